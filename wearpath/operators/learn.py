"""Model fitting on MLlib: training-only preprocessing, weights, out-of-fold predictions, selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassificationModel, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import arg_max, clip, soft_gates
from ..session import materialise
from .quality import DataQualityError
from .splits import perturb

SEED = 42


@dataclass(frozen=True)
class Scaling:
    """Columns that vary in the fitting rows, with their mean and population deviation."""

    kept: tuple[str, ...]
    mean: dict[str, float]
    std: dict[str, float]

    def columns(self, suffix: str = "") -> dict[str, Column]:
        return {c + suffix: (F.col(c) - self.mean[c]) / self.std[c] for c in self.kept}


def fit_scaling(train: DataFrame, features: Sequence[str], weight: str | None = None) -> Scaling:
    """One aggregate over the fitting rows; with weights the mean and deviation are weighted too."""
    if weight is None:
        parts = [f(c).alias(f"{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = train.agg(*parts).first()
        mean = {c: row[f"m_{c}"] for c in features}
        std = {c: row[f"s_{c}"] for c in features}
    else:
        w = F.col(weight)
        first = train.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in features]).first()
        mean = {c: first[c] for c in features}
        second = train.agg(*[F.sqrt(F.sum(w * (F.col(c) - mean[c]) ** 2) / F.sum(w)).alias(c) for c in features]).first()
        std = {c: second[c] for c in features}
    kept = tuple(c for c in features if std[c] is not None and std[c] > 0)
    return Scaling(kept, {c: float(mean[c]) for c in kept}, {c: float(std[c]) for c in kept})


def scaled_pipeline(train: DataFrame, features: Sequence[str], model, weight: str | None = None) -> Pipeline:
    """Scaling fitted on ``train`` only, written as a SQL stage so that it saves and loads with the model."""
    scaling = fit_scaling(train, features, weight)
    if not scaling.kept:
        raise DataQualityError("no feature varies in the fitting rows")
    parts = ", ".join(f"(`{c}` - {scaling.mean[c]!r}D) / {scaling.std[c]!r}D AS `__z_{c}`" for c in scaling.kept)
    assemble = VectorAssembler(inputCols=[f"__z_{c}" for c in scaling.kept], outputCol="features")
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__"), assemble, model])


def apply_model(model: PipelineModel, df: DataFrame, low: float | None = None, high: float | None = None,
                name: str = "predicted", offset: float = 0.0) -> DataFrame:
    """Predictions within bounds; the helper columns are dropped."""
    out = model.transform(df).withColumn(name, clip(F.col("prediction") + offset, low, high))
    return out.select(*[c for c in df.columns if c != name], name)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# -- model families ------------------------------------------------------------------
def linear(target: str, ridge: float = 0.0, weight: str | None = None) -> LinearRegression:
    model = LinearRegression(featuresCol="features", labelCol=target, regParam=ridge, elasticNetParam=0.0, solver="normal", standardization=False)
    return model.setWeightCol(weight) if weight else model


def forest(target: str, trees: int = 40, depth: int = 8, weight: str | None = None) -> RandomForestRegressor:
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=SEED)
    return model.setWeightCol(weight) if weight else model


def boosted(target: str, rounds: int = 20, depth: int = 4) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=SEED)


def forest_classifier(target: str, trees: int = 40, depth: int = 8, weight: str | None = None) -> RandomForestClassifier:
    model = RandomForestClassifier(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=SEED)
    return model.setWeightCol(weight) if weight else model


def logistic(target: str, weight: str = "weight") -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=target, weightCol=weight, maxIter=50)


def balanced_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (classes x rows of the class), from a per-class count joined back."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    totals = counts.agg((F.sum("__n") / F.count("*")).alias("share")).scalar()
    return df.join(counts, label).withColumn(name, totals / F.col("__n")).drop("__n")


def fit(train: DataFrame, features: Sequence[str], model, weight: str | None = None) -> PipelineModel:
    return scaled_pipeline(train, features, model, weight).fit(train)


# -- importances -----------------------------------------------------------------------
def tree_nodes(model: PipelineModel, features: Sequence[str] | None = None) -> DataFrame:
    """The inner nodes of a fitted ensemble's trees as a table: tree, feature, gain, rows (weighted), tree_weight.

    The last stage is written to the shared folder and its node table read back; nodes never pass the driver.
    """
    from pyspark.sql import SparkSession

    from ..session import shared_folder

    spark = SparkSession.active()
    stage = model.stages[-1]
    if features is None:
        features = [c.removeprefix("__z_") for c in model.stages[-2].getInputCols()]
    path = shared_folder(spark, "nodes") + "/model"
    stage.write().save(path)
    trees = spark.createDataFrame([(i, float(w)) for i, w in enumerate(stage.treeWeights)], "tree long, tree_weight double")  # one row a tree
    data = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID").cast("long") if "treeID" in data.columns else F.lit(0).cast("long")
    node = data.select(tree.alias("tree"), F.col("nodeData.*") if "nodeData" in data.columns else "*")
    # The weight of a node's rows: for variance the first of its impurity statistics, for classes their sum.
    stats = F.col("impurityStats")
    classes = isinstance(stage, (RandomForestClassificationModel, DecisionTreeClassificationModel))
    rows = F.aggregate(stats, F.lit(0.0), lambda a, v: a + v) if classes else F.get(stats, F.lit(0))
    inner = node.filter("leftChild >= 0").select("tree", F.element_at(F.array(*[F.lit(c) for c in features]), F.col("split.featureIndex") + 1).alias("feature"),
                                                 "gain", rows.alias("rows"))
    return inner.join(trees, "tree")


def importances(model: PipelineModel, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, importance): gain times rows summed over nodes, scaled to one.

    Forests scale each tree to one first; boosted trees, whose later trees matter less, do not.
    """
    per = tree_nodes(model, features).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"))
    if not isinstance(model.stages[-1], (GBTRegressionModel, GBTClassificationModel)):
        trees = per.groupBy("tree").agg(F.sum("g").alias("total"))
        per = per.join(trees, "tree").withColumn("g", F.try_divide("g", "total"))
    shares = per.groupBy("feature").agg(F.sum("g").alias("g"))
    return shares.select("feature", (F.col("g") / shares.agg(F.sum("g")).scalar()).alias("importance"))


# -- out of fold -----------------------------------------------------------------------
def out_of_fold(df: DataFrame, fold: str, folds: Sequence, fit_fold: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Each row scored by the fit that never saw its fold. ``fit_fold(train)`` returns a scorer."""
    parts = []
    for k in folds:
        score = fit_fold(df.filter(F.col(fold) != F.lit(k)))
        parts.append(score(df.filter(F.col(fold) == F.lit(k))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def regression_oof(df, fold, folds, features, model, low=0.0, high=None, weight=None) -> DataFrame:
    def fit_fold(train):
        fitted = fit(train, features, model, weight)
        return lambda held: apply_model(fitted, held, low, high)

    return out_of_fold(df, fold, folds, fit_fold)


def linear_by_group(df: DataFrame, group: str, features: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """(group, __a: intercept, __b: coefficients) of the least-squares fit on all rows of other groups, for every group.

    One aggregate a group gives the moments, one more their totals; a group's normal equations are the totals less its own
    moments, solved inside tasks for a batch of groups at a time. So the table is read twice however many groups there
    are, and no group's fit passes the driver. Columns are centred first, so that the difference keeps its digits.
    """
    centre = df.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first()  # one row of means
    shift = {c: float(centre[c]) if centre[c] is not None else 0.0 for c in [*features, target]}
    x = [F.lit(1.0), *[F.col(c) - shift[c] for c in features]]
    y = F.col(target) - shift[target]
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = df.groupBy(group).agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * y).alias(f"b{i}") for i in range(p)])
    names = [f"a{i}_{j}" for i, j in pairs] + [f"b{i}" for i in range(p)]
    totals = sums.agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    moments = sums.crossJoin(F.broadcast(totals)).select(group, *[(F.col(f"t_{n}") - F.col(n)).alias(n) for n in names])  # one row of totals
    kind = df.schema[group].dataType.simpleString()

    def solve(batches):
        for batch in batches:
            n = batch.num_rows
            left, right = np.zeros((n, p, p)), np.zeros((n, p))
            for at, (i, j) in enumerate(pairs, 1):
                left[:, i, j] = left[:, j, i] = batch.column(at).to_numpy(zero_copy_only=False)
            for i in range(p):
                right[:, i] = batch.column(1 + len(pairs) + i).to_numpy(zero_copy_only=False)
            left, right = np.nan_to_num(left), np.nan_to_num(right)
            inner = np.arange(1, p)
            left[:, inner, inner] += ridge * left[:, :1, 0]
            # Scaled to unit diagonal, so that a column that does not vary is told by its eigenvalue.
            scale = np.sqrt(np.maximum(np.diagonal(left, axis1=1, axis2=2), 0))
            scale[scale == 0] = 1.0
            beta = (np.linalg.pinv(left / scale[:, :, None] / scale[:, None, :], rcond=1e-12, hermitian=True) @ (right / scale)[:, :, None])[:, :, 0] / scale
            start = shift[target] + beta[:, 0] - beta[:, 1:] @ np.array([shift[c] for c in features])
            weights = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (p - 1), pa.array(beta[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), weights], [group, "__a", "__b"])

    return moments.mapInArrow(solve, f"`{group}` {kind}, __a double, __b array<double>")


def linear_by_fold(df: DataFrame, fold: str, features: Sequence[str], target: str, ridge: float = 0.0) -> list[tuple]:
    """(fold, intercept, coefficients) of `linear_by_group` as a list, for a few folds."""
    return sorted((row[fold], row["__a"], list(row["__b"])) for row in linear_by_group(df, fold, features, target, ridge).collect())


def linear_oof(df: DataFrame, fold: str, features: Sequence[str], target: str, low: float | None = 0.0, high: float | None = None,
               ridge: float = 0.0, name: str = "predicted", train: DataFrame | None = None) -> DataFrame:
    """Out-of-fold least squares for any number of folds, units as folds included: coefficient rows joined by fold.

    The fits are written, so that their size is known when the join is planned: those of a few folds are broadcast and no
    row is dealt by its fold. ``train``: the rows to fit on where ``df`` only adds columns to them.
    """
    fits = materialise(linear_by_group(df if train is None else train, fold, features, target, ridge).withColumnRenamed(fold, "__fold"), "fits")
    value = F.col("__a")
    for i, c in enumerate(features):
        value = value + F.get("__b", i) * F.col(c)
    return df.join(fits, F.col(fold).eqNullSafe(F.col("__fold"))).withColumn(name, clip(value, low, high)).drop("__a", "__b", "__fold")


def weighted_linear(df: DataFrame, features: Sequence[str], target: str, weights: dict[str, Column]) -> dict[str, Column]:
    """Least-squares predictions for several weightings of the same rows, fitted in one aggregate pass."""
    centre = df.agg(*[F.avg(c).alias(c) for c in [*features, target]]).first()
    x = [F.lit(1.0), *[F.col(c) - float(centre[c]) for c in features]]
    y = F.col(target) - float(centre[target])
    p = len(x)
    row = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"{n}_a{i}_{j}") for n, w in weights.items() for i in range(p) for j in range(i, p)],
                 *[F.sum(w * x[i] * y).alias(f"{n}_b{i}") for n, w in weights.items() for i in range(p)]).first()
    out = {}
    for n in weights:
        a = np.array([[row[f"{n}_a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        beta = np.linalg.lstsq(a, np.array([row[f"{n}_b{i}"] for i in range(p)]), rcond=None)[0]
        value = F.lit(float(centre[target]) + float(beta[0]))
        for i, c in enumerate(features):
            value = value + float(beta[i + 1]) * (F.col(c) - float(centre[c]))
        out[n] = value
    return out


def classification_oof(df, fold, folds, features, model, key: Sequence[str], stress: bool = False, weight=None) -> DataFrame:
    """Class and raw confidence per held-out row; with ``stress`` also the class of the perturbed row."""
    def fit_fold(train):
        fitted = fit(train, features, model, weight)

        def score(held):
            sides = [held.withColumn("side", F.lit("clean"))]
            if stress:
                sides.append(perturb(held, train, key, features).withColumn("side", F.lit("perturbed")))
            rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
            out = fitted.transform(rows)
            return out.select(*held.columns, "side", F.col("prediction").cast("int").alias("predicted"),
                              F.array_max(vector_to_array("probability")).alias("raw_confidence"))

        return score

    return out_of_fold(df, fold, folds, fit_fold)


def labelled(probability: str, names: Sequence[str]) -> Column:
    return arg_max(names, vector_to_array(F.col(probability)))


# -- targets ---------------------------------------------------------------------------
def encode_target(rul: Column, age: Column, how: str, cap: float | None = None) -> Column:
    value = clip(rul, 0.0, cap)
    if how == "plain":
        return value
    if how == "log":
        return F.log1p(value)
    if how == "lifetime":
        return rul + age
    raise ValueError(f"unknown target {how!r}")


def decode_target(predicted: Column, age: Column, how: str) -> Column:
    if how == "log":
        predicted = F.expm1(clip(predicted, 0.0, 20.0))
    elif how == "lifetime":
        predicted = predicted - age
    return F.greatest(predicted, F.lit(0.0))


def blend(first: Column, second: Column, share: float = 0.5) -> Column:
    return (1 - share) * first + share * second


# -- condition clusters ------------------------------------------------------------------
def condition_gates(df: DataFrame, features: Sequence[str], clusters: int, width: float = 1.0, weight: str | None = None) -> DataFrame:
    """Soft membership of each row in weighted k-means conditions (``gates`` sums to 1)."""
    scaling = fit_scaling(df, features, weight)
    rows = VectorAssembler(inputCols=[f"__z_{c}" for c in scaling.kept], outputCol="__at").transform(df.withColumns(
        {f"__z_{c}": v for c, v in ((c, col) for c, col in scaling.columns().items())}))
    means = KMeans(featuresCol="__at", k=clusters, seed=SEED, maxIter=20)
    model = (means.setWeightCol(weight) if weight else means).fit(rows)
    centres = model.clusterCenters()
    distance = [F.sqrt(sum(((F.col(f"__z_{c}") - float(centre[i])) ** 2 for i, c in enumerate(scaling.kept)), F.lit(0.0))) for centre in centres]
    return rows.withColumn("gates", soft_gates(F.array(*distance), width)).drop("__at", *[f"__z_{c}" for c in scaling.kept])


def condition_blend(df: DataFrame, local: Sequence[str], overall: str, share: float = 0.5, gates: str = "gates") -> Column:
    """Gate-weighted mean of the local predictions, blended with the global one."""
    mixed = sum((F.get(gates, i) * F.col(c) for i, c in enumerate(local)), F.lit(0.0))
    return blend(F.col(overall), mixed, share)


# -- simple predictors -------------------------------------------------------------------
def fold_statistic(df: DataFrame, fold: str, folds: Sequence, target: str, how: str = "median") -> DataFrame:
    """Median or mean of the other folds' target, one row per fold: the baseline predictor out of fold."""
    from .order_stats import counted_quantile
    from .order_stats import linear as interpolated

    if how == "median":
        # Rows are counted per fold and value first; only these counts go to the other folds.
        per = materialise(df.groupBy(fold, F.col(target).cast("double").alias("__value")).agg(F.count("*").alias("__n")), "fold-values")
        away = per.select(F.explode(F.array_remove(F.array(*[F.lit(k) for k in folds]), F.col(fold))).alias(fold), "__value", "__n")
        counted = materialise(away.groupBy(fold, "__value").agg(F.sum("__n").alias("__n")), "away-values")
        return materialise(counted_quantile(counted, [fold], "__value", "__n", "predicted", interpolated(0.5)), "medians")
    sums = df.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(fold, ((total.select("s").scalar() - F.col("s")) / (total.select("n").scalar() - F.col("n"))).alias("predicted"))


def most_frequent(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Commonest class (the smaller on ties), from counts."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.max_by(label, F.struct("__n", -F.col(label).cast("double"))).alias("predicted"))


def with_median_predictor(df: DataFrame, train: DataFrame, target: str) -> DataFrame:
    from .order_stats import median, quantiles

    return df.withColumn("predicted", quantiles(train, [], {"m": median(target)}).scalar())


