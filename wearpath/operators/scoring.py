"""Scoring requests of a component: estimate with interval, class with confidence, input support, acceptance, warnings.

Fits are made on training rows only; their constants (coefficients, a radius, bounds, class centres) are a few numbers and
are applied in generated code. Results of all components have the same columns, `RESULT`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import notes
from . import calibrate, learn, profile

RESULT = ("component", "output", "estimate", "lower", "upper", "label", "confidence", "accepted", "warnings")
# What a request is told.
OUTSIDE, TAIL, UNSTABLE, SHORT, UNSURE = "outside training support", "tail of the training range", "unstable condition", "limited history", "low confidence"
EXPERIMENTAL, UNANSWERED = "experimental: review required", "no model response"


@dataclass(frozen=True)
class Estimate:
    model: PipelineModel
    radius: float
    bounds: dict[str, dict]
    low: float | None
    high: float | None


def fit_estimate(train: DataFrame, features: Sequence[str], target: str, low: float | None, high: float | None, alpha: float = 0.05) -> Estimate:
    model = learn.fit(train, features, learn.linear(target))
    scored = learn.apply_model(model, train, low, high).withColumn("__error", F.col(target) - F.col("predicted"))
    radius = calibrate.conformal_radius(scored, "__error", alpha).first()["radius"]
    return Estimate(model, float(radius), _bounds(train, features), low, high)


def _bounds(train: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    return {b["feature"]: b.asDict() for b in profile.support_bounds(train, features).collect()}  # one row a feature


def _supported(rows: DataFrame, bounds: dict[str, dict]) -> DataFrame:
    """Adds ``__lost`` (an input is missing), ``__outside`` (that, or beyond the fitted range) and ``__tail``."""
    flags = calibrate.support_flags(bounds)
    lost = F.lit(False)
    for c in bounds:
        lost = lost | F.col(c).isNull() | F.isnan(c)
    return rows.withColumns({"__lost": lost, "__outside": F.coalesce(flags["abstain"], F.lit(False)) | lost, "__tail": F.size(flags["tail_warnings"]) > 0})


def estimated(rows: DataFrame, fitted: Estimate, component: str, output: str, *more: tuple[Column, str]) -> DataFrame:
    """Rows with `RESULT` columns added; ``more``: further conditions and their warnings."""
    outside, tail = F.col("__outside"), F.col("__tail")
    filled = _supported(rows, fitted.bounds).na.fill(0.0, list(fitted.bounds))
    scored = learn.apply_model(fitted.model, filled, fitted.low, fitted.high, "__estimate").withColumn("estimate", F.when(~F.col("__lost"), F.col("__estimate")))
    band = calibrate.interval(F.col("estimate"), F.lit(fitted.radius))
    return scored.withColumns({
        "component": F.lit(component), "output": F.lit(output), "lower": band["lower"], "upper": band["upper"], "label": F.lit(None).cast("int"),
        "confidence": F.lit(None).cast("double"), "accepted": ~outside, "warnings": F.concat_ws("; ", notes((outside, OUTSIDE), (~outside & tail, TAIL), *more))}).drop("__estimate", "__lost", "__outside", "__tail")


@dataclass(frozen=True)
class Centres:
    """Class centres in units of the pooled deviation of each feature."""

    classes: tuple[tuple[int, tuple[float, ...]], ...]
    spread: tuple[float, ...]
    features: tuple[str, ...]
    threshold: float
    bounds: dict[str, dict]


def _shares(rows: DataFrame, features: Sequence[str], classes, spread) -> DataFrame:
    """Softmax of negative half squared distances to the centres; the class with the largest share, the first on ties."""
    def distance(centre):
        return sum((((F.col(c) - m) / s) ** 2 for c, m, s in zip(features, centre, spread)), F.lit(0.0)) / 2

    raised = F.array(*[-distance(centre) for _, centre in classes])
    top = F.array_max(raised)
    weights = F.transform(raised, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(int(k)) for k, _ in classes])
    place = (F.array_position(raised, top) - 1).cast("int")
    return rows.withColumns({"label": F.get(names, place), "confidence": F.round(1 / total, 6)})


def fit_centres(train: DataFrame, features: Sequence[str], label: str, accuracy: float = 0.9, coverage: float = 0.2) -> Centres:
    """Centres, pooled deviation and the confidence from which training rows are right often enough."""
    means = train.groupBy(label).agg(*[F.avg(c).alias(c) for c in features]).orderBy(label).collect()  # one row a class
    within = train.join(train.groupBy(label).agg(*[F.avg(c).alias(f"__m_{c}") for c in features]), label)
    row = within.agg(*[F.sqrt(F.avg((F.col(c) - F.col(f"__m_{c}")) ** 2)).alias(c) for c in features]).first()
    classes = tuple((int(m[label]), tuple(float(m[c]) for c in features)) for m in means)
    spread = tuple(float(row[c]) or 1.0 for c in features)
    scored = _shares(train.withColumnRenamed(label, "__known"), features, classes, spread).withColumn("__right", F.col("label") == F.col("__known"))
    threshold = calibrate.acceptance_threshold(scored.select("confidence", "__right"), "confidence", "__right", accuracy, coverage)
    return Centres(classes, spread, tuple(features), threshold, _bounds(train, features))


def classified(rows: DataFrame, fitted: Centres, component: str, output: str, refuse: Column | None = None, *more: tuple[Column, str]) -> DataFrame:
    """Rows with `RESULT` columns added; ``refuse``: rows that are never accepted."""
    outside, tail = F.col("__outside"), F.col("__tail")
    refuse = F.lit(False) if refuse is None else F.coalesce(refuse, F.lit(False))
    sure = F.coalesce(F.col("confidence") >= fitted.threshold, F.lit(False))
    empty = F.lit(None).cast("double")
    return _shares(_supported(rows, fitted.bounds), fitted.features, fitted.classes, fitted.spread).withColumns({
        "component": F.lit(component), "output": F.lit(output), "estimate": empty, "lower": empty, "upper": empty, "accepted": sure & ~outside & ~refuse,
        "warnings": F.concat_ws("; ", notes((outside, OUTSIDE), (~outside & tail, TAIL), (~sure, UNSURE), *more))}).drop("__lost", "__outside", "__tail")


def flagged(samples: DataFrame, channels: dict[str, tuple[float, float]], limit: float, component: str) -> DataFrame:
    """Alerts per request: samples whose largest scaled distance from the normal centre exceeds the limit. Never accepted unseen."""
    far = F.greatest(*[F.abs(F.col(c) - m) / s for c, (m, s) in channels.items()], F.lit(0.0)) > limit
    per = samples.groupBy("bundle_id").agg(F.count_if(far).cast("double").alias("estimate"), F.count("*").alias("samples"))
    empty = F.lit(None).cast("double")
    return per.withColumns({
        "component": F.lit(component), "output": F.lit("alerts"), "lower": empty, "upper": empty, "label": (F.col("estimate") > 0).cast("int"), "confidence": empty,
        "accepted": F.lit(False), "warnings": F.concat_ws("; ", notes((F.col("samples") < 5, SHORT), (F.lit(True), EXPERIMENTAL)))})


def unanswered(requests: DataFrame, results: DataFrame, component: str, output: str) -> DataFrame:
    """Requests of a component for which no result came."""
    missing = requests.select("bundle_id").join(results.select("bundle_id"), "bundle_id", "left_anti")
    kinds = {"estimate": "double", "lower": "double", "upper": "double", "label": "int", "confidence": "double"}
    return missing.withColumns({"component": F.lit(component), "output": F.lit(output), **{c: F.lit(None).cast(t) for c, t in kinds.items()}, "accepted": F.lit(False), "warnings": F.lit(UNANSWERED)})


def preflight_status(results: DataFrame) -> DataFrame:
    """Checks before any prediction: what of a result depends on inputs alone."""
    status = (F.when(F.col("component") == "fuel-system", "not_assessed").when(F.col("warnings").contains(UNANSWERED) | F.col("warnings").contains(OUTSIDE) | F.col("warnings").contains(UNSTABLE)
              | F.col("warnings").contains(SHORT), "review_required").when(F.col("warnings").contains(TAIL), "tail_range").otherwise("supported"))
    return results.withColumn("status", status)
