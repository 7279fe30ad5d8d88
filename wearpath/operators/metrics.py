"""Scores of predictions: rows (unit, cycle, actual, predicted[, fold, lower, upper, accepted])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import life_phase, rul_band
from .order_stats import median, quantiles

PHASES = ("early", "middle", "late")


def regression_scores(actual: Column, predicted: Column) -> dict[str, Column]:
    error = predicted - actual
    return {
        "mae": F.avg(F.abs(error)), "rmse": F.sqrt(F.avg(error * error)),
        "r2": 1 - F.try_divide(F.sum(error * error), F.var_pop(actual) * F.count(actual)),
        "bias": F.avg(error),
    }


def late_penalty(actual: Column, predicted: Column) -> Column:
    """Sum of exp(-e/13)-1 for early and exp(e/10)-1 for late predictions."""
    e = predicted - actual
    return F.sum(F.when(e < 0, F.exp(-e / 13) - 1).otherwise(F.exp(e / 10) - 1))


def near_failure_scores(actual: Column, predicted: Column, near: float = 30) -> dict[str, Column]:
    e = F.when(actual <= near, predicted - actual)
    return {"near_bias": F.avg(e), "near_late_rate": F.avg((e > 0).cast("double"))}


def safety_scores(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, late-prediction diagnostics and the two selection objectives built from them."""
    parts = regression_scores(actual, predicted) | near_failure_scores(actual, predicted) | {
        "average_penalty": late_penalty(actual, predicted) / F.count("*")}
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])
    late = F.greatest(F.coalesce("near_bias", F.lit(0.0)), F.lit(0.0))
    return out.withColumns({
        "safety_objective": F.col("rmse") + 1.5 * late + 0.5 * F.col("average_penalty"),
        "selection_score": F.col("rmse") + 0.5 * late})


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("rows"))


def class_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class seen in either column; undefined ratios are 0
    except recall, which is null for a class that never occurs."""
    table = confusion(df, actual, predicted, by)
    sides = F.array(F.struct(F.col("actual").alias("label"), F.col("rows").alias("s"), F.lit(0).cast("long").alias("p")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("s"), F.col("rows").alias("p")))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0)
    per = table.select(*by, hit.alias("hit"), F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted_rows"),
        (F.sum("hit") / 2).cast("long").alias("true_positive"))
    tp = F.col("true_positive")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.withColumns({
        "precision": zero(tp, F.col("predicted_rows")), "recall": F.try_divide(tp, F.col("support")),
        "f1": zero(2 * tp, F.col("support") + F.col("predicted_rows"))})


def classification_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy (classes that occur) and macro F1 (classes seen on either side)."""
    per = class_report(df, actual, predicted, by)
    return per.groupBy(*by).agg(
        (F.sum("true_positive") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def unit_errors(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    return df.groupBy(*unit).agg(F.count("*").alias("rows"), F.avg(F.abs(e)).alias("mae"),
                                 F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def unit_mean_scores(df: DataFrame, unit: str = "unit", by: Sequence[str] = ()) -> DataFrame:
    """Scores per unit, then an unweighted mean over units."""
    per = unit_errors(df, [*by, unit])
    return per.groupBy(*by).agg(F.count("*").alias("units"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                                F.avg("bias").alias("bias"))


def detection_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Binary detector quality: classification scores, false alarms and detections."""
    a, p = F.col(actual), F.col(predicted)
    rates = df.groupBy(*by).agg(
        F.avg((a == p).cast("double")).alias("accuracy"),
        F.avg(F.when(a == 0, p)).alias("false_alarm_rate"), F.avg(F.when(a == 1, p)).alias("detection_rate"),
        F.sum(F.when((a == 1) & (p == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when((a == 0) & (p == 0), 1).otherwise(0)).alias("tn"),
        F.sum(F.when((a == 0) & (p == 1), 1).otherwise(0)).alias("fp"), F.sum(F.when((a == 1) & (p == 0), 1).otherwise(0)).alias("fn"))
    f1 = lambda t: F.try_divide(2 * F.col(t), 2 * F.col(t) + F.col("fp") + F.col("fn"))
    present = lambda *c: F.aggregate(F.array_compact(F.array(*c)), F.lit(0.0), lambda x, v: x + v) / F.greatest(F.size(F.array_compact(F.array(*c))), F.lit(1))
    return rates.withColumns({
        "balanced_accuracy": present(1 - F.col("false_alarm_rate"), F.col("detection_rate")),
        "macro_f1": present(f1("tp"), f1("tn"))}).drop("tp", "tn", "fp", "fn")


def error_slices(df: DataFrame, slices: dict[str, Column], unit: str = "unit") -> DataFrame:
    """The error summary of every slice value, from one pass: rows are folded to (slice, key, unit)
    before the shuffle and units are averaged after it. A null key leaves a row out of that slice."""
    e = F.col("predicted") - F.col("actual")
    floor = F.col("cap_error_floor") if "cap_error_floor" in df.columns else F.lit(0.0)
    cells = F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("key")) for n, c in slices.items()])
    per = df.select(unit, e.alias("e"), floor.alias("floor"), F.inline(cells)).filter(F.col("key").isNotNull()).groupBy(
        "slice", "key", unit).agg(F.count("*").alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") ** 2).alias("q"),
                                  F.sum("e").alias("s"), F.count_if(F.col("e") > 10).alias("over"), F.sum("floor").alias("f"))
    n = F.sum("n")
    return per.groupBy("slice", "key").agg(
        n.alias("rows"), F.count("*").alias("units"), (F.sum("a") / n).alias("row_mae"), F.sqrt(F.sum("q") / n).alias("row_rmse"),
        F.avg(F.col("a") / F.col("n")).alias("unit_mean_mae"), F.avg(F.sqrt(F.col("q") / F.col("n"))).alias("unit_mean_rmse"),
        (F.sum("s") / n).alias("bias"), (F.sum("over") / n).alias("over_10_rate"), (F.sum("f") / n).alias("cap_error_floor"))


def standard_slices(df: DataFrame) -> DataFrame:
    """All rows, phases, life bands and units."""
    return error_slices(df, {"all": F.lit("all"), "phase": life_phase(F.col("cycle"), F.col("actual")),
                             "rul_band": rul_band(F.col("actual")), "unit": F.col("unit")})


def balanced_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unit- and phase-balanced errors, one row (per ``by``).

    ``complete`` is false when some unit lacks a phase: the scores then are not comparable.
    """
    e = F.col("predicted") - F.col("actual")
    phase = life_phase(F.col("cycle"), F.col("actual"))
    near = F.col("actual") <= 30
    cells = df.select(*by, "unit", phase.alias("phase"), e.alias("e"), near.alias("near")).groupBy(*by, "unit", "phase").agg(
        F.count("*").alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") ** 2).alias("q"),
        F.count_if("near").alias("near_n"), F.sum(F.when(F.col("near"), F.abs("e")).otherwise(0.0)).alias("near_a"),
        F.count_if(F.col("near") & (F.col("e") > 10)).alias("near_over"))
    at = lambda p, c: F.max(F.when(F.col("phase") == p, c))
    per_unit = cells.groupBy(*by, "unit").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("q").alias("q"), F.sum("near_n").alias("near_n"),
        F.sum("near_a").alias("near_a"), F.sum("near_over").alias("near_over"), F.count("*").alias("phases"),
        *[at(p, F.col("a") / F.col("n")).alias(f"{p}_mae") for p in PHASES],
        *[at(p, F.sqrt(F.col("q") / F.col("n"))).alias(f"{p}_rmse") for p in PHASES])
    out = per_unit.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.count("*").alias("units"), F.avg(F.col("a") / F.col("n")).alias("unit_mean_mae"),
        F.avg(F.sqrt(F.col("q") / F.col("n"))).alias("unit_mean_rmse"), F.max(F.col("a") / F.col("n")).alias("worst_unit_mae"),
        F.avg(F.try_divide("near_a", "near_n")).alias("near_failure_unit_mae"),
        F.avg(F.try_divide("near_over", "near_n")).alias("near_failure_over_by_10_rate"),
        (F.min("phases") == 3).alias("complete"),
        *[F.avg(f"{p}_{k}").alias(f"{p}_unit_mean_{k}") for p in PHASES for k in ("mae", "rmse")])
    mean = sum((F.col(f"{p}_unit_mean_mae") for p in PHASES), F.lit(0.0)) / 3
    return out.withColumn("balanced_phase_mae", mean)


def interval_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    return df.groupBy(*by).agg(F.avg(inside.cast("double")).alias("coverage"),
                               F.avg(F.col("upper") - F.col("lower")).alias("mean_width"))


def acceptance_scores(df: DataFrame, accepted: Column, correct: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share accepted and accuracy among the accepted (null when nothing is)."""
    return df.groupBy(*by).agg(F.avg(accepted.cast("double")).alias("coverage"),
                               F.avg(F.when(accepted, correct.cast("double"))).alias("accepted_accuracy"))


def capped_report(df: DataFrame, cap: float) -> DataFrame:
    """Raw and capped scores, mean and median absolute error of terminal rows, one row per view."""
    views = F.array(F.struct(F.lit("raw").alias("view"), F.col("actual").cast("double").alias("y")),
                    F.struct(F.lit("capped").alias("view"), F.least(F.col("actual"), F.lit(cap)).cast("double").alias("y")))
    long = df.select("predicted", F.inline(views)).withColumn("away", F.abs(F.col("predicted") - F.col("y")))
    scores = regression_scores(F.col("y"), F.col("predicted")) | {"penalty": late_penalty(F.col("y"), F.col("predicted"))}
    table = long.groupBy("view").agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in scores.items()])
    return table.join(quantiles(long, ["view"], {"median_absolute_error": median("away")}), "view")


def required_detection_rate(target_accuracy: Column, false_alarm: Column, normal: Column, abnormal: Column) -> Column:
    """Detection rate that would reach the accuracy at the given false-alarm rate."""
    return (target_accuracy * (normal + abnormal) - normal * (1 - false_alarm)) / abnormal


def beyond_other_folds(df: DataFrame, fold: str, name: str = "beyond") -> DataFrame:
    """Marks rows whose whole life exceeds every life in the other folds."""
    tops = df.groupBy(fold).agg(F.max(F.col("cycle") + F.col("actual")).alias("__top"))
    first = tops.agg(F.max("__top")).scalar()
    second = tops.orderBy(F.desc("__top")).limit(2).agg(F.min("__top")).scalar()
    others = tops.withColumn("__limit", F.when(F.col("__top") < first, first).otherwise(second)).drop("__top")
    return df.join(others, fold).withColumn(name, F.col("cycle") + F.col("actual") > F.col("__limit")).drop("__limit")
