"""Intervals, input support and calibrated abstention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, name_of_each
from .order_stats import conformal, quantiles
from .series import series

REJECT_ALL = 1.0 + 2.0 ** -52  # the next number above one: no confidence reaches it


def conformal_radius(errors: DataFrame, error: str, alpha: float, by: Sequence[str] = (), name: str = "radius") -> DataFrame:
    absolute = errors.withColumn("__abs", F.abs(error))
    return quantiles(absolute, by, {name: ("__abs", 1 - alpha, conformal(alpha))})


def interval(predicted: Column, radius: Column, low: float | None = 0.0, high: float | None = None) -> dict[str, Column]:
    return {"lower": clip(predicted - radius, low, high), "upper": clip(predicted + radius, low, high)}


def support_flags(bounds: dict[str, dict[str, float]]) -> dict[str, Column]:
    """Per row: features outside the fitted range, features in the 1 % tails, and whether to abstain.

    ``bounds``: feature -> hard_min, hard_max, q01, q99. The judgement is per row, so one strange row
    never rejects the others.
    """
    names = sorted(bounds)
    hard = name_of_each([(n, (F.col(n) < bounds[n]["hard_min"]) | (F.col(n) > bounds[n]["hard_max"])) for n in names])
    tail = name_of_each([(n, (F.col(n) < bounds[n]["q01"]) | (F.col(n) > bounds[n]["q99"])) for n in names])
    return {"hard_violations": hard, "tail_warnings": tail, "abstain": F.size(hard) > 0}


def fit_isotonic(df: DataFrame, raw: str, correct: str):
    """Non-decreasing calibration of correctness, fitted on one weighted row per distinct raw score."""
    folded = df.groupBy(F.col(raw).cast("double").alias("raw")).agg(
        F.avg(F.col(correct).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    rows = VectorAssembler(inputCols=["raw"], outputCol="features").transform(folded)
    return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(rows)


def apply_isotonic(model, df: DataFrame, raw: str, name: str = "confidence") -> DataFrame:
    rows = VectorAssembler(inputCols=[raw], outputCol="__raw").transform(df)
    scored = model.setFeaturesCol("__raw").setPredictionCol(name).transform(rows)
    return scored.drop("__raw").withColumn(name, clip(F.col(name), 0.0, 1.0))


def acceptance_threshold(df: DataFrame, confidence: str, correct: str, accuracy: float = 0.90, coverage: float = 0.20, **layout) -> float:
    """Smallest confidence whose accepted rows are numerous and accurate enough, else reject everything."""
    levels = df.groupBy(F.col(confidence).alias("level")).agg(
        F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("right"))
    total = levels.agg(F.sum("n")).first()[0]
    walked = series(levels, (), "level", **layout).running(True, n_above=("sum", F.col("n")), right_above=("sum", F.col("right")))
    fits = (F.col("n_above") / total >= coverage) & (F.col("right_above") / F.col("n_above") >= accuracy)
    found = walked.df.filter(fits).agg(F.min("level")).first()[0]
    return REJECT_ALL if found is None else float(found)


def accepted(confidence: Column, threshold: float, supported: Column) -> Column:
    return (confidence >= threshold) & supported
