"""Normal-only anomaly detectors: fitted statistics are small tables, scoring is column arithmetic.

Every function takes ``by``: the columns that name a fit (fold, candidate ...), so all cells of an
experiment are fitted and scored in the same jobs instead of one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import interpolating_asof
from .order_stats import higher, quantiles
from .profile import melt, robust_scale, shrink
from .quality import DataQualityError, require
from .selection import row_aggregate
from .series import Series, series

LEAST_NORMAL_ROWS = 12


def smooth(s: Series, channels: Sequence[str], window: int, how: str = "median", suffix: str = "") -> Series:
    """Trailing median or mean of each channel inside a segment."""
    if window == 1:
        return s.select(**{c + suffix: F.col(c) for c in channels})
    pick = (lambda c: F.percentile(c, 0.5)) if how == "median" else F.avg
    if suffix:
        return s.trailing(window, lambda f: {c + suffix: pick(c).over(f.last(window)) for c in channels})
    held = s.trailing(window, lambda f: {f"__{c}": pick(c).over(f.last(window)) for c in channels})
    moved = held.select(**{c: F.col(f"__{c}") for c in channels})
    return moved.using(moved.df.drop(*[f"__{c}" for c in channels]))


def fit_envelope(normal: DataFrame, channels: Sequence[str], by: Sequence[str] = (), abnormal: str | None = None) -> DataFrame:
    """Robust centre and scale per channel as arrays, one row per fit."""
    if abnormal is not None:
        require(normal.filter(F.col(abnormal) != 0).select(abnormal), "envelopes are fitted on normal rows only")
    long = melt(normal, list(by), channels, "__channel", "__value")
    scale = robust_scale(long, [*by, "__channel"], "__value")
    pick = lambda c, v: F.max(F.when(F.col("__channel") == c, F.col(v)))
    sizes = normal.groupBy(*by).agg(F.count("*").alias("fit_rows"))
    fits = scale.groupBy(*by).agg(F.array(*[pick(c, "centre") for c in channels]).alias("centre"),
                                  F.array(*[pick(c, "scale") for c in channels]).alias("scale"))
    if not by:
        rows = sizes.first()["fit_rows"]
        if rows < LEAST_NORMAL_ROWS:
            raise DataQualityError("at least twelve normal rows are required")
        return fits.withColumn("fit_rows", F.lit(rows))
    # A fit of too few rows stays, without values: its rows keep a place and get no score.
    enough = F.col("fit_rows") >= LEAST_NORMAL_ROWS
    return fits.join(sizes, list(by)).withColumns({c: F.when(enough, F.col(c)) for c in ("centre", "scale")})


def attach(df: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put each row's fit beside it. One fit: its single row as literals; several: a join on the fit key."""
    if by:
        return df.join(fits, list(by))
    one = fits.first()
    return df.select("*", *[_literal(one[c]).alias(c) for c in fits.columns])


def _literal(value) -> Column:
    return F.array(*[F.lit(float(v)) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)


def z_scores(channels: Sequence[str]) -> list[Column]:
    return [(F.col(c) - F.get("centre", i)) / F.get("scale", i) for i, c in enumerate(channels)]


def with_precision(normal: DataFrame, fits: DataFrame, channels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds the row-major inverse of the shrunk covariance of the scaled channels.

    Per fit only p x p moments reach the driver.
    """
    p = len(channels)
    z = attach(normal, fits.filter("centre IS NOT NULL") if by else fits, by).select(*by, *[c.alias(f"z{i}") for i, c in enumerate(z_scores(channels))])
    means = z.groupBy(*by).agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in range(p)])
    joined = z.join(means, list(by)) if by else z.select("*", *[means.select(f"m{i}").scalar().alias(f"m{i}") for i in range(p)])
    x = [F.col(f"z{i}") - F.col(f"m{i}") for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = joined.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs],
                                      *[F.sum(x[i] * x[i] * x[j] * x[j]).alias(f"q{i}_{j}") for i, j in pairs])
    rows = []
    for m in moments.collect():
        _, precision, _ = shrink(m["n"], p, lambda i, j: m[f"s{i}_{j}"], lambda i, j: m[f"q{i}_{j}"])
        rows.append((*[m[b] for b in by], [float(v) for v in precision.ravel()]))
    fields = [moments.schema[b] for b in by] + [T.StructField("precision", T.ArrayType(T.DoubleType()))]
    table = normal.sparkSession.createDataFrame(rows, T.StructType(fields))
    return fits.join(table, list(by), "left") if by else fits.withColumn("precision", _literal(rows[0][-1]))


def envelope_score(channels: Sequence[str], aggregation: str = "max") -> Column:
    """Largest absolute z, or Mahalanobis length, of a row that carries its fit."""
    z = z_scores(channels)
    if aggregation == "max":
        return F.greatest(*map(F.abs, z)) if len(z) > 1 else F.abs(z[0])
    if aggregation != "mahalanobis":
        raise ValueError(f"unknown aggregation {aggregation!r}")
    p, total = len(channels), F.lit(0.0)
    for i in range(p):
        for j in range(p):
            total = total + z[i] * z[j] * F.get("precision", i * p + j)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def thresholds(calibration: DataFrame, score: str, q: float, by: Sequence[str] = (), name: str = "threshold") -> DataFrame:
    """The calibration scores' order statistic at ceil(q (n-1))."""
    return quantiles(calibration, by, {name: (score, q, higher(q))})


def phase_residual(queries: DataFrame, template: DataFrame, by: Sequence[str], position: str, channels: Sequence[str],
                   scales: Sequence[float], aggregation: str = "top2_mean", name: str = "score", **layout) -> DataFrame:
    """Scaled absolute distance from the position-aligned normal template, folded over channels."""
    met = interpolating_asof(queries, template, by, position, channels, **layout)
    away = F.array(*[F.abs(F.col(c) - F.col(f"{c}_expected")) / F.lit(float(s)) for c, s in zip(channels, scales)])
    return met.withColumn(name, row_aggregate(away, aggregation))


def voting_alerts(df: DataFrame, unit: Sequence[str], position: str, vote: str, window: int, required: int,
                  name: str = "alert", **layout) -> DataFrame:
    from .causal import segmented_persistence

    return segmented_persistence(df, unit, position, vote, window, required, name, **layout).frame


def ensemble_votes(members: DataFrame, key: Sequence[str], member_count: int) -> DataFrame:
    """Majority of the members' positive margins, and the median margin, per row."""
    from .order_stats import array_median

    # One margin per member, so the list is as short as the ensemble.
    return members.groupBy(*key).agg(
        F.count_if(F.col("margin") > 0).alias("votes"), array_median(F.collect_list("margin")).alias("median_margin"),
    ).withColumn("predicted", (F.col("votes") >= member_count // 2 + 1).cast("int"))


def selection_score(penalty: float, budget: float) -> Column:
    """Balanced accuracy less a penalty for false alarms above the budget."""
    return F.col("balanced_accuracy") - penalty * F.greatest(F.col("false_alarm_rate") - budget, F.lit(0.0))
