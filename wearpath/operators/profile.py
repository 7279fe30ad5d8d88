"""Dataset summaries, exploratory profiles and fitted scalar statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import average_ranks, linear, median, quantiles


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def columns_to_rows(one: DataFrame, names: Sequence[str], fields: Sequence[str], label: str = "feature") -> DataFrame:
    """A single aggregate row with ``<field>__<name>`` columns, turned into one row per name."""
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(label), *[F.col(f"{f}__{n}").alias(f) for f in fields]) for n in names])))


def column_profile(df: DataFrame, columns: Sequence[str], near_constant: float = 1e-6) -> DataFrame:
    """Range, mean, sample deviation and distinct values of every column."""
    kinds = {"low": F.min, "high": F.max, "mean": F.avg, "std": F.stddev_samp}
    stats = df.agg(*[fn(c).cast("double").alias(f"{k}__{c}") for c in columns for k, fn in kinds.items()])
    # One distinct pass over long rows instead of an expansion per column.
    counts = melt(df, [], columns).filter(F.col("value").isNotNull()).distinct().groupBy("feature").agg(
        F.count("*").alias("distinct_values"))
    rows = columns_to_rows(stats, columns, list(kinds)).join(counts, "feature", "left")
    return rows.withColumns({
        "value_range": F.col("high") - F.col("low"), "constant": F.col("distinct_values") <= 1,
        "near_constant": F.coalesce(F.col("std") < near_constant, F.lit(True))})


def correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(f"correlation__{c}") for c in columns])
    return columns_to_rows(one, columns, ["correlation"]).withColumn("strength", F.abs("correlation"))


def rank_correlations(df: DataFrame, key: Sequence[str], columns: Sequence[str], target: str) -> DataFrame:
    """Spearman's rho of each column with the target: Pearson of average ranks."""
    long = melt(df, key, [*columns, target])
    ranked = long.join(average_ranks(long, ["feature"], "value"), ["feature", "value"])
    goal = ranked.filter(F.col("feature") == target).select(*key, F.col("rank").alias("__goal"))
    return ranked.filter(F.col("feature") != target).join(goal, list(key)).groupBy("feature").agg(
        F.corr("rank", "__goal").alias("rho"))


def grouped_summary(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    basics = df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(column).alias("low"), F.avg(column).alias("mean"),
                                 F.max(column).alias("high"))
    return basics.join(quantiles(df, by, {"median": median(column)}), list(by))


def standardized_shift(df: DataFrame, scenario: str, normal: str, columns: Sequence[str], top: int = 3) -> DataFrame:
    """Scenario mean minus normal mean over the normal population deviation; the ``top`` largest per scenario."""
    per = df.groupBy(scenario).agg(*[f(c).alias(f"{k}__{c}") for c in columns for k, f in
                                     (("mean", F.avg), ("std", F.stddev_pop))])
    base = per.filter(F.col(scenario) == normal)
    ref = {c: (base.select(f"mean__{c}").scalar(), base.select(f"std__{c}").scalar()) for c in columns}
    shift = lambda c: (F.col(f"mean__{c}") - ref[c][0]) / F.when(ref[c][1] == 0, 1.0).otherwise(ref[c][1])
    named = per.filter(F.col(scenario) != normal).select(scenario, *[shift(c).alias(f"shift__{c}") for c in columns])
    entries = F.array(*[F.struct((-F.abs(f"shift__{c}")).alias("order"), F.lit(c).alias("feature"),
                                 F.col(f"shift__{c}").alias("shift")) for c in columns])
    # sort_array, unlike array_sort, may stand over a scalar subquery.
    return named.select(scenario, F.inline(F.slice(F.sort_array(entries), 1, top))).drop("order")


def life_stage_shift(df: DataFrame, rul: str, columns: Sequence[str], healthy: float = 120, failing: float = 30) -> DataFrame:
    """(near-failure mean - healthy mean) / sample deviation of all rows."""
    one = df.agg(*[c for name in columns for c in (
        F.avg(F.when(F.col(rul) > healthy, F.col(name))).alias(f"healthy__{name}"),
        F.avg(F.when(F.col(rul) <= failing, F.col(name))).alias(f"failing__{name}"),
        F.stddev_samp(name).alias(f"std__{name}"))])
    rows = columns_to_rows(one, columns, ["healthy", "failing", "std"])
    return rows.withColumn("shift", F.try_divide(F.col("failing") - F.col("healthy"), F.col("std")))


def binned_profile(df: DataFrame, share: Column, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Mean per right-closed bin of a share in [0, 1] and its z-score across bins."""
    spot = F.greatest(F.ceil(share * bins), F.lit(1)).cast("int").alias("bin")
    means = melt(df.withColumn("bin", spot), ["bin"], columns).groupBy("feature", "bin").agg(F.avg("value").alias("mean"))
    across = means.groupBy("feature").agg(F.avg("mean").alias("__m"), F.stddev_samp("mean").alias("__s"))
    return means.join(across, "feature").select(
        "feature", "bin", "mean", F.try_divide(F.col("mean") - F.col("__m"), F.col("__s")).alias("z"))


def unit_lifetimes(df: DataFrame, unit: str, order: str) -> DataFrame:
    """Distribution of the units' last order value."""
    last = df.groupBy(unit).agg(F.max(order).cast("double").alias("life"))
    shape = quantiles(last, [], {"q25": ("life", .25, linear(.25)), "median": median("life"), "q75": ("life", .75, linear(.75))})
    basic = last.agg(F.count("*").alias("units"), F.avg("life").alias("mean"), F.stddev_samp("life").alias("std"),
                     F.min("life").alias("shortest"), F.max("life").alias("longest"))
    return basic.select("*", *[shape.select(c).scalar().alias(c) for c in shape.columns])


def support_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: hard range and interpolated 1 % / 99 % quantiles of the fitting rows."""
    long = melt(df, [], columns)
    hard = long.groupBy("feature").agg(F.min("value").alias("hard_min"), F.max("value").alias("hard_max"))
    tails = quantiles(long, ["feature"], {"q01": ("value", .01, linear(.01)), "q99": ("value", .99, linear(.99))})
    return hard.join(tails, "feature")


# Consistency factor of the MAD and the scale floor.
MAD_FACTOR = 1.4826
SCALE_FLOOR = 1e-6


def robust_scale(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Median and MAD-based scale per group (``by`` includes the feature), deviation as fallback."""
    centre = quantiles(long, by, {"centre": median(value)})
    away = long.join(centre, list(by)).withColumn("__away", F.abs(F.col(value) - F.col("centre")))
    mad = quantiles(away, by, {"__mad": median("__away")})
    std = long.groupBy(*by).agg(F.stddev_pop(value).alias("__std"))
    mad_scale = F.col("__mad") * MAD_FACTOR
    scale = F.greatest(F.when(mad_scale > 1e-9, mad_scale).otherwise(F.col("__std")), F.lit(SCALE_FLOOR))
    return centre.join(mad, list(by)).join(std, list(by)).select(*by, "centre", scale.alias("scale"))


def adjacent_noise(df: DataFrame, by: Sequence[str], difference: str, floor: float = 1e-3) -> DataFrame:
    """Noise from differences of neighbouring samples: MAD x 1.4826 / sqrt(2), never below the floor."""
    centre = quantiles(df, by, {"__centre": median(difference)})
    joined = df.join(centre, list(by)) if by else df.withColumn("__centre", centre.scalar())
    away = joined.withColumn("__away", F.abs(F.col(difference) - F.col("__centre")))
    mad = quantiles(away, by, {"__mad": median("__away")})
    return mad.select(*by, F.greatest(F.coalesce(F.col("__mad"), F.lit(0.0)) * MAD_FACTOR / F.sqrt(F.lit(2.0)),
                                      F.lit(floor)).alias("noise"))


def template_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population deviation per channel; a flat channel borrows the median of the others."""
    one = df.agg(*[F.stddev_pop(c).alias(c) for c in columns])
    live = F.filter(F.array(*columns), lambda v: v > 1e-9)
    from .order_stats import array_median

    fallback = F.coalesce(array_median(live), F.lit(1.0))
    return one.select(*[F.when(F.col(c) > 1e-9, F.col(c)).otherwise(fallback).alias(c) for c in columns])


def shrunk_covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Ledoit-Wolf covariance, precision and shrinkage from two aggregate passes.

    Only the p x p moments reach the driver.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    x = [F.col(c) - F.lit(float(means[c])) for c in columns]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs],
                 *[F.sum(x[i] * x[i] * x[j] * x[j]).alias(f"q{i}_{j}") for i, j in pairs]).first()
    return shrink(row["n"], len(columns), lambda i, j: row[f"s{i}_{j}"], lambda i, j: row[f"q{i}_{j}"])


def shrink(n, p, product, quartic):
    sums, quads = np.zeros((p, p)), np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            sums[i, j] = sums[j, i] = product(i, j)
            quads[i, j] = quads[j, i] = quartic(i, j)
    sample = sums / n
    mu = np.trace(sample) / p
    distance = (np.sum(sample ** 2) - 2 * mu * np.trace(sample) + p * mu ** 2) / p
    noise = min((quads.sum() / n - np.sum(sample ** 2)) / (p * n), distance)
    amount = 0.0 if noise <= 0 or distance == 0 else noise / distance
    covariance = (1 - amount) * sample + amount * mu * np.eye(p)
    return covariance, np.linalg.pinv(covariance), float(amount)


def group_shares(df: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("rows") / total)


def equal_group_weights(df: DataFrame, group: Sequence[str], name: str = "weight") -> DataFrame:
    """Every group counts the same and weights average 1: rows / (groups x rows of the group)."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("__size"))
    totals = sizes.agg(F.sum("__size").alias("rows"), F.count("*").alias("groups"))
    share = totals.select(F.col("rows") / F.col("groups")).scalar()
    return df.join(sizes, list(group)).withColumn(name, share / F.col("__size")).drop("__size")


def mixture_weights(df: DataFrame, source: str, unit: str, shares: dict[str, float], name: str = "weight") -> DataFrame:
    """A fixed share per source, spread equally over its units and equally over a unit's rows."""
    sizes = df.groupBy(source, unit).agg(F.count("*").alias("__rows"))
    units = sizes.groupBy(source).agg(F.count("*").alias("__units"))
    per = sizes.join(units, source)
    share = reduce(lambda acc, kv: acc.when(F.col(source) == kv[0], F.lit(kv[1])), shares.items(), F.when(F.lit(False), F.lit(0.0)))
    weight = per.select(source, unit, (share / F.col("__units") / F.col("__rows")).alias("__w"))
    return df.join(weight, [source, unit]).withColumnRenamed("__w", name)


def banded_weights(target: Column, near: float = 4.0, mid: float = 2.0, far: float = 1.0) -> Column:
    return F.when(target <= 30, near).when(target <= 60, mid).otherwise(far)
