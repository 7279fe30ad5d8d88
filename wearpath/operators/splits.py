"""Leakage-safe splits. Whole groups move together; order comes from a hash, never from row order."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order_stats import linear, median, quantiles
from .series import series

SEED = "42"


def hash_text(*columns: str | Column, seed: str = SEED) -> Column:
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def hash_number(text: Column) -> Column:
    """The leading 52 bits as a number: orders like the hexadecimal text and fits a double."""
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("long")


def hash_unit(*columns: str | Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) that depends on the row's key only, not on partitions."""
    return hash_number(hash_text(*columns, seed=seed)) / float(16 ** 13)


def _hash_order(df: DataFrame, unit: Sequence[str], key: Sequence[str], seed: str, **layout):
    text = hash_text(*key, seed=seed)
    marked = df.withColumns({"__hn": hash_number(text), "__ht": text})
    return series(marked, unit, ("__hn", "__ht", *key), **layout)


def holdout(df: DataFrame, group: str, share: float = 0.2, seed: str = SEED, **layout) -> DataFrame:
    """``part`` = validation for the first ceil(share x groups) groups in hash order, else train."""
    groups = _hash_order(df.select(group).distinct(), (), [group], seed, **layout).number("__n").totals(__all=F.count("*"))
    part = F.when(F.col("__n") <= F.ceil(F.col("__all") * share), "validation").otherwise("train")
    return df.join(groups.df.select(group, part.alias("part")), group)


def three_way(df: DataFrame, group: str, shares: tuple[float, float] = (0.6, 0.2), seed: str = SEED, **layout) -> DataFrame:
    """Fit / calibration / evaluation groups."""
    groups = _hash_order(df.select(group).distinct(), (), [group], seed, **layout).number("__n").totals(__all=F.count("*"))
    spot = F.col("__n") - 1
    first = F.floor(F.col("__all") * F.lit(shares[0]))
    second = F.floor(F.col("__all") * F.lit(shares[0] + shares[1]))
    part = F.when(spot < first, "fit").when(spot < second, "calibration").otherwise("evaluation")
    return df.join(groups.df.select(group, part.alias("part")), group)


def allot(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """Largest-first onto the lightest fold, for a histogram of (size, groups).

    Groups of one size are interchangeable, so the answer per size is a number of groups per fold:
    rows (size, fold, first position, last position). Distinct sizes stay below sqrt(2 x rows),
    however many groups there are.
    """
    load = [0] * folds
    out = []
    for size, groups in sorted(sizes, reverse=True):
        give = [0] * folds
        if groups > 4 * folds and size > 0:  # raise all folds to one water level at once
            low, high = min(load), max(load) + size * groups
            room = lambda level: [max(0, (level - x) // size) for x in load]
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if sum(room(mid)) <= groups else (low, mid - 1)
            give = room(low)
        heap = [(load[f] + give[f] * size, f) for f in range(folds)]
        heapq.heapify(heap)
        for _ in range(groups - sum(give)):
            weight, f = heapq.heappop(heap)
            give[f] += 1
            heapq.heappush(heap, (weight + size, f))
        start = 1
        for f in range(folds):
            load[f] += give[f] * size
            if give[f]:
                out.append((size, f, start, start + give[f] - 1))
                start += give[f]
    return out


def group_folds(df: DataFrame, group: str, folds: int, seed: str = SEED, **layout) -> DataFrame:
    """(group, fold) with folds balanced by row count."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    histogram = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    plan = df.sparkSession.createDataFrame(allot(histogram, folds), "size long, fold int, first long, last long")
    placed = _hash_order(sizes, ["size"], [group], seed, **layout).number("__n").df
    return placed.join(plan, "size").filter(F.col("__n").between(F.col("first"), F.col("last"))).select(group, "fold")


def stratified_group_folds(df: DataFrame, group: str, label: str, folds: int, seed: str = SEED, **layout) -> DataFrame:
    """(group, fold), balanced within each majority class so that classes spread over the folds."""
    per = df.groupBy(group, label).agg(F.count("*").alias("n"))
    major = per.groupBy(group).agg(F.sum("n").alias("size"), F.max_by(label, F.struct("n", F.col(label).cast("string"))).alias("stratum"))
    # One stratum's distinct sizes are few (below the square root of twice its rows); strata are dealt in tasks.
    histogram = major.groupBy("stratum", "size").agg(F.count("*").alias("n"))
    kind = dict(major.dtypes)["stratum"]

    def deal(sizes: pd.DataFrame) -> pd.DataFrame:
        cells = allot(list(zip(sizes["size"].tolist(), sizes["n"].tolist())), folds)
        return pd.DataFrame([(sizes["stratum"].iloc[0], *cell) for cell in cells], columns=["stratum", "size", "fold", "first", "last"])

    plan = histogram.groupBy("stratum").applyInPandas(deal, f"stratum {kind}, size long, fold int, first long, last long")
    placed = _hash_order(major, ["stratum", "size"], [group], seed, **layout).number("__n").df
    return placed.join(plan, ["stratum", "size"]).filter(
        F.col("__n").between(F.col("first"), F.col("last"))).select(group, "fold")


def stratified_folds(df: DataFrame, key: Sequence[str], label: str, folds: int, seed: str = SEED, name: str = "fold", **layout) -> DataFrame:
    """Rows dealt round robin within each class in hash order."""
    dealt = _hash_order(df, [label], key, seed, **layout).number("__n")
    return dealt.frame.withColumn(name, F.pmod(F.col("__n") - 1, F.lit(folds)).cast("int")).drop("__n", "__hn", "__ht")


def quantile_bins(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed bins at exact interpolated quantiles, repeated edges dropped, lowest value included."""
    wanted = {f"q{i:03d}": (column, i / bins, linear(i / bins)) for i in range(bins + 1)}
    edges = sorted({v for v in quantiles(df, [], wanted).first() if v is not None})  # at most bins + 1 numbers
    below = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(name, F.greatest(below - 1, F.lit(0)))


def snapshots(df: DataFrame, unit: str, order: Sequence[str], seed: str = SEED, **layout) -> DataFrame:
    """One row per unit, at a hash-chosen position in the last 80 % of its rows."""
    s = series(df, unit, order, **layout).number("__n").totals(__rows=F.count("*"))
    head = F.floor(F.col("__rows") / 5)
    spot = head + F.pmod(hash_number(hash_text(unit, seed=seed)), F.col("__rows") - head) + 1
    return s.frame.filter(F.col("__n") == spot).drop("__rows").withColumnRenamed("__n", "position")


def rotating_roles(df: DataFrame, block: str, blocks: int) -> DataFrame:
    """Every row once per fold with its role: fold i tests block i, calibrates on i-1, trains on the rest."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    role = (F.when(F.col(block) == F.col("fold"), "test")
            .when(F.col(block) == F.pmod(F.col("fold") - 1, F.lit(blocks)), "calibration").otherwise("train"))
    return df.withColumn("fold", fold).withColumn("role", role)


def nested_plan(blocks: int) -> list[tuple[int, int, str, int]]:
    """(outer, inner, role, block): the outer fold keeps one block for its test; inner -1 is the refit."""
    rows = []
    for outer in range(blocks):
        rest = [b for b in range(blocks) if b != outer]
        for i, held in enumerate(rest):
            calibration = rest[(i + 1) % len(rest)]
            rows += [(outer, i, "validation", held), (outer, i, "calibration", calibration)]
            rows += [(outer, i, "train", b) for b in rest if b not in (held, calibration)]
        rows += [(outer, -1, "test", outer), (outer, -1, "calibration", rest[0])]
        rows += [(outer, -1, "train", b) for b in rest[1:]]
    return rows


def leave_one_scenario_out(df: DataFrame, scenario: str, normal: str, block: str, scenarios: Sequence[str]) -> DataFrame:
    """``fold`` in which each row is held out: a fault with its scenario, a normal row with its block."""
    names = F.array(*[F.lit(s) for s in scenarios])
    return df.withColumn("fold", F.when(F.col(scenario) == normal, F.col(block)).otherwise(
        F.array_position(names, F.col(scenario)).cast("int") - 1))


def perturb(df: DataFrame, train: DataFrame, key: Sequence[str], features: Sequence[str],
            noise: float = 0.05, dropout: float = 0.03, seed: str = SEED) -> DataFrame:
    """Gaussian noise scaled to the training deviation, and random replacement by the training median.

    Draws are hashes of (seed, feature, key), so they do not depend on partitioning.
    """
    scale = train.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()
    middle = quantiles(train, [], {c: median(c) for c in features}).first()

    def draw(name, c):
        return hash_unit(F.lit(f"{name}:{c}"), *key, seed=seed)

    def moved(c):
        radius = F.sqrt(-2 * F.log(F.lit(1.0) - draw("radius", c)))
        normal = radius * F.cos(2 * F.pi() * draw("angle", c))
        noisy = F.col(c) + normal * (noise * float(scale[c]))
        return F.when(draw("drop", c) < dropout, F.lit(float(middle[c]))).otherwise(noisy)

    return df.withColumns({c: moved(c) for c in features})


def leaking_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups that appear in more than one part."""
    return df.groupBy(group).agg(F.count_distinct(part).alias("parts")).filter(F.col("parts") > 1)


def coverage_errors(df: DataFrame, keys: Sequence[str], expected: DataFrame) -> DataFrame:
    """Keys not covered exactly once."""
    seen = df.groupBy(*keys).agg(F.count("*").alias("times"))
    both = expected.select(*keys).distinct().withColumn("__due", F.lit(1)).join(seen, list(keys), "full_outer")
    return both.filter((F.coalesce("times", F.lit(0)) != 1) | F.col("__due").isNull()).select(*keys, "times")


def frozen_fold_drift(df: DataFrame, group: str, frozen: DataFrame) -> DataFrame:
    """Groups whose stored fold is missing, doubled or names a group the data lacks."""
    return coverage_errors(frozen, [group], df.select(group))
