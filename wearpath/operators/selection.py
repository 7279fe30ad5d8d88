"""Top-k, best-candidate choice and thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The k first rows of each group; Spark cuts each partition to k per group before its shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top_channels(deviations: dict[str, Column], k: int = 5) -> Column:
    """Names of the k largest channels of a row; ties go to the later name, as in a reversed argsort."""
    entries = F.array(*[F.struct((-value).alias("order"), F.lit(-i).alias("tie"), F.lit(name).alias("name"))
                        for i, (name, value) in enumerate(deviations.items())])
    return F.transform(F.slice(F.sort_array(entries), 1, k), lambda e: e["name"])


def row_aggregate(values: Column, how: str) -> Column:
    """Mean, max, interpolated 75th percentile or mean of the two largest of an array."""
    from ..functions.scalars import array_mean
    from .order_stats import array_quantile

    if how == "mean":
        return array_mean(values)
    if how == "max":
        return F.array_max(values)
    if how == "p75":
        return array_quantile(values, 0.75)
    if how == "top2_mean":
        return array_mean(F.slice(F.sort_array(values, asc=False), 1, 2))
    raise ValueError(f"unknown row aggregate {how!r}")


def best(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First row by the given ascending keys (per group) without a sort: min_by over a key struct."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(
        F.min_by(F.struct(*df.columns), key).alias("__best")).select("__best.*")


def preferred_near_best(df: DataFrame, score: str, name: str, preference: Sequence[str], slack: float = 0.01) -> DataFrame:
    """Among candidates within ``slack`` of the lowest score, the one earliest in the preference list."""
    lowest = df.agg(F.min(score)).scalar()
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(name))
    near = df.filter((F.col(score) <= lowest * (1 + slack)) & (rank > 0))
    return best(near, [rank, F.col(score)])


def importances(names: Sequence[str], values: Sequence[float], spark, limit: int = 5) -> DataFrame:
    """Largest positive importances scaled so the first is 100 (names and values come from one model)."""
    rows = spark.createDataFrame([(n, float(abs(v))) for n, v in zip(names, values)], "feature string, weight double")
    top = rows.agg(F.max("weight")).scalar()
    return top_rows(rows.filter(F.col("weight") > 0).withColumn("importance", F.col("weight") / top * 100),
                    [F.desc("weight"), F.asc("feature")], limit)


def thin(s: Series, points: int = 180) -> DataFrame:
    """Every n-th row of each unit so that about ``points`` remain, always with the last one."""
    sized = s.number("__n").totals(__rows=F.count("*"))
    stride = F.greatest(F.ceil(F.col("__rows") / points), F.lit(1))
    keep = (F.pmod(F.col("__n") - 1, stride) == 0) | (F.col("__n") == F.col("__rows"))
    return sized.frame.filter(keep).drop("__n", "__rows")
