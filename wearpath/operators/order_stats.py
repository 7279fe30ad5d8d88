"""Exact order statistics that need neither a full sort nor a group in one task.

Small groups use Spark's exact ``percentile``. For larger ones a mergeable sketch
brackets each wanted rank, exact counts say how many values lie below the bracket,
and only the bracket (a few parts per ten thousand of the rows, counted per distinct value) is ranked. A column's
ranks share one sketch; brackets and counts are written, so that the rows are read three times whatever follows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .series import null_safe_join, series

SMALL_ROWS = 1_000_000
ACCURACY = 10_000

# A rule gives the 0-based (possibly fractional) rank wanted among n sorted values.
Rule = Callable[[Column], Column]


def linear(q: float) -> Rule:
    return lambda n: F.lit(float(q)) * (n - 1)


def higher(q: float) -> Rule:
    """Order statistic at index ceil(q (n-1)): never below the interpolated quantile."""
    return lambda n: F.ceil(F.lit(float(q)) * (n - 1)).cast("double")


def conformal(alpha: float) -> Rule:
    """Rank min(ceil((n+1)(1-alpha)), n), the split-conformal radius."""
    return lambda n: (F.least(F.ceil((n + 1) * F.lit(1.0 - alpha)), n) - 1).cast("double")


def _at(values: Column, rank: Column) -> Column:
    low, high = F.get(values, F.floor(rank).cast("int")), F.get(values, F.ceil(rank).cast("int"))
    return low + (high - low) * (rank - F.floor(rank))


def quantiles(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float, Rule]],
              small_rows: int | None = None) -> DataFrame:
    """One row per group. ``wanted``: output name -> (column, approximate fraction, rank rule).

    The fraction only places the bracket; the rule decides the exact rank. Groups up to
    ``small_rows`` (session setting ``spark.wearpath.smallGroupRows``) are sorted as a whole.
    """
    if small_rows is None:
        small_rows = int(df.sparkSession.conf.get("spark.wearpath.smallGroupRows", str(SMALL_ROWS)))
    by = list(by)
    top = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if top <= small_rows:
        columns = sorted({c for c, _, _ in wanted.values()})
        sorted_values = df.groupBy(*by).agg(
            *[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"__v_{c}") for c in columns]
        )
        return sorted_values.select(*by, *[
            F.when(F.size(f"__v_{c}") > 0, _at(F.col(f"__v_{c}"), rule(F.size(f"__v_{c}").cast("double")))).alias(name)
            for name, (c, _, rule) in wanted.items()
        ])
    return _by_bracket(df, by, wanted)


def _by_bracket(df, by, wanted):
    names = list(wanted)
    margin = 4.0 / ACCURACY
    columns = sorted({c for c, _, _ in wanted.values()})
    fractions = {c: sorted({f for x, q, _ in wanted.values() if x == c for f in (max(0.0, q - margin), min(1.0, q + margin))}) for c in columns}
    sketches = df.groupBy(*by).agg(
        *[F.count(c).cast("double").alias(f"__n_{c}") for c in columns],
        *[F.percentile_approx(F.col(c).cast("double"), fractions[c], ACCURACY).alias(f"__b_{c}") for c in columns],
    )
    edge = lambda k, f: F.get(f"__b_{wanted[k][0]}", fractions[wanted[k][0]].index(f))
    # A group of few rows takes its whole range: its rank can fall outside the margin.
    few = {k: F.col(f"__n_{wanted[k][0]}") * margin < 4 for k in names}
    ranks = materialise(sketches.select(*by, *[
        F.struct(
            wanted[k][2](F.col(f"__n_{wanted[k][0]}")).alias("rank"),
            F.when(few[k], F.lit(float("-inf"))).otherwise(edge(k, max(0.0, wanted[k][1] - margin))).alias("lo"),
            F.when(few[k], F.lit(float("inf"))).otherwise(edge(k, min(1.0, wanted[k][1] + margin))).alias("hi"),
        ).alias(f"__r_{k}") for k in names
    ]), "ranks")
    joined = null_safe_join(df, ranks, by, "left") if by else df.select("*", *[
        ranks.select(f"__r_{k}").scalar().alias(f"__r_{k}") for k in names])
    near = {k: F.col(wanted[k][0]).isNotNull() & (F.col(wanted[k][0]) <= F.col(f"__r_{k}.hi")) for k in names}
    entry = lambda k: (F.lit(k).alias("__name"), F.col(f"__r_{k}.rank").alias("__rank"),
                       F.when(F.col(wanted[k][0]).cast("double") >= F.col(f"__r_{k}.lo"), F.col(wanted[k][0]).cast("double")).alias("__value"))
    if len(names) == 1:
        inside = joined.filter(near[names[0]]).select(*by, *entry(names[0]))
    else:
        inside = joined.select(*by, F.inline(F.array_compact(F.array(*[F.when(near[k], F.struct(*entry(k))) for k in names]))))
    # Values under the bracket collapse to one counted row (null), the rest to one per value.
    counted = materialise(inside.groupBy(*by, "__name", "__rank", "__value").agg(F.count("*").alias("__count")), "bracket")
    lead = F.coalesce("__value", F.lit(float("-inf")))
    walked = series(counted.withColumn("__lead", lead).withColumn("__under", F.col("__value").isNotNull().cast("int")),
                    [*by, "__name"], ("__lead", "__under")).running(__upto=("sum", F.col("__count"))).frame
    first = F.col("__upto") - F.col("__count")
    covers = lambda r: (first <= r) & (r < F.col("__upto"))
    low, high = F.floor("__rank"), F.ceil("__rank")
    picked = walked.filter(F.col("__value").isNotNull()).groupBy(*by, "__name").agg(
        F.max("__rank").alias("__rank"),
        F.max(F.when(covers(low), F.col("__value"))).alias("__low"),
        F.max(F.when(covers(high), F.col("__value"))).alias("__high"),
    )
    value = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__rank") - F.floor("__rank"))
    long = picked.withColumn("__out", value)
    found = long.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == k, F.col("__out"))).alias(k) for k in names])
    if by:
        found = null_safe_join(ranks.select(*by), found, by, "left")  # a group without values stays
    return materialise(found, "quantiles")


def counted_quantile(counted: DataFrame, by: Sequence[str], value: str, count: str, name: str, rule: Rule) -> DataFrame:
    """One row per group: the quantile of values that come with how often they occur. A group of nulls alone has none."""
    walked = series(counted.filter(F.col(value).isNotNull()), by, value).running(__upto=("sum", F.col(count))).frame
    ranks = counted.groupBy(*by).agg(rule(F.sum(F.when(F.col(value).isNotNull(), F.col(count))).cast("double")).alias("__rank"))
    placed = null_safe_join(walked, ranks, by, "left")
    covers = lambda r: (F.col("__upto") - F.col(count) <= r) & (r < F.col("__upto"))
    ends = placed.groupBy(*by).agg(F.max("__rank").alias("__rank"), F.max(F.when(covers(F.floor("__rank")), F.col(value))).alias("__low"),
                                   F.max(F.when(covers(F.ceil("__rank")), F.col(value))).alias("__high"))
    found = ends.select(*by, (F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__rank") - F.floor("__rank"))).alias(name))
    return null_safe_join(ranks.select(*by), found, by, "left")


def median(column: str) -> tuple[str, float, Rule]:
    return (column, 0.5, linear(0.5))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of every distinct value of a group (ties share the mean of their ranks)."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    walked = series(counted, by, value).running(__upto=("sum", F.col("ties"))).frame
    return walked.select(*by, value, (F.col("__upto") - (F.col("ties") - 1) / 2).alias(name))


def array_median(values: Column) -> Column:
    ordered = F.sort_array(values)  # native sort; array_sort would interpret a comparator
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def array_quantile(values: Column, q: float) -> Column:
    ordered = F.sort_array(values)  # native sort; array_sort would interpret a comparator
    return F.when(F.size(ordered) > 0, _at(ordered, F.lit(float(q)) * (F.size(ordered) - 1)))
