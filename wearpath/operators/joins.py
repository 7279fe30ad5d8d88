"""Validated, reconciling, positional and interpolating joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import DataQualityError, Rule, duplicates, require
from .series import Series, series


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], complete: bool = True) -> DataFrame:
    """Inner join whose keys are unique on both sides; optionally every right row must match."""
    require(duplicates(left, on), "left keys repeat")
    require(duplicates(right, on), "right keys repeat")
    if complete:
        require(right.join(left, list(on), "left_anti").select(*on), "right rows without a partner")
    return left.join(right, list(on), "inner")


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    require(duplicates(right, on), "lookup keys repeat")
    return left.join(right, list(on), "left")


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str],
              suffixes: tuple[str, str] = ("_left", "_right"), how: str = "full_outer") -> DataFrame:
    """Join on the keys keeping both versions of ``values`` and a ``side`` indicator."""
    a = left.select(*on, *[F.col(v).alias(v + suffixes[0]) for v in values], F.lit(True).alias("__l"))
    b = right.select(*on, *[F.col(v).alias(v + suffixes[1]) for v in values], F.lit(True).alias("__r"))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, list(on), how).withColumn("side", side).drop("__l", "__r")


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Equal within tolerance; a missing value never is."""
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))


def enrich(left: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left one-to-one feature join that may not replace a column the table already has."""
    taken = (set(left.columns) & set(extra.columns)) - set(on)
    if taken:
        raise DataQualityError(f"columns would be replaced: {sorted(taken)}")
    require(duplicates(left, on), "table keys repeat")
    require(duplicates(extra, on), "feature keys repeat")
    return left.join(extra, list(on), "left")


def side_by_side(tables: Sequence[DataFrame], key: str, strict: bool = True) -> DataFrame:
    """Paste per-sensor tables on their explicit row id (co-partitioned, so one exchange per table).

    No row is left out: an id that a table lacks has nulls in its columns, and in strict mode raises, as tables
    of unequal length do not belong side by side.
    """
    marked = [t.withColumn(f"__in_{i}", F.lit(True)) for i, t in enumerate(tables)]
    wide = marked[0]
    for other in marked[1:]:
        wide = wide.join(other, key, "full_outer")
    lost = reduce(lambda a, b: a | b, [F.col(f"__in_{i}").isNull() for i in range(len(tables))])
    if strict:
        require(wide.filter(lost).select(key), "tables differ in their rows")
    return wide.drop(*[f"__in_{i}" for i in range(len(tables))])


def membership(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    marked = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(marked, list(on), "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit")


def with_candidates(df: DataFrame, candidates: Sequence[dict], name: str = "candidate") -> DataFrame:
    """Each row once per candidate setting: literals exploded in place, so one scan scores the grid."""
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates])
    return df.withColumn(name, F.explode(grid))


def interpolating_asof(queries: DataFrame, template: DataFrame, by: Sequence[str], position: str,
                       values: Sequence[str], suffix: str = "_expected", **layout) -> DataFrame:
    """Value of the piecewise-linear template of a group at each query position, held flat at both ends.

    Both sides go into one ordered stream per group; the template point before and after each
    query are running "latest non-null" values, so large groups are cut into blocks.
    """
    point = F.struct(F.col(position).cast("double").alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    knots = template.select(*by, F.col(position).cast("double").alias("__x"), F.lit(0).alias("__kind"),
                            point.alias("__knot"), F.lit(None).alias("__row"))
    asked = queries.select(*by, F.col(position).cast("double").alias("__x"), F.lit(1).alias("__kind"),
                           F.lit(None).alias("__knot"), F.struct(*queries.columns).alias("__row"))
    s = series(knots.unionByName(asked), by, ("__x", "__kind"), **layout)
    s = s.running(__prior=("last", F.col("__knot"))).running(True, __next=("last", F.col("__knot")))
    p, n, x = F.col("__prior"), F.col("__next"), F.col("__x")

    def blend(v):
        line = p[v] + F.try_divide((x - p["x"]) * (n[v] - p[v]), n["x"] - p["x"])
        return F.when(p.isNull(), n[v]).when(n.isNull() | (p["x"] == x), p[v]).otherwise(line)

    found = s.frame.filter(F.col("__kind") == 1)
    return found.select("__row.*", *[blend(v).alias(v + suffix) for v in values])


def aligned_predictions(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidate predictions on the reference's rows; anything but the same rows, folds and labels raises.

    Both sides are grouped by their key once; all rules are judged on that one table.
    """
    from ..sources.readers import settled

    keys = ["unit", "cycle"]
    values = [c for c in ("fold", "predicted", "actual") if c in candidate.columns]
    kept = F.struct(*[F.col(f"`{c}`") for c in reference.columns])
    new, old = candidate.select(*keys, F.struct(*values).alias("new")), reference.select(*keys, kept.alias("old"))
    both = new.unionByName(old, allowMissingColumns=True).groupBy(*keys).agg(
        F.count("new").alias("n_new"), F.count("old").alias("n_old"), F.first("new", ignorenulls=True).alias("new"), F.first("old", ignorenulls=True).alias("old"))

    def unsound(side: str, names: Sequence[str]) -> Column:
        bad = F.lit(False)
        for c in names:
            v = F.col(f"{side}.{c}").cast("double")
            bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        return bad | (F.col(f"{side}.predicted") < 0)

    differ = lambda c: ~F.col(f"new.{c}").cast("double").eqNullSafe(F.col(f"old.{c}").cast("double"))
    present = (F.col("n_new") > 0) & (F.col("n_old") > 0)
    rule = lambda name, broken: Rule(name, broken, F.lit(""))
    rules = [
        rule("candidate rows repeat", F.col("n_new") > 1), rule("reference rows repeat", F.col("n_old") > 1), rule("rows differ", ~present),
        rule("keys are not valid", F.col("unit").isNull() | F.col("cycle").isNull() | (F.col("cycle") <= 0)),
        rule("candidate evidence is not finite and valid", (F.col("n_new") > 0) & unsound("new", values)),
        rule("reference evidence is not finite and valid", (F.col("n_old") > 0) & unsound("old", ("fold", "predicted", "actual"))),
        rule("folds differ", present & differ("fold") if "fold" in values else F.lit(False)), rule("labels differ", present & differ("actual") if "actual" in values else F.lit(False)),
        rule("labels must not be negative", F.col("old.actual") < 0)]
    sound = settled(both, rules, "aligned predictions", True)
    return sound.select(*[(F.col("new.predicted") if c == "predicted" else F.col(f"old.`{c}`")).alias(c) for c in reference.columns])
