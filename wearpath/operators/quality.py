"""Data-quality rules. Each check yields violations (rule, key, detail) to raise on or to quarantine by."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, is_sha256, is_web_address, normalized, notes
from .order_stats import array_median
from .series import Series


class DataQualityError(ValueError):
    """Raised in strict mode when a check finds violations."""


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    detail: Column


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def missing(column: str) -> Rule:
    return Rule(f"missing:{column}", F.col(column).isNull(), F.lit("null"))


def non_finite(column: str) -> Rule:
    return Rule(f"non_finite:{column}", ~finite(F.col(column)), _text(column))


def not_numeric(column: str) -> Rule:
    c = F.col(column)
    return Rule(f"not_numeric:{column}", c.isNotNull() & c.try_cast("double").isNull(), _text(column))


def out_of_range(column: str, low=None, high=None, strict: bool = False) -> Rule:
    c = F.col(column)
    below = F.lit(False) if low is None else (c <= low if strict else c < low)
    above = F.lit(False) if high is None else (c >= high if strict else c > high)
    return Rule(f"out_of_range:{column}", below | above, _text(column))


def outside_domain(column: str, allowed: Sequence) -> Rule:
    return Rule(f"outside_domain:{column}", ~F.col(column).isin(*allowed), _text(column))


def not_integer(column: str) -> Rule:
    c = F.col(column).cast("double")
    return Rule(f"not_integer:{column}", c != F.floor(c), _text(column))


def violations(df: DataFrame, key: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """All row rules in one pass, one output row per broken rule."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), r.detail.alias("detail")))
        for r in rules]))
    return df.select(*key, F.inline(found))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def require(found: DataFrame, what: str) -> None:
    """Strict mode: raise with one example when the violations frame is not empty."""
    example = found.limit(1).collect()
    if example:
        raise DataQualityError(f"{what}: {example[0].asDict()}")


def quarantine(df: DataFrame, found: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, rows with violations)."""
    bad = found.select(*key).distinct()
    return df.join(bad, list(key), "left_anti"), df.join(bad, list(key), "left_semi")


def schema_issues(df: DataFrame, expected: T.StructType | Sequence[str], ordered: bool = True) -> list[str]:
    """Missing, unexpected and misplaced columns (driver metadata only)."""
    names = expected.fieldNames() if isinstance(expected, T.StructType) else list(expected)
    issues = [f"missing column {n}" for n in names if n not in df.columns]
    issues += [f"unexpected column {n}" for n in df.columns if n not in names]
    if ordered and not issues and df.columns != names:
        issues.append("columns are in another order")
    return issues


def key_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, list(keys), "full_outer").filter(F.col("__l").isNull() | F.col("__r").isNull())
    return both.select(*keys, F.when(F.col("__l").isNull(), "right_only").otherwise("left_only").alias("side"))


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing and non-finite values, long form, from a single aggregate."""
    total = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns],
                   *[F.count_if(F.col(c).isNotNull() & ~finite(F.col(c).cast("double"))).alias(f"i_{c}") for c in columns])
    return total.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing"), F.col(f"i_{c}").alias("non_finite")) for c in columns])))


def trajectory_quality(s: Series, order: str, target: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One record per unit: rows, span, gaps, implied lifetimes and label mismatches."""
    lifetime = F.col(order) + F.col(target)
    gapped = s.trailing(2, lambda f: {"__gap": (F.col(order) - F.lag(order).over(f.ordered) > 1).cast("int")})
    records = gapped.df.groupBy(*s.unit).agg(
        F.count("*").alias("rows"), F.min(order).alias("first_cycle"), F.max(order).alias("last_cycle"),
        F.coalesce(F.sum("__gap"), F.lit(0)).alias("cycle_gaps"),
        F.count_distinct(lifetime).alias("lifetime_values"),
        F.min_by(lifetime, F.col(order)).alias("observed_lifetime"),
        F.sum((lifetime != F.col(order)).cast("int")).alias("__any"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    mismatched = s.totals(__last=F.max(order)).df.groupBy(*s.unit).agg(
        F.count_if(lifetime != F.col("__last")).alias("label_mismatch_rows"))
    everything = s.df.agg(F.count("*")).scalar()
    return records.join(mismatched, list(s.unit)).drop("__any").withColumn(
        "row_fraction", F.col("rows") / everything)


def sudden_drops(s: Series, column: str, share: float = 0.5, prior: int = 5, least: int = 3) -> Series:
    """Flags values below a share of the median of the preceding rows, and values <= 0."""
    held = s.trailing(prior + 1, lambda f: {"__before": F.collect_list(column).over(f.before(prior))})
    level = F.when(F.size("__before") >= least, array_median(F.col("__before")))
    done = held.select(large_downward_jump=F.coalesce(F.col(column) < share * level, F.lit(False)),
                       nonpositive=F.col(column) <= 0)
    return done.using(done.df.drop("__before"))


def crossing_stability(histories: DataFrame, unit: str, capacity: str, threshold: str,
                       before: int = 5, after: int = 3) -> DataFrame:
    """Per unit with an observed end of life: level just before, and returns above it just after.

    Only the few valid rows nearest the crossing are ranked (Spark trims each side before its shuffle).
    """
    valid = histories.filter(F.col("observed_eol_cycle").isNotNull() & (F.col("valid_capacity")
                             | (F.col("discharge_cycle") == F.col("observed_eol_cycle"))))
    gap = F.col("discharge_cycle") - F.col("observed_eol_cycle")
    side = F.when(gap < 0, "before").when(gap > 0, "after").otherwise("at")
    w = Window.partitionBy(unit, "side").orderBy(F.abs("gap"))
    near = valid.withColumns({"gap": gap, "side": side}).withColumn("near", F.row_number().over(w)).filter(
        F.col("near") <= max(before, after))
    at = lambda name: F.col("side") == name
    return near.groupBy(unit).agg(
        F.max("observed_eol_cycle").alias("first_crossing_cycle"),
        F.max(F.when(at("at"), F.col(capacity))).alias("crossing_capacity"),
        array_median(F.collect_list(F.when(at("before") & (F.col("near") <= before), F.col(capacity)))).alias("prior_median"),
        F.count_if(at("after") & (F.col("near") <= after)).alias("following_valid"),
        F.count_if(at("after") & (F.col("near") <= after) & (F.col(capacity) > F.col(threshold))).alias("following_above"),
    ).withColumn("needs_review", F.col("following_above") > 0)


# The manifest's columns, components and partitions.
MANIFEST_COLUMNS = ("component", "group_id", "partition", "source_url", "source_version", "license_or_access_terms",
                    "raw_sha256", "acquired_utc", "label_method", "independent_from_development", "used_for_tuning")
COMPONENTS = ("engine", "battery", "hydraulic", "fuel-system", "landing-gear")
PARTITIONS = ("external_calibration", "frozen_test")


def manifest_issues(rows: DataFrame) -> DataFrame:
    """(component, group_id, issue) of every rule a validation-manifest row breaks.

    A row with missing fields, or an unknown component or partition, reports only that.
    """
    clean = rows.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in MANIFEST_COLUMNS])
    clean = clean.withColumns({"component": F.lower("component"), "partition": F.lower("partition")})
    absent = F.concat_ws(", ", notes(*[(F.col(c) == "", c) for c in MANIFEST_COLUMNS]))
    independent, tuned = normalized(F.col("independent_from_development")), normalized(F.col("used_for_tuning"))
    frozen = F.col("partition") == "frozen_test"
    detail = notes(
        (~is_web_address(F.col("source_url")), "source is not a web address"),
        (~is_sha256(F.col("raw_sha256")), "digest is not 64 hexadecimal digits"),
        (~independent.isin("true", "false") | ~tuned.isin("true", "false"), "independence or tuning flag is neither true nor false"),
        (frozen & (independent != "true"), "frozen group without declared independence"),
        (frozen & (tuned != "false"), "frozen group was tuned on"),
    )
    issues = (F.when(absent != "", F.array(F.concat(F.lit("missing "), absent)))
              .when(~F.col("component").isin(*COMPONENTS), F.array(F.lit("unknown component")))
              .when(~F.col("partition").isin(*PARTITIONS), F.array(F.lit("unknown partition")))
              .otherwise(detail))
    checked = clean.withColumn("issues", issues)
    usable = checked.filter((absent == "") & F.col("component").isin(*COMPONENTS) & F.col("partition").isin(*PARTITIONS))
    repeated = duplicates(usable, ["component", "group_id"]).select(
        "component", "group_id", F.lit("group listed more than once").alias("issue"))
    counts = usable.groupBy("component").pivot("partition", list(PARTITIONS)).count()
    names = rows.sparkSession.createDataFrame([(c,) for c in COMPONENTS], "component string")
    short = names.join(counts, "component", "left").select(
        "component", F.lit("").alias("group_id"), F.explode(F.concat(
            notes((F.coalesce(*PARTITIONS).isNull(), "component has no groups")),
            notes(*[(F.col(p).isNull(), f"no {p} group") for p in PARTITIONS]))).alias("issue"))
    return checked.select("component", "group_id", F.explode("issues").alias("issue")).unionByName(repeated).unionByName(short)


def fingerprint_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, sha256) that are unlisted, absent, changed, or whose listed path leaves the root."""
    listed = manifest.select("path", F.col("sha256").alias("expected"))
    joined = files.select("path", "sha256").join(listed, "path", "full_outer")
    escapes = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    problem = (F.when(escapes, "path leaves the root").when(F.col("expected").isNull(), "unlisted")
               .when(F.col("sha256").isNull(), "absent").when(F.col("sha256") != F.col("expected"), "changed"))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("path", "problem")


def request_issues(records: DataFrame, request: str, unit: str, order: str, longest: int = 10_000, span: bool = False) -> DataFrame:
    """Per request: several units, repeated orders, too many records, no positive time span."""
    per = records.groupBy(request).agg(
        F.count("*").alias("n"), F.count_distinct(unit).alias("units"), F.count_distinct(order).alias("orders"),
        (F.max(order) - F.min(order)).alias("span"))
    pairs = [(F.col("units") > 1, "several units"), (F.col("orders") < F.col("n"), "repeated order values"),
             (F.col("n") > longest, "too many records")]
    if span:
        pairs.append((F.col("span") <= 0, "no positive time span"))
    return per.select(request, F.col("n").alias("records"), F.explode(notes(*pairs)).alias("issue"))


def order_notes(s: Series, arrival: str, order: str, short: int = 10) -> DataFrame:
    """Warnings per unit: short history, gaps, rows that arrived out of order, broken final stretch.

    ``s`` is ordered by ``order``; ``arrival`` tells the order the rows came in.
    """
    marked = s.number("__n").trailing(2, lambda f: {
        "__step": F.col(order) - F.lag(order).over(f.ordered),
        "__came": (F.col(arrival) < F.lag(arrival).over(f.ordered)).cast("int")}).totals(__rows=F.count("*"))
    last = F.col("__n") > F.col("__rows") - (short - 1)
    per = marked.df.groupBy(*s.unit).agg(
        F.count("*").alias("records"), F.count_if(F.col("__step") > 1).alias("gaps"),
        F.count_if(F.col("__came") == 1).alias("out_of_order"),
        F.count_if(last & (F.col("__step") != 1)).alias("broken_tail"))
    text = notes((F.col("records") < short, "short history"), (F.col("gaps") > 0, "cycle gaps"),
                 (F.col("out_of_order") > 0, "out of order input"),
                 ((F.col("records") >= short) & (F.col("broken_tail") > 0), "last rows not consecutive"))
    return per.withColumn("notes", F.concat_ws("; ", text))
