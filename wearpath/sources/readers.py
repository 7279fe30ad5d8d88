"""Readers of the raw files. Each gives a typed DataFrame; ``strict`` raises where a row breaks a rule.

Rules are evaluated beside the parse: `ingest` writes each row once, sound or with the names of the rules it breaks. Strict readers go on from the written rows, so the files are parsed once whatever
number of rules there are; with ``strict=False`` rows come as parsed, lazily and unchecked.

Rows are told apart by their file's whole path; ``file`` is its name. Row order that exists only in a file becomes an
explicit column here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import quality
from ..operators.quality import DataQualityError, Rule, require
from ..operators.series import series
from ..session import shared_folder
from . import schemas


@dataclass(frozen=True)
class Ingested:
    """Sound rows, and the others with ``broken_rules``; how many there are of both."""

    good: DataFrame
    bad: DataFrame
    rows: int
    broken: int


def ingest(rows: DataFrame, rules: Sequence[Rule]) -> Ingested:
    """Parse, judge and write in one job. The counts come from the written files' footers.

    (An Observation would count on the way, but a session that has used one can no longer be part of a closure, as some
    MLlib models' are.)
    """
    names = F.array_compact(F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules]))
    marked = rows.withColumn("broken_rules", names).withColumn("__sound", F.size("broken_rules") == 0)
    path = shared_folder(rows.sparkSession, "ingest")
    marked.write.partitionBy("__sound").parquet(path)
    back = rows.sparkSession.read.schema(marked.schema).parquet(path)
    counts = {row["__sound"]: row["count"] for row in back.groupBy("__sound").count().collect()}  # two rows at most
    broken = counts.get(False, 0)
    return Ingested(back.filter("__sound").drop("__sound", "broken_rules"), back.filter("NOT __sound").drop("__sound"), counts.get(True, 0) + broken, broken)


def settled(rows: DataFrame, rules: Sequence[Rule], what: str, strict: bool) -> DataFrame:
    """The rows, or in strict mode the written sound rows; raises with one example where there are others."""
    if not strict:
        return rows
    got = ingest(rows, rules)
    if got.broken:
        raise DataQualityError(f"{what}: {got.broken} of {got.rows} rows, such as {got.bad.first().asDict()}")
    return got.good


def _place() -> tuple[Column, Column]:
    return F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file")


def _rule(name: str, broken: Column, detail: Column | None = None) -> Rule:
    return Rule(name, broken, F.lit("") if detail is None else detail)


def numbered_lines(spark: SparkSession, path: str, **layout) -> DataFrame:
    """path, file, line (1-based), value of every non-blank line, for any number of files of any size.

    A split's rows are read in order, so (path, split start, id inside the scan) is the line order.
    """
    raw = spark.read.text(path).select(*_place(), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), "value")
    kept = raw.filter(F.trim("value") != "")
    return series(kept, "path", ("__start", "__id"), **layout).number("line").frame.select("path", "file", "line", "value")


def _words(value: str = "value"):
    return F.split(F.trim(F.col(value)), r"\s+")


def trajectory_rules(columns: Sequence[str]) -> list[Rule]:
    ids = list(columns[:2])
    rules = [_rule("columns", F.col("__width") != len(columns))] + [quality.missing(c) for c in columns] + [quality.non_finite(c) for c in columns]
    return rules + [quality.out_of_range(c, 1) for c in ids] + [quality.not_integer(c) for c in ids]


def parse_trajectories(spark: SparkSession, path: str, columns: Sequence[str] = schemas.ENGINE_COLUMNS) -> DataFrame:
    """Lines as rows, unchecked; ``__width`` is the number of words and ``__line`` the text."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(*_place(), _words().alias("w"), "value")
    return lines.select("file", *[F.get("w", i).try_cast("double").alias(c) for i, c in enumerate(columns)], "path", F.size("w").alias("__width"), F.col("value").alias("__line"))


def read_trajectories(spark: SparkSession, path: str, strict: bool = True, columns: Sequence[str] = schemas.ENGINE_COLUMNS) -> DataFrame:
    """Whitespace-separated, header-less trajectories; ``file`` tells the subset."""
    rows = parse_trajectories(spark, path, columns)
    rows = settled(rows, trajectory_rules(columns), "trajectory rows", strict).drop("__width", "__line")
    if strict:
        require(quality.duplicates(rows, ["path", *columns[:2]]), "trajectory keys repeat")
    return rows.withColumns({c: F.col(c).cast("long") for c in columns[:2]})


def read_life_labels(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One number per line; line k of a file belongs to its unit k."""
    lines = numbered_lines(spark, path)
    rows = lines.select("file", F.col("line").alias("unit_id"), F.trim("value").try_cast("double").alias("additional_rul"), "path")
    rules = [quality.missing("additional_rul"), quality.not_integer("additional_rul"), quality.out_of_range("additional_rul", 0)]
    return settled(rows, rules, "life labels", strict).withColumn("additional_rul", F.col("additional_rul").try_cast("long"))


def _csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text with the header checked against the expected names."""
    ddl = ", ".join(f"`{c}` string" for c in columns)
    header = spark.read.option("header", True).csv(path)
    issues = quality.schema_issues(header, columns)
    if issues:
        raise DataQualityError("; ".join(issues))
    return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).option("nullValue", "\0").option("escape", '"').csv(path)


def read_event_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Battery metadata: text columns to integers, capacity, complex impedance and timestamps."""
    raw = _csv(spark, path, schemas.BATTERY_COLUMNS)
    long = lambda c: F.col(c).try_cast("long").alias(c)
    typed = raw.select(
        "type", fn.timestamp_from_vector(F.col("start_time")).alias("start_time"), long("ambient_temperature"), "battery_id",
        long("test_id"), long("uid"), "filename", fn.missing_to_null(F.col("Capacity")).try_cast("double").alias("capacity"),
        fn.complex_number(F.col("Re")).alias("re"), fn.complex_number(F.col("Rct")).alias("rct"),
        F.col("Capacity").alias("__capacity"), F.col("Re").alias("__re"), F.col("Rct").alias("__rct"))
    lost = lambda text, value: fn.missing_to_null(F.col(text)).isNotNull() & F.col(value).isNull()
    rules = [quality.missing(c) for c in ("start_time", "ambient_temperature", "test_id", "uid")]
    rules += [quality.outside_domain("type", list(schemas.SAMPLE_COLUMNS)), quality.out_of_range("ambient_temperature", -100),
              _rule("unsafe:filename", ~fn.safe_file_name(F.col("filename")), F.col("filename"))]
    rules += [_rule(f"malformed:{v}", lost(t, v), F.col(t)) for t, v in (("__capacity", "capacity"), ("__re", "re"), ("__rct", "rct"))]
    rows = settled(typed, rules, "event log", strict).drop("__capacity", "__re", "__rct")
    if strict:
        for key in ("uid", "filename"):
            require(quality.duplicates(rows, [key]), f"{key} repeats")
    return rows


def read_samples(spark: SparkSession, path: str, kind: str, metadata: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """All measurement files of one kind in a single job, joined to their metadata by file name."""
    columns = schemas.SAMPLE_COLUMNS[kind]
    ddl = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)
    convert = fn.complex_number if kind == "impedance" else (lambda c: c.try_cast("double"))
    rows = raw.select(F.col("_metadata.file_name").alias("filename"), *[convert(F.col(c)).alias(c) for c in columns])
    rules = [] if kind == "impedance" else [quality.missing(c) for c in columns] + [quality.non_finite(c) for c in columns]
    rows = settled(rows, rules, "samples", strict and bool(rules))
    if metadata is None:
        return rows
    wanted = metadata.filter(F.col("type") == kind)
    if strict:
        require(wanted.join(rows.select("filename").distinct(), "filename", "left_anti").select("uid", "filename"), "events without samples")
    return rows.join(wanted.select("filename", "uid", "battery_id"), "filename")


def read_matrix(spark: SparkSession, path: str, samples: int | None = None, strict: bool = True) -> DataFrame:
    """One waveform per line: file, cycle_id (line number in its file), samples array, path."""
    rows = numbered_lines(spark, path).select(
        "file", F.col("line").alias("cycle_id"), F.transform(_words(), lambda v: v.try_cast("double")).alias("samples"), "path")
    rules = [_rule("non_finite", F.exists("samples", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))]
    rules += [] if samples is None else [_rule("length", F.size("samples") != samples)]
    return settled(rows, rules, "waveforms", strict)


def read_sensor(spark: SparkSession, folder: str, sensor: str, strict: bool = True) -> DataFrame:
    hz = schemas.SENSOR_HZ[sensor]
    rows = read_matrix(spark, f"{folder}/{sensor}.txt", hz * schemas.CYCLE_SECONDS, strict)
    return rows.select("cycle_id", F.col("samples").alias(sensor))


def read_profile(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Condition labels: integers from fixed domains, keyed by line number (and file, where there are several)."""
    names = list(schemas.PROFILE_DOMAINS)
    lines = numbered_lines(spark, path).select("path", F.col("line").alias("cycle_id"), F.transform(_words(), lambda v: v.try_cast("double")).alias("v"))
    rows = lines.select("cycle_id", *[F.get("v", i).alias(n) for i, n in enumerate(names)], "path", F.size("v").alias("__width"))
    rules = [_rule("columns", F.col("__width") != len(names))] + [quality.missing(n) for n in names] + [quality.not_integer(n) for n in names]
    rules += [quality.outside_domain(n, [float(v) for v in allowed]) for n, allowed in schemas.PROFILE_DOMAINS.items()]
    return settled(rows, rules, "condition labels", strict).drop("__width").withColumns({n: F.col(n).cast("long") for n in names})


def read_scenarios(spark: SparkSession, path: str, scenarios: dict[str, str], expected_rows: int | None = None, strict: bool = True) -> DataFrame:
    """Scenario files as one table with code, label and sample index.

    ``scenarios`` names each scenario by its file or by the folder that its one file lies in.
    """
    lines = numbered_lines(spark, path)
    header = ",".join(schemas.FUEL_CHANNELS)
    cells = F.split("value", ",")
    name = F.create_map(*[F.lit(x) for kv in scenarios.items() for x in kv])
    code = F.create_map(*[F.lit(x) for kv in schemas.FUEL_CODES.items() for x in kv])
    folder = F.url_decode(F.element_at(F.split("path", "/"), -2))
    rows = lines.select(
        F.coalesce(F.try_element_at(name, F.col("file")), F.try_element_at(name, folder)).alias("scenario_id"), (F.col("line") - 1).alias("sample_index"),
        *[F.trim(F.get(cells, i)).try_cast("double").alias(c) for i, c in enumerate(schemas.FUEL_CHANNELS)], (F.trim("value") == header).alias("__header"))
    rows = rows.filter(F.col("scenario_id").isNotNull() & ((F.col("sample_index") > 0) | ~F.col("__header")))
    rules = [_rule("unexpected columns", F.col("sample_index") == 0)] + [quality.missing(c) for c in schemas.FUEL_CHANNELS] + [quality.non_finite(c) for c in schemas.FUEL_CHANNELS]
    rows = settled(rows, rules, "scenario rows", strict).filter("sample_index > 0")
    if strict and expected_rows is not None:
        counts = rows.groupBy("scenario_id").agg(F.count("*").alias("rows"))
        require(counts.filter(F.col("rows") != expected_rows), f"expected {expected_rows} rows per scenario")
    return rows.select("scenario_id", F.try_element_at(code, F.col("scenario_id")).alias("scenario_code"),
                       (F.col("scenario_id") != "normal").cast("int").alias("is_abnormal"), "sample_index", *schemas.FUEL_CHANNELS)


def read_landing_events(spark: SparkSession, path: str, expected_rows: int | None = None, strict: bool = True) -> DataFrame:
    raw = _csv(spark, path, schemas.LANDING_COLUMNS)
    rows = raw.select(*[F.col(c).try_cast("double").alias(c) for c in schemas.LANDING_COLUMNS])
    features = schemas.LANDING_COLUMNS[1:7]
    rules = [quality.missing(c) for c in schemas.LANDING_COLUMNS] + [quality.non_finite(c) for c in schemas.LANDING_COLUMNS]
    rules += [quality.out_of_range(c, 0, strict=True) for c in ("RunID", *features)]
    rules += [quality.not_integer("RunID"), quality.not_integer("Fault_Code"), quality.outside_domain("Fault_Code", [0.0, 1.0, 2.0, 3.0]),
              quality.out_of_range("RUL", 0, 100)]
    rows = settled(rows, rules, "landing events", strict)
    if strict:
        require(quality.duplicates(rows, ["RunID"]), "RunID repeats")
        if expected_rows is not None and rows.count() != expected_rows:
            raise DataQualityError(f"expected {expected_rows} landing events")
    return rows.withColumns({"RunID": F.col("RunID").cast("long"), "Fault_Code": F.col("Fault_Code").cast("int")})


def read_requests(spark: SparkSession, path: str, component: str, strict: bool = True) -> DataFrame:
    """Files of JSON requests, one per line; unreadable lines are kept in ``_unreadable`` unless strict."""
    schema = schemas.request_schema(component).add("_unreadable", "string")
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_unreadable").json(path)
    if not strict:
        return rows
    return settled(rows, [_rule("unreadable", F.col("_unreadable").isNotNull(), F.col("_unreadable"))], "requests", True).drop("_unreadable")


def request_records(requests: DataFrame, array: str = "records") -> DataFrame:
    """Nested records as rows with their arrival number."""
    keep = [c for c in requests.columns if c != array]
    exploded = requests.select(*keep, F.posexplode(array).alias("arrival", "__r"))
    return exploded.select(*keep, "arrival", "__r.*")


def read_uploads(spark: SparkSession, path: str, component: str, columns: Sequence[str]) -> DataFrame:
    """Upload CSV files to request documents, one row per file.

    A file is one request by contract (at most 20 000 samples), so gathering its rows is bounded;
    longer ones are rejected before anything is gathered.
    """
    raw = _csv(spark, path, columns)
    text_columns = {"battery_id", "operating_condition_stable"}
    rows = raw.select(*_place(), F.monotonically_increasing_id().alias("__id"),
                      *[(F.col(c) if c in text_columns else F.col(c).try_cast("double")).alias(c) for c in columns])
    numeric = [c for c in columns if c not in text_columns]
    rules = [quality.missing(c) for c in columns] + [quality.non_finite(c) for c in numeric]
    if "operating_condition_stable" in columns:
        rules.append(_rule("not a boolean word", fn.boolean_word(F.col("operating_condition_stable")).isNull()))
    rows = settled(rows, rules, "upload cells", True).withColumnRenamed("path", "request_id").drop("file")
    limit = {"hydraulic": 1, "landing-gear": 1, "battery": 20_000}.get(component, 10_000)
    counts = rows.groupBy("request_id").agg(F.count("*").alias("rows"))
    require(counts.filter(F.col("rows") > limit), f"at most {limit} rows per {component} file")
    gather = lambda names: F.transform(F.array_sort(F.collect_list(F.struct("__id", *names))), lambda s: F.struct(*[s[n].alias(n) for n in names]))
    if component == "battery":
        fixed = ["battery_id", "discharge_cycle", "ambient_temperature"]
        spread = rows.groupBy("request_id").agg(*[F.count_distinct(c).alias(c) for c in fixed])
        require(spread.filter(" or ".join(f"{c} <> 1" for c in fixed)), "battery fields must stay the same on every row")
        rest = [c for c in columns if c not in fixed]
        return rows.groupBy("request_id").agg(*[F.first(c).alias(c) for c in fixed], gather(rest).alias("samples"))
    if component == "hydraulic":
        rest = [c for c in columns if c not in ("cycle_id", "operating_condition_stable")]
        features = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))])
        return rows.select("request_id", F.col("cycle_id").cast("long").alias("cycle_id"),
                           fn.boolean_word(F.col("operating_condition_stable")).alias("operating_condition_stable"), features.alias("features"))
    if component == "landing-gear":
        return rows.drop("__id")
    return rows.groupBy("request_id").agg(gather(list(columns)).alias("records" if component == "engine" else "samples"))


def read_bundles(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Documents with exactly one section per component."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("bundle_id"), "value")
    sections = F.map_keys(F.from_json("value", "map<string,string>"))
    wanted = F.array(*[F.lit(c) for c in schemas.HISTORY_COMPONENTS])
    rows = whole.select("bundle_id", "value", F.array_except(wanted, sections).alias("absent"), F.array_except(sections, wanted).alias("unknown"))
    if strict:
        require(rows.filter(F.col("absent").isNull() | (F.size("absent") > 0) | (F.size("unknown") > 0)).select("bundle_id"), "bundle sections")
    parts = F.from_json("value", "map<string,string>")
    return rows.select("bundle_id", *[F.element_at(parts, F.lit(c)).alias(c) for c in schemas.HISTORY_COMPONENTS]) if strict else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Validation manifest as text columns; a byte-order mark before the header is ignored."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in rows.columns])
    absent = [c for c in quality.MANIFEST_COLUMNS if c not in rows.columns]
    if absent:
        raise DataQualityError(f"manifest lacks {absent}")
    return rows
