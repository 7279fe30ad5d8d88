"""Readers against the tables: raw files are rendered from the given tables, parsed, and compared with the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..session import shared_folder, table
from ..sources import readers, schemas
from .inputs import EV, event_series
from .registry import query, r, rs

FILES = 12  # part files of a rendering that has no file order of its own


def _written(lines, purpose, *by, order=(), spread=()):
    """Lines (column ``value``) as text files; with ``by``, one folder and file for each of its values, sorted by ``order``.

    With ``spread``, a value's lines go to several files, all lines with the same ``spread`` to one.
    """
    place = shared_folder(lines.sparkSession, purpose) + "/files"
    if spread:
        lines.repartition(*by, *spread).sortWithinPartitions(*by).select(*by, "value").write.partitionBy(*by).text(place)
    elif by:
        lines = lines.repartition(FILES, *by).sortWithinPartitions(*by, *order)
        lines.select(*by, "value").write.partitionBy(*by).text(place)
    else:
        lines.select("value").write.text(place)
    return place


def _csv_files(rows, purpose, *by):
    place = shared_folder(rows.sparkSession, purpose) + "/files"
    writer = (rows.repartition(FILES, *by) if by else rows).write.option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(place)
    return place


def _subset(name="path"):
    """What a folder key=value above a file says."""
    return F.regexp_extract(name, r"/[^/=]+=([^/]+)/[^/]+$", 1)


# -- trajectories --------------------------------------------------------------------------
def trajectory_lines(spark, d):
    """unit, cycle and 24 numbers derived from the event's value, two blanks apart here and there, trailing blanks."""
    s = event_series(spark, d).frame
    numbers = [F.round(F.col("value") * (i + 1) / 2, 3).cast("string") for i in range(24)]
    return s.select("event_type", "event_id", "user_id", F.concat(F.concat_ws(" ", (F.col("user_id") + 1).cast("string"), F.col("cycle").cast("string"), F.lit("")), F.concat_ws("  ", *numbers), F.lit("  ")).alias("value"))


_TRAJECTORY = f"""{EV} SELECT event_type AS subset, user_id + 1 AS unit_id, count(*) AS rows, max(cycle) AS last_cycle, {rs('sum(value / 2)', 3)} AS setting_1, {rs('sum(value * 12)', 3)} AS sensor_21"""


@query("src_01_trajectory_files", f"WITH {_TRAJECTORY} FROM ev GROUP BY 1, 2")
def trajectory_files(spark, d):
    place = _written(trajectory_lines(spark, d), "trajectories", "event_type", spread=["user_id"])
    rows = readers.read_trajectories(spark, f"{place}/*")
    return rows.groupBy(_subset().alias("subset"), "unit_id").agg(
        F.count("*").alias("rows"), F.max("cycle").alias("last_cycle"), r(F.sum("operational_setting_1"), 3).alias("setting_1"), r(F.sum("sensor_21"), 3).alias("sensor_21"))


@query("src_01b_rejected_lines", """WITH b AS (SELECT CASE event_id % 20 WHEN 3 THEN 'short' WHEN 7 THEN 'word' WHEN 11 THEN 'infinite' ELSE 'sound' END AS kind FROM events)
  SELECT CASE kind WHEN 'short' THEN 'columns' WHEN 'word' THEN 'missing:sensor_21' WHEN 'infinite' THEN 'non_finite:operational_setting_1' ELSE 'sound' END AS rule, count(*) AS rows FROM b GROUP BY 1
  UNION ALL SELECT 'missing:sensor_21', count(*) FILTER (kind = 'short') FROM b HAVING count(*) FILTER (kind = 'short') > 0 UNION ALL SELECT 'input', count(*) FROM b""")
def rejected_lines(spark, d):
    """Some lines lack a column, hold a word, or an infinite number: sound and rejected lines, by rule, from one pass."""
    kind = F.pmod("event_id", F.lit(20))
    words = F.split(F.trim("value"), r"\s+")
    broken = F.when(kind == 3, F.slice(words, 1, 25)).when(kind == 7, F.concat(F.slice(words, 1, 25), F.array(F.lit("n/a")))).when(
        kind == 11, F.concat(F.slice(words, 1, 2), F.array(F.lit("Infinity")), F.slice(words, 4, 23))).otherwise(words)
    place = _written(trajectory_lines(spark, d).withColumn("value", F.array_join(broken, " ")), "broken")
    got = readers.ingest(readers.parse_trajectories(spark, place), readers.trajectory_rules(schemas.ENGINE_COLUMNS))
    named = got.bad.select(F.explode("broken_rules").alias("rule")).filter(F.col("rule").isin("columns", "missing:sensor_21", "non_finite:operational_setting_1"))
    per = named.groupBy("rule").agg(F.count("*").alias("rows"))
    # A line that is short breaks two rules; the SQL lists both, so equal names come as two rows.
    split = per.filter("rule <> 'missing:sensor_21'").unionByName(got.bad.filter(F.array_contains("broken_rules", "missing:sensor_21")).groupBy(
        F.array_contains("broken_rules", "columns").alias("short")).agg(F.count("*").alias("rows")).select(F.lit("missing:sensor_21").alias("rule"), "rows"))
    sound = got.good.agg(F.count("*").alias("rows")).select(F.lit("sound").alias("rule"), "rows")
    return split.unionByName(sound).unionByName(spark.range(1).select(F.lit("input").alias("rule"), F.lit(got.rows).cast("long").alias("rows")))


@query("src_02_life_label_files", """WITH u AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT event_type AS subset, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS unit_id, n AS additional_rul FROM u""")
def life_label_files(spark, d):
    """One file a subset, all of the same name; a line's number in its file is the unit."""
    units = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").cast("string").alias("value"))
    rows = readers.read_life_labels(spark, _written(units, "labels", "event_type", order=["user_id"]) + "/*")
    return rows.select(_subset().alias("subset"), F.col("unit_id").cast("long").alias("unit_id"), "additional_rul")


# -- battery ---------------------------------------------------------------------------------
_KIND = "CASE event_type WHEN 'click' THEN 'charge' WHEN 'view' THEN 'discharge' ELSE 'impedance' END"


@query("src_03_event_log", f"""SELECT event_id AS uid, {_KIND} AS type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started, CAST(json_extract(props, '$.k') AS BIGINT) AS ambient_temperature, 'B' || user_id AS battery_id,
  {rs(f"CASE WHEN {_KIND} = 'discharge' THEN value END", 4)} AS capacity, {rs(f"CASE WHEN {_KIND} = 'impedance' THEN value / 100 END", 4)} AS re, {rs(f"CASE WHEN {_KIND} = 'impedance' THEN -0.5 END", 4)} AS im FROM events""")
def event_log(spark, d):
    """Times as vectors, missing numbers as empty brackets, impedances as complex numbers."""
    k = F.from_json("props", "struct<k:int>")["k"]
    kind = F.when(F.col("event_type") == "click", "charge").when(F.col("event_type") == "view", "discharge").otherwise("impedance")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "value", k.alias("k"), kind.alias("type"))
    part = lambda f: F.date_format("ts", f).cast("int").cast("string")
    start = F.concat(F.lit("["), F.concat_ws(". ", *[part(f) for f in ("yyyy", "M", "d", "H", "m")]), F.lit(". "), F.date_format("ts", "s.SSSSSS"), F.lit("]"))
    impedance = F.when(F.col("type") == "impedance", F.concat(F.lit("("), F.round(F.col("value") / 100, 6).cast("decimal(12,6)").cast("string"), F.lit("-0.5j)"))).otherwise("")
    raw = events.select("type", start.alias("start_time"), F.col("k").alias("ambient_temperature"), F.concat(F.lit("B"), "user_id").alias("battery_id"), F.col("event_id").alias("test_id"),
                        F.col("event_id").alias("uid"), F.concat(F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".csv")).alias("filename"),
                        F.when(F.col("type") == "discharge", F.col("value").cast("string")).otherwise("[]").alias("Capacity"), impedance.alias("Re"), F.lit("[]").alias("Rct"))
    rows = readers.read_event_log(spark, _csv_files(raw, "metadata"))
    return rows.select("uid", "type", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started"), "ambient_temperature", "battery_id",
                       r("capacity", 4).alias("capacity"), r(F.col("re.re"), 4).alias("re"), r(F.col("re.im"), 4).alias("im"))


@query("src_04_sample_files", f"""SELECT user_id % {FILES} AS uid, 'B' || (user_id % {FILES}) AS battery_id, count(*) AS samples, {rs('sum(value)', 3)} AS voltage, {rs('max(epoch_us(ts) / 1e6)', 3)} AS last FROM events GROUP BY 1""")
def sample_files(spark, d):
    """Discharge files read in one job and joined to their metadata by file name."""
    events = table(spark, d, "events").select(F.pmod("user_id", F.lit(FILES)).alias("unit"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    v = F.col("value")
    samples = events.select("unit", v.alias("Voltage_measured"), F.lit(-2.0).alias("Current_measured"), F.lit(24.0).alias("Temperature_measured"), F.lit(2.0).alias("Current_load"), (v * 0.9).alias("Voltage_load"), (F.col("us") / 1e6).cast("decimal(20,6)").alias("Time"))
    place = shared_folder(spark, "samples") + "/files"
    for unit in range(FILES):  # a write each, so that every unit has one file with a name of its own
        samples.filter(F.col("unit") == unit).drop("unit").coalesce(1).write.option("header", True).csv(f"{place}/unit={unit}")
    names = spark.read.option("header", True).csv(f"{place}/*").select(F.col("_metadata.file_name").alias("filename"), _subset("_metadata.file_path").alias("unit")).distinct()
    meta = names.select("filename", F.col("unit").cast("long").alias("uid"), F.lit("discharge").alias("type"), F.concat(F.lit("B"), "unit").alias("battery_id"))
    rows = readers.read_samples(spark, f"{place}/*", "discharge", meta)
    return rows.groupBy("uid", "battery_id").agg(F.count("*").alias("samples"), r(F.sum("Voltage_measured"), 3).alias("voltage"), r(F.max("Time"), 3).alias("last"))


# -- hydraulic --------------------------------------------------------------------------------
@query("src_05_sensor_matrix", f"""WITH n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS cycle_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  SELECT CAST(label AS VARCHAR) AS sensor, cycle_id, CAST(len(e) AS INTEGER) AS samples, {rs('e[1]', 5)} AS first, {rs('e[64]', 5)} AS last, {rs('list_sum(e)', 5)} AS total FROM n""")
def sensor_matrix(spark, d):
    """One matrix file a label, tab-separated; the line number is the cycle."""
    lines = table(spark, d, "embeddings").select("label", "vec_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t").alias("value"))
    rows = readers.read_matrix(spark, _written(lines, "matrix", "label", order=["vec_id"]) + "/*", 64)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rows.select(_subset().alias("sensor"), F.col("cycle_id").cast("long").alias("cycle_id"), F.size("samples").alias("samples"),
                       r(F.get("samples", F.lit(0)), 5).alias("first"), r(F.get("samples", F.lit(63)), 5).alias("last"), r(total, 5).alias("total"))


def _pick(values, key="p_partkey"):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


_PROFILE = ", ".join(f"[{', '.join(map(str, v))}][p_partkey % {len(v)} + 1] AS {n}" for n, v in schemas.PROFILE_DOMAINS.items())


@query("src_06_condition_profile", f"""SELECT p_brand AS machine, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS cycle_id, {_PROFILE} FROM part""")
def condition_profile(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws("\t", *[_pick(v).cast("string") for v in schemas.PROFILE_DOMAINS.values()]).alias("value"))
    rows = readers.read_profile(spark, _written(parts, "profile", "p_brand", order=["p_partkey"]) + "/*")
    return rows.select(F.url_decode(F.url_decode(_subset())).alias("machine"), F.col("cycle_id").cast("long").alias("cycle_id"), *schemas.PROFILE_DOMAINS)


# -- fuel system and landing gear ---------------------------------------------------------------
SCENARIOS = {"view": "normal", "click": "one", "error": "two", "purchase": "three", "signup": "four"}
_SCENARIO = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCENARIOS.items()) + " END"


@query("src_07_scenario_files", f"""SELECT {_SCENARIO} AS scenario_id, CASE event_type {' '.join(f"WHEN '{k}' THEN {schemas.FUEL_CODES[v]}" for k, v in SCENARIOS.items())} END AS scenario_code,
  CAST(event_type <> 'view' AS INTEGER) AS is_abnormal, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sample_index, {rs('value', 3)} AS FTL, {rs('value + 7', 3)} AS CRTT FROM events""")
def scenario_files(spark, d):
    """One file a scenario with its header line first; the place in the file is the sample."""
    events = table(spark, d, "events").select("event_type", F.col("event_id").alias("at"), F.concat_ws(",", *[F.round(F.col("value") + i, 4).cast("string") for i in range(8)]).alias("value"))
    heads = events.select("event_type").distinct().select("event_type", F.lit(-1).cast("long").alias("at"), F.lit(",".join(schemas.FUEL_CHANNELS)).alias("value"))
    place = _written(events.unionByName(heads), "scenarios", "event_type", order=["at"])
    rows = readers.read_scenarios(spark, f"{place}/*", {f"event_type={k}": v for k, v in SCENARIOS.items()})
    return rows.select("scenario_id", "scenario_code", "is_abnormal", F.col("sample_index").cast("long").alias("sample_index"), r("FTL", 3).alias("FTL"), r("CRTT", 3).alias("CRTT"))


@query("src_08_landing_events", f"""SELECT p_partkey + 1 AS RunID, {rs('p_size / 100.0 + 0.01', 4)} AS Max_Deflection, {rs('p_retailprice', 3)} AS Mass, CAST(p_size % 4 AS INTEGER) AS Fault_Code, {rs('p_size * 2.0', 3)} AS RUL FROM part""")
def landing_events(spark, d):
    size = F.col("p_size")
    raw = table(spark, d, "part").select(
        (F.col("p_partkey") + 1).alias("RunID"), (size / 100 + 0.01).alias("Max_Deflection"), (size + 0.5).alias("Max_Velocity"), (size / 10 + 0.1).alias("Settling_Time"),
        F.col("p_retailprice").cast("double").alias("Mass"), F.lit(3.0).alias("K_Stiffness"), F.lit(4.0).alias("B_Damping"), F.pmod(size, F.lit(4)).alias("Fault_Code"), (size * 2).alias("RUL"))
    rows = readers.read_landing_events(spark, _csv_files(raw, "landing"))
    return rows.select("RunID", r("Max_Deflection", 4).alias("Max_Deflection"), r("Mass", 3).alias("Mass"), "Fault_Code", r("RUL", 3).alias("RUL"))


# -- uploads and manifests ------------------------------------------------------------------------
UPLOAD_ROWS = 5000


@query("src_11_upload_files", f"""WITH k AS (SELECT greatest({FILES}, CAST(ceil(count(*) / {UPLOAD_ROWS}.0) AS BIGINT)) AS files FROM events)
  SELECT event_id % files AS file, count(*) AS samples, {rs('sum(value)', 3)} AS FTL, {rs('max(value + 7)', 3)} AS CRTT FROM events, k GROUP BY 1""")
def upload_files(spark, d):
    """Upload files of fuel samples: header, finite numbers and row limit checked, one request a file."""
    events = table(spark, d, "events")
    files = events.agg(F.greatest(F.lit(FILES).cast("long"), F.ceil(F.count("*") / F.lit(float(UPLOAD_ROWS)))).alias("n")).scalar()
    rows = events.select(F.pmod("event_id", files).alias("file"), *[(F.col("value") + i).alias(c) for i, c in enumerate(schemas.FUEL_CHANNELS)])
    requests = readers.read_uploads(spark, _csv_files(rows, "uploads", "file") + "/*", "fuel-system", schemas.FUEL_CHANNELS)
    flat = requests.select(_subset("request_id").cast("long").alias("file"), F.inline("samples"))
    return flat.groupBy("file").agg(F.count("*").alias("samples"), r(F.sum("FTL"), 3).alias("FTL"), r(F.max("CRTT"), 3).alias("CRTT"))


@query("src_13_manifest_file", """WITH m AS (SELECT 'engine' AS component, 'g' || page_id AS group_id, CASE page_id % 2 WHEN 0 THEN 'frozen_test' ELSE 'external_calibration' END AS part,
    url, sha256(coalesce(html, '')) AS digest, page_id % 10 = 3 AS tuned FROM pages)
  SELECT component, group_id, issue FROM (SELECT component, group_id, unnest([CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'source is not a web address' END,
    CASE WHEN part = 'frozen_test' AND tuned THEN 'frozen group was tuned on' END]) AS issue FROM m) WHERE issue IS NOT NULL
  UNION ALL SELECT c, '', unnest(['component has no groups', 'no external_calibration group', 'no frozen_test group']) FROM (SELECT unnest(['battery', 'hydraulic', 'fuel-system', 'landing-gear']) AS c)""")
def manifest_file(spark, d):
    """A manifest CSV with a byte-order mark, read and judged."""
    pages = table(spark, d, "pages")
    values = {"component": F.lit("engine"), "group_id": F.concat(F.lit("g"), "page_id"), "partition": F.when(F.pmod("page_id", F.lit(2)) == 0, "frozen_test").otherwise("external_calibration"),
              "source_url": F.col("url"), "source_version": F.lit("1"), "license_or_access_terms": F.lit("open, see page"), "raw_sha256": F.sha2(F.coalesce("html", F.lit("")), 256),
              "acquired_utc": F.lit("2024-01-01T00:00:00Z"), "label_method": F.lit("inspection"), "independent_from_development": F.lit("TRUE"),
              "used_for_tuning": F.when(F.pmod("page_id", F.lit(10)) == 3, "true").otherwise("False")}
    rows = pages.select(*[v.cast("string").alias(("﻿" if i == 0 else "") + c) for i, (c, v) in enumerate(values.items())])
    return quality.manifest_issues(readers.read_manifest(spark, _csv_files(rows, "manifest")))
