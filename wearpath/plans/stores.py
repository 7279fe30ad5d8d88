"""Results that are written and read back: processed tables and their manifest, reports, history, artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, learn, profile
from ..operators.quality import DataQualityError
from ..session import materialise, shared_folder, table
from ..sources import artefacts, sinks
from .aggregates import _CURVE_SQL
from .checks import RESULTS, triaged
from .inputs import EV, HIST, WAVE, event_rows, tail
from .jobs import prepare, prepared
from .models import TR, training_rows
from .registry import flag, query, r, rs

# -- processed tables -------------------------------------------------------------------
_TIME, _TEXT = ("ts", "o_orderdate"), ("event_type", "rul_label_status", "fault")
_COLUMNS = {
    "engine": "user_id event_id ts event_type value cycle rul value_mean_5 value_mean_10",
    "battery": "o_custkey o_orderkey o_orderdate capacity eol_capacity discharge_cycle valid_capacity soh_percent initial_valid_capacity observed_eol_cycle rul_cycles "
               "at_or_after_eol rul_label_status rul_training_eligible",
    "hydraulic": "cycle_id emb_mean emb_std emb_min emb_max emb_range emb_rms emb_slope",
    "fuel_system": "user_id sample_count duration_seconds voltage_start voltage_end voltage_min voltage_max voltage_mean voltage_std voltage_drop current_abs_mean current_std "
                   "temperature_start temperature_end temperature_mean temperature_max temperature_rise load_current_abs_mean load_voltage_mean load_voltage_min "
                   "charge_throughput_ah energy_throughput_wh",
    "landing_gear": "p_partkey p_size p_retailprice fault",
}
_T64 = "list_transform(range(1, 65), lambda i: (i - 1) / 63.0 - 0.5)"
_TABLES = f"""WITH {EV}, {HIST}, {WAVE}, engine AS (SELECT *, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul, avg(value) OVER t AS value_mean_5, avg(value) OVER t10 AS value_mean_10
    FROM ev WINDOW {tail(5)}, {tail(10, 't10')}), battery AS (SELECT * FROM hist),
  u AS (SELECT cycle_id, unnest(samples) AS v, unnest({_T64}) AS t FROM wave), hydraulic AS (SELECT cycle_id, avg(v) AS emb_mean, stddev_pop(v) AS emb_std, min(v) AS emb_min, max(v) AS emb_max,
    max(v) - min(v) AS emb_range, sqrt(avg(v * v)) AS emb_rms, sum(v * t) / sum(t * t) AS emb_slope FROM u GROUP BY 1),
  fuel_system AS ({_CURVE_SQL}), landing_gear AS (SELECT p_partkey, p_size, p_retailprice, p_brand AS fault FROM part)"""


def _mean_sql(c):
    return "NULL" if c in _TIME else f"avg(length({c}))" if c in _TEXT else f"avg(CAST({c} AS DOUBLE))"


_FEATURES = " UNION ALL ".join(
    f"SELECT '{t}' AS component, '{c}' AS feature, count(*) AS rows, count({c}) AS filled, {rs(_mean_sql(c), 2)} AS mean FROM {t}" for t, names in _COLUMNS.items() for c in names.split())


def feature_means(frame, component):
    """Rows, filled cells and mean of every column (texts: of their lengths; times: none)."""
    parts = []
    for field in frame.schema:
        c, kind = F.col(field.name), field.dataType.typeName()
        mean = F.lit(None).cast("double") if kind.startswith(("timestamp", "date")) else F.avg(F.length(c)) if kind == "string" else F.avg(c.cast("double"))
        parts.append(F.struct(F.lit(field.name).alias("feature"), F.count("*").alias("rows"), F.count(c).alias("filled"), r(mean, 2).alias("mean")))
    return frame.agg(F.array(*parts).alias("p")).select(F.lit(component).alias("component"), F.inline("p"))


@query("snk_01_processed_tables", f"{_TABLES} {_FEATURES}")
def processed_tables(spark, d):
    """Every feature column of the five processed tables, read back from what was written."""
    base = shared_folder(spark, "processed")
    out = None
    for name, frame in prepared(spark, d).items():
        sinks.write_table(frame, f"{base}/{name}")
        one = feature_means(spark.read.schema(frame.schema).parquet(f"{base}/{name}"), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("job_01_prepare_manifest", f"""{_TABLES}, f AS ({_FEATURES}) SELECT component, any_value(rows) AS rows, CAST(count(*) AS INTEGER) AS columns, CAST(sum(filled) AS BIGINT) AS filled, 0 AS differing FROM f GROUP BY 1""")
def prepare_manifest(spark, d):
    """The manifest of the written tables next to what reading them finds: filled cells, and whether rows differ from the plans' own.

    The plans are written a second time, in another number of part files; a digest that differs marks the table.
    """
    base = shared_folder(spark, "manifest")
    manifest = prepare(spark, d, base)
    found, again = None, None
    for name, frame in prepared(spark, d).items():
        data = spark.read.schema(frame.schema).parquet(f"{base}/{name}")
        one = data.agg(sum((F.count(c) for c in data.columns), F.lit(0)).alias("filled")).select(F.lit(f"{base}/{name}").alias("path"), F.lit(name).alias("component"), "filled")
        found = one if found is None else found.unionByName(one)
        data.repartition(3).write.parquet(f"{base}/again/{name}")
        two = artefacts.table_digest(spark, f"{base}/again/{name}").select(F.lit(name).alias("component"), F.col("digest").alias("again"))
        again = two if again is None else again.unionByName(two)
    joined = manifest.join(found, "path").join(again, "component")
    return joined.select("component", "rows", "columns", "filled", flag((F.col("sha256") != F.col("again")) | (F.col("bytes") <= 0)).alias("differing"))


@query("snk_08_no_overwrite", "SELECT event_type, count(*) AS rows, 1 AS refused FROM events GROUP BY 1")
def no_overwrite(spark, d):
    """A second write to a finished table is refused and leaves it as it is."""
    place = shared_folder(spark, "experiment") + "/result"
    events = event_rows(spark, d).select("event_type", "event_id")
    sinks.write_table(events, place, ["event_type"])
    try:
        sinks.write_table(events.limit(1), place, ["event_type"])
        refused = 0
    except Exception:
        refused = 1
    return spark.read.parquet(place).groupBy("event_type").agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


@query("src_09_table_round_trip", f"""SELECT event_type, count(*) AS rows, count(DISTINCT CAST(user_id AS VARCHAR)) AS keys, {rs('sum(value / 3)', 4)} AS total, 0 AS differing FROM events GROUP BY 1""")
def table_round_trip(spark, d):
    """Doubles and text keys read back from Parquet and from CSV are the ones written, bit for bit."""
    base = shared_folder(spark, "round-trip")
    rows = event_rows(spark, d).select("event_id", F.col("user_id").cast("string").alias("unit"), "event_type", (F.col("value") / 3).alias("x"))
    kinds = {"parquet": {}, "csv": {"header": "true"}}
    for kind in kinds:
        sinks.write_table(rows, f"{base}/{kind}", kind=kind)
    back = [spark.read.schema(rows.schema).options(**options).format(kind).load(f"{base}/{kind}") for kind, options in kinds.items()]
    both = back[0].join(back[1].select("event_id", *[F.col(c).alias(f"other_{c}") for c in ("unit", "event_type", "x")]), "event_id", "full_outer")
    joined = both.join(rows.select("event_id", F.col("x").alias("own")), "event_id", "full_outer")
    same = F.col("x").eqNullSafe(F.col("own")) & F.col("other_x").eqNullSafe(F.col("own")) & F.col("unit").eqNullSafe(F.col("other_unit"))
    return joined.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_distinct("unit").alias("keys"), r(F.sum("x"), 4).alias("total"), F.count_if(~same).cast("int").alias("differing"))


@query("snk_04_json_reports", f"SELECT event_type, count(*) AS rows, {rs('avg(value)')} AS mean, {rs('max(value)')} AS highest, {rs('stddev_pop(value)')} AS spread FROM events GROUP BY 1")
def json_reports(spark, d):
    """A metrics table written as JSON lines and read back."""
    place = shared_folder(spark, "report") + "/metrics"
    metrics = event_rows(spark, d).groupBy("event_type").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"), F.max("value").alias("highest"), F.stddev_pop("value").alias("spread"))
    sinks.write_report(metrics, place)
    back = spark.read.schema(metrics.schema).json(place)
    return back.select("event_type", "rows", *[r(c).alias(c) for c in ("mean", "highest", "spread")])


@query("snk_06_payload_csv", f"""SELECT user_id, event_id, event_type, {rs('value')} AS value FROM events""")
def payload_csv(spark, d):
    """Nested samples as flat CSV rows with their request's fields, quotes and commas kept, read back."""
    place = shared_folder(spark, "payload") + "/csv"
    rows = event_rows(spark, d).withColumn("label", F.concat(F.lit('say "'), "event_type", F.lit('", twice')))
    nested = rows.groupBy("user_id", F.floor(F.col("event_id") / 500).alias("part")).agg(F.collect_list(F.struct("event_id", "label", "value")).alias("samples"))
    flat = sinks.payload_rows(nested, "samples", ["user_id"])
    flat.write.option("header", True).option("escape", '"').csv(place)
    back = spark.read.schema(flat.schema).option("header", True).option("escape", '"').csv(place)
    return back.select("user_id", "event_id", F.regexp_extract("label", '^say "(.*)", twice$', 1).alias("event_type"), r("value").alias("value"))


# -- prediction history -------------------------------------------------------------------
_LOG = RESULTS + """, entry AS (SELECT 'e' || event_id AS id, ts, CAST(user_id AS VARCHAR) AS asset_id, component, reason, level, k,
  CASE WHEN level = 'Critical' AND k % 2 = 0 THEN 'confirmed_fault' WHEN level = 'Critical' THEN 'inconclusive' ELSE 'unreviewed' END AS outcome FROM tri)"""


def written_history(spark, d):
    """One entry per result; critical ones are reviewed, some twice; some reviews name entries that do not exist.

    The log is compacted between the appends and once more at the end.
    """
    place = shared_folder(spark, "history")
    rows = materialise(triaged(spark, d).select("event_id", "user_id", "ts", "component", "reason", "level", "k", "needs_review"), "results")
    at = F.col("ts").cast("timestamp")
    key = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    entries = rows.select(key.alias("id"), at.alias("at"), "component", F.col("user_id").cast("string").alias("asset_id"), F.lit(sinks.SOURCES[0]).alias("source"),
                          F.col("reason").alias("summary"), F.col("needs_review").alias("review_required"), F.lit("v2").alias("model_release"), F.sha2(key, 256).alias("input_digest"))
    sinks.append_history(sinks.created(entries), place)
    sinks.compact_history(spark, place)
    critical = rows.filter("level = 'Critical'")
    first = critical.select(key.alias("id"), (at + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("inconclusive").alias("outcome_status"))
    second = critical.filter("k % 2 = 0").select(key.alias("id"), (at + F.expr("INTERVAL 2 HOURS")).alias("at"), F.lit("confirmed_fault").alias("outcome_status"))
    lost = rows.filter("event_id % 50 = 0").select(F.concat(F.lit("x"), key).alias("id"), at.alias("at"), F.lit("inconclusive").alias("outcome_status"))
    for change in (second, first.unionByName(lost)):
        sinks.append_history(sinks.outcomes(change, sinks.OUTCOMES), place)
    sinks.compact_history(spark, place)
    return sinks.read_history(spark, place)


def _listed(found):
    return found.select("id", "asset_id", "component", F.col("summary").alias("reason"), F.coalesce("outcome_status", F.lit(sinks.UNREVIEWED)).alias("outcome"), F.col("created_at_utc").alias("created"))


_SHOWN = "SELECT id, asset_id, component, reason, outcome, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created FROM entry"


@query("snk_05_newest_history", f"WITH {_LOG} {_SHOWN} ORDER BY ts DESC, id DESC LIMIT 50")
def newest_history(spark, d):
    return _listed(sinks.newest_history(written_history(spark, d), 50))


@query("snk_05b_asset_history", f"WITH {_LOG} {_SHOWN} WHERE asset_id = '7' ORDER BY ts DESC, id DESC LIMIT 200")
def asset_history(spark, d):
    return _listed(sinks.newest_history(written_history(spark, d), 200, " 7 "))


@query("job_08c_history_outcomes", f"""WITH {_LOG} SELECT outcome, count(*) AS entries, count(DISTINCT asset_id) AS assets FROM entry GROUP BY 1
  UNION ALL SELECT 'unknown id', count(*), 0 FROM entry WHERE CAST(id[2:] AS BIGINT) % 50 = 0""")
def history_outcomes(spark, d):
    """Entries by their latest outcome, and outcomes that name no entry."""
    log = materialise(written_history(spark, d), "log")
    now = sinks.current_history(log).groupBy(F.coalesce("outcome_status", F.lit(sinks.UNREVIEWED)).alias("outcome")).agg(F.count("*").alias("entries"), F.count_distinct("asset_id").alias("assets"))
    lost = sinks.unknown_outcomes(log).distinct().agg(F.count("*").alias("entries")).select(F.lit("unknown id").alias("outcome"), "entries", F.lit(0).cast("long").alias("assets"))
    return now.unionByName(lost)


# -- artefacts ------------------------------------------------------------------------------
def fitted_artefact(rows, path: str, version: str):
    """Fit a capped estimate on all rows and keep scaling, model, radius and bounds as one version."""
    spark = rows.sparkSession
    features = ["cycle", "value_mean_5"]
    model = learn.fit(rows, features, learn.linear("capped"))
    scored = learn.apply_model(model, rows, 0.0, 40.0)
    radius = calibrate.conformal_radius(scored.withColumn("e", F.col("capped") - F.col("predicted")), "e", 0.05)
    scaling = learn.fit_scaling(rows, features)
    constants = spark.createDataFrame([(c, scaling.mean[c], scaling.std[c]) for c in scaling.kept], "feature string, mean double, std double")
    artefacts.save(spark, path, version, {"scaling": constants, "radius": radius, "bounds": profile.support_bounds(rows, features)}, {"model": model})
    return scored


def apply_artefact(found: artefacts.Artefact, rows):
    """Estimate, interval and support flags from the parts of a loaded version."""
    radius = found.tables["radius"].first()["radius"]  # one row
    bounds = {b["feature"]: b.asDict() for b in found.tables["bounds"].collect()}  # one row a feature
    scored = learn.apply_model(found.models["model"], rows, 0.0, 40.0)
    return scored.withColumns(calibrate.support_flags(bounds)).withColumns(calibrate.interval(F.col("predicted"), F.lit(radius)))


_FIT = f"""{TR}, m AS (SELECT avg(cycle) AS mx, avg(value_mean_5) AS mz, avg(least(rul, 40)) AS my, covar_pop(cycle, cycle) AS xx, covar_pop(value_mean_5, value_mean_5) AS zz, covar_pop(cycle, value_mean_5) AS xz,
    covar_pop(cycle, least(rul, 40)) AS xy, covar_pop(value_mean_5, least(rul, 40)) AS zy FROM tr),
  k AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM m),
  p AS (SELECT tr.*, least(rul, 40) AS capped, least(greatest(my + b * (cycle - mx) + c * (value_mean_5 - mz), 0), 40) AS predicted FROM tr, k),
  q AS (SELECT max(e) FILTER (n = least(ceil((t + 1) * CAST(0.95 AS DOUBLE)), t)) AS radius FROM (SELECT abs(capped - predicted) AS e, row_number() OVER (ORDER BY abs(capped - predicted)) AS n, count(*) OVER () AS t FROM p))"""


@query("snk_09_reload_predictions", f"WITH {_FIT} SELECT event_id, {rs('predicted', 3)} AS predicted, {rs('greatest(predicted - radius, 0)', 3)} AS lower, {rs('predicted + radius', 3)} AS upper, 0 AS differs FROM p, q")
def reload_predictions(spark, d):
    """A fit saved, read back with its digests checked, and applied: its predictions next to those of the fit that was saved."""
    rows = materialise(training_rows(spark, d).withColumn("capped", F.least("rul", F.lit(40.0))), "training")
    place = shared_folder(spark, "artefacts")
    before = fitted_artefact(rows, place, "v1").select("event_id", F.col("predicted").alias("saved"))
    after = apply_artefact(artefacts.load(spark, place, "v1"), rows)
    both = after.join(before, "event_id", "full_outer")
    return both.select("event_id", *[r(c, 3).alias(c) for c in ("predicted", "lower", "upper")], flag(~F.col("predicted").eqNullSafe(F.col("saved"))).alias("differs"))


@query("mdl_29b_artefact_parts", f"""WITH {_FIT}, s AS (SELECT 'scaling' AS part, 2 AS rows, 3 AS columns UNION ALL SELECT 'radius', 1, 1 UNION ALL SELECT 'bounds', 2, 5)
  SELECT part, CAST(rows AS BIGINT) AS rows, CASE part WHEN 'scaling' THEN {rs("(SELECT mx + mz FROM m)", 4)} WHEN 'radius' THEN {rs("(SELECT radius FROM q)", 4)}
    ELSE {rs("(SELECT max(cycle) + max(value_mean_5) FROM tr)", 4)} END AS content, 1 AS refused FROM s""")
def artefact_parts(spark, d):
    """What a loaded version holds, and that a version with a changed part is refused."""
    rows = materialise(training_rows(spark, d).withColumn("capped", F.least("rul", F.lit(40.0))), "training")
    place = shared_folder(spark, "artefacts")
    fitted_artefact(rows, place, "v1")
    parts = artefacts.load(spark, place, "v1").tables
    fitted_artefact(rows, place, "v2")
    refused = {}
    for name, frame in parts.items():
        number = next(f.name for f in frame.schema if f.dataType.typeName() == "double")
        held = materialise(frame, "held")
        held.withColumn(number, F.col(number) + 1).write.mode("overwrite").parquet(f"{place}/v2/{name}")
        try:
            artefacts.load(spark, place, "v2")
            refused[name] = 0
        except DataQualityError:
            refused[name] = 1
        held.write.mode("overwrite").parquet(f"{place}/v2/{name}")
    content = {"scaling": F.sum("mean"), "radius": F.max("radius"), "bounds": F.sum("hard_max")}
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias("rows"), r(content[name], 4).alias("content")).select(F.lit(name).alias("part"), "rows", "content", F.lit(refused[name]).alias("refused"))
        out = one if out is None else out.unionByName(one)
    return out
