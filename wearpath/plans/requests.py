"""Bundles of five requests: built from the tables, written, read back, checked and scored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, scoring, waveform
from ..operators.series import series
from ..session import materialise, shared_folder, table
from ..sources import bundles, schemas
from .inputs import EV, SAMPLES, WAVE, event_series, sample_rows, tail, waveform_rows
from .models import training_rows
from .registry import flag, query, r, rs

HELD = 5  # every fifth unit, part and vector is no training row
LIMIT = 2.5  # scaled distance from the normal centre beyond which a fuel sample is flagged
_CURVE = {"voltage": "voltage_measured", "current": "current_measured", "temperature": "temperature_measured", "load_current": "current_load", "load_voltage": "voltage_load", "time": "time"}


# -- documents ---------------------------------------------------------------------------------
def examples(spark, d):
    """One request of each component per user; a user without a vector or part of its own number lacks those."""
    events = event_series(spark, d).frame.select("user_id", "cycle", "value", "event_id")
    gathered = lambda rows, order, fields: rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("s")))).alias("x")).select("user_id", F.transform("x", lambda x: x["s"]).alias("x"))
    key = F.col("user_id").cast("string").alias("request_id")
    named = lambda rows, *fields: rows.select(F.col("user_id").cast("string").alias("bundle_id"), F.struct(key, *fields).alias("payload"))
    records = gathered(events, ["cycle"], [(F.col("user_id") + 1).alias("unit_id"), "cycle", F.col("value").alias("sensor_1")])
    samples = sample_rows(spark, d)
    v, c = F.col("voltage"), F.col("current")
    curve = gathered(samples, ["time", "event_id"], [v.alias("voltage_measured"), c.alias("current_measured"), v.alias("temperature_measured"), c.alias("current_load"), v.alias("voltage_load"), "time"])
    fuel = gathered(events, ["event_id"], [(F.col("value") + i).alias(n) for i, n in enumerate(schemas.FUEL_CHANNELS)])
    shapes = waveform_features(spark, d).select(F.col("cycle_id").alias("user_id"), "emb_mean", "emb_slope")
    features = F.create_map(F.lit("emb_mean"), F.col("emb_mean"), F.lit("emb_slope"), F.col("emb_slope"))
    users = events.select("user_id").distinct()
    gear = table(spark, d, "part").select((F.col("p_partkey") - 1).cast("long").alias("user_id"), "p_size", "p_retailprice").join(users, "user_id")
    size = F.col("p_size")
    return {
        "engine": named(records, F.lit("A").alias("subset"), F.col("x").alias("records")),
        "battery": named(curve, F.concat(F.lit("B"), "user_id").alias("battery_id"), F.lit(1).alias("discharge_cycle"), F.lit(24.0).alias("ambient_temperature"), F.col("x").alias("samples")),
        "hydraulic": named(shapes.join(users, "user_id"), F.col("user_id").alias("cycle_id"), (F.col("user_id") % 4 != 1).alias("operating_condition_stable"), features.alias("features")),
        "landing-gear": named(gear, (size / 100 + 0.01).alias("max_deflection"), (size + 0.5).alias("max_velocity"), (size / 10).alias("settling_time"), F.col("p_retailprice").cast("double").alias("mass")),
        "fuel-system": named(fuel, F.col("x").alias("samples")),
    }


def waveform_features(spark, d):
    return waveform.waveform_table(waveform_rows(spark, d).withColumnRenamed("samples", "emb"), "cycle_id", ["emb"])


def read_back(spark, d):
    """Documents with all five examples, written as lines and read back with their rules."""
    place = shared_folder(spark, "bundles") + "/lines"
    bundles.build(examples(spark, d), strict=False).select("value").write.text(place)
    return bundles.read(spark, place)


_USERS = "u AS (SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT vec_id FROM embeddings) AND user_id + 1 IN (SELECT p_partkey FROM part))"


@query("src_12_bundles", f"""WITH {_USERS}, e AS (SELECT e.* FROM events e JOIN u USING (user_id)) SELECT CAST(user_id AS VARCHAR) AS bundle_id, count(*) AS records, {rs('sum(value)', 3)} AS engine, {rs("sum(CAST(json_extract(props, '$.k') AS INTEGER))", 3)} AS battery,
  any_value(CAST(user_id % 4 <> 1 AS INTEGER)) AS stable, {rs('any_value((SELECT p_retailprice FROM part WHERE p_partkey = user_id + 1))', 3)} AS mass, {rs('sum(value + 7)', 3)} AS fuel FROM e GROUP BY 1, user_id""")
def bundle_documents(spark, d):
    """Bundles built from five examples and read back: a number from each of the typed sections."""
    parts = bundles.split(read_back(spark, d).good)
    total = lambda array, field: F.aggregate(array, F.lit(0.0), lambda a, x: a + x[field].cast("double"))
    engine = parts["engine"].select("bundle_id", F.size("records").cast("long").alias("records"), r(total("records", "sensor_1"), 3).alias("engine"))
    battery = parts["battery"].select("bundle_id", r(total("samples", "current_measured"), 3).alias("battery"))
    return engine.join(battery, "bundle_id").join(parts["hydraulic"].select("bundle_id", flag("operating_condition_stable").alias("stable")), "bundle_id").join(
        parts["landing-gear"].select("bundle_id", r("mass", 3).alias("mass")), "bundle_id").join(
        parts["fuel-system"].select("bundle_id", r(total("samples", "CRTT"), 3).alias("fuel")), "bundle_id")


@query("src_12b_rejected_bundles", f"""WITH {_USERS}, b AS (SELECT user_id % 7 AS k FROM u) SELECT * FROM (SELECT unnest(['unreadable', 'missing:battery', 'unexpected', 'not an object:engine', 'sound']) AS rule,
  unnest([count(*) FILTER (k = 1), count(*) FILTER (k = 2), count(*) FILTER (k = 3), count(*) FILTER (k = 4), count(*) FILTER (k NOT IN (1, 2, 3, 4))]) AS documents FROM b) WHERE documents > 0""")
def rejected_bundles(spark, d):
    """Documents cut short, without a section, with one too many, with a list for a section."""
    place = shared_folder(spark, "broken-bundles") + "/lines"
    whole = bundles.build(examples(spark, d), strict=False)
    k = F.col("bundle_id").cast("long") % 7
    value = (F.when(k == 1, F.substring("value", 1, 40)).when(k == 2, F.regexp_replace("value", '"battery":', '"engine2":')).when(k == 3, F.regexp_replace("value", "^\\{", '{"extra":{},'))
             .when(k == 4, F.regexp_replace("value", '^\\{"engine":', '{"engine":[1],"engine_old":')).otherwise(F.col("value")))
    whole.select(value.alias("value")).write.text(place)
    got = bundles.read(spark, place)
    wanted = ("unreadable", "missing:battery", "unexpected", "not an object:engine")
    # Renaming a section also makes an unexpected one: the first of the named rules counts.
    first = F.get(F.filter(F.array(*[F.lit(w) for w in (wanted[0], wanted[1], wanted[3], wanted[2])]), lambda w: F.array_contains("broken_rules", w)), 0)
    bad = got.bad.select(first.alias("rule")).groupBy("rule").agg(F.count("*").alias("documents"))
    good = got.good.agg(F.count("*").alias("documents")).select(F.lit("sound").alias("rule"), "documents").filter("documents > 0")
    return bad.unionByName(good)


# -- fits and results -----------------------------------------------------------------------------
def fitted(spark, d):
    """Constants of all tasks, from rows that no bundle with a number divisible by five is scored on."""
    engine = training_rows(spark, d).filter(F.col("user_id") % HELD != 0).withColumn("y", F.least("rul", F.lit(40.0)))
    engine = materialise(engine.select("value_mean_5", "y"), "engine")  # a fit reads its rows several times
    curves = waveform.curve_features(sample_rows(spark, d).filter(F.col("user_id") % HELD != 0), ["user_id"], {
        "voltage": "voltage", "current": "current", "temperature": "voltage", "load_current": "current", "load_voltage": "voltage", "time": "time"}, ["time", "event_id"])
    curves = materialise(curves.select("user_id", "voltage_mean", "voltage_end", (F.col("duration_seconds") / 86400).alias("days")), "curves")
    waves = waveform_rows(spark, d).filter(F.col("cycle_id") % HELD != 0).select("cycle_id", (F.get("samples", F.lit(0)) + F.get("samples", F.lit(1)) > 0).cast("int").alias("valve"))
    waves = materialise(waveform_features(spark, d).select("cycle_id", "emb_mean", "emb_slope").join(waves, "cycle_id"), "waves")
    parts = table(spark, d, "part").filter((F.col("p_partkey") - 1) % HELD != 0)
    gear = materialise(parts.select((F.col("p_size") / 100 + 0.01).alias("max_deflection"), F.col("p_retailprice").cast("double").alias("mass"), ((F.col("p_size") > 25).cast("int") + (F.col("p_size") > 40).cast("int")).alias("fault"),
                                    (F.col("p_size") * 2.0).alias("life")), "gear")
    normal = table(spark, d, "events").filter("event_type = 'view'").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    return {
        "engine": scoring.fit_estimate(engine, ["value_mean_5"], "y", 0.0, 40.0), "soh": scoring.fit_estimate(curves, ["voltage_mean"], "voltage_end", 0.0, 150.0),
        "battery": scoring.fit_estimate(curves, ["voltage_mean"], "days", 0.0, None), "valve": scoring.fit_centres(waves, ["emb_mean", "emb_slope"], "valve", 0.7, 0.2),
        "fault": scoring.fit_centres(gear, ["max_deflection"], "fault", 0.9, 0.2), "gear": scoring.fit_estimate(gear, ["mass"], "life", 0.0, 100.0),
        "fuel": {c: (normal["m"] + i, normal["s"]) for i, c in enumerate(schemas.FUEL_CHANNELS)}}


def scored_bundles(spark, d):
    """All results of all bundles: seven outputs of five components."""
    parts, fit = bundles.split(read_back(spark, d).good), fitted(spark, d)
    records = parts["engine"].select("bundle_id", F.inline("records")).select("bundle_id", "cycle", F.col("sensor_1").alias("value"))
    s = causal.trailing_mean(series(records, "bundle_id", "cycle").totals(records=F.count("*")), ["value"], (5,))
    # What windows and groups make is written: results and the search for unanswered requests both read it.
    last = materialise(causal.terminal_rows(s.frame, ["bundle_id"], ["cycle"]).select("bundle_id", "value_mean_5", "records"), "last")
    samples = parts["battery"].select("bundle_id", F.posexplode("samples").alias("arrival", "s")).select("bundle_id", "arrival", "s.*")
    curves = materialise(waveform.curve_features(samples, ["bundle_id"], _CURVE, ["time", "arrival"]).select("bundle_id", "voltage_mean"), "bundle-curves")
    hydraulic = parts["hydraulic"].select("bundle_id", (~F.col("operating_condition_stable")).alias("unstable"), *[F.element_at("features", F.lit(c)).alias(c) for c in ("emb_mean", "emb_slope")])
    gear = parts["landing-gear"].select("bundle_id", "max_deflection", "mass")
    alerts = materialise(scoring.flagged(parts["fuel-system"].select("bundle_id", F.inline("samples")), fit["fuel"], LIMIT, "fuel-system").select("bundle_id", *scoring.RESULT), "alerts")
    unstable = F.col("unstable")
    found = {
        ("engine", "rul"): scoring.estimated(last, fit["engine"], "engine", "rul", (F.col("records") < 10, scoring.SHORT)),
        ("battery", "soh"): scoring.estimated(curves, fit["soh"], "battery", "soh"), ("battery", "rul"): scoring.estimated(curves, fit["battery"], "battery", "rul"),
        ("hydraulic", "valve"): scoring.classified(hydraulic, fit["valve"], "hydraulic", "valve", unstable, (unstable, scoring.UNSTABLE)),
        ("landing-gear", "fault"): scoring.classified(gear, fit["fault"], "landing-gear", "fault"), ("landing-gear", "rul"): scoring.estimated(gear, fit["gear"], "landing-gear", "rul"),
        ("fuel-system", "alerts"): alerts}
    out = None
    for (component, output), rows in found.items():
        rows = rows.select("bundle_id", *scoring.RESULT)
        both = rows.unionByName(scoring.unanswered(parts[component], rows, component, output).select("bundle_id", *scoring.RESULT))
        out = both if out is None else out.unionByName(both)
    return out


def _estimate_sql(p, low, high):
    """Fit, radius and results of one task; {p}_t(x, y): training rows, {p}_r(id, x, short): requests."""
    top = "" if high is None else f", {high}"
    clip = lambda e: f"greatest({e}, {low})" if high is None else f"least(greatest({e}, {low}){top})"
    return f"""{p}_k AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM {p}_t),
  {p}_e AS (SELECT abs(y - {clip('a + b * x')}) AS e FROM {p}_t, {p}_k), {p}_q AS (SELECT max(e) FILTER (n = least(ceil((c + 1) * CAST(0.95 AS DOUBLE)), c)) AS radius FROM (SELECT e, row_number() OVER (ORDER BY e) AS n, count(*) OVER () AS c FROM {p}_e)),
  {p}_s AS (SELECT id, {clip('a + b * x')} AS estimate, radius, x IS NULL OR x < lo OR x > hi AS outside, x < q01 OR x > q99 AS tail, short FROM {p}_r, {p}_k, {p}_q)"""


def _estimate_rows(p, component, output):
    return f"""SELECT id AS bundle_id, '{component}' AS component, '{output}' AS output, {rs('estimate', 3)} AS estimate, {rs('greatest(estimate - radius, 0)', 3)} AS lower, {rs('greatest(estimate + radius, 0)', 3)} AS upper, NULL::INTEGER AS label, NULL::DOUBLE AS confidence,
  CAST(NOT outside AS INTEGER) AS accepted, concat_ws('; ', CASE WHEN outside THEN '{scoring.OUTSIDE}' END, CASE WHEN NOT outside AND tail THEN '{scoring.TAIL}' END, CASE WHEN short THEN '{scoring.SHORT}' END) AS warnings FROM {p}_s"""


def _centre_sql(p, features, accuracy, coverage):
    """{p}_t(id, features, k): training rows, {p}_r(id, features, unstable): requests."""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in features)
    spread = ", ".join(f"sqrt(avg(({c} - m_{c}) ** 2)) AS s_{c}" for c in features)
    half = " + ".join(f"((x.{c} - m_{c}) / s_{c}) ** 2" for c in features)
    ranges = " OR ".join(f"x.{c} < (SELECT min({c}) FROM {p}_t) OR x.{c} > (SELECT max({c}) FROM {p}_t)" for c in features)
    tails = " OR ".join(f"x.{c} < (SELECT quantile_cont({c}, 0.01) FROM {p}_t) OR x.{c} > (SELECT quantile_cont({c}, 0.99) FROM {p}_t)" for c in features)
    shares = lambda src: f"""SELECT x.id, arg_max(c.k, (-({half}) / 2, -c.k)) AS label, round(1 / sum(exp(-({half}) / 2 - top)), 6) AS confidence FROM (SELECT x.*, (SELECT max(-({half}) / 2) FROM {p}_c, {p}_w) AS top FROM {src} x) x, {p}_c c, {p}_w GROUP BY x.id"""
    return f"""{p}_c AS (SELECT k, {means} FROM {p}_t GROUP BY k), {p}_w AS (SELECT {spread} FROM {p}_t JOIN {p}_c USING (k)), {p}_f AS ({shares(f'{p}_t')}),
  {p}_l AS (SELECT confidence, count(*) AS n, count(*) FILTER (label = k) AS ok FROM {p}_f JOIN {p}_t USING (id) GROUP BY 1),
  {p}_a AS (SELECT confidence, sum(n) OVER o AS n, sum(ok) OVER o AS ok, sum(n) OVER () AS total FROM {p}_l WINDOW o AS (ORDER BY confidence DESC)),
  {p}_h AS (SELECT coalesce(min(confidence), 2) AS threshold FROM {p}_a WHERE n / total >= {coverage} AND ok / n >= {accuracy}),
  {p}_s AS (SELECT f.*, confidence < threshold AS unsure, {ranges} AS outside, {tails} AS tail, unstable FROM ({shares(f'{p}_r')}) f JOIN {p}_r x USING (id), {p}_h)"""


def _centre_rows(p, component, output):
    return f"""SELECT id, '{component}', '{output}', NULL, NULL, NULL, CAST(label AS INTEGER), confidence, CAST(NOT (outside OR unsure OR unstable) AS INTEGER), concat_ws('; ', CASE WHEN outside THEN '{scoring.OUTSIDE}' END,
  CASE WHEN NOT outside AND tail THEN '{scoring.TAIL}' END, CASE WHEN unsure THEN '{scoring.UNSURE}' END, CASE WHEN unstable THEN '{scoring.UNSTABLE}' END) FROM {p}_s"""


_T64 = "list_transform(range(1, 65), lambda i: (i - 1) / 63.0 - 0.5)"
_SCORED = f"""WITH {_USERS}, {EV}, {SAMPLES}, {WAVE}, tr AS (SELECT user_id, cycle, max(cycle) OVER (PARTITION BY user_id) AS n, avg(value) OVER t AS x FROM ev WINDOW {tail(5)}),
  en_t AS (SELECT x, least(n - cycle, 40) AS y FROM tr WHERE user_id % {HELD} <> 0), en_r AS (SELECT CAST(user_id AS VARCHAR) AS id, x, n < 10 AS short FROM tr JOIN u USING (user_id) WHERE cycle = n), {_estimate_sql('en', 0, 40)},
  cv AS (SELECT user_id, avg(voltage) AS x, arg_max(voltage, (time, event_id)) AS last, (max(time) - min(time)) / 86400 AS days FROM samples GROUP BY 1 HAVING count(*) >= 2),
  so_t AS (SELECT x, last AS y FROM cv WHERE user_id % {HELD} <> 0), so_r AS (SELECT CAST(user_id AS VARCHAR) AS id, x, false AS short FROM cv JOIN u USING (user_id)), {_estimate_sql('so', 0, 150)},
  ba_t AS (SELECT x, days AS y FROM cv WHERE user_id % {HELD} <> 0), ba_r AS (SELECT * FROM so_r), {_estimate_sql('ba', 0, None)},
  wf AS (SELECT cycle_id, avg(v) AS emb_mean, sum(v * t) / sum(t * t) AS emb_slope FROM (SELECT cycle_id, unnest(samples) AS v, unnest({_T64}) AS t FROM wave) GROUP BY 1),
  va_t AS (SELECT cycle_id AS id, emb_mean, emb_slope, CAST(samples[1] + samples[2] > 0 AS INTEGER) AS k FROM wf JOIN wave USING (cycle_id) WHERE cycle_id % {HELD} <> 0),
  va_r AS (SELECT CAST(user_id AS VARCHAR) AS id, emb_mean, emb_slope, user_id % 4 = 1 AS unstable FROM wf JOIN u ON user_id = cycle_id), {_centre_sql('va', ['emb_mean', 'emb_slope'], 0.7, 0.2)},
  pa AS (SELECT p_partkey - 1 AS id, p_size / 100 + 0.01 AS max_deflection, CAST(p_retailprice AS DOUBLE) AS mass, (p_size > 25)::INT + (p_size > 40)::INT AS k, p_size * 2.0 AS life FROM part),
  fa_t AS (SELECT * FROM pa WHERE id % {HELD} <> 0), fa_r AS (SELECT CAST(user_id AS VARCHAR) AS id, max_deflection, false AS unstable FROM pa JOIN u ON user_id = id), {_centre_sql('fa', ['max_deflection'], 0.9, 0.2)},
  ge_t AS (SELECT mass AS x, life AS y FROM fa_t), ge_r AS (SELECT CAST(user_id AS VARCHAR) AS id, mass AS x, false AS short FROM pa JOIN u ON user_id = id), {_estimate_sql('ge', 0, 100)},
  fu AS (SELECT user_id, count(*) AS n, count(*) FILTER (abs(value - (SELECT avg(value) FROM events WHERE event_type = 'view')) / (SELECT stddev_pop(value) FROM events WHERE event_type = 'view') > {LIMIT}) AS far FROM events JOIN u USING (user_id) GROUP BY 1),
  res AS ({_estimate_rows('en', 'engine', 'rul')} UNION ALL {_estimate_rows('so', 'battery', 'soh')} UNION ALL {_estimate_rows('ba', 'battery', 'rul')} UNION ALL {_centre_rows('va', 'hydraulic', 'valve')} UNION ALL {_centre_rows('fa', 'landing-gear', 'fault')}
    UNION ALL {_estimate_rows('ge', 'landing-gear', 'rul')} UNION ALL SELECT CAST(user_id AS VARCHAR), 'fuel-system', 'alerts', far, NULL, NULL, CAST(far > 0 AS INTEGER), NULL, 0, concat_ws('; ', CASE WHEN n < 5 THEN '{scoring.SHORT}' END, '{scoring.EXPERIMENTAL}') FROM fu
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'battery', unnest(['soh', 'rul']), NULL, NULL, NULL, NULL, NULL, 0, '{scoring.UNANSWERED}' FROM u WHERE user_id NOT IN (SELECT user_id FROM cv))"""


@query("job_06b_bundle_scoring", f"{_SCORED} SELECT * FROM res")
def bundle_scoring(spark, d):
    """All five components of every bundle: estimate with interval or class with confidence, acceptance and warnings."""
    rows = scored_bundles(spark, d)
    return rows.select("bundle_id", "component", "output", *[r(c, 3).alias(c) for c in ("estimate", "lower", "upper")], "label", "confidence", flag("accepted").alias("accepted"), "warnings")


@query("job_07b_bundle_preflight", f"""{_SCORED}, p AS (SELECT component, output, accepted, CASE WHEN component = 'fuel-system' THEN 'not_assessed' WHEN regexp_matches(warnings, '{scoring.UNANSWERED}|{scoring.OUTSIDE}|{scoring.UNSTABLE}|{scoring.SHORT}') THEN 'review_required'
  WHEN contains(warnings, '{scoring.TAIL}') THEN 'tail_range' ELSE 'supported' END AS status FROM res) SELECT component, output, status, count(*) AS requests, CAST(sum(accepted) AS BIGINT) AS accepted FROM p GROUP BY ALL""")
def bundle_preflight(spark, d):
    """Input checks of all components without a verdict on the prediction, and how many results are accepted."""
    rows = scoring.preflight_status(scored_bundles(spark, d))
    return rows.groupBy("component", "output", "status").agg(F.count("*").alias("requests"), F.sum(F.col("accepted").cast("long")).alias("accepted"))
