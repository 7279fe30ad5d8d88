"""Whole jobs: the operators composed as a caller runs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import digest, notes
from ..operators import calibrate, causal, gates, labels, learn, metrics, profile, quality, review, waveform
from ..operators.labels import remaining_life
from ..operators.selection import best, top_rows
from ..operators.series import series
from ..session import materialise, shared_folder, table
from ..sources import artefacts, sinks
from .aggregates import _CURVE
from .checks import RESULTS, triaged
from .inputs import CHANNELS, EV, HIST, SAMPLES, event_rows, event_series, order_histories, sample_rows, tail, waveform_rows
from .models import FOLDS, TR, training_rows
from .registry import flag, query, r, rounded, rs


@query("job_00_fleet_watch", f"""WITH {EV.replace('FROM events', 'FROM events WHERE value >= 0')}, w AS (SELECT user_id, event_id, cycle, value, max(cycle) OVER (PARTITION BY user_id) AS last_cycle, coalesce(value - lag(value) OVER o, 0) AS dv, avg(value) OVER t AS m5, greatest(stddev_pop(value) OVER t, 0) AS s5
  FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY cycle), {tail(5)})
  SELECT user_id, event_id, cycle, {rs('value')} AS value, {rs('dv')} AS value_delta, {rs('m5')} AS value_mean_5, {rs('s5')} AS value_std_5, CASE WHEN m5 <= 30 THEN 'High' WHEN m5 <= 60 THEN 'Medium' ELSE 'Low' END AS risk
  FROM w WHERE cycle = last_cycle ORDER BY m5, user_id LIMIT 20""")
def fleet_watch(spark, d):
    """Valid events -> past-only features -> latest row per user -> risk -> the twenty most urgent."""
    rows = event_rows(spark, d).filter(F.col("value") >= 0)
    s = series(rows, "user_id", ("ts", "event_id")).number("cycle")
    s = causal.trailing_std(causal.trailing_mean(causal.first_difference(s, ["value"]), ["value"], (5,)), ["value"], (5,))
    last = causal.terminal_rows(s.frame, ["user_id"], ["cycle"]).withColumn("risk", review.risk_band(F.col("value_mean_5")))
    urgent = top_rows(last, [F.asc("value_mean_5"), F.asc("user_id")], 20)
    names = ["value", "value_delta", "value_mean_5", "value_std_5"]
    return rounded(urgent.select("user_id", "event_id", "cycle", *names, "risk"), names)


def prepared(spark, d):
    """The processed table of every component."""
    engine = causal.trailing_mean(remaining_life(event_series(spark, d), "cycle"), ["value"], (5, 10)).frame
    battery = labels.discharge_histories(order_histories(spark, d)).frame
    hydraulic = waveform.waveform_table(waveform_rows(spark, d).withColumnRenamed("samples", "emb"), "cycle_id", ["emb"])
    fuel = waveform.curve_features(sample_rows(spark, d), ["user_id"], _CURVE, ["time", "event_id"])
    landing = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.col("p_brand").alias("fault"))
    return {"engine": engine, "battery": battery, "hydraulic": hydraulic, "fuel_system": fuel, "landing_gear": landing}


def prepare(spark, d, out):
    """Write every processed table and return the manifest of what was written."""
    manifest = None
    for name, frame in prepared(spark, d).items():
        sinks.write_table(frame, f"{out}/{name}")
        one = sinks.table_entry(spark, f"{out}/{name}", f"processed {name} table")
        manifest = one if manifest is None else manifest.unionByName(one)
    return manifest


@query("job_02_validation_report", f"""WITH c AS (SELECT count(*) AS rows, {', '.join(f'count(*) FILTER ({c} IS NULL) AS miss_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in CHANNELS)} FROM lineitem), k AS (SELECT coalesce(sum(n - 1), 0) AS dup FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))
  SELECT rows, CAST(dup AS BIGINT) AS duplicate_keys, {', '.join(f"miss_{c}, {rs(f'lo_{c}', 3)} AS lo_{c}, {rs(f'hi_{c}', 3)} AS hi_{c}" for c in CHANNELS)} FROM c, k""")
def validation_report(spark, d):
    lines = table(spark, d, "lineitem")
    repeated = quality.duplicates(lines, ["l_orderkey", "l_linenumber"]).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n")).scalar()
    one = lines.agg(F.count("*").alias("rows"), *[x for c in CHANNELS for x in (
        F.count_if(F.col(c).isNull()).alias(f"miss_{c}"), r(F.min(c), 3).alias(f"lo_{c}"), r(F.max(c), 3).alias(f"hi_{c}"))])
    return one.select("*", repeated.alias("duplicate_keys"))


@query("job_03_exploratory_profile", f"""WITH {TR}, s AS (SELECT {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}, corr({c}, rul) AS r_{c}, (avg({c}) FILTER (rul <= 10) - avg({c}) FILTER (rul > 40)) / stddev_samp({c}) AS d_{c}" for c in ('cycle', 'value', 'value_mean_5'))} FROM tr)
  """ + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rs(f'm_{c}', 4)} AS mean, {rs(f's_{c}', 4)} AS std, {rs(f'r_{c}', 5)} AS correlation, {rs(f'd_{c}', 5)} AS shift FROM s" for c in ("cycle", "value", "value_mean_5")))
def exploratory_profile(spark, d):
    rows, names = training_rows(spark, d), ["cycle", "value", "value_mean_5"]
    shape = profile.column_profile(rows, names).select("feature", "mean", "std")
    linked = profile.correlations(rows, names, "rul").select("feature", "correlation")
    moved = profile.life_stage_shift(rows, "rul", names, 40, 10).select("feature", "shift")
    out = shape.join(linked, "feature").join(moved, "feature")
    return rounded(rounded(out, ["mean", "std"], 4), ["correlation", "shift"], 5)


def baseline_predictions(spark, d):
    """Out-of-fold predictions of three baselines in long form."""
    rows = materialise(training_rows(spark, d), "training")
    dummy = learn.fold_statistic(rows, "fold", FOLDS, "rul").withColumnRenamed("predicted", "median_rul")
    train = rows.filter("fold IS NOT NULL")
    scored = learn.linear_oof(rows.join(F.broadcast(dummy), "fold"), "fold", ["cycle"], "rul", 0.0, 125.0, name="age", train=train)
    both = learn.linear_oof(scored, "fold", ["value_mean_5"], "rul", 0.0, 125.0, name="level", train=train)
    return sinks.long_predictions(both.select("user_id", "event_id", "cycle", "fold", F.col("rul").alias("actual"), "median_rul", "age", "level"),
                                  ["user_id", "event_id", "cycle", "fold"], {"median": "median_rul", "age": "age", "level": "level"})


_BASE = f"""{TR}, k AS (SELECT f.fold, quantile_cont(rul, 0.5) AS med, regr_slope(rul, cycle) AS b1, regr_intercept(rul, cycle) AS a1, regr_slope(rul, value_mean_5) AS b2, regr_intercept(rul, value_mean_5) AS a2
  FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1), lp AS (SELECT user_id, cycle, fold, rul AS actual, unnest(['median', 'age', 'level']) AS model, unnest([med, least(greatest(a1 + b1 * cycle, 0), 125), least(greatest(a2 + b2 * value_mean_5, 0), 125)]) AS predicted FROM tr JOIN k USING (fold))"""


@query("job_04_train_baselines", f"""WITH {_BASE}, u AS (SELECT model, user_id, avg(abs(predicted - actual)) AS mae FROM lp GROUP BY 1, 2) SELECT model, count(*) AS rows, {rs('avg(abs(predicted - actual))', 5)} AS mae, {rs('sqrt(avg((predicted - actual) ** 2))', 5)} AS rmse,
  (SELECT {rs('avg(mae)', 5)} FROM u WHERE u.model = lp.model) AS unit_mean_mae FROM lp GROUP BY model""")
def train_baselines(spark, d):
    long = baseline_predictions(spark, d)
    scores = metrics.regression_scores(F.col("actual"), F.col("predicted"))
    per = long.groupBy("model").agg(F.count("*").alias("rows"), r(scores["mae"], 5).alias("mae"), r(scores["rmse"], 5).alias("rmse"))
    units = metrics.unit_mean_scores(long, "user_id", ["model"]).select("model", r("mae", 5).alias("unit_mean_mae"))
    return per.join(units, "model")


@query("job_05_readiness", f"""WITH {_BASE}, e AS (SELECT model, abs(predicted - actual) AS e, actual, predicted, row_number() OVER (PARTITION BY model ORDER BY abs(predicted - actual)) AS n, count(*) OVER (PARTITION BY model) AS c FROM lp),
  q AS (SELECT model, max(e) FILTER (n = least(ceil((c + 1) * CAST(0.95 AS DOUBLE)), c)) AS radius FROM e GROUP BY 1), s AS (SELECT model, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse, avg(predicted - actual) FILTER (actual <= 30) AS near,
  any_value(radius) AS radius, avg(CAST(actual BETWEEN greatest(predicted - radius, 0) AND predicted + radius AS INTEGER)) AS coverage FROM lp JOIN q USING (model) GROUP BY 1)
  SELECT model, {rs('mae', 4)} AS mae, {rs('rmse', 4)} AS rmse, {rs('rmse + 0.5 * greatest(near, 0)', 4)} AS selection_score, {rs('radius', 4)} AS radius, {rs('coverage', 3)} AS coverage, CAST(row_number() OVER (ORDER BY round(rmse + 0.5 * greatest(near, 0), 6), model) = 1 AS INTEGER) AS selected,
  CASE WHEN mae <= 15 AND rmse <= 20 THEN 'conditional_pass' ELSE 'fail' END AS gate FROM s""")
def readiness(spark, d):
    """Selection, 95 % interval and gate from one set of out-of-fold predictions."""
    long = materialise(baseline_predictions(spark, d), "predictions")
    scores = metrics.safety_scores(long, F.col("actual"), F.col("predicted"), ["model"])
    radius = calibrate.conformal_radius(long, "error", 0.05, ["model"])
    banded = long.join(F.broadcast(radius), "model").withColumns(calibrate.interval(F.col("predicted"), F.col("radius")))
    covered = metrics.interval_scores(banded, ["model"]).select("model", "coverage")
    table_ = materialise(scores.join(radius, "model").join(covered, "model"), "readiness")
    winner = best(table_, [F.round("selection_score", 6), F.col("model")]).select("model").scalar()
    gate = gates.target_gate({"mae_ok": F.col("mae") <= 15, "rmse_ok": F.col("rmse") <= 20})["gate"]
    return table_.select("model", *[r(c, 4).alias(c) for c in ("mae", "rmse", "selection_score", "radius")], r("coverage", 3).alias("coverage"),
                         flag(F.col("model") == winner).alias("selected"), gate.alias("gate"))


@query("job_06_batch_scoring", f"""WITH {TR}, k AS (SELECT regr_slope(least(rul, 40), value_mean_5) AS b, regr_intercept(least(rul, 40), value_mean_5) AS a, min(value_mean_5) AS lo, max(value_mean_5) AS hi, quantile_cont(value_mean_5, 0.01) AS q01, quantile_cont(value_mean_5, 0.99) AS q99 FROM tr WHERE user_id % 2 = 1),
  s AS (SELECT tr.*, least(greatest(a + b * value_mean_5, 0), 40) AS p, lo, hi, q01, q99 FROM tr, k), q AS (SELECT max(e) FILTER (n = least(ceil((c + 1) * CAST(0.95 AS DOUBLE)), c)) AS radius FROM (SELECT abs(least(rul, 40) - p) AS e, row_number() OVER (ORDER BY abs(least(rul, 40) - p)) AS n, count(*) OVER () AS c FROM s WHERE user_id % 2 = 1))
  SELECT user_id, CAST(cycle AS BIGINT) AS latest_cycle, {rs('p', 3)} AS predicted, {rs('greatest(p - radius, 0)', 3)} AS lower, {rs('p + radius', 3)} AS upper, CASE WHEN p <= 30 THEN 'High' WHEN p <= 60 THEN 'Medium' ELSE 'Low' END AS risk,
  concat_ws('; ', CASE WHEN cycle < 10 THEN 'limited history' END, CASE WHEN value_mean_5 < q01 OR value_mean_5 > q99 THEN 'tail range' END) AS warnings, CAST(value_mean_5 BETWEEN lo AND hi AS INTEGER) AS accepted FROM s, q WHERE rul = 0""")
def batch_scoring(spark, d):
    """Each user's history is a request: features, latest row, estimate, interval, support, risk and warnings.

    Fit, radius and bounds come from users with odd numbers; the others' requests may lie outside and are then not accepted.
    """
    rows = materialise(training_rows(spark, d).withColumn("capped", F.least("rul", F.lit(40.0))), "training")
    odd = F.col("user_id") % 2 == 1
    model = learn.fit(rows.filter(odd), ["value_mean_5"], learn.linear("capped"))
    scored = learn.apply_model(model, rows, 0.0, 40.0)
    radius = calibrate.conformal_radius(scored.filter(odd).withColumn("e", F.col("capped") - F.col("predicted")), "e", 0.05).first()["radius"]
    bounds = {b["feature"]: b.asDict() for b in profile.support_bounds(rows.filter(odd), ["value_mean_5"]).collect()}
    last = causal.terminal_rows(scored, ["user_id"], ["cycle"]).withColumns(calibrate.support_flags(bounds)).withColumns(
        calibrate.interval(F.col("predicted"), F.lit(radius)))
    warnings = notes((F.col("cycle") < 10, "limited history"), (F.size("tail_warnings") > 0, "tail range"))
    return last.select("user_id", F.col("cycle").cast("long").alias("latest_cycle"), *[r(c, 3).alias(c) for c in ("predicted", "lower", "upper")],
                       review.risk_band(F.col("predicted")).alias("risk"), F.concat_ws("; ", warnings).alias("warnings"), flag(~F.col("abstain")).alias("accepted"))


@query("job_07_preflight", """WITH b AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) // 60 AS bucket, o_totalprice FROM orders), f AS (SELECT quantile_cont(o_totalprice, 0.01) AS q01, quantile_cont(o_totalprice, 0.99) AS q99 FROM orders),
  w AS (SELECT *, bucket - lag(bucket) OVER o AS step, o_orderkey < lag(o_orderkey) OVER o AS came, row_number() OVER o AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM b WINDOW o AS (PARTITION BY o_custkey ORDER BY bucket, o_orderkey)),
  p AS (SELECT o_custkey, count(*) AS records, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (came) AS oo, count(*) FILTER (n > c - 9 AND step <> 1) AS bt, arg_max(o_totalprice, n) AS latest FROM w GROUP BY 1)
  SELECT o_custkey, records, CASE WHEN records < 10 OR bt > 0 THEN 'review_required' WHEN latest < q01 OR latest > q99 THEN 'tail_range' ELSE 'supported' END AS status,
  concat_ws('; ', CASE WHEN records < 10 THEN 'limited history' END, CASE WHEN gaps > 0 THEN 'cycle gaps' END, CASE WHEN oo > 0 THEN 'reordered by cycle' END, CASE WHEN records < 10 OR bt > 0 THEN 'fewer than 10 consecutive recent cycles' END) AS notes FROM p, f""")
def preflight(spark, d):
    """Request checks and input support without a prediction."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(days / 60).cast("long").alias("bucket"), "o_totalprice")
    checked = quality.order_notes(series(rows, "o_custkey", ("bucket", "o_orderkey")), "o_orderkey", "bucket")
    last = causal.terminal_rows(rows, ["o_custkey"], ["bucket", "o_orderkey"]).select("o_custkey", "o_totalprice")
    bounds = profile.support_bounds(rows, ["o_totalprice"]).first()
    tail_range = (F.col("o_totalprice") < bounds["q01"]) | (F.col("o_totalprice") > bounds["q99"])
    short = (F.col("records") < 10) | (F.col("broken_tail") > 0)
    text = review.history_notes(F.col("records"), F.col("gaps"), F.col("out_of_order"), F.col("broken_tail") == 0)
    return checked.join(last, "o_custkey").select(
        "o_custkey", "records", F.when(short, "review_required").when(tail_range, "tail_range").otherwise("supported").alias("status"),
        F.concat_ws("; ", text).alias("notes"))


@query("job_08_fleet_review", f"""WITH {RESULTS}, h AS (SELECT user_id, component, level, ts, event_id FROM tri) SELECT component, count(*) AS results, {', '.join(f"count(*) FILTER (level = '{v}') AS {v.lower()}" for v in ('Critical', 'Caution', 'Monitor', 'Unavailable'))},
  count(DISTINCT user_id) AS assets, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest FROM h GROUP BY 1""")
def fleet_review(spark, d):
    rows = triaged(spark, d)
    return rows.groupBy("component").agg(
        F.count("*").alias("results"), *[F.count_if(F.col("level") == v).alias(v.lower()) for v in ("Critical", "Caution", "Monitor", "Unavailable")],
        F.count_distinct("user_id").alias("assets"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest"))


@query("job_08b_history_view", f"""WITH {RESULTS} SELECT CAST(user_id AS VARCHAR) AS asset_id, count(*) AS entries, arg_max(event_id, (ts, event_id)) AS newest_event, arg_max(CASE WHEN level = 'Critical' THEN 'inspected' END, (ts, event_id)) FILTER (level = 'Critical') AS latest_outcome FROM tri GROUP BY 1""")
def history_view(spark, d):
    """Log rows (one creation per result, an outcome for critical ones) folded to the current view per asset."""
    rows = triaged(spark, d)
    at = F.struct("ts", "event_id")
    return rows.groupBy(F.col("user_id").cast("string").alias("asset_id")).agg(
        F.count("*").alias("entries"), F.max_by("event_id", at).alias("newest_event"),
        F.max_by(F.lit("inspected"), F.when(F.col("level") == "Critical", at)).alias("latest_outcome"))


@query("job_09_label_audit", f"""WITH {HIST}, u AS (SELECT o_custkey, any_value(rul_label_status) AS status, count(*) AS n, count(*) FILTER (NOT valid_capacity) AS invalid, max(observed_eol_cycle) AS eol FROM hist GROUP BY 1),
  nx AS (SELECT o_custkey, count(*) FILTER (capacity > eol_capacity) AS above FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY discharge_cycle) AS k FROM hist WHERE valid_capacity AND discharge_cycle > observed_eol_cycle) WHERE k <= 3 GROUP BY 1)
  SELECT status, count(*) AS units, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(invalid) AS BIGINT) AS invalid_rows, count(*) FILTER (above > 0) AS unstable_crossings FROM u LEFT JOIN nx USING (o_custkey) GROUP BY 1""")
def label_audit(spark, d):
    h = labels.discharge_histories(order_histories(spark, d)).frame
    units = h.groupBy("o_custkey").agg(F.first("rul_label_status").alias("status"), F.count("*").alias("n"), F.count_if(~F.col("valid_capacity")).alias("invalid"))
    stable = quality.crossing_stability(h, "o_custkey", "capacity", "eol_capacity").select("o_custkey", "needs_review")
    return units.join(stable, "o_custkey", "left").groupBy("status").agg(
        F.count("*").alias("units"), F.sum("n").alias("rows"), F.sum("invalid").alias("invalid_rows"), F.count_if("needs_review").alias("unstable_crossings"))


@query("job_11_experiment_replay", f"""WITH {TR}, g AS (SELECT unnest(['cap40', 'cap60', 'plain']) AS candidate, unnest([40.0, 60.0, 1e9]) AS cap), k AS (SELECT candidate, CAST(cap AS DOUBLE) AS cap, f.fold, regr_slope(least(rul, cap), cycle) AS b, regr_intercept(least(rul, cap), cycle) AS a FROM g, (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY 1, 2, 3),
  s AS (SELECT candidate, user_id, least(greatest(a + b * cycle, 0), cap) - rul AS e FROM tr JOIN k USING (fold)), u AS (SELECT candidate, user_id, avg(abs(e)) AS mae FROM s GROUP BY 1, 2), m AS (SELECT candidate, avg(mae) AS mae FROM u GROUP BY 1)
  SELECT candidate, {rs('mae', 5)} AS unit_mean_mae, CAST(row_number() OVER (ORDER BY round(mae, 9), candidate) = 1 AS INTEGER) AS selected, 1 AS replay_matches FROM m""")
def experiment_replay(spark, d):
    """Candidates scored inside the folds; winner, configuration and predictions are kept as an artefact.

    The replay knows nothing but that artefact and the table: it reads the configuration, derives the rows anew,
    fits, and compares row by row with the predictions kept and with the metric kept.
    """
    rows = materialise(training_rows(spark, d), "training")
    caps = {"cap40": 40.0, "cap60": 60.0, "plain": None}

    def scored(cap, rows=rows):
        target = rows.withColumn("y", F.col("rul") if cap is None else F.least("rul", F.lit(cap)))
        return learn.linear_oof(target, "fold", ["cycle"], "y", 0.0, cap)

    table_ = None
    for name, cap in caps.items():
        one = metrics.unit_mean_scores(scored(cap).withColumn("actual", F.col("rul")), "user_id").select(F.lit(name).alias("candidate"), "mae")
        table_ = one if table_ is None else table_.unionByName(one)
    first = {row["candidate"]: row["mae"] for row in table_.collect()}  # one number per candidate
    winner = min(sorted(first), key=lambda c: round(first[c], 9))
    place = shared_folder(spark, "experiment")
    artefacts.save(spark, place, winner, {
        "config": spark.createDataFrame([(winner, caps[winner], "cycle", first[winner])], "candidate string, cap double, feature string, mae double"),
        "predictions": scored(caps[winner]).select("event_id", "predicted")})
    differing = replay_differences(spark, d, place, winner)
    return table_.select("candidate", r("mae", 5).alias("unit_mean_mae"), flag(F.col("candidate") == winner).alias("selected"),
                         flag((F.col("candidate") != winner) | F.lit(differing == 0)).alias("replay_matches"))


def replay_differences(spark, d, place: str, version: str) -> int:
    """Rows on which an experiment's kept predictions differ from those of fitting its kept configuration again; one more for its metric."""
    kept = artefacts.load(spark, place, version)
    config = kept.tables["config"].first()  # one row
    rows = training_rows(spark, d)
    target = rows.withColumn("y", F.col("rul") if config["cap"] is None else F.least("rul", F.lit(config["cap"])))
    again = materialise(learn.linear_oof(target, "fold", [config["feature"]], "y", 0.0, config["cap"]), "replay")
    both = again.select("event_id", "predicted").join(kept.tables["predictions"].withColumnRenamed("predicted", "kept"), "event_id", "full_outer")
    differing = both.filter(~F.coalesce(F.abs(F.col("predicted") - F.col("kept")) <= 1e-9, F.lit(False))).count()
    mae = metrics.unit_mean_scores(again.withColumn("actual", F.col("rul")), "user_id").first()["mae"]
    return differing + int(abs(mae - config["mae"]) > 1e-9)


@query("job_12_registry_view", """SELECT event_type AS task, '{"task":"' || event_type || '","rows":' || CAST(count(*) AS VARCHAR) || ',"available":' || CASE WHEN count(*) >= 150 THEN 'true' ELSE 'false' END || ',"experimental":' || CASE event_type WHEN 'error' THEN 'true' ELSE 'false' END || '}' AS document FROM events GROUP BY event_type""")
def registry_view(spark, d):
    per = event_rows(spark, d).groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("rows"))
    document = F.struct("task", "rows", (F.col("rows") >= 150).alias("available"), (F.col("task") == "error").alias("experimental"))
    return per.select("task", F.to_json(document).alias("document"))


@query("snk_03_prediction_tables", f"""WITH {_BASE} SELECT user_id, CAST(cycle AS BIGINT) AS cycle, {rs("max(predicted) FILTER (model = 'median')", 4)} AS median, {rs("max(predicted) FILTER (model = 'age')", 4)} AS age, {rs("max(predicted) FILTER (model = 'level')", 4)} AS level FROM lp GROUP BY 1, 2""")
def prediction_tables(spark, d):
    wide = sinks.wide_predictions(baseline_predictions(spark, d), ["user_id", "cycle"], ["median", "age", "level"])
    return rounded(wide, ["median", "age", "level"], 4).withColumn("cycle", F.col("cycle").cast("long"))


@query("snk_07_section_reports", f"""WITH {RESULTS}, j AS (SELECT *, sha256('{{"value":' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',"k":' || CAST(k AS VARCHAR) || '}}') AS dg FROM tri)
  SELECT event_id, '{{"component":"' || component || '","level":"' || level || '","reason":"' || reason || '","input_digest":"' || dg || '"}}' AS document FROM j""")
def section_reports(spark, d):
    raw = F.to_json(F.struct(F.floor("value").alias("value"), "k"))
    return sinks.section_report(triaged(spark, d), ["event_id"], ["component", "level", "reason", "value"], raw, raw=["value"])


@query("snk_02_document_manifest", """SELECT lang, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(dg, 1, 13) AS BIGINT)) AS VARCHAR) AS fingerprint FROM (SELECT lang, strlen(text) AS n, sha256(text) AS dg FROM documents) GROUP BY 1""")
def document_manifest(spark, d):
    """Files, bytes and one fingerprint per language: a sum of content digests, so it merges in any order."""
    docs = table(spark, d, "documents").select("lang", F.octet_length("text").alias("n"), digest(F.col("text")).alias("dg"))
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"), sinks.merged_digest(F.col("dg")).alias("fingerprint"))


@query("src_10_nested_requests", f"""WITH {SAMPLES}, x AS (SELECT user_id, event_id, time, voltage, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) - 1 AS n FROM samples)
  SELECT user_id, n // 1000 AS part, event_id, CAST(n % 1000 AS INTEGER) AS arrival, {rs('voltage')} AS voltage FROM x""")
def nested_requests(spark, d):
    """Request documents of at most 1000 records, parsed back and exploded with their arrival order."""
    from ..sources.readers import request_records

    numbered = series(sample_rows(spark, d), "user_id", ("time", "event_id")).number("n").frame
    part = F.floor((F.col("n") - 1) / 1000).alias("part")
    documents = numbered.groupBy("user_id", part).agg(F.to_json(F.array_sort(F.collect_list(F.struct("n", "event_id", "voltage")))).alias("body"))
    parsed = documents.select("user_id", "part", F.from_json("body", "array<struct<event_id:long,voltage:double>>").alias("samples"))
    return request_records(parsed, "samples").select("user_id", "part", "event_id", "arrival", r("voltage").alias("voltage"))


@query("src_14_example_selection", f"""WITH {HIST}, e AS (SELECT *, row_number() OVER (PARTITION BY rul_label_status ORDER BY o_orderdate, o_orderkey) AS f, row_number() OVER (PARTITION BY rul_label_status ORDER BY o_orderdate DESC, o_orderkey DESC) AS l FROM hist WHERE valid_capacity)
  SELECT rul_label_status, CAST(max(o_orderkey) FILTER (f = 1) AS BIGINT) AS first_example, CAST(max(o_orderkey) FILTER (l = 1) AS BIGINT) AS last_example FROM e GROUP BY 1""")
def example_selection(spark, d):
    """First and last eligible record of each status."""
    at = F.struct("o_orderdate", "o_orderkey")
    h = labels.discharge_histories(order_histories(spark, d)).frame.filter("valid_capacity")
    return h.groupBy("rul_label_status").agg(F.min_by("o_orderkey", at).alias("first_example"), F.max_by("o_orderkey", at).alias("last_example"))
