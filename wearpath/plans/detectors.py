"""Detector, calibration, interval and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, causal, detect, gates, metrics, splits
from ..operators.joins import with_candidates
from ..operators.order_stats import higher, quantiles
from ..operators.profile import support_bounds as fit_bounds
from ..operators.selection import best
from ..operators.series import series
from ..session import materialise, table
from .inputs import CHANNELS, EV, FAULTS, SCENARIOS, SCORED, scenario_rows, scored_rows, tail
from .registry import flag, query, r, rounded, rs

AB = ["a", "b"]


@query("mdl_08_prediction_interval", f"""WITH {SCORED}, e AS (SELECT fold, abs(predicted - actual) AS e FROM scored), k AS (SELECT fold, e, row_number() OVER (PARTITION BY fold ORDER BY e) AS n, count(*) OVER (PARTITION BY fold) AS c FROM e),
  q AS (SELECT fold, max(e) FILTER (n = least(ceil((c + 1) * CAST(0.9 AS DOUBLE)), c)) AS radius FROM k GROUP BY 1)
  SELECT unit, cycle, {rs('greatest(predicted - radius, 0)')} AS lower, {rs('predicted + radius')} AS upper, {rs('least(greatest(predicted + radius, 0), 100)')} AS capped_upper FROM scored JOIN q USING (fold)""")
def prediction_interval(spark, d):
    rows = scored_rows(spark, d).drop("lower", "upper")
    radius = calibrate.conformal_radius(rows.withColumn("e", F.col("predicted") - F.col("actual")), "e", 0.10, ["fold"])
    joined = rows.join(radius, "fold")
    open_side = calibrate.interval(F.col("predicted"), F.col("radius"))
    closed = calibrate.interval(F.col("predicted"), F.col("radius"), 0.0, 100.0)
    return joined.select("unit", "cycle", r(open_side["lower"]).alias("lower"), r(open_side["upper"]).alias("upper"), r(closed["upper"]).alias("capped_upper"))


_FITROWS = "l_returnflag <> 'R'"


@query("mdl_09_input_support", f"""WITH b AS (SELECT {', '.join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, quantile_cont({c}, 0.01) AS {c}_q01, quantile_cont({c}, 0.99) AS {c}_q99" for c in CHANNELS)} FROM lineitem WHERE {_FITROWS} AND l_quantity <= 45),
  f AS (SELECT l_returnflag, {' + '.join(f'CAST({c} < {c}_lo OR {c} > {c}_hi AS INTEGER)' for c in CHANNELS)} AS hard, {' + '.join(f'CAST({c} < {c}_q01 OR {c} > {c}_q99 AS INTEGER)' for c in CHANNELS)} AS tails FROM lineitem, b)
  SELECT l_returnflag, count(*) AS rows, CAST(sum(hard) AS BIGINT) AS hard_violations, CAST(sum(tails) AS BIGINT) AS tail_warnings, count(*) FILTER (hard > 0) AS abstained FROM f GROUP BY 1""")
def input_support(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", *CHANNELS)
    fit = fit_bounds(lines.filter((F.col("l_returnflag") != "R") & (F.col("l_quantity") <= 45)), CHANNELS)
    bounds = {row["feature"]: row.asDict() for row in fit.collect()}  # one row per feature
    judged = lines.withColumns(calibrate.support_flags(bounds))
    return judged.groupBy("l_returnflag").agg(
        F.count("*").alias("rows"), F.sum(F.size("hard_violations")).alias("hard_violations"),
        F.sum(F.size("tail_warnings")).alias("tail_warnings"), F.count_if("abstain").alias("abstained"))


def confidence_rows(spark, d):
    """Raw confidence in steps of ten event values; a prediction is right within 25 of the life left."""
    raw = F.least(F.floor(F.col("predicted") / 10), F.lit(12)) / 12
    return scored_rows(spark, d).select("unit", "cycle", "fold", "predicted", (1 - raw).alias("raw"),
                                        flag(F.abs(F.col("predicted") - F.col("actual")) <= 25).alias("correct"))


_ISO = f"""{SCORED}, conf AS (SELECT unit, cycle, predicted, 1 - least(floor(predicted / 10), 12) / 12 AS raw, CAST(abs(predicted - actual) <= 25 AS INTEGER) AS correct FROM scored),
  lv AS (SELECT row_number() OVER (ORDER BY raw) AS i, raw, sum(correct) AS s, count(*) AS n FROM conf GROUP BY raw), pre AS (SELECT i, raw, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn, s, n FROM lv),
  seg AS (SELECT a.i AS j, b.i AS k, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cn - a.cn + a.n) AS m FROM pre a JOIN pre b ON a.i <= b.i),
  low AS (SELECT p.i, s.j, min(s.m) AS m FROM pre p JOIN seg s ON s.j <= p.i AND s.k >= p.i GROUP BY 1, 2), iso AS (SELECT p.raw, max(l.m) AS confidence FROM pre p JOIN low l USING (i) GROUP BY 1),
  cal AS (SELECT unit, cycle, predicted, correct, confidence FROM conf JOIN iso USING (raw)),
  thr AS (SELECT min(confidence) AS t FROM (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS na, sum(c) OVER (ORDER BY confidence DESC) AS ca, sum(n) OVER () AS tot FROM (SELECT round(confidence, 9) AS confidence, count(*) AS n, sum(correct) AS c FROM cal GROUP BY 1))
  WHERE na / tot >= 0.2 AND ca / na >= 0.5)"""


def calibrated(spark, d):
    rows = confidence_rows(spark, d)
    scored = calibrate.apply_isotonic(calibrate.fit_isotonic(rows, "raw", "correct"), rows, "raw")
    return scored.withColumn("confidence", F.round("confidence", 9))


@query("mdl_10_confidence_calibration", f"""WITH {_ISO} SELECT {rs('min(raw)')} AS raw, {rs('confidence')} AS confidence, any_value((SELECT {rs('coalesce(t, 1)')} FROM thr)) AS threshold FROM iso GROUP BY confidence""")
def confidence_calibration(spark, d):
    rows = calibrated(spark, d)
    threshold = calibrate.acceptance_threshold(rows, "confidence", "correct", accuracy=0.5)
    return rows.groupBy(r("confidence").alias("confidence")).agg(r(F.min("raw")).alias("raw"), r(F.lit(threshold)).alias("threshold")).distinct()


@query("mdl_11_acceptance_flag", f"""WITH {_ISO} SELECT unit, cycle, {rs('confidence')} AS confidence, CAST(round(confidence, 9) >= coalesce((SELECT t FROM thr), 2) AND predicted <= 250 AS INTEGER) AS accepted FROM cal""")
def acceptance_flag(spark, d):
    rows = calibrated(spark, d)
    threshold = calibrate.acceptance_threshold(rows, "confidence", "correct", accuracy=0.5)
    flagged = calibrate.accepted(F.col("confidence"), threshold, F.col("predicted") <= 250)
    return rows.select("unit", "cycle", r("confidence").alias("confidence"), flag(flagged).alias("accepted"))


# -- envelopes -------------------------------------------------------------------------
_ENV = f"""{SCENARIOS}, nrm AS (SELECT * FROM scen WHERE scenario = 'view'), md AS (SELECT quantile_cont(a, 0.5) AS am, quantile_cont(b, 0.5) AS bm, stddev_pop(a) AS asd, stddev_pop(b) AS bsd FROM nrm),
  sc AS (SELECT any_value(am) AS am, any_value(bm) AS bm, quantile_cont(abs(a - am), 0.5) * 1.4826 AS ad, quantile_cont(abs(b - bm), 0.5) * 1.4826 AS bd, any_value(asd) AS asd, any_value(bsd) AS bsd FROM nrm, md),
  ft AS (SELECT am, bm, greatest(CASE WHEN ad > 1e-9 THEN ad ELSE asd END, 1e-6) AS asc_, greatest(CASE WHEN bd > 1e-9 THEN bd ELSE bsd END, 1e-6) AS bsc FROM sc)"""


@query("mdl_12_envelope_max", f"""WITH {_ENV} SELECT scenario, position, {rs('greatest(abs((a - am) / asc_), abs((b - bm) / bsc))')} AS score FROM scen, ft""")
def envelope_max(spark, d):
    rows = scenario_rows(spark, d).frame
    fits = detect.fit_envelope(rows.filter("is_abnormal = 0"), AB, abnormal="is_abnormal")
    return detect.attach(rows, fits, []).select("scenario", "position", r(detect.envelope_score(AB)).alias("score"))


@query("mdl_12b_envelope_mahalanobis", f"""WITH {_ENV}, z AS (SELECT scenario, position, is_abnormal, (a - am) / asc_ AS za, (b - bm) / bsc AS zb FROM scen, ft), c AS (SELECT za - avg(za) OVER () AS x, zb - avg(zb) OVER () AS y FROM z WHERE is_abnormal = 0),
  m AS (SELECT count(*) AS n, avg(x * x) AS sxx, avg(x * y) AS sxy, avg(y * y) AS syy, sum(x*x*x*x) + 2 * sum(x*x*y*y) + sum(y*y*y*y) AS quart FROM c), k AS (SELECT *, (sxx + syy) / 2 AS mu, sxx*sxx + 2*sxy*sxy + syy*syy AS fro FROM m),
  w AS (SELECT *, (fro - 2 * mu * (sxx + syy) + 2 * mu * mu) / 2 AS dist, (quart / n - fro) / (2 * n) AS beta FROM k), q AS (SELECT *, least(beta, dist) / dist AS s FROM w),
  v AS (SELECT (1 - s) * sxx + s * mu AS vaa, (1 - s) * sxy AS vab, (1 - s) * syy + s * mu AS vbb FROM q)
  SELECT scenario, position, {rs('sqrt(greatest((za * za * vbb - 2 * za * zb * vab + zb * zb * vaa) / (vaa * vbb - vab * vab), 0))', 5)} AS score FROM z, v""")
def envelope_mahalanobis(spark, d):
    rows = scenario_rows(spark, d).frame
    normal = rows.filter("is_abnormal = 0")
    fits = detect.with_precision(normal, detect.fit_envelope(normal, AB), AB)
    return detect.attach(rows, fits, []).select("scenario", "position", r(detect.envelope_score(AB, "mahalanobis"), 5).alias("score"))


@query("mdl_12c_envelope_smoothed", f"""WITH {_ENV.replace('nrm AS (SELECT * FROM scen WHERE', "raw AS (SELECT * FROM scen), smo AS (SELECT scenario, position, is_abnormal, quantile_cont(a, 0.5) OVER w AS a, avg(b) OVER w AS b FROM raw WINDOW w AS (PARTITION BY scenario ORDER BY position ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), nrm AS (SELECT * FROM smo WHERE")}
  SELECT scenario, position, {rs('greatest(abs((a - am) / asc_), abs((b - bm) / bsc))')} AS score FROM smo, ft""")
def envelope_smoothed(spark, d):
    """Median-smoothed first channel, mean-smoothed second."""
    s = detect.smooth(detect.smooth(scenario_rows(spark, d), ["a"], 3), ["b"], 3, "mean")
    rows = s.frame
    fits = detect.fit_envelope(rows.filter("is_abnormal = 0"), AB)
    return detect.attach(rows, fits, []).select("scenario", "position", r(detect.envelope_score(AB)).alias("score"))


def knots(spark, d):
    """Normal readings of at least 3 in the first channel; positions without one are interpolated."""
    return scenario_rows(spark, d).frame.filter("is_abnormal = 0 AND a >= 3")


_TPL = f"""{SCENARIOS}, tpl AS (SELECT position, a, b FROM scen WHERE scenario = 'view' AND a >= 3), p0 AS (SELECT s.*, t.position AS px, t.a AS pa, t.b AS pb FROM scen s ASOF LEFT JOIN tpl t ON s.position >= t.position),
  p1 AS (SELECT p0.*, t.position AS nx, t.a AS na, t.b AS nb FROM p0 ASOF LEFT JOIN tpl t ON p0.position < t.position),
  met AS (SELECT scenario, position, is_abnormal, a, b, {', '.join(f"CASE WHEN px IS NULL THEN n{c} WHEN nx IS NULL OR px = position THEN p{c} ELSE p{c} + (position - px) * (n{c} - p{c}) / (nx - px) END AS e{c}" for c in 'ab')} FROM p1)"""


@query("mdl_13_phase_residual", f"""WITH {_TPL}, s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM tpl), x AS (SELECT scenario, position, abs(a - ea) / sa AS ra, abs(b - eb) / sb AS rb FROM met, s)
  SELECT scenario, position, {rs('(ra + rb) / 2')} AS top2_mean, {rs('greatest(ra, rb)')} AS largest, {rs('least(ra, rb) + 0.75 * abs(ra - rb)')} AS p75 FROM x""")
def phase_residual(spark, d):
    from ..operators.profile import template_scale
    from ..operators.selection import row_aggregate

    template = knots(spark, d)
    scale = template_scale(template, AB).first()
    asked = scenario_rows(spark, d).frame.select("scenario", "position", "a", "b")
    away = F.array(*[F.abs(F.col(c) - F.col(f"{c}_expected")) / scale[c] for c in AB])
    met = detect.phase_residual(asked, template, [], "position", AB, [scale[c] for c in AB])
    return met.select("scenario", "position", r("score").alias("top2_mean"), r(row_aggregate(away, "max")).alias("largest"),
                      r(row_aggregate(away, "p75")).alias("p75"))


@query("mdl_14_position_profile", f"""WITH {_TPL}, dif AS (SELECT position, a - lag(a) OVER (ORDER BY position) AS x, position - lag(position) OVER (ORDER BY position) AS st FROM tpl), d1 AS (SELECT x, quantile_cont(x, 0.5) OVER () AS m FROM dif WHERE st = 1),
  n AS (SELECT greatest(quantile_cont(abs(x - m), 0.5) * 1.4826 / sqrt(2.0), 1e-3) AS noise FROM d1) SELECT scenario, position, {rs('abs(a - ea) / noise')} AS score FROM met, n""")
def position_profile(spark, d):
    from ..operators.profile import adjacent_noise

    template = knots(spark, d)
    steps = series(template, (), "position").trailing(2, lambda f: {
        "dif": F.when(F.col("position") - F.lag("position").over(f.ordered) == 1, F.col("a") - F.lag("a").over(f.ordered))})
    noise = adjacent_noise(steps.df.filter(F.col("dif").isNotNull()), [], "dif").first()["noise"]
    asked = scenario_rows(spark, d).frame.select("scenario", "position", "a", "b")
    met = detect.phase_residual(asked, template, [], "position", ["a"], [noise], "max")
    return met.select("scenario", "position", r("score").alias("score"))


# Normal positions fall into four contiguous blocks; block 0 calibrates, the rest fits.
_BLK = f"""{SCENARIOS}, blk AS (SELECT *, CASE WHEN is_abnormal = 0 THEN ntile(4) OVER (PARTITION BY scenario ORDER BY position) - 1 END AS block FROM scen)"""


def blocked(spark, d, blocks=4):
    s = causal.contiguous_blocks(scenario_rows(spark, d), blocks)
    return s.select(block=F.when(F.col("is_abnormal") == 0, F.col("block")))


_CAL = f"""{_BLK}, nrm AS (SELECT * FROM blk WHERE block > 0), md AS (SELECT quantile_cont(a, 0.5) AS am, quantile_cont(b, 0.5) AS bm FROM nrm),
  ft AS (SELECT any_value(am) AS am, any_value(bm) AS bm, quantile_cont(abs(a - am), 0.5) * 1.4826 AS asc_, quantile_cont(abs(b - bm), 0.5) * 1.4826 AS bsc FROM nrm, md),
  sco AS (SELECT scenario, position, is_abnormal, block, greatest(abs((a - am) / asc_), abs((b - bm) / bsc)) AS score FROM blk, ft),
  th AS (SELECT max(score) FILTER (n = ceil(CAST(0.9 AS DOUBLE) * (c - 1)) + 1) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) AS n, count(*) OVER () AS c FROM sco WHERE block = 0)),
  al AS (SELECT *, score - threshold AS margin, CAST(sum(CAST(score > threshold AS INTEGER)) OVER (PARTITION BY scenario ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 2 AS INTEGER) AS alert FROM sco, th)"""


def calibrated_alerts(spark, d, channels=("a", "b"), q=0.9, window=5, required=2):
    rows = materialise(blocked(spark, d).frame, "blocks")
    fits = detect.fit_envelope(rows.filter("block > 0"), list(channels))
    scored = detect.attach(rows, fits, []).withColumn("score", detect.envelope_score(list(channels)))
    limit = detect.thresholds(scored.filter("block = 0"), "score", q).first()["threshold"]
    voted = scored.withColumn("margin", F.col("score") - limit).withColumn("vote", flag(F.col("margin") > 0))
    return detect.voting_alerts(voted, ["scenario"], "position", "vote", window, required)


@query("mdl_15_threshold_and_alerts", f"""WITH {_CAL} SELECT scenario, position, {rs('margin')} AS margin, alert FROM al""")
def threshold_and_alerts(spark, d):
    return calibrated_alerts(spark, d).select("scenario", "position", r("margin").alias("margin"), "alert")


@query("mdl_16_block_ensemble", f"""WITH {SCENARIOS}, blk AS (SELECT *, CASE WHEN is_abnormal = 0 THEN ntile(6) OVER (PARTITION BY scenario ORDER BY position) - 1 END AS block FROM scen), mem AS (SELECT unnest(range(0, 6)) AS k),
  tr AS (SELECT k, a, b FROM blk, mem WHERE is_abnormal = 0 AND block <> k AND block <> (k + 5) % 6), md AS (SELECT k, quantile_cont(a, 0.5) AS am, quantile_cont(b, 0.5) AS bm FROM tr GROUP BY 1),
  ft AS (SELECT k, any_value(am) AS am, any_value(bm) AS bm, quantile_cont(abs(a - am), 0.5) * 1.4826 AS asc_, quantile_cont(abs(b - bm), 0.5) * 1.4826 AS bsc FROM tr JOIN md USING (k) GROUP BY 1),
  sco AS (SELECT k, scenario, position, block, greatest(abs((a - am) / asc_), abs((b - bm) / bsc)) AS score FROM blk, ft),
  th AS (SELECT k, max(score) FILTER (n = ceil(CAST(0.95 AS DOUBLE) * (c - 1)) + 1) AS threshold, greatest(stddev_pop(score), 1e-12) AS spread FROM
    (SELECT k, score, row_number() OVER (PARTITION BY k ORDER BY score) AS n, count(*) OVER (PARTITION BY k) AS c FROM sco WHERE block = (k + 5) % 6) GROUP BY 1)
  SELECT scenario, position, count(*) FILTER (score > threshold) AS votes, {rs('quantile_cont((score - threshold) / spread, 0.5)')} AS median_margin, CAST(count(*) FILTER (score > threshold) >= 4 AS INTEGER) AS predicted
  FROM sco JOIN th USING (k) GROUP BY 1, 2""")
def block_ensemble(spark, d):
    """Six members; each leaves out one block, calibrates on the block before it and trains on the rest."""
    rows = materialise(blocked(spark, d, 6).frame, "blocks")
    roles = splits.rotating_roles(rows.filter("is_abnormal = 0"), "block", 6)
    fits = detect.fit_envelope(roles.filter("role = 'train'"), AB, ["fold"])
    every = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(5))))
    scored = detect.attach(every, F.broadcast(fits), ["fold"]).withColumn("score", detect.envelope_score(AB))
    held = scored.filter(F.col("block") == F.pmod(F.col("fold") - 1, F.lit(6)))
    spread = held.groupBy("fold").agg(F.greatest(F.stddev_pop("score"), F.lit(1e-12)).alias("spread"))
    limits = detect.thresholds(held, "score", 0.95, ["fold"]).join(spread, "fold")
    members = scored.join(F.broadcast(limits), "fold").withColumn("margin", (F.col("score") - F.col("threshold")) / F.col("spread"))
    return rounded(detect.ensemble_votes(members, ["scenario", "position"], 6), ["median_margin"])


@query("mdl_17_alert_fusion", f"""WITH {_CAL}, fu AS (SELECT is_abnormal AS actual, alert AS base, CAST(greatest(alert, CAST(score > 4 AS INTEGER)) AS INTEGER) AS fused FROM al), m AS (SELECT avg(base) FILTER (actual = 0) AS f0, avg(base) FILTER (actual = 1) AS d0, avg(fused) FILTER (actual = 0) AS f1, avg(fused) FILTER (actual = 1) AS d1 FROM fu)
  SELECT {rs('f0')} AS base_false_alarm, {rs('d0')} AS base_detection, {rs('f1')} AS fused_false_alarm, {rs('d1')} AS fused_detection, CAST(f1 <= f0 AND d1 >= d0 AND (1 - f1 + d1) > (1 - f0 + d0) AS INTEGER) AS fusion_wins FROM m""")
def alert_fusion(spark, d):
    rows = calibrated_alerts(spark, d).select(F.col("is_abnormal").alias("actual"), F.col("alert").alias("base"),
                                              F.greatest("alert", flag(F.col("score") > 4)).alias("fused"))
    rates = {n: F.avg(F.when(F.col("actual") == side, F.col(lane))) for n, lane, side in (
        ("base_false_alarm", "base", 0), ("base_detection", "base", 1), ("fused_false_alarm", "fused", 0), ("fused_detection", "fused", 1))}
    one = rows.agg(*[c.alias(n) for n, c in rates.items()])
    gain = (1 - F.col("fused_false_alarm") + F.col("fused_detection")) > (1 - F.col("base_false_alarm") + F.col("base_detection"))
    wins = (F.col("fused_false_alarm") <= F.col("base_false_alarm")) & (F.col("fused_detection") >= F.col("base_detection")) & gain
    return rounded(one.withColumn("fusion_wins", flag(wins)), list(rates))


@query("mdl_22_detector_selection", f"""WITH {SCENARIOS}, g AS (SELECT unnest([20.0, 40.0, 60.0, 90.0, 120.0]) AS threshold), m AS (SELECT threshold, avg(CAST(a > threshold AS INTEGER)) FILTER (is_abnormal = 0) AS fa, avg(CAST(a > threshold AS INTEGER)) FILTER (is_abnormal = 1) AS dr FROM scen, g GROUP BY 1)
  SELECT CAST(threshold AS DOUBLE) AS threshold, {rs('(1 - fa + dr) / 2 - 2 * greatest(fa - 0.10, 0)')} AS strict_score, {rs('(1 - fa + dr) / 2 - 0.75 * greatest(fa - 0.10, 0)')} AS mild_score FROM m""")
def detector_selection(spark, d):
    grid = [{"threshold": t} for t in (20.0, 40.0, 60.0, 90.0, 120.0)]
    rows = with_candidates(scenario_rows(spark, d).df, grid).select(
        "candidate.threshold", F.col("is_abnormal").alias("actual"), flag(F.col("a") > F.col("candidate.threshold")).alias("predicted"))
    scores = metrics.detection_scores(rows, "actual", "predicted", ["threshold"])
    return scores.select("threshold", r(detect.selection_score(2, .10)).alias("strict_score"), r(detect.selection_score(.75, .10)).alias("mild_score"))


# -- gates -----------------------------------------------------------------------------
def fold_evidence(spark, d):
    """Per fold: the value itself as candidate against the trailing mean as baseline."""
    from .inputs import event_series
    from ..operators.labels import remaining_life

    s = causal.trailing_mean(remaining_life(event_series(spark, d), "cycle", "actual"), ["value"], (5,))
    rows = s.frame.select(F.pmod("user_id", F.lit(5)).cast("int").alias("fold"), F.col("actual").cast("double").alias("actual"),
                          F.explode(F.array(F.struct(F.lit("new").alias("version"), F.col("value_mean_5").alias("predicted")),
                                            F.struct(F.lit("old").alias("version"), F.col("value").alias("predicted")))).alias("v"))
    return rows.select("fold", "actual", "v.*")


_EVID = f"""{EV}, bas AS (SELECT user_id % 5 AS fold, CAST(max(cycle) OVER (PARTITION BY user_id) - cycle AS DOUBLE) AS actual, value, avg(value) OVER t AS mean5 FROM ev WINDOW {tail(5)}),
  mt AS (SELECT fold, avg(abs(mean5 - actual)) AS nm, avg(abs(value - actual)) AS om, sqrt(avg((mean5 - actual) ** 2)) AS nr, sqrt(avg((value - actual) ** 2)) AS orr,
    avg(CAST(abs(mean5 - actual) <= 20 AS INTEGER)) AS nc, avg(CAST(abs(value - actual) <= 20 AS INTEGER)) AS oc FROM bas GROUP BY 1)"""


@query("mdl_23_nonregression_gate", f"""WITH {_EVID} SELECT CAST(fold AS INTEGER) AS fold, concat_ws('; ', CASE WHEN nm > om + 1e-8 THEN 'mae is worse' END, CASE WHEN nr > orr + 1e-8 THEN 'rmse is worse' END,
  CASE WHEN nc < oc - 1e-8 THEN 'coverage is lower' END, CASE WHEN nm > 0.99 * om THEN 'audit gain below 1 %' END, CASE WHEN fold = 4 THEN 'candidate is the baseline' END, CASE WHEN fold = 3 THEN 'not eligible inside the fitting groups' END) AS reasons,
  CAST(NOT (nm > om + 1e-8 OR nr > orr + 1e-8 OR nc < oc - 1e-8 OR nm > 0.99 * om OR fold IN (3, 4)) AS INTEGER) AS passes FROM mt""")
def nonregression_gate(spark, d):
    e = F.col("predicted") - F.col("actual")
    parts = {"mae": F.abs(e), "rmse": e * e, "coverage": flag(F.abs(e) <= 20)}
    wide = fold_evidence(spark, d).groupBy("fold").agg(*[
        F.avg(F.when(F.col("version") == v, c)).alias(prefix + n) for n, c in parts.items() for v, prefix in (("new", ""), ("old", "baseline_"))])
    table_ = wide.withColumns({
        "rmse": F.sqrt("rmse"), "baseline_rmse": F.sqrt("baseline_rmse"), "width": F.lit(40.0), "baseline_width": F.lit(40.0),
        "audit_mae": F.col("mae"), "baseline_audit_mae": F.col("baseline_mae"), "is_baseline": F.col("fold") == 4, "inner_eligible": F.col("fold") != 3})
    return gates.nonregression(table_, ["fold"]).withColumn("passes", flag("passes"))


def _gate_scores(version):
    e = f"({'predicted * 0.6' if version == 'new' else 'predicted'} - actual)"
    return f"""{version}0 AS (SELECT unit, actual, {e} AS e, CASE WHEN cycle / (cycle + actual) <= CAST(1 AS DOUBLE) / 3 THEN 'early' WHEN cycle / (cycle + actual) <= CAST(2 AS DOUBLE) / 3 THEN 'middle' ELSE 'late' END AS phase FROM scored),
  {version}1 AS (SELECT {', '.join(f"avg({k}) FILTER (phase = '{p}') AS {p}_{k}" for p in metrics.PHASES for k in ('mae', 'rmse'))} FROM (SELECT unit, phase, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM {version}0 GROUP BY 1, 2)),
  {version}2 AS (SELECT avg(mae) AS unit_mean_mae, avg(rmse) AS unit_mean_rmse, max(mae) AS worst_unit_mae, avg(near) AS near_failure_unit_mae, avg(over) AS near_failure_over_by_10_rate FROM
    (SELECT unit, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e)) FILTER (actual <= 30) AS near, avg(CAST(e > 10 AS INTEGER)) FILTER (actual <= 30) AS over FROM {version}0 GROUP BY 1))"""


_FIVE = ("unit_mean_mae", "unit_mean_rmse", "worst_unit_mae", "near_failure_unit_mae", "near_failure_over_by_10_rate")
_BALANCED = lambda v: f"({v}1.early_mae + {v}1.middle_mae + {v}1.late_mae) / 3"


@query("mdl_24_protocol_gate", f"""WITH {SCORED}, {_gate_scores('new')}, {_gate_scores('old')} SELECT CAST({_BALANCED('new')} <= 0.99 * {_BALANCED('old')} AS INTEGER) AS balanced_phase_mae_improves_1pct,
  {', '.join(f'CAST(new2.{k} <= old2.{k} + 1e-10 AS INTEGER) AS {k}_no_worse' for k in _FIVE)},
  {', '.join(f'CAST(new1.{p}_{k} <= old1.{p}_{k} + 1e-10 AS INTEGER) AS {p}_unit_mean_{k}_no_worse' for p in metrics.PHASES for k in ('mae', 'rmse'))},
  CAST({_BALANCED('new')} <= 0.99 * {_BALANCED('old')} AND {' AND '.join(f'new2.{k} <= old2.{k} + 1e-10' for k in _FIVE)} AND {' AND '.join(f'new1.{p}_{k} <= old1.{p}_{k} + 1e-10' for p in metrics.PHASES for k in ('mae', 'rmse'))} AS INTEGER) AS eligible FROM new1, old1, new2, old2""")
def protocol_gate(spark, d):
    reference = scored_rows(spark, d).select("unit", "cycle", "actual", "predicted")
    candidate = reference.withColumn("predicted", F.col("predicted") * 0.6)
    out = gates.protocol_checks(candidate, reference).drop("complete")
    return out.select(*[flag(c).alias(c) for c in out.columns])


# Error targets per task kind.
TARGETS = {"engine": {"mae": 15.0, "rmse": 20.0}, "battery_rul": {"mae": 10.0}}


@query("mdl_25_target_gates", f"""WITH {SCORED}, m AS (SELECT fold, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse FROM scored GROUP BY 1)
  SELECT fold, CAST(mae <= 15 AS INTEGER) AS mae_ok, CAST(rmse <= 20 AS INTEGER) AS rmse_ok, CASE WHEN mae <= 15 AND rmse <= 20 THEN 'conditional_pass' ELSE 'fail' END AS gate FROM m""")
def target_gates(spark, d):
    scores = metrics.regression_scores(F.col("actual"), F.col("predicted"))
    per = scored_rows(spark, d).groupBy("fold").agg(scores["mae"].alias("mae"), scores["rmse"].alias("rmse"))
    limits = TARGETS["engine"]
    held = gates.target_gate({f"{k}_ok": F.col(k) <= v for k, v in limits.items()})
    return per.select("fold", flag(held["mae_ok"]).alias("mae_ok"), flag(held["rmse_ok"]).alias("rmse_ok"), held["gate"].alias("gate"))


# -- nested evaluation -----------------------------------------------------------------
NESTED_BLOCKS, NESTED_REACH = len(FAULTS), 5  # normal blocks; rows in the longest window of the grid
NESTED_GRID = [{"index": i, "smoothing": s, "q": q, "window": w, "required": m} for i, (s, q, w, m) in enumerate(
    (s, q, w, m) for s in (1, 3) for q in (0.9, 0.95) for w, m in ((1, 1), (5, 3)))]


def nested_evaluation(spark, d):
    """Outer fold = one fault type and one normal block; candidates are chosen inside the rest.

    All cells (outer, inner, candidate) are fitted, calibrated, scored and voted on together; the
    plan joins rows to roles, so nothing loops over folds on the driver.
    """
    plan = spark.createDataFrame(splits.nested_plan(NESTED_BLOCKS), "outer int, inner int, role string, block int")
    fault_no = F.array_position(F.array(*[F.lit(f) for f in FAULTS]), F.col("scenario")).cast("int") - 1
    s = blocked(spark, d, NESTED_BLOCKS)
    # The four rows before each row of its stretch (a block of normal rows, a fault's whole trajectory) stand beside it, so that
    # a cell's scores and votes come from one row at a time: cells multiply nothing that is sorted, sent or written.
    names = ["scenario", "position", "is_abnormal", "block", *AB, *[f"{c}_{k}" for k in range(1, NESTED_REACH) for c in AB]]

    def beside(f):
        same = {k: F.lag("block", k).over(f.ordered).eqNullSafe(F.col("block")) for k in range(1, NESTED_REACH)}
        return {f"{c}_{k}": F.when(same[k], F.lag(c, k).over(f.ordered)) for k in same for c in AB}

    variants = [v.trailing(NESTED_REACH, beside).frame.select(*names, F.lit(n).alias("smoothing")) for n, v in ((1, s), (3, detect.smooth(s, AB, 3)))]
    rows = materialise(variants[0].unionByName(variants[1]), "variants")
    cell = ["outer", "inner", "smoothing"]

    # ``smoothing`` looks back over earlier rows of its trajectory, so each block is smoothed in place.
    def normal(role):
        return rows.filter("is_abnormal = 0").join(F.broadcast(plan.filter(F.col("role") == role).drop("role")), "block")

    def faults(role):
        """Every outer fold tests its own fault after the refit, and validates on the others in its inner folds."""
        mine = (fault_no == F.col("outer")) if role == "test" else ~(fault_no == F.col("outer"))
        inner = F.array(F.lit(-1)) if role == "test" else F.sequence(F.lit(0), F.lit(NESTED_BLOCKS - 2))
        return rows.filter("is_abnormal = 1").withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(NESTED_BLOCKS - 1)))).filter(mine).withColumn("inner", F.explode(inner))

    fits = materialise(detect.fit_envelope(normal("train"), AB, cell), "fits")
    held = materialise(normal("calibration").join(F.broadcast(fits), cell).select(*cell, detect.envelope_score(AB).alias("score")), "scores")
    qs = sorted({g["q"] for g in NESTED_GRID})
    levels = quantiles(held, cell, {f"q{i}": ("score", q, higher(q)) for i, q in enumerate(qs)})
    limits = levels.select(*cell, F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("threshold")) for i, q in enumerate(qs)])))
    grid = spark.createDataFrame([(g["index"], g["smoothing"], g["q"], g["window"], g["required"]) for g in NESTED_GRID],
                                 "index int, smoothing int, q double, window int, required int")
    cells = materialise(limits.join(F.broadcast(grid), ["smoothing", "q"]), "cells")  # as many rows as the plan and the grid have
    scores = {f"score_{k}": detect.envelope_score(AB if k == 0 else [f"{c}_{k}" for c in AB]) for k in range(NESTED_REACH)}
    hits = sum((F.when(F.col(c).isNotNull(), flag(F.col(c) > F.col("threshold"))).otherwise(0) for c in scores), F.lit(0))
    alert = F.when(F.col("window") == 1, flag(F.col("score_0") > F.col("threshold"))).otherwise(flag(hits >= F.col("required")))

    def voted(role, limits):
        """Alerts of the rows of one role under the given cells; nothing but their counts or the chosen ones is kept."""
        judged = normal(role).unionByName(faults(role)).join(F.broadcast(fits), cell).select(
            *cell, "scenario", "position", "is_abnormal", *[c.alias(n) for n, c in scores.items()])
        return judged.join(F.broadcast(limits), cell).select(
            "outer", "inner", "index", "scenario", "position", F.col("is_abnormal").alias("actual"), alert.alias("predicted"))

    inner = metrics.detection_scores(voted("validation", cells), "actual", "predicted", ["outer", "index"])
    chosen = best(inner.withColumn("score", F.round(detect.selection_score(2, .10), 9)), [-F.col("score"), F.col("index")], ["outer"]).select("outer", "index", "score")
    chosen = materialise(chosen, "chosen")
    return voted("test", cells.join(chosen.select("outer", "index"), ["outer", "index"])).join(F.broadcast(chosen), ["outer", "index"])


def _nested_sql() -> str:
    plan = ", ".join(f"({o}, {i}, '{role}', {b})" for o, i, role, b in splits.nested_plan(NESTED_BLOCKS))
    faults = ", ".join(f"'{f}'" for f in FAULTS)
    grid = ", ".join(f"({g['index']}, {g['smoothing']}, CAST({g['q']} AS DOUBLE), {g['window']}, {g['required']})" for g in NESTED_GRID)
    return f"""{SCENARIOS}, blk AS (SELECT *, CASE WHEN is_abnormal = 0 THEN ntile({NESTED_BLOCKS}) OVER (PARTITION BY scenario ORDER BY position) - 1 END AS block FROM scen),
  plan(o, i, role, block) AS (VALUES {plan}), grid(idx, smoothing, q, win, req) AS (VALUES {grid}),
  vr AS (SELECT scenario, position, is_abnormal, block, 1 AS smoothing, a, b FROM blk UNION ALL SELECT scenario, position, is_abnormal, block, 3, quantile_cont(a, 0.5) OVER w, quantile_cont(b, 0.5) OVER w FROM blk
    WINDOW w AS (PARTITION BY scenario ORDER BY position ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  nm AS (SELECT vr.*, o, i, role FROM vr JOIN plan USING (block) WHERE is_abnormal = 0), tr AS (SELECT * FROM nm WHERE role = 'train'),
  md AS (SELECT o, i, smoothing, quantile_cont(a, 0.5) AS am, quantile_cont(b, 0.5) AS bm FROM tr GROUP BY 1, 2, 3),
  ft AS (SELECT o, i, smoothing, any_value(am) AS am, any_value(bm) AS bm, quantile_cont(abs(a - am), 0.5) * 1.4826 AS asc_, quantile_cont(abs(b - bm), 0.5) * 1.4826 AS bsc FROM tr JOIN md USING (o, i, smoothing) GROUP BY 1, 2, 3),
  ou AS (SELECT unnest(range(0, {NESTED_BLOCKS})) AS o), fl AS (SELECT vr.*, o, unnest(CASE WHEN list_position([{faults}], scenario) - 1 = o THEN [-1] ELSE range(0, {NESTED_BLOCKS - 1}) END) AS i FROM vr, ou WHERE is_abnormal = 1),
  ju AS (SELECT scenario, position, is_abnormal, smoothing, a, b, o, i, role FROM nm WHERE role <> 'train' UNION ALL SELECT scenario, position, is_abnormal, smoothing, a, b, o, i, CASE WHEN i = -1 THEN 'test' ELSE 'validation' END FROM fl),
  sco AS (SELECT ju.*, greatest(abs((a - am) / asc_), abs((b - bm) / bsc)) AS score FROM ju JOIN ft USING (o, i, smoothing)),
  cs AS (SELECT o, i, smoothing, score, row_number() OVER (PARTITION BY o, i, smoothing ORDER BY score) AS n, count(*) OVER (PARTITION BY o, i, smoothing) AS c FROM sco WHERE role = 'calibration'),
  th AS (SELECT o, i, idx, any_value(win) AS win, any_value(req) AS req, smoothing, max(score) FILTER (n = ceil(q * (c - 1)) + 1) AS threshold FROM cs JOIN grid USING (smoothing) GROUP BY o, i, idx, smoothing),
  vo AS (SELECT o, i, idx, win, req, role, scenario, position, is_abnormal AS actual, CAST(score > threshold AS INTEGER) AS vote FROM sco JOIN th USING (o, i, smoothing) WHERE role <> 'calibration'),
  pr AS (SELECT *, CASE WHEN win = 1 THEN vote ELSE CAST(sum(vote) OVER (PARTITION BY o, i, idx, scenario ORDER BY position ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= req AS INTEGER) END AS predicted FROM vo),
  im AS (SELECT o, idx, avg(predicted) FILTER (actual = 0) AS fa, avg(predicted) FILTER (actual = 1) AS dr FROM pr WHERE role = 'validation' GROUP BY 1, 2),
  ch AS (SELECT o, idx FROM im QUALIFY row_number() OVER (PARTITION BY o ORDER BY round((1 - fa + dr) / 2 - 2 * greatest(fa - 0.1, 0), 9) DESC, idx) = 1),
  fin AS (SELECT pr.* FROM pr JOIN ch USING (o, idx) WHERE role = 'test')"""


@query("job_10_nested_detector_evaluation", f"""WITH {_nested_sql()} SELECT CAST(o AS INTEGER) AS outer_fold, CAST(any_value(idx) AS INTEGER) AS selected, count(*) AS rows, {rs('avg(predicted) FILTER (actual = 0)')} AS false_alarm_rate, {rs('avg(predicted) FILTER (actual = 1)')} AS detection_rate FROM fin GROUP BY 1""")
def nested_detector_evaluation(spark, d):
    out = nested_evaluation(spark, d)
    actual, predicted = F.col("actual"), F.col("predicted")
    return out.groupBy(F.col("outer").alias("outer_fold")).agg(
        F.max("index").alias("selected"), F.count("*").alias("rows"), r(F.avg(F.when(actual == 0, predicted))).alias("false_alarm_rate"),
        r(F.avg(F.when(actual == 1, predicted))).alias("detection_rate"))
