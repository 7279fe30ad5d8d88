"""Evaluation and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, learn, metrics, selection
from ..operators.causal import terminal_rows
from ..operators.joins import with_candidates
from ..operators.labels import trajectory_third
from ..session import table
from .inputs import EV, SCENARIOS, SCORED, SHIP, event_rows, event_series, scenario_rows, scored_rows, shipment_series
from .registry import flag, query, r, rounded, rs

_E = "predicted - actual"


def actual():
    return F.col("actual")


def predicted():
    return F.col("predicted")



@query("eval_01_regression", f"""WITH {SCORED} SELECT {rs(f'avg(abs({_E}))')} AS mae, {rs(f'sqrt(avg(({_E}) ** 2))')} AS rmse, {rs(f'1 - sum(({_E}) ** 2) / (var_pop(actual) * count(*))')} AS r2, {rs(f'avg({_E})')} AS bias FROM scored""")
def regression(spark, d):
    return scored_rows(spark, d).agg(*[r(c).alias(n) for n, c in metrics.regression_scores(actual(), predicted()).items()])


_CLASS = """c AS (SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT actual AS label FROM c UNION SELECT predicted FROM c),
  p AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM c WHERE actual = label) AS support, (SELECT coalesce(sum(n), 0) FROM c WHERE predicted = label) AS predicted_rows,
  (SELECT coalesce(sum(n), 0) FROM c WHERE actual = label AND predicted = label) AS true_positive FROM k)"""


@query("eval_02_classification", f"""WITH {_CLASS} SELECT {rs('sum(true_positive) / sum(support)')} AS accuracy, {rs('avg(true_positive / CAST(support AS DOUBLE)) FILTER (support > 0)')} AS balanced_accuracy,
  {rs('avg(CASE WHEN support + predicted_rows > 0 THEN 2 * true_positive / CAST(support + predicted_rows AS DOUBLE) ELSE 0 END)')} AS macro_f1 FROM p""")
def classification(spark, d):
    return rounded(metrics.classification_scores(table(spark, d, "labels"), "quality", "toxic"), ["accuracy", "balanced_accuracy", "macro_f1"])


@query("eval_03_class_report", f"""WITH {_CLASS} SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted_rows AS BIGINT) AS predicted_rows, CAST(true_positive AS BIGINT) AS true_positive,
  {rs('coalesce(true_positive / nullif(CAST(predicted_rows AS DOUBLE), 0), 0)')} AS precision, {rs('true_positive / nullif(CAST(support AS DOUBLE), 0)')} AS recall,
  {rs('coalesce(2 * true_positive / nullif(CAST(support + predicted_rows AS DOUBLE), 0), 0)')} AS f1 FROM p""")
def class_report(spark, d):
    return rounded(metrics.class_report(table(spark, d, "labels"), "quality", "toxic"), ["precision", "recall", "f1"])


@query("eval_03b_confusion_matrix", "SELECT quality AS actual, toxic AS predicted, count(*) AS rows FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


def log_penalty(column):
    """log10(1 + x): late errors count in full, and the sum of their exponentials still agrees between engines."""
    return F.log10(1 + F.col(column))


@query("eval_04_late_penalty", f"""WITH {SCORED} SELECT fold, {rs(f'log10(1 + sum(CASE WHEN {_E} < 0 THEN exp(-({_E}) / 13) - 1 ELSE exp(({_E}) / 10) - 1 END))')} AS log_penalty FROM scored GROUP BY 1""")
def late_penalty(spark, d):
    out = scored_rows(spark, d).groupBy("fold").agg(metrics.late_penalty(actual(), predicted()).alias("penalty"))
    return out.select("fold", r(log_penalty("penalty")).alias("log_penalty"))


_SAFETY = f"""{SCORED}, s AS (SELECT fold, avg(abs({_E})) AS mae, sqrt(avg(({_E}) ** 2)) AS rmse, avg({_E}) FILTER (actual <= 30) AS near_bias, avg(CAST({_E} > 0 AS INTEGER)) FILTER (actual <= 30) AS near_late_rate,
  sum(CASE WHEN {_E} < 0 THEN exp(-({_E}) / 13) - 1 ELSE exp(({_E}) / 10) - 1 END) / count(*) AS average_penalty FROM scored GROUP BY 1)"""


@query("eval_05_safety_objective", f"""WITH {_SAFETY} SELECT fold, {rs('near_bias')} AS near_bias, {rs('near_late_rate')} AS near_late_rate, {rs('log10(1 + average_penalty)')} AS log_average_penalty,
  {rs('log10(1 + rmse + 1.5 * greatest(near_bias, 0) + 0.5 * average_penalty)')} AS log_safety_objective FROM s""")
def safety_objective(spark, d):
    out = metrics.safety_scores(scored_rows(spark, d), actual(), predicted(), ["fold"])
    return out.select("fold", r("near_bias").alias("near_bias"), r("near_late_rate").alias("near_late_rate"), *[
        r(log_penalty(c)).alias(f"log_{c}") for c in ("average_penalty", "safety_objective")])


@query("eval_06_selection_score", f"""WITH {_SAFETY} SELECT fold, {rs('rmse + 0.5 * greatest(near_bias, 0)')} AS selection_score, {rs('near_late_rate')} AS near_late_rate FROM s""")
def selection_score(spark, d):
    out = metrics.safety_scores(scored_rows(spark, d), actual(), predicted(), ["fold"])
    return rounded(out.select("fold", "selection_score", "near_late_rate"), ["selection_score", "near_late_rate"])


@query("eval_07_unit_mean_scores", f"""WITH {SCORED}, u AS (SELECT unit, avg(abs({_E})) AS mae, sqrt(avg(({_E}) ** 2)) AS rmse, avg({_E}) AS bias FROM scored GROUP BY 1)
  SELECT count(*) AS units, {rs('avg(mae)')} AS mae, {rs('avg(rmse)')} AS rmse, {rs('avg(bias)')} AS bias FROM u""")
def unit_mean_scores(spark, d):
    return rounded(metrics.unit_mean_scores(scored_rows(spark, d)), ["mae", "rmse", "bias"])


_DET = f"{SCENARIOS}, det AS (SELECT scenario, position, is_abnormal AS actual, CAST(a > 40 AS INTEGER) AS predicted FROM scen)"


def detections(spark, d):
    return scenario_rows(spark, d).frame.select("scenario", "position", F.col("is_abnormal").alias("actual"), flag(F.col("a") > 40).alias("predicted"))


_DSQL = """avg(CAST(actual = predicted AS INTEGER)) AS accuracy, avg(predicted) FILTER (actual = 0) AS fa, avg(predicted) FILTER (actual = 1) AS dr,
  2.0 * count(*) FILTER (actual = 1 AND predicted = 1) / (2 * count(*) FILTER (actual = 1 AND predicted = 1) + count(*) FILTER (actual <> predicted)) AS f1,
  2.0 * count(*) FILTER (actual = 0 AND predicted = 0) / (2 * count(*) FILTER (actual = 0 AND predicted = 0) + count(*) FILTER (actual <> predicted)) AS f0"""


@query("eval_08_detection", f"""WITH {_DET}, m AS (SELECT {_DSQL} FROM det) SELECT {rs('accuracy')} AS accuracy, {rs('fa')} AS false_alarm_rate, {rs('dr')} AS detection_rate,
  {rs('(1 - fa + dr) / 2')} AS balanced_accuracy, {rs('(f1 + f0) / 2')} AS macro_f1 FROM m""")
def detection(spark, d):
    out = metrics.detection_scores(detections(spark, d), "actual", "predicted")
    return rounded(out, ["accuracy", "false_alarm_rate", "detection_rate", "balanced_accuracy", "macro_f1"])


@query("eval_08b_detection_by_scenario", f"""WITH {_DET} SELECT scenario, count(*) AS rows, {rs('avg(predicted)')} AS detection_rate FROM det WHERE actual = 1 GROUP BY 1""")
def detection_by_scenario(spark, d):
    return detections(spark, d).filter("actual = 1").groupBy("scenario").agg(F.count("*").alias("rows"), r(F.avg("predicted")).alias("detection_rate"))


_PHASE = "CASE WHEN cycle / (cycle + actual) <= CAST(1 AS DOUBLE) / 3 THEN 'early' WHEN cycle / (cycle + actual) <= CAST(2 AS DOUBLE) / 3 THEN 'middle' ELSE 'late' END"
_BAND = "CASE WHEN actual <= 30 THEN '0-30' WHEN actual <= 100 THEN '31-100' ELSE '>100' END"


@query("eval_09_error_slices", f"""WITH {SCORED}, s AS (SELECT *, {_E} AS e, {_PHASE} AS phase, {_BAND} AS band FROM scored),
  x AS (SELECT 'all' AS slice, 'all' AS key, unit, e FROM s UNION ALL SELECT 'phase', phase, unit, e FROM s UNION ALL SELECT 'rul_band', band, unit, e FROM s UNION ALL SELECT 'unit', unit, unit, e FROM s),
  u AS (SELECT slice, key, unit, count(*) AS n, sum(abs(e)) AS a, sum(e * e) AS q, sum(e) AS s, count(*) FILTER (e > 10) AS o FROM x GROUP BY 1, 2, 3)
  SELECT slice, key, CAST(sum(n) AS BIGINT) AS rows, count(*) AS units, {rs('sum(a) / sum(n)')} AS row_mae, {rs('sqrt(sum(q) / sum(n))')} AS row_rmse, {rs('avg(a / n)')} AS unit_mean_mae, {rs('avg(sqrt(q / n))')} AS unit_mean_rmse,
  {rs('sum(s) / sum(n)')} AS bias, {rs('sum(o) / sum(n)')} AS over_10_rate, {rs('0')} AS cap_error_floor FROM u GROUP BY 1, 2""")
def error_slices(spark, d):
    out = metrics.standard_slices(scored_rows(spark, d))
    return rounded(out, ["row_mae", "row_rmse", "unit_mean_mae", "unit_mean_rmse", "bias", "over_10_rate", "cap_error_floor"])


_BAL = f"""b0 AS (SELECT *, {_E} AS e, {_PHASE} AS phase FROM scored), b1 AS (SELECT unit, phase, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM b0 GROUP BY 1, 2),
  b2 AS (SELECT unit, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e)) FILTER (actual <= 30) AS near, avg(CAST(e > 10 AS INTEGER)) FILTER (actual <= 30) AS over FROM b0 GROUP BY 1),
  b3 AS (SELECT {', '.join(f"avg({k}) FILTER (phase = '{p}') AS {p}_{k}" for p in metrics.PHASES for k in ('mae', 'rmse'))} FROM b1)"""


@query("eval_10_balanced_scores", f"""WITH {SCORED}, {_BAL} SELECT (SELECT count(*) FROM scored) AS rows, (SELECT count(*) FROM b2) AS units, {rs('(SELECT avg(mae) FROM b2)')} AS unit_mean_mae, {rs('(SELECT avg(rmse) FROM b2)')} AS unit_mean_rmse,
  {rs('(SELECT max(mae) FROM b2)')} AS worst_unit_mae, {rs('(SELECT avg(near) FROM b2)')} AS near_failure_unit_mae, {rs('(SELECT avg(over) FROM b2)')} AS near_failure_over_by_10_rate,
  (SELECT CAST(min(c) = 3 AS INTEGER) FROM (SELECT count(*) AS c FROM b1 GROUP BY unit)) AS complete,
  {', '.join(f"{rs(f'{p}_{k}')} AS {p}_unit_mean_{k}" for p in metrics.PHASES for k in ('mae', 'rmse'))}, {rs('(early_mae + middle_mae + late_mae) / 3')} AS balanced_phase_mae FROM b3""")
def balanced_scores(spark, d):
    out = metrics.balanced_scores(scored_rows(spark, d))
    doubles = [c for c in out.columns if c not in ("rows", "units", "complete")]
    return rounded(out, doubles).withColumn("complete", flag("complete"))


@query("eval_11_interval_coverage", f"""WITH {SCORED} SELECT fold, {rs('avg(CAST(actual BETWEEN lower AND upper AS INTEGER))')} AS coverage, {rs('avg(upper - lower)')} AS mean_width FROM scored GROUP BY 1""")
def interval_coverage(spark, d):
    return rounded(metrics.interval_scores(scored_rows(spark, d), ["fold"]), ["coverage", "mean_width"])


@query("eval_12_acceptance", f"""WITH {SCORED} SELECT event_type, {rs('avg(CAST(predicted <= 50 AS INTEGER))')} AS coverage, {rs('avg(CAST(abs(predicted - actual) <= 10 AS INTEGER)) FILTER (predicted <= 50)')} AS accepted_accuracy FROM scored GROUP BY 1""")
def acceptance(spark, d):
    out = metrics.acceptance_scores(scored_rows(spark, d), predicted() <= 50, F.abs(predicted() - actual()) <= 10, ["event_type"])
    return rounded(out, ["coverage", "accepted_accuracy"])


_OFF = lambda y: f"""count(*) AS rows, {rs(f'avg(abs(predicted - {y}))')} AS mae, {rs(f'sqrt(avg((predicted - {y}) ** 2))')} AS rmse, {rs(f'1 - sum((predicted - {y}) ** 2) / (var_pop({y}) * count(*))')} AS r2, {rs(f'avg(predicted - {y})')} AS bias,
  {rs(f'log10(1 + sum(CASE WHEN predicted < {y} THEN exp(({y} - predicted) / 13) - 1 ELSE exp((predicted - {y}) / 10) - 1 END))')} AS log_penalty, {rs(f'quantile_cont(abs(predicted - {y}), 0.5)')} AS median_absolute_error"""


@query("eval_13_capped_report", f"""WITH {SCORED}, t AS (SELECT actual, least(actual, 40) AS c, predicted FROM scored) SELECT 'raw' AS view, {_OFF('actual')} FROM t UNION ALL SELECT 'capped', {_OFF('c')} FROM t""")
def capped_report(spark, d):
    out = metrics.capped_report(scored_rows(spark, d), 40)
    out = out.withColumn("log_penalty", log_penalty("penalty")).drop("penalty")
    return rounded(out, ["mae", "rmse", "r2", "bias", "median_absolute_error", "log_penalty"])


_THIRD = "CASE WHEN position <= 57 THEN 'first' WHEN position <= 114 THEN 'second' WHEN position <= 171 THEN 'third' ELSE 'beyond' END"


@query("eval_14_alerts_by_third", f"""WITH {SCENARIOS} SELECT scenario, {_THIRD} AS third, {rs('avg(CAST(a > 40 AS INTEGER))')} AS rate_a, {rs('avg(CAST(b > 80 AS INTEGER))')} AS rate_b FROM scen GROUP BY 1, 2""")
def alerts_by_third(spark, d):
    third = F.coalesce(trajectory_third(F.col("position")), F.lit("beyond"))
    return scenario_rows(spark, d).df.groupBy("scenario", third.alias("third")).agg(
        r(F.avg(flag(F.col("a") > 40))).alias("rate_a"), r(F.avg(flag(F.col("b") > 80))).alias("rate_b"))


@query("eval_15_required_detection", f"""WITH {_DET}, m AS (SELECT avg(predicted) FILTER (actual = 0) AS fa, count(*) FILTER (actual = 0) AS n, count(*) FILTER (actual = 1) AS p FROM det)
  SELECT {rs('(0.9 * (n + p) - n * (1 - fa)) / p')} AS required_detection_rate, {rs('greatest(n, p) / CAST(n + p AS DOUBLE)')} AS majority_accuracy FROM m""")
def required_detection(spark, d):
    one = detections(spark, d).agg(F.avg(F.when(actual() == 0, predicted())).alias("fa"), F.count_if(actual() == 0).alias("n"), F.count_if(actual() == 1).alias("p"))
    need = metrics.required_detection_rate(F.lit(0.9), F.col("fa"), F.col("n"), F.col("p"))
    return one.select(r(need).alias("required_detection_rate"), r(F.greatest("n", "p") / (F.col("n") + F.col("p"))).alias("majority_accuracy"))


@query("eval_16_beyond_training_life", f"""WITH {SCORED}, m AS (SELECT fold, max(cycle + actual) AS top FROM scored GROUP BY 1), t AS (SELECT a.fold, max(b.top) AS train_top FROM m a JOIN m b ON a.fold <> b.fold GROUP BY 1)
  SELECT fold, count(*) AS rows, count(*) FILTER (cycle + actual > train_top) AS beyond_rows, {rs('avg(greatest(actual - 60, 0))')} AS cap_error_floor FROM scored JOIN t USING (fold) GROUP BY 1""")
def beyond_training_life(spark, d):
    """Life longer than any in the other folds, which are the fold's training rows."""
    rows = metrics.beyond_other_folds(scored_rows(spark, d), "fold")
    return rows.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if("beyond").alias("beyond_rows"),
                                    r(F.avg(F.greatest(actual() - 60, F.lit(0)))).alias("cap_error_floor"))


# -- sort, limit, top-k ----------------------------------------------------------------
@query("top_01_canonical_order", f"""WITH {SHIP} SELECT l_suppkey, cycle, l_orderkey, l_quantity FROM ship ORDER BY l_suppkey, cycle""")
def canonical_order(spark, d):
    return shipment_series(spark, d).frame.select("l_suppkey", "cycle", "l_orderkey", "l_quantity").orderBy("l_suppkey", "cycle")


@query("top_02_worst_rows", f"""WITH {SCORED} SELECT unit, cycle, {rs(f'abs({_E})')} AS absolute_error FROM scored ORDER BY abs({_E}) DESC, unit, cycle LIMIT 5""")
def worst_rows(spark, d):
    rows = scored_rows(spark, d).select("unit", "cycle", F.abs(predicted() - actual()).alias("absolute_error"))
    return rounded(selection.top_rows(rows, [F.desc("absolute_error"), F.asc("unit"), F.asc("cycle")], 5), ["absolute_error"])


@query("top_03_top_per_group", """SELECT event_type, event_id, value, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(value) DESC, event_id) AS n FROM events) WHERE n <= 3""")
def top_per_group(spark, d):
    return selection.top_per_group(event_rows(spark, d), ["event_type"], [F.desc(F.abs("value")), F.asc("event_id")], 3).select(
        "event_type", "event_id", "value", "place")


@query("top_04_importance_ranking", f"""WITH w AS (SELECT 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS w FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem)
  SELECT feature, {rs('w / max(w) OVER () * 100', 4)} AS importance FROM w WHERE w > 0 ORDER BY w DESC LIMIT 5""")
def importance_ranking(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    one = table(spark, d, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in names]).first()
    return selection.importances(names, [one[c] for c in names], spark).select("feature", r("importance", 4).alias("importance"))


@query("top_05_top_channels", f"""WITH m AS (SELECT avg(l_quantity) AS q, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS e, stddev_pop(l_extendedprice) AS es, avg(l_discount) AS d, stddev_pop(l_discount) AS ds, avg(l_tax) AS t, stddev_pop(l_tax) AS ts FROM lineitem),
  v AS (SELECT l_returnflag, list_sort(list_value({{'w': -abs(avg(l_quantity) - any_value(q)) / any_value(qs), 'n': 'l_quantity'}}, {{'w': -abs(avg(l_extendedprice) - any_value(e)) / any_value(es), 'n': 'l_extendedprice'}}, {{'w': -abs(avg(l_discount) - any_value(d)) / any_value(ds), 'n': 'l_discount'}}, {{'w': -abs(avg(l_tax) - any_value(t)) / any_value(ts), 'n': 'l_tax'}})) AS s FROM lineitem, m GROUP BY 1)
  SELECT l_returnflag, s[1].n || ',' || s[2].n AS channels FROM v""")
def top_channels(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = table(spark, d, "lineitem")
    fit = lines.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    per = lines.groupBy("l_returnflag").agg(*[F.avg(c).alias(c) for c in names])
    away = {c: F.abs(F.col(c) - fit[f"m_{c}"]) / fit[f"s_{c}"] for c in names}
    return per.select("l_returnflag", F.concat_ws(",", selection.top_channels(away, 2)).alias("channels"))


@query("top_04b_model_importances")
def model_importances(spark, d):
    """Importances of a fitted forest, summed over its node table, next to the model's own vector (tested to agree)."""
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    lines = table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in names], F.col("l_extendedprice").cast("double").alias("y"))
    model = learn.fit(lines, names, learn.forest("y", 8, 5))
    own = model.stages[-1].featureImportances
    kept = [c.removeprefix("__z_") for c in model.stages[-2].getInputCols()]
    theirs = spark.createDataFrame([(c, float(own[i])) for i, c in enumerate(kept)], "feature string, own double")  # one row a feature
    found = learn.importances(model)
    return theirs.join(found, "feature", "left").select("feature", r("importance", 6).alias("importance"), flag(F.abs(F.coalesce("importance", F.lit(0.0)) - F.col("own")) > 1e-9).alias("differs"))


_AWAY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_gap", "rate_gap")
_GAPS = "l_extendedprice - 1500 * l_quantity AS price_gap, l_discount - l_tax AS rate_gap"


@query("top_05b_latest_deviations", f"""WITH l AS (SELECT *, {_GAPS} FROM lineitem), n AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _AWAY)} FROM l WHERE l_returnflag = 'N'),
  t AS (SELECT l.* FROM l QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
  v AS (SELECT l_suppkey, unnest([{', '.join(f"'{c}'" for c in _AWAY)}]) AS feature, unnest([{', '.join(f'abs({c} - m_{c}) / s_{c}' for c in _AWAY)}]) AS away FROM t, n)
  SELECT l_suppkey, feature, {rs('away', 3)} AS deviation, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY round(away, 9) DESC, feature) AS INTEGER) AS place FROM v QUALIFY place <= 5""")
def latest_deviations(spark, d):
    """Of each supplier's latest shipment the five channels furthest from the normal centre, differences of channels included."""
    gaps = {"price_gap": F.col("l_extendedprice") - 1500 * F.col("l_quantity"), "rate_gap": F.col("l_discount") - F.col("l_tax")}
    lines = table(spark, d, "lineitem").withColumns(gaps)
    normal = lines.filter("l_returnflag = 'N'").agg(*[F.avg(c).alias(f"m_{c}") for c in _AWAY], *[F.stddev_pop(c).alias(f"s_{c}") for c in _AWAY]).first()  # one row
    last = causal.terminal_rows(lines.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", *_AWAY), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    away = F.array(*[F.struct((-F.round(F.abs(F.col(c) - normal[f"m_{c}"]) / normal[f"s_{c}"], 9)).alias("key"), F.lit(c).alias("feature")) for c in _AWAY])
    ranked = last.select("l_suppkey", F.posexplode(F.slice(F.array_sort(away), 1, 5)).alias("place", "x"))
    return ranked.select("l_suppkey", "x.feature", r(-F.col("x.key"), 3).alias("deviation"), (F.col("place") + 1).alias("place"))


@query("top_06_row_aggregates", """WITH v AS (SELECT vec_id, list_sort(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) AS s FROM embeddings)
  SELECT vec_id, """ + f"""{rs('(s[63] + s[64]) / 2')} AS top2_mean, {rs('s[64]')} AS largest, {rs('list_avg(s)')} AS mean, {rs('s[48] + (s[49] - s[48]) * 0.25')} AS p75 FROM v""")
def row_aggregates(spark, d):
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    names = {"top2_mean": "top2_mean", "max": "largest", "mean": "mean", "p75": "p75"}
    return table(spark, d, "embeddings").select("vec_id", *[r(selection.row_aggregate(v, how)).alias(n) for how, n in names.items()])


@query("top_07_newest_rows", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def newest_rows(spark, d):
    return selection.top_rows(event_rows(spark, d).filter(F.col("event_type") == "error"), [F.desc("ts"), F.desc("event_id")], 20).select(
        "event_id", "user_id", "event_type")


_GRID = [{"index": i, "threshold": t} for i, t in enumerate((10.0, 20.0, 30.0, 40.0, 60.0, 90.0))]


def threshold_grid(spark, d):
    scored = with_candidates(scenario_rows(spark, d).df, _GRID)
    rows = scored.select("candidate.index", "candidate.threshold", F.col("is_abnormal").alias("actual"), flag(F.col("a") > F.col("candidate.threshold")).alias("predicted"))
    return metrics.detection_scores(rows, "actual", "predicted", ["index", "threshold"])


_GRIDSQL = f"""{SCENARIOS}, g AS (SELECT unnest(range(0, 6)) AS i, unnest([10.0, 20.0, 30.0, 40.0, 60.0, 90.0]) AS threshold),
  m AS (SELECT i, threshold, avg(CAST(a > threshold AS INTEGER)) FILTER (is_abnormal = 0) AS fa, avg(CAST(a > threshold AS INTEGER)) FILTER (is_abnormal = 1) AS dr FROM scen, g GROUP BY 1, 2)"""


@query("top_08_best_candidate", f"""WITH {_GRIDSQL} SELECT CAST(threshold AS DOUBLE) AS threshold, {rs('(1 - fa + dr) / 2')} AS balanced_accuracy FROM m ORDER BY round((1 - fa + dr) / 2, 9) DESC, round(fa, 9), i LIMIT 1""")
def best_candidate(spark, d):
    order = [-r("balanced_accuracy", 9), r("false_alarm_rate", 9), F.col("index")]
    return selection.best(threshold_grid(spark, d), order).select("threshold", r("balanced_accuracy").alias("balanced_accuracy"))


@query("top_09_preferred_near_best", f"""WITH {_GRIDSQL}, s AS (SELECT *, 1 - (1 - fa + dr) / 2 AS loss FROM m) SELECT CAST(threshold AS DOUBLE) AS threshold, {rs('loss')} AS loss FROM s
  WHERE loss <= 1.05 * (SELECT min(loss) FROM s) ORDER BY i DESC LIMIT 1""")
def preferred_near_best(spark, d):
    grid = threshold_grid(spark, d).select("threshold", F.col("index").cast("string").alias("name"), (1 - F.col("balanced_accuracy")).alias("loss"))
    return selection.preferred_near_best(grid, "loss", "name", ["5", "4", "3", "2", "1", "0"], 0.05).select("threshold", r("loss").alias("loss"))


@query("top_10_thinned_series", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
  SELECT user_id, cycle, value FROM n WHERE (cycle - 1) % CAST(greatest(ceil(c / 18.0), 1) AS BIGINT) = 0 OR cycle = c""")
def thinned_series(spark, d):
    return selection.thin(event_series(spark, d), 18).select("user_id", "cycle", "value")


@query("top_11_preview", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 10")
def preview(spark, d):
    return selection.top_rows(event_rows(spark, d), [F.asc("event_id")], 10).select("event_id", "user_id", "value")


@query("top_12_terminal_scores", f"""WITH {SCORED} SELECT unit, cycle, {rs('predicted')} AS predicted FROM scored WHERE actual = 0""")
def terminal_scores(spark, d):
    return terminal_rows(scored_rows(spark, d), ["unit"], ["cycle"]).select("unit", "cycle", r("predicted").alias("predicted"))
