"""Summary, profile, waveform and curve queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, labels, profile, waveform
from ..operators.order_stats import conformal, higher, median, quantiles
from ..operators.series import series
from ..session import table
from .inputs import (CHANNELS, EV, HIST, SAMPLES, SCENARIOS, SCORED, WAVE, event_rows, event_series, order_histories, sample_rows,
                     scenario_rows, scored_rows, waveform_rows)
from .registry import flag, query, r, rounded, rs

_L = "l AS (SELECT *, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul FROM ev)"


def lives(spark, d):
    return labels.remaining_life(event_series(spark, d), "cycle").frame


def histories(spark, d):
    return labels.discharge_histories(order_histories(spark, d)).frame


@query("agg_01_trajectory_summary", """SELECT event_type AS split, count(*) AS rows, count(DISTINCT user_id) AS units FROM events GROUP BY 1""")
def trajectory_summary(spark, d):
    return event_rows(spark, d).groupBy(F.col("event_type").alias("split")).agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("units"))


@query("agg_02_event_log_summary", """SELECT o_orderstatus AS type, count(*) AS rows, count(DISTINCT o_custkey) AS units, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS labelled,
  min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1""")
def event_log_summary(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("type")).agg(
        F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("units"), F.count_if(F.col("o_totalprice") > 1000).alias("labelled"),
        F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("agg_03_label_table_summary", f"""WITH {HIST}, u AS (SELECT o_custkey, arg_min(rul_label_status, discharge_cycle) AS status FROM hist GROUP BY 1)
  SELECT 'status:' || status AS measure, CAST(count(*) AS DOUBLE) AS amount FROM u GROUP BY 1
  UNION ALL SELECT 'valid', count(*) FILTER (valid_capacity) FROM hist UNION ALL SELECT 'missing', count(*) FILTER (capacity IS NULL) FROM hist
  UNION ALL SELECT 'zero', count(*) FILTER (capacity = 0) FROM hist UNION ALL SELECT 'soh_median', {rs('quantile_cont(soh_percent, 0.5)', 3)} FROM hist
  UNION ALL SELECT 'soh_min', {rs('min(soh_percent)', 3)} FROM hist UNION ALL SELECT 'soh_max', {rs('max(soh_percent)', 3)} FROM hist""")
def label_table_summary(spark, d):
    h = histories(spark, d)
    status = h.groupBy("o_custkey").agg(F.min_by("rul_label_status", "discharge_cycle").alias("s")).groupBy("s").count()
    by_status = status.select(F.concat(F.lit("status:"), "s").alias("measure"), F.col("count").cast("double").alias("amount"))
    one = h.agg(F.count_if("valid_capacity").alias("valid"), F.count_if(F.col("capacity").isNull()).alias("missing"),
                F.count_if(F.col("capacity") == 0).alias("zero"), r(F.min("soh_percent"), 3).alias("soh_min"), r(F.max("soh_percent"), 3).alias("soh_max"))
    rows = one.select(*[F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], list(one.columns), "measure", "amount")
    middle = quantiles(h, [], {"m": median("soh_percent")}).select(F.lit("soh_median").alias("measure"), r("m", 3).alias("amount"))
    return by_status.unionByName(rows).unionByName(middle)


@query("agg_04_scenario_summary", f"""WITH {SCENARIOS} SELECT scenario, is_abnormal, count(*) AS rows, min(a) AS a_low, max(a) AS a_high, min(b) AS b_low, max(b) AS b_high,
  count(*) - count(DISTINCT (a, b)) AS duplicate_rows FROM scen GROUP BY 1, 2""")
def scenario_summary(spark, d):
    """Duplicates are counted after equal rows collapsed to one counted row each."""
    folded = scenario_rows(spark, d).df.groupBy("scenario", "is_abnormal", "a", "b").agg(F.count("*").alias("n"))
    return folded.groupBy("scenario", "is_abnormal").agg(
        F.sum("n").alias("rows"), F.min("a").alias("a_low"), F.max("a").alias("a_high"), F.min("b").alias("b_low"),
        F.max("b").alias("b_high"), (F.sum("n") - F.count("*")).alias("duplicate_rows"))


@query("agg_05_class_summary", """SELECT p_type, count(*) AS rows, min(p_size) AS size_low, max(p_size) AS size_high, min(p_retailprice) AS price_low, max(p_retailprice) AS price_high,
  count(DISTINCT p_brand) AS brands FROM part GROUP BY 1""")
def class_summary(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.count("*").alias("rows"), F.min("p_size").alias("size_low"), F.max("p_size").alias("size_high"),
        F.min("p_retailprice").alias("price_low"), F.max("p_retailprice").alias("price_high"), F.count_distinct("p_brand").alias("brands"))


@query("agg_06_unit_lifetimes", f"""WITH {EV}, u AS (SELECT user_id, CAST(max(cycle) AS DOUBLE) AS life FROM ev GROUP BY 1) SELECT count(*) AS units, {rs('avg(life)')} AS mean,
  {rs('stddev_samp(life)')} AS std, min(life) AS shortest, max(life) AS longest, {rs('quantile_cont(life, 0.25)')} AS q25, {rs('quantile_cont(life, 0.5)')} AS median, {rs('quantile_cont(life, 0.75)')} AS q75 FROM u""")
def unit_lifetimes(spark, d):
    return rounded(profile.unit_lifetimes(event_series(spark, d).df, "user_id", "cycle"), ["mean", "std", "q25", "median", "q75"])


@query("agg_07_sensor_profile", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {rs(f'min({c})', 3)} AS low, {rs(f'max({c})', 3)} AS high, {rs(f'avg({c})', 4)} AS mean, {rs(f'stddev_samp({c})', 4)} AS std,
  count(DISTINCT {c}) AS distinct_values, {rs(f'max({c}) - min({c})', 3)} AS value_range, CAST(count(DISTINCT {c}) <= 1 AS INTEGER) AS constant,
  CAST(stddev_samp({c}) < 1e-6 AS INTEGER) AS near_constant FROM lineitem""" for c in CHANNELS))
def sensor_profile(spark, d):
    out = profile.column_profile(table(spark, d, "lineitem"), CHANNELS)
    out = rounded(rounded(out, ["low", "high", "value_range"], 3), ["mean", "std"], 4)
    return out.withColumns({"constant": flag("constant"), "near_constant": flag("near_constant")})


@query("agg_08_target_correlation", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {rs(f'corr({c}, l_extendedprice)')} AS correlation, {rs(f'abs(corr({c}, l_extendedprice))')} AS strength FROM lineitem"""
                                                         for c in ("l_quantity", "l_discount", "l_tax")))
def target_correlation(spark, d):
    out = profile.correlations(table(spark, d, "lineitem"), ("l_quantity", "l_discount", "l_tax"), "l_extendedprice")
    return rounded(out, ["correlation", "strength"])


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("agg_09_rank_correlation", f"""WITH k AS (SELECT {_rank_sql('p_size')} AS a, {_rank_sql('p_retailprice')} AS b, {_rank_sql('p_partkey')} AS c FROM part)
  SELECT 'p_size' AS feature, {rs('corr(a, b)')} AS rho FROM k UNION ALL SELECT 'p_partkey', {rs('corr(c, b)')} FROM k""")
def rank_correlation(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_partkey", "p_size", "p_retailprice")
    return rounded(profile.rank_correlations(parts, ["key"], ["p_size", "p_partkey"], "p_retailprice"), ["rho"])


@query("agg_10_grouped_summary", f"""SELECT p_brand, count(*) AS rows, min(p_retailprice) AS low, {rs('avg(p_retailprice)', 4)} AS mean, max(p_retailprice) AS high,
  {rs('quantile_cont(p_retailprice, 0.5)', 4)} AS median FROM part GROUP BY 1""")
def grouped_summary(spark, d):
    return rounded(profile.grouped_summary(table(spark, d, "part"), ["p_brand"], "p_retailprice"), ["mean", "median"], 4)


@query("agg_11_standardized_shift", f"""WITH {SCENARIOS}, n AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM scen WHERE scenario = 'view')
  SELECT scenario, 'a' AS feature, {rs('(avg(a) - any_value(ma)) / any_value(sa)')} AS shift FROM scen, n WHERE scenario <> 'view' GROUP BY 1
  UNION ALL SELECT scenario, 'b', {rs('(avg(b) - any_value(mb)) / any_value(sb)')} FROM scen, n WHERE scenario <> 'view' GROUP BY 1""")
def standardized_shift(spark, d):
    return rounded(profile.standardized_shift(scenario_rows(spark, d).df, "scenario", "view", ["a", "b"]), ["shift"])


@query("agg_12_life_stage_shift", f"""WITH {EV}, {_L} SELECT 'value' AS feature, {rs('avg(value) FILTER (rul > 40)')} AS healthy, {rs('avg(value) FILTER (rul <= 10)')} AS failing,
  {rs('stddev_samp(value)')} AS std, {rs('(avg(value) FILTER (rul <= 10) - avg(value) FILTER (rul > 40)) / stddev_samp(value)')} AS shift FROM l""")
def life_stage_shift(spark, d):
    return rounded(profile.life_stage_shift(lives(spark, d), "rul", ["value"], 40, 10), ["healthy", "failing", "std", "shift"])


@query("agg_13_life_fraction_bins", f"""WITH {EV}, b AS (SELECT CAST(greatest(ceil(cycle / CAST(max(cycle) OVER (PARTITION BY user_id) AS DOUBLE) * 20), 1) AS INTEGER) AS bin, value FROM ev),
  m AS (SELECT bin, avg(value) AS mean FROM b GROUP BY 1) SELECT 'value' AS feature, bin, {rs('mean')} AS mean,
  {rs('(mean - avg(mean) OVER ()) / stddev_samp(mean) OVER ()')} AS z FROM m""")
def life_fraction_bins(spark, d):
    df = event_series(spark, d).totals(last_cycle=F.max("cycle")).frame
    return rounded(profile.binned_profile(df, F.col("cycle") / F.col("last_cycle"), ["value"]), ["mean", "z"])


@query("agg_14_unit_label_quality", f"""WITH {HIST} SELECT o_custkey, count(*) AS rows, count(*) FILTER (valid_capacity) AS valid_rows, min(capacity) FILTER (valid_capacity) AS low,
  max(capacity) FILTER (valid_capacity) AS high, max(initial_valid_capacity) AS initial FROM hist GROUP BY 1""")
def unit_label_quality(spark, d):
    valid = F.when(F.col("valid_capacity"), F.col("capacity"))
    return histories(spark, d).groupBy("o_custkey").agg(
        F.count("*").alias("rows"), F.count(valid).alias("valid_rows"), F.min(valid).alias("low"), F.max(valid).alias("high"),
        F.max("initial_valid_capacity").alias("initial"))


_T = "list_transform(range(1, 65), lambda i: (i - 1) / 63.0 - 0.5)"


@query("agg_15_waveform_statistics", f"""WITH {WAVE}, u AS (SELECT cycle_id, unnest(samples) AS v, unnest({_T}) AS t FROM wave) SELECT cycle_id, {rs('avg(v)')} AS emb_mean, {rs('stddev_pop(v)')} AS emb_std,
  {rs('min(v)')} AS emb_min, {rs('max(v)')} AS emb_max, {rs('max(v) - min(v)')} AS emb_range, {rs('sqrt(avg(v * v))')} AS emb_rms, {rs('sum(v * t) / sum(t * t)')} AS emb_slope FROM u GROUP BY 1""")
def waveform_statistics(spark, d):
    out = waveform.waveform_table(waveform_rows(spark, d).withColumnRenamed("samples", "emb"), "cycle_id", ["emb"])
    return rounded(out, [c for c in out.columns if c != "cycle_id"])


@query("agg_16_sensor_feature_table", f"""WITH {WAVE}, s AS (SELECT cycle_id, samples[1:32] AS fast, samples[33:48] AS mid, samples[49:64] AS slow FROM wave)
  SELECT cycle_id, {', '.join(f"{rs(f'list_avg({n})')} AS {n}_mean, {rs(f'list_stddev_pop({n})')} AS {n}_std, {rs(f'list_max({n}) - list_min({n})')} AS {n}_range" for n in ('fast', 'mid', 'slow'))} FROM s""")
def sensor_feature_table(spark, d):
    """Three sensors recorded at different rates, joined by cycle."""
    rows = waveform_rows(spark, d)
    tables = [waveform.waveform_table(rows.select("cycle_id", F.slice("samples", start, n).alias(name)), "cycle_id", [name]).select(
        "cycle_id", *[f"{name}_{k}" for k in ("mean", "std", "range")]) for name, start, n in (("fast", 1, 32), ("mid", 33, 16), ("slow", 49, 16))]
    out = joins.side_by_side(tables, "cycle_id")
    return rounded(out, [c for c in out.columns if c != "cycle_id"])


@query("agg_17_phase_statistics", f"""WITH {WAVE}, c AS (SELECT cycle_id, samples, unnest(range(0, 16)) AS second FROM wave), p AS (SELECT cycle_id, second, samples[second * 4 + 1:second * 4 + 4] AS x, samples[1:4] AS x0 FROM c)
  SELECT cycle_id, CAST(second AS INTEGER) AS second, {rs('list_avg(x)')} AS phase_mean, {rs('list_stddev_pop(x)')} AS phase_std, {rs('list_avg(x) - list_avg(x0)')} AS phase_relative FROM p""")
def phase_statistics(spark, d):
    stats = waveform.phase_statistics(F.col("samples"), 16, 4, "emb")
    wide = waveform_rows(spark, d).select("cycle_id", *[c.alias(n) for n, c in stats.items()])
    long = wide.select("cycle_id", F.posexplode(F.arrays_zip(*stats)).alias("second", "v"))
    return long.select("cycle_id", "second", *[r(F.col("v")[f"emb_{k}"]).alias(k) for k in ("phase_mean", "phase_std", "phase_relative")])


_CURVE = {"voltage": "voltage", "current": "current", "temperature": "voltage", "load_current": "current", "load_voltage": "voltage", "time": "time"}
_CURVE_SQL = f"""WITH {SAMPLES}, s AS (SELECT *, lag(time) OVER o AS pt, lag(voltage) OVER o AS pv, lag(current) OVER o AS pc FROM samples WINDOW o AS (PARTITION BY user_id ORDER BY time, event_id))
  SELECT user_id, CAST(count(*) AS DOUBLE) AS sample_count, {rs('max(time) - min(time)', 3)} AS duration_seconds, {rs('arg_min(voltage, time)')} AS voltage_start, {rs('arg_max(voltage, time)')} AS voltage_end,
  {rs('min(voltage)')} AS voltage_min, {rs('max(voltage)')} AS voltage_max, {rs('avg(voltage)')} AS voltage_mean, {rs('stddev_pop(voltage)')} AS voltage_std, {rs('arg_min(voltage, time) - arg_max(voltage, time)')} AS voltage_drop,
  {rs('avg(abs(current))')} AS current_abs_mean, {rs('stddev_pop(current)')} AS current_std, {rs('arg_min(voltage, time)')} AS temperature_start, {rs('arg_max(voltage, time)')} AS temperature_end,
  {rs('avg(voltage)')} AS temperature_mean, {rs('max(voltage)')} AS temperature_max, {rs('arg_max(voltage, time) - arg_min(voltage, time)')} AS temperature_rise, {rs('avg(abs(current))')} AS load_current_abs_mean,
  {rs('avg(voltage)')} AS load_voltage_mean, {rs('min(voltage)')} AS load_voltage_min, {rs('sum((time - pt) * (abs(current) + abs(pc)) / 2) / 3600', 3)} AS charge_throughput_ah,
  {rs('sum((time - pt) * (voltage * abs(current) + pv * abs(pc)) / 2) / 3600', 2)} AS energy_throughput_wh FROM s GROUP BY 1 HAVING count(*) >= 2"""


def curve_table(spark, d):
    out = waveform.curve_features(sample_rows(spark, d), ["user_id"], _CURVE, ["time", "event_id"])
    digits = {"duration_seconds": 3, "charge_throughput_ah": 3, "energy_throughput_wh": 2}
    return out.select("user_id", *[r(c, digits.get(c, 6)).alias(c) for c in out.columns if c != "user_id"])


@query("agg_18_curve_features", _CURVE_SQL)
def curve_features(spark, d):
    return curve_table(spark, d)


@query("agg_18b_short_curves", """WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3)
  SELECT event_type, count(*) AS curves, count(*) FILTER (n < 2) AS short_curves, count(*) FILTER (n >= 2) AS featured FROM c GROUP BY 1""")
def short_curves(spark, d):
    """Curves of one sample are reported: with those that have features they make up all curves."""
    rows = sample_rows(spark, d).join(table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day")), "event_id")
    key = ["user_id", "event_type", "day"]
    every = rows.select(*key).distinct().groupBy("event_type").agg(F.count("*").alias("curves"))
    short = waveform.short_curves(rows, key).groupBy("event_type").agg(F.count("*").alias("short_curves"))
    have = waveform.curve_features(rows, key, _CURVE, ["time", "event_id"]).groupBy("event_type").agg(F.count("*").alias("featured"))
    return every.join(short, "event_type", "left").join(have, "event_type", "left").fillna(0)


@query("agg_19_feature_completeness", f"""WITH {SAMPLES}, c AS (SELECT user_id, count(*) AS n FROM samples GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
  SELECT count(*) AS units, count(*) FILTER (n >= 2) AS complete_units FROM u LEFT JOIN c USING (user_id)""")
def feature_completeness(spark, d):
    wanted = event_rows(spark, d).select("user_id").distinct()
    have = waveform.curve_features(sample_rows(spark, d), ["user_id"], _CURVE, ["time", "event_id"]).select("user_id", "sample_count")
    return wanted.join(have, "user_id", "left").agg(F.count("*").alias("units"), F.count("sample_count").alias("complete_units"))


@query("agg_20_trapezoid_integral", f"""WITH {SAMPLES}, s AS (SELECT user_id, (time - lag(time) OVER o) * (voltage + lag(voltage) OVER o) / 2 AS area FROM samples WINDOW o AS (PARTITION BY user_id ORDER BY time, event_id))
  SELECT user_id, {rs('sum(area) / 3600', 3)} AS integral FROM s GROUP BY 1""")
def trapezoid_integral(spark, d):
    s = series(sample_rows(spark, d), "user_id", ("time", "event_id")).trailing(2, lambda f: {
        "area": waveform.trapezoid(F.col("voltage"), F.col("time"), f.ordered)})
    return s.df.groupBy("user_id").agg(r(F.sum("area") / 3600, 3).alias("integral"))


@query("agg_21_cutoff_integral", f"""WITH {SAMPLES}, s AS (SELECT *, row_number() OVER o AS n, lag(time) OVER o AS pt, lag(voltage) OVER o AS pv, lag(abs(current)) OVER o AS pc, abs(current) AS c FROM samples
  WINDOW o AS (PARTITION BY user_id ORDER BY time, event_id)), k AS (SELECT *, min(n) FILTER (voltage <= 3) OVER (PARTITION BY user_id) AS k, (time - pt) * (c + pc) / 2 AS area FROM s),
  x AS (SELECT *, (pv - 3) / (pv - voltage) AS f FROM k)
  SELECT user_id, CASE WHEN max(k) IS NULL THEN 'no_observed_crossing' WHEN max(k) = 1 THEN 'starts_at_or_below_cutoff' ELSE 'crossing_observed' END AS status,
  {rs('coalesce(sum(area), 0) / 3600', 3)} AS full_throughput_ah, {rs('max(CASE WHEN n = k AND n > 1 THEN pt + f * (time - pt) END)', 3)} AS crossing_seconds,
  {rs('CASE WHEN max(k) > 1 THEN (coalesce(sum(area) FILTER (n < k), 0) + max(CASE WHEN n = k THEN f * (time - pt) * (pc + pc + f * (c - pc)) / 2 END)) / 3600 END', 3)} AS cutoff_interpolated_ah,
  {rs('CASE WHEN max(k) > 1 THEN coalesce(sum(area) FILTER (n < k), 0) / 3600 END', 3)} AS last_above_sample_ah,
  {rs('CASE WHEN max(k) > 1 THEN coalesce(sum(area) FILTER (n <= k), 0) / 3600 END', 3)} AS first_below_sample_ah FROM x GROUP BY 1""")
def cutoff_integral(spark, d):
    out = waveform.cutoff_integrals(sample_rows(spark, d), ["user_id"], "time", "voltage", "current", 3.0, ["time", "event_id"])
    return rounded(out, [c for c in out.columns if c not in ("user_id", "status")], 3)


@query("agg_22_raw_trace_check", f"""WITH {SAMPLES}, s AS (SELECT user_id, event_id, time, (time - lag(time) OVER o) * (abs(current) + abs(lag(current) OVER o)) / 2 AS area FROM samples WINDOW o AS (PARTITION BY user_id ORDER BY time, event_id)),
  t AS (SELECT user_id, event_id, area, row_number() OVER (PARTITION BY user_id ORDER BY time DESC, event_id DESC) AS n FROM s) SELECT user_id, event_id, {rs('area / 3600', 4)} AS recent_area FROM t WHERE n <= 3""")
def raw_trace_check(spark, d):
    """Area of each unit's last three segments, taken again from the raw samples."""
    from ..operators.causal import last_rows

    s = series(sample_rows(spark, d), "user_id", ("time", "event_id")).trailing(2, lambda f: {
        "area": waveform.trapezoid(F.abs("current"), F.col("time"), f.ordered)})
    return last_rows(s.frame, ["user_id"], [F.desc("time"), F.desc("event_id")], 3).select(
        "user_id", "event_id", r(F.col("area") / 3600, 4).alias("recent_area"))


@query("agg_23_support_bounds", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {rs(f'min({c})')} AS hard_min, {rs(f'max({c})')} AS hard_max, {rs(f'quantile_cont({c}, 0.01)', 4)} AS q01,
  {rs(f'quantile_cont({c}, 0.99)', 4)} AS q99 FROM lineitem""" for c in CHANNELS))
def support_bounds(spark, d):
    out = rounded(profile.support_bounds(table(spark, d, "lineitem"), CHANNELS), ["hard_min", "hard_max"])
    return rounded(out, ["q01", "q99"], 4)


@query("agg_24_higher_quantile", """WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
  SELECT event_type, max(value) FILTER (n = ceil(CAST(0.95 AS DOUBLE) * (c - 1)) + 1) AS q95, max(value) FILTER (n = ceil(CAST(0.99 AS DOUBLE) * (c - 1)) + 1) AS q99 FROM k GROUP BY 1""")
def higher_quantile(spark, d):
    return quantiles(event_rows(spark, d), ["event_type"], {"q95": ("value", .95, higher(.95)), "q99": ("value", .99, higher(.99))})


@query("agg_25_conformal_radius", f"""WITH {SCORED}, e AS (SELECT fold, abs(predicted - actual) AS e FROM scored), k AS (SELECT fold, e, row_number() OVER (PARTITION BY fold ORDER BY e) AS n, count(*) OVER (PARTITION BY fold) AS c FROM e)
  SELECT fold, {rs('max(e) FILTER (n = least(ceil((c + 1) * CAST(0.9 AS DOUBLE)), c))')} AS radius90, {rs('max(e) FILTER (n = least(ceil((c + 1) * CAST(0.95 AS DOUBLE)), c))')} AS radius95 FROM k GROUP BY 1""")
def conformal_radius(spark, d):
    errors = scored_rows(spark, d).select("fold", F.abs(F.col("predicted") - F.col("actual")).alias("e"))
    out = quantiles(errors, ["fold"], {"radius90": ("e", .9, conformal(.1)), "radius95": ("e", .95, conformal(.05))})
    return rounded(out, ["radius90", "radius95"])


_ROBUST = lambda c: f"""SELECT '{c}' AS feature, scenario, m AS centre, greatest(CASE WHEN d * 1.4826 > 1e-9 THEN d * 1.4826 ELSE s END, 1e-6) AS scale FROM
  (SELECT scenario, any_value(m) AS m, quantile_cont(abs({c} - m), 0.5) AS d, stddev_pop({c}) AS s FROM (SELECT scenario, {c}, quantile_cont({c}, 0.5) OVER (PARTITION BY scenario) AS m FROM scen) GROUP BY 1)"""


@query("agg_26_robust_scale", f"""WITH {SCENARIOS}, u AS ({_ROBUST('a')} UNION ALL {_ROBUST('b')}) SELECT feature, scenario, {rs('centre')} AS centre, {rs('scale')} AS scale FROM u""")
def robust_scale(spark, d):
    long = profile.melt(scenario_rows(spark, d).df, ["scenario"], ["a", "b"])
    return rounded(profile.robust_scale(long, ["feature", "scenario"]), ["centre", "scale"])


@query("agg_27_adjacent_noise", f"""WITH {SCENARIOS}, x AS (SELECT scenario, a - lag(a) OVER (PARTITION BY scenario ORDER BY position) AS dif FROM scen), m AS (SELECT scenario, dif, quantile_cont(dif, 0.5) OVER (PARTITION BY scenario) AS c FROM x WHERE dif IS NOT NULL)
  SELECT scenario, {rs('greatest(quantile_cont(abs(dif - c), 0.5) * 1.4826 / sqrt(2.0), 1e-3)')} AS noise FROM m GROUP BY 1""")
def adjacent_noise(spark, d):
    s = scenario_rows(spark, d).trailing(2, lambda f: {"dif": F.when(
        F.col("position") - F.lag("position").over(f.ordered) == 1, F.col("a") - F.lag("a").over(f.ordered))})
    return rounded(profile.adjacent_noise(s.df.filter(F.col("dif").isNotNull()), ["scenario"], "dif"), ["noise"])


@query("agg_28_template_scale", f"""WITH s AS (SELECT stddev_pop(l_quantity) AS q, stddev_pop(l_discount) AS d, stddev_pop(l_orderkey - l_orderkey) AS z FROM lineitem) SELECT {rs('q')} AS l_quantity, {rs('d')} AS l_discount, {rs('(q + d) / 2')} AS flat FROM s""")
def template_scale(spark, d):
    rows = table(spark, d, "lineitem").withColumn("flat", (F.col("l_orderkey") - F.col("l_orderkey")).cast("double"))
    return rounded(profile.template_scale(rows, ["l_quantity", "l_discount", "flat"]), ["l_quantity", "l_discount", "flat"])


_LW = f"""{SCENARIOS}, c AS (SELECT a - avg(a) OVER () AS x, b - avg(b) OVER () AS y FROM scen), m AS (SELECT count(*) AS n, avg(x * x) AS sxx, avg(x * y) AS sxy, avg(y * y) AS syy,
  sum(x*x*x*x) + 2 * sum(x*x*y*y) + sum(y*y*y*y) AS quart FROM c), k AS (SELECT *, (sxx + syy) / 2 AS mu, sxx*sxx + 2*sxy*sxy + syy*syy AS fro FROM m),
  z AS (SELECT *, (fro - 2 * mu * (sxx + syy) + 2 * mu * mu) / 2 AS dist, (quart / n - fro) / (2 * n) AS beta FROM k), q AS (SELECT *, least(beta, dist) / dist AS shrinkage FROM z)"""


@query("agg_29_shrunk_covariance", f"""WITH {_LW} SELECT {rs('shrinkage', 8)} AS shrinkage, {rs('(1 - shrinkage) * sxx + shrinkage * mu', 4)} AS aa, {rs('(1 - shrinkage) * sxy', 4)} AS ab, {rs('(1 - shrinkage) * syy + shrinkage * mu', 4)} AS bb FROM q""")
def shrunk_covariance(spark, d):
    rows = scenario_rows(spark, d).df
    covariance, _, shrinkage = profile.shrunk_covariance(rows, ["a", "b"])
    values = {"shrinkage": (shrinkage, 8), "aa": (covariance[0, 0], 4), "ab": (covariance[0, 1], 4), "bb": (covariance[1, 1], 4)}
    return spark.range(1).select(*[r(F.lit(float(v)), k).alias(n) for n, (v, k) in values.items()])


@query("agg_30_group_shares", f"""SELECT o_custkey, count(*) AS rows, {rs('count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE)', 9)} AS share FROM orders GROUP BY 1""")
def group_shares(spark, d):
    return profile.group_shares(table(spark, d, "orders"), ["o_custkey"]).withColumn("share", r("share", 9))


@query("agg_31_equal_group_weights", f"""WITH w AS (SELECT event_id, 1.0 / count(*) OVER (PARTITION BY user_id) AS w FROM events) SELECT event_id, {rs('w / avg(w) OVER ()', 9)} AS weight FROM w""")
def equal_group_weights(spark, d):
    out = profile.equal_group_weights(event_rows(spark, d), ["user_id"])
    return out.select("event_id", r("weight", 9).alias("weight"))


@query("agg_32_mixture_weights", f"""WITH u AS (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS k FROM events), s AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
  SELECT event_id, {rs("CASE event_type WHEN 'view' THEN 0.6 ELSE 0.1 END / n / k", 9)} AS weight FROM u JOIN s USING (event_type)""")
def mixture_weights(spark, d):
    shares = {"view": 0.6, "click": 0.1, "error": 0.1, "purchase": 0.1, "signup": 0.1}
    out = profile.mixture_weights(event_rows(spark, d), "event_type", "user_id", shares)
    return out.select("event_id", r("weight", 9).alias("weight"))


@query("agg_33_banded_weights", f"""WITH {EV}, {_L} SELECT event_id, CASE WHEN rul <= 30 THEN 4.0::DOUBLE WHEN rul <= 60 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM l""")
def banded_weights(spark, d):
    return lives(spark, d).select("event_id", profile.banded_weights(F.col("rul")).alias("weight"))


@query("agg_34_level_counts", """SELECT CASE WHEN event_type = 'error' THEN 'Critical' WHEN value > 100 THEN 'Caution' ELSE 'Monitor' END AS level, count(*) AS rows FROM events GROUP BY 1""")
def level_counts(spark, d):
    level = F.when(F.col("event_type") == "error", "Critical").when(F.col("value") > 100, "Caution").otherwise("Monitor")
    return event_rows(spark, d).groupBy(level.alias("level")).agg(F.count("*").alias("rows"))
