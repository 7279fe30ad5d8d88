"""Ordered-window and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import wall_micros
from ..operators import causal, labels
from ..operators.series import series
from .inputs import (CHANNELS, EV, HIST, OW, SCENARIOS, SHIP, event_rows, event_series, order_histories,
                     scenario_rows, shipment_series, tail)
from .registry import flag, query, r, rounded, rs

KEY = ["user_id", "cycle"]


@query("win_01_first_difference", f"""WITH {EV} SELECT user_id, cycle,
  {rs('coalesce(value - lag(value) OVER o, 0)')} AS value_delta FROM ev {OW}""")
def first_difference(spark, d):
    s = causal.first_difference(event_series(spark, d), ["value"])
    return s.frame.select(*KEY, r("value_delta").alias("value_delta"))


@query("win_02_trailing_mean", f"""WITH {EV} SELECT user_id, cycle, {rs('avg(value) OVER t5')} AS value_mean_5,
  {rs('avg(value) OVER t10')} AS value_mean_10, {rs('avg(value) OVER t15')} AS value_mean_15
  FROM ev WINDOW {tail(5, 't5')}, {tail(10, 't10')}, {tail(15, 't15')}""")
def trailing_mean(spark, d):
    names = [f"value_mean_{w}" for w in (5, 10, 15)]
    s = causal.trailing_mean(event_series(spark, d), ["value"], (5, 10, 15))
    return rounded(s.frame.select(*KEY, *names), names)


@query("win_02b_trailing_mean_channels", f"""WITH {SHIP} SELECT l_suppkey, cycle,
  {', '.join(f"{rs(f'avg({c}) OVER t')} AS {c}_mean_5" for c in CHANNELS)} FROM ship
  WINDOW t AS (PARTITION BY l_suppkey ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def trailing_mean_channels(spark, d):
    names = [f"{c}_mean_5" for c in CHANNELS]
    s = causal.trailing_mean(shipment_series(spark, d), CHANNELS, (5,))
    return rounded(s.frame.select("l_suppkey", "cycle", *names), names)


@query("win_03_trailing_std", f"""WITH {EV} SELECT user_id, cycle, {rs('greatest(stddev_pop(value) OVER t5, 0)')} AS value_std_5,
  {rs('greatest(stddev_pop(value) OVER t10, 0)')} AS value_std_10, {rs('greatest(stddev_pop(value) OVER t30, 0)')} AS value_std_30
  FROM ev WINDOW {tail(5, 't5')}, {tail(10, 't10')}, {tail(30, 't30')}""")
def trailing_std(spark, d):
    names = [f"value_std_{w}" for w in (5, 10, 30)]
    s = causal.trailing_std(event_series(spark, d), ["value"], (5, 10, 30))
    return rounded(s.frame.select(*KEY, *names), names)


@query("win_04_trailing_median", f"""WITH {EV} SELECT user_id, cycle, {rs('quantile_cont(value, 0.5) OVER t3')} AS value_median_3,
  {rs('quantile_cont(value, 0.5) OVER t5')} AS value_median_5 FROM ev WINDOW {tail(3, 't3')}, {tail(5, 't5')}""")
def trailing_median(spark, d):
    names = ["value_median_3", "value_median_5"]
    s = causal.trailing_median(event_series(spark, d), ["value"], (3, 5))
    return rounded(s.frame.select(*KEY, *names), names)


@query("win_05_trailing_mad", f"""WITH {EV}, w AS (SELECT user_id, cycle, list(value) OVER t AS v,
  quantile_cont(value, 0.5) OVER t AS m FROM ev WINDOW {tail(7)})
  SELECT user_id, cycle, {rs("list_aggregate(list_transform(v, lambda x: abs(x - m)), 'median')")} AS mad7 FROM w""")
def trailing_mad(spark, d):
    s = causal.trailing_mad(event_series(spark, d), "value", 7, "mad7")
    return s.frame.select(*KEY, r("mad7").alias("mad7"))


def _ewm_sql(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"""walk{span} AS (SELECT user_id, cycle, value AS y FROM ev WHERE cycle = 1 UNION ALL
      SELECT e.user_id, e.cycle, {a!r} * e.value + {1 - a!r} * p.y FROM walk{span} p
      JOIN ev e ON e.user_id = p.user_id AND e.cycle = p.cycle + 1)"""


@query("win_06_exponential_mean", f"""WITH RECURSIVE {EV}, {_ewm_sql(5)}, {_ewm_sql(20)}
  SELECT a.user_id, a.cycle, {rs('a.y')} AS ewm5, {rs('b.y')} AS ewm20 FROM walk5 a
  JOIN walk20 b ON a.user_id = b.user_id AND a.cycle = b.cycle""")
def exponential_mean(spark, d):
    s = event_series(spark, d).ewm({"ewm5": ("value", 5), "ewm20": ("value", 20)})
    return rounded(s.frame.select(*KEY, "ewm5", "ewm20"), ["ewm5", "ewm20"])


@query("win_07_growing_baseline", f"""WITH {EV} SELECT user_id, cycle,
  {rs('avg(value) FILTER (WHERE cycle <= 10) OVER u')} AS value_baseline,
  {rs('quantile_cont(value, 0.5) FILTER (WHERE cycle <= 5) OVER u')} AS median_baseline FROM ev
  WINDOW u AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def growing_baseline(spark, d):
    s = causal.growing_mean_baseline(event_series(spark, d), ["value"], 10)
    s = causal.growing_median_baseline(s, "value", "median_baseline", 5)
    return rounded(s.frame.select(*KEY, "value_baseline", "median_baseline"), ["value_baseline", "median_baseline"])


@query("win_08_relative_to_first", f"""WITH {EV} SELECT user_id, cycle,
  {rs('value - first_value(value) OVER o')} AS value_relative_first FROM ev {OW}""")
def relative_to_first(spark, d):
    s = causal.difference_from_first(event_series(spark, d), ["value"])
    return s.frame.select(*KEY, r("value_relative_first").alias("value_relative_first"))


@query("win_09_lagged_slope", f"""WITH {EV} SELECT user_id, cycle,
  {', '.join(f"{rs(f'coalesce((value - lag(value, {k}) OVER o) / (cycle - lag(cycle, {k}) OVER o), 0)')} AS value_slope_{k}" for k in (4, 14, 20, 50))}
  FROM ev {OW}""")
def lagged_slope(spark, d):
    names = [f"value_slope_{k}" for k in (4, 14, 20, 50)]
    s = causal.lagged_slope(event_series(spark, d), "value", "cycle", (4, 14, 20, 50))
    return rounded(s.frame.select(*KEY, *names), names)


@query("win_10_regression_slope", f"""WITH {EV} SELECT user_id, cycle,
  {', '.join(f"{rs(f'CASE WHEN cycle = 1 THEN 0 ELSE regr_slope(value, cycle) OVER t{w} END')} AS slope_{w}" for w in (5, 15, 30))}
  FROM ev WINDOW {', '.join(tail(w, f't{w}') for w in (5, 15, 30))}""")
def regression_slope(spark, d):
    names = [f"slope_{w}" for w in (5, 15, 30)]
    s = causal.regression_slope(event_series(spark, d), "value", "cycle", (5, 15, 30), "slope")
    return rounded(s.frame.select(*KEY, *names), names)


def _theil_sql(window: int) -> str:
    pairs = f"""flatten(list_transform(range(1, len(v) + 1), lambda i: list_transform(range(i + 1, len(v) + 1),
      lambda j: (v[j] - v[i]) / (j - i))))"""
    return f"""th{window} AS (SELECT user_id, cycle, coalesce(list_aggregate({pairs}, 'median'), 0) AS s FROM
      (SELECT user_id, cycle, list(value) OVER t AS v FROM ev WINDOW {tail(window)}))"""


@query("win_11_theil_sen_slope", f"""WITH {EV}, {_theil_sql(7)}, {_theil_sql(21)} SELECT a.user_id, a.cycle,
  {rs('a.s', 9)} AS robust_slope_7, {rs('b.s', 9)} AS robust_slope_21 FROM th7 a JOIN th21 b
  ON a.user_id = b.user_id AND a.cycle = b.cycle""")
def theil_sen_slope(spark, d):
    names = ["robust_slope_7", "robust_slope_21"]
    s = causal.theil_sen_slope(event_series(spark, d), "value", "cycle", (7, 21), "robust_slope")
    return rounded(s.frame.select(*KEY, *names), names, 9)


@query("win_12_life_proxy", f"""WITH {EV}, w AS (SELECT user_id, cycle, avg(value) OVER t5 - 10 AS margin,
  CASE WHEN cycle = 1 THEN 0 ELSE regr_slope(value, cycle) OVER t15 END AS slope FROM ev WINDOW {tail(5, 't5')}, {tail(15, 't15')})
  SELECT user_id, cycle, {rs('margin')} AS margin, CAST(slope < -1e-4 AS INTEGER) AS declining,
  {rs('least(greatest(CASE WHEN slope < -1e-4 THEN margin / -least(slope, -1e-4) ELSE 500 END, 0), 500)', 4)} AS life_proxy FROM w""")
def life_proxy(spark, d):
    s = causal.trailing_mean(event_series(spark, d), ["value"], (5,))
    s = causal.regression_slope(s, "value", "cycle", (15,), "slope")
    margin, slope = F.col("value_mean_5") - 10, F.col("slope_15")
    return s.frame.select(*KEY, r(margin).alias("margin"), flag(causal.declining(slope)).alias("declining"),
                          r(causal.life_proxy(margin, slope), 4).alias("life_proxy"))


@query("win_13_history_count", f"""WITH {EV} SELECT user_id, event_id, cycle AS history_count FROM ev""")
def history_count(spark, d):
    return series(event_rows(spark, d), "user_id", ("ts", "event_id")).number("history_count").frame.select(
        "user_id", "event_id", "history_count")


# Segments: the day number is the position, so a day without an event opens a new segment.
_DAYS = """days AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events)"""
_SEG = _DAYS + """, brk AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <> 1 THEN 1 ELSE 0 END AS b FROM days),
seg AS (SELECT user_id, day, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM brk)"""


def active_days(spark, d):
    day = F.floor(wall_micros(F.col("ts")) / 86400e6).cast("long")
    return event_rows(spark, d).select("user_id", day.alias("day")).distinct()


@query("win_14_segments", f"WITH {_SEG} SELECT * FROM seg")
def segments(spark, d):
    s = causal.segments(series(active_days(spark, d), "user_id", "day"), "day")
    return s.frame.select("user_id", "day", F.col("segment").cast("long").alias("segment"))


@query("win_15_causal_persistence", f"""WITH {EV}, v AS (SELECT *, CAST(value > 30 AS INTEGER) AS vote FROM ev)
  SELECT user_id, cycle, vote, CAST(sum(vote) OVER t5 >= 3 AS INTEGER) AS alert_3_of_5,
  CAST(sum(vote) OVER t7 >= 4 AS INTEGER) AS alert_4_of_7 FROM v WINDOW {tail(5, 't5')}, {tail(7, 't7')}""")
def causal_persistence(spark, d):
    s = event_series(spark, d).select(vote=flag(F.col("value") > 30))
    s = causal.persistence(causal.persistence(s, "vote", 5, 3, "alert_3_of_5"), "vote", 7, 4, "alert_4_of_7")
    return s.frame.select(*KEY, "vote", "alert_3_of_5", "alert_4_of_7")


@query("win_15b_segmented_persistence", f"""WITH {_SEG}, dv AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day,
  CAST(max(value) > 40 AS INTEGER) AS vote FROM events GROUP BY 1, 2)
  SELECT user_id, day, segment, CAST(sum(vote) OVER (PARTITION BY user_id, segment ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS INTEGER) AS alert
  FROM seg JOIN dv USING (user_id, day)""")
def segmented_persistence(spark, d):
    day = F.floor(wall_micros(F.col("ts")) / 86400e6).cast("long")
    votes = event_rows(spark, d).groupBy("user_id", day.alias("day")).agg(flag(F.max("value") > 40).alias("vote"))
    s = causal.segmented_persistence(votes, ["user_id"], "day", "vote", 5, 3)
    return s.frame.select("user_id", "day", F.col("segment").cast("long").alias("segment"), "alert")


@query("win_16_terminal_rows", f"""WITH {EV} SELECT user_id, event_id, cycle, value FROM ev
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cycle DESC) = 1""")
def terminal_rows(spark, d):
    return causal.terminal_rows(event_series(spark, d).frame, ["user_id"], ["cycle"]).select("user_id", "event_id", "cycle", "value")


@query("win_17_last_three_rows", """SELECT user_id, event_id, CAST(rn AS INTEGER) AS row_from_end FROM (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def last_three_rows(spark, d):
    return causal.last_rows(event_rows(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select(
        "user_id", "event_id", "row_from_end")


@query("win_18_checkpoints", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
  SELECT user_id, cycle, value FROM n WHERE list_contains([{', '.join(f'greatest(1, CAST(ceil(CAST({f} AS DOUBLE) * c) AS BIGINT))' for f in (0.2, 0.4, 0.6, 0.8, 1.0))}], cycle)""")
def checkpoints(spark, d):
    return causal.checkpoints(event_series(spark, d)).select("user_id", "cycle", "value")


@query("win_19_mission_phase", f"""WITH {EV}, p AS (SELECT user_id, cycle,
  (cycle - 1) / CAST(greatest(max(cycle) OVER (PARTITION BY user_id) - 1, 1) AS DOUBLE) AS phase FROM ev)
  SELECT user_id, cycle, {rs('phase')} AS phase, {rs('sin(2 * pi() * phase)')} AS phase_sin, {rs('cos(2 * pi() * phase)')} AS phase_cos,
  CAST(least(floor(phase * 6), 5) AS INTEGER) AS phase_bin FROM p""")
def mission_phase(spark, d):
    s = causal.mission_phase(event_series(spark, d), "cycle")
    return rounded(s.frame.select(*KEY, "phase", "phase_sin", "phase_cos", "phase_bin"), ["phase", "phase_sin", "phase_cos"])


@query("win_20_unit_maximum", f"""WITH {EV} SELECT user_id, cycle, max(cycle) OVER (PARTITION BY user_id) AS last_cycle,
  max(value) OVER (PARTITION BY user_id) AS peak FROM ev""")
def unit_maximum(spark, d):
    return event_series(spark, d).totals(last_cycle=F.max("cycle"), peak=F.max("value")).frame.select(*KEY, "last_cycle", "peak")


@query("win_21_class_transitions", f"""WITH {EV} SELECT user_id, cycle,
  CAST(coalesce(event_type <> lag(event_type) OVER o, false) AS INTEGER) AS changed FROM ev {OW}""")
def class_transitions(spark, d):
    return causal.transitions(event_series(spark, d), "event_type").frame.select(*KEY, "changed")


@query("win_22_first_alert", f"""WITH {EV}, v AS (SELECT user_id, cycle, sum(CAST(value > 60 AS INTEGER)) OVER t >= 2 AS alert FROM ev WINDOW {tail(4)})
  SELECT user_id, CAST(min(cycle) FILTER (WHERE alert) AS DOUBLE) AS first_alert FROM v GROUP BY user_id""")
def first_alert(spark, d):
    s = causal.persistence(event_series(spark, d).select(vote=flag(F.col("value") > 60)), "vote", 4, 2)
    return s.df.groupBy("user_id").agg(F.min(F.when(F.col("alert") == 1, F.col("cycle"))).cast("double").alias("first_alert"))


@query("win_23_last_three_flags", """WITH f AS (SELECT user_id, CAST(value > 20 AS INTEGER) AS flag,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  SELECT user_id, CAST(sum(flag) AS BIGINT) AS flagged, CAST(sum(flag) FILTER (WHERE rn <= 3) = 3 AS INTEGER) AS persistent_last_three FROM f GROUP BY user_id""")
def last_three_flags(spark, d):
    s = event_series(spark, d).select(vote=flag(F.col("value") > 20)).trailing(
        3, lambda f: {"recent": F.sum("vote").over(f.last(3))})
    return s.df.groupBy("user_id").agg(F.sum("vote").alias("flagged"),
                                       flag(F.max_by("recent", "cycle") == 3).alias("persistent_last_three"))


@query("win_24_contiguous_blocks", f"""WITH {EV} SELECT user_id, cycle,
  CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY cycle) - 1 AS INTEGER) AS block FROM ev""")
def contiguous_blocks(spark, d):
    return causal.contiguous_blocks(event_series(spark, d), 4).frame.select(*KEY, "block")


# -- labels ----------------------------------------------------------------------------
@query("lbl_01_remaining_life", f"WITH {EV} SELECT user_id, cycle, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul FROM ev")
def remaining_life(spark, d):
    return labels.remaining_life(event_series(spark, d), "cycle").frame.select(*KEY, "rul")


@query("lbl_02_truncated_life", f"""WITH {EV}, extra AS (SELECT user_id, CAST(count(*) AS BIGINT) AS additional_rul FROM events
  WHERE event_type = 'error' GROUP BY 1) SELECT user_id, cycle, additional_rul + max(cycle) OVER (PARTITION BY user_id) - cycle AS rul
  FROM ev LEFT JOIN extra USING (user_id)""")
def truncated_life(spark, d):
    extra = event_rows(spark, d).filter(F.col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("additional_rul"))
    return labels.truncated_life(event_series(spark, d), "cycle", extra).frame.select(*KEY, "rul")


@query("lbl_03_discharge_number", f"WITH {HIST} SELECT o_custkey, o_orderkey, discharge_cycle FROM hist")
def discharge_number(spark, d):
    return order_histories(spark, d).number("discharge_cycle").frame.select("o_custkey", "o_orderkey", "discharge_cycle")


@query("lbl_04_state_of_health", f"""WITH {HIST} SELECT o_custkey, o_orderkey, CAST(valid_capacity AS INTEGER) AS valid_capacity,
  {rs('soh_percent', 3)} AS soh_percent FROM hist""")
def state_of_health(spark, d):
    h = labels.discharge_histories(order_histories(spark, d)).frame
    return h.select("o_custkey", "o_orderkey", flag("valid_capacity").alias("valid_capacity"), r("soh_percent", 3).alias("soh_percent"))


@query("lbl_05_end_of_life", f"""WITH {HIST} SELECT o_custkey, o_orderkey, eol_capacity, initial_valid_capacity, CAST(observed_eol_cycle AS DOUBLE) AS observed_eol_cycle FROM hist""")
def end_of_life(spark, d):
    return labels.discharge_histories(order_histories(spark, d)).frame.select(
        "o_custkey", "o_orderkey", "eol_capacity", "initial_valid_capacity",
        F.col("observed_eol_cycle").cast("double").alias("observed_eol_cycle"))


@query("lbl_06_censor_status", f"""WITH {HIST} SELECT o_custkey, o_orderkey, CAST(rul_cycles AS DOUBLE) AS rul_cycles, CAST(at_or_after_eol AS INTEGER) AS at_or_after_eol,
  rul_label_status, CAST(rul_training_eligible AS INTEGER) AS rul_training_eligible FROM hist""")
def censor_status(spark, d):
    h = labels.discharge_histories(order_histories(spark, d)).frame
    return h.select("o_custkey", "o_orderkey", F.col("rul_cycles").cast("double").alias("rul_cycles"), flag("at_or_after_eol").alias("at_or_after_eol"), "rul_label_status",
                    flag("rul_training_eligible").alias("rul_training_eligible"))


@query("lbl_07_scenario_label", """SELECT event_type AS scenario, CAST(event_type <> 'view' AS INTEGER) AS is_abnormal, count(*) AS rows
  FROM events GROUP BY 1, 2""")
def scenario_label(spark, d):
    return scenario_rows(spark, d).df.groupBy("scenario", "is_abnormal").agg(F.count("*").alias("rows"))


_PHASE = "CASE WHEN cycle / CAST(cycle + rul AS DOUBLE) <= 1.0 / 3 THEN 'early' WHEN cycle / CAST(cycle + rul AS DOUBLE) <= 2.0 / 3 THEN 'middle' ELSE 'late' END"


@query("lbl_08_life_phase", f"""WITH {EV}, l AS (SELECT *, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul FROM ev)
  SELECT user_id, cycle, {_PHASE} AS phase, CASE WHEN rul <= 30 THEN '0-30' WHEN rul <= 100 THEN '31-100' ELSE '>100' END AS rul_band FROM l""")
def life_phase(spark, d):
    s = labels.remaining_life(event_series(spark, d), "cycle")
    return s.frame.select(*KEY, labels.life_phase(F.col("cycle"), F.col("rul")).alias("phase"), labels.rul_band(F.col("rul")).alias("rul_band"))


@query("lbl_09_trajectory_third", f"""WITH {SCENARIOS} SELECT scenario, position, CASE WHEN position > 0 AND position <= 57 THEN 'first'
  WHEN position > 57 AND position <= 114 THEN 'second' WHEN position > 114 AND position <= 171 THEN 'third' END AS third FROM scen""")
def trajectory_third(spark, d):
    return scenario_rows(spark, d).frame.select("scenario", "position", labels.trajectory_third(F.col("position")).alias("third"))
