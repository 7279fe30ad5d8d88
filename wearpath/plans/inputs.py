"""How the standard tables play the roles of the sensor datasets, in Spark and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import wall_micros
from ..operators.series import Series, series
from ..session import table


def epoch_seconds(column: str = "ts") -> Column:
    return wall_micros(F.col(column)) / 1e6


# -- one-channel trajectories: a user's events in time order ---------------------------
def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type", "value")


def event_series(spark, folder) -> Series:
    return series(event_rows(spark, folder), "user_id", ("ts", "event_id")).number("cycle")


EV = """ev AS (SELECT user_id, event_id, ts, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cycle FROM events)"""
# One ordered window per user, for SQL texts that select FROM ev.
OW = "WINDOW o AS (PARTITION BY user_id ORDER BY cycle)"


def tail(rows: int, name: str = "t") -> str:
    return f"{name} AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


# -- two-channel samples: event value and the number inside props ----------------------
def sample_rows(spark, folder) -> DataFrame:
    """Curves per user: time in seconds, voltage = value, current = props.k."""
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, folder, "events").select(
        "user_id", "event_id", "event_type", epoch_seconds().alias("time"), F.col("value").alias("voltage"),
        k.cast("double").alias("current"))


SAMPLES = """samples AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS time, value AS voltage,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS current FROM events)"""


def scenario_rows(spark, folder) -> Series:
    """Scenario trajectories: event type as scenario ('view' is normal), two channels a and b."""
    rows = sample_rows(spark, folder).select(
        F.col("event_type").alias("scenario"), "time", "event_id", F.col("voltage").alias("a"), F.col("current").alias("b"))
    s = series(rows, "scenario", ("time", "event_id")).number("position")
    return s.select(is_abnormal=(F.col("scenario") != "view").cast("int"))


SCENARIOS = SAMPLES + """, scen AS (SELECT event_type AS scenario, time, event_id, voltage AS a, current AS b,
  row_number() OVER (PARTITION BY event_type ORDER BY time, event_id) AS position,
  CAST(event_type <> 'view' AS INTEGER) AS is_abnormal FROM samples)"""
FAULTS = ("click", "error", "purchase", "signup")


# -- several channels: a supplier's shipments ------------------------------------------
CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SHIP_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def shipment_series(spark, folder) -> Series:
    rows = table(spark, folder, "lineitem").select("l_suppkey", *SHIP_ORDER)
    return series(rows, "l_suppkey", SHIP_ORDER).number("cycle")


SHIP = f"""ship AS (SELECT l_suppkey, {', '.join(SHIP_ORDER)},
  row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(SHIP_ORDER)}) AS cycle FROM lineitem)"""


# -- end-of-life histories: a customer's orders ----------------------------------------
# Threshold per market segment; FURNITURE has none.
SEGMENT_LIMITS = {"AUTOMOBILE": 60000.0, "BUILDING": 120000.0, "HOUSEHOLD": 200000.0, "MACHINERY": 300000.0}


def order_histories(spark, folder) -> Series:
    """Capacity is the order total; pending orders have none."""
    limits = reduce(lambda acc, kv: acc.when(F.col("c_mktsegment") == kv[0], F.lit(kv[1])),
                    SEGMENT_LIMITS.items(), F.when(F.lit(False), F.lit(0.0)))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), limits.alias("eol_capacity"))
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("capacity"))
    return series(orders.join(customers, "o_custkey", "left"), "o_custkey", ("o_orderdate", "o_orderkey"))


_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_LIMITS.items())
HIST = f"""base AS (SELECT o_custkey, o_orderkey, o_orderdate,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS capacity,
    CAST(CASE c_mktsegment {_CASES} END AS DOUBLE) AS eol_capacity
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
n1 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS discharge_cycle,
    (capacity IS NOT NULL AND capacity > 0) AS valid_capacity FROM base),
n2 AS (SELECT *, arg_min(capacity, discharge_cycle) FILTER (WHERE valid_capacity) OVER (PARTITION BY o_custkey)
    AS initial_valid_capacity FROM n1),
n3 AS (SELECT *, min(discharge_cycle) FILTER (WHERE valid_capacity AND initial_valid_capacity > eol_capacity
    AND capacity <= eol_capacity) OVER (PARTITION BY o_custkey) AS observed_eol_cycle FROM n2),
hist AS (SELECT *, CASE WHEN valid_capacity THEN capacity / 2.0 * 100.0 END AS soh_percent,
    CASE WHEN observed_eol_cycle IS NOT NULL THEN greatest(observed_eol_cycle - discharge_cycle, 0) END AS rul_cycles,
    coalesce(discharge_cycle >= observed_eol_cycle, false) AS at_or_after_eol,
    CASE WHEN observed_eol_cycle IS NOT NULL THEN 'observed_eol' WHEN eol_capacity IS NULL THEN 'no_documented_threshold'
      WHEN coalesce(initial_valid_capacity <= eol_capacity, false) THEN 'starts_at_or_below_threshold'
      ELSE 'right_censored' END AS rul_label_status,
    valid_capacity AND coalesce(discharge_cycle <= observed_eol_cycle, false) AS rul_training_eligible FROM n3)"""


# -- scored rows: life left against a prediction ---------------------------------------
def scored_rows(spark, folder) -> DataFrame:
    """unit, cycle, actual (life left in events), predicted (the event's value), interval and fold."""
    from ..operators.labels import remaining_life

    s = remaining_life(event_series(spark, folder), "cycle", "actual")
    return s.frame.select(
        F.col("user_id").cast("string").alias("unit"), "cycle", F.col("actual").cast("double").alias("actual"),
        F.col("value").alias("predicted"), F.greatest(F.col("value") - 20, F.lit(0.0)).alias("lower"),
        (F.col("value") + 20).alias("upper"), F.pmod("user_id", F.lit(5)).cast("int").alias("fold"), "event_type")


SCORED = EV + """, scored AS (SELECT CAST(user_id AS VARCHAR) AS unit, cycle,
  CAST(max(cycle) OVER (PARTITION BY user_id) - cycle AS DOUBLE) AS actual, value AS predicted,
  greatest(value - 20, 0.0) AS lower, value + 20 AS upper, CAST(user_id % 5 AS INTEGER) AS fold, event_type FROM ev)"""


# -- waveforms: embeddings as 16 seconds of 4 samples ----------------------------------
def waveform_rows(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("cycle_id"), "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


WAVE = """wave AS (SELECT vec_id AS cycle_id, label, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)"""
