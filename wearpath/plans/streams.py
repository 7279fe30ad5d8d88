"""Streaming queries: the events table replayed as a stream, compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..session import materialise, shared_folder, table
from ..streaming import online
from .inputs import EV, tail
from .registry import query, r, rounded, rs
from .windows import _ewm_sql

ORDER = ["at", "event_id"]
# Histogram edges and fitted range of the drift report, days of its baseline, hours in which a review counts.
EDGES, LOW, HIGH, BASELINE_DAYS, REVIEW_HOURS = (5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 80.0, 110.0, 150.0, 220.0), 1, 100, 7, 72


def _arrivals(events, *columns, **options):
    """Replayed events with their times in ``at``, held until their order is certain."""
    stream, hold = online.replay(events.select("ts", *columns), "ts", **options)
    return online.timed(stream, "ts", hold).drop("ts")


@query("str_01_online_features", f"""WITH RECURSIVE {EV}, {_ewm_sql(5)} SELECT e.user_id, e.cycle, {rs('coalesce(value - lag(value) OVER o, 0)')} AS value_delta, {rs('avg(value) OVER t')} AS value_mean_5,
  {rs('greatest(stddev_pop(value) OVER t, 0)')} AS value_std_5, {rs('y')} AS ewm5, {rs('avg(value) FILTER (WHERE e.cycle <= 10) OVER u')} AS value_baseline
  FROM ev e JOIN (SELECT user_id, cycle, y FROM walk5) w ON e.user_id = w.user_id AND e.cycle = w.cycle
  WINDOW o AS (PARTITION BY e.user_id ORDER BY e.cycle), t AS (PARTITION BY e.user_id ORDER BY e.cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), u AS (PARTITION BY e.user_id ORDER BY e.cycle ROWS UNBOUNDED PRECEDING)""")
def online_features(spark, d):
    arrivals = _arrivals(table(spark, d, "events"), "user_id", "event_id", "value")
    rows = online.run_to_end(online.causal_features(arrivals, "user_id", ORDER, "value"), "features", partition_by=["status"])
    names = ["value_delta", "value_mean_5", "value_std_5", "ewm5", "value_baseline"]
    return rounded(rows.filter(F.col("status") == online.ACCEPTED).select("user_id", "cycle", *names), names)


@query("str_01b_reorder_accounts", """WITH d AS (SELECT event_id, event_id % 97 = 1 AS untimed FROM events UNION ALL SELECT event_id, event_id % 97 = 1 FROM events WHERE event_id % 10 = 0),
n AS (SELECT event_id, untimed, row_number() OVER (PARTITION BY event_id) AS copy FROM d)
SELECT CASE WHEN untimed THEN 'untimed' WHEN copy > 1 THEN 'repeated' ELSE 'accepted' END AS status, count(*) AS rows FROM n GROUP BY 1 UNION ALL SELECT 'input', count(*) FROM d""")
def reorder_accounts(spark, d):
    """Every tenth event is delivered twice and some have lost their time: what became of each delivered row, and their number."""
    events = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 97 != 1, F.col("ts")).alias("ts"), "value")
    delivered = events.unionByName(events.filter("event_id % 10 = 0"))
    rows = online.run_to_end(online.causal_features(_arrivals(delivered, "user_id", "event_id", "value"), "user_id", ORDER, "value"), "accounts", partition_by=["status"])
    return rows.groupBy("status").agg(F.count("*").alias("rows")).unionByName(delivered.agg(F.count("*").alias("rows")).select(F.lit("input").alias("status"), "rows"))


@query("str_02_online_alerts", f"""WITH {EV}, v AS (SELECT user_id, cycle, CAST(value > 30 AS INTEGER) AS vote FROM ev) SELECT user_id, cycle, CAST(sum(vote) OVER t >= 3 AS INTEGER) AS alert FROM v WINDOW {tail(5)}""")
def online_alerts(spark, d):
    """The position is the event's number within its user; without gaps there is one segment per user."""
    votes = table(spark, d, "events").withColumn("vote", (F.col("value") > 30).cast("int"))
    rows = online.run_to_end(online.persistence_alerts(_arrivals(votes, "user_id", "event_id", "vote"), "user_id", ORDER, "vote"), "alerts", partition_by=["status"])
    return rows.filter(F.col("status") == online.ACCEPTED).select("user_id", "cycle", "alert")


@query("str_02b_alerts_with_gaps", f"""WITH {EV}, v AS (SELECT user_id, cycle, row_number() OVER (PARTITION BY user_id ORDER BY cycle) AS n, CAST(value > 30 AS INTEGER) AS vote FROM ev WHERE cycle % 7 <> 0),
s AS (SELECT *, cycle - n AS segment FROM v) SELECT user_id, n AS cycle, segment, CAST(sum(vote) OVER (PARTITION BY user_id, segment ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS INTEGER) AS alert FROM s""")
def alerts_with_gaps(spark, d):
    """Every seventh record of a user is missing; the votes start again behind the gap. Two streams, the first's accepted rows feed the second."""
    votes = table(spark, d, "events").withColumn("vote", (F.col("value") > 30).cast("int"))
    numbered = online.persistence_alerts(_arrivals(votes, "user_id", "event_id", "vote"), "user_id", ORDER, "vote")
    rows = online.run_to_end(numbered, "numbered", partition_by=["status"]).filter(F.col("status") == online.ACCEPTED)
    left = rows.filter("cycle % 7 <> 0").select("user_id", "event_id", F.timestamp_micros("at").alias("ts"), "vote", F.col("cycle").alias("position"))
    again = online.persistence_alerts(_arrivals(left, "user_id", "event_id", "vote", "position"), "user_id", ORDER, "vote", position="position")
    return online.run_to_end(again, "alerts", partition_by=["status"]).filter(F.col("status") == online.ACCEPTED).select("user_id", "cycle", "segment", "alert")


@query("str_03_quality_split", """WITH d AS (SELECT event_id, event_type, value, false AS again FROM events UNION ALL SELECT event_id, event_type, value, true FROM events WHERE event_id % 10 = 0),
p AS (SELECT CASE WHEN NOT again AND value <= 150 AND event_type <> 'signup' THEN 'accepted' END AS part FROM d UNION ALL SELECT CASE WHEN again THEN 'repeated' END FROM d
  UNION ALL SELECT CASE WHEN value > 150 THEN 'out_of_range:value' END FROM d UNION ALL SELECT CASE WHEN event_type = 'signup' THEN 'outside_domain:event_type' END FROM d
  UNION ALL SELECT CASE WHEN again OR value > 150 OR event_type = 'signup' THEN 'rejected' END FROM d UNION ALL SELECT 'input' FROM d)
SELECT part, count(*) AS rows FROM p WHERE part IS NOT NULL GROUP BY part""")
def quality_split(spark, d):
    """Every tenth event comes again an hour later; sound rows and rejected ones, by rule, add up to the input."""
    base = shared_folder(spark, "quality")
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    delivered = events.unionByName(events.filter("event_id % 10 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    rows = online.first_of_key(_arrivals(delivered, "event_id", "event_type", "value"), "event_id", memory_seconds=86_400)
    rules = lambda: [quality.out_of_range("value", 0, 150), quality.outside_domain("event_type", ["click", "error", "purchase", "view"])]
    online.quality_split(rows, rules, f"{base}/accepted", f"{base}/rejected", f"{base}/offsets").awaitTermination()
    columns = "event_id long, event_type string, value double"
    good = spark.read.schema(columns).parquet(f"{base}/accepted").agg(F.count("*").alias("rows")).select(F.lit("accepted").alias("part"), "rows")
    rejected = spark.read.schema(f"{columns}, broken_rules array<string>").parquet(f"{base}/rejected")
    bad = rejected.select(F.explode(F.concat("broken_rules", F.array(F.lit("rejected")))).alias("part")).groupBy("part").agg(F.count("*").alias("rows"))
    return good.unionByName(bad).unionByName(delivered.agg(F.count("*").alias("rows")).select(F.lit("input").alias("part"), "rows"))


_BIN = " + ".join(f"(value >= {e})::INT" for e in EDGES)


@query("str_04_support_drift", f"""WITH e AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type, value, {_BIN} AS bin, CAST(value < {LOW} OR value > {HIGH} AS INT) AS outside FROM events),
b AS (SELECT * FROM e WHERE day < (SELECT min(day) + {BASELINE_DAYS} FROM e)),
bs AS (SELECT event_type, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM b GROUP BY 1),
w AS (SELECT day, event_type, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance, avg(outside) AS outside_rate FROM e GROUP BY 1, 2),
g AS (SELECT w.day, w.event_type, w.n, bs.n AS base_n, k.bin, (SELECT count(*) FROM e WHERE e.day = w.day AND e.event_type = w.event_type AND e.bin = k.bin) AS a,
        (SELECT count(*) FROM b WHERE b.event_type = w.event_type AND b.bin = k.bin) AS c FROM w JOIN bs USING (event_type), (SELECT DISTINCT bin FROM e) k),
h AS (SELECT day, event_type, sum((sqrt(base_n / n) * a - sqrt(n / base_n) * c) ** 2 / (a + c)) AS statistic, count(*) - 1 AS freedom FROM g WHERE a + c > 0 GROUP BY 1, 2)
SELECT day, event_type, w.n AS rows, bs.n AS base_rows, {rs('w.mean')} AS mean, {rs('bs.mean')} AS base_mean, {rs('outside_rate')} AS outside_rate, {rs('w.mean - bs.mean')} AS shift,
  {rs('sqrt(w.variance / w.n + bs.variance / bs.n)')} AS shift_error, {rs('statistic')} AS statistic, freedom, {rs('CASE WHEN freedom > 0 THEN (statistic - freedom) / sqrt(2 * freedom) END')} AS excess
FROM w JOIN bs USING (event_type) JOIN h USING (day, event_type)""")
def support_drift(spark, d):
    """Every day of the input against the stored histograms of the first days; the closing row releases the last day."""
    events = table(spark, d, "events").select("ts", "event_type", "value")
    stream, hold = online.replay(events, "ts")
    bins = online.run_to_end(online.support_drift(online.clocked(stream, "ts", hold), "event_type", "value", LOW, HIGH, EDGES), "drift")
    first = bins.agg(F.min("window_start").alias("first"))
    early = bins.join(F.broadcast(first), F.col("window_start") < F.col("first") + F.expr(f"INTERVAL {BASELINE_DAYS} DAYS")).drop("first")
    baseline = materialise(early.groupBy("event_type", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "total", "squares", "outside")]), "baseline")
    told = online.drift_report(bins, baseline, "event_type")
    names = ["mean", "base_mean", "outside_rate", "shift", "shift_error", "statistic", "excess"]
    day = F.floor(F.unix_micros("window_start") / 86400e6).cast("long")
    return rounded(told.select(day.alias("day"), "event_type", "rows", "base_rows", *names, "freedom"), names)


@query("str_05_outcome_performance", f"""WITH r AS (SELECT doc_id AS event_id, quality, coalesce(ts, TIMESTAMP '2024-01-15') + INTERVAL 1 HOUR * (doc_id % 120) AS reviewed FROM labels LEFT JOIN events ON event_id = doc_id),
j AS (SELECT e.event_type, e.event_id, CAST(value > 20 AS INT) AS predicted, quality, reviewed FROM events e LEFT JOIN r ON r.event_id = e.event_id AND r.reviewed BETWEEN e.ts AND e.ts + INTERVAL {REVIEW_HOURS} HOUR)
SELECT event_type, count(reviewed) AS reviewed, count(*) - count(reviewed) AS unreviewed, 0 AS unmatched, {rs('avg(CAST(predicted = quality AS INT)) FILTER (reviewed IS NOT NULL)')} AS agreement FROM j GROUP BY 1
UNION ALL SELECT NULL, 0, 0, n, NULL FROM (SELECT count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.event_id = r.event_id AND j.reviewed IS NOT NULL)) WHERE n > 0""")
def outcome_performance(spark, d):
    """Each event predicts 'good' by its value; labels are reviews that come up to five days later, and count for three."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type", (F.col("value") > 20).cast("int").alias("predicted"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), "quality").join(events.select("event_id", "ts"), "event_id", "left")
    start = F.coalesce("ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    reviews = known.select("event_id", "quality", (start + F.make_dt_interval(hours=(F.col("event_id") % 120).cast("int"))).alias("at"))
    made, hold = online.replay(events, "ts")
    came, hold_reviews = online.replay(reviews, "at")
    predictions = online.clocked(made, "ts", hold).drop("ts").withColumnRenamed("clock", "made")
    outcomes = online.clocked(came, "at", hold_reviews).drop("at").withColumnRenamed("clock", "reviewed")
    rows = online.run_to_end(online.with_outcomes(predictions, outcomes, ["event_id"], "made", "reviewed", f"{REVIEW_HOURS} HOURS"), "outcomes")
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("reviewed", "unreviewed", "unmatched")]
    agreed = F.when(F.col("outcome") == "reviewed", (F.col("predicted") == F.col("quality")).cast("int"))
    return rows.groupBy("event_type").agg(*counts, r(F.avg(agreed)).alias("agreement"))
