"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import wall_micros
from ..operators import causal, joins, splits
from ..operators.series import series
from ..session import table
from .inputs import (EV, SAMPLES, SCENARIOS, SCORED, SEGMENT_LIMITS, event_rows, event_series, sample_rows, scenario_rows,
                     scored_rows, tail)
from .registry import flag, query, r, rounded, rs


def order_lines(spark, d):
    """One feature row per order that has lines."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("gross"))


LINES = "lines AS (SELECT l_orderkey AS o_orderkey, count(*) AS lines, sum(l_quantity) AS quantity, sum(l_extendedprice) AS gross FROM lineitem GROUP BY 1)"


@query("jn_01_inner_one_to_one", f"""WITH {LINES} SELECT o_orderkey, o_custkey, lines, {rs('quantity', 2)} AS quantity FROM lines JOIN orders USING (o_orderkey)""")
def inner_one_to_one(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.one_to_one(order_lines(spark, d), orders, ["o_orderkey"], complete=False).select(
        "o_orderkey", "o_custkey", "lines", r("quantity", 2).alias("quantity"))


@query("jn_02_left_many_to_one", """SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def left_many_to_one(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.many_to_one(table(spark, d, "orders"), customers, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "c_nationkey")


@query("jn_03_dictionary_lookup", f"""SELECT c_custkey, CAST(CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SEGMENT_LIMITS.items())} END AS DOUBLE) AS eol_capacity FROM customer""")
def dictionary_lookup(spark, d):
    limits = F.create_map(*[F.lit(x) for kv in SEGMENT_LIMITS.items() for x in kv])
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(limits, F.col("c_mktsegment")).alias("eol_capacity"))


def _day_counts(spark, d, kind):
    day = F.floor(wall_micros(F.col("ts")) / 86400e6).cast("long").alias("day")
    return event_rows(spark, d).filter(F.col("event_type") == kind).groupBy("user_id", day).agg(
        F.count("*").alias("n"), F.max("value").alias("peak"))


_DAY = """dc AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2, 3)"""


@query("jn_04_full_outer_indicator", f"""WITH {_DAY}, a AS (SELECT * FROM dc WHERE event_type = 'click'), b AS (SELECT * FROM dc WHERE event_type = 'error')
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, a.peak AS peak_new, b.peak AS peak_old,
  CASE WHEN a.n IS NULL THEN 'right_only' WHEN b.n IS NULL THEN 'left_only' ELSE 'both' END AS side
  FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def full_outer_indicator(spark, d):
    return joins.reconcile(_day_counts(spark, d, "click"), _day_counts(spark, d, "error"), ["user_id", "day"], ["peak"], ("_new", "_old"))


@query("jn_05_left_reconciliation", f"""WITH {LINES} SELECT o_orderkey, CASE WHEN lines IS NULL THEN 'left_only' ELSE 'both' END AS side,
  CAST(coalesce(abs(o_totalprice - gross) <= 1000 + 0.5 * abs(gross), false) AS INTEGER) AS agrees FROM orders LEFT JOIN lines USING (o_orderkey)""")
def left_reconciliation(spark, d):
    stated = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("gross"))
    both = joins.reconcile(stated, order_lines(spark, d), ["o_orderkey"], ["gross"], ("_stated", "_source"), "left")
    return both.select("o_orderkey", "side", flag(joins.close(F.col("gross_stated"), F.col("gross_source"), 1000, 0.5)).alias("agrees"))


@query("jn_06_feature_enrichment", f"""WITH {EV} SELECT user_id, event_id, event_type, {rs('avg(value) OVER t')} AS value_mean_5 FROM ev WINDOW {tail(5)}""")
def feature_enrichment(spark, d):
    extra = causal.trailing_mean(event_series(spark, d), ["value"], (5,)).frame.select("user_id", "event_id", "value_mean_5")
    joined = joins.enrich(event_rows(spark, d), extra, ["user_id", "event_id"])
    return joined.select("user_id", "event_id", "event_type", r("value_mean_5").alias("value_mean_5"))


@query("jn_07_semi_join", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, d):
    wanted = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@query("jn_08_anti_join", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("jn_09_positional_join", """WITH a AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS cycle_id FROM embeddings),
  b AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS cycle_id FROM pages), c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS cycle_id FROM benchmark)
  SELECT cycle_id, vec_id, label, page_id, item_id FROM a FULL JOIN b USING (cycle_id) FULL JOIN c USING (cycle_id)""")
def positional_join(spark, d):
    def numbered(name, key, *columns):
        rows = table(spark, d, name).select(key, *columns)
        return series(rows, (), key).number("cycle_id").frame

    return joins.side_by_side([numbered("embeddings", "vec_id", "label"), numbered("pages", "page_id"), numbered("benchmark", "item_id")], "cycle_id", strict=False)


@query("jn_10_interpolating_asof", f"""WITH {SAMPLES}, t AS (SELECT user_id, time AS x, max(voltage) AS voltage, max(current) AS current FROM samples WHERE event_type = 'view' GROUP BY 1, 2),
  q AS (SELECT user_id, event_id, time FROM samples WHERE event_type <> 'view'),
  p AS (SELECT q.*, t.x AS px, t.voltage AS pv, t.current AS pc FROM q ASOF LEFT JOIN t ON q.user_id = t.user_id AND q.time >= t.x),
  n AS (SELECT p.*, t.x AS nx, t.voltage AS nv, t.current AS nc FROM p ASOF LEFT JOIN t ON p.user_id = t.user_id AND p.time < t.x)
  SELECT user_id, event_id, {rs('CASE WHEN px IS NULL THEN nv WHEN nx IS NULL OR px = time THEN pv ELSE pv + (time - px) * (nv - pv) / (nx - px) END', 5)} AS voltage_expected,
  {rs('CASE WHEN px IS NULL THEN nc WHEN nx IS NULL OR px = time THEN pc ELSE pc + (time - px) * (nc - pc) / (nx - px) END', 5)} AS current_expected FROM n""")
def interpolating_asof(spark, d):
    samples = sample_rows(spark, d)
    template = samples.filter(F.col("event_type") == "view").groupBy("user_id", "time").agg(
        F.max("voltage").alias("voltage"), F.max("current").alias("current"))
    asked = samples.filter(F.col("event_type") != "view").select("user_id", "event_id", "time")
    out = joins.interpolating_asof(asked, template, ["user_id"], "time", ["voltage", "current"])
    return rounded(out.drop("time"), ["voltage_expected", "current_expected"], 5)


@query("jn_11_aligned_predictions", f"""WITH {SCORED} SELECT unit, cycle, actual, fold, {rs('predicted * 0.9')} AS predicted FROM scored""")
def aligned_predictions(spark, d):
    reference = scored_rows(spark, d).select("unit", "cycle", "fold", "actual", "predicted")
    candidate = reference.withColumn("predicted", F.col("predicted") * 0.9)
    return joins.aligned_predictions(candidate, reference).withColumn("predicted", r("predicted"))


@query("jn_12_events_and_samples", """SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS samples, max(l_extendedprice) AS peak
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def events_and_samples(spark, d):
    """Samples fold to one row per event before they meet the metadata, so a hot event costs no more than others."""
    samples = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("samples"), F.max("l_extendedprice").alias("peak"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(samples, "o_orderkey", "left").select(
        "o_orderkey", "o_orderpriority", F.coalesce("samples", F.lit(0)).alias("samples"), "peak")


@query("jn_13_checkpoint_membership", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM ev)
  SELECT user_id, cycle, CAST(list_contains([{', '.join(f'greatest(1, CAST(ceil(CAST({f} AS DOUBLE) * c) AS BIGINT))' for f in (0.2, 0.4, 0.6, 0.8, 1.0))}], cycle) AS INTEGER) AS fixed_checkpoint FROM n""")
def checkpoint_membership(spark, d):
    s = event_series(spark, d)
    marked = joins.membership(s.frame, causal.checkpoints(s), ["user_id", "cycle"], "fixed_checkpoint")
    return marked.select("user_id", "cycle", flag("fixed_checkpoint").alias("fixed_checkpoint"))


@query("jn_14_candidate_grid", f"""WITH {SCENARIOS}, g AS (SELECT unnest([20.0, 40.0, 60.0]) AS threshold), w AS (SELECT unnest([1, 2]) AS channel)
  SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(channel AS INTEGER) AS channel, scenario, count(*) FILTER (CASE channel WHEN 1 THEN a ELSE b END > threshold) AS votes FROM scen, g, w GROUP BY 1, 2, 3""")
def candidate_grid(spark, d):
    grid = [{"threshold": t, "channel": c} for t in (20.0, 40.0, 60.0) for c in (1, 2)]
    scored = joins.with_candidates(scenario_rows(spark, d).frame, grid)
    value = F.when(F.col("candidate.channel") == 1, F.col("a")).otherwise(F.col("b"))
    return scored.groupBy("candidate.threshold", "candidate.channel", "scenario").agg(
        F.count_if(value > F.col("candidate.threshold")).alias("votes"))


# -- sets ------------------------------------------------------------------------------
@query("set_01_union_by_name", """SELECT source, count(*) AS rows FROM (SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark
  UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY 1""")
def union_by_name(spark, d):
    parts = [table(spark, d, n).select("text", F.lit(n).alias("source")) for n in ("documents", "benchmark", "conversations")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("rows"))


@query("set_02_union_with_offset", """WITH c AS (SELECT max(c_custkey) AS m FROM customer) SELECT 'customer' AS source, c_custkey AS unit, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', s_suppkey + m + 1, s_acctbal FROM supplier, c""")
def union_with_offset(spark, d):
    """Units of the second source are shifted past the first source's largest id."""
    first = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("balance"))
    offset = first.agg(F.max("unit")).scalar()
    second = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), (F.col("s_suppkey") + offset + 1).alias("unit"),
                                                F.col("s_acctbal").alias("balance"))
    return first.unionByName(second)


@query("set_03_evaluation_union", f"""WITH {SCENARIOS} SELECT scenario, position, CASE WHEN is_abnormal = 0 THEN 'blocked_normal' ELSE 'held_out_fault' END AS kind FROM scen""")
def evaluation_union(spark, d):
    rows = scenario_rows(spark, d).frame.select("scenario", "position", "is_abnormal")
    normal = rows.filter("is_abnormal = 0").withColumn("kind", F.lit("blocked_normal"))
    faults = rows.filter("is_abnormal = 1").withColumn("kind", F.lit("held_out_fault"))
    return normal.unionByName(faults).drop("is_abnormal")


@query("set_04_group_leakage", """SELECT l_suppkey, count(DISTINCT l_returnflag) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def group_leakage(spark, d):
    return splits.leaking_groups(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("set_05_name_sets", """SELECT event_id, CAST(len(list_filter(['j', 'k'], lambda x: NOT list_contains(json_keys(props), x))) AS INTEGER) AS missing_names,
  CAST(len(list_filter(json_keys(props), lambda x: NOT list_contains(['j', 'k'], x))) AS INTEGER) AS extra_names FROM events""")
def name_sets(spark, d):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    wanted = F.array(F.lit("j"), F.lit("k"))
    return table(spark, d, "events").select("event_id", F.size(F.array_except(wanted, keys)).alias("missing_names"),
                                            F.size(F.array_except(keys, wanted)).alias("extra_names"))


@query("set_06_exact_coverage", """SELECT CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS BIGINT) AS times WHERE false
  UNION ALL SELECT o_orderkey, nullif(c, 0) FROM (SELECT o_orderkey, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE c <> 1
  UNION ALL SELECT l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def exact_coverage(spark, d):
    """Orders whose lines do not cover them exactly once."""
    due = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return splits.coverage_errors(table(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"], due)


