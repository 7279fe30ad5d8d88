"""Split, fold and perturbation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import causal, learn, splits
from ..session import table
from .inputs import EV, FAULTS, SCENARIOS, event_rows, scenario_rows
from .models import TR, training_rows
from .registry import query, r, rs


def _h(*columns: str) -> str:
    return "md5('42:' || " + " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in columns) + ")"


_GROUPS = f"g AS (SELECT o_custkey, row_number() OVER (ORDER BY {_h('o_custkey')}) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT o_custkey FROM orders))"


@query("spl_01_group_holdout", f"""WITH {_GROUPS} SELECT o_orderkey, o_custkey, CASE WHEN n <= ceil(c * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'train' END AS part FROM orders JOIN g USING (o_custkey)""")
def group_holdout(spark, d):
    return splits.holdout(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


def _greedy(units):
    """SQL of five loads per stratum: units (stratum, n, size), largest first, each to the lightest load."""
    return f"""walk AS (SELECT stratum, 0::BIGINT AS n, [0, 0, 0, 0, 0]::BIGINT[] AS load FROM {units} GROUP BY 1
  UNION ALL SELECT w.stratum, w.n + 1, list_transform(w.load, lambda x, i: CASE WHEN i = list_position(w.load, list_min(w.load)) THEN x + u.size ELSE x END) FROM walk w JOIN {units} u ON u.stratum IS NOT DISTINCT FROM w.stratum AND u.n = w.n + 1),
  loads AS (SELECT stratum, list_sort(load) AS load FROM walk QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY n DESC) = 1)"""


def _loads(rows, *by):
    """The folds' row counts in ascending order, with the number of groups that lie in several folds."""
    sizes = rows.groupBy(*by, "fold").agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rows", "fold"))
    return sizes.select(*by, place.alias("place"), "rows")


_CUSTOMERS = "un AS (SELECT 'all' AS stratum, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS n, count(*) AS size FROM orders GROUP BY o_custkey)"


@query("spl_02_group_folds", f"""WITH RECURSIVE {_CUSTOMERS}, {_greedy('un')}, p AS (SELECT unnest(load) AS rows, unnest([1, 2, 3, 4, 5]) AS place FROM loads)
  SELECT CAST(place AS INTEGER) AS place, CAST(rows AS BIGINT) AS rows, 0 AS leaking FROM p WHERE rows > 0""")
def group_folds(spark, d):
    """The folds' row counts are those of giving each customer, the largest first, to the lightest fold."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(splits.group_folds(orders, "o_custkey", 5), "o_custkey")
    leaking = splits.leaking_groups(joined, "o_custkey", "fold").agg(F.count("*")).scalar()
    return _loads(joined).withColumn("leaking", leaking.cast("int"))


@query("spl_03_leave_one_group_out", """SELECT a.event_type AS held_out, CAST(any_value(a.n) AS BIGINT) AS held_rows, CAST(sum(b.n) AS BIGINT) AS train_rows FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) a
  JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) b ON a.event_type <> b.event_type GROUP BY 1""")
def leave_one_group_out(spark, d):
    """Every group is a fold of its own; the training rows are all the others, counted without copying them."""
    per = event_rows(spark, d).groupBy(F.col("event_type").alias("held_out")).agg(F.count("*").alias("held_rows"))
    return per.withColumn("train_rows", per.agg(F.sum("held_rows")).scalar() - F.col("held_rows"))


@query("spl_03b_leave_one_unit_out", f"""WITH {TR}, t AS (SELECT count(*) AS n, sum(cycle) AS x, sum(rul) AS y, sum(cycle * cycle) AS xx, sum(cycle * rul) AS xy FROM tr),
  o AS (SELECT user_id, count(*) AS n, sum(cycle) AS x, sum(rul) AS y, sum(cycle * cycle) AS xx, sum(cycle * rul) AS xy FROM tr GROUP BY 1),
  d AS (SELECT o.user_id, t.n - o.n AS n, t.x - o.x AS x, t.y - o.y AS y, t.xx - o.xx AS xx, t.xy - o.xy AS xy FROM o, t),
  k AS (SELECT user_id, (n * xy - x * y) / (n * xx - x * x) AS b, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS a FROM d)
  SELECT event_id, {rs('greatest(a + b * cycle, 0)', 4)} AS predicted FROM tr JOIN k USING (user_id)""")
def leave_one_unit_out(spark, d):
    """Every user is a fold: as many fits as users, each from the totals less the user's own moments."""
    scored = learn.linear_oof(training_rows(spark, d), "user_id", ["cycle"], "rul", 0.0)
    return scored.select("event_id", r("predicted", 4).alias("predicted"))


@query("spl_04_stratified_folds", f"""SELECT p_partkey, p_type, CAST((row_number() OVER (PARTITION BY p_type ORDER BY {_h('p_partkey')}) - 1) % 5 AS INTEGER) AS fold FROM part""")
def stratified_folds(spark, d):
    return splits.stratified_folds(table(spark, d, "part").select("p_partkey", "p_type"), ["p_partkey"], "p_type", 5)


_BRANDS = """mj AS (SELECT p_brand, sum(n) AS size, arg_max(p_type, (n, p_type)) AS stratum FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1),
  un AS (SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, p_brand) AS n, CAST(size AS BIGINT) AS size FROM mj)"""


@query("spl_05_stratified_group_folds", f"""WITH RECURSIVE {_BRANDS}, {_greedy('un')}, q AS (SELECT stratum, unnest(load) AS rows FROM loads), p AS (SELECT * FROM q WHERE rows > 0)
  SELECT stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY rows) AS INTEGER) AS place, CAST(rows AS BIGINT) AS rows, 0 AS leaking FROM p""")
def stratified_group_folds(spark, d):
    """Within each majority type the folds' row counts are those of the greedy deal."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    folds = splits.stratified_group_folds(parts, "p_brand", "p_type", 5)
    joined = parts.join(folds, "p_brand")
    leaking = splits.leaking_groups(joined, "p_brand", "fold").agg(F.count("*")).scalar()
    per = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("stratum"))
    return _loads(joined.join(per, "p_brand"), "stratum").withColumn("leaking", leaking.cast("int"))


@query("spl_06_quantile_bins", f"""WITH e AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(p_size, CAST({i / 20} AS DOUBLE))' for i in range(21))}])) AS edges FROM part)
  SELECT p_partkey, CAST(greatest(len(list_filter(edges, lambda x: x < p_size)) - 1, 0) AS INTEGER) AS bin FROM part, e""")
def quantile_bins(spark, d):
    return splits.quantile_bins(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 20).select("p_partkey", F.col("bin").cast("int").alias("bin"))


@query("spl_07_three_way_partition", f"""WITH {_GROUPS} SELECT o_orderkey, CASE WHEN n - 1 < floor(c * CAST(0.6 AS DOUBLE)) THEN 'fit' WHEN n - 1 < floor(c * CAST(0.8 AS DOUBLE)) THEN 'calibration' ELSE 'evaluation' END AS part FROM orders JOIN g USING (o_custkey)""")
def three_way_partition(spark, d):
    return splits.three_way(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "part")


@query("spl_08_snapshots", f"""WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM ev), s AS (SELECT *, c // 5 + CAST('0x' || substr({_h('user_id')}, 1, 13) AS BIGINT) % (c - c // 5) + 1 AS spot FROM n)
  SELECT user_id, event_id, cycle AS position FROM s WHERE cycle = spot""")
def snapshots(spark, d):
    return splits.snapshots(event_rows(spark, d), "user_id", ("ts", "event_id")).select("user_id", "event_id", "position")


_BLK = f"{SCENARIOS}, blk AS (SELECT *, ntile(6) OVER (PARTITION BY scenario ORDER BY position) - 1 AS block FROM scen WHERE is_abnormal = 0)"


@query("spl_09_rotating_blocks", f"""WITH {_BLK}, f AS (SELECT unnest(range(0, 6)) AS fold) SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'test' WHEN block = (fold + 5) % 6 THEN 'calibration' ELSE 'train' END AS role,
  count(*) AS rows, min(position) AS first_position, max(position) AS last_position FROM blk, f GROUP BY 1, 2""")
def rotating_blocks(spark, d):
    s = causal.contiguous_blocks(scenario_rows(spark, d), 6)
    roles = splits.rotating_roles(s.frame.filter("is_abnormal = 0"), "block", 6)
    return roles.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


_PLAN = ", ".join(f"({o}, {i}, '{role}', {b})" for o, i, role, b in splits.nested_plan(4))


@query("spl_10_nested_plan", f"""WITH {SCENARIOS}, blk AS (SELECT ntile(4) OVER (PARTITION BY scenario ORDER BY position) - 1 AS block FROM scen WHERE is_abnormal = 0), plan(outer_fold, inner_fold, role, block) AS (VALUES {_PLAN})
  SELECT outer_fold, inner_fold, role, count(*) AS rows FROM blk JOIN plan USING (block) GROUP BY 1, 2, 3""")
def nested_plan(spark, d):
    plan = spark.createDataFrame(splits.nested_plan(4), "outer_fold int, inner_fold int, role string, block int")
    rows = causal.contiguous_blocks(scenario_rows(spark, d), 4).frame.filter("is_abnormal = 0").select("block")
    # Rows fold to one count per block before the plan multiplies them.
    return rows.groupBy("block").count().join(F.broadcast(plan), "block").groupBy("outer_fold", "inner_fold", "role").agg(F.sum("count").alias("rows"))


@query("spl_11_leave_scenario_out", f"""WITH {SCENARIOS}, blk AS (SELECT *, ntile(4) OVER (PARTITION BY scenario ORDER BY position) - 1 AS block FROM scen)
  SELECT scenario, position, CAST(CASE WHEN is_abnormal = 0 THEN block ELSE list_position({list(FAULTS)}, scenario) - 1 END AS INTEGER) AS fold FROM blk""")
def leave_scenario_out(spark, d):
    rows = causal.contiguous_blocks(scenario_rows(spark, d), 4).frame
    return splits.leave_one_scenario_out(rows, "scenario", "view", "block", FAULTS).select("scenario", "position", "fold")


def _u(name: str) -> str:
    return f"(CAST('0x' || substr(md5('42:{name}:a:' || CAST(event_id AS VARCHAR)), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


@query("spl_12_perturbation", f"""WITH {SCENARIOS}, t AS (SELECT stddev_pop(a) AS s, quantile_cont(a, 0.5) AS m FROM scen WHERE is_abnormal = 0)
  SELECT event_id, {rs(f"CASE WHEN {_u('drop')} < CAST(0.03 AS DOUBLE) THEN m ELSE a + sqrt(-2 * ln(1 - {_u('radius')})) * cos(2 * pi() * {_u('angle')}) * 0.05 * s END", 5)} AS a FROM scen, t""")
def perturbation(spark, d):
    rows = scenario_rows(spark, d).frame.select("event_id", "a", "is_abnormal")
    moved = splits.perturb(rows, rows.filter("is_abnormal = 0"), ["event_id"], ["a"])
    return moved.select("event_id", r("a", 5).alias("a"))


@query("spl_13_frozen_fold_drift", """SELECT c_custkey, CAST(NULL AS DOUBLE) AS times FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT o_custkey, CAST(n AS DOUBLE) FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) WHERE n <> 1""")
def frozen_fold_drift(spark, d):
    """Stored folds (the priorities a customer ordered with) against the customer table."""
    frozen = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    drift = splits.frozen_fold_drift(table(spark, d, "customer").select("c_custkey"), "c_custkey", frozen)
    return drift.select("c_custkey", F.col("times").cast("double").alias("times"))
