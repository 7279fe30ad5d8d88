"""Data-quality, filter and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clip, digest, notes, wall_micros
from ..operators import joins, labels, quality, review
from ..operators.series import series
from ..session import table
from .inputs import CHANNELS, EV, HIST, SCENARIOS, event_rows, event_series, order_histories, scenario_rows
from .registry import flag, query, r, rs


# -- DQ --------------------------------------------------------------------------------
# The columns expected of an events table, and a longer list to find gaps with.
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query("dq_01_schema_issues", """WITH wanted AS (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'unit_code']) AS c),
  have AS (SELECT DISTINCT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS c), n AS (SELECT count(*) AS rows FROM events)
  SELECT 'missing column ' || c AS issue, rows FROM wanted, n WHERE c NOT IN (SELECT c FROM have)
  UNION ALL SELECT 'unexpected column ' || c, rows FROM have, n WHERE c NOT IN (SELECT c FROM wanted)""")
def schema_issues(spark, d):
    events = table(spark, d, "events")
    issues = quality.schema_issues(events, [*EVENT_COLUMNS[:-1], "unit_code"])
    return events.groupBy().agg(F.count("*").alias("rows")).select(
        F.explode(F.array(*[F.lit(i) for i in issues])).alias("issue"), "rows")


@query("dq_02_row_counts", """SELECT event_type, count(*) AS rows, CAST(count(*) >= 5 AS INTEGER) AS enough FROM events GROUP BY 1""")
def row_counts(spark, d):
    return event_rows(spark, d).groupBy("event_type").agg(F.count("*").alias("rows"), flag(F.count("*") >= 5).alias("enough"))


@query("dq_03_numeric_coercion", """SELECT doc_id, 'not_numeric:source' AS rule, source AS detail FROM documents
  WHERE source IS NOT NULL AND try_cast(source AS DOUBLE) IS NULL""")
def numeric_coercion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("string").alias("n_chars"))
    return quality.violations(docs, ["doc_id"], [quality.not_numeric("source"), quality.not_numeric("n_chars")])


@query("dq_04_finite_values", f"""SELECT unnest({list(CHANNELS)}) AS column_name, CAST(unnest([{', '.join(f'count(*) FILTER ({c} IS NULL)' for c in CHANNELS)}]) AS BIGINT) AS missing,
  CAST(unnest([{', '.join(f'count(*) FILTER (isinf({c}) OR isnan({c}))' for c in CHANNELS)}]) AS BIGINT) AS non_finite FROM lineitem""")
def finite_values(spark, d):
    return quality.column_counts(table(spark, d, "lineitem"), CHANNELS)


@query("dq_05_missing_values", f"""WITH {HIST} SELECT count(*) - count(capacity) AS missing_capacity, count(*) - count(eol_capacity) AS missing_threshold,
  count(*) AS rows FROM hist""")
def missing_values(spark, d):
    return order_histories(spark, d).df.agg(
        F.count_if(F.col("capacity").isNull()).alias("missing_capacity"),
        F.count_if(F.col("eol_capacity").isNull()).alias("missing_threshold"), F.count("*").alias("rows"))


@query("dq_06_range_bounds", """SELECT event_id, 'out_of_range:value' AS rule, CAST(value AS DOUBLE) AS observed FROM events WHERE value > 150
  UNION ALL SELECT event_id, 'out_of_range:user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id < 1""")
def range_bounds(spark, d):
    found = quality.violations(event_rows(spark, d), ["event_id"], [
        quality.out_of_range("value", 0, 150), quality.out_of_range("user_id", 1)])
    return found.select("event_id", "rule", F.col("detail").cast("double").alias("observed"))


@query("dq_07_domains_and_integers", """SELECT p_partkey, 'outside_domain:p_type' AS rule FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL')
  UNION ALL SELECT p_partkey, 'not_integer:p_retailprice' FROM part WHERE p_retailprice <> floor(p_retailprice)""")
def domains_and_integers(spark, d):
    return quality.violations(table(spark, d, "part"), ["p_partkey"], [
        quality.outside_domain("p_type", ["ECONOMY", "SMALL"]), quality.not_integer("p_retailprice")]).select("p_partkey", "rule")


@query("dq_08_duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq_08b_duplicate_texts", """WITH g AS (SELECT sha256(text) AS digest, count(*) AS c FROM documents GROUP BY 1)
  SELECT digest, c AS rows FROM g WHERE c > 1""")
def duplicate_texts(spark, d):
    docs = table(spark, d, "documents").select(digest(F.col("text")).alias("digest"))
    return quality.duplicates(docs, ["digest"])


@query("dq_09_key_set_match", """SELECT coalesce(a.k, b.k) AS doc_id, CASE WHEN a.k IS NULL THEN 'right_only' ELSE 'left_only' END AS side
  FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL OUTER JOIN (SELECT DISTINCT doc_id AS k FROM labels) b ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL""")
def key_set_match(spark, d):
    return quality.key_mismatches(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("dq_10_trajectory_quality", """WITH base AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS cycle, event_id % 7 AS rul FROM events),
  g AS (SELECT *, cycle - lag(cycle) OVER (PARTITION BY user_id ORDER BY cycle, event_id) > 1 AS gap, max(cycle) OVER (PARTITION BY user_id) AS last FROM base)
  SELECT user_id, count(*) AS rows, min(cycle) AS first_cycle, max(cycle) AS last_cycle, CAST(coalesce(sum(CAST(gap AS INTEGER)), 0) AS BIGINT) AS cycle_gaps,
  count(DISTINCT cycle + rul) AS lifetime_values, count(*) FILTER (cycle + rul <> last) AS label_mismatch_rows,
  (round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events), 9) + 0.0) AS row_fraction FROM g GROUP BY user_id""")
def trajectory_quality(spark, d):
    hour = F.floor(wall_micros(F.col("ts")) / 3600e6).cast("long")
    base = event_rows(spark, d).select("user_id", "event_id", hour.alias("cycle"), F.pmod("event_id", F.lit(7)).alias("rul"))
    records = quality.trajectory_quality(series(base, "user_id", ("cycle", "event_id")), "cycle", "rul")
    return records.drop("observed_lifetime").withColumn("row_fraction", r("row_fraction", 9))


@query("dq_11_sudden_drops", f"""WITH {EV}, w AS (SELECT user_id, cycle, value, count(*) OVER p AS c, quantile_cont(value, 0.5) OVER p AS m FROM ev
  WINDOW p AS (PARTITION BY user_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
  SELECT user_id, cycle, CAST(coalesce(c >= 3 AND value < 0.5 * m, false) AS INTEGER) AS large_downward_jump, CAST(value <= 0 AS INTEGER) AS nonpositive FROM w""")
def sudden_drops(spark, d):
    s = quality.sudden_drops(event_series(spark, d), "value")
    return s.frame.select("user_id", "cycle", flag("large_downward_jump").alias("large_downward_jump"), flag("nonpositive").alias("nonpositive"))


@query("dq_12_label_recheck", f"""WITH {HIST}, stored AS (SELECT o_orderkey, rul_cycles + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS stored_rul FROM hist WHERE rul_training_eligible)
  SELECT count(*) AS rows_checked, count(*) FILTER (stored_rul <> rul_cycles) AS mismatch_rows FROM stored JOIN hist USING (o_orderkey)""")
def label_recheck(spark, d):
    """Stored labels (every eleventh off by one) against labels derived again from the source orders."""
    fresh = labels.discharge_histories(order_histories(spark, d)).frame
    stored = fresh.filter("rul_training_eligible").select(
        "o_orderkey", (F.col("rul_cycles") + flag(F.pmod("o_orderkey", F.lit(11)) == 0)).alias("rul_cycles"))
    both = joins.reconcile(stored, fresh, ["o_orderkey"], ["rul_cycles"], ("_stored", "_source"), "left")
    wrong = (F.col("side") != "both") | ~joins.close(F.col("rul_cycles_stored"), F.col("rul_cycles_source"))
    return both.agg(F.count("*").alias("rows_checked"), F.count_if(wrong).alias("mismatch_rows"))


@query("dq_13_crossing_stability", f"""WITH {HIST}, x AS (SELECT *, discharge_cycle - observed_eol_cycle AS gap FROM hist WHERE observed_eol_cycle IS NOT NULL AND valid_capacity),
  k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, sign(gap) ORDER BY abs(gap)) AS near FROM x)
  SELECT o_custkey, CAST(max(observed_eol_cycle) AS DOUBLE) AS first_crossing_cycle, max(capacity) FILTER (gap = 0) AS crossing_capacity,
  {rs('quantile_cont(capacity, 0.5) FILTER (gap < 0 AND near <= 5)', 3)} AS prior_median, count(*) FILTER (gap > 0 AND near <= 3) AS following_valid,
  count(*) FILTER (gap > 0 AND near <= 3 AND capacity > eol_capacity) AS following_above,
  CAST(count(*) FILTER (gap > 0 AND near <= 3 AND capacity > eol_capacity) > 0 AS INTEGER) AS needs_review FROM k GROUP BY o_custkey""")
def crossing_stability(spark, d):
    h = labels.discharge_histories(order_histories(spark, d)).frame
    out = quality.crossing_stability(h, "o_custkey", "capacity", "eol_capacity")
    return out.withColumns({"first_crossing_cycle": F.col("first_crossing_cycle").cast("double"),
                            "prior_median": r("prior_median", 3), "needs_review": flag("needs_review")})


def manifest_rows(spark, d):
    """Pages as a validation manifest: sources come from real addresses, digests from the page text."""
    pages = table(spark, d, "pages")
    n = F.col("page_id")
    return pages.select(
        F.when(n % 13 == 0, "Sonar").when(n % 3 == 0, " Engine ").when(n % 3 == 1, "battery").otherwise("hydraulic").alias("component"),
        (n % 60).cast("string").alias("group_id"),
        F.when(n % 17 == 0, "training").when(n % 2 == 0, "frozen_test").otherwise("external_calibration").alias("partition"),
        F.when(n % 19 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")).alias("source_url"),
        F.lit("1").alias("source_version"), F.when(n % 23 == 0, "").otherwise("open").alias("license_or_access_terms"),
        F.when(n % 29 == 0, "abc").otherwise(digest(F.col("html"))).alias("raw_sha256"), F.lit("2024-01-01").alias("acquired_utc"),
        F.lit("manual").alias("label_method"), F.when(n % 31 == 0, "no").when(n % 37 == 0, "false").otherwise("TRUE").alias("independent_from_development"),
        F.when(n % 41 == 0, "true").otherwise("False").alias("used_for_tuning"))


@query("dq_14_manifest_issues", """WITH m AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'sonar' WHEN page_id % 3 = 0 THEN 'engine' WHEN page_id % 3 = 1 THEN 'battery' ELSE 'hydraulic' END AS component,
  CAST(page_id % 60 AS VARCHAR) AS group_id, CASE WHEN page_id % 17 = 0 THEN 'training' WHEN page_id % 2 = 0 THEN 'frozen_test' ELSE 'external_calibration' END AS part FROM pages),
  ok AS (SELECT * FROM m WHERE page_id % 23 <> 0 AND component <> 'sonar' AND part <> 'training'), frozen AS (SELECT * FROM ok WHERE part = 'frozen_test'),
  issues AS (SELECT component, 'missing license_or_access_terms' AS issue FROM m WHERE page_id % 23 = 0
  UNION ALL SELECT component, 'unknown component' FROM m WHERE page_id % 23 <> 0 AND component = 'sonar'
  UNION ALL SELECT component, 'unknown partition' FROM m WHERE page_id % 23 <> 0 AND component <> 'sonar' AND part = 'training'
  UNION ALL SELECT component, 'source is not a web address' FROM ok WHERE page_id % 19 = 0
  UNION ALL SELECT component, 'digest is not 64 hexadecimal digits' FROM ok WHERE page_id % 29 = 0
  UNION ALL SELECT component, 'independence or tuning flag is neither true nor false' FROM ok WHERE page_id % 31 = 0
  UNION ALL SELECT component, 'frozen group without declared independence' FROM frozen WHERE page_id % 31 = 0 OR page_id % 37 = 0
  UNION ALL SELECT component, 'frozen group was tuned on' FROM frozen WHERE page_id % 41 = 0
  UNION ALL SELECT component, 'group listed more than once' FROM ok GROUP BY component, group_id HAVING count(*) > 1
  UNION ALL SELECT c, i FROM (SELECT unnest(['fuel-system', 'landing-gear']) AS c), (SELECT unnest(['component has no groups', 'no external_calibration group', 'no frozen_test group']) AS i))
  SELECT component, issue, count(*) AS rows FROM issues GROUP BY 1, 2""")
def manifest_issues(spark, d):
    return quality.manifest_issues(manifest_rows(spark, d)).groupBy("component", "issue").agg(F.count("*").alias("rows"))


@query("dq_15_fingerprint_check", """WITH f AS (SELECT CAST(page_id AS VARCHAR) || '.html' AS path, CASE WHEN contains(url, '?') THEN 'unlisted' WHEN contains(url, '#') THEN 'absent'
  WHEN contains(url, '.org/') THEN 'changed' WHEN contains(url, '.net/') THEN 'escaping' END AS kind FROM pages)
  SELECT path, CASE kind WHEN 'escaping' THEN 'unlisted' ELSE kind END AS problem FROM f WHERE kind IS NOT NULL
  UNION ALL SELECT '../' || path, 'path leaves the root' FROM f WHERE kind = 'escaping'""")
def fingerprint_check(spark, d):
    """Page files against a manifest that lacks some, lists absent and changed ones and names paths outside the root."""
    has = lambda part: F.contains(F.col("url"), F.lit(part))
    kind = F.when(has("?"), "unlisted").when(has("#"), "absent").when(has(".org/"), "changed").when(has(".net/"), "escaping").otherwise("same")
    pages = table(spark, d, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), digest(F.col("html")).alias("sha256"), kind.alias("kind"))
    manifest = pages.filter("kind <> 'unlisted'").select(
        F.when(F.col("kind") == "escaping", F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(F.col("kind") == "changed", "0").otherwise(F.col("sha256")).alias("sha256"))
    return quality.fingerprint_mismatches(pages.filter("kind <> 'absent'"), manifest)


@query("dq_16_request_rules", """WITH g AS (SELECT o_orderkey, l_suppkey, l_linenumber, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  p AS (SELECT o_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS u, count(DISTINCT l_linenumber) AS o FROM g GROUP BY 1)
  SELECT o_orderkey, n AS records, 'several units' AS issue FROM p WHERE u > 1 UNION ALL SELECT o_orderkey, n, 'repeated order values' FROM p WHERE o < n
  UNION ALL SELECT o_orderkey, n, 'too many records' FROM p WHERE n > 6""")
def request_rules(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_linenumber")
    records = lines.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return quality.request_issues(records, "o_orderkey", "l_suppkey", "l_linenumber", 6)


@query("dq_17_order_notes", """WITH b AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) // 60 AS bucket FROM orders),
  w AS (SELECT *, bucket - lag(bucket) OVER o AS step, o_orderkey < lag(o_orderkey) OVER o AS came, row_number() OVER o AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM b
  WINDOW o AS (PARTITION BY o_custkey ORDER BY bucket, o_orderkey)),
  p AS (SELECT o_custkey, count(*) AS records, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (came) AS out_of_order, count(*) FILTER (n > c - 9 AND step <> 1) AS broken_tail FROM w GROUP BY 1)
  SELECT *, concat_ws('; ', CASE WHEN records < 10 THEN 'short history' END, CASE WHEN gaps > 0 THEN 'cycle gaps' END, CASE WHEN out_of_order > 0 THEN 'out of order input' END,
  CASE WHEN records >= 10 AND broken_tail > 0 THEN 'last rows not consecutive' END) AS notes FROM p""")
def order_notes(spark, d):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(days / 60).cast("long").alias("bucket"))
    return quality.order_notes(series(rows, "o_custkey", ("bucket", "o_orderkey")), "o_orderkey", "bucket")


@query("flt_01_predicate_filters", f"""WITH {HIST} SELECT o_orderkey, o_custkey, capacity FROM hist
  WHERE rul_training_eligible AND capacity BETWEEN 50000 AND 250000""")
def predicate_filters(spark, d):
    h = labels.discharge_histories(order_histories(spark, d)).frame
    return h.filter(F.col("rul_training_eligible") & F.col("capacity").between(50000, 250000)).select("o_orderkey", "o_custkey", "capacity")


# -- PRJ -------------------------------------------------------------------------------
# Order status codes.
STATUS_NAMES = {"F": "finished", "O": "open", "P": "pending"}


@query("prj_01_rename_and_map", """SELECT o_orderkey AS event_key, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status_name,
  CAST(o_orderstatus <> 'F' AS INTEGER) AS unfinished, o_totalprice AS total_price FROM orders""")
def rename_and_map(spark, d):
    names = F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv])
    named = F.coalesce(F.element_at(names, F.col("o_orderstatus")), F.raise_error(F.lit("unknown status code")).cast("string"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_key"), named.alias("status_name"), flag(F.col("o_orderstatus") != "F").alias("unfinished"),
        F.col("o_totalprice").alias("total_price"))


@query("prj_02_feature_columns", """SELECT l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem""")
def feature_columns(spark, d):
    """Features are what an identifier and label deny-list leaves, prefixes of proxy channels dropped."""
    rows = table(spark, d, "lineitem")
    numeric = [f.name for f in rows.schema if isinstance(f.dataType, T.DoubleType) and not f.name.startswith("l_ship")]
    return rows.select(*[F.col(c).alias(c.lower().removeprefix("l_")) for c in numeric])


@query("prj_03_clipping", f"""SELECT event_id, {rs('least(greatest(value, 5), 125)')} AS both_sides, {rs('greatest(value, 5)')} AS lower_only, {rs('value')} AS open FROM events""")
def clipping(spark, d):
    v = F.col("value")
    return event_rows(spark, d).select("event_id", r(clip(v, 5, 125)).alias("both_sides"), r(clip(v, 5)).alias("lower_only"), r(clip(v)).alias("open"))


@query("prj_04_channel_differences", f"""WITH {SCENARIOS} SELECT event_id, {rs('a - b')} AS pair_difference FROM scen""")
def channel_differences(spark, d):
    return scenario_rows(spark, d).frame.select("event_id", r(F.col("a") - F.col("b")).alias("pair_difference"))


@query("prj_05_condition_groups", """SELECT p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR) AS condition_group, count(*) AS rows FROM part GROUP BY 1""")
def condition_groups(spark, d):
    key = F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string"))
    return table(spark, d, "part").groupBy(key.alias("condition_group")).agg(F.count("*").alias("rows"))


@query("prj_06_risk_band", f"""WITH {EV}, l AS (SELECT user_id, cycle, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul FROM ev)
  SELECT user_id, cycle, CASE WHEN rul <= 30 THEN 'High' WHEN rul <= 60 THEN 'Medium' ELSE 'Low' END AS risk,
  CASE WHEN rul <= 30 THEN 'Inspect Immediately' WHEN rul <= 60 THEN 'Monitor Closely' ELSE 'No Immediate Action Required' END AS recommendation FROM l""")
def risk_bands(spark, d):
    s = labels.remaining_life(event_series(spark, d), "cycle")
    risk = review.risk_band(F.col("rul"))
    return s.frame.select("user_id", "cycle", risk.alias("risk"), review.recommendation(risk).alias("recommendation"))


def component_results(spark, d):
    """Every event as one component's answer; the number in props tells flags, faults and acceptance."""
    component = F.create_map(*[F.lit(x) for x in ("click", "engine", "view", "battery", "error", "fuel-system", "purchase", "landing-gear", "signup", "hydraulic")])
    k = F.from_json("props", "struct<k:int>")["k"]
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.element_at(component, F.col("event_type")).alias("component"), "value", k.alias("k"))
    return rows.withColumns({
        "answered": F.col("value") > 1, "flagged": F.greatest(F.col("k") - 50, F.lit(0)), "fault": F.pmod("k", F.lit(4)),
        "accepted": F.array(F.col("k") < 90, F.when(F.col("value") < 100, F.col("k") > 5)), "tails": flag(F.col("value") > 60)})


RESULTS = """res AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'click' THEN 'engine' WHEN 'view' THEN 'battery' WHEN 'error' THEN 'fuel-system' WHEN 'purchase' THEN 'landing-gear' ELSE 'hydraulic' END AS component,
  value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), tri AS (SELECT *, CASE WHEN value <= 1 THEN 'Unavailable' WHEN component = 'fuel-system' AND k > 50 OR component = 'landing-gear' AND k % 4 > 0 THEN 'Critical'
  WHEN k >= 90 OR (value < 100 AND k <= 5) OR value > 60 THEN 'Caution' ELSE 'Monitor' END AS level, CASE WHEN value <= 1 THEN 'no model response' WHEN component = 'fuel-system' AND k > 50 THEN 'samples flagged'
  WHEN component = 'landing-gear' AND k % 4 > 0 THEN 'fault class predicted' WHEN k >= 90 OR (value < 100 AND k <= 5) THEN 'an output was not accepted' WHEN value > 60 THEN 'input near the edge of the fitted range' ELSE 'no alert' END AS reason FROM res)"""


def triaged(spark, d):
    rows = component_results(spark, d)
    cells = review.attention(F.col("component"), F.col("answered"), F.col("flagged"), F.col("fault"), F.col("accepted"), F.col("tails"))
    return rows.withColumns(cells).withColumns({
        "all_accepted": review.acceptance(F.col("accepted")), "needs_review": review.needs_review(F.col("component"), F.col("accepted"))})


@query("prj_07_attention_level", f"""WITH {RESULTS} SELECT event_id, level, reason, CAST(k < 90 AND (value >= 100 OR k > 5) AS INTEGER) AS all_accepted,
  CAST(component = 'fuel-system' OR NOT (k < 90 AND value < 100 AND k > 5) AS INTEGER) AS needs_review FROM tri""")
def attention_level(spark, d):
    return triaged(spark, d).select("event_id", "level", "reason", flag("all_accepted").alias("all_accepted"), flag("needs_review").alias("needs_review"))


@query("prj_08_result_summary", f"""WITH {RESULTS} SELECT event_id, CASE component WHEN 'engine' THEN 'Estimated RUL: ' || CAST(k AS VARCHAR) || ' cycles' WHEN 'battery' THEN 'SOH: ' || CAST(k AS VARCHAR) || '%; estimated RUL: ' || CAST(k AS VARCHAR) || ' cycles'
  WHEN 'landing-gear' THEN 'Fault: ' || CAST(k % 4 AS VARCHAR) || '; estimated RUL: ' || CAST(k AS VARCHAR) || ' percent' WHEN 'fuel-system' THEN CAST(greatest(k - 50, 0) AS VARCHAR) || ' of 100 samples flagged' END AS summary FROM res""")
def result_summary(spark, d):
    k = F.col("k").cast("double")
    return component_results(spark, d).select("event_id", review.summary(
        F.col("component"), k, k, F.col("fault"), F.col("flagged"), F.lit(100)).alias("summary"))


@query("prj_09_request_summary", """SELECT event_id, CAST(CASE WHEN json_valid(props) THEN len(json_keys(props)) END AS INTEGER) AS fields,
  CASE WHEN NOT json_valid(props) THEN 'unreadable' WHEN len(json_keys(props)) = 0 THEN 'empty' ELSE 'ready' END AS state FROM events""")
def request_summary(spark, d):
    parsed = F.from_json("props", "map<string,string>")
    size = F.size(F.map_keys(parsed))
    return table(spark, d, "events").select(
        "event_id", F.when(parsed.isNotNull(), size).alias("fields"),
        F.when(parsed.isNull(), "unreadable").when(size == 0, "empty").otherwise("ready").alias("state"))


@query("prj_10_output_contract", f"""WITH {EV}, l AS (SELECT *, max(cycle) OVER (PARTITION BY user_id) - cycle AS rul FROM ev)
  SELECT event_id, '{{"component":"engine","estimate":' || CAST(rul AS VARCHAR) || ',"accepted":' || CASE WHEN value <= 100 THEN 'true' ELSE 'false' END ||
  ',"warnings":[' || concat_ws(',', CASE WHEN cycle < 10 THEN '"short history"' END, CASE WHEN value > 100 THEN '"low confidence"' END) || ']}}' AS document FROM l""")
def output_contract(spark, d):
    s = labels.remaining_life(event_series(spark, d), "cycle")
    document = F.struct(F.lit("engine").alias("component"), F.col("rul").alias("estimate"), (F.col("value") <= 100).alias("accepted"),
                        notes((F.col("cycle") < 10, "short history"), (F.col("value") > 100, "low confidence")).alias("warnings"))
    return s.frame.select("event_id", F.to_json(document).alias("document"))
