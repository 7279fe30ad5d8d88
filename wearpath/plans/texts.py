"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..session import table
from .inputs import CHANNELS, epoch_seconds, event_rows
from .registry import flag, query, r, rs


@query("scl_01_timestamp_vector", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def timestamp_vector(spark, d):
    """Times written as six-number vectors and read back."""
    ts = F.col("ts")
    text = F.concat(F.lit("["), F.date_format(ts, "yyyy. M. d. H. m. "), F.date_part(F.lit("SECOND"), ts).cast("string"), F.lit("]"))
    parsed = fn.timestamp_from_vector(text)
    return event_rows(spark, d).select("event_id", fn.wall_micros(parsed).alias("micros"))


@query("scl_02_complex_numbers", f"""SELECT event_id, {rs('value')} AS re, {rs("-CAST(json_extract(props, '$.k') AS DOUBLE)")} AS im, {rs("sqrt(value * value + CAST(json_extract(props, '$.k') AS DOUBLE) ** 2)")} AS magnitude FROM events""")
def complex_numbers(spark, d):
    k = F.from_json("props", "struct<k:int>")["k"]
    z = fn.complex_number(F.concat(F.lit("("), F.col("value").cast("string"), F.lit("-"), k.cast("string"), F.lit("j)")))
    return table(spark, d, "events").select("event_id", r(z["re"]).alias("re"), r(z["im"]).alias("im"), r(fn.magnitude(z)).alias("magnitude"))


@query("scl_03_placeholder_to_null", "SELECT item_id, CASE WHEN trim(text) IN ('', '[]') THEN NULL ELSE length(text) END AS kept_length FROM benchmark UNION ALL SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE length(lang) END FROM documents")
def placeholder_to_null(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.length(fn.missing_to_null(F.col("text"))).cast("long").alias("kept_length"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.length(fn.missing_to_null(F.col("lang"), ("en",))).cast("long").alias("kept_length"))
    return items.unionByName(docs)


@query("scl_04_safe_file_names", """SELECT page_id, CAST(regexp_full_match(substr(url, 9) || '.csv', '[^/\\\\]+\\.[cC][sS][vV]') AS INTEGER) AS whole_safe, CAST(regexp_full_match(CAST(page_id AS VARCHAR) || '.csv', '[^/\\\\]+\\.[cC][sS][vV]') AS INTEGER) AS key_safe FROM pages""")
def safe_file_names(spark, d):
    return table(spark, d, "pages").select(
        "page_id", flag(fn.safe_file_name(F.concat(F.expr("substr(url, 9)"), F.lit(".csv")))).alias("whole_safe"),
        flag(fn.safe_file_name(F.concat(F.col("page_id").cast("string"), F.lit(".csv")))).alias("key_safe"))


@query("scl_05_normalized_text", "SELECT o_orderkey, lower(trim(o_orderpriority)) AS priority FROM orders")
def normalized_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.normalized(F.concat(F.lit("﻿ "), "o_orderpriority", F.lit(" "))).alias("priority"))


@query("scl_06_boolean_words", "SELECT doc_id, quality, toxic, CAST(NULL AS INTEGER) AS unknown FROM labels")
def boolean_words(spark, d):
    word = lambda c: F.when(F.col(c) == 1, " True").otherwise("0")
    return table(spark, d, "labels").select("doc_id", flag(fn.boolean_word(word("quality"))).alias("quality"),
                                            flag(fn.boolean_word(word("toxic"))).alias("toxic"), flag(fn.boolean_word(F.lit("maybe"))).alias("unknown"))


@query("scl_07_format_checks", """SELECT page_id, CAST(regexp_matches(lower(url), '^https?://') AS INTEGER) AS web, 1 AS digest_ok, CAST(length(url) <= 60 AND regexp_full_match(url, '[a-z0-9:/.?=&#_-]+') AS INTEGER) AS id_ok FROM pages""")
def format_checks(spark, d):
    return table(spark, d, "pages").select(
        "page_id", flag(fn.is_web_address(F.col("url"))).alias("web"), flag(fn.is_sha256(fn.digest(F.col("html")))).alias("digest_ok"),
        flag((F.length("url") <= 60) & F.col("url").rlike("^[a-z0-9:/.?=&#_-]+$")).alias("id_ok"))


@query("scl_08_text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.digest(F.col("text")).alias("digest"))


@query("scl_09_math", f"""SELECT event_id, {rs('ln(1 + value)')} AS log1p, {rs('exp(least(value, 20) / 10) - 1', 5)} AS expm1, {rs('sqrt(value)')} AS root, CAST(floor(value) AS BIGINT) AS low, CAST(ceil(value) AS BIGINT) AS high, {rs('abs(value - 50)')} AS away FROM events""")
def math(spark, d):
    v = F.col("value")
    return event_rows(spark, d).select("event_id", r(F.log1p(v)).alias("log1p"), r(F.expm1(F.least(v, F.lit(20)) / 10), 5).alias("expm1"), r(F.sqrt(v)).alias("root"),
                                       F.floor(v).alias("low"), F.ceil(v).alias("high"), r(F.abs(v - 50)).alias("away"))


@query("scl_10_cyclic_encoding", f"""SELECT event_id, {rs('sin(2 * pi() * (epoch_us(ts) / 1e6) / 86400)', 5)} AS day_sin, {rs('cos(2 * pi() * (epoch_us(ts) / 1e6) / 86400)', 5)} AS day_cos FROM events""")
def cyclic_encoding(spark, d):
    turn = 2 * F.pi() * epoch_seconds() / 86400
    return event_rows(spark, d).select("event_id", r(F.sin(turn), 5).alias("day_sin"), r(F.cos(turn), 5).alias("day_cos"))


@query("scl_11_conditionals", f"""SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS band, {rs('least(greatest(value, 10), 60)')} AS clipped FROM events""")
def conditionals(spark, d):
    v = F.col("value")
    return event_rows(spark, d).select("event_id", F.when(v < 10, "low").when(v < 60, "mid").otherwise("high").alias("band"), r(fn.clip(v, 10, 60)).alias("clipped"))


# A band matrix over all 64 places: rising weights on the diagonal, neighbours linked.
_P = tuple(tuple(1.0 + i / 64 if i == j else -0.25 if abs(i - j) == 1 else 0.0 for j in range(64)) for i in range(64))
_FORM_SQL = ("list_sum(list_transform(range(1, 65), lambda i: (1.0 + (i - 1) / 64.0) * v[i] * v[i])) - 0.5 * list_sum(list_transform(range(1, 64), lambda i: v[i] * v[i + 1]))")


@query("scl_12_array_math", f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, {rs('list_avg(v[1:16])')} AS first_mean, {rs('list_stddev_pop(v[49:64])')} AS last_std,
  {rs('list_dot_product(v, v)')} AS square, {rs(_FORM_SQL)} AS form FROM e""")
def array_math(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    places = [F.get("v", F.lit(i)) for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select(
        "vec_id", r(fn.array_mean(F.slice("v", 1, 16))).alias("first_mean"), r(fn.array_std(F.slice("v", 49, 16))).alias("last_std"),
        r(fn.dot(F.col("v"), F.col("v"))).alias("square"), r(fn.quadratic_form(places, _P)).alias("form"))


@query("scl_13_arg_max", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, 'c' || (list_position(v, list_max(v)) - 1) AS winner, """ + rs("list_max(v)") + " AS top FROM e")
def arg_max(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", fn.arg_max([f"c{i}" for i in range(64)], v).alias("winner"), r(F.array_max(v)).alias("top"))


@query("scl_14_soft_gates", f"""WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(-(x - 0.1) * (x - 0.1) / 0.125)) AS g FROM embeddings)
  SELECT vec_id, {rs('g[1] / list_sum(g)')} AS first_gate, {rs('g[64] / list_sum(g)')} AS last_gate, {rs('list_max(g) / list_sum(g)')} AS top_gate,
  {rs('list_sum(list_transform(range(1, 65), lambda i: i * g[i])) / list_sum(g)')} AS centre FROM e""")
def soft_gates(spark, d):
    """The gates of all 64 values: first, last, largest, and the mean place weighted by them."""
    gates = fn.soft_gates(F.transform("embedding", lambda x: x.cast("double") - 0.1), 0.25)
    rows = table(spark, d, "embeddings").select("vec_id", gates.alias("g"))
    centre = F.aggregate(F.transform("g", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", r(F.get("g", F.lit(0))).alias("first_gate"), r(F.get("g", F.lit(63))).alias("last_gate"), r(F.array_max("g")).alias("top_gate"), r(centre).alias("centre"))


@query("scl_15_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_utc FROM events")
def utc_text(spark, d):
    return event_rows(spark, d).select("event_id", fn.utc_seconds(F.col("ts")).alias("at_utc"))


@query("scl_16_json_objects", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',"type":"' || event_type || '"}' AS document FROM events""")
def json_objects(spark, d):
    k = F.from_json("props", "struct<k:int>")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("document"))


@query("scl_17_map_entries", f"""SELECT l_orderkey, l_linenumber, l_suppkey, name, {rs('value')} AS value FROM (SELECT l_orderkey, l_linenumber, l_suppkey, unnest({list(CHANNELS)}) AS name, unnest([{', '.join(CHANNELS)}]) AS value FROM lineitem)""")
def map_entries(spark, d):
    features = F.create_map(*[x for c in CHANNELS for x in (F.lit(c), F.col(c))])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(features).alias("name", "value")).withColumn("value", r("value"))


@query("scl_18_csv_quoting", """SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS cell_digest FROM conversations""")
def csv_quoting(spark, d):
    text = F.col("text")
    cell = F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return table(spark, d, "conversations").select("conv_id", "turn", fn.digest(cell).alias("cell_digest"))


@query("scl_19_membership", "SELECT p_partkey, CAST(p_size IN (1, 5, 9, 23) AS INTEGER) AS listed, CAST(p_type IN ('ECONOMY', 'SMALL') AS INTEGER) AS small_type FROM part")
def membership(spark, d):
    sizes = F.array(*[F.lit(v) for v in (1, 5, 9, 23)])
    return table(spark, d, "part").select("p_partkey", flag(F.array_contains(sizes, F.col("p_size"))).alias("listed"),
                                          flag(F.col("p_type").isin("ECONOMY", "SMALL")).alias("small_type"))
