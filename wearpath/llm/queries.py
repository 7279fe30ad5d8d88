"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, table
from . import chat, divergence, fingerprints, langid, lm_scoring, mixing, mtree, near_dup, packing, prefix_trie, quality_rules, site_quality, warc
from .columns import text_of, word_count
from .registry import BUILDERS, SQL, query  # noqa: F401

MINUS_SEVEN = "\\### Assistant: </turn> ok"


def conversations(spark, folder):
    extra = spark.createDataFrame([(-7, 0, "user", MINUS_SEVEN), (-7, 1, "assistant", MINUS_SEVEN)], "conv_id long, turn long, role string, text string")
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)


@query("op2_chat_format", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
m AS (SELECT *, row_number() OVER w AS pos, lag(role, 1, 'start') OVER w AS before FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant') AS fits,
      length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 15 AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, bool_and(fits) AND arg_max(role, pos) IN ('user', 'assistant') AS valid
FROM s GROUP BY conv_id""")
def op2_chat_format(spark, folder):
    return chat.digest(conversations(spark, folder))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
RULES_SQL = rf"""
d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) >= 2),
p AS (SELECT row, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY row),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals FROM d LEFT JOIN p USING (row)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [n_symbols / greatest(1, n_words), n_repeat_words / greatest(1, n_words), n_dup_lines / greatest(1, n_lines),
              n_exclaims / greatest(1, n_words), n_capitals / greatest(1, word_chars)] AS rates FROM m),
h AS (SELECT v.lang, v.rates, l.good FROM v JOIN (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) l USING (doc_id)
      WHERE NOT base_failed),
t AS (SELECT lang, s, c, count(*) FILTER (good) AS n, count(*) FILTER (good AND rates[s] > c) AS k, count(*) FILTER (NOT good AND rates[s] > c) AS bad
      FROM h, (VALUES (1), (2), (3), (4), (5)) a(s), (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)) b(c) GROUP BY ALL),
q AS (SELECT *, CASE WHEN k < n * 0.01 THEN list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) ELSE 1 END AS p, (SELECT count(*) FROM t) AS tests FROM t),
b AS (SELECT lang, s, arg_max(c, (bad - 5 * k) * 1000 + c) AS cutoff FROM q WHERE p <= 0.05 / tests AND bad - 5 * k > 0 GROUP BY lang, s),
z AS (SELECT v.*, NOT base_failed AND NOT EXISTS (SELECT 1 FROM b WHERE b.lang IS NOT DISTINCT FROM v.lang AND v.rates[b.s] > b.cutoff) AS kept FROM v)"""


@query("op3_risk_rules", f"WITH {RULES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM z")
def op3_risk_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    measured = materialise(quality_rules.measures(docs, keep=("doc_id", "lang")), "measures")
    return quality_rules.judge(measured, table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_source_mix", r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('8/' || coalesce(doc_id::VARCHAR, 'none')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / CASE WHEN text = '' THEN 1.0 ELSE greatest(0.1, 1 - 10.0 * length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g')) / length(text)) END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0 * n / w AS ratio, 1.5 * sum(n) OVER () AS total, sum(w) OVER () AS ws FROM s),
e AS (SELECT *, coalesce(sum(2.0 * n) OVER o, 0) AS stopped, coalesce(sum(w) OVER o, 0) AS gone FROM f
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - stopped) / (ws - gone) AS level FROM e),
t AS (SELECT source, n, least(2.0 * n, coalesce(w * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level), 2.0 * n)) AS target FROM l),
b AS (SELECT *, CASE WHEN n > 0 THEN floor(floor(target) / n) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (SELECT k.*, b.n, b.target, b.epochs, floor(target)::BIGINT - epochs * n AS rest,
      sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, round(target, 4) AS target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM p""")
def op8_source_mix(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    text = text_of("text")
    sized = docs.select("doc_id", "source", word_count(text).alias("__size"), mixing.text_quality(text).alias("__quality"))
    mixed = mixing.mix(sized, "source", "doc_id", F.col("__size"), F.col("__quality"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


@query("op10_bottomk_dedup", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op10_bottomk_dedup(spark, folder):
    return near_dup.near_duplicates(table(spark, folder, "documents"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


@query("op6_warc_chain", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: ('0x' || '0' || substr(hex, (i * 5) // 4 + 1, 3))::BIGINT // pow(2, 7 - (i * 5) % 4)::BIGINT % 32) AS fives FROM (SELECT page_id, n, first, hex || '00' AS hex FROM h))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM b""")
def op6_warc_chain(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query("op7_language_id")
def op7_language_id(spark, folder):
    return langid.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query("op9_site_quality")
def op9_site_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    measured = materialise(quality_rules.measures(docs, keep=("doc_id", "source", "lang")), "measures")
    return site_quality.judge(measured, table(spark, folder, "labels")).select("doc_id", "source", "lang", "evidence", "site_rate", "quality", "kept")


@query("op4_phrase_fingerprint")
def op4_phrase_fingerprint(spark, folder):
    return fingerprints.with_next(table(spark, folder, "documents"))


@query("op1_context_mixing")
def op1_context_mixing(spark, folder):
    return lm_scoring.score(table(spark, folder, "documents").select("doc_id", "text", "lang"))


@query("op11_mtree_search", """
WITH r AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
c AS (SELECT row_number() OVER () AS row, vec_id, v FROM r),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM c q JOIN c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank, vec_id, score FROM p
QUALIFY rank <= 5""")
def op11_mtree_search(spark, folder):
    return mtree.top_k(mtree.integer_vectors(table(spark, folder, "embeddings")))


@query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, row, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, d.source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS count, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v))::BIGINT AS p,
             (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v))::BIGINT AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE count > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE 'C')::INT AS rank
FROM x QUALIFY part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_prefix_trie", r"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) AS t FROM (SELECT unnest(range(256)) AS b)),
crc_table AS (SELECT list(t ORDER BY b) AS t FROM bits),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda x, s: xor(x >> 8, t[(xor(x, s) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
m AS (SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5 WHERE o.pos <= h
      UNION ALL SELECT h.conv_id, o.pos + 1000000, o.role, o.text FROM h JOIN o USING (conv_id) WHERE o.pos > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, strlen(text) AS bytes,
             string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM m
      UNION ALL SELECT conv_id, 0, 0, '' FROM h),
l AS (SELECT conv_id, max(depth) AS len FROM r GROUP BY 1),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends FROM r JOIN l USING (conv_id) GROUP BY ALL),
c AS (SELECT a.*, count(b.path) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.path[:32 * a.depth] = a.path GROUP BY ALL),
s AS (SELECT r.depth, r.path, count(*) FILTER (c.n_children = 0) AS n_leaves, sum(c.own) AS saved FROM c JOIN r ON r.conv_id = c.conv_id AND r.depth <= c.depth GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM c JOIN s USING (depth, path) LEFT JOIN n p ON p.depth = c.depth - 1 AND p.path = c.path[:32 * (c.depth - 1)]""")
def op13_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
