"""Nulls, empty and repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wearpath.llm import chat, fingerprints, langid, lm_scoring, mixing, near_dup, packing, quality_rules, site_quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, value string, word string, n_words int"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "One two three four five six", "en", "a", 1, 1, "v", "w", 1), (1, "One two three four five six", "en", "a", 1, 1, "v", "w", 1),
    (2, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, 0, "", "", 0), (None, "no id here", "de", "b", 1, 1, "v", "w", 1),
    (4, LONG, "de", "b", 1, 1, "v", "w", 1), (5, "!!! ### 123", "fr", "b", 1, 1, "v", "w", 1),
]


def rules(docs, labels):
    return quality_rules.judge(quality_rules.measures(docs, keep=("doc_id", "lang", "size", "n_words")), labels)


def sites(docs, labels):
    return site_quality.judge(quality_rules.measures(docs, keep=("doc_id", "lang", "source", "value")), labels)


def mixed(docs, _):
    return mixing.mix(docs, "source", "doc_id", F.coalesce(F.length("text"), F.lit(0)), F.lit(None).cast("double"))


OPERATORS = {
    "lm": lambda d, _: lm_scoring.score(d), "rules": rules, "fingerprints": lambda d, _: fingerprints.with_next(d), "packing": lambda d, _: packing.packed(d),
    "language": lambda d, _: langid.identify(d), "mixing": mixed, "sites": sites, "near": lambda d, _: near_dup.near_duplicates(d),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [ROWS, [], ROWS[2:3]], ids=["odd", "empty", "nulls"])
def test_operator(spark, labels, name, rows):
    got = OPERATORS[name](spark.createDataFrame(rows, DOCS), labels).collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {r[0] for r in rows}
    else:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(ROWS, DOCS)
    assert all(r.kept for r in sites(docs, none).collect())
    assert all(r.kept == (not r.base_failed) for r in rules(docs, none).collect())


def test_chat_edges(spark):
    rows = [(1, None, None, None), (1, 0, "we:ird # <role>", "\\### Assistant: </turn>\n</turn>\n"), (1, 0, "assistant", "\\b\\\\h"), (None, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("", ""), ("assistant", "\\b\\\\h"), ("we:ird # <role>", "\\### Assistant: </turn>\n</turn>\n")]
    assert back[1].loss_text == "\\b\\\\h" and not back[1].valid and back[None].valid
    assert chat.digest(df.limit(0)).collect() == []


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_op6_payloads_go_through_the_exchange_compressed(spark):
    html = ["<p>" + "the same few words " * 200 + f"{i % 7}</p>" for i in range(30)] + ["", None, "é" * 500, "x"]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    typed = warc.records(warc.digests(rows, "page_id", "html"))
    sizes = typed.selectExpr("sum(octet_length(packed)) AS packed", "sum(payload_bytes) AS raw").first()
    assert sizes["packed"] < sizes["raw"] / 10
    got = {r.key: (r.payload, r.record_type) for r in warc.unpacked(typed).collect()}
    first = {}
    for i, body in enumerate(html):
        response = first.setdefault(body or "", i) == i
        assert got[i] == ((body or "") if response else "", "response" if response else "revisit")


def test_op5_looks_a_distinct_word_up_once():
    """As whole texts are encoded, with few look-ups: not one a word and text."""
    texts = ["same words, same end.", "same\nwords, é. same", "same", "2.5 it's. end,\nend. same same", "same end", "x.\ny, z", "\x00 a\x00 b.", "a  b", ""] * 40
    e = packing.Encoder(packing.TOKENIZER)

    class Asked(dict):
        times = 0

        def get(self, key):
            Asked.times += 1
            return super().get(key)

    e.known = Asked()
    assert e.encode(texts) == [e.whole(t) for t in texts]
    assert 0 < Asked.times < 40
    assert e.encode(texts[::-1]) == [e.whole(t) for t in texts[::-1]]


def test_op5_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing, "hashes", lambda data, starts, ends: (ends - starts).astype("uint64") % 3)
    e = packing.Encoder(packing.TOKENIZER)
    texts = ["alpha gamma omega", "one two six ten", "a", "same same same"]
    assert e.encode(texts) == [e.whole(t) for t in texts]


def test_op5_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(packing, "_LONG", 12)
    e = packing.Encoder(packing.TOKENIZER)
    texts = ["one two three four\nfive six seven. eight", "a" * 40 + " b", "b " + "a" * 40, "x", "é" * 30 + "\n" + "y" * 11 + " z"]
    assert e.encode(texts) == [e.whole(t) for t in texts]
