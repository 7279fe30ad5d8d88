"""The corpus pipeline's stages against plain Python, and their odd cases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from wearpath.llm import near_dup, packing, quality_rules, site_quality
from wearpath.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"alpha{i} beta{i * 7 % 90}" for i in range(60))
ROWS = [(1, WORDS, "en", "a", len(WORDS)), (1, WORDS, "en", "a", len(WORDS)), (1, "another text of the same id " + WORDS, "en", "a", 9), (2, WORDS + " more", "en", "a", 9),
        (None, WORDS, "en", "a", 9), (3, None, None, None, None), (4, "", "de", "b", 0), (5, " ".join(f"w{i}" for i in range(300)), "de", "b", 9), (None, None, None, None, None)]


def rows_of(frame):
    return Counter(tuple(r) for r in frame.select(*pipeline.COLUMNS).collect())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(*pipeline.COLUMNS)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "empty"])
def test_stages_take_any_rows(spark, sf_dir, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], DOCS + ", size int, value string, target double")
    given = Counter(tuple(r) for r in rows)
    for name, stage in pipeline.STAGES[:-1]:
        out = rows_of(stage(spark, frame, sf_dir))
        most = 2 if name == "source_mix" else 1
        assert all(n <= most * given[row] for row, n in out.items()), name  # nothing is made up, cut, or multiplied
    pieces = pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r[0] for r in rows)


def test_filters_keep_what_their_operators_keep(spark, sf_dir, docs):
    labels = table(spark, sf_dir, "labels")
    measured = quality_rules.measures(docs, keep=("doc_id", "source", "lang"))
    for stage, judge in ((pipeline.classify, site_quality.judge), (pipeline.apply_rules, quality_rules.judge)):
        kept = {r.doc_id for r in judge(measured, labels).filter("kept").collect()}
        assert rows_of(stage(spark, docs, sf_dir)) == Counter(tuple(r) for r in docs.collect() if r.doc_id in kept)


def test_one_of_each_group_stays(spark, sf_dir):
    out = rows_of(pipeline.deduplicate(spark, spark.createDataFrame(ROWS, DOCS), sf_dir))
    # Id 1 has two texts, one of them twice: both texts stay, the repeat goes. Id 2 is a near copy of it. Rows without an id stay.
    ids = Counter(row[0] for row in out.elements())
    assert ids == {1: 2, 3: 1, 4: 1, 5: 1, None: 2} and len(out) == 7
    found = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(ROWS, DOCS)).filter("doc_id IS NOT NULL").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_mix_takes_whole_documents_near_the_targets(spark, sf_dir, docs):
    out = rows_of(pipeline.mix_sources(spark, docs, sf_dir))
    given = rows_of(docs)
    size = lambda row: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    assert all(n <= 2 * given[row] for row, n in out.items())
    sizes, words, largest = Counter(), Counter(), Counter()
    for row, n in given.items():
        sizes[row[3]] += n * size(row)
        largest[row[3]] = max(largest[row[3]], size(row))
    for row, n in out.items():
        words[row[3]] += n * size(row)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        open_ -= over
    for s in order:
        assert abs(words[s] - target[s]) <= largest[s] / 2 + 2, s


def test_the_whole_run_is_its_stages(spark, sf_dir, docs):
    staged = docs
    for _, stage in pipeline.STAGES[:-1]:
        staged = pipeline.materialise(stage(spark, staged, sf_dir), "test-stage")
    want = Counter((p.doc_id, p.piece, p.length, p.ids_crc32) for p in packing.packed(staged).collect())
    got = pipeline.run(spark, sf_dir)
    assert Counter((p.doc_id, p.piece, p.length, p.ids_crc32) for p in got.collect()) == want
    full = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("gapless"))
    assert full.filter("n > 1024 OR NOT gapless").count() == 0
