"""Operators that SQL cannot express, against plain Python, exact round trips or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wearpath.llm import fingerprints, langid, lm_scoring, near_dup, packing, queries, warc
from wearpath.session import table


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r.doc_id, r.text or "", r.lang) for r in table(spark, sf_dir, "documents").collect()]


def test_op1_counts_and_base(spark, sf_dir, documents):
    found = {r.doc_id: r for r in queries.BUILDERS["op1_context_mixing"](spark, sf_dir).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t, _ in documents}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = found[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and r.bits == pytest.approx(-r.score / math.log10(2))
    assert sum(r.score for r in found.values() if not r.held_out) > sum(r.base_score for r in found.values() if not r.held_out)


def test_op1_mixes_contexts_over_word_boundaries(spark):
    """The whole text is priced: the order of words, white space and bytes far behind a cut of a long text all count."""
    rows = [(i, "alpha beta gamma delta " * 5, "en") for i in range(120)]
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    texts = ["alpha beta gamma delta alpha beta", "beta alpha delta gamma beta alpha", "alpha  beta\ngamma delta alpha beta", "ALPHA beta gamma delta alpha beta"]
    rows = [r for r in rows if r[0] not in held] + [(i, t, "en") for i, t in zip(held, texts)]
    found = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    asked, turned, spaced, upper = (found[i] for i in held)
    assert asked.base_score == pytest.approx(turned.base_score) == pytest.approx(spaced.base_score)
    assert asked.score > turned.score + 3 and asked.score > spaced.score + 1 and upper.score == asked.score


def test_op1_against_single_bits():
    """Counts, contexts and mixing of whole texts against a plain loop over bits; a long text's cuts change nothing."""
    texts = [b"the cat sat on the mat", b"", "thé cat  sat".encode(), b"on the cat " * 30]
    cells = np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SLOTS, dtype=np.int32)
    plain = defaultdict(lambda: [0, 0])
    data, owner = lm_scoring.laid_out(texts)
    ctx = lm_scoring.contexts(data, owner)
    for _, value, rows in lm_scoring.nibbles(data, ctx):
        for r in rows:
            np.add.at(cells, r + value, 1)
    for _, _, bit, slots in lm_scoring.bits(data, ctx):
        for s in slots:
            for a, b in zip(s.tolist(), bit.tolist()):
                plain[a][b] += 1
    zeros, ones = lm_scoring.bit_counts(cells)
    assert all((zeros[s], ones[s]) == tuple(c) for s, c in plain.items()) and (zeros + ones > 0).sum() == len(plain)
    # What stands before a byte, spelt out: equal hashes where and only where it is equal.
    at, seen = 0, [defaultdict(set) for _ in lm_scoring.ORDERS]
    for t in texts:
        for i in range(len(t) + 1):
            words = t[:i].replace(b" ", b" |").split(b"|")
            spans = [(min(i, k), t[max(0, i - k):i]) for k in lm_scoring.BYTES] + [words[-1][-32:], (b"".join(words[-2:]))[-32:]]
            for k, span in enumerate(spans):
                seen[k][span].add(int(ctx[k][at]))
            at += 1
    for by in seen:
        assert all(len(h) == 1 for h in by.values()) and len({next(iter(h)) for h in by.values()}) == len(by)
    model = lm_scoring.Speller(zeros, ones).freeze()
    got, total, at = model.log10(texts), np.zeros(len(texts)), 0
    for place, node, bit, slots in lm_scoring.bits(data, ctx):
        for i in range(len(data)):
            x = [int(model.stretched[s[i]]) for s in slots]
            dot = sum(lm_scoring.SCALE * w * v for w, v in zip(model.weights[place * (len(x) + 1) + sum(v != 0 for v in x)], x))
            spot = (min(max(dot, -7.999), 7.999) + 8) * 2
            row, low = model.refined[node[i]], int(spot)
            p = 0.25 / (1 + math.exp(-dot)) + 0.75 * (row[low] + (row[low + 1] - row[low]) * (spot - low))
            total[owner[i]] += math.log10(min(max(p if bit[i] else 1 - p, 1e-6), 1 - 1e-6))
    assert got == pytest.approx(total, rel=1e-4)
    long = b"a cut text of words and more words " * 20_000
    lm_run, whole = lm_scoring.RUN, model.log10([b"on", long, b"the"])
    try:
        lm_scoring.RUN = 1 << 22
        assert whole == pytest.approx(model.log10([b"on", long, b"the"]), rel=1e-9)
    finally:
        lm_scoring.RUN = lm_run


def test_op1_spelling_is_a_distribution():
    words = [b"the", b"then", b"than", b"on", b"", "é".encode()]
    zeros = np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SLOTS, dtype=np.int32)
    ones = zeros.copy()
    data, owner = lm_scoring.laid_out(words)
    for _, _, bit, slots in lm_scoring.bits(data, lm_scoring.contexts(data, owner)):
        for s in slots:
            np.add.at(ones, s[bit == 1], 1)
            np.add.at(zeros, s[bit == 0], 1)
    model = lm_scoring.Speller(zeros, ones)
    learner = model.learner()
    learner.learn(words)
    model.weights = learner.weights
    model.freeze()
    one = model.log10([b""])[0]
    # The byte after "the" is one of 256: their chances, each with what ends the word next, stay below one in all.
    longer = model.log10([b"the" + bytes([b]) for b in range(256) if b != 32])
    assert np.sum(10.0 ** longer) + 10.0 ** model.log10([b"the"])[0] < 1
    assert one < 0 and model.log10([b"the"])[0] > model.log10([b"xqz"])[0]


def test_op1_scores_do_not_depend_on_the_tasks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r.doc_id: r.score for r in lm_scoring.score(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(found[1][k] == pytest.approx(v, rel=1e-12) for k, v in found[0].items())


def test_op1_long_unknown_tokens_cost_by_their_length(spark):
    rng = random.Random(2)
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    unbroken = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (1000, 2000, 40_000)]
    rows = [(i, f"some words of a text with number {i}", "en") for i in range(200) if i not in held] + [(i, t, "en") for i, t in zip(held, unbroken)]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    a, b, c = (got[i] for i in held)
    assert a < -1000 and b == pytest.approx(2 * a, rel=0.1) and c == pytest.approx(40 * a, rel=0.1)


def test_op1_learns_from_every_word_and_language(spark, monkeypatch):
    words = [f"{a}{b}{c}".encode() for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    zeros = np.zeros(len(lm_scoring.ORDERS) * lm_scoring.SLOTS, dtype=np.int32)
    ones = zeros.copy()
    data, owner = lm_scoring.laid_out(words)
    for _, _, bit, slots in lm_scoring.bits(data, lm_scoring.contexts(data, owner)):
        for s in slots:
            np.add.at(ones, s[bit == 1], 1)
            np.add.at(zeros, s[bit == 0], 1)
    met = []
    refine_by = lm_scoring.Speller.refine_by
    monkeypatch.setattr(lm_scoring.Speller, "refine_by", lambda self, cell, hits, share: (met.append(hits.sum()), refine_by(self, cell, hits, share))[1])
    fitted = lm_scoring.fit(lm_scoring.Speller(zeros, ones), spark.createDataFrame([(w,) for w in words], "word binary").repartition(3))
    assert met == [8 * len(data)]
    assert np.isfinite(fitted.weights).all() and (fitted.weights != 0.35).any()
    # Twelve languages with words of their own: each has a gate, so each prices its words alike.
    rows = [(i, " ".join(f"w{i % 12}x{(i + k) % 5}" for k in range(20)), f"l{i % 12:02}") for i in range(600)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("NOT held_out").collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id % 12].append(r.score)
    means = [sum(v) / len(v) for v in by.values()]
    assert len(means) == 12 and max(means) - min(means) < 0.1 * abs(sum(means) / 12)


def test_op4_against_direct_parsing(spark, sf_dir, documents):
    found = {r.doc_id: r for r in queries.BUILDERS["op4_phrase_fingerprint"](spark, sf_dir).collect()}
    ordered = sorted(documents, key=lambda d: -d[0])
    for (i, text, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = fingerprints.edited(text, following)
        own, other, then = fingerprints.sketches([text, changed, following])
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(own), fingerprints.written(other))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(own, other), fingerprints.likeness(own, then))


def test_op4_parsing_is_local():
    rng = random.Random(4)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = (fingerprints.phrase_names([(x + middle + y).encode()])[0][2] for x, y in (("", "tail"), ("some other beginning", "")))
    assert len(set(a) & set(b)) >= 0.95 * max(len(set(a)), len(set(b)))


def test_op4_keeps_as_many_names_as_before_they_were_shortened():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    (sketch,) = fingerprints.sketches([text])
    assert len(sketch[fingerprints.LEVEL]) == 48 and len(fingerprints.written(sketch)) == 2 + 48 * 8


def test_op5_round_trip(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.TOKENIZER)
    ids = {i: np.array(model.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for i, t, _ in documents}
    rows = queries.BUILDERS["op5_best_fit_packing"](spark, sf_dir).collect()
    ends, total = defaultdict(list), 0
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
        ends[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, ids.values()))
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(ends) <= 1.03 * -(-total // 1024) + 1


@pytest.mark.parametrize("text", ["", " ", "a  b", "a\n\nb ", "x y", "it's fine, isn't it?\nyes. no", "<|endoftext|>", " lead", "tab\tb", "12,5. a,. b.,"])
def test_op5_encoder_equals_the_tokenizer(text):
    e = packing.encoder(packing.TOKENIZER)
    for t in (text, f"word {text} word", f"{text} {text}"):
        assert e.encode([t])[0] == e.whole(t)


def test_op6_rejects_magic_in_payloads(spark):
    rng = random.Random(1)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "".join(rng.choice(["x" * 50, "\r\n\r\n", fake, "\r\n\r\n" + fake, "\r\n\r\nWARC/1.1\r\n", "é"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, None)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, html string").repartition(2)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    first = {}
    for i, body in rows:
        first.setdefault(body or "", i)
    assert len(got) == len(rows)
    for i, body in rows:
        data, r = (body or "").encode(), got[i]
        origin = first[body or ""]
        assert (r.payload_bytes, r.payload_digest, r.intact) == (len(data), warc.payload_digest(data), True)
        assert (r.record_type, r.refers_to) == (("response", None) if origin == i else ("revisit", origin))


@pytest.mark.parametrize("size", ["250", "100000"])
def test_op6_magic_at_the_edges_of_payloads(spark, size):
    magic, blank = "WARC/1.1", "\r\n\r\n"
    bodies = [magic, "text" + blank + magic, magic + "\r\n", blank + magic + blank + magic, "a " + magic + "\r\nb", magic + blank, "\r\n" + magic + "\r\n" + magic]
    rows = [(i, f"{body}" if i % 2 else f"{i}{body}") for i, body in enumerate(bodies)] + [(99, "the last one")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, html string").coalesce(1)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {i: (r.payload_digest, r.intact) for i, r in got.items()} == {i: (warc.payload_digest(body.encode()), True) for i, body in rows}


def test_op6_reports_a_chain_that_ends_early(spark, tmp_path):
    whole = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(whole.encode() * 2)
    assert warc.read(spark, str(tmp_path)).count() == 2
    (tmp_path / "b.warc").write_bytes(whole.encode() + whole.encode()[:-9])
    with pytest.raises(ValueError, match="b.warc"):
        warc.read(spark, str(tmp_path))


def test_op7_held_out_accuracy(spark, sf_dir, documents):
    lang = {i: g for i, _, g in documents}
    rows = [r for r in queries.BUILDERS["op7_language_id"](spark, sf_dir).collect() if r.held_out]
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_op9_keeps_good_and_rejects_bad(spark):
    sf_dir = "/root/testdata/sf0.01"  # 58 bad labels; the smallest tables have 11
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = [r for r in queries.BUILDERS["op9_site_quality"](spark, sf_dir).collect() if r.doc_id in labels]
    good, bad = ([r for r in rows if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)


def _plain_components(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_op10_edited_copies_and_shared_passages(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, key = [], 0
    for _ in range(3):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for at in rng.sample(range(120), edits):
                w[at] = word()
            rows.append((key, " ".join(w)))
            key += 1
    for n in (5, 10, 15, 40, 200):
        for _ in range(4):
            rows.append((key, " ".join([word() for _ in range(n)] + passage)))
            key += 1
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _plain_components(rows)


def test_language_vector_has_length_one():
    where, counts = langid.counted("Der Hund")
    x = langid.vector(where, counts, np.ones(langid.FEATURES))
    assert float(x @ x) == pytest.approx(1)


def test_op10_blocks_find_every_link_between_components(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 4)
    monkeypatch.setattr(near_dup, "MATRIX_COLUMNS", 16)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(30):  # edited copies whose similarity to each other lies on both sides of the threshold
        own = list(base)
        for _ in range(i % 4):
            own[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    listed = [(v, i, 56, float(i), i // 2) for i in range(30) for v in (1, 2)] + [(3, 40, 5, 0.0, 40), (3, 41, 5, 0.0, 40)]
    listed = spark.createDataFrame(listed, "value long, doc_id long, n long, central double, component long")
    placed = near_dup.in_blocks(listed)
    assert placed.filter("doc_id >= 40").count() == 0 and placed.select("lo", "hi").distinct().count() > 1
    links = near_dup.block_links(placed, spark.createDataFrame(texts, "doc_id long, text string")).collect()

    def shingles(t):
        w = t.split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    own = [shingles(t) for _, t in texts]
    linked = {(a, b) for a in range(30) for b in range(a) if a // 2 != b // 2 and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])}
    assert 0 < len(linked) < 400
    assert {(r.b, r.a) for r in links} <= linked
    assert {tuple(sorted((r.a // 2, r.b // 2))) for r in links} == {tuple(sorted((a // 2, b // 2))) for a, b in linked}


def test_op6_leaves_no_tables_of_its_rounds(spark):
    """What a round or a step has read is deleted, and tables of places name files by number."""
    from wearpath import session

    rows = [(i, f"text {i} " + "x" * 200) for i in range(64)]
    known = set(session._FOLDERS)
    assert warc.round_trip(spark.createDataFrame(rows, "page_id long, html string").coalesce(1)).count() == len(rows)
    left = sorted(path.rsplit("/", 1)[1].split("-")[0] for _, path in set(session._FOLDERS) - known)
    assert left == ["candidates", "files", "reached", "warc"]
