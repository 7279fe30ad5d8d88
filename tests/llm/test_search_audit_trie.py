"""Exact search, source divergence and the prefix trie against plain Python, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wearpath.llm import divergence, mtree, prefix_trie

# -- exact top-k search --------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, score double"


def plain_top(rows, k=5, every=50):
    """All products of integer vectors, the highest first, ties to the smaller id (null last)."""
    known = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, e in rows
             if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q, own in known:
        if q is None or q % every:
            continue
        met = [(-sum(a * b for a, b in zip(own, v)), i is None, i or 0, i) for i, v in known if i != q and len(v) == len(own)]
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(met)[:k], 1)]
    return sorted(out, key=str)


def found_top(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, e, 1, "x", 2, 0.5) for i, e in rows], VECTORS)
    return sorted((tuple(r) for r in mtree.top_k(mtree.integer_vectors(frame), **sizes).collect()), key=str)


def test_search_finds_the_brute_force_answer(spark):
    draw = np.random.default_rng(11)
    rows = [(i, (draw.normal(0, 1, 12) * (1 + i % 7)).astype(np.float32).tolist()) for i in range(400)]
    assert found_top(spark, rows, shard=64, block=3, page=8, fanout=4) == plain_top(rows) == found_top(spark, rows)  # deep trees, shallow ones


def test_search_over_ties_copies_nulls_and_odd_vectors(spark):
    same, other = [0.5, -0.25, 1.0], [0.25, 0.25, 0.25]
    rows = [(i, same) for i in range(0, 120)] + [(200, other), (200, other), (250, same), (250, other), (300, None), (350, [1.0, None, 0.0]), (400, [float("nan"), 0.0, 0.0]),
            (450, [float("inf"), 0.0, 0.0]), (None, same), (500, []), (550, []), (600, [2.0] * 5), (650, [-2.0] * 5), (700, [1e30, 0.0, 0.0]), (750, [0.0, 0.0, 0.0])]
    got = found_top(spark, rows, shard=16, block=2)
    fits = lambda t: max(-(2**63), min(2**63 - 1, t))
    small = [r for r in rows if r[0] != 700]
    assert found_top(spark, small, shard=16, block=2) == plain_top(small)
    huge = [g for g in got if g[0] == 700 and g[2] is not None]
    assert huge and all(g[3] <= fits(2**80) for g in huge)
    assert found_top(spark, []) == [] and found_top(spark, [(50, same)]) == []


def test_search_skips_pages(spark):
    """On clustered vectors the bounds leave most products out, and the answer is whole."""
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 300, (20, 16))
    v = np.floor(centres[draw.integers(0, 20, 4000)] + draw.normal(0, 3, (4000, 16))).astype(np.int64)
    points, most = mtree.lifted(v)
    pages = mtree.bulk_load(points)
    assert {int(r) for p in pages if (p["child"] < 0).all() for r in p["rows"]} == set(range(4000))
    for number, page in enumerate(pages):  # every entry below a routing vector lies within its radius
        for row, child, radius in zip(page["rows"], page["child"], page["radius"]):
            if child >= 0:
                below = mtree.distances(points[pages[child]["rows"]], points[[row]])[:, 0]
                assert (below <= radius + pages[child]["radius"] + 1e-6).all() and np.allclose(below, pages[child]["to_parent"])
    shard = mtree.pd.DataFrame({"v": list(v), "ids": [[i] for i in range(4000)], "nameless": False})
    tree = mtree.Tree(mtree.build((16, 0), shard), 16)
    computed = 0
    for q in range(0, 4000, 400):
        best, n = tree.search(q, v[q], 5, None)
        computed += n
        scores = v @ v[q]
        want = sorted(((-int(s), i) for i, s in enumerate(scores) if i != q))[:5]
        assert sorted((-s, -i) for s, i in best) == want
    assert computed < 10 * 4000 * 0.7


# -- source divergence -----------------------------------------------------------------------------
def plain_audit(rows, least=30):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {t[0] for t in texts}:
        mine = [t for t in texts if t[0] == lang]
        docs = Counter(w for _, _, words in mine for w in set(words))
        kept = [w for w, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())
        price = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q, p = price(whole), {s: price(c) for s, c in counts.items()}
        for s in p:
            pairs = sorted((-sum(abs(p[s][w] - p[t][w]) for w in kept), t.encode(), t) for t in p if t != s)
            out += [(lang, s, "pair", t, -v, rank) for rank, (v, _, t) in enumerate(pairs, 1)]
            over = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:50]
            out += [(lang, s, "term", w, -v, rank) for rank, (v, _, w) in enumerate(over, 1)]
    return sorted(out)


DOCS = "lang string, source string, text string, doc_id long, term string, count int, g int"


def found_audit(spark, rows, **sizes):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], DOCS), **sizes).collect())


def test_divergence_equals_plain_counting(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcäöXY") for _ in range(draw.randint(1, 3))) for _ in range(200)]
    rows = [(draw.choice(["de", "fr"]), f"s{min(draw.randint(0, 9), draw.randint(0, 9))}", draw.choice([" ", ", 3", "\n"]).join(draw.choices(words, weights=range(200, 0, -1), k=draw.randint(0, 60)))) for _ in range(400)]
    want = plain_audit(rows)
    assert found_audit(spark, rows) == want
    # Small blocks: several deals of terms and pairs of blocks of groups, and products cut into pieces.
    assert found_audit(spark, rows, terms=16, per_block=3, columns=40) == want


def test_divergence_of_odd_rows(spark):
    long = "Wort " * 300_000
    rows = [("de", "a", "Ein Wort")] * 30 + [("de", "b", long), ("de", None, None), (None, None, "ein"), (None, "z", ""), ("de", "", "WORT wort"), ("xx", "only", "few words"), ("de", "emoji 🙂", "🙂 12 _")]
    assert found_audit(spark, rows) == plain_audit(rows)
    assert found_audit(spark, []) == []


# -- prefix trie --------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string, id string, size int, path string, n int"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t, key=lambda x: (x[:3], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))] for c, t in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = Counter(t[:-1] for t in members if t)
    out = []
    for node, inside in members.items():
        below = {c2[:d] for c in inside for c2 in [made[c]] for d in range(len(node), len(c2) + 1)}
        leaves = sum(children[b] == 0 for b in below)
        saved = sum((len(members[b]) - 1) * (len(b[-1][1].encode()) if b else 0) for b in below)
        ends = ",".join(map(str, sorted(c for c in inside if len(made[c]) == len(node))))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_trie(spark, rows, per_shard=prefix_trie.TURNS_PER_SHARD):
    frame = spark.createDataFrame([(*r, "i", 1, "p", 2) for r in rows], TURNS)
    found = prefix_trie.classes(prefix_trie.rebuilt(prefix_trie.materialise(prefix_trie.paths(frame), "turns")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.trie(found, per_shard).select(*columns).collect()), key=str)


def dialogues(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(draw.choice([0, 1, 2, 3, 5, 9, 40])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["yes", "no", "Ü" * draw.randint(0, 2), ""]) if turn < 12 else "so on"))
    return rows


@pytest.mark.parametrize("per_shard", [40, 200, 10**6])
def test_trie_equals_plain_prefixes(spark, per_shard):
    """Few different turns, so that prefixes are shared deeply and shards meet inside nodes."""
    rows = dialogues(1, 120)
    assert found_trie(spark, rows, per_shard) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(5, None, "user", "a"), (5, 2, None, None), (5, 1, "user", "b"), (5, 1, "user", "b"), (6, 1, "user", "b"), (None, 1, "user", "lost"), (-3, 0, "user", "x"), (11, 0, "", ""),
            (7, 0, "user", "word " * 200_000), (8, 0, "ab", "c"), (9, 0, "a", "bc")]
    rows += [(12, t, "user", f"t{t}") for t in range(300)] + [(17, t, "user", f"t{t}") for t in range(300)] + [(18, t, "user", f"t{t % 290}") for t in range(300)]
    rows += [(c, 0, "user", "all the same") for c in range(100, 160)]
    assert found_trie(spark, rows, 50) == plain_trie(rows)
    assert found_trie(spark, []) == []


def test_paths_are_sorted_with_their_common_prefixes():
    draw = np.random.default_rng(2)
    paths = sorted({tuple(draw.integers(1, 3, draw.integers(0, 60)).tolist()) for _ in range(400)} | {tuple([1] * n) for n in range(0, 70, 3)})
    shuffled = [paths[i] for i in draw.permutation(len(paths))]
    data = np.array([(x, x) for p in shuffled for x in p], dtype=np.uint64).reshape(-1, 2)
    order, common = prefix_trie.sorted_paths(data, np.r_[0, np.cumsum([len(p) for p in shuffled])])
    assert [shuffled[i] for i in order] == paths and common[0] == -1
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [shared(a, b) for a, b in zip(paths, paths[1:])]
