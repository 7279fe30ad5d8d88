"""Near-duplicate documents by bottom-k sketches from one hash function.

1. *Sets.* A document's set holds the 64-bit hashes of its distinct shingles (five lower-cased words; the whole
   sequence if it is shorter). Its sketch is the ``K`` smallest hashes. Documents with equal sets are one class,
   represented by its smallest id; only representatives go on.
2. *Inverted lists.* For two sets of similarity 0.75 or more each of the K smallest hashes of the union
   is in both sets with that chance, so they share `need` retained values with all but certainty (for K = 64 they
   share fewer than 31 with a chance of about 1e-6). Hence they share a value among each one's rarest
   ``retained - need + 1`` values: only those are listed, which leaves passages that many documents contain out.
3. *Overlaps.* Within a list every member is compared with one member, the hub: the one whose retained values are the
   most common, which is the text that a group of edited copies goes back to. A member keeps the hub that the most
   lists offer. After the links found are joined up, members of lists that still span several components are compared
   with hubs drawn by a hash. What then still spans several components is compared in pairs of bounded blocks, each
   with its documents' full sets; no pair but a link leaves a block. Pairs within a component need no comparison.
4. *Estimate.* The bottom-k of the united sketches estimates similarity; pairs far below the threshold go.
5. *Verification.* Full shingle sets of both texts decide: 100 * intersection >= 75 * union.
6. *Components* of the confirmed links by `components`.

Defined cases: null and empty texts have an empty set and no links; copies share all links; rows with the
same id are one node; a null id takes the component of its class, if any, and is kept only if nothing else is
known of it; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, passing
from .batches import LOWERED, bytes_of, combined, hashes, ranges, word_places
from .components import components

WORDS, PERCENT = 5, 75
K, NEED = 64, 31
#: The share of the united sketch that two sets of similarity 0.75 have in common is below this with a chance of about 1e-6.
LEAST_ESTIMATE = NEED / K
#: The most documents and shingles of a block, on average, and the columns of a matrix piece in the block comparison.
BLOCK_DOCS, BLOCK_SHINGLES, MATRIX_COLUMNS = 512, 1_000_000, 4096


def shingle_sets(column: pa.Array, words: int = WORDS):
    """Yields the sorted distinct shingle hashes of each row of a string column."""
    data, offsets = bytes_of(column)
    for lo, hi in ranges(offsets):
        own = offsets[lo:hi + 1] - offsets[lo]
        piece = LOWERED[data[offsets[lo]:offsets[hi]]]
        starts, ends, rows = word_places(piece, own)
        h = hashes(piece, starts, ends)
        bounds = np.searchsorted(rows, np.arange(hi - lo + 1))
        rolled = combined([h[i:len(h) - words + 1 + i] for i in range(words)]) if len(h) >= words else h[:0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= words:
                yield np.unique(rolled[a:b - words + 1])
            elif b > a:
                yield combined([h[i:i + 1] for i in range(a, b)] + [np.array([b - a], dtype=np.uint64)])
            else:
                yield h[:0]


def sets(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text) -> doc_id, n (set size), print (digest of the set, null if empty), sketch (ascending values)."""
    def run(batches):
        for batch in batches:
            n, prints, values, places = [], [], [], [0]
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                prints.append(None if len(s) == 0 else _print(s))
                values.append(s[:k])
                places.append(places[-1] + len(values[-1]))
            flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, dtype=np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.string()), sketch], ["doc_id", "n", "print", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print string, sketch array<long>")


def _print(s: np.ndarray) -> str:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()


def need(n: Column) -> Column:
    """How many retained values a set of n shingles shares with any set it is linked with."""
    return F.when(n <= K * PERCENT // 100, F.ceil(n * PERCENT / 100)).otherwise(F.lit(NEED)).cast("int")


def lists(reps: DataFrame) -> DataFrame:
    """(value, doc_id, n) for the values of each document's sketch that may be its rarest shared one, where others have them too."""
    postings = reps.select("doc_id", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    found = postings.join(shared, "value")
    mine = Window.partitionBy("doc_id")
    ranked = found.withColumns({"alone": F.col("kept") - F.count(F.lit(1)).over(mine), "central": F.sum("df").over(mine) / F.col("kept")}).withColumn(
        "rank", F.col("alone") + F.row_number().over(mine.orderBy("df", "value")))
    return ranked.filter(F.col("rank") <= F.col("kept") - need(F.col("n")) + 1).select("value", "doc_id", "n", "central")


def alike_in_size(n: Column, m: Column) -> Column:
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def hub_pairs(listed: DataFrame, central: bool) -> DataFrame:
    """Each document with the hub that the most of its lists offer: (a, b). ``listed``: value, doc_id, n, central, component."""
    first = -F.col("central") if central else F.xxhash64("doc_id", "value")
    draw = F.struct(first.alias("h"), F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component"))
    hubs = listed.groupBy("value").agg(F.min(draw).alias("draw")).select("value", "draw.*")
    offers = listed.join(hubs, "value").filter((F.col("component") != F.col("hub_component")) & alike_in_size(F.col("n"), F.col("hub_n")))
    votes = offers.groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("votes", F.col("hub"))).alias("best"))
    return best.select(F.least("doc_id", "best.hub").alias("a"), F.greatest("doc_id", "best.hub").alias("b")).distinct()


def in_blocks(listed: DataFrame) -> DataFrame:
    """Members of lists that span several components, once for each pair of blocks that meet in a list: (lo, hi, doc_id, component).

    Documents are dealt into blocks of bounded size by the most common of their lists, so that members of a group meet
    in few blocks. Lists are reduced to their blocks first: blocks meet blocks, whatever number of documents and lists
    says so, and documents join the distinct pairs. A group of m members is sent m / BLOCK_DOCS times.
    """
    spread = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    open_ = materialise(listed.join(spread.select("value", "members"), "value").select("value", "members", "doc_id", "n", "component"), "open")
    homes = open_.groupBy("doc_id", "n", "component").agg(F.max(F.struct("members", "value"))["value"].alias("home"))
    salts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES))
    sizes = homes.groupBy("home").agg(salts.alias("salts"))
    dealt = materialise(homes.join(sizes, "home").select("doc_id", "component", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), "salts")).alias("block")), "dealt")
    met = materialise(open_.join(dealt.select("doc_id", "block"), "doc_id").groupBy("value", "block").agg(F.min("component").alias("least"), F.max("component").alias("most")), "met")
    # Lists that meet the same blocks with the same spans say the same: one of each kind goes on. Two sums of hashes tell the kinds apart.
    marks = [F.sum(F.xxhash64(*c).cast("decimal(38,0)")).alias(name) for name, c in (("s", ("block", "least", "most")), ("t", (F.lit(1), "most", "least", "block")))]
    kinds = met.groupBy("value").agg(*marks).groupBy("s", "t").agg(F.min("value").alias("value")).select("value")
    one = met.join(kinds, "value")
    other = one.select("value", F.col("block").alias("hi"), F.col("least").alias("other_least"), F.col("most").alias("other_most"))
    apart = (F.col("least") != F.col("other_least")) | (F.col("most") != F.col("other_most")) | (F.col("least") != F.col("most"))
    pairs = one.join(other, "value").filter((F.col("block") <= F.col("hi")) & apart).select(F.col("block").alias("lo"), "hi").distinct()
    sides = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return sides.join(dealt, "block").select("lo", "hi", "doc_id", "component")


def common_counts(sets_: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all sets of a block, by products of 0/1 matrices of a few thousand shared values."""
    owner = np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
    values, column, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # a value of one set alone is in no intersection
    shared = times[column] > 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(sets_), len(sets_)), dtype=np.float32)  # exact up to 2^24
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + MATRIX_COLUMNS])
        rows, own = np.unique(owner[lo:hi], return_inverse=True)
        piece = np.zeros((len(rows), MATRIX_COLUMNS), dtype=np.float32)
        piece[own, column[lo:hi] - first] = 1
        counts[np.ix_(rows, rows)] += piece @ piece.T
    return counts


def block_links(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact links across components inside each pair of blocks, one for any two components: (a, b)."""
    def run(key, pdf):
        own = list(shingle_sets(pa.array(pdf["text"], pa.string())))
        n, ids, component = np.array([len(s) for s in own]), pdf["doc_id"].to_numpy(), pdf["component"].to_numpy()
        common = common_counts(own)
        linked = (100 * common >= PERCENT * (n[:, None] + n[None, :] - common)) & (common > 0) & (component[:, None] < component[None, :])
        a, b = np.nonzero(linked)
        _, one = np.unique(np.stack([component[a], component[b]], axis=1), axis=0, return_index=True)
        return pd.DataFrame({"a": np.minimum(ids[a[one]], ids[b[one]]), "b": np.maximum(ids[a[one]], ids[b[one]])})

    return placed.join(texts, "doc_id").select("lo", "hi", "doc_id", "component", "text").groupBy("lo", "hi").applyInPandas(run, "a long, b long")


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose united sketches do not rule the threshold out."""
    one = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
    two = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
    united = F.slice(F.array_sort(F.array_union("x", "y")), 1, K)
    common = F.array_intersect(F.array_intersect("x", "y"), united)
    both = pairs.join(one, "a").join(two, "b")
    return both.filter(F.size(common) >= LEAST_ESTIMATE * F.size(united)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold. ``texts``: doc_id, text."""
    def run(batches):
        for batch in batches:
            links = []
            for i, (s, t) in enumerate(zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)))):
                common = len(np.intersect1d(s, t, assume_unique=True))
                links.append(100 * common >= PERCENT * (len(s) + len(t) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("one"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def with_components(listed: DataFrame, links: DataFrame) -> DataFrame:
    """The list members with the component that the links found so far give them."""
    return listed.join(components(links), F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")


def links_of(every: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links between representatives, enough of them to join up every group: (a, b)."""
    reps = every.join(classes, (every["print"] == classes["print"]) & (F.col("doc_id") == F.col("first"))).select("doc_id", "n", "sketch").distinct()
    reps = materialise(reps, "reps")
    listed = materialise(lists(reps), "lists")
    candidates = listed.select("doc_id").distinct()
    texts = materialise(docs.join(candidates, "doc_id", "left_semi").distinct(), "texts")
    labelled = listed.withColumn("component", F.col("doc_id"))
    links = materialise(confirmed(estimated(hub_pairs(labelled, True), reps), texts), "links")
    labelled = with_components(listed, links)
    links = links.unionByName(materialise(confirmed(estimated(hub_pairs(labelled, False), reps), texts), "links"))
    labelled = with_components(listed, links)
    return links.unionByName(block_links(in_blocks(labelled), texts))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id (smallest id reachable), kept: one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialise(sets(docs), "sets")
    classes = every.filter("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first"))
    classes = materialise(classes, "classes")
    with passing() as kept:
        links = materialise(links_of(every, classes, docs), "links")
        kept.append(links)
    # A class is its representative's; only an id with several texts joins classes.
    several = every.filter("doc_id IS NOT NULL").join(classes, "print").groupBy("doc_id").agg(F.min("first").alias("b"), F.collect_set("first").alias("firsts")).filter("size(firsts) > 1")
    several = several.select(F.explode("firsts").alias("a"), "b").filter("a <> b")

    with passing() as kept:
        final = components(links.unionByName(several))
        of_class = classes.join(final, F.col("first") == F.col("node"), "left").select(F.col("print").alias("p"), F.coalesce("component", "first").alias("component"))
        of_class = materialise(of_class, "class-labels")
        kept.append(of_class)
    known = every.filter("print IS NOT NULL").join(of_class, F.col("print") == F.col("p"), "left").select("doc_id", "n", "component")
    # Rows without a set take the component of their id, where other rows have the id.
    empty = every.filter("print IS NULL").select("doc_id", "n")
    named = known.filter("doc_id IS NOT NULL").join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("component"))
    known = known.unionByName(empty.join(named, "doc_id", "left").select("doc_id", "n", "component"))
    component = F.coalesce("component", "doc_id")
    return known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.when(F.col("doc_id").isNull(), component.isNull()).otherwise(F.col("doc_id") == component).alias("kept"))
