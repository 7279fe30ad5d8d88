"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up. On every level runs of one symbol become one symbol; deterministic coin tossing then
labels each symbol by the lowest bit in which it differs from its left neighbour and that bit's value, three
times, which leaves a handful of labels with no two equal neighbours. Local maxima of the labels start the next
phrase, and a phrase's name is a hash of its symbols: a symbol of the level above. Where a phrase starts depends on
a few symbols around it only, so equal substrings are parsed alike wherever they stand, except at their edges.

The fingerprint holds, per level, the ``KEEP`` smallest distinct phrase names (32 bits) in hexadecimal: of level 3 (about thirty bytes
a phrase), and of levels 1 and 2 too where a text has fewer than `SHORT` characters. Likeness is the estimated
resemblance of the name sets of the highest level on which both texts have enough phrases.

Whole texts are parsed, in numpy over Arrow batches. `with_next` puts each document beside the one that follows it
in descending id by one range partitioning; only the first document of a partition is looked up across it.

Defined cases: null is empty; an empty text has the fingerprint ``-`` and is fully like another empty one and not like
any other; equal texts have equal fingerprints; equal ids are ordered by text; a null id comes last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .batches import mixed

KEEP, LEVEL, SHORT, ENOUGH = 48, 3, 300, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.cumprod(np.full(64, _STEP, dtype=np.uint64))
_WORK = 1 << 19


def _pair_labels(size: int) -> np.ndarray:
    """Label of a symbol given its left neighbour, for symbols below ``size`` that differ."""
    left, own = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    lowest = (left ^ own) & -(left ^ own)
    place = np.where(lowest > 0, np.log2(np.maximum(lowest, 1)), 0).astype(np.int64)
    return (2 * place + ((own >> place) & 1)).astype(np.uint8).reshape(-1)


_SECOND, _THIRD = _pair_labels(128), _pair_labels(16)


def parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (uint64 symbols of texts one after the other, start of each non-empty text) -> names, starts."""
    change = np.empty(len(symbols), dtype=bool)
    change[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=change[1:])
    change[starts] = True
    at = np.flatnonzero(change)
    starts = np.searchsorted(at, starts)
    s = symbols[at]
    if len(at) < len(symbols):  # a run is a symbol of its own
        run = np.diff(at, append=len(symbols)).astype(np.uint64)
        long = run > 1
        s[long] = mixed(s[long] + run[long] * _STEP)
    # First toss on 64-bit symbols; the first symbol of a text has its own complement as neighbour.
    differ = np.empty_like(s)
    differ[1:] = s[1:] ^ s[:-1]
    differ[starts] = ~np.uint64(0)
    differ[differ == 0] = np.uint64(1) << np.uint64(63)  # two hashed symbols of equal value
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    label = (2 * place + ((s >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for table, width in ((_SECOND, 7), (_THIRD, 4)):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[starts] = label[starts] ^ 1
        label = table[(left.astype(np.uint16) << width) | label]
    top = np.zeros(len(s), dtype=bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    top[starts[1:] - 1] = False  # the last symbol of a text starts no phrase
    top[starts] = True
    begin = np.flatnonzero(top)
    place = np.arange(len(s)) - np.repeat(begin, np.diff(begin, append=len(s)))
    names = mixed(np.add.reduceat(s * _WEIGHTS[np.minimum(place, 63)], begin))
    return names, np.searchsorted(begin, starts)


def phrase_names(texts: list[bytes]) -> list[list[np.ndarray]]:
    """Per text its phrase names by level (1 to `LEVEL`)."""
    filled = [i for i, t in enumerate(texts) if t]
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.uint64)] * LEVEL for _ in texts]
    if not filled:
        return out
    names = mixed(np.arange(256, dtype=np.uint64) + _STEP)[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    starts = np.cumsum([0] + [len(texts[i]) for i in filled[:-1]])
    levels = []
    for _ in range(LEVEL):
        names, starts = parse(names, starts)
        levels.append((names, np.append(starts, len(names))))
    for k, i in enumerate(filled):
        out[i] = [n[s[k]:s[k + 1]] for n, s in levels]
    return out


def smallest(names: np.ndarray) -> np.ndarray:
    names = (names >> np.uint64(32)).astype(np.uint32)
    if len(names) > 8 * KEEP:  # distinct values among the smallest few are enough
        part = np.unique(np.partition(names, 4 * KEEP)[:4 * KEEP])
        if len(part) >= KEEP:
            return part[:KEEP]
    return np.unique(names)[:KEEP]


def sketches(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """Per text level -> its smallest phrase names."""
    out, start, size = [], 0, 0
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    for i, d in enumerate(data):
        size += len(d)
        if size >= _WORK or i == len(data) - 1:
            for text, levels in zip(texts[start:i + 1], phrase_names(data[start:i + 1])):
                wanted = range(1, LEVEL + 1) if len(text) < SHORT else (LEVEL,)
                out.append({n: smallest(levels[n - 1]) for n in wanted} if text else {})
            start, size = i + 1, 0
    return out


def written(sketch: dict[int, np.ndarray]) -> str:
    return ";".join(f"{n}:{v.astype('>u4').tobytes().hex()}" for n, v in sketch.items()) or "-"


def likeness(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> float:
    """Estimated resemblance of two sketches, 0 to 1."""
    if not a or not b:
        return float(not a and not b)
    both = sorted(set(a) & set(b), reverse=True)
    level = next((n for n in both if min(len(a[n]), len(b[n])) >= ENOUGH), both[-1])
    x, y = a[level], b[level]
    united = np.union1d(x, y)
    if max(len(x), len(y)) >= KEEP:
        united = united[:KEEP]
    common = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(common, united, assume_unique=True).sum() / len(united))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) from the start of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_ENDS = "part int, side string, doc_id long, text string"


def _rows(ids: list, texts: list[str], following: list[str], follows: list[dict], own: list[dict]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    other = sketches(changed)
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], [written(s) for s in own],
        [written(s) for s in other], [likeness(s, o) for s, o in zip(own, other)], [likeness(s, f) for s, f in zip(own, follows)]]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def _groups(texts: list[str], limit: int = _WORK):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> fingerprints of each text, of its edited text, and the likeness to both and to the next document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.length("text")]
    ranged = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        """All rows but a partition's last, which waits for the first of the next; both ends go out as rows of their own."""
        part, waiting, ends = TaskContext.get().partitionId(), None, []
        blank = {"side": None, "text": None}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _groups(texts):
                own = sketches(texts[a:b])
                row_ids, row_texts, row_own = ids[a:b], texts[a:b], own
                if waiting is None:
                    ends.append((part, "first", ids[a], texts[a]))
                else:
                    row_ids, row_texts, row_own = [waiting[0], *row_ids], [waiting[1], *row_texts], [waiting[2], *own]
                waiting = (row_ids[-1], row_texts[-1], row_own[-1])
                if len(row_ids) > 1:
                    yield _both(_rows(row_ids[:-1], row_texts[:-1], row_texts[1:], row_own[1:], row_own[:-1]), part, blank)
        if waiting is not None:
            ends.append((part, "last", waiting[0], waiting[1]))
            empty = [[None] * len(ends)] * (len(_NAMES) - 1)
            columns = [pa.array([e[2] for e in ends], pa.int64()), *[pa.array(c, k) for c, k in zip(empty, (pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends]), pa.array([e[3] for e in ends])],
                                             [*_NAMES, "part", "side", "text"])

    done = materialise(ranged.mapInArrow(run, OUT + ", part int, side string, text string"), "fingerprints")
    # The ends: two rows a partition. The last of each meets the first of the next one that has rows; after all comes the first.
    ends = done.filter("side IS NOT NULL").select("part", "side", "doc_id", "text")
    first = ends.filter("side = 'first'").select(F.col("part").alias("p"), F.col("text").alias("following"))
    heads = first.select("p")
    turn = Window.orderBy("p")
    after = heads.withColumn("then", F.coalesce(F.lead("p").over(turn), F.first("p").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    met = ends.filter("side = 'last'").join(after, F.col("part") == F.col("p")).drop("p").join(first, F.col("then") == F.col("p")).select("doc_id", "text", "following")

    def close(batches):
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            yield _rows(ids, texts, following, sketches(following), sketches(texts))

    return done.filter("side IS NULL").select(*_NAMES).unionByName(met.mapInArrow(close, OUT))


def _both(rows: pa.RecordBatch, part: int, blank: dict) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*_NAMES, "part", "side", "text"])
