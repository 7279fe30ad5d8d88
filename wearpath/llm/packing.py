"""Pack tokenised documents into sequences by hierarchical best fit.

`pieces` tokenises whole texts and cuts only documents longer than a sequence: the first piece takes the
remainder, the others are full. `pack` then works in rounds. In a round every task packs its items by best fit,
largest first; bins that are nearly full are finished, the others are the items of the next round, which has
as many fewer tasks as there are fewer items. The tree ends where one task sees all that is left,
or where a round no longer saves a hundredth of the bins: then what is left is packed as it is. No round holds
more than ``ITEMS`` rows in a task, and only ids and lengths move after tokenising.

Defined cases: a null text is empty, an empty text is one end token; rows with the same id are separate
documents; a null id stays null; no rows give no sequences; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import hashes

CAPACITY, END = 1024, 2
#: Rows a task packs at once; a bin this full is finished.
ITEMS, NEARLY_FULL = 50_000, 1016
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: White space whose grouping depends on what is around it, and the special token: such texts are encoded in one go.
_RUNS = ("  ", "\n ", " \n", "\n\n", "<|endoftext|>")
_OTHER_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_KEPT_WORDS = 1_000_000
#: A text of more bytes is cut between words while it is encoded.
_LONG = 1 << 22


def _together(text: str) -> bool:
    if not text or text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS):
        return True
    return any(c in text for c in _OTHER_SPACES)


class Encoder:
    """Token ids as little-endian 32-bit bytes, with a memory of words.

    The tokenizer never merges across a single space between two words (the space belongs to the second)
    or a single line feed, so the ids of a text are those of its words in turn. Words are told apart by a hash and
    then compared byte by byte.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.marks = {m: self.whole(m) for m in ",."}
        self.newline = self.whole("\n")
        #: Ids of words with the space or line feed before them, as bytes.
        self.known: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, unknown: list[bytes]) -> None:
        """Words that are not yet known, with the space or line feed before them."""
        heads = [w for w in unknown if w[:1] == b"\n"]
        self.known.update([(w, self.newline + self.whole(w[1:].decode())) for w in heads])
        seen = {w[1:].decode(): w for w in unknown if w[:1] == b" "}
        # A comma or stop after a letter, at the end of a word, is always a token of its own.
        marked = {w: key for w, key in seen.items() if w[-1:] in self.marks and w[-2:-1].isalpha()}
        plain = {w: key for w, key in seen.items() if w not in marked}
        plain.update([(w[:-1], key[:-1]) for w, key in marked.items() if key[:-1] not in self.known])
        self._learn_words(list(plain), list(plain.values()))
        self.known.update([(key, self.known[key[:-1]] + self.marks[w[-1]]) for w, key in marked.items()])

    def _learn_words(self, new: list[str], keys: list[bytes]) -> None:
        if not new:
            return
        ids = np.array(self.model.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(new):  # a word with a space of its own kind inside
            self.known.update([(key, self.whole(" " + w)) for w, key in zip(new, keys)])
            return
        data, bounds = ids.tobytes(), (np.append(starts, len(ids)) * 4).tolist()
        self.known.update(zip(keys, [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        apart = [not _together(t) for t in texts]
        # A text begins as a line does; that line feed is left out again.
        lines = [b"\n" + t.encode() for t, a in zip(texts, apart) if a]
        short = iter(self._by_words([x for x in lines if len(x) <= _LONG]))
        by_words = (next(short) if len(x) <= _LONG else b"".join([self._by_words([part])[0] for part in _cut(x)]) for x in lines)
        return [next(by_words)[len(self.newline):] if a else self.whole(t) for t, a in zip(texts, apart)]

    def _by_words(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts of texts, every word behind one space or line feed: a distinct word is looked up once."""
        if not parts:
            return []
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        raw = b"".join(parts)
        data = np.frombuffer(raw, dtype=np.uint8)
        starts = np.flatnonzero((data == 32) | (data == 10))
        one, number = distinct(data, starts)
        if one is None:
            return [self.newline * p.startswith(b"\n") + self.whole(p.decode().removeprefix("\n")) for p in parts]
        words = [raw[a:b] for a, b in zip(starts[one].tolist(), np.append(starts, len(data))[one + 1].tolist())]
        ids = list(map(self.known.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        self.learn([words[i] for i in unknown])
        for i in unknown:
            ids[i] = self.known[words[i]]
        flat, size = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        n = size[number]
        end = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(size) - size)[number] - (end - n), n) + np.arange(end[-1])].tobytes()
        first = np.searchsorted(starts, np.cumsum([len(p) for p in parts[:-1]])) if len(parts) > 1 else np.zeros(0, dtype=np.int64)
        bounds = (4 * np.concatenate([[0], (end - n)[first], end[-1:]])).tolist()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts that begin with a space or line feed, of ``_LONG`` bytes at most but for a longer word."""
    at = 0
    while at < len(text):
        stop = len(text)
        if stop - at > _LONG:
            found = max(text.rfind(b" ", at + 1, at + _LONG), text.rfind(b"\n", at + 1, at + _LONG))
            stop = found if found > at else min([x for x in (text.find(b" ", at + 1), text.find(b"\n", at + 1)) if x > at], default=stop)
        yield text[at:stop]
        at = stop


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Of spans that follow each other from the first byte to the last: (one span of each distinct kind, number of each span's
    kind), or (None, None) where different spans have one hash: every span is compared with the one of its kind."""
    ends = np.append(starts[1:], len(data))
    _, one, number = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths, like = ends - starts, one[number]
    if (lengths != lengths[like]).any():
        return None, None
    at = np.repeat(starts[like] - starts, lengths) + np.arange(len(data))
    return (one, number) if np.array_equal(data[at], data) else (None, None)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per task process: loading takes a while."""
    return Encoder(path)


def chunks(texts: list[str], limit: int = 1 << 20):
    """Consecutive slices of about ``limit`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


PIECES = "item long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, text) -> the pieces of every document, each with a number of its own (``item``)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        model = encoder(tokenizer)
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, rows = iter(batch.column(0).to_pylist()), []
            for part in chunks([t or "" for t in batch.column(1).to_pylist()]):
                for data in model.encode(part):
                    data += tail
                    n, doc = len(data) // 4, next(ids)
                    cut = n if n <= capacity else (n % capacity or capacity)
                    start = 0
                    for piece, stop in enumerate(range(cut, n + 1, capacity)):
                        rows.append((item, doc, piece, start, stop - start, zlib.crc32(data[4 * start:4 * stop])))
                        start, item = stop, item + 1
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the given order: the fullest bin with room, else a new one.

    Open bins lie in one stack per free room; an integer has a bit for every room there is.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, chosen, bins = capacity, bins, bins + 1
        out.append((chosen, capacity - room))
        stacks[room - n].append(chosen)
        rooms |= 1 << (room - n)
    return out


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """(bin, fill) -> bin, into (a new number), base (offset there), total (fill there)."""
    def run(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("bin", pa.int64()), ("fill", pa.int32())])).sort_by([("fill", "descending"), ("bin", "ascending")])
        fill = table.column("fill").to_pylist()
        places = best_fit(fill, capacity)
        total = np.zeros(len(places) + 1, dtype=np.int32)
        np.add.at(total, [b for b, _ in places], fill)
        first = (number << 56) | (TaskContext.get().partitionId() << 33)
        yield pa.RecordBatch.from_arrays([
            table.column("bin").combine_chunks(), pa.array([first + b for b, _ in places], pa.int64()),
            pa.array([o for _, o in places], pa.int32()), pa.array([int(total[b]) for b, _ in places], pa.int32())], ["bin", "into", "base", "total"])

    return items.mapInArrow(run, "bin long, into long, base int, total int")


def pack(cut: DataFrame, capacity: int = CAPACITY, items_per_task: int = ITEMS, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Written pieces -> the same with ``sequence_id`` and ``offset``. Lengths are 1 to ``capacity``."""
    placed = cut.withColumns({"sequence_id": F.col("item"), "offset": F.lit(0)})
    items = cut.filter(F.col("length") < capacity).select(F.col("item").alias("bin"), F.col("length").cast("int").alias("fill"))
    left, number = items.count(), 0
    while left:
        number += 1
        tasks = -(-left // items_per_task)
        moved = materialise(_round(items.repartition(tasks), number, capacity), "bins")
        placed = placed.join(moved, F.col("sequence_id") == F.col("bin"), "left").select(
            *cut.columns, F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
        placed = materialise(placed, "placed")
        items = moved.filter(F.col("total") < nearly_full).groupBy(F.col("into").alias("bin")).agg(F.max("total").alias("fill"))
        before, left = left, items.count()
        if tasks == 1 or left > 0.99 * before:
            break
    return placed.select(*cut.columns, "sequence_id", F.col("offset").cast("long").alias("offset"))


def packed(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) -> one row per piece with its place."""
    return pack(materialise(pieces(docs, tokenizer), "pieces")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
