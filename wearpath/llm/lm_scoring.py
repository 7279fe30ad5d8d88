"""Language-model scoring by logistic context mixing of the bits of whole texts.

*Model.* A text, with A-Z lower-cased, is a series of bytes (white space included) and one end, a byte that no UTF-8 text
has. Each byte is eight bit decisions. Predictors each look up a hashed context of what stands before, whatever word it
belongs to: the last 1, 2, 3, 4 and 6 bytes, the present word so far (which counts words), and the present word with the
one before. Their counts, in the logistic domain, are combined by a mixer whose weights are chosen by a gate (the bit's
place and how many predictors know their context). An adaptive table indexed by the partial byte and the mixed
prediction refines the result. Once learnt all is frozen, so every string has one fixed probability.

*Learning.* Counts come from all learning texts, in hashed tables of fixed size. A byte is two nibbles: a context picks a row per
nibble and the counts of its sixteen values give those of its fifteen bits. The weights are learnt online over all learning
texts, each bit seen without its own count, and the refinement counts the same bits. Texts are dealt by a hash to a fixed
number of learners, whose weights are averaged over all steps by the bits that they have met; so scores do not depend on the number of
tasks. Tables hold eight bits a prediction (steps of 0.1 in the logistic domain).

*Words.* All learning tokens are counted for the base score. The word table grows with the corpus and stays distributed. Words above
a count that at most ``FREQUENT`` words reach are looked up inside tasks (a bound on what is broadcast); all others
are joined by hash.

Defined cases: null is empty, an empty text is one end; rows with one id are scored each; a null id counts as
learning; with nothing to learn from all words are unknown and every bit costs one bit.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import LOWERED, bytes_of, hashes, mixed, powers, ranges, word_places
from .langid import held_out

BYTES = (1, 2, 3, 4, 6)
ORDERS = (*BYTES, "word", "pair")
SLOTS, FREQUENT = 1 << 21, 1 << 18
#: Bytes of a learner's first online step and of its longest, learners whose weights are averaged; results depend on both and on nothing of the cluster.
FIRST_STEP, STEP, LEARNERS, RATE = 1 << 5, 1 << 14, 32, 0.3
#: Bytes laid out at once, and how far back a context may look across a cut of a longer text.
RUN, LEAD, REACH = 1 << 16, 64, 32
END, END_OF_TEXT = b"\xff", 1
PIECE, PRIOR = 1 << 22, 10
#: Cells of the table sent as one array, and the most that a cell counts: sums of sixteen stay within 32 bits.
BLOCK, MOST = 1 << 12, (1 << 31) // 16 - 1
SCALE = 0.1
#: Predictions are mixed in rows of so many bytes, the last row filled up with bytes that do not count.
LANES = 64
FACTOR, LENGTH = np.full(1, 0x2545F4914F6CDD1D, dtype=np.uint64), np.full(1, 0xD6E8FEB86659FD93, dtype=np.uint64)
SQUARE = FACTOR * FACTOR
KNOWN, ROW = np.full(1, 0x9E3779B97F4A7C15, dtype=np.uint64), np.full(1, 0xD6E8FEB86659FD93, dtype=np.uint64)
#: Hashes of the last byte and of the last two.
ONE = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1))
TWO = mixed((np.arange(1 << 16, dtype=np.uint64) % np.uint64(256) + np.uint64(1)) * FACTOR + (np.arange(1 << 16, dtype=np.uint64) >> np.uint64(8)) + np.uint64(3))
#: Learning tokens per learner, until there are `LEARNERS`.
SHARE = 100_000


# -- contexts ---------------------------------------------------------------------------------------------
def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with their ends, number of the text of each byte)."""
    data = np.frombuffer(b"".join([t + END for t in texts]), dtype=np.uint8)
    return data, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def runs(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts laid out about ``RUN`` bytes at a time: (bytes, number of the text of each, bytes at the front that only lead in)."""
    held: list[bytes] = []
    size = done = 0
    for t in texts:
        if held and size + len(t) >= RUN:
            data, owner = laid_out(held)
            yield data, owner + done, 0
            done, held, size = done + len(held), [], 0
        if len(t) < RUN:
            held.append(t)
            size += len(t) + 1
            continue
        whole = np.frombuffer(t + END, dtype=np.uint8)
        for at in range(0, len(whole), RUN):
            lead = min(at, LEAD)
            piece = whole[at - lead:at + RUN]
            yield piece, np.full(len(piece), done), lead
        done += 1
    if held:
        data, owner = laid_out(held)
        yield data, owner + done, 0


def contexts(data: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per predictor, a row each, a hash of what stands before each byte in its text. The rows are those of `ORDERS`."""
    n = len(data)
    out, spare = np.empty((len(ORDERS), n), dtype=np.uint64), np.empty(n, dtype=np.uint64)
    first = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)[:n]
    # The last bytes: h(k) = h(k - 1) * FACTOR + byte k back + 1, where a byte before the text is 0; two bytes at once, and by table for one and two.
    far = max(BYTES)
    before = np.ones(n + far, dtype=np.uint64)
    np.add(data, np.uint64(1), out=before[far:])
    twos = before[1:] * FACTOR
    twos += before[:-1]
    short = np.zeros(n + 2, dtype=np.intp)
    short[2:] = data
    np.take(ONE, short[1:n + 1], out=out[0], mode="clip")
    short[1:] += short[:-1] << 8
    np.take(TWO, short[1:n + 1], out=out[1], mode="clip")
    np.multiply(twos[4:4 + n], FACTOR, out=out[2])
    out[2] += before[3:3 + n]
    np.multiply(twos[4:4 + n], SQUARE, out=out[3])
    out[3] += twos[2:2 + n]
    np.multiply(out[3], SQUARE, out=out[4])
    out[4] += twos[:n]
    _words_before(data, first, before[far:], out[5], out[6])
    for k in range(2, len(ORDERS)):
        if k >= len(BYTES):
            _mix(out[k], spare)
        out[k] += np.uint64(BYTES[k] if k < len(BYTES) else 1000 + k - len(BYTES))
        _mix(out[k], spare)
    # Where a text begins, what stands before it does not count.
    place, spot = np.tile(np.arange(far), len(first) - 1), (first[1:, None] + np.arange(far)).reshape(-1)
    inside = spot < np.repeat(np.append(first[2:], n), far)[:len(spot)]
    place, spot = place[inside], spot[inside]
    h = np.zeros(len(spot), dtype=np.uint64)
    for back in range(1, far + 1):
        h = h * FACTOR + np.where(place < back, np.uint64(1), before[spot + far - back])
        if back in BYTES:
            out[BYTES.index(back), spot] = mixed(h + np.uint64(back))
    return out


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """`mixed` in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint64(factor), out=x)


def _words_before(data, first, counted, word, pair) -> None:
    """`hashes` of the present word so far, and with the one before, of the last ``REACH`` bytes at most; ``counted``: each byte and one more."""
    n = len(data)
    gap = (data - np.uint8(9)) < 5
    gap |= data == 0x20
    opens = np.zeros(n, dtype=bool)
    opens[1:] = gap[:-1]
    opens[first] = True
    begins = np.flatnonzero(opens)
    lengths = np.diff(begins, append=n)
    previous = np.append(0, begins[:-1])[:len(begins)]
    where = np.searchsorted(begins, first)
    previous[where] = first
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(counted, up[:n], out=word)
    np.cumsum(word, out=sums[1:])
    by_place = np.arange(n, dtype=np.uint64) * LENGTH
    for begin, out in ((begins, word), (previous, pair)):
        # (sums[at] - sums[begin]) * down[begin] + (at - begin) * LENGTH
        np.multiply(sums[:-1], np.repeat(down[begin], lengths), out=out)
        out += by_place
        out -= np.repeat(sums[begin] * down[begin] + by_place[begin], lengths)
        long = np.flatnonzero(begins + lengths - begin > REACH + 1)
        if len(long):
            opened = np.maximum(begins[long], begin[long] + REACH + 1)
            many = begins[long] + lengths[long] - opened
            at = np.repeat(opened - np.cumsum(many) + many, many) + np.arange(many.sum())
            out[at] = (sums[at] - sums[at - REACH]) * down[at - REACH] + LENGTH * np.uint64(REACH)


def values(data: np.ndarray, ctx: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each half of a byte: (half, its value, the slot of that value in the context's row, a row per predictor with slots of its own). Slots are good until the next."""
    c = ctx * ROW
    slots, high = np.empty(c.shape, dtype=np.uint64), (data >> 4).astype(np.uint64)
    for half, value in ((0, high), (1, (data & 15).astype(np.uint64))):
        if half:
            c += (high + np.uint64(16)) * KNOWN * ROW
        np.right_shift(c, np.uint64(64 - ROW_BITS - 4), out=slots)
        slots &= ~np.uint64(15)
        slots += value
        yield half, value.view(np.int64), slots.view(np.int64)


def nibbles(data: np.ndarray, ctx: np.ndarray):
    """For each half of a byte: (half, its value, the first slot of the context's row per predictor)."""
    for half, value, slots in values(data, np.asarray(ctx)):
        yield half, value, [row - value + k * SLOTS for k, row in enumerate(slots)]


ROW_BITS = SLOTS.bit_length() - 5


def bits(data: np.ndarray, ctx: list[np.ndarray]):
    """For each of eight places: (place, partial byte, bit, slots per predictor)."""
    v = data.astype(np.int64)
    for half, nibble, rows in nibbles(data, ctx):
        for p in range(4):
            place = 4 * half + p
            part = (1 << p) | (nibble >> (4 - p))
            yield place, (1 << place) | (v >> (8 - place)), (v >> (7 - place)) & 1, [r + part for r in rows]


def filled(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and their owners with a row of bytes behind them that do not count."""
    return np.append(data, np.zeros(LANES, dtype=np.uint8)), np.append(owner, np.full(LANES, owner[-1] if len(owner) else 0))


def _by_byte() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per half, byte and place in the half: (first cell of the partial byte and the bit, the bit, a quarter for a one and less a quarter for a zero)."""
    byte, place = np.arange(256)[:, None], np.arange(8)
    bit = (byte >> (7 - place)) & 1
    cells = (2 * ((1 << place) | (byte >> (8 - place))) + bit) * Speller.BUCKETS
    return tuple(np.ascontiguousarray(a.reshape(256, 2, 4).swapaxes(0, 1)) for a in (cells.astype(np.int32), bit.astype(np.float32), (bit / 2 - 0.25).astype(np.float32)))


def four(table: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The four values of each byte in one row, of a table of four 32-bit values per byte."""
    return np.take(table.view(np.complex128).reshape(-1), byte, mode="wrap").view(table.dtype)


# -- model ------------------------------------------------------------------------------------------------
class Speller:
    """Counts per slot, weights per gate, refinement per partial byte."""

    BUCKETS = 33

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        self.zeros, self.ones = zeros, ones
        self.weights = np.full((8 * (len(ORDERS) + 1), len(ORDERS)), 0.2, dtype=np.float64)
        self.squares = np.full_like(self.weights, 1e-2)
        centres = 1 / (1 + np.exp(-np.linspace(-8, 8, self.BUCKETS)))
        self.refined = np.tile(centres, (256, 1))

    @staticmethod
    def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Stretched predictions from counts, in steps of `SCALE`; 0 is an unknown slot."""
        x = np.log((n1.astype(np.float32) + np.float32(0.3)) / (n0.astype(np.float32) + np.float32(0.3)))
        steps = np.clip(np.rint(x / SCALE), -127, 127).astype(np.int8)
        steps[steps == 0] = 1
        steps[n0 + n1 == 0] = 0
        return steps

    def _per_order(self, make, width: int) -> np.ndarray:
        out = np.zeros((len(self.zeros), width), dtype=np.int8)
        for at in range(0, len(self.zeros), SLOTS):
            out[at:at + SLOTS] = make(self.zeros[at:at + SLOTS], self.ones[at:at + SLOTS]).reshape(-1, width)
        return out.reshape(-1)

    def learner(self) -> "Speller":
        """What learning needs: at 2 * slot + bit the prediction of a slot whose counts lack that bit once, so that no bit sees itself."""
        own = copy.copy(self)
        own.without = self._per_order(lambda n0, n1: np.stack([self.stretch(np.maximum(n0 - 1, 0), n1), self.stretch(n0, np.maximum(n1 - 1, 0))], axis=1), 2)
        own.zeros = own.ones = None
        return own

    def ways(self) -> np.ndarray:
        """Per slot of a nibble's value the predictions of its four bits, eight bits each in one word; made where it is first asked for."""
        if not hasattr(self, "_ways"):
            learns = hasattr(self, "without")
            rows, value = (self.without if learns else self.stretched).reshape(-1, 32 if learns else 16), np.arange(16)
            out = np.empty((len(rows), 16, 4), dtype=np.int8)
            for p in range(4):
                node, bit = (1 << p) | (value >> (4 - p)), (value >> (3 - p)) & 1
                out[:, :, p] = rows[:, 2 * node + bit if learns else node]
            self._ways = out.view(np.uint32).reshape(-1)
        return self._ways

    def weighed(self, half: int, slots: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weighted sums of the predictions of a half's four bits, bit by bit and byte by byte, times ``sign``.

        The bits whose context every predictor knows, nearly all in a large corpus, share a gate; the others pick theirs. Returns
        (predictions, sums, bits of other gates, their gates).
        """
        words, ways = np.empty(slots.shape, dtype=np.uint32), self.ways()
        for k, row in enumerate(slots):
            np.take(ways[k * SLOTS:(k + 1) * SLOTS], row, out=words[k], mode="wrap")
        found = words.view(np.int8)
        x = found.astype(np.float32)
        places = (self.weights.astype(np.float32) * np.float32(SCALE * sign)).reshape(2, 4, len(ORDERS) + 1, len(ORDERS))[half]
        row = np.empty((len(ORDERS), LANES, 4), dtype=np.float32)
        row[:] = places[:, -1].T[:, None, :]
        dot = np.einsum("kab,kb->ab", x.reshape(len(ORDERS), -1, 4 * LANES), row.reshape(len(ORDERS), -1)).reshape(-1)
        least = np.minimum.reduce(found.view(np.uint8), axis=0)
        if least.all():
            return x, dot, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        other = np.flatnonzero(least == 0)
        known = np.count_nonzero(found[:, other], axis=0)
        dot[other] = (places[other & 3, known] * x[:, other].T).sum(axis=1)
        return x, dot, other, known

    def chances(self):
        """Per partial byte, bit and bucket of the sum: the refined part of the bit's chance, and what it grows by to the next bucket.
        To it comes a quarter of the chance of a one as mixed; a zero has that quarter here and loses it again."""
        if not hasattr(self, "_chances"):
            part = np.stack([1 - 0.75 * self.refined, 0.75 * self.refined], axis=1)
            self._chances = part.reshape(-1), np.diff(part, axis=2, append=part[:, :, -1:]).astype(np.float32).reshape(-1)
        return self._chances

    def starting(self) -> "Speller":
        """The same predictions, with weights of its own to learn and cells of its own to count."""
        self.ways()
        own = copy.copy(self)
        own.weights, own.squares = self.weights.copy(), np.full_like(self.weights, 1e-2)
        own._empty()
        return own

    def _empty(self) -> None:
        self.hits, self.hit_ones = np.zeros(self.refined.size), np.zeros(self.refined.size)
        self.summed = np.zeros_like(self.weights)  # over the steps, by the bits met

    def learn(self, texts: Iterable[bytes]) -> np.ndarray:
        """Online steps over the texts, of `FIRST_STEP` bytes and then an eighth more each until `STEP`; a step takes the mean over
        its bits per gate. Returns the bits met per gate."""
        total, hits, size = np.zeros(len(self.weights), dtype=np.int64), np.zeros(2 * self.refined.size, dtype=np.int64), FIRST_STEP
        if not hasattr(self, "hits"):
            self._empty()
        for data, owner, lead in runs(texts):
            ctx, at = contexts(*filled(data, owner)), lead
            while at < len(data):
                total += self._step(data[at:at + size], ctx[:, at:], hits)
                at, size = at + size, min(size + size // 8, STEP)
        hits = hits.reshape(-1, 2, self.BUCKETS)
        self.hits += hits.sum(axis=1).reshape(-1)
        self.hit_ones += hits[:, 1].reshape(-1)
        return total

    @np.errstate(over="ignore")
    def _step(self, data: np.ndarray, ctx: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """One step over the bits of ``data``; ``ctx`` goes on behind them, ``hits`` counts zeros and ones per cell. Returns the bits met per gate."""
        gates, n, wide = len(ORDERS) + 1, 4 * len(data), -(-len(data) // LANES) * LANES
        met, slope = np.zeros((8, gates)), np.zeros((8, gates, len(ORDERS)))
        data = np.append(data, np.zeros(wide - len(data), dtype=np.uint8))
        byte = data.astype(np.intp)
        for half, _, slots in values(data, ctx[:, :wide]):
            x, error, other, gate = self.weighed(half, slots, -1)
            bucket = error * np.float32(-2)
            bucket += np.float32(15.5)
            np.clip(np.ceil(bucket, out=bucket), np.float32(0), np.float32(self.BUCKETS - 1), out=bucket)
            cell = bucket.astype(np.int32)
            cell += four(CELLS[half], byte)
            hits += np.bincount(cell[:n], minlength=len(hits))
            # The bit less its chance, which is 1 / (1 + exp(-sum)).
            np.exp(error, out=error)
            error += np.float32(1)
            np.divide(np.float32(1), error, out=error)
            np.subtract(four(BITS[half], byte), error, out=error)
            error[n:] = 0
            mine, other, gate = slice(4 * half, 4 * half + 4), other[other < n], gate[other < n]
            if len(other):
                spot, missed = (other & 3) * gates + gate, x[:, other] * error[other]
                met[mine] += np.bincount(spot, minlength=4 * gates).reshape(4, gates)
                for k, m in enumerate(missed):
                    slope[mine, :, k] += np.bincount(spot, weights=m, minlength=4 * gates).reshape(4, gates)
                error[other] = 0
            met[mine, -1] += n // 4 - met[mine].sum(axis=1)
            sums = np.einsum("kab,ab->kb", x.reshape(len(ORDERS), -1, 4 * LANES), error.reshape(-1, 4 * LANES))
            slope[mine, -1] += sums.reshape(len(ORDERS), -1, 4).sum(axis=1, dtype=np.float64).T
        met, slope = met.reshape(-1), slope.reshape(self.weights.shape)
        slope *= SCALE / np.maximum(met, 1)[:, None]
        self.squares += slope * slope
        self.weights += RATE * slope / np.sqrt(self.squares)
        self.summed += self.weights * met[:, None]
        return met.astype(np.int64)

    def refine_by(self, cell: np.ndarray, hits: np.ndarray, ones: np.ndarray) -> None:
        """Each cell's share of ones, beside ``PRIOR`` bits as mixed."""
        flat = self.refined.reshape(-1)
        flat[cell] = (ones + PRIOR * flat[cell]) / (hits + PRIOR)
        np.clip(self.refined, 1e-4, 1 - 1e-4, out=self.refined)

    def freeze(self) -> "Speller":
        """Keep one stretched prediction per slot."""
        self.stretched = self._per_order(self.stretch, 1)
        self.zeros = self.ones = None
        return self

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end, of a frozen model."""
        found = np.zeros(len(texts))
        for data, owner, lead in runs(texts):
            more, owners = filled(data, owner)
            ctx = contexts(more, owners)
            for at in range(lead, len(data), STEP):
                end = min(at + STEP, len(data))
                chance = self._chance(more[at:], ctx[:, at:], end - at)
                found += np.bincount(owner[at:end], weights=np.log10(chance), minlength=len(texts))
        return found

    @np.errstate(over="ignore")
    def _chance(self, data: np.ndarray, ctx: np.ndarray, n: int) -> np.ndarray:
        """The chance of each of the first n bytes; what goes on behind them only fills up."""
        wide, chance = -(-n // LANES) * LANES, 1.0
        data, (left, growth) = data[:wide], self.chances()
        byte = data.astype(np.intp)
        for half, _, slots in values(data, ctx[:, :wide]):
            dot = self.weighed(half, slots, -1)[1]
            mixed = np.exp(dot)
            mixed += np.float32(1)
            np.divide(four(QUARTERS[half], byte), mixed, out=mixed)
            np.clip(dot, np.float32(-7.999), np.float32(7.999), out=dot)
            np.subtract(np.float32(8), dot, out=dot)
            dot *= np.float32(2)
            low = dot.astype(np.int32)
            dot -= low.astype(np.float32)
            low += four(CELLS[half], byte)
            cell = low.astype(np.int64)
            dot *= np.take(growth, cell, mode="clip")
            p = np.take(left, cell, mode="clip")  # in 64 bits: the same cell is met often
            p += dot
            p += mixed
            p = p.reshape(-1, 4)
            chance = chance * ((p[:, 0] * p[:, 1]) * (p[:, 2] * p[:, 3]))
        return chance[:n]


CELLS, BITS, QUARTERS = _by_byte()


def spelling_counts(texts: DataFrame) -> DataFrame:
    """(word: a text's bytes) -> (block, counts): how often each value of a nibble follows each row, over all texts.

    A task sends the blocks of the table that it has met, as arrays that are added up block by block.
    """
    names, kind = ["block", "counts"], "block int, counts binary"

    def run(batches):
        counts = np.zeros(len(ORDERS) * SLOTS, dtype=np.int32)
        for data, owner, lead in runs(t.lower() for batch in batches for i in range(0, batch.num_rows, 64) for t in batch.column(0).slice(i, 64).to_pylist()):
            for _, _, slots in values(data, contexts(data, owner)):
                for k, met in enumerate(slots[:, lead:]):
                    np.add.at(counts[k * SLOTS:(k + 1) * SLOTS], met, np.int32(1))
        blocks = counts.reshape(-1, BLOCK)
        met = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(met), 64):
            m = met[i:i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array([blocks[k].tobytes() for k in m], pa.binary())], names)

    def added(batches):
        held, total = None, None
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != held and held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.astype(np.int32).tobytes()], pa.binary())], names)
                fresh = np.frombuffer(counts, dtype=np.int32).astype(np.int64)
                held, total = block, np.minimum(fresh if block != held else total + fresh, MOST)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.astype(np.int32).tobytes()], pa.binary())], names)

    return texts.select("word").mapInArrow(run, kind).repartition("block").sortWithinPartitions("block").mapInArrow(added, kind)


def leaves_of(table: pa.Table) -> np.ndarray:
    """The whole table of counts from its blocks."""
    leaves = np.zeros(len(ORDERS) * SLOTS, dtype=np.int32)
    for block, counts in zip(table.column("block").to_pylist(), table.column("counts")):
        leaves[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(counts.as_buffer(), dtype=np.int32)
    return leaves


def bit_counts(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) per slot from the counts of nibble values: the bits of a nibble are the nodes 1 to 15 of its row."""
    zeros, ones = np.zeros_like(leaves), np.zeros_like(leaves)
    z, o, level = zeros.reshape(-1, 16), ones.reshape(-1, 16), leaves.reshape(-1, 16)
    for width in (8, 4, 2, 1):
        z[:, width:2 * width], o[:, width:2 * width] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return zeros, ones


def fit(speller: Speller, texts: DataFrame, learners: int = LEARNERS) -> Speller:
    """Weights and refinement from all texts (word: their bytes), in tasks. Returns the frozen model.

    Texts are dealt to learners by a hash and sorted, so that a learner meets the same texts in the same steps
    whatever tasks there are. Each learner has a task of its own. A row per learner and weight or cell comes to the driver.
    """
    names, kind = ["learner", "at", "total", "n"], "learner int, at int, total double, n double"
    weights = speller.weights.size

    def learnt(batches):
        def pairs():
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    yield from zip(batch.column(0).slice(i, 64).to_pylist(), batch.column(1).slice(i, 64).to_pylist())

        for number, mine in groupby(pairs(), key=lambda pair: pair[0]):
            own = shared.value.starting()
            n = np.repeat(own.learn(text.lower() for _, text in mine), len(ORDERS)).astype(np.float64)
            total = np.concatenate([own.summed.reshape(-1), own.hit_ones])
            n = np.concatenate([n, own.hits])
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), number, dtype=np.int32)), pa.array(met.astype(np.int32)), pa.array(total[met]), pa.array(n[met])], names)

    context = texts.sparkSession.sparkContext
    deal = F.pmod(F.xxhash64("word"), F.lit(learners)).cast("int")
    dealt = texts.select(deal.alias("learner"), "word").repartitionById(learners, F.col("learner")).sortWithinPartitions("learner", F.xxhash64(F.lit(1), "word"), "word")
    shared = context.broadcast(speller.learner())
    found = materialise(dealt.mapInArrow(learnt, kind), "weights").toArrow().sort_by([("learner", "ascending"), ("at", "ascending")])
    shared.unpersist()
    size = weights + speller.refined.size
    total, n = np.zeros(size), np.zeros(size)
    place = found.column("at").to_numpy()
    np.add.at(total, place, found.column("total").to_numpy())  # in the order of the learners
    np.add.at(n, place, found.column("n").to_numpy())
    flat, met = speller.weights.reshape(-1), n[:weights] > 0
    flat[met] = total[:weights][met] / n[:weights][met]
    cell = np.flatnonzero(n[weights:])
    speller.refine_by(cell, n[weights:][cell], total[weights:][cell])
    return speller.freeze()


# -- word memory ------------------------------------------------------------------------------------------
def _tokens(batch_text, most: int = PIECE):
    """Per piece of a batch: (first row, rows, lower-cased bytes, starts, ends, row of each word, hash of each word)."""
    data, offsets = bytes_of(batch_text)
    for lo, hi in ranges(offsets, most):
        piece = np.take(LOWERED, data[offsets[lo]:offsets[hi]])
        starts, ends, rows = word_places(piece, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi - lo, piece, starts, ends, rows, hashes(piece, starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def word_counts(marked: DataFrame) -> DataFrame:
    """(text, held_out) -> (h, c): learning counts; words met in held-out texts only have zeros."""
    def run(batches):
        for batch in batches:
            learns = ~np.array(batch.column(1).to_pylist(), dtype=bool)
            for lo, n, _, _, _, rows, h in _tokens(batch.column(0)):
                values, number = np.unique(h, return_inverse=True)
                counts = np.bincount(number, weights=learns[lo + rows], minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(values, np.uint64(END_OF_TEXT)).view(np.int64)), pa.array(np.append(counts, learns[lo:lo + n].sum()))], ["h", "c"])

    return marked.select("text", "held_out").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(words: DataFrame, most: int = FREQUENT) -> int:
    """The least count that at most ``most`` words reach. Few counts are distinct."""
    left, least = most, None
    for row in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if row["n"] > left or row["c"] == 0:
            break
        left, least = left - row["n"], row["c"]
    return least if least is not None else 1 << 62


def score(docs: DataFrame, remainder: int = 1) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(remainder=remainder))
    words = materialise(word_counts(marked).sortWithinPartitions("h"), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    floor = math.log10(total + 0.5 * (distinct + 1))

    learning = marked.filter(~F.col("held_out")).select(F.coalesce("text", F.lit("")).cast("binary").alias("word"))
    speller = Speller(*bit_counts(leaves_of(materialise(spelling_counts(learning), "spelling").toArrow())))  # a table of fixed size
    shared = docs.sparkSession.sparkContext.broadcast(fit(speller, learning, min(LEARNERS, 1 + total // SHARE)))

    least = _frequent(words)
    top = words.filter(F.col("c") >= least).toArrow().sort_by("h")  # at most FREQUENT rows
    memory = docs.sparkSession.sparkContext.broadcast((top.column("h").to_numpy(), top.column("c").to_numpy()))
    del top

    def look_up(batches):
        """Row numbers run on over the batches of a task."""
        row = TaskContext.get().partitionId() << 33
        values, known_counts = memory.value
        for batch in batches:
            ids, texts, held, size = (batch.column(i) for i in range(4))
            for lo, n, _, _, _, rows, h in _tokens(texts):
                h = np.concatenate([h.view(np.int64), np.full(n, END_OF_TEXT, dtype=np.int64)])
                rows = np.concatenate([rows, np.arange(n)])
                at = np.minimum(np.searchsorted(values, h), max(len(values) - 1, 0))
                hit = values[at] == h if len(values) else np.zeros(len(h), dtype=bool)
                mine, at = rows[hit], at[hit]
                base = np.bincount(mine, weights=np.log10(known_counts[at] + 0.5) - floor, minlength=n)
                rare = np.argsort(rows[~hit], kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(rows[~hit], minlength=n))).astype(np.int32)), pa.array(h[~hit][rare]))
                whole = shared.value.log10([(t or "").encode().lower() for t in texts.slice(lo, n).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), ids.slice(lo, n), held.slice(lo, n), size.slice(lo, n), pa.array(np.bincount(rows, minlength=n)),
                    pa.array(np.bincount(mine, minlength=n)), pa.array(base), pa.array(whole), lists], found_names)
                row += n

    found_names = ["row", "doc_id", "held_out", "bytes", "n_tokens", "n_known", "base", "score", "rare"]
    found_schema = "row long, doc_id long, held_out boolean, bytes long, n_tokens long, n_known long, base double, score double, rare array<long>"
    read = marked.select("doc_id", "text", "held_out", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    scanned = materialise(read.mapInArrow(look_up, found_schema), "scanned")
    rare = scanned.select("row", F.explode("rare").alias("h")).join(words, "h").groupBy("row").agg(
        F.count(F.when(F.col("c") > 0, 1)).alias("more_known"), F.sum(F.log10(F.col("c") + 0.5) - floor).alias("more_base"))
    every = scanned.drop("rare").join(rare, "row", "left")

    def with_more(name: str, more: str) -> Column:
        return F.col(name) + F.coalesce(F.col(more), F.lit(0))

    total_bits = -F.col("score") / math.log10(2)
    return every.select("doc_id", "held_out", "n_tokens", with_more("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                        with_more("base", "more_base").alias("base_score"), "score", total_bits.alias("bits"), (total_bits / F.greatest(F.lit(1), F.col("bytes"))).alias("bits_per_byte"))
