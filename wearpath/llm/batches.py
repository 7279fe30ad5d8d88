"""Words of Arrow string batches as numpy arrays, for operators that work inside tasks.

A column's bytes are used as Arrow holds them; nothing is decoded. A word is a run of bytes other than
space and 0x09-0x0D; as UTF-8 continuation bytes are none of these, words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GAP = np.zeros(256, dtype=bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A"):ord("Z") + 1] += 32

#: Bytes worked on at once, so that numpy's intermediates stay in the cache; one longer text is worked on whole.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    if n >= len(_powers.get("up", ())):
        size = max(n + 1, PIECE + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buffer[places[0]:places[-1]], places - places[0]


def ranges(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words end with their row."""
    if len(data) == 0:
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~GAP[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # also where a row ends
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial of its bytes, read off prefix sums, and its length, mixed."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several per element, in order."""
    out = parts[0]
    for p in parts[1:]:
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out
