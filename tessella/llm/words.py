"""Vectorised word kernels over Arrow text columns.

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is exactly
``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.  The kernels work on whole Arrow buffers
with NumPy: no Python object is made per word or per document.  Texts are taken
in slices of at most ``SLICE_BYTES`` (a longer single document makes a slice of
its own), so working memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

U64 = np.uint64
#: An odd multiplier is invertible modulo 2**64, so the hash of a byte range is
#: a difference of prefix sums times an inverse power.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Multiplier of the rolling hash over word hashes.
ROLL = U64(0xD6E8FEB86659FD93)

_powers: dict[int, np.ndarray] = {}


def power_table(base: int, size: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for at least ``size`` exponents."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, SLICE_BYTES + 65), base, dtype=U64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a 64-bit word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (``n + 1``) of a string column; null texts are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most ``limit`` bytes (or one row)."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of a run of rows: ``start``/``end`` byte positions, ``row`` of each
    word, and ``first``: word index at which each row starts (``n + 1``)."""

    __slots__ = ("data", "start", "end", "first", "rows")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = _SPACE[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        if len(data):
            edge[0] = not space[0]
            edge[1:-1] = space[1:] != space[:-1]
            edge[-1] = not space[-1]
            # A row boundary inside a run of word bytes ends one word and starts another.
            inner = offsets[1:-1]
            inner = np.unique(inner[(inner > 0) & (inner < len(data))])
            both = inner[~space[inner - 1] & ~space[inner]]
        else:
            edge[0] = False
            both = np.empty(0, np.int64)
        marks = np.flatnonzero(edge)
        if len(both):
            marks = np.sort(np.concatenate([marks, both, both]))
        self.data, self.start, self.end = data, marks[0::2], marks[1::2]
        self.first = np.searchsorted(self.start, offsets, side="left")
        self.rows = len(offsets) - 1

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes (with A-Z lower-cased if asked)."""
        if not len(self.start):
            return np.empty(0, U64)
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        base = (BASE + 2 * seed) % (1 << 64)
        up = power_table(base, n + 1)
        down = power_table(pow(base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' bytes, a space after each, and where each begins (one more)."""
        size = self.end - self.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        if not len(size):
            return np.empty(0, np.uint8), at
        index = np.repeat(self.start - at[:-1], size) + np.arange(at[-1])
        out = self.data[np.minimum(index, len(self.data) - 1)]
        out[at[1:] - 1] = 0x20
        return out, at

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes; entry i covers words i..i+k-1.

    The array has ``max(0, n - k + 1)`` entries and pays no heed to row ends: the
    caller keeps only starts with ``k`` words left in their row.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= ROLL
        out += hashes[i : i + n]
    return mix(out)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over ``rolling(.., k)`` entries that lie inside one row."""
    total = int(first[-1])
    n = total - k + 1
    if n <= 0:
        return np.empty(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= ends


def minimizers(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` consecutive entries, the index of its smallest one
    (leftmost on ties); entry i covers hashes i..i+w-1."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # Doubling: best index over 1, 2, 4, ... entries, then one overlap.
    best = np.arange(len(hashes))
    span = 1
    while span * 2 <= w:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(hashes[right] < hashes[left], right, left)
        span *= 2
    if span < w:
        left, right = best[:n], best[w - span : w - span + n]
        best = np.where(hashes[right] < hashes[left], right, left)
    return best[:n]
