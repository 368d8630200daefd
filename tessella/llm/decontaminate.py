r"""Benchmark decontamination: SimHash over item-sized windows (operator 9).

Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased; shingles are five words (a
text of fewer words is one shingle).  A window of a document has as many words as
the item it is held against.  A window leaks an item if their weighted shingle
similarity - the sum of smaller over the sum of larger shingle counts - is at
least 0.8.

1. *Where to look.* A window of n shingles at similarity s or more shares at least
   2ns/(1+s) of them with one item, so windows with fewer shingles that any item
   holds are skipped: an exact bound, not a cap.
2. *Fingerprints.* Each remaining window gets a 128-bit SimHash of its weighted
   shingles, from running sums over the document's words.
3. *Multi-index.* Fingerprints are cut into ``BLOCKS`` blocks.  Two fingerprints
   within ``RADIUS`` agree in some block up to ``RADIUS // BLOCKS`` bits, so each
   block indexes its items under every value that near: none within the radius is
   missed.  A pair at similarity 0.8 differs in 19 of 128 bits, give or take 4.
4. *Verification.* The exact weighted similarity of each candidate decides.

The benchmark is read in blocks of bounded size, each sent to the tasks and held
against all documents, so it may outgrow one task's memory.  Documents are never
shuffled whole; only their matches are.

A document with fewer words than an item is one window, its whole text, held against
the item in the same way.

Defined cases: null and word-free texts (documents or items) match nothing; repeated rows with one id are one
document, repeated items with one id give one match, with the best similarity;
null ids are kept as null; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import MB, by_batch, keep_rows

U64 = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
BITS = 128
RADIUS = 36
BLOCKS = 12
#: Bytes of item texts that go to the tasks at once.
ITEM_BYTES = 8 * MB
GROUP = 64  # items of one length in one index

_EDGES = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
_SECOND = U64(0xC2B2AE3D27D4EB4F)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """Each shingle's 128 bits as +1 and -1."""
    wide = np.stack([W.mix(shingles), W.mix(shingles ^ _SECOND)], axis=1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _blocks(bits: np.ndarray) -> np.ndarray:
    """Block values (rows x BLOCKS) of fingerprints given as 0/1 bits."""
    out = np.empty((len(bits), BLOCKS), np.int64)
    for b, (lo, hi) in enumerate(zip(_EDGES[:-1], _EDGES[1:])):
        out[:, b] = bits[:, lo:hi] @ (1 << np.arange(hi - lo))
    return out


def _near(width: int, flips: int) -> np.ndarray:
    """All masks of at most ``flips`` bits among ``width``."""
    return np.array([sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(width), n)], np.int64)


def _counts(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    most = int(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


class Items:
    """The index of one block of benchmark items, by their length in words."""

    def __init__(self, texts: list[str]):
        data, offsets = W.text_buffers(pa.array(texts, pa.large_string()))
        words = W.Words(data, offsets)
        hashes = words.hashes(lower=True)
        self.counts, self.by_length = {}, {}
        every = []
        for i in range(len(texts)):
            own = hashes[words.first[i] : words.first[i + 1]]
            if not len(own):
                continue
            shingles = W.rolling(own, min(SHINGLE, len(own)))
            self.counts[i] = _counts(shingles)
            every.append(shingles)
            self.by_length.setdefault(len(own), []).append((i, (_signs(shingles).sum(axis=0) > 0).astype(np.int64)))
        # Shingle widths differ only for items of fewer than five words.
        self.known = {}
        for length in self.by_length:
            width = min(SHINGLE, length)
            held = [self.counts[i][0] for i, _ in self.by_length[length]]
            self.known[width] = np.unique(np.concatenate([self.known.get(width, np.empty(0, U64)), *held]))
        self.filter = {}
        for width, known in self.known.items():
            table = np.zeros(1 << 20, bool)
            table[(known & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.filter[width] = table
        self.index = {length: [_Group(entries[j : j + GROUP]) for j in range(0, len(entries), GROUP)] for length, entries in self.by_length.items()}

    def holds(self, shingles: np.ndarray, width: int) -> np.ndarray:
        """Mask of the shingles that some item has."""
        maybe = np.flatnonzero(self.filter[width][(shingles & U64((1 << 20) - 1)).astype(np.int64)])
        known = self.known[width]
        spot = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        out = np.zeros(len(shingles), bool)
        out[maybe[known[spot] == shingles[maybe]]] = True
        return out


class _Group:
    """The multi-index of at most 64 items of one length: a bit set per block value."""

    def __init__(self, entries):
        self.items = np.array([i for i, _ in entries])
        self.bits = np.stack([bits for _, bits in entries])
        values = _blocks(self.bits)
        self.tables = []
        for b, (lo, hi) in enumerate(zip(_EDGES[:-1], _EDGES[1:])):
            table = np.zeros(1 << (hi - lo), U64)
            masks = _near(hi - lo, RADIUS // BLOCKS)
            for i in range(len(entries)):
                table[values[i, b] ^ masks] |= U64(1) << U64(i)
            self.tables.append(table)

    def candidates(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs within the radius."""
        values = _blocks(bits)
        met = np.zeros(len(bits), U64)
        for b, table in enumerate(self.tables):
            met |= table[values[:, b]]
        rows, items = [], []
        for i in range(len(self.items)):
            at = np.flatnonzero(met >> U64(i) & U64(1))
            at = at[(bits[at] != self.bits[i]).sum(axis=1) <= RADIUS]
            rows.append(at)
            items.append(np.full(len(at), self.items[i]))
        return np.concatenate(rows), np.concatenate(items)


def _leaks(items: Items):
    def shorter(words: W.Words, length: int, groups: list, total: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """Whole texts of fewer words than the items of one length: as ``search``."""
        width = min(SHINGLE, length)
        n, first = length - width + 1, words.first[:-1]
        size = np.diff(words.first)
        m = size - width + 1
        rows = np.flatnonzero((size < length) & (m >= max(1, n * SIMILARITY - 1e-9)))
        shared = total[first[rows] + m[rows]] - total[first[rows]]
        rows = rows[shared >= (m[rows] + n) * SIMILARITY / (1 + SIMILARITY) - 1e-9]
        for row in rows.tolist():
            own = shingles[first[row] : first[row] + m[row]]
            bits = (_signs(own).sum(axis=0) > 0).astype(np.int64)[None, :]
            for group in groups:
                for item in group.candidates(bits)[1]:
                    found = similarity(_counts(own), items.counts[int(item)])
                    if found >= SIMILARITY:
                        yield row, int(item), int(first[row]), int(size[row]), found

    def search(words: W.Words) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity) of each leaking window."""
        hashes = words.hashes(lower=True)
        held, shingles_of = {}, {}
        for width in items.known:
            shingles = W.rolling(hashes, width)
            shingles_of[width] = shingles
            held[width] = items.holds(shingles, width) & W.whole(words.first, width) if len(shingles) else np.zeros(0, bool)
        sums = {}
        for length, groups in items.index.items():
            width = min(SHINGLE, length)
            hit = held[width]
            n = length - width + 1
            if not hit.any():
                continue
            if width not in sums:
                sums[width] = np.concatenate([[0], np.cumsum(hit)])
            total = sums[width]
            yield from shorter(words, length, groups, total, shingles_of[width])
            if len(hashes) < length:
                continue
            # starts of windows whose shingles some item holds often enough
            least = int(np.ceil(2 * n * SIMILARITY / (1 + SIMILARITY) - 1e-9))
            starts = np.flatnonzero((total[n:] - total[:-n] >= least)[: len(hashes) - length + 1] & W.whole(words.first, length))
            if not len(starts):
                continue
            shingles = shingles_of[width]
            for s in range(0, len(starts), 4096):
                part = starts[s : s + 4096]
                # running sums over the stretch of words that these windows cover
                spots = np.unique((part[:, None] + np.arange(n)).ravel())
                run = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(shingles[spots]), axis=0, dtype=np.int32)])
                lo = np.searchsorted(spots, part)
                bits = (run[lo + n] - run[lo] > 0).astype(np.int64)
                for group in groups:
                    for row, item in zip(*group.candidates(bits)):
                        start = int(part[row])
                        found = similarity(_counts(shingles[start : start + n]), items.counts[int(item)])
                        if found >= SIMILARITY:
                            yield int(np.searchsorted(words.first, start, side="right") - 1), int(item), start, length, found

    return search


def _task(items: Items, names: list, kind: pa.DataType, item_kind: pa.DataType):
    search = _leaks(items)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        data, offsets = W.text_buffers(batch.column(1))
        best: dict = {}
        for a, z in W.slices(offsets):
            words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            for row, item, start, length, found in search(words):
                key = (a + row, item)
                place = start - int(words.first[row])
                if key not in best or (found, -place) > (best[key][0], -best[key][1]):
                    best[key] = (found, place, length)
        rows = [(ids[r], names[i], p, n, s) for (r, i), (s, p, n) in sorted(best.items())]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        kinds = [kind, item_kind, pa.int32(), pa.int32(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return by_batch(run)


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark's items in blocks of at most ``ITEM_BYTES`` (or one item)."""
    rows, size = [], 0
    for row in benchmark.select(id_col, F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        weight = len(row[1].encode())
        if rows and size + weight > ITEM_BYTES:
            yield rows
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += weight
    yield rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: a row per document and
    item it leaks, with its most similar (then first) window."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, start_word int, n_words int, similarity double"
    found = None
    for block in _item_blocks(benchmark, item_col, item_text):
        items = Items([text for _, text in block])
        part = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
            _task(items, [name for name, _ in block], to_arrow_type(id_type), to_arrow_type(item_type)), schema
        )
        found = part if found is None else found.union(part)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "n_words")).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a leaking window, with all their columns: a pass over
    the texts per block of items, and no shuffle."""
    for block in _item_blocks(benchmark, item_col, item_text):
        search = _leaks(Items([text for _, text in block]))

        def clean(column: pa.Array, search=search) -> np.ndarray:
            data, offsets = W.text_buffers(column)
            out = np.ones(len(column), bool)
            for a, z in W.slices(offsets):
                words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                out[[a + row for row, *_ in search(words)]] = False
            return out

        docs = keep_rows(docs, text_col, clean)
    return docs
