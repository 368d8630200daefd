"""Exact top-k search by no-random-access aggregation (operator 2).

A score is a sum over dimensions of query weight times component, so every dimension
is a list of candidates sorted by component: read from the top for a positive weight,
from the bottom for a negative one.  Lists are read sequentially; at each depth the
newly read entries replace what stood for them.  A candidate's lower bound adds what
was read of it to the least that its unread lists can hold; its upper bound adds the
values at which reading stands.  Once at most ``OPEN * k`` candidates have an upper
bound that reaches the k-th lower bound, no outsider can qualify; reading stops and the
open ones' scores are resolved.

Candidates lie in blocks of about ``BLOCK`` vectors, each with its own sorted lists,
and queries in blocks as well; every query block meets every candidate block (a
stated query set against all rows, in blocks).  A task that holds a query block
against one candidate block after the other starts from the k-th score that the
earlier ones gave.  Each query's best k of every block then merge into its best k:
scores descending, ties to the smaller id.

Components are ``floor(64 * x)``; sums are whole numbers, in single or double
precision while all partial sums are exact there, in Python integers beyond.

Defined cases: vectors that are null or hold null or non-finite components, and null
ids, take no part; only vectors of equal length meet; every row is a candidate and,
if asked for, a query, so repeated rows count as often as they are there (a query's
repeated rows share its ranks); rows that share the query's id are its own and no
candidates; scores beyond a long rank by their value in a block, and are cut to a long
between blocks; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, by_groups, partitions, written

BLOCK = 4096
QUERY_ROWS = 256
SCALE = 64
#: Shares of the lists read before each look at the bounds.
DEPTHS = (0.5, 0.8, 0.9, 0.95, 0.98, 1.0)
OPEN = 8  # times k


def _quantise(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(id, vector) -> (id, length, ``floor(64 * x) / 64`` as doubles, which is exact),
    usable vectors only."""
    ids, rows, sizes, kept = batch.column(0), batch.column(1), [], []
    values = rows.values.cast(pa.float64()) if rows.values.type != pa.float64() else rows.values
    usable = np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    flat = np.nan_to_num(values.fill_null(0.0).to_numpy(zero_copy_only=False))
    # From 2**53 on a double is whole already.
    flat = np.where(np.abs(flat) < 2.0**53, np.floor(np.clip(flat, -(2.0**53), 2.0**53) * SCALE) / SCALE, flat) + 0.0
    offsets = rows.offsets.to_numpy()
    valid = rows.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    packed = []
    for i in np.flatnonzero(valid).tolist():
        lo, hi = offsets[i], offsets[i + 1]
        if usable[lo:hi].all():
            kept.append(i)
            sizes.append(int(hi - lo))
            packed.append(flat[lo:hi].tobytes())
    return pa.record_batch([ids.take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["id", "length", "vector"])


def _pack(batch: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (length, block, id, vector) sorted by block and id -> a row per block."""
    length, block, ids, vector = (batch.column(i) for i in range(4))
    ends = [*starts[1:].tolist(), batch.num_rows]
    for s, e in zip(starts.tolist(), ends):
        packed = b"".join(vector.slice(s, e - s).to_pylist())
        yield pa.record_batch(
            [length.slice(s, 1), block.slice(s, 1), pa.array([ids.slice(s, e - s).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([packed], pa.binary())],
            names=["length", "block", "ids", "vectors"],
        )


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, earlier ones first on ties."""
    return np.argsort(-scores, kind="stable")[:k]


class Lists:
    """One candidate block: vectors sorted by id, and each dimension's sorted list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.x = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def depths(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """At one depth after the other what has been read shows: (lower, upper)
        stand-ins for the components, for positive weights and then for negative ones."""
        n, d = self.x.shape
        lower = np.concatenate([np.repeat(self.sorted[:1], n, axis=0), np.repeat(self.sorted[-1:], n, axis=0)], axis=1)
        read = np.zeros((n, 2 * d), bool)
        columns, at = np.arange(d), 0
        for share in DEPTHS:
            p = min(n, math.ceil(share * n))
            for side, rows in ((0, self.order[n - p : n - at]), (d, self.order[at:p])):
                lower[rows, side + columns] = self.x[rows, columns]
                read[rows, side + columns] = True
            stands = np.concatenate([self.sorted[n - p], self.sorted[p - 1]])
            yield lower, np.where(read, lower, stands)
            at = p

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floor: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query row, candidate rows, scores) of each query's best k that reach its
        ``floor``, a k-th score that other blocks gave (or None)."""
        own = np.searchsorted(self.ids, ids, side="left"), np.searchsorted(self.ids, ids, side="right")
        left = np.arange(len(queries))
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        signed = np.concatenate([np.maximum(queries, zero), np.minimum(queries, zero)], axis=1)
        others = np.ones(len(self.x), bool)
        for lower, upper in self.depths():
            low, high = signed[left] @ lower.T, signed[left] @ upper.T
            going = []
            for j, i in enumerate(left.tolist()):
                others[own[0][i] : own[1][i]] = False
                open_ = others.copy()
                others[own[0][i] : own[1][i]] = True
                there = low[j][open_]
                reach = floor[i]
                if len(there) >= k:
                    kth = np.partition(there, len(there) - k)[len(there) - k]
                    reach = kth if reach is None else max(reach, kth)
                if reach is not None:
                    open_ &= high[j] >= reach
                at = np.flatnonzero(open_)
                if len(at) <= OPEN * k:
                    # No outsider can qualify: the open ones' scores are resolved.
                    scores = self.x[at] @ queries[i]
                    best = _best(scores, k)
                    yield i, at[best], scores[best]
                else:
                    going.append(i)
            left = np.array(going, np.int64)
            if not len(left):
                return
        # Read to the end: the bounds are the scores.
        for j, i in enumerate((queries[left] @ self.x.T if len(left) else [])):
            at = np.concatenate([np.arange(own[0][left[j]]), np.arange(own[1][left[j]], len(self.x))])
            best = _best(i[at], k)
            yield int(left[j]), at[best], i[at][best]


def _whole(y: np.ndarray, kind) -> np.ndarray:
    """The whole numbers ``64 * y`` as ``kind``, or as Python integers."""
    if kind is not None:
        return (y * SCALE).astype(kind)
    out = np.empty(y.shape, object)
    out.reshape(-1)[:] = [int(v) * SCALE if abs(v) >= 2.0**53 else int(v * SCALE) for v in y.reshape(-1).tolist()]
    return out


def _precision(a: np.ndarray, b: np.ndarray):
    """The smallest float type in which every partial sum is exact, or None."""
    with np.errstate(over="ignore"):
        bound = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * SCALE * float(np.abs(b).max(initial=0)) * SCALE
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else None


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kth = None, {}  # the query block being held, and its queries' best scores so far
        for batch in batches:
            for length, name, c_ids, c, q_ids, q in zip(*(batch.column(i).to_pylist() for i in range(6))):
                c_ids, q_ids = np.frombuffer(c_ids, np.int64), np.frombuffer(q_ids, np.int64)
                c = np.frombuffer(c, float).reshape(len(c_ids), length)
                q = np.frombuffer(q, float).reshape(len(q_ids), length)
                if (length, name) != block:
                    block, kth = (length, name), {}
                kind = _precision(c, q)
                lists, asked = Lists(c_ids, _whole(c, kind)), _whole(q, kind)
                for s in range(0, len(q), QUERY_ROWS):
                    part, part_ids = asked[s : s + QUERY_ROWS], q_ids[s : s + QUERY_ROWS]
                    floor = [kth[s + i][-1] if len(kth.get(s + i, ())) == k else None for i in range(len(part))]
                    rows = []
                    for i, at, scores in lists.search(part_ids, part, k, floor):
                        known = [int(v) for v in scores.tolist()]
                        kth[s + i] = sorted([*kth.get(s + i, []), *known], reverse=True)[:k]
                        cut = np.array([min(max(v, -(2**63)), 2**63 - 1) for v in known], np.int64)
                        rows.append((np.full(len(at), part_ids[i]), c_ids[at], cut))
                    if rows:
                        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """Rows dealt by id over ``count`` blocks and packed, a row per block."""
    dealt = rows.select("length", F.pmod(F.xxhash64("id"), F.lit(count)).cast("long").alias("block"), "id", "vector")
    dealt = dealt.repartition(max(partitions(rows), 1), "length", "block").sortWithinPartitions("length", "block", "id", "vector")
    return dealt.mapInArrow(by_groups(2, _pack), "length long, block long, ids binary, vectors binary")


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's ``k`` best candidates.

    ``is_query``: a condition on the id; queries meet every row but their own.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(by_batch(_quantise), "id long, length long, vector binary")
    rows = written(rows, "vectors")
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    n, q = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-q // BLOCK))
    candidates = _blocks(rows, blocks).select("length", F.col("block").alias("c"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), _each(query_blocks).alias("q"))
    queries = _blocks(asked, query_blocks).select("length", F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), _each(blocks).alias("c"))
    pairs = candidates.join(queries.hint("merge"), ["length", "q", "c"]).select("length", "q", "c_ids", "c_vectors", "q_ids", "q_vectors")
    found = pairs.mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _each(count: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
