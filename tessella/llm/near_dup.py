r"""MinHash near-dedup: a Chosen-Path set similarity join (operator 10).

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased,
words ``[^\x20\x09-\x0D]+``); with fewer words, the whole sequence is the one shingle;
without words the set is empty and linked with nothing.  Two documents are linked if
``100 * |A & B| >= 80 * |A | B|``; components of these links are the groups.

1. *Classes.* Equal sets share a 128-bit digest; one row per class goes on, so
   copies are never paired with each other.
2. *Chosen paths.* ``trees`` independent trees branch every node by ``BRANCH``
   minwise tokens of the set (the node's path picks which); a set joins the child
   named by each token.  The root and its children hold more than a node may, so
   the first two choices are made at once.  With two choices a pair of Jaccard
   similarity s stays together in some child with the survival probability of a
   branching process of mean 2s, at any depth; ``trees`` follows from ``recall``.
3. *Small nodes* (at most ``NODE``) are compared exhaustively by their minhash
   sketches, and each gives a star per sketch component, never all pairs.  In a
   *large node* each set is held against the node's head: sets whose sketches agree
   in ``SETTLED`` of their places hang on it and branch no further, so a large
   group of near copies does not multiply; those that agree in ``UNSURE`` hang on
   it and go on too (a set similar to a settled one agrees at least as much, by
   the triangle inequality of Jaccard distance); the rest just goes on.  Whatever
   is still large at ``DEPTH`` hangs on the head.  All this only joins *candidate
   clusters*, which hold every true group whole; wrong members cost time, not
   correctness.
4. *Full sets.* Each cluster's full sets are compared exactly, by inverted lists,
   in blocks of bounded size.  A larger cluster has several blocks that share
   ``PIVOTS`` of its members.  What the blocks leave undecided - members outside
   their cluster's largest component - visits other blocks, though only those that an
   inverted list of prefixes names: with the shingles in any one order, two linked
   sets of n and m shingles share some of their first n - ceil(0.8 n) + 1 and
   m - ceil(0.8 m) + 1.  Shingles that few pivots hold come first, so a boilerplate's
   words name no block.  A list has a row per block and not per member, and only of
   shingles that pass a filter made of the undecided members' prefixes.  No link
   between components is lost, and no task holds more than a block and as many visitors.

Defined cases: null and word-free texts stand alone (``n_shingles`` 0, component
their own id, kept); rows with equal ids are separate documents; a null id gives
a null component unless its group holds an id, and is kept only where the
component is null as well; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .common import LAST_ID, by_batch, by_groups, clear, id_key, partitions, rows_of_binary, unused, written
from .components import components

U64 = np.uint64
SKETCH = 64
BRANCH = 2
NODE = 256
DEPTH = 8
SETTLED = 0.6
UNSURE = 0.2
#: A sketch of a pair at 0.8 agrees in 0.8 of its places, give or take 0.05.
SKETCH_SHARE = 0.55
BLOCK_SETS = 256
BLOCK_SHINGLES = 1 << 18
PIVOTS = 16
#: Bits of a cluster's filter, and the kinds of rows that a block is dealt.
FILTER_BITS = 1 << 19
MEMBER, PIVOT, FILTER = 0, 1, 2

_draw = np.random.default_rng(20240229)
_MULTIPLIERS = _draw.integers(0, 1 << 63, SKETCH, dtype=U64) << U64(1) | U64(1)
_SINGLE = U64(0x5851F42D4C957F2D)


def trees_for(recall: float, similarity: float = 0.8) -> int:
    """Independent trees that find a pair at ``similarity`` with chance ``recall``."""
    lost = 0.0
    for _ in range(64):
        lost = (1 - similarity + similarity * lost) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(column: pa.Array, width: int = 2) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    out: list[np.ndarray] = []
    data, offsets = W.text_buffers(column)
    for a, z in W.slices(offsets):
        words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        hashes = words.hashes(lower=True)
        runs = W.rolling(hashes, width)
        for f, l in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if l - f >= width:
                out.append(np.unique(runs[f : l - width + 1]))
            elif l > f:
                out.append(W.mix(W.rolling(hashes[f:l], l - f) ^ _SINGLE))
            else:
                out.append(np.empty(0, U64))
    return out


def _sketch(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(U64).max, U64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i : i + 1024, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (W.mix(least) >> U64(48)).astype(np.uint16)


#: Rows whose sets are in memory at once.
ROWS = 512


def _describe(width: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            digests, sketches, sizes = [], [], []
            for shingles in shingle_sets(part.column(3), width):
                sizes.append(len(shingles))
                digests.append(_digest(shingles) if len(shingles) else None)
                sketches.append(_sketch(shingles).tobytes() if len(shingles) else None)
            columns = [*(part.column(i) for i in range(3)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            out.append(pa.record_batch(columns, names=["out_id", "doc", "h", "cid", "n", "sketch"]))
        return out

    return by_batch(run)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _child(node: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(node ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15))) + value.astype(U64))


def _branch(node: np.ndarray, sketch: np.ndarray, first_place: int) -> list[np.ndarray]:
    """The ``BRANCH`` children of each row's node, by places that the node picks."""
    free = SKETCH - first_place
    rows = np.arange(len(node))
    out = []
    for b in range(BRANCH):
        # two different places: the second is an offset from the first
        pick = (W.mix(node + U64(1)) % U64(free)).astype(np.int64)
        if b:
            pick = (pick + 1 + (W.mix(node + U64(1 + b)) % U64(free - 1)).astype(np.int64)) % free
        place = first_place + pick
        out.append(_child(node, place, sketch[rows, place]))
    return out


def _roots(trees: int):
    """Two choices at once: the children's children of every tree's root."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        key = batch.column(0)
        sketch = rows_of_binary(batch.column(1), np.uint16, SKETCH)
        out = []
        for tree in range(trees):
            for b in range(BRANCH):
                place = (tree * BRANCH + b) % SKETCH
                root = np.full(len(sketch), W.mix(np.array([tree + 1], U64))[0], U64)
                node = _child(root, np.full(len(sketch), place), sketch[:, place])
                for child in _branch(node, sketch, min(trees * BRANCH, SKETCH // 2)):
                    out.append(pa.record_batch([pa.array(child.view(np.int64)), key], names=["node", "key"]))
        return out

    return by_batch(run)


def _deeper(first_place: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        node = batch.column(0).to_numpy().view(U64)
        sketch = rows_of_binary(batch.column(2), np.uint16, SKETCH)
        return [
            pa.record_batch([pa.array(child.view(np.int64)), batch.column(1)], names=["node", "key"])
            for child in _branch(node, sketch, first_place)
        ]

    return by_batch(run)


def _agree(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(node, key, sketch, head, head's sketch) -> the share of places that agree."""
    own, head = (rows_of_binary(batch.column(i), np.uint16, SKETCH) for i in (2, 4))
    share = (own == head).mean(axis=1)
    return pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(share)], names=["node", "key", "sketch", "head", "share"])


def _forest(links: np.ndarray) -> np.ndarray:
    """Each member's component (its smallest index) in a small symmetric matrix."""
    m = len(links)
    label = np.arange(m)
    while True:
        least = np.where(links, label[None, :], m).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _compare_small(batch: pa.RecordBatch, starts: np.ndarray):
    """Small nodes' members compared by sketches -> a star per component."""
    key = batch.column(1).to_numpy()
    sketch = rows_of_binary(batch.column(2), np.uint16, SKETCH)
    need = math.ceil(SKETCH_SHARE * SKETCH)
    size = np.diff(np.append(starts, len(key)))
    us, vs = [], []
    two = starts[size == 2]
    if len(two):
        alike = (sketch[two] == sketch[two + 1]).sum(axis=1) >= need
        us.append(key[two[alike]])
        vs.append(key[two[alike] + 1])
    for s, m in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
        part = sketch[s : s + m]
        same = np.zeros((m, m), np.uint8)
        for j in range(SKETCH):
            same += part[:, j, None] == part[None, :, j]
        label = _forest(same >= need)
        moved = np.flatnonzero(label != np.arange(m))
        if len(moved):
            us.append(key[s + moved])
            vs.append(key[s + label[moved]])
    if us:
        yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def candidate_edges(classes: DataFrame, trees: int, scratch: list[str]) -> DataFrame:
    """``u, v`` edges whose components hold every pair of similar classes whole
    (with the recall that ``trees`` gives).  ``classes``: ``key`` and ``sketch``."""
    used = min(trees * BRANCH, SKETCH // 2)
    small, edges = [], []
    rows = classes.select("key", "sketch").mapInArrow(_roots(trees), "node long, key long")
    for depth in range(2, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("m"), F.min("key").alias("head")).where("m > 1")
        # Written, so that both sides of the join have an exchange and a hot node splits.
        sizes = written(sizes, f"sizes{depth}", compact=True, scratch=scratch)
        held = rows.join(sizes.hint("merge"), "node").join(classes.select("key", "sketch"), "key").select("node", "key", "sketch", "m", "head")
        held = written(held, f"nodes{depth}", scratch=scratch)
        small.append(held.where(F.col("m") <= NODE).select("node", "key", "sketch"))
        large = held.where(F.col("m") > NODE).select("node", "key", "sketch", "head")
        if large.isEmpty():
            break
        if depth == DEPTH:
            edges.append(large.select(F.col("key").alias("u"), F.col("head").alias("v")))
            break
        heads = large.where("key = head").select("node", F.col("sketch").alias("head_sketch")).dropDuplicates(["node"])
        judged = large.join(heads, "node").select("node", "key", "sketch", "head", "head_sketch")
        judged = written(judged.mapInArrow(by_batch(_agree), "node long, key long, sketch binary, head long, share double"), f"judged{depth}", scratch=scratch)
        edges.append(judged.where(F.col("share") >= UNSURE).select(F.col("key").alias("u"), F.col("head").alias("v")))
        open_rows = judged.where(F.col("share") < SETTLED).select("node", "key", "sketch")
        rows = written(open_rows.mapInArrow(_deeper(used), "node long, key long"), f"rows{depth}", scratch=scratch)
    # Nodes' numbers tell their depths apart, so all small ones are compared at once.
    nodes = reduce(DataFrame.union, small).repartition(partitions(classes), "node").sortWithinPartitions("node", "key")
    found = nodes.mapInArrow(by_groups(1, _compare_small), "u long, v long")
    return reduce(DataFrame.union, edges, found)


class _Links:
    """Exact links among sets held in one task, by inverted lists."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        values, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)

    def of(self, i: int) -> np.ndarray:
        """Mask of the sets linked with set ``i``."""
        own = self.at[self.start[i] : self.start[i] + self.size[i]]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.at], self.start, dtype=np.int64)
        self.mark[own] = False
        return 100 * both >= 80 * (self.size[i] + self.size - both)


def _block(batch: pa.RecordBatch, starts: np.ndarray):
    """Blocks (root, block) of classes with their sets and keys -> every class with
    its component's smallest key within the block.  Pivots come last in a block."""
    cids, sets, keys = batch.column(3), batch.column(4), batch.column(5).to_numpy()
    out, labels = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        rows = list(dict(zip(cids.slice(s, e - s).to_pylist(), range(s, e))).values())
        names = keys[rows]
        order = np.argsort(names, kind="stable")
        rows, names = [rows[i] for i in order.tolist()], names[order]
        label = np.arange(len(rows))
        if len(rows) > 1:
            links, groups = _Links([np.frombuffer(sets[r].as_buffer(), U64) for r in rows]), len(rows)
            for i in range(len(rows)):
                if groups == 1:
                    break
                joined = np.unique(label[links.of(i)])
                if len(joined) > 1:
                    groups -= len(joined) - 1
                    label[np.isin(label, joined)] = joined[0]
        out.extend(rows)
        labels.append(names[label])
    if out:
        take = batch.take(pa.array(out, pa.int64()))
        columns = [take.column(i) for i in (0, 1, 2, 3, 5, 6)]
        yield pa.record_batch([*columns, pa.array(np.concatenate(labels))], names=["root", "block", "pivot", "cid", "key", "blocks", "label"])


def _across(batch: pa.RecordBatch, starts: np.ndarray):
    """Blocks (root, block, share) with their members and visitors (``probe``) ->
    exact links between different components (``label``)."""
    us, vs = [], []
    label_all, probe_all = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        probe = np.flatnonzero(probe_all[s:e])
        if not len(probe) or len(probe) == e - s:
            continue
        label = label_all[s:e]
        links = _Links([np.frombuffer(x.as_buffer(), U64) for x in batch.column(3).slice(s, e - s)])
        for i in probe.tolist():
            # one link to each component it meets is enough
            met = np.unique(label[links.of(i) & (label != label[i])])
            us.extend([label[i]] * len(met))
            vs.extend(met.tolist())
    if us:
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _prefix(own: np.ndarray, common: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The set's prefix, shingles ordered by how many pivots hold them, then by hash:
    the same order in all blocks of a cluster."""
    often = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        often = np.where(common[at] == own, held[at], 0)
    return own[np.lexsort((own, often))[: len(own) - _needed(len(own)) + 1]]


def _blocks_with_pivots(batch: pa.RecordBatch, starts: np.ndarray):
    """Rows (root, block, kind, shingles, key) -> each block's first row, members'
    rows, pivots' shingles with their counts, and the filter's bits if it has one."""
    kind, keys = batch.column(2).to_numpy(), batch.column(4).to_numpy()
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        bits = None
        of = {}
        for i in range(s, e):
            if kind[i] == PIVOT:
                of[int(keys[i])] = np.frombuffer(batch.column(3)[i].as_buffer(), U64)
            elif kind[i] == FILTER:
                bits = np.frombuffer(batch.column(3)[i].as_buffer(), U64)
        common, held = np.unique(np.concatenate([*of.values(), np.empty(0, U64)]), return_counts=True)
        yield s, s + np.flatnonzero(kind[s:e] == MEMBER), common, held, bits


def _undecided_tokens(batch: pa.RecordBatch, starts: np.ndarray):
    """Undecided members (and pivots) -> a row for each shingle of a member's prefix."""
    for s, members, common, held, _ in _blocks_with_pivots(batch, starts):
        own = [_prefix(np.frombuffer(batch.column(3)[i].as_buffer(), U64), common, held) for i in members.tolist()]
        if own:
            row = pa.array(np.repeat(members, [len(x) for x in own]))
            yield pa.record_batch([*(batch.column(i).take(row) for i in (0, 1)), pa.array(np.concatenate(own).view(np.int64)), batch.column(4).take(row)], names=["root", "block", "token", "key"])


def _block_tokens(batch: pa.RecordBatch, starts: np.ndarray):
    """All members (pivots, and the cluster's filter) -> the prefix shingles of each
    block, once each, that pass the filter."""
    for s, members, common, held, bits in _blocks_with_pivots(batch, starts):
        own = [_prefix(np.frombuffer(batch.column(3)[i].as_buffer(), U64), common, held) for i in members.tolist()]
        if own and bits is not None:
            token = np.unique(np.concatenate(own))
            spot = token & U64(FILTER_BITS - 1)
            token = token[(bits[(spot >> U64(6)).astype(np.intp)] >> (spot & U64(63)) & U64(1)) == 1]
            yield pa.record_batch([*(pa.array(np.full(len(token), batch.column(i)[s].as_py(), np.int64)) for i in (0, 1)), pa.array(token.view(np.int64))], names=["root", "block", "token"])


def _pack_filter(batch: pa.RecordBatch, starts: np.ndarray):
    """(root, word, bits) -> a row per root with its whole bitmap."""
    word, bits = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(U64)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        whole = np.zeros(FILTER_BITS // 64, U64)
        whole[word[s:e]] = bits[s:e]
        yield pa.record_batch([batch.column(0).slice(s, 1), pa.array([whole.tobytes()], pa.binary())], names=["root", "shingles"])


def _needed(n):
    """Shingles that a set of ``n`` shares with any set it is linked with."""
    return -(-80 * n // 100)


def undecided_tokens(wide: DataFrame, pivots: DataFrame, labels: DataFrame) -> DataFrame:
    """``root, block, token, key``: the prefix shingles of undecided members.

    ``wide`` and ``pivots``: ``root, block, cid, shingles, key``; ``labels``: ``key,
    label, probe`` of the clusters that have undecided members."""
    return _dealt([_kind(wide, labels.where("probe"), MEMBER), _kind(pivots, labels, PIVOT)]).mapInArrow(by_groups(2, _undecided_tokens), "root long, block long, token long, key long")


def block_tokens(wide: DataFrame, pivots: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """``root, block, token``: blocks' prefix shingles that undecided members of their
    cluster (``wanted``) may have.  A bitmap of bounded size says which; one that a
    cluster's many undecided members fill up lets more shingles pass, and loses none."""
    n = partitions(wide)
    spot = F.col("token").bitwiseAND(F.lit(FILTER_BITS - 1))
    # Shares of 64 bits: at most FILTER_BITS / 64 rows a cluster.
    bits = wanted.select("root", F.shiftright(spot, 6).alias("word"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit")).groupBy("root", "word").agg(F.bit_or("bit").alias("bits"))
    packed = bits.repartition(n, "root").sortWithinPartitions("root", "word").mapInArrow(by_groups(1, _pack_filter), "root long, shingles binary")
    blocks = wide.groupBy("root").agg(F.max("blocks").alias("blocks"))
    filters = packed.join(blocks.hint("merge"), "root").select("root", _blocks_of(), F.lit(FILTER).alias("kind"), "shingles", F.lit(0).cast("long").alias("key"))
    return _dealt([_kind(wide, labels, MEMBER), _kind(pivots, labels, PIVOT), filters]).mapInArrow(by_groups(2, _block_tokens), "root long, block long, token long")


def _kind(rows: DataFrame, labels: DataFrame, kind: int) -> DataFrame:
    return rows.join(labels.select("key").hint("merge"), "key").select("root", "block", F.lit(kind).alias("kind"), "shingles", "key")


def _dealt(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.union, parts)
    return rows.repartition(partitions(rows), "root", "block").sortWithinPartitions("root", "block")


def visits(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """``key, root, block, share, shares``: the blocks that each undecided member must
    be held against, at most about ``BLOCK_SETS`` visitors to a share of a block."""
    members = members.withColumnRenamed("block", "home")
    # A list is bits, 64 blocks to a row: a common shingle meets few rows, and a member's
    # lists are one before their blocks are rows.
    bit = F.expr("shiftleft(1L, cast(block & 63 as int))")
    lists = blocks.groupBy("root", "token", F.shiftright("block", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    named = members.join(lists.hint("merge"), ["root", "token"]).groupBy("key", "root", "home", "word").agg(F.bit_or("bits").alias("bits"))
    # Its own block is done: all its members were held against each other.
    named = named.withColumn("bits", F.when(F.shiftright("home", 6) == F.col("word"), F.expr("bits & ~shiftleft(1L, cast(home & 63 as int))")).otherwise(F.col("bits")))
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    met = named.select("key", "root", "word", F.explode(held).alias("at")).select("key", "root", (F.col("word") * 64 + F.col("at")).alias("block"))
    shares = met.groupBy("root", "block").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("shares"))
    return met.join(shares.hint("merge"), ["root", "block"]).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")))


def _set_rows(width: int):
    """(text, cid, root, key) -> the rows whose text has the class's set, with it."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for s in range(0, batch.num_rows, ROWS):
            part = batch.slice(s, ROWS)
            sets, own = shingle_sets(part.column(0), width), part.column(1).to_pylist()
            take = [i for i, x in enumerate(sets) if len(x) and _digest(x) == own[i]]
            rows = pa.array(take, pa.int64())
            columns = [*(part.column(i).take(rows) for i in (1, 2, 3)), pa.array([sets[i].tobytes() for i in take], pa.binary())]
            out.append(pa.record_batch(columns, names=["cid", "root", "key", "shingles"]))
        return out

    return by_batch(run)


def exact_components(members: DataFrame, texts: DataFrame, scratch: list[str], width: int = 2) -> DataFrame:
    """``cid, comp`` of exact components among candidate clusters' classes.

    ``members``: ``cid, rep, n, key, root`` (root: the cluster; rep: ``doc, h`` of one
    row with the set); ``texts``: ``doc, h, text``.  A cluster of one block is settled
    in its task; only larger ones need their blocks joined.
    """
    n = partitions(members)
    # Merged at every size: the members grow with the documents.
    own = members.select("rep.doc", "rep.h", "cid", "root", "key").hint("merge")
    sets = own.join(texts, ["doc", "h"]).select("text", "cid", "root", "key")
    sets = sets.mapInArrow(_set_rows(width), "cid binary, root long, key long, shingles binary")
    weight = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    weight = weight.select(
        "root", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("all") / BLOCK_SHINGLES), F.lit(1)).cast("long").alias("blocks")
    )
    columns = ["root", "block", F.lit(False).alias("pivot"), "cid", "shingles", "key", "blocks"]
    sets = written(sets.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("long")).select(columns), "sets", scratch=scratch)
    wide = sets.where("blocks > 1")
    several = not wide.isEmpty()
    rows = sets
    if several:
        rank = Window.partitionBy("root").orderBy(F.xxhash64("cid", F.lit(1)), "cid")
        pivots = wide.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PIVOTS).select("root", _blocks_of(), F.lit(True).alias("pivot"), "cid", "shingles", "key", "blocks")
        rows = sets.union(pivots)
    dealt = rows.repartition(n, "root", "block").sortWithinPartitions("root", "block", "pivot")
    labelled = dealt.mapInArrow(by_groups(2, _block), "root long, block long, pivot boolean, cid binary, key long, blocks long, label long")
    labelled = written(labelled, "labelled", scratch=scratch)
    settled = labelled.where("blocks = 1").select("cid", F.col("label").alias("comp"))
    if not several:
        return settled
    open_rows = labelled.where("blocks > 1")
    # Only pivots lie in several blocks and so join the components of different ones.
    links = open_rows.where("pivot").select(F.col("key").alias("u"), F.col("label").alias("v"))
    found = written(components(links, "joined", scratch), "joined", compact=True, scratch=scratch)
    held = open_rows.groupBy("root", "cid", "key").agg(F.min("label").alias("label"))
    named = held.join(found.hint("merge"), held["label"] == found["node"], "left").select(held["root"], "cid", "key", F.coalesce(found["root"], "label").alias("label"))
    named = written(named, "labels", compact=True, scratch=scratch)
    sizes = named.groupBy("root", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    known = named.select("cid", F.col("label").alias("comp"))
    if main.isEmpty():
        return settled.union(known)
    # Members outside their cluster's largest component visit the blocks that their rare shingles name.
    labels = named.join(main.hint("merge"), "root").select("key", "label", (F.col("label") != F.col("main")).alias("probe"))
    labels = written(labels, "undecided", compact=True, scratch=scratch)
    wanted = written(undecided_tokens(wide, pivots, labels), "wanted", compact=True, scratch=scratch)
    there = written(block_tokens(wide, pivots, labels, wanted), "there", scratch=scratch)
    visit = written(visits(wanted, there), "visits", compact=True, scratch=scratch)
    more = _meet(wide, labels, visit).mapInArrow(by_groups(3, _across), "u long, v long")
    final = components(more, "final", scratch)
    out = named.join(final.hint("merge"), named["label"] == final["node"], "left").select("cid", F.coalesce(final["root"], "label"))
    return settled.union(out)


def _meet(wide: DataFrame, labels: DataFrame, visit: DataFrame) -> DataFrame:
    """Visited blocks' members and their visitors, sorted by (root, block, share)."""
    sets = wide.select("root", "block", "shingles", "key").join(labels.hint("merge"), "key")
    shares = visit.select("root", "block", "shares").distinct()
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    own = sets.join(shares.hint("merge"), ["root", "block"]).select("root", "block", share, "shingles", "label", F.lit(False).alias("probe"))
    guests = visit.select("key", "root", "block", "share").join(sets.select("key", "shingles", "label").hint("merge"), "key")
    rows = own.union(guests.select("root", "block", "share", "shingles", "label", F.lit(True).alias("probe")))
    return rows.repartition(partitions(wide), "root", "block", "share").sortWithinPartitions("root", "block", "share")


def _blocks_of():
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.99999, width: int = 2) -> DataFrame:
    """A row per document: its id, ``n_shingles``, ``component_id`` and ``kept``.

    ``width``: words in a shingle."""
    trees = trees_for(recall)
    text = F.col(text_col).cast("string")
    # ``h`` tells rows without an id, or with the same one, apart.
    texts = docs.select(F.col(id_col).alias("out_id"), id_key(id_col).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(texts.mapInArrow(_describe(width), f"out_id {kind}, doc long, h long, cid binary, n long, sketch binary"), "described")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc", "h")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("key", F.xxhash64("cid")), "classes")
    scratch: list[str] = []
    clusters = components(written(candidate_edges(classes, trees, scratch), "candidates", compact=True, scratch=scratch), "clusters", scratch)
    members = written(classes.join(clusters.withColumnRenamed("node", "key").hint("merge"), "key").select("cid", "rep", "n", "key", "root"), "members", compact=True, scratch=scratch)
    exact = written(exact_components(members, texts.select("doc", "h", "text"), scratch, width), "groups", compact=True)
    clear(docs.sparkSession, scratch)
    names = classes.select("cid", F.col("rep.doc").alias("rep"))
    least = exact.join(names, "cid").groupBy("comp").agg(F.min("rep").alias("least"))
    labels = names.join(exact.join(least, "comp").select("cid", "least"), "cid", "left")
    # Written, so that the join below has an exchange on both sides and a hot class splits.
    labels = written(labels.select("cid", F.coalesce("least", "rep").alias("least")), "labels", compact=True)
    out = rows.select("out_id", "doc", "cid", "n").join(labels.hint("merge"), "cid", "left")
    least = F.nullif(F.coalesce("least", "doc"), F.lit(LAST_ID))
    out = out.select(F.col("out_id"), F.col("n").alias("n_shingles"), least.alias("component_id"))
    return out.withColumn("kept", F.col("out_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("out_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.99999, width: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Repeated rows (same id and text) count once; documents without words stay."""
    kept_id, nth = unused(docs, "kept"), unused(docs, "nth")
    found = near_duplicates(docs, id_col, text_col, recall, width)
    kept = found.where("kept").select(F.col(id_col).alias(kept_id)).distinct()
    rows = docs.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    again = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.col(id_col))
    return rows.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).drop(nth)
