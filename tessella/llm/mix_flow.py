r"""Mixing sources to target weights by min-cost flow (operator 4).

A document may belong to several overlapping sources.  Documents are aggregated by
their membership pattern (the set of sources); a flow then sends each pattern's
token capacity to its sources' quotas.  The first reading of a pattern's tokens
costs nothing and each further reading costs more than the one before (convex
costs), so repeats are used only where fresh tokens run out.  Successive shortest
paths solve the flow exactly on the driver, over patterns and sources, whose number
is bounded (``MAX_PATTERNS``; beyond it the operator says so instead of guessing).

Then documents are selected: each has a place drawn from a seeded hash of its id
and text, and a pattern's flow takes its documents in that order, round after
round.  Running totals over the places come from histograms: hash buckets are
summed, the bucket where the flow ends is split again, and only the documents of
the last bucket are ordered.  A reading may stop inside the last document, so that
the mix takes exactly the flow.  No task orders a whole source.

Defined cases: a null text has size 0; the null source is a source of its own, last
in order; repeated rows are taken each, in an order given by their columns; with no
words all targets are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import words as W
from .common import by_batch, written

REPEATS = 2
SEED = 17
MAX_PATTERNS = 100_000
#: Hash bits per histogram level and levels: 2**24 last buckets.
LEVEL_BITS, LEVELS = 8, 3


def count_words(docs: DataFrame, text_col: str, keep: bool, out: str = "size") -> DataFrame:
    """``docs`` with each text's number of words (null texts: 0), and the text
    itself if it is to be kept."""
    place = docs.columns.index(text_col)
    columns = [i for i in range(len(docs.columns)) if keep or i != place]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = W.text_buffers(batch.column(place))
        sizes = [np.diff(W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]).first) for a, z in W.slices(offsets)]
        sizes = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        return pa.record_batch([*(batch.column(i) for i in columns), pa.array(sizes.astype(np.int64))], names=[*names, out])

    names = [docs.columns[i] for i in columns]
    schema = T.StructType([docs.schema.fields[i] for i in columns]).add(out, "long")
    return docs.mapInArrow(by_batch(run), schema)


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = REPEATS) -> list[float]:
    """``total`` shared by weight; a share stops at ``most`` times its size, and the
    excess is shared again among the rest by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def min_cost_flow(patterns: Sequence[tuple[frozenset, int]], quotas: dict, most: int = REPEATS) -> dict[tuple[int, object], int]:
    """Tokens that each pattern gives to each of its sources, at least total cost.

    ``patterns``: (sources, tokens).  Reading a pattern's tokens the n-th time costs
    n - 1 a token.  As much of the quotas as possible is met.  Successive shortest
    paths: with reduced costs kept non-negative, each path is a Dijkstra search over
    sources and patterns.
    """
    holders: dict = {}
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            holders.setdefault(s, []).append(p)
    need = {s: int(q) for s, q in quotas.items()}
    used = [0] * len(patterns)
    flow: dict[tuple[int, object], int] = {}

    def price(p: int) -> int | None:
        size = patterns[p][1]
        return None if used[p] >= most * size else used[p] // size

    def room(p: int) -> int:
        size = patterns[p][1]
        return size - used[p] % size

    # The single-source case needs no rerouting: its patterns fill by round.
    order = sorted(need, key=lambda s: (s is None, s or ""))
    for s in order:
        while need[s] > 0:
            # Shortest path from source s to any pattern with room: a step to a
            # full-priced pattern may push another source's flow out of it.
            best, end = None, None
            heap, seen, back = [(0, 0, ("s", s))], set(), {}
            tie = 0
            while heap:
                cost, _, node = heapq.heappop(heap)
                if best is not None and cost >= best:
                    break
                if node in seen:
                    continue
                seen.add(node)
                if node[0] == "s":
                    for p in holders.get(node[1], ()):
                        if ("p", p) not in seen:
                            back.setdefault(("p", p), node)
                            tie += 1
                            heapq.heappush(heap, (cost, tie, ("p", p)))
                else:
                    p = node[1]
                    here = price(p)
                    if here is not None and (best is None or cost + here < best):
                        best, end = cost + here, node
                    for other in patterns[p][0]:
                        if flow.get((p, other), 0) > 0 and ("s", other) not in seen:
                            back.setdefault(("s", other), node)
                            tie += 1
                            heapq.heappush(heap, (cost, tie, ("s", other)))
            if end is None:
                break
            path, node = [end], end
            while node != ("s", s):
                node = back[node]
                path.append(node)
            path.reverse()  # s, p, s', p', ..., p
            amount = min(need[s], room(path[-1][1]))
            for i in range(1, len(path) - 1, 2):
                amount = min(amount, flow[(path[i][1], path[i + 1][1])])
            for i in range(0, len(path), 2):
                key = (path[i + 1][1], path[i][1])
                flow[key] = flow.get(key, 0) + amount
                if i + 2 < len(path):
                    flow[(path[i + 1][1], path[i + 2][1])] -= amount
            used[path[-1][1]] += amount
            need[s] -= amount
    return {k: v for k, v in flow.items() if v}


def _take(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """``rows`` (``pattern, place, size`` and more) with ``fresh``: the words taken
    when each pattern's documents are read in order of ``place`` up to ``quota``
    (``pattern, part``).  Each level sums buckets and keeps the one that is cut."""
    spark = rows.sparkSession
    # (pattern, low, high, left): documents below ``low`` are whole, ``left`` words of
    # those in [low, high) remain to be taken.
    cut = quota.select("pattern", F.lit(0).cast("long").alias("low"), F.col("part").alias("left"))
    bits = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        width = 1 << (bits - LEVEL_BITS * level)
        inside = rows.join(F.broadcast(cut), "pattern").where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * (1 << LEVEL_BITS)))
        sums = inside.groupBy("pattern", "low", "left", F.floor((F.col("place") - F.col("low")) / width).alias("bucket")).agg(F.sum("size").alias("size"))
        run = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("size").over(run))
        # The cut lies in the first bucket that reaches what is left; where the
        # rows hold less than that, all are taken.
        found = sums.where("upto >= left").groupBy("pattern").agg(F.min_by(F.struct("bucket", "size", "upto", "low", "left"), "bucket").alias("b"))
        found = found.select("pattern", (F.col("b.low") + F.col("b.bucket") * width).alias("low"), (F.col("b.left") - F.col("b.upto") + F.col("b.size")).alias("left"))
        kept = [tuple(r) for r in found.collect()]
        known = {p for p, _, _ in kept}
        rest = [(r["pattern"], 1 << bits, 0) for r in cut.select("pattern").collect() if r["pattern"] not in known]
        cut = spark.createDataFrame(kept + rest, "pattern int, low long, left long")
    rows = rows.join(F.broadcast(cut), "pattern", "left")
    last = rows.where("place = low")
    order = Window.partitionBy("pattern").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    fresh = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("before")))
    last = last.withColumn("fresh", fresh).drop("before")
    whole = rows.where("low is null or place != low").withColumn("fresh", F.when(F.col("place") < F.col("low"), F.col("size")).otherwise(F.lit(0).cast("long")))
    return whole.unionByName(last).drop("low", "left")


def mix(docs: DataFrame, weights, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "sources", budget: float = 1.5, most: int = REPEATS, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """``docs``' ids with ``size, sources, taken`` and, per document, ``targets`` (a
    map from source to the source's target) and ``source_sizes``.

    ``sources_col`` is an array of source names (a null element is the null source).
    ``weights`` gives each source its weight: a function from the sources in code
    point order, null last, to a list.  ``budget``: the mix's share of all words.
    ``carry``: columns of ``docs`` that come along, under their own names.
    """
    place = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    base = docs.select(
        F.col(id_col).alias("id"),
        # equal rows differ nowhere, so their order does not matter
        place.alias("order"),
        F.array_distinct(F.col(sources_col)).alias("sources"),
        F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry) if c not in (id_col, text_col)),
    )
    sized = count_words(base, "text", text_col in carry).withColumn("sources", F.coalesce(F.sort_array("sources", asc=False), F.array().cast("array<string>")))
    sized = sized.withColumn("place", F.shiftrightunsigned("order", 64 - LEVEL_BITS * LEVELS))
    sized = written(sized, "sized")
    pattern_rows = sized.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(pattern_rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group the sources")
    pattern_rows = sorted(pattern_rows, key=lambda r: [(x is None, x or "") for x in r["sources"]])
    patterns = [(frozenset(r["sources"]), int(r["size"] or 0)) for r in pattern_rows]
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for p, n in patterns if s in p) for s in names]
    goal = targets(sizes, weights(names), budget * sum(n for _, n in patterns), most)
    filled = [i for i, (_, n) in enumerate(patterns) if n]
    flow = min_cost_flow([patterns[i] for i in filled], {s: round(g) for s, g in zip(names, goal)}, most)
    spark = docs.sparkSession
    total = [0] * len(patterns)
    for (p, _), amount in flow.items():
        total[filled[p]] += amount
    place = {s: i for i, s in enumerate(names)}
    # Rounds: whole readings, then a part of one more.
    table = [
        (i, list(r["sources"]), total[i] // n if n else 0, total[i] % n if n else 0, [s or "" for s in r["sources"]], [float(goal[place[s]]) for s in r["sources"]], [int(sizes[place[s]]) for s in r["sources"]])
        for i, (r, (_, n)) in enumerate(zip(pattern_rows, patterns))
    ]
    plan = spark.createDataFrame(table, "pattern int, sources array<string>, rounds long, part long, names array<string>, targets array<double>, source_sizes array<long>")
    rows = sized.join(F.broadcast(plan.select("pattern", F.to_json("sources").alias("key"), "rounds", "targets", "source_sizes")), F.to_json("sources") == F.col("key"))
    taken = _take(rows.drop("key"), plan.select("pattern", "part"))
    own = [F.col("text" if c == text_col else f"c_{i}").alias(c) for i, c in enumerate(carry) if c != id_col]
    return taken.select(F.col("id").alias(id_col), "size", "sources", "targets", "source_sizes", (F.col("rounds") * F.col("size") + F.col("fresh")).alias("taken"), *own)


def round_robin(names: Sequence, cycle: Sequence[int] = (3, 1, 2)) -> list[int]:
    return [cycle[i % len(cycle)] for i in range(len(names))]
