"""Corpus building: leakage control, deduplication, sampling, hold-outs, manifests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.points import before, classes, code_points, slices
from ..functions.text import letters_only, sentence_hash, shingles_or_whole, strip
from ..session import scratch_path
from .ranks import running_total

Hash = Callable[[Column], Column]


class LeakageError(ValueError):
    """Evaluation text was found where it must not be."""


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Named sources in one table, with ``source`` and its rank as ``source_rank``."""
    parts = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    if not parts:
        raise ValueError("no sources")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exclusion_hashes(texts: DataFrame, text_col: str = "text", hash_fn: Hash = sentence_hash) -> DataFrame:
    """The distinct hashes of evaluation texts."""
    return texts.select(hash_fn(F.col(text_col)).alias("hash")).where("hash is not null").distinct()


def without_leaks(rows: DataFrame, exclusion: DataFrame, text_col: str = "text", hash_fn: Hash = sentence_hash) -> DataFrame:
    """Rows whose hash is not excluded: a left anti join."""
    return rows.withColumn("hash", hash_fn(F.col(text_col))).join(exclusion, "hash", "left_anti").drop("hash")


def leak_counts(rows: DataFrame, exclusion: DataFrame, by: Sequence[str], text_col: str = "text", hash_fn: Hash = sentence_hash) -> DataFrame:
    """Per group: rows, and rows that are excluded."""
    marked = rows.withColumn("hash", hash_fn(F.col(text_col))).join(exclusion.select("hash", F.lit(True).alias("leaked")), "hash", "left")
    return marked.groupBy(*by).agg(F.count("*").alias("n_in"), F.count_if(F.coalesce("leaked", F.lit(False))).alias("n_leaked"))


def assert_no_leaks(rows: DataFrame, exclusion: DataFrame, label: str, id_col: str, text_col: str = "text", hash_fn: Hash = sentence_hash) -> None:
    """Raise ``LeakageError`` naming up to five offending rows."""
    found = rows.withColumn("hash", hash_fn(F.col(text_col))).join(exclusion, "hash", "left_semi").select(id_col).orderBy(id_col).limit(5).collect()
    if found:
        raise LeakageError(f"{label}: excluded text at {[r[0] for r in found]}")


def coverage(evaluation: DataFrame, exclusion: DataFrame, text_col: str = "text", hash_fn: Hash = sentence_hash) -> DataFrame:
    """How many evaluation rows the exclusion list holds and lacks."""
    marked = evaluation.select(hash_fn(F.col(text_col)).alias("hash")).join(exclusion.select("hash", F.lit(1).alias("held")), "hash", "left")
    return marked.agg(F.count("*").alias("n_checked"), F.count_if(F.col("held").isNull()).alias("n_missing"))


def shingle_index(evaluation: DataFrame, k: int, text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """Distinct ``(eval_source, shingle)`` of evaluation letters; texts with fewer than
    ``k`` letters are their own shingle, and letterless ones have none."""
    source = F.col(source_col) if source_col else F.lit("all")
    return evaluation.select(source.alias("eval_source"), F.explode(shingles_or_whole(letters_only(F.col(text_col)), k)).alias("shingle")).distinct()


#: Bits of the filter that a row's shingles pass before they are rows (4 MB), and bytes of text hashed at once.
FILTER_BITS, LETTERS = 25, 1 << 17
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array: its products wrap without a warning


def _spots(hashes: np.ndarray) -> np.ndarray:
    """The filter's bit of each hash."""
    return ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER_BITS)


def _window_spots(points: np.ndarray, k: int) -> np.ndarray:
    """The filter's bit of each window of ``k`` code points, by doubling."""
    held, base, done, out, size = points.astype(np.uint64), _BASE, 0, None, 1
    while True:
        if k & size:
            if out is None:
                out = held
            else:  # the windows so far, then one of ``size``
                out = out[: max(len(points) - done - size + 1, 0)] * base + held[done : len(points) - size + 1]
            done += size
        if done == k:
            break
        held = held[: max(len(held) - size, 0)] * base + held[size:]
        base, size = base * base, size * 2
    return _spots(out)


def _whole_spots(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The filter's bit of each whole text of a few code points, its size included."""
    out = sizes.astype(np.uint64)
    for i in range(int(sizes.max(initial=0))):
        longer = np.flatnonzero(sizes > i)
        out[longer] = out[longer] * _BASE + points[starts[longer] + i]
    return _spots(out)


def _held(spots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[(spots >> np.uint64(6)).astype(np.intp)] >> (spots & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingle_filter(index: DataFrame, k: int) -> np.ndarray:
    """A bitmap of the index's shingles, whole short texts among them, of a size that
    does not grow with it: one that a large index fills up lets more rows pass and
    loses none."""

    @F.arrow_udf("long")
    def spots(shingles: pa.Array) -> pa.Array:
        points, bounds = code_points(shingles)
        sizes, out = np.diff(bounds), np.zeros(len(shingles), np.uint64)
        full, short = np.flatnonzero(sizes == k), np.flatnonzero(sizes < k)
        if len(full):
            out[full] = _window_spots(points, k)[bounds[full]]
        out[short] = _whole_spots(points, bounds[short], sizes[short])
        return pa.array(out.astype(np.int64))

    spot = index.where("shingle != ''").select(spots("shingle").alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = spot.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def filtered_shingles(text: Column, k: int, bits: np.ndarray) -> Column:
    """The distinct shingles of a text's letters (``shingles_or_whole``) that pass the
    filter; no shingle of the filter's index is lost."""
    table = classes(r"\p{L}")

    @F.arrow_udf("array<string>")
    def passing(texts: pa.Array) -> pa.Array:
        rows, found = [], []
        for first, part in slices(texts, LETTERS):
            points, bounds = code_points(part)
            kept = table[points] != 0
            points, bounds = points[kept], before(kept)[bounds]
            sizes = np.diff(bounds)
            short = np.flatnonzero((sizes > 0) & (sizes < k))
            short = short[_held(_whole_spots(points, bounds[short], sizes[short]), bits)]
            at = np.flatnonzero(_held(_window_spots(points, k), bits)) if len(points) >= k else short[:0]
            row = np.searchsorted(bounds, at, "right") - 1
            inside = at + k <= bounds[row + 1]
            row, at = np.concatenate([short, row[inside]]), np.concatenate([bounds[short], at[inside]])
            if len(row):
                letters = points.tobytes().decode("utf-32-le")
                rows.append(row + first)
                found.extend(letters[i : i + n] for i, n in zip(at.tolist(), np.minimum(sizes[row], k).tolist()))
        row = np.concatenate([*rows, np.empty(0, np.int64)])
        # Each row's shingles together and once.
        pairs = sorted(set(zip(row.tolist(), found)))
        ends = np.searchsorted(np.array([r for r, _ in pairs], np.int64), np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([s for _, s in pairs], pa.string()))

    return passing(text)


def shingle_overlaps(rows: DataFrame, index: DataFrame, k: int, id_col: str, text_col: str = "text") -> DataFrame:
    """Distinct ``(id, eval_source)`` pairs that share a shingle.  The rows' own short
    texts are whole shingles too, so one equi-join covers both cases.  Only shingles
    that pass a filter of the index become rows; the join decides."""
    exploded = rows.select(F.col(id_col), F.explode(filtered_shingles(F.col(text_col), k, shingle_filter(index, k))).alias("shingle"))
    return exploded.join(index, "shingle").select(id_col, "eval_source").distinct()


def line_digest(text: Column) -> Column:
    """A 128-bit key of a text, as binary: what deduplication shuffles in its place."""
    return F.unhex(F.md5(text))


def first_occurrences(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``.  Keys meet as 128-bit digests.  The
    minimum of the order columns is an aggregate with partial sums, so a hot key does
    not gather its rows; only the winners join back."""
    keyed = rows.withColumn("__key", line_digest(key))
    first = keyed.groupBy("__key").agg(F.min(F.struct(*order)).alias("__first"))
    again = keyed.join(first, keyed["__key"].eqNullSafe(first["__key"]) & (F.struct(*(keyed[c] for c in order)) == first["__first"]), "left_semi")
    return again.drop("__key")


def dedup_across_sources(rows: DataFrame, text_col: str = "text", order: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """Non-blank rows, first of each stripped text in (source, position) order."""
    plain = rows.withColumn("__plain", strip(F.col(text_col))).where("__plain != ''")
    return first_occurrences(plain, F.col("__plain"), order).drop("__plain")


def dedup_counts(rows: DataFrame, by: Sequence[str], text_col: str = "text", order: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """Per group: rows in, blanks, duplicates of an earlier row, rows kept."""
    plain = strip(F.col(text_col))
    # A text's first row alone counts, and of it only its group: no join, no text in a shuffle.
    firsts = rows.where(plain != "").groupBy(line_digest(plain).alias("__key")).agg(F.min(F.struct(*order, *by)).alias("__first"))
    kept = firsts.groupBy(*(F.col("__first")[c].alias(c) for c in by)).agg(F.count("*").alias("n_out"))
    every = rows.groupBy(*by).agg(F.count("*").alias("n_in"), F.count_if(plain == "").alias("n_blank"))
    out = every.join(kept, list(by), "left").withColumn("n_out", F.coalesce("n_out", F.lit(0).cast("long")))
    return out.withColumn("n_duplicate", F.col("n_in") - F.col("n_blank") - F.col("n_out"))


def manifest(rows: DataFrame, by: Sequence[str] = (), text_col: str = "text") -> DataFrame:
    """Lines, characters and bytes (line ends included in ``file_bytes``), and an
    order-free fingerprint of the lines."""
    text = F.col(text_col)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.length(text)).cast("long").alias("n_chars"),
        F.sum(F.octet_length(text)).cast("long").alias("n_bytes"),
        (F.sum(F.octet_length(text)) + F.count("*")).cast("long").alias("file_bytes"),
        F.md5(F.sum(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")).alias("fingerprint"),
    )


# --- sampling and hold-outs: all by a hash of the key, so reruns agree -----------------


def unit_hash(key: Column, seed: int) -> Column:
    """A portable number in [0, 1): the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def bernoulli(rows: DataFrame, key: str, p: float, seed: int, sampled: Column | None = None) -> DataFrame:
    """Each row with probability ``p``; rows that are not ``sampled`` all stay."""
    chosen = unit_hash(F.col(key), seed) < p
    return rows.where(chosen if sampled is None else ~sampled | chosen)


def keep_probability(budget: float, kept: float, sampled: float) -> float:
    """What part of the sampled bytes fits the budget beside the kept ones."""
    if kept > budget:
        raise ValueError("the sources that are kept whole exceed the budget")
    return min(1.0, (budget - kept) / sampled) if sampled > 0 else 1.0


def sample_n(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen uniformly by hash (a distributed top-n)."""
    return rows.withColumn("__u", unit_hash(F.col(key), seed)).orderBy("__u", key).limit(n).drop("__u")


def holdout_groups(rows: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """The held-out groups: a fraction of the distinct ones (floor, at least one)."""
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct()
    n = groups.count()
    return sample_n(groups, group, max(1, int(n * fraction)) if n else 0, seed)


def assert_disjoint(left: DataFrame, right: DataFrame, column: str) -> None:
    both = left.select(column).intersect(right.select(column)).limit(5).collect()
    if both:
        raise LeakageError(f"on both sides: {[r[0] for r in both]}")


def holdout_rows(rows: DataFrame, key: str, n: int, seed: int, k: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(held, rest)``: ``n`` rows, and the rows that share no ``k``-letter shingle
    with any of them."""
    held = sample_n(rows, key, n, seed)
    near = shingle_overlaps(rows, shingle_index(held, k, text_col), k, key, text_col).select(key)
    return held, rows.join(held.select(key), key, "left_anti").join(near, key, "left_anti")


def byte_prefix(rows: DataFrame, key: str, budget: int, seed: int, text_col: str = "text") -> DataFrame:
    """Rows in hash order until their bytes (one more per line end) first reach the
    budget.  Hash buckets are summed first, and only the bucket where the budget ends
    is ordered, so no task sorts the corpus."""
    sized = rows.withColumn("__u", unit_hash(F.col(key), seed)).withColumn("__b", F.octet_length(text_col).cast("long") + 1)
    sized = sized.withColumn("__k", F.floor(F.col("__u") * 4096))
    sums = sized.groupBy("__k").agg(F.sum("__b").alias("size"))
    before = F.sum("size").over(Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    marks = sums.select("__k", before.alias("__before"), "size").where(F.col("__before") < budget)  # at most 4096 rows
    joined = sized.join(F.broadcast(marks), "__k")
    whole = joined.where(F.col("__before") + F.col("size") < budget)
    last = joined.where(F.col("__before") + F.col("size") >= budget)
    run = F.sum("__b").over(Window.partitionBy("__k").orderBy("__u", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__b")
    last = last.withColumn("__run", F.col("__before") + run).where(F.col("__run") < budget).drop("__run")
    return whole.unionByName(last).drop("__u", "__b", "__k", "__before", "size")


def char_cap(rows: DataFrame, order: str, cap: int, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Rows in order up to the character cap; the row that reaches it is included."""
    return running_total(rows, by, [order], F.length(text_col), "__run").where(F.col("__run") < cap).drop("__run")


def line_ranges(rows: DataFrame, rank: str, source: str) -> DataFrame:
    """Half-open line ranges of the sources, one after the other by rank."""
    sums = rows.groupBy(rank, source).agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row per source
    return sums.select(source, (stop - F.col("n")).alias("start"), stop.alias("stop"))


def every_nth(rows: DataFrame, pos: str, stride: int) -> DataFrame:
    return rows.where(F.col(pos) % stride == 0)


def aligned(pairs: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Pairs that are non-blank in every language."""
    keep = F.lit(True)
    for language in languages:
        keep = keep & (F.coalesce(strip(F.col(language)), F.lit("")) != "")
    return pairs.where(keep)


def attach_by_index(rows: DataFrame, records: DataFrame, index: str, text: str, record_text: str) -> DataFrame:
    """Records joined to rows by index, with ``problem``: ``missing`` (no record),
    ``extra`` (no row), ``stale`` (the record was made from another text) or null."""
    left, right = rows.withColumn("__l", F.lit(1)), records.withColumn("__r", F.lit(1))
    joined = left.join(right, index, "full_outer")
    problem = F.when(F.col("__r").isNull(), "missing").when(F.col("__l").isNull(), "extra").when(~F.col(text).eqNullSafe(F.col(record_text)), "stale")
    return joined.withColumn("problem", problem).drop("__l", "__r")


# --- the accept pipeline -----------------------------------------------------------


def accept(rows: DataFrame, exclusion: DataFrame, index: DataFrame, k: int, id_col: str, reason: Column, order: Sequence[str], text_col: str = "text") -> DataFrame:
    """Every row with ``drop_reason`` (null: kept): the quality ``reason``, then
    ``hash``, then ``shingle``; duplicates are judged among the survivors alone."""
    # The rules are read once per row, before any join multiplies the plan.
    hashed = rows.withColumn("__hash", sentence_hash(F.col(text_col))).withColumn("__rule", reason)
    near = shingle_overlaps(rows, index, k, id_col, text_col).select(id_col).distinct()
    marked = _judged(hashed, exclusion, near, id_col)
    alive = marked.where("drop_reason is null")
    first = alive.groupBy("__hash").agg(F.min(_place(order)).alias("__first"))
    joined = marked.join(first, "__hash", "left")
    again = F.when(F.col("drop_reason").isNull() & (_place(order) != F.col("__first")), "duplicate")
    return joined.withColumn("drop_reason", F.coalesce("drop_reason", again)).drop("__hash", "__first")


def accept_counts(rows: DataFrame, exclusion: DataFrame, index: DataFrame, k: int, id_col: str, reason: Column, order: Sequence[str], by: str, text_col: str = "text") -> DataFrame:
    """``drop_counts`` of ``accept`` without its rows: one pass reads the texts, and what
    it says of each row is written to ``spark.checkpoint.dir``.  A text's first survivor
    alone is kept, so survivors are counted by aggregates and no text's rows meet.  Of
    rows that ``order`` leaves tied, one is kept."""
    rule = F.col("__rule")
    read = rows.withColumn("__rule", reason).withColumn("__near", filtered_shingles(F.col(text_col), k, shingle_filter(index, k)))
    read = read.withColumn("__hash", F.when(rule.isNull(), sentence_hash(F.col(text_col))))
    read = read.select(*dict.fromkeys([by, id_col, *order]), "__rule", "__hash", "__near")
    path = scratch_path(rows.sparkSession, "accept")
    read.write.parquet(path)
    read = rows.sparkSession.read.schema(read.schema).parquet(path)
    near = read.where(F.size("__near") > 0).select(id_col, F.explode("__near").alias("shingle"))
    near = near.join(index.select("shingle").distinct(), "shingle", "left_semi").select(id_col).distinct()
    passed = _judged(read.where(rule.isNull()), exclusion, near, id_col)
    alive = passed.where("drop_reason is null")
    first = alive.groupBy("__hash").agg(F.min(F.struct(_place(order), by)).alias("__first"))

    def counted(found: DataFrame, name: Column, n: Column = F.count("*")) -> DataFrame:
        return found.groupBy(F.col(by), name.alias("drop_reason")).agg(n.alias("n"))

    duplicate, less = F.lit("duplicate"), -F.count("*")
    kept = first.select(F.col(f"__first.{by}").alias(by))
    parts = [counted(read.where(rule.isNotNull()), rule), counted(passed.where("drop_reason is not null"), F.col("drop_reason"))]
    parts += [counted(kept, F.lit(None).cast("string")), counted(alive, duplicate), counted(kept, duplicate, less)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sums = every.groupBy(by, "drop_reason").agg(F.sum("n").alias("n")).where("n > 0")
    return drop_counts(sums, by, F.sum("n"))


def _judged(rows: DataFrame, exclusion: DataFrame, near: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``drop_reason`` from their ``__rule``, their ``__hash`` and ``near`` ids."""
    marked = rows.join(exclusion.select(F.col("hash").alias("__hash"), F.lit(True).alias("__leak")), "__hash", "left")
    marked = marked.join(near.withColumn("__found", F.lit(True)), id_col, "left")
    why = F.coalesce("__rule", F.when(F.col("__leak"), "hash"), F.when(F.col("__found"), "shingle"))
    return marked.withColumn("drop_reason", why).drop("__leak", "__found", "__rule")


def _place(order: Sequence[str]) -> Column:
    """A row's place in ``order``: a null comes after all values, as in SQL."""
    return F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))


def drop_counts(accepted: DataFrame, by: str, n: Column | None = None) -> DataFrame:
    """Rows per group and reason, with totals over groups and reasons (a rollup)."""
    reason = F.coalesce("drop_reason", F.lit("kept"))
    return accepted.withColumn("reason", reason).rollup(by, "reason").agg((F.count("*") if n is None else n).alias("n"))
