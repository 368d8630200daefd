r"""LM scoring: marginal likelihood over a subword lattice (operator 6).

The pieces of an existing tokenizer vocabulary (its file is a parameter) weight all
segmentations of each word.  A text is its words ``[^\x20\x09-\x0D]+`` (A-Z
lower-cased), each led by one space, then one end.  A word's probability is the sum
over all its segmentations into pieces of the product of the pieces' probabilities,
by a forward recursion in log space; the text's is the product over its words and
the end.  Every single byte is a piece as well, so no text is impossible.

The vocabulary's own scores (merge ranks) give the pieces' prior: ``PRIOR`` expected
counts a piece on average, shared out by those scores.  Expected counts over all
training words, by forward-backward, are added to it.  The vocabulary itself is never
changed.  A word known from training is one more path through its lattice: with N words
and V different ones in training, the whole-word path has weight N / (N + V) and the
pieces' paths share the rest, V / (N + V), the chance that the next word is a new one.
The driver holds one number per piece; word counts, which grow with the corpus, stay
distributed.

Each word's count meets the documents in two ways: the most frequent words, at most
``HEAD`` of them, go to every task; the rest join by the word's hash, one row
per document and word, summed before the shuffle.

Defined cases: a null text is the empty text (one end); a null id is held out or
not by the empty string's crc32, and stays null; repeated ids are scored by row;
with no training documents every count is zero; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import by_batch, written

U64 = np.uint64
HEAD = 200_000
PASSES = 3
#: Prior counts a piece, on average.
PRIOR = 0.1
LONG_WORD = 512  # bytes; longer words are scored one at a time
CACHE = 1 << 21
SLOT_BITS = 20
#: Bytes of text whose new words go through the lattice together.
SLICE = 1 << 20
NONE = -np.inf
_MARK = 0x20  # the byte that leads a word


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Byte strings and scores of a sentencepiece vocabulary's ordinary pieces, then
    the 256 single bytes.  The word mark becomes a space; pieces with a space
    elsewhere than at their head cannot occur in a word and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            scores[piece] = max(scores.get(piece, NONE), model.get_score(i))
    for b in range(256):
        scores.setdefault(bytes([b]), min(scores.values(), default=0.0) if scores else 0.0)
    names = sorted(scores)
    return names, np.array([scores[x] for x in names])


def start_logs(scores: np.ndarray) -> np.ndarray:
    """Log probabilities from merge ranks: the usual 1/rank law."""
    order = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    logs = -np.log(order + 10.0)
    return logs - np.logaddexp.reduce(logs)


class Lattice:
    """Pieces in a hash table over byte ranges; forward and backward over words."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.logs = logs
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        self.lengths = sorted(set(size.tolist()))
        self.up = W.power_table(W.BASE, len(data) + 1)
        self.down = W.power_table(W.INVERSE, len(data) + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * self.up[: len(data)])])
        keys = self._mixed((sums[start + size] - sums[start]) * self.down[start], size)
        order = np.argsort(keys)
        self.sorted, self.ids = keys[order], order
        # One byte per slot says whether any piece may have the key: most have not.
        self.maybe = np.zeros(1 << SLOT_BITS, bool)
        self.maybe[(keys >> U64(64 - SLOT_BITS)).astype(np.intp)] = True

    @staticmethod
    def _mixed(raw: np.ndarray, length) -> np.ndarray:
        """A byte range's key: its hash spread over the upper bits, told apart by length."""
        return (raw + np.asarray(length).astype(U64) * U64(0x632BE59BD9B4E019)) * U64(0xD6E8FEB86659FD93)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that are pieces, and the pieces."""
        at = np.flatnonzero(self.maybe[(keys >> U64(64 - SLOT_BITS)).astype(np.intp)])
        held = keys[at]
        spot = np.minimum(np.searchsorted(self.sorted, held), len(self.sorted) - 1)
        same = self.sorted[spot] == held
        return at[same], self.ids[spot[same]]

    def edges(self, text: np.ndarray):
        """For words of one length (rows of bytes): ``(start, length, rows, pieces)``
        in the order of their starts."""
        n, size = text.shape
        # positions by rows: a range's sums of all words lie side by side
        sums = np.zeros((size + 1, n), U64)
        np.cumsum((text.T.astype(U64) + U64(1)) * self.up[:size, None], axis=0, out=sums[1:])
        for start in range(size):
            for length in self.lengths:
                if start + length > size:
                    break
                rows, piece = self.find(self._mixed((sums[start + length] - sums[start]) * self.down[start], length))
                if len(rows):
                    yield start, length, rows, piece

    def forward(self, text: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word."""
        n, size = text.shape
        alpha = np.full((size + 1, n), NONE)
        alpha[0] = 0.0
        for start, length, rows, piece in self.edges(text):
            end = alpha[start + length]
            end[rows] = np.logaddexp(end[rows], alpha[start][rows] + self.logs[piece])
        return alpha[size]

    def expected(self, text: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected count in the words, ``weight`` times, to ``into``."""
        n, size = text.shape
        alpha = np.full((size + 1, n), NONE)
        beta = np.full((size + 1, n), NONE)
        alpha[0], beta[size] = 0.0, 0.0
        found = []
        for start, length, rows, piece in self.edges(text):
            log = self.logs[piece]
            end = alpha[start + length]
            end[rows] = np.logaddexp(end[rows], alpha[start][rows] + log)
            found.append((start, length, rows, piece, log))
        whole = alpha[size]
        for start, length, rows, piece, log in reversed(found):
            through = log + beta[start + length][rows]
            here = beta[start]
            here[rows] = np.logaddexp(here[rows], through)
            # the part of the word's probability that passes over this edge
            share = np.exp(alpha[start][rows] + through - whole[rows])
            np.add.at(into, piece, share * weight[rows])

    def _stretch(self, word: np.ndarray, lo: int, hi: int) -> list[list[tuple[int, int]]]:
        """``(length, piece)`` of each piece that starts at lo..hi-1 of a long word."""
        text = word[lo : hi + self.lengths[-1]]
        sums = np.zeros(len(text) + 1, U64)
        up, down = W.power_table(W.BASE, len(text) + 1), W.power_table(W.INVERSE, len(text) + 1)
        np.cumsum((text.astype(U64) + U64(1)) * up[: len(text)], out=sums[1:])
        out: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo)]
        for length in self.lengths:
            starts = np.arange(min(hi - lo, len(text) - length + 1))
            if not len(starts):
                break
            at, piece = self.find(self._mixed((sums[starts + length] - sums[starts]) * down[starts], length))
            for i, p in zip(at.tolist(), piece.tolist()):
                out[i].append((length, p))
        return out

    def long_word(self, word: np.ndarray, weight: float = 0.0, into: np.ndarray | None = None) -> float:
        """``forward`` (and ``expected``) for one very long word, block by block."""
        size, block = len(word), 1 << 14
        alpha = np.full(size + 1, NONE)
        alpha[0] = 0.0
        for lo in range(0, size, block):
            for i, found in enumerate(self._stretch(word, lo, min(size, lo + block))):
                for length, piece in found:
                    end = lo + i + length
                    alpha[end] = np.logaddexp(alpha[end], alpha[lo + i] + self.logs[piece])
        whole = alpha[size]
        if into is not None:
            beta = np.full(size + 1, NONE)
            beta[size] = 0.0
            for lo in reversed(range(0, size, block)):
                stretch = self._stretch(word, lo, min(size, lo + block))
                for i in reversed(range(len(stretch))):
                    for length, piece in stretch[i]:
                        through = self.logs[piece] + beta[lo + i + length]
                        beta[lo + i] = np.logaddexp(beta[lo + i], through)
                        into[piece] += weight * np.exp(alpha[lo + i] + through - whole)
        return float(whole)


def _by_length(start: np.ndarray, end: np.ndarray, data: np.ndarray):
    """Words of each byte length, led by the mark: ``(indices, rows of bytes)``."""
    size = end - start
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order], prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(order))):
        length = int(size[order[lo]])
        step = max(1, (1 << 21) // (length + 1))
        for s in range(lo, hi, step):
            at = order[s : min(hi, s + step)]
            text = np.empty((len(at), length + 1), np.uint8)
            text[:, 0] = _MARK
            text[:, 1:] = data[start[at][:, None] + np.arange(length)]
            yield at, text


def _count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch's distinct words and counts."""
    data, offsets = W.text_buffers(batch.column(0))
    data = W.LOWER[data]
    seen, counts, start, end = [], [], [], []
    for a, z in W.slices(offsets):
        words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        hashes, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        seen.append(hashes)
        counts.append(n)
        start.append(words.start[at] + offsets[a])
        end.append(words.end[at] + offsets[a])
    if not seen:
        return pa.record_batch([pa.array([], pa.binary()), pa.array([], pa.int64())], names=["word", "c"])
    hashes, at, group = np.unique(np.concatenate(seen), return_index=True, return_inverse=True)
    total = np.bincount(group, weights=np.concatenate(counts), minlength=len(hashes)).astype(np.int64)
    start, end = np.concatenate(start)[at], np.concatenate(end)[at]
    size = end - start
    stop = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(start - stop[:-1], size) + np.arange(stop[-1])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(stop.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
    return pa.record_batch([words, pa.array(total)], names=["word", "c"])


def _word_arrays(column: pa.Array):
    data, offsets = W.text_buffers(column)
    return data, offsets[:-1], offsets[1:]


def _with_hash(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, start, end = _word_arrays(batch.column(0))
    words = W.Words.__new__(W.Words)
    out = np.empty(len(start), U64)
    offsets = np.append(start, len(data))
    for a, z in W.slices(offsets):
        words.data, words.start, words.end = data[offsets[a] : offsets[z]], start[a:z] - offsets[a], end[a:z] - offsets[a]
        out[a:z] = words.hashes()
    return pa.record_batch([pa.array(out.view(np.int64)), batch.column(0), batch.column(1)], names=["h", "word", "c"])


def _expect(pieces: list[bytes], logs: np.ndarray):
    def run(batches):
        lattice = Lattice(pieces, logs)
        total = np.zeros(len(pieces))
        for batch in batches:
            data, start, end = _word_arrays(batch.column(0))
            weight = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            short = np.flatnonzero(end - start < LONG_WORD)
            for at, text in _by_length(start[short], end[short], data):
                lattice.expected(text, weight[short][at], total)
            for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
                lattice.long_word(np.append(np.uint8(_MARK), data[start[i] : end[i]]), weight[i], total)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "e"])

    return run


def fit(counts: DataFrame, pieces: list[bytes], scores: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Log probabilities of the pieces from all training words (``word``, ``c``)."""
    logs = start_logs(scores)
    prior = PRIOR * len(pieces) * np.exp(logs)
    for _ in range(passes):
        rows = counts.select("word", "c").mapInArrow(_expect(pieces, logs), "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        expected = prior.copy()
        for row in rows:
            expected[row["piece"]] += row["e"]
        logs = np.log(expected / expected.sum())
    return logs


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the upper count classes that together hold at most ``most`` words.
    Counts fall into some 2,000 classes at most, and no task gathers candidates."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 32)
    sizes = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"])
    held, least = 0, None
    for row in sizes:
        held += row["n"]
        if held > most:
            break
        least = row["level"]
    return counts.where(F.lit(False) if least is None else level >= least)


def known_log(whole: float, count, n_words: int, log):
    """Log probability of words with ``count`` in training and the lattice's ``log``."""
    return np.logaddexp(math.log(whole) + np.log(count / n_words), math.log1p(-whole) + log)


def _head_scores(pieces: list[bytes], logs: np.ndarray):
    """Words -> the log of their summed segmentations into pieces."""

    def run(batches):
        lattice = Lattice(pieces, logs)
        for batch in batches:
            data, start, end = _word_arrays(batch.column(1))
            out = np.empty(len(start))
            short = np.flatnonzero(end - start < LONG_WORD)
            for at, text in _by_length(start[short], end[short], data):
                out[short[at]] = lattice.forward(text)
            for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
                out[i] = lattice.long_word(np.append(np.uint8(_MARK), data[start[i] : end[i]]))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out)], names=["h", "c", "log"])

    return run


def _score(pieces: list[bytes], logs: np.ndarray, model: dict, keys: np.ndarray, known: np.ndarray, scores: np.ndarray):
    """Documents -> a row each with what its ``HEAD`` words and its end add to score
    and base; other words follow, a row per document and word with the lattice's ``log``,
    for the join.  ``keys``: the head's hashes in order, with ``known`` (base) and
    ``scores``."""

    def word_scores(lattice: Lattice, words: W.Words, at: np.ndarray) -> np.ndarray:
        start, end = words.start[at], words.end[at]
        out = np.empty(len(at))
        short = np.flatnonzero(end - start < LONG_WORD)
        for i, text in _by_length(start[short], end[short], words.data):
            out[short[i]] = lattice.forward(text)
        for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
            out[i] = lattice.long_word(np.append(np.uint8(_MARK), words.data[start[i] : end[i]]))
        return out

    def run(batches):
        lattice = Lattice(pieces, logs)
        cache_key, cache = np.zeros(CACHE, U64), np.zeros(CACHE)
        bucket = np.searchsorted(keys >> U64(64 - SLOT_BITS), np.arange((1 << SLOT_BITS) + 1, dtype=U64))
        deep = int(np.diff(bucket).max(initial=0))
        names = ["out_id", "part", "h", "n", "n_known", "base", "score", "held_out", "log"]
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(2))
            data = W.LOWER[data]
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for a, z in W.slices(offsets, SLICE):
                words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                rows, h, row = z - a, words.hashes(), words.row_of()
                place = (h >> U64(64 - SLOT_BITS)).astype(np.intp)
                spot = bucket[place]
                # a bucket of the head's table holds a word or two: look at them in turn
                in_head = np.zeros(len(h), bool)
                for step in range(deep):
                    there = np.minimum(bucket[place] + step, max(len(keys) - 1, 0))
                    same = (keys[there] == h) if len(keys) else in_head
                    spot[same] = there[same]
                    in_head |= same
                value = np.empty(len(h))
                value[in_head] = scores[spot[in_head]]
                rest = np.flatnonzero(~in_head)
                slot = (h[rest] & U64(CACHE - 1)).astype(np.intp)
                value[rest] = cache[slot]
                miss = rest[cache_key[slot] != h[rest]]
                if len(miss):
                    new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
                    logp = word_scores(lattice, words, miss[at])
                    value[miss] = logp[back]
                    where = (new & U64(CACHE - 1)).astype(np.intp)
                    # of several new words in one slot the last stays, key and value alike
                    cache_key[where] = new
                    kept = cache_key[where] == new
                    cache[where[kept]] = logp[kept]
                score = np.bincount(row[in_head], weights=value[in_head] + model["word_log"], minlength=rows) / math.log(10) + model["end_log10"]
                base = np.bincount(row[in_head], weights=known[spot[in_head]], minlength=rows) if len(keys) else np.zeros(rows)
                ids, own, held = (batch.column(i).slice(a, rows) for i in (0, 1, 3))
                spread = W.mix(part[a:z].view(U64) + np.arange(a, z).astype(U64))
                columns = [
                    ids,
                    own,
                    pa.array(spread.view(np.int64)),
                    pa.array(np.diff(words.first) + 1),
                    pa.array(np.bincount(row[in_head], minlength=rows) + model["end_known"]),
                    pa.array(base + model["end_base"]),
                    pa.array(score),
                    held,
                    pa.nulls(rows, pa.float64()),
                ]
                yield pa.record_batch(columns, names=names)
                if len(rest):
                    order = rest[np.lexsort((h[rest], row[rest]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                    first = np.flatnonzero(new)
                    m = len(first)
                    where = pa.array(row[order[first]])
                    n = np.diff(np.append(first, len(order)))
                    columns = [ids.take(where), own.take(where), pa.array(h[order[first]].view(np.int64)), pa.array(n)]
                    yield pa.record_batch([*columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.bool_()), pa.array(value[order[first]])], names=names)

    return run


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """A row per document: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score`` (log10 probabilities).

    Documents whose crc32 of the id's text leaves ``held`` modulo ``folds`` are held
    out of all counts."""
    pieces, scores = load_pieces(vocabulary)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    base = docs.select(F.col(id_col).alias("out_id"), (fold == held).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = base.where(~F.col("held_out"))
    counts = train.select("text").mapInArrow(by_batch(_count_words), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = written(counts.mapInArrow(by_batch(_with_hash), "h long, word binary, c long"), "counts")
    n_train = train.count()
    sums = counts.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    n_words = sums["c"] or 0
    tokens, types = n_words + n_train, sums["v"] + (1 if n_train else 0)
    shift = math.log10(tokens + types + 1)
    logs = fit(counts, pieces, scores)
    top = most_frequent(counts, HEAD).select("h", "word", "c").mapInArrow(_head_scores(pieces, logs), "h long, c long, log double").toPandas()
    keys = top["h"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    model = {
        # what comes next in a text: another word, or its end
        "word_log": math.log((n_words + 1) / (tokens + 2)),
        "end_log10": math.log10((n_train + 1) / (tokens + 2)),
        "end_base": math.log10(n_train + 1) - shift,
        "end_known": int(n_train > 0),
    }
    known = np.log10(top["c"].to_numpy(float)[order] + 1) - shift
    # The whole-word path's weight: all but the chance that a word is a new one.
    types_of_words = sums["v"]
    whole = n_words / (n_words + types_of_words) if n_words else 0.0
    head = known_log(whole, top["c"].to_numpy(float)[order], n_words, top["log"].to_numpy(float)[order]) if n_words else np.empty(0)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = base.select("out_id", F.xxhash64("text").alias("part"), "text", "held_out").mapInArrow(
        _score(pieces, logs, model, keys[order], known, head), f"out_id {kind}, part long, h long, n long, n_known long, base double, score double, held_out boolean, log double"
    )
    joined = rows.join(counts.select("h", "c"), "h", "left")
    own = F.col("score").isNotNull()
    word_base = F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(shift))
    # A new word has the pieces' paths alone; a known one's whole-word path is far the heavier.
    new_word = F.col("log") + F.lit(math.log1p(-whole))
    old_word = F.log(F.lit(whole / max(1, n_words)) * F.col("c") + F.exp(new_word))
    word_score = F.col("n") * (F.when(F.col("c").isNull(), new_word).otherwise(old_word) + F.lit(model["word_log"])) / F.lit(math.log(10))
    parts = joined.groupBy("out_id", "part").agg(
        F.count("score").alias("rows"),
        F.first("held_out", ignorenulls=True).alias("held_out"),
        F.sum(F.when(own, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).otherwise(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own, F.col("base")).otherwise(word_base)).alias("base"),
        F.sum(F.when(own, F.col("score")).otherwise(word_score)).alias("score"),
    )
    # Rows with one id and one text were summed: each gets its share back.
    return parts.select(
        F.col("out_id").alias(id_col),
        "held_out",
        F.expr("n_tokens div rows").alias("n_tokens"),
        F.expr("n_known div rows").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy"),
    ).drop("copy")
