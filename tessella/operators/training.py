"""Tokenizer training on distributed word counts: BPE, boundary-bound BPE, unigram.

The word table (a row per distinct piece) stays distributed and is held packed, many
words a row.  Training is sequential by nature: each merge, each length of seeds and
each round of estimates is one pass over that table, and only the best pair, or counts
of pieces that can still enter the vocabulary, come to the driver.  Where the caller
sets ``max_words``, a corpus with more distinct pieces is refused rather than cut.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters
from .tokenizers import SPACE_MARK, Bpe, pieces


#: Ids of symbols: a character's code point, and from here on merges in their order.
FIRST_MERGE = 0x110000
#: Merges that passes replay before the packed words are made anew.
REPLAYED = 16
#: Cells of best scores in memory at once.
CELLS = 1 << 20


class BoundaryMarkerLeaked(ValueError):
    """The boundary marker became part of a vocabulary."""


@dataclass(frozen=True)
class Trained:
    alphabet: list[str]
    merges: list[tuple[str, str]]

    def encoder(self) -> Bpe:
        return Bpe(self.alphabet, self.merges)

    def table(self, spark) -> DataFrame:
        rows = [(i, a, b) for i, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string")


def piece_counts(lines: DataFrame, text_col: str = "text", marker: str | None = None) -> DataFrame:
    """``piece, c``: pre-tokens of all lines; a boundary marker cuts a piece and goes."""
    found = pieces(F.col(text_col))
    if marker is not None:
        found = F.flatten(F.transform(found, lambda p: F.filter(F.split(p, marker, -1), lambda x: x != "")))
    return lines.select(F.explode(found).alias("piece")).groupBy("piece").agg(F.count("*").alias("c"))


def refuse_more(counts: DataFrame, max_words: int | None) -> None:
    if max_words is not None and counts.limit(max_words + 1).count() > max_words:
        raise ValueError(f"more than {max_words} distinct pieces; train on a sample or raise the bound")


# --- packed words ------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``piece, c`` -> a row per batch: the words' symbols, -1 after each word, and the words' counts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column(0).to_pylist()
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        symbols = np.insert(points, np.cumsum([len(w) for w in words]), -1).astype(np.int32)
        counts = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.record_batch([pa.array([symbols.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["symbols", "counts"])


def packed(counts: DataFrame) -> DataFrame:
    return counts.select("piece", "c").mapInArrow(_pack, "symbols binary, counts binary").persist()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for symbols, counts in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)


def _weights(symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each symbol's word count."""
    ends = np.flatnonzero(symbols < 0)
    return np.repeat(counts, np.diff(ends, prepend=-1))


def _add_up(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, c
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], c[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(c, head)


def summed(words: DataFrame, keyed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``key, c``: the counts that ``keyed`` finds in each row, added up per key in the tasks and then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        for symbols, counts in _unpacked(batches):
            waiting.append(_add_up(*keyed(symbols, counts)))
            n += len(waiting[-1][0])
            if n > 1 << 20:
                held = _add_up(*(np.concatenate(x) for x in zip(held, *waiting)))
                waiting, n = [], 0
        keys, c = _add_up(*(np.concatenate(x) for x in zip(held, *waiting)))
        yield pa.record_batch([pa.array(keys), pa.array(c)], names=["key", "c"])

    return words.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _characters(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = symbols >= 0
    return symbols[inside].astype(np.int64), _weights(symbols, counts)[inside]


def _merged(symbols: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """The symbols with each pair, from the left of its word, made one."""
    at = np.flatnonzero((symbols[:-1] == left) & (symbols[1:] == right))
    if not len(at):
        return symbols
    if left == right:  # of a run of one symbol every second pair
        first = np.append(True, np.diff(at) != 1)
        at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
    out = symbols.copy()
    out[at] = new
    return np.delete(out, at + 1)


def _replayed(symbols: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    for left, right, new in merges:
        symbols = _merged(symbols, left, right, new)
    return symbols


def _pairs(merges: list[tuple[int, int, int]]):
    def keyed(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = _replayed(symbols, merges)
        inside = (symbols[:-1] >= 0) & (symbols[1:] >= 0)
        return symbols[:-1][inside].astype(np.int64) << 32 | symbols[1:][inside], _weights(symbols, counts)[:-1][inside]

    return keyed


def _repacked(merges: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, counts in _unpacked(batches):
            yield pa.record_batch([pa.array([_replayed(symbols, merges).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["symbols", "counts"])

    return run


def distributed_merges(counts: DataFrame, vocab_size: int, specials: int = 1) -> Trained:
    """What ``merge_loop`` gives, with words and pair counts left in the tasks: a pass per merge."""
    words = packed(counts)
    names = {r["key"]: chr(r["key"]) for r in summed(words, _characters).collect()}
    alphabet = sorted(names.values())
    merges: list[tuple[str, str]] = []
    waiting: list[tuple[int, int, int]] = []
    while len(names) + specials < vocab_size:
        # ties go to the smaller pair of ids
        best = summed(words, _pairs(waiting)).agg(F.max(F.struct("c", (-F.col("key")).alias("back")))).first()[0]
        if best is None:
            break
        left, right, new = -best["back"] >> 32, -best["back"] & 0xFFFFFFFF, FIRST_MERGE + len(merges)
        merges.append((names[left], names[right]))
        names[new] = names[left] + names[right]
        waiting = [*waiting, (left, right, new)]
        if len(waiting) == REPLAYED:
            last, words = words, words.mapInArrow(_repacked(waiting), "symbols binary, counts binary").persist()
            words.count()
            last.unpersist()
            waiting = []
    words.unpersist()
    return Trained(alphabet, merges)


def merge_loop(counts: dict[str, int], vocab_size: int, specials: int = 1) -> Trained:
    """Merges by highest pair count, ties to the smaller pair of ids, with the pair
    counts kept up to date word by word: for word tables that one process holds."""
    alphabet = sorted({c for w in counts for c in w})
    ids = {c: i for i, c in enumerate(alphabet)}
    names = list(alphabet)
    held = [([ids[c] for c in w], n) for w, n in sorted(counts.items())]
    pair_counts: Counter = Counter()
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, (symbols, n) in enumerate(held):
        for pair in zip(symbols, symbols[1:]):
            pair_counts[pair] += n
            where[pair].add(i)
    merges: list[tuple[str, str]] = []
    while len(names) + specials < vocab_size and pair_counts:
        pair, count = max(pair_counts.items(), key=lambda x: (x[1], (-x[0][0], -x[0][1])))
        if count <= 0:
            break
        new = len(names)
        merges.append((names[pair[0]], names[pair[1]]))
        names.append(names[pair[0]] + names[pair[1]])
        for i in where.pop(pair):
            symbols, n = held[i]
            for old in zip(symbols, symbols[1:]):
                pair_counts[old] -= n
            out, j = [], 0
            while j < len(symbols):
                if j + 1 < len(symbols) and (symbols[j], symbols[j + 1]) == pair:
                    out.append(new)
                    j += 2
                else:
                    out.append(symbols[j])
                    j += 1
            symbols[:] = out
            for made in zip(symbols, symbols[1:]):
                pair_counts[made] += n
                where[made].add(i)
        pair_counts = Counter({p: c for p, c in pair_counts.items() if c > 0})
    return Trained(alphabet, merges)


def train_bpe(lines: DataFrame, vocab_size: int, text_col: str = "text", marker: str | None = None, max_words: int | None = None) -> Trained:
    counts = piece_counts(lines, text_col, marker)
    refuse_more(counts, max_words)
    trained = distributed_merges(counts, vocab_size)
    if marker is not None and any(marker in s for s in [*trained.alphabet, *(a + b for a, b in trained.merges)]):
        raise BoundaryMarkerLeaked("the boundary marker is part of the vocabulary")
    return trained


def pair_counts(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """One step of training as a query: ``left, right, c`` over all neighbours."""
    counts = piece_counts(lines, text_col)
    chars = characters(F.col("piece"))
    n = F.length("piece")
    pairs = F.transform(F.arrays_zip(F.slice(chars, F.lit(1), n - 1).alias("left"), F.slice(chars, F.lit(2), n - 1).alias("right")), lambda x: x)
    rows = counts.where(n > 1).select("c", F.explode(pairs).alias("p"))
    return rows.groupBy("p.left", "p.right").agg(F.sum("c").alias("c"))


# --- unigram -----------------------------------------------------------------------


class Unigram:
    """A unigram model: the best segmentation of each pre-token by Viterbi."""

    def __init__(self, logs: dict[str, float], unknown: float = -20.0):
        self.logs, self.unknown = logs, unknown
        self.longest = max(map(len, logs), default=1)
        self.vocab = {p: i + 1 for i, p in enumerate(sorted(logs))}

    def segment(self, piece: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            options = []
            for start in range(max(0, end - self.longest), end):
                part = piece[start:end]
                log = self.logs.get(part, self.unknown if end - start == 1 else None)
                if log is not None:
                    options.append((best[start][0] + log, start))
            best.append(max(options))
        out, end = [], len(piece)
        while end:
            start = best[end][1]
            out.append(piece[start:end])
            end = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [self.vocab.get(s, 0) for piece in Bpe([], []).split(text) for s in self.segment(piece)]


def _placed(symbols: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
    """Per length the place in ``levels`` of the piece that begins at each symbol, or -1.  A level's keys are
    the places, one level down, of a piece without its last and without its first character."""
    out, keys = [], symbols.astype(np.int64)
    for level in levels:
        spot = np.minimum(np.searchsorted(level, keys), max(len(level) - 1, 0))
        place = np.where((keys >= 0) & (level[spot] == keys), spot, -1) if len(level) else np.full(len(keys), -1)
        out.append(place)
        after = np.append(place[1:], -1)
        keys = np.where((place >= 0) & (after >= 0), place << 32 | after, -1)
    return out


def _longer(levels: list[np.ndarray]):
    """Counts of the pieces one character longer than the last level's."""

    def keyed(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = _placed(symbols, levels)[-1]
        inside = (place[:-1] >= 0) & (place[1:] >= 0)
        return place[:-1][inside] << 32 | place[1:][inside], _weights(symbols, counts)[:-1][inside]

    return keyed


def seed_pieces(words: DataFrame, most: int, longest: int) -> tuple[list[np.ndarray], list[list[str]], dict[str, int]]:
    """Levels of pieces by length, their names, and the seeds' counts: all characters and the ``most`` longer
    pieces of highest count times length, ties to the smaller piece.

    A piece is at most as frequent as its parts, so one is only counted where its parts are frequent enough
    for a piece of the greatest length to be a seed: an exact bound, not a cap."""
    rows = sorted((r["key"], r["c"]) for r in summed(words, _characters).collect())
    single = {chr(k): c for k, c in rows}
    levels, names = [np.array([k for k, _ in rows], np.int64)], [list(single)]
    rest: list[tuple[int, str, int]] = []
    for length in range(2, longest + 1):
        least = max(2, -(-rest[-1][0] // longest)) if len(rest) == most else 2
        rows = sorted((r["key"], r["c"]) for r in summed(words, _longer(levels)).where(F.col("c") >= least).collect())
        below = names[-1]
        names.append([below[k >> 32] + below[k & 0xFFFFFFFF][-1] for k, _ in rows])
        levels.append(np.array([k for k, _ in rows], np.int64))
        rest = sorted([*rest, *((c * length, p, c) for p, (_, c) in zip(names[-1], rows))], key=lambda x: (-x[0], x[1]))[:most]
        if not rows:
            break
    return levels, names, {**single, **{p: c for _, p, c in rest}}


def _segmented(levels: list[np.ndarray], logs: list[np.ndarray]):
    """Counts of the pieces in all words' best segmentations (as ``Unigram.segment``), keyed by length and place."""

    def keyed(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = _placed(symbols, levels)
        scores = [np.where(place >= 0, log[place], -np.inf) if len(log) else np.full(len(place), -np.inf) for place, log in zip(places, logs)]
        ends = np.flatnonzero(symbols < 0)
        begins = np.append(0, ends[:-1] + 1)
        order = np.argsort(begins - ends, kind="stable")  # longest words first
        keys, found = [], []
        i = 0
        while i < len(order):
            top = int(ends[order[i]] - begins[order[i]])
            rows = order[i : i + max(1, CELLS // (top + 1))]
            i += len(rows)
            begin, size = begins[rows], ends[rows] - begins[rows]
            best = np.zeros((top + 1, len(rows)))
            back = np.zeros((top + 1, len(rows)), np.int16)
            for end in range(1, top + 1):
                m = int(np.searchsorted(-size, -end, side="right"))  # words that long
                best[end, :m] = -np.inf
                for n in range(min(end, len(levels)), 0, -1):
                    score = best[end - n, :m] + scores[n - 1][begin[:m] + end - n]
                    better = (score >= best[end, :m]) & (score > -np.inf)
                    best[end, :m][better] = score[better]
                    back[end, :m][better] = n
            at, row = size.copy(), np.arange(len(rows))
            while len(row := row[at[row] > 0]):
                n = back[at[row], row].astype(np.int64)
                at[row] -= n
                spot = begin[row] + at[row]
                for length in np.unique(n):
                    mine = n == length
                    keys.append(length << 32 | places[length - 1][spot[mine]])
                    found.append(counts[rows[row[mine]]])
        none = [np.empty(0, np.int64)]
        return np.concatenate(keys or none), np.concatenate(found or none)

    return keyed


def train_unigram(lines: DataFrame, vocab_size: int, text_col: str = "text", rounds: int = 4, longest: int = 8, max_words: int | None = None) -> Unigram:
    """Hard-EM unigram training: seed pieces by frequency times length, then alternate
    best segmentations and re-estimates, dropping the least used pieces.  Fixed order
    throughout, so reruns agree."""
    counts = piece_counts(lines, text_col)
    refuse_more(counts, max_words)
    # Each task gives each piece it meets once a pass: fewer tasks, though not fewer than cores, give fewer rows.
    spark = lines.sparkSession
    few = max(spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    words = packed(counts.coalesce(few))
    levels, names, weight = seed_pieces(words, vocab_size * 4, longest)
    single = names[0]
    for r in range(rounds):
        total = sum(weight.values()) or 1
        model = Unigram({p: float(np.log(n / total)) for p, n in weight.items() if n > 0})
        logs = [np.array([model.logs.get(p, -np.inf) for p in level]) for level in names]
        used: Counter = Counter(dict.fromkeys(single, 1))
        for row in summed(words, _segmented(levels, logs)).collect():
            used[names[(row["key"] >> 32) - 1][row["key"] & 0xFFFFFFFF]] += row["c"]
        size = max(vocab_size - 1, len(single)) if r == rounds - 1 else max(vocab_size - 1, len(used) * 3 // 4)
        order = sorted(used, key=lambda p: (len(p) > 1, -used[p], p))
        weight = {p: used[p] for p in order[:size]}
    words.unpersist()
    total = sum(weight.values()) or 1
    return Unigram({p: float(np.log(n / total)) for p, n in weight.items()})


def marked_words(words: Sequence[str]) -> str:
    return " ".join(words).replace(" ", SPACE_MARK)


TRAINERS = {"bpe": train_bpe, "unigram": train_unigram}


def train_arm(algorithm: str, lines: DataFrame, vocab_size: int, **options):
    """One arm by its algorithm's name."""
    if algorithm not in TRAINERS:
        raise ValueError(f"no algorithm {algorithm!r}; there are {', '.join(sorted(TRAINERS))}")
    return TRAINERS[algorithm](lines, vocab_size, **options)
