"""Ordered quality rules on lines: the first rule that fails names the drop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.points import any_in, before, classes, code_points, runs, slices
from ..functions.text import WHITE

#: Letters of the SLP1 transliteration and what may stand beside them (fixed values).
SLP1_LETTERS = "aAiIuUfFxXeEoOMHkKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL"
ASCII_REST = r"0-9!-/:-@\[-`{-~ "

#: Function words of Hindi (fixed values).
HINDI_MARKERS = ("का", "के", "की", "है", "हैं", "में", "से", "को", "और", "पर", "ने", "था", "थी", "थे", "हो")


@dataclass(frozen=True)
class Rules:
    """Thresholds; the defaults are those for lines transliterated to SLP1."""

    letters: str = SLP1_LETTERS
    clean: str = SLP1_LETTERS + ASCII_REST
    markers: tuple[str, ...] = HINDI_MARKERS
    least_markers: int = 2
    letter_share: float = 0.85
    least_words: int = 3
    most_words: int = 40
    least_length: float = 3.0
    most_length: float = 14.0
    names: tuple[str, ...] = field(default=("latin", "hindi", "letter_fraction", "n_words", "word_length", "non_slp1"))


#: Classes that the rules read besides their own two: bits 0 to 3, then the own ones.
CLASSES = (WHITE, r"\p{L}", r"A-Za-z", r"!-/:-@\[-`{-~\x{9}-\x{D}\x{20}")
SPACE, LETTER, LATIN, TAIL, OWN, CLEAN = (1 << i for i in range(6))
PASSED = 6  # beside the six rules' places


def drop_reason(source: Column, text: Column, rules: Rules = Rules(), latin: bool = True) -> Column:
    """The name of the first rule that a line fails, or null.

    ``source`` is the line as written, ``text`` what the later rules read (the
    transliteration).  The rules are read off vectors of code points, for all lines of
    an Arrow batch at once and each line's characters once, whatever rule it fails.
    """
    table = classes(*CLASSES, rules.letters, rules.clean)
    names = pa.array([*rules.names, None], pa.string())

    def written(points: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.where(_marker_counts(points, marks, bounds, rules.markers) >= rules.least_markers, 1, PASSED)
        return np.where(any_in(marks & LATIN != 0, bounds), 0, out) if latin else out

    def read(points: np.ndarray, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n, letters = _real_word_sizes(marks, bounds)
        mean = letters / np.maximum(n, 1)
        out = np.where(any_in(marks & CLEAN == 0, bounds), 5, PASSED)
        out = np.where((mean >= rules.least_length) & (mean <= rules.most_length), out, 4)
        out = np.where((n >= rules.least_words) & (n <= rules.most_words), out, 3)
        return np.where(_letter_shares(marks, bounds) < rules.letter_share, 2, out)

    @F.arrow_udf("string")
    def reason(sources: pa.Array, texts: pa.Array) -> pa.Array:
        if sources.equals(texts):
            failed = _failed(texts, table, lambda *line: np.minimum(written(*line), read(*line)))
        else:
            failed = np.minimum(_failed(sources, table, written), _failed(texts, table, read))
        return names.take(pa.array(failed))

    return reason(source, text)


def _failed(texts: pa.Array, table: np.ndarray, ask: Callable[..., np.ndarray]) -> np.ndarray:
    """For each text the place of the first rule that it fails; none for a null."""
    out = np.empty(len(texts), np.int8)
    for first, part in slices(texts):
        points, bounds = code_points(part)
        out[first : first + len(part)] = ask(points, table[points], bounds)
    if texts.null_count:
        out[texts.is_null().to_numpy(zero_copy_only=False)] = PASSED
    return out


def _marker_counts(points: np.ndarray, marks: np.ndarray, bounds: np.ndarray, markers: tuple[str, ...]) -> np.ndarray:
    """How many different marker words each line has as words."""
    starts, stops = runs(marks & SPACE == 0, bounds)
    sizes, counts = stops - starts, np.zeros(len(bounds) - 1, np.int64)
    for size in {len(m) for m in markers}:
        at = starts[sizes == size]
        letters = [points[at + i] for i in range(size)]
        for marker in {m for m in markers if len(m) == size}:
            same = np.ones(len(at), bool)
            for have, want in zip(letters, marker):
                same &= have == ord(want)
            counts += np.diff(np.searchsorted(at[same], bounds)) > 0
    return counts


def _letter_shares(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``letter_fraction`` of each line."""
    hard = np.concatenate([[-1], np.flatnonzero(marks & TAIL == 0)])
    ends = np.maximum(hard[np.searchsorted(hard, bounds[1:]) - 1] + 1, bounds[:-1])
    solid = marks & SPACE == 0
    considered, kept = (c[ends] - c[bounds[:-1]] for c in (before(solid), before(solid & (marks & OWN != 0))))
    return np.where(considered == 0, 0.0, kept / np.maximum(considered, 1))


def _real_word_sizes(marks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each line hold a letter, and their characters together."""
    starts, stops = runs(marks & SPACE == 0, bounds)
    letters = before(marks & LETTER != 0)
    real = letters[stops] > letters[starts]
    edges = np.searchsorted(starts, bounds)
    return np.diff(before(real)[edges]), np.diff(before(np.where(real, stops - starts, 0))[edges])
