"""Tokenizer arms: token counts, ids and character spans as columns.

Byte, character and word arms are native expressions.  BPE arms come in two forms
with the same result: a native replay of a short merge list (nested ``replace``), and
an Arrow-batched UDF for long ones.  Adapters for tokenizer libraries load their file
once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_SPACE, characters, word_count


class TokenizerUnavailable(RuntimeError):
    """An arm whose file or library is not there."""


@dataclass(frozen=True)
class Arm:
    name: str
    family: str
    variant: str
    count: Callable[[Column], Column]
    ids: Callable[[Column], Column] | None = None
    spans: Callable[[Column], Column] | None = None
    vocab_size: int | None = None
    places: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None


# --- native arms -------------------------------------------------------------------


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as numbers, in one Arrow pass."""

    @F.pandas_udf("array<int>")
    def numbers(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.frombuffer(t.encode(), np.uint8).astype(np.int32), na_action="ignore")

    return numbers(text)


def char_ids(text: Column) -> Column:
    return F.transform(characters(text), lambda c: F.conv(F.hex(F.encode(c, "UTF-32BE")), 16, 10).cast("int"))


def char_spans(text: Column) -> Column:
    """One span per character that is not white space."""
    at = F.transform(characters(text), lambda c, i: F.struct(i.cast("int").alias("start"), (i + 1).cast("int").alias("end"), c.alias("c")))
    return F.transform(F.filter(at, lambda s: s["c"].rlike(NOT_SPACE)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _struct_spans(rows: Column) -> Column:
    return F.transform(rows, lambda s: F.struct(s[0].alias("start"), s[1].alias("end")))


def word_spans(text: Column) -> Column:
    """One span per word (a regular expression's places, which SQL does not give)."""

    @F.pandas_udf("array<array<int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [[m.start(), m.end()] for m in re.finditer(r"[^\s\x1c-\x1f]+", t)], na_action="ignore")

    return _struct_spans(find(text))


def char_places(space: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``char_spans`` of texts laid one after the other (``edges``: where each begins,
    and the end): starts and ends in the whole."""
    at = np.flatnonzero(~space)
    return at, at + 1


def word_places(space: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_spans`` of texts laid one after the other, as ``char_places``."""
    inside, cut = ~space, np.zeros(len(space) + 1, bool)
    cut[edges] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1] | cut[1:-1]
    last[:-1] &= space[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


BYTE = Arm("byte", "byte", "original", lambda t: F.octet_length(t), byte_ids, char_spans, 256, char_places)
CHAR = Arm("char", "char", "original", lambda t: F.length(t), char_ids, char_spans, None, char_places)
WORD = Arm("word", "word", "original", word_count, None, word_spans, None, word_places)


# --- byte-pair arms ----------------------------------------------------------------

SPACE_MARK = "▁"
LEFT, RIGHT = "\x02", "\x03"  # around every symbol, so that neighbours share no delimiter


def pieces(text: Column) -> Column:
    """Pre-tokens: each space becomes the mark, one is put in front, and the text is
    cut before every mark."""
    marked = F.concat(F.lit(SPACE_MARK), F.replace(text, F.lit(" "), F.lit(SPACE_MARK)))
    return F.filter(F.split(marked, f"(?={SPACE_MARK})"), lambda p: p != "")


def replay(piece: Column, merges: Sequence[tuple[str, str]]) -> Column:
    """The piece's symbols after all merges in rank order, in delimiters: each merge is
    one native ``replace`` over the whole piece.  Equal to the usual encoder as long as
    no symbol can arise from two different merges (``check_merges``)."""
    out = F.regexp_replace(piece, "(?s)(.)", f"{LEFT}$1{RIGHT}")
    for a, b in merges:
        out = F.replace(out, F.lit(f"{LEFT}{a}{RIGHT}{LEFT}{b}{RIGHT}"), F.lit(f"{LEFT}{a}{b}{RIGHT}"))
    return out


def replay_count(text: Column, merges: Sequence[tuple[str, str]]) -> Column:
    symbols = replay(F.array_join(pieces(text), "\x04"), merges)
    marks = F.length(symbols) - F.length(F.replace(symbols, F.lit(LEFT), F.lit("")))
    return (marks - F.size(pieces(text)) + 1).cast("long")


def check_merges(merges: Sequence[tuple[str, str]]) -> None:
    made = [a + b for a, b in merges]
    if len(set(made)) != len(made):
        raise ValueError("a symbol has two derivations; use the UDF encoder")


class Bpe:
    """Rank-ordered merges over code points; unknown characters give ``unk``."""

    def __init__(self, alphabet: Sequence[str], merges: Sequence[tuple[str, str]], specials: Sequence[str] = ("[UNK]",)):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.vocab = {s: i for i, s in enumerate([*specials, *sorted(alphabet), *(a + b for a, b in merges)])}
        self.piece_symbols = cache(self._symbols)

    def _symbols(self, piece: str) -> tuple[str, ...]:
        symbols = list(piece)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return tuple(symbols)

    def split(self, text: str) -> list[str]:
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        starts = [i for i, c in enumerate(marked) if c == SPACE_MARK] + [len(marked)]
        return [marked[a:b] for a, b in zip(starts, starts[1:])]

    def encode(self, text: str) -> list[int]:
        return [self.vocab.get(s, 0) for piece in self.split(text) for s in self.piece_symbols(piece)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        raw, at = [], -1  # the mark in front is not in the text
        for piece in self.split(text):
            for symbol in self.piece_symbols(piece):
                raw.append((max(at, 0), at + len(symbol)))
                at += len(symbol)
        return normalise_spans(text, raw)


def normalise_spans(text: str, raw: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans from the furthest end before them on, without white space at their ends;
    empty ones go."""
    ends = [min(end, len(text)) for _, end in raw]
    furthest = accumulate(ends, max, initial=0)
    held = [(max(start, reached), text[max(start, reached) : end]) for (start, _), end, reached in zip(raw, ends, furthest)]
    begins = ((at + len(piece) - len(piece.lstrip()), piece.strip()) for at, piece in held)
    return [(at, at + len(piece)) for at, piece in begins if piece]


def byte_spans(text: str, lengths: Sequence[int]) -> list[tuple[int, int]]:
    """Character spans of tokens given by their byte lengths; a boundary inside a
    character moves up to its end."""
    ends, total = [], 0
    for char in text:
        total += len(char.encode())
        ends.append(total)
    raw, at, start = [], 0, 0
    for n in lengths:
        at += n
        stop = start
        while stop < len(ends) and (ends[stop - 1] if stop else 0) < at:
            stop += 1
        raw.append((start, stop))
        start = stop
    return normalise_spans(text, raw)


def spans_tile(text: str, spans: Sequence[tuple[int, int]]) -> bool:
    """Whether the spans are in order, do not overlap, and cover exactly the
    characters that are not white space."""
    at = 0
    for start, end in spans:
        if start < at or end <= start or end > len(text) or not text[at:start].isspace() and start > at:
            return False
        if any(c.isspace() for c in (text[start], text[end - 1])):
            return False
        at = end
    return not text[at:].strip()


def spans_tile_column(text: Column, spans: Column) -> Column:
    """``spans_tile`` as a column."""

    @F.pandas_udf("boolean")
    def tile(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t is not None and f is not None and spans_tile(t, [tuple(s) for s in f]) for t, f in zip(texts, found)])

    return tile(text, F.transform(spans, lambda s: F.array(s["start"], s["end"])))


#: Characters whose spans are in memory at once (one text at least).
CHARACTERS = 1 << 20
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def tiling(space: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """``spans_tile`` of each text among texts laid one after the other; ``row``: the
    text of each span."""
    before = np.concatenate([[0], np.cumsum(~space)])  # characters that are no white space
    at = edges[row]
    at[1:] = np.where(row[1:] == row[:-1], end[:-1], at[1:])
    good = (start >= at) & (end > start) & (end <= edges[row + 1])
    s, e, a = (np.clip(x, 0, len(space)) for x in (start, end, at))
    good &= (before[s] == before[a]) & (before[np.minimum(s + 1, len(space))] > before[s]) & (before[e] > before[np.maximum(e - 1, 0)])
    reached = edges[:-1].copy()
    reached[row] = e  # the last of a row stays
    ok = before[edges[1:]] == before[np.clip(reached, 0, len(space))]
    ok[row[~good]] = False
    return ok


def span_report(text: Column, arm: Arm) -> Column:
    """``ok, k, s, e`` of each text: whether the arm's spans tile it, their number, and
    the sums of their starts and ends.  Spans are places in vectors, never rows of
    lists, and those of at most ``CHARACTERS`` characters are held at once."""
    places = arm.places

    @F.arrow_udf("struct<ok: boolean, k: int, s: long, e: long>")
    def report(texts: pa.Array) -> pa.Array:
        sizes = np.array([0 if n is None else n for n in pa.compute.utf8_length(texts).to_pylist()], np.int64)
        out, first = [], 0
        while first < len(sizes):
            stop = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), CHARACTERS, "right")) + first)
            part = texts.slice(first, stop - first)
            points = np.frombuffer("".join(t or "" for t in part.to_pylist()).encode("utf-32-le"), "<u4")
            space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
            edges = np.concatenate([[0], np.cumsum(sizes[first:stop])])
            start, end = places(space, edges)
            row = np.searchsorted(edges, start, "right") - 1
            count = np.bincount(row, minlength=stop - first)
            upto = np.concatenate([[0], np.cumsum(count)])
            none = ~part.is_valid().to_numpy(zero_copy_only=False)
            sums = (np.diff(np.concatenate([[0], np.cumsum(x - edges[row])])[upto]) for x in (start, end))
            columns = [pa.array(tiling(space, edges, start, end, row) & ~none), pa.array(count.astype(np.int32), mask=none), *(pa.array(x, mask=none) for x in sums)]
            out.append(pa.StructArray.from_arrays(columns, ["ok", "k", "s", "e"]))
            first = stop
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("ok", pa.bool_()), ("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))

    return report(text)


def udf_arm(name: str, family: str, variant: str, load: Callable[[], object], vocab_size: int | None = None) -> Arm:
    """An arm over a Python encoder (``encode`` and maybe ``spans``), Arrow-batched;
    ``load`` runs once in each worker."""
    held = cache(load)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = held()
        return texts.map(lambda t: len(encoder.encode(t)), na_action="ignore").astype("Int64")

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = held()
        return texts.map(lambda t: encoder.encode(t), na_action="ignore")

    @F.pandas_udf("array<array<int>>")
    def raw_spans(texts: pd.Series) -> pd.Series:
        encoder = held()
        return texts.map(lambda t: [list(s) for s in encoder.spans(t)], na_action="ignore")

    def spans(text: Column) -> Column:
        return _struct_spans(raw_spans(text))

    return Arm(name, family, variant, count, ids, spans, vocab_size)


class _Tiktoken:
    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.inner = tiktoken.Encoding("arm", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.inner.encode_ordinary(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return byte_spans(text, [len(self.inner.decode_single_token_bytes(t)) for t in self.encode(text)])


class _Library:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def spans(self, text: str) -> list[tuple[int, int]]:
        return normalise_spans(text, self.inner.encode(text, add_special_tokens=False).offsets)


class _Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.inner = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> list[int]:
        return self.inner.encode(text)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = self.inner.encode(text, out_type="immutable_proto").pieces
        return normalise_spans(text, [(p.begin, p.end) for p in found])


_LOADERS = {"tiktoken": _Tiktoken, "json": _Library, "model": _Pieces}


def file_arm(name: str, path: str, variant: str = "original", pattern: str | None = None) -> Arm:
    """An arm from a tokenizer file: ranks (``.tiktoken``), a tokenizers library file
    (``.json``) or a sentencepiece model (``.model``)."""
    import os

    kind = path.rpartition(".")[2]
    if kind not in _LOADERS or not os.path.exists(path):
        raise TokenizerUnavailable(f"{name}: no loader or no file at {path}")
    args = (path, pattern) if kind == "tiktoken" else (path,)
    return udf_arm(name, kind, variant, lambda: _LOADERS[kind](*args))


# --- registry ----------------------------------------------------------------------


class Registry:
    """Arms by name; loaders are tried in order, and what fails is recorded."""

    def __init__(self):
        self.loaders: dict[str, tuple[str, str, list[Callable[[], Arm]]]] = {}
        for arm in (BYTE, CHAR, WORD):
            self.add(arm.name, arm.family, arm.variant, lambda arm=arm: arm)

    def add(self, name: str, family: str, variant: str, *loaders: Callable[[], Arm]) -> None:
        self.loaders[name] = (family, variant, list(loaders))

    def names(self, family: str | None = None, variant: str | None = None) -> list[str]:
        return [n for n, (f, v, _) in self.loaders.items() if family in (None, f) and variant in (None, v)]

    def load(self, name: str) -> Arm:
        if name not in self.loaders:
            raise KeyError(f"no arm {name!r}; there are {', '.join(self.loaders)}")
        errors = []
        for loader in self.loaders[name][2]:
            try:
                return loader()
            except (TokenizerUnavailable, ImportError, OSError) as e:
                errors.append(str(e))
        raise TokenizerUnavailable(f"{name}: {'; '.join(errors)}")

    def load_all(self, names: Sequence[str]) -> tuple[dict[str, Arm], dict[str, str]]:
        """Arms that load, and the reasons of those that do not."""
        found, missing = {}, {}
        for name in names:
            try:
                found[name] = self.load(name)
            except TokenizerUnavailable as e:
                missing[name] = str(e)
        return found, missing

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, f, v) for n, (f, v, _) in self.loaders.items()], "arm string, family string, variant string")


def encode_corpus(lines: DataFrame, ids: Column, eos_id: int, vocab: int, order: str, carry: Sequence[str] = ()) -> DataFrame:
    """``order, ids`` and the carried columns, with the end id after each line; an id outside the vocabulary is
    an error raised by the row that holds it."""
    rows = lines.select(order, *carry, F.concat(ids, F.array(F.lit(eos_id))).alias("ids"))
    held = F.col("ids")
    bad = F.exists(held, lambda i: (i < 0) | (i >= vocab))
    return rows.select(order, *carry, F.when(bad, F.raise_error(F.lit("a token id lies outside the vocabulary"))).otherwise(held).alias("ids"))


def vocab_dtype(vocab: int) -> str:
    return "uint16" if vocab <= 1 << 16 else "uint32"


def round_up(vocab: int, multiple: int) -> int:
    return -(-vocab // multiple) * multiple
