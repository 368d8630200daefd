"""Text expressions as Spark columns: no Python worker, all inside codegen.

White space is Python's ``str.isspace`` set, which Java's ``\\s`` is not: it also
holds U+001C to U+001F.  Letters are ``\\p{L}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of the white-space class, for Java and RE2 patterns alike (fixed values).
WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE, NOT_SPACE = f"[{WHITE}]", f"[^{WHITE}]"

#: Typographic characters and the ASCII they stand for (fixed values).
TYPOGRAPHIC = {
    "‘": "'",
    "’": "'",
    "‚": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "–": "-",
    "—": "-",
    "‒": "-",
    "…": "...",
    " ": " ",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it (Spark
    evaluates an outer expression again for each element of an array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(text: Column) -> Column:
    """The code points, as an array of strings."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """The maximal runs of other than white space, as an array (null stays null)."""
    return F.regexp_extract_all(text, F.lit(f"({NOT_SPACE}+)"), 1)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def real_words(text: Column) -> Column:
    """The words that hold a letter."""
    return F.filter(words(text), lambda w: w.rlike(r"\p{L}"))


def mean_word_length(text: Column) -> Column:
    """Mean code points of the real words; 0 without any."""
    found = real_words(text)
    total = F.aggregate(found, F.lit(0), lambda acc, w: acc + F.length(w))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(total / F.size(found))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}]", "")


def nonspace_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def typographic(text: Column) -> Column:
    """Typographic punctuation as ASCII: single characters, then the ellipsis."""
    one = {k: v for k, v in TYPOGRAPHIC.items() if len(v) == 1}
    return F.replace(F.translate(text, "".join(one), "".join(one.values())), F.lit("…"), F.lit("..."))


def normalise_line(text: Column) -> Column:
    return collapse(typographic(text))


def letter_fraction(text: Column, letters: str) -> Column:
    """Share of characters in ``letters`` (a class body) among those that are not
    white space, after trailing ASCII punctuation and space are gone; 0 if none."""
    core = F.regexp_replace(text, r"[!-/:-@\[-`{-~\x{9}-\x{D}\x{20}]+$", "")
    considered = F.regexp_replace(core, SPACE, "")
    kept = F.length(F.regexp_replace(considered, f"[^{letters}]", ""))
    return F.when(F.length(considered) == 0, F.lit(0.0)).otherwise(kept / F.length(considered))


def has_markers(text: Column, markers: Sequence[str], least: int = 2) -> Column:
    """Whether at least ``least`` different marker words occur as words."""
    found = F.regexp_extract_all(text, F.lit(f"(?<!{NOT_SPACE})({'|'.join(map(re.escape, markers))})(?!{NOT_SPACE})"), 1)
    return F.size(F.array_distinct(found)) >= least


def shingles(letters: Column, k: int) -> Column:
    """The distinct windows of ``k`` characters; empty for shorter strings."""
    if k <= 0:
        raise ValueError("a window holds at least one character")

    # A look-ahead matches at every character: one pass, however long the string.
    return F.array_distinct(F.regexp_extract_all(letters, F.lit(f"(?s)(?=(.{{{k}}}))"), 1))


def shingles_or_whole(letters: Column, k: int) -> Column:
    """As ``shingles``, but a shorter string that is not empty is its own window."""

    def body(text: Column) -> Column:
        n = F.length(text)
        return F.when(n >= k, shingles(text, k)).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    return let(letters, body)


def split_after(text: Column, terminators: str) -> Column:
    """Pieces that end after each character of the class body ``terminators``."""
    return F.split(text, f"(?<=[{terminators}])")


def sentence_hash(text: Column) -> Column:
    """sha256 of the stripped text, as lower-case hex."""
    return F.sha2(strip(text), 256)


def strip_markers(text: Column, marker: str) -> tuple[Column, Column]:
    """The text without markers, and the offset (in the plain text) of each."""
    parts = F.split(text, marker, -1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        at = acc["at"] + n
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    offsets = F.aggregate(lengths, start, step, lambda acc: acc["out"])
    return F.array_join(parts, ""), offsets


def mark(text: Column, offsets: Column, marker: str) -> Column:
    """The text with a marker at each offset; offsets outside the text are an error."""
    ordered = F.array_sort(offsets)
    cuts = F.concat(F.array(F.lit(0)), ordered, F.array(F.length(text)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.substring(text, F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i))
    )
    outside = F.exists(offsets, lambda o: (o < 0) | (o > F.length(text)))
    return F.when(outside, F.raise_error(F.lit("an offset lies outside the text"))).otherwise(F.array_join(pieces, marker))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    most = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), most), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def peel(unit: Column) -> tuple[Column, Column, Column]:
    """Outer non-letters before, the core, and outer non-letters after; a unit
    without letters is all "after"."""
    pattern = r"(?s)^([^\p{L}]*)(\p{L}(?:.*\p{L})?)([^\p{L}]*)$"
    some = unit.rlike(r"\p{L}")
    parts = [F.regexp_extract(unit, pattern, i) for i in (1, 2, 3)]
    return F.when(some, parts[0]).otherwise(""), F.when(some, parts[1]).otherwise(""), F.when(some, parts[2]).otherwise(unit)


def pipe_fields(cell: Column) -> Column:
    """``K=V|K=V`` as a map: items without ``=`` go, and the last of a key stays."""
    items = F.filter(F.split(cell, r"\|"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def plain_cell(cell: Column) -> Column:
    """A table cell, with ``_`` for an empty one."""
    return F.when(cell == "_", "").otherwise(cell)


def without_boilerplate(document: Column, title: Column, shortest: int = 20) -> Column:
    """The document's lines that are not blank, headings (``==``), the title itself
    or shorter than ``shortest`` characters."""
    def keep(line):
        plain = strip(line)
        return (plain != "") & ~plain.startswith("==") & (plain != strip(F.coalesce(title, F.lit("")))) & (F.length(plain) >= shortest)

    return F.array_join(F.filter(F.split(document, "\n"), keep), "\n")


def document_lines(document: Column, terminators: str = ".।॥", least_words: int = 2) -> Column:
    """A document's lines: split at line ends and after terminators, white space
    collapsed, pieces of fewer than ``least_words`` real words left out."""
    pieces = F.flatten(F.transform(F.split(document, "\n"), lambda line: split_after(line, terminators)))
    return F.filter(F.transform(pieces, collapse), lambda p: F.size(real_words(p)) >= least_words)
