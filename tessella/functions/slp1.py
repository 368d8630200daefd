"""SLP1, a one-character-per-phoneme transliteration of Sanskrit, to and from
Devanagari and IAST.

A Devanagari consonant carries the vowel ``a`` unless a vowel sign or the virama
follows; a nukta reads as ``0`` and the dandas as ``.`` and ``..``.  Characters outside
the tables pass unchanged.  The columns run the string functions once per *distinct*
word, since texts repeat their words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phonemes in the order of the Devanagari alphabet.
_VOWELS = dict(zip("अआइईउऊऋॠऌॡएऐओऔ", "aAiIuUfFxXeEoO"))
_SIGNS = dict(zip("ािीुूृॄॢॣेैोौ", "AiIuUfFxXeEoO"))
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "kKgGNcCjJYwWqQRtTdDnpPbBmyrlvSzshL"))
_MARKS = {"ं": "M", "ः": "H", "ँ": "~", "ऽ": "'", "।": ".", "॥": "..", "़": "0", "ॐ": "oM"}
_DIGITS = dict(zip("०१२३४५६७८९", "0123456789"))
_VIRAMA = "्"
_IAST = {
    "ā": "A", "ī": "I", "ū": "U", "ṛ": "f", "ṝ": "F", "ḷ": "x", "ḹ": "X", "ṃ": "M", "ḥ": "H", "ṅ": "N", "ñ": "Y", "ṇ": "R", "ś": "S", "ṣ": "z", "ṭ": "w", "ḍ": "q",
}
_IAST_PAIRS = {"kh": "K", "gh": "G", "ch": "C", "jh": "J", "ṭh": "W", "ḍh": "Q", "th": "T", "dh": "D", "ph": "P", "bh": "B", "ai": "E", "au": "O"}
SLP1_VOWELS = "aAiIuUfFxXeEoO"


def _from_devanagari(text: str) -> str:
    out, open_consonant = [], False
    for char in text:
        if char in _SIGNS:
            out.append(_SIGNS[char])
        elif char == _VIRAMA:
            if not open_consonant:
                out.append(char)
        elif char == "़":
            out.append("0")
            continue  # the consonant stays open for its vowel
        else:
            if open_consonant:
                out.append("a")
            if char in _CONSONANTS:
                out.append(_CONSONANTS[char])
                open_consonant = True
                continue
            out.append(_VOWELS.get(char) or _MARKS.get(char) or _DIGITS.get(char) or char)
        open_consonant = False
    if open_consonant:
        out.append("a")
    return "".join(out)


def _from_iast(text: str) -> str:
    text, out, i = unicodedata.normalize("NFC", text).replace("ṁ", "ṃ").lower(), [], 0
    while i < len(text):
        pair = text[i : i + 2]
        if pair in _IAST_PAIRS:
            out.append(_IAST_PAIRS[pair])
            i += 2
        else:
            out.append("." if text[i] == "।" else _IAST.get(text[i], text[i]))
            i += 1
    return "".join(out)


def to_slp1(text: str, script: str) -> str:
    if script == "slp1":
        return text
    return {"devanagari": _from_devanagari, "iast": _from_iast}[script](text)


def _to_devanagari(text: str) -> str:
    vowels = {v: k for k, v in _VOWELS.items()}
    signs = {v: k for k, v in _SIGNS.items()}
    consonants = {v: k for k, v in _CONSONANTS.items()}
    marks = {"M": "ं", "H": "ः", "~": "ँ", "'": "ऽ"}
    out, open_consonant, i = [], False, 0
    while i < len(text):
        char = text[i]
        if open_consonant and char in vowels:
            out.append("" if char == "a" else signs[char])
            open_consonant = False
        elif open_consonant and char == "0":
            out.append("़")
        else:
            if open_consonant:
                out.append(_VIRAMA)
            open_consonant = char in consonants
            if open_consonant:
                out.append(consonants[char])
            elif text[i : i + 2] == "..":
                out.append("॥")
                i += 1
            elif char == ".":
                out.append("।")
            elif char.isdigit() and char.isascii():
                out.append({v: k for k, v in _DIGITS.items()}[char])
            else:
                out.append(vowels.get(char) or marks.get(char) or char)
        i += 1
    if open_consonant:
        out.append(_VIRAMA)
    return "".join(out)


def _to_iast(text: str) -> str:
    table = {v: k for k, v in {**_IAST, **_IAST_PAIRS}.items()}
    return "".join(table.get(c, c) for c in text)


def from_slp1(text: str, script: str) -> str:
    if script == "slp1":
        return text
    return {"devanagari": _to_devanagari, "iast": _to_iast}[script](text)


def round_trips(text: str, script: str) -> bool:
    return from_slp1(to_slp1(text, script), script) == text


def signs_passed_through() -> str:
    """Devanagari signs (marks, punctuation and the like, vowel signs aside) that the
    transliteration does not know and so would leave in the text."""
    kinds = {"Mn", "Mc", "Po", "Lm", "So", "Sk"}
    blocks = [*range(0x0900, 0x0980), *range(0xA8E0, 0xA900)]
    found = (chr(c) for c in blocks if unicodedata.category(chr(c)) in kinds and "VOWEL SIGN" not in unicodedata.name(chr(c), ""))
    return "".join(c for c in found if c not in "।॥" and to_slp1(c, "devanagari") == c)


def _column(function: Callable[[str, str], str], script: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        distinct = {t: function(t, script) for t in texts.dropna().unique()}
        return texts.map(distinct, na_action="ignore")

    return convert


def slp1_column(text: Column, script: str) -> Column:
    """``to_slp1`` as a column (an Arrow-batched UDF: the rules look at neighbours)."""
    return _column(to_slp1, script)(text)


def script_column(text: Column, script: str) -> Column:
    return _column(from_slp1, script)(text)


def normalise_source(text: Column) -> Column:
    """Without the signs that SLP1 has no room for (native)."""
    signs = signs_passed_through()
    return F.translate(text, signs, "") if signs else text
