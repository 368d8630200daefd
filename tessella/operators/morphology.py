"""Boundaries inside words: alignment, marking, boundary F1, merge audits, stems.

Alignment and reconciliation follow ``difflib``'s matching, which is a sequential
string algorithm: those run as Arrow-batched UDFs.  Counting and scoring are native.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import divide, f1
from ..functions.slp1 import SLP1_VOWELS
from ..functions.text import common_prefix

#: Between morphemes of a marked text (a fixed value: the unit separator).
MARKER = "\x1f"
LEAST_RATIO = 0.6
LEAST_STEM = 2
#: Closed word classes have no stem boundary, and these lemmas none at all (fixed values).
CLOSED_CLASSES = ("ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NUM", "PART", "PRON", "PUNCT", "SCONJ", "SYM", "X")


# --- alignment ---------------------------------------------------------------------


def align_segments(surface: str | None, segments: Sequence[str] | None, least: float = LEAST_RATIO) -> list[int] | None:
    """Where each segment after the first begins in the surface form; None where the
    two are too unlike, or the boundaries do not rise strictly inside the form.

    A boundary inside a matching block goes through it; one in a gap goes to the next
    block's start."""
    joined = "".join(segments or ())
    if not surface or not joined:
        return None
    matcher = SequenceMatcher(None, surface, joined, autojunk=False)
    if matcher.ratio() < least:
        return None
    blocks, out, at = matcher.get_matching_blocks(), [], 0
    for segment in segments[:-1]:
        at += len(segment)
        block = next((b for b in blocks if at < b.b + b.size or b.b > at), None)
        place = len(surface) if block is None else block.a + max(0, at - block.b)
        if not (out[-1] if out else 0) < place < len(surface):
            return None
        out.append(place)
    return out


def match_words(text_words: Sequence[str], token_words: Sequence[str]) -> list[int | None]:
    """For each word of the text its index among the tokens' words, where a run of
    equal words connects them."""
    out: list[int | None] = [None] * len(text_words)
    for a, b, size in SequenceMatcher(None, list(text_words), list(token_words), autojunk=False).get_matching_blocks():
        out[a : a + size] = range(b, b + size)
    return out


def aligned_offsets(surface: Column, segments: Column) -> Column:
    """``align_segments`` as a column (Arrow batches)."""

    @F.pandas_udf("array<int>")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align_segments(x, None if y is None else list(y)) for x, y in zip(a, b)], dtype=object)

    return align(surface, segments)


# --- reconciliation ----------------------------------------------------------------

WINDOW = 8


def _like(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _outer(unit: str) -> tuple[str, str, str]:
    letters = [i for i, c in enumerate(unit) if c.isalpha()]
    if not letters:
        return "", "", unit
    return unit[: letters[0]], unit[letters[0] : letters[-1] + 1], unit[letters[-1] + 1 :]


def _window_scores(part: str, segments: Sequence[str]) -> list[float]:
    """Likeness of the part to the first 1, 2, ... segments joined: ``WINDOW`` widths,
    and one more as long as the widest is the likest of all."""
    scores: list[float] = []
    while len(scores) < len(segments) and (len(scores) < WINDOW or scores[-1] > max(scores[:-1], default=0.0)):
        scores.append(_like(part, "".join(segments[: len(scores) + 1])))
    return scores


def choose_window(part: str, segments: Sequence[str], following: str | None, threshold: float = LEAST_RATIO) -> tuple[int, float]:
    """How many of the segments a part claims, and their likeness; (0, 0.0) for none.

    A window may be claimed if it reaches the threshold and is no likelier the following
    unit's; of these the likest, and the shortest of equals.  Nothing is claimed where
    already the first segment is likelier the following unit's, or where the choice is
    the widest window looked at though segments are left."""
    rival = (lambda held: _like(following, held)) if following is not None else (lambda held: -1.0)
    if not segments or rival(segments[0]) > _like(part, segments[0]):
        return 0, 0.0
    scores = _window_scores(part, segments)
    allowed = [n for n, score in enumerate(scores, 1) if score >= threshold and score >= rival("".join(segments[:n]))]
    if not allowed:
        return 0, 0.0
    chosen = min(allowed, key=lambda n: (-scores[n - 1], n))
    cut_short = chosen == len(scores) < len(segments)
    return (0, 0.0) if cut_short else (chosen, scores[chosen - 1])


def _claims(peeled: Sequence[tuple[str, str, str]], units: Sequence[str], segments: Sequence[str], threshold: float) -> dict[tuple[int, int], tuple[str, bool]]:
    """What the parts of the units claim, in their order: (unit, part) -> the segments,
    spaced, and whether they differ from the part.  A unit without letters lets a
    segment that resembles it go by."""
    found: dict[tuple[int, int], tuple[str, bool]] = {}
    left = list(segments)
    for i, (_, core, _) in enumerate(peeled):
        if not core:
            if left and _like(units[i], left[0]) >= threshold:
                del left[0]
            continue
        following = (peeled[i + 1][1] or units[i + 1]) if i + 1 < len(units) else None
        for j, part in enumerate(core.split("-")):
            n, score = choose_window(part, left, following, threshold) if part else (0, 0.0)
            if n:
                found[i, j] = " ".join(left[:n]), score < 1.0
                del left[:n]
    return found


def _shown(peeled: tuple[str, str, str], claimed: dict[int, str]) -> str:
    """A unit with its claimed parts: its own outer characters and hyphens stand, and
    outer non-letters of what was claimed go."""
    before, core, after = peeled
    parts = [claimed.get(j, part) for j, part in enumerate(core.split("-"))]
    parts[0] = before + parts[0][len(_outer(parts[0])[0]) if _outer(parts[0])[1] else len(parts[0]) :]
    _, held, behind = _outer(parts[-1])
    parts[-1] = (parts[-1][: len(parts[-1]) - len(behind)] if held else "") + after
    return "-".join(parts)


def reconcile(raw: str, model: str, threshold: float = LEAST_RATIO) -> dict:
    """The raw text with the model's segmentation where both agree; everything else,
    and all outer non-letters and hyphens, as written.  With counters."""
    units = raw.split()
    peeled = [_outer(unit) for unit in units]
    segments = [part for unit in model.split() for part in unit.split("-") if part]
    found = _claims(peeled, units, segments, threshold)
    by_unit: dict[int, dict[int, str]] = {}
    for (i, j), (text, _) in found.items():
        by_unit.setdefault(i, {})[j] = text
    out = [_shown(peeled[i], by_unit[i]) if i in by_unit else unit for i, unit in enumerate(units)]
    verbatim, inexact = len(units) - len(by_unit), len({i for (i, _), (_, differs) in found.items() if differs})
    text = " ".join(out)
    size = {name: sum(not c.isspace() for c in t) for name, t in (("raw", raw), ("model", model), ("out", text))}
    return {
        "text": text,
        "n_units_raw": len(units),
        "n_units_out": len(text.split()),
        "n_units_kept_verbatim": verbatim,
        "n_units_replaced_inexact": inexact,
        "chars_raw": size["raw"],
        "chars_model": size["model"],
        "chars_out": size["out"],
    }


RECONCILED = "text string, n_units_raw int, n_units_out int, n_units_kept_verbatim int, n_units_replaced_inexact int, chars_raw int, chars_model int, chars_out int"


def reconciled(raw: Column, model: Column) -> Column:
    """``reconcile`` as a struct column (Arrow batches)."""

    @F.pandas_udf(RECONCILED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reconcile(x or "", y or "") for x, y in zip(a, b)], columns=[f.split()[0] for f in RECONCILED.split(", ")])

    return run(raw, model)


# --- what a transformation kept ----------------------------------------------------


def drop_lost_nonletters(raw: str, out: str) -> str:
    """The raw text without, from the left, the non-letters that the output lost."""
    def counted(text: str) -> Counter:
        return Counter(c for c in text if not c.isalpha() and not c.isspace())

    lost = counted(raw) - counted(out)
    kept = []
    for char in raw:
        if lost[char] > 0:
            lost[char] -= 1
        else:
            kept.append(char)
    return "".join(kept)


def character_changes(pairs: DataFrame, idx: str, raw: str, out: str) -> DataFrame:
    """``idx, ch, d``: signed counts (out minus raw) of characters that are not white
    space, where they differ."""
    def chars(column: str, sign: int) -> DataFrame:
        return pairs.select(idx, F.explode(F.split(F.regexp_replace(column, r"\s", ""), "")).alias("ch")).where("ch != ''").groupBy(idx, "ch").agg((F.count("*") * sign).alias("d"))

    both = chars(raw, -1).union(chars(out, 1))
    return both.groupBy(idx, "ch").agg(F.sum("d").alias("d"))


def text_invariants(pairs: DataFrame, idx: str, raw: str, out: str) -> DataFrame:
    """Letters and other characters before and after, and what was gained and lost:
    gross (row by row) and net (over the corpus)."""
    changes = character_changes(pairs, idx, raw, out).withColumn("letter", F.col("ch").rlike(r"^\p{L}$"))
    gross = changes.agg(
        *(
            F.coalesce(F.sum(F.when((F.col("letter") == is_letter) & (F.col("d") * sign > 0), F.col("d") * sign)), F.lit(0)).alias(f"{kind}_{name}_gross")
            for kind, is_letter in (("letters", True), ("others", False))
            for name, sign in (("lost", -1), ("gained", 1))
        )
    )
    net = changes.groupBy("ch", "letter").agg(F.sum("d").alias("d")).agg(
        *(
            F.coalesce(F.sum(F.when((F.col("letter") == is_letter) & (F.col("d") * sign > 0), F.col("d") * sign)), F.lit(0)).alias(f"{kind}_{name}_net")
            for kind, is_letter in (("letters", True), ("others", False))
            for name, sign in (("lost", -1), ("gained", 1))
        )
    )
    letters = pairs.agg(
        F.sum(F.length(F.regexp_replace(raw, r"[^\p{L}]", ""))).cast("long").alias("letters_raw"), F.sum(F.length(F.regexp_replace(out, r"[^\p{L}]", ""))).cast("long").alias("letters_out")
    )
    joined = letters.crossJoin(gross).crossJoin(net)  # one row each
    return joined.withColumn("letter_retention", divide(F.col("letters_out"), F.col("letters_raw")))


def deletion_cost(pairs: DataFrame, count, raw: str, out: str) -> DataFrame:
    """Tokens of the raw text, of the raw text without lost non-letters, and what part
    of the saving that deletion explains (NULL unless something was saved)."""
    @F.pandas_udf("string")
    def dropped(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else drop_lost_nonletters(x, y) for x, y in zip(a, b)], dtype=object)

    rows = pairs.select(count(F.col(raw)).alias("a"), count(dropped(F.col(raw), F.col(out))).alias("b"), count(F.col(out)).alias("c"))
    sums = rows.agg(F.sum("a").alias("tokens_raw"), F.sum("b").alias("tokens_without_lost"), F.sum("c").alias("tokens_out"))
    saved, cost = F.col("tokens_raw") - F.col("tokens_out"), F.col("tokens_raw") - F.col("tokens_without_lost")
    return sums.withColumns({"tokens_saved": saved, "deletion_tokens": cost, "deletion_share": F.when(saved > 0, divide(cost, saved))})


# --- boundary scores ---------------------------------------------------------------


def token_boundaries(spans: Column) -> Column:
    """Starts of spans other than the first character."""
    return F.filter(F.transform(spans, lambda s: s["start"]), lambda x: x != 0)


def _nearest(predicted: Sequence[int], gold: Sequence[int], tolerance: int) -> int:
    free, matched = list(predicted), 0
    for g in gold:
        near = [p for p in free if abs(p - g) <= tolerance]
        if near:
            free.remove(min(near, key=lambda p: (abs(p - g), p)))
            matched += 1
    return matched


def matched_count(predicted: Column, gold: Column, tolerance: int = 0) -> Column:
    """Gold boundaries met one to one: exactly (native), or greedily by the nearest
    within a tolerance (UDF)."""
    if tolerance == 0:
        return F.size(F.array_intersect(predicted, gold))

    @F.pandas_udf("int")
    def nearest(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _nearest(list(a), list(b), tolerance) for a, b in zip(p, g)], dtype="Int32")

    return nearest(predicted, gold)


def boundary_scores(words: DataFrame, by: Sequence[str], predicted: str, gold: str, tolerance: int = 0) -> DataFrame:
    """Pooled precision, recall and F1.  Words without a gold array are excluded and
    counted; without any word, gold or prediction the ratios are undefined."""
    usable = F.col(gold).isNotNull()
    rows = words.withColumn("__m", F.when(usable, matched_count(F.col(predicted), F.col(gold), tolerance)))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n_words"),
        F.count_if(~usable).alias("n_excluded"),
        F.sum("__m").cast("long").alias("n_matched"),
        F.sum(F.when(usable, F.size(predicted))).cast("long").alias("n_predicted"),
        F.sum(F.when(usable, F.size(gold))).cast("long").alias("n_gold"),
    )
    p, r = divide(F.col("n_matched"), F.col("n_predicted")), divide(F.col("n_matched"), F.col("n_gold"))
    value = F.when(F.col("n_gold") + F.col("n_predicted") > 0, f1(F.col("n_matched"), F.col("n_predicted"), F.col("n_gold")))
    return sums.withColumns({"precision": p, "recall": r, "f1": value})


def merge_violations(words: DataFrame, by: Sequence[str], spans: str, boundaries: str) -> DataFrame:
    """Tokens that reach over a boundary: it lies strictly inside their span."""
    crossing = F.filter(F.col(spans), lambda s: F.exists(F.col(boundaries), lambda b: (s["start"] < b) & (b < s["end"])))
    crossed = F.filter(F.col(boundaries), lambda b: F.exists(F.col(spans), lambda s: (s["start"] < b) & (b < s["end"])))
    sums = words.groupBy(*by).agg(
        F.count("*").alias("n_words"),
        F.sum(F.size(spans)).cast("long").alias("n_tokens"),
        F.sum(F.size(boundaries)).cast("long").alias("n_boundaries"),
        F.sum(F.size(crossing)).cast("long").alias("n_violating_tokens"),
        F.sum(F.size(crossed)).cast("long").alias("n_violated_boundaries"),
    )
    return sums.withColumn("violations_per_boundary", divide(F.col("n_violated_boundaries"), F.col("n_boundaries")))


# --- stems -------------------------------------------------------------------------


def stem_cut_lcp(segment: Column, lemma: Column) -> Column:
    """The common prefix as stem, if it is long enough and not the whole segment."""
    n = common_prefix(segment, lemma)
    return F.when((F.coalesce(lemma, F.lit("")).isin("", "_")) | (n < LEAST_STEM) | (n >= F.length(segment)), F.lit(None)).otherwise(n)


def cut_is_fused(segment: Column, lemma: Column, cut: Column) -> Column:
    """The cut stands before the lemma's last vowel, which the form replaces by another."""
    last, there = F.substring(lemma, -1, 1), F.substring(segment, cut + 1, F.lit(1))
    vowel = f"^[{SLP1_VOWELS}]$"
    return (cut == F.length(lemma) - 1) & (cut < F.length(segment)) & last.rlike(vowel) & there.rlike(vowel)


def stem_cut(segment: Column, lemma: Column, upos: Column) -> Column:
    """As ``stem_cut_lcp``, but only where the whole lemma is there or its last vowel
    alone is fused, and never in closed word classes."""
    n = common_prefix(segment, lemma)
    good = (n == F.length(lemma)) | cut_is_fused(segment, lemma, n)
    return F.when(~F.coalesce(upos, F.lit("")).isin(*CLOSED_CLASSES) & good, stem_cut_lcp(segment, lemma))


def stem_audit(segments: DataFrame, segment: str, lemma: str, upos: str) -> DataFrame:
    """Per rule: segments, cuts, cuts inside the lemma, and fused cuts among them."""
    s, l = F.col(segment), F.col(lemma)
    rules = F.array(F.struct(F.lit("sandhi_aware").alias("rule"), stem_cut(s, l, F.col(upos)).alias("cut")), F.struct(F.lit("lcp").alias("rule"), stem_cut_lcp(s, l).alias("cut")))
    rows = segments.where(s != "").select(s.alias("s"), l.alias("l"), F.explode(rules).alias("r")).select("s", "l", "r.*")
    inside = F.col("cut") < F.length("l")
    sums = rows.groupBy("rule").agg(
        F.count("*").alias("n_segments"),
        F.count("cut").alias("n_cuts"),
        F.count_if(F.coalesce(inside, F.lit(False))).alias("n_inside_lemma"),
        F.count_if(F.coalesce(inside & cut_is_fused(F.col("s"), F.col("l"), F.col("cut")), F.lit(False))).alias("n_fused"),
    )
    return sums.withColumns({"fraction_inside_lemma": divide(F.col("n_inside_lemma"), F.col("n_cuts")), "fraction_fused": divide(F.col("n_fused"), F.col("n_cuts"))})
