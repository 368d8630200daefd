"""Gold segmentation records from parsed sentences, and corpus ingestion with hold-outs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slp1 import SLP1_VOWELS, to_slp1
from ..functions.text import sentence_hash
from .corpus import holdout_groups
from .morphology import CLOSED_CLASSES, LEAST_STEM, MARKER, align_segments, match_words

GOLD = (
    "sent_id string, text_id int, text_iast string, text_slp1 string, oracle_split_slp1 string, segment_offsets array<array<int>>, "
    "stem_offsets array<array<int>>, t5_marked string, t5seg_marked string, t6_marked string, n_words int, n_words_aligned int, human_verified boolean"
)


def stem_cut(segment: str, lemma: str, upos: str) -> int | None:
    """Where a segment's stem ends: after the whole lemma, or before its fused vowel."""
    if upos in CLOSED_CLASSES or lemma in ("", "_"):
        return None
    n = next((i for i, (a, b) in enumerate(zip(segment, lemma)) if a != b), min(len(segment), len(lemma)))
    fused = n == len(lemma) - 1 and n < len(segment) and lemma[-1] in SLP1_VOWELS and segment[n] in SLP1_VOWELS
    return n if (n == len(lemma) or fused) and LEAST_STEM <= n < len(segment) else None


def marked(word: str, offsets: Sequence[int]) -> str:
    cuts = [0, *sorted(set(offsets)), len(word)]
    return MARKER.join(word[a:b] for a, b in zip(cuts, cuts[1:]))


def gold_sentence(sent_id: str, text_id: int, text: str, words: Sequence[dict]) -> tuple:
    """One record: the text's words in SLP1, matched to the token block, with segment
    boundaries (None where a word does not align) and stem boundaries projected
    through them, and the three marked texts."""
    surfaces = [to_slp1(w, "iast") for w in text.split(" ") if w]
    block = [to_slp1(w["surface"], "iast") for w in words]
    segment_offsets, stem_offsets, oracle = [], [], []
    for surface, at in zip(surfaces, match_words(surfaces, block)):
        tokens = [] if at is None else words[at]["tokens"]
        segments = [to_slp1(t["unsandhied"], "iast") for t in tokens] or [surface]
        offsets = None if at is None else align_segments(surface, segments)
        stems = []
        if offsets is not None:
            starts = [0, *offsets]
            ends = [*offsets, len(surface)]
            for start, end, segment, token in zip(starts, ends, segments, tokens):
                cut = stem_cut(segment, to_slp1(token["lemma"], "iast"), token["upos"])
                if cut is not None and start < start + cut < end:
                    stems.append(start + cut)
        segment_offsets.append(offsets)
        stem_offsets.append(stems)
        oracle.append(" ".join(segments))
    both = [marked(w, [*(o or []), *s]) for w, o, s in zip(surfaces, segment_offsets, stem_offsets)]
    only = [marked(w, o or []) for w, o in zip(surfaces, segment_offsets)]
    split = [" ".join(marked(p, ()) for p in s.split(" ")) for s in oracle]
    verified = not any(t["reconstructed"] for w in words for t in w["tokens"])
    return (
        sent_id, text_id, text, " ".join(surfaces), " ".join(oracle), segment_offsets, stem_offsets, " ".join(both), " ".join(only), " ".join(split),
        len(surfaces), sum(o is not None for o in segment_offsets), verified,
    )


def gold_records(sentences: DataFrame) -> DataFrame:
    """Gold records of ``sources.readers.conllu_sentences`` rows (Arrow batches: word
    matching and alignment are sequential)."""
    names = [f.split()[0] for f in GOLD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [gold_sentence(s, int(i), t, [{"surface": w["surface"], "tokens": list(w["tokens"])} for w in ws]) for s, i, t, ws in zip(batch["sent_id"], batch["text_id"], batch["text"], batch["words"])]
            yield pd.DataFrame(rows, columns=names)

    return sentences.select("sent_id", "text_id", "text", "words").mapInPandas(run, GOLD)


def projected_stems(stem_offsets, segment_offsets):
    """Stem boundaries that are no segment boundaries, per word (order kept)."""
    return F.zip_with(stem_offsets, segment_offsets, lambda a, b: F.when(b.isNotNull(), F.array_except(a, b)))


def ingest(records: DataFrame, exclusion: DataFrame, fraction: float, seed: int, least_words: int = 1) -> DataFrame:
    """Records with ``split``: ``heldout`` (texts chosen by hash), ``train``, or a reason:
    ``short`` (too few words), ``excluded`` (evaluation text), ``leak`` (the same
    sentence is held out).  Held-out texts are whole texts."""
    held = holdout_groups(records, "text_id", fraction, seed).withColumn("held", F.lit(True))
    rows = records.withColumn("hash", sentence_hash(F.col("text_slp1"))).join(F.broadcast(held), "text_id", "left")
    rows = rows.join(exclusion.select("hash", F.lit(True).alias("listed")), "hash", "left")
    own = rows.where("held and listed is null").select("hash", F.lit(True).alias("seen")).distinct()
    rows = rows.join(own, "hash", "left")
    split = F.when(F.col("n_words") < least_words, "short").when(F.col("listed"), "excluded").when(F.col("held"), "heldout").when(F.col("seen"), "leak").otherwise("train")
    return rows.withColumn("split", split).drop("hash", "held", "listed", "seen")
