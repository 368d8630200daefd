"""Round-trip and coverage reports, text extents, labels and small report rules."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import divide
from ..functions.slp1 import script_column, slp1_column
from ..functions.text import strip


def examples(rows: DataFrame, condition: Column, idx: str, text: str, most: int = 5) -> list:
    """Up to ``most`` matching rows, first by index."""
    return [tuple(r) for r in rows.where(condition).select(idx, text).orderBy(idx).limit(most).collect()]


def roundtrip_report(rows: DataFrame, script: str, text: str = "text") -> DataFrame:
    """Round trips through SLP1: exact, equal but for white space, otherwise failing,
    and blank rows."""
    slp1 = slp1_column(F.col(text), script)
    back = rows.select(F.col(text).alias("t"), slp1.alias("s")).select("t", script_column(F.col("s"), script).alias("b"))
    blank, same = strip(F.col("t")) == "", F.col("t") == F.col("b")
    loose = F.regexp_replace("t", r"\s+", "") == F.regexp_replace("b", r"\s+", "")
    return back.agg(
        F.count("*").alias("n"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & same).alias("n_exact"), F.count_if(~blank & ~same & loose).alias("n_white_space"), F.count_if(~blank & ~same & ~loose).alias("n_failed")
    )


def slp1_coverage(rows: DataFrame, text: str = "text") -> DataFrame:
    """Transliterated rows that carry a nukta mark, and those with characters outside
    ASCII."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(text).rlike("[A-Za-z]0")).alias("n_nukta"), F.count_if(F.col(text).rlike(r"[^\x00-\x7F]")).alias("n_non_ascii"))


def text_extent(lines: DataFrame, order: str, most: int, text: str = "text") -> DataFrame:
    """Lines, characters and bytes of the first ``most`` non-blank lines."""
    head = lines.where(strip(F.col(text)) != "").orderBy(order).limit(most)
    return head.agg(F.count("*").alias("n_lines"), F.sum(F.length(text)).cast("long").alias("n_chars"), F.sum(F.octet_length(text)).cast("long").alias("n_bytes"))


def bytes_per_token(lines: DataFrame, pos: str, stride: int, tokens: Column, text: str = "text") -> DataFrame:
    """Bytes per token over every ``stride``-th line, an end token per line included."""
    part = lines.where(F.col(pos) % stride == 0)
    sums = part.agg(F.sum(F.octet_length(text) + 1).alias("n_bytes"), F.sum(tokens + 1).alias("n_tokens"), F.count("*").alias("n_lines"))
    return sums.withColumn("bytes_per_token", divide(F.col("n_bytes"), F.col("n_tokens")))


def source_at(rows: DataFrame, index: str, ranges: DataFrame) -> DataFrame:
    """The source whose half-open range holds each index.  Ranges follow each other,
    so the last start not above the index decides; there is a range per source."""
    starts = F.broadcast(ranges.agg(F.array_sort(F.collect_list(F.struct("start", "stop", "source"))).alias("r")))
    joined = rows.crossJoin(starts)  # one row of ranges
    hit = F.try_element_at(F.filter("r", lambda x: (x["start"] <= F.col(index)) & (F.col(index) < x["stop"])), F.lit(1))
    return joined.withColumn("source", hit["source"]).drop("r")


def chunk_text(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` UTF-8 bytes: cut after the last ``|`` or ``.`` that
    fits, else after the last space, else at the last whole character."""
    if limit < 4:
        raise ValueError("a piece holds at least one character")
    out = []
    while len(text.encode()) > limit:
        head = text.encode()[:limit].decode(errors="ignore")
        at = max(head.rfind("|"), head.rfind(".")) + 1 or head.rfind(" ") + 1 or len(head)
        out.append(head[:at].strip())
        text = text[at:].lstrip()
    return [p for p in [*out, text.strip()] if p]


def chunks(text: Column, limit: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, limit), na_action="ignore")

    return run(text)


def group_units(raw: str, split: str) -> list[list[str]]:
    """Split units under the raw units they came from, by letter counts."""
    def letters(unit: str) -> int:
        return sum(c.isalpha() for c in unit)

    out, units, at = [], split.split(), 0
    for unit in raw.split():
        held, count = [], 0
        while at < len(units) and (count < letters(unit) or not held):
            held.append(units[at])
            count += letters(units[at])
            at += 1
        out.append(held)
    if at < len(units) and out:
        out[-1].extend(units[at:])
    return out


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "_split$", "")


def eval_role(name: Column, in_domain: Sequence[str]) -> Column:
    return F.when(base_name(name).isin(*in_domain), "in_domain").otherwise("out_of_domain")


def vocab_label(vocab: Column) -> Column:
    """``64k`` for thousands (of 1,000 or 1,024), the number itself below."""
    return F.when(vocab < 1000, vocab.cast("string")).otherwise(F.concat(F.round(vocab / 1000).cast("int").cast("string"), F.lit("k")))


def unavailable_caption(missing: dict[str, str]) -> str:
    return f"Not available here: {', '.join(sorted(missing))}." if missing else ""


def throughput_choice(hours: float, most: float = 12.0) -> dict:
    """Whether a run fits the time at hand."""
    return {"hours": hours, "fits": hours <= most, "choice": "whole" if hours <= most else "sample"}
