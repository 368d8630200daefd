"""Readers: aligned text, JSON lines, CoNLL-U, documents, hash lists, caches, runs.

Row order that a reader must keep becomes a column.  Files whose lines are numbered
(aligned text, CoNLL-U) are read whole, a row each: these are evaluation sets and
chapters.  Corpora are read by lines or as Parquet, without numbers.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import pipe_fields, plain_cell, strip

SPLIT_RECORD = "index long, raw_deva string, raw_slp1 string, output_model string, output string"
GOLD_RECORD = (
    "sent_id string, text_id int, text_iast string, text_slp1 string, oracle_split_slp1 string, segment_offsets array<array<int>>, "
    "stem_offsets array<array<int>>, t5_marked string, t5seg_marked string, t6_marked string, n_words int, n_words_aligned int, human_verified boolean"
)
CACHE_RECORD = "key string, input string, output string"


class AlignmentError(ValueError):
    """Aligned sides do not have the same rows."""


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, idx, line`` of text files read whole; lines end at ``\\n`` only, and a
    final line end makes no extra line."""
    paths = [path] if isinstance(path, str) else list(path)
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    body = F.regexp_replace("value", "\n$", "")
    return whole.where("value != ''").select("file", F.posexplode(F.split(body, "\n")).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


def aligned_files(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, int]:
    """``idx`` and a column per language of one text file each, stripped; lines that
    are blank in some language go.  Returns the table and how many went."""
    sides = [numbered_lines(spark, path).select("idx", strip(F.col("line")).alias(lang)) for lang, path in paths.items()]
    counts = [side.count() for side in sides]
    if len(set(counts)) > 1:
        raise AlignmentError(f"line counts differ: {dict(zip(paths, counts))}")
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, "idx", "full_outer")
    keep = F.lit(True)
    for lang in paths:
        keep = keep & (F.col(lang) != "")
    kept = out.where(keep)
    order = Window.orderBy("idx")  # an evaluation set: renumbering needs its whole order
    kept = kept.withColumn("idx", F.row_number().over(order).cast("long") - 1)
    return kept, counts[0] - kept.count()


def aligned_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and a string column per language.  The first record names the languages;
    each record has exactly these, and ids are 0, 1, ... without a gap."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    first = lines.select(F.json_object_keys("value").alias("k")).first()
    if first is None:
        return spark.createDataFrame([], "id long")
    languages = [k for k in first["k"] if k != "id"]
    odd = lines.where(F.array_sort(F.json_object_keys("value")) != F.array_sort(F.array(*map(F.lit, first["k"])))).limit(1).count()
    if odd:
        raise AlignmentError("records have different languages")
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(x, T.StringType()) for x in languages)])
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    s = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    if s["n"] and (s["lo"] != 0 or s["hi"] + 1 != s["n"] or s["d"] != s["n"]):
        raise AlignmentError("ids are not dense")
    return rows


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are no records."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def split_records(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, SPLIT_RECORD)


def gold_records(spark: SparkSession, path: str) -> DataFrame:
    """Gold sentences; a null inner array is an unaligned word, not an empty one."""
    return jsonl(spark, path, GOLD_RECORD)


def split_cache(spark: SparkSession, path: str) -> DataFrame:
    """An append-only cache: the last record of a key stands.  One broken final line (a
    writer that died) is passed over; a broken line elsewhere is an error."""
    lines = numbered_lines(spark, path).where(strip(F.col("line")) != "")
    parsed = lines.select("file", "idx", F.from_json("line", CACHE_RECORD).alias("r"))
    broken = parsed.where(F.col("r.key").isNull() | F.col("r.output").isNull()).select("file", "idx")
    last = lines.groupBy("file").agg(F.max("idx").alias("last"))
    bad = broken.join(last, "file").where("idx != last").limit(1).count()
    if bad:
        raise ValueError("a cache line is broken before the end")
    good = parsed.where(F.col("r.output").isNotNull())
    return good.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.input", F.struct("file", "idx")).alias("input"), F.max_by("r.output", F.struct("file", "idx")).alias("output"))


def exclusion_list(spark: SparkSession, path: str) -> DataFrame:
    """Hashes, one a line; comments (``#``) and blank lines are passed over."""
    line = strip(F.col("value"))
    return spark.read.text(path).select(line.alias("hash")).where("hash != '' and not startswith(hash, '#')").distinct()


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines without their line ends."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r+$", "").alias("text")).where(strip(F.col("text")) != "")


def documents(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = ("text",)) -> DataFrame:
    """Parquet documents, only the columns asked for; empty texts go, other nulls are ''."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.parquet(*paths)
    picked = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if rows.schema[c].dataType.simpleString() == "string" else F.col(c) for c in columns))
    return picked.where(F.col("text") != "") if "text" in columns else picked


def resolve_files(files: Sequence[str], prefix: str, suffix: str = ".parquet", most: int | None = None) -> list[str]:
    """Whole files in their order: those outside the prefix are an error."""
    outside = [f for f in files if not (f.startswith(prefix) and f.endswith(suffix))]
    if outside:
        raise ValueError(f"not under {prefix}: {outside[:5]}")
    if most is not None and most <= 0:
        raise ValueError("at least one file")
    return list(files) if most is None else list(files)[:most]


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("n_bytes"))


def first_complete(readers: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The first source that reads without an error, with its name."""
    errors = []
    for name, reader in readers:
        try:
            return name, reader()
        except Exception as e:  # noqa: BLE001 - any failure moves on to the next source
            errors.append(f"{name}: {e}")
    raise RuntimeError("no source could be read: " + "; ".join(errors))


def tar_member_lines(spark: SparkSession, path: str, members: dict[str, str], sha256: str | None = None) -> DataFrame:
    """``idx`` and a column per language from members of a ``.tar.gz``, read in place;
    with a checksum the archive must match it."""
    import hashlib

    row = spark.read.format("binaryFile").load(path).select("content").first()
    data = bytes(row["content"])
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the archive's checksum does not match")
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        columns = {lang: tar.extractfile(name).read().decode().removesuffix("\n").split("\n") for lang, name in members.items()}
    if len({len(c) for c in columns.values()}) > 1:
        raise AlignmentError("members have different line counts")
    rows = [(i, *line) for i, line in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("idx", T.LongType()), *(T.StructField(x, T.StringType()) for x in columns)]))


def run_records(spark: SparkSession, path: str) -> DataFrame:
    """Results under ``track/size/arm/seedN/results.json``, with the path's parts."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(path)
    file = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+)/([^/]+)/seed(\d+)/results\.json$"
    parts = {name: F.regexp_extract(file, pattern, i + 1) for i, name in enumerate(("track", "size", "arm"))}
    return rows.select("*", *(c.alias(n) for n, c in parts.items()), F.regexp_extract(file, pattern, 4).cast("int").alias("seed"))


# --- CoNLL-U -----------------------------------------------------------------------


def _header(name: str) -> Column:
    return F.when(F.col("line").startswith(f"## {name}:"), F.regexp_replace(F.substring("line", len(name) + 5, 1 << 30), r"^\s+|\s+$", ""))


def conllu_tokens(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per token: its file, sentence, word and place, all by native windows.

    ``##`` headers hold for the sentences after them; a ``# text`` line opens a
    sentence; a range ``n-m`` joins tokens n to m to one word; empty nodes and short
    lines are passed over."""
    lines = numbered_lines(spark, path)
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = {n: F.last(_header(n), True).over(before) for n in ("text", "text_id", "chapter")}
    opens = F.col("line").startswith("# text = ")
    lines = lines.withColumns({**{f"h_{n}": c for n, c in heads.items()}, "sentence": F.sum(opens.cast("int")).over(before)}).where("sentence > 0")
    within = Window.partitionBy("file", "sentence").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("file", "sentence")
    cells = F.split("line", "\t")
    lines = lines.withColumns(
        {
            "sentence_text": F.max(F.when(opens, F.substring("line", 10, 1 << 30))).over(every),
            "sent_id": F.nullif(F.max(F.when(F.col("line").startswith("# sent_id = "), F.trim(F.substring("line", 13, 1 << 30)))).over(every), F.lit("")),
            "cells": F.when(~F.col("line").startswith("#") & (F.size(cells) >= 10), cells),
        }
    ).where("sent_id is not null")
    lines = lines.withColumn("id", F.col("cells")[0])
    range_end = F.when(F.col("id").rlike(r"^\d+-\d+$"), F.split("id", "-")[1].cast("int"))
    lines = lines.withColumns(
        {"range_end": F.last(range_end, True).over(within), "range_at": F.last(F.when(range_end.isNotNull(), F.col("idx")), True).over(within), "range_surface": F.last(F.when(range_end.isNotNull(), F.col("cells")[1]), True).over(within)}
    )
    tokens = lines.where(F.col("id").rlike(r"^\d+$")).withColumn("id", F.col("id").cast("int"))
    inside = F.coalesce(F.col("id") <= F.col("range_end"), F.lit(False))
    misc, feats = pipe_fields(F.col("cells")[9]), plain_cell(F.col("cells")[5])
    return tokens.select(
        "file",
        "sentence",
        "sent_id",
        "sentence_text",
        F.coalesce("h_text", F.lit("")).alias("text_name"),
        F.coalesce(F.when(F.col("h_text_id").rlike(r"^\d+$"), F.col("h_text_id").cast("int")), F.lit(-1)).alias("text_id"),
        F.coalesce("h_chapter", F.lit("")).alias("chapter"),
        F.when(inside, F.col("range_at")).otherwise(F.col("idx")).alias("word"),
        F.when(inside, F.col("range_surface")).otherwise(F.col("cells")[1]).alias("word_surface"),
        "id",
        F.col("cells")[1].alias("surface"),
        plain_cell(F.col("cells")[2]).alias("lemma"),
        plain_cell(F.col("cells")[3]).alias("upos"),
        feats.alias("feats"),
        F.coalesce(F.nullif(F.try_element_at(misc, F.lit("Unsandhied")), F.lit("")), F.col("cells")[1]).alias("unsandhied"),
        F.coalesce(F.try_element_at(misc, F.lit("UnsandhiedReconstructed")) == "True", F.lit(False)).alias("reconstructed"),
        F.coalesce(F.try_element_at(pipe_fields(feats), F.lit("Case")) == "Cpd", F.lit(False)).alias("is_cpd"),
    )


def conllu_sentences(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Sentences with nested words and tokens, in file order."""
    tokens = conllu_tokens(spark, path)
    keys = ["file", "sentence", "sent_id", "text_id", "text_name", "chapter", F.col("sentence_text").alias("text")]
    fields = ("id", "surface", "lemma", "upos", "feats", "unsandhied", "reconstructed", "is_cpd")
    words = tokens.groupBy(*keys, "word", "word_surface").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens"))
    held = F.array_sort(F.collect_list(F.struct("word", F.col("word_surface").alias("surface"), "tokens")))
    sentences = words.groupBy("file", "sentence", "sent_id", "text_id", "text_name", "chapter", "text").agg(held.alias("w"))
    plain = F.transform("w", lambda w: F.struct(w["surface"].alias("surface"), w["tokens"].alias("tokens")))
    return sentences.select("file", "sentence", "sent_id", "text_id", "text_name", "chapter", "text", plain.alias("words"))


def human_verified(words: Column) -> Column:
    """No token of the sentence was reconstructed."""
    return F.forall(F.flatten(F.transform(words, lambda w: w["tokens"])), lambda t: ~t["reconstructed"])


def text_matches_tokens(text: Column, words: Column) -> Column:
    """The sentence's text has exactly the token block's words."""
    return F.filter(F.split(text, " "), lambda w: w != "") == F.transform(words, lambda w: w["surface"])


def text_ids(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, text_id`` from the headers; -1 where it is missing or no number."""
    lines = numbered_lines(spark, path)
    value = F.max(_header("text_id")).alias("v")
    found = lines.groupBy("file").agg(value)
    return found.select("file", F.coalesce(F.when(F.col("v").rlike(r"^\d+$"), F.col("v").cast("int")), F.lit(-1)).alias("text_id"))
