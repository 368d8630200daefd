"""A training-corpus pipeline made of the ``llm`` operators.

Documents pass a quality classifier, near-duplicate removal, removal of repeated
passages, benchmark decontamination and mixing to source weights.  Every stage takes
``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's documents; all but the last return the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mix_flow, near_dup, quality_cnn, substring_dedup
from tessella.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the byte-level network takes for junk.  It learns from the table's
    labelled documents, which are the first stage's documents as well."""
    net = quality_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_cnn.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar five-word shingles stays."""
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside passages that a document with a smaller id has go."""
    kept = substring_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window like a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix reads, with the words it takes of each (``taken``;
    above ``size`` where a document is read again) and their source's target."""
    rows = docs.withColumn("sources", F.array("source"))
    mixed = mix_flow.mix(rows, mix_flow.round_robin, carry=["doc_id", "text", "lang", "source"])
    mixed = mixed.where("taken > 0")
    return mixed.select("doc_id", "text", "lang", "source", "size", F.col("targets")[0].alias("target"), "taken")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: The learned and the seeded stages have no SQL form; the tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
