"""How the supplied tables stand in for corpora, pairs, lines and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import with_ranks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A user turn and the assistant turn after it: ``conv_id, idx, src, pivot``."""
    c = table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("idx"), F.col("text").alias("src"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("idx"), F.col("text").alias("pivot"))
    return user.join(reply, ["conv_id", "idx"])


PAIRS = """pairs AS (SELECT u.conv_id, u.turn AS idx, u.text AS src, a.text AS pivot FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def parallel_documents(spark: SparkSession, d: str) -> DataFrame:
    """The k-th document of each other language beside the k-th English one."""
    docs = table(spark, d, "documents")
    ranked = with_ranks(docs.select("lang", "doc_id"), ["lang"], ["doc_id"], "k")
    # Only ids are ranked; texts join by id.
    pairs = ranked.where("lang != 'en'").join(ranked.where("lang = 'en'").select("k", F.col("doc_id").alias("other")), "k")
    english = docs.where("lang = 'en'").select(F.col("doc_id").alias("other"), F.col("text").alias("pivot"))
    return pairs.join(docs.where("lang != 'en'").select("doc_id", F.col("text").alias("src")), "doc_id").join(english, "other").select("lang", "k", "src", "pivot")


PARALLEL = """ranked AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
par AS (SELECT a.lang, a.k, a.text AS src, b.text AS pivot FROM ranked a JOIN ranked b ON a.k = b.k AND a.lang <> 'en' AND b.lang = 'en')"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines: ``source, source_rank, doc_id, n, text``; (doc_id, n) is the key."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    rank = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return docs.withColumn("source_rank", rank)


LINES = """lines AS (SELECT source, doc_id, n, t AS text, regexp_extract(source, '([0-9]+)', 1)::INTEGER AS source_rank
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n FROM documents))"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Events as training curves: ``arm, seed, step, value``."""
    events = table(spark, d, "events")
    rows = events.select(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("seed"), "ts", "event_id", "value")
    ranked = with_ranks(rows, ["arm", "seed"], ["ts", "event_id"], "step")
    return ranked.select("arm", "seed", F.col("step").cast("int").alias("step"), "value")


CURVES = """curves AS (SELECT event_type AS arm, user_id % 3 AS seed, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS step, value FROM events)"""
