"""Encoded corpora: written once, reused while nothing behind them changed, and read
back as a stream of token ids."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .bootstrap import hash_index
from .corpus import manifest
from .ranks import running_total, with_ranks
from .tokenizers import Arm, encode_corpus, vocab_dtype


def arm_fingerprint(arm: Arm, source_id: str, artifact: str | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
    """What tells one trained arm from another of the same name: where it is from, its
    vocabulary's size, and the sha256 of its file, if it has one."""
    digest = None
    if artifact and spark is not None:
        found = spark.read.format("binaryFile").load(artifact).select(F.sha2("content", 256).alias("d")).first()
        digest = found["d"] if found else None
    return {"arm": arm.name, "arm_source_id": source_id, "arm_vocab_size": arm.vocab_size or 0, "arm_sha256": digest}


def source_lines(lines: DataFrame, order: Sequence[str], text_col: str = "text") -> DataFrame:
    """Non-blank lines with ``line``, their place from 0."""
    kept = lines.where(strip(F.col(text_col)) != "")
    return with_ranks(kept, [], order, "line").withColumn("line", F.col("line") - 1)


def _wanted(identity: dict[str, Any], eos_id: int, found: dict[str, Any]) -> dict[str, Any]:
    return {**identity, "eos_id": eos_id, "source_fingerprint": found["fingerprint"]}


def load_metadata(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The metadata of an encoded corpus; None where it cannot be read."""
    try:
        return json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()["value"])
    except Exception:  # noqa: BLE001 - what cannot be read is not there
        return None


def ensure_encoded(lines: DataFrame, order: Sequence[str], arm: Arm, identity: dict[str, Any], path: str, eos_id: int, text_col: str = "text") -> tuple[dict[str, Any], list[str]]:
    """The corpus encoded at ``path``: its metadata, and the keys that differed from
    what was there (none where it is reused, ``["absent"]`` where there was nothing)."""
    spark = lines.sparkSession
    plain = lines.where(strip(F.col(text_col)) != "")
    found = manifest(plain, text_col=text_col).first().asDict()
    wanted, known = _wanted(identity, eos_id, found), load_metadata(spark, path)
    changed = ["absent"] if known is None else [k for k, v in wanted.items() if known.get(k) != v]
    if not changed:
        return known, changed
    vocab = max(arm.vocab_size or 0, eos_id + 1)
    encoded = encode_corpus(source_lines(lines, order, text_col), arm.ids(F.col(text_col)), eos_id, vocab, "line")
    encoded.write.mode("overwrite").parquet(f"{path}/ids")
    sums = open_lines(spark, path).agg(F.sum(F.size("ids")).cast("long").alias("n")).first()
    meta = {**wanted, "dtype": vocab_dtype(vocab), "n_tokens": sums["n"] or 0, "n_lines": found["n_lines"], "n_chars": found["n_chars"] or 0, "n_bytes": found["n_bytes"] or 0, "logical_vocab": vocab}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return meta, changed


def open_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, ids`` of an encoded corpus."""
    return spark.read.schema("line long, ids array<int>").parquet(f"{path}/ids")


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``pos, id``: the corpus as one stream of ids."""
    placed = running_total(open_lines(spark, path), [], ["line"], F.size("ids"), "at")
    return placed.select(F.posexplode("ids").alias("i", "id"), "at").select((F.col("at") + F.col("i")).alias("pos"), "id")


def random_windows(spark: SparkSession, path: str, block: int, windows: int, seed: int) -> DataFrame:
    """``window, start, x, y``: windows of ``block`` ids that begin at seeded places,
    with replacement, and the same one id on.  A window meets the lines it reads through
    stretches of ``block`` positions, so no row meets all windows."""
    meta = load_metadata(spark, path)
    n = meta["n_tokens"] if meta else 0
    if n < block + 1:
        raise ValueError(f"{n} tokens hold no window of {block} and one more")
    drawn = spark.range(windows).select(F.col("id").alias("window"), hash_index(F.lit(seed), F.col("id"), F.lit(n - block)).alias("start"))
    wanted = drawn.select("window", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + block) / block))).alias("stretch"))
    tokens = open_tokens(spark, path).withColumn("stretch", F.floor(F.col("pos") / block))
    read = wanted.join(tokens, "stretch").where(F.col("pos").between(F.col("start"), F.col("start") + block))
    held = read.groupBy("window", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("held"))
    ids = F.transform("held", lambda t: t["id"])
    return held.select("window", "start", F.slice(ids, 1, block).alias("x"), F.slice(ids, 2, block).alias("y"))


def length_batches(rows: DataFrame, idx: str, size: int, text_col: str = "text") -> DataFrame:
    """``rows`` with ``batch``: batches of ``size`` rows, the longest texts first, equal
    ones in their order.  ``idx`` restores the order."""
    sized = rows.withColumn("__minus", -F.length(text_col))
    ranked = with_ranks(sized, [], ["__minus", idx], "__rank")
    return ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__minus", "__rank")
