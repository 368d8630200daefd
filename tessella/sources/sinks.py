"""Writers: lines, JSON lines, hash lists, manifests, strict results."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import manifest
from .readers import exclusion_list


def write_jsonl(rows: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; with an order, sorted over the files by range."""
    (rows.orderBy(order) if order else rows).write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str, text_col: str = "text") -> dict[str, Any]:
    """One line per row; returns the manifest of what is on disk."""
    rows.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
    back = rows.sparkSession.read.text(path).withColumnRenamed("value", "text")
    return manifest(back).first().asDict()


def is_current(spark: SparkSession, path: str, known: dict[str, Any]) -> bool:
    """Whether the lines on disk are the ones that a manifest describes."""
    try:
        back = spark.read.text(path).withColumnRenamed("value", "text")
        return manifest(back).first()["fingerprint"] == known.get("fingerprint")
    except Exception:  # noqa: BLE001 - nothing readable is not current
        return False


def replace_path(spark: SparkSession, staged: str, path: str) -> None:
    """A staged table in the place of another: the old one moves aside first and goes
    last, so a whole one is there under one of the names at any time."""
    jvm = spark.sparkContext._jvm
    new, target, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path, f"{path}.old"))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(aside, True)
    if files.exists(target):
        files.rename(target, aside)
    files.rename(new, target)
    files.delete(aside, True)


def write_exclusion_list(hashes: DataFrame, path: str, allow_shrink: bool = False) -> int:
    """Sorted distinct hashes under two comment lines: how many there are, and how many
    each source gave (a ``source`` column, if there is one) before they were made
    distinct.  A list that lacks hashes of the one on disk is refused unless it may
    shrink."""
    spark = hashes.sparkSession
    new = hashes.select("hash").distinct()
    try:
        old = exclusion_list(spark, path)
        old.limit(1).collect()
    except Exception:  # noqa: BLE001 - no list yet
        old = None
    if old is not None and not allow_shrink:
        lost = old.join(new, "hash", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"the new list lacks {[r[0] for r in lost]}")
    source = F.col("source") if "source" in hashes.columns else F.lit("all")
    given = {r["s"]: r["count"] for r in hashes.groupBy(source.alias("s")).count().collect()}
    n = new.count()
    header = [f"# {n} distinct sha256 hashes", "# " + ", ".join(f"{k}: {v}" for k, v in sorted(given.items(), key=str))]
    lines = spark.createDataFrame([(f" {i}", line) for i, line in enumerate(header)], "at string, value string").union(new.select("hash", "hash"))
    lines.orderBy("at").select("value").write.mode("overwrite").text(f"{path}.new")
    replace_path(spark, f"{path}.new", path)
    return n


def strict(value: Any) -> Any:
    """Values as strict JSON: NaN and infinities null, tuples lists, paths strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [strict(v) for v in value]
    return str(value) if isinstance(value, os.PathLike) else value


def write_results(results: dict[str, Any], folder: str, name: str = "results.json") -> Path:
    """Serialised first, then written, so a value that cannot be serialised leaves the
    old file as it was."""
    text = json.dumps(strict(results), indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False)
    target = Path(folder) / name
    target.parent.mkdir(parents=True, exist_ok=True)
    staged = target.with_suffix(".new")
    staged.write_text(text + "\n", encoding="utf-8")
    staged.replace(target)
    return target


def append_cache(rows: DataFrame, path: str) -> None:
    """Append ``key, input, output`` records."""
    rows.select("key", "input", "output").write.mode("append").json(path)
