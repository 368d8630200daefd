"""Configurations, and corpora by the names that they give."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers

Loader = Callable[[SparkSession, dict[str, Any]], DataFrame]


def load_config(path: str) -> dict[str, Any]:
    """A mapping from a YAML file, or from a JSON one where YAML cannot be read."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML needs its library; write the configuration as JSON") from missing
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def ordered_text(rows: DataFrame, field: str, key: str = "id") -> DataFrame:
    """``key`` and the field as ``text``, by the key: the order that rows are read in."""
    return rows.select(key, F.col(field).alias("text")).orderBy(key)


def by_language(rows: DataFrame, language: str, script: str, columns: tuple[str, str] = ("iso_639_3", "iso_15924")) -> DataFrame:
    """A data set's rows of one language and script."""
    return rows.where((F.col(columns[0]) == language) & (F.col(columns[1]) == script))


def _parquet(spark: SparkSession, entry: dict[str, Any]) -> DataFrame:
    rows = spark.read.parquet(entry["path"])
    for column, value in entry.get("where", {}).items():
        rows = rows.where(F.col(column) == value)
    return rows.select(*entry["columns"]) if "columns" in entry else rows


LOADERS: dict[str, Loader] = {
    "aligned_files": lambda spark, entry: readers.aligned_files(spark, entry["paths"])[0],
    "aligned_jsonl": lambda spark, entry: readers.aligned_jsonl(spark, entry["path"]),
    "jsonl": lambda spark, entry: readers.jsonl(spark, entry["path"], entry.get("schema")),
    "lines": lambda spark, entry: readers.corpus_lines(spark, entry["path"]),
    "parquet": _parquet,
}


def load_corpus(spark: SparkSession, entry: dict[str, Any]) -> DataFrame:
    """The corpus that a configuration's entry names: ``loader`` and its arguments."""
    name = entry.get("loader")
    if name not in LOADERS:
        raise ValueError(f"no loader {name!r}; there are {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, entry)
