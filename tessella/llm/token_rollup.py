"""Token counts: delta-maintained rollups (operator 8).

A store keeps signed counts.  A batch of inserts, deletes and revised counts becomes
signed rows: an insert adds a document and its tokens, a delete takes both away, and
a revision adds the difference to the count on record.  The batch's rows go to the
ledger (by document) and, summed by source, language and tokenizer version, to the
deltas; totals are the plain sum of all committed batches' deltas, whatever their
order, and a batch is never read again to maintain them.

Commits are idempotent.  A batch writes its ledger and deltas into folders of its own
name and is committed by a marker, a one-row table of its own, written last; readers
see marked batches only.  A
batch that died half-way is overwritten by its next attempt; a batch that is already
marked changes nothing.  All files are written and read by Spark, so any shared file
system serves.

Defined cases: deletes and revisions of documents that are not on record (with that
version) are ignored; a delete or revision of a document that stands several times
applies to each; null sources, languages and ids are values of their own; null texts
have no tokens; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import path_exists

#: Characters that are encoded at once, at least.
PART = 1 << 16
KEYS = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"
DELTAS = "source string, lang string, version string, docs long, tokens long"

#: How a byte-level BPE vocabulary cuts texts before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RollupStore:
    """Totals by source, language and tokenizer version under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return batch in self.batches()

    def batches(self) -> list[str]:
        """Names of the committed batches (a row per batch, never per document).  A
        marker counts by its row, which is there once its file is whole."""
        if not path_exists(self.spark, f"{self.path}/commits"):
            return []
        names = self.spark.read.schema("name string").parquet(f"{self.path}/commits").select("name").collect()
        return sorted(r["name"] for r in names)

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [self._folder(kind, b) for b in self.batches()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def ledger(self) -> DataFrame:
        """What is on record: a row per document and version that still stands."""
        keys = ["doc_id", *KEYS]
        sums = self._read("ledger", LEDGER).groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs > 0")

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens``; groups that are empty again go."""
        sums = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 or tokens != 0")

    def commit(self, batch: str, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Commit one batch; false if it was committed before.

        ``inserts``: ``doc_id, source, lang, version, tokens``.  ``deletes``:
        ``doc_id, version``.  ``revisions``: ``doc_id, version, tokens`` (per
        document).  Deletes and revisions refer to what earlier batches recorded; a
        document that one batch both deletes and revises is deleted.
        """
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch's name has letters, digits, '-', '_' and '.' only")
        if self.committed(batch):
            return False
        parts = []
        if inserts is not None:
            one = F.lit(1).cast("long").alias("docs")
            parts.append(inserts.select("doc_id", *KEYS, one, F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("tokens")))
        standing = self.ledger() if deletes is not None or revisions is not None else None
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
            match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
            parts.append(standing.join(gone, match, "left_semi").select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
        if revisions is not None:
            new = revisions.groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(F.max("tokens").cast("long").alias("new"))
            match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))
            changed = standing.join(new, match)
            if deletes is not None:
                changed = changed.drop("d", "v").join(gone, match, "left_anti")
            parts.append(changed.select("doc_id", *KEYS, F.lit(0).cast("long").alias("docs"), (F.col("new") * F.col("docs") - F.col("tokens")).alias("tokens")))
        rows = self.spark.createDataFrame([], LEDGER)
        for part in parts:
            rows = rows.union(part)
        folder = self._folder("ledger", batch)
        rows.write.mode("overwrite").parquet(folder)
        sums = self.spark.read.schema(LEDGER).parquet(folder).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(self._folder("deltas", batch))
        marker = self.spark.createDataFrame([(batch,)], "name string").coalesce(1)
        marker.write.mode("overwrite").parquet(self._folder("commits", batch))
        return True


def byte_bpe(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts by the byte-level BPE ranks in ``path``."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # A very long run without a break would cost the square of its length.
    return lambda texts: [sum(len(encoding.encode_ordinary(part)) for part in _parts(t)) for t in texts]


def _parts(text: str) -> Iterator[str]:
    """The text in stretches whose tokens are the whole text's: cut before a line end
    that a word follows at once.  The pattern never joins that line end with the white
    space before it, nor with the word."""
    start = 0
    while len(text) - start > PART:
        stop = text.find("\n", start + PART)
        while 0 <= stop < len(text) - 1 and text[stop + 1].isspace():
            stop = text.find("\n", stop + 1)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:]


def count_tokens(docs: DataFrame, tokenizers: dict[str, Callable[[], Callable[[list[str]], list[int]]]], columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with ``version, tokens``: a row per tokenizer.

    ``tokenizers`` maps a version's name to a function that loads its counter; it is
    loaded once in each Python worker's task."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {name: load() for name, load in tokenizers.items()}
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                texts = [t or "" for t in part.column(len(columns)).to_pylist()]
                for name, counter in counters.items():
                    counted = pa.array(np.array(counter(texts), np.int64))
                    yield pa.record_batch([*(part.column(i) for i in range(len(columns))), pa.array([name] * len(texts)), counted], names=[*columns, "version", "tokens"])

    return docs.select(*columns, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{fields}, version string, tokens long")
