"""Shared folders, written tables and small helpers of the ``llm`` operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: after every other id.
LAST_ID = (1 << 63) - 1
MB = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests on one machine) a temporary folder is taken.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame) -> DataFrame:
    """Narrow rows (a few numbers, no sets or texts) in fewer tasks, though never fewer
    than the cluster has cores: a Python worker per shuffle partition costs more than
    iterations' small rows do."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-partitions(df) // 16)))


def written(df: DataFrame, name: str, compact: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    It cuts the lineage: a lost executor costs a reread, not a recomputation.
    ``compact`` writes ``few`` files: iterations over narrow rows would else make a
    file per shuffle partition each round.  The path is added to ``scratch``, for
    tables that the caller deletes once its result no longer reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if compact:
        df = few(df)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a written table or archive folder, in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession, scratch: list[str]) -> None:
    """Delete the tables of ``scratch``."""
    while scratch:
        delete_path(spark, scratch.pop())


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]]):
    """A ``mapInArrow`` function from a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            yield from out if isinstance(out, list) else [out]

    return run


def id_key(column: str):
    """The id as a long; a null id sorts and compares as the largest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions: what the cluster's owner sized them to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


WORD_SQL = r"[^\x20\x09-\x0D]+"


def by_groups(keys: int, function):
    """A ``mapInArrow`` function over rows sorted by their first ``keys`` long
    columns: ``function(batch, starts)`` gets whole groups only.  A group is held
    in memory, so this is for groups whose size the caller has bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for i in range(keys):
                key = batch.column(i).to_numpy(zero_copy_only=False)
                change[1:] |= key[1:] != key[:-1]
            starts = np.flatnonzero(change)
            last = int(starts[-1])
            rest = batch.slice(last)
            if last:
                yield from function(batch.slice(0, last), starts[:-1])
        if rest is not None:
            yield from function(rest, np.zeros(1, np.int64))

    return run


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary array from the rows of a contiguous 2-d array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def rows_of_binary(column: pa.Array, kind, width: int) -> np.ndarray:
    """The reverse of ``binary_rows`` for ``width`` items of ``kind`` a row."""
    if not len(column):
        return np.empty((0, width), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), width)


def whole_copies(marks: DataFrame, doc: str, scratch: list[str] | None = None) -> DataFrame:
    """The rows of ``marks`` (``doc, h1, h2``, two hashes of a text) whose text a
    smaller document has.

    Only texts that occur twice are joined back.  Their table is written first, so that
    both sides of the join come from an exchange and Spark can split a hot text.
    """
    least = marks.groupBy("h1", "h2").agg(F.min(doc).alias("least"), F.max(doc).alias("most")).where("least < most")
    least = written(least.select("h1", "h2", "least"), "copies", compact=True, scratch=scratch)
    return marks.join(least.hint("merge"), ["h1", "h2"]).where(F.col("least") < F.col(doc)).drop("least")


def text_hashes(text: str = "text"):
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def hash_sample(rows: DataFrame, columns: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``columns``.

    Rows beyond twice the share that is needed are left out before the sort, so the
    last task of the top-n gets a bounded number of rows however many tasks feed it.
    """
    share = 2 * most / max(1, rows.count())
    h = F.xxhash64(*columns, F.lit(seed))
    if share < 1:
        rows = rows.where(h < F.lit(int(share * 2**64) - 2**63))
    return rows.orderBy(h, *columns).limit(most)


def keep_rows(docs: DataFrame, text_col: str, chosen: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``chosen`` marks, with all their columns, in one pass."""
    place = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(chosen(batch.column(place)), pa.bool_()))

    return docs.mapInArrow(by_batch(run), docs.schema)
