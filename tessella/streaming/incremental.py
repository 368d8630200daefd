"""Incremental corpus filter on Structured Streaming (an addition: batch only before).

New lines pass the hash list and the duplicates of earlier lines as they arrive; the
state is one hash per kept line, and ends with the watermark if there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import sentence_hash, strip


def filter_stream(lines: DataFrame, exclusion: DataFrame, text_col: str = "text", time_col: str | None = None, late: str = "1 hour") -> DataFrame:
    """Lines that are not blank, not excluded and not seen before."""
    rows = lines.where(strip(F.col(text_col)) != "").withColumn("hash", sentence_hash(F.col(text_col)))
    rows = rows.join(exclusion.select("hash"), "hash", "left_anti")
    if time_col is None:
        return rows.dropDuplicates(["hash"]).drop("hash")
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["hash"]).drop("hash")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once Parquet files; one pass over what is there, then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def counts_by_window(events: DataFrame, time_col: str, window: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts per group, closed by the watermark."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window), *by).agg(F.count("*").alias("n"))
