"""Places and running totals within groups, without one task per group.

Rows of a group fall into buckets by the first order column; buckets' totals, a few
rows, give what comes before each; only within a bucket are rows sorted.  Order columns
that are not numbers or times make one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKETS = 64


def _bucket(rows: DataFrame, column: str) -> Column:
    """The number of marks below the row's value; marks are approximate quantiles."""
    kind = rows.schema[column].dataType
    if not isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        return F.lit(0)
    value = F.unix_micros(F.col(column).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.DateType)) else F.col(column)
    marks = rows.select(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("m")).first()["m"]
    marks = sorted(set(marks or ()))
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < value)), F.lit(0)) if marks else F.lit(0)


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, before: str, total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows that come before in their
    group's order, and the group's whole sum."""
    sized = rows.withColumn("__amount", amount.cast("long")).withColumn("__bucket", _bucket(rows, order[0]))
    keys = [*by, "__bucket"]
    sums = sized.groupBy(*keys).agg(F.sum("__amount").alias("__held"))
    first = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__before", F.sum("__held").over(first) - F.col("__held"))
    if total:
        sums = sums.withColumn(total, F.sum("__held").over(Window.partitionBy(*by)))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sized.withColumn("__own", F.sum("__amount").over(own) - F.col("__amount"))
    sums = sums.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [inside[k].eqNullSafe(sums[f"__r_{k}"]) for k in keys])
    joined = inside.join(sums, same).withColumn(before, F.col("__before") + F.col("__own"))
    return joined.select(*rows.columns, before, *([total] if total else []))


def with_ranks(rows: DataFrame, by: Sequence[str], order: Sequence[str], rank: str, size: str | None = None) -> DataFrame:
    """``rows`` with their place in their group's order, from 1, and the group's size."""
    found = running_total(rows, by, order, F.lit(1), rank, size)
    return found.withColumn(rank, F.col(rank) + 1)
