"""Renyi entropy and efficiency of token distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import divide


def unigram_counts(texts: DataFrame, by: Sequence[str], tokens) -> DataFrame:
    """``by..., token, c`` from an expression that gives each row's tokens."""
    return texts.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("c"))


def renyi(counts: DataFrame, by: Sequence[str], alphas: Sequence[float], vocab_size: int | None = None) -> DataFrame:
    """Per group and alpha: entropy in bits, and the efficiency against log2 of the
    observed types (and of ``vocab_size``).  One type alone has efficiency undefined.

    Two aggregates of the count table: the totals, and all alphas' sums at once.
    """
    if any(a <= 0 or a == 1 for a in alphas):
        raise ValueError("alpha is positive and not 1")
    totals = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    share = F.col("c") / F.col("total")
    joined = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))
    sums = joined.groupBy(*by).agg(F.first("total").alias("n"), F.count("*").alias("n_types"), *(F.sum(F.pow(share, F.lit(float(a)))).alias(f"s{i}") for i, a in enumerate(alphas)))
    held = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), (F.log2(F.col(f"s{i}")) / F.lit(1.0 - a)).alias("entropy_bits")) for i, a in enumerate(alphas)))
    out = sums.select(*by, "n", "n_types", F.explode(held).alias("h")).select(*by, "n", "n_types", "h.*")
    out = out.withColumn("efficiency", divide(F.col("entropy_bits"), F.log2(F.col("n_types").cast("double"))))
    if vocab_size is not None:
        out = out.withColumn("efficiency_nominal", F.col("entropy_bits") / F.log2(F.lit(float(vocab_size))))
    return out
