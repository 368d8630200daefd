"""Ratio-of-sums metrics over long tables of counts.

Counts stay counts until the last step: a table ``keys..., idx, source, pivot`` is
summed by keys and then divided, so every metric is one hash aggregate with partial
sums, and never a mean of ratios.  Undefined values are NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measures import divide, length_bin
from ..functions.text import words

Counter = Callable[[Column], Column]


def unpivot_texts(pairs: DataFrame, keys: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Wide aligned texts as ``keys..., lang, text``."""
    return pairs.unpivot(list(keys), list(languages), "lang", "text")


def count_tokens(texts: DataFrame, arms: dict[str, Counter], text_col: str = "text") -> DataFrame:
    """Each row once per arm, with ``arm`` and ``n_tokens``; one pass over the texts."""
    held = F.array(*(F.struct(F.lit(name).alias("arm"), count(F.col(text_col)).cast("long").alias("n_tokens")) for name, count in arms.items()))
    return texts.select("*", F.explode(held).alias("__t")).select("*", "__t.arm", "__t.n_tokens").drop("__t")


def ratio_parts(source: DataFrame, pivot: DataFrame, on: Sequence[str], value: str = "n_tokens") -> DataFrame:
    """The 1:1 join of two aligned sides: ``on..., source, pivot``."""
    left = source.select(*on, F.col(value).alias("source"))
    return left.join(pivot.select(*on, F.col(value).alias("pivot")), list(on))


def check_aligned(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Raise if the sides do not have the same rows (an aggregate, not a collect)."""
    both = left.select(*on, F.lit(1).alias("l")).join(right.select(*on, F.lit(1).alias("r")), list(on), "full_outer")
    missing = both.where("l is null or r is null").limit(5).collect()
    if missing:
        raise ValueError(f"the sides are not aligned, for instance at {[tuple(r) for r in missing]}")


def pooled(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: the pooled ratio and its parts, with the mean and population
    deviation of the defined per-pair ratios."""
    each = divide(F.col("source"), F.col("pivot"))
    return parts.groupBy(*by).agg(
        divide(F.sum("source"), F.sum("pivot")).alias("value"),
        F.count("*").alias("n"),
        F.sum("source").alias("source_total"),
        F.sum("pivot").alias("pivot_total"),
        F.count_if(F.col("pivot") == 0).alias("n_undefined"),
        F.avg(each).alias("mean"),
        F.stddev_pop(each).alias("std"),
    )


def per_pair(parts: DataFrame) -> DataFrame:
    """Each pair's own ratio, NULL where the pivot has no tokens."""
    return parts.withColumn("ratio", divide(F.col("source"), F.col("pivot")))


def fertility(texts: DataFrame, by: Sequence[str], count: Counter, text_col: str = "text") -> DataFrame:
    """Tokens per word, each word encoded on its own.  ``n_undefined`` counts words
    without tokens; a group with texts but no words is undefined."""
    exploded = texts.select(*by, F.explode_outer(words(F.col(text_col))).alias("word"))
    n = F.when(F.col("word").isNotNull(), count(F.col("word")).cast("long"))
    return exploded.groupBy(*by).agg(
        divide(F.sum(n), F.count("word")).alias("value"), F.count("word").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("n_tokens"), F.count_if(n == 0).alias("n_undefined")
    )


def fertility_against(texts: DataFrame, by: Sequence[str], count: Counter, text_col: str, reference_col: str) -> DataFrame:
    """Tokens of a text's words over the words of another text."""
    tokens = F.aggregate(words(F.col(text_col)), F.lit(0).cast("long"), lambda acc, w: acc + count(w).cast("long"))
    rows = texts.select(*by, tokens.alias("t"), F.size(words(F.col(reference_col))).cast("long").alias("w"))
    return rows.groupBy(*by).agg(divide(F.sum("t"), F.sum("w")).alias("value"), F.sum("w").alias("n"), F.sum("t").alias("n_tokens"), F.count_if(F.col("w") == 0).alias("n_undefined"))


def compression(texts: DataFrame, by: Sequence[str], count: Counter, text_col: str = "text") -> DataFrame:
    """UTF-8 bytes per token over whole texts."""
    size, n = F.octet_length(F.col(text_col)), count(F.col(text_col)).cast("long")
    return texts.groupBy(*by).agg(
        divide(F.sum(size), F.sum(n)).alias("value"), F.count("*").alias("n"), F.sum(size).cast("long").alias("n_bytes"), F.sum(n).alias("n_tokens"), F.count_if(n == 0).alias("n_undefined")
    )


def decomposition(pairs: DataFrame, by: Sequence[str], count: Counter, source: str, pivot: str) -> DataFrame:
    """The token ratio as character ratio times density ratio (tokens per character),
    with the byte and byte-density ratios beside it."""
    def total(expr: Column) -> Column:
        return F.sum(expr.cast("long"))

    a, b = F.col(source), F.col(pivot)
    rows = pairs.groupBy(*by).agg(
        total(F.length(a)).alias("chars_source"),
        total(F.length(b)).alias("chars_pivot"),
        total(F.octet_length(a)).alias("bytes_source"),
        total(F.octet_length(b)).alias("bytes_pivot"),
        total(count(a)).alias("tokens_source"),
        total(count(b)).alias("tokens_pivot"),
    )
    c = F.col
    return rows.select(
        "*",
        divide(c("tokens_source"), c("tokens_pivot")).alias("tpp"),
        divide(c("chars_source"), c("chars_pivot")).alias("char_ratio"),
        divide(c("tokens_source") * c("chars_pivot"), c("chars_source") * c("tokens_pivot")).alias("density_ratio"),
        divide(c("bytes_source"), c("bytes_pivot")).alias("byte_ratio"),
        divide(c("tokens_source") * c("bytes_pivot"), c("bytes_source") * c("tokens_pivot")).alias("byte_density_ratio"),
    )


def by_length(parts: DataFrame, by: Sequence[str], words_col: str, edges: list[int], labels: list[str], sparse_below: int) -> DataFrame:
    """The pooled ratio per length bin of ``words_col``.  Bins without pairs are there
    too, undefined and sparse; the counts below the first edge go to the first bin."""
    spark = parts.sparkSession
    binned = parts.withColumn("bin", length_bin(F.col(words_col), edges).cast("int"))
    sums = binned.groupBy(*by, "bin").agg(
        F.count("*").alias("n_pairs"), divide(F.sum("source"), F.sum("pivot")).alias("value"), F.avg("source_words").alias("mean_source_words"), F.avg("pivot_words").alias("mean_pivot_words")
    )
    bins = spark.createDataFrame([(i, label) for i, label in enumerate(labels)], "bin int, label string")
    groups = parts.select(*by).distinct() if by else spark.range(1).select()
    every = groups.join(F.broadcast(bins), how="cross")
    out = every.join(sums, [*by, "bin"], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))
    return out.withColumn("sparse", F.col("n_pairs") < sparse_below)


def metric_summary(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``n`` (undefined counted), ``n_undefined``, mean and population deviation."""
    x = F.col(value)
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_undefined"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
