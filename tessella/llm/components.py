"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on the smallest of itself and all neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("least"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return larger.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, hang on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least.hint("merge"), "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.union(least)


def components(edges: DataFrame, name: str, scratch: list[str]) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``u`` and ``v``); the
    root is the component's smallest node.

    Self loops and repeated edges are allowed; null ends are dropped.  A node's
    smallest neighbour is an aggregate with partial sums, and it meets the node's edges
    in a join that Spark can split, so a node that very many hang on fills no task.
    Each step is written to the shared folder, and rounds end when the edges stay the
    same.  The step before is deleted; the last one's path goes to ``scratch``.
    """
    spark, before, now = edges.sparkSession, [], []
    edges = edges.where("u is not null and v is not null and u != v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, compact=True, scratch=now)
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        for star in (_large_star, _small_star):
            before, now = now, []
            edges = written(star(edges).distinct(), name, compact=True, scratch=now)
            clear(spark, before)
    scratch.extend(now)
    # Stars now: every u hangs on its root.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
