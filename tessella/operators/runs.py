"""Aggregation of training runs, language-model scores and report queries."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..functions.measures import divide, verdict


def seed_stats(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation of the defined values; the deviation is NULL below two."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_runs"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def best(rows: DataFrame, by: Sequence[str], value: str, step: str) -> DataFrame:
    """The smallest value, and the earliest step that has it."""
    at = F.min(F.struct(F.col(value).alias("value"), F.col(step).alias("step"))).alias("b")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(at).select(*by, F.col("b.value").alias("best"), F.col("b.step").alias("best_step"))


def first_crossing(rows: DataFrame, by: Sequence[str], value: str, step: str, threshold: Column) -> DataFrame:
    """The first step at which the value is at or below the threshold."""
    at = F.min(F.struct(F.col(step).alias("step"), F.col(value).alias("value"))).alias("c")
    return rows.where(F.col(value) <= threshold).groupBy(*by).agg(at).select(*by, F.col("c.step").alias("crossing_step"), F.col("c.value").alias("crossing_value"))


def mean_curve(rows: DataFrame, by: Sequence[str], step: str, counters: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Across seeds per step: counters' means cut to whole numbers, values' means."""
    return rows.groupBy(*by, step).agg(F.count("*").alias("n"), *(F.avg(c).cast("long").alias(c) for c in counters), *(F.avg(v).alias(v) for v in values))


def last_and_first(rows: DataFrame, by: Sequence[str], value: str, step: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"), F.min(value).alias("lowest"), F.count("*").alias("n"))


def until(rows: DataFrame, step: str, last: int) -> DataFrame:
    return rows.where(F.col(step) <= last)


def first_defined(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The first value that is there, in order."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, order).alias(value))


def unigram_bits(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bits per character of ``token, c`` rows under their own unigram distribution."""
    total = counts.groupBy(*by).agg(F.sum("c").alias("total"))
    nats = F.sum(-F.col("c") * F.ln(F.col("c") / F.col("total")))
    sums = counts.join(total, list(by)).groupBy(*by).agg(F.sum("c").alias("n_tokens"), nats.alias("total_nats"), F.sum(F.col("c") * F.length("token")).alias("chars"))
    return sums.withColumn("bits_per_char", measures.bits_per_char(F.col("total_nats"), F.col("chars")))


def bits_per_char(total_nats: float, chars: int) -> float:
    """As a number, for one text; errors instead of undefined values."""
    if chars <= 0 or total_nats < 0 or not math.isfinite(total_nats):
        raise ValueError("bits per character need characters and a finite loss")
    return total_nats / math.log(2) / chars


def token_budget(max_bytes: Column, bytes_per_token: Column) -> Column:
    """Whole tokens in a byte budget, halves to the even number."""
    return F.bround(max_bytes / bytes_per_token).cast("long")


def plan_table(rows: DataFrame, track: str, value: str, rate: float) -> DataFrame:
    """Runs, tokens and hours per track with a grand total (a rollup)."""
    return rows.rollup(track).agg(F.count("*").alias("n_runs"), F.sum(value).alias(value), (F.sum(value) / F.lit(rate * 3600)).alias("hours"))


def plan_hash(plan: dict) -> str:
    return hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()


def pending(planned: DataFrame, complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs that are not complete under the same plan."""
    return planned.join(complete.select(*keys), list(keys), "left_anti")


def gradient_flips(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many groups change the sign of last minus first dense bin between two
    stratifications (``by..., bin, value, sparse``)."""
    def sign(strata: DataFrame, name: str) -> DataFrame:
        dense = strata.where("value is not null and not sparse")
        ends = dense.groupBy(*by).agg((F.max_by("value", "bin") - F.min_by("value", "bin")).alias("g"), F.count("*").alias("k"))
        return ends.where("k > 1").select(*by, F.signum("g").alias(name))

    both = sign(left, "a").join(sign(right, "b"), list(by))
    return both.agg(F.count_if(F.col("a") * F.col("b") < 0).alias("n_flips"), F.count("*").alias("n_groups"))


def dense_gap(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Over bins dense on both sides: how often the left value is below the right, and
    the smallest and largest gap."""
    a = left.where("value is not null and not sparse").select(*by, "bin", F.col("value").alias("l"))
    b = right.where("value is not null and not sparse").select(*by, "bin", F.col("value").alias("r"))
    gap = F.col("r") - F.col("l")
    return a.join(b, [*by, "bin"]).agg(F.count_if(gap > 0).alias("n_below"), F.count("*").alias("n_bins"), F.min(gap).alias("least_gap"), F.max(gap).alias("most_gap"))


def busiest_bin(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """The jointly dense bin with most pairs; the smaller bin on ties."""
    a = left.where("value is not null and not sparse").select(*by, "bin", F.col("n_pairs").alias("a"))
    b = right.where("value is not null and not sparse").select(*by, "bin", F.col("n_pairs").alias("b"))
    n = F.col("a") + F.col("b")
    top = F.max(F.struct(n.alias("n"), (-F.col("bin")).alias("back"))).alias("t")
    return a.join(b, [*by, "bin"]).groupBy(*by).agg(top).select(*by, (-F.col("t.back")).alias("bin"), F.col("t.n").alias("n_pairs"))


def weighted_mean(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*by).agg(divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def progression(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Values in order, as one array per group (groups of a report, not of a corpus)."""
    held = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.transform(held, lambda x: x[value]).alias("values"))


def interval_verdicts(rows: DataFrame, centre: float = 1.0) -> DataFrame:
    return rows.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high"), centre))


def check_pairs(pairs: DataFrame, arms: DataFrame, same: Sequence[str]) -> DataFrame:
    """Arm pairs (``first, second``) with ``problem``: an arm that is missing, or a
    property in which matched arms differ."""
    a = arms.select(F.col("arm").alias("first"), *(F.col(c).alias(f"a_{c}") for c in same), F.lit(True).alias("has_a"))
    b = arms.select(F.col("arm").alias("second"), *(F.col(c).alias(f"b_{c}") for c in same), F.lit(True).alias("has_b"))
    joined = pairs.join(F.broadcast(a), "first", "left").join(F.broadcast(b), "second", "left")  # a row per arm
    problem = F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), F.lit("missing"))
    for c in same:
        problem = problem.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(f"differs in {c}"))
    return joined.select("first", "second", problem.alias("problem"))


def enumerate_runs(tracks: DataFrame, sizes: DataFrame, arms: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every track, size, arm and seed: dimensions of a plan, a few rows each."""
    return tracks.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(arms)).crossJoin(F.broadcast(seeds))


def parse_arm(name: Column) -> Column:
    """``family_algorithm_vocab[_variant]`` names as a struct."""
    parts = F.split(name, "_")
    variant = F.regexp_extract(name, "_(split|raw|slp1)$", 1)
    plain = F.split(F.regexp_replace(name, "_(split|raw|slp1)$", ""), "_")
    return F.struct(
        F.element_at(parts, 1).alias("family"), F.try_element_at(plain, F.lit(2)).alias("algorithm"), F.element_at(plain, -1).alias("vocab"), F.when(variant == "", "original").otherwise(variant).alias("variant")
    )
