"""Ratios with undefined values: an undefined value is NULL, never 0 and never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """``a / b``; NULL where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def defined(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def length_bin(n: Column, edges: list[int]) -> Column:
    """Index of the last edge not above ``n``; below the first edge it is bin 0."""
    return F.greatest(sum((F.when(n >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1, F.lit(0))


def bin_labels(edges: list[int]) -> list[str]:
    return [f"{a}-{b - 1}" if b - 1 > a else str(a) for a, b in zip(edges, edges[1:])] + [f"{edges[-1]}+"]


def bits_per_char(nats: Column, chars: Column) -> Column:
    return divide(nats / F.lit(math.log(2)), chars)


def f1(matched: Column, predicted: Column, gold: Column) -> Column:
    """F1 from counts; 0 where precision and recall are both 0."""
    p, r = F.coalesce(divide(matched, predicted), F.lit(0.0)), F.coalesce(divide(matched, gold), F.lit(0.0))
    return F.coalesce(divide(2 * p * r, p + r), F.lit(0.0))


def verdict(low: Column, high: Column, centre: float = 1.0) -> Column:
    """Where an interval lies: ``above``, ``below`` or ``straddles``."""
    return F.when(low > centre, "above").when(high < centre, "below").when(low.isNull() | high.isNull(), None).otherwise("straddles")


def learning_rate(step: Column, peak: float, least: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to ``least``."""
    done = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(least + (peak - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * done)))
