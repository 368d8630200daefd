"""Cubes over arms, pivots and variants, and the lookups that reports make in them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap, ratios
from .morphology import boundary_scores


def take_rows(rows: DataFrame, idx: str, wanted: DataFrame, at: str = "at", index: str = "index") -> DataFrame:
    """The rows at the indices of ``wanted`` (``at``: place in the result); an index may
    come again, and one without a row is an error."""
    joined = wanted.select(at, F.col(index).alias("__i")).join(rows.withColumnRenamed(idx, "__i").withColumn("__there", F.lit(True)), "__i", "left")
    known = F.when(F.col("__there"), F.col("__i")).otherwise(F.raise_error(F.concat(F.lit("no row at index "), F.col("__i").cast("string"))))
    return joined.withColumn(idx, known).drop("__i", "__there")


def pivots_for(arms: DataFrame, control: DataFrame, deployed: str) -> DataFrame:
    """``arm, role, pivot``: the arm's matched control, where it has one, and the
    deployed pivot that all arms share."""
    first = arms.join(control.select("arm", F.col("pivot")), "arm").select("arm", F.lit("english_control").alias("role"), "pivot")
    return first.union(arms.select("arm", F.lit("deployed").alias("role"), F.lit(deployed).alias("pivot")))


def tpp_by_role(counts_source: DataFrame, counts_pivot: DataFrame, roles: DataFrame, corpus: Sequence[str], idx: str) -> DataFrame:
    """Pooled ratios for each arm and role.  ``counts_*``: ``corpus..., idx, arm, n``.
    Roles are a few rows and multiply the source's rows by roles, not by pivots."""
    source = counts_source.join(F.broadcast(roles), "arm").select(*corpus, idx, "arm", "role", "pivot", F.col("n").alias("source"))
    pivot = counts_pivot.select(*corpus, idx, F.col("arm").alias("pivot"), F.col("n").alias("__n"))
    parts = source.join(pivot, [*corpus, idx, "pivot"]).withColumnRenamed("pivot", "pivot_arm").withColumnRenamed("__n", "pivot")
    return ratios.pooled(parts, [*corpus, "arm", "role", "pivot_arm"])


def tpp_deltas(parts: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], order: Sequence[str], replicates: int, ci: float = 0.95) -> DataFrame:
    """For each pair of arms the difference of their ratios, and its interval over one
    set of draws.  ``parts``: ``by..., order..., arm, source, pivot``."""
    made = []
    for first, second in pairs:
        a = parts.where(F.col("arm") == first).select(*by, *order, F.col("source").alias("a_source"), F.col("pivot").alias("a_pivot"))
        b = parts.where(F.col("arm") == second).select(*by, *order, F.col("source").alias("b_source"), F.col("pivot").alias("b_pivot"))
        made.append(a.join(b, [*by, *order]).withColumn("pair", F.lit(f"{first}-{second}")))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    keys = [*by, "pair"]
    value = rows.groupBy(*keys).agg((F.try_divide(F.sum("a_source"), F.sum("a_pivot")) - F.try_divide(F.sum("b_source"), F.sum("b_pivot"))).alias("delta"))
    return value.join(bootstrap.delta_interval(rows, keys, order, replicates, ci), keys)


def f1_deltas(words: DataFrame, by: Sequence[str], first: str, second: str, gold: str, tolerances: Sequence[int]) -> DataFrame:
    """The difference of two predictions' pooled F1 for each group and tolerance."""
    made = []
    for tolerance in tolerances:
        a = boundary_scores(words, by, first, gold, tolerance).select(*by, F.col("f1").alias("f1_first"))
        b = boundary_scores(words, by, second, gold, tolerance).select(*by, F.col("f1").alias("f1_second"))
        made.append(a.join(b, list(by)).select(*by, F.lit(tolerance).alias("tolerance"), "f1_first", "f1_second", (F.col("f1_first") - F.col("f1_second")).alias("delta")))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def length_pairs(arms: DataFrame, pivots: DataFrame, controlled: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """``arm, pivot, variant``: each arm beside every English pivot in each of its
    variants, and the controlled pairs; without repeats or arms to skip."""
    every = arms.crossJoin(F.broadcast(pivots))  # two small lists of names
    rows = every.select("arm", "pivot", "variant").union(controlled.join(arms, "arm").select("arm", "pivot", "variant"))
    return rows.where(~F.col("arm").isin(*skip)).distinct() if skip else rows.distinct()


def variants_for(families: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """``family, variant``; a family without a list is an error."""
    known = F.create_map(*(x for k, v in variants.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    held = F.coalesce(F.try_element_at(known, F.col("family")), F.raise_error(F.concat(F.lit("no variants for "), F.col("family"))))
    return families.select("family", F.explode(held).alias("variant"))


def ordered_union(*names: Sequence[str]) -> list[str]:
    """All names, each where it first occurs."""
    return list(dict.fromkeys(x for part in names for x in part))


def size_matched(arms: DataFrame, wanted: Column, size: Column, tolerance: float = 0.0) -> DataFrame:
    """``arms`` with whether a vocabulary has the size that was asked for."""
    return arms.withColumn("size_matched", F.abs(size - wanted) <= wanted * F.lit(tolerance))


def undersized(arms: DataFrame, wanted: str, size: str) -> DataFrame:
    """Arms whose training stopped short of the vocabulary that was asked for."""
    return arms.where(F.col(size) < F.col(wanted))


def reported_pairs(pairs: DataFrame, arms: DataFrame) -> DataFrame:
    """Pairs of which both arms are there and as large as asked for."""
    good = arms.where("size_matched").select("arm")
    return pairs.join(good.withColumnRenamed("arm", "first"), "first", "left_semi").join(good.withColumnRenamed("arm", "second"), "second", "left_semi")


def lookup(results: DataFrame, keys: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``keys`` with their value; a key without a result is an error."""
    found = results.select(*on, F.col(value).alias("__v"), F.lit(True).alias("__there"))
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in on))
    held = F.when(F.col("__there"), F.col("__v")).otherwise(F.raise_error(F.concat(F.lit("no result for "), name)).cast(results.schema[value].dataType))
    return keys.join(found, list(on), "left").withColumn(value, held).drop("__v", "__there")


def dig(json_text: Column, *path: str) -> Column:
    """The value at a path of a JSON text, as text; null where there is none."""
    return F.get_json_object(json_text, "$" + "".join(f"['{p}']" for p in path))


def interval_row(json_text: Column, *path: str) -> Column:
    """Value and bounds of an interval record at a path."""
    return F.struct(*(dig(json_text, *path, k).cast("double").alias(k) for k in ("value", "ci_low", "ci_high")))


def mean_units(rows: DataFrame, by: Sequence[str], units: Column) -> DataFrame:
    """Mean number of units of a text; null without texts."""
    return rows.groupBy(*by).agg(F.avg(units).alias("mean_units"), F.count("*").alias("n"))


def split_manifest(records: DataFrame, by: Sequence[str], raw: str, out: str, units: Callable[[Column], Column]) -> DataFrame:
    """What a split corpus holds: records, changed ones, units and characters on both
    sides, and a fingerprint of the outputs that does not depend on their order."""
    a, b = F.col(raw), F.col(out)
    print_of = F.conv(F.substring(F.sha2(b, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return records.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        F.count_if(a != b).alias("n_changed"),
        F.sum(units(a)).cast("long").alias("units_raw"),
        F.sum(units(b)).cast("long").alias("units_out"),
        F.sum(F.length(a)).cast("long").alias("chars_raw"),
        F.sum(F.length(b)).cast("long").alias("chars_out"),
        F.md5(F.sum(print_of).cast("string")).alias("fingerprint"),
    )


def length_report(rows: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Number, mean, median, 95th percentile and most of a size: a benchmark's inputs."""
    held = F.percentile(size, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(size).alias("mean"), held[0].alias("median"), held[1].alias("p95"), F.max(size).alias("most"))


def lockstep(rows: DataFrame, reason: Column, raw: str, split: str, by: Sequence[str]) -> DataFrame:
    """Per group and side what two parallel corpora hold that keep exactly the same
    rows: those that pass on the raw side and are not blank on either."""
    plain = (F.trim(F.col(raw)) != "") & (F.trim(F.col(split)) != "")
    kept = rows.where(reason.isNull() & plain)
    sides = F.array(F.struct(F.lit("raw").alias("side"), F.col(raw).alias("line")), F.struct(F.lit("split").alias("side"), F.col(split).alias("line")))
    both = kept.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    return both.groupBy(*by, "side").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.sum(F.octet_length("line")).cast("long").alias("n_bytes"))


def alignment_check(rows: DataFrame, records: DataFrame, idx: Sequence[str], raw: str, record_raw: str) -> DataFrame:
    """How many rows a parallel file lacks, has too many, or has made of another text:
    all zero where both sides are in step, sentence by sentence."""
    left, right = rows.select(*idx, F.col(raw).alias("__a"), F.lit(1).alias("__l")), records.select(*idx, F.col(record_raw).alias("__b"), F.lit(1).alias("__r"))
    joined = left.join(right, list(idx), "full_outer")
    there = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return joined.agg(
        F.count_if(there).alias("n_aligned"), F.count_if(F.col("__r").isNull()).alias("n_missing"), F.count_if(F.col("__l").isNull()).alias("n_extra"), F.count_if(there & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_differing")
    )


def language_code(code: Column) -> Column:
    """``xxx_Yyyy`` as language and script; another form is an error."""
    form = code.rlike("^[a-z]{2,3}_[A-Z][a-z]{3}$")
    return F.when(form, F.struct(F.split_part(code, F.lit("_"), F.lit(1)).alias("language"), F.split_part(code, F.lit("_"), F.lit(2)).alias("script"))).otherwise(F.raise_error(F.concat(F.lit("no language code: "), code)))
