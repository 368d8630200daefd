"""Registered queries of readers, writers, encoded corpora and report cubes.

Queries of files write a table's rows in the format at hand to the shared folder, read
them back, and return what came back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, encoded, experiments, morphology, quality, runs, tokenizers
from ..session import scratch_path
from ..sources import readers, sinks
from . import catalog as C
from . import config
from .catalog import ARM_PARTS, ARMS, CASCADE, PLAIN_RULES, arm_parts, gold_words, query, rounded, s, w
from .inputs import LINES, PAIRS, PARALLEL, lines, pairs, parallel_documents, table

# --- files -------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY conv_id, idx) - 1 AS id, md5(src) AS src, md5(pivot) AS pivot FROM pairs")
def aligned_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.ranks import with_ranks

    rows = with_ranks(pairs(spark, d), [], ["conv_id", "idx"], "id").select((F.col("id") - 1).alias("id"), "src", "pivot")
    path = scratch_path(spark, "aligned")
    sinks.write_jsonl(rows, path, "id")
    back = config.load_corpus(spark, {"loader": "aligned_jsonl", "path": path})
    return back.select("id", F.md5("src").alias("src"), F.md5("pivot").alias("pivot"))


@query(f"""WITH {LINES}, l AS (SELECT source, regexp_replace(text, '[\\r\\n]', '', 'g') AS t FROM lines WHERE {s("text")} <> '')
SELECT count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars, sum(strlen(t))::BIGINT AS n_bytes, (sum(strlen(t)) + count(*))::BIGINT AS file_bytes, true AS current, false AS other_is_current,
  md5(sum(('0x' || substr(sha256(t), 1, 15))::HUGEINT)::VARCHAR) AS fingerprint FROM l""")
def line_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).where(X.strip(F.col("text")) != "").select(F.regexp_replace("text", "[\r\n]", "").alias("text"))
    path = scratch_path(spark, "lines")
    known = sinks.write_lines(rows, path)
    marks = (F.lit(sinks.is_current(spark, path, known)).alias("current"), F.lit(sinks.is_current(spark, path, {"fingerprint": "other"})).alias("other_is_current"))
    return corpus.manifest(readers.corpus_lines(spark, path)).select("*", *marks)


@query(f"SELECT DISTINCT sha256({s('text')}) AS hash FROM documents WHERE {s('text')} <> ''")
def exclusion_list_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(X.strip(F.col("text")) != "")
    hashes = docs.select("source", X.sentence_hash(F.col("text")).alias("hash"))
    path = scratch_path(spark, "excluded")
    sinks.write_exclusion_list(hashes.where("pmod(crc32(hash), 2) = 0"), path)
    sinks.write_exclusion_list(hashes, path)  # a superset takes the old list's place
    return readers.exclusion_list(spark, path)


@query(f"SELECT sha256({s('text')}) AS key, any_value({s('text')}) AS input, length(any_value({s('text')}))::VARCHAR AS output FROM documents WHERE {s('text')} <> '' GROUP BY 1")
def split_cache_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(X.strip(F.col("text")) != "").select(X.strip(F.col("text")).alias("input")).distinct()
    rows = docs.select(X.sentence_hash(F.col("input")).alias("key"), "input", F.length("input").cast("string").alias("output"))
    path = scratch_path(spark, "cache")
    sinks.append_cache(rows, path)
    return readers.split_cache(spark, path)


@query("SELECT doc_id AS id, md5(text) AS text FROM documents WHERE lang = 'en' AND source = 'src1'")
def dataset_of_one_language(spark: SparkSession, d: str) -> DataFrame:
    rows = config.load_corpus(spark, {"loader": "parquet", "path": f"{d}/documents.parquet", "columns": ["doc_id", "text", "lang", "source"]})
    chosen = config.by_language(rows, "en", "src1", ("lang", "source"))
    return config.ordered_text(chosen.withColumnRenamed("doc_id", "id"), "text").select("id", F.md5("text").alias("text"))


@query("SELECT lang || '_Latn' AS code, lang AS language, 'Latn' AS script, count(*) AS n FROM documents GROUP BY lang")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("code", F.concat("lang", F.lit("_Latn")))
    return rows.select("code", experiments.language_code(F.col("code")).alias("c"), "n").select("code", "c.language", "c.script", "n")


@query("SELECT item_id, strlen(text)::BIGINT AS n_bytes, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM benchmark")
def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """A text file per item, read as such: lines end at line ends only."""
    path = scratch_path(spark, "files")
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("value"))
    rows.write.partitionBy("item_id").text(path)
    back = readers.numbered_lines(spark, f"{path}/item_id=*")
    item = F.regexp_extract("file", r"item_id=(\d+)", 1).cast("long")
    sized = back.select(item.alias("item_id"), "line").groupBy("item_id").agg((F.sum(F.octet_length("line")) + F.count("*") - 1).cast("long").alias("n_bytes"), F.count("*").alias("n_lines"))
    return sized


# --- encoded corpora ---------------------------------------------------------------

EOS = 256


def _encoded(spark: SparkSession, d: str, path: str, eos: int = EOS):
    identity = encoded.arm_fingerprint(tokenizers.BYTE, "bytes/utf-8")
    return encoded.ensure_encoded(table(spark, d, "benchmark"), ["item_id"], tokenizers.BYTE, identity, path, eos)


@query(f"""SELECT sum(strlen(text) + 1)::BIGINT AS n_tokens, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, 'uint16' AS dtype, {EOS} AS eos_id,
  'absent' AS first, '' AS second, 'eos_id' AS third FROM benchmark WHERE {s("text")} <> ''""")
def encoded_corpus_cache(spark: SparkSession, d: str) -> DataFrame:
    """Encoded, found again, and encoded anew as the end id changed."""
    path = scratch_path(spark, "encoded")
    meta, first = _encoded(spark, d, path)
    again, second = _encoded(spark, d, path)
    assert again == meta
    third = _encoded(spark, d, path, EOS + 1)[1]
    row = [(*(meta[k] for k in ("n_tokens", "n_lines", "n_chars", "n_bytes", "dtype", "eos_id")), ",".join(first), ",".join(second), ",".join(third))]
    return spark.createDataFrame(row, "n_tokens long, n_lines long, n_chars long, n_bytes long, dtype string, eos_id int, first string, second string, third string")


STREAM = f"""lines AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS line FROM benchmark WHERE {s("text")} <> ''), sized AS (SELECT *, sum(strlen(text) + 1) OVER (ORDER BY line) - strlen(text) - 1 AS first FROM lines),
bytes AS (SELECT first, hex(encode(text)) AS h, unnest(generate_series(0, strlen(text))) AS i, strlen(text) AS n FROM sized),
stream AS (SELECT (first + i)::BIGINT AS pos, CASE WHEN i = n THEN {EOS} ELSE ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INTEGER END AS id FROM bytes)"""


@query(f"WITH {STREAM} SELECT pos, id FROM stream")
def token_stream(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "encoded")
    _encoded(spark, d, path)
    return encoded.open_tokens(spark, path)


@query(f"""WITH {STREAM}, z AS (SELECT count(*) AS n FROM stream), q AS (SELECT w AS "window", ('0x' || substr(md5('7:' || w), 1, 8))::BIGINT % (n - 64) AS start FROM z, range(200) AS r(w)),
j AS (SELECT q."window", q.start, pos, id FROM q JOIN stream ON pos BETWEEN q.start AND q.start + 64)
SELECT "window", start, list(id ORDER BY pos) FILTER (pos < start + 64) AS x, list(id ORDER BY pos) FILTER (pos > start) AS y FROM j GROUP BY ALL""")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "encoded")
    _encoded(spark, d, path)
    return encoded.random_windows(spark, path, 64, 200, 7)


@query("SELECT doc_id, (row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) // 32 AS batch FROM documents")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    return encoded.length_batches(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 32).select("doc_id", "batch")


# --- rows, sets and parallel corpora -----------------------------------------------


@query("SELECT j AS at, doc_id FROM range(60) AS r(j) JOIN documents ON doc_id = (j * 37) % 50")
def rows_at_indices(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(60).select(F.col("id").alias("at"), (F.col("id") * 37 % 50).alias("index"))
    return experiments.take_rows(table(spark, d, "documents").select("doc_id"), "doc_id", wanted).select("at", "doc_id")


@query(f"SELECT DISTINCT sha256({s('text')}) AS hash FROM documents WHERE {s('text')} <> '' AND sha256({s('text')}) NOT IN (SELECT sha256({s('text')}) FROM documents WHERE doc_id % 2 = 0 AND {s('text')} <> '')")
def previous_hashes_subtracted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(X.strip(F.col("text")) != "")
    before = corpus.exclusion_hashes(docs.where("doc_id % 2 = 0"))
    return corpus.exclusion_hashes(docs).join(before, "hash", "left_anti")


@query(f"WITH {LINES} SELECT source, count(*) AS n, count(DISTINCT md5({s('text')})) AS n_digests FROM lines GROUP BY source")
def line_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).select("source", corpus.line_digest(X.strip(F.col("text"))).alias("k"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_digests"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def first_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy("doc_id").limit(25).select("doc_id")


SPLIT_LINE = "regexp_replace(text, '(ing|tion)', ' \\1', 'g')"


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("split", F.regexp_replace("text", "(ing|tion)", " $1"))


@query(f"""WITH {LINES}, k AS (SELECT source, text, {SPLIT_LINE} AS split FROM lines WHERE ({CASCADE}) IS NULL AND trim(text) <> '')
SELECT source, 'raw' AS side, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes FROM k GROUP BY source
UNION ALL SELECT source, 'split', count(*), sum(length(split))::BIGINT, sum(strlen(split))::BIGINT FROM k GROUP BY source""")
def lockstep_corpora(spark: SparkSession, d: str) -> DataFrame:
    reason = quality.drop_reason(F.col("text"), F.col("text"), PLAIN_RULES, latin=False)
    return experiments.lockstep(split_lines(spark, d), reason, "text", "split", ["source"])


@query(f"""WITH {LINES}, r AS (SELECT doc_id, n, CASE WHEN n % 50 = 7 THEN text || '!' ELSE text END AS t FROM lines WHERE n % 40 <> 3)
SELECT count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL) AS n_aligned, count(*) FILTER (r.doc_id IS NULL) AS n_missing, count(*) FILTER (l.doc_id IS NULL) AS n_extra, count(*) FILTER (l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL AND l.text IS DISTINCT FROM r.t) AS n_differing
FROM (SELECT * FROM lines WHERE n % 60 <> 11) l FULL JOIN r ON l.doc_id = r.doc_id AND l.n = r.n""")
def parallel_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    records = rows.where("n % 40 != 3").select("doc_id", "n", F.when(F.col("n") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("made_of"))
    return experiments.alignment_check(rows.where("n % 60 != 11"), records, ["doc_id", "n"], "text", "made_of")


@query(f"""WITH {LINES}, t AS (SELECT source, text, {SPLIT_LINE} AS split FROM lines)
SELECT source, count(*) AS n_records, count(*) FILTER (text <> split) AS n_changed, sum(len({w("text")}))::BIGINT AS units_raw, sum(len({w("split")}))::BIGINT AS units_out, sum(length(text))::BIGINT AS chars_raw, sum(length(split))::BIGINT AS chars_out,
  md5(sum(('0x' || substr(sha256(split), 1, 15))::HUGEINT)::VARCHAR) AS fingerprint FROM t GROUP BY source""")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return experiments.split_manifest(split_lines(spark, d), ["source"], "text", "split", X.word_count)


@query(f"SELECT lang, round(avg(len({w('text')})), 9) AS mean_units, count(*) AS n FROM documents GROUP BY lang")
def mean_units(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.mean_units(table(spark, d, "documents"), ["lang"], X.word_count(F.col("text"))))


@query("SELECT lang, count(*) AS n, round(avg(length(text)), 9) AS mean, round(quantile_cont(length(text)::DOUBLE, 0.5), 9) AS median, round(quantile_cont(length(text)::DOUBLE, 0.95), 9) AS p95, max(length(text))::INTEGER AS most FROM documents GROUP BY lang")
def length_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(experiments.length_report(table(spark, d, "documents"), ["lang"], F.length("text")))


# --- cubes -------------------------------------------------------------------------

CONTROL = [("byte", "byte"), ("char", "char")]


@query(f"""WITH {PARALLEL}, c AS (SELECT p.lang, p.k, a.arm, a.n::BIGINT AS source FROM par p, LATERAL {C.arm_values("p.src")} AS a(arm, n)), v AS (SELECT p.lang, p.k, a.arm, a.n::BIGINT AS pivot FROM par p, LATERAL {C.arm_values("p.pivot")} AS a(arm, n)),
r(arm, role, pivot_arm) AS (VALUES ('byte', 'english_control', 'byte'), ('char', 'english_control', 'char'), ('byte', 'deployed', 'word'), ('char', 'deployed', 'word'), ('word', 'deployed', 'word')),
parts AS (SELECT c.lang, c.arm, r.role, r.pivot_arm, c.source, v.pivot FROM c JOIN r USING (arm) JOIN v ON v.lang = c.lang AND v.k = c.k AND v.arm = r.pivot_arm)
SELECT lang, arm, role, pivot_arm, {C.POOLED} FROM parts GROUP BY ALL""")
def tpp_by_role(spark: SparkSession, d: str) -> DataFrame:
    docs = parallel_documents(spark, d)

    def counts(side: str) -> DataFrame:
        held = F.array(*(F.struct(F.lit(n).alias("arm"), c(F.col(side)).cast("long").alias("n")) for n, c in ARMS.items()))
        return docs.select("lang", "k", F.explode(held).alias("t")).select("lang", "k", "t.*")

    arms = spark.createDataFrame([(a,) for a in ARMS], "arm string")
    roles = experiments.pivots_for(arms, spark.createDataFrame(CONTROL, "arm string, pivot string"), "word")
    return rounded(experiments.tpp_by_role(counts("src"), counts("pivot"), roles, ["lang"], "k"))


def delta_sql(first: str, second: str) -> str:
    return f"""SELECT '{first}-{second}' AS pair, b, sum(x.source)::DOUBLE / nullif(sum(x.pivot), 0) - sum(y.source)::DOUBLE / nullif(sum(y.pivot), 0) AS delta FROM r JOIN p x USING (pos) JOIN p y USING (pos) WHERE x.arm = '{first}' AND y.arm = '{second}' GROUP BY b"""


@query(f"""WITH {PAIRS}, {ARM_PARTS}, p AS (SELECT arm, dense_rank() OVER (ORDER BY conv_id, idx) - 1 AS pos, source, pivot FROM parts), z AS (SELECT max(pos) + 1 AS n FROM p),
r AS (SELECT b, {C.DRAW} % (SELECT n FROM z) AS pos FROM range({C.REPLICATES}) AS x(b), range((SELECT n FROM z)) AS y(k)), d AS ({delta_sql("byte", "word")} UNION ALL {delta_sql("char", "word")}),
t AS (SELECT arm, sum(source)::DOUBLE / nullif(sum(pivot), 0) AS v FROM parts GROUP BY arm)
SELECT 'turns' AS corpus, pair, round((SELECT v FROM t WHERE arm = split_part(pair, '-', 1)) - (SELECT v FROM t WHERE arm = 'word'), 9) AS delta, round(quantile_cont(delta, 0.025), 9) AS ci_low, round(quantile_cont(delta, 0.975), 9) AS ci_high, count(delta) AS n_defined FROM d GROUP BY pair""")
def tpp_deltas(spark: SparkSession, d: str) -> DataFrame:
    parts = arm_parts(spark, d).withColumn("corpus", F.lit("turns"))
    return rounded(experiments.tpp_deltas(parts, [("byte", "word"), ("char", "word")], ["corpus"], ["conv_id", "idx"], C.REPLICATES))


F1 = "coalesce(2 * {m} / nullif({p} + sum(len(gold)), 0), 0)::DOUBLE"
EIGHTH = "list_filter(predicted, lambda i: i % 8 = 0)"


@query(f"""WITH {C.WORDS}, g AS (SELECT *, CASE WHEN length(word) < 8 THEN 'short' ELSE 'long' END AS subset FROM b WHERE gold IS NOT NULL),
f AS (SELECT subset, {F1.format(m="sum(len(list_intersect(predicted, gold)))::DOUBLE", p="sum(len(predicted))")} AS a, {F1.format(m=f"sum(len(list_intersect({EIGHTH}, gold)))::DOUBLE", p=f"sum(len({EIGHTH}))")} AS e FROM g GROUP BY subset)
SELECT subset, 0 AS tolerance, round(a, 9) AS f1_first, round(e, 9) AS f1_second, round(a - e, 9) AS delta FROM f""")
def morphscore_deltas(spark: SparkSession, d: str) -> DataFrame:
    rows = gold_words(spark, d).where("gold is not null").withColumn("subset", F.when(F.length("word") < 8, "short").otherwise("long"))
    rows = rows.withColumn("other", F.filter("predicted", lambda i: i % 8 == 0))
    return rounded(experiments.f1_deltas(rows, ["subset"], "predicted", "other", "gold", [0]))


@query(f"""WITH {C.WORDS}, g AS (SELECT word, gold[1] AS g, predicted FROM b WHERE gold IS NOT NULL AND len(gold) > 0),
m AS (SELECT count(*) FILTER (len(list_filter(predicted, lambda i: abs(i - g) <= 1)) > 0) AS n FROM g)
SELECT 'all' AS subset, count(*) AS n_words, count(*) FILTER (gold IS NULL) AS n_excluded, (SELECT n FROM m)::BIGINT AS n_matched, sum(len(predicted)) FILTER (gold IS NOT NULL)::BIGINT AS n_predicted, sum(len(gold))::BIGINT AS n_gold FROM b""")
def morphscore_tol1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words have one gold boundary at most, so the nearest match is any within reach."""
    rows = gold_words(spark, d).withColumn("subset", F.lit("all"))
    return morphology.boundary_scores(rows, ["subset"], "predicted", "gold", 1).select("subset", "n_words", "n_excluded", "n_matched", "n_predicted", "n_gold")


# --- report lookups: arms are the documents' languages, their sizes the words in use -------------

ARM_SIZES = f"""arms AS (SELECT lang AS arm, count(DISTINCT word)::BIGINT AS size, 15000::BIGINT AS wanted FROM (SELECT lang, unnest({w("text")}) AS word FROM documents) GROUP BY lang), sized AS (SELECT *, abs(size - wanted) <= wanted * 0.2 AS size_matched FROM arms),
pairs AS (SELECT a.arm AS first, b.arm AS second FROM arms a JOIN arms b ON a.arm < b.arm)"""


def measured_arms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.col("lang").alias("arm"), F.explode(X.words(F.col("text"))).alias("word"))
    arms = words.distinct().groupBy("arm").agg(F.count("*").alias("size")).withColumn("wanted", F.lit(15000).cast("long"))
    return experiments.size_matched(arms, F.col("wanted"), F.col("size"), 0.2)


@query(f"WITH {ARM_SIZES} SELECT arm, size, wanted, size_matched FROM sized")
def size_matched_arms(spark: SparkSession, d: str) -> DataFrame:
    return measured_arms(spark, d).select("arm", "size", "wanted", "size_matched")


@query(f"WITH {ARM_SIZES} SELECT arm FROM arms WHERE size < wanted")
def undersized_arms(spark: SparkSession, d: str) -> DataFrame:
    return experiments.undersized(measured_arms(spark, d), "wanted", "size").select("arm")


@query(f"WITH {ARM_SIZES} SELECT first, second FROM pairs WHERE first IN (SELECT arm FROM sized WHERE size_matched) AND second IN (SELECT arm FROM sized WHERE size_matched)")
def reported_pairs(spark: SparkSession, d: str) -> DataFrame:
    arms = measured_arms(spark, d)
    names = arms.select("arm")
    both = names.select(F.col("arm").alias("first")).join(names.select(F.col("arm").alias("second")), F.col("first") < F.col("second"))
    return experiments.reported_pairs(both, arms).select("first", "second")


@query(f"""WITH {ARM_SIZES}, v AS (SELECT arm, unnest(['original', 'slp1']) AS variant FROM arms), e AS (SELECT arm AS pivot FROM arms WHERE arm <> 'de')
SELECT DISTINCT v.arm, e.pivot, v.variant FROM v, e WHERE v.arm <> 'fr' UNION SELECT 'de', 'de', unnest(['original', 'slp1'])""")
def length_pairs(spark: SparkSession, d: str) -> DataFrame:
    arms = measured_arms(spark, d).select("arm")
    every = experiments.variants_for(arms.withColumnRenamed("arm", "family"), {x: ("original", "slp1") for x in ("de", "en", "es", "fr")}).withColumnRenamed("family", "arm")
    controlled = spark.createDataFrame([("de", "de")], "arm string, pivot string")
    return experiments.length_pairs(every, arms.where("arm != 'de'").select(F.col("arm").alias("pivot")), controlled, skip=["fr"])


@query(f"""SELECT lang AS arm, 'original' AS variant, round(sum(strlen(text))::DOUBLE / nullif(sum(len({w("text")})), 0), 9) AS value FROM documents GROUP BY lang""")
def compression_lookup(spark: SparkSession, d: str) -> DataFrame:
    results = C.compression(spark, d).select(F.col("lang").alias("arm"), F.lit("original").alias("variant"), "value")
    keys = table(spark, d, "documents").select(F.col("lang").alias("arm")).distinct().withColumn("variant", F.lit("original"))
    return experiments.lookup(results, keys, ["arm", "variant"], "value")


@query(f"WITH {PAIRS}, {ARM_PARTS}, v AS (SELECT arm, sum(source)::DOUBLE / sum(pivot) AS x FROM parts GROUP BY arm) SELECT arm, round(x, 9) AS value, round(x, 9) - 1 AS ci_low, round(x, 9) + 1 AS ci_high, NULL::DOUBLE AS absent FROM v")
def report_paths(spark: SparkSession, d: str) -> DataFrame:
    """Interval records in JSON, read by their paths."""
    values = rounded(C.tpp_by_arm(spark, d).select("arm", "value"))
    made = values.select("arm", F.to_json(F.struct(F.struct(F.struct("value", (F.col("value") - 1).alias("ci_low"), (F.col("value") + 1).alias("ci_high")).alias("turns")).alias("tpp"))).alias("report"))
    return made.select("arm", experiments.interval_row(F.col("report"), "tpp", "turns").alias("i"), experiments.dig(F.col("report"), "tpp", "other").cast("double").alias("absent")).select("arm", "i.*", "absent")


@query("WITH t AS (SELECT source, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT row_number() OVER (ORDER BY first) - 1 AS place, source AS name FROM t")
def needed_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Training corpora, then those that are only audited: each once."""
    first = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("first")).orderBy("first")
    train = [r["source"] for r in first.collect()]  # a few names
    names = experiments.ordered_union(train, train[::-1])
    return spark.createDataFrame(list(enumerate(names)), "place long, name string")


@query("""WITH a(name) AS (VALUES ('T1_bpe_64k'), ('T1_bpe_64k_split'), ('S_unigram_32k_slp1'), ('byte'))
SELECT name, string_split(name, '_')[1] AS family, CASE WHEN ends_with(name, '_split') THEN 'split' WHEN ends_with(name, '_slp1') THEN 'slp1' ELSE 'original' END AS variant, regexp_replace(name, '_split$', '') AS base FROM a""")
def arm_names(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reports import base_name

    rows = spark.createDataFrame([(x,) for x in ("T1_bpe_64k", "T1_bpe_64k_split", "S_unigram_32k_slp1", "byte")], "name string")
    return rows.select("name", runs.parse_arm(F.col("name")).alias("p"), base_name(F.col("name")).alias("base")).select("name", "p.family", "p.variant", "base")


