"""The accept pipeline and its line rules against their SQL, on odd lines."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.functions import points
from tessella.operators import corpus, quality
from tessella.plans import catalog

GOOD = "alpha beta gamma delta"
ODD = [
    None, "", " ", GOOD, GOOD + "\r", GOOD + " ", GOOD + "!!\u0085", " " + GOOD + "　", "\x1c" + GOOD + " \x1f", GOOD + " é ñ ß 語",
    "der alpha die beta", "der der alpha beta", "xder alpha dies beta", "alpha der.die beta", "die der", "und", "ÜBER äöü ñandú", "𝒜𝒷𝒸𝒹 𐐷𐐷𐐷 语言文字 abc",
    "😀😀 abcd efgh ijkl", "a b c", "ab cd ef", "abcdefghijklmno " * 4, "word " * 40, "word " * 41, "12 34 56 words here now", "été clair matin bleu", "...!!!", "abc" + "!" * 60, "a-b c-d e-f gh",
    "tab\tbed\tlid", "v\x0bw vwx xyz", "﻿alpha beta gamma", "alpha \x00 beta gamma",
]


@pytest.mark.parametrize("most", [1, 40, 1 << 17])
def test_rules_are_those_of_the_sql(spark, monkeypatch, most):
    monkeypatch.setattr(points, "SLICE", most)
    draw = np.random.default_rng(3)
    some = [" ".join(draw.choice(["der", "die", "Haus", "x1", "1", "—", "été", "日本", " ", "ok."], draw.integers(0, 9))) for _ in range(300)]
    rows = list(enumerate(ODD + some))
    lines = pa.table({"n": [n for n, _ in rows], "text": [t for _, t in rows]})  # noqa: F841 - DuckDB reads it by name
    want = dict(duckdb.sql(f"select n, {catalog.CASCADE} from lines where text is not null").fetchall()) | {0: None}
    df = spark.createDataFrame(rows, "n int, text string").coalesce(1)
    text = F.col("text")
    assert dict(df.select("n", quality.drop_reason(text, text, catalog.PLAIN_RULES, latin=False)).collect()) == want
    # Lines whose source differs from what the later rules read.
    upper = F.when(F.col("n") % 3 > 0, F.upper(text))
    apart = df.select("n", text.rlike("[A-Za-z]").alias("latin"), quality.drop_reason(text, upper, catalog.PLAIN_RULES).alias("why")).collect()
    assert all((r["why"] == "latin") == bool(r["latin"]) for r in apart)


def odd_tables(folder):
    letters = "abcdefghijklmnopqrstuvwxyz"
    leak = " ".join(letters[i : i + 5] for i in range(20))
    texts = [GOOD, f"one more line here\n{GOOD}\nfirst of all things", None, "", f"{GOOD}\n{GOOD}\r\nsome {leak[:40]} words", f"{leak}\nonly here and there", "zzz short one\nzzz short one", f"first of all things\n{GOOD} 1 2 3 4 5 6"]
    n = 3 * len(texts)
    docs = {"doc_id": [i // 2 if i > n - 6 else i for i in range(n)], "text": (texts * 3)[:n], "source": [None if i % 5 == 0 else f"s{i % 3}" for i in range(n)]}
    # Rows of one id are of one source, which SQL could else choose freely between.
    docs["source"] = [docs["source"][docs["doc_id"].index(i)] for i in docs["doc_id"]]
    tables = {"documents": pa.table(docs), "benchmark": pa.table({"item_id": [0, 1, 2], "text": [f"{leak}\nfirst of all things", "zzz, short one", None]})}
    for name, made in tables.items():
        pq.write_table(made, f"{folder}/{name}.parquet")
    return tables


def test_accept_pipeline_on_odd_rows(spark, tmp_path):
    """Null sources come last, rows of one id share their marks, and of tied rows one stays."""
    con = duckdb.connect()
    for name, made in odd_tables(tmp_path).items():
        con.register(name, made)
    want = con.execute(catalog.ORACLE_SQL["accept_pipeline"]).fetchall()
    got = [tuple(r[c] for c in ("source", "reason", "n")) for r in catalog.accept_pipeline(spark, str(tmp_path)).collect()]
    assert {r[1] for r in want} > {"kept", "hash", "shingle", "duplicate", "letter_fraction"}
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_accept_pipeline_reads_each_line_once(spark, tmp_path, monkeypatch):
    odd_tables(tmp_path)
    read = spark.sparkContext.accumulator(0)

    def counted(source, text, rules, latin):
        @F.arrow_udf("string")
        def reason(texts: pa.Array) -> pa.Array:
            read.add(len(texts))
            return pa.nulls(len(texts), pa.string())

        return reason(text)

    monkeypatch.setattr(quality, "drop_reason", counted)
    catalog.accept_pipeline(spark, str(tmp_path)).collect()
    assert read.value == catalog.lines(spark, str(tmp_path)).count()


def test_counts_are_those_of_the_rows(spark):
    draw = np.random.default_rng(8)
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma", "der", "die"], draw.integers(2, 6))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}", i % 3) for i, t in enumerate(texts)], "id long, text string, source string, source_rank int")
    held = spark.createDataFrame([(t,) for t in texts[::40]], "text string")
    exclusion, index = corpus.exclusion_hashes(held.limit(4)), corpus.shingle_index(held, 21)
    rule = quality.drop_reason(F.col("text"), F.col("text"), catalog.PLAIN_RULES, latin=False)
    args = (rows, exclusion, index, 21, "id", rule, ["source_rank", "id"])
    want = {tuple(r) for r in corpus.drop_counts(corpus.accept(*args), "source").collect()}
    assert {tuple(r) for r in corpus.accept_counts(*args, "source").collect()} == want and {r[1] for r in want} >= {"kept", "duplicate", "hash", "shingle"}


def test_whole_short_texts_pass_only_if_the_index_holds_them(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "a1b", "ba", "abc", "", None, "語"])], "id int, text string")
    index = corpus.shingle_index(rows.where("id in (0, 6)"), 5)
    passed = rows.select("id", corpus.filtered_shingles(F.col("text"), 5, corpus.shingle_filter(index, 5)).alias("s")).collect()
    assert {r["id"]: r["s"] for r in passed} == {0: ["ab"], 1: ["ab"], 2: [], 3: [], 4: [], 5: [], 6: ["語"]}
