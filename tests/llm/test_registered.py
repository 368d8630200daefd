"""Registered queries against their SQL, and the pipeline against its parts."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tessella.llm import decontaminate, near_dup, quality_cnn, queries
from tessella.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], DATA), name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    net = quality_cnn.fit(docs, labels)
    assert ids[1] == {r["doc_id"] for r in quality_cnn.score(docs, net).where(f"score >= {quality_cnn.KEEP}").collect()}
    assert ids[2] == {r["doc_id"] for r in near_dup.near_duplicates(seen[1], width=5).where("kept").collect()}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaking = {r["doc_id"] for r in decontaminate.find_leaks(seen[3], items).collect()}
    assert ids[4] == ids[3] - leaking
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in seen[5].collect()}
    assert all(0 < t <= 2 * n for n, t in taken.values())
    assert corpus_pipeline.run(spark, DATA).count() == len(taken)


def test_pipeline_takes_odd_rows(spark, documents):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "some text here", "en", "a", 14), (4, "x " * 5000, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = written(stage(spark, df, DATA), name)
        df.collect()
