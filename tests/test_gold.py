"""Gold records, ingestion and reports."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import corpus, gold, reports
from tessella.sources import readers

from .test_sources import CONLLU


def test_gold_records(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU, encoding="utf-8")
    rows = gold.gold_records(readers.conllu_sentences(spark, str(tmp_path / "a.conllu"))).orderBy("sent_id").collect()
    first = rows[0]
    assert first["text_slp1"] == "rAmeti vadati" and first["oracle_split_slp1"] == "rAma iti vadati"
    assert first["segment_offsets"] == [[4], []] and first["stem_offsets"] == [[], [3]]
    assert first["t5seg_marked"] == "rAme\x1fti vadati" and first["t5_marked"] == "rAme\x1fti vad\x1fati"
    assert (first["n_words"], first["n_words_aligned"], first["human_verified"]) == (2, 2, False)


def test_unaligned_words_are_null(spark):
    record = gold.gold_sentence("1", 1, "abc zzz", [{"surface": "abc", "tokens": [{"unsandhied": "xyz", "lemma": "", "upos": "", "reconstructed": False}]}])
    assert record[5] == [None, None] and record[6] == [[], []]


def test_ingest(spark):
    rows = [(i, f"s{i}", i % 4, f"text {i % 9}", 2) for i in range(40)] + [(99, "x", 1, "one", 1)]
    df = spark.createDataFrame(rows, "n int, sent_id string, text_id int, text_slp1 string, n_words int")
    ex = corpus.exclusion_hashes(df.where("n = 3").select(F.col("text_slp1").alias("text")))
    got = gold.ingest(df, ex, 0.25, 1, least_words=2).collect()
    split = {s: {r["text_slp1"] for r in got if r["split"] == s} for s in ("train", "heldout", "excluded", "leak", "short")}
    assert len(got) == 41 and split["excluded"] == {"text 3"} and split["short"] == {"one"}
    assert not split["train"] & split["heldout"] and len({r["text_id"] for r in got if r["split"] == "heldout"}) == 1


def test_reports(spark):
    df = spark.createDataFrame([(0, "धर्मः"), (1, " "), (2, "abc")], "idx int, text string")
    assert reports.roundtrip_report(df, "devanagari").first()["n_exact"] >= 1
    assert reports.examples(df, F.col("text").rlike("[a-z]"), "idx", "text") == [(2, "abc")]
    assert reports.text_extent(df, "idx", 1).first()["n_lines"] == 1
    ranges = spark.createDataFrame([("a", 0, 2), ("b", 2, 5)], "source string, start long, stop long")
    got = reports.source_at(spark.range(6), "id", ranges).orderBy("id").collect()
    assert [r["source"] for r in got] == ["a", "a", "b", "b", "b", None]


def test_chunks():
    text = "aa. bb cc| dd " * 20
    parts = reports.chunk_text(text, 30)
    assert all(len(p.encode()) <= 30 for p in parts) and "".join("".join(parts).split()) == "".join(text.split())
    assert reports.chunk_text("ééééé", 5) == ["éé", "éé", "é"]
    with pytest.raises(ValueError):
        reports.chunk_text("x", 1)


def test_group_units():
    assert reports.group_units("tadapi ca", "tat api ca") == [["tat", "api"], ["ca"]]
