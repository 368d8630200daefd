"""Readers and writers on small files."""

import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tessella.operators import corpus
from tessella.sources import readers, sinks
from tessella.streaming import incremental

CONLLU = """## text: Kathā
## text_id: 7
## chapter: One
# text = rāmeti vadati
# sent_id = 11
1-2\trāmeti\t_\t_\t_\t_\t_\t_\t_\t_
1\trāma\trāma\tNOUN\t_\tCase=Cpd\t_\t_\t_\tUnsandhied=rāma|UnsandhiedReconstructed=True
2\titi\titi\tPART\t_\t_\t_\t_\t_\tUnsandhied=iti
2.1\tempty\t_\t_\t_\t_\t_\t_\t_\t_
3\tvadati\tvad\tVERB\t_\t_\t_\t_\t_\t_
short line
# text = without id
1\tx\tx\tNOUN\t_\t_\t_\t_\t_\t_
## text_id: none
# text = tatra
# sent_id = 12
1\ttatra\ttatra\tADV\t_\t_\t_\t_\t_\tX
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU, encoding="utf-8")
    rows = readers.conllu_sentences(spark, str(tmp_path / "a.conllu")).orderBy("sentence").collect()
    assert [(r["sent_id"], r["text_id"], r["text_name"]) for r in rows] == [("11", 7, "Kathā"), ("12", -1, "Kathā")]
    words = rows[0]["words"]
    assert [(w["surface"], [t["unsandhied"] for t in w["tokens"]]) for w in words] == [("rāmeti", ["rāma", "iti"]), ("vadati", ["vadati"])]
    assert words[0]["tokens"][0]["is_cpd"] and words[0]["tokens"][0]["reconstructed"]
    flags = readers.conllu_sentences(spark, str(tmp_path / "a.conllu")).orderBy("sentence").select(readers.human_verified(F.col("words")), readers.text_matches_tokens(F.col("text"), F.col("words"))).collect()
    assert [tuple(r) for r in flags] == [(False, True), (True, True)]


def test_aligned_files(spark, tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n \nfour\n")
    (tmp_path / "b").write_text("eins\nzwei\ndrei\nvier\n")
    pairs, dropped = readers.aligned_files(spark, {"en": str(tmp_path / "a"), "de": str(tmp_path / "b")})
    assert dropped == 1 and [tuple(r) for r in pairs.orderBy("idx").collect()] == [(0, "one", "eins"), (1, "two", "zwei"), (2, "four", "vier")]
    (tmp_path / "c").write_text("eins\n")
    with pytest.raises(readers.AlignmentError):
        readers.aligned_files(spark, {"en": str(tmp_path / "a"), "de": str(tmp_path / "c")})


def test_aligned_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps({"id": i, "x": f"a{i}", "y": f"b{i}"}) for i in range(3)) + "\n\n")
    assert readers.aligned_jsonl(spark, str(path)).count() == 3
    path.write_text('{"id": 0, "x": "a"}\n{"id": 1, "y": "b"}\n')
    with pytest.raises(readers.AlignmentError):
        readers.aligned_jsonl(spark, str(path))
    path.write_text('{"id": 0, "x": "a"}\n{"id": 2, "x": "b"}\n')
    with pytest.raises(readers.AlignmentError):
        readers.aligned_jsonl(spark, str(path))


def test_split_cache(spark, tmp_path):
    path = tmp_path / "cache.jsonl"
    path.write_text('{"key":"k","input":"a","output":"1"}\n{"key":"k","input":"a","output":"2"}\n{"key":"z","inp')
    assert [tuple(r) for r in readers.split_cache(spark, str(path)).collect()] == [("k", "a", "2")]
    path.write_text('{"key":"z","inp\n{"key":"k","input":"a","output":"1"}\n')
    with pytest.raises(ValueError):
        readers.split_cache(spark, str(path))


def test_tar_members(spark, tmp_path):
    (tmp_path / "x.en").write_text("one\ntwo\n")
    (tmp_path / "x.de").write_text("eins\nzwei\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for n in ("x.en", "x.de"):
            tar.add(tmp_path / n, n)
    rows = readers.tar_member_lines(spark, str(tmp_path / "a.tar.gz"), {"en": "x.en", "de": "x.de"})
    assert [tuple(r) for r in rows.orderBy("idx").collect()] == [(0, "one", "eins"), (1, "two", "zwei")]
    with pytest.raises(ValueError):
        readers.tar_member_lines(spark, str(tmp_path / "a.tar.gz"), {"en": "x.en"}, sha256="0" * 64)


def test_exclusion_list_does_not_shrink(spark, tmp_path):
    path = str(tmp_path / "list")
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    assert sinks.write_exclusion_list(corpus.exclusion_hashes(texts), path) == 2
    with pytest.raises(ValueError):
        sinks.write_exclusion_list(corpus.exclusion_hashes(texts.limit(1)), path)
    more = texts.union(spark.createDataFrame([("c",)], "text string"))
    assert sinks.write_exclusion_list(corpus.exclusion_hashes(more), path) == 3


def test_manifest_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("ab",), ("é",)], "text string")
    known = sinks.write_lines(rows, str(tmp_path / "lines"))
    assert (known["n_lines"], known["n_chars"], known["n_bytes"], known["file_bytes"]) == (2, 3, 4, 6)
    assert sinks.is_current(spark, str(tmp_path / "lines"), known) and not sinks.is_current(spark, str(tmp_path / "none"), known)
    out = sinks.write_results({"a": float("nan"), "b": (1, 2)}, str(tmp_path))
    assert json.loads(out.read_text()) == {"a": None, "b": [1, 2]}


def test_files():
    assert readers.resolve_files(["v/a.parquet", "v/b.parquet"], "v/", most=1) == ["v/a.parquet"]
    with pytest.raises(ValueError):
        readers.resolve_files(["w/a.parquet"], "v/")
    name, got = readers.first_complete([("bad", lambda: 1 / 0), ("good", lambda: 5)])
    assert (name, got) == ("good", 5)


def test_stream_filter(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a",), (" a ",), ("leak",), ("  ",), ("b",)], "text string").write.parquet(source)
    ex = corpus.exclusion_hashes(spark.createDataFrame([("leak",)], "text string"))
    lines = spark.readStream.schema("text string").parquet(source)
    query = incremental.write_stream(incremental.filter_stream(lines, ex), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert sorted(r["text"].strip() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
