"""Cubes, lookups, encoded corpora and configurations on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import encoded, experiments, tokenizers, training
from tessella.plans import config
from tessella.sources import readers, sinks


def test_rows_at_indices(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "idx long, text string")
    wanted = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "at long, index long")
    assert [r["text"] for r in experiments.take_rows(rows, "idx", wanted).orderBy("at").collect()] == ["t3", "t1", "t3"]
    with pytest.raises(Exception, match="no row at index 9"):
        experiments.take_rows(rows, "idx", spark.createDataFrame([(0, 9)], "at long, index long")).collect()


def test_lookups(spark):
    results = spark.createDataFrame([("a", 1.5), ("b", None)], "arm string, value double")
    keys = spark.createDataFrame([("a",), ("b",)], "arm string")
    assert {r["arm"]: r["value"] for r in experiments.lookup(results, keys, ["arm"], "value").collect()} == {"a": 1.5, "b": None}
    with pytest.raises(Exception, match="no result for c"):
        experiments.lookup(results, spark.createDataFrame([("c",)], "arm string"), ["arm"], "value").collect()
    with pytest.raises(Exception, match="no variants for z"):
        experiments.variants_for(spark.createDataFrame([("z",)], "family string"), {"a": ["x"]}).collect()
    with pytest.raises(Exception, match="no language code"):
        spark.createDataFrame([("english",)], "c string").select(experiments.language_code(F.col("c"))).collect()
    assert experiments.ordered_union(["b", "a"], ["c", "a"], []) == ["b", "a", "c"]


def test_report_arms(spark):
    arms = experiments.size_matched(spark.createDataFrame([("a", 100, 100), ("b", 90, 100), ("c", 99, 100)], "arm string, size long, wanted long"), F.col("wanted"), F.col("size"), 0.02)
    assert {r["arm"] for r in experiments.undersized(arms, "wanted", "size").collect()} == {"b", "c"}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "first string, second string")
    assert [tuple(r) for r in experiments.reported_pairs(pairs, arms).select("first", "second").collect()] == [("a", "c")]


def test_encoded_corpus(spark, tmp_path):
    lines = spark.createDataFrame([(2, "bc"), (0, "a"), (1, "  ")], "pos long, text string")
    identity = encoded.arm_fingerprint(tokenizers.BYTE, "bytes/utf-8")
    path = str(tmp_path / "e")
    meta, changed = encoded.ensure_encoded(lines, ["pos"], tokenizers.BYTE, identity, path, 256)
    assert changed == ["absent"] and (meta["n_tokens"], meta["n_lines"]) == (5, 2)
    assert [r["id"] for r in encoded.open_tokens(spark, path).orderBy("pos").collect()] == [97, 256, 98, 99, 256]
    assert encoded.ensure_encoded(lines, ["pos"], tokenizers.BYTE, identity, path, 256) == (meta, [])
    more = lines.union(spark.createDataFrame([(3, "d")], "pos long, text string"))
    assert encoded.ensure_encoded(more, ["pos"], tokenizers.BYTE, identity, path, 256)[1] == ["source_fingerprint"]
    retrained = {**identity, "arm_sha256": "x"}
    assert encoded.ensure_encoded(more, ["pos"], tokenizers.BYTE, retrained, path, 256)[1] == ["arm_sha256"]
    for r in encoded.random_windows(spark, path, 3, 20, 1).collect():
        assert r["x"][1:] == r["y"][:-1] and len(r["x"]) == len(r["y"]) == 3 and 0 <= r["start"] < 4
    with pytest.raises(ValueError):
        encoded.random_windows(spark, path, 7, 1, 1)


def test_an_arms_file_is_in_its_fingerprint(spark, tmp_path):
    file = tmp_path / "tokenizer.json"
    file.write_text("one")
    one = encoded.arm_fingerprint(tokenizers.BYTE, str(file), str(file), spark)
    file.write_text("two")
    two = encoded.arm_fingerprint(tokenizers.BYTE, str(file), str(file), spark)
    assert one["arm_sha256"] != two["arm_sha256"] and len(one["arm_sha256"]) == 64


def test_configurations(spark, tmp_path):
    lines = tmp_path / "lines.txt"
    lines.write_text("a\n\nb\n")
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"corpus": {"loader": "lines", "path": str(lines)}}))
    entry = config.load_config(str(path))["corpus"]
    assert sorted(r["text"] for r in config.load_corpus(spark, entry).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="no loader"):
        config.load_corpus(spark, {"loader": "other"})
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        config.load_config(str(tmp_path / "list.json"))


def test_training_by_name(spark):
    lines = spark.createDataFrame([("ab ab ab abc",)], "text string")
    assert training.train_arm("bpe", lines, 8).merges == training.train_bpe(lines, 8).merges
    with pytest.raises(ValueError, match="no algorithm"):
        training.train_arm("other", lines, 8)


def test_exclusion_list_has_two_header_lines(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([("s1", "b" * 64), ("s1", "a" * 64), ("s2", "a" * 64)], "source string, hash string")
    assert sinks.write_exclusion_list(rows, path) == 2
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ["# 2 distinct sha256 hashes", "# s1: 2, s2: 1", "a" * 64, "b" * 64]
    with pytest.raises(ValueError, match="lacks"):
        sinks.write_exclusion_list(rows.where("source = 's2'"), path)
    assert readers.exclusion_list(spark, path).count() == 2
    assert sinks.write_exclusion_list(rows.where("source = 's2'"), path, allow_shrink=True) == 1
