"""Operators on small cases with known values."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import bootstrap, corpus, entropy, morphology, ranks, ratios, runs, tokenizers, training
from tessella.plans import catalog


def test_pooled_ratio(spark):
    rows = [(0, 3, 2), (1, 1, 4)]
    parts = spark.createDataFrame(rows, "idx long, source long, pivot long").withColumn("g", F.lit("x"))
    got = ratios.pooled(parts, ["g"]).first()
    assert (got["value"], got["source_total"], got["pivot_total"], got["n_undefined"]) == (4 / 6, 4, 6, 0)
    assert [r["ratio"] for r in ratios.per_pair(parts).orderBy("idx").collect()] == [1.5, 0.25]
    empty = ratios.pooled(parts.withColumn("pivot", F.lit(0)), ["g"]).first()
    assert (empty["value"], empty["mean"], empty["n_undefined"]) == (None, None, 2)


def test_fertility(spark):
    texts = spark.createDataFrame([("x", "ab cde"), ("y", "  ")], "g string, text string")
    got = {r["g"]: (r["value"], r["n"]) for r in ratios.fertility(texts, ["g"], F.length).collect()}
    assert got == {"x": (2.5, 2), "y": (None, 0)}


def test_unaligned_sides_are_an_error(spark):
    a, b = spark.range(3), spark.range(4)
    with pytest.raises(ValueError):
        ratios.check_aligned(a, b, ["id"])
    ratios.check_aligned(a, a, ["id"])


@pytest.mark.parametrize("counts,alpha,bits,efficiency", [([1, 1, 1, 1], 2.0, 2.0, 1.0), ([3, 1], 2.0, 0.678072, 0.678072), ([1, 1], 3.0, 1.0, 1.0)])
def test_renyi(spark, counts, alpha, bits, efficiency):
    df = spark.createDataFrame([("g", str(i), c) for i, c in enumerate(counts)], "g string, token string, c long")
    got = entropy.renyi(df, ["g"], [alpha]).first()
    assert got["entropy_bits"] == pytest.approx(bits, abs=1e-6) and got["efficiency"] == pytest.approx(efficiency, abs=1e-6)
    with pytest.raises(ValueError):
        entropy.renyi(df, ["g"], [1.0])


def test_bootstraps():
    assert [bootstrap.block_count(n, b) for n, b in ((10, 5), (11, 5), (4, 5), (0, 5))] == [2, 3, 1, 0]
    same = np.array([3, 1, 4, 1, 5])
    assert bootstrap.stream_interval(same, same, 50, 1, 0.95) == (1.0, 1.0)
    assert bootstrap.stream_interval(same, same * 0, 50, 1, 0.95) == (None, None)
    assert bootstrap.stream_f1_delta(np.zeros((0, 3)), np.zeros((0, 3)), 10, 1, 0.9) == (None, None, None)
    with pytest.raises(ValueError):
        bootstrap.check_level(1.0)


def test_hash_draws_cover_every_replicate(spark):
    sized = spark.range(7).select(F.lit("g").alias("g"), F.col("id").alias("pos"), F.lit(7).cast("long").alias("n"))
    for length in (1, 3):
        got = bootstrap.draws(sized, ["g"], 5, length).groupBy("b").agg(F.sum("times").alias("t")).collect()
        assert [r["t"] for r in got] == [7] * 5


def test_replicates_read_without_a_row_for_each_draw(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(g, i, int(x), None if i % 9 == 4 else float(x) / 7) for g, n in (("a", 1), ("b", 13), ("c", 1234)) for i, x in enumerate(draw.integers(0, 90, n))]
    parts = spark.createDataFrame(rows, "g string, idx long, source long, pivot double")
    sized = bootstrap.numbered(parts, ["g"], ["idx"]).cache()
    for length, span in ((1, 1 << 22), (1, 100), (7, 1 << 22), (7, 100)):
        monkeypatch.setattr(bootstrap, "SPAN", span)
        read = bootstrap.draws(sized, ["g"], 30, length).join(sized, ["g", "pos"])
        want = read.groupBy("g", "b").agg(F.sum(F.col("source") * F.col("times")).alias("s"), F.sum(F.col("pivot") * F.col("times")).alias("p"))
        got = bootstrap.replicate_sums(sized, ["g"], ["source", "pivot"], 30, length)
        assert {(r["g"], r["b"]): (r["source"], r["pivot"]) for r in got.collect()} == {(r["g"], r["b"]): (r["s"], pytest.approx(r["p"])) for r in want.collect()}
    # no join multiplies pairs by replicates, and no plan can broadcast the product
    plan = bootstrap.ratio_interval(parts, ["g"], ["idx"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "times" not in plan


def test_dedup_first_wins(spark):
    rows = spark.createDataFrame([("b", 1, 0, " x "), ("a", 0, 5, "x"), ("a", 0, 2, "x"), ("b", 1, 1, "y"), ("b", 1, 2, "  ")], "source string, source_rank int, pos int, text string")
    kept = sorted((r["source"], r["pos"]) for r in corpus.dedup_across_sources(rows).collect())
    assert kept == [("a", 2), ("b", 1)]
    counts = {r["source"]: (r["n_in"], r["n_blank"], r["n_duplicate"], r["n_out"]) for r in corpus.dedup_counts(rows, ["source"]).collect()}
    assert counts == {"a": (2, 0, 1, 1), "b": (3, 1, 1, 1)}


def test_leaks(spark):
    rows = spark.createDataFrame([(1, "keep"), (2, " leak ")], "id int, text string")
    ex = corpus.exclusion_hashes(spark.createDataFrame([("leak",)], "text string"))
    assert [r["id"] for r in corpus.without_leaks(rows, ex).collect()] == [1]
    with pytest.raises(corpus.LeakageError, match="2"):
        corpus.assert_no_leaks(rows, ex, "rows", "id")


def test_short_texts_overlap_as_a_whole(spark):
    items = spark.createDataFrame([("abc",), ("abcdefgh",)], "text string")
    index = corpus.shingle_index(items, 5)
    rows = spark.createDataFrame([(1, "a b c"), (2, "xxabcdexx"), (3, "abcd")], "id int, text string")
    assert sorted(r["id"] for r in corpus.shingle_overlaps(rows, index, 5, "id").collect()) == [1, 2]


def test_only_shingles_of_the_index_become_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "LETTERS", 50)
    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("abé 😀1"), draw.integers(0, 40))) for _ in range(300)] + [None, "", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = rows.where("id % 40 = 3 or id = 302").select("text")
    for k in (1, 3, 5, 6, 7, 24):
        index = corpus.shingle_index(items, k)
        plain = rows.select("id", F.explode(corpus.shingles_or_whole(corpus.letters_only(F.col("text")), k)).alias("shingle"))
        want = {r["id"] for r in plain.join(index, "shingle").collect()}
        assert {r["id"] for r in corpus.shingle_overlaps(rows, index, k, "id").collect()} == want
    index = corpus.shingle_index(items, 7)
    passed = rows.select(F.explode(corpus.filtered_shingles(corpus.letters_only(F.col("text")), 7, corpus.shingle_filter(index, 7))).alias("shingle"))
    assert passed.where("length(shingle) = 7").count() < 2 * passed.where("length(shingle) = 7").join(index, "shingle").count()
    plan = corpus.shingle_overlaps(rows, index, 7, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "filtered" in plan or "passing" in plan  # shingles are cut and told apart before any is a row


def test_samples_are_stable(spark):
    rows = spark.range(1000)
    a = {r["id"] for r in corpus.sample_n(rows, "id", 50, 1).collect()}
    assert len(a) == 50 and a == {r["id"] for r in corpus.sample_n(rows.repartition(7), "id", 50, 1).collect()}
    assert corpus.keep_probability(100, 20, 160) == 0.5 and corpus.keep_probability(100, 0, 10) == 1.0
    with pytest.raises(ValueError):
        corpus.keep_probability(10, 20, 5)


def test_alignment_of_fused_boundaries():
    cases = [("rAmeti", ["rAma", "iti"], [4]), ("tatrEva", ["tatra", "eva"], [5]), ("vacanenEkam", ["vacanena", "Ekam"], [7]), ("sAgacCat", ["sa", "AgacCat"], [1]), ("tadapi", ["tat", "api"], [3])]
    for surface, segments, want in cases:
        assert morphology.align_segments(surface, segments) == want
    assert morphology.align_segments("abc", ["xyz"]) is None
    assert morphology.align_segments("ab", ["ab", "ab"]) is None
    assert morphology.align_segments("abc", ["abc"]) == []
    assert morphology.match_words(["a", "x", "b"], ["a", "b"]) == [0, None, 1]


def test_reconcile():
    got = morphology.reconcile("rAmaH rAmam vadati", "rAmam vadati")
    assert got["text"] == "rAmaH rAmam vadati" and got["n_units_kept_verbatim"] == 1
    assert morphology.reconcile("tadapi\t\nca", "tad  api   ca")["text"] == "tad api ca"
    assert morphology.reconcile("log-in (tadapi)!", "log-in tad api")["text"] == "log-in (tad api)!"
    assert morphology.reconcile("2020 rAmaH", "2020 rAmaH")["text"] == "2020 rAmaH"
    assert morphology.drop_lost_nonletters("a, b. c,", "a b c,") == "a b c,"


def test_boundary_scores(spark):
    rows = spark.createDataFrame([("perfect", [3], [3]), ("zero", [2], [3]), ("half", [1, 3], [3]), ("off", [4], [3]), ("none", [1], None)], "g string, p array<int>, q array<int>")
    exact = {r["g"]: r["f1"] for r in morphology.boundary_scores(rows, ["g"], "p", "q").collect()}
    near = {r["g"]: r["f1"] for r in morphology.boundary_scores(rows, ["g"], "p", "q", 1).collect()}
    assert exact == {"perfect": 1.0, "zero": 0.0, "half": pytest.approx(2 / 3), "off": 0.0, "none": None}
    assert near["off"] == 1.0 and near["zero"] == 1.0


def test_bpe(spark):
    lines = spark.createDataFrame([("low lower lowest low",), ("new newer",)], "text string")
    trained = training.train_bpe(lines, 20)
    encoder = trained.encoder()
    text = "low newest"
    spans = encoder.spans(text)
    assert tokenizers.spans_tile(text, spans)
    replayed = spark.createDataFrame([(text,)], "text string").select(tokenizers.replay_count(F.col("text"), trained.merges)).first()[0]
    assert replayed == len(encoder.encode(text))
    model = training.train_unigram(lines, 30)
    assert all(len(model.encode(t)) > 0 for t in ("low", "zzz"))
    with pytest.raises(ValueError):
        training.train_bpe(lines, 20, max_words=1)


def test_span_reports_hold_no_lists(spark, monkeypatch):
    monkeypatch.setattr(tokenizers, "CHARACTERS", 5)
    texts = ["", "  ", "ab", " a\u3000bc\x1c d ", "नमस्ते x", "😀 y\u00a0z", None, "a", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for arm in (tokenizers.CHAR, tokenizers.WORD):
        spans = rows.select("id", arm.spans(F.col("text")).alias("a")).collect()
        want = {r["id"]: None if r["a"] is None else [(x["start"], x["end"]) for x in r["a"]] for r in spans}
        for r in rows.select("id", tokenizers.span_report(F.col("text"), arm).alias("a")).select("id", "a.*").collect():
            own = want[r["id"]]
            assert tuple(r)[1:] == ((False, None, None, None) if own is None else (True, len(own), sum(x[0] for x in own), sum(x[1] for x in own)))
    draw = np.random.default_rng(2)
    for _ in range(300):  # as spans_tile has it, of right and wrong spans
        made = ["".join(draw.choice(list("ab  "), draw.integers(0, 6))) for _ in range(3)]
        found = [sorted((int(a), int(a + draw.integers(0, 3))) for a in draw.integers(0, 6, draw.integers(0, 3))) for _ in made]
        edges = np.concatenate([[0], np.cumsum([len(t) for t in made])])
        row = np.repeat(np.arange(3), [len(f) for f in found])
        start, end = (np.array([s[i] for f in found for s in f], int) + edges[row] for i in (0, 1))
        got = tokenizers.tiling(np.array([c.isspace() for c in "".join(made)], bool), edges, start, end, row)
        assert got.tolist() == [tokenizers.spans_tile(t, f) if all(e <= len(t) for _, e in f) else False for t, f in zip(made, found)]
    plan = catalog.span_tiling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "pandas" not in plan.lower() and "array<array" not in plan and "lambda" not in plan


def brute_unigram(counts, vocab_size, rounds=4, longest=8):
    """The trainer in one process, all seeds counted."""
    seeds = Counter()
    for word, n in counts.items():
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + longest) + 1):
                seeds[word[i:j]] += n
    single = {p: n for p, n in seeds.items() if len(p) == 1}
    rest = sorted(((n * len(p), p) for p, n in seeds.items() if len(p) > 1 and n > 1), key=lambda x: (-x[0], x[1]))[: vocab_size * 4]
    weight = {**single, **{p: seeds[p] for _, p in rest}}
    for r in range(rounds):
        total = sum(weight.values()) or 1
        model = training.Unigram({p: float(np.log(n / total)) for p, n in weight.items() if n > 0})
        used = Counter(dict.fromkeys(single, 1))
        for word, n in sorted(counts.items()):
            for part in model.segment(word):
                used[part] += n
        size = max(vocab_size - 1, len(single)) if r == rounds - 1 else max(vocab_size - 1, len(used) * 3 // 4)
        order = sorted(used, key=lambda p: (len(p) > 1, -used[p], p))
        weight = {p: used[p] for p in order[:size]}
    total = sum(weight.values()) or 1
    return {p: float(np.log(n / total)) for p, n in weight.items()}


def test_training_reads_the_documents(spark):
    data = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{data}/documents.parquet")
    counts = {r["piece"]: r["c"] for r in training.piece_counts(lines).collect()}
    merges = [(r["left"], r["right"]) for r in catalog.QUERIES["bpe_train"](spark, data).orderBy("rank").collect()]
    assert merges == training.merge_loop(counts, 150).merges and len(merges) > 16
    got = {r["piece"]: r["log_prob"] for r in catalog.QUERIES["unigram_train"](spark, data).collect()}
    assert got == brute_unigram(counts, 200)


def test_training_of_runs_ties_and_nothing(spark):
    lines = spark.createDataFrame([("aaaa aaa aaaaa b\nb bb abab \U0001F600\U0001F600 ab",), (None,), ("",), ("  ",)], "text string")
    counts = {r["piece"]: r["c"] for r in training.piece_counts(lines).collect()}
    assert training.train_bpe(lines, 60) == training.merge_loop(counts, 60)
    assert training.train_unigram(lines, 9).logs == brute_unigram(counts, 9)
    none = lines.where("text = 'x'")
    assert training.train_bpe(none, 9) == training.Trained([], []) and training.train_unigram(none, 9).logs == {}


def test_markers_bind_training(spark):
    marked = spark.createDataFrame([("tad\x1fapi tad\x1fapi tat",)], "text string")
    trained = training.train_bpe(marked, 40, marker="\x1f")
    assert not any("dap" in a + b for a, b in trained.merges)


def test_byte_spans():
    text = "aक b"
    assert tokenizers.byte_spans(text, [1, 1, 2, 1, 1]) == [(0, 1), (1, 2), (3, 4)]


def test_registry():
    registry = tokenizers.Registry()
    registry.add("gone", "file", "original", lambda: tokenizers.file_arm("gone", "/nowhere/x.json"))
    found, missing = registry.load_all(["byte", "gone"])
    assert list(found) == ["byte"] and list(missing) == ["gone"]
    assert registry.names(family="word") == ["word"]


def test_run_aggregates(spark):
    rows = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 2.0), ("b", 1, None)], "arm string, step int, v double")
    assert runs.best(rows, ["arm"], "v", "step").first()[:] == ("a", 2.0, 2)
    stats = {r["arm"]: (r["mean"], r["std"]) for r in runs.seed_stats(rows, ["arm"], "v").collect()}
    assert stats["b"] == (None, None)
    with pytest.raises(ValueError):
        runs.bits_per_char(1.0, 0)


def test_block_draws_are_numpys_whole_matrices():
    """A replicate that stays short of n makes all draw as many blocks again."""
    n, length, replicates = 95, 10, 200
    source, pivot = np.arange(1, n + 1, dtype=float), np.arange(n, 0, -1, dtype=float) + 3
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 10, (replicates, 10))]
    size = np.minimum(10, n - np.arange(10) * 10)
    while (size[np.concatenate(columns, axis=1)].sum(axis=1) < n).any():
        columns.append(rng.integers(0, 10, (replicates, 10)))
    ratios = []
    for row in np.concatenate(columns, axis=1):
        read = [i for b in row for i in range(10 * b, 10 * b + size[b])][:n]
        ratios.append(source[read].sum() / pivot[read].sum())
    assert len(columns) > 1
    want = np.percentile(ratios, [2.5, 97.5])
    assert bootstrap.stream_interval(source, pivot, replicates, 3, 0.95, length) == pytest.approx(tuple(want))


def test_ranks_and_running_totals(spark):
    draw = np.random.default_rng(8)
    rows = [(int(draw.integers(0, 3)) if draw.random() > 0.1 else None, int(draw.integers(0, 50)), i, int(draw.integers(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, a long, b long, x long")
    got = {r["b"]: (r["pos"], r["n"]) for r in ranks.with_ranks(df, ["g"], ["a", "b"], "pos", "n").collect()}
    sums = {r["b"]: r["before"] for r in ranks.running_total(df, ["g"], ["a", "b"], F.col("x"), "before").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])
        assert [got[r[2]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]
        assert [sums[r[2]] for r in own] == [sum(x[3] for x in own[:i]) for i in range(len(own))]
    assert ranks.with_ranks(df.limit(0), ["g"], ["a"], "pos").count() == 0
    texts = df.withColumn("a", F.col("a").cast("string"))
    assert ranks.with_ranks(texts, [], ["a", "b"], "pos").agg(F.max("pos")).first()[0] == 400


def test_many_lines_of_one_document_keep_their_places(spark, tmp_path):
    from tessella.plans import inputs

    spark.createDataFrame([(1, "\n".join(["x"] * 1_000_003), "en", "src1", 1), (2, "a\nb", "en", "src1", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = inputs.lines(spark, str(tmp_path))
    assert rows.select("doc_id", "n").distinct().count() == 1_000_005
