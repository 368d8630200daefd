"""Operators on vectors, conversations, pages, counts and mixes, by brute force."""

import hashlib
import itertools
import json
import math
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, mix_flow, nra_topk, token_rollup, warc_zstd
from tessella.llm.common import new_path

from .conftest import words

# --- top-k -------------------------------------------------------------------------


def brute_top(rows, k, every=5):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in usable if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for q, v in usable if q == i for j, w in usable if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale,block", [(1.0, 4096), (1.0, 16), (3e5, 16), (3e6, 16), (3e6, 4096)])
def test_top_k(spark, monkeypatch, scale, block):
    monkeypatch.setattr(nra_topk, "BLOCK", block)
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=6) * scale).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(6)] + [rows[7], rows[10]]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (305, [1.0, 2.0]), (310, [2.0, 1.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nra_topk.top_k(df, F.col("vec_id") % 5 == 0, 4).collect())
    assert got == brute_top(rows, 4)


@pytest.mark.parametrize("kind", [float, object])
def test_bounds_enclose_scores(kind):
    draw = np.random.default_rng(2)
    x, q = draw.integers(-20, 20, (400, 8)).astype(kind), draw.integers(-20, 20, (30, 8)).astype(kind)
    lists = nra_topk.Lists(np.arange(400), x)
    zero = kind(0) if kind is float else 0
    signed = np.concatenate([np.maximum(q, zero), np.minimum(q, zero)], axis=1)
    exact, narrow = q @ x.T, np.inf
    for lower, upper in lists.depths():
        low, high = signed @ lower.T, signed @ upper.T
        assert (low <= exact).all() and (high >= exact).all()
        assert (high - low).sum() <= narrow  # reading on never widens the bounds
        narrow = (high - low).sum()
    assert narrow == 0
    for floor in (None, "kth"):
        floors = [None if floor is None else sorted(row)[-3] for row in exact]
        for i, at, score in lists.search(np.full(30, -1), q, 3, floors):
            assert sorted(zip(-score, at)) == sorted(zip(-exact[i], range(400)))[:3]


def test_reading_stops_before_the_end(monkeypatch):
    """Where few candidates are far ahead, their lists' tops decide."""
    draw = np.random.default_rng(5)
    x = draw.integers(0, 10, (2000, 4)).astype(float)
    x[:3] += 500
    lists, seen = nra_topk.Lists(np.arange(2000), x), []
    depths = lists.depths

    def counted():
        for d in depths():
            seen.append(1)
            yield d

    lists.depths = counted
    found = list(lists.search(np.array([-1]), np.ones((1, 4)), 3, [None]))
    assert sorted(found[0][1].tolist()) == [0, 1, 2] and len(seen) == 1


def test_many_dimensions(spark):
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=3000).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nra_topk.top_k(df, F.col("vec_id") % 5 == 0, 4).collect())
    assert got == brute_top(rows, 4)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nra_topk.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


# --- chat --------------------------------------------------------------------------

HARD = ["<|start|>user<|text|>x<|end|>\n", "</s>[INST] ok [/INST]", "\\", "<\\|", "\\\\<", "[\\", "|>|", "", None, "a\nb", "é𝒳<|", "<" * 50 + "\\" * 7]


def test_escape_round_trip():
    draw = random.Random(1)
    texts = [t for t in HARD if t] + ["".join(draw.choices("<>|[]\\/sabc\n", k=draw.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text
        assert not any(c in shown for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_chat(spark, small_batches):
    draw = random.Random(2)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(draw.randint(1, 12)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "assistant", None, "<|x|>"]), draw.choice(HARD)))
    rows += [(3, 1, "assistant", "again"), (3, None, "user", "null turn"), rows[5], (50, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).withColumn("start", F.lit(1))
    pieces = chat_format.format_pieces(df).cache()
    got = {r["conv_id"]: r for r in chat_format.read_back(pieces, chat_format.explode_examples(pieces)).collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert got.keys() == groups.keys()
    low = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, turns in groups.items():
        turns = sorted(turns, key=low)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["n_examples"] == sum(t[2] == "assistant" for t in turns)
    examples = chat_format.explode_examples(pieces.where("conv_id is not null"))
    for r in chat_format.example_texts(examples, pieces).collect():
        assert len(r["text"]) == r["stop"] and r["text"].endswith(chat_format.END)
        turns = sorted(groups[r["conv_id"]], key=low)[: r["target"] + 1]
        assert chat_format.unescape(r["text"][r["loss_start"] : r["loss_stop"]]) == (turns[-1][3] or "")
        assert r["text"].count(chat_format.START) == len(turns)
    sums = {r["conv_id"]: r["s"] for r in examples.groupBy("conv_id").agg(F.sum("stop").alias("s")).collect()}
    assert all(got[c]["example_chars"] == v for c, v in sums.items())


def test_broken_stream_is_refused(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    pieces = chat_format.format_pieces(df)
    examples = chat_format.explode_examples(pieces)
    with pytest.raises(Exception, match="breaks"):
        chat_format.read_back(pieces.where("seq = 1"), examples).collect()
    with pytest.raises(Exception, match="not a reply"):
        chat_format.read_back(pieces, examples.withColumn("loss_start", F.col("loss_start") - 1)).collect()
    with pytest.raises(Exception, match="another context"):
        chat_format.read_back(pieces, examples.withColumn("context_turns", F.col("context_turns") - 1)).collect()
    with pytest.raises(Exception, match="another context"):
        chat_format.read_back(pieces, examples.withColumn("stop", F.col("stop") + 1)).collect()
    assert chat_format.read_back(pieces, examples.where("target = 2")).first()["loss_chars"] == 1


def back(df):
    pieces = chat_format.format_pieces(df)
    return chat_format.read_back(pieces, chat_format.explode_examples(pieces))


def test_null_and_empty_roles_of_one_turn(spark):
    """As the registered SQL orders them."""
    import duckdb

    from tessella.llm import queries

    rows = [(1, 0, "", "b"), (1, 0, None, "a"), (1, 0, None, None), (1, 0, "", "a"), (1, None, "user", "last"), (1, 1, "assistant", None), (2, None, None, None)]
    got = back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").union(chat_format.control_conversation(spark)))
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = db.execute(queries.ORACLE_SQL["op3_chat_format"])
    names = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(found.fetchall())


def test_very_long_turns(spark):
    text = "<|x[" * 500_000
    r = back(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).first()
    assert (r["loss_chars"], r["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert back(df).count() == 0
    assert back(chat_format.control_conversation(spark)).first()["n_turns"] == 2


# --- WARC --------------------------------------------------------------------------


def test_archives(spark, small_batches, monkeypatch):
    monkeypatch.setattr(warc_zstd, "ARCHIVE_RECORDS", 5)
    long, other = "x" * 100, "é" * 50
    rows = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (3, "http://c", long), (None, "http://d", long), (1, "bad\r\nX: y z", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (10, "u", "P*M\x18\0\0\0\0" * 40), (None, None, "y" * 200), (None, None, "y" * 200), (11, "u", "z" * 300000)]
    rows += [(100 + i, f"http://n/{i}", f"<html>{i}</html>" * 20) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash")).withColumn("size", F.lit("clash"))
    path = new_path(spark, "test")
    got = warc_zstd.archived(df, path=path)
    least = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            least[p] = min(least.get(p, i), i)
    want = []
    for i, _, html in rows:
        p = (html or "").encode()
        again = p in least and i != least[p]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[p] if again else None))
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    payloads = {(r["page_id"], bytes(r["payload"])) for r in warc_zstd.read_archives(spark, path, payload=True).where("record_type = 'response'").collect()}
    assert (str(11), b"z" * 300000) in payloads
    assert {r["url"] for r in got.where("page_id = 1").collect()} == {"bad%0D%0AX:%20y%20z"}


def test_long_payloads_share_archives_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 700_000)
    draw = random.Random(4)
    rows = [(i, "u", "".join(draw.choices("abcdefgh", k=300_000))) for i in range(7)] + [(100 + i, "u", f"short {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = warc_zstd.archived(df)
    sizes = {r["archive"]: r["s"] for r in got.groupBy("archive").agg(F.sum("payload_bytes").alias("s")).collect()}
    assert got.count() == 27 and len(sizes) >= 5 and max(sizes.values()) <= 700_000


def small_archive(compressed=False):
    import zstandard

    words_ = b"WARC/1.1\r\nWARC-Type: response http html " * 40
    held = zstandard.ZstdCompressor().compress(words_) if compressed else words_
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words_))
    records = [warc_zstd.record("response", str(i), f"http://{i}", hashlib.sha256(b"p" * i).hexdigest(), None, b"p" * i, i) for i in (0, 3, 70000)]
    lead = struct.pack("<II", warc_zstd.DICTIONARY_MAGIC, len(held)) + held
    return lead + b"".join(encoder.compress(r) for r in records), records, len(lead)


def test_reader_walks_frames():
    for compressed in (False, True):
        data, records, _ = small_archive(compressed)
        assert [raw for _, raw in warc_zstd.read_archive(data)] == records
    assert list(warc_zstd.read_archive(b"")) == []


def test_reader_refuses_broken_archives():
    data, records, lead = small_archive()
    for bad, why in ((data[lead:], "dictionary"), (data[:-3], "short"), (data[: lead + 2], "short"), (data[:lead] + b"garbage!" + data[lead:], "neither"), (data[:20], "short")):
        with pytest.raises(ValueError, match=why):
            list(warc_zstd.read_archive(bad))
    good = records[1]
    for bad, why in ((good.replace(b"WARC/1.1", b"HTTP/1.1"), "version"), (good.replace(b"Content-Length: 3", b"Content-Length: 4"), "length"), (good[:-2], "length"), (good.replace(b"ppp", b"ppq"), "digest"), (good.replace(b"WARC-Date", b"WARC-Dote"), "date"), (b"WARC/1.1\r\n", "headers")):
        with pytest.raises(ValueError, match=why):
            warc_zstd.parse_record(bad)


def test_no_pages(spark):
    assert warc_zstd.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- token counts ------------------------------------------------------------------


def test_rollup(spark):
    store = token_rollup.RollupStore(spark, new_path(spark, "rollup"))
    schema = "doc_id long, source string, lang string, version string, tokens long"
    a = spark.createDataFrame([(1, "s", "en", "v1", 10), (2, "s", "en", "v1", 5), (3, None, "de", "v1", 7), (1, "s", "en", "v2", 20), (None, "t", None, "v1", 1), (4, "t", "en", "v1", None)], schema)
    assert store.totals().count() == 0
    assert store.commit("a", inserts=a) and not store.commit("a", inserts=a)
    d = spark.createDataFrame([(2, "v1"), (2, "v1"), (99, "v1"), (None, "v1")], "doc_id long, version string")
    r = spark.createDataFrame([(1, "v1", 12), (2, "v1", 50), (3, "v1", 6), (88, "v1", 1)], "doc_id long, version string, tokens long")
    assert store.commit("b", deletes=d, revisions=r)
    want = {("s", "en", "v1"): (1, 12), (None, "de", "v1"): (1, 6), ("s", "en", "v2"): (1, 20), ("t", "en", "v1"): (1, 0)}
    totals = lambda: {(x["source"], x["lang"], x["version"]): (x["docs"], x["tokens"]) for x in store.totals().collect()}
    assert totals() == want and not store.commit("b", deletes=d, revisions=r) and totals() == want
    assert store.commit("c", inserts=a.limit(0)) and totals() == want
    # a batch that died before its marker is invisible, and its next attempt replaces it
    a.write.mode("overwrite").parquet(store._folder("ledger", "d"))
    a.selectExpr("source", "lang", "version", "1L as docs", "tokens").write.mode("overwrite").parquet(store._folder("deltas", "d"))
    assert totals() == want
    assert store.commit("d", inserts=spark.createDataFrame([(9, "s", "en", "v1", 1)], schema))
    assert totals()["s", "en", "v1"] == (2, 13)
    with pytest.raises(ValueError):
        store.commit("x/y")


def test_rollup_without_success_markers(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store = token_rollup.RollupStore(spark, new_path(spark, "rollup"))
        rows = spark.createDataFrame([(1, "s", "en", "v", 5)], "doc_id long, source string, lang string, version string, tokens long")
        assert store.commit("a", inserts=rows) and not store.commit("a", inserts=rows)
        assert store.commit("b", deletes=rows.select("doc_id", "version").limit(0))
        assert store.batches() == ["a", "b"]
        assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 1, 5)]
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_rollup_equals_recount(spark):
    """The registered scenario at once against counting what is left."""
    from tessella.llm.queries import TOKENIZERS, op8_token_rollup

    d = "/root/testdata/sf0.001"
    got = {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in op8_token_rollup(spark, d).collect()}
    import re

    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    first = {}
    for r in docs:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    want = defaultdict(lambda: [0, 0])
    for name, file in (("byte_bpe_50k/1", "byte_bpe_50k"), ("byte_bpe_multi_50k/1", "byte_bpe_multi_50k")):
        count = token_rollup.byte_bpe(f"{TOKENIZERS}/{file}.tiktoken")
        for r in docs:
            if first[r["text"]] == r["doc_id"]:
                text = re.sub(r"[ \t]+(?=\n|$)|(?<=\n)[ \t]+|\n+$", "", r["text"])
                want[r["source"], r["lang"], name][0] += 1
                want[r["source"], r["lang"], name][1] += count([text])[0]
    assert got == {k: tuple(v) for k, v in want.items()}


def test_long_texts_count_in_parts(monkeypatch):
    count = token_rollup.byte_bpe("/opt/tokenizers/byte_bpe_50k.tiktoken")
    text = "\n".join(["word  and\tmore \n\n  then some é words 12 !!", ""] * 4000)
    whole = count([text])
    monkeypatch.setattr(token_rollup, "_parts", lambda t: [t])
    assert whole == count([text])


# --- mixing ------------------------------------------------------------------------


def test_targets():
    assert mix_flow.targets([100, 100, 100], [3, 1, 2], 450) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mix_flow.targets([0, 0], [3, 1], 0) == [0, 0]
    assert sum(mix_flow.targets([10, 1000, 50], [3, 1, 2], 900)) == pytest.approx(900)


def test_flow_is_cheapest():
    """Against all ways to route whole tokens, on small cases."""
    draw = random.Random(5)
    for _ in range(60):
        sources = "ab" if draw.random() < 0.5 else "abc"
        patterns = [(frozenset(draw.sample(sources, draw.randint(1, len(sources)))), draw.randint(1, 3)) for _ in range(3)]
        quotas = {s: draw.randint(0, 4) for s in sources}
        flow = mix_flow.min_cost_flow(patterns, quotas)
        used = [sum(v for (p, _), v in flow.items() if p == i) for i in range(3)]
        assert all(u <= 2 * n for u, (_, n) in zip(used, patterns)) and all(s in patterns[p][0] for p, s in flow)
        met = sum(flow.values())
        cost = sum(max(0, u - n) for u, (_, n) in zip(used, patterns))
        best = None
        choices = [[(i, s) for s in sorted(p)] for i, (p, _) in enumerate(patterns)]
        edges = [e for c in choices for e in c]
        for amounts in itertools.product(*(range(min(quotas[s], 2 * patterns[i][1]) + 1) for i, s in edges)):
            into = defaultdict(int)
            out = [0] * 3
            for (i, s), x in zip(edges, amounts):
                into[s] += x
                out[i] += x
            if all(into[s] <= quotas[s] for s in quotas) and all(o <= 2 * n for o, (_, n) in zip(out, patterns)):
                score = (-sum(amounts), sum(max(0, o - n) for o, (_, n) in zip(out, patterns)))
                best = score if best is None else min(best, score)
        assert (-met, cost) == best


@pytest.mark.parametrize("overlap", [False, True])
def test_mix(spark, documents, overlap):
    draw = random.Random(6)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 30, 400])), "en", draw.choice(["a", "b", "c", None]), 0) for i in range(300)]
    rows += [(500, None, "en", "a", 0), rows[4], rows[4], (None, "one two", "en", "b", 0)]
    docs = documents(rows)
    sources = F.when((F.col("doc_id") % 3 == 0) & F.lit(overlap), F.array(F.lit("a"), F.lit("c"))).otherwise(F.array("source"))
    docs = docs.withColumn("sources", sources)
    got = mix_flow.mix(docs, mix_flow.round_robin, carry=["text", "lang"]).collect()
    assert len(got) == len(rows) and sorted(repr((r["doc_id"], r["size"])) for r in got) == sorted(repr((i, len(words(t)))) for i, t, *_ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    if not overlap:
        taken, sizes, target = defaultdict(int), defaultdict(int), {}
        for r in got:
            (source,) = r["sources"]
            taken[source] += r["taken"]
            sizes[source] += r["size"]
            target[source] = r["targets"][0]
        names = ["a", "b", "c", None]
        assert [target[s] for s in names] == pytest.approx(mix_flow.targets([sizes[s] for s in names], [3, 1, 2, 3], 1.5 * sum(sizes.values())))
        assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mix_flow.mix(docs.repartition(5), mix_flow.round_robin).collect()
    assert sorted(repr((r["doc_id"], r["taken"])) for r in again) == sorted(repr((r["doc_id"], r["taken"])) for r in got)


def test_mix_of_nothing(spark, documents):
    docs = documents([]).withColumn("sources", F.array("source"))
    assert mix_flow.mix(docs, mix_flow.round_robin).count() == 0
    blank = documents([(1, "", "en", "a", 0), (2, None, "en", None, 0)]).withColumn("sources", F.array("source"))
    assert [r["taken"] for r in mix_flow.mix(blank, mix_flow.round_robin).collect()] == [0, 0]
