"""Operators on texts against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate, lattice_lm, near_dup, quality_cnn, substring_dedup
from tessella.llm import words as W

from .conftest import words

ODD = [None, "", "   \t\n", "one", "Ünï \x1f code", "a b", "A  B\r\n", "x " * 300, "long" * 5000]


def random_texts(n, seed, vocabulary=60, longest=120):
    """Texts over few words, with copies, shared passages and near copies."""
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passages = [" ".join(draw.choices(vocab, k=draw.randint(13, 40))) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = draw.random()
        if out and kind < 0.2:
            out.append(draw.choice(out))
        elif out and kind < 0.5:
            base = draw.choice(out).split()
            for _ in range(draw.randint(1, 4)):
                if base:
                    base[draw.randrange(len(base))] = draw.choice(vocab).upper()
            out.append(" ".join(base))
        else:
            parts = draw.choices(vocab, k=draw.randint(0, longest))
            if draw.random() < 0.5:
                parts.insert(draw.randint(0, len(parts)), draw.choice(passages))
            out.append("\n".join(parts) if draw.random() < 0.2 else " ".join(parts))
    return out


# --- kernel ------------------------------------------------------------------------


def test_words_kernel():
    texts = [t for t in ODD if t is not None] + random_texts(30, 1)
    data, offsets = W.text_buffers(pa.array(texts))
    found = W.Words(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(found.start, found.end)] == [w for t in texts for w in words(t)]
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    by_hash = defaultdict(set)
    for h, w in zip(found.hashes(lower=True).tolist(), (w for t in texts for w in words(t, True))):
        by_hash[h].add(w)
    assert all(len(x) == 1 for x in by_hash.values())
    # slices give the same hashes as the whole
    pieces = [W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]).hashes() for a, z in W.slices(offsets, 100)]
    assert np.array_equal(np.concatenate(pieces), found.hashes())


def test_minimizers():
    h = np.random.default_rng(0).integers(0, 50, 200, dtype=np.uint64)
    for w in (1, 2, 3, 9):
        assert W.minimizers(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


# --- substring dedup ---------------------------------------------------------------


def brute_dedup(rows, k):
    first = {}
    key = lambda i: (i is None, i)
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, key(doc)), key(doc))
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < key(doc):
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [3, 13])
def test_substring_dedup(spark, documents, small_batches, k):
    texts = ODD + random_texts(70, 5 + k)
    rows = list(enumerate(texts))
    random.Random(2).shuffle(rows)
    rows += [rows[3], rows[10], (rows[20][0], "other " + (rows[21][1] or "")), (None, texts[-1]), (None, texts[-2])]
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs, k=k).collect()), key=repr)
    assert got == brute_dedup(rows, k)


def test_without_repeats_keeps_columns(spark, documents):
    base = " ".join(f"v{i}" for i in range(40))
    docs = documents([(1, f"a\n{base}", "en", "s", 1), (2, f"{base} own words here", "de", "t", 2), (3, base, None, None, 3), (4, "", "fr", "u", 0)])
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs).collect()}
    assert sorted(got) == [1, 2, 4] and got[1]["text"] == f"a\n{base}" and got[2]["text"] == "own words here" and got[2]["lang"] == "de"
    assert got[4].asDict().keys() == set(docs.columns)


def test_paths_name_their_sources(spark):
    base = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(5, "x " + base), (9, "y z " + base + " q")], "doc_id long, text string")
    row = substring_dedup.repeated_paths(docs).collect()
    assert [(r["doc"], r["start"], r["edges"], r["source"], r["source_start"]) for r in row] == [(9, 2, 18, 5, 1)]
    assert row[0]["digest"] in (None, hashlib.blake2b(base.encode(), digest_size=16).digest())


def test_equal_hashes_of_different_words_are_found(spark, monkeypatch):
    """Nodes told apart by six bits alone: some path does not have its source's words."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(random_texts(60, 12, vocabulary=2000))], "doc_id long, text string")
    made = substring_dedup._edges

    def weak(*args):
        run = made(*args)

        def masked(batches):
            for b in run(batches):
                cut = [pa.array(b.column(i).to_numpy() & 63) for i in range(2)]
                yield pa.record_batch([*cut, *(b.column(i) for i in range(2, 7))], names=b.schema.names)

        return masked

    monkeypatch.setattr(substring_dedup, "_edges", weak)
    with pytest.raises(Exception, match="another seed"):
        substring_dedup.dedup_substrings(docs).collect()


def test_equal_hashes_within_a_batch_are_found(monkeypatch):
    texts = [" ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))]
    hits = pa.array([list(range(64))] * 2, pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array([1, 2]), pa.array(texts), pa.array([5, 6]), hits], names=["doc", "text", "part", "hits"])
    made = W.rolling
    monkeypatch.setattr(W, "rolling", lambda hashes, k: made(hashes, k) & np.uint64(3))
    with pytest.raises(ValueError, match="another seed"):
        list(substring_dedup._edges(13)(iter([batch])))


def test_another_seed_gives_the_same(spark):
    rows = list(enumerate(random_texts(50, 13)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs, seed=3).collect()), key=repr) == brute_dedup(rows, 13)


def test_many_rows_without_an_id_or_with_one(spark):
    base = " ".join(f"v{i}" for i in range(30))
    rows = [(None, f"n{i} {base} m{i}") for i in range(40)] + [(7, f"s {base}")] * 30 + [(7, f"other {base} text")] + [(3, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()), key=repr) == brute_dedup(rows, 13)


def brute_unitigs(rows, k):
    """Nonbranching paths of the graph of edges that two documents hold, as word lists."""
    held, seen = defaultdict(set), {}
    for doc, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - k + 1):
            held[tuple(w[i : i + k])].add(doc)
    edges = {g for g, docs in held.items() if len(docs) > 1}
    outs, ins = defaultdict(list), defaultdict(list)
    for g in edges:
        outs[g[:-1]].append(g)
        ins[g[1:]].append(g)
    single = lambda node: len(ins[node]) == len(outs[node]) == 1
    paths = []
    for g in edges:
        if single(g[:-1]):
            continue
        path = [g]
        while single(path[-1][1:]):
            path.append(outs[path[-1][1:]][0])
        paths.append(tuple(path[0]) + tuple(x[-1] for x in path[1:]))
    return sorted(paths)


@pytest.mark.parametrize("k", [4, 13])
def test_unitigs(spark, small_batches, k):
    """Two sources that branch, one path over several sources, and passages at random."""
    u, v, x = (" ".join(f"{c}{i}" for i in range(25)) for c in "uvx")
    rows = [(1, f"a {u} b"), (2, f"c {u} {v} d"), (3, f"e {u} {x} f"), (4, f"g {u} {v} h"), (5, f"{u} {x}"), (6, f"{v} tail one"), (7, f"{x} {v}"), (8, f"k {x} {v} l")]
    rows += [(10, " ".join(f"p{i}" for i in range(20)) + " z"), (11, "y " + " ".join(f"p{i}" for i in range(40))), (12, " ".join(f"p{i}" for i in range(5, 40)) + " w")]
    texts = random_texts(30, 40 + k, vocabulary=400)
    rows += [(100 + i, t) for i, t in enumerate(texts) if t not in texts[:i]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text, found = dict(rows), defaultdict(list)
    for r in substring_dedup.unitigs(docs, k=k).collect():
        found[r["unitig_doc"], r["unitig_place"]].append((r["offset"], r["doc"], r["place"] & 0xFFFFFFFF, r["edges"]))
    paths = []
    for parts in found.values():
        out, at = (), 0
        for offset, doc, place, edges in sorted(parts):
            assert offset == at
            w = tuple(words(text[doc])[place : place + edges + k - 1])
            assert not out or out[1 - k :] == w[: k - 1]
            out, at = out + (w[k - 1 :] if out else w), at + edges
        paths.append(out)
    assert sorted(paths) == brute_unitigs(rows, k) and len(paths) > 5


def test_unitigs_of_nothing(spark):
    assert substring_dedup.unitigs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_do_not_depend_on_batches(spark, monkeypatch):
    """Each pass over the texts gets them in other batches, as after a lost executor."""
    made, passes = substring_dedup._anchors, []

    def cut(*args):
        run, rows = made(*args), 1 if passes else 1000
        passes.append(rows)
        return lambda batches: run(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    monkeypatch.setattr(substring_dedup, "_anchors", cut)
    base = " ".join(f"v{i}" for i in range(30))
    rows = [(i, f"x{i} {base} y{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()), key=repr) == brute_dedup(rows, 13)


# --- near duplicates ---------------------------------------------------------------


def brute_groups(rows, width=2):
    def shingles(text):
        w = words(text, True)
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[label[i]] = doc if least[label[i]] is None else min(least[label[i]], doc)
    return sorted(((doc, len(sets[i]), least[label[i]], doc == least[label[i]]) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed,bounds", [(1, {}), (2, {"NODE": 3, "BLOCK_SETS": 4, "PIVOTS": 1}), (3, {"NODE": 3, "BLOCK_SHINGLES": 300, "DEPTH": 3})])
def test_near_duplicates(spark, documents, small_batches, monkeypatch, seed, bounds):
    for name, v in bounds.items():
        monkeypatch.setattr(near_dup, name, v)
    rows = list(enumerate(ODD + random_texts(90, 100 + seed)))
    rows += [rows[12], (None, rows[15][1]), (None, "nobody else has this text at all"), (500, rows[-1][1])]
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr)
    assert got == brute_groups(rows)


@pytest.mark.parametrize("width", [1, 3, 5])
def test_wider_shingles(spark, documents, width):
    rows = list(enumerate(ODD + random_texts(60, 300 + width)))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs, width=width).collect()), key=repr) == brute_groups(rows, width)


def loose_rows(n):
    """Documents that share 78 words and have 80 of their own each: no two are linked."""
    shared = " ".join(f"s{i}" for i in range(78))
    return [(i, shared + " " + " ".join(f"o{i}x{j}" for j in range(80))) for i in range(n)]


def test_members_of_a_loose_cluster_do_not_meet(spark, monkeypatch):
    """Rows of the exact stage grow in proportion to a cluster that one boilerplate joins."""
    monkeypatch.setattr(near_dup, "NODE", 16)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 40)
    counts = {}
    wanted, there, visits = near_dup.undecided_tokens, near_dup.block_tokens, near_dup.visits

    def counted(name, made):
        def run(*args):
            out = made(*args)
            counts.setdefault(name, []).append(out.count())
            return out

        return run

    monkeypatch.setattr(near_dup, "undecided_tokens", counted("wanted", wanted))
    monkeypatch.setattr(near_dup, "block_tokens", counted("there", there))
    monkeypatch.setattr(near_dup, "visits", counted("visits", visits))
    for n in (200, 400):
        docs = spark.createDataFrame(loose_rows(n), "doc_id long, text string")
        assert near_dup.near_duplicates(docs).where("kept and component_id = doc_id").count() == n
    for few, many in counts["wanted"], counts["there"]:
        assert 0 < few and many < 2.5 * few
    assert counts["visits"] == [0, 0]


def test_links_of_undecided_members_are_found(spark, monkeypatch):
    """Chains through one boilerplate: links lie across blocks, and both ends share it."""
    monkeypatch.setattr(near_dup, "NODE", 16)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 10)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    draw = random.Random(9)
    rows = loose_rows(60)
    for i, text in list(rows):
        for c in range(draw.randint(0, 3)):
            w = text.split()
            for _ in range(draw.randint(1, 12)):
                w[draw.randrange(len(w))] = f"c{i}x{c}x{draw.randrange(1000)}"
            rows.append((1000 + 10 * i + c, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)


def test_common_shingles_do_not_multiply_visits(spark):
    """Members whose shingles all blocks hold: the join has a row for each of a member's
    shingles and 64 blocks, and each visit comes once."""
    tokens, blocks = 30, 70
    members = spark.range(20 * tokens).select(F.lit(5).cast("long").alias("root"), (F.col("id") % 20).alias("key"), F.floor(F.col("id") / 20).alias("token"), (F.col("id") % 20 * 4 % blocks).alias("block"))
    there = spark.range(tokens * blocks).select(F.lit(5).cast("long").alias("root"), (F.col("id") % blocks).alias("block"), F.floor(F.col("id") / blocks).alias("token"))
    got = near_dup.visits(members.select("root", "block", "token", "key"), there)
    assert sorted((r["key"], r["block"]) for r in got.collect()) == [(k, b) for k in range(20) for b in range(blocks) if b != k * 4 % blocks]
    made, nodes = [], [got._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        if name == "SortMergeJoin":
            made.append(node.metrics().apply("numOutputRows").value())
    assert made and max(made) <= 20 * blocks < 20 * tokens * blocks / 10


def test_rows_without_an_id_do_not_meet_each_other(spark):
    texts = random_texts(30, 5, longest=40)
    rows = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)


def test_recall_on_the_supplied_documents(spark):
    """Against an exact join by inverted lists of whole sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE", 16)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 40)
    draw = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(200):
        copy = list(base)
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(60)] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)


def test_many_partitions_in_few_tasks(spark, documents, small_batches, monkeypatch):
    """More shuffle partitions than tasks: sorted streams run over several of them."""
    monkeypatch.setattr(near_dup, "NODE", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = list(enumerate(random_texts(80, 77)))
        docs = documents([(i, t, "en", "s", 0) for i, t in rows])
        assert sorted((tuple(r) for r in near_dup.near_duplicates(docs).collect()), key=repr) == brute_groups(rows)
        assert sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs, k=4).collect()), key=repr) == brute_dedup(rows, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_words_in_a_document(spark):
    rows = [(1, "a b " * 40), (2, "x " + "a b " * 30 + "y"), (3, "b " * 50), (4, "b " * 20 + "c d"), (5, "c " * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()), key=repr) == brute_dedup(rows, 13)


def test_keep_one(spark, documents):
    text = " ".join(f"k{i}" for i in range(50))
    docs = documents([(3, text, "en", "a", 1), (1, text.upper(), "de", "b", 2), (1, text.upper(), "de", "b", 2), (2, "", "fr", "c", 0), (None, "lonely text", "es", "d", 4)])
    docs = docs.withColumn("kept", F.lit("x")).withColumn("nth", F.lit("x")).withColumn("_kept", F.lit("x"))
    got = near_dup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["lang"]) for r in got.collect()), key=repr) == [(1, "de"), (2, "fr"), (None, "es")]


def test_trees_follow_recall():
    assert near_dup.trees_for(0.9) <= near_dup.trees_for(0.999) <= near_dup.trees_for(0.99999) == 5


# --- decontamination ---------------------------------------------------------------


def brute_leaks(docs, items):
    def bag(w):
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    out = {}
    for doc, text in docs:
        w = words(text, True)
        for item, other in items:
            x = words(other, True)
            if not x:
                continue
            b = bag(x)
            for s in range(max(1, len(w) - len(x) + 1) if w else 0):
                a = bag(w[s : s + len(x)])
                least = sum((a & b).values())
                sim = least / sum((a | b).values())
                if sim >= 0.8 and (sim, -s) > out.get((doc, item), (0, 0))[:2]:
                    out[doc, item] = (sim, -s, min(len(x), len(w)))
    return sorted((d, i, -s, n, round(v, 12)) for (d, i), (v, s, n) in out.items())


def test_decontamination(spark, documents, small_batches):
    draw = random.Random(4)
    items = [(i, " ".join(f"q{draw.randrange(400)}" for _ in range(n))) for i, n in enumerate([3, 5, 9, 14, 20, 20, 35, 50])]
    items += [(98, None), (99, " "), (7, items[7][1])]
    docs = list(enumerate(ODD + random_texts(20, 9)))
    for i, (_, text) in enumerate(items[:8]):
        w = text.split()
        docs.append((1000 + i, "pre " + text.upper() + " post"))
        if len(w) > 15:
            docs.append((2000 + i, "x y " + " ".join([*w[:-1], "changed"]) + " z"))
            docs.append((3000 + i, " ".join([*w[:3], "in", *w[3:]])))
            docs.append((4000 + i, " ".join(w[: len(w) // 2])))
    table = spark.createDataFrame(items, "item_id long, text string")
    made = documents([(i, t, "en", "s", 0) for i, t in docs])
    got = sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 12)) for r in decontaminate.find_leaks(made, table).collect())
    want = brute_leaks(docs, items)
    assert got == want and {d for d, *_ in want} >= set(range(1000, 1008))
    kept = {r["doc_id"] for r in decontaminate.drop_leaking(made, table).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}


def test_documents_shorter_than_an_item(spark):
    item = [f"i{j}" for j in range(15)]
    rows = [(1, " ".join(item[:14])), (2, " ".join(item[1:])), (3, " ".join(item[:12])), (4, " ".join(item[:13])), (5, "i0"), (6, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "i0 i1 i2")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_word"], r["n_words"], round(r["similarity"], 12)) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == brute_leaks(rows, [(1, " ".join(item)), (2, "i0 i1 i2")])
    assert {1, 2, 6} <= {g[0] for g in got if g[1] == 1}
    assert {r["doc_id"] for r in decontaminate.drop_leaking(docs, items).collect()} == {r[0] for r in rows} - {g[0] for g in got}


def test_multi_index_finds_all_within_radius():
    draw = np.random.default_rng(0)
    bits = draw.integers(0, 2, (50, decontaminate.BITS))
    group = decontaminate._Group([(i, b) for i, b in enumerate(bits)])
    probes = np.repeat(bits, 20, axis=0)
    for row in probes:
        row[draw.choice(decontaminate.BITS, draw.integers(0, 48), replace=False)] ^= 1
    rows, items = group.candidates(probes)
    near = (probes[:, None, :] != bits[None, :, :]).sum(axis=2) <= decontaminate.RADIUS
    assert set(zip(rows.tolist(), items.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_items_in_several_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(6)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('a ', text, ' b') as text")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 150)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(i, i) for i in range(6)}
    assert decontaminate.drop_leaking(docs, items).count() == 0


# --- language model ----------------------------------------------------------------

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def test_lattice_sums_all_segmentations():
    pieces = sorted([b" a", b"a", b"ab", b"b", b" ab", b" ", b"c", b"abc"])
    logs = np.log(np.linspace(1, 2, len(pieces)) / 20)
    lattice = lattice_lm.Lattice(pieces, logs)
    prob = dict(zip(pieces, np.exp(logs)))

    def brute(w):
        return 1.0 if not w else sum(p * brute(w[len(x) :]) for x, p in prob.items() if w.startswith(x))

    for word in (b" a", b" ab", b" abc", b" abab", b" ccabcab"):
        text = np.frombuffer(word, np.uint8)
        assert lattice.forward(text[None, :])[0] == pytest.approx(math.log(brute(word)))
        assert lattice.long_word(text) == pytest.approx(math.log(brute(word)))
        one, two = np.zeros(len(pieces)), np.zeros(len(pieces))
        lattice.expected(text[None, :], np.array([2.0]), one)
        lattice.long_word(text, 2.0, two)
        assert one == pytest.approx(two)
        assert sum(c * len(p) for c, p in zip(one, pieces)) == pytest.approx(2 * len(word))


def test_scores_equal_a_plain_recursion(spark, monkeypatch):
    """With the pieces' first probabilities kept: every word's paths by a plain loop."""
    monkeypatch.setattr(lattice_lm, "fit", lambda counts, pieces, scores: lattice_lm.start_logs(scores))
    monkeypatch.setattr(lattice_lm, "HEAD", 20)
    names, scores = lattice_lm.load_pieces(VOCABULARY)
    prob = dict(zip(names, np.exp(lattice_lm.start_logs(scores))))
    longest = max(map(len, names))
    rows = list(enumerate(ODD[:8] + random_texts(40, 23)))
    tokens = [words(t, True) for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, docs = sum(c.values()), sum(not h for h in held)
    whole = n / (n + len(c))

    def lattice(word):
        alpha = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            alpha[end] = sum(alpha[s] * prob.get(word[s:end], 0.0) for s in range(max(0, end - longest), end))
        return alpha[-1]

    def score(ws):
        each = [math.log10((whole * c[w] / n + (1 - whole) * lattice(b" " + w)) * (n + 1) / (n + docs + 2)) for w in ws]
        return sum(each) + math.log10((docs + 1) / (n + docs + 2))

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score_texts(frame, VOCABULARY).collect()}
    assert got == pytest.approx({i: score(ws) for (i, _), ws in zip(rows, tokens)}, rel=1e-9)


def test_held_out_texts(spark):
    """Pieces alone gave -5.35 a token here.  The word base (-4.07) is no yardstick: it
    gives the weight of all unknown words together to each of them."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lattice_lm.score_texts(frame, VOCABULARY).where("held_out")
    sums = held.agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert sums["s"] / sums["n"] > -4.8


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_language_model(spark, documents, small_batches, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    rows = list(enumerate(ODD + random_texts(60, 21)))
    rows += [rows[11], rows[11], (None, "no id"), (12, "same id")]
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    got = sorted((tuple(r) for r in lattice_lm.score_texts(docs, VOCABULARY).collect()), key=repr)
    tokens = [[*words(t, True), None] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(t for ts, h in zip(tokens, held) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for (i, _), h, ts in zip(rows, held, tokens)), key=repr)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert [g[5] for g in got] == pytest.approx([x[5] for x in want])
    assert all(g[6] < 0 for g in got)


# --- quality -----------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = quality_cnn.fit(docs, labels)
    scored = quality_cnn.score(docs, net).join(labels, "doc_id").where(quality_cnn.held_out("doc_id")).toPandas()
    kept = scored["score"] >= quality_cnn.KEEP
    assert (kept == (scored["quality"] == 1)).mean() > 0.97 and kept[scored["quality"] == 1].mean() > 0.99


def test_quality_edges(spark, documents):
    rows = list(enumerate(ODD))
    docs = documents([(i, t, "en", "s", 0) for i, t in rows])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score(docs, net).collect()}
    assert len(got) == 9 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    none = quality_cnn.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_cnn.score(docs, none).collect()} == {0.5}
    assert quality_cnn.keep_good(docs, none).columns == docs.columns


def test_segments_do_not_change_scores(monkeypatch):
    net = quality_cnn.Network(3)
    texts = [b"", b"a", b"ab cd" * 500, b"x" * 31, b"y" * 64, b"z " * 1000]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality_cnn.score_bytes(net, data, offsets)
    monkeypatch.setattr(quality_cnn, "SEGMENT", 3)
    assert quality_cnn.score_bytes(net, data, offsets) == pytest.approx(whole, abs=1e-5)
    alone = [quality_cnn.score_bytes(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert alone == pytest.approx(whole, abs=1e-5)


def plain_score(net, text):
    """The network as its docstring says it, a filter and a chunk at a time."""
    w = net.w
    blocks = max(1, -(-len(text) // 32))
    padded = list(text) + [0] * (32 * (blocks + 2) - len(text))
    answers = []
    for at in range(0, 32 * (blocks + 1), 2):
        answers.append([max(0.0, sum(float(w["filters"][j, padded[at + j], f]) for j in range(4)) + float(w["bias"][f])) for f in range(quality_cnn.FILTERS)])
    units = [-math.inf] * quality_cnn.UNITS
    for chunk in range(blocks):
        mean = np.mean(answers[16 * chunk : 16 * chunk + 32], axis=0)
        features = [*mean, *(m * m for m in mean)]
        for u in range(quality_cnn.UNITS):
            units[u] = max(units[u], sum(f * float(w["units"][i, u]) for i, f in enumerate(features)) + float(w["lift"][u]))
    x = sum(max(0.0, u) * float(o) for u, o in zip(units, w["out"])) + float(w["shift"][0])
    return 1 / (1 + math.exp(-x))


def test_scores_equal_a_plain_convolution(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(25).collect()
    texts = [b"", b"a", b"x" * 31, b"y" * 64, *((r["text"] or "").encode()[:3000] for r in rows)]
    net = quality_cnn.train(texts, np.array([i % 2 for i in range(len(texts))], float), epochs=1)
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert quality_cnn.score_bytes(net, data, offsets) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


@pytest.mark.parametrize("segment", [2048, 2])
def test_gradient(monkeypatch, segment):
    """Also where a document has several segments: its units are pooled over all."""
    monkeypatch.setattr(quality_cnn, "SEGMENT", segment)
    net = quality_cnn.Network(5)
    texts, label = [b"hello world, this is one", b"THE!! OTHER!! ONE!!" * 16], np.array([1.0, 0.0])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grad = net.gradient(list(quality_cnn.segments(data, offsets)), label, np.ones(2))

    def loss():
        net.tabled = None
        p = quality_cnn.score_bytes(net, data, offsets)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, at in (("out", 3), ("shift", 0), ("lift", 4), ("units", (5, 6)), ("bias", 2), ("filters", (1, ord("E"), 7))):
        keep, step = net.w[name][at], 1e-2
        net.w[name][at] = keep + step
        up = loss()
        net.w[name][at] = keep - step
        down = loss()
        net.w[name][at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=5e-3), name


def test_the_fit_reads_whole_texts_of_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels: seen.append((texts, labels)) or quality_cnn.Network())
    long = "filler " * 20_000 + "the end"
    docs = spark.createDataFrame([(i, long if i == 4 else f"text {i}") for i in range(40)] + [(4, "other")] * 3 + [(6, f"copy {j}") for j in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    quality_cnn.fit(docs, labels)
    quality_cnn.fit(docs, labels, sample=10)
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0][0]) == len(learned) and len(seen[1][0]) <= 10
    if 4 in learned:
        assert {long.encode(), b"other"} & {bytes(t) for t in seen[0][0]}


# --- empty tables ------------------------------------------------------------------


def test_empty_tables(spark, documents):
    docs = documents([])
    items = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.dedup_substrings(docs).count() == 0
    assert substring_dedup.without_repeats(docs).count() == 0
    assert near_dup.near_duplicates(docs).count() == 0
    assert near_dup.keep_one(docs).count() == 0
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert decontaminate.drop_leaking(docs, items).count() == 0
    assert lattice_lm.score_texts(docs, VOCABULARY).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_cnn.score(docs, quality_cnn.fit(docs, labels)).count() == 0


def test_long_pieces_of_a_vocabulary_count(monkeypatch):
    import sentencepiece

    names = ["a", "▁" + "क" * 12]

    class Model:
        def __init__(self, model_file):
            pass

        is_control = is_unknown = is_byte = lambda self, i: False
        get_piece_size = lambda self: len(names)
        id_to_piece = lambda self, i: names[i]
        get_score = lambda self, i: -float(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    pieces, scores = lattice_lm.load_pieces("any")
    long = (" " + "क" * 12).encode()
    assert long in pieces
    logs = lattice_lm.start_logs(scores)
    whole = lattice_lm.Lattice(pieces, logs).forward(np.frombuffer(long, np.uint8)[None])[0]
    assert whole >= logs[pieces.index(long)]
