"""The ten operators' registered queries and their SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, text_hashes, whole_copies, written

#: Where public tokenizers' files are; a parameter of the operators that read them.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lattice_lm(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    from .lattice_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"), vocabulary)


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import KEEP, fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op4_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix_flow import mix, round_robin

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    mixed = mix(docs, round_robin, budget=1.5)
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zstd import archived

    records = archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nra_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import control_conversation, explode_examples, format_pieces, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pieces = written(format_pieces(rows.unionByName(control_conversation(spark))), "chat")
    return read_back(pieces, explode_examples(pieces))


def op8_token_rollup(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after four commits: all documents counted by two tokenizer versions;
    whole copies deleted; counts revised for texts whose lines are trimmed; and the
    deletes sent once more, which changes nothing."""
    from .token_rollup import RollupStore, byte_bpe, count_tokens

    one, two = f"{tokenizers}/byte_bpe_50k.tiktoken", f"{tokenizers}/byte_bpe_multi_50k.tiktoken"
    versions = {"byte_bpe_50k/1": lambda: byte_bpe(one), "byte_bpe_multi_50k/1": lambda: byte_bpe(two)}
    docs = table(spark, sf_dir, "documents")
    store = RollupStore(spark, new_path(spark, "rollup"))
    store.commit("1-inserts", inserts=count_tokens(docs, versions, ["doc_id", "source", "lang"]))
    copies = whole_copies(docs.select("doc_id", *text_hashes()), "doc_id")
    copies = copies.select("doc_id", F.explode(F.array(*map(F.lit, versions))).alias("version"))
    store.commit("2-deletes", deletes=copies)
    trimmed = F.regexp_replace("text", r"[ \t]+(?=\n|$)|(?<=\n)[ \t]+|\n+$", "")
    changed = docs.select("doc_id", trimmed.alias("new"), "text").where("new != text").select("doc_id", F.col("new").alias("text"))
    store.commit("3-revisions", revisions=count_tokens(changed, versions, ["doc_id"]))
    store.commit("2-deletes", deletes=copies)
    return store.totals()


QUERIES = {
    "op3_chat_format": op3_chat_format,
    "op8_token_rollup": op8_token_rollup,
    "op2_nra_topk": op2_nra_topk,
    "op5_warc_zstd": op5_warc_zstd,
    "op4_mix_flow": op4_mix_flow,
    "op1_quality_cnn": op1_quality_cnn,
    "op6_lattice_lm": op6_lattice_lm,
    "op9_decontaminate": op9_decontaminate,
    "op10_near_dup": op10_near_dup,
    "op7_substring_dedup": op7_substring_dedup,
}

ORACLE_SQL = {
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 25 + 2 * length(role) - length(translate(role, '<[|\', '')) + 2 * length(text) - length(translate(text, '<[|\', '')) AS size FROM c),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant')::BIGINT AS n_examples, coalesce(sum(stop) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM p GROUP BY conv_id
""",
    "op2_nra_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""",
    "op5_warc_zstd": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS r FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, n AS payload_bytes, p.h AS payload_digest,
       CASE WHEN r IS NULL OR r = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r IS NULL OR r = p.page_id THEN NULL ELSE r END AS refers_to
FROM p LEFT JOIN first ON p.h = first.h
""",
    "op9_decontaminate": r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
           UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
item AS (SELECT id AS item_id, ws, len(ws) AS words, least(5, len(ws)) AS width FROM t WHERE kind = 'i' AND len(ws) > 0),
ig AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, array_to_string(ws[p:p+width-1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, words - width + 1)) AS p FROM item)) GROUP BY ALL),
dg AS (SELECT id AS doc_id, width, p, array_to_string(ws[p:p+width-1], ' ') AS g FROM (SELECT id, ws, width, unnest(generate_series(1, len(ws) - width + 1)) AS p FROM t, (SELECT DISTINCT width FROM item) WHERE kind = 'd' AND len(ws) >= width)),
hit AS (SELECT dg.doc_id, i.item_id, dg.p, dg.g, ig.c FROM dg JOIN ig USING (g) JOIN item i ON i.item_id = ig.item_id AND i.width = dg.width),
pair AS (SELECT DISTINCT h.doc_id, h.item_id, least(i.words, len(t.ws)) AS n, len(t.ws) AS doc_words, i.words, i.width FROM hit h JOIN item i USING (item_id) JOIN t ON t.kind = 'd' AND t.id = h.doc_id),
near AS (SELECT DISTINCT h.doc_id, h.item_id, unnest(generate_series(greatest(1, h.p - (n - width)), least(h.p, doc_words - n + 1))) AS s, n, words, width FROM hit h JOIN pair USING (doc_id, item_id)),
same AS (SELECT s.doc_id, s.item_id, s.s, s.n, s.words, s.width, h.g, least(count(*), any_value(h.c)) AS m
         FROM near s JOIN hit h ON h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.p BETWEEN s.s AND s.s + s.n - s.width GROUP BY ALL),
score AS (SELECT doc_id, item_id, s, n, sum(m)::DOUBLE / ((n - width + 1) + (words - width + 1) - sum(m)) AS similarity FROM same GROUP BY doc_id, item_id, s, n, words, width),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS r FROM score WHERE similarity >= 0.8)
SELECT doc_id, item_id, (s - 1)::INTEGER AS start_word, n::INTEGER AS n_words, similarity FROM best WHERE r = 1
""",
    "op10_near_dup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 2),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i+1] AS g FROM sh UNION SELECT doc_id, ws[1] AS g FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id
""",
    "op7_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], chr(1)) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
first AS (SELECT g, min(doc_id) AS src FROM win GROUP BY g),
bad AS (SELECT DISTINCT win.doc_id, win.i + o AS p FROM win JOIN first USING (g), generate_series(0, 12) AS s(o) WHERE first.src < win.doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w),
flag AS (SELECT pos.doc_id, pos.word, pos.p, bad.p IS NOT NULL AS gone FROM pos LEFT JOIN bad ON pos.doc_id = bad.doc_id AND pos.p = bad.p),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM flag GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n_words, 0)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id
""",
}
