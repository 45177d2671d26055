"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nxtide.llm import chat, decontaminate, fill_middle, html_text, language, line_dedup, neighbours, prefix_trie, sentencepieces, sharding, simhash, token_counts, toxicity
from nxtide.llm.common import table, text_of

#: What is said in conversation -7, added to those of the table.
ODD = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; its package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn int, role string, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    return chat.read_back(chat.format_chats(turns.unionByName(odd), path), path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex.empty(spark).insert(docs)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neighbours.NearestIndex.build(table(spark, sf_dir, "embeddings"))
    return index.search(index.vectors.filter("vec_id % 20 = 0").select("vec_id", "v"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_texts(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_to_shards(rows, ["doc_id", "size", "text_crc32"], 40)
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(text_of(F.col("doc_id"))) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ranked(prefix_trie.hashed(turns))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  the pipeline belongs to this subpackage

    return {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_chat_format, op4_line_dedup, op5_neighbours, op6_token_counts, op7_html_text, op8_simhash, op9_sharding, op10_decontamination, op11_language_id, op12_fill_middle, op13_prefix_trie, pipeline)}


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS x, replace(replace(role, '\', '\\'), '<|', '<\|') AS y FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(x) + length(y) + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
n AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, n.key IS NOT NULL AND k.doc_id <> n.last AS dropped FROM k LEFT JOIN n ON k.key = n.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(dropped, false)), '')) AS kept_sha256
FROM f GROUP BY r"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""

OP13_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
  [coalesce(role, ''), coalesce(text, '')] AS turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(turn ORDER BY i) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1)))),
  lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1))), 4294967295) % 9 AS h FROM l),
r AS (SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN l b ON b.c = h.c - h.c % 5),
p AS (SELECT c, len(turns) AS n, unnest(range(len(turns) + 1)) AS d, turns FROM r),
q AS (SELECT c, n, d, turns[1:d] AS pre, coalesce(strlen(turns[d][2]), 0) AS bytes FROM p),
g AS (SELECT pre, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, any_value(bytes) AS bytes, max(n) > any_value(d) AS inner_node,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM q GROUP BY pre),
u AS (SELECT pre, d, c, n_convs, ends, (n_convs - 1) * bytes AS saved, NOT inner_node AS leaf, unnest(range(d + 1)) AS up FROM g),
s AS (SELECT pre[1:up] AS pre, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves, count(*) FILTER (WHERE d = up + 1) AS children FROM u GROUP BY 1)
SELECT g.c AS conv_id, g.d AS depth, parent.c AS parent_conv_id, g.n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s ON g.pre = s.pre LEFT JOIN g parent ON g.d > 0 AND parent.pre = g.pre[1:g.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op4_line_dedup": OP4_SQL, "op12_fill_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
