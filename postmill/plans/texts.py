"""Queries on documents, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.lexicon import fixture_lexicon
from postmill.operators import dedup, dialogue, support
from postmill.plans.common import sql_any, sql_collapse, sql_hits, table

LEX = fixture_lexicon()
CHUNK = 500


def docs_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def docs_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_content(table(spark, sf_dir, "documents")).where("copies > 1")


def docs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


def docs_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_hits(F.col("text"), LEX.signals).alias("hits"), T.token_estimate(F.col("text")).alias("tokens"))


def docs_cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.cjk_ratio(F.col("text")).alias("cjk_ratio"), T.looks_english(F.col("text")).alias("looks_english"))


def docs_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"), CHUNK)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def docs_labels_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return dialogue.selected(table(spark, sf_dir, "documents"), verdicts, ["doc_id"], "good").select("doc_id", "lang", "n_chars")


def docs_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n_source"), F.count_if(F.col("quality") == 1).alias("n_selected"))


def docs_or_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dropped if source with length, or the summary, equals that of a kept row."""
    docs = table(spark, sf_dir, "documents").withColumn("address", F.concat_ws(":", "source", "n_chars")).withColumn("print", T.summary(F.col("text")))
    return dedup.keep_unseen(docs, "doc_id", "address", "print").select("doc_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def conv_dialogue_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.dialogue_text(conversations(spark, sf_dir), "conv_id", "turn")


def conv_last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.last_message(conversations(spark, sf_dir), "user")


def conv_recent6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.recent_context(conversations(spark, sf_dir)).select("conv_id", "turn", "role")


def conv_turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


def conv_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.qa_pairs(conversations(spark, sf_dir))


def conv_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = conversations(spark, sf_dir).where("role = 'user'").withColumn("route", support.route(F.col("text"), LEX))
    return asked.select("conv_id", "turn", "route", support.route_profile(F.col("route"))["k"].alias("k"))


def conv_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_route(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.sum("k").alias("passages"))


def conv_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support.rule_tickets(conversations(spark, sf_dir)).select("conv_id", "user_id", "service_type", "user_request", "summary")


SUMMARY = "CASE WHEN len(s) > 0 THEN substr(array_to_string(s, '。'), 1, 300) ELSE substr(text, 1, 300) END"
STRIP = r"regexp_replace(p, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g')"
ROUTE = f"CASE WHEN {sql_any('text', LEX.direct)} THEN 'DIRECT' WHEN {sql_any('text', LEX.strong)} THEN 'STRONG_RAG' ELSE 'LIGHT_RAG' END"
ROUTES = f"SELECT conv_id, turn, {ROUTE} AS route FROM conversations WHERE role = 'user'"
K = "CASE route WHEN 'DIRECT' THEN 0 WHEN 'LIGHT_RAG' THEN 3 ELSE 6 END"
HAS_LATIN = "regexp_matches({0}, '[A-Za-z]') AND NOT regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]')"
QUERIES = {
    f.__name__: f
    for f in (
        docs_content_hash, docs_exact_dups, docs_summary, docs_keyword_hits, docs_cjk_ratio, docs_chunks, docs_labels_semi, docs_split_summary, docs_or_dedup,
        conv_dialogue_text, conv_last_user, conv_recent6, conv_turn_stats, conv_qa_pairs, conv_route, conv_route_counts, conv_ticket,
    )
}
ORACLE = {
    "docs_content_hash": f"SELECT doc_id, sha256({sql_collapse('text')}) AS content_hash FROM documents",
    "docs_exact_dups": f"SELECT sha256({sql_collapse('text')}) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "docs_summary": f"SELECT doc_id, {SUMMARY} AS summary FROM (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?]'), lambda p: {STRIP}), lambda p: length(p) >= 12)[1:3] AS s FROM documents)",
    "docs_keyword_hits": f"SELECT doc_id, {sql_hits('text', LEX.signals)} AS hits, greatest(1, length(text) // 4)::INT AS tokens FROM documents",
    "docs_cjk_ratio": r"SELECT doc_id, CASE WHEN length(c) > 0 THEN length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g'))::DOUBLE / length(c) ELSE 0.0 END AS cjk_ratio, " + HAS_LATIN.format("text") + r" AS looks_english FROM (SELECT *, regexp_replace(text, '[\s\p{Z}\d:,.\->]', '', 'g') AS c FROM documents)",
    "docs_chunks": f"SELECT doc_id, i::INT AS chunk_no, length(substr(text, i * {CHUNK} + 1, {CHUNK}))::INT AS n_chars, md5(substr(text, i * {CHUNK} + 1, {CHUNK})) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(greatest((length(text) - 1) // {CHUNK}, 0) + 1)) AS i FROM documents)",
    "docs_labels_semi": "SELECT doc_id, lang, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)",
    "docs_split_summary": "SELECT lang, count(*) AS n_source, count(*) FILTER (quality = 1) AS n_selected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "conv_dialogue_text": f"SELECT conv_id, count(*)::INT AS n_turns, string_agg(role || ': ' || p, chr(10) ORDER BY turn) AS dialogue FROM (SELECT conv_id, turn, role, {STRIP.replace('(p,', '(text,')} AS p FROM conversations) WHERE p <> '' GROUP BY conv_id",
    "conv_last_user": "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1",
    "conv_recent6": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 AND role <> 'system'",
    "conv_turn_stats": "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY role",
    "conv_qa_pairs": "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'",
    "conv_route": f"SELECT conv_id, turn, route, {K} AS k FROM ({ROUTES})",
    "conv_route_counts": f"SELECT route, count(*) AS n, sum({K})::BIGINT AS passages FROM ({ROUTES}) GROUP BY route",
    "conv_ticket": f"""
        WITH g AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS asked, coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS answered FROM conversations GROUP BY conv_id),
        c AS (SELECT conv_id, substr({sql_collapse('asked')}, 1, 120) AS a, substr({sql_collapse('answered')}, 1, 180) AS b FROM g)
        SELECT conv_id, 'conversation:' || conv_id AS user_id, '{support.SERVICE}' AS service_type,
            CASE WHEN trim(a) <> '' AND NOT ({HAS_LATIN.format('a')}) THEN trim(a) ELSE '{support.REQUEST_TEXT}' END AS user_request,
            CASE WHEN trim(b) <> '' AND NOT ({HAS_LATIN.format('b')}) THEN trim(b) ELSE '{support.SUMMARY_TEXT}' END AS summary FROM c""",
}
