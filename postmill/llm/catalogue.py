"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import (
    chat_format, chunk_dedup, decontaminate, divergence, fingerprint, hard_negatives, jaccard_join, language, repetition, source_mix, token_file, toxicity,
    warc,
)
from postmill.llm.common import id_remainder, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_languages(table(spark, sf_dir, "documents"), id_remainder("doc_id", 5) != 0)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    turn = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"))))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("t"))
    extra = extra.select("conv_id", F.col("t.turn").cast("long").alias("turn"), F.col("t.role").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.format_and_read_back(rows.unionByName(extra))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_toxicity, op3_token_files, op4_chunk_dedup, op5_decontamination,
        op6_source_mix, op7_jaccard_join, op8_chat_format, op9_fingerprints, op10_warc,
        op11_quality_rules, op12_source_divergence, op13_hard_negatives,
    )
}


def sql_escaped(expr: str) -> str:
    for plain, written in chat_format.ESCAPES:
        expr = f"replace({expr}, '{plain}', '{written}')"
    return expr


OP8_SQL = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        9 + length({sql_escaped("role")}) + length({sql_escaped("text")}) AS written
    FROM rows
), summed AS (SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
OP10_SQL = """
WITH digests AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
owners AS (SELECT hex, max(page_id) AS owner FROM digests GROUP BY hex),
fives AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 1 + 5 * i::INT, 5))::BIGINT) AS parts FROM digests JOIN owners USING (hex))
SELECT page_id, payload_bytes,
    array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v >> b) & 31))::INT, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id < owner OR (page_id IS NULL AND owner IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < owner OR page_id IS NULL THEN owner END AS refers_to
FROM fives
"""
OP11_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
placed AS (SELECT row_id, words, unnest(range(len(words))) AS pos FROM split),
runs AS (
    SELECT row_id, pos, 5 AS run, array_to_string(words[pos + 1 : pos + 5], ' ') AS said FROM placed WHERE pos + 5 <= len(words)
    UNION ALL SELECT row_id, pos, 8, array_to_string(words[pos + 1 : pos + 8], ' ') FROM placed WHERE pos + 8 <= len(words)
    UNION ALL SELECT row_id, pos, 51, array_to_string(words[pos + 1 : pos + 51], ' ') FROM placed WHERE pos + 51 <= len(words)
),
twice AS (SELECT row_id, run, pos FROM runs QUALIFY count(*) OVER (PARTITION BY row_id, run, said) > 1),
covered AS (SELECT row_id, run, count(DISTINCT pos + o) AS n FROM twice, range(51) o(o) WHERE o < run GROUP BY ALL),
by_row AS (SELECT row_id, sum(n) FILTER (run = 5) AS short, sum(n) FILTER (run = 8) AS base, sum(n) FILTER (run = 51) AS long FROM covered GROUP BY row_id),
line AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM texts),
lines AS (SELECT row_id, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
counted AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(base, 0) AS n_repeat_words, coalesce(short, 0) AS covered_words, long IS NOT NULL AS too_long
    FROM split LEFT JOIN by_row USING (row_id) LEFT JOIN lines USING (row_id)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    base_failed, NOT base_failed AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept
FROM judged
"""
OP12_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
said AS (
    SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM rows
),
kept AS (SELECT lang, term, count(*) AS lang_count FROM said GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM rows),
counted AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
whole AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM kept GROUP BY lang),
shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v))::HUGEINT AS p,
        (1 + 1000000000::HUGEINT * (lang_count + 1) // (lang_total + v))::HUGEINT AS lang_p
    FROM sized JOIN whole USING (lang) JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)
),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT FROM shares WHERE n > 0 AND p > lang_p
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
OP13_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.row_id, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.row_id <> b.row_id
),
positives AS (
    SELECT row_id, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, other_id NULLS LAST) AS position
    FROM scored WHERE same QUALIFY position <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.row_id, p.position ORDER BY s.score DESC, s.other_id NULLS LAST)::INTEGER AS rank,
    s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.row_id = p.row_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
#: The other operators hash with functions that SQL engines do not share, train models, or need a recursion over all pairs.
ORACLE: dict[str, str] = {
    "op8_chat_format": OP8_SQL, "op10_warc": OP10_SQL, "op11_quality_rules": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
