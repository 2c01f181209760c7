"""Queries on prompts, documents for embedding, fetch rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import prompts as P
from postmill.functions.lexicon import WAF_MARKERS
from postmill.operators import dialogue, fetching, reporting
from postmill.plans.common import sql_collapse, table

MARKS = [("m.example.com", "Example Mobile"), ("example.com", "Example Post"), ("example.net", "Example Net")]
K = 3


def docs_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(P.one_line(F.col("text"))).alias("line_md5"))


def docs_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.first_seen_counts(table(spark, sf_dir, "documents"), "source", "doc_id").withColumnRenamed("first", "first_id")


def docs_policy_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    content = P.policy_document(
        F.col("source"), F.substring("text", 1, 30), F.array("lang", "source"), F.substring("text", 1, 100), F.lit(None).cast("string"), none,
        F.when(F.col("n_chars") > 2000, F.col("n_chars").cast("string")), F.lit(""), F.array("lang"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")),
    )
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def conv_rendered_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return whole.select("conv_id", F.md5(P.rendered(F.col("messages"))).alias("prompt_md5"))


def conv_rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    score = (F.pmod(F.col("turn"), F.lit(7)) + 1) / 7.0
    hit = F.struct(F.col("turn").cast("int").alias("rank"), score.cast("double").alias("score"), F.col("text").alias("content"))
    hits = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list(hit).alias("hits"))
    asked = dialogue.last_message(rows, "user").join(hits, "conv_id", "left")
    found = F.coalesce("hits", F.array().cast("array<struct<rank:int,score:double,content:string>>"))
    return asked.select("conv_id", F.md5(P.rag_prompt(F.col("text"), found)).alias("prompt_md5"))


def conv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a conversation; what its users asked stands for the summaries."""
    turn = F.struct(F.col("turn").cast("int").alias("turn"), (F.col("role") == "user").alias("from_user"), F.col("text").alias("utterance"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    asked = F.filter("turns", lambda t: t["from_user"])
    qa = F.transform(asked, lambda t: F.struct(F.substring(t["utterance"], 1, 4).alias("intent"), F.substring(t["utterance"], 1, 20).alias("summary")))
    return whole.select("conv_id", P.dialogue_document(F.col("conv_id"), F.col("conv_id"), qa, F.col("turns")).alias("content"))


def conv_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    return reporting.conversation_page(rows.select("conv_id", (F.col("conv_id") % 97 == 0).alias("pinned"), "updated_at"))


def pages_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(fetching.company_of(F.col("url"), MARKS).alias("company")).agg(F.count("*").alias("n"))


def pages_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a fetcher takes as HTML and not as blocked; every fifth has a state of its own."""
    state = F.when(F.col("page_id") % 5 == 0, F.lit(412)).otherwise(F.lit(200))
    return table(spark, sf_dir, "pages").select(
        "page_id", fetching.blocked(state, F.col("html"), F.col("url")).alias("blocked"), fetching.html_response(F.lit(None).cast("string"), F.col("url")).alias("is_html")
    )


def labels_candidate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        F.lit("labels").alias("source_file"), (F.col("doc_id") % (K + 1)).alias("success_count"), (F.col("quality") == 1).alias("json_valid"), (F.col("toxic") == 0).alias("required_ok"),
        F.col("toxic").alias("risk_hits"), F.when(F.col("doc_id") % 2 == 0, F.col("quality") == 1).alias("choice_correct"), (F.col("doc_id") % 100).alias("candidate_ms"), (F.col("doc_id") % 64).alias("agent_ms"),
    )
    return reporting.candidate_metrics(rows, K).drop("source_files")


def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of a log a user: training losses, and validation losses at every fifth event."""
    loss = (F.round(F.col("value") / 20 * 1000) / 1000).cast("decimal(38,3)").cast("string")  # rounds the product, as SQL does; never an exponent
    line = F.concat(F.lit("Iter "), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit(": Val loss ")).when(F.col("event_id") % 5 < 3, F.lit(": Train loss ")).otherwise(F.lit(": no loss ")), loss)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    return reporting.loss_metrics(table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run")).agg(F.array_join(lines, "\n").alias("text")))


def eval_best_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best adapter, one a user, of those whose folders are still there, every third."""
    path = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    adapters = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("score")).select((F.col("user_id") % 6).cast("int").alias("rank"), "score", path.alias("path"))
    return reporting.best_adapter(adapters, table(spark, sf_dir, "events").where("user_id % 3 = 0").select(path.alias("path")))


STRIPPED = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')".format
NL = "chr(10)"
LINE = "coalesce(text, '')"
ASKED = "SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1"
NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
QUERIES = {
    f.__name__: f
    for f in (
        docs_one_line, docs_source_counts, docs_policy_document, conv_rendered_prompt, conv_rag_prompt, conv_documents, conv_page, pages_company, pages_blocked,
        labels_candidate_metrics, eval_loss, eval_best_adapter,
    )
}
ORACLE = {
    "docs_one_line": f"SELECT doc_id, md5({sql_collapse(LINE)}) AS line_md5 FROM documents",
    "docs_source_counts": "SELECT coalesce(source, '') AS source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "docs_policy_document": f"""
        SELECT doc_id, concat_ws({NL}, '{P.COMPANY}' || coalesce(nullif(source, ''), '{P.DEFAULT_COMPANY}'), '{P.TITLE}' || {STRIPPED("substr(text, 1, 30)")},
            '{P.CATEGORIES}' || concat_ws('、', lang, source), '{P.SUMMARY}' || {STRIPPED("substr(text, 1, 100)")}, '{P.EVIDENCE}',
            CASE WHEN n_chars > 2000 THEN '{P.LIMIT}' || n_chars END, CASE WHEN lang <> '' THEN '{P.EXCLUSIONS}' || lang END, '{P.LINK}doc:' || doc_id) AS content FROM documents""",
    "conv_rendered_prompt": f"SELECT conv_id, md5(string_agg(upper(role) || ': ' || {STRIPPED('text')}, {NL} || {NL} ORDER BY turn) || {NL} || {NL} || 'ASSISTANT:') AS prompt_md5 FROM conversations GROUP BY conv_id",
    "conv_rag_prompt": f"""
        WITH hits AS (SELECT conv_id, string_agg(printf('[引用%d score=%.4f]', turn::INT, (turn % 7 + 1) / 7.0::DOUBLE) || {NL} || text, {NL} || {NL} ORDER BY turn) AS cited FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT conv_id, md5('用户问题:' || {NL} || text || {NL} || {NL} || '可用引用对话:' || {NL} || coalesce(cited, '无')) AS prompt_md5 FROM ({ASKED}) LEFT JOIN hits USING (conv_id)""",
    "conv_documents": f"""
        SELECT conv_id, '会话ID: ' || conv_id || {NL} || '对话ID: ' || conv_id || {NL} || '业务意图: ' || coalesce(string_agg(substr(text, 1, 4), '、' ORDER BY turn) FILTER (role = 'user' AND text <> ''), '') || {NL}
            || '问答摘要:' || {NL} || coalesce(string_agg(substr(text, 1, 20), {NL} ORDER BY turn) FILTER (role = 'user' AND text <> ''), '') || {NL} || '原始对话:' || {NL}
            || string_agg(CASE role WHEN 'user' THEN '用户[' ELSE '客服[' END || turn || ']: ' || coalesce(text, ''), {NL} ORDER BY turn) AS content FROM conversations GROUP BY conv_id""",
    "conv_page": "SELECT conv_id, conv_id % 97 = 0 AS pinned, max(turn) AS updated_at FROM conversations GROUP BY conv_id ORDER BY pinned DESC, updated_at DESC, conv_id DESC LIMIT 30",
    "pages_company": f"SELECT CASE {' '.join(f'WHEN contains(url, {chr(39)}{m}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for m, n in MARKS)} ELSE coalesce(nullif({NETLOC}, ''), '{fetching.OTHER_COMPANY}') END AS company, count(*) AS n FROM pages GROUP BY 1",
    "pages_blocked": f"""
        SELECT page_id, {' OR '.join(f"contains(lower(html), '{m}')" for m in WAF_MARKERS)} OR (page_id % 5 = 0 AND contains(lower(url), '{fetching.GUARDED_SITE}')) AS blocked,
            regexp_matches(lower(url), '(\\.html?|/)$') AS is_html FROM pages""",
    "labels_candidate_metrics": f"""
        SELECT count(*) AS sample_count, avg((doc_id % {K + 1}) / {K}::DOUBLE) AS success_rate, avg(coalesce((quality = 1)::INT, 0)::DOUBLE) AS json_valid_rate,
            avg(coalesce((toxic = 0)::INT, 0)::DOUBLE) AS required_fields_rate, avg(coalesce((toxic > 0)::INT, 0)::DOUBLE) AS risk_rate, count(*) FILTER (doc_id % 2 = 0 AND quality IS NOT NULL) AS choice_case_count,
            avg((quality = 1)::INT::DOUBLE) FILTER (doc_id % 2 = 0) AS choice_accuracy, round(avg(doc_id % 100), 2) AS avg_candidate_ms, round(avg(doc_id % 64), 2) AS avg_agent_ms, count(*) * {K} AS request_count FROM labels""",
    "eval_loss": f"""
        WITH lines AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'val' WHEN event_id % 5 < 3 THEN 'train' END AS kind, round(value / 20, 3) AS loss FROM events)
        SELECT user_id::VARCHAR AS run, arg_max(loss, event_id) FILTER (kind = 'train') AS train_loss, arg_max(loss, event_id) FILTER (kind = 'val') AS val_loss, exp(arg_max(loss, event_id) FILTER (kind = 'val')) AS val_perplexity
        FROM lines GROUP BY user_id""",
    "eval_best_adapter": """
        SELECT (user_id % 6)::INT AS rank, max(value) AS score, 'a' || user_id AS path FROM events WHERE user_id % 3 = 0 GROUP BY user_id ORDER BY score DESC, rank, path LIMIT 1""",
}
