"""Queries on reports, names of outputs, call logs, seeds, tickets and the records of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import crawl, policy, reporting, support
from postmill.plans.common import sql_any, sql_hits, sql_plain, table
from postmill.session import fresh_path
from postmill.sources import readers, sinks

TOPIC = "t"


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of ten pages each, with their addresses as entries."""
    rows = table(spark, sf_dir, "pages").groupBy((F.floor(F.col("page_id") / 10)).alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("entry_urls"))
    return rows.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("source_id"), F.concat(F.lit("c"), (F.col("s") % 3).cast("string")).alias("company"), "entry_urls", F.array(F.lit(TOPIC), F.col("s").cast("string")).alias("allowed_topics"))


def pages_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.seeds(page_sources(spark, sf_dir)).withColumn("topic_hints", F.array_join("topic_hints", ","))


def pages_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log joined to every other source; rows of the others leave."""
    log = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), F.floor(F.col("page_id") / 10).cast("string")).alias("source_id"), F.lit("own").alias("company"))
    known = page_sources(spark, sf_dir).where(F.substring("source_id", 2, 9).cast("int") % 2 == 0)
    return crawl.with_source(log, known.unionByName(known)).select("page_id", "source_id", "company")


def pages_pdf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("company"), "url", F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.col("html").cast("binary").alias("body"))
    return sinks.pdf_rows(rows).select("name", F.octet_length("body").cast("long").alias("n_bytes"), "record")


def pages_policy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the page gate does with each page's insurance words: the record fields of whole texts."""
    rows = table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.coalesce("html", F.lit(""))).alias("plain"), (F.col("page_id") % 4).alias("k"))
    said = F.concat_ws(" ", "plain", F.when(F.col("k") == 1, F.lit("本单已保价，附发票")).when(F.col("k") == 2, F.lit("declared value")).when(F.col("k") == 3, F.lit("shipment insurance")))
    return rows.select("page_id", policy.insurance(said).alias("i")).select("page_id", "i.insurance_available", "i.insurance_type", F.size("i.requirements").alias("n_requirements"))


def docs_report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report blocks of documents as samples: one in four as question and answer, the others with their section or their evidence."""
    docs = table(spark, sf_dir, "documents")
    file, title = F.concat("source", F.lit(".md")), F.concat(F.lit("T"), (F.col("doc_id") % 40).cast("string"))
    sections = docs.where("doc_id % 3 = 0").select(file.alias("file"), F.col("doc_id").alias("first_line"), F.concat(F.lit(" "), title).alias("title"), F.array(F.lit(""), F.concat(F.lit("b"), F.col("doc_id").cast("string")), F.lit("---"), F.lit("")).alias("body"))
    samples = docs.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(reporting.ASKED_SOURCE)).otherwise(F.lit("x")).alias("source_id"), F.col("source").alias("company"), F.array("lang").alias("policy_categories"), (F.col("n_chars") > 900).alias("insurance_available"),
        title.alias("title"), F.when(F.col("doc_id") % 5 != 0, F.concat(file, F.lit("#a"))).alias("locator"), F.lit("s").alias("summary"), F.concat(F.lit("e "), F.col("lang")).alias("evidence_text"),
    )
    return reporting.sample_blocks(reporting.originals(samples, sections), "doc_id").select("doc_id", F.md5("block").alias("block_md5"))


def docs_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.most_common(table(spark, sf_dir, "documents"), "source", "doc_id")


def docs_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("text", 1, 40)
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_label(first).alias("label"), T.safe_file(first).alias("file"))


def docs_markdown_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit("\n \n"), F.replace("text", F.lit("\n"), F.lit("\r\n\n\n")), F.lit("\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.markdown_whitespace(spaced)).alias("text_md5"))


def events_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 9 != 0, F.concat("event_type", F.lit("/7b"))).alias("model"), "event_id")
    rows = sinks.call_log_rows(calls)
    return rows.select(F.col("day").cast("string").alias("day"), "name", F.get_json_object("line", "$.logged_at").alias("logged_at"), F.get_json_object("line", "$.event_id").cast("long").alias("event_id"))


def conv_ticket_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue types from the newest citation of each conversation; each answer cites once, every fifth without intents."""
    said = table(spark, sf_dir, "conversations")
    intents = F.when(F.col("turn") % 4 == 1, F.array(F.lit("Delivery"), F.lit("x"))).when(F.col("turn") % 4 == 3, F.array(F.lit("寄件"))).otherwise(F.array().cast("array<string>"))
    cited = said.where("role = 'assistant' AND conv_id % 3 > 0").select("conv_id", F.lit(0).alias("created_at"), F.col("turn").alias("id"), F.when(F.col("conv_id") % 5 != 0, intents).alias("intents"))
    return support.with_issue(said.select("conv_id").distinct(), cited)


def conv_model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider of each conversation's messages by its switch, and what their metadata say without a tuned model."""
    pair = lambda provider, model: F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"))
    tuned = F.col("conv_id") % 2 == 0
    rows = table(spark, sf_dir, "conversations").where("turn = 0")
    return rows.select("conv_id", support.model_choice(tuned, pair("a", "m"), pair("b", "n"))["provider"].alias("provider"), support.model_metadata(tuned, pair("a", "m"), pair("", "n"))["model"].alias("model"))


def conv_json_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lists, one a split, read back by the array reader."""
    folder = fresh_path(spark, "splits")
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 3).alias("k"), "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("json"))
    split = Window.partitionBy("k")
    line = said.withColumn("n", F.count("*").over(split)).withColumn("at", F.row_number().over(split.orderBy("conv_id", "turn")))
    text = F.concat(F.when(F.col("at") == 1, F.lit("[")).otherwise(F.lit("")), "json", F.when(F.col("at") == F.col("n"), F.lit("]")).otherwise(F.lit(",")))
    sinks.write_files(line.select(F.concat(F.lit("part"), F.col("k").cast("string"), F.lit(".json")).alias("name"), F.col("at").alias("line"), text.alias("text")), folder)
    return readers.json_array(spark, folder, "conv_id long, turn long, role string").select("split", "conv_id", "turn", "role")


QUERIES = {
    f.__name__: f
    for f in (
        pages_seeds, pages_of_sources, pages_pdf_rows, pages_policy_records, docs_report_blocks, docs_most_common, docs_safe_names, docs_markdown_whitespace, events_call_log, conv_ticket_issues, conv_model_choice, conv_json_splits,
    )
}
TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x1c-\x1f\x{{85}}]+$', '', 'g')".format
SAID = f"({sql_plain('html')} || CASE page_id % 4 WHEN 1 THEN ' 本单已保价，附发票' WHEN 2 THEN ' declared value' WHEN 3 THEN ' shipment insurance' ELSE '' END)"
ORACLE = {
    "pages_seeds": """
        SELECT 's' || page_id // 10 AS source_id, 'c' || page_id // 10 % 3 AS company, (row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1)::INT AS pos, url, 't,' || page_id // 10 AS topic_hints, 0 AS depth FROM pages""",
    "pages_of_sources": "SELECT page_id, 's' || page_id // 10 AS source_id, 'c' || page_id // 10 % 3 AS company FROM pages WHERE page_id // 10 % 2 = 0",
    "pages_pdf_rows": """
        SELECT sha1(url) || '.pdf' AS name, strlen(html)::BIGINT AS n_bytes, '{"source_id":"s","company":null,"url":' || to_json(url)::VARCHAR || ',"title":"t' || page_id || '","saved_path":"' || sha1(url) || '.pdf"}' AS record FROM pages""",
    "docs_report_blocks": """
        WITH s AS (SELECT source, doc_id % 40 AS t, arg_min(doc_id, doc_id) AS first FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2),
        d AS (SELECT d.*, row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN doc_id % 5 <> 0 AND first IS NOT NULL THEN 'b' || first ELSE 'e ' || lang END AS original, doc_id % 4 = 0 AS asked
            FROM documents d LEFT JOIN s ON s.source = d.source AND s.t = d.doc_id % 40)
        SELECT doc_id, md5(concat_ws(chr(10), '### 样本 ' || n || '：T' || doc_id % 40, '', '| 字段 | 内容 |', '|---|---|', '| 来源标识 | `' || CASE WHEN asked THEN 'ems_policy_network' ELSE 'x' END || '` |', '| 公司字段 | ' || source || ' |',
            '| 类别 | ' || lang || ' |', '| 是否涉及保险 | ' || CASE WHEN n_chars > 900 THEN '是' ELSE '否' END || ' |', '| 标题 | T' || doc_id % 40 || ' |', '| 定位 | `' || CASE WHEN doc_id % 5 <> 0 THEN source || '.md#a' ELSE '无' END || '` |', '',
            CASE WHEN asked THEN concat_ws(chr(10), '问题：', '', '> T' || doc_id % 40, '', '答案：', '', '> s', '') ELSE concat_ws(chr(10), '原文：', '', '> ' || original, '') END)) AS block_md5 FROM d""",
    "docs_most_common": "SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id), source)::INT AS place FROM documents GROUP BY source",
    "docs_safe_names": r"""
        SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS label, regexp_replace(substr(text, 1, 40), '[^\p{L}\p{N}_.-]', '_', 'g') AS file FROM documents""",
    "docs_markdown_whitespace": f"""
        SELECT doc_id, md5({TRIM("regexp_replace(regexp_replace(chr(10) || ' ' || chr(10) || replace(text, chr(10), chr(13) || chr(10) || chr(10) || chr(10)) || chr(10), chr(13) || chr(10) || '?', chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS text_md5 FROM documents""",
    "events_call_log": """
        WITH e AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN event_type || '_7b' ELSE 'unknown-model' END AS model FROM events)
        SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || '_' || model || '.json' AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000' AS logged_at, event_id FROM e""",
    "conv_ticket_issues": """
        WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' AND conv_id % 3 > 0 AND conv_id % 5 <> 0 GROUP BY conv_id)
        SELECT conv_id, CASE turn % 4 WHEN 1 THEN '配送咨询' WHEN 3 THEN '寄件' ELSE '' END AS issue_type FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN l USING (conv_id)""",
    "conv_model_choice": "SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN 'b' ELSE 'a' END AS provider, CASE conv_id % 2 WHEN 0 THEN '' ELSE 'm' END AS model FROM conversations WHERE turn = 0",
    "conv_json_splits": "SELECT 'part' || conv_id % 3 AS split, conv_id, turn, role FROM conversations",
    "pages_policy_records": f"""
        WITH p AS (SELECT page_id, {SAID} AS said FROM pages),
        f AS (SELECT *, {sql_any("said", ["declared value", "声明价值"])} AS declared, contains(said, '保价') AS insured, {sql_any("said", ["shipment insurance"])} AS shipment,
            {sql_any("said", ["liability"])} AND {sql_any("said", policy.LIABILITY_CONTEXT)} AS liable, contains(said, '保险') AND {sql_any("said", policy.GENERIC_INSURANCE_CONTEXT)} AS generic, {sql_hits("said", policy.INSURANCE_CONTEXT)} AS hits FROM p),
        g AS (SELECT *, hits >= 2 OR insured OR declared OR shipment OR liable OR generic AS available FROM f)
        SELECT page_id, available AS insurance_available, CASE WHEN NOT available THEN '未知' WHEN declared THEN '声明价值' WHEN insured THEN '保价' WHEN generic OR shipment THEN '运输保险' WHEN liable THEN '承运商责任' ELSE '未知' END AS insurance_type,
            ({" + ".join(sql_any("said", words) + "::INT" for words in policy.REQUIREMENTS.values())})::INT AS n_requirements FROM g""",
}
