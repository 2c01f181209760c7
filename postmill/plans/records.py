"""Queries on files, messages, subtitles and evaluation records made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import prompts as P
from postmill.functions import text as T
from postmill.operators import crawl, dialogue, evaluation, fetching, links, markdown, policy, reporting, retrieval, subtitles
from postmill.plans.common import sql_collapse, sql_entities, table
from postmill.plans.services import STRIPPED
from postmill.session import fresh_path
from postmill.sources import adapters, readers, sinks

FIRST = 50
DOMAINS = ["example.com", "m.example.net"]
REPLY = "1: eins\n2：zwei\nno number"
BATCH = 3
PROMISE, HEDGED = "一定赔", "不能保证一定赔"
STATUSES = ["click", "view", "error"]
WEIGHTS = {"quality": 0.75, "toxic": -0.25}


def text_id(column: str) -> Column:
    return F.col(column).cast("string")


# Documents


def docs_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.published_at(F.col("text")).alias("published_at"))


def docs_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.eval_norm(F.col("text"))).alias("norm_md5"), T.slug(first).alias("slug"))


def docs_unfenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come in a code fence, and texts that end in rules and blank lines."""
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n```"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.code_fence(fenced)).alias("body_md5"), F.md5(P.without_trailing_rules(F.concat(T.strip(F.col("text")), F.lit("\n---\n  \n***\n")))).alias("ruleless_md5"),
        F.md5(P.embedding_query(F.col("text"), "find the passage")).alias("query_md5"),
    )


def docs_prefer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    translated = table(spark, sf_dir, "labels").select(text_id("doc_id").alias("stem"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    found = subtitles.prefer_translated(table(spark, sf_dir, "documents").select(text_id("doc_id").alias("stem"), "text"), translated)
    return found.select("stem", F.md5("text").alias("text_md5"))


def docs_labels_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside their documents; an error if they do not line up."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return dialogue.aligned(docs.join(labels, "doc_id", "left_semi"), labels.join(docs.withColumnRenamed("lang", "other"), "doc_id"), ["doc_id"], [("lang", "other")])


def docs_not_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.not_yet(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


def docs_label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("v"))
    return dialogue.upsert(target, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("v")), ["doc_id"])[0]


def docs_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("v"))
    return dialogue.upsert(target, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("v")), ["doc_id"])[1]


def docs_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.array("lang", "source").alias("policy_categories"))
    return markdown.category_counts(rows).withColumnRenamed("count", "n")


def docs_field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.field_profile(table(spark, sf_dir, "documents"), "doc_id")


def both_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("a").alias("kind"), F.col("doc_id").alias("ord"), F.md5("text").alias("text_md5"))
    items = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("ord"), F.md5("text").alias("text_md5"))
    return retrieval.union_documents(docs, items, "ord")


def docs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_documents(spark, sf_dir)


def docs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_documents(both_documents(spark, sf_dir), FIRST, "kind", "ord")


def docs_first_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", dialogue.first_intent(F.array(none, F.array("lang", "source"), F.array("source"))).alias("intent"))


def labels_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.to_json(F.struct(F.struct(F.struct(F.col("quality").alias("json_valid_rate"), F.lit("n/a").alias("risk_rate")).alias("format")).alias("tasks")))
    of = lambda task, metric: evaluation.metric_value(report, task, metric, -1.0)
    return table(spark, sf_dir, "labels").select("doc_id", of("format", "json_valid_rate").alias("valid"), of("format", "risk_rate").alias("odd"), of("safety", "risk_rate").alias("absent"))


def pages_rank_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat(F.lit("runs/rank_"), text_id("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", T.rank_of_folder(folder).alias("rank"), T.rank_of_folder(F.concat(folder, F.lit("/x"))).alias("other"))


def labels_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr("stack(2, 'quality', quality * 100.0D, 'toxic', toxic * 100.0D) as (dimension, score)"))
    return evaluation.weighted_dimensions(rows, "doc_id", WEIGHTS)


def labels_report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("quality") / 3.0
    return table(spark, sf_dir, "labels").select(
        "doc_id", P.flag(F.col("quality") == 1).alias("good"), P.three_places(third).alias("third"), P.valued(F.nullif(F.col("toxic"), F.lit(0))).alias("toxic"),
    )


# Pages


def pages_pdf_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.pdf_title(F.col("url"), F.lit("Example")).alias("title"))


def pages_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("h", fetching.request_headers(F.col("url"), F.lit("reader/1")))
    return rows.select("page_id", F.size("h").alias("n"), F.col("h")["Referer"].alias("referer"), F.col("h")["User-Agent"].alias("agent"), fetching.browser_retry(F.col("url")).alias("retry"))


def pages_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = fetching.decode_body(F.col("html").cast("binary"), F.lit("text/html"), F.col("url"), F.lit("utf-8"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(body).alias("text_md5"))


def pages_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.allowed_domain(F.col("url"), DOMAINS).alias("allowed"))


def pages_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", sinks.raw_text_name(F.lit("html"), F.col("url"), F.col("html")).alias("raw_name"), F.col("html").alias("text"), F.col("html").cast("binary").alias("body"))
    return sinks.fetch_log_rows(rows).select("page_id", "raw_name", F.md5("text").alias("text_md5"), "text_truncated", "body_bytes")


def pages_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as JSON lines and read back."""
    path = fresh_path(spark, "pages-jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return readers.jsonl(spark, path, "page_id long, url string, html string").select("page_id", "url", F.md5("html").alias("html_md5"))


def pages_raw_or_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews, and whole texts where a raw one is stored (those of the allowed domains)."""
    rows = table(spark, sf_dir, "pages")
    log = rows.select("page_id", F.substring("html", 1, 100).alias("text"), text_id("page_id").alias("raw_text_path"))
    raw = rows.where(links.allowed_domain(F.col("url"), DOMAINS)).select(text_id("page_id").alias("path"), F.col("html").alias("text"))
    return readers.raw_or_preview(log, raw).select("page_id", F.md5("text").alias("text_md5"))


def pages_crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, companies, categories and failures of a log in which every seventh fetch failed."""
    failed = F.col("page_id") % 7 == 0
    log = table(spark, sf_dir, "pages").select((~failed).alias("success"), F.when(failed, F.lit("HTTP 404")).alias("failure_reason"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.array("lang").alias("policy_categories"))
    return crawl.crawl_report(log, docs)


# Conversations


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown files: system turns are parts, user turns sections, answers list items."""
    head = F.get(F.split("text", "\n"), F.lit(0))
    rest = F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", r"\A[^\n]*", "")).otherwise(F.lit(""))
    piece = F.when(F.col("role") == "assistant", F.concat(F.lit("- "), "text")).otherwise(
        F.concat(F.when(F.col("role") == "user", F.lit("### ")).otherwise(F.lit("## 第一部分：")), head, rest)
    )
    grouped = conversations(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("p"))
    files = grouped.select(F.concat(text_id("conv_id"), F.lit(".md")).alias("file"), F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text"))
    return markdown.sections(files)


def conv_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_sections(spark, sf_dir).select("file", "category", "title", F.md5(F.array_join("body", "\n")).alias("body_md5"))


def conv_markdown_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.section_records(markdown_sections(spark, sf_dir))
    return found.select("uri", "title", "category", F.md5("summary").alias("summary_md5"), F.md5("evidence_text").alias("evidence_md5"))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a subtitle file, two and a half seconds a turn."""
    said = F.regexp_replace(T.strip(F.col("text")), r"\n\s*\n", "\n")
    times = F.concat(T.srt_time(F.col("turn") * 2.5), F.lit(" --> "), T.srt_time(F.col("turn") * 2.5 + 2.25))
    rows = conversations(spark, sf_dir).select(text_id("conv_id").alias("file"), F.col("turn").alias("pos"), times.alias("times"), said.alias("text"))
    return subtitles.format_srt(rows.where("text <> ''"))


def conv_srt_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subtitles.parse_srt(srt_files(spark, sf_dir))
    return found.select("file", "pos", "idx", "times", F.md5("text").alias("text_md5"))


def conv_srt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subtitles.batches(subtitles.parse_srt(srt_files(spark, sf_dir)), BATCH)
    return found.select("file", F.col("batch").cast("long").alias("batch"), F.md5("prompt").alias("prompt_md5"))


def conv_srt_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = subtitles.parse_srt(srt_files(spark, sf_dir))
    replies = subtitles.batches(entries, BATCH).select("file", "batch", F.lit(REPLY).alias("reply"))
    return subtitles.merge_translations(entries, replies, BATCH).select("file", "pos", F.md5("text").alias("text_md5"))


def conv_srt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subtitles.split_languages(subtitles.parse_srt(srt_files(spark, sf_dir)))
    return found.select("file", "pos", F.md5("zh").alias("zh_md5"), F.md5("en").alias("en_md5"))


def conv_srt_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.is_chinese(subtitles.parse_srt(srt_files(spark, sf_dir)))


def conv_first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.limit_per_file(conversations(spark, sf_dir).select("conv_id", "turn", "role"), 2, "conv_id", "turn")


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("turn").cast("long")
    return conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + at).alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), at.alias("created_at"))


def conv_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = messages_of(spark, sf_dir)
    kept, _ = dialogue.retry_last_turn(messages, messages.select("conversation_id").distinct(), "once more")
    return kept.select("id", F.md5("content").alias("content_md5"))


def conv_oldest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.oldest(messages_of(spark, sf_dir).where("role = 'assistant'"), "conversation_id", ["created_at", "id"])
    return found.select("conversation_id", "id", F.md5("content").alias("content_md5"))


def conv_error_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of conversations, every second one without; the newest user message stands for the error."""
    rows = conversations(spark, sf_dir)
    title = F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("no "), text_id("conv_id")))
    errors = dialogue.last_message(rows, "user").select("conv_id", F.col("text").alias("message"))
    return dialogue.titled_by_error(rows.select("conv_id", title.alias("title")).distinct(), errors, "conv_id")


def citations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer cites itself for the message before it, scored by its length."""
    answers = messages_of(spark, sf_dir).where("role = 'assistant'")
    return answers.select(
        (F.col("id") - 1).alias("message_id"), (F.length("content") / 1000.0).alias("score"), F.col("created_at").alias("document_id"), F.md5("content").alias("quoted_text"), "created_at", "id"
    )


def conv_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.with_citations(messages_of(spark, sf_dir), citations_of(spark, sf_dir))
    return found.select("id", F.size("citations").alias("n"), F.get("citations", F.lit(0))["quoted_text"].alias("best"))


def conv_newest_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = messages_of(spark, sf_dir).select(F.col("id").alias("message_id"), F.col("conversation_id").alias("conv_id"))
    return reporting.newest_citation(messages, citations_of(spark, sf_dir)).select("conv_id", "id", "quoted_text")


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.qa_pairs(conversations(spark, sf_dir))


def conv_qa_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows of the pairs; odd turns have the fallback fields only."""
    even, none = F.col("turn") % 4 == 0, F.lit(None).cast("string")
    qa = F.struct(
        "turn", F.when(even, F.col("question")).alias("QueSumm"), F.when(~even, F.col("answer")).alias("AnsSummShort"), F.when(even, F.col("answer")).otherwise(F.lit("")).alias("AnsSummLong"),
        F.when(~even, F.col("question")).alias("QASumm"), F.when(even, F.lit("寄 件")).otherwise(none).alias("intent"),
    )
    whole = pairs_of(spark, sf_dir).groupBy(F.col("conv_id").alias("dialogue_id")).agg(F.array_sort(F.collect_list(qa)).alias("QA"))
    found = dialogue.qa_examples(whole)
    said = lambda i: F.md5(F.get("messages", F.lit(i))["content"])
    return found.select("dialogue_id", "qa_index", said(0).alias("asked_md5"), said(1).alias("answer_md5"))


def conv_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity examples of records that name their fields in different ways."""
    even, none = F.col("turn") % 4 == 0, F.lit(None).cast("string")
    rows = pairs_of(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages"),
        F.when(even, F.col("question")).otherwise(F.lit("")).alias("question"), none.alias("prompt"), F.when(~even, F.col("question")).alias("user"),
        none.alias("answer"), F.when(even, F.col("answer")).alias("response"), F.when(~even, F.col("answer")).alias("assistant"),
    )
    found = reporting.identity_examples(rows, "be brief")
    return found.select("ord", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")).alias("messages_md5"))


def conv_answer_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("问题："), "question", F.lit(" 答案："), "answer")
    rows = pairs_of(spark, sf_dir)
    return rows.select("conv_id", "turn", F.md5(P.answer_part(whole, F.lit(""))).alias("from_summary"), F.md5(P.answer_part(F.lit(" "), F.col("answer"))).alias("from_evidence"))


def conv_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAQ payloads of the pairs, one section a conversation, with escaped tags."""
    item = F.struct("turn", F.col("turn").cast("string").alias("id"), F.concat(F.lit("&lt;b&gt;"), "question").alias("question"), F.concat("answer", F.lit("<br/>")).alias("answer"))
    whole = pairs_of(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    section = F.struct(F.lit(None).cast("string").alias("name"), F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["question"].alias("question"), x["answer"].alias("answer"))).alias("faqList"))
    found = policy.faq_items(whole.select(F.concat(F.lit("faq:"), text_id("conv_id")).alias("url"), F.array(section).alias("data")))
    return found.select("url", F.md5("text").alias("text_md5"))


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records of the pairs: JSON answers, promises and repeated questions by turn."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    as_json = F.to_json(F.struct(F.lit("寄件").alias("类别"), F.col("answer").alias("reason")))
    task = F.element_at(F.array(*map(F.lit, ("format", "math", "safety", "postal"))), kind.cast("int") + 1)
    output = F.when(kind == 0, F.concat(F.lit("```json\n"), as_json, F.lit("\n```"))).when(kind == 1, F.concat("question", F.lit(" 快递"))).when(
        kind == 2, F.concat("answer", F.lit("。" * 15), F.when(F.col("conv_id") % 3 == 0, F.lit(PROMISE)).otherwise(F.lit(HEDGED)))
    ).otherwise(F.concat(F.lit("\n"), "question"))
    wanted = F.when(kind == 0, F.lit('{"category": "寄 件", "reason": ""}')).when(kind == 3, F.col("question"))
    keys = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("category"))).otherwise(F.array(F.lit("phone")))
    rows = pairs_of(spark, sf_dir).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), task.alias("task"), F.col("question").alias("prompt"), F.lit(None).cast("string").alias("answer_type"), wanted.alias("answer"), keys.alias("required_keys"), output.alias("output"),
    )
    return evaluation.record_metrics(rows)


def conv_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_records(spark, sf_dir).select(
        "id", "task", "risk_hits", "json_valid", "json_required_keys_ok", "json_value_match_rate", "json_exact_match", "postal_pollution", "exact_match", F.round("rouge_l_f1", 6).alias("rouge_l_f1"),
    )


def conv_task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.task_metrics(scored_records(spark, sf_dir))
    rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return found.select("task", F.col("count").alias("n"), *rounded("risk_rate", "json_valid_rate", "json_required_keys_rate", "avg_json_value_match_rate", "postal_pollution_rate", "exact_match_rate"))


# Events


def events_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", T.clock(F.col("ts"), "Asia/Shanghai", "yyyy-MM-dd HH:mm").alias("clock"), T.srt_time(F.col("value")).alias("srt_time"), T.sse(F.col("event_type"), F.col("props")).alias("frame")
    )


def events_props_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", evaluation.has_all_keys(props, ["k"]).alias("has_k"), evaluation.has_all_keys(props, ["k", "x"]).alias("has_both"), evaluation.has_all_keys(F.col("event_type"), ["k"]).alias("is_object")
    )


def events_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.status_counts(table(spark, sf_dir, "events"), STATUSES, "event_type")


def monitor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each user as a step of its event type's run; low ones are gated."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("user_id").alias("step"), F.date_format("ts", "yyyy-MM-dd").alias("file"), F.col("event_id").alias("line"), F.col("value").alias("score"), (F.col("value") < 2).alias("gated")
    )
    return evaluation.last_per_step(rows, ["run"])


def events_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.running_best(monitor_steps(spark, sf_dir), ["run"]).select("run", "step", "score", "best_before", "best_updated")


def events_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_summary(monitor_steps(spark, sf_dir), ["run"]).withColumn("score_drop", F.round("score_drop", 4))


QUERIES = {
    f.__name__: f
    for f in (
        docs_dates, docs_norms, docs_unfenced, docs_prefer_labels, docs_labels_aligned, docs_not_labelled, docs_label_upsert, docs_upsert_counts, docs_category_counts, docs_field_profile,
        docs_union, docs_first, docs_first_intent, labels_metric, pages_rank_folder, conv_oldest_answer, conv_error_titles, events_props_keys,
        labels_weighted, labels_report_values, pages_pdf_title, pages_headers, pages_decoded, pages_allowed, pages_fetch_log, pages_jsonl, pages_raw_or_preview, pages_crawl_report,
        conv_markdown_sections, conv_markdown_records, conv_srt_entries, conv_srt_batches, conv_srt_translated, conv_srt_split, conv_srt_chinese, conv_first_two, conv_retry, conv_citations,
        conv_newest_citation, conv_qa_examples, conv_identity, conv_answer_part, conv_faq, conv_record_metrics, conv_task_metrics, events_clock, events_status_counts, events_running_best, events_run_summary,
    )
}
NL = "chr(10)"
WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}-]+"
NETLOC = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
ALLOWED = "(" + " OR ".join(f"{NETLOC} = '{d}' OR ends_with({NETLOC}, '.{d}')" for d in DOMAINS) + ")"
ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
PAIRS = "(SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
MESSAGES = "(SELECT conv_id * 1000 + turn AS id, conv_id, role, text AS content, turn FROM conversations)"


def sql_slug(expr: str) -> str:
    inner = f"regexp_replace({STRIPPED(expr)}, '{WORD}', '-', 'g')"
    return f"coalesce(nullif(regexp_replace(regexp_replace({inner}, '-{{2,}}', '-', 'g'), '^-|-$', '', 'g'), ''), 'section')"


def sql_srt_time(seconds: str) -> str:
    ms = f"floor(round(({seconds}) * 1000, 6))::BIGINT"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def sql_clean_line(expr: str) -> str:
    out = f"regexp_replace({STRIPPED(expr)}, '^(---+|\\*\\*\\*+|___+)$', '')"
    for pattern in ("^>\\s?", "^[-*+]\\s+", "^\\d+[.、)]\\s*"):
        out = STRIPPED(f"regexp_replace({out}, '{pattern}', '')")
    return out


SECTIONS = f"""
    SELECT conv_id || '.md' AS file, conv_id, seg, any_value(regexp_replace({STRIPPED("part")}, '^第[^部]*部分[：:]', '')) AS category,
        {STRIPPED("any_value(head)")} AS title, string_agg(piece, {NL} ORDER BY turn) AS body
    FROM (SELECT *, first_value(role) OVER s AS opener, first_value(split_part(text, {NL}, 1)) OVER s AS head,
            CASE WHEN role = 'assistant' THEN '- ' || text WHEN contains(text, {NL}) THEN substr(text, length(split_part(text, {NL}, 1)) + 2) END AS piece
        FROM (SELECT *, sum((role <> 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg,
                coalesce(min_by(split_part(text, {NL}, 1), turn) FILTER (role = 'system') OVER (PARTITION BY conv_id), '') AS part FROM conversations)
        WINDOW s AS (PARTITION BY conv_id, seg ORDER BY turn))
    WHERE opener = 'user' GROUP BY conv_id, seg"""
SRT = f"""
    SELECT conv_id::VARCHAR AS file, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS idx, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos,
        {sql_srt_time("turn * 2.5")} || ' --> ' || {sql_srt_time("turn * 2.5 + 2.25")} AS times, said AS text
    FROM (SELECT *, regexp_replace({STRIPPED("text")}, '\\n\\s*\\n', chr(10), 'g') AS said FROM conversations) WHERE said <> ''"""
CJK_RATIO = r"(CASE WHEN length(regexp_replace({0}, '[\s\p{{Z}}\d:,.\->]', '', 'g')) > 0 THEN length(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'))::DOUBLE / length(regexp_replace({0}, '[\s\p{{Z}}\d:,.\->]', '', 'g')) ELSE 0.0 END)"
CITES = "(SELECT id - 1 AS message_id, length(content) / 1000.0 AS score, turn, md5(content) AS quoted_text, id FROM " + MESSAGES + " WHERE role = 'assistant')"
#: The metrics of a record follow from how it was made (``scored_records``); a repeated question scores 1.
RECORDS = f"""
    SELECT conv_id || ':' || turn AS id, ['format', 'math', 'safety', 'postal'][k + 1] AS task, CASE WHEN k = 2 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS risk_hits,
        CASE WHEN k = 0 THEN true END AS json_valid, CASE WHEN k = 0 THEN conv_id % 2 = 0 END AS json_required_keys_ok,
        CASE WHEN k = 0 THEN CASE WHEN normal = '' THEN 1.0 ELSE 0.5 END END::DOUBLE AS json_value_match_rate, CASE WHEN k = 0 THEN normal = '' END AS json_exact_match,
        CASE WHEN k = 1 THEN NOT contains(question, '快递') END AS postal_pollution, CASE WHEN k = 3 THEN true END AS exact_match, CASE WHEN k = 3 THEN 1.0 END::DOUBLE AS rouge_l_f1
    FROM (SELECT *, ((conv_id + turn) % 4)::INT AS k, {sql_collapse("answer")} AS normal FROM {PAIRS})"""
STEPS = "(SELECT event_type AS run, user_id AS step, value AS score, value < 2 AS gated FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) = 1)"
UNION = "SELECT 'a' AS kind, doc_id AS ord, md5(text) AS text_md5 FROM documents UNION ALL SELECT 'b', item_id + (SELECT count(*) FROM documents), md5(text) FROM benchmark"
ORACLE = {
    "docs_dates": r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(20\d{2}[-/年]\d{1,2}[-/月]\d{1,2}日?)', 1), ''), regexp_extract(text, '(20\d{2}\.\d{1,2}\.\d{1,2})', 1)) AS published_at FROM documents",
    "docs_norms": f"SELECT doc_id, md5(lower(regexp_replace(text, '[\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+', '', 'g'))) AS norm_md5, {sql_slug(f'split_part(text, {NL}, 1)')} AS slug FROM documents",
    "docs_unfenced": f"SELECT doc_id, md5({STRIPPED('text')}) AS body_md5, md5({STRIPPED('text')}) AS ruleless_md5, md5('Instruct: find the passage' || {NL} || 'Query:' || text) AS query_md5 FROM documents",
    "docs_prefer_labels": "SELECT coalesce(d.doc_id, l.doc_id)::VARCHAR AS stem, md5(coalesce('quality ' || quality, text)) AS text_md5 FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "docs_labels_aligned": "SELECT doc_id, lang, quality, lang AS other FROM documents JOIN labels USING (doc_id)",
    "docs_not_labelled": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "docs_label_upsert": "SELECT doc_id, lang AS v FROM documents UNION ALL SELECT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "docs_upsert_counts": "SELECT count(*) FILTER (l.doc_id IS NULL) AS created, count(l.doc_id) AS updated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "docs_category_counts": "SELECT category, count(*) AS n FROM (SELECT unnest([lang, source]) AS category FROM documents) GROUP BY category",
    "docs_field_profile": """
        SELECT p::INT AS place, field, CASE WHEN missing THEN 'NoneType' ELSE kind END AS kind FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1),
            LATERAL (VALUES (0, 'doc_id', 'int', doc_id IS NULL), (1, 'text', 'str', text IS NULL), (2, 'lang', 'str', lang IS NULL), (3, 'source', 'str', source IS NULL), (4, 'n_chars', 'int', n_chars IS NULL)) AS v(p, field, kind, missing)""",
    "docs_union": UNION,
    "docs_first": f"{UNION} ORDER BY kind, ord LIMIT {FIRST}",
    "docs_first_intent": "SELECT doc_id, lang AS intent FROM documents",
    "labels_metric": "SELECT doc_id, coalesce(quality::DOUBLE, -1) AS valid, -1::DOUBLE AS odd, -1::DOUBLE AS absent FROM labels",
    "pages_rank_folder": "SELECT page_id, page_id::INT AS rank, NULL::INT AS other FROM pages",
    "conv_oldest_answer": f"SELECT conv_id AS conversation_id, min(id) AS id, md5(min_by(content, id)) AS content_md5 FROM {MESSAGES} WHERE role = 'assistant' GROUP BY conv_id",
    "conv_error_titles": "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN substr(max_by(text, turn) FILTER (role = 'user'), 1, 128) ELSE 'no ' || conv_id END AS title FROM conversations GROUP BY conv_id",
    "events_props_keys": "SELECT event_id, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'x') AS has_both, false AS is_object FROM events",
    "labels_weighted": f"SELECT doc_id, round(quality * 100 * {WEIGHTS['quality']}::DOUBLE + toxic * 100 * {WEIGHTS['toxic']}::DOUBLE, 2) AS overall FROM labels",
    "labels_report_values": "SELECT doc_id, CASE quality WHEN 1 THEN '是' ELSE '否' END AS good, printf('%.3f', quality / 3.0::DOUBLE) AS third, CASE WHEN toxic <> 0 THEN toxic::VARCHAR ELSE '无' END AS toxic FROM labels",
    "pages_pdf_title": f"SELECT page_id, coalesce(nullif({sql_entities("string_split(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/')[-1]")}, ''), 'Example PDF') AS title FROM pages",
    "pages_headers": f"""
        SELECT page_id, (6 + ({ORIGIN} <> '')::INT + retry::INT * 4)::INT AS n, nullif({ORIGIN}, '') || '/' AS referer, 'reader/1' AS agent, retry
        FROM (SELECT *, ends_with(split_part({NETLOC}, ':', 1), '{fetching.GUARDED_SITE}') AS retry FROM pages)""",
    "pages_decoded": "SELECT page_id, md5(CASE WHEN ends_with(lower(url), '.pdf') THEN '' ELSE html END) AS text_md5 FROM pages",
    "pages_allowed": f"SELECT page_id, {ALLOWED} AS allowed FROM pages",
    "pages_fetch_log": "SELECT page_id, sha1('html:' || url || ':' || substr(html, 1, 200)) || '.html' AS raw_name, md5(substr(html, 1, 1000)) AS text_md5, length(html) > 1000 AS text_truncated, '<bytes:' || strlen(html) || '>' AS body_bytes FROM pages",
    "pages_jsonl": "SELECT page_id, url, md5(html) AS html_md5 FROM pages",
    "pages_raw_or_preview": f"SELECT page_id, md5(CASE WHEN {ALLOWED} THEN html ELSE substr(html, 1, 100) END) AS text_md5 FROM pages",
    "pages_crawl_report": """
        SELECT 'totals' AS section, 'total' AS name, count(*) AS n FROM pages UNION ALL SELECT 'totals', 'successes', count(*) FROM pages WHERE page_id % 7 <> 0
        UNION ALL SELECT 'totals', 'failures', count(*) FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT 'companies', coalesce(nullif(source, ''), '未知来源'), count(*) FROM documents GROUP BY ALL
        UNION ALL SELECT 'categories', lang, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'failures', 'HTTP 404', count(*) FROM pages WHERE page_id % 7 = 0 HAVING count(*) > 0""",
    "conv_markdown_sections": f"SELECT file, category, title, md5(coalesce(body, '')) AS body_md5 FROM ({SECTIONS})",
    "conv_markdown_records": f"""
        SELECT file || '#' || {sql_slug("title")} AS uri, title, category, md5(array_to_string(l[1:4], ' ')) AS summary_md5, md5(array_to_string(l, {NL})) AS evidence_md5
        FROM (SELECT *, list_filter(list_transform(string_split(body, {NL}), lambda x: {sql_clean_line("x")}), lambda x: x <> '') AS l FROM ({SECTIONS})) WHERE len(l) > 0""",
    "conv_srt_entries": f"SELECT file, pos, idx, times, md5(text) AS text_md5 FROM ({SRT})",
    "conv_srt_batches": f"SELECT file, (pos // {BATCH})::BIGINT AS batch, md5(string_agg((pos % {BATCH} + 1) || ': ' || replace(text, {NL}, ' '), {NL} ORDER BY pos)) AS prompt_md5 FROM ({SRT}) GROUP BY file, pos // {BATCH}",
    "conv_srt_translated": f"SELECT file, pos, md5(CASE pos % {BATCH} WHEN 0 THEN 'eins' WHEN 1 THEN 'zwei' ELSE text END) AS text_md5 FROM ({SRT})",
    "conv_srt_split": f"""
        SELECT file, pos, md5(array_to_string(list_filter(l, lambda x: regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]')), {NL})) AS zh_md5,
            md5(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '[\\x{{4e00}}-\\x{{9fff}}]')), {NL})) AS en_md5 FROM (SELECT *, string_split(text, {NL}) AS l FROM ({SRT}))""",
    "conv_srt_chinese": f"SELECT file, {CJK_RATIO.format('t')} > 0.3 AS chinese FROM (SELECT file, string_agg(text, ' ' ORDER BY pos) AS t FROM ({SRT}) WHERE pos < 30 GROUP BY file)",
    "conv_first_two": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2",
    "conv_retry": f"""
        SELECT id, md5(CASE WHEN turn = last THEN 'once more' ELSE content END) AS content_md5
        FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM {MESSAGES}) WHERE last IS NULL OR turn <= last""",
    "conv_citations": f"SELECT m.id, count(c.id)::INT AS n, max_by(quoted_text, (score, c.turn, quoted_text)) AS best FROM {MESSAGES} m LEFT JOIN {CITES} c ON c.message_id = m.id GROUP BY m.id",
    "conv_newest_citation": f"SELECT m.conv_id, max_by(c.id, c.turn) AS id, max_by(quoted_text, c.turn) AS quoted_text FROM {MESSAGES} m JOIN {CITES} c ON c.message_id = m.id GROUP BY m.conv_id",
    "conv_qa_examples": f"""
        SELECT conv_id AS dialogue_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS qa_index,
            md5({sql_collapse("question")} || CASE WHEN turn % 4 = 0 THEN {NL} || '意图：寄 件' ELSE '' END) AS asked_md5, md5({sql_collapse("answer")}) AS answer_md5 FROM {PAIRS}
        QUALIFY {sql_collapse("question")} <> '' AND {sql_collapse("answer")} <> ''""",
    "conv_identity": f"SELECT conv_id * 1000 + turn AS ord, md5('system:be brief' || {NL} || 'user:' || {sql_collapse('question')} || {NL} || 'assistant:' || {sql_collapse('answer')}) AS messages_md5 FROM {PAIRS} WHERE {sql_collapse('question')} <> '' AND {sql_collapse('answer')} <> ''",
    "conv_answer_part": f"SELECT conv_id, turn, md5({STRIPPED('answer')}) AS from_summary, md5({STRIPPED('answer')}) AS from_evidence FROM {PAIRS}",
    "conv_faq": f"""
        SELECT 'faq:' || conv_id || '#faq-' || turn AS url, md5('栏目：常见问题。问题：' || q || '。答案：' || a) AS text_md5
        FROM (SELECT *, {sql_collapse(sql_entities("question"))} AS q, {sql_collapse(sql_entities("answer || '。'"))} AS a FROM {PAIRS}) WHERE q <> '' AND a <> '' AND length(q) + length(a) >= 40""",
    "conv_record_metrics": RECORDS,
    "conv_task_metrics": f"""
        SELECT task, count(*) AS n, round(avg(risk_hits), 6) AS risk_rate, round(avg(json_valid::INT), 6) AS json_valid_rate, round(avg(json_required_keys_ok::INT), 6) AS json_required_keys_rate,
            round(avg(json_value_match_rate), 6) AS avg_json_value_match_rate, round(avg(postal_pollution::INT), 6) AS postal_pollution_rate, round(avg(exact_match::INT), 6) AS exact_match_rate FROM ({RECORDS}) GROUP BY task""",
    "events_clock": f"SELECT event_id, strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M') AS clock, {sql_srt_time('value')} AS srt_time, 'event: ' || event_type || {NL} || 'data: ' || props || {NL} || {NL} AS frame FROM events",
    "events_status_counts": "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS {s}" for s in STATUSES) + " FROM events",
    "events_running_best": f"SELECT run, step, score, best_before, NOT gated AND (best_before IS NULL OR score > best_before) AS best_updated FROM (SELECT *, max(CASE WHEN NOT gated THEN score END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {STEPS})",
    "events_run_summary": f"SELECT run, count(*) AS n_steps, max(score) AS best_score, min(step) FILTER (score = m) AS best_step, max_by(score, step) AS final_score, round(max(score) - max_by(score, step), 4) AS score_drop FROM (SELECT *, max(score) OVER (PARTITION BY run) AS m FROM {STEPS}) GROUP BY run",
}
