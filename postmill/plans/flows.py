"""Queries on streams, answer events, stored indexes, run folders and files that the tables are written to first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.functions import text as T
from postmill.operators import crawl, dialogue, frames, index, links, reduction, subtitles
from postmill.plans import pages as page_plans
from postmill.plans.common import sql_collapse, sql_plain, sql_text, table
from postmill.session import fresh_path
from postmill.sources import readers, runs, sinks
from postmill.streaming import once, unseen

PIECE, CHUNK = 7, 11
K, STEP = 5, 50
TREE_CHARS = 2000
RANKS, TOTAL_STEPS = 6, 9000
REFERENCES = [
    "../x/./y", "./a//b/../c", "../../../up", "g;x=1/../y", "?q=1", "", "/r/../s/.", "//other.example/p/../q", "https://a.example/b/../c", "..", "b/", "/", "./", "#top", "a?b=/../c", "g/..", "/./g", "../../../../g",
]


# Streams


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an address and a print, both of one day, so that each day is a chain of its own."""
    day = F.date_format("ts", "yyyy-MM-dd")
    address, mark = F.concat_ws(":", day, F.col("user_id").cast("string")), F.concat_ws(":", day, "event_type", F.round("value").cast("int").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), address.alias("address"), mark.alias("mark"))


def events_stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept by address and print, as a stream: odd events come a day late and are put in order by the watermark."""
    rows, inbox, folder = dated_events(spark, sf_dir), fresh_path(spark, "events-inbox"), fresh_path(spark, "events-unseen")
    schema = rows.schema
    part = F.floor((F.dayofmonth("ts") + F.col("event_id") % 2) / 16)
    spark.createDataFrame([], schema).write.parquet(inbox)
    release = unseen.release_to(spark.readStream.schema(schema).parquet(inbox), "ts", "event_id", "3 days", "1 hour", folder)
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/released")
    keep = None
    closing = rows.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 5 DAYS")).alias("ts"), F.lit("").alias("address"), F.lit("").alias("mark"))
    try:
        for arriving in (rows.where(part == 0), rows.where(part > 0), closing):
            arriving.write.mode("append").parquet(inbox)
            release.processAllAvailable()
            if keep is None:
                keep = unseen.keep_unseen_stream(spark.readStream.schema(schema).parquet(f"{folder}/released"), "event_id", "address", "mark", folder)
            keep.processAllAvailable()
    finally:
        release.stop()
        if keep is not None:
            keep.stop()
    return unseen.kept_rows(spark, folder).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def pages_stream_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page log parsed as a stream: gate and raw texts as in the batch form; a repeat has an address or a title and text seen before."""
    pages = table(spark, sf_dir, "pages")
    log = pages.select(
        F.col("page_id").alias("ord"), F.lit("s").alias("source_id"), F.lit("Example").alias("company"), F.substring_index("url", "?", 1).alias("url"), (F.col("page_id") % 11 != 0).alias("success"),
        F.substring("html", 1, 200).alias("text"), F.concat("url", F.lit(".html")).alias("raw_text_path"),
    )
    raw = pages.select(F.concat("url", F.lit(".html")).alias("path"), "html")
    inbox, folder = fresh_path(spark, "fetch-log"), fresh_path(spark, "fetches")
    middle = pages.agg(F.max("page_id")).first()[0] or 0
    spark.createDataFrame([], log.schema).write.json(inbox)
    stream = spark.readStream.schema(log.schema).json(inbox)
    parsed = crawl.kept_fetches(stream, raw, page_plans.TOPICS, page_plans.LEX)
    parsed = parsed.select("ord", "url", "title", F.sha2(F.concat("title", "plain_text"), 256).alias("mark"))  # the whole text: a summary is that of other pages too
    query = unseen.keep_unseen_stream(parsed, "ord", "url", "mark", folder)
    try:
        for half in (log.where(F.col("ord") <= middle // 2), log.where(F.col("ord") > middle // 2)):
            half.write.mode("append").json(inbox)
            query.processAllAvailable()
    finally:
        query.stop()
    return unseen.kept_rows(spark, folder).select(F.col("ord").alias("page_id"), "url", "title")


def conv_tickets_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of a stream of user messages: the first request of a conversation makes it, later ones find it."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    inbox, folder = fresh_path(spark, "ticket-requests"), fresh_path(spark, "tickets")
    schema = StructType.fromDDL("conv_id long, ticket string")
    make = lambda rows: rows.select("conv_id", F.md5(F.concat_ws(":", "turn", "text")).alias("ticket"))
    for early in (F.col("turn") < 2, F.col("turn") >= 2):
        asked.where(early).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(asked.schema).parquet(inbox)
        once.make_once(stream, "conv_id", ["turn"], make, folder, schema).awaitTermination()
    return once.stored(spark, folder).select("conv_id", "ticket")


# Answer events and conversations


def conv_event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written as event frames, cut into chunks anywhere, and read back."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rag, failed = F.col("conv_id") % 2 == 0, F.col("conv_id") % 5 == 0
    keys = [F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id")]
    answers = said.select(
        *keys, rag.alias("use_rag"), F.lit(False).alias("use_sft"), F.when(rag, F.lit("light")).otherwise(F.lit("none")).alias("rag_profile"),
        F.when(rag, F.lit(2)).otherwise(F.lit(0)).alias("rag_top_k"), F.col("text").alias("answer"), F.when(failed, F.concat(F.lit("failed: "), F.col("conv_id").cast("string"))).alias("error"),
    )
    hits = said.where(rag).select(*keys, F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), "text")
    hits = hits.select("conversation_id", "message_id", "rank", (1 / F.col("rank")).alias("score"), F.lit("k").alias("source_key"), F.substring("text", F.col("rank") * 3, F.lit(20)).alias("quoted_text"))
    events = frames.encoded(frames.answer_events(answers, hits, PIECE))
    chunks = frames.cut(events, "conversation_id", ["message_id", "seq"], CHUNK)
    found = frames.records(chunks, "conversation_id", "chunk")
    of = lambda name: F.get_json_object("data", f"$.{name}")
    value = F.coalesce(of("content"), of("quoted_text"), of("message"), of("message_id"), of("rag_profile"))
    return found.select(F.col("conversation_id").alias("conv_id"), F.col("record").alias("seq"), "event", F.md5(value).alias("value_md5"))


def conv_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message of each conversation as a chat request: every third conversation exists, the others are made."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    there = F.col("conv_id") % 3 == 0
    known = first.where(there).select((F.col("conv_id") + 1).alias("conversation_id"))
    requests = first.select(F.col("conv_id").alias("request_id"), F.when(there, F.col("conv_id") + 1).alias("conversation_id"), F.col("text").alias("message"))
    created, messages = dialogue.conversation_writes(requests, known)
    new = created.select("conversation_id", F.lit(True).alias("created"))
    return messages.join(new, "conversation_id", "left").select("request_id", "conversation_id", F.coalesce("created", F.lit(False)).alias("created"), F.md5("content").alias("content_md5"))


# Indexes and documents


def emb_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as an index, loaded, and searched by every fiftieth of them."""
    rows, path = table(spark, sf_dir, "embeddings"), fresh_path(spark, "index")
    index.write_index(rows, path, "table", "none", "vec_id")
    asked = rows.where(F.col("vec_id") % STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(index.load_index(spark, path), asked, K).select("query_id", "rank", "vec_id", "label", F.round("score", 3).alias("score"))


def docs_policy_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as policy records with what a vector of them would need to be traced back."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source_id"), F.when(F.col("doc_id") % 3 != 0, F.lit("Post")).alias("company"), F.concat(F.lit(" u"), F.col("doc_id").cast("string")).alias("url"),
        F.substring("text", 1, 30).alias("title"), F.col("lang").alias("published_at"), F.array("lang", F.lit(" "), "source").alias("policy_categories"), F.lit("s").alias("summary"), F.lit("e").alias("evidence_text"),
        (F.col("n_chars") > 2000).alias("insurance_available"), none.alias("insurance_type"), none.alias("compensation_limit"), F.lit("30").alias("claim_deadline"),
        F.array().cast("array<string>").alias("requirements"), F.array().cast("array<string>").alias("insurance_exclusions"),
    )
    found = index.policy_documents(rows, "doc_id", "policy.jsonl")
    of = lambda name: F.get_json_object("metadata", f"$.{name}")
    return found.select("key", "split", of("source_id").alias("source_id"), of("company").alias("company"), of("intents").alias("intents"), of("insurance_available").alias("insured"), of("turn_count").alias("turns"), F.substring_index("content", "\n", -1).alias("last_line"))


def docs_jsonl_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of documents, a file a source with blank lines in it, read back with their line numbers."""
    docs = table(spark, sf_dir, "documents")
    blank = F.array_repeat(F.lit(""), (F.col("doc_id") % 3).cast("int"))
    lines = docs.select(F.concat("source", F.lit(".jsonl")).alias("name"), "doc_id", F.posexplode(F.concat(F.array(F.to_json(F.struct("doc_id", "n_chars"))), blank)).alias("k", "text"))
    folder = fresh_path(spark, "numbered")
    sinks.write_files(lines.withColumn("line", F.struct("doc_id", "k")), folder)
    found = readers.jsonl_numbered(spark, folder, "doc_id long, n_chars long")
    return found.select("file", "line", "row.doc_id", "row.n_chars")


def docs_tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents summarised by a model that leaves nothing out, in rounds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    same = lambda c: c
    found = reduction.summarised(docs, "doc_id", "text", TREE_CHARS, same, same, lambda prompts: prompts, lambda parts: F.array_join(parts, ""))
    return found.select("doc_id", F.md5("summary").alias("summary_md5"), "rounds")


# Files of runs and subtitles


def monitor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.dayofmonth("ts") < 16, F.lit("1")).otherwise(F.lit("2"))
    report = F.concat(F.lit('{"tasks":{"format":{"json_valid_rate":'), F.col("value").cast("string"), F.lit(',"json_required_keys_rate":"x"},"safety":{"risk_rate":0.5}}}'))
    line = F.concat(F.lit('{"step":'), F.col("event_id").cast("string"), F.lit(',"score":'), F.col("value").cast("string"), F.lit(',"metrics":'), report, F.lit("}"))
    rows = table(spark, sf_dir, "events").withColumn("rank", F.col("user_id") % 4).withColumn("half", half)
    return rows.select("event_id", "value", "rank", "half", report.alias("report"), line.alias("text"), F.col("event_id").alias("line"))


def monitor_name() -> Column:
    return F.concat(F.lit("rank_"), F.col("rank").cast("string"), F.lit("/logs/train_monitor_"), "half", F.lit(".jsonl"))


def events_resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where runs go on whose newest monitors have cut lines and steps that are texts."""
    rows, folder = monitor_lines(spark, sf_dir), fresh_path(spark, "run")
    broken = F.when(F.col("event_id") % 17 == 0, F.substring("text", 1, 12)).when(F.col("event_id") % 13 == 0, F.regexp_replace("text", r'"step":(\d+)', '"step":"$1"')).otherwise(F.col("text"))
    sinks.write_files(rows.withColumn("name", monitor_name()).withColumn("text", broken), folder)
    return runs.resume_plan(spark.range(RANKS).select(F.col("id").cast("int").alias("rank")), runs.completed_steps(spark, folder), TOTAL_STEPS)


def events_rank_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and final figures of runs; odd ranks keep their best files in the older folder, even ones in both."""
    rows, folder = monitor_lines(spark, sf_dir), fresh_path(spark, "run")
    best = rows.groupBy("rank", "half").agg(F.max_by(F.struct("event_id", "value", "report"), F.struct("value", -F.col("event_id"))).alias("b"))
    text = F.concat(F.lit('{"best_step":'), F.col("b.event_id").cast("string"), F.lit(',"best_score":'), F.col("b.value").cast("string"), F.lit(',"metrics":'), F.col("b.report"), F.lit("}"))
    older = F.concat(F.lit("rank_"), F.col("rank").cast("string"), F.lit("/best_adapter/best_adapter_9"), "half", F.lit(".json"))
    newer = F.concat(F.lit("rank_"), F.col("rank").cast("string"), F.lit("/logs/best_adapter_"), "half", F.lit(".json"))
    names = F.when(F.col("rank") % 2 == 0, F.array(older, newer)).otherwise(F.array(older))
    files = best.select(F.explode(names).alias("name"), F.lit(0).cast("long").alias("line"), text.alias("text"))
    files = files.withColumn("text", F.when(F.col("name").contains("/best_adapter/") & F.col("name").rlike("rank_[02]"), F.lit("{}")).otherwise(F.col("text")))
    sinks.write_files(rows.withColumn("name", monitor_name()).select("name", "line", "text").unionByName(files), folder)
    return runs.rank_comparison(spark, folder).drop("postal_terms", "next_steps")


def events_rank_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = monitor_lines(spark, sf_dir)
    score = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    found = runs.rank_summaries(rows.select("rank", F.col("event_id").alias("step"), score.alias("score"), F.col("report").alias("metrics")), ["rank"])
    return found.select("rank", "steps", "last_step", "best_step", "best_score", "final_score", F.round("score_drop", 6).alias("score_drop"), "json_valid", "json_keys", "safety_risk", "ceval_acc")


def conv_srt_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files of conversations in folders: those to work on, and whether they have two languages."""
    said = table(spark, sf_dir, "conversations").withColumn("said", T.collapse(F.col("text"))).where("said <> ''")
    tag = F.when(F.col("conv_id") % 5 == 0, F.lit(".en")).when(F.col("conv_id") % 7 == 0, F.lit(".zh")).otherwise(F.lit(""))
    name = F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string"), F.lit("/c"), F.col("conv_id").cast("string"), tag, F.lit(".srt"))
    both = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("中文"), F.col("said"))).otherwise(F.array("said"))
    rows = said.select(name.alias("name"), "turn", F.posexplode(F.concat(F.array(F.concat(F.lit("#"), F.col("turn").cast("string")), F.lit("0 --> 1")), both, F.array(F.lit(""), F.lit("")))).alias("k", "text"))
    folder = fresh_path(spark, "subtitles")
    sinks.write_files(rows.withColumn("line", F.struct("turn", "k")), folder)
    return subtitles.subtitle_sets(readers.whole_texts(spark, folder, "*.srt"))


def pages_resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every form, seen from each page's address."""
    refs = F.array(*map(F.lit, REFERENCES))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(refs).alias("n", "ref"))
    return rows.select("page_id", "n", links.absolute_url(F.col("url"), F.col("ref")).alias("resolved"))


QUERIES = {
    f.__name__: f
    for f in (
        events_stream_unseen, pages_stream_fetches, conv_tickets_once, conv_event_frames, conv_writes, emb_index_search, docs_policy_index_rows, docs_jsonl_numbered, docs_tree_summary,
        events_resume_plan, events_rank_comparison, events_rank_summaries, conv_srt_folder, pages_resolved_urls,
    )
}


def sql_unseen(rows: str, ident: str, address: str, mark: str, group: str) -> str:
    """Rows kept one after the other by address and print, in each group, as a recursion over their numbers."""
    return f"""
        WITH RECURSIVE numbered AS (SELECT {group} AS grp, {ident} AS ident, {address} AS address, {mark} AS mark, row_number() OVER (PARTITION BY {group} ORDER BY {ident}) AS n FROM ({rows})),
        step AS (
            SELECT grp, 0::BIGINT AS n, NULL::BIGINT AS ident, false AS kept, []::VARCHAR[] AS addresses, []::VARCHAR[] AS marks FROM (SELECT DISTINCT grp FROM numbered)
            UNION ALL
            SELECT grp, n, ident, fresh, CASE WHEN fresh THEN list_append(addresses, address) ELSE addresses END, CASE WHEN fresh THEN list_append(marks, mark) ELSE marks END
            FROM (SELECT r.grp, r.n, r.ident, r.address, r.mark, s.addresses, s.marks, NOT list_contains(s.addresses, r.address) AND NOT list_contains(s.marks, r.mark) AS fresh
                FROM step s JOIN numbered r ON r.grp = s.grp AND r.n = s.n + 1)
        ),
        kept AS (SELECT grp, ident FROM step WHERE kept)"""


DAY = "strftime(ts, '%Y-%m-%d')"
EVENTS = f"SELECT event_id, {DAY} AS day, {DAY} || ':' || user_id AS address, {DAY} || ':' || event_type || ':' || round(value)::INT AS mark FROM events"
PIECES = f"list_transform(range(((length(text) + {PIECE - 1}) // {PIECE})), lambda i: substr(text, 1 + {PIECE} * i, {PIECE}))"
HALF = "CASE WHEN day(ts) < 16 THEN 1 ELSE 2 END"
LAST_HALF = f"(SELECT *, user_id % 4 AS rank, {HALF} AS half, max({HALF}) OVER (PARTITION BY user_id % 4) AS last_half FROM events)"
REF_SQL = ", ".join(map(sql_text, REFERENCES))
STACK = "array_to_string(list_reduce(list_concat([['']], list_transform({0}, lambda s: [s])), lambda a, s: CASE WHEN s[1] = '..' THEN a[:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)[2:] || CASE WHEN {0}[-1] IN ('.', '..') THEN [''] ELSE [] END, '/')"
SRT_NAME = "'c' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '.en' WHEN conv_id % 7 = 0 THEN '.zh' ELSE '' END || '.srt'"
ORACLE = {
    "events_stream_unseen": sql_unseen(EVENTS, "event_id", "address", "mark", "day") + " SELECT ident AS event_id, grp AS day FROM kept",
    "pages_stream_fetches": f"""
        WITH pages AS (SELECT page_id, split_part(url, '?', 1) AS url, html FROM main.pages WHERE page_id % 11 <> 0),
        gate AS ({page_plans.ORACLE["pages_policy_gate"]}),
        rows AS (SELECT page_id, url, {page_plans.TITLE_SQL} AS title, {sql_plain("html")} AS plain FROM pages JOIN gate USING (page_id) WHERE filter_reason = 'keep'),
        kept AS ({sql_unseen("SELECT page_id, url, title || plain AS mark FROM rows", "page_id", "url", "mark", "0")} SELECT ident FROM kept)
        SELECT page_id, url, title FROM rows WHERE page_id IN (SELECT ident FROM kept)""",
    "conv_tickets_once": "SELECT conv_id, md5(concat_ws(':', min(turn), arg_min(text, turn))) AS ticket FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "conv_event_frames": f"""
        WITH a AS (SELECT conv_id, turn, text, conv_id % 2 = 0 AS rag, conv_id % 5 = 0 AS failed FROM conversations WHERE role = 'assistant'),
        e AS (
            SELECT conv_id, turn, 0 AS part, 0 AS i, 'meta' AS event, CASE WHEN rag THEN 'light' ELSE 'none' END AS value FROM a
            UNION ALL SELECT conv_id, turn, 1, r, 'citation', substr(text, r * 3, 20) FROM a, (VALUES (1), (2)) v(r) WHERE rag
            UNION ALL SELECT conv_id, turn, 2, unnest(range(len({PIECES}))), 'delta', unnest({PIECES}) FROM a
            UNION ALL SELECT conv_id, turn, 3, 0, CASE WHEN failed THEN 'error' ELSE 'done' END, CASE WHEN failed THEN 'failed: ' || conv_id ELSE turn::VARCHAR END FROM a
        )
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part, i) - 1 AS seq, event, md5(value) AS value_md5 FROM e""",
    "conv_writes": """
        WITH f AS (SELECT *, conv_id % 3 = 0 AS there FROM conversations WHERE turn = 0), h AS (SELECT coalesce(max(conv_id + 1) FILTER (there), 0) AS top FROM f)
        SELECT conv_id AS request_id, (CASE WHEN there THEN conv_id + 1 ELSE top + row_number() OVER (PARTITION BY there ORDER BY conv_id) END)::BIGINT AS conversation_id, NOT there AS created, md5(text) AS content_md5 FROM f, h""",
    "emb_index_search": f"""
        WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % {STEP} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, label, round(score, 3) AS score FROM r WHERE rank <= {K}""",
    "docs_policy_index_rows": """
        WITH d AS (SELECT *, CASE WHEN doc_id % 4 <> 0 AND trim(source) <> '' THEN trim(source) ELSE 'policy_dataset' END AS sid FROM documents)
        SELECT 'policy:' || doc_id || ':' || sid || ':' || doc_id || ':' || doc_id AS key, 'policy' AS split, sid AS source_id, CASE WHEN doc_id % 3 <> 0 THEN 'Post' ELSE '' END AS company,
            '["' || lang || '","' || source || '"]' AS intents, (n_chars > 2000)::VARCHAR AS insured, '1' AS turns, '来源链接: u' || doc_id AS last_line FROM d""",
    "docs_jsonl_numbered": "SELECT source || '.jsonl' AS file, (sum(1 + doc_id % 3) OVER (PARTITION BY source ORDER BY doc_id) - 1 - doc_id % 3)::BIGINT AS line, doc_id, n_chars FROM documents",
    "docs_tree_summary": f"SELECT doc_id, md5(text) AS summary_md5, CASE WHEN text = '' THEN 0 ELSE 1 + ceil(log2(ceil(length(text) / {TREE_CHARS})))::INT END AS rounds FROM documents",
    "events_resume_plan": f"""
        WITH s AS (SELECT rank, max(event_id) FILTER (event_id % 17 <> 0 AND event_id % 13 <> 0) AS step FROM {LAST_HALF} WHERE half = last_half GROUP BY rank)
        SELECT r::INT AS rank, coalesce(step, 0) AS completed, CASE WHEN step >= {TOTAL_STEPS} THEN 'skip' WHEN step > 0 THEN 'resume' ELSE 'start' END AS status FROM range({RANKS}) t(r) LEFT JOIN s ON rank = r""",
    "events_rank_comparison": f"""
        SELECT rank::INT AS rank, arg_max(event_id, (value, -event_id))::INT AS best_step, max(value) AS best_score, arg_max(value, event_id) AS final_score, 0.0 AS json_keys, max(value) AS json_valid, 0.5 AS safety_risk,
            0.0 AS final_json_keys, 0.5 AS final_safety_risk FROM {LAST_HALF} WHERE half = last_half GROUP BY rank""",
    "events_rank_summaries": """
        WITH e AS (SELECT user_id % 4 AS rank, event_id, value, CASE WHEN event_id % 50 <> 0 THEN value END AS score FROM events), l AS (SELECT rank, max(event_id) AS last FROM e GROUP BY rank)
        SELECT rank, count(*) AS steps, max(event_id) AS last_step, arg_max(event_id, (score, -event_id)) FILTER (score IS NOT NULL) AS best_step, max(score) AS best_score, coalesce(max(score) FILTER (event_id = last), 0) AS final_score,
            round(max(score) - coalesce(max(score) FILTER (event_id = last), 0), 6) AS score_drop, max(score) AS json_valid, 0.0 AS json_keys, 0.5 AS safety_risk, 0.0 AS ceval_acc FROM e JOIN l USING (rank) GROUP BY rank""",
    "conv_srt_folder": f"""
        SELECT {SRT_NAME} AS file, conv_id % 4 = 0 AS bilingual FROM (SELECT DISTINCT conv_id FROM conversations WHERE {sql_collapse("text")} <> '')
        WHERE conv_id % 5 <> 0 AND NOT (conv_id % 7 = 0 AND conv_id % 4 = 0)""",
    "pages_resolved_urls": rf"""
        WITH r AS (SELECT page_id, url, unnest(range({len(REFERENCES)})) AS n, unnest([{REF_SQL}]) AS ref FROM pages),
        p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS base_path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(ref, '^([^?#]*)', 1) AS path FROM r),
        q AS (SELECT *, substr(ref, length(path) + 1) AS tail, string_split(CASE WHEN starts_with(path, '/') THEN path ELSE regexp_replace(CASE WHEN base_path = '' THEN '/' ELSE base_path END, '[^/]*$', '') || path END, '/') AS parts FROM p),
        s AS (SELECT *, CASE WHEN starts_with(path, '/') THEN parts ELSE list_concat(list_concat(parts[1:1], list_filter(parts[2:-2], lambda x: x <> '')), parts[-1:]) END AS segments FROM q),
        t AS (SELECT *, {STACK.format("segments")} AS resolved_path FROM s)
        SELECT page_id, n::INT AS n, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref WHEN starts_with(ref, '//') THEN scheme || ref
            WHEN path = '' THEN origin || base_path || CASE WHEN starts_with(tail, '?') THEN '' ELSE query END || tail
            ELSE origin || CASE WHEN starts_with(resolved_path, '/') THEN '' ELSE '/' END || resolved_path || tail END AS resolved FROM t""",
}
