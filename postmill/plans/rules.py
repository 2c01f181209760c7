"""Queries on text rules, redirects, gates, records and adapters, whose inputs differ from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import dialogue, fetching, links, markdown, policy, support
from postmill.plans import pages as page_plans
from postmill.plans.common import sql_any, sql_plain, table
from postmill.session import fresh_path
from postmill.sources import adapters, readers, sinks
from postmill.streaming import streams

PATTERNS = ["[a-z]+ing ", "[a-z]{12,}", "[A-Z][a-z]+"]
STATUSES = [200, 204, 301, 403, 404, 429, 500, 503]


def picked(values: list, by: Column) -> Column:
    """The value at a row's place in a list that is gone through again and again."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


def docs_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.first_match(F.col("text"), PATTERNS).alias("match"))


def docs_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice that generations state, in forms that go before each other."""
    letter, other = picked(list("ABCD"), F.col("doc_id")), picked(list("BCA"), F.col("doc_id"))
    forms = [F.concat(F.lit("so 答案："), letter, F.lit(" or "), other), F.concat(letter, F.lit(". it is "), other), F.concat(F.lit("=========="), F.lit(" 选项 "), letter, F.lit(" ==========\nPrompt: D")), F.concat(F.lit("x"), letter, F.lit("x"))]
    said = F.get(F.array(*forms), (F.floor(F.col("doc_id") / 12) % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.choice(said).alias("choice"))


def docs_display_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("客服[1]:你 好 ， （ 请）"), F.col("doc_id").cast("string"), F.lit("用户[2]:好\n\n\n的 ！"))
    return table(spark, sf_dir, "documents").select("doc_id", T.display_norm(text).alias("shown"))


def pages_client_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects by script and by meta element, to addresses of each form."""
    target = picked(["/a/../b", "next", "https://o.example/x", "?p=1"], F.col("page_id"))
    forms = [F.concat(F.lit("<script>window.location.replace('"), target, F.lit("')</script>")), F.concat(F.lit("<script>Location.href = \""), target, F.lit("\"</script>")), F.concat(F.lit("<meta http-equiv='refresh' content='0; url="), target, F.lit("'>")), F.lit("<p>none</p>")]
    page = F.get(F.array(*forms), (F.floor(F.col("page_id") / 4) % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", fetching.client_redirect(F.col("url"), page).alias("target"))


def pages_policy_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether links point to policy pages, by their address and by what they say."""
    found = links.page_links(table(spark, sf_dir, "pages"))
    tail, said = picked(["", "/policy", "/news/rules", "/a.css", "/Terms.pdf", "/file.pdf"], F.col("page_id")), picked(["x", "保价 条款", "Login", "insurance notice"], F.col("pos"))
    return found.select("page_id", "pos", links.policy_like(F.concat("url", tail), said).alias("policy"))


def events_fetch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", picked(STATUSES, F.col("event_id")).alias("status_code"))
    return rows.select("event_id", adapters.fetch_status().alias("f")).select("event_id", "f.success", "f.failure_reason")


def pages_kept_and_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages that the gate keeps and audit rows of the others, as one table."""
    found = page_plans.features(spark, sf_dir)
    kept = policy.policy_records(found, "s", "c").select("source_id", "url", F.lit("").alias("filter_reason"), F.length("evidence_text").alias("n_chars"))
    left = policy.filtered_pages(found, "s", "c").select("source_id", "url", "filter_reason", F.length("excerpt").alias("n_chars"))
    return markdown.merge_records(kept, left)


def docs_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by a stand-in for a model, joined to documents by key."""
    model = lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]
    found = adapters.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", model, 2).drop("text")
    both = dialogue.aligned(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), found, ["doc_id"], [])
    return both.select("doc_id", "n_chars", F.get("embedding", F.lit(0)).alias("length"), F.get("embedding", F.lit(1)).alias("n_e"))


def conv_parsed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets of outputs that are whole, fenced, unknown in a field, without a time, or no object."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    issue = picked(["Refund", "large thing shipping", "寄件", ""], F.col("conv_id"))
    body = lambda extra: F.concat(F.lit('{"user_id":"u'), F.col("conv_id").cast("string"), F.lit('","issue_type":"'), issue, F.lit('"'), F.lit(extra), F.lit("}"))
    whole = body(',"timestamp":"t","need_follow_up":true')
    forms = [whole, F.concat(F.lit("```json\n"), whole, F.lit("\n```")), body(',"timestamp":"t","other":1'), body(""), F.lit("[1]")]
    rows = first.select("conv_id", F.get(F.array(*forms), (F.floor(F.col("conv_id") / 4) % 5).cast("int")).alias("output"))
    return support.parse_tickets(rows).select("conv_id", F.coalesce("error", F.lit("")).alias("error"), "ticket.issue_type", "ticket.need_follow_up", "ticket.service_type")


def events_stream_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ungated value of each user, kept by a stream over events in two parts."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("label"), F.col("event_id").alias("step"), F.col("value").alias("score"), (F.col("event_id") % 7 == 0).alias("gated"))
    inbox, out, mark = (fresh_path(spark, f"best-{n}") for n in ("in", "out", "mark"))
    for part in (rows.where("step % 10 < 5 AND step < 4000"), rows.where("step >= 4000")):
        part.write.mode("append").parquet(inbox)
        stream = streams.best_so_far(spark.readStream.schema(rows.schema).parquet(inbox))
        write = lambda batch, number: batch.selectExpr("*", f"{number} AS batch").write.mode("append").parquet(out)
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("label").agg(F.max_by(F.struct("best_score", "best_step"), "batch").alias("b"))
    return last.select("label", "b.best_score", "b.best_step")


def labels_verdict_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as one object of splits, read back by split and place."""
    rows = table(spark, sf_dir, "labels").withColumn("split", picked(["train", "val", "test"], F.col("doc_id")))
    item = F.to_json(F.struct("doc_id", (F.col("toxic") == 1).alias("bad")))
    lists = rows.groupBy("split").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("j")))), lambda x: x["j"]), ",").alias("j"))
    whole = lists.select(F.lit("verdicts.json").alias("name"), "split", F.concat(F.lit('"'), "split", F.lit('":['), "j", F.lit("]")).alias("text"))
    edge = F.when(F.col("split") == "test", F.concat(F.lit("{"), "text", F.lit(","))).when(F.col("split") == "train", F.concat("text", F.lit(","))).otherwise(F.concat("text", F.lit("}")))
    folder = fresh_path(spark, "verdicts")
    sinks.write_files(whole.withColumn("line", F.col("split")).withColumn("text", edge), folder)
    return readers.split_verdicts(spark, folder, ["train", "val", "test"], "doc_id: long, bad: boolean")


QUERIES = {
    f.__name__: f
    for f in (
        docs_first_match, docs_choice, docs_display_norm, pages_client_redirect, pages_policy_like, events_fetch_status, pages_kept_and_left, docs_embedded, conv_parsed_tickets, events_stream_best, labels_verdict_splits,
    )
}
LIST = lambda values, by: "([" + ", ".join(f"'{v}'" for v in values) + f"])[1 + {by} % {len(values)}]"
LETTER = LIST("ABCD", "doc_id")
TARGET = LIST(["/a/../b", "next", "https://o.example/x", "?p=1"], "page_id")
ISSUE = LIST(["退款咨询", "大件寄递咨询", "寄件", ""], "conv_id")
LIKE_URL = "url || " + LIST(["", "/policy", "/news/rules", "/a.css", "/Terms.pdf", "/file.pdf"], "page_id")
SAID = LIST(["x", "保价 条款", "Login", "insurance notice"], "pos")
ORACLE = {
    "docs_first_match": "SELECT doc_id, trim(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 0, 'i'), '')" for p in PATTERNS) + ", '')) AS match FROM documents",
    "docs_choice": f"SELECT doc_id, CASE WHEN doc_id // 12 % 4 < 3 THEN {LETTER} ELSE '' END AS choice FROM documents",
    "docs_display_norm": "SELECT doc_id, '客服[1]:你好， （请）' || doc_id || chr(10) || '用户[2]:好的！' AS shown FROM documents",
    "pages_client_redirect": rf"""
        WITH p AS (SELECT page_id, {TARGET} AS t, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id, CASE WHEN page_id // 4 % 4 = 3 THEN '' WHEN t = '/a/../b' THEN origin || '/b' WHEN t = 'next' THEN origin || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || 'next' WHEN t = '?p=1' THEN origin || path || t ELSE t END AS target FROM p""",
    "pages_policy_like": page_plans.LINKS_SQL + f"""
        , l AS (SELECT page_id, pos, {LIKE_URL} AS u, {SAID} AS a FROM links),
        f AS (SELECT *, regexp_matches(lower(u), '({"|".join(s.replace(".", "[.]") for s in links.STATIC_SUFFIXES)})$') OR {sql_any("u", ["/xhtml/", "/images/", "/libs/", *links.NEGATIVE_HINTS])} OR {sql_any("a", links.NEGATIVE_HINTS)} AS barred,
            {sql_any("u", links.PATH_HINTS)} AS by_path, {sql_any("a", links.POLICY_HINTS)} AS by_anchor, {sql_any("a", links.ANCHOR_HINTS)} AS hard FROM l)
        SELECT page_id, pos, NOT barred AND CASE WHEN ends_with(lower(u), '.pdf') THEN by_path OR by_anchor ELSE by_path OR (hard AND by_anchor) END AS policy FROM f""",
    "events_fetch_status": f"""
        WITH e AS (SELECT event_id, ({STATUSES})[1 + event_id % {len(STATUSES)}] AS s FROM events)
        SELECT event_id, s BETWEEN 200 AND 299 AS success, CASE WHEN s IN (403, 429, 503) THEN 'refused' WHEN s BETWEEN 200 AND 299 THEN '' ELSE 'HTTP ' || s END AS failure_reason FROM e""",
    "pages_kept_and_left": f"""
        WITH g AS ({page_plans.ORACLE["pages_policy_gate"]}), p AS (SELECT page_id, url, length({sql_plain("html")}) AS n FROM pages)
        SELECT 's' AS source_id, url, CASE WHEN filter_reason = 'keep' THEN '' ELSE filter_reason END AS filter_reason, (CASE WHEN filter_reason = 'keep' THEN n ELSE least(n, 300) END)::INT AS n_chars FROM g JOIN p USING (page_id)""",
    "docs_embedded": "SELECT doc_id, n_chars, length(text)::DOUBLE AS length, length(regexp_replace(text, '[^e]', '', 'g'))::DOUBLE AS n_e FROM documents",
    "conv_parsed_tickets": f"""
        WITH c AS (SELECT conv_id, conv_id // 4 % 5 AS form FROM conversations WHERE turn = 0)
        SELECT conv_id, CASE form WHEN 2 THEN 'unknown field' WHEN 3 THEN 'timestamp is missing' WHEN 4 THEN 'not a JSON object' ELSE '' END AS error, CASE WHEN form < 2 THEN {ISSUE} END AS issue_type,
            CASE WHEN form < 2 THEN true END AS need_follow_up, CASE WHEN form < 2 THEN '邮政客服' END AS service_type FROM c""",
    "events_stream_best": """
        WITH e AS (SELECT user_id::VARCHAR AS label, event_id AS step, value AS score, event_id % 7 = 0 AS gated FROM events WHERE event_id >= 4000 OR event_id % 10 < 5)
        SELECT label, max(score) FILTER (NOT gated) AS best_score, arg_max(step, (score, -step)) FILTER (NOT gated) AS best_step FROM e GROUP BY label""",
    "labels_verdict_splits": f"""
        WITH l AS (SELECT doc_id, toxic = 1 AS bad, {LIST(["train", "val", "test"], "doc_id")} AS split FROM labels)
        SELECT split, (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1)::INT AS pos, doc_id, bad FROM l""",
}
