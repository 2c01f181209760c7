"""Counts, profiles and summaries that reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import prompts as P
from postmill.functions import text as T
from postmill.functions.prompts import one_line
from postmill.operators.ranges import prefix_sum


def first_seen_counts(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Rows of each value, null as '', with the place ``first`` where it first occurs."""
    return rows.groupBy(F.coalesce(column, F.lit("")).alias(column)).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def field_profile(rows: DataFrame, order: str) -> DataFrame:
    """Place, name and kind of the first row's fields; nothing for no rows."""
    kinds = {"string": "str", "boolean": "bool", "double": "float", "float": "float"}

    def kind(name: str, of: str) -> Column:
        known = "list" if of.startswith("array") else "dict" if of.startswith(("struct", "map")) else kinds.get(of, "int")
        return F.struct(F.lit(name).alias("field"), F.when(F.col(name).isNull(), F.lit("NoneType")).otherwise(F.lit(known)).alias("kind"))

    first = rows.orderBy(order).limit(1)
    return first.select(F.posexplode(F.array(*[kind(n, t) for n, t in rows.dtypes])).alias("place", "f")).select("place", "f.field", "f.kind")


def candidate_metrics(results: DataFrame, k: int) -> DataFrame:
    """One row of rates over items of ``k`` candidates each; an error if there is no item.

    ``results`` has source_file, success_count, json_valid, required_ok,
    risk_hits, choice_correct (null without a choice), candidate_ms and
    agent_ms.
    """
    share = lambda test: F.avg(F.coalesce(test.cast("double"), F.lit(0.0)))
    out = results.agg(
        F.count("*").alias("sample_count"), F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.avg(F.col("success_count") / k).alias("success_rate"), share(F.col("json_valid")).alias("json_valid_rate"),
        share(F.col("required_ok")).alias("required_fields_rate"), share(F.col("risk_hits") > 0).alias("risk_rate"),
        F.count("choice_correct").alias("choice_case_count"), F.avg(F.col("choice_correct").cast("double")).alias("choice_accuracy"),
        F.round(F.avg("candidate_ms"), 2).alias("avg_candidate_ms"), F.round(F.avg("agent_ms"), 2).alias("avg_agent_ms"),
    )
    counted = F.when(F.col("sample_count") > 0, F.col("sample_count")).otherwise(F.raise_error(F.lit("no results to summarise")).cast("long"))
    return out.withColumn("sample_count", counted).withColumn("request_count", F.col("sample_count") * k)


def loss_metrics(logs: DataFrame) -> DataFrame:
    """run, the last training and validation loss of its log (run, text) and the perplexity."""
    last = lambda name: F.try_element_at(F.regexp_extract_all("text", F.lit(rf"{name} loss ([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).cast("double")
    found = logs.select("run", last("Train").alias("train_loss"), last("Val").alias("val_loss"))
    return found.withColumn("val_perplexity", F.exp("val_loss"))


def status_counts(rows: DataFrame, statuses: list[str], key: str = "status") -> DataFrame:
    """One row with a count for each of the statuses."""
    return rows.agg(*[F.count_if(F.col(key) == s).alias(s) for s in statuses])


def best_adapter(adapters: DataFrame, existing: DataFrame, rank: int | None = None) -> DataFrame:
    """The adapter (rank, score, path) with the highest score whose path exists; the least rank on ties."""
    there = adapters.join(existing.select("path").distinct(), "path", "left_semi").where("score IS NOT NULL")
    there = there if rank is None else there.where(F.col("rank") == rank)
    return there.orderBy(F.desc("score"), "rank", "path").limit(1)


def newest_citation(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """conv_id and its newest citation; messages (message_id, conv_id), citations (message_id, created_at, id, ...)."""
    fields = [c for c in citations.columns if c != "message_id"]
    joined = citations.join(messages.select("message_id", "conv_id"), "message_id")
    newest = joined.groupBy("conv_id").agg(F.max_by(F.struct(*fields), F.struct("created_at", "id")).alias("c"))
    return newest.select("conv_id", "c.*")


def conversation_page(conversations: DataFrame, size: int = 30) -> DataFrame:
    """The first page of conversations (conv_id, pinned, updated_at): pinned ones first, then the newest."""
    return conversations.orderBy(F.desc("pinned"), F.desc("updated_at"), F.desc("conv_id")).limit(size)


def identity_examples(records: DataFrame, system: str) -> DataFrame:
    """Chat examples of records (ord, messages, question, prompt, user, answer, response, assistant).

    A record with messages is taken as it is; others need a question and an
    answer under one of their names, the first that is not empty.
    """
    either = lambda *names: one_line(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked, answered = either("question", "prompt", "user"), either("answer", "response", "assistant")
    whole = records.where("size(messages) > 0").select("ord", "messages")
    pairs = records.where(F.col("messages").isNull() & (asked != "") & (answered != ""))
    built = F.array(message("system", F.lit(system)), message("user", asked), message("assistant", answered))
    return whole.unionByName(pairs.select("ord", built.alias("messages")))


def most_common(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, n and place (from 1) of every value: the most frequent first, then the one that appears first. Counts combine on the map side."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "__first", key))  # one row a value
    return counted.select(key, "n", place.alias("place"))


# The source that is shown as question and answer, and the words of a sample's block.
ASKED_SOURCE = "ems_policy_network"
BLOCK_ROWS = [("来源标识", "source_id", True), ("公司字段", "company", False), ("类别", "policy_categories", False), ("是否涉及保险", "insurance_available", False), ("标题", "title", False), ("定位", "locator", True)]
SAMPLE, TABLE_HEAD, QUESTION, ANSWER, ORIGINAL = "### 样本 {}：", ["| 字段 | 内容 |", "|---|---|"], "问题：", "答案：", "原文："


def originals(samples: DataFrame, sections: DataFrame) -> DataFrame:
    """Samples with ``original``: the body of their section, quoted, else their evidence on one line.

    ``samples`` has locator (file#anchor), title and evidence_text, ``sections``
    file, first_line, title and body (lines). The first section of the file
    with the title counts, without the blank lines and rules at its end; an
    empty body counts as none.
    """
    first = sections.groupBy("file", T.strip(F.col("title")).alias("__title")).agg(F.min_by("body", "first_line").alias("__body"))
    body = T.strip(P.without_trailing_rules(F.array_join("__body", "\n")))
    quoted = F.nullif(F.array_join(F.transform(F.split(body, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n"), F.lit("> "))
    evidence = F.concat(F.lit("> "), P.one_line(F.col("evidence_text")))
    at = samples.withColumn("__file", F.when(F.contains("locator", F.lit("#")), F.substring_index("locator", "#", 1))).withColumn("__wanted", T.strip(F.coalesce("title", F.lit(""))))
    met = at.join(first.withColumnRenamed("file", "__section_file"), (F.col("__file") == F.col("__section_file")) & (F.col("__wanted") == F.col("__title")), "left")
    return met.withColumn("original", F.coalesce(quoted, evidence)).drop("__file", "__wanted", "__section_file", "__title", "__body")


def sample_blocks(samples: DataFrame, order: str) -> DataFrame:
    """order and the report's block of every sample with its original, numbered from 1 in that order."""
    numbered = prefix_sum(samples.withColumn("__one", F.lit(1)).withColumn("__bucket", F.floor(F.col(order) / 4096)), [], "__bucket", [order], "__one", "__before")
    shown = {"policy_categories": P.listed(P.as_list(F.col("policy_categories"))), "insurance_available": P.flag(F.col("insurance_available"))}
    cell = lambda name, code: F.concat(F.lit("`"), value(name), F.lit("`")) if code else value(name)
    value = lambda name: shown.get(name, P.valued(F.col(name)))
    rows = [F.concat(F.lit(f"| {label} | "), cell(name, code), F.lit(" |")) for label, name, code in BLOCK_ROWS]
    before, after = SAMPLE.split("{}")
    head = [F.concat(F.lit(before), (F.col("__before") + 1).cast("string"), F.lit(after), value("title")), F.lit(""), *map(F.lit, TABLE_HEAD), *rows, F.lit("")]
    quote = lambda text: F.concat(F.lit("> "), text)
    asked = [F.lit(QUESTION), F.lit(""), quote(P.one_line(F.col("title"))), F.lit(""), F.lit(ANSWER), F.lit(""), quote(P.one_line(P.answer_part(F.col("summary"), F.col("evidence_text")))), F.lit("")]
    shown_text = [F.lit(ORIGINAL), F.lit(""), F.col("original"), F.lit("")]
    block = F.when(F.col("source_id") == ASKED_SOURCE, F.concat_ws("\n", *head, *asked)).otherwise(F.concat_ws("\n", *head, *shown_text))
    return numbered.select(order, block.alias("block"))
