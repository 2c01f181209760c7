"""Documents for embedding, prompts and report values, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import collapse, strip

# Labels of the documents' lines.
COMPANY, TITLE, CATEGORIES, SUMMARY, EVIDENCE = "资料来源: ", "标题: ", "政策分类: ", "摘要: ", "证据原文: "
REQUIREMENTS, LIMIT, DEADLINE, EXCLUSIONS, LINK = "办理要求: ", "赔付上限: ", "理赔时限: ", "保价除外责任: ", "来源链接: "
DEFAULT_COMPANY = "中国邮政/EMS"
ANSWER_MARK, NO_ANSWER, NOTHING, YES, NO, LIST_MARK = "答案：", "（空）", "无", "是", "否", "、"


def as_text(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def as_list(values: Column) -> Column:
    """A list's non-blank elements, stripped; none for null."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), as_text), lambda v: v != "")


def one_line(text: Column) -> Column:
    return collapse(F.coalesce(text, F.lit("")))


def listed(values: Column) -> Column:
    """A list as report text."""
    return F.when(F.size(values) > 0, F.array_join(values, LIST_MARK)).otherwise(F.lit(NOTHING))


def flag(value: Column) -> Column:
    return F.when(value, F.lit(YES)).when(~value, F.lit(NO)).otherwise(F.lit(NOTHING))


def valued(value: Column) -> Column:
    return F.coalesce(F.nullif(as_text(value), F.lit("")), F.lit(NOTHING))


def three_places(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.3f", value))


def answer_part(summary: Column, evidence: Column) -> Column:
    """What follows the answer mark in the summary, or in the evidence where that is blank."""
    text = F.coalesce(*[F.nullif(as_text(c), F.lit("")) for c in (summary, evidence)])
    at = F.locate(ANSWER_MARK, text)
    after = strip(F.substring(text, at + len(ANSWER_MARK), F.length(text)))
    return F.when(text.isNull(), F.lit(NO_ANSWER)).when(at > 0, F.coalesce(F.nullif(after, F.lit("")), text)).otherwise(text)


def without_trailing_rules(text: Column) -> Column:
    """Text without the blank lines and horizontal rules at its end."""
    return F.regexp_replace(text, r"(?:(?:^|\n)[^\S\n]*(?:---|\*\*\*|___)?[^\S\n]*)*\z", "")


def policy_document(
    company: Column, title: Column, categories: Column, summary: Column, evidence: Column, requirements: Column, limit: Column, deadline: Column, exclusions: Column, url: Column
) -> Column:
    """A policy record as labelled lines; the later five only where they are given."""
    line = lambda label, value: F.concat(F.lit(label), value)
    given = lambda label, value: F.when(value != "", line(label, value))
    joined = lambda values: F.array_join(as_list(values), LIST_MARK)
    none = F.lit("")
    return F.concat_ws(
        "\n",
        line(COMPANY, F.coalesce(F.nullif(company, none), F.lit(DEFAULT_COMPANY))), line(TITLE, as_text(title)), line(CATEGORIES, joined(categories)),
        line(SUMMARY, as_text(summary)), line(EVIDENCE, as_text(evidence)),
        given(REQUIREMENTS, joined(requirements)), given(LIMIT, limit), given(DEADLINE, deadline), given(EXCLUSIONS, joined(exclusions)), given(LINK, as_text(url)),
    )


def dialogue_document(session: Column, dialogue: Column, qa: Column, turns: Column) -> Column:
    """A dialogue as text: ids, intents, summaries (``qa``: intent, summary) and turns (turn, from_user, utterance)."""
    given = lambda field: F.filter(F.transform(qa, lambda x: x[field]), lambda v: F.coalesce(v, F.lit("")) != "")
    said = F.transform(
        turns, lambda t: F.concat(F.when(t["from_user"], F.lit("用户[")).otherwise(F.lit("客服[")), t["turn"].cast("string"), F.lit("]: "), F.coalesce(t["utterance"], F.lit("")))
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("会话ID: "), session.cast("string")), F.concat(F.lit("对话ID: "), dialogue.cast("string")),
        F.concat(F.lit("业务意图: "), F.array_join(given("intent"), LIST_MARK)), F.lit("问答摘要:"), F.array_join(given("summary"), "\n"),
        F.lit("原始对话:"), F.array_join(said, "\n"),
    )


def embedding_query(query: Column, instruction: str) -> Column:
    """A query as embedding models with instructions take it; documents go as they are."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), query)


def rag_prompt(query: Column, hits: Column) -> Column:
    """A question and its citations (array of rank, score, content), by rank."""
    blocks = F.transform(F.array_sort(hits), lambda h: F.format_string("[引用%d score=%.4f]\n%s", h["rank"], h["score"], h["content"]))
    cited = F.coalesce(F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.lit(NOTHING))
    return F.concat(F.lit("用户问题:\n"), query, F.lit("\n\n可用引用对话:\n"), cited)


def chat(system: str, user: Column) -> Column:
    """A system and a user message, as model adapters take them."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user))


def rendered(messages: Column) -> Column:
    """Messages (role, content) as one prompt for a model without a template."""
    parts = F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), as_text(m["content"])))
    return F.array_join(F.concat(parts, F.array(F.lit("ASSISTANT:"))), "\n\n")
