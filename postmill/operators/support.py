"""Question routes and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.functions.lexicon import Lexicon

# Routes with their number of passages, ticket labels and fields.
ROUTES = {"DIRECT": ("direct", 0), "LIGHT_RAG": ("light", 3), "STRONG_RAG": ("strong", 6)}
SERVICE, ISSUE, LARGE = "邮政客服", "邮政业务咨询", "大件寄递咨询"
ISSUES = {"shipping": "寄递咨询", "large item shipping": "大件寄递咨询", "delivery": "配送咨询", "tracking": "物流查询", "refund": "退款咨询"}
REQUEST_TEXT, SUMMARY_TEXT = "用户咨询邮政业务办理。", "已根据当前对话整理用户诉求和客服处理过程。"
TICKET_FIELDS = ["user_id", "timestamp", "service_type", "issue_type", "user_request", "summary", "resolution", "need_follow_up"]


def route(message: Column, lexicon: Lexicon) -> Column:
    """DIRECT before STRONG_RAG before LIGHT_RAG."""
    said = F.coalesce(message, F.lit(""))
    return F.when(T.has_any(said, lexicon.direct), F.lit("DIRECT")).when(T.has_any(said, lexicon.strong), F.lit("STRONG_RAG")).otherwise(F.lit("LIGHT_RAG"))


def route_profile(name: Column) -> Column:
    """Profile and number of passages of a route; an unknown one is strong."""
    clean = F.upper(T.strip(F.coalesce(name, F.lit(""))))
    out = None
    for key, (profile, k) in ROUTES.items():
        value = F.struct(F.lit(profile).alias("profile"), F.lit(k).alias("k"))
        out = F.when(clean == key, value) if out is None else out.when(clean == key, value)
    return out.otherwise(F.struct(F.lit("strong").alias("profile"), F.lit(6).alias("k")))


def service_type(value: Column) -> Column:
    text = T.strip(F.coalesce(value, F.lit("")))
    return F.when((text == "") | T.looks_english(text), F.lit(SERVICE)).otherwise(text)


def issue_type(value: Column) -> Column:
    text = T.strip(F.coalesce(value, F.lit("")))
    low = F.lower(text)
    out = F.when(text == "", F.lit(""))
    for english, label in ISSUES.items():
        out = out.when(low == english, F.lit(label))
    return out.when(F.contains(low, F.lit("large")) & F.contains(low, F.lit("shipping")), F.lit(LARGE)).when(T.looks_english(text), F.lit(ISSUE)).otherwise(text)


def chinese_or(value: Column, fallback: str) -> Column:
    text = T.strip(F.coalesce(value, F.lit("")))
    return F.when((text != "") & ~T.looks_english(text), text).otherwise(F.lit(fallback))


def rule_tickets(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Fallback tickets: the user's words cut at 120, the last answer at 180 characters."""
    user = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct(order, "text")))), lambda x: x["text"]), "\n")
    last = F.max(F.when(F.col("role") == "assistant", F.struct(order, "text")))["text"]
    grouped = messages.groupBy(key).agg(user.alias("asked"), last.alias("answered"))
    return grouped.select(
        key,
        F.concat(F.lit("conversation:"), F.col(key).cast("string")).alias("user_id"),
        F.lit(SERVICE).alias("service_type"),
        chinese_or(T.compact(F.col("asked"), 120), REQUEST_TEXT).alias("user_request"),
        chinese_or(T.compact(F.coalesce("answered", F.lit("")), 180), SUMMARY_TEXT).alias("summary"),
        F.lit(False).alias("need_follow_up"),
    )


def parse_tickets(rows: DataFrame, output: str = "output") -> DataFrame:
    """Tickets of model outputs, with ``error`` where one is not acceptable.

    A code fence is taken off; the rest must be a JSON object with no unknown
    key and with a timestamp. English texts become the stock phrases.
    """
    text = T.code_fence(F.coalesce(output, F.lit("")))
    parsed = rows.withColumn("__json", F.when(F.try_parse_json(text).isNotNull(), text)).withColumn("__keys", F.json_object_keys("__json"))
    schema = ", ".join(f"{f} {'boolean' if f == 'need_follow_up' else 'string'}" for f in TICKET_FIELDS)
    parsed = parsed.withColumn("t", F.from_json("__json", schema))
    error = (
        F.when(F.col("__keys").isNull(), F.lit("not a JSON object"))
        .when(F.size(F.array_except("__keys", F.array(*map(F.lit, TICKET_FIELDS)))) > 0, F.lit("unknown field"))
        .when(F.col("t.timestamp").isNull(), F.lit("timestamp is missing"))
    )
    ticket = F.struct(
        F.coalesce("t.user_id", F.lit("")).alias("user_id"), F.col("t.timestamp").alias("timestamp"),
        service_type(F.col("t.service_type")).alias("service_type"), issue_type(F.col("t.issue_type")).alias("issue_type"),
        chinese_or(F.col("t.user_request"), REQUEST_TEXT).alias("user_request"), chinese_or(F.col("t.summary"), SUMMARY_TEXT).alias("summary"),
        chinese_or(F.col("t.resolution"), "").alias("resolution"), F.coalesce("t.need_follow_up", F.lit(False)).alias("need_follow_up"),
    )
    out = parsed.withColumn("error", error)
    return out.withColumn("ticket", F.when(F.col("error").isNull(), ticket)).drop("__json", "__keys", "t")


def with_issue(tickets: DataFrame, citations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Tickets with ``issue_type`` from the first intent of the conversation's newest citation (key, created_at, id, intents); '' without one."""
    newest = citations.groupBy(key).agg(F.max_by("intents", F.struct("created_at", "id")).alias("__intents"))
    first = issue_type(F.coalesce(F.get("__intents", F.lit(0)), F.lit("")))
    return tickets.join(newest, key, "left").withColumn("issue_type", first).drop("__intents")


def ticket_json(ticket: Column) -> Column:
    """A ticket as indented JSON text."""
    return F.to_json(ticket, {"pretty": "true", "ignoreNullFields": "false"})


def model_choice(tuned: Column, default: Column, other: Column) -> Column:
    """Provider and model (structs of both) by the switch; a tuned one that is not named is an error."""
    missing = F.coalesce(F.nullif(other["provider"], F.lit("")), F.lit("")).eqNullSafe("") | F.coalesce(F.nullif(other["model"], F.lit("")), F.lit("")).eqNullSafe("")
    named = F.when(missing, F.raise_error(F.lit("there is no tuned model")).cast("struct<provider:string,model:string>")).otherwise(other)
    return F.when(tuned, named).otherwise(default)


def model_metadata(tuned: Column, default: Column, other: Column) -> Column:
    """The same pair for a message's metadata: both empty where the tuned model is not named."""
    whole = (F.coalesce(other["provider"], F.lit("")) != "") & (F.coalesce(other["model"], F.lit("")) != "")
    nothing = F.struct(F.lit("").alias("provider"), F.lit("").alias("model"))
    return F.when(~tuned, default).when(whole, other).otherwise(nothing)
