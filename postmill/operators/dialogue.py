"""Dialogues: documents, verdict alignment, question-answer rows and turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.ranges import prefix_sum

# Fixed value: the title of a conversation that has none.
UNTITLED = "未命名会话"
#: Requests that are numbered in one task at a time.
REQUEST_BUCKET = 100_000


class AlignmentError(ValueError):
    """Dialogues and verdicts do not line up."""


def dialogue_text(messages: DataFrame, key: str, order: str) -> DataFrame:
    """One ``role: text`` line per non-blank message, in order, as one text per key."""
    said = messages.where(F.coalesce(T.strip(F.col("text")), F.lit("")) != "")
    line = F.concat_ws(": ", "role", T.strip(F.col("text")))
    grouped = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("l"))
    return grouped.select(key, F.size("l").alias("n_turns"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("dialogue"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str], same: list[tuple[str, str]]) -> DataFrame:
    """Inner join that fails unless both sides have the same keys and agree in ``same``."""
    marked = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full_outer")
    wrong = F.col("__l").isNull() | F.col("__r").isNull()
    for a, b in same:
        wrong = wrong | ~F.col(a).eqNullSafe(F.col(b))
    n = marked.where(wrong).count()
    if n:
        raise AlignmentError(f"{n} rows do not line up")
    return marked.drop("__l", "__r")


def selected(rows: DataFrame, verdicts: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Rows with a verdict that is true; a null verdict is not."""
    return rows.join(verdicts.where(F.col(flag)), keys, "left_semi")


def qa_examples(dialogues: DataFrame) -> DataFrame:
    """Chat rows of dialogues (dialogue_id, QA array): one for each usable pair.

    Question and answer fall back to QASumm and the short answer before
    normalisation; ``qa_index`` is the place in the original array.
    """
    rows = dialogues.select("dialogue_id", F.posexplode("QA").alias("qa_index", "qa"))
    given = lambda *names: F.coalesce(*[F.nullif(F.col(f"qa.{n}"), F.lit("")) for n in names])
    question = T.collapse(F.coalesce(given("QueSumm", "QASumm"), F.lit("")))
    answer = T.collapse(F.coalesce(given("AnsSummLong", "AnsSummShort"), F.lit("")))
    intent = F.coalesce(T.collapse(F.col("qa.intent")), F.lit(""))
    rows = rows.select("dialogue_id", "qa_index", question.alias("question"), answer.alias("answer"), intent.alias("intent")).where("question <> '' AND answer <> ''")
    asked = F.when(F.col("intent") != "", F.concat("question", F.lit("\n意图："), "intent")).otherwise(F.col("question"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select("dialogue_id", "qa_index", F.array(turn("user", asked), turn("assistant", F.col("answer"))).alias("messages"))


def qa_pairs(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Every user message with the assistant message right after it."""
    at = Window.partitionBy(key).orderBy(order)
    following = messages.withColumn("next_role", F.lead("role").over(at)).withColumn("answer", F.lead("text").over(at))
    kept = following.where("role = 'user' AND next_role = 'assistant'")
    return kept.select(key, order, F.col("text").alias("question"), "answer")


def last_message(messages: DataFrame, role: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest message of a role in each conversation."""
    return messages.where(F.col("role") == role).groupBy(key).agg(F.max(F.struct(order, "text")).alias("m")).select(key, f"m.{order}", "m.text")


def recent_context(messages: DataFrame, size: int = 6, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``size`` messages, without system ones, which leave after the cut."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    cut = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= size).drop("__n")
    return cut.where("role <> 'system'")


def after(messages: DataFrame, at: Column, key: Column) -> DataFrame:
    """Messages strictly after a point in (created_at, id) order."""
    return messages.where(F.struct("created_at", "id") > F.struct(at.alias("created_at"), key.alias("id")))


def retry_last_turn(messages: DataFrame, tickets: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Replace each conversation's newest user message, drop what follows it and all its tickets."""
    last = messages.where("role = 'user'").groupBy("conversation_id").agg(F.max(F.struct("created_at", "id")).alias("last"))
    joined = messages.join(last, "conversation_id", "left")
    point = F.struct("created_at", "id")
    kept = joined.where(F.col("last").isNull() | (point <= F.col("last")))
    new = kept.withColumn("content", F.when(point == F.col("last"), F.lit(text)).otherwise(F.col("content"))).drop("last")
    return new, tickets.join(last, "conversation_id", "left_anti")


def with_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with their citations as an array, best score first; empty if none."""
    nested = citations.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("score", "document_id", "quoted_text")), False).alias("citations"))
    out = messages.join(nested, messages["id"] == nested["message_id"], "left").drop("message_id")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(nested.schema["citations"].dataType)))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """New target with the source's rows in place of equal keys, and counts of created and updated."""
    known = target.select(*keys).distinct().withColumn("__old", F.lit(True))
    counts = source.join(known, keys, "left").agg(F.count_if(F.col("__old").isNull()).alias("created"), F.count_if(F.col("__old")).alias("updated"))
    return target.join(source, keys, "left_anti").unionByName(source), counts


def first_intent(lists: Column) -> Column:
    """The first element of the first list that is not empty; null if all are."""
    return F.get(F.get(F.filter(lists, lambda x: F.size(x) > 0), F.lit(0)), F.lit(0))


def oldest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The oldest row of each key, as a conversation's first ticket; minima combine on the map side."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("r")).select(key, "r.*")


def titled_by_error(conversations: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Conversations (key, title) whose empty titles become the first 128 characters of their error (key, message)."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.substring("message", 1, 128))
    return conversations.join(errors.select(key, "message"), key, "left").withColumn("title", title).drop("message")


def conversation_writes(requests: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What chat requests (request_id, conversation_id, message) add: new conversations, and the users' messages.

    A request without a conversation (null or 0) makes one; new ids follow the
    highest there is, in the order of request_id. A request for a conversation
    that does not exist makes the query fail. ``request_id`` is a whole number.
    """
    highest = conversations.agg(F.max("conversation_id").alias("n")).first()["n"] or 0
    asked = requests.withColumn("__new", F.coalesce("conversation_id", F.lit(0)) == 0).withColumn("__one", F.col("__new").cast("int"))
    placed = prefix_sum(asked.withColumn("__bucket", F.floor(F.col("request_id") / REQUEST_BUCKET)), [], "__bucket", ["request_id"], "__one", "__before")
    known = conversations.select("conversation_id", F.lit(True).alias("__known")).distinct()
    placed = placed.join(known, "conversation_id", "left")
    missing = F.raise_error(F.concat(F.lit("no conversation "), F.col("conversation_id").cast("string"))).cast("long")
    ident = F.when(F.col("__new"), F.lit(highest) + F.col("__before") + 1).when(F.col("__known"), F.col("conversation_id")).otherwise(missing)
    rows = placed.withColumn("__id", ident)
    created = rows.where("__new").select(F.col("__id").alias("conversation_id"), F.lit("").alias("title"))
    return created, rows.select("request_id", F.col("__id").alias("conversation_id"), F.lit("user").alias("role"), F.col("message").alias("content"))


def with_error_rows(messages: DataFrame, errors: DataFrame) -> DataFrame:
    """Messages and, for each error (conversation_id, created_at, message), a system row that says it."""
    rows = errors.select("conversation_id", "created_at", F.lit("system").alias("role"), F.col("message").alias("content"), F.to_json(F.struct(F.lit("error").alias("kind"))).alias("metadata"))
    return messages.unionByName(rows, allowMissingColumns=True)


def made_title(question: Column, reply: Column) -> Column:
    """A conversation's title: the model's reply without quotes, cut at 20 characters, else the question's first 20, else the placeholder."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(F.coalesce(reply, F.lit(""))), r'^"+|"+\z', ""), r"^'+|'+\z", "")
    given = F.when(reply.isNull(), F.substring(F.coalesce(question, F.lit("")), 1, 20)).otherwise(F.substring(bare, 1, 20))
    return F.coalesce(F.nullif(given, F.lit("")), F.lit(UNTITLED))
