"""Answer events as server-sent frames, and the reading of frames that arrive cut into chunks of any length.

A stream is a key with ordered chunk rows. Lines and records are found by
running totals over chunks, so one long stream is spread over tasks like many
short ones; only the pieces of one line, or the lines of one record, meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.ranges import prefix_sum

#: Rows of a stream that are summed in one task at a time.
BUCKET = 4096
#: Chunks of a stream that follow one another and are joined before they are cut into lines.
JOINED = 256
DONE = "[DONE]"


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def pieces(text: Column, size: int) -> Column:
    """A text cut into pieces of ``size`` characters, none for an empty one."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, (i - 1) * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def answer_events(answers: DataFrame, citations: DataFrame, size: int) -> DataFrame:
    """conversation_id, message_id, seq, event and data of each answer.

    ``answers`` has conversation_id, message_id, use_rag, use_sft, rag_profile,
    rag_top_k, answer and error; ``citations`` message_id, conversation_id, rank
    (from 1), score, source_key and quoted_text. The events are one ``meta``,
    a ``citation`` for each hit, a ``delta`` for every ``size`` characters of
    the answer, and ``done``, or ``error`` where the answer has one.
    """
    keys = ["conversation_id", "message_id"]
    hits = citations.groupBy(*keys).agg(F.count("*").alias("n_hits"))
    rows = answers.join(hits, keys, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))).withColumn("parts", pieces(F.coalesce("answer", F.lit("")), size))
    meta = json_of(**{c: F.col(c) for c in ("conversation_id", "use_rag", "use_sft", "rag_profile", "rag_top_k")})
    failed = F.col("error").isNotNull()
    end = F.when(failed, json_of(message=F.col("error"))).otherwise(json_of(**{c: F.col(c) for c in keys}))
    event = lambda seq, name, data: F.struct(seq.cast("long").alias("seq"), name.alias("event"), data.alias("data"))
    deltas = F.transform("parts", lambda p, i: event(i + 1 + F.col("n_hits"), F.lit("delta"), json_of(content=p)))
    last = event(F.size("parts") + 1 + F.col("n_hits"), F.when(failed, F.lit("error")).otherwise(F.lit("done")), end)
    own = rows.select(*keys, F.explode(F.concat(F.array(event(F.lit(0), F.lit("meta"), meta)), deltas, F.array(last))).alias("e")).select(*keys, "e.*")
    cited = citations.select(*keys, event(F.col("rank"), F.lit("citation"), json_of(**{c: F.col(c) for c in ("rank", "score", "source_key", "quoted_text")})).alias("e"))
    return own.unionByName(cited.select(*keys, "e.*"))


def completion_frames(answers: DataFrame, ident: str, text: str, model: str, size: int) -> DataFrame:
    """ident, seq and frame of answers as completion chunks: the role, the content in pieces, the stop and the end mark."""
    delta = lambda **fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    role, stop = delta(role=F.lit("assistant"), content=F.lit(None).cast("string")), delta(role=F.lit(None).cast("string"), content=F.lit(None).cast("string"))
    said = F.transform(pieces(F.coalesce(text, F.lit("")), size), lambda p: delta(role=F.lit(None).cast("string"), content=p))
    parts = F.concat(F.array(role), said, F.array(stop))
    rows = answers.select(ident, F.size(parts).alias("n"), F.posexplode(parts).alias("seq", "delta"))
    finish = F.when(F.col("seq") == F.col("n") - 1, F.lit("stop"))
    choice = F.concat(F.lit('[{"index":0,"delta":'), F.to_json("delta"), F.lit(',"finish_reason":'), F.coalesce(F.concat(F.lit('"'), finish, F.lit('"')), F.lit("null")), F.lit("}]"))
    body = F.concat(F.lit('data: {"id":"'), F.concat(F.lit("chatcmpl-"), F.col(ident).cast("string")), F.lit(f'","object":"chat.completion.chunk","model":"{model}","choices":'), choice, F.lit("}\n\n"))
    ends = answers.select(ident, (F.size(parts)).alias("seq"), F.lit(f"data: {DONE}\n\n").alias("frame"))
    return rows.select(ident, "seq", body.alias("frame")).unionByName(ends)


def encoded(events: DataFrame) -> DataFrame:
    """Events with their frame text."""
    return events.withColumn("frame", T.sse(F.col("event"), F.col("data")))


def cut(frames: DataFrame, key: str, order: list[str], size: int, frame: str = "frame") -> DataFrame:
    """The frames of each key, joined in order and cut into chunks of ``size`` characters: key, chunk, text.

    The first of ``order`` must be a number; it deals a key's frames into buckets.
    """
    sized = frames.select(key, *order, F.col(frame).alias("__frame"), F.length(frame).alias("__length"), F.floor(F.col(order[0]) / BUCKET).alias("__bucket"))
    placed = prefix_sum(sized, [key], "__bucket", order, "__length", "__start").where("__length > 0")
    first, last = F.floor(F.col("__start") / size), F.floor((F.col("__start") + F.col("__length") - 1) / size)
    spread = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("chunk") * size, F.col("__start"))
    end = F.least((F.col("chunk") + 1) * size, F.col("__start") + F.col("__length"))
    part = F.expr("substring(__frame, cast(__begin - __start + 1 as int), cast(__end - __begin as int))")
    parts = spread.withColumn("__begin", begin).withColumn("__end", end).select(key, "chunk", F.struct("__begin", part.alias("part")).alias("p"), (F.col("__end") - F.col("__begin") == size).alias("__full"))
    shared = parts.where("NOT __full").groupBy(key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("text"))
    return parts.where("__full").select(key, "chunk", F.col("p.part").alias("text")).unionByName(shared)  # a chunk inside one frame meets no other


def lines(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, line (from 0) and content of every ended line of chunked streams; LF or CRLF end a line.

    Runs of chunks are joined first, so that mostly whole lines are shuffled.
    """
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    runs = chunks.groupBy(key, F.floor(F.col(order) / JOINED).alias("__run")).agg(F.array_join(F.transform(in_order, lambda c: c["t"]), "").alias("__text"))
    rows = runs.select(key, "__run", F.split("__text", "\n", -1).alias("__parts"), F.floor(F.col("__run") / BUCKET).alias("__bucket")).withColumn("__ends", F.size("__parts") - 1)
    placed = prefix_sum(rows, [key], "__bucket", ["__run"], "__ends", "__line")
    parts = placed.select(key, "__run", "__line", "__ends", F.posexplode("__parts").alias("__i", "__part"))
    parts = parts.select(key, (F.col("__line") + F.col("__i")).alias("line"), F.struct("__run", F.col("__part").alias("part")).alias("p"), (F.col("__i") < F.col("__ends")).alias("ended"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    whole = parts.groupBy(key, "line").agg(joined.alias("content"), F.max("ended").alias("ended")).where("ended")
    return whole.select(key, "line", F.regexp_replace("content", r"\r\z", "").alias("content"))


def records(chunks: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """key, record (ascending), event and data of the frames in chunked streams.

    A blank line ends a record; a last one that it does not end is left out.
    The last ``event`` field names it (``message`` without one), ``data`` lines
    are joined by line feeds, one space after the colon and comment lines are
    dropped, and a record without data gives no row. Null chunks are empty.
    """
    found = lines(chunks, key, order, text).withColumn("__blank", (F.col("content") == "").cast("int")).withColumn("__bucket", F.floor(F.col("line") / BUCKET))
    numbered = prefix_sum(found, [key], "__bucket", ["line"], "__blank", "record")
    name = F.substring_index("content", ":", 1)
    value = F.when(F.instr("content", ":") > 0, F.regexp_replace("content", r"\A[^:]*: ?", "")).otherwise(F.lit(""))
    field = F.struct("line", name.alias("name"), value.alias("value"))
    grouped = numbered.groupBy(key, "record").agg(F.array_sort(F.collect_list(field)).alias("f"), F.max("__blank").alias("__ended")).where("__ended = 1")
    of = lambda n: F.transform(F.filter("f", lambda x: x["name"] == n), lambda x: x["value"])
    event = F.coalesce(F.nullif(F.element_at(F.concat(F.array(F.lit("")), of("event")), -1), F.lit("")), F.lit("message"))
    return grouped.where(F.size(of("data")) > 0).select(key, "record", event.alias("event"), F.array_join(of("data"), "\n").alias("data"))
