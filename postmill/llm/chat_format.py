"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, its text alone is trainable. A conversation whose last turn is not an
assistant's gets one more example, all context, so that nothing is lost.

The template writes a turn as ``<s>[role]text</s>``. Inside roles and texts
the characters ``& < > [ ]`` are written as ``&amp; &lt; &gt; &#91; &#93;``,
so no text can hold a control string and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

ASSISTANT = "assistant"
# Characters of control strings and what stands for them; the first must be escaped first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;"), ("]", "&#93;")]


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_examples(conversations: DataFrame) -> DataFrame:
    """Training examples of ``conversations`` (conv_id, turn, role, text, ...).

    Returns conv_id, example (from 1), formatted, loss_start and loss_end
    (code points of ``formatted`` from 0; both null in an example that is all
    context) and last (whether it ends the conversation). Turns go by turn,
    equal turns by role and text, null turns first; null roles and texts are
    empty; repeated rows are turns of their own; other columns are ignored. A
    conversation is one row of arrays: its digest contract reads it in order.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == ASSISTANT).alias("trained"),
            F.concat(F.lit("<s>["), escape(t["role"]), F.lit("]")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    whole = whole.select("conv_id", pieces.alias("pieces"))
    ends = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.element_at("pieces", i)["trained"] | (i == F.size("pieces")))
    each = whole.select("conv_id", "pieces", F.posexplode(ends).alias("at", "upto"))
    text = F.array_join(
        F.transform(F.slice("pieces", F.lit(1), F.col("upto")), lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), ""
    )
    target = F.element_at("pieces", F.col("upto"))
    end = F.when(F.col("trained"), F.length("formatted") - 4)
    out = each.select("conv_id", (F.col("at") + 1).alias("example"), text.alias("formatted"), target["trained"].alias("trained"),
                      F.length(target["body"]).alias("size"), (F.col("upto") == F.size("pieces")).alias("last"))
    return out.select(
        "conv_id", "example", "formatted", (end - F.col("size")).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"), "last"
    )


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    parts = F.split(formatted, "</s>", -1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, 5, 1 << 30), "]", 1)).alias("role"),
            unescape(F.substring(p, F.locate("]", p) + 1, F.length(p))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the examples alone."""
    masked = unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    parsed = examples.select(
        "conv_id", "example", "last", F.coalesce(masked, F.lit("")).alias("loss"), F.length("formatted").alias("chars"),
        F.when(F.col("last"), parse_turns(F.col("formatted"))).alias("turns"),
    )
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    grouped = parsed.groupBy("conv_id").agg(loss.alias("loss"), F.max("turns").alias("turns"), F.sum("chars").alias("chars"))
    return grouped.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )


def format_and_read_back(conversations: DataFrame) -> DataFrame:
    """Write the examples to the shared folder and digest what is read from there."""
    return read_back(materialise(format_examples(conversations), "chat"))
