"""Map-reduce summaries of long texts: a tree of reductions, one written table a round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.frames import pieces
from postmill.session import materialise
from postmill.sources.adapters import generate

# Fixed value: what stands before each part that is merged.
PART_MARK = "【片段{}】\n"
BETWEEN = "\n\n"


def marked(parts: Column) -> Column:
    """Parts in order as one text, each below its number."""
    before, after = PART_MARK.split("{}")
    said = F.transform(parts, lambda p, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(after), p))
    return F.array_join(said, BETWEEN)


def summarised(
    texts: DataFrame, key: str, text: str, size: int, first: Callable[[Column], Column], merge: Callable[[Column], Column], model: Callable[[list[str]], list[str]], join: Callable[[Column], Column] = marked
) -> DataFrame:
    """key, summary and rounds of each text.

    A text is cut into pieces of ``size`` characters and each is answered by
    the ``model`` to the prompt ``first``. Then runs of answers that follow one
    another, as many as fit ``size`` by the longest answer and two at least, are
    joined and answered to the prompt ``merge``, until each text has one answer
    left; so a text of n pieces takes about log n rounds, and no task holds more
    than a run. A text of one piece is answered once; an empty or null one gives
    an empty summary without asking. A failed answer makes the query fail, since
    a summary without a part would be wrong. Keys must be unique.
    """
    def asked(rows: DataFrame, label: str) -> DataFrame:
        out = generate(rows, "__text", model)
        failed = F.raise_error(F.concat(F.lit("no summary: "), F.col("error"))).cast("string")
        answer = F.when(F.col("error").isNotNull(), failed).otherwise(F.coalesce("output", F.lit("")))
        return materialise(out.select("__key", "__at", "rounds", answer.alias("__text")), label)

    keyed = texts.select(F.col(key).alias("__key"), F.coalesce(text, F.lit("")).alias("__whole"))
    cut = keyed.select("__key", F.posexplode(pieces(F.col("__whole"), size)).alias("__at", "__piece"))
    rows = asked(cut.select("__key", F.col("__at").cast("long").alias("__at"), F.lit(1).alias("rounds"), first(F.col("__piece")).alias("__text")), "summary-pieces")
    done = None
    while True:
        counts = rows.groupBy("__key").agg(F.count("*").alias("__n"))
        single = rows.join(counts.where("__n = 1"), "__key").drop("__n")
        done = single if done is None else done.unionByName(single)
        open_rows = rows.join(counts.where("__n > 1"), "__key").drop("__n")
        longest = open_rows.agg(F.max(F.length("__text")).alias("m")).first()["m"]
        if longest is None:
            break
        fan = max(2, size // max(1, longest))
        runs = open_rows.groupBy("__key", F.floor(F.col("__at") / fan).alias("__run")).agg(F.array_sort(F.collect_list(F.struct("__at", "__text"))).alias("p"), F.max("rounds").alias("rounds"))
        parts = F.transform("p", lambda p: p["__text"])
        ready = runs.select("__key", F.col("__run").alias("__at"), (F.col("rounds") + 1).alias("rounds"), merge(join(parts)).alias("__text"))
        rows = asked(ready, "summary-round")
    empty = keyed.where("__whole = ''").select("__key", F.lit(0).alias("rounds"), F.lit("").alias("__text"))
    out = done.select("__key", "rounds", "__text").unionByName(empty)
    return out.select(F.col("__key").alias(key), F.col("__text").alias("summary"), "rounds")
