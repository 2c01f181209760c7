"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. A source's documents lie in shuffled order on a line of its
words, cut into equal blocks of at most ``BLOCK_WORDS`` words, ``LEAST_BLOCKS``
or more where it has as many words. Slot i takes the i-th golden-ratio point
in [0, 1); the point falls into one source's share of the cumulative numbers of
blocks that the targets need, and so gives the slot to that source. Any stretch
of slots thus holds the sources' words nearly at their weights. Slots are
ranked per source, and the r-th takes block r modulo the number of blocks. What
a source gets in all is its number of points times its block, within a few
blocks of its target; slots beyond ``MOST_REPEATS`` passes stay empty.

Everything is DataFrame code. Running totals go through buckets of a source,
so that a source with a large share of all rows is never in one task. Only
tables of one row a source are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators.ranges import prefix_sum
from postmill.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
BLOCK_WORDS = 8192
LEAST_BLOCKS = 1024
BUCKET_ROWS = 4096
CELLS = 4096
GOLDEN_RATIO = 0.6180339887498949
#: Slots of one bucket of a source's ranks; ids are split there, for points of full precision.
STRETCH = 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, n_rows, source_size and target of every source of (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
    share all words by weight; no target exceeds ``MOST_REPEATS`` times the
    source's size, and the excess is shared again by weight. The sources that
    stop there are those with the least room for their weight, so one ordered
    running total finds them. One row per source is all that meets here.
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    weighed = weighed.withColumn("most", (F.col("source_size") * MOST_REPEATS).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    stops = weighed.withColumn("level", level).withColumn("stopped", F.col("most") <= F.col("level") * F.col("weight"))
    share = F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything)
    first = F.min(F.when(~F.col("stopped"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("stopped"), F.col("most")).otherwise(F.coalesce(first, share) * F.col("weight"))
    return stops.select("source", "n_rows", "source_size", target.alias("target"))


def golden_point(slot: Column) -> Column:
    """The fractional part of (slot + 1) times the golden ratio."""
    high, low = F.floor((slot + 1) / STRETCH), F.pmod(slot + 1, F.lit(STRETCH))
    return F.pmod(high * F.lit(GOLDEN_RATIO * STRETCH % 1.0) + low * F.lit(GOLDEN_RATIO), F.lit(1.0))


def block_count(source_size: Column) -> Column:
    """Equal blocks of a source's words."""
    return F.greatest(F.ceil(source_size / BLOCK_WORDS), F.least(source_size, F.lit(LEAST_BLOCKS))).cast("long")


def block_start(block: Column, source_size: Column, blocks: Column) -> Column:
    """The first word of a block; the block after the last one starts at the source's end."""
    return F.floor(block * source_size / blocks).cast("long")


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """The slots of the mix that take a block: slot (its position, from 0), source and block."""
    need = targets.where("target > 0").select("source", "target", "source_size", block_count(F.col("source_size")).alias("blocks"))
    need = need.withColumn("wanted", F.col("target") * F.col("blocks") / F.col("source_size"))
    total = need.agg(F.round(F.coalesce(F.sum("wanted"), F.lit(0.0))).cast("long").alias("n")).first()["n"]
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_of = F.sum("wanted").over(Window.partitionBy(F.lit(0)))
    upto = F.sum("wanted").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / all_of
    shares = need.withColumn("high", upto).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    cells = shares.select(
        "source", "blocks", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)).cast("int"))).alias("cell"),
    )
    points = spark.range(total).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    hits = points.join(cells, "cell").where("point >= low AND point < high").select("source", "slot", "blocks")
    hits = hits.withColumn("stretch", F.floor(F.col("slot") / STRETCH)).withColumn("one", F.lit(1))
    ranked = prefix_sum(hits, ["source"], "stretch", ["slot"], "one", "rank").where(F.col("rank") < MOST_REPEATS * F.col("blocks"))
    return ranked.select("slot", "source", F.pmod("rank", "blocks").alias("block"))


def mixed_rows(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, ...) with what the mix takes of it.

    Returns doc_id, source, size, source_size, target, taken, line, slots and
    any further ``columns``. ``taken`` counts words, repeats counted, and never
    exceeds ``MOST_REPEATS`` times the size; ``line`` is the row's place on its
    source's line, and ``slots`` holds the positions, at most as many as the
    repeats, of the slots that take its middle word. Rows with a null or
    wordless text have size 0, take 0 and have no slots; a null source is a
    source; equal rows are rows of their own, shuffled by a hash of doc_id,
    source and size; reruns agree. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    extra = [F.col(c).alias(f"__c{i}") for i, c in enumerate(columns or [])]
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra)
    sized = materialise(sized, "sizes")
    targets = materialise(source_targets(sized), "targets")
    slots = schedule(spark, targets).groupBy(F.col("source").alias("__s"), F.col("block").alias("__b"))
    slots = materialise(slots.agg(F.count("*").alias("passes"), F.sort_array(F.collect_list("slot")).alias("slots")), "slots")
    keyed = targets.withColumnRenamed("source", "__source").withColumn("blocks", block_count(F.col("source_size")))
    rows = sized.join(keyed, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    at = F.xxhash64("doc_id", "source", "size")
    rows = rows.withColumn("at", at).withColumn("bucket", F.pmod(F.shiftright("at", 20), F.ceil(F.col("n_rows") / BUCKET_ROWS)))
    order = ["at", "doc_id", "size", *[f"__c{i}" for i in range(len(extra))]]
    lined = prefix_sum(rows, ["source"], "bucket", order, "size", "line")
    held = lined.where("size > 0")
    # The block of word w is the last that starts at w or before.
    block_of = lambda w: F.floor(((w + 1) * F.col("blocks") - 1) / F.col("source_size")).cast("long")
    spans = held.withColumn("block", F.explode(F.sequence(block_of(F.col("line")), block_of(F.col("line") + F.col("size") - 1))))
    met = spans.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left")
    low = F.greatest(F.col("line"), block_start(F.col("block"), F.col("source_size"), F.col("blocks")))
    high = F.least(F.col("line") + F.col("size"), block_start(F.col("block") + 1, F.col("source_size"), F.col("blocks")))
    middle = block_of(F.col("line") + F.floor(F.col("size") / 2))
    met = met.withColumn("part", (high - low) * F.coalesce("passes", F.lit(0))).withColumn("mid", F.when(F.col("block") == middle, F.col("slots")))
    keep = ["doc_id", "source", "size", "source_size", "target", "line", *[f"__c{i}" for i in range(len(extra))]]
    taken = met.groupBy(*keep).agg(F.sum("part").cast("long").alias("taken"), F.max("mid").alias("slots"))
    empty = lined.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slots": F.lit(None).cast("array<bigint>")})
    out = taken.unionByName(empty.select(*taken.columns)).withColumn("slots", F.coalesce("slots", F.array().cast("array<bigint>")))
    return out.withColumnsRenamed({f"__c{i}": c for i, c in enumerate(columns or [])})


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; see :func:`mixed_rows`."""
    return mixed_rows(docs).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents in the order of the mix: each row of ``docs``, all columns, as often as the mix takes it.

    A row stands at every slot that takes its middle word, rows of one slot in
    the order of their source's line. Rows are matched by doc_id, source and
    size; rows with an equal triple share their slots, the texts in order.
    Rows without a word are not part of a mix of words and leave.
    """
    places = F.transform("slots", lambda slot: F.struct(slot.alias("slot"), F.col("line").alias("line")))
    share = mixed_rows(docs).where("size > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__w"), places.alias("places"))
    share = share.groupBy("__d", "__s", "__w").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("__at"), F.count("*").alias("__n")).where(F.size("__at") > 0)
    tagged = docs.withColumn("__size", word_count(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__w"))
    met = tagged.join(share, on)
    single = met.where("__n = 1").withColumn("__mine", F.col("__at"))
    twins = Window.partitionBy("__d", "__s", "__w").orderBy("text")
    tied = met.where("__n > 1").withColumn("__i", F.row_number().over(twins) - 1)
    tied = tied.withColumn("__mine", F.expr("filter(__at, (x, k) -> k % __n = __i)")).drop("__i")
    placed = single.unionByName(tied).select(*[F.col(c) for c in docs.columns], F.explode("__mine").alias("__place"))
    return placed.orderBy("__place").select(*docs.columns)
