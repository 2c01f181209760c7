"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (its lines, cut further after sentences, and every
``PIECE`` characters where that leaves long ones; each counts once) are hashed to 64-bit digests. A sketch has three tables of cells; a digest
goes to one cell of each, which keeps a count, the xor of digests and the xor
of their check hashes; empty cells are not stored. Sketches of two versions
subtract cell by cell, which cancels all common paragraphs; peeling then takes
digests out of cells that hold a single one until no cell is left, and so
recovers the paragraphs that only one version has. If cells remain, both
sketches are made again at twice the size. After ``ATTEMPTS`` sizes the
digests are compared as sets, which gives the same answer.

Everything is DataFrame code on one row's arrays: cells are sorted and folded,
so the work grows with the number of paragraphs times its logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import let
from postmill.operators.ranges import range_bounds, range_bucket
from postmill.session import materialise

TABLES = 3
ATTEMPTS = 6
ROUNDS = 24
LEAST_WIDTH = 4
#: Longest uncut stretch of a paragraph without a break, and the pieces of a longer one.
STRETCH, PIECE = 480, 240
#: Ranges of ids for each shuffle partition, so that ranges that meet in one make little difference.
RANGES = 6
#: Bits of a digest that give its place in a table.
PLACE_BITS = 21
#: Where paragraphs end.
BREAKS = r"[\n\r]+|(?<=[.!?])[ \t]+|(?<=[。！？؟।])"


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's non-blank paragraphs, ascending; none for null."""
    lines = F.split(F.coalesce(text, F.lit("")), BREAKS)
    cut = F.transform(lines, lambda x: F.when(F.length(x) > STRETCH, F.regexp_extract_all(x, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array(x)))
    worded = F.filter(F.flatten(cut), lambda x: F.trim(x) != "")
    return F.sort_array(F.array_distinct(F.transform(worded, lambda x: F.xxhash64(F.trim(x)))))


def table_width(n: Column) -> Column:
    """Cells of one table for ``n`` digests: a power of two, as many at least, so that few rounds peel them."""
    return F.greatest(F.lit(LEAST_WIDTH), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int"))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def cells_of(digest: Column, n: Column, width: Column) -> Column:
    """A digest's three cells (c, n, d, h): each table takes other bits of the digest for the place."""
    mask = (width - 1).cast("long")
    place = lambda t: F.shiftright(digest, PLACE_BITS * t).bitwiseAND(mask).cast("int") + width * t
    return let(check_of(digest), lambda h: F.array(*[F.struct(place(t).alias("c"), n.alias("n"), digest.alias("d"), h.alias("h")) for t in range(TABLES)]))


def fold(cells: Column) -> Column:
    """Cells with equal numbers as one, ascending; cells that come to nothing are left out."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("h"))

    def add(at: Column, x: Column) -> Column:
        return F.struct(x["c"].alias("c"), (at["n"] + x["n"]).alias("n"), at["d"].bitwiseXOR(x["d"]).alias("d"), at["h"].bitwiseXOR(x["h"]).alias("h"))

    def merged(ordered: Column) -> Column:
        opens = lambda x, i: F.when((i == 0) | (x["c"] != F.get(ordered, i - 1)["c"]), i)
        one = lambda start, end: F.when(end - start == 1, F.get(ordered, start)).otherwise(F.aggregate(F.slice(ordered, start + 1, end - start), zero, add))
        starts = F.array_compact(F.transform(ordered, opens))
        runs = let(starts, lambda at: F.transform(at, lambda i, k: one(i, F.coalesce(F.get(at, k + 1), F.size(ordered)))))
        return F.filter(runs, lambda c: (c["n"] != 0) | (c["d"] != 0) | (c["h"] != 0))

    none = F.array().cast("array<struct<c:int,n:int,d:bigint,h:bigint>>")
    return let(F.sort_array(cells), lambda ordered: F.when(F.size(ordered) > 0, merged(ordered)).otherwise(none))


def signed_cells(digests: Column, sign: int, width: Column) -> Column:
    """The cells of all digests, not yet folded, with the count ``sign``."""
    return F.flatten(F.transform(digests, lambda d: cells_of(d, F.lit(sign), width)))


def sketch(digests: Column, width: Column) -> Column:
    """Filled cells of a set of digests."""
    return fold(signed_cells(digests, 1, width))


def subtracted(a: Column, b: Column, width: Column) -> Column:
    """Cell by cell, the sketch of ``a`` less that of ``b``."""
    return fold(F.concat(signed_cells(a, 1, width), signed_cells(b, -1, width)))


def peel(cells: Column, width: Column) -> Column:
    """(more, less, done): numbers of digests with positive and negative count, and whether no cell is left."""
    state = F.struct(cells.alias("cells"), F.lit(0).alias("more"), F.lit(0).alias("less"), F.lit(True).alias("live"))

    def turn(acc: Column, _: Column) -> Column:
        single = F.filter(acc["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["h"] == check_of(c["d"])))
        of = lambda cells, n: F.array_distinct(F.transform(F.filter(cells, lambda c: c["n"] == n), lambda c: c["d"]))
        found = let(single, lambda cells: F.struct(of(cells, 1).alias("more"), of(cells, -1).alias("less")))

        def take(x: Column) -> Column:
            left = F.concat(acc["cells"], signed_cells(x["more"], -1, width), signed_cells(x["less"], 1, width))
            more, less = F.size(x["more"]), F.size(x["less"])
            return F.struct(
                F.when(more + less > 0, fold(left)).otherwise(acc["cells"]).alias("cells"), (acc["more"] + more).alias("more"),
                (acc["less"] + less).alias("less"), (more + less > 0).alias("live"),
            )

        return F.when(acc["live"] & (F.size(acc["cells"]) > 0), let(found, take)).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn,
        lambda acc: F.struct(acc["more"].alias("more"), acc["less"].alias("less"), (F.size(acc["cells"]) == 0).alias("done")),
    )


def difference(a: Column, b: Column) -> Column:
    """(more, less): numbers of digests that only ``a`` or only ``b`` holds, by peeling."""
    start = table_width(F.size(a) + F.size(b))
    init = F.struct(F.lit(0).alias("more"), F.lit(0).alias("less"), F.lit(False).alias("done"))

    def attempt(acc: Column, k: Column) -> Column:
        again = let(
            (start * F.pow(F.lit(2), k)).cast("int"),
            lambda width: peel(subtracted(a, b, width), width),
        )
        return F.when(acc["done"], acc).otherwise(again)

    exact = F.struct(F.size(F.array_except(a, b)).alias("more"), F.size(F.array_except(b, a)).alias("less"), F.lit(True).alias("done"))
    return let(
        F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), init, attempt), lambda got: F.when(got["done"], got).otherwise(exact)
    )


def likeness(a: Column, b: Column) -> Column:
    """Common share of two texts' paragraphs, from the peeled difference; 1 for two empty ones."""
    return let(
        difference(a, b),
        lambda d: F.when(F.size(a) + d["less"] == 0, F.lit(1.0)).otherwise((F.size(a) - d["more"]) / (F.size(a) + d["less"])),
    )


def fingerprint(digests: Column) -> Column:
    """A sketch as text: width, number of paragraphs and the filled cells in hexadecimal."""
    show = lambda c: F.concat_ws(".", F.hex(c["c"]), F.hex(c["n"]), F.hex(c["d"]), F.hex(c["h"]))
    return let(
        table_width(F.size(digests)),
        lambda width: F.concat_ws(
            ":", width.cast("string"), F.size(digests).cast("string"), F.array_join(F.transform(sketch(digests, width), show), ",")
        ),
    )


def with_next(docs: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Add ``next_`` + c for each of ``columns``: those of the following row by ``order``, the first row's after the last.

    ``order`` begins with an integer column. Rows are dealt into ranges of it;
    every range also gets the first row of the next one, and a window inside
    the range finds the following row.
    """
    spark = docs.sparkSession
    lead = order[0]
    bounds = range_bounds(docs, lead, RANGES * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    dealt = docs.withColumn("__range", range_bucket(F.col(lead), bounds)).withColumn("__guest", F.lit(0))
    firsts = dealt.groupBy("__range").agg(F.min(F.struct(*order, *[F.col(c).alias(f"__v{i}") for i, c in enumerate(docs.columns)])).alias("f"))
    firsts = materialise(firsts, "firsts")
    ids = sorted(r["__range"] for r in firsts.select("__range").collect())
    before = {r: ids[i - 1] for i, r in enumerate(ids)}
    host = F.create_map(*[F.lit(x) for r, b in before.items() for x in (r, b)])[F.col("__range")] if ids else F.col("__range")
    guests = firsts.select(*[F.col(f"f.__v{i}").alias(c) for i, c in enumerate(docs.columns)], host.alias("__range"), F.lit(1).alias("__guest"))
    inside = Window.partitionBy("__range").orderBy("__guest", *order)
    following = dealt.unionByName(guests).withColumn("__next", F.lead(F.struct(*columns)).over(inside)).where("__guest = 0")
    return following.select(*docs.columns, *[F.col("__next")[c].alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text, ...), its edited text and its successor.

    The edited text has its last floor(n / 2) code points replaced by the
    first as many, or all, of the next row's text (ascending doc_id, nulls
    first, equal ids by text; the first row follows the last). Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text is empty; texts without paragraphs
    are alike; repeated rows follow each other; other columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("parts", paragraph_digests(F.col("text")))
    joined = with_next(base, ["text", "parts"], ["doc_id", "text"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    joined = joined.select("doc_id", F.length("text").cast("long").alias("n_chars"), "parts", "next_parts", edited.alias("edited"))
    joined = joined.select("doc_id", "n_chars", "parts", "next_parts", F.sha2("edited", 256).alias("edited_sha256"), paragraph_digests(F.col("edited")).alias("edited_parts"))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("parts")).alias("fingerprint"),
        fingerprint(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
