"""Benchmark decontamination by canonical templates.

A text becomes a row of template tokens, its runs of letters and digits.
Capitalised words turn into a name placeholder, numbers, in digits or as words
and with or without a unit, into a number's, and a run of either into one; other
words stay. Sentence openers are capitalised too, so they count as names wherever
they stand.
Windows of ``WINDOW`` tokens of the benchmark and of the documents meet in a
hash join; an item with fewer tokens is one window of its own length. So a
question whose numbers and names were exchanged still meets its original. A
window without any literal word says nothing about a template and must agree
in its values. Windows of all words as they are, in lower case, meet beside
them, so a copy that only changed its capitals, which decide about names, is
found too.

Hits are grouped by their diagonal (same item, same shift), and also over
neighbouring diagonals, which an inserted word leads to. In a group every
original value stands for the value that it meets most often; windows with
another value in a slot do not count, and enough of the item's windows must
remain.

DataFrame functions only. The benchmark's windows are sent to all tasks in
blocks of at most ``BLOCK_WINDOWS``, each of which passes over the documents
once, so texts are never shuffled, however large either side is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import let
from postmill.session import materialise

WINDOW = 8
#: Share of an item's windows that a document must hold with consistent slots.
COVERAGE = 0.5
#: Diagonals that one group of neighbours spans.
SPREAD = 16
#: Windows of the benchmark that are broadcast at once, about.
BLOCK_WINDOWS = 250_000
#: Codes of placeholders; words have codes from ``WORDS`` on.
NUMBER, NAME, WORDS = 1, 2, 16
#: Forms of windows: templates, and all words in lower case.
TEMPLATE, FOLDED = 0, 1
# Units of measure recognised after a number, and numbers as words.
UNITS = [
    "cent", "centimeter", "centimeters", "cents", "cm", "day", "days", "dollar", "dollars", "euro", "euros", "feet", "foot", "g", "gallon", "gallons", "gram", "grams", "hour", "hours", "inch", "inches",
    "kg", "kilogram", "kilograms", "kilometer", "kilometers", "km", "liter", "liters", "m", "meter", "meters", "mile", "miles", "minute", "minutes", "ml", "mm", "month", "months", "ounce", "ounces",
    "pence", "percent", "pound", "pounds", "second", "seconds", "week", "weeks", "yard", "yards", "year", "years",
]
NUMBER_WORDS = [
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
]


def is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def is_capital(word: Column) -> Column:
    """Whether the word opens with a capital; only letters beyond ASCII need a look at their other case."""
    first = F.substring(word, 1, 1)
    return ((word >= "A") & (word < "[")) | ((word >= "{") & (F.lower(first) != first))


def raw_words(text: Column) -> Column:
    """Runs of letters and digits, a number's word as a digit; empty words at the ends are the template's to leave out."""
    first = "".join(sorted({w[0] for w in NUMBER_WORDS}))  # a look ahead that most words end at
    written = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\b(?=[{first}{first.upper()}])(?i:{'|'.join(NUMBER_WORDS)})\b", "0")
    return F.split(written, r"[^\p{L}\p{N}\p{M}]+")


def folded_codes(words: Column) -> Column:
    """A number for each raw word in lower case."""
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.shiftrightunsigned(F.xxhash64(F.lower(w), F.lit("folded")), 2) + WORDS)


def raw_codes(words: Column) -> Column:
    """A number for each raw word: a placeholder's, above ``WORDS`` for a literal word, 0 for one that is no token of its own.

    No tokens are empty words, units after a number, and the words of a run of numbers or names but the first.
    """
    units = F.array(*map(F.lit, UNITS))

    def code(w: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        number = F.when(is_number(before), 0).otherwise(NUMBER)
        placeholder = F.when(is_number(w), number).when(is_capital(w), F.when(is_capital(before), 0).otherwise(NAME))
        gone = (w == "") | (is_number(before) & F.array_contains(units, F.lower(w)))
        return F.coalesce(placeholder.when(gone, 0).cast("long"), F.shiftrightunsigned(F.xxhash64(w), 2) + WORDS)

    return F.transform(words, code)


def window_hashes(codes: Column, length: int) -> Column:
    """The hash of every window of ``length`` codes, in order; those of ``WINDOW`` by doubling."""
    if length < WINDOW:
        hashes = F.transform(F.sequence(F.lit(0), F.size(codes) - length), lambda i: F.xxhash64(F.slice(codes, i + 1, length)))
    else:
        doubled = lambda h, k: F.zip_with(h, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
        hashes = F.slice(let(let(doubled(codes, 1), lambda h: doubled(h, 2)), lambda h: doubled(h, 4)), F.lit(1), F.size(codes) - WINDOW + 1)
    return F.when(F.size(codes) >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def value_digests(words: Column, places: Column, at: Column) -> Column:
    """Digests of the words behind the ``WINDOW`` tokens from ``at`` (from 0), whatever their case."""
    return F.array(*[F.xxhash64(F.lower(F.get(words, F.get(places, at + k)))) for k in range(WINDOW)])


def coded(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, raw words, codes, places (of the codes' words) and folded codes of each row."""
    split = rows.select(*keys, raw_words(F.col("text")).alias("words"))
    raw = split.select(*keys, "words", raw_codes(F.col("words")).alias("raw"))
    places = F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.get("raw", i) != 0)
    return raw.select(*keys, "words", places.alias("places"), F.array_remove("raw", F.lit(0).cast("long")).alias("codes"), folded_codes(F.col("words")).alias("folded"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, form, item_at, hash, length, item_windows, slots (their places in the window) and was (values) of all windows of all items."""
    both = coded(benchmark.where("item_id IS NOT NULL").select("item_id", "text").distinct(), "item_id")
    forms = F.array(F.struct(F.lit(TEMPLATE).alias("form"), F.col("codes").alias("codes")), F.struct(F.lit(FOLDED).alias("form"), F.col("folded").alias("codes")))
    items = both.select("item_id", "words", "places", F.explode(forms).alias("f")).select("item_id", "words", "places", "f.form", "f.codes").withColumn("n", F.size("codes"))
    items = items.withColumn("length", F.least("n", F.lit(WINDOW)))
    hashes = reduce(lambda other, k: F.when(F.col("n") == k, window_hashes(F.col("codes"), k)).otherwise(other), range(1, WINDOW), window_hashes(F.col("codes"), WINDOW))
    # Outer, for an inner one would have Spark compute the arrays once more, in a filter on their sizes.
    each = items.select("*", F.posexplode_outer(hashes).alias("item_at", "hash"))
    slots = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.get("codes", F.col("item_at") + k) < WORDS)
    was = F.when(F.col("form") == TEMPLATE, value_digests(F.col("words"), F.col("places"), F.col("item_at"))).otherwise(F.array().cast("array<bigint>"))
    return each.where("hash IS NOT NULL").select("item_id", "form", "item_at", "hash", "length", (F.col("n") - F.col("length") + 1).alias("item_windows"), slots.alias("slots"), was.alias("was"))


def sound_windows(hits: Column) -> Column:
    """The hits whose slots hold the values that the group's originals meet most often (the larger digest among equals)."""
    pairs = F.flatten(F.transform(hits, lambda h: h["pairs"]))

    def dominant(all_pairs: Column) -> Column:
        counted = F.transform(F.array_distinct(all_pairs), lambda p: F.struct(p["was"].alias("was"), F.size(F.filter(all_pairs, lambda q: q == p)).alias("n"), p["now"].alias("now")))
        return let(counted, lambda known: F.filter(known, lambda p: ~F.exists(known, lambda q: (q["was"] == p["was"]) & (F.struct(q["n"], q["now"]) > F.struct(p["n"], p["now"])))))

    def kept(all_pairs: Column) -> Column:
        distinct = F.array_distinct(all_pairs)
        mixed = F.size(distinct) > F.size(F.array_distinct(F.transform(distinct, lambda p: p["was"])))
        chosen = lambda: F.transform(dominant(all_pairs), lambda p: F.struct(p["was"].alias("was"), p["now"].alias("now")))
        return F.when(mixed, let(chosen(), lambda c: F.filter(hits, lambda h: F.forall(h["pairs"], lambda p: F.array_contains(c, p))))).otherwise(hits)

    return let(pairs, kept)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, share, n_windows, n_slots and text_hash.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. One row for
    each item and each pair of a doc_id and a text. ``share`` is the largest
    share of the item's windows in one group of hits with consistent slots,
    ``n_slots`` the originals checked there, ``text_hash`` tells texts with one
    doc_id apart. Null and blank texts on either side meet nothing, and so do
    items with a null id; a null doc_id is an id; repeated rows count once; an
    empty side gives an empty result; other columns are ignored. Texts of any
    length are read whole.
    """
    items = materialise(benchmark_windows(benchmark), "item-windows")
    n = items.count()
    # At most WINDOW different lengths of a form; documents need windows of those lengths only.
    known = sorted(((r["form"], -r["length"]) for r in items.select("form", "length").distinct().collect())) or [(TEMPLATE, -WINDOW)]
    kinds = [(form, -length) for form, length in known]
    texts = coded(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text")), "doc_id", "text_hash")
    of = {TEMPLATE: "codes", FOLDED: "folded"}
    texts = texts.withColumn("hashes", F.concat(*[window_hashes(F.col(of[form]), k) for form, k in kinds])).withColumn("n", F.array(F.size("codes"), F.size("folded")))
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    texts = texts.select("doc_id", "text_hash", "words", "places", "n", "hashes")
    texts = materialise(texts, "text-windows") if blocks > 1 else texts
    each = texts.select("doc_id", "text_hash", "words", "places", "n", F.posexplode_outer("hashes").alias("pos", "hash"))
    met = [each.join(F.broadcast(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)), "hash") for b in range(blocks)]
    # Hashes stand by form and length, the longest first.
    ahead = lambda i: sum((F.greatest(F.get("n", F.lit(form)) - m + 1, F.lit(0)) for form, m in kinds[:i]), F.lit(0))
    mine = lambda form, k: (F.col("form") == form) & (F.col("length") == k)
    at = F.col("pos") - reduce(lambda other, i: F.when(mine(*kinds[i]), ahead(i)).otherwise(other), range(len(kinds)), F.lit(0))
    placed = reduce(DataFrame.unionAll, met).withColumn("at", at).withColumn("now", value_digests(F.col("words"), F.col("places"), F.col("at"))).drop("words", "places", "n", "pos", "hash")
    hits = placed.where((F.size("slots") < F.col("length")) | (F.slice("was", F.lit(1), F.col("length")) == F.slice("now", F.lit(1), F.col("length"))))
    pairs = F.transform("slots", lambda k: F.struct(F.get("was", k).alias("was"), F.get("now", k).alias("now")))
    shift = F.col("at") - F.col("item_at")
    # Each hit counts on its own diagonal and in both stretches of neighbouring ones that hold it.
    groups = F.array(
        F.struct("form", F.lit(0).alias("kind"), shift.alias("place")), F.struct("form", F.lit(1).alias("kind"), F.floor(shift / SPREAD).cast("int").alias("place")),
        F.struct("form", F.lit(2).alias("kind"), F.floor((shift + SPREAD // 2) / SPREAD).cast("int").alias("place")),
    )
    dealt = hits.select("doc_id", "text_hash", "item_id", "item_windows", "item_at", "at", pairs.alias("pairs"), F.explode(groups).alias("group"))
    # A group has at most SPREAD hits for each window of its item, when repeated rows count once.
    grouped = dealt.groupBy("doc_id", "text_hash", "item_id", "group").agg(
        F.max("item_windows").alias("item_windows"), F.collect_set(F.struct("item_at", "at", "pairs")).alias("hits")
    )
    windows_of = lambda hits: F.size(F.array_distinct(F.transform(hits, lambda h: h["item_at"])))
    enough = lambda n: n >= F.col("item_windows") * coverage
    likely = grouped.where(enough(windows_of("hits"))).withColumn("hits", sound_windows(F.col("hits")))
    slots = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.transform(h["pairs"], lambda p: p["was"])))))
    counted = likely.select("doc_id", "text_hash", "item_id", "item_windows", windows_of("hits").alias("n_windows"), slots.alias("n_slots")).where(enough(F.col("n_windows")))
    share = (F.col("n_windows") / F.col("item_windows")).alias("share")
    best = counted.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct(share, "n_windows", "n_slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.share", "best.n_windows", "best.n_slots", "text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; see :func:`benchmark_hits`.

    Rows with a null doc_id are judged by their texts like all others.
    """
    hits = materialise(benchmark_hits(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "hit-texts")
    gone = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    return docs.join(hits, gone, "left_anti")
