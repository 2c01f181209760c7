"""Subtitle files: parsing, writing, batches and merging of translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T


def parse_srt(files: DataFrame) -> DataFrame:
    """Entries of whole texts (file, text): file, pos, idx, times, text.

    Blocks of fewer than three lines, or without an integer number, are dropped.
    """
    clean = T.strip(F.regexp_replace("text", "\r\n?", "\n"))
    blocks = files.select("file", F.posexplode(F.split(clean, "\n\n")).alias("pos", "block"))
    parts = blocks.withColumn("l", F.split(T.strip(F.col("block")), "\n")).where(F.size("l") >= 3)
    number = F.expr("try_cast(trim(l[0]) as int)")
    return parts.select("file", "pos", number.alias("idx"), T.strip(F.get("l", F.lit(1))).alias("times"), F.array_join(F.slice("l", 3, 1 << 20), "\n").alias("text")).where("idx IS NOT NULL")


def parse_srt_loosely(files: DataFrame) -> DataFrame:
    """Entries of whole texts (file, text) as older files have them: any number of blank lines between blocks, the index a text of any kind.

    Blocks of fewer than three lines are dropped: file, pos, idx, times, text.
    """
    clean = T.strip(F.regexp_replace("text", "\r\n?", "\n"))
    blocks = files.select("file", F.posexplode(F.split(clean, "\n\n+")).alias("pos", "block"))
    parts = blocks.withColumn("l", F.split(T.strip(F.col("block")), "\n")).where(F.size("l") >= 3)
    return parts.select("file", "pos", F.get("l", F.lit(0)).alias("idx"), F.get("l", F.lit(1)).alias("times"), F.array_join(F.slice("l", 3, 1 << 20), "\n").alias("text"))


def is_bilingual(entries: DataFrame, first: int = 5) -> DataFrame:
    """Whether one of each file's first entries has a line with Chinese and one without: file, bilingual."""
    lines = F.split("text", "\n")
    both = (F.size(lines) >= 2) & F.exists(lines, lambda x: x.rlike(T.CJK)) & F.exists(lines, lambda x: ~x.rlike(T.CJK) & (T.strip(x) != ""))
    early = entries.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).where(F.col("n") <= first)
    return early.groupBy("file").agg(F.max(both).alias("bilingual"))


def subtitle_sets(files: DataFrame) -> DataFrame:
    """file and bilingual of the subtitle files to work on, of whole files (file, text).

    Split results are left out (stems that end in ``.en``, and ``.zh`` for the
    bilingual ones), and so are files without an entry.
    """
    stem = F.regexp_replace("file", r"\.srt\z", "")
    found = is_bilingual(parse_srt_loosely(files.where(~F.endswith(stem, F.lit(".en")))))
    return found.where(~(F.col("bilingual") & F.endswith(stem, F.lit(".zh"))))


def bilingual_lines(entries: DataFrame, translations: DataFrame) -> DataFrame:
    """file, pos, line and text of files with each entry's translation (file, pos, said) above its text, as ``write_files`` takes them."""
    joined = entries.join(translations, ["file", "pos"])
    rows = F.concat(F.array("idx", "times"), F.split("said", "\n"), F.split("text", "\n"), F.array(F.lit("")))
    return joined.select("file", "pos", F.posexplode(rows).alias("line", "text"))


def split_lines(entries: DataFrame) -> DataFrame:
    """name, pos, line and text of the two files, ``.zh`` and ``.en``, into which bilingual files are split."""
    halves = split_languages(entries)
    stem = F.regexp_replace("file", r"\.srt\z", "")
    part = lambda language: F.struct(F.concat(stem, F.lit(f".{language}.srt")).alias("name"), F.split(language, "\n").alias("said"))
    both = halves.select("pos", "idx", "times", F.explode(F.array(part("zh"), part("en"))).alias("h"))
    rows = F.concat(F.array("idx", "times"), F.col("h.said"), F.array(F.lit("")))
    return both.select("h.name", "pos", F.posexplode(rows).alias("line", "text"))


def format_srt(entries: DataFrame) -> DataFrame:
    """One text per file, numbered again from 1."""
    grouped = entries.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "times", "text"))).alias("e"))
    block = lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), x["times"], x["text"])
    return grouped.select("file", F.concat(F.array_join(F.transform("e", block), "\n\n"), F.lit("\n")).alias("text"))


def is_chinese(entries: DataFrame, threshold: float = 0.3, first: int = 30) -> DataFrame:
    """Whether the first entries of each file are mostly Chinese."""
    grouped = entries.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("e"))
    joined = F.array_join(F.transform(F.slice("e", 1, first), lambda x: x["text"]), " ")
    return grouped.select("file", (T.cjk_ratio(joined) > threshold).alias("chinese"))


def batches(entries: DataFrame, size: int) -> DataFrame:
    """Numbered prompt text of each run of ``size`` entries: file, batch, prompt."""
    placed = entries.withColumn("batch", F.floor(F.col("pos") / size)).withColumn("n", F.pmod("pos", F.lit(size)) + 1)
    line = F.concat_ws(": ", F.col("n").cast("string"), F.regexp_replace("text", "\n", " "))
    grouped = placed.groupBy("file", "batch").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return grouped.select("file", "batch", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("prompt"))


def merge_translations(entries: DataFrame, replies: DataFrame, size: int) -> DataFrame:
    """Entries with the reply's numbered lines in place; a line missing there keeps its text.

    ``replies`` has file, batch and reply; of repeated numbers the last counts.
    """
    split = replies.select("file", "batch", F.posexplode(F.split("reply", "\n")).alias("at", "line"))
    numbered = split.select("file", "batch", "at", F.expr("try_cast(regexp_extract(line, '^\\\\s*(\\\\d+)\\\\s*[:：]', 1) as int)").alias("n"), T.strip(F.regexp_replace("line", r"^\s*\d+\s*[:：]", "")).alias("said"))
    last = numbered.where("n IS NOT NULL").groupBy("file", "batch", "n").agg(F.max_by("said", "at").alias("said"))
    placed = entries.withColumn("batch", F.floor(F.col("pos") / size)).withColumn("n", F.pmod("pos", F.lit(size)).cast("int") + 1)
    joined = placed.join(last, ["file", "batch", "n"], "left")
    return joined.select("file", "pos", "idx", "times", F.coalesce(F.nullif("said", F.lit("")), "text").alias("text"))


def split_languages(entries: DataFrame) -> DataFrame:
    """Chinese and other lines of each entry, as texts of their own."""
    rows = F.split("text", "\n")
    pick = lambda test: F.array_join(F.filter(rows, test), "\n")
    return entries.select("file", "pos", "idx", "times", pick(lambda x: x.rlike(T.CJK)).alias("zh"), pick(lambda x: ~x.rlike(T.CJK)).alias("en"))


def prefer_translated(raw: DataFrame, translated: DataFrame) -> DataFrame:
    """One text per stem; a translated file goes before the raw one."""
    both = raw.select("stem", F.col("text").alias("raw")).join(translated.select("stem", F.col("text").alias("zh")), "stem", "full_outer")
    return both.select("stem", F.coalesce("zh", "raw").alias("text"))
