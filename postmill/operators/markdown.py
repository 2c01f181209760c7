"""Markdown files to section records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T


def lines(files: DataFrame) -> DataFrame:
    """file, n and line of whole texts (file, text)."""
    return files.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "line"))


def clean_line(line: Column) -> Column:
    """A line without quote mark, bullet or number; a rule becomes empty."""
    out = T.strip(line)
    out = F.when(out.rlike(r"^(---+|\*\*\*+|___+)$"), F.lit("")).otherwise(out)
    for pattern in (r"^>\s?", r"^[-*+]\s+", r"^\d+[.、)]\s*"):
        out = T.strip(F.regexp_replace(out, pattern, ""))
    return out


def sections(files: DataFrame) -> DataFrame:
    """Sections under ``### `` headings: file, section, category, title, body lines.

    A ``## `` heading closes the open section; text before the first section
    is ignored. The category is the file's first ``## `` heading without its
    ordinal prefix.
    """
    rows = lines(files)
    opens, closes = F.startswith("line", F.lit("### ")), F.startswith("line", F.lit("## "))
    at = Window.partitionBy("file").orderBy("n")
    marked = rows.withColumn("edge", (opens | closes).cast("int")).withColumn("open", opens)
    run = F.sum("edge").over(at.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("run", run).where("run > 0")
    grouped = marked.groupBy("file", "run").agg(
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("all"), F.max("open").alias("is_section"), F.min("n").alias("first_line")
    )
    heads = rows.where(closes).groupBy("file").agg(F.min_by("line", "n").alias("h2"))
    category = F.regexp_replace(T.strip(F.substring("h2", 4, 1 << 20)), "^第[^部]*部分[：:]", "")
    body = F.transform(F.slice("all", 2, 1 << 20), lambda x: x["line"])
    out = grouped.where("is_section").join(heads, "file", "left")
    return out.select("file", "first_line", F.coalesce(T.strip(category), F.lit("")).alias("category"), T.strip(F.substring(F.get("all", F.lit(0))["line"], 5, 1 << 20)).alias("title"), body.alias("body"))


def section_records(parts: DataFrame) -> DataFrame:
    """Records of sections with a summary or evidence: uri, title, category, summary, evidence."""
    cleaned = F.filter(F.transform("body", clean_line), lambda x: x != "")
    out = parts.withColumn("cleaned", cleaned)
    return out.select(
        F.concat("file", F.lit("#"), T.slug(F.col("title"))).alias("uri"), "title", "category",
        F.array_join(F.slice("cleaned", 1, 4), " ").alias("summary"), F.array_join("cleaned", "\n").alias("evidence_text"),
    ).where("summary <> '' OR evidence_text <> ''")


def merge_records(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both record sets, columns missing on one side as nulls."""
    return first.unionByName(second, allowMissingColumns=True)


def category_counts(records: DataFrame) -> DataFrame:
    """Labels of policy_categories with counts, most frequent first."""
    rows = records.select(F.explode("policy_categories").alias("category"))
    return rows.groupBy("category").count().orderBy(F.desc("count"), "category")
