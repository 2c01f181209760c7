"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from operator import itemgetter
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.session import fresh_path

PREVIEW = 1000
NAMELESS = "__HIVE_DEFAULT_PARTITION__"
RENAMES = 16


def fetch_log_rows(fetches: DataFrame) -> DataFrame:
    """Fetches (text, body binary, ...) as log rows: preview, truncation flag and size in place of bytes."""
    size = F.concat(F.lit("<bytes:"), F.coalesce(F.octet_length("body"), F.lit(0)).cast("string"), F.lit(">"))
    return fetches.withColumns({
        "text_truncated": F.length("text") > PREVIEW, "text": F.substring("text", 1, PREVIEW), "body_bytes": size
    }).drop("body")


def raw_text_name(kind: Column, url: Column, text: Column) -> Column:
    """Content key of a raw text."""
    suffix = F.when(kind == "json", F.lit(".json")).otherwise(F.lit(".html"))
    return F.concat(F.sha1(F.concat_ws(":", kind, url, F.substring(text, 1, 200))), suffix)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report table in one file: small by construction."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_lines(rows: DataFrame) -> DataFrame:
    """Markdown lines of a crawl report (section, name, n), sections in name order."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.col("n").cast("string"))
    grouped = rows.groupBy("section").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "name", line.alias("line")))).alias("l"))
    return grouped.select("section", F.concat(F.lit("## "), "section", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def named_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Write rows (name, value as bytes), those of a name together and in order, as files under a mounted folder; gives no rows.

    A file gets its name once it is whole, so attempts of a task never mix; a checksum of an older file of that name goes.
    """

    def pieces() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            values = iter(batch.column("value").to_pylist())
            for name, same in groupby(batch.column("name").to_pylist()):
                yield name, b"".join(value + b"\n" for _, value in zip(same, values))

    for name, texts in groupby(pieces(), itemgetter(0)):
        target = Path(f"{root}/{name}")
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{uuid.uuid4().hex}")
        with part.open("wb") as out:
            out.writelines(text for _, text in texts)
        target.with_name(f".{target.name}.crc").unlink(missing_ok=True)
        part.replace(target)
    yield from ()


def write_files(lines: DataFrame, folder: str, name: str = "name", order: str = "line", text: str = "text") -> None:
    """Text files under ``folder`` with the names of column ``name`` (may hold slashes), each with its lines in order.

    Every file is written by one task. In a mounted folder (``file:``) the task
    also names it, and the driver's work does not grow with the files. Other
    stores are reached by Spark's writer only: tasks commit the files and the
    driver renames each, some at a time. Rows without a name go to a file with
    the name that Spark gives to a partition without one.
    """
    spark = lines.sparkSession
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(to_path(folder))
    named = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(NAMELESS))
    rows = lines.select(named.alias("name"), F.col(order).alias("__line"), F.coalesce(text, F.lit("")).alias("value"))
    sorted_rows = rows.repartition("name").sortWithinPartitions("name", "__line").drop("__line")
    if files.getScheme() == "file":
        root = to_path(folder).toUri().getPath()
        sorted_rows.withColumn("value", F.col("value").cast("binary")).mapInArrow(lambda batches: named_files(batches, root), "name string").write.format("noop").mode("overwrite").save()
        return
    scratch = fresh_path(spark, "files")
    sorted_rows.withColumnRenamed("name", "__name").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("__name").text(scratch)

    def place(part: JavaObject) -> None:
        source = part.getPath()
        target = to_path(f"{folder}/{unquote(source.getParent().getName().removeprefix('__name='))}")
        files.mkdirs(target.getParent())
        files.delete(target, False)
        if not files.rename(source, target):
            raise OSError(f"{target.toString()} could not be written")

    with ThreadPoolExecutor(RENAMES) as pool:
        for _ in pool.map(place, files.globStatus(to_path(f"{scratch}/__name=*/part-*"))):
            pass
    files.delete(to_path(scratch), True)


def pdf_rows(fetches: DataFrame) -> DataFrame:
    """name, body and the record of each PDF (source_id, company, url, title, body): files named by their address, as a table of binaries."""
    name = F.concat(F.sha1("url"), F.lit(".pdf"))
    record = F.to_json(F.struct("source_id", "company", "url", "title", name.alias("saved_path")), {"ignoreNullFields": "false"})
    return fetches.select(name.alias("name"), "body", record.alias("record"))


def call_log_rows(calls: DataFrame, at: str = "ts", model: str = "model") -> DataFrame:
    """day, name and line of model calls: names of time, milliseconds and model, lines of JSON with the time of the call first."""
    stamp = F.concat_ws("_", F.date_format(at, "yyyyMMdd_HHmmss"), F.lpad((F.floor(F.unix_micros(at) / 1000) % 1000).cast("string"), 3, "0"), T.safe_file(F.coalesce(model, F.lit("unknown-model"))))
    rest = [F.col(c) for c in calls.columns if c != at]
    line = F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssZ").alias("logged_at"), *rest), {"ignoreNullFields": "false"})
    return calls.select(F.to_date(at).alias("day"), F.concat(stamp, F.lit(".json")).alias("name"), line.alias("line"))


def write_call_log(rows: DataFrame, folder: str) -> None:
    """Append call log lines, a folder a day; many calls share a file, which one file a call would not bear."""
    rows.select("day", F.col("line").alias("value")).write.mode("append").partitionBy("day").text(folder)


def replace_outputs(outputs: dict[str, DataFrame], needed: str) -> bool:
    """Write tables in place of those at their paths, but only if the ``needed`` one has rows; otherwise all stay as they were."""
    if outputs[needed].isEmpty():
        return False
    for path, rows in outputs.items():
        rows.write.mode("overwrite").parquet(path)
    return True
