"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's code points: each step shifts the hash left
and adds the symbol's random number, so its top bits depend on the last 16
symbols alone. A chunk ends where the hash is the least of some ``WINDOW``
consecutive ones. Cuts thus depend on nothing but the text around them:
inserting a character moves no cut further away than a window, chunks vary in
length up to ``WINDOW`` (more in a run of one repeated
symbol), and every passage of over 16 + 2 * ``WINDOW``
characters that two texts share holds the same chunks in both.

Chunks with equal digests are repeats of each other. Neighbouring repeats join
into stretches; those with ``min_words`` words or more are reported, one passage
for each document that their chunks were first seen in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm import kernels
from postmill.llm.common import let_workers_import

GEAR_SPAN = 16
WINDOW = 64
MIN_WORDS = 15
GEAR = (kernels.mix(np.arange(0x10000, dtype=np.uint64) + np.uint64(0x51ED270B)) >> np.uint64(48)).astype(np.uint16)
CHUNK_SCHEMA = "doc_id long, row long, digest long, start long, end long, words int"


def gear_hashes(codes: np.ndarray) -> np.ndarray:
    """The rolling hash after every symbol, of the last 16 symbols."""
    rolled = GEAR[codes & np.uint32(0xFFFF)]
    for k in (1, 2, 4, 8):
        ahead = rolled[:-k] << np.uint16(k)
        rolled = rolled.copy()
        rolled[k:] += ahead
    return rolled


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, its own end last."""
    n = len(codes)
    if n <= WINDOW:
        return np.array([n]) if n else np.zeros(0, np.int64)
    place = np.arange(n, dtype=np.uint64)
    rolled = gear_hashes(codes)
    low = (kernels.mix(rolled.astype(np.uint64)) & ~np.uint64(0xFFFFFFFF)) | place
    k = 1
    while 2 * k <= WINDOW:  # least hash, and the first place of it, of every window
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    picked = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    picked = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
    same = (rolled[picked[1:]] == rolled[picked[:-1]]) & (np.diff(picked) <= GEAR_SPAN)
    picked = picked[np.concatenate(([True], ~same))] + 1  # a run of one repeated symbol is one chunk
    return np.append(picked[picked < n], n)


def chunks_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests, starts, ends and numbers of words that begin in each chunk."""
    codes = kernels.code_points(text)
    ends = cut_points(codes)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    begins, _ = kernels.words(codes)
    counts = np.diff(np.searchsorted(begins, np.concatenate((starts[:1], ends)))) if len(ends) else ends
    return kernels.Spans(codes).digests(starts, ends).view(np.int64), starts, ends, counts


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(ids: list, rows: list, parts: list) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in parts]
        each = pa.array(np.repeat(np.arange(len(ids)), sizes))
        keys, owners = (pa.array(x, pa.int64()).take(each) for x in (ids, rows))
        digest, start, end, words = (np.concatenate([p[k] for p in parts]) for k in range(4))
        columns = [keys, owners, pa.array(digest, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(words.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "digest", "start", "end", "words"])

    for batch in batches:
        ids, rows, parts, size = [], [], [], 0
        for key, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            if text:
                ids.append(key)
                rows.append(row)
                parts.append(chunks_of(text))
                size += len(parts[-1][0])
            if size > 100_000:
                yield flush(ids, rows, parts)
                ids, rows, parts, size = [], [], [], 0
        if parts:
            yield flush(ids, rows, parts)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of ``docs`` (doc_id, text, ...) whose chunks occur more than once.

    Returns doc_id, start and end (code points), n_words, is_first (its chunks
    occur nowhere earlier, in the order of doc_id and place) and first_doc_id
    (the least doc_id that holds them). One row per passage: a maximal run of
    neighbouring repeated chunks that are all first or all seen before, first
    in the same document. Passages that touch form a stretch, which needs
    ``min_words`` words; a passage of it may have fewer. A chunk that is first
    is never in a passage that is not. Repeats inside a text count. Null and
    empty texts have none. Rows with equal doc_ids are versions of one document:
    a chunk that they hold at the same place is no repeat, so repeated rows
    count once, and each different text has passages of its own. Other columns
    are ignored.
    """
    return passages_of(docs, min_words).drop("row")


def passages_of(docs: DataFrame, min_words: int) -> DataFrame:
    """The passages of :func:`repeated_passages` with the digest of their text as ``row``."""
    let_workers_import(docs.sparkSession)
    chunks = docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(chunk_rows, CHUNK_SCHEMA)
    seen = (
        chunks.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
        .where("first <> last")
        .select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.start").alias("first_start"))
    )
    repeats = chunks.join(seen, "digest").withColumn(
        "first_here", (F.col("first_id").eqNullSafe(F.col("doc_id"))) & (F.col("first_start") == F.col("start"))
    )
    by_doc = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    repeats = repeats.withColumn("again", F.lag("start").over(by_doc).eqNullSafe(F.col("start"))).where("NOT again")
    # A stretch ends where a chunk is no repeat, a passage also where its chunks were first seen elsewhere.
    origin = F.struct("first_here", "first_id")
    runs = repeats.withColumn("opens", F.coalesce((F.lag("end").over(by_doc) < F.col("start")).cast("int"), F.lit(1)))
    runs = runs.withColumn("turns", F.when(F.lag(origin).over(by_doc).eqNullSafe(origin), F.col("opens")).otherwise(F.lit(1)))
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("stretch", F.sum("opens").over(so_far)).withColumn("run", F.sum("turns").over(so_far))
    passages = runs.groupBy("doc_id", "row", "stretch", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").cast("long").alias("n_words"),
        F.first("first_here").alias("is_first"),
        F.first("first_id").alias("first_doc_id"),
    )
    whole = passages.withColumn("whole", F.sum("n_words").over(Window.partitionBy("doc_id", "row", "stretch")))
    return whole.where(F.col("whole") >= min_words).drop("stretch", "run", "whole")


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with every passage that is not the first of its kind cut out of its text."""
    later = passages_of(docs, min_words).where("NOT is_first")
    spans = later.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left")
    whole = F.array(F.struct(F.length("text").cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    gaps = F.aggregate(
        F.concat(F.col("__cut"), whole),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept")),
        lambda acc, s: F.struct(
            s["end"].alias("at"),
            F.concat(acc["kept"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))).alias("kept"),
        ),
    )["kept"]
    return joined.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(gaps)).select(*docs.columns)
