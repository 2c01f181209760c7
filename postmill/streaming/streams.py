"""Structured Streaming forms of the log-driven steps, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.sources.readers import FETCH_LOG


def fetch_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a fetch log directory."""
    return spark.readStream.schema(FETCH_LOG).json(path)


def events_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; a batch frame works too."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def best_so_far(rows: DataFrame) -> DataFrame:
    """The best ungated score of each label, updated as monitor rows (label, step, score, gated) arrive.

    A step that comes after a later batch was seen is ignored; inside a batch
    the parts of a label come in any order. Of equal scores the least step
    counts, and rows without a score never do.
    """
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, at = state.get if state.exists else (-1, None, None)
        newest = last
        for part in parts:
            new = part[part["step"] > last]
            if len(new):
                newest = max(newest, int(new["step"].max()))
            fair = new[new["gated"].eq(False) & new["score"].notna()]
            if len(fair):
                top = float(fair["score"].max())
                step = int(fair.loc[fair["score"] == top, "step"].min())
                if best is None or top > best or (top == best and step < at):
                    best, at = top, step
        state.update((newest, best, at))
        yield pd.DataFrame({"label": [key[0]], "best_score": [best], "best_step": [at]})

    return rows.groupBy("label").applyInPandasWithState(
        update, "label string, best_score double, best_step long", "last long, best double, at long", "update", GroupStateTimeout.NoTimeout
    )


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append rows whose keys the target does not have yet; a batch that is repeated adds nothing."""
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(target).select(*keys)
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = batch.limit(0).select(*keys)
        batch.dropDuplicates(keys).join(known, keys, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
