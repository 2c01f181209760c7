"""Order-dependent deduplication of a stream: a row goes if its url or its print is that of an earlier kept row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from postmill.operators.dedup import keep_unseen
from postmill.session import fresh_path, materialise, scratch

SHARDS = 64
#: Columns of the digests of url and fingerprint beside the kept rows.
DIGESTS = ("__url_digest", "__print_digest")


def release_to(rows: DataFrame, time: str, ordinal: str, late: str, slot: str, folder: str) -> StreamingQuery:
    """Write released rows to ``folder/released``, whose batches become visible whole; a stream that reads them takes all there are."""
    out = released(rows, time, ordinal, late, slot).writeStream.format("parquet").option("path", f"{folder}/released")
    return out.option("checkpointLocation", f"{folder}/release-checkpoint").outputMode("append").start()


def released(rows: DataFrame, time: str, ordinal: str, late: str, slot: str = "1 minute") -> DataFrame:
    """Rows of a stream once no earlier one can come, by the watermark of ``time``.

    A slot of time leaves as soon as the watermark has passed its end, so a
    batch holds whole slots and no later batch has an earlier row. A slot is
    held in shards by ``ordinal``; rows later than the watermark are dropped,
    as the stream's ``late`` says.
    """
    held = rows.withWatermark(time, late).groupBy(F.window(time, slot).alias("slot"), F.pmod(F.xxhash64(ordinal), F.lit(SHARDS)).alias("shard")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
    return held.select(F.explode("rows").alias("r")).select("r.*")


def kept_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the stream has kept so far, with the batch that kept it."""
    return spark.read.parquet(f"{folder}/kept").drop(*DIGESTS)


def keep_unseen_stream(rows: DataFrame, ordinal: str, url: str, fingerprint: str, folder: str, partitions: int | None = None, **trigger: str) -> StreamingQuery:
    """Run ``keep_unseen`` over a stream whose batches come in the order of ``ordinal``.

    ``rows`` has a string url and fingerprint. What is kept is written to
    ``folder/kept`` with two numbers, the digests of both keys. A batch drops the
    rows whose digests earlier batches kept, by two joins that Spark spreads, and
    decides the others among themselves. So it costs its own rows and the
    reading of 16 bytes for each row kept so far, and no row meets Python. Kept
    rows are partitioned by batch, and a batch that runs again after a failure
    reads the earlier partitions only and overwrites its own. ``partitions`` is
    that of the stream's own plan (the session's shuffle partitions without it).
    """
    spark = rows.sparkSession
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    schema = rows.schema
    target = StructType([*schema.fields, *[StructField(d, LongType()) for d in DIGESTS], StructField("batch", LongType())])
    spark.createDataFrame([], target).write.mode("append").partitionBy("batch").parquet(f"{folder}/kept")

    def decide(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            path = fresh_path(spark, "unseen-batch")
            digests = {d: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for d, c in zip(DIGESTS, (url, fingerprint), strict=True)}
            batch.withColumns(digests).write.parquet(path)
            fresh = spark.read.schema(StructType(target.fields[:-1])).parquet(path)  # in the caller's session: the stream's own does not adapt its plans
            kept = spark.read.schema(target).parquet(f"{folder}/kept").where(F.col("batch") < number)
            for digest in DIGESTS:
                fresh = fresh.join(kept.select(digest), digest, "left_anti")
            fresh = materialise(fresh.select(*schema.names, *DIGESTS), "unseen-fresh")
            if not fresh.isEmpty():
                chosen = keep_unseen(fresh, ordinal, url, fingerprint).withColumn("batch", F.lit(number).cast("long"))
                chosen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/kept")

    writer = rows.writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/checkpoint")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions or shuffled))
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
