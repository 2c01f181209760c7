"""Streams that make something once for each key and then return what is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from postmill.operators.dedup import first_by
from postmill.session import materialise, scratch


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows made so far, with the batch that made each."""
    return spark.read.parquet(f"{folder}/made")


def commit(batch: DataFrame, number: int, key: str, order: list[str], make: Callable[[DataFrame], DataFrame], folder: str, schema: StructType) -> None:
    """Make the rows of a batch whose keys have none yet, and store them as the partition of the batch.

    The partition is the claim and the ledger in one: a batch that comes again
    finds its partition and makes nothing, whether the stream stopped before or
    after its own commit, and a partition appears whole or not at all. Of
    requests with one key the first by ``order`` counts.
    """
    spark = batch.sparkSession
    made = spark.read.schema(StructType([*schema.fields]).add("batch", LongType())).parquet(f"{folder}/made")
    if made.where(F.col("batch") == number).limit(1).count():
        return
    wanted = first_by(batch.where(F.col(key).isNotNull()), [key], order)
    fresh = materialise(wanted.join(made.select(key), key, "left_anti"), "once")
    if not fresh.isEmpty():
        rows = make(fresh).select(*schema.fieldNames()).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/made")


def make_once(requests: DataFrame, key: str, order: list[str], make: Callable[[DataFrame], DataFrame], folder: str, schema: StructType) -> StreamingQuery:
    """Run ``make`` (rows of ``schema``, one for each request it gets) once for each key of a stream of requests.

    ``make`` may be costly and may answer differently each time, as a model
    does; what is stored first is kept. Results are read by ``stored``; those
    of repeated requests are a join with it.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], StructType([*schema.fields]).add("batch", LongType())).write.mode("append").partitionBy("batch").parquet(f"{folder}/made")

    def write(batch: DataFrame, number: int) -> None:
        with scratch(spark):
            commit(materialise(batch, "requests"), number, key, order, make, folder, schema)

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
