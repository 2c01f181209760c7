"""Session construction and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: The scratch folder of the work going on in this thread.
SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def build_session(master: str = "local[8]", app: str = "postmill", **extra: str) -> SparkSession:
    """A session with UTC times, AQE and Arrow, as the queries expect."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
    }
    conf.update(extra)
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a local session has none (tests) a temporary folder of this
    machine is made and remembered in the session; on a cluster that is an error.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="postmill-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, or in the scratch folder that is open."""
    return f"{SCRATCH.get() or f'{shared_dir(spark)}/postmill'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; for work whose results are written elsewhere, as each batch of a stream."""
    folder = fresh_path(spark, "scratch")
    before = SCRATCH.set(folder)
    try:
        yield
    finally:
        SCRATCH.reset(before)
        drop_path(spark, folder)


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
