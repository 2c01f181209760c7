"""Ordered deduplication."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators.graph import connected_components
from postmill.session import fresh_path, materialise

#: Rounds before what is left is looked at by components, and the rows of a component that one task decides.
ROUNDS, COMPONENT_ROWS = 5, 50_000


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key combination, by ``order``."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(ranked)).where("__n = 1").drop("__n")


def by_content(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """doc_id, content hash, number of copies and first copy; hot texts combine on the map side."""
    hashed = docs.select(order, T.content_hash(F.coalesce(text, F.lit(""))).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(order).alias("first_id"))


def decided_whole(rows: pa.Table) -> pa.Table:
    """The ordinals that a loop over the rows of a few whole components drops."""
    seen: tuple[set, set] = set(), set()
    gone = []
    for at, *keys in sorted(zip(*(rows.column(c).to_pylist() for c in ("__o", "__u", "__f")), strict=True), key=lambda r: r[0]):
        if any(k is not None and k in known for k, known in zip(keys, seen, strict=True)):
            gone.append(at)
        else:
            for k, known in zip(keys, seen, strict=True):
                known.add(k)
    return pa.table({"__o": pa.array(gone, rows.schema.field("__o").type)})


def by_component(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ordinals dropped in components of at most ``COMPONENT_ROWS`` rows, and the rows of larger ones."""
    node = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c))
    rows = undecided.withColumn("__un", node("__u")).withColumn("__fn", node("__f"))
    labels = connected_components(rows.select(F.col("__un").alias("src"), F.col("__fn").alias("dst")))
    labelled = rows.withColumn("__node", F.coalesce("__un", "__fn")).join(labels, F.col("__node") == F.col("node"), "left").withColumn("__c", F.coalesce("component", "__node"))
    sizes = labelled.groupBy("__c").agg(F.count("*").alias("__n"))
    sized = materialise(labelled.select("__o", "__u", "__f", "__c").join(sizes, "__c"), "unseen-components")
    small = sized.where(F.col("__n") <= COMPONENT_ROWS)
    gone = small.groupBy("__c").applyInArrow(decided_whole, undecided.select("__o").schema)
    return gone, sized.where(F.col("__n") > COMPONENT_ROWS).select("__o", "__u", "__f")


def keep_unseen(rows: DataFrame, ordinal: str, url: str, fingerprint: str) -> DataFrame:
    """Drop a row whose url or fingerprint equals that of an earlier *kept* row.

    Dropped rows register nothing, so the choice is sequential, but it can be
    made in rounds: an undecided row that is the least of both its groups is
    kept, since every earlier row of them is decided; the others of those groups
    are dropped; the rest goes into the next round. Minima combine on the map
    side and the joins are on keys that Spark can split, so a hot value never
    meets one task. Rounds decide most rows at once but advance a chain of
    choices that wait for each other by one link only, so after every ``ROUNDS``
    of them what is left is cut into connected components, and those of at most
    ``COMPONENT_ROWS`` rows are decided whole, each in a task. Null values equal
    nothing; an empty table gives an empty result. ``ordinal`` must be unique
    and not null.
    """
    digest = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    undecided = materialise(rows.select(F.col(ordinal).alias("__o"), digest(url).alias("__u"), digest(fingerprint).alias("__f")), "unseen")
    spark = rows.sparkSession
    dropped = fresh_path(spark, "unseen-dropped")
    undecided.where("false").select("__o").write.parquet(dropped)
    for number in itertools.count(1):
        if undecided.isEmpty():
            break
        if number % ROUNDS == 0:
            small, undecided = by_component(undecided)
            small.write.mode("append").parquet(dropped)
        state = undecided
        for key, low in (("__u", "__least_u"), ("__f", "__least_f")):
            least = undecided.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__o").alias(low))
            state = state.join(least, key, "left")
        first = (F.coalesce("__least_u", "__o") == F.col("__o")) & (F.coalesce("__least_f", "__o") == F.col("__o"))
        state = materialise(state.select("__o", "__u", "__f", first.alias("__kept")), "unseen-round")
        kept, rest = state.where("__kept"), state.where("NOT __kept").drop("__kept")
        for key in ("__u", "__f"):  # a kept row is the only one of its group
            rest = rest.join(kept.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(f"{key}_seen")), key, "left")
        rest = materialise(rest.withColumn("__drop", F.coalesce("__u_seen", "__f_seen", F.lit(False))), "unseen-rest")
        rest.where("__drop").select("__o").write.mode("append").parquet(dropped)
        undecided = rest.where("NOT __drop").select("__o", "__u", "__f")
    gone = spark.read.schema(undecided.select("__o").schema).parquet(dropped)
    return rows.join(gone, F.col(ordinal) == F.col("__o"), "left_anti")
