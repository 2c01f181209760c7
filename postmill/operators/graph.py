"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return (
        both.join(least, "src")
        .where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    hop = down.join(least, "src")
    return (
        hop.select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .union(least.select("src", F.col("low").alias("dst")))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Label the nodes of an undirected edge list with their smallest member.

    ``edges`` has the columns src and dst of one ordered type. Returns node and
    component, one row for each node that has an edge to another node; rows with
    a null end or equal ends are ignored, repeated edges count once, and an
    empty input gives an empty result. Minima are combined on the map side, so
    a hub node costs no more than its edges. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of a
    component's diameter.
    """
    current = materialise(
        edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), "cc"
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        current = materialise(_small_star(_large_star(current)), "cc")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
            )
        seen = state
    raise RuntimeError("connected components did not settle")
