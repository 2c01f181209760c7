"""Running totals and neighbours over hot groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``bucket`` and then by ``order``. Only one bucket of a
    group is ever sorted in one task; the buckets' own totals, one row each,
    are accumulated in a second, small window. Group columns compare null-safe.
    """
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__total"))
    ahead = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
        F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__total").over(ahead), F.lit(0)).alias("__base"),
    )
    on = F.col(bucket).eqNullSafe(F.col("__b"))
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = df.withColumn("__in", F.coalesce(F.sum(value).over(local), F.lit(0))).join(base, on, "left")
    return out.withColumn(name, (F.col("__in") + F.col("__base")).cast("long")).drop(
        "__in", "__base", "__b", *[f"__g{i}" for i in range(len(group))]
    )


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 ascending cut points of an integer column, nulls left out.

    They come from one approximate-quantile aggregate over all rows; the driver
    gets as many numbers as there are buckets, whatever the input.
    """
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column, at, 20 * buckets).alias("q")).first()
    return sorted(set(row["q"] or []))


def range_bucket(column: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` not above the value, by binary search; null goes to 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    steps, step = [], 1
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    found = F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(bounds)) & (F.element_at(cuts, F.least(at + s, F.lit(len(bounds)))) <= column), at + s
        ).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))
