"""Vectors in blocks: rows of a table packed into matrices, and query blocks dealt to them.

A block is one row with the carried columns as arrays and its vectors as one
binary matrix, so a task compares thousands of vectors by one matrix product
and never holds more than a block of either side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from postmill.session import materialise

#: Vectors of a block of the searched table and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 2048, 512
#: Query blocks that one block meets in one task.
WAVE = 64
#: Most shuffle partitions of a meeting; more keys than that share one.
MOST_PARTITIONS = 20_000


def dense(vectors: pa.ListArray, kind: str) -> np.ndarray:
    """Rows of a matrix; shorter vectors end in zeros. ``int`` takes the narrowest integers that hold all values."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if kind == "int":
        values = values.astype(np.int64)
        low, high = int(values.min(initial=0)), int(values.max(initial=0))
        kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), kind)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def packer(carry: int, order: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        table = table.take(pc.sort_indices(table, [(order, "ascending")])).combine_chunks()
        matrix = dense(table.column(carry).chunk(0), kind)
        offsets = pa.array([0, len(table)], pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, table.column(i).chunk(0)) for i in range(carry)]
        single = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.dtype.name]), pa.array([matrix.tobytes()], pa.binary())]
        names = ["block", "dim", "kind", "matrix"]
        yield pa.RecordBatch.from_arrays(single + arrays, names=names + table.schema.names[:carry])

    return run


def packed(df: DataFrame, carry: list[str], vector: str, order: str, rows: int, kind: str) -> tuple[DataFrame, int]:
    """``df`` as blocks of about ``rows`` vectors, in the order of one carried column (nulls last), and their number.

    ``kind`` is a floating dtype or ``int``. Columns: block, dim, kind, matrix and the carried ones as arrays.
    """
    count = max(1, math.ceil(df.count() / rows))
    schema = StructType.fromDDL("block int, dim int, kind string, matrix binary")
    for name in carry:
        schema = schema.add(name, ArrayType(df.schema[name].dataType))
    return df.select(*carry, vector).repartition(count).mapInArrow(packer(len(carry), order, kind), schema), count


def pack(df: DataFrame, carry: list[str], vector: str, order: str, rows: int, kind: str, label: str) -> tuple[DataFrame, int]:
    """``packed`` blocks, written to the shared folder."""
    blocks, count = packed(df, carry, vector, order, rows, kind)
    return materialise(blocks, label), count


def matrix_of(row: dict, prefix: str = "") -> np.ndarray:
    """The vectors of a block, read without a copy."""
    flat = np.frombuffer(row[f"{prefix}matrix"], row[f"{prefix}kind"])
    return flat.reshape(-1, row[f"{prefix}dim"]) if row[f"{prefix}dim"] else np.zeros((len(row[f"{prefix}id"]), 0), row[f"{prefix}kind"])


def meet(blocks: DataFrame, n_blocks: int, queries: DataFrame, n_queries: int) -> DataFrame:
    """Every block with every query block (columns ``q_...``), one row each.

    An equality join on block and wave of query blocks, so that a task's work
    is bounded: neither side is broadcast or passes the driver.
    """
    waves = math.ceil(n_queries / WAVE)
    left = blocks.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    right = right.withColumn("wave", F.floor(F.col("q_block") / WAVE).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    parts = min(MOST_PARTITIONS, n_blocks * waves)
    return left.repartition(parts, "block", "wave").join(right.repartition(parts, "block", "wave"), ["block", "wave"])


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch of block pairs: binaries as buffers, arrays as Arrow arrays, numbers as such."""
    for i in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            value = column[i]
            row[name] = value.values if pa.types.is_list(column.type) else value.as_buffer() if pa.types.is_binary(column.type) else value.as_py()
        yield row


def best_of(many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query of a pair of blocks, the ``many`` vectors of highest inner product; ties go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                block, queries = matrix_of(row), matrix_of(row, "q_")
                dim = max(block.shape[1], queries.shape[1])
                block, queries = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (block, queries))
                scores = (queries @ block.T).astype(np.float64)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :many]  # rows of a block stand in the order of ids
                asked = np.repeat(np.arange(len(queries)), order.shape[1])
                values = np.take_along_axis(scores, order, axis=1).ravel()
                columns = [row["q_id"].take(pa.array(asked)), row["id"].take(pa.array(order.ravel())), pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def nearest(blocks: DataFrame, n_blocks: int, queries: DataFrame, n_queries: int, k: int, id_types: tuple[str, str]) -> DataFrame:
    """query_id, vec_id, score and rank of the ``k`` best vectors of blocks for each query; ids are unique."""
    found = meet(blocks, n_blocks, queries, n_queries).mapInArrow(best_of(k), f"query_id {id_types[0]}, vec_id {id_types[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors as int64: exact, held at the ends of the 64-bit range where they leave it."""
    dim = max(left.shape[1], right.shape[1])
    wide = [np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (left, right)]
    most = dim * int(np.abs(wide[0].astype(float)).max(initial=0)) * int(np.abs(wide[1].astype(float)).max(initial=0))
    if most < 1 << 53:
        return (wide[0].astype(np.float64) @ wide[1].astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return wide[0].astype(np.int64) @ wide[1].astype(np.int64).T
    limit = (1 << 63) - 1
    return np.clip(wide[0].astype(object) @ wide[1].astype(object).T, -limit, limit).astype(np.int64)
