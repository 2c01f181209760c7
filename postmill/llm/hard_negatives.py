"""Hard negatives of anchors, by a full sort of the scores of each anchor.

Vectors become whole numbers floor(scale * x), so that scores are exact integer
inner products. Vectors are packed into blocks in id order; every anchor meets
every block. There its scores with all vectors of the block are sorted, higher
first and ties by smaller id. The first pass reads the leading vectors of the
anchor's label; the best of all blocks are its positives. The second pass
finds in the sorted scores, by binary search, where the scores begin that a
positive's upper limit allows, and reads vectors of another label from there,
while they are above the lower limit. A block returns as many rows as the whole
result may have, so what is merged is bounded by blocks, not by rows.

Rows with a null label or vector, or with a null or non-finite component, take
no part. A null id is a row too: it is no anchor and comes last among ties.
Equal rows are rows of their own, and an anchor leaves out itself alone, not
its copies. Shorter vectors count as ended by zeros. Components and scores
beyond 64 bits are held at the ends of the range. Without anchors, positives or
other labels there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import let_workers_import
from postmill.operators.blocks import BLOCK_ROWS, QUERY_ROWS, matrix_of, meet, pack, products, rows_of

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's must be.
LOWER, UPPER = 50, 95
#: Anchors whose scores are held at a time.
SLICE = 64


def whole_vectors(rows: DataFrame, ident: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """id, label, anchor and whole-numbered vector of the rows that take part."""
    x = lambda v: v.cast("double")
    usable = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    fit = rows.where(F.col(vector).isNotNull() & usable).select(
        F.col(ident).alias("id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(vector, lambda v: F.floor(SCALE * x(v))).alias("vector")
    )
    return fit.where("label IS NOT NULL")


ANCHOR_DDL = "home int, place int, id {id}, label {label}, vector array<long>"


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of blocks, with their block and place in it."""
    for batch in batches:
        for row in rows_of(batch):
            at = np.flatnonzero(row["anchor"].to_numpy(zero_copy_only=False))
            if len(at):
                own = matrix_of(row)[at].astype(np.int64)
                offsets = pa.array(np.arange(len(at) + 1) * own.shape[1], pa.int32())
                columns = [np.full(len(at), row["block"], np.int32), at.astype(np.int32), row["id"].take(pa.array(at)), row["label"].take(pa.array(at)), pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["home", "place", "id", "label", "vector"])


def codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of labels as numbers, equal for equal labels."""
    both = pa.concat_arrays([left, right]).dictionary_encode().indices.to_numpy()
    return both[: len(left)], both[len(left) :]


def sorted_scores(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a pair of blocks: its place, the block's order by score and id, the scores in that order, and whether labels are its own."""
    block, anchors = matrix_of(row), matrix_of(row, "q_")
    labels, own = codes(row["label"], row["q_label"])
    for begin in range(0, len(anchors), SLICE):
        scores = products(anchors[begin : begin + SLICE], block)
        orders = np.argsort(-scores, axis=1, kind="stable")  # rows of a block stand in the order of ids
        for k in range(len(scores)):
            order = orders[k]
            yield begin + k, order, scores[k][order], labels[order] == own[begin + k]


def leading_positives(many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first vectors of each anchor's label in each block, the anchor itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                home, place = row["q_home"].to_numpy(), row["q_place"].to_numpy()
                rows, picked, values = [], [], []
                for k, order, scores, same in sorted_scores(row):
                    at = np.flatnonzero(same)[: many + 1]
                    if home[k] == row["block"]:
                        at = at[order[at] != place[k]]
                    at = at[:many]
                    rows.append(np.full(len(at), k))
                    picked.append(order[at])
                    values.append(scores[at])
                rows, picked, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, picked, values))
                columns = [pa.array(np.full(len(rows), row["q_block"], np.int32)), pa.array(rows.astype(np.int32)), row["id"].take(pa.array(picked)), pa.array(values.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["q_block", "q_row", "id", "score"])

    return run


def negatives_within(many: int, lower: int, upper: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first vectors of another label within the limits of each positive, in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                wanted: dict[int, list[tuple[int, int]]] = {}
                for k, p in enumerate(row["positives"].to_pylist()):
                    wanted.setdefault(p["q_row"], []).append((k, p["score"]))
                which, picked, values = [], [], []
                for k, order, scores, same in sorted_scores(row):
                    if k in wanted:
                        other = np.flatnonzero(~same)
                        falling = -scores[other]
                        for p, score in wanted[k]:
                            least, most = -(-lower * score // 100), upper * score // 100
                            if least <= most:
                                begin = np.searchsorted(falling, -most)
                                at = other[begin : begin + many]
                                at = at[scores[at] >= least]
                                which.append(np.full(len(at), p))
                                picked.append(order[at])
                                values.append(scores[at])
                which, picked, values = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (which, picked, values))
                positives = row["positives"].take(pa.array(which))
                columns = [row["q_id"].take(positives.field("q_row")), positives.field("q_row"), positives.field("position"), positives.field("id"), positives.field("score"), row["id"].take(pa.array(picked)), pa.array(values)]
                names = ["anchor_id", "q_row", "position", "positive_id", "positive_score", "negative_id", "negative_score"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), row["q_block"], np.int32)), *columns], names=["q_block", *names])

    return run


def mine(
    rows: DataFrame, ident: str, vector: str, label: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``rows``."""
    let_workers_import(rows.sparkSession)
    fit = whole_vectors(rows, ident, vector, label, anchor)
    id_type, label_type = fit.schema["id"].dataType.simpleString(), fit.schema["label"].dataType.simpleString()
    blocks, n_blocks = pack(fit, ["id", "label", "anchor"], "vector", "id", BLOCK_ROWS, "int", "vector-blocks")
    chosen = blocks.mapInArrow(anchors_of, ANCHOR_DDL.format(id=id_type, label=label_type))
    queries, n_queries = pack(chosen, ["home", "place", "id", "label"], "vector", "id", QUERY_ROWS, "int", "anchor-blocks")
    blocks = blocks.drop("anchor")

    leading = meet(blocks, n_blocks, queries, n_queries).mapInArrow(leading_positives(positives), f"q_block int, q_row int, id {id_type}, score long")
    by_score = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = leading.withColumn("position", F.row_number().over(by_score)).where(F.col("position") <= positives)
    listed = best.groupBy(F.col("q_block").alias("block")).agg(F.collect_list(F.struct("q_row", "position", "id", "score")).alias("positives"))

    met = meet(blocks, n_blocks, queries.join(listed, "block"), n_queries).withColumnRenamed("q_positives", "positives")
    schema = f"q_block int, anchor_id {id_type}, q_row int, position int, positive_id {id_type}, positive_score long, negative_id {id_type}, negative_score long"
    found = met.mapInArrow(negatives_within(negatives, lower, upper), schema)
    by_score = Window.partitionBy("q_block", "q_row", "position").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
