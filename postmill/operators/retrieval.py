"""Exact vector retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.blocks import BLOCK_ROWS, QUERY_ROWS, nearest, pack


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(a)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(a, lambda x: x.cast("double") / safe)


def unit_vectors(rows: DataFrame, ident: str, embedding: str = "embedding") -> DataFrame:
    """id and vector of length one; null components count as zeros."""
    filled = F.transform(F.coalesce(embedding, F.array().cast(rows.schema[embedding].dataType)), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return rows.select(F.col(ident).alias("id"), normalised(filled).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` vectors of highest cosine for each query: query_id, vec_id, score, rank.

    ``vectors`` has vec_id and embedding, ``queries`` query_id and embedding;
    ids are unique. Both are packed into blocks of normalised vectors, and each
    pair of blocks is one matrix product that returns k vectors a query, so
    neither side is broadcast. Scores are not rounded before they are ranked.
    Ties go to the smaller vec_id; a zero or null vector scores 0, shorter
    vectors count as ended by zeros; fewer than k vectors give fewer rows.
    """
    blocks, n_blocks = pack(unit_vectors(vectors, "vec_id"), ["id"], "vector", "id", BLOCK_ROWS, "float64", "vectors")
    asked, n_asked = pack(unit_vectors(queries, "query_id"), ["id"], "vector", "id", QUERY_ROWS, "float64", "queries")
    return nearest(blocks, n_blocks, asked, n_asked, k, (queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()))


def with_documents(hits: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Hits of a search (query_id, vec_id, score, rank) with the document of each; those without one are left out.

    ``docs`` is joined after the best were chosen, so only k rows a query meet it.
    """
    return hits.join(docs, hits["vec_id"] == docs[key])


def union_documents(first: DataFrame, second: DataFrame, ordinal: str) -> DataFrame:
    """Both document sets as one, the second's ordinals (from 0) after the first's rows."""
    return first.unionByName(second.withColumn(ordinal, F.col(ordinal) + F.lit(first.count())))


def first_documents(docs: DataFrame, n: int, kind: str, ordinal: str) -> DataFrame:
    """The first ``n`` rows in the order of kind and ordinal, a limit that callers ask for."""
    return docs.orderBy(kind, ordinal).limit(n)
