"""A stored vector index with its documents, and the keyed tables it is built from."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import prompts as P
from postmill.operators.blocks import BLOCK_ROWS, QUERY_ROWS, nearest, pack, packed
from postmill.operators.retrieval import unit_vectors

# Where a policy record without a source is filed, and its kind.
POLICY_SOURCE, POLICY_KIND = "policy_dataset", "policy_jsonl"


class IndexShapeError(ValueError):
    """Vectors, documents and manifest do not fit each other."""


@dataclass(frozen=True)
class Manifest:
    """What an index says about itself: a row of JSON beside its blocks."""

    model: str
    provider: str
    ident: str
    dimensions: int
    vectors: int
    blocks: int


@dataclass(frozen=True)
class Index:
    manifest: Manifest
    blocks: DataFrame
    documents: DataFrame


def write_index(documents: DataFrame, path: str, model: str, provider: str, ident: str = "id", embedding: str = "embedding") -> Manifest:
    """Write documents (ident, embedding and any columns) as an index and return its manifest.

    Blocks of normalised 32-bit vectors, the documents without their vectors,
    and the manifest, written last, so that an index that broke off has none.
    Vectors of different lengths, null ones and repeated ids are errors.
    """
    spark = documents.sparkSession
    size = F.size(embedding)
    whole = F.col(embedding).isNotNull() & F.forall(F.coalesce(embedding, F.array().cast(documents.schema[embedding].dataType)), lambda x: x.isNotNull())
    seen = documents.agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.count_if(~whole).alias("broken")).first()
    repeated = documents.groupBy(ident).count().where(F.col("count") > 1).limit(1).count()
    if seen["broken"] or seen["low"] != seen["high"] or repeated:
        raise IndexShapeError(f"{seen['broken']} broken vectors, lengths {seen['low']} to {seen['high']}, {'repeated' if repeated else 'no repeated'} ids")
    blocks, count = packed(unit_vectors(documents, ident, embedding), ["id"], "vector", "id", BLOCK_ROWS, "float32")
    manifest = Manifest(model, provider, ident, seen["high"] or 0, seen["n"], count)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    documents.drop(embedding).write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``, checked against its manifest."""
    manifest = Manifest(**json.loads(spark.read.text(f"{path}/manifest").first()["value"]))
    blocks, documents = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/documents")
    seen = blocks.agg(F.coalesce(F.sum(F.size("id")), F.lit(0)).alias("n"), F.count_if(F.col("dim") != manifest.dimensions).alias("odd")).first()
    held = documents.count()
    if seen["odd"] or seen["n"] != manifest.vectors or held != manifest.vectors:
        raise IndexShapeError(f"{seen['odd']} blocks of other dimensions, {seen['n']} vectors and {held} documents for {manifest.vectors}")
    return Index(manifest, blocks, documents)


def search(index: Index, queries: DataFrame, k: int, ident: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, score and the document's columns of the ``k`` nearest documents; queries of another length are an error."""
    other = queries.where(F.col(embedding).isNull() | (F.size(embedding) != index.manifest.dimensions)).limit(1).count()
    if other:
        raise IndexShapeError(f"a query has not {index.manifest.dimensions} dimensions")
    asked, n_asked = pack(unit_vectors(queries, ident, embedding), ["id"], "vector", "id", QUERY_ROWS, "float32", "index-queries")
    kinds = (queries.schema[ident].dataType.simpleString(), index.blocks.schema["id"].dataType.elementType.simpleString())
    hits = nearest(index.blocks, index.manifest.blocks, asked, n_asked, k, kinds)
    own = index.manifest.ident
    return hits.join(index.documents.withColumnRenamed(own, "vec_id"), "vec_id").withColumnRenamed("vec_id", own)


def policy_metadata(rows: DataFrame, index: str, path: str) -> DataFrame:
    """``rows`` (policy records with their number ``index``) with ``metadata``, what a vector needs to be traced back."""
    text = lambda name: P.as_text(F.col(name))
    given = lambda name: F.coalesce(F.col(name), F.lit(""))
    source = F.coalesce(F.nullif(text("source_id"), F.lit("")), F.lit(POLICY_SOURCE))
    categories = P.as_list(F.col("policy_categories"))
    number = F.col(index).cast("int")
    fields = {
        "index": number, "source_kind": F.lit(POLICY_KIND), "source_id": source, "session_id": F.concat(source, F.lit(":"), number.cast("string")), "dialogue_id": number, "turn_count": F.lit(1),
        "title": text("title"), "company": given("company"), "url": text("url"), "published_at": given("published_at"), "policy_categories": categories, "intents": categories,
        "insurance_available": F.coalesce("insurance_available", F.lit(False)), "insurance_type": given("insurance_type"), "compensation_limit": given("compensation_limit"),
        "claim_deadline": given("claim_deadline"), "source_path": F.lit(path),
    }
    return rows.withColumn("metadata", F.struct(*[c.alias(n) for n, c in fields.items()]))


def source_key(split: Column, index: Column, session: Column, dialogue: Column) -> Column:
    return F.concat_ws(":", split, index.cast("string"), session, dialogue.cast("string"))


def policy_documents(rows: DataFrame, index: str, path: str) -> DataFrame:
    """Policy records as documents: key, split, index, content and metadata."""
    marked = policy_metadata(rows, index, path)
    names = ["company", "title", "policy_categories", "summary", "evidence_text", "requirements", "compensation_limit", "claim_deadline", "insurance_exclusions", "url"]
    content = P.policy_document(*[F.col(n) for n in names])
    m = F.col("metadata")
    key = source_key(F.lit("policy"), m["index"], m["session_id"], m["dialogue_id"])
    return marked.select(key.alias("key"), F.lit("policy").alias("split"), m["index"].alias("index"), content.alias("content"), F.to_json("metadata").alias("metadata"))


def dialogue_documents(dialogues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Selected dialogues (split, index, session_id, dialogue_id, qa, turns) as documents like ``policy_documents``."""
    chosen = dialogues.join(verdicts.where("selected").select("split", "index"), ["split", "index"], "left_semi")
    content = P.dialogue_document(F.col("session_id"), F.col("dialogue_id"), F.col("qa"), F.col("turns"))
    intents = F.filter(F.transform("qa", lambda x: x["intent"]), lambda v: F.coalesce(v, F.lit("")) != "")
    meta = F.to_json(F.struct(F.col("index"), "session_id", "dialogue_id", F.size("turns").alias("turn_count"), intents.alias("intents")))
    return chosen.select(source_key(F.col("split"), F.col("index"), F.col("session_id"), F.col("dialogue_id")).alias("key"), "split", "index", content.alias("content"), meta.alias("metadata"))


def keyed_vectors(vectors: DataFrame, metadata: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (split, index, session_id, dialogue_id) with their stored vectors.

    ``vectors`` has split, index and embedding, ``metadata`` the rows of
    ``embedding_metadata``. A key without metadata or vector, or whose ids are
    not those of the metadata at its place, makes the query fail.
    """
    at = metadata.select("split", F.col("pos").alias("index"), *[F.col(n).alias(f"m_{n}") for n in ("index", "session_id", "dialogue_id")])
    joined = keys.join(at, ["split", "index"], "left").join(vectors.select("split", "index", "embedding"), ["split", "index"], "left")
    place = F.concat(F.col("split"), F.lit("["), F.col("index").cast("string"), F.lit("] "))
    wrong = F.lit(None).cast("string")
    for name in ("dialogue_id", "session_id", "index"):
        wrong = F.when(~F.col(name).eqNullSafe(F.col(f"m_{name}")), F.lit(f"metadata {name} mismatch")).otherwise(wrong)
    wrong = F.when(F.col("embedding").isNull(), F.lit("no vector")).otherwise(wrong)
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(place, wrong)).cast(vectors.schema["embedding"].dataType)).otherwise(F.col("embedding"))
    return joined.select(*keys.columns, checked.alias("embedding"))
