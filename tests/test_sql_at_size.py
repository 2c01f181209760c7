"""Cases in which queries once differed from their SQL, or took too long, on larger tables."""

from pyspark.sql import functions as F

from postmill.catalogue import ORACLE, QUERIES
from postmill.sources import adapters
from postmill.streaming import unseen
from tests.oracle import connect, differences

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, folder, rows):
    """An events table of (event_id, user_id, value)."""
    made = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    made.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props").coalesce(1).toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return str(folder)


def test_a_stream_keeps_unseen_rows_without_state_or_python(spark, tmp_path):
    schema = "i long, u string, p string"
    inbox = f"{tmp_path}/in"
    spark.range(100).selectExpr("id AS i", "concat('u', id % 40) AS u", "concat('p', id % 30) AS p").write.parquet(inbox)
    query = unseen.keep_unseen_stream(spark.readStream.schema(schema).parquet(inbox), "i", "u", "p", f"{tmp_path}/out")
    query.processAllAvailable()
    ran = [p for p in query.recentProgress if p.numInputRows]
    query.stop()
    assert ran and not any(p.stateOperators for p in ran)
    assert sorted(r.i for r in unseen.kept_rows(spark, f"{tmp_path}/out").collect()) == list(range(30))


def test_losses_round_as_sql_does(spark, tmp_path):
    values = [0.29, 1.25, 17.49, 17.47, 8.11, 0.01, 1e9, *(k / 100 for k in range(1, 2000, 10))]
    rows = [(5 * user + kind, user, value) for user, value in enumerate(values) for kind in (0, 1)]
    sf = events(spark, tmp_path, rows)
    assert differences(QUERIES["eval_loss"](spark, sf), ORACLE["eval_loss"], connect(sf)) == []


def test_the_best_of_a_label_that_comes_in_many_parts(spark, tmp_path):
    rows = [(4000 + (k * 37) % 101, k % 2, float((k * 53) % 89)) for k in range(101)]
    sf = events(spark, tmp_path, rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 3)
    try:
        assert differences(QUERIES["events_stream_best"](spark, sf), ORACLE["events_stream_best"], connect(sf)) == []
    finally:
        spark.conf.set(size, before)


def test_pages_that_differ_behind_their_summary_are_no_repeats(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    kept = QUERIES["pages_stream_fetches"](spark, sf).orderBy("page_id").first()["page_id"]
    copies = pages.where(F.col("page_id") == kept).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    more = copies.select((11 * 1000 + F.col("k")).cast("long").alias("page_id"), F.concat("url", F.lit("/other/"), F.col("k").cast("string")).alias("url"), F.concat("html", F.lit(" at the end "), F.least("k", F.lit(2)).cast("string")).alias("html"))
    pages.unionByName(more).coalesce(1).toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["pages_stream_fetches"](spark, str(tmp_path))
    assert differences(found, ORACLE["pages_stream_fetches"], connect(str(tmp_path))) == []
    assert {r.page_id for r in found.where("page_id > 11000").collect()} == {11001, 11002}


def test_a_model_gets_texts_in_slices(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 100 <> 0 THEN repeat('x', 20) END AS text").coalesce(1)
    found = adapters.embed(rows, "text", lambda texts: [[float(len(texts)), float(sum(t is None for t in texts))]] * len(texts), 2)
    got = found.selectExpr("id", "text", "embedding[0] AS n").collect()
    assert sorted((r.id, r.text) for r in got) == [(i, "x" * 20 if i % 100 else None) for i in range(3000)]
    assert max(r.n for r in got) <= adapters.SLICE_ROWS


def test_answers_of_a_slice_keep_to_the_batch_and_the_bytes(spark):
    rows = spark.range(100).selectExpr("id", "repeat('y', 600000) AS text").coalesce(1)
    found = adapters.generate(rows, "text", lambda prompts: [str(len(prompts))] * len(prompts)).selectExpr("id", "length(text) AS n", "output", "error").collect()
    assert sorted((r.id, r.n, r.output, r.error) for r in found) == [(i, 600000, "8" if i < 96 else "4", None) for i in range(100)]
    import pyarrow as pa

    cut = [len(s) for s in adapters.in_slices(pa.record_batch({"text": ["z" * 600000] * 20}), "text", 8)]
    assert cut == [8, 8, 4]
