import corpus_pipeline
from postmill.llm import decontaminate, jaccard_join


def test_stages_take_effect_one_after_the_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs)
    toxic, single, clean, mixed = kept
    assert jaccard_join.jaccard_links(single).where("n_links > 0").count() == 0
    assert decontaminate.benchmark_hits(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert single.count() < toxic.count() and clean.count() < single.count()
    tokens = corpus_pipeline.STAGES[-1][1](spark, mixed, sf)
    assert tokens.count() == mixed.count() == corpus_pipeline.run(spark, sf).count()
