"""The pipeline's stages, one by one on what the stage before kept."""

import corpus_pipeline
from factorspark.llm import decontam, near_join

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        assert docs.join(before, columns).count() == docs.count() > 0  # rows of the stage before, unchanged
        sizes.append(docs.count())
        if name == "near_duplicates":
            again = near_join.near_duplicates(docs).collect()
            assert all(r["component_id"] == r["doc_id"] for r in again)
            groups = near_join.near_duplicates(before).collect()
            assert {r["component_id"] for r in groups} == {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "decontamination":
            items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
            assert decontam.contaminated(docs, items).count() == 0
            hit = {r["doc_id"] for r in decontam.contaminated(before, items).collect()}
            assert before.count() - docs.count() == len(hit) > 0
    assert sizes[3] < sizes[2] < sizes[1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None
