import os

import pytest

import corpus_pipeline

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before, items = docs.columns, docs.count(), [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, D).cache()
        assert new.columns == columns and new.count() <= docs.count()
        if name == "decontamination":
            assert not [r for r in new.collect() if any(x in r["text"] for x in items)]
        docs = new
    assert docs.count() > 0.7 * before
    packed = corpus_pipeline.run(spark, D).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
