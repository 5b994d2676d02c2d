"""Heap that finished work leaves in executors (here: the driver's JVM) when a stage of the pipeline begins."""

import corpus_pipeline
import pytest


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_begins_with_a_small_heap(spark, monkeypatch, name, stage):
    for operator in ("train", "keep_identified", "keep_good", "keep_one", "pack_documents"):
        monkeypatch.setattr(corpus_pipeline, operator, lambda docs, *a: docs)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().totalMemory
    spark.range(0, 8, 1, 8).selectExpr("length(concat(repeat(cast(id as string), 100000000), 'x'))").collect()
    filled = heap()
    docs = spark.createDataFrame([(1, "some words", "en", "web")], "doc_id long, text string, lang string, source string")
    assert stage(spark, docs, "").count() == 1
    assert filled > 1 << 30 and heap() < filled - (256 << 20)
