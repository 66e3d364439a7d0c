"""The pipeline's stages, one on another, and the registry."""

import os

import pytest

import corpus_pipeline
from palimpsest.llm import registry

SMALL = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]


def test_registry():
    names = registry.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) < set(names)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids, kept = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) <= ids
        ids, kept = set(got), spark.createDataFrame(out.collect(), docs.schema)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SMALL)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= ids and max(counts.values()) <= 3
    last = corpus_pipeline.run(spark, SMALL)
    assert set(docs.columns) < set(last.columns)
    assert {r.doc_id for r in last.select("doc_id").collect()} == set(counts)


def test_stages_keep_clashing_columns(spark, tmp_path):
    rows = [(i, "some words of text number " + str(i) + " " + "and more of it " * (i % 7), "en", "s" + str(i % 2), 10, 1.0, 2, "x", 3, 4) for i in range(40)] + [(None, None, None, None, None, None, None, None, None, None), (50, "", "en", "s0", 0, 0.5, 1, "y", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, row string, words int, id int")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        out.count()
