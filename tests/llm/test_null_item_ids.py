"""Benchmark items without an id."""

import hashlib

import pytest

from palimpsest.llm import decontaminate

PASSAGE = " ".join(f"w{k}" for k in range(20))


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 30])
def test_items_without_an_id_hit(spark, chunk_bytes):
    docs = spark.createDataFrame([(1, "a b " + PASSAGE), (2, "a b c"), (3, PASSAGE + " of seven")], "doc_id long, text string")
    items = spark.createDataFrame([(None, PASSAGE), (7, "of seven"), (None, None)], "item_id long, text string")
    found = decontaminate.judge(decontaminate.search_benchmark(docs, items, chunk_bytes=chunk_bytes))
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (20, 0, sha(""), True), 2: (0, 0, sha(""), False), 3: (22, 1, sha("7"), True)}


def test_the_stage_drops_what_holds_an_item_without_an_id(spark, tmp_path):
    spark.createDataFrame([(None, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "a b " + PASSAGE), (2, "a b c")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.stage(spark, docs, str(tmp_path)).collect()] == [2]
