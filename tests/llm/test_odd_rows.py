"""Clashing column names, very long texts, ties and empty tables, operator by operator."""

import numpy as np
import pytest

from palimpsest.llm import decontaminate, minhash, mixing, pivots, quality, repeats, sharding, toxicity

CLASH = ["row", "id", "key", "score", "predicted", "n_words", "hit_spans", "items", "number", "copies", "shard", "component_id", "kept", "n_links", "n_removed", "dropped", "words", "of"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, None, None), (4, "", "b"), (None, "seven", "b"), (2, "one two three four five six", "a")]
    return spark.createDataFrame([(*r, *[f"c{k}" for k in range(len(CLASH))]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))


def test_clashing_names(spark, docs):
    assert minhash.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(r.component_id or 0 for r in minhash.near_duplicates(docs).collect()) == [0, 1, 1, 1, 3, 4]
    assert repeats.remove_repeats(docs).count() == 6
    sharded = sharding.assign_shards(docs)
    assert sharded.count() == 6 and set(sharded.columns) == set(docs.columns) | set(sharding.ADDED)
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    for chunk in (1 << 20, 4):
        found = decontaminate.judge(decontaminate.search_benchmark(docs, bench, chunk_bytes=chunk))
        assert {(r.doc_id, r.n_hit, r.row) for r in found.collect()} == {(1, 2, "c0"), (2, 2, "c0"), (3, 0, "c0"), (4, 0, "c0"), (None, 0, "c0")} and len(found.columns) == len(set(found.columns))
    for module in (quality, toxicity):
        scored = module.score(docs, None)
        assert scored.count() == 6 and scored.schema["score"].dataType.typeName() == "double" and len(scored.columns) == len(set(scored.columns))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("row = 'c0'").count() == mixed.count()
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x", 5), (2, [1.0, 0.0], "x", 6)], "vec_id long, embedding array<double>, component_id string, n_links int")
    assert sorted(tuple(r) for r in pivots.near_vectors(vectors).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_stages_keep_all_columns(spark, docs, tmp_path):
    spark.createDataFrame([(7, "two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (quality.stage, minhash.stage, decontaminate.stage, mixing.stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert sharding.stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_very_long_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 300_000)]
    passage = [f"p{k}" for k in range(40)]
    long = spark.createDataFrame([(1, " ".join(words[:200_000] + passage + words[200_000:]), "a"), (2, "short", "a")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.judge(decontaminate.search_benchmark(long, bench)).collect()}
    assert found == {1: (300_040, 40, False), 2: (1, 0, False)}
    assert {r.doc_id: r.size for r in mixing.word_counts(long).collect()} == {1: 300_040, 2: 1}
    shards = {r.doc_id: (r.shard_bytes, r.shard_docs) for r in sharding.assign_shards(long, limit_bytes=1000).collect()}
    assert shards[1][1] == 1 and shards[1][0] > 1_000_000 and shards[2] == (5, 1)  # one row beyond the limit has a shard of its own
    assert 0 <= quality.features(" ".join(words).encode()).min() and np.isfinite(quality.features(" ".join(words).encode())).all()


def test_ties(spark):
    """Equal vectors, texts and sizes: the smallest id stands for them, and draws follow the document."""
    vectors = spark.createDataFrame([(k, [float(k % 2 + 1), 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(vectors, threshold=0.99).collect()}
    assert got == {k: (19, k % 2) for k in range(40)}
    docs = spark.createDataFrame([(k, "a b c", "s") for k in range(30)] + [(k + 100, "a b c d e f", "t") for k in range(5)], "doc_id long, text string, source string")
    runs = [sorted(tuple(r) for r in mixing.mix_sizes(mixing.word_counts(docs.repartition(n)), leaf_docs=4, fan_in=2).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
