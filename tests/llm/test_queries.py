"""The registered queries on the smallest tables, against their SQL or the contract's rules."""

import math
import os
import zlib

import pytest

from palimpsest.llm import registry

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def same(a, b):
    return math.isclose(a, b, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))] == []


def test_shards_are_uneven(spark):
    """The query's limit splits some buckets more often than others."""
    from palimpsest.llm import sharding

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.assign_shards(docs, limit_bytes=16 << 10).select("shard", "shard_depth", "shard_bytes").distinct().collect()
    assert len({r.shard_depth for r in got}) > 2 and len(got) > 10


@pytest.mark.parametrize(("name", "folds", "held", "cut"), [("op4_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3)])
def test_scores(spark, name, folds, held, cut):
    rows = registry.queries()[name](spark, DATA).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_mix_of_the_query(spark):
    docs = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = registry.queries()["op3_mixing"](spark, DATA).collect()
    assert rows == registry.queries()["op3_mixing"](spark, DATA).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, registry.queries()["op3_mixing"](spark, DATA).collect()))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    taken, target = {}, {}
    for r in rows:
        source, size = docs[r.doc_id]
        assert r.size == size and r.taken <= 3 * size and r.taken % max(size, 1) == 0
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
    most = max(size for _, size in docs.values())
    assert all(abs(taken[s] - target[s]) <= most for s in target)
    assert sum(target.values()) == pytest.approx(sum(size for _, size in docs.values()))
