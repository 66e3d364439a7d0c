"""Top-k search against all inner products."""

import math

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import threshold

SCHEMA = "vec_id long, embedding array<double>, score long, rank string"


def brute(rows, queries, k=10, scale=1024):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if usable(v)]
    out = []
    for qi, q in ((i, [math.floor(scale * x) for x in v]) for i, v, *_ in queries if usable(v) and i is not None):
        found = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), i is None, i or 0) for i, c in whole if i != qi and len(c) == len(q)))[:k]
        out += [(qi, n + 1, None if none else i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, none, i) in enumerate(found)]
    return sorted(out, key=repr)


def searched(spark, rows, queries, **options):
    df = lambda r: spark.createDataFrame([(*x, 1, "own") for x in r], SCHEMA).repartition(3)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in threshold.top_k(df(rows), df(queries), **options).collect()), key=repr)


@pytest.mark.parametrize(("width", "kind"), [(3, "spread"), (3, "clustered"), (16, "spread"), (2, "ties"), (5, "skewed")])
def test_equals_brute_force(spark, width, kind):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(900, width))
    if kind == "clustered":
        x = x * 0.02 + rng.normal(size=(6, width))[rng.integers(0, 6, 900)]
    if kind == "ties":
        x = rng.integers(-1, 2, size=(900, width)) / 2
    if kind == "skewed":  # a few long vectors end most searches
        x[:12] *= 50
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    queries = [r for r in rows if r[0] % 50 == 0]
    assert searched(spark, rows, queries, tile_bytes=8 * width * 128) == brute(rows, queries)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 1.0]), (5, []), (200, []), (6, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (7, [5.0, 5.0]), (8, [-1.0, 0.0]), (300, [0.0, 0.0]), (2**62, [1.0, 1.0]), (-100, [0.5, -0.5])]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    assert searched(spark, rows, queries) == brute(rows, queries)
    assert searched(spark, [], []) == []
    assert searched(spark, rows, []) == []


def test_queries_in_more_partitions_than_cores(spark):
    """Blocks of queries keep keys of their own, however many partitions hold queries."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 0").repartitionByRange(23, "vec_id")
    assert asked.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in threshold.top_k(df, asked).collect()), key=repr)
    assert got == brute(rows, [r for r in rows if r[0] % 3 == 0])


def test_products_beyond_doubles_and_longs(spark):
    rows = [(i, [1e6 + i, 3.0, 1e9 * (i % 3 - 1)]) for i in range(40)] + [(100, [2.0**60, 1.0, 2.0**60]), (101, [2.0**61, 1.0, 2.0**61])]
    queries = [r for r in rows if r[0] % 10 == 0]
    assert searched(spark, rows, queries, k=4) == brute(rows, queries, k=4)


def test_the_bound_ends_searches_early():
    """On long-tailed vectors most are never scored, and nothing is lost."""
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(5000, 4)) * np.exp(rng.normal(size=(5000, 1)) * 1.5) * 1024)
    tile = threshold.Tile(pa.array(np.arange(5000)), x.tobytes(), 4)
    q = x[:50]
    best, scored = threshold.search(tile, np.arange(50), q, np.full(50, -np.inf), 10)
    products = q @ x.T
    products[np.arange(50), np.arange(50)] = -np.inf
    want = np.argsort(-products, axis=1, kind="stable")[:, :10]
    assert (best.rows == want).all()
    assert scored < 0.1 * products.size
    floor = np.take_along_axis(products, want, 1)[:, -1]
    small = np.flatnonzero(np.abs(x).max(1) < 1024)
    other = threshold.Tile(pa.array(small + 10_000), x[small].tobytes(), 4)
    assert threshold.search(other, np.arange(50), q, floor, 10)[1] < 0.02 * 50 * len(small)
