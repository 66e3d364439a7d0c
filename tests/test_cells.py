"""Cells of vectors: the same answers as a scan, from a part of the vectors."""

import numpy as np
import pytest

from palimpsest.operators import cells, retrieval


def frames(spark, x, queries):
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, dense array<double>")
    return points, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")


def rows(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def same(got, want):
    got, want = rows(got), rows(want)
    assert [(q, i, rank) for q, i, _, rank in got] == [(q, i, rank) for q, i, _, rank in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=3e-12)


def test_equals_a_scan_of_ten_thousand_and_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(60, 24))
    x = groups[rng.integers(0, 60, 10_000)] + 0.15 * rng.normal(size=(10_000, 24))
    x[5000:5040] = x[17]  # ties, more than k
    points, queries = frames(spark, x, np.concatenate([x[::700], [x[17]]]))
    index = cells.CellIndex.build(points, f"file://{tmp_path}/cells")
    got = index.topk(queries, 8, f"file://{tmp_path}/scratch")
    same(got, retrieval.dense_topk(queries, points, 8))
    assert got.count() == 8 * 16
    assert cells.share_read(index, f"file://{tmp_path}/scratch") < 0.1
    read = index._points(index.cells[:2])
    assert {r.cell for r in read.select("cell").distinct().collect()} == set(index.cells[:2])
    assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", [1, 5, 400])
def test_spread_vectors_and_points_that_count(spark, tmp_path, k, monkeypatch):
    monkeypatch.setattr(cells, "PART", 16)  # cells in many parts
    rng = np.random.default_rng(k)
    points, queries = frames(spark, rng.normal(size=(300, 6)), rng.normal(size=(9, 6)))
    index = cells.CellIndex.build(points, f"file://{tmp_path}/cells")
    same(index.topk(queries, k, f"file://{tmp_path}/a"), retrieval.dense_topk(queries, points, k))
    some = points.where("id % 3 = 0")
    same(index.topk(queries, k, f"file://{tmp_path}/b", some), retrieval.dense_topk(queries, some, k))


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    points = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [nan, 1.0]), ("e", [None, 1.0]), ("f", [1.0]), ("g", [1e200, 1e200]), ("h", [-1.0, 0.0]), ("a", [1.0, 0.0])], "id string, dense array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [nan, 1.0])], "query_id int, vector array<double>")
    index = cells.CellIndex.build(points, f"file://{tmp_path}/cells", dimensions=2)
    got = rows(index.topk(queries, 3, f"file://{tmp_path}/scratch"))
    assert [(q, i, rank) for q, i, _, rank in got] == [(1, "a", 1), (1, "a", 2), (1, "g", 3)]
    none = cells.CellIndex.build(points.limit(0), f"file://{tmp_path}/none", dimensions=2)
    assert none.topk(queries, 3, f"file://{tmp_path}/scratch2").collect() == []
