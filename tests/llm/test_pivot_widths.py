"""Near vectors of several lengths in one table, against brute force over each length."""

import numpy as np

from palimpsest.llm import pivots

SCHEMA = "vec_id long, embedding array<float>"


def mixed():
    rng, rows = np.random.default_rng(4), []
    for dims, n in ((16, 200), (8, 90), (24, 60), (5, 1)):
        base = rng.normal(size=(n, dims))
        near = base[: n // 2] + rng.normal(size=(n // 2, dims)) * 0.03
        rows += [[float(np.float32(a)) for a in v] for v in np.vstack([base, near, base[:9]])]
    rng.shuffle(order := list(range(len(rows))))
    return [(k, rows[i]) for k, i in enumerate(order)]


def brute(rows):
    links, root = {}, {i: i for i, _ in rows}
    for dims in {len(v) for _, v in rows}:
        ids = [i for i, v in rows if len(v) == dims]
        x = pivots.unit(np.array([v for _, v in rows if len(v) == dims], np.float32))
        close = x @ x.T >= pivots.THRESHOLD
        np.fill_diagonal(close, False)
        links |= zip(ids, close.sum(1).tolist())
        for _ in ids:
            for a, b in zip(*np.nonzero(close)):
                root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
    return {i: (links[i], root[i], root[i] == i) for i, _ in rows}


def test_each_length_meets_itself(spark):
    rows = mixed()
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), block=64).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)
    for dims in (16, 8, 24, 5):
        own = [i for i, v in rows if len(v) == dims]
        assert sum(want[i][0] for i in own) > 0
        assert sum(got[i][0] for i in own) >= 0.99 * sum(want[i][0] for i in own)
    assert sum(got[i] != want[i] for i in got) <= 0.03 * len(got)


def test_copies_of_a_rare_length(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [3.0]), (13, [-3.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 13: (0, 13, True)}


def test_no_usable_vector(spark):
    rows = [(1, [0.0]), (2, None), (3, [])]
    got = sorted(tuple(r) for r in pivots.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
