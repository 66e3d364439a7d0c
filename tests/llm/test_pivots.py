"""Near vectors against brute force over all pairs."""

import numpy as np
import pytest

from palimpsest.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    ids = [i for i, _ in ok]
    x = np.stack([v / np.linalg.norm(v) for _, v in ok])
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    root = {i: i for i, _, _ in rows}
    for _ in range(len(ids)):
        moved = False
        for a, b in zip(*np.nonzero(close)):
            low = min(root[ids[a]], root[ids[b]])
            moved |= root[ids[a]] != low or root[ids[b]] != low
            root[ids[a]] = root[ids[b]] = low
        if not moved:
            break
    links = dict(zip(ids, close.sum(1).tolist()))
    return {i: (links.get(i, 0), root[i], root[i] == i) for i, _, _ in rows}


def result(spark, rows, **options):
    got = pivots.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    return got


def sample(seed=1, n=300, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, dims)) * 0.08
    hub = base[0] + rng.normal(size=(120, dims)) * 0.05
    same = np.repeat(base[3:4], 40, axis=0)
    return [(i * 2, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(np.vstack([base, near, hub, same]))]


def test_equals_brute_force(spark):
    rows = sample()
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result(spark, rows, block=64)}
    assert got.keys() == want.keys()
    assert sum(got[i][0] for i in got) >= 0.99 * sum(want[i][0] for i in want)
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i] != want[i] for i in got) <= 0.03 * len(got)


def test_unusable_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, float("nan"), 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [float("inf"), 2.0, 3.0], 0), (8, [1.0, 2.0], 0), (9, [], 0), (None, v, 0), (2, v, 0), (10, [3e38, 6e38 / 2, 0.0], 0), (11, [1e-40, 2e-40, 3e-40], 0)]
    got = sorted((tuple(r) for r in result(spark, rows)), key=lambda t: (t[0] is None, t))
    alone = lambda i: (i, 0, i, True)
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (11, 3, 1, False), *map(alone, (3, 4, 5, 6, 7, 8, 9, 10))]) + [(None, 0, None, True)]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_recall_of_many_links(spark):
    """10,000 vectors of 64 dimensions, each of half of them a little above or below the threshold from a partner, and a dense group."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4800, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.935, 0.985, (len(base), 1))
    dense = base[0] + rng.normal(size=(400, 64)) * 0.025
    x = np.vstack([base, base * cosine + off * np.sqrt(1 - cosine**2), dense]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want = brute(rows)
    links = sum(w[0] for w in want.values())
    assert links > 8000
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result(spark, rows, block=256)}
    assert all(got[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert sum(g[0] for g in got.values()) >= 0.995 * links
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.995 * len(want)


def crowded(n, partners, dims, mean, seed=5):
    """Unit vectors of a mean cosine of `mean`, and partners of some of them at cosines of 0.95 to 0.985."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    x = unit(np.sqrt(mean) * unit(rng.normal(size=(1, dims))) + np.sqrt(1 - mean) * unit(rng.normal(size=(n, dims))))
    base, off = x[:partners], rng.normal(size=(partners, dims))
    cosine = rng.uniform(0.95, 0.985, (partners, 1))
    off = unit(off - (off * base).sum(1, keepdims=True) * base)
    return x, base * cosine + off * np.sqrt(1 - cosine**2)


@pytest.mark.parametrize(("dims", "mean"), [(64, 0.0), (64, 0.8), (384, 0.8), (64, 0.85)])
def test_lists_of_crowded_vectors_are_short(dims, mean):
    """20,000 vectors: of all pairs, lists hold under 0.35 (an index of all pairs would be at 1), and partners share pivots."""
    x, partners = crowded(20_000, 1000, dims, mean)
    points, prefix = pivots.chosen(lambda most: x[-most:], pivots.pivot_count(len(x)), pivots.PREFIX)
    near = lambda v: np.argpartition(-(v @ points.T), prefix - 1, axis=1)[:, :prefix]
    of_all, of_partners = near(x), near(partners)
    listed = np.bincount(of_all.ravel()).astype(float)
    assert (listed**2).sum() / len(x) ** 2 < 0.35
    shared = [len(set(a) & set(b)) for a, b in zip(of_all[:1000].tolist(), of_partners.tolist())]
    assert np.mean(np.array(shared) >= pivots.MIN_SHARED) >= 0.99
    assert (prefix == pivots.PREFIX) == (mean == 0.0)


def test_crowded_vectors_equal_brute_force(spark):
    x, partners = crowded(3000, 600, 64, 0.8)
    rows = [(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(np.vstack([x, partners]))]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result(spark, rows, block=256)}
    assert sum(w[0] for w in want.values()) >= 1000
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_one_pivot_for_a_dense_group_however_large():
    rng = np.random.default_rng(3)
    spread, dense = rng.normal(size=(200, 64)), rng.normal(size=(1, 64)) + rng.normal(size=(1800, 64)) * 0.02
    x = pivots.unit(rng.permutation(np.vstack([spread, dense])))
    points, _ = pivots.chosen(lambda most: x[:most], 134, 8)
    assert len(points) > 50 and ((points @ pivots.unit(dense[:1])[0]) > 0.9).sum() <= 1


def test_candidates_share_pivots_and_meet_once():
    nearest = np.array([[3, 5, 9], [5, 3, 1], [9, 4, 5], [7, 8, 2], [3, 5, 9]])

    def pairs(pivot, least):
        listed = np.flatnonzero((nearest == pivot).any(1))
        l, r = pivots.candidates(nearest[listed], pivot, np.arange(len(listed)), np.arange(len(listed)), least)  # noqa: E741
        return {(a, b) for a, b in zip(listed[l].tolist(), listed[r].tolist()) if a < b}

    assert pairs(3, 2) == {(0, 1), (0, 4), (1, 4)}
    assert pairs(5, 2) == {(0, 2), (2, 4)}  # 1 and 2 share pivot 5 alone
    assert pairs(5, 1) == {(0, 2), (1, 2), (2, 4)}
    assert pairs(9, 2) == set()  # met before
    assert pairs(3, 3) == {(0, 4)}
