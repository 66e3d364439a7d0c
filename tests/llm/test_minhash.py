"""Near duplicates against brute force over all pairs."""

import random

import numpy as np

from palimpsest.llm import minhash

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if w else set()


def brute(docs, share=85):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(spark, docs, **options):
    rows = [(d, t, "x") for d, t in docs]
    return minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    docs, n = [], 0
    for _ in range(30):
        base = words(rng, rng.randrange(20, 200))
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            docs.append((n, " ".join(w)))
            n += 3
    hub = words(rng, 120)
    for _ in range(60):  # a large group: some members are linked only through others
        w = list(hub)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        docs.append((n, " ".join(w)))
        n += 3
    docs += [(n + k, docs[4][1].upper()) for k in range(15)]
    docs += [(9000, ""), (9001, None), (9002, " \t\n"), (9003, "one two"), (9004, "ONE  two"), (9005, "two one"), (9006, "a b c d e"), (9007, "a b c d e")]
    got = {r.doc_id: tuple(r)[1:] for r in result(spark, docs, block=16)}
    want = brute(docs)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_repeated_rows_and_null_ids(spark):
    t = "a b c d e f g"
    got = sorted((tuple(r) for r in result(spark, [(4, t), (4, t), (2, t), (None, t), (7, "")])), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (None, 3, None, True), (7, 0, 7, True)], key=str)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_odd_sketches_reject_and_pass():
    """The estimate follows the similarity, so that pairs far below the threshold go and those at it stay."""
    rng = np.random.default_rng(3)
    for n in (60, 300, 3000):
        for similarity in (0.3, 0.6, 0.7, 0.85, 0.95, 1.0):
            common = round(2 * n * similarity / (1 + similarity))
            values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.sort(values[:n]), np.sort(np.concatenate([values[:common], values[n : 2 * n - common]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            differing = np.bitwise_count(minhash.odd_sketch(minhash.samples(a)) ^ minhash.odd_sketch(minhash.samples(b))).sum()
            estimate = float(minhash.estimate(np.array([differing]))[0])
            assert abs(estimate - true) < minhash.MARGIN or true < 0.5 and estimate < 0.6
            assert (estimate >= 0.85 - minhash.MARGIN) == (true >= 0.85 - 0.001) or 0.7 < true < 0.85
            assert minhash.similar(a, b, 85) == (100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)))


def test_sketches_come_before_sets(spark, monkeypatch):
    """Of banded pairs, those that the sketch rejects never meet on their full sets."""
    rng = random.Random(9)
    docs, n = [], 0
    for _ in range(80):  # similarity about 0.45 to 0.6: many pairs share a band
        base = words(rng, 100)
        for _ in range(2):
            w = list(base)
            for at in rng.sample(range(0, 100, 6), 5):
                w[at] = "z" + str(rng.randrange(10**6))
            docs.append((n, " ".join(w)))
            n += 1
    close = words(rng, 200)
    docs += [(n, " ".join(close)), (n + 1, " ".join(close[:-4]))]
    from palimpsest.llm.storage import Scratch

    kept = {}
    keep = Scratch.keep

    def note(self, df, name, small=False):
        out = keep(self, df, name, small)
        kept.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", note)
    got = {r.doc_id: r.component_id for r in result(spark, docs)}
    assert got[n + 1] == n and all(got[i] == i for i in range(n + 1))
    assert kept["members"][0] > 20  # banded
    assert kept["pairs"][0] < kept["members"][0] / 4 and kept["links"][0] == 1


def test_long_texts(spark):
    rng = random.Random(4)
    long = words(rng, 150_000)
    other = list(long)
    for at in range(0, 150_000, 400):
        other[at] = "changed"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:75_000]))])}
    assert got == {i: w[:2] for i, w in brute([(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:75_000]))]).items()}
    assert got[2][1] == 1 and got[3][1] == 3


def test_one_id_with_two_texts(spark):
    a, b = " ".join("abcdefgh"), " ".join("ijklmnop")
    got = sorted(tuple(r) for r in result(spark, [(5, a), (5, b), (7, a), (9, b + " q")], share=60))
    assert got == [(5, 4, 5, True), (5, 4, 5, True), (7, 4, 5, False), (9, 5, 5, False)]
