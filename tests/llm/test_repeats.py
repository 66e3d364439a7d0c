"""Repeated strings against a brute-force version over all windows."""

import hashlib
import random

import pytest

from palimpsest.llm import repeats

SCHEMA = "doc_id long, text string, spans string"


def brute(docs, length=100):
    first, out = {}, {}
    for doc, text in sorted((d, (t or "").encode()) for d, t in docs if d is not None):
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            if first.setdefault(w, (doc, p)) != (doc, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        n_spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(text), sum(gone), n_spans, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, docs):
    rows = [(d, t, "x") for d, t in docs]
    found = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return found


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gämma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = [words(rng, 30) for _ in range(4)]
    docs = []
    for i in range(90):
        parts = [words(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a = rng.randrange(0, 40)
            parts += [p[a : a + rng.randrange(90, 160)], words(rng, rng.randrange(1, 40))]
        docs.append((i * 3, " ".join(parts)))
    for i in range(40):  # near copies, with one edit
        t = docs[5][1]
        at = rng.randrange(len(t))
        docs.append((1000 + i, t[:at] + "Q" + t[at + 1 :]))
    docs += [(2000 + i, docs[7][1]) for i in range(20)]  # exact copies
    docs += [(3000, "ab" * 700), (3001, "x" * 333), (3002, "x" * 99), (3003, "x" * 100), (3004, words(rng, 20) + "=" * 150 + words(rng, 20) + "=" * 150)]
    docs += [(3005, ""), (3006, None), (3007, "é" * 120), (3008, (words(rng, 40) + " ") * 5)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, docs)}
    want = brute(docs)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}


def test_many_surroundings_of_one_line(spark):
    rng = random.Random(3)
    line = words(rng, 9)[:70]
    docs = [(i, words(rng, 8) + line + words(rng, 8)) for i in range(150)] + [(500, line + line + line)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, docs)}
    assert got == brute(docs)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(4)
    t = words(rng, 60)
    got = result(spark, [(1, t), (1, t), (2, t), (None, t), (None, None)])
    whole, none = (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()), (0, 0, 0, hashlib.sha256(b"").hexdigest())
    gone = (len(t.encode()), len(t.encode()), 1, none[3])
    assert sorted((r.doc_id or 0, tuple(r)[1:]) for r in got) == sorted([(1, whole), (1, whole), (2, gone), (0, whole), (0, none)])


def test_empty_table(spark):
    assert result(spark, []) == []


def test_pieces_agree(spark, monkeypatch):
    rng = random.Random(5)
    t = words(rng, 2000)
    monkeypatch.setattr(repeats, "PIECE", 997)
    assert len(list(repeats.pieces(t.encode()))) == -(-(len(t.encode()) - 99) // 997)


def test_a_text_of_several_pieces(spark):
    rng = random.Random(6)
    long = words(rng, 170_000)
    assert len(long.encode()) > repeats.PIECE + 50_000
    edge = repeats.PIECE
    docs = [(1, long), (2, words(rng, 20) + long[edge - 700 : edge + 300] + words(rng, 20)), (3, long[: edge // 2] + "!" + long[edge // 2 :])]
    docs.append((4, words(rng, 10) + docs[1][1][200:450]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, docs)}
    assert got == brute(docs)


def test_texts_that_share_an_id(spark):
    """Different texts of one id are documents in the order of their digests; smaller ids come first."""
    import xxhash

    rng = random.Random(8)
    passage = words(rng, 40)
    a, b = sorted((passage + words(rng, 20), words(rng, 15) + passage), key=lambda t: xxhash.xxh3_128_digest(t.encode()))
    rows = [(5, a), (5, b), (5, b), (7, passage), (3, words(rng, 9) + passage[:150]), (9, None), (9, "")]
    got = sorted(tuple(r) for r in result(spark, rows))
    want = brute([(30, rows[4][1]), (50, a), (51, b), (70, passage), (90, None), (91, "")])
    assert got == sorted([(3, *want[30]), (5, *want[50]), (5, *want[51]), (5, *want[51]), (7, *want[70]), (9, *want[90]), (9, *want[91])])


def test_rounds_rank_growing_cores_until_unique(spark, monkeypatch):
    from palimpsest.llm.storage import Scratch

    rng = random.Random(11)
    line = words(rng, 8)[:60]  # shorter than a window: its surroundings differ, so that all that share its leaders leave on the way
    docs = [(i, words(rng, 12) + line + words(rng, 12)) for i in range(400)]
    left, keep = {}, Scratch.keep

    def note(self, df, name, small=False):
        out = keep(self, df, name, small)
        if name.startswith("round"):
            left[name] = out.where(f"kind = {repeats.ROW}").count()
        return out

    monkeypatch.setattr(Scratch, "keep", note)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in result(spark, docs)}
    assert got == brute(docs)
    counts = [left[f"round{r}"] for r in range(len(left))]
    assert counts[0] >= 400 and counts == sorted(counts, reverse=True) and counts[-1] == 0


def test_ranks_of_many_parts_go_past_the_sort():
    """A batch sends at most BATCH_CLASSES parts of a rank to be sorted; the others go past, with one marker."""
    rng = random.Random(12)
    core = words(rng, 20).encode()[:69]
    n = 50
    cuts = [bytes(rng.randrange(97, 123) for _ in range(29)) + core + bytes(rng.randrange(97, 123) for _ in range(33)) for _ in range(n)]
    import numpy as np

    pos = repeats._pack(np.arange(n) * 1000, np.full(n, 31), np.full(n, 31))  # offsets 0 to 31 from a leader at byte 31
    rows = repeats._parts(np.full(n, 77), np.arange(n), pos, cuts, 1)
    kinds = rows.column("kind").to_pylist()
    assert kinds.count(repeats.PAST) + kinds.count(repeats.ROW) == n and kinds.count(repeats.MARKER) <= 1
    same = repeats._parts(np.full(n, 77), np.arange(n), pos, [cuts[0]] * n, 1)
    assert same.column("kind").to_pylist().count(repeats.SPAN) == n - 1
    last = repeats._parts(np.full(n, 77), np.arange(n), repeats._pack(np.arange(n) * 1000, np.zeros(n, int), np.full(n, 31)), [c[:100] for c in cuts], repeats.ROUNDS)
    assert last.column("kind").to_pylist() == [repeats.ROW] * n
