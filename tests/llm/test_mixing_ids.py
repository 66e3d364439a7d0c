"""Ids beyond 2^53 beside null ones, and copies against a plain pivotal tree."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import mixing

BIG = 9007199254740993
SCHEMA = "doc_id long, source string, text string"


def test_large_ids_beside_null_ones_stay_whole(spark):
    rows = [(BIG, "a", "one two three"), (BIG + 2, "a", "four five"), (None, "a", "six"), (None, "a", "six seven"), (7, "a", "eight nine ten")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sizes(mixing.word_counts(docs)).collect()
    assert {r.doc_id for r in got} == {BIG, BIG + 2, None, 7}
    assert all(r.copies == 1 for r in got)  # one source: its target is its size
    mixed = mixing.mix_documents(docs).collect()
    assert sorted(map(repr, mixed)) == sorted(map(repr, docs.collect()))


def plain_copies(units, targets, cycle, cap, seed, leaf_docs, fan_in):
    """units: (doc_id, source, size) -> rows; targets: source -> (size, target). Copies of each unit, one source at a time in memory."""
    copies, most = {}, max((sum(1 for u in units if u[1] == s) for s in targets), default=0)
    draw = lambda s, level, i: xxhash.xxh3_64_intdigest(f"{s}/{level}/{'null' if i is None else i}".encode()) / 2.0**64
    for source, (size, target, nodes_of) in targets.items():
        rate = target / size if size else 0.0
        rows = [[u, float(u[2] * n), (rate - int(rate)) * u[2] * n, nodes_of(u)] for u, n in units.items() if u[1] == source]
        nodes, level = max(1, -(-most // leaf_docs)), 0
        while True:
            left = []
            for node in {r[3] for r in rows}:
                group = sorted((r for r in rows if r[3] == node), key=lambda r: (-r[1], draw(seed, level, r[0][0]), r[0][2]))
                out, held = mixing.pivot(np.array([r[2] for r in group]), np.array([r[1] for r in group]), np.array([draw(seed, level, r[0][0]) for r in group]))
                for k, r in enumerate(group):
                    if k == held and nodes > 1:
                        left.append([r[0], r[1], out[k], node // fan_in])
                        continue
                    up = draw(seed + 1, level, r[0][0]) * r[1] < out[k] if k == held else r[1] > 0 and out[k] >= r[1]
                    copies[r[0]] = int(rate) + int(up)
            if nodes <= 1:
                break
            rows, nodes, level = left, -(-nodes // fan_in), level + 1
    return copies


def test_copies_equal_a_plain_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "abc"[i % 3] if i % 17 else None, "w " * int(rng.integers(0, 40))) for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (None, "b", "x y")], SCHEMA)
    options = {"leaf_docs": 16, "fan_in": 3}
    got = mixing.mix_sizes(mixing.word_counts(docs), **options).collect()
    units, sizes, counts = {}, {}, {}
    for doc_id, source, text in [*rows, rows[3], rows[3], (None, "b", "x y")]:
        u = (doc_id, source, len(text.split()))
        units[u] = units.get(u, 0) + 1
    for (_, source, size), n in units.items():
        sizes[source], counts[source] = sizes.get(source, 0) + size * n, counts.get(source, 0) + 1
    hashes = {(r.doc_id, r.size): r.h for r in spark.createDataFrame([(u[0], u[2]) for u in units], "doc_id long, size long").select("doc_id", "size", F.xxhash64("doc_id", "size", F.lit(mixing.SEED)).alias("h")).collect()}
    target = {r.source: r.target for r in got}
    targets = {s: (sizes[s], target[s], lambda u, s=s: hashes[u[0], u[2]] % -(-counts[s] // 16)) for s in sizes}
    want = plain_copies(units, targets, mixing.WEIGHTS, mixing.CAP, mixing.SEED, 16, 3)
    assert {(r.doc_id, r.source, r.size): r.copies for r in got} == want
