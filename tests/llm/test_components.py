"""Components by rounds and in one task, against a search."""

import random

from palimpsest.llm.components import connected_components
from palimpsest.llm.storage import Scratch


def reached(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        if v not in out:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = v
                    todo += near[x]
    return out


def test_both_ways(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 300)]  # a chain
    edges += [(1000, 1001 + k) for k in range(200)]  # a star
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    edges += [(5, 5), (None, 7), (8, None), (-3, 2000), (1 << 60, -(1 << 60)), edges[0]]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = reached(edges)
    for local in (0, 100, 10_000):  # rounds alone, rounds and then one task, one task alone
        got = connected_components(df, Scratch(spark, "test"), local).collect()
        assert len(got) == len(want) and {r.id: r.component for r in got} == want
    assert connected_components(df.limit(0), Scratch(spark, "test")).collect() == []
