"""The manifest against trees built one node at a time."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, position int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def tree(nodes, fanout):
    """(root, for each node its siblings on each level as (before, after))."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, at in zip(paths, where, strict=True):
            start = at // fanout * fanout
            path.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + fanout])))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], paths


def brute(rows, fanout=16):
    by_source = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([leaf_of(r) for r in by_source[s]], fanout) for s in names}
    root, above = tree([made[s][0] for s in names], fanout)
    out = []
    for s, up in zip(names, above, strict=True):
        for i, (r, path) in enumerate(zip(by_source[s], made[s][1], strict=True)):
            out.append((r[0], s, i, leaf_of(r), made[s][0], root, tuple(path + up)))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.tree, r.position, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in df.collect()), key=repr)


def rows_of(sizes):
    return [(k, s, "en", k % 5, f"Text {k}", "own", 1) for s, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1}, {"a": 8, "b": 9, None: 2}, {"a": 27, "": 28, "é": 64, "z": 1, "Z": 5}, {f"s{i}": i % 4 + 1 for i in range(30)}])
def test_trees_of_many_blocks(spark, sizes):
    rows = rows_of(sizes)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), fanout=3, depth=2)
    assert shown(got) == brute(rows, 3)


def test_wide_trees(spark):
    rows = rows_of({"a": 16, "b": 17, "c": 257, "d": 600, None: 4097})
    assert shown(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None, None), (1, None, "en", 0, "", "x", 1), (1, None, "en", 0, "", "x", 1), (1, None, "en", None, None, "x", 1), (2, "", "", 5, "é" * 300_000, "x", 1), (2**62, "b", "xx", -1, "A" * 200_000, "x", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    assert shown(got) == brute(rows)
    assert got.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found(spark):
    rows = rows_of({"a": 40, "b": 7})
    docs = spark.createDataFrame(rows, SCHEMA)
    forged = F.when(F.col("doc_id") % 4 == 0, merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS[:-1]], F.lower("text")))
    got = merkle.manifest(docs, presented=forged).withColumn("ok", merkle.folded(F.col("presented"), F.col("path")) == F.col("root")).collect()
    assert len(got) == 47 and all(r.ok == (r.doc_id % 4 != 0) for r in got)
    by_proof = {r.proof for r in merkle.manifest(docs).select(merkle.proof_digest(F.col("path")).alias("proof")).collect()}
    assert by_proof == {h(*[x for level in r[6] for x in level]) for r in brute(rows)}
