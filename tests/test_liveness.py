"""Live sources of atoms: what edits change against what is counted anew."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import liveness, versioning
from palimpsest.sources import folders


class Model:
    """Tables in plain Python, edited at random."""

    def __init__(self, seed):
        self.r = random.Random(seed)
        self.docs = {f"d{k}": [f"p{k % 2}", f"f{k // 2}.md", True] for k in range(8)}
        self.chunks = {(f"d{k % 8}", i): [f"t{(3 * k + i) % 12}", self.r.random() < 0.8] for k in range(8) for i in range(3)}
        self.edges = {(f"a{self.r.randrange(9)}", f"t{self.r.randrange(12)}") for _ in range(30)}

    def frames(self, spark):
        docs = spark.createDataFrame([(d, p, path, "h", 1, on) for d, (p, path, on) in self.docs.items()], schemas.DOCUMENTS)
        chunks = spark.createDataFrame([(d, t, i, "H", 1, 2, on) for (d, i), (t, on) in self.chunks.items()], schemas.CHUNKS)
        return spark.createDataFrame(sorted(self.edges), schemas.ATOM_SOURCES), chunks, docs

    def live(self):
        out = {}
        for a, t in self.edges:
            for (d, _), (turn, on) in self.chunks.items():
                if turn == t and on and self.docs[d][2]:
                    out[a, self.docs[d][0]] = out.get((a, self.docs[d][0]), 0) + 1
        return out


def told(df):
    return {(r.atom_id, r.project_id): r.live for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(spark, seed):
    m = Model(seed)
    edges, chunks, docs = m.frames(spark)
    counts = liveness.source_counts(edges, chunks, docs)
    assert told(counts) == m.live()
    for step in range(5):
        kept = spark.createDataFrame([(*k, n) for k, n in told(counts).items()], schemas.SOURCE_COUNTS)
        if step % 2:  # edges come and go
            new = {(f"a{m.r.randrange(12)}", f"t{m.r.randrange(12)}") for _ in range(6)} - m.edges
            old = set(m.r.sample(sorted(m.edges), 6))
            m.edges = (m.edges | new) - old
            frame = lambda s: spark.createDataFrame(sorted(s), schemas.ATOM_SOURCES)
            change = liveness.edge_changes(frame(new), frame(old), chunks, docs)
        else:  # paths go off or on, with their chunks
            paths = m.r.sample(["f0.md", "f1.md", "f2.md", "f3.md"], 2)
            for d, row in m.docs.items():
                if row[1] in paths:
                    row[2] = m.r.random() < 0.5
            for (d, i), row in m.chunks.items():
                if m.docs[d][1] in paths:
                    row[1] = m.r.random() < 0.7
            _, chunks_after, docs_after = m.frames(spark)
            own = F.col("relative_path").isin(paths)
            change = liveness.document_changes(edges, liveness.live_turns(chunks, docs.where(own)), liveness.live_turns(chunks_after, docs_after.where(own)))
        counts = liveness.changed_counts(kept, change)
        edges, chunks, docs = m.frames(spark)
        assert told(counts) == m.live()


def test_the_cascade_by_counts_equals_that_by_all_edges(spark):
    m = Model(3)
    edges, chunks, docs = m.frames(spark)
    atoms = spark.createDataFrame([(f"a{k}", f"p{k % 2}" if k % 4 else None, k == 7) for k in range(9)], "id string, project_id string, source_deleted boolean")
    links = spark.createDataFrame([("project_sections", f"s{k % 4}", f"a{k}") for k in range(9)], schemas.L2_ATOMS)
    gone = docs.where("relative_path IN ('f0.md', 'f1.md', 'f3.md')").select(*versioning.KEY)
    off = liveness.document_changes(edges, liveness.live_turns(chunks, docs.join(gone, versioning.KEY, "left_semi")), None)
    counts = liveness.changed_counts(liveness.source_counts(edges, chunks, docs), off)
    want = versioning.deactivation_cascade(gone, docs, chunks, edges, atoms, links)
    got = versioning.deactivation_cascade(gone, docs, chunks, edges, atoms, links, counts)
    for name in ("stale", "sections", "refresh"):
        assert sorted(got[name].collect()) == sorted(want[name].collect()), name
    assert want["stale"].count() > 0


def test_odd_rows(spark):
    edges = spark.createDataFrame([("a", "t"), (None, "t"), ("b", None)], schemas.ATOM_SOURCES)
    chunks = spark.createDataFrame([("d", "t", 0, "H", 1, 2, True), ("d", "t", 1, "H", 1, 2, True), ("d", "t", 2, "H", 1, 2, None), ("d", None, 3, "H", 1, 2, True)], schemas.CHUNKS)
    docs = spark.createDataFrame([("d", "p", "f", "h", 1, True)], schemas.DOCUMENTS)
    assert told(liveness.source_counts(edges, chunks, docs)) == {("a", "p"): 2}
    none = liveness.source_counts(edges.limit(0), chunks, docs)
    assert told(none) == {}
    with pytest.raises(Exception, match="fewer than no live sources of atom a"):
        liveness.changed_counts(none, liveness.edge_changes(None, edges, chunks, docs)).collect()


def test_parts_of_a_count_grow_with_the_tables(spark, tmp_path, monkeypatch):
    """A task's rows don't grow with the edges, however few partitions shuffles have."""
    m = Model(5)
    frames = {}
    for name, df in zip(("edges", "chunks", "docs"), m.frames(spark), strict=True):
        df.repartition(6).write.parquet(f"{tmp_path}/{name}")
        frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    monkeypatch.setattr(folders, "PART_BYTES", 256)
    parts = folders.parts_of(frames["edges"])
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = liveness.source_counts(frames["edges"], frames["chunks"], frames["docs"])
    assert counts.rdd.getNumPartitions() >= parts
    assert told(counts) == m.live()
    assert folders.parts_of(spark.range(3)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
