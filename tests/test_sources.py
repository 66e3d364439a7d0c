"""Markdown folders, snapshots and the index table."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.sources import folder_source, index, markdown, snapshot


def test_markdown_folder(spark, tmp_path):
    for name, text in {"b.md": "# B\n\nbody", "Sub/A.Markdown": "plain", "skip.txt": "x", "node_modules/c.md": "x", "sub/.git/d.md": "x", "empty.md": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    docs = markdown.read_markdown(spark, str(tmp_path))
    assert [r.relative_path for r in markdown.in_order(docs).collect()] == ["b.md", "empty.md", "Sub/A.Markdown"]
    one = docs.where("relative_path = 'b.md'").first()
    assert (one.content, one.content_hash, one.byte_size) == ("# B\n\nbody", hashlib.sha256(b"# B\n\nbody").hexdigest(), 9)
    assert [tuple(r) for r in markdown.chunked(docs).where("relative_path = 'b.md'").select("chunk_index", "heading", "start_line", "end_line").collect()] == [(0, "B", 1, 3)]
    with pytest.raises(Exception, match="too large"):
        markdown.read_markdown(spark, str(tmp_path), max_bytes=5).collect()
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF"):
        markdown.read_markdown(spark, str(tmp_path)).collect()


def test_links_and_ignored_folders_are_passed_over(spark, tmp_path):
    """Neither links to files nor to folders are followed, a loop among them; Spark's own reader gives the same rows but for links."""
    outside, root = tmp_path / "outside", tmp_path / "docs"
    (outside).mkdir()
    (outside / "o.md").write_text("outside")
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.md").write_text("a")
    (root / "sub" / "deep" / "B.MD").write_text("é\r\nb")
    (root / "sub" / "none.md").write_text("")
    (root / "sub" / "x.mdx").write_text("x")
    (root / "build").mkdir()
    (root / "build" / "c.md").write_text("c")
    want = [("a.md", "a", 1), ("sub/deep/B.MD", "é\r\nb", 5), ("sub/none.md", "", 0)]
    told = lambda df: sorted((r.relative_path, r.content, r.byte_size) for r in df.collect())
    assert told(markdown._binary_files(spark, str(root), 100)) == want
    (root / "linked").symlink_to(outside)
    (root / "loop").symlink_to(root)
    (root / "l.md").symlink_to(outside / "o.md")
    for folder in (str(root), f"file://{root}", f"{root}/"):
        assert told(markdown.read_markdown(spark, folder)) == want
    assert told(markdown.read_markdown(spark, str(root / "build"))) == [("c.md", "c", 1)]
    (root / "none").mkdir()
    assert told(markdown.read_markdown(spark, str(root / "none"))) == []
    with pytest.raises(Exception, match="there is no folder"):
        markdown.read_markdown(spark, str(root / "missing")).collect()


def test_partitions_of_files():
    f = folder_source.Found
    got = folder_source.packed([f("d", 0, 0), f("a", 6, 0), f("c", 3, 0), f("b", 4, 0), f("e", 20, 0), f("f", 1, 0)], 10)
    assert [p.paths for p in got] == [("a", "b"), ("c", "d"), ("e",), ("f",)]
    assert folder_source.packed([], 10) == []


def test_a_folder_as_a_stream(spark, tmp_path):
    """Each file once, changed ones again; a stopped stream goes on where it was."""
    root = tmp_path / "docs"
    root.mkdir()

    def run():
        out = str(tmp_path / "out")
        stream = markdown.stream_markdown(spark, str(root), settle_seconds=0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        return sorted((r.relative_path, r.content) for r in spark.read.schema(folder_source.SCHEMA).parquet(out).collect())

    (root / "a.md").write_text("one")
    (root / "b.md").write_text("b")
    assert run() == [("a.md", "one"), ("b.md", "b")]
    assert run() == [("a.md", "one"), ("b.md", "b")]
    (root / "a.md").write_text("two")
    (root / "c.md").write_text("")
    assert run() == [("a.md", "one"), ("a.md", "two"), ("b.md", "b"), ("c.md", "")]


def test_snapshots(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.versions() == [] and store.table("atom_sources").count() == 0
    edges = spark.createDataFrame([("a", "t1")], schemas.ATOM_SOURCES)
    assert store.commit({"atom_sources": edges, "extraction_coverage": spark.createDataFrame([("t1",)], schemas.COVERAGE)}) == 1
    more = store.table("atom_sources").unionByName(spark.createDataFrame([("b", "t2")], schemas.ATOM_SOURCES))
    assert store.commit({"atom_sources": more}) == 2
    assert store.table("atom_sources").count() == 2 and store.table("atom_sources", 1).count() == 1
    assert store.table("extraction_coverage").count() == 1
    for k in range(snapshot.MOST_FOLDERS + 2):
        store.commit({}, append={"atom_sources": spark.createDataFrame([(f"c{k}", "t")], schemas.ATOM_SOURCES)})
    assert store.table("atom_sources").count() == 4 + snapshot.MOST_FOLDERS and store.table("atom_sources", 2).count() == 2
    assert len(store.manifest()["atom_sources"]) < snapshot.MOST_FOLDERS
    assert store.table("extraction_coverage").count() == 1
    rival = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store")
    rival._base = lambda: (1, {})
    with pytest.raises(RuntimeError, match="another writer"):
        rival.commit({"atom_sources": edges})


def _atoms(spark, ids, statement="old"):
    named = {"scope": "s", "statement": statement}
    fields = [f.split()[0] for f in schemas.ATOMS.split(", ")]
    return spark.createDataFrame([tuple(i if f == "id" else named.get(f) for f in fields) for i in ids], schemas.ATOMS)


def test_changes_by_key_write_their_buckets_only(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.commit({"atoms": _atoms(spark, map(str, range(100)))})
    before = store.buckets("atoms")
    assert len(before) == 8 and store.table("atoms").count() == 100
    store.commit(merge={"atoms": _atoms(spark, ["7", "new"], "changed")}, gone={"atoms": _atoms(spark, ["9", "none"]).select("id")})
    after = store.buckets("atoms")
    changed = {b for b in after if after[b] != before.get(b)}
    where = {r.id: r.b for r in spark.createDataFrame([(i,) for i in ("7", "new", "9", "none")], "id string").select("id", store._bucket("id", 8).alias("b")).collect()}
    assert changed == set(where.values()) and len(changed) < 8
    got = {r.id: r.statement for r in store.table("atoms").collect()}
    assert len(got) == 100 and got["7"] == got["new"] == "changed" and "9" not in got and got["8"] == "old"
    assert [r.id for r in store.rows_of("atoms", _atoms(spark, ["8", "none"])).collect()] == ["8"]
    for k in range(snapshot.MOST_FOLDERS + 2):  # appends: a bucket with many folders is made one again
        store.commit(append={"atoms": _atoms(spark, [f"more{k}"])})
    assert store.table("atoms").count() == 100 + snapshot.MOST_FOLDERS + 2 and max(map(len, store.buckets("atoms").values())) <= snapshot.MOST_FOLDERS
    store.commit(gone={"atoms": store.table("atoms").select("id")})
    assert store.table("atoms").count() == 0 and store.buckets("atoms") == {}


def test_a_table_written_before_there_were_buckets(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store", buckets=4)
    path = f"file://{tmp_path}/store/atoms/old"
    _atoms(spark, ["1", "2"]).write.parquet(path)
    store._publish(1, {"atoms": path})
    assert store.table("atoms").count() == 2
    store.commit(merge={"atoms": _atoms(spark, ["2", "3"], "changed")})
    assert {r.id: r.statement for r in store.table("atoms").collect()} == {"1": "old", "2": "changed", "3": "changed"}
    assert isinstance(store.manifest()["atoms"], dict)


def test_unfinished_manifests_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "PATIENCE", 0.3)
    root = tmp_path / "store"
    store = snapshot.SnapshotStore(spark, f"file://{root}", buckets=2)
    for k in range(4):
        store.commit({"extraction_coverage": spark.createDataFrame([(f"t{k}",)], schemas.COVERAGE), "atoms": _atoms(spark, [str(k), "x", "y", "z"])})
    store.staged(_atoms(spark, ["s"]))
    (root / "_manifests" / "5.json").write_text("")
    assert [r.id for r in store.table("extraction_coverage").collect()] == ["t3"]  # readers see the last whole one
    with pytest.raises(RuntimeError, match="not finished"):
        store.commit({"extraction_coverage": spark.createDataFrame([("u",)], schemas.COVERAGE)})
    assert store.vacuum(older_than_hours=1) == 0 and store.versions() == [1, 2, 3, 4, 5]
    assert store.vacuum(keep=2, older_than_hours=-1) == 2 + 2 + 1  # two versions of two tables, and what was staged
    assert store.versions() == [3, 4]
    assert [r.id for r in store.table("extraction_coverage", 3).collect()] == ["t2"] and store.table("atoms").count() == 4
    assert store.commit({"extraction_coverage": spark.createDataFrame([("u",)], schemas.COVERAGE)}) == 5


def test_a_batch_is_in_the_manifest(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert not store.seen("worker", 0)
    store.commit({"extraction_coverage": spark.createDataFrame([("u",)], schemas.COVERAGE)}, batch=("worker", 3))
    store.commit({"synthesis_coverage": spark.createDataFrame([("u",)], schemas.COVERAGE)})
    assert store.seen("worker", 3) and store.seen("worker", 2) and not store.seen("worker", 4) and not store.seen("other", 0)


def test_index(spark, tmp_path):
    atoms = spark.createDataFrame([("1", "s", "one", None, None, False), ("2", "s", "two", "1", "p", True)], "id string, scope string, statement string, supersedes string, project_id string, source_deleted boolean")
    rows = spark.createDataFrame([("9", "s", "docs", "T", "sum", None)], "id string, scope string, category string, title string, summary string, project_id string")
    points = index.atom_points(atoms).unionByName(index.row_points(rows))
    got = {r.id: (r.source_table, r.content, r.source_deleted, r.superseded, r.project_id) for r in points.collect()}
    assert got == {"1": ("atoms", "one", False, True, None), "2": ("atoms", "two", True, False, "p"), "9": ("docs", "T\nsum", False, False, None)}
    path = str(tmp_path / "index")
    index.write_index(points, path)
    back = spark.read.parquet(path).select(*points.columns)
    changed = index.upserted(back, points.where("id = '9'").withColumn("content", F.lit("new")))
    assert {r.id: r.content for r in changed.collect()} == {"1": "one", "2": "two", "9": "new"}
    vectors = spark.createDataFrame([("1", [1.0, 2.0])], "id string, dense array<float>")
    assert index.with_vectors(points, vectors, 2).where("dense IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="components"):
        index.with_vectors(points, vectors, 3).collect()
    assert index.as_json(rows).first().json == '{"id":"9","scope":"s","category":"docs","title":"T","summary":"sum","project_id":null}'
