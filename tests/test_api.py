"""The memory front, end to end over a store; commits of judged batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.api import Memory
from palimpsest.operators import extraction

T0 = dt.datetime(2024, 1, 1)


def test_memory(spark, tmp_path):
    def encoder(texts):  # local, so that it is sent by value
        words = ["quartz", "postgres", "spark"]
        return [[float(t.lower().count(w)) + 0.01 for w in words] for t in texts]

    memory = Memory(spark, f"file://{tmp_path}/m", encoder, 3)
    said = spark.createDataFrame([("s", "Quartz holds the vectors", "fact"), ("s", "Postgres holds the rows", "decision"), ("t", "Spark runs the plans", "fact")], "scope string, statement string, category string")
    written = memory.remember(said).collect()
    assert len(written) == 3 and len({r.id for r in written}) == 3
    ids = {r.statement.split()[0]: r.id for r in written}
    asked = spark.createDataFrame([(0, "where are quartz vectors"), (1, "postgres rows")], "query_id int, query string")
    got = memory.recall(asked, sources=["atoms"], scope="s", least=0.3).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, ids["Quartz"]), (1, ids["Postgres"])}
    assert {(r.query_id, r.id) for r in memory.search_candidates(asked, k=1, sources=["atoms"], mode="bm25").collect()} == {(0, ids["Quartz"]), (1, ids["Postgres"])}
    memory.update(spark.createDataFrame([(ids["Postgres"], "DuckDB holds the rows")], "id string, statement string"))
    fetched = memory.fetch(spark.createDataFrame([(i,) for i in ids.values()], "id string")).collect()
    assert {r.content for r in fetched} == {"Quartz holds the vectors", "DuckDB holds the rows", "Spark runs the plans"}
    gone = memory.forget(spark.createDataFrame([(ids["Quartz"],), ("none",)], "id string")).collect()
    assert {(r.id, r.found) for r in gone} == {(ids["Quartz"], True), ("none", False)}
    assert memory.recall(asked, sources=["atoms"], scope="s", least=0.4).where("query_id = 0").count() == 0
    assert memory.fetch(spark.createDataFrame([(ids["Quartz"],)], "id string")).count() == 0
    with pytest.raises(Exception, match="category"):
        memory.remember(said.withColumn("category", F.lit("x")))
    with pytest.raises(ValueError):
        memory.recall(asked, k=0)
    with pytest.raises(ValueError):
        memory.recall(asked, sources=["project_sections"])


def test_one_forget_writes_one_bucket(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", buckets=16)
    said = spark.createDataFrame([("s", f"Statement {k} of quartz", "fact") for k in range(60)], "scope string, statement string, category string")
    ids = sorted(r.id for r in memory.remember(said).collect())
    before = {name: memory.store.buckets(name) for name in ("atoms", "index_points")}
    assert memory.forget(spark.createDataFrame([(ids[0],)], "id string")).collect()[0].found
    for name, old in before.items():
        new = memory.store.buckets(name)
        assert len([b for b in {**old, **new} if new.get(b) != old.get(b)]) == 1
    assert memory.store.table("index_points").count() == 59
    assert memory.store.table("atoms").where("source_deleted").count() == 1


def test_inverted_lists_follow_the_buckets(spark, tmp_path):
    """A change makes lists of the buckets it wrote; what was replaced there doesn't count any more."""
    memory = Memory(spark, f"file://{tmp_path}/m", buckets=8)
    said = spark.createDataFrame([("s", f"quartz number{k}", "fact") for k in range(24)], "scope string, statement string, category string")
    ids = {r.statement.split()[1]: r.id for r in memory.remember(said).collect()}
    ask = lambda text, k=30: {r.id for r in memory.search_candidates(spark.createDataFrame([(0, text)], "query_id int, query string"), k=k, sources=["atoms"], scope="s").collect()}
    assert ask("quartz") == set(ids.values()) and ask("number3") == {ids["number3"]}
    assert len(memory._lexical().roots) == 1
    memory.update(spark.createDataFrame([(ids["number3"], "basalt number3")], "id string, statement string"))
    assert ask("basalt") == {ids["number3"]} and ask("quartz") == set(ids.values()) - {ids["number3"]}
    first, second = memory._lexical().alive
    assert sorted(map(len, (first, second))) == [1, 7] and len(memory.store._listed(f"{memory.store.root}/_lexical")) == 2
    memory.forget(spark.createDataFrame([(ids["number5"],)], "id string"))
    assert ask("number5 number6") == {ids["number6"]}


def test_drill_down_and_projects(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m")
    fill = lambda name, row: spark.createDataFrame([tuple(row.get(f.split()[0]) for f in schemas.TABLES[name].split(", "))], schemas.TABLES[name])
    memory.store.commit({
        "turns": fill("turns", {"id": "t1", "session_id": "x", "scope": "s", "source": "user", "content": "hi", "created_at": T0}), "atoms": fill("atoms", {"id": "a1", "scope": "s", "statement": "st"}),
        "atom_sources": spark.createDataFrame([("a1", "t1")], schemas.ATOM_SOURCES), "l2_rows": fill("l2_rows", {"category": "docs", "id": "r1", "scope": "s", "title": "T"}), "l2_atoms": spark.createDataFrame([("docs", "r1", "a1")], schemas.L2_ATOMS),
    })
    for record, table in (("a1", "atoms"), ("r1", "docs")):
        got = memory.drill_down(spark.createDataFrame([(record,)], "id string"), table).collect()
        assert [(r.record_id, r.id, r.content) for r in got] == [(record, "t1", "hi")]
    with pytest.raises(ValueError):
        memory.drill_down(spark.createDataFrame([("a1",)], "id string"), "x")
    projects = "scope string, name string, aliases array<string>, root_path string"
    memory.register_projects(spark.createDataFrame([("s", "Store  Dashboard", ["shop"], "/a"), ("s", "Other", [], None)], projects))
    memory.register_projects(spark.createDataFrame([("s", "store dashboard", ["till"], None)], projects))
    listed = memory.list_projects("s").collect()
    assert [(r.normalized_name, r.aliases, r.root_path) for r in listed] == [("other", [], None), ("store dashboard", ["till"], "/a")]
    assert [r.name for r in memory.resolve_project(spark.createDataFrame([(0, "TILL")], "query_id int, name string")).collect()] == ["store dashboard"]


def test_commit_of_a_judged_batch(spark):
    batch = spark.createDataFrame([("t1", "x", "s", T0), ("t2", "x", "s", T0), ("t3", "x", "s", T0)], "id string, session_id string, scope string, created_at timestamp")
    judged = spark.createDataFrame(
        [("a", "s", None, "one", "fact", "sc", "ADA", None, 0.9, "k1", ["t1", "t2"]), ("b", "s", None, "two", "fact", "sc", None, None, 0.9, "k2", ["t2"])],
        "atom_id string, scope string, project_id string, statement string, category string, scene_name string, entity string, predicate string, confidence double, supersedes string, source_turn_ids array<string>",
    )
    known = spark.createDataFrame([("k1", "s", None), ("k2", "other", None)], "id string, scope string, project_id string")
    entities = spark.createDataFrame([("e1", "s", "Ada", [], T0)], schemas.ENTITIES)
    out = extraction.commit(judged, batch, batch.where("id <> 't2'"), known, entities, F.lit(T0))
    atoms = out["atoms"].collect()
    assert [(r.id, r.entity_id, r.supersedes, r.origin) for r in atoms] == [("a", "e1", "k1", "inferred")]
    assert [tuple(r) for r in out["atom_sources"].collect()] == [("a", "t1")]
    assert [r.id for r in out["extraction_coverage"].collect()] == ["t1"]
    assert [(r.cursor_id, r.cursor_at) for r in out["extraction_attempts"].collect()] == [("t3", T0)]
    whole = extraction.commit(judged, batch, batch, known, entities, F.lit(T0), project=True)
    assert {r.id for r in whole["extraction_coverage"].collect()} == {"t1", "t2", "t3"}
    assert {(r.id, r.supersedes) for r in whole["atoms"].collect()} == {("a", "k1"), ("b", None)}
    assert [r.id for r in extraction.reindexed(whole["atoms"], known.select("id")).collect()] == ["k1"]
