"""Operators on hand-made rows; the queries' SQL covers the driver's tables."""

import datetime as dt
import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import agent, mutations, pending, pooling, provenance, quality_gate, registry, retrieval, synthesis, validation, versioning

FAILS = (PySparkException, Py4JJavaError)
T0 = dt.datetime(2024, 1, 1, 12, 0)


def ago(minutes):
    return T0 - dt.timedelta(minutes=minutes)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


TURN = "id long, session_id string, scope string, created_at timestamp"


def test_triggers(spark):
    turns = [(k, "idle", "s", ago(16)) for k in range(2)] + [(100 + k, "full", "s", T0) for k in range(20)] + [(200 + k, "old", "s", ago(16)) for k in range(20)] + [(300, "fresh", "s", ago(14)), (400, "edge", "s", ago(15))]
    turns = spark.createDataFrame(turns, TURN)
    cursors = spark.createDataFrame([("old", "s", ago(16), 219)], "session_id string, scope string, cursor_at timestamp, cursor_id long")
    none = spark.createDataFrame([], "id long")
    out = pending.session_status(turns, none, cursors, F.lit(T0))
    assert rows(out, "session_id", "pending", "inactivity", "volume", "due") == [("edge", 1, True, False, True), ("fresh", 1, False, False, False), ("full", 20, False, True, True), ("idle", 2, True, False, True), ("old", 20, False, False, False)]


def test_gap_of_exactly_the_limit_parts_bursts(spark):
    turns = spark.createDataFrame([(1, "a", "s", ago(40)), (2, "a", "s", ago(25)), (3, "a", "s", dt.datetime(2024, 1, 1, 11, 49, 59))], TURN)
    assert rows(pending.idle_sessions(turns), "id", "burst") == [(1, 0), (2, 1), (3, 1)]


def test_cursor_orders_by_time_then_id(spark):
    turns = spark.createDataFrame([(1, "a", "s", T0), (2, "a", "s", T0), (3, "a", "s", ago(1)), (4, "b", "s", ago(9))], TURN)
    cursors = spark.createDataFrame([("a", "s", T0, 1)], "session_id string, scope string, cursor_at timestamp, cursor_id long")
    assert rows(pending.after_cursor(turns, cursors), "id") == [(2,), (4,)]
    moved = mutations.advance_cursor(cursors, spark.createDataFrame([("a", "s", ago(5), 9), ("c", "s", T0, 3)], cursors.schema))
    assert rows(moved, "session_id", "cursor_id") == [("a", 9), ("c", 3)]


def test_turn_validation(spark):
    turns = spark.createDataFrame([(1, "user", "s", "hi", None), (2, "system", "s", "hi", None), (3, "user", " ", "hi", None), (4, "user", "s", "", None), (5, "tool", "s", "hi", None), (6, "tool", "s", "hi", "c"), (7, None, "s", "hi", None)], "id int, source string, scope string, content string, tool_call_id string")
    good, bad = validation.split_turns(turns)
    assert rows(good, "id") == [(1,), (6,)]
    assert rows(bad, "id", "problem") == [(2, "source"), (3, "scope"), (4, "content"), (5, "tool_call_id"), (7, "source")]


JUDGED = "id int, confidence double, source_turn_ids array<string>, batch_ids array<string>"


def test_judged_atoms(spark):
    atoms = spark.createDataFrame([(1, 0.95, ["a", "b"], ["a", "b"]), (2, 0.2, ["a", "b"], ["a", "b"]), (3, 0.95, ["a"], ["a", "b"]), (4, 0.95, ["a", "a"], ["a"])], JUDGED)
    assert rows(validation.validated_atoms(atoms), "id") == [(1,)]
    assert rows(validation.validated_atoms(atoms, corroborate=False), "id") == [(1,), (3,), (4,)]
    outside = spark.createDataFrame([(5, 0.95, ["a", "z"], ["a", "b"])], JUDGED)
    with pytest.raises(FAILS):
        validation.validated_atoms(outside).collect()
    assert validation.validated_atoms(outside, drop_invalid=True).count() == 0


def test_judge_replies(spark):
    reply = '[{"scene_name": " a  b ", "atoms": [{"statement": " s ", "category": "fact", "confidence": 0.9, "source_turn_ids": ["t"]}]}]'
    got = validation.scenes_to_atoms(spark.createDataFrame([(1, reply)], "k int, reply string"), keep=("k",)).first()
    assert (got.k, got.scene_name, got.statement, got.confidence, got.supersedes) == (1, "a b", "s", 0.9, None)
    with pytest.raises(FAILS):
        validation.scenes_to_atoms(spark.createDataFrame([("[{",)], "reply string")).collect()


def test_uuid_is_required(spark):
    good = spark.createDataFrame([("6ba7b811-9dad-11d1-80b4-00c04fd430c8",)], "id string")
    assert validation.require_uuid(good, "id").count() == 1
    with pytest.raises(FAILS):
        validation.require_uuid(good.withColumn("id", F.lit("x")), "id").collect()


ATOM = "id int, scope string, statement string, category string, confidence float, supersedes int, source_deleted boolean, entity_id int"


def test_active_and_superseded(spark):
    atoms = spark.createDataFrame([(1, "s", "a", "fact", 0.9, None, False, 1), (2, "s", "b", "fact", 0.9, 1, False, 9), (3, "t", "c", "fact", 0.9, 2, None, None), (4, "s", "d", "fact", 0.9, None, True, None)], ATOM)
    assert rows(provenance.active_atoms(atoms), "id") == [(3,)]
    assert rows(provenance.with_superseded_flag(atoms), "id", "superseded") == [(1, True), (2, False), (3, False), (4, False)]
    assert rows(provenance.with_superseded_flag(atoms, same_scope=False), "id", "superseded") == [(1, True), (2, True), (3, False), (4, False)]
    entities = spark.createDataFrame([(1, "Ada")], "id int, name string")
    assert rows(provenance.with_entity(atoms, entities), "id", "entity") == [(1, "Ada"), (2, None), (3, None), (4, None)]


def test_sources_and_modes(spark):
    assert retrieval.resolve_sources() == sorted(schemas.GENERAL_CATEGORIES)
    assert retrieval.resolve_sources(project=True) == ["project_sections"]
    assert retrieval.resolve_sources(types=["user"], sources=["atoms"]) == ["atoms", "profiles", "users"]
    assert "project_sections" not in retrieval.resolve_sources(types=["workspace"])
    for bad in ({"types": ["x"]}, {"sources": ["x"]}, {"sources": ["project_sections"]}):
        with pytest.raises(ValueError):
            retrieval.resolve_sources(**bad)
    df = spark.createDataFrame([(["atoms"],), (["tools"],), (["atoms", "tools"],)], "s array<string>")
    assert [r[0] for r in df.select(retrieval.natural_mode(F.col("s"))).collect()] == ["vector", "bm25", "hybrid"]
    assert retrieval.attempt_sources(1) == sorted(schemas.GENERAL_CATEGORIES) and retrieval.attempt_sources(3, project=True) == ["atoms", "project_sections"]
    with pytest.raises(ValueError):
        retrieval.attempt_sources(4)


POINT = "id int, scope string, source_table string, title string, content string, project_id int, source_deleted boolean, superseded boolean, dense array<double>"


@pytest.fixture
def points(spark):
    data = [(1, "s", "atoms", None, "Quartz retrieval index", None, None, None, [1.0, 0.0]), (2, "s", "docs", "T", "Postgres tables", None, False, False, [0.0, 1.0]), (3, "s", "docs", "P", "Quartz project", 7, False, False, [1.0, 0.1]), (4, "s", "atoms", None, "Quartz gone", None, True, None, [1.0, 0.0]), (5, "s", "atoms", None, "Quartz old", None, None, True, [1.0, 0.0])]
    return spark.createDataFrame(data, POINT)


def test_project_isolation(points):
    assert rows(retrieval.visible(points), "id") == [(1,), (2,)]
    assert rows(retrieval.visible(points, F.lit(7)), "id") == [(3,)]
    assert rows(retrieval.in_scope(retrieval.visible(points), "s", ["docs"]), "id") == [(2,)]


@pytest.mark.parametrize("mode, first", [("vector", 2), ("bm25", 1), ("hybrid", 1)])
def test_modes(spark, points, mode, first):
    queries = spark.createDataFrame([(0, "quartz retrieval", [0.2, 1.0])], "query_id int, query string, vector array<double>")
    got = retrieval.search(queries, retrieval.visible(points), mode, 5).orderBy("rank").collect()
    assert got[0].id == first
    with pytest.raises(ValueError):
        retrieval.search(queries, points, "x")


def test_threshold_after_reranking(spark, points):
    pool = points.where("id = 1").select(F.lit(0).alias("query_id"), "id", "content", F.lit(0.99).alias("score"))
    for query, kept in (("Postgres", 0), ("Quartz", 1)):
        queries = spark.createDataFrame([(0, query)], "query_id int, query string")
        assert retrieval.above(retrieval.keyword_rerank(pool, queries), 0.5).count() == kept
    with pytest.raises(ValueError):
        retrieval.above(pool, 1.5)


def test_model_scores(spark):
    replies = spark.createDataFrame([(0, '[{"id": "a", "score": 0.5}]')], "query_id int, reply string")
    assert rows(retrieval.parse_scores(replies)) == [(0, "a", 0.5)]
    with pytest.raises(FAILS):
        retrieval.parse_scores(spark.createDataFrame([(0, '[{"id": "a", "score": 1.5}]')], replies.schema)).collect()


def test_first_arrival_wins_ties(spark):
    c = spark.createDataFrame([(0, 1, "a", 0.5, 2), (0, 1, "b", 0.5, 1), (0, 1, "c", 0.4, 0)], "query_id int, id int, source_table string, score double, arrival int")
    assert rows(retrieval.keep_best(c), "source_table") == [("b",)]


def test_recall_budget(spark):
    calls = spark.createDataFrame([("r", k) for k in range(4)], "run_id string, arrival int")
    assert rows(retrieval.attempts(calls), "arrival", "attempt", "layers") == [(0, 1, "summaries"), (1, 2, "summaries"), (2, 3, "atoms+summaries"), (3, None, "exhausted")]


def test_pooling(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "id int, dense array<double>")
    got = {r.id: r.dense for r in pooling.pooled_dense(chunks).collect()}
    assert got[1] == pytest.approx([2**-0.5] * 2) and got[2] == [0.0, 0.0]
    with pytest.raises(FAILS):
        pooling.pooled_dense(spark.createDataFrame([(1, [1.0]), (1, [0.0, 1.0])], chunks.schema)).collect()
    sparse = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.8), (1, 2, 0.9), (1, 3, 0.1)], "id int, idx long, weight double")
    assert rows(pooling.sparse_arrays(pooling.pooled_sparse(sparse))) == [(1, [1, 2, 3], [0.2, 0.9, 0.1])]
    texts = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[0] for r in texts.select(pooling.encoded(F.col("t"), lambda b: [[float(len(x)), 1.0] for x in b], 2)).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_projects(spark):
    projects = spark.createDataFrame([(1, "Store Dashboard", ["shop"]), (2, "Shop", []), (3, "Workshop", None), (4, " ", [])], "id int, name string, aliases array<string>")
    asked = spark.createDataFrame([(0, "SHOP"), (1, "dashboard store"), (2, "none")], "query_id int, name string")
    ranked = registry.rank_projects(asked, projects)
    assert [tuple(r) for r in ranked.orderBy("query_id", "rank").select("query_id", "id", "match").collect()] == [(0, 2, 0), (0, 1, 1), (0, 3, 2), (1, 1, 3)]
    assert registry.with_other_option(ranked).where("name = 'Other options'").count() == 2
    assert registry.resolve_single(ranked).count() == 4
    with pytest.raises(FAILS):
        registry.resolve_single(ranked, most=2).collect()


def test_names_by_their_grams_equal_all_pairs(spark):
    """Short terms, repeated rows, separators alone, terms across a name's parts, and names without any of these."""
    import itertools

    parts = ["ab", "abc", "code", "x", "VS", "data-lake", "lake_house", "Straße", "日本語", "a b", "--", "ed it"]
    names = [" ".join(p) for n in (1, 2) for p in itertools.permutations(parts, n)]
    projects = spark.createDataFrame([(i, name, [names[-i]] if i % 3 else None) for i, name in enumerate(names)] + [(5, names[5], [names[-5]])], "id int, name string, aliases array<string>")
    asked = spark.createDataFrame(list(enumerate(["vscode", "b", "data lake", "lakehouse", "-_ -", "abc x", "edit", "本語", "none at all", " ", "code code", "abcabc", "abc x"])), "query_id int, name string")
    from palimpsest.functions.text import candidate_rank, project_name

    known = projects.select("id", "name", project_name(F.col("name")).alias("norm"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: project_name(a)).alias("al"))
    every = asked.select("query_id", project_name(F.col("name")).alias("asked")).where("asked <> ''").crossJoin(known)
    want = every.withColumn("match", candidate_rank(F.col("asked"), F.col("norm"), F.col("al"))).where("match IS NOT NULL").select("query_id", "match", "id", "name")
    got = registry.rank_projects(asked, projects, limit=1000).select("query_id", "match", "id", "name")
    assert rows(got) == rows(want) and got.count() > 300
    plan = registry.rank_projects(asked.where("query_id < 4"), projects)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_insert_or_keep(spark):
    t = "session_id string, scope string, source_event_id string, content string"
    old = spark.createDataFrame([("a", "s", "e1", "old"), ("a", "s", None, "n1")], t)
    new = spark.createDataFrame([("a", "s", "e1", "new"), ("a", "s", "e2", "x"), ("a", "s", "e2", "y"), ("a", "s", None, "n1")], t)
    got = mutations.insert_or_keep(old, new, ["session_id", "scope", "source_event_id"])
    assert rows(got, "source_event_id", "content") == sorted([("e1", "old"), ("e2", "x"), (None, "n1"), (None, "n1")], key=str)


def test_entities(spark):
    entities = spark.createDataFrame([("1", "s", "Ada", ["The Countess"], ago(5)), ("2", "s", "ada", [], ago(9))], schemas.ENTITIES)
    names = spark.createDataFrame([("s", "ADA"), ("s", "the countess"), ("t", "Ada"), ("s", "Bob"), ("s", "bob")], "scope string, name string")
    assert rows(mutations.match_entities(names, entities), "scope", "name", "entity_id") == [("s", "ADA", "2"), ("s", "Bob", None), ("s", "bob", None), ("s", "the countess", "1"), ("t", "Ada", None)]
    assert mutations.insert_entities(names, entities, F.concat("scope", F.lower("name")), F.lit(T0)).count() == 4


def test_atom_changes(spark):
    atoms = spark.createDataFrame([(1, "s", "a", 0.5, False, "inferred"), (2, "s", "b", 0.5, None, "inferred")], "id int, scope string, statement string, confidence float, source_deleted boolean, origin string")
    changes = spark.createDataFrame([(1, None)], "id int, statement string")
    assert rows(mutations.update_atoms(atoms, changes, ["statement"]), "id", "statement", "confidence", "origin") == [(1, "a", 1.0, "asserted"), (2, "b", 0.5, "inferred")]
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    assert rows(mutations.forget(atoms, ids), "id", "source_deleted") == [(1, False), (2, True)]
    assert rows(mutations.forgotten(atoms, ids)) == [(2, True), (9, False)]
    said = mutations.asserted(spark.createDataFrame([("s", "x", "fact")], "scope string, statement string, category string"), F.lit("id1"), "remembered", F.lit(T0)).first()
    assert (said.origin, said.confidence, said.scene_name) == ("asserted", 1.0, "remembered")


DEST = "destination_id int, category string, scope string, title string, summary string, atom_ids array<int>, existing_row_id int, owner string, deadline timestamp, status string"
ROWS = "category string, id int, scope string, title string, summary string, owner string, deadline timestamp, status string, created_at timestamp, updated_at timestamp"


def test_gates(spark):
    atoms = spark.createDataFrame([(1, "weak", 0.7), (2, "strong", 0.8), (3, "unsure", None)], "id int, statement string, confidence float")
    l2 = spark.createDataFrame([("docs", 10, "s", "Topic", "Settled text. \n", None, None, None, T0, T0)], ROWS)

    def gated(ids, existing=None, title="TOPIC", **kw):
        d = spark.createDataFrame([(1, "docs", "s", title, "New.", ids, existing, None, None, None)], DEST)
        return synthesis.gated_summaries(d, atoms, l2, **kw).first().summary

    note = "Proposed, not yet applied:\n- "
    assert gated([2]) == "New."
    assert gated([1]) == "Settled text.\n\n" + note + "weak"
    assert gated([3, 1], existing=10) == "Settled text.\n\n" + note + "unsure\n- weak"
    assert gated([1], title="Other") == note + "weak"
    assert gated([1, 2]) == "New.\n\n" + note + "weak"
    assert gated([1, 2], project=True) == "Settled text.\n\n" + note + "weak"


def test_titles_meet_one_row_of_each_title(spark):
    """The join by title gives a row for each destination at once, however many rows share the title."""
    l2 = spark.createDataFrame([("docs", k, "s", "Topic" if k % 2 else "TOPIC", f"text {k}", None, None, None, T0, ago(k // 2 % 7)) for k in range(60)] + [("docs", 90, "s", None, "untitled", None, None, None, T0, T0)], ROWS)
    d = spark.createDataFrame([(k % 30, "docs", "s", "topic", "New.", [], None, None, None, None) for k in range(40)] + [(50, "docs", "s", None, "New.", [], None, None, None, None), (51, "docs", "s", "other", "New.", [], 7, None, None, None)], DEST)
    met = synthesis.matched_rows(d, l2)
    assert rows(met, "destination_id", "row_id", "settled") == sorted([(k % 30, 0, "text 0") for k in range(40)] + [(50, None, None), (51, 7, "text 7")], key=str)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "destination_id" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_task_upsert(spark):
    l2 = spark.createDataFrame([("tasks", 1, "s", "A", "a", "Ada", T0, "doing", T0, T0), ("docs", 2, "s", "B", "b", None, None, None, T0, T0)], ROWS)
    d = spark.createDataFrame([(1, "tasks", "s", "a", "a2", [], None, None, None, None), (2, "docs", "s", "b", "b2", [], None, "x", None, "done"), (3, "tasks", "s", "new", "n", [], None, "Bob", None, None)], DEST)
    out = synthesis.upsert_rows(l2, synthesis.matched_rows(d, l2), F.lit(ago(0)), F.lit(99))
    assert rows(out, "category", "id", "summary", "owner", "status") == [("docs", 2, "b2", None, None), ("tasks", 1, "a2", None, "doing"), ("tasks", 99, "n", "Bob", "todo")]


def test_versions(spark):
    docs = spark.createDataFrame([("1", "p", "a.md", "h1", 1, True), ("2", "p", "b.md", "h1", 1, True), ("3", "p", "a.md", "h0", 1, False), ("4", "p", "c.md", "h1", 1, True)], schemas.DOCUMENTS)
    files = spark.createDataFrame([("p", "a.md", "h0"), ("p", "b.md", "h1"), ("p", "d.md", "h1")], "project_id string, relative_path string, content_hash string")
    diff = versioning.version_diff(docs.where("is_active"), files)
    assert rows(diff, "relative_path", "status") == [("a.md", "changed"), ("b.md", "unchanged"), ("c.md", "deleted"), ("d.md", "new")]
    assert rows(versioning.import_counts(diff)) == [("p", 2, 1, 1)]
    after = versioning.next_documents(docs, diff)
    assert rows(after.where("is_active"), "relative_path", "content_hash") == [("a.md", "h0"), ("b.md", "h1"), ("d.md", "h1")]
    assert after.count() == 5


def test_cascade(spark):
    docs = spark.createDataFrame([("d1", "p", "a.md", "h", 1, True), ("d2", "p", "b.md", "h", 1, True)], schemas.DOCUMENTS)
    chunks = spark.createDataFrame([("d1", "t1", 0, "H", 1, 2, True), ("d2", "t2", 0, "H", 1, 2, True)], schemas.CHUNKS)
    edges = spark.createDataFrame([("x", "t1"), ("y", "t1"), ("y", "t2"), ("z", "t2")], schemas.ATOM_SOURCES)
    atoms = spark.createDataFrame([(i, "p", False) for i in "xyz"], "id string, project_id string, source_deleted boolean")
    links = spark.createDataFrame([("project_sections", "s1", "x"), ("project_sections", "s1", "z"), ("project_sections", "s2", "z")], schemas.L2_ATOMS)
    out = versioning.deactivation_cascade(spark.createDataFrame([("p", "a.md")], "project_id string, relative_path string"), docs, chunks, edges, atoms, links)
    assert rows(out["stale"]) == [("x",)] and rows(out["sections"]) == [("s1",)] and rows(out["refresh"]) == [("z",)]
    assert rows(out["chunks"], "turn_id", "is_active") == [("t1", False), ("t2", True)] and rows(out["documents"], "id", "is_active") == [("d1", False), ("d2", True)]


def test_cascade_meets_an_edge_once(spark):
    """A turn of many chunks and many edges gives no pairs of them; projects of others don't count."""
    docs = spark.createDataFrame([(f"d{k}", "pq"[k % 2], "a.md" if k < 30 else "b.md", "h", 1, True) for k in range(60)], schemas.DOCUMENTS)
    chunks = spark.createDataFrame([(f"d{k}", "t", 0, "H", 1, 2, k != 32) for k in range(60) if k < 30 or k % 2 == 0], schemas.CHUNKS)
    edges = spark.createDataFrame([(f"x{k}", "t") for k in range(60)], schemas.ATOM_SOURCES)
    atoms = spark.createDataFrame([(f"x{k}", "pqr"[k % 3] if k % 4 else None, False) for k in range(60)], "id string, project_id string, source_deleted boolean")
    gone = docs.where("relative_path = 'a.md'").select(*versioning.KEY).distinct()
    touched = versioning.touched_atoms(gone, docs, chunks, edges, atoms)
    assert rows(touched) == sorted((f"x{k}",) for k in range(60) if k % 4 and k % 3 < 2)
    after = docs.withColumn("is_active", F.col("relative_path") != "a.md")
    assert rows(versioning.stale_atoms(touched, atoms, edges, chunks, after), "id") == sorted((f"x{k}",) for k in range(60) if k % 4 and k % 3 == 1)
    for df in (touched, versioning._own_edges(edges, atoms, versioning._active_turns(chunks, after))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert [line for line in plan.splitlines() if "Join" in line and "turn_id" in line and "LeftSemi" not in line] == []


def test_quality_gate(spark):
    data = [("a", 1, "100.0"), ("a", 2, "x"), ("b", 1, "n"), ("c", 1, "1"), ("c", 2, None)] + [("d", k, "1") for k in range(9)] + [("d", 9, "bad")]
    records = quality_gate.transform(spark.createDataFrame(data, "batch_id string, id int, amount string"))
    gate = quality_gate.gate(records)
    assert rows(gate, "batch_id", "status", "issues") == [("a", "VALIDATION", "unparseable amount 'x'"), ("b", "FATAL", "unparseable amount 'n'"), ("c", "VALIDATION", "unparseable amount 'None'"), ("d", "PASS", "unparseable amount 'bad'")]
    allowed = spark.createDataFrame([("a",), ("b",)], "batch_id string")
    assert rows(quality_gate.commit_counts(quality_gate.committed(records, gate, allowed))) == [("a", 1), ("d", 10)]


@pytest.mark.parametrize("action, error, retry, fix, want", [("retry_same", "TRANSIENT", True, False, "retry_same"), ("retry_same", "VALIDATION", True, False, "ask_user"), ("retry_same", "TRANSIENT", False, False, "stop"), ("retry_with_correction", "VALIDATION", True, False, "ask_user"), ("retry_with_correction", "VALIDATION", True, True, "retry_with_correction"), ("refresh_and_retry", "FATAL", True, True, "stop"), ("ask_user", "RESOURCE", True, True, "stop")])
def test_recovery(spark, action, error, retry, fix, want):
    assert spark.range(1).select(quality_gate.normalized_action(*map(F.lit, (action, error, retry, fix)))).first()[0] == want


def test_step_results(spark):
    t = spark.createDataFrame([({"id": "3", "name": "Go", "to": {"name": None, "id": "9"}},)], "t struct<id:string,name:string,to:struct<name:string,id:string>>")
    assert tuple(t.select(quality_gate.flat_transition(F.col("t"))).first()[0]) == ("3", "Go", "9")
    got = spark.range(1).select(quality_gate.envelope(F.lit(False), F.lit("p"), F.lit("TRANSIENT"), F.lit("m"), F.lit(True))).first()[0]
    assert tuple(got) == ("fail", None, "TRANSIENT", "m", True)
    assert [r[0] for r in spark.createDataFrame([(404, True), (503, True), (403, False)], "s int, r boolean").select(quality_gate.failure_class(F.col("s"), F.col("r"))).collect()] == ["VALIDATION", "TRANSIENT", "RESOURCE"]


def test_run_events(spark):
    call = {"tool_name": "recall", "tool_call_id": "c1", "tool_args": ' {"q": 1} '}
    messages = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": " ok ", "tool_calls": [call]}, {"role": "tool", "content": "res", "tool_name": "recall"}, {"role": "assistant", "content": " "}]
    fill = lambda m: {k: m.get(k) for k in ("role", "content", "tool_calls", "tool_name", "tool_call_id")}
    runs = spark.createDataFrame([("7", "s", "sc", "x", [fill(m) for m in messages]), (None, "s2", "sc", "only", [])], f"run_id string, session_id string, scope string, content string, messages {agent.MESSAGES}")
    got = agent.run_events(runs).orderBy("run_id", "position").collect()
    assert [(r.source, r.content, r.tool_name, r.tool_call_id, r.source_event_id) for r in got] == [
        ("assistant", "only", None, None, None),
        ("assistant", '{"q": 1}', "recall", "c1", "agno:7:message:1:tool:0"),
        ("assistant", "ok", None, None, "agno:7:message:1:content"),
        ("tool", "res", "recall", "agno:7:message:2:tool-result", "agno:7:message:2:tool-result"),
    ]


def test_intents(spark):
    said = ["move scrum-8 to approved", "sync the rows", "draft a welcome", "pay 30", "ticket pending or rejected"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(m,) for m in said], "m string").select(agent.intent(F.col("m"))).collect()]
    assert got == [("jira", "SCRUM-8", "Approved"), ("complex", None, None), ("medium", None, None), ("simple", None, None), ("jira", None, "Rejected")]


def test_feedback(spark):
    choices = [("a", 0, "Project", "Other options"), ("a", 1, "Other options", "Recall memory"), ("b", 0, "Project", "Other options"), ("c", 0, "Project", "x"), ("d", 0, "y", "Cancel"), ("d", 1, "Other options", "Recall memory")]
    got = agent.feedback_phase(spark.createDataFrame(choices, "run_id string, position int, header string, option string"))
    assert rows(got) == [("a", "generic_recall"), ("b", "other_pending"), ("c", None), ("d", "cancelled")]


def test_dense_search_in_blocks(spark):
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0, float(k % 3)]) for k in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0])], "id int, dense array<float>")
    queries = spark.createDataFrame([(k, [float(k), 1.0, 0.5]) for k in range(7)] + [(8, None), (9, [0.0, 0.0, 0.0])], "query_id int, vector array<double>")
    whole, parts = retrieval.dense_topk(queries, vectors, 6), retrieval.dense_topk(queries, vectors.repartition(7), 6, block=2)
    assert rows(whole) == rows(parts) and whole.count() == 42
    first = whole.where("query_id = 0").orderBy("rank").collect()
    assert [r.id for r in first[:5]] == [10, 25, 0, 15, 30] and first[2].score == first[4].score


def _plain_lexical(points, queries, k, k1=1.2, b=0.75):
    """Best k points of each query by the sum of its terms' weights, one text at a time."""
    import re

    texts = {i: re.findall("[a-z0-9_]{2,}", (c or "").lower()) for i, c in points}
    lengths = [len(t) for t in texts.values() if t]
    mean = sum(lengths) / len(lengths)
    out = []
    for q, text in queries:
        terms, scored = set(re.findall("[a-z0-9_]{2,}", text.lower())), []
        for i, found in texts.items():
            score = sum(n * (k1 + 1) / (n + k1 * (1 - b + b * len(found) / mean)) for n in map(found.count, sorted(terms)) if n)
            if score:
                scored.append((-round(score, 9), i))
        out += [(q, i, rank + 1, round(-s, 6)) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_inverted_lists(spark, tmp_path):
    """Blocks, shards, parts and groups of queries: the same as a plain search; terms that aren't asked for are not read."""
    import random

    from palimpsest.operators import inverted, retrieval

    rng = random.Random(4)
    words = ["the", "a_b", "Spark", "x9", *(f"w{k}" for k in range(40))]
    texts = [(f"p{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(1500)] + [("none", None), ("long", "w1 " * 20_000), ("twin1", "w2 w3"), ("twin0", "w2 w3")]
    asked = [(q, " ".join(["the", *rng.sample(words, 3)])) for q in range(30)] + [(99, "! ?"), (98, "unheard"), (97, "w3 w2")]
    points, queries = spark.createDataFrame(texts, "id string, content string").repartition(3), spark.createDataFrame(asked, "query_id int, query string")
    lists = inverted.InvertedIndex.of_texts(points, f"file://{tmp_path}/lists")
    got = retrieval.lexical_topk(queries, lists, 5).collect()
    want = _plain_lexical(texts, asked, 5)
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == [w[:3] for w in want]
    assert [r.score for r in sorted(got, key=lambda r: (r.query_id, r.id))] == pytest.approx([w[3] for w in want], abs=2e-6)
    some = points.where("id < 'p0400'")
    got = retrieval.lexical_topk(queries, lists, 3, some).select("query_id", "id", "rank").collect()
    full = retrieval.lexical_topk(queries, lists, 1600).where("id < 'p0400'").collect()
    best = {}
    for r in sorted(full, key=lambda r: r["rank"]):
        best.setdefault(r.query_id, []).append(r.id)
    assert {(r.query_id, r.id, r["rank"]) for r in got} == {(q, i, n + 1) for q, ids in best.items() for n, i in enumerate(ids[:3])}
    read = lists.postings_of(spark.createDataFrame([("w7",)], "term string"))
    assert {r.term for r in read.collect()} == {"w7"} and len(read.inputFiles()) >= 1
    assert "PartitionFilters: [" in read._jdf.queryExecution().executedPlan().toString()
    assert lists.postings_of(spark.createDataFrame([("unheard",)], "term string")) is None
    none = retrieval.lexical_topk(queries.where("query_id = 98"), lists, 5)
    assert none.collect() == [] and none.columns == ["query_id", "id", "score", "rank"]


def test_lists_of_texts_are_counted_before_they_are_dealt(spark, tmp_path, monkeypatch):
    """No word is a row of a shuffle; parts grow with the texts; a block that batches part stays whole in a search."""
    from palimpsest.operators import inverted, retrieval

    texts = [(f"p{i:03d}", " ".join(f"w{i * k % 23}" for k in range(i % 9)) or None) for i in range(150)]
    spark.createDataFrame(texts, "id string, content string").repartition(2).write.parquet(f"{tmp_path}/texts")
    points = spark.read.parquet(f"{tmp_path}/texts")
    asked = [(q, f"w{q} w{q + 3} w0") for q in range(12)]
    monkeypatch.setattr(inverted, "TEXT_BYTES", 128)
    monkeypatch.setattr(inverted.InvertedIndex, "_written", classmethod(lambda cls, staged, rows, *x, _real=inverted.InvertedIndex._written.__func__: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or _real(cls, staged, rows, *x)))
    plans = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lists = inverted.InvertedIndex.of_texts(points, f"file://{tmp_path}/lists")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate explode" not in plans[0] and plans[0].index("Repartition") < plans[0].index("MapInArrow")
    parts = {r.part for r in lists._table("postings").select("part").distinct().collect()}
    assert len(parts) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = retrieval.lexical_topk(spark.createDataFrame(asked, "query_id int, query string"), lists, 4).collect()
    assert sorted((r.query_id, r.id, r["rank"], round(r.score, 6)) for r in got) == _plain_lexical(texts, asked, 4)


def test_grams_of_one_file_are_cut_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "shared_folder", lambda *x: f"file://{tmp_path}/names")
    projects = spark.createDataFrame([(k, f"ring {k}", ["x"]) for k in range(200)], "id int, name string, aliases array<string>").coalesce(1)
    asked = spark.createDataFrame([(1, "ring 7")], "query_id int, name string")
    assert rows(registry.rank_projects(asked, projects, 2), "id", "match") == [(7, 0), (70, 2)]
    assert len(list((tmp_path / "names" / "hits").glob("part-*"))) > 1


def test_block_maxima_leave_blocks_out():
    """A block whose greatest weights can't reach the k-th score isn't scored."""
    import pyarrow as pa

    from palimpsest.operators import inverted

    n, size = 16, inverted.BLOCK
    docs = pa.table({"block": pa.array([b for b in range(n) for _ in range(size)]), "ids": pa.array([[b * size + i] for b in range(n) for i in range(size)]), "at": pa.array([[i] for _ in range(n) for i in range(size)], pa.list_(pa.int32()))})
    weights = [[(1.0 if b else 2.0) - i / 1000 for i in range(size)] for b in range(n)]
    posts = pa.table({"block": pa.array(range(n)), "term": ["t"] * n, "top": [w[0] for w in weights], "at": pa.array([list(range(size))] * n, pa.list_(pa.int32())), "weights": weights})
    rows, scores, scored = inverted.Shard(docs, posts).search([[("t", 1.0)], [("unheard", 1.0)]], 5)
    assert rows[0].tolist() == [0, 1, 2, 3, 4] and scores[0].tolist() == pytest.approx(weights[0][:5]) and len(rows[1]) == 0
    assert scored == 1


def test_capture_of_whole_runs(spark):
    from palimpsest.operators import agent

    message = "struct<role:string,content:string,tool_calls:array<struct<tool_name:string,tool_call_id:string,tool_args:string>>,tool_name:string,tool_call_id:string>"
    runs = spark.createDataFrame([("r1", "chat", "s", " hello ", [("assistant", "hi", None, None, None)], None), ("r2", "chat", "s", "  ", [], "bye")], f"run_id string, session_id string, scope string, input string, messages array<{message}>, content string")
    got = agent.captured_turns(runs).collect()
    assert sorted((r.source, r.content, r.source_event_id) for r in got) == [("assistant", "bye", "agno:r2:assistant"), ("assistant", "hi", "agno:r1:message:0:content"), ("user", "hello", "agno:r1:user")]
    assert len({r.session_id for r in got}) == 1 and len(got[0].session_id) == 36


def test_tool_calls_of_any_shape(spark):
    calls = ['{"tool_name": "grep", "tool_call_id": "1", "tool_args": {"q": "x"}}', '{"id": 2, "function": {"name": "find", "arguments": "{}"}}', '{"tool_name": "", "tool_args": null, "arguments": "a"}', "{}", '"text"', "null"]
    told = [tuple(r.c) for r in spark.createDataFrame([(c,) for c in calls], "j string").select(agent.tool_call(F.parse_json("j")).alias("c")).collect()]
    assert told == [("grep", "1", ('{"q":"x"}', True)), ("find", "2", ("{}", False)), (None, None, (None, False)), (None, None, (None, False)), (None, None, (None, False)), (None, None, (None, False))]


def test_run_events_of_json(spark):
    """Arrays, objects that hold one, variants, contents of any kind, and what is no JSON."""
    one = '[{"role": "assistant", "content": null, "tool_calls": [{"id": "c1", "function": {"name": "remember", "arguments": {"b": "é", "a": [1, 2.5]}}}, "odd"]}, {"role": "tool", "content": {"ok": true}, "tool_name": "remember", "tool_call_id": ""}, 7, null, {"role": "assistant", "content": " said ", "tool_calls": null, "extra": {}}]'
    data = [("1", one), ("2", '{"messages": [{"role": "assistant", "content": 5}]}'), ("3", "no json"), ("4", None), ("5", "[]"), ("6", '[{"role": "assistant", "content": "  "}]')]
    runs = spark.createDataFrame([(i, "s", "sc", "own", m) for i, m in data], "run_id string, session_id string, scope string, content string, messages string")
    want = [("1", "assistant", '{"a": [1, 2.5], "b": "\\u00e9"}', "remember", "c1"), ("1", "assistant", "{}", None, None), ("1", "tool", '{"ok": true}', "remember", "agno:1:message:1:tool-result"), ("1", "assistant", "said", None, None)]
    want += [("2", "assistant", "5", None, None)] + [(i, "assistant", "own", None, None) for i in "3456"]
    for form in (runs, runs.withColumn("messages", F.try_parse_json("messages"))):
        got = agent.run_events(form).orderBy("run_id", "position").collect()
        assert [(r.run_id, r.source, r.content, r.tool_name, r.tool_call_id) for r in got] == want
    assert agent.run_events(runs.limit(0)).count() == 0


def test_inputs_of_intents(spark):
    from palimpsest.operators import agent

    said = ["move SCRUM-80 to approved and simulate a failure at step b", "welcome the missing user", "sync these rows", "unknown user", "12.50"]
    got = [r.i.asDict() for r in spark.createDataFrame([(m,) for m in said], "m string").select(agent.intent_input(F.col("m")).alias("i")).collect()]
    assert (got[0]["issue_key"], got[0]["target_status"], got[0]["simulate_failure_at"], got[0]["instruction"]) == ("SCRUM-80", "Approved", "B_transition", said[0])
    assert [g["user_id"] for g in got] == [None, "u2", None, "does-not-exist", None]
    assert [g["min_quality"] for g in got] == [None, None, 0.9, None, None] and got[4]["raw_amount"] == "12.50"


def test_canonical_json(spark):
    from palimpsest.functions.text import canonical_json

    given = ['{"b": 1, "a": {"d": "é", "c": null}}', ' "  text " ', "plain text ", "[3, 1]", "null", '"  "', None]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "j string").select(canonical_json("j")).collect()]
    assert got == ['{"a": {"c": null, "d": "\\u00e9"}, "b": 1}', "text", "plain text", "[3, 1]", None, None, None]


def test_small_sets(spark):
    from palimpsest.operators import extraction, mutations, pending, validation

    edges = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("b", "t3")], "atom_id string, turn_id string")
    turns = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t3",)], "id string")
    assert sorted(r.id for r in extraction.turns_that_are_sources(turns, edges).collect()) == ["t1", "t3"]
    assert sorted(r.id for r in mutations.covered_by_sources(turns.distinct(), edges).collect()) == ["t1", "t3"]
    assert [tuple(r) for r in mutations.new_edges(edges, edges.unionByName(spark.createDataFrame([("c", "t9"), ("c", "t9")], edges.schema))).collect()] == [("c", "t9")]
    open_ = spark.createDataFrame([("p", "s", 1), ("p", "s", 2), ("q", "s", 1)], "project_id string, scope string, n int")
    assert pending.projects_with_open_turns(open_).count() == 2
    judged = spark.createDataFrame([("s", "x", "fact", 0.5), (" ", "x", "fact", 0.5), ("s", "", "fact", 0.5), ("s", "x", "mood", 0.5), ("s", "x", "fact", 1.5), (None, "x", "fact", 0.5), ("s" * 121, "x", "fact", 0.5)], "scene_name string, statement string, category string, confidence double")
    assert [r.p for r in judged.select(validation.atom_problem().alias("p")).collect()] == [None, "scene_name", "statement", "category", "confidence", "scene_name", "scene_name"]
    made = spark.createDataFrame([("docs", "T", "S", ["a"], None), ("tasks", "T", "S", ["a"], "doing"), ("tasks", "T", "S", ["a"], "maybe"), ("atoms", "T", "S", ["a"], None), ("docs", "T" * 241, "S", ["a"], None), ("docs", "T", "S", [], None)], "category string, title string, summary string, atom_ids array<string>, status string")
    assert [r.p for r in made.select(validation.destination_problem(["docs", "tasks"]).alias("p")).collect()] == [None, None, "status", "category", "title", "atom_ids"]


def test_chunks_are_encoded_and_pooled(spark):
    from palimpsest.operators import pooling

    def encoder(texts):
        return [[float(len(t) <= 60), float("head" in t)] for t in texts]

    texts = spark.createDataFrame([("a", "word " * 40, "head"), ("b", "short", ""), ("c", None, None)], "id string, text string, breadcrumb string")
    assert {r.id: r.n for r in pooling.chunked_texts(texts, 60).groupBy("id").agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 1, "c": 1}
    got = {r.id: [round(x, 3) for x in r.dense] for r in pooling.embedded(texts, encoder, 2, 60).collect()}
    assert got == {"a": [0.707, 0.707], "b": [1.0, 0.0], "c": [1.0, 0.0]}
    sparse = {r.id: r.sparse for r in pooling.sparse_vectors(texts).collect()}
    assert set(sparse) == {"a", "b"} and len(sparse["a"]) == 1 and next(iter(sparse["a"].values())) > 2
