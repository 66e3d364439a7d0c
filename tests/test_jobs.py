"""The jobs end to end over a store, with judges that follow rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest import jobs, schemas
from palimpsest.api import Memory
from palimpsest.operators import liveness

T0 = dt.datetime(2024, 1, 1)
TURN = "session_id string, scope string, source string, content string, source_event_id string"


def at(minutes):
    return F.lit(T0 + dt.timedelta(minutes=minutes))


def judges():  # local, so that they are sent by value
    def extraction(payload):
        import json

        p = json.loads(payload)
        if any("poison" in t["content"] for t in p["new_turns"]):
            raise RuntimeError("the model is down")
        if any("nonsense" in t["content"] for t in p["new_turns"]):
            return "no json"
        if any("stray" in t["content"] for t in p["new_turns"]):
            return json.dumps([{"scene_name": "s", "atoms": [{"statement": "x", "category": "fact", "confidence": 0.9, "source_turn_ids": ["elsewhere", "nowhere"]}]}])
        ids = [t["id"] for t in p["new_turns"]]
        atoms = [{"statement": f"{len(ids)} turns, {len(p['recent_atoms'])} known", "category": "fact", "entity": "Ada  L", "confidence": 0.9, "source_turn_ids": ids}]
        atoms.append({"statement": "unsure", "category": "fact", "confidence": 0.2, "source_turn_ids": ids})
        return json.dumps([{"scene_name": "talk", "atoms": atoms}])

    def synthesis(payload):
        import json

        p = json.loads(payload)
        ids = [a["id"] for a in p["new_atoms"]]
        if p["scope"] == "broken":
            return json.dumps([{"category": "nowhere", "title": "T", "summary": "S", "atom_ids": ids}])
        return json.dumps([{"category": "docs", "title": "Topic", "summary": f"{len(ids)} atoms, {len(p['existing_rows'])} rows", "atom_ids": ids}])

    return {"extraction_judge": extraction, "synthesis_judge": synthesis, "project_synthesis_judge": synthesis}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_run_isolates_what_fails(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", buckets=2)
    worker = jobs.Jobs(memory, **judges(), turn_cap=2)
    said = [("a", "s", "user", "one", "e1"), ("a", "s", "assistant", "two", "e2"), ("a", "s", "user", "three", "e3"), ("b", "s", "user", "poison", None), ("c", "s", "user", "nonsense", None), ("d", "broken", "user", "four", None), ("d", "broken", "user", "five", None), ("f", "s", "user", "stray", None)]
    bad = worker.ingest(spark.createDataFrame([*said, ("e", "s", "robot", "x", None), ("e", "s", "user", "  ", None)], TURN), at(0))
    assert rows(bad, "session_id", "problem") == [("e", "content"), ("e", "source")]
    worker.ingest(spark.createDataFrame([("a", "s", "user", "again", "e1")], TURN), at(1))
    t = memory.store.table
    assert t("turns").count() == 8 and t("turns").where("content = 'again'").count() == 0
    # too early for all but the session that reached its cap
    assert rows(worker.status(at(1)).where("due"), "session_id") == [("a",), ("d",)]
    run = worker.extract(at(20))
    assert run.asked == {"extraction": 5} and run.done == {"extraction": 2}
    assert sorted((r.key, r.error.split(":")[0]) for e in run.errors for r in e.collect()) == [("b/s", "RuntimeError"), ("c/s", "the reply is not what was asked for"), ("f/s", "a source is not in the batch")]
    assert rows(t("atoms"), "scope", "statement", "origin") == [("broken", "2 turns, 0 known", "inferred"), ("s", "2 turns, 0 known", "inferred")]
    entities = {r.id: (r.scope, r.name) for r in t("entities").collect()}
    assert sorted(entities.values()) == [("broken", "Ada L"), ("s", "Ada L")] and {r.entity_id for r in t("atoms").collect()} == set(entities)
    assert t("extraction_coverage").count() == 4 and rows(t("extraction_attempts"), "session_id") == [("a",), ("d",)]
    # one turn of session a is left, without corroboration: nothing is written, the cursor moves on
    run = worker.extract(at(40))
    assert run.done == {"extraction": 1} and t("atoms").count() == 2 and t("entities").count() == 2
    run = worker.synthesize(at(80))
    assert run.done == {"synthesis": 1} and [r.error for e in run.errors for r in e.collect()] == ["category"]
    assert rows(t("l2_rows"), "category", "scope", "title", "summary") == [("docs", "s", "Topic", "1 atoms, 0 rows")]
    assert t("l2_atoms").count() == 1 and t("synthesis_coverage").count() == 1
    assert {r.source_table for r in t("index_points").collect()} == {"atoms", "docs"}
    assert t("index_points").where("sparse IS NULL").count() == 0
    # a further batch of the scope meets the row by its title
    worker.ingest(spark.createDataFrame([("g", "s", "user", "six", None), ("g", "s", "user", "seven", None)], TURN), at(100))
    total = worker.drain(at(200), most=5)
    assert total.done == {"project_extraction": 0, "extraction": 1, "synthesis": 0, "project_synthesis": 0}  # the new atom isn't idle yet
    assert worker.drain(at(300), most=5).done["synthesis"] == 1
    assert rows(t("l2_rows"), "title", "summary") == [("Topic", "1 atoms, 1 rows")] and t("l2_atoms").count() == 2
    found = memory.recall(spark.createDataFrame([(0, "turns known")], "query_id int, query string"), scope="s", sources=["atoms"], least=0.1).collect()
    assert len(found) == 2 and all(r.entity == "Ada L" and r.scope == "s" for r in found)


def counts_hold(t):
    """Whether the kept counts of live sources are those counted anew."""
    anew = liveness.source_counts(t("atom_sources"), t("project_document_chunks"), t("project_documents"))
    return rows(t("source_counts"), "atom_id", "project_id", "live") == rows(anew, "atom_id", "project_id", "live")


def test_documents_of_a_project(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}/m", buckets=2)
    memory.register_projects(spark.createDataFrame([("s", "Engine", [], None), ("s", "Other", [], None)], "scope string, name string, aliases array<string>, root_path string"))
    project, other = (r.id for r in memory.list_projects().collect())
    worker, t = jobs.Jobs(memory, **judges()), memory.store.table
    folder = tmp_path / "docs"
    (folder / "env").mkdir(parents=True)
    (folder / "a.md").write_text("# A\n\nfirst")
    (folder / "b.md").write_text("# B\n\nsecond")
    (folder / "env" / "c.md").write_text("# C\n\npassed over")
    counts = lambda c: (c["imported"], c["unchanged"], c["deleted"], c["chunks"])
    with pytest.raises(KeyError):
        worker.import_documents(str(folder), "none")
    first, run = worker.import_and_drain(str(folder), project, at(0))
    assert counts(first) == (2, 0, 0, 2) and run.done == {"project_extraction": 1, "project_synthesis": 1}
    turn = t("turns").where("source_path = 'a.md'").first()
    assert (turn.session_id, turn.scope, turn.source, turn.tool_name, turn.source_heading, turn.source_start_line, turn.source_end_line) == (project, "s", "tool", "project_document", "A", 1, 3)
    assert turn.source_event_id == f"project-document:{project}:a.md:{turn.source_hash}:0" == turn.tool_call_id
    assert rows(t("atoms"), "project_id", "statement") == [(project, "2 turns, 0 known")]
    assert rows(t("l2_rows"), "category", "project_id", "title") == [("project_sections", project, "Topic")]
    assert counts_hold(t) and [r.live for r in t("source_counts").collect()] == [2]
    assert counts(worker.import_documents(str(folder), project, at(10))) == (0, 2, 0, 0)
    assert worker.extract(at(10), project=True).asked == {"project_extraction": 0}
    # records of a project are seen with it alone
    ids = t("atoms").select("id").unionByName(t("l2_rows").select("id"))
    assert memory.fetch(ids).count() == 0 and memory.fetch(ids, project=project).count() == 2 and memory.fetch(ids, project=other).count() == 0
    assert memory.fetch(ids, scope="s", project=project).count() == 2
    with pytest.raises(KeyError):
        memory.fetch(ids, scope="x", project=project)
    assert memory.drill_down(t("atoms").select("id"), "atoms").count() == 0
    assert memory.drill_down(t("atoms").select("id"), "atoms", project=project).count() == 2
    # a change and a deletion: the atom has lost both of its sources
    (folder / "a.md").write_text("# A\n\nchanged")
    (folder / "b.md").unlink()
    third = worker.import_documents(str(folder), project, at(20))
    assert counts(third) == (1, 0, 1, 1) and (third["stale"], third["sections"]) == (1, 1)
    assert counts_hold(t) and t("source_counts").count() == 0
    assert t("atoms").where("source_deleted").count() == 1 and t("l2_rows").count() == 0 and t("l2_atoms").count() == 0 and t("index_points").count() == 0
    assert rows(t("project_documents").where("is_active"), "relative_path") == [("a.md",)] and t("project_documents").count() == 3
    # back to the old text: its version and its turn come back
    (folder / "a.md").write_text("# A\n\nfirst")
    again, run = worker.import_and_drain(str(folder), project, at(30))
    assert counts(again) == (1, 0, 0, 1) and t("project_documents").count() == 3
    active = t("project_documents").where("is_active").collect()
    assert [(r.relative_path, r.byte_size) for r in active] == [("a.md", 10)]
    assert t("turns").where("source_path = 'a.md'").count() == 2
    assert rows(jobs.sections_of(t("l2_rows"), project), "title") == []
    assert counts_hold(t) and [r.live for r in t("source_counts").collect()] == [1]
    worker.upkeep()
    assert counts_hold(t)


def test_scopes(spark, tmp_path):
    def encoder(texts):
        return [[float(t.startswith("query")), float(len(t)), float("Quartz" in t)] for t in texts]

    memory = Memory(spark, f"file://{tmp_path}/m", encoder, 3, default_scope="s")
    made = memory.remember(spark.createDataFrame([("s", "Quartz holds vectors", "fact"), ("t", "Spark runs plans", "fact")], "scope string, statement string, category string"))
    ids = {r.scope: r.id for r in made.collect()}
    assert len(memory.store.versions()) == 1  # one commit
    everything = spark.createDataFrame([(i,) for i in ids.values()], "id string")
    assert [r.scope for r in memory.fetch(everything).collect()] == ["s"]
    assert sorted(r.scope for r in memory.fetch(everything, all_scopes=True).collect()) == ["s", "t"]
    for wrong in ({"scope": " "}, {"scope": "s", "all_scopes": True}):
        with pytest.raises(ValueError):
            memory.fetch(everything, **wrong)
    with pytest.raises(Exception, match="no such atom"):
        memory.update(spark.createDataFrame([(ids["t"], "x")], "id string, statement string"))
    assert {(r.id, r.found) for r in memory.forget(everything).collect()} == {(ids["s"], True), (ids["t"], False)}
    assert [r.scope for r in memory.fetch(everything, all_scopes=True).collect()] == ["t"]
    points = {r.scope: r for r in memory.store.table("index_points").collect()}
    assert set(points) == {"t"} and len(points["t"].sparse) == 3 and len(points["t"].dense) == 3
    asked = spark.createDataFrame([(0, "plans of Spark")], "query_id int, query string")
    for mode in ("bm25", "vector", "hybrid"):
        assert [r.id for r in memory.recall(asked, mode=mode, sources=["atoms"], scope="t").collect()] == [ids["t"]]


def test_payloads(spark):
    turns = spark.createDataFrame([("t2", "x", "s", "tool", 'say "hi"', "grep", "c1", None, T0 + dt.timedelta(1)), ("t1", "x", "s", "user", "a\nb", None, None, "doc.md", T0)], "id string, session_id string, scope string, source string, content string, tool_name string, tool_call_id string, source_path string, created_at timestamp")
    atoms = spark.createDataFrame([tuple({"id": f"a{k}", "scope": s, "statement": f"st{k}", "scene_name": f'sc"{k}', "project_id": p, "created_at": T0 + dt.timedelta(k)}.get(f.split()[0]) for f in schemas.ATOMS.split(", ")) for k, s, p in ((1, "s", None), (2, "s", None), (3, "s", "p"), (4, "u", None))], schemas.ATOMS)
    entities = spark.createDataFrame([("e", "s", "Ada", ["A"], T0)], schemas.ENTITIES)
    from palimpsest.operators import pending

    got = json.loads(pending.extraction_payloads(turns, atoms, entities, n=1).first().payload)
    assert [t["id"] for t in got["new_turns"]] == ["t1", "t2"] and got["new_turns"][0]["source_path"] == "doc.md" and "source_path" not in got["new_turns"][1]
    assert got["new_turns"][0]["tool_name"] is None and got["new_turns"][1]["content"] == 'say "hi"'
    assert got["recent_scene"] == 'sc"2' and [a["id"] for a in got["recent_atoms"]] == ["a2"] and got["known_entities"] == [{"name": "Ada", "id": "e", "aliases": ["A"]}]
    assert got["project_id"] is None and got["document_mode"] is False
    empty = json.loads(pending.extraction_payloads(turns, atoms.limit(0), entities.limit(0)).first().payload)
    assert empty["recent_scene"] is None and empty["recent_atoms"] == [] == empty["known_entities"]
    rows_ = spark.createDataFrame([tuple({"category": c, "id": f"r{k}", "scope": "s", "title": "T", "summary": "S", "updated_at": T0 + dt.timedelta(k)}.get(f.split()[0]) for f in schemas.L2_ROWS.split(", ")) for k, c in ((1, "docs"), (2, "docs"), (3, "tasks"), (4, "project_sections"))], schemas.L2_ROWS)
    batch = pending.synthesis_batches(atoms.where("scope = 's' AND project_id IS NULL"))
    got = json.loads(pending.synthesis_payloads(batch, rows_, entities, ["docs", "tasks"]).first().payload)
    assert [a["id"] for a in got["new_atoms"]] == ["a1", "a2"] and got["scene_names"] == ['sc"1', 'sc"2']
    assert [(r["category"], r["id"]) for r in got["existing_rows"]] == [("docs", "r2"), ("docs", "r1"), ("tasks", "r3")]
