"""Queries over tables that go beyond the small ids."""

from palimpsest.plans import recall


def test_hydrated_results_reach_late_events(spark):
    tables = {
        "events": spark.createDataFrame([(4, 0.1), (999, 0.2), (1000, 0.3), (1001, 0.4), (70_000, 0.5)], "event_id long, value double"),
        "atoms": spark.createDataFrame([(12, "a", None, False), (3000, "b", None, False), (210_000, "c", None, False)], "id long, statement string, supersedes long, source_deleted boolean"),
        "l2_rows": spark.createDataFrame([("tasks", 2997, "t1", "s1"), ("tasks", 3003, "t2", "s2"), ("users", 3003, "t3", "s3")], "category string, id long, title string, summary string"),
        "entities": spark.createDataFrame([], "id long, scope string, name string, aliases array<string>"),
    }
    tables["atoms"] = tables["atoms"].selectExpr("*", "'s' AS scope", "'fact' AS category", "CAST(NULL AS BIGINT) AS entity_id", "CAST(NULL AS BIGINT) AS project_id")
    tables["l2_rows"] = tables["l2_rows"].selectExpr("*", "'s' AS scope", "CAST(NULL AS BIGINT) AS project_id")
    got = sorted((r.query_id, r.id, r.title, r.content) for r in recall.hydrated_results(tables.get).collect())
    assert got == [(4, 12, None, "a"), (999, 2997, "t1", "s1"), (1000, 3000, None, "b"), (1001, 3003, "t2", "s2"), (70_000, 210_000, None, "c")]


def test_project_rank_reaches_late_parts(spark):
    parts = [(1999, "old small ring", "Brand#1", "T", 1), (2000, "small ring", "Brand#2", "T", 2), (50_000, "late", "Brand#7", "ECONOMY", 11)]
    tables = {"part": spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), "region": spark.range(1)}
    tables["projects"] = tables["part"].selectExpr("p_partkey AS id", "p_name AS name", "array(p_brand, concat(p_type, '-', CAST(p_size AS STRING))) AS aliases").where("id < 2000")
    got = {(r.query_id, r.id, r.match) for r in recall.project_rank(tables.get).collect()}
    assert {(0, 2000, 0), (0, 1999, 2), (2, 50_000, 1), (4, 50_000, 1)} <= got
