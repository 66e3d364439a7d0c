"""Streams against the batch operators, over the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.streaming import triggers

T0 = dt.datetime(2024, 1, 1)
TURN = "id long, session_id long, scope string, created_at timestamp, source_event_id string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def drain(df, spark, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_due_sessions(spark, tmp_path):
    volume = [(k, 1, "s", at(k), None) for k in range(5)]
    quiet = [(10, 2, "s", at(1), None), (11, 2, "s", at(2), None)]
    later = [(12, 3, "s", at(60), None)]
    last = [(13, 3, "s", at(61), None)]
    got = drain(triggers.due_sessions(stream(spark, tmp_path, [volume + quiet, later, last], TURN), minutes=15, cap=5), spark, tmp_path, "due")
    assert sorted((r.session_id, r.reason, r.pending, r.last_turn_at) for r in got) == [(1, "volume", 5, at(4)), (2, "inactivity", 2, at(2))]


def test_replayed_events(spark, tmp_path):
    rows = [(1, 1, "s", at(0), "e1"), (2, 1, "s", at(1), "e1"), (3, 1, "s", at(1), None), (4, 1, "s", at(1), None), (5, 2, "s", at(1), "e1")]
    got = drain(triggers.distinct_turns(stream(spark, tmp_path, [rows, rows[:2]], TURN)), spark, tmp_path, "turns")
    assert sorted(r.id for r in got if r.session_id == 2 or r.source_event_id is None) == [3, 4, 5]
    assert sum(r.source_event_id == "e1" and r.session_id == 1 for r in got) == 1


def test_budget_equals_batch(spark, tmp_path):
    calls = [[("a", 0), ("b", 1), ("a", 2)], [("a", 3), ("a", 4)], [("b", 5)]]
    schema = "run_id string, arrival long"
    got = drain(triggers.budgeted_calls(stream(spark, tmp_path, calls, schema)), spark, tmp_path, "calls", "append")
    want = retrieval.attempts(spark.createDataFrame([c for b in calls for c in b], schema)).collect()
    assert sorted((r.run_id, r.arrival, r.attempt) for r in got) == sorted((r.run_id, r.arrival, r.attempt) for r in want)


def test_pending_counts(spark, tmp_path):
    rows = [[(1, 1, "s", at(0), None), (2, 1, "s", at(3), None)], [(3, 1, "s", at(2), None)]]
    got = drain(triggers.pending_counts(stream(spark, tmp_path, rows, TURN)), spark, tmp_path, "counts", "complete")
    assert [(r.session_id, r.pending, r.last_turn_at) for r in got] == [(1, 3, at(3))]
