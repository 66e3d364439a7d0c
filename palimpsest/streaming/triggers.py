"""Streaming forms of the triggers and of the recall budget.

State is kept for each key (a session, a run) with applyInPandasWithState; the
batch operators in operators.pending give the same answers over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pending import IDLE_MINUTES, TURN_CAP
from ..operators.retrieval import MAX_ATTEMPTS

DUE = "session_id long, scope string, reason string, pending long, last_turn_at timestamp"


def due_sessions(turns: DataFrame, minutes: int = IDLE_MINUTES, cap: int = TURN_CAP, late: str = "1 minute") -> DataFrame:
    """session_id, scope, reason (volume, inactivity), pending, last_turn_at whenever a session falls due.

    turns is a stream of (id, session_id, scope, created_at) of uncovered turns. A
    session falls due with its cap-th turn, or when event time has passed its last
    turn by `minutes`; its pending turns then count as attempted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, last = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            out.append((*key, "inactivity", pending, pd.Timestamp(last, unit="us")))
            state.remove()
        else:
            stamps = pd.concat([f["created_at"] for f in frames]).sort_values()
            for ts in stamps:
                pending += 1
                last = max(last, int(ts.value // 1000))
                if pending >= cap:
                    out.append((*key, "volume", pending, pd.Timestamp(last, unit="us")))
                    pending = 0
            if pending:
                state.update((pending, last))
                state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["session_id", "scope", "reason", "pending", "last_turn_at"])

    marked = turns.withWatermark("created_at", late)
    return marked.groupBy("session_id", "scope").applyInPandasWithState(step, DUE, "pending long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_turns(turns: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of turns without replayed events; rows without an event id pass."""
    own = F.coalesce("source_event_id", F.concat(F.lit("row:"), F.col("id").cast("string")))
    return turns.withColumn("__event", own).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["session_id", "scope", "__event"]).drop("__event")


def budgeted_calls(calls: DataFrame, most: int = MAX_ATTEMPTS, forget: str = "1 hour") -> DataFrame:
    """run_id, arrival, attempt (null beyond the budget) of a stream of calls (run_id, arrival)."""
    keep_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("arrival")
        n = used + 1 + pd.Series(range(len(rows)), index=rows.index)
        rows["attempt"] = n.where(n <= most).astype("Int64")
        state.update((min(most, used + len(rows)),))
        state.setTimeoutDuration(keep_ms)
        yield rows[["run_id", "arrival", "attempt"]]

    return calls.groupBy("run_id").applyInPandasWithState(step, "run_id string, arrival long, attempt long", "used long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pending_counts(turns: DataFrame) -> DataFrame:
    """Running pending count and last turn of each session, for a sink in update mode."""
    return turns.groupBy("session_id", "scope").agg(F.count("*").alias("pending"), F.max("created_at").alias("last_turn_at"))
