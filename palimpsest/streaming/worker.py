"""The worker as a stream: turns come in micro-batches, and each batch ends with one round of the jobs.

Every commit of a batch keeps the batch's number in the manifest, with the tables it
changes: a batch that is replayed after a failure goes on where it was, and commits
nothing twice. What each session has pending is kept as a table, changed by what comes
and goes (operators.pending), so no batch counts the turns of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..jobs import Jobs, Run
from ..sources import markdown

#: Columns of turns as they come; those that a stream lacks are null.
COLUMNS = ["session_id", "scope", "source", "content", "tool_name", "tool_call_id", "source_event_id", "source_path", "source_heading", "source_start_line", "source_end_line", "source_hash"]


def heartbeat(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """turns, and a row without a session every second, so that sessions fall due while nothing comes."""
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return turns.unionByName(beat.select(*[F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in turns.columns]))


class StreamWorker:
    """Ingests a stream of turns and runs the jobs after each batch."""

    def __init__(self, jobs: Jobs, name: str = "worker", now: Column | None = None):
        self.jobs, self.name, self.now = jobs, name, now
        self.last: Run | None = None

    def batch(self, turns: DataFrame, number: int) -> None:
        """One batch, or what is left of it."""
        stream = f"{self.name}/ingest"
        if not self.jobs.store.seen(stream, number):
            self.jobs.ingest(turns.where("session_id IS NOT NULL OR content IS NOT NULL"), self.now, batch=(stream, number))
        self.last = self.jobs.run_once(self.now, stream=(self.name, number))

    def start(self, turns: DataFrame, checkpoint: str, every: str | None = "30 seconds") -> StreamingQuery:
        """Run on (or, with every=None, until all that is there is done)."""
        turns = turns.select(*[c for c in COLUMNS if c in turns.columns])
        writer = turns.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


class FolderWorker:
    """Imports a project's folder again whenever files in it change. An import that is run twice finds nothing new the second time."""

    def __init__(self, jobs: Jobs, folder: str, project: str, now: Column | None = None):
        self.jobs, self.folder, self.project, self.now = jobs, folder, project, now
        self.told: list[dict[str, int]] = []

    def batch(self, files: DataFrame, number: int) -> None:
        if not files.isEmpty():
            self.told.append(self.jobs.import_documents(self.folder, self.project, self.now))

    def start(self, checkpoint: str, every: str = "30 seconds", settle_seconds: float = markdown.SETTLE_SECONDS) -> StreamingQuery:
        changes = markdown.stream_markdown(self.jobs.memory.spark, self.folder, settle_seconds=settle_seconds).select("relative_path")
        return changes.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
