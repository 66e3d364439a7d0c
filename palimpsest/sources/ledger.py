"""Replies of models, kept by the hash of what was asked: a payload is asked once, whatever is run again.

A task asks one payload and its reply is part of the ledger as soon as the task has
ended, even if the job then fails, so a lost task asks its own payload again and a
rerun those without a reply. A model's failure is written, too, but counts as no
reply; a reply that breaks the caller's rules can be rejected, and is asked for anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import SnapshotStore

Model = Callable[[str], str]
#: Payloads of a job, each a task.
WAVE = 4096
SCHEMA = "asked string, reply string, error string, run string, at timestamp"


class ReplyLedger:
    def __init__(self, store: SnapshotStore, name: str):
        self.store, self.spark, self.path = store, store.spark, f"{store.root}/_replies/{name}"

    def _rows(self) -> DataFrame:
        if not self.store._listed(self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def replies(self) -> DataFrame:
        """asked (hash), reply: of each payload's entries the last, where that is a reply."""
        last = self._rows().groupBy("asked").agg(F.max_by("reply", F.struct("at", F.col("reply").isNotNull())).alias("reply"))
        return last.where("reply IS NOT NULL")

    def _append(self, rows: DataFrame) -> None:
        # a task's file is where it stays once the task has ended, not when the job has
        rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)

    def ask(self, payloads: DataFrame, model: Model) -> DataFrame:
        """payloads (..., payload) with asked, reply, and error where the model failed, in place of payload."""

        @F.pandas_udf("struct<reply:string,error:string>")
        def call(texts: pd.Series) -> pd.DataFrame:
            out = []
            for text in texts:
                try:
                    out.append((model(text), None))
                except Exception as e:  # one payload's failure is its own
                    out.append((None, f"{type(e).__name__}: {e}"))
            return pd.DataFrame(out, columns=["reply", "error"])

        run = uuid.uuid4().hex
        hashed = self.store.staged(payloads.withColumn("asked", F.sha2("payload", 256)))
        while True:
            done = self.replies().select("asked").unionByName(self._rows().where(F.col("run") == run).select("asked"))
            wave = hashed.select("asked", "payload").dropDuplicates(["asked"]).join(done, "asked", "left_anti").limit(WAVE)
            wave = self.store.staged(wave)
            n = wave.count()
            if not n:
                break
            told = wave.repartition(n).withColumn("r", call("payload"))
            self._append(told.select("asked", "r.reply", "r.error", F.lit(run).alias("run"), F.current_timestamp().alias("at")))
            if n < WAVE:
                break
        failed = self._rows().where((F.col("run") == run) & F.col("error").isNotNull()).groupBy("asked").agg(F.max("error").alias("error"))
        return hashed.drop("payload").join(self.replies(), "asked", "left").join(failed, "asked", "left").withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))

    def reject(self, asked: DataFrame, why: str = "rejected") -> None:
        """Payloads (asked) whose replies are of no use: they are asked for again."""
        none = F.lit(None).cast("string")
        self._append(asked.select("asked", none.alias("reply"), F.lit(why).alias("error"), F.lit("").alias("run"), F.current_timestamp().alias("at")))
