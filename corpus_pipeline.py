"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, minhash, mixing, quality, sharding
from palimpsest.llm.storage import Scratch, table

STAGES = [
    ("quality", quality.stage),
    ("near_dedup", minhash.stage),
    ("decontaminate", decontaminate.stage),
    ("mix", mixing.stage),
    ("shard", sharding.stage),
]

#: The classifier, MinHash and the random mix are beyond SQL; tests check the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
