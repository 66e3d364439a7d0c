"""Bounded samples of rows, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def sample_ids(ids: DataFrame, keep: list[str], bound: int, seed: int = 7) -> DataFrame:
    """At most `bound` rows of ids, those of the smallest hash of doc_id."""
    h = F.xxhash64("doc_id", F.lit(seed))
    return ids.select("doc_id", *keep, h.alias("h")).orderBy("h", "doc_id", *keep).limit(bound).drop("h")
