"""Registered queries of the engine, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import extraction, recall, upkeep

ALL = {**extraction.CATALOG, **recall.CATALOG, **upkeep.CATALOG}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in ALL.items() if q.sql is not None}
