"""JSON objects of records, as a service's callers get them: named fields, ISO times, optional ones only where they are set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import iso

# The fields of each kind of record.
TURN = ["id", "session_id", "scope", "source", "content", "tool_name", "tool_call_id", "source_event_id", "created_at"]
TURN_OPTIONAL = ["project_id", "source_path", "source_heading", "source_start_line", "source_end_line", "source_hash"]
ATOM = ["id", "scope", "statement", "category", "origin", "entity", "predicate"]
PROJECT = ["id", "scope", "name", "aliases", "root_path"]
RESULT = ["id", "source_table", "title", "content", "scope", "score", "category", "entity", "predicate", "origin", "scene_name", "metadata"]
_IDS = {"id", "session_id", "project_id"}


def iso_short(ts: Column) -> Column:
    """ISO time; without a fraction where that is zero."""
    return F.regexp_replace(F.regexp_replace(iso(ts), r"\.000000", ""), "Z$", "+00:00")


def _field(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string").alias(name)
    kind = df.schema[name].dataType.typeName()
    value = F.col(name).cast("string") if name in _IDS else iso_short(F.col(name)) if kind in ("timestamp", "timestamp_ntz") else F.date_format(name, "yyyy-MM-dd") if kind == "date" else F.col(name)
    if name == "aliases":
        value = F.coalesce(value, F.array().cast("array<string>"))
    return value.alias(name)


def as_objects(df: DataFrame, fields: list[str], optional: list[str] = ()) -> DataFrame:
    """df with json: its fields (null where there is none), and the optional ones that are set."""
    fixed = F.to_json(F.struct(*[_field(df, f) for f in fields]), {"ignoreNullFields": "false"})
    there = [f for f in optional if f in df.columns]
    if not there:
        return df.withColumn("json", fixed)
    more = F.to_json(F.struct(*[_field(df, f) for f in there]))
    return df.withColumn("json", F.when(F.length(more) > 2, F.concat(F.substr(fixed, F.lit(1), F.length(fixed) - 1), F.lit(","), F.substr(more, F.lit(2)))).otherwise(fixed))


def turns(df: DataFrame) -> DataFrame:
    return as_objects(df, TURN, TURN_OPTIONAL)


def atoms(df: DataFrame) -> DataFrame:
    return as_objects(df, ATOM)


def projects(df: DataFrame) -> DataFrame:
    return as_objects(df, PROJECT)


def results(df: DataFrame) -> DataFrame:
    return as_objects(df, RESULT)
