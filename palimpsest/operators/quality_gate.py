"""Batch transform, quality gate and the routing of failed steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parsed_amount

MIN_QUALITY = 0.8


def transform(records: DataFrame) -> DataFrame:
    """records (batch_id, id, amount as text) with parsed amount, valid and issue."""
    number = parsed_amount(F.col("amount"))
    valid = number.isNotNull()
    return records.withColumn("valid", valid).withColumn("issue", F.when(~valid, F.concat(F.lit("unparseable amount '"), F.coalesce("amount", F.lit("None")), F.lit("'")))).withColumn("amount", number)


def gate(transformed: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """batch_id, total, invalid, status (PASS, FATAL, VALIDATION), issues in order of id."""
    bad = F.collect_list(F.when(~F.col("valid"), F.struct("id", "issue")))
    out = transformed.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(~F.col("valid")).alias("invalid"), F.sort_array(bad).alias("bad"))
    ratio = F.col("invalid") / F.col("total")
    status = F.when(ratio <= F.lit(1.0) - F.lit(min_quality), "PASS").when(F.col("invalid") == F.col("total"), "FATAL").otherwise("VALIDATION")
    return out.select("batch_id", "total", "invalid", status.alias("status"), F.array_join(F.transform("bad", lambda b: b["issue"]), "; ").alias("issues"))


def committed(transformed: DataFrame, gated: DataFrame, drop_invalid: DataFrame | None = None) -> DataFrame:
    """Records that may be written: of batches that pass, and the valid ones of batches where dropping is allowed."""
    passed = transformed.join(gated.where("status = 'PASS'").select("batch_id"), "batch_id", "left_semi")
    if drop_invalid is None:
        return passed
    allowed = gated.where("status = 'VALIDATION'").join(drop_invalid.select("batch_id"), "batch_id", "left_semi")
    return passed.unionByName(transformed.where("valid").join(allowed.select("batch_id"), "batch_id", "left_semi"))


def commit_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("batch_id").agg(F.count("*").alias("committed"))


def missing_fields(records: DataFrame, required: list[str]) -> DataFrame:
    """records with the array of required fields that are null."""
    return records.withColumn("missing", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull()))


def route(success: Column, attempt: Column, most: int) -> Column:
    return F.when(success, "success").when(attempt >= most, "give_up").otherwise("recover")


def normalized_action(action: Column, error: Column, retryable: Column, has_fix: Column) -> Column:
    """The recovery action that the error allows."""
    stop_or_ask = F.when(error == "VALIDATION", "ask_user").otherwise("stop")
    fatal = error.isin("FATAL", "RESOURCE")
    same = (action == "retry_same") & (~retryable | F.coalesce(error != "TRANSIENT", F.lit(True)))
    other = action.isin("retry_with_correction", "refresh_and_retry") & ~retryable
    return F.when(fatal, "stop").when(same | other, stop_or_ask).when((action == "retry_with_correction") & ~has_fix, "ask_user").otherwise(action)


def options(records: DataFrame, items: str, path: str, label: str) -> DataFrame:
    """id, path, label of distinct options (by path) in an array of structs."""
    flat = records.select("id", F.posexplode(items).alias("pos", "o")).select("id", "pos", F.col(f"o.{path}").alias("path"), F.col(f"o.{label}").alias("label"))
    return flat.groupBy("id", "path").agg(F.min_by("label", "pos").alias("label"))


def sync_outcome(attempt: Column) -> Column:
    """The rehearsed dependency: it times out on the first two attempts."""
    return F.when(F.coalesce(attempt, F.lit(0)) < 2, "TRANSIENT").otherwise("OK")


def failure_class(status: Column, retryable: Column) -> Column:
    """Error class of an API failure: a missing record is the caller's to correct."""
    return F.when(status == 404, "VALIDATION").when(retryable, "TRANSIENT").otherwise("RESOURCE")


def flat_transition(transition: Column) -> Column:
    """id, name and to_status of a nested transition (id, name, to: name, id)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    target = F.coalesce(F.nullif(text(transition["to"]["name"]), F.lit("")), text(transition["to"]["id"]))
    return F.struct(text(transition["id"]).alias("id"), text(transition["name"]).alias("name"), target.alias("to_status"))


def envelope(ok: Column, payload: Column, error: Column, message: Column, retry: Column) -> Column:
    """Result of a step: payload, or error class, message and whether to retry."""
    return F.named_struct(F.lit("status"), F.when(ok, "ok").otherwise("fail"), F.lit("payload"), F.when(ok, payload), F.lit("error_status"), F.when(~ok, error), F.lit("message"), F.when(~ok, message), F.lit("retry"), ~ok & retry)
