"""Date, vector and score scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(now: Column, since: Column, minutes: int) -> Column:
    """Whether `minutes` or more have passed; false for null."""
    return F.coalesce(now - since >= F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def parse_iso(text: Column) -> Column:
    return F.to_timestamp(text)


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def overlap(query: Column, terms: Column) -> Column:
    """Share of the query's distinct terms that are among `terms`."""
    return F.size(F.array_intersect(query, terms)) / F.greatest(F.size(query), F.lit(1))


def keyword_score(query: Column, terms: Column, retrieval: Column) -> Column:
    return clamp01(F.lit(0.8) * overlap(query, terms) + F.lit(0.2) * clamp01(retrieval))


def parsed_amount(text: Column) -> Column:
    return text.try_cast("double")
