"""Pooling of chunk vectors into one vector for each text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import EMBED_CHARS, embed_chunks
from ..functions.scalars import norm

#: Sparse weights: saturation, share of the length, and the length (in terms) that counts as usual.
SATURATION, LENGTH_SHARE, USUAL_LENGTH = 1.2, 0.75, 256


def pooled_dense(chunks: DataFrame, key: str = "id", vector: str = "dense") -> DataFrame:
    """Mean of a key's vectors, at unit length; a zero mean stays. Vectors of unequal length raise."""
    parts = chunks.select(key, F.size(vector).alias("width"), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min("width").alias("lo"), F.max("width").alias("hi"))
    lists = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lists = lists.where(F.assert_true(F.col("lo") == F.col("hi"), "vectors have unequal lengths").isNull())
    size = norm(F.col("mean"))
    return lists.select(key, F.when(size == 0, F.col("mean")).otherwise(F.transform("mean", lambda x: x / size)).alias(vector))


def pooled_sparse(chunks: DataFrame, key: str = "id") -> DataFrame:
    """Greatest weight of each index: (key, idx, weight) rows."""
    return chunks.groupBy(key, "idx").agg(F.max("weight").alias("weight"))


def sparse_arrays(weights: DataFrame, key: str = "id") -> DataFrame:
    """key, indices, values in order of the index."""
    packed = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("w"))
    return packed.select(key, F.transform("w", lambda x: x["idx"]).alias("indices"), F.transform("w", lambda x: x["weight"]).alias("values"))


def chunked_texts(texts: DataFrame, limit: int = EMBED_CHARS) -> DataFrame:
    """id, chunk of texts (id, text, breadcrumb): pieces within an encoder's limit, each headed by the breadcrumb."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series, crumb: pd.Series) -> pd.Series:
        return pd.Series([embed_chunks(t, limit, c) for t, c in zip(text.fillna(""), crumb.fillna(""))], dtype=object)

    return texts.select("id", F.explode(cut("text", "breadcrumb")).alias("chunk"))


def embedded(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], dimensions: int, limit: int = EMBED_CHARS) -> DataFrame:
    """id, dense of texts (id, text, breadcrumb): cut, encoded, and pooled into one vector for each id."""
    chunks = chunked_texts(texts, limit).withColumn("dense", encoded(F.col("chunk"), encoder, dimensions))
    return pooled_dense(chunks).withColumn("dense", F.col("dense").cast("array<float>"))


def sparse_vectors(texts: DataFrame) -> DataFrame:
    """id, sparse (hashed term -> weight) of texts (id, text): saturated term frequencies, damped by length."""
    terms = texts.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("terms"))
    counted = terms.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy("id", F.xxhash64("term").alias("idx")).agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    weight = F.col("tf") * (SATURATION + 1) / (F.col("tf") + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("n") / USUAL_LENGTH))
    return counted.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", weight.alias("w"))))).alias("sparse"))


def sparse_encoded(texts: DataFrame, encoder: Callable[[list[str]], list[dict[int, float]]], limit: int = EMBED_CHARS) -> DataFrame:
    """id, sparse (index -> weight) of texts (id, text, breadcrumb): cut, encoded by a hook, and of each index the greatest weight over the chunks."""

    @F.pandas_udf("array<struct<idx:bigint,weight:double>>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"idx": int(i), "weight": float(w)} for i, w in v.items()] for v in encoder(batch.fillna("").tolist())], dtype=object)

    chunks = chunked_texts(texts, limit).withColumn("v", run("chunk")).select("id", F.inline("v"))
    return pooled_sparse(chunks).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "weight")))).alias("sparse"))


def encoded(texts: Column, encoder: Callable[[list[str]], list[list[float]]], dimensions: int) -> Column:
    """Hook of a dense encoder: a batch of texts in, a batch of vectors of `dimensions` out."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        vectors = encoder(batch.fillna("").tolist())
        if any(len(v) != dimensions for v in vectors):
            raise ValueError(f"the encoder gave vectors of another length than {dimensions}")
        return pd.Series(vectors)

    return run(texts)
