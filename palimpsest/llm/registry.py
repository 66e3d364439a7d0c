"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive, decontaminate, merkle, minhash, mixing, pivots, quality, repeats, resample, sharding, threshold, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivots": pivots.op1_pivots,
        "op2_sharding": sharding.op2_sharding,
        "op3_mixing": mixing.op3_mixing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_minhash": minhash.op5_minhash,
        "op6_repeats": repeats.op6_repeats,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_archive": archive.op9_archive,
        "op10_quality": quality.op10_quality,
        "op11_merkle": merkle.op11_merkle,
        "op12_resample": resample.op12_resample,
        "op13_topk": threshold.op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pivots": pivots.ORACLE,
        "op2_sharding": sharding.ORACLE,
        "op5_minhash": minhash.ORACLE,
        "op6_repeats": repeats.ORACLE,
        "op7_decontaminate": decontaminate.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op9_archive": archive.ORACLE,
        "op11_merkle": merkle.ORACLE,
        "op12_resample": resample.ORACLE,
        "op13_topk": threshold.ORACLE,
    }
