"""Sharding by extendible hashing.

Documents are keyed by 60 bits of a digest of their id. A directory maps each
key prefix to a shard. It starts at the depth that the total size suggests plus
a few bits; the bytes of its cells are rolled up to every shorter prefix, and a
shard is the shortest prefix that fits the byte limit, so that only oversized
buckets are split on another bit. Cells that are still too large get further
bits in the next round, alone.

Where rows of one id exceed the limit after the last bit, they are numbered in a
written table and their number is hashed in place of the id. Only a single row
larger than the limit makes a shard larger than the limit.

Defined results: a null id is keyed like the text 'null'; a null text has no
bytes; an empty table has no shards. Repeated rows each get a row. Extra columns
stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table

LIMIT_BYTES = 8 << 20
#: Limit of the registered query, at which tables of a few megabytes split unevenly, too.
QUERY_LIMIT_BYTES = 256 << 10
BITS = 60
#: Bits that the directory has beyond what the mean load needs.
SLACK_BITS = 3
ROUND_BITS = 8


def hash_key(value: Column) -> Column:
    """60-bit key: the first 15 hexadecimal digits of MD5."""
    text = F.coalesce(value.cast("string"), F.lit("null")).cast("binary")
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def _cell(key: Column, depth: int) -> Column:
    return F.shiftright(key, BITS - depth)


def _leaves(cells: DataFrame, depth: int, floor: int, limit: int, scratch: Scratch) -> DataFrame:
    """cell -> depth and size of its shard: the shortest prefix of at least `floor` bits that fits; null if none fits.

    Cells meet the prefixes that fit, from the shortest of these on, so that a prefix
    gets no more rows than it has cells, and none that is known to be too large any.
    """
    prefix = F.expr(f"shiftright(cell, {depth} - d)").alias("prefix")
    sums = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("d")).select("d", prefix, "bytes", "docs")
    fits = scratch.keep(sums.groupBy("d", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(F.col("shard_bytes") <= limit), f"fits{depth}", small=True)
    least = fits.agg(F.coalesce(F.min("d"), F.lit(depth))).first()[0]
    prefixes = cells.select("cell", F.explode(F.sequence(F.lit(least), F.lit(depth))).alias("d")).select("cell", "d", prefix)
    best = prefixes.join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min(F.struct("d", "prefix", "shard_bytes", "shard_docs")).alias("b")).select("cell", "b.*")
    return cells.select("cell").join(best, "cell", "left")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """docs with shard (its bits, after a level number for renumbered rows), shard_depth, shard_bytes, shard_docs.

    Columns of docs that have these names are replaced.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), hash_key(F.col(id_col)).alias("key"), size.alias("size"))
    return _assign(rows, limit_bytes, 0).select("row.*", *ADDED)


ADDED = ("shard", "shard_depth", "shard_bytes", "shard_docs")


def _assign(rows: DataFrame, limit_bytes: int, level: int) -> DataFrame:
    """rows (row, key, size) with the columns of ADDED."""
    scratch = Scratch(rows.sparkSession, "sharding")
    keyed = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs")), "keys")
    total = keyed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SLACK_BITS)
    floor, rounds, todo = 0, [], keyed
    while True:
        cells = todo.groupBy(_cell(F.col("key"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        leaves = scratch.keep(_leaves(cells, depth, floor, limit_bytes, scratch), f"depth{depth}", small=True)
        rounds.append((depth, leaves.where("d IS NOT NULL")))
        over = leaves.where("d IS NULL").select("cell")
        done = over.isEmpty()
        if done or depth == BITS:
            break
        todo = todo.join(over, _cell(F.col("key"), depth) == F.col("cell"), "left_semi")
        floor, depth = depth + 1, min(BITS, depth + ROUND_BITS)
    out, found = rows, []
    for k, (at, leaves) in enumerate(rounds):
        named = leaves.select(F.col("cell").alias(f"cell{k}"), F.struct("d", "prefix", "shard_bytes", "shard_docs").alias(f"leaf{k}"))
        out = out.join(named, _cell(F.col("key"), at) == F.col(f"cell{k}"), "left").drop(f"cell{k}")
        found.append(F.col(f"leaf{k}"))
    leaf = F.coalesce(*found)
    bits = F.when(leaf["d"] == 0, F.lit("")).otherwise(F.lpad(F.conv(leaf["prefix"].cast("string"), 10, 2), leaf["d"], F.lit("0")))
    name = F.when(leaf["d"].isNotNull(), F.concat(F.lit(f"{level}:"), bits))
    placed = out.select("row", "key", "size", name.alias("shard"), leaf["d"].alias("shard_depth"), leaf["shard_bytes"].alias("shard_bytes"), leaf["shard_docs"].alias("shard_docs"))
    if done:
        return placed
    single = placed.where("shard IS NULL").select("row", "key", "size")
    if level:  # numbered rows: each is alone under its key
        last = single.select("*", F.concat(F.lit(f"{level}:"), F.lpad(F.conv(F.col("key").cast("string"), 10, 2), BITS, "0")).alias("shard"), F.lit(BITS).alias("shard_depth"), F.col("size").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"))
        return placed.where("shard IS NOT NULL").unionByName(last)
    numbered = scratch.keep(single.select("row", "size", F.monotonically_increasing_id().alias("number")), "numbered")
    again = _assign(numbered.select("row", hash_key(F.col("number")).alias("key"), "size"), limit_bytes, 1)
    return placed.where("shard IS NOT NULL").unionByName(again)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder of Parquet for each shard."""
    assigned = assign_shards(docs, **options)
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = sized.select(F.struct("doc_id", "n_bytes").alias("row"), hash_key(F.col("doc_id")).alias("key"), F.col("n_bytes").alias("size"))
    return _assign(rows, QUERY_LIMIT_BYTES, 0).select("row.doc_id", "row.n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards."""
    return assign_shards(docs)


ORACLE = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k FROM documents),
p AS (SELECT doc_id, n_bytes, d.d, k >> (60 - d.d) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS d) d),
s AS (SELECT d, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY d, prefix HAVING sum(n_bytes) <= {QUERY_LIMIT_BYTES}),
l AS (SELECT doc_id, n_bytes, min(p.d) AS d FROM p JOIN s USING (d, prefix) GROUP BY doc_id, n_bytes)
SELECT l.doc_id, l.n_bytes, '0:' || CASE WHEN l.d = 0 THEN '' ELSE right(bin(p.prefix + (1::BIGINT << 61)), l.d) END AS shard, CAST(l.d AS INTEGER) AS shard_depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM l JOIN p ON p.doc_id = l.doc_id AND p.d = l.d JOIN s ON s.d = p.d AND s.prefix = p.prefix
"""
