"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the source's
target over its size. The whole part is certain; the fraction is rounded in the
pivotal manner: two documents with fractional copies exchange words (fraction
times size) at random, so that expectations stay, until one of them has no
fraction. A group of documents so leaves one fractional document at most; these
residuals meet in the next level of a reduction tree with a fixed fan-in, until
one document a source is left, which is rounded by chance. The words that a
source gives thus differ from its target by less than one document.

Random numbers are hashes of the seed, the level and the document, so reruns
agree.

Defined results: rows with the same id, source and size are one unit and get the
same number of copies. A null text has size 0; documents of size 0 give no words.
A null source is a source, the last in order. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table
from .textkit import utf8

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 20240229
#: Documents in a leaf, and leaves (or nodes) that meet in a node of the tree.
LEAF_DOCS, FAN_IN = 512, 64
#: Up to this number of documents that the mix takes, their copies are broadcast to the texts; beyond it, texts are shuffled once.
BROADCAST_ROWS = 1_000_000


def _count_words(batches):
    for batch in batches:
        sizes = [len(t.split()) if t else 0 for t in utf8(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words separated by space and \\t-\\r)."""
    slim = docs.select(F.col("doc_id").cast("long"), "source", "text")
    return slim.mapInArrow(_count_words, "doc_id long, source string, size long")


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, units, rank: sources by code point, null last.

    A range sort ranks them; what reaches the driver is the number of sources of each of its partitions.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    at = F.monotonically_increasing_id()
    placed = scratch.keep(totals.orderBy(F.col("source").asc_nulls_last()).select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "sources", small=True)
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    offset = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0).cast("long")
    return placed.select("source", "source_size", "units", (offset + F.col("nth")).alias("rank"))


def source_targets(sizes: DataFrame, scratch: Scratch, cycle: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, units, target of each source.

    Targets share the sum of sizes by weight, none above cap times its size, the
    excess reshared: a round sums what is at its cap, and the weights of the rest,
    over all sources, until no more sources reach their caps.
    """
    weight = F.element_at(F.array(*map(F.lit, cycle)), F.pmod("rank", F.lit(len(cycle))).cast("int") + 1)
    sources = ranked_sources(sizes, scratch).withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    free = F.col("source_size") > 0
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0))).first()
    rest, left, capped = total, weights, 0
    while left:
        over = free & (rest * F.col("weight") / left > F.col("most"))
        n, full, still = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(free & ~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped:
            break
        rest, left, capped = total - full, still, n
    share = F.least(rest * F.col("weight") / left, F.col("most")) if left else F.col("most")
    return sources.select("source", "source_size", "units", F.when(free, share).otherwise(F.lit(0.0)).alias("target"))


def pivot(mass: np.ndarray, limit: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of masses 0 < mass < limit: final masses (0 or limit), and the index left fractional, or -1."""
    out = mass.astype(np.float64).copy()
    held = -1
    for i in range(len(out)):
        if not 0.0 < out[i] < limit[i]:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        up, down = min(limit[held] - a, b), min(a, limit[i] - b)
        move = up if draws[i] * (up + down) < down else -down
        a, b = a + move, b - move
        # which of the two became whole follows from the comparison, not from rounded sums
        if move > 0:
            held_whole, i_whole = move >= limit[held] - out[held], move >= out[i]
            a, b = (limit[held] if held_whole else a), (0.0 if i_whole else b)
        else:
            held_whole, i_whole = -move >= out[held], -move >= limit[i] - out[i]
            a, b = (0.0 if held_whole else a), (limit[i] if i_whole else b)
        out[held], out[i] = a, b
        held = i if held_whole and not i_whole else -1 if held_whole else held
    return out, held


def _draw(seed: int, level: int, ids: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}/{level}/{i}".encode()) / 2.0**64 for i in ids])


def _node(seed: int, level: int, last: bool):
    """Group function over Arrow columns, in which an id stays a whole number beside a null one."""

    def run(table: pa.Table) -> pa.Table:
        names = ["null" if i is None else str(i) for i in table.column("doc_id").to_pylist()]
        limit, draws, size = table.column("limit").to_numpy(), _draw(seed, level, names), table.column("size").to_numpy()
        order = np.lexsort((size, draws, -limit))
        table, limit, draws = table.take(order), limit[order], draws[order]
        out, held = pivot(table.column("mass").to_numpy(), limit, draws)
        extra = np.where((limit > 0) & (out >= limit), 1.0, 0.0)
        open_ = np.zeros(len(extra), bool)
        if held >= 0:
            again = _draw(seed + 1, level, [names[order[held]]])[0]
            extra[held], open_[held] = float(again * limit[held] < out[held]), not last
        table = table.set_column(table.schema.get_field_index("mass"), "mass", pa.array(out))
        return table.append_column("extra", pa.array(extra, mask=open_))

    return run


def mix_sizes(sizes: DataFrame, cycle: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, leaf_docs: int = LEAF_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, source, size, n (rows of the unit), source_size, target, copies."""
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mixing")
    units = scratch.keep(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    targets = scratch.keep(source_targets(units.withColumn("size", F.col("size") * F.col("n")), scratch, cycle, cap), "targets", small=True)
    most = targets.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaves = F.ceil(F.col("units") / leaf_docs)
    rows = (
        units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.floor(rate))
        .withColumn("limit", (F.col("size") * F.col("n")).cast("double"))
        .withColumn("mass", (rate - F.col("whole")) * F.col("limit"))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), leaves))
        .select("doc_id", "source", "size", "n", "source_size", "target", "whole", "limit", "mass", "node")
    )
    schema = "doc_id long, source string, size long, n long, source_size long, target double, whole long, limit double, mass double, node long, extra double"
    nodes, level, done = max(1, -(-most // leaf_docs)), 0, []
    while True:
        last = nodes <= 1
        made = scratch.keep(rows.groupBy("source", "node").applyInArrow(_node(seed, level, last), schema), f"level{level}")
        done.append(made.where("extra IS NOT NULL") if not last else made)
        if last:
            break
        rows = made.where("extra IS NULL").drop("extra").withColumn("node", F.floor(F.col("node") / fan_in))
        nodes, level = -(-nodes // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("extra")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, source, text, ...), each as often as the mix takes it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("of"), "text")
    plan = mix_sizes(word_counts(docs), **options).where("copies > 0").select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_of"), F.col("size").alias("plan_words"), "copies")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    met = _with_size(rows).join(plan, F.col("id").eqNullSafe(F.col("plan_id")) & F.col("of").eqNullSafe(F.col("plan_of")) & (F.col("words") == F.col("plan_words")))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _with_size(rows: DataFrame) -> DataFrame:
    """rows with words in place of the last column, a text."""

    def count(batches):
        for batch in batches:
            n = pa.array([len(t.split()) if t else 0 for t in utf8(batch.column(batch.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "words"])

    return rows.mapInArrow(count, rows.drop("text").select("*", F.lit(0).cast("long").alias("words")).schema)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix_sizes(word_counts(docs))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("row")).drop("row")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)
