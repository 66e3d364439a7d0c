"""Embedding near-duplicates with a pivot-permutation index.

Reference points (pivots) are vectors of the table, chosen by hash and apart from
one another. A vector is described by its PREFIX nearest pivots in order. Inverted
lists lead from each pivot to the vectors that have it among them. In a list, the
number of pivots that two vectors share is counted; those that share at least
MIN_SHARED are candidates, in the list of the first pivot they share, so that each
pair is one once. Only candidates are verified by cosine, in double precision, and
every pair that is verified counts.

Lists are dealt in blocks of about BLOCK vectors; a task takes two blocks, counts
shared pivots with a matrix product, and gives, for each vector, the number of rows
it is linked with, and links enough to keep what is connected connected. Pairs are
not written out. Equal vectors are one class, which its smallest vec_id stands for.
Vectors go with the lists: with MIN_SHARED at 2, nearly every member of a list has
a candidate in it, so that fetching them afterwards would move as much again.

Each length of vectors has pivots of its own, and only vectors of one length meet.
Where random vectors are so near to one another that few are apart, as those of texts
often are, pivots are taken closer, more of them, and prefixes are longer (LEVELS).

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite
component, and rows with a null vec_id link with nothing; their component is their
own vec_id, and they are kept. Rows with
one vec_id are one vertex. Repeated rows each get a row and count as links of
each other. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Scratch, table

logger = logging.getLogger(__name__)

THRESHOLD = 0.95
PREFIX, MIN_SHARED = 8, 2
#: The number of pivots is PIVOT_RATE times the root of the number of vectors, within these bounds.
PIVOT_RATE, PIVOTS_LEAST, PIVOTS_MOST = 3.0, 64, 32768
#: Pivots are taken from so many times as many vectors.
PIVOT_OFFER = 2
#: The cosine that pivots are below of one another, and by how much prefixes and the number of pivots grow. A later
#: level is taken only where the one before gives less than ENOUGH of its number, and the later at least BETTER times as many.
LEVELS = ((0.75, 1.0, 1.0), (0.85, 1.5, 3.0), (0.9, 1.75, 4.0))
ENOUGH, BETTER = 0.25, 2.0
#: Vectors of a list that make a block, and candidates that are verified at a time.
BLOCK, AT_ONCE = 1024, 1 << 14


def pivot_count(n: int) -> int:
    return int(min(PIVOTS_MOST, max(PIVOTS_LEAST, PIVOT_RATE * math.sqrt(n))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(offered: np.ndarray, most: int, below: float = LEVELS[0][0]) -> np.ndarray:
    """The first `most` of the vectors offered that have cosines under `below` with all taken before.

    A dense group so has one pivot. Several would be ordered by chance within the group.
    """
    taken = np.empty((most, offered.shape[1]))
    n = 0
    for x in offered:
        if n == most:
            break
        if n == 0 or (taken[:n] @ x).max() < below:
            taken[n] = x
            n += 1
    return taken[:n]


def chosen(offer: Callable[[int], np.ndarray], most: int, prefix: int) -> tuple[np.ndarray, int]:
    """Pivots, and how many of the nearest describe a vector. offer: gives that many vectors, at the most."""
    best, length = None, prefix
    for below, longer, times in LEVELS:
        wanted = min(int(most * times), max(most, PIVOTS_MOST))
        offered = offer(PIVOT_OFFER * wanted)
        found = apart(offered, wanted, below)
        if best is None or len(found) >= BETTER * len(best):
            best, length = found, round(prefix * longer)
        if len(best) >= min(ENOUGH * wanted, len(offered)):
            break
    return best, length


def _classes(batches):
    """vec_id, embedding -> vec_id, width, vec (bytes) and key of usable vectors, nulls for others."""
    for batch in batches:
        width, vec, key = [], [], []
        for value in batch.column(1):
            usable = None
            if value.is_valid and len(value) and not value.values.null_count:
                x = value.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all() and x.any():
                    usable = (x + 0.0).astype(np.float64)  # -0.0 becomes 0.0
            if usable is None:
                width.append(None), vec.append(None), key.append(None)
            else:
                raw = usable.astype(np.float32) if (usable.astype(np.float32) == usable).all() else usable
                width.append(len(usable)), vec.append(raw.tobytes()), key.append(xxhash.xxh3_128_digest(usable.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(vec, pa.binary()), pa.array(key, pa.binary())], ["vec_id", "width", "vec", "vec_key"])


def _matrix(column, width: int) -> np.ndarray:
    out = np.empty((len(column), width))
    for i, v in enumerate(column):
        raw = v.as_buffer()
        out[i] = np.frombuffer(raw, np.float32 if len(raw) == 4 * width else np.float64)
    return out


def _nearest(pivots: dict[int, tuple[int, np.ndarray, int]]):
    """mapInArrow function; pivots: by width, the number of the first, the vectors, and how many describe one. Rows of other widths are left out."""

    def run(batches):
        for batch in batches:
            widths = batch.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                if width not in pivots:
                    continue
                first, points, prefix = pivots[width]
                own = batch if (widths == width).all() else batch.filter(pa.array(widths == width))
                for a in range(0, own.num_rows, 4096):
                    part = own.slice(a, 4096)
                    x = unit(_matrix(part.column(2), width))
                    near = x @ points.T
                    k = min(prefix, near.shape[1])
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
                    top = (first + np.take_along_axis(top, order, 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(top), pa.list_(pa.int32()))], [*part.schema.names, "nearest"])

    return run


def candidates(nearest: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, min_shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of left and one of right that share at least min_shared pivots, `pivot` being the smallest of them."""
    numbers, column = np.unique(nearest, return_inverse=True)
    holds = np.zeros((len(nearest), len(numbers)), np.float32)
    holds[np.arange(len(nearest))[:, None], column.reshape(nearest.shape)] = 1
    here = int(np.searchsorted(numbers, pivot))
    before, rest = holds[:, :here], holds[:, here:]
    found = rest[left] @ rest[right].T >= min_shared
    if here:
        found &= before[left] @ before[right].T == 0
    i, j = np.nonzero(found)
    return left[i], right[j]


def _compare(threshold: float, min_shared: int):
    """Group function of a pair of blocks, whose vectors have one width: (id, linked, other): links counted in rows, and connecting links."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, weight, block = (table.column(n).to_numpy() for n in ("rep", "weight", "block"))
        pivot, diagonal = table.column("pivot")[0].as_py(), table.column("diagonal")[0].as_py()
        m = len(ids)
        nearest = table.column("nearest").combine_chunks().flatten().to_numpy().reshape(m, -1)
        left = right = np.arange(m)
        if not diagonal:
            left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        l, r = candidates(nearest, pivot, left, right, min(min_shared, nearest.shape[1])) if len(left) and len(right) else (left[:0], left[:0])  # noqa: E741
        if diagonal:
            l, r = l[l < r], r[l < r]  # noqa: E741
        x = unit(_matrix(table.column("vec"), table.column("width")[0].as_py())) if len(l) else None
        close = [np.einsum("ij,ij->i", x[l[a : a + AT_ONCE]], x[r[a : a + AT_ONCE]]) >= threshold for a in range(0, len(l), AT_ONCE)]
        close = np.concatenate(close) if close else np.empty(0, bool)
        l, r = l[close], r[close]  # noqa: E741
        linked = np.zeros(m, np.int64)
        np.add.at(linked, l, weight[r])
        np.add.at(linked, r, weight[l])
        label, edges = np.arange(m), []
        at = np.searchsorted(l, np.arange(m + 1))  # l is in order
        for i in np.unique(l).tolist():
            for j in r[at[i] : at[i + 1]][label[r[at[i] : at[i + 1]]] != label[i]].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    edges.append((ids[i], ids[j]))
        has = np.flatnonzero(linked)
        e = np.array(edges, np.int64).reshape(-1, 2)
        alone = np.concatenate([np.ones(len(has), bool), np.zeros(len(e), bool)])
        return pa.table({
            "id": pa.array(np.concatenate([ids[has], e[:, 0]]), pa.int64()), "linked": pa.array(np.concatenate([linked[has], np.zeros(len(e), np.int64)])),
            "other": pa.array(np.concatenate([np.zeros(len(has), np.int64), e[:, 1]]), pa.int64(), mask=alone),
        })

    return run


def _offer(classes: DataFrame, width: int):
    """Gives the first vectors by their keys, that is, by hash."""

    def offer(most: int) -> np.ndarray:
        rows = classes.select("vec_key", "vec").orderBy("vec_key").limit(most).collect()
        return unit(np.stack([np.frombuffer(r["vec"], np.float32 if len(r["vec"]) == 4 * width else np.float64) for r in rows]))

    return offer


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, min_shared: int = MIN_SHARED, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    rows = scratch.keep(slim.mapInArrow(_classes, "vec_id long, width int, vec binary, vec_key binary"), "rows")
    linking = rows.where("width IS NOT NULL AND vec_id IS NOT NULL")
    classes = scratch.keep(linking.groupBy("width", "vec_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "classes")
    points, taken = {}, 0
    for width, n in sorted(classes.groupBy("width").count().where("count > 1").collect()):
        most = pivots or pivot_count(n)
        found, length = chosen(_offer(classes.where(F.col("width") == width), width), most, prefix)
        if len(found) < min(PIVOTS_LEAST, n) and len(found) < most:
            logger.warning("%d pivots for %d vectors of width %d: lists are long, results are whole", len(found), n, width)
        points[width] = taken, found, length
        taken += len(found)
    indexed = classes.select("width", "rep", "vec", "weight").mapInArrow(_nearest(points), "width int, rep long, vec binary, weight long, nearest array<int>")
    indexed = scratch.keep(indexed, "indexed")
    lists = indexed.select(F.explode("nearest").alias("pivot")).groupBy("pivot").agg(F.count("*").alias("n")).where("n > 1").select(F.col("pivot").alias("p"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = indexed.select("width", "rep", "vec", "weight", "nearest", F.explode("nearest").alias("pivot")).join(F.broadcast(lists), F.col("pivot") == F.col("p"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("width", "rep", "vec", "weight", "nearest", "pivot", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") == F.col("other")).alias("diagonal"))
    found = scratch.keep(dealt.groupBy("pivot", "low", "high").applyInArrow(_compare(threshold, min_shared), "id long, linked long, other long"), "found", small=True)
    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("linked").alias("linked"))
    names = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    named = (
        classes.select("vec_key", "rep", "weight")
        .join(counts, F.col("rep") == F.col("id"), "left")
        .drop("id")
        .join(names, F.col("rep") == F.col("id"), "left")
        .select(F.col("vec_key").alias("k"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("c"))
    )
    linked = linking.join(named, F.col("vec_key") == F.col("k"), "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    others = rows.where("width IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).select("*", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE list_aggregate(list_transform(e, lambda x: abs(x)), 'sum') > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach(id, root) AS (SELECT a, a FROM link UNION SELECT link.b, r.root FROM reach r JOIN link ON link.a = r.id WHERE r.root < link.b),
c AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN deg ON deg.a = e.vec_id LEFT JOIN c ON c.id = e.vec_id
"""
