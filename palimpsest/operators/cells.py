"""Exact nearest vectors by cosine over stored cells: cells that can't hold one of the best k are not read.

Vectors are scaled to unit length and put into the cell of the nearest centre. Centres
come from a few rounds of spherical k-means on a sample of bounded size. A cell's
radius is the greatest angle between its centre and one of its vectors, so no vector
of it is nearer to a query than the query's angle to the centre less the radius:
that bounds the cosine. Cells are folders (partitions) of the stored table.

A search has two rounds. First each query is compared with the cells of the highest
bounds that together hold k vectors; then with the cells whose bounds don't lie below
its k-th score of the first round. Both read only folders that some query needs. A
cell is dealt to tasks in parts of about PART vectors, however many it holds, and a
task reads its vectors, then the queries that ask for them, one batch at a time.

Null vectors, zero ones, those with null or non-finite components, and those of
another length than `dimensions` match nothing and are matched by nothing.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from .pending import first_n

#: Cells are CELL_RATE times the root of the number of vectors, within these bounds; vectors of the sample for each centre.
CELL_RATE, CELLS_LEAST, CELLS_MOST, SAMPLE = 1.0, 4, 1024, 32
ROUNDS = 8
#: Vectors of a cell that a task holds.
PART = 8192
DECIMALS = 12
#: How far rounding may take a bound or a score.
SLACK = 1e-9


def unit_rows(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch are usable, and these at unit length in double precision."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == width)
    x = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good] / np.abs(x[good]).max(1, keepdims=True)
    return fits[good], x / np.sqrt((x * x).sum(1, keepdims=True))


def centres_of(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """n centres (or fewer) of unit vectors: each the mean direction of those nearest to it; the first are far from one another."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        at = int(np.argmin(near))
        if near[at] > 1 - SLACK:
            break
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > SLACK, total / np.maximum(size, SLACK), c)
    return c


def bounds(near: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The greatest cosine that a vector of each cell can have with each query, from the cosines to the centres and the radii (angles)."""
    return np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius, 0))


def _assigned(centres: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                keep, x = unit_rows(part.column(1), centres.shape[1])
                near = x @ centres.T
                cell = np.argmax(near, axis=1) if len(x) else np.empty(0, np.int64)
                own = np.clip(near[np.arange(len(x)), cell], -1, 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(list(x), pa.list_(pa.float64())), pa.array(np.arccos(own)), pa.array(cell, pa.int32())], names)

    return run


def _planned(centres: np.ndarray, radius: np.ndarray, sizes: np.ndarray, k: int, names: list[str]):
    """mapInArrow function: (query_id, vec, first, cells, bounds); first: how many of the cells hold k vectors."""

    def run(batches):
        for batch in batches:
            keep, x = unit_rows(batch.column(1), centres.shape[1])
            most = bounds(x @ centres.T, radius)
            order = np.argsort(-most, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            first = np.minimum((held < k).sum(1) + 1, len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(list(x), pa.list_(pa.float64())), pa.array(first, pa.int32()), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(np.take_along_axis(most, order, 1)), pa.list_(pa.float64()))], names)

    return run


def _compared(k: int, names: list[str], id_type: pa.DataType, query_type: pa.DataType):
    """Partitions of (cell, part, kind, ...): a part's vectors (kind 0), then its queries (1)."""

    def run(batches):
        at, ids, vectors, held = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "part", "kind")], axis=1)
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]).tolist() if len(key) else []
            for start, end in zip(edges, [*edges[1:], len(key)], strict=True):
                rows, (cell, part, kind) = batch.slice(start, end - start), key[start].tolist()
                if (cell, part) != at:
                    at, ids, vectors, held = (cell, part), [], [], None
                x = rows.column("vec").flatten().to_numpy().reshape(rows.num_rows, -1)
                if kind == 0:
                    ids.append(rows.column("id"))
                    vectors.append(x)
                    continue
                if not vectors:
                    continue
                if held is None:
                    names_of = pa.chunked_array(ids).combine_chunks()
                    order = np.array(pc.array_sort_indices(names_of))
                    held, vectors = (names_of.take(pa.array(order)), np.concatenate(vectors)[order]), [vectors[0][:0]]
                for a in range(0, len(x), 256):
                    scores = np.round(x[a : a + 256] @ held[1].T, DECIMALS)
                    m = min(k, scores.shape[1])
                    least = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
                    picked, points, values = [], [], []
                    for i, row in enumerate(scores):
                        near = np.flatnonzero(row >= least[i])
                        near = near[np.argsort(-row[near], kind="stable")][:m]  # vectors are in order of their ids
                        picked += [a + i] * len(near)
                        points.append(near)
                        values.append(row[near])
                    yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(picked)).cast(query_type), held[0].take(pa.array(np.concatenate(points))).cast(id_type), pa.array(np.concatenate(values))], names)

    return run


class CellIndex:
    """Stored tables below a folder: points (by cell), cells, and the width."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        facts = json.loads(spark.read.text(f"{self.root}/facts").first()[0])
        self.width, self.schema = facts["width"], f"id {facts['id']}, vec array<double>, angle double, cell int"
        rows = sorted(spark.read.parquet(f"{self.root}/cells").collect())  # CELLS_MOST at most
        self.cells = [r["cell"] for r in rows]
        self.centres = np.array([r["centre"] for r in rows]).reshape(-1, self.width)
        self.radius, self.sizes = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows], np.int64)

    @classmethod
    def build(cls, points: DataFrame, root: str, dimensions: int | None = None, cells: int | None = None) -> CellIndex:
        """Cells of points (id, dense)."""
        spark, root = points.sparkSession, root.rstrip("/")
        usable = points.select("id", "dense").where("size(dense) > 0")
        n, widest = usable.agg(F.count("*"), F.max(F.size("dense"))).first()
        width = dimensions or widest or 1
        wanted = cells or int(min(CELLS_MOST, max(CELLS_LEAST, CELL_RATE * n**0.5)))
        offered = usable.where(F.size("dense") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * wanted).select("dense").collect()
        _, sample = unit_rows(pa.array([r[0] for r in offered], pa.list_(pa.float64())), width)
        centres = centres_of(sample, wanted) if len(sample) else np.eye(1, width)
        names = ["id", "vec", "angle", "cell"]
        schema = points.select("id").schema.add("vec", ArrayType(DoubleType())).add("angle", "double").add("cell", IntegerType())
        dealt = usable.withColumn("dense", F.col("dense").cast("array<double>")).mapInArrow(_assigned(centres, names), schema)
        dealt.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/points")
        stored = spark.read.schema(schema).parquet(f"{root}/points")
        known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).join(F.broadcast(known), "cell").write.mode("overwrite").parquet(f"{root}/cells")
        spark.range(1).select(F.lit(json.dumps({"width": width, "id": schema["id"].dataType.simpleString()})).alias("value")).write.mode("overwrite").text(f"{root}/facts")
        return cls(spark, root)

    def _points(self, cells: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/points").where(F.col("cell").isin(cells))

    def _met(self, pairs: DataFrame, k: int, within: DataFrame | None, schema) -> DataFrame:
        """query_id, id, score of pairs (query_id, vec, cell); only the folders of their cells are read."""
        cells = [r[0] for r in pairs.select("cell").distinct().collect()]  # CELLS_MOST at most
        points = self._points(cells)
        parts = {c: max(1, -(-int(self.sizes[i]) // PART)) for i, c in enumerate(self.cells)}
        part_of = F.create_map(*[F.lit(x) for c in cells for x in (c, parts[c])]) if cells else F.create_map().cast("map<int,int>")
        if within is not None:
            points = points.join(within.select("id").distinct(), "id", "left_semi")
        none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        vectors = points.select("cell", F.pmod(F.xxhash64("id"), part_of[F.col("cell")]).cast("int").alias("part"), F.lit(0).alias("kind"), "id", none(pairs, "query_id"), "vec")
        asked = pairs.select("cell", F.explode(F.sequence(F.lit(0), part_of[F.col("cell")] - 1)).alias("part"), F.lit(1).alias("kind"), none(points, "id"), "query_id", "vec")
        rows = vectors.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        arrow = to_arrow_schema(schema)
        return rows.mapInArrow(_compared(k, arrow.names, arrow.field(1).type, arrow.field(0).type), schema)

    def topk(self, queries: DataFrame, k: int, scratch: str, within: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank: the best k points of each query (query_id, vector); scratch: a shared folder for what the rounds find; within: ids of the points that count.

        Scores have 12 decimals, and a smaller id goes first among equal ones. The pairs of queries and cells that
        were compared are in the folders first-pairs and rest-pairs of scratch.
        """
        out = queries.select("query_id").schema.add(self._points([]).schema["id"]).add("score", "double")
        planned = queries.select("query_id").schema.add("vec", ArrayType(DoubleType())).add("first", IntegerType()).add("cells", ArrayType(IntegerType())).add("most", ArrayType(DoubleType()))
        names = [f.name for f in planned]
        plan = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_planned(self.centres, self.radius, self.sizes, k, names), planned)
        plan = self._kept(plan, f"{scratch}/plan")
        numbers = F.array(*map(F.lit, self.cells)).cast("array<int>")
        pairs = plan.select("query_id", "vec", "first", F.posexplode(F.arrays_zip("cells", "most"))).select("query_id", "vec", "first", "pos", F.element_at(numbers, F.col("col.cells") + 1).alias("cell"), F.col("col.most").alias("most"))
        first = self._kept(pairs.where("pos < first").select("query_id", "vec", "cell"), f"{scratch}/first-pairs")
        near = self._kept(first_n(self._met(first, k, within, out), ["query_id"], [F.desc("score"), "id"], k), f"{scratch}/first")
        reached = near.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("kth"))
        rest = pairs.where("pos >= first").join(reached, F.col("query_id").eqNullSafe(F.col("q")), "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - SLACK))
        rest = self._kept(rest.select("query_id", "vec", "cell"), f"{scratch}/rest-pairs")
        return first_n(near.drop("rank").unionByName(self._met(rest, k, within, out)), ["query_id"], [F.desc("score"), "id"], k)

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def share_read(index: CellIndex, scratch: str) -> float:
    """The share of all pairs of a query and a point that a search of topk, with this scratch folder, compared."""
    spark = index.spark
    sizes = spark.read.parquet(f"{index.root}/cells").select("cell", "n")
    pairs = spark.read.parquet(f"{scratch}/first-pairs", f"{scratch}/rest-pairs").select("cell")
    queries = spark.read.parquet(f"{scratch}/plan").count()
    met = pairs.join(sizes, "cell").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return met / max(1, queries * int(index.sizes.sum()))
