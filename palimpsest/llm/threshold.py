"""Exact top-k search by inner product with the threshold algorithm over sorted lists.

Components are made integers, so that scores are exact. Vectors are dealt by a range
sort of their norms into tiles of TILE_BYTES. A tile has a sorted list of its vectors
for each dimension; a query reads a list from its high end where its own component is
positive, else from its low end. After each step down all lists, vectors that were
seen for the first time are scored in full, and the sum of the query's components
times the values where the lists stand bounds every vector not yet seen: once it is
below the k-th best score, the query is done with the tile. It goes on at a tie, as a
smaller id may be left. Where the lists would be read for most of the tile anyway,
the queries that are left score the rest of it as a matrix product.

The tile of the greatest norms is searched first. Its k-th scores go with the queries
to all other tiles, so that most of these are given up early where the data allow it.
Queries are a stated set (in QUERY_BLOCK rows) that meets all rows: each tile's task
reads its vectors, then the queries one block at a time, and gives k rows a query.

Defined results: vectors that are null, or hold a null or a non-finite component,
take no part. Only vectors of one length meet; vectors of no components have score 0
with each other. A row whose id is the query's is its own and no candidate; other
repeated rows are candidates each. A repeated query row gets its results again. A row
with a null id is no query; as a candidate it comes last among equal scores. Scores
are exact in all cases and shown as the nearest long where they exceed one. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, table

SCALE = 1024
K, QUERY_MODULUS = 10, 100
#: Vectors of a tile, as doubles; queries that are searched together.
TILE_BYTES, QUERY_BLOCK = 8 << 20, 512
#: Entries of a list that are read at first, and how many times as many by the next step.
FIRST_STEP, STEP = 8, 4
#: The lists are read while they can hold at most this share of the tile's vectors.
LIST_SHARE = 0.25
#: Parts that the tiles of a width are dealt into, to meet the queries' keys.
SALTS = 16
#: Integers up to this are exact as doubles.
EXACT = float(1 << 53)
_LONG = np.iinfo(np.int64)


def _quantised(scale: int):
    """(id, width, norm, vec) of the vectors that take part; vec: whole numbers as doubles, which hold them exactly."""

    def run(batches):
        for batch in batches:
            ids, widths, norms, vecs = [], [], [], []
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                for k, vec_id in enumerate(batch.column(0).to_pylist()):
                    x = np.floor(values[offsets[k] : offsets[k + 1]] * scale)
                    if gone[k] or not np.isfinite(x).all():  # a null component came as NaN
                        continue
                    ids.append(vec_id)
                    widths.append(len(x))
                    norms.append(float(x @ x))
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(norms, pa.float64()), pa.array(vecs, pa.binary())], ["id", "width", "norm", "vec"])

    return run


def _packed(rows_of):
    """Rows (id, width, ..., vec) of a partition, of which each width's come together, as blocks of rows_of(width): (width, part, block, ids, vecs)."""

    def run(batches):
        part, width, ids, vecs, block = TaskContext.get().partitionId(), None, [], [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(vecs)], pa.binary())], ["width", "part", "block", "ids", "vecs"])

        for batch in batches:
            for vec_id, w, vec in zip(*(batch.column(n).to_pylist() for n in ("id", "width", "vec")), strict=True):
                if ids and (w != width or len(ids) >= rows_of(width)):
                    yield made()
                    ids, vecs, block = [], [], block + 1
                width = w
                ids.append(vec_id)
                vecs.append(vec)
        if ids:
            yield made()

    return run


PACKED = "width int, part int, block int, ids array<long>, vecs binary"


class Tile:
    """Vectors in order of their ids (null last), and a sorted list of them for each dimension."""

    def __init__(self, ids: pa.Array, vecs: bytes, width: int):
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        plain = ids.fill_null(0).to_numpy()
        order = np.lexsort((plain, ~known))
        self.ids, self.known = plain[order], known[order]
        self.x = np.frombuffer(vecs, np.float64).reshape(len(order), width)[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable")
        self.n, self.width = self.x.shape
        self.largest = float(np.abs(self.x).max(initial=0.0))

    def own(self, query_id: int) -> slice:
        """Rows of this id."""
        n = int(self.known.sum())
        return slice(*np.searchsorted(self.ids[:n], [query_id, query_id + 1])) if query_id < _LONG.max else slice(int(np.searchsorted(self.ids[:n], query_id)), n)

    def bound(self, q: np.ndarray, depth: int) -> np.ndarray:
        """The most that a vector can score of which no list has shown an entry above `depth`; one for each row of q."""
        low = np.take_along_axis(self.x, self.lists[depth : depth + 1], 0)[0]
        high = np.take_along_axis(self.x, self.lists[self.n - 1 - depth : self.n - depth], 0)[0]
        return np.maximum(q, 0) @ high + np.minimum(q, 0) @ low

    def shown(self, q: np.ndarray, start: int, end: int) -> np.ndarray:
        """Rows between two depths of the lists, as the query reads them."""
        up = self.lists[self.n - end : self.n - start, q > 0]
        down = self.lists[start:end, q < 0]
        return np.unique(np.concatenate([up.ravel(), down.ravel()]))


class Best:
    """The k best (score, row) of each query; ties go to the smaller row."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, kind=np.float64):
        self.k, self.floor = k, floor
        self.scores, self.rows = np.full((queries, k), -np.inf, kind), np.full((queries, k), -1, np.int64)

    def add(self, i: int, scores: np.ndarray, rows: np.ndarray) -> None:
        s, r = np.concatenate([self.scores[i], scores]), np.concatenate([self.rows[i], rows])
        first = np.lexsort((r, -s))[: self.k]
        self.scores[i], self.rows[i] = s[first], r[first]

    def kth(self) -> np.ndarray:
        """No vector below this score is among the best."""
        return np.maximum(self.scores[:, -1], self.floor)


def search(tile: Tile, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[Best, int]:
    """The best of the tile's rows for each query, leaving out what is below floor, and the number of scores computed."""
    best, scored = Best(len(q), k, floor), 0
    own = [tile.own(i) for i in ids.tolist()]
    open_, start, step = np.arange(len(q)), 0, FIRST_STEP
    seen: dict[int, np.ndarray] = {}
    while len(open_) and start < tile.n:
        open_ = open_[tile.bound(q[open_], start) >= best.kth()[open_]]
        end = min(tile.n, start + step)
        if not tile.width or end * tile.width > LIST_SHARE * tile.n:
            break
        for i in open_.tolist():
            known = seen.setdefault(i, np.zeros(tile.n, bool))
            rows = tile.shown(q[i], start, end)
            rows = rows[~known[rows]]
            known[rows] = True
            rows = rows[(rows < own[i].start) | (rows >= own[i].stop)]
            best.add(i, tile.x[rows] @ q[i], rows)
            scored += len(rows)
        start, step = end, step * STEP
    if start >= tile.n:
        return best, scored
    for a in range(0, tile.n, 4096) if len(open_) else ():
        scores = q[open_] @ tile.x[a : a + 4096].T
        for j, i in enumerate(open_.tolist()):
            left, right = max(own[i].start - a, 0), max(own[i].stop - a, 0)
            scores[j, left:right] = -np.inf
            if i in seen:
                scores[j, seen[i][a : a + 4096]] = -np.inf
        scored += scores.size
        least = best.kth()[open_]
        m = min(k, scores.shape[1])
        if m < scores.shape[1]:  # each query's m-th here: what is below it is not among the best
            least = np.maximum(least, np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m])
        least = np.maximum(least, -np.finfo(np.float64).max)
        for j, i in enumerate(open_.tolist()):
            rows = np.flatnonzero(scores[j] >= least[j])
            if len(rows) > m:  # ties at the end: the first rows have the smaller ids
                above = rows[scores[j, rows] > least[j]]
                rows = np.concatenate([above, rows[scores[j, rows] == least[j]][:m]])
            best.add(i, scores[j, rows], a + rows)
    return best, scored


def search_exactly(tile: Tile, ids: np.ndarray, q: np.ndarray, k: int) -> Best:
    """search for components so large that doubles don't hold their products: all rows are scored in whole numbers."""
    x = np.vectorize(int, otypes=[object])(tile.x) if tile.x.size else tile.x.astype(object)
    best = Best(len(q), k, np.full(len(q), -np.inf), object)
    for i, (vec_id, row) in enumerate(zip(ids.tolist(), q, strict=True)):
        own, whole = tile.own(vec_id), [int(v) for v in row]
        scores = [sum(a * b for a, b in zip(r, whole, strict=True)) for r in x]
        rows = [j for j in sorted(range(tile.n), key=lambda j: (-scores[j], j)) if not own.start <= j < own.stop][:k]
        best.rows[i, : len(rows)] = rows
        best.scores[i, : len(rows)] = [scores[j] for j in rows]
    return best


def _searched(k: int):
    """Partitions of (tile, kind, ...): a tile's vectors, then its queries, block by block."""

    def run(batches):
        tile = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                width, ids, vecs = row.column("width")[0].as_py(), row.column("ids").flatten(), row.column("vecs")[0].as_py()
                if row.column("kind")[0].as_py() == 0:
                    tile = Tile(ids, vecs, width)
                    continue
                q, query_ids = np.frombuffer(vecs, np.float64).reshape(len(ids), width), ids.to_numpy()
                floor = row.column("floor")
                floor = floor.flatten().to_numpy() if floor.null_count == 0 else np.full(len(ids), -np.inf)
                exact = tile.largest * np.abs(q).sum(1).max(initial=0.0) < EXACT
                best = search(tile, query_ids, q, floor, k)[0] if exact else search_exactly(tile, query_ids, q, k)
                i, j = np.nonzero(best.rows >= 0)
                rows = best.rows[i, j]
                scores = best.scores[i, j].astype(np.int64) if exact else np.array([min(max(s, _LONG.min), _LONG.max) for s in best.scores[i, j]], np.int64)
                found = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(tile.ids[rows], pa.int64(), mask=~tile.known[rows]), pa.array(scores, pa.int64()), pa.array(best.scores[i, j].astype(np.float64))], ["at", "vec_id", "score", "rough"])
                kth = best.scores[:, -1].astype(np.float64)
                yield pa.RecordBatch.from_arrays([
                    *(row.column(c) for c in ("width", "q_part", "q_block")), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found),
                    pa.ListArray.from_arrays(pa.array([0, len(kth)], pa.int32()), pa.array(kth)),
                ], ["width", "q_part", "q_block", "found", "floor"])

    return run


FOUND = "width int, q_part int, q_block int, found array<struct<at:int,vec_id:long,score:long,rough:double>>, floor array<double>"


def _met(tiles: DataFrame, keys: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches of all queries (width, q_part, q_block, ids, vecs, floor) in all tiles of their width; keys: width, part, block of the tiles."""
    none = lambda kind: F.lit(None).cast(kind)
    vectors = tiles.select("width", "part", "block", F.lit(0).alias("kind"), none("int").alias("q_part"), none("int").alias("q_block"), "ids", "vecs", none("array<double>").alias("floor"))
    # keys meet first, salted, as all tiles may have one width; then each query block is fetched for its tiles
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    pairs = keys.withColumn("salt", F.pmod(F.xxhash64("part", "block"), F.lit(SALTS)).cast("int")).join(queries.select("width", "q_part", "q_block", salts.alias("salt")), ["width", "salt"]).drop("salt")
    asked = pairs.join(queries, ["width", "q_part", "q_block"]).select("width", "part", "block", F.lit(1).alias("kind"), "q_part", "q_block", "ids", "vecs", "floor")
    key = ["width", "part", "block"]
    return vectors.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "kind", "q_part", "q_block").mapInArrow(_searched(k), FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of vectors for each row of queries."""
    scratch = Scratch(vectors.sparkSession, "threshold")

    def quantised(df: DataFrame) -> DataFrame:
        slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
        return slim.mapInArrow(_quantised(scale), "id long, width int, norm double, vec binary")

    rows = scratch.keep(quantised(vectors), "rows")
    # few partitions before they are packed, not after: a block's key is its task's number and its own within the task
    few = quantised(queries).where("id IS NOT NULL").coalesce(max(2, scratch.spark.sparkContext.defaultParallelism))
    asked = few.sortWithinPartitions("width").mapInArrow(_packed(lambda width: QUERY_BLOCK), PACKED)
    asked = scratch.keep(asked.select("width", F.col("part").alias("q_part"), F.col("block").alias("q_block"), "ids", "vecs"), "queries")
    by_norm = rows.orderBy("width", F.col("norm").desc(), "id")
    tiles = scratch.keep(by_norm.mapInArrow(_packed(lambda width: max(1, tile_bytes // (8 * max(1, width)))), PACKED), "tiles")
    keys = scratch.keep(tiles.select("width", "part", "block"), "keys", small=True)
    heads = scratch.keep(keys.groupBy("width").agg(F.min(F.struct("part", "block")).alias("head")).select("width", "head.*"), "heads", small=True)
    head = lambda df, how: df.join(heads, ["width", "part", "block"], how)
    first = scratch.keep(_met(head(tiles, "left_semi"), heads, asked.withColumn("floor", F.lit(None).cast("array<double>")), k), "first", small=True)
    floors = first.select("width", "q_part", "q_block", "floor")
    rest = _met(head(tiles, "left_anti"), head(keys, "left_anti"), asked.join(floors, ["width", "q_part", "q_block"]), k)
    names = asked.select("width", "q_part", "q_block", F.posexplode("ids").alias("at", "query_id"))
    hits = first.unionByName(rest).select("width", "q_part", "q_block", F.inline("found"))
    one = Window.partitionBy("width", "q_part", "q_block", "at").orderBy(F.col("rough").desc(), F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    best = hits.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= k)
    return best.join(names, ["width", "q_part", "q_block", "at"]).select("query_id", "rank", "vec_id", "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_MODULUS == 0))


ORACLE = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % {QUERY_MODULUS} = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= {K}"""
