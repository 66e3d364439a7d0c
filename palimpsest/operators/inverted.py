"""Inverted lists of weighted terms, stored in blocks with their maxima, and exact top-k search over them.

Points are numbered in the order they are read and cut into blocks of BLOCK. A
posting row holds a term's points within one block, their weights, and the greatest of
these. Rows are dealt to parts (folders) by term, a common term's by spans of blocks,
too, and sorted by term within; a lexicon tells the parts that hold a term, so a search
reads only parts, and of these only rows, of terms that are asked for, and no text.

A search deals blocks to shards. A shard's task gets the posting rows of its blocks,
then the queries, QUERY_BLOCK at a time. The maxima, multiplied with the queries'
weights, bound what any point of a block can score for each query. Blocks are taken
in order of these bounds; one is scored (as a matrix product) for those queries only
whose k-th score so far doesn't exceed its bound. A task gives k rows a query.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import term_list
from ..sources.folders import parts_of
from .pending import first_n

BM25_K1, BM25_B = 1.2, 0.75
#: Points of a block, as a power of two; blocks of a shard at most; queries that are scored together.
BLOCK_BITS, SHARD_BLOCKS, QUERY_BLOCK = 10, 16, 256
BLOCK = 1 << BLOCK_BITS
#: Blocks (as a power of two) of a term that are in one part of the table.
SPAN_BITS = 6
#: Bytes of stored texts whose postings are one part at least.
TEXT_BYTES = 8 << 20
#: Scores are compared with so many decimals; sums of weights in another order differ less.
DECIMALS = 9
#: Parts that shards are dealt into, to meet the queries; bits of a block's number below the folder's.
SALTS, FOLDER_BITS = 16, 52
POSTINGS = "term string, block long, top double, at array<int>, weights array<double>, part int"


class Shard:
    """Points and postings of a shard's blocks."""

    def __init__(self, docs: pa.Table, posts: pa.Table):
        blocks = docs.column("block").to_numpy()
        self.blocks = np.unique(blocks)
        self.ids = docs.column("ids").combine_chunks().flatten()
        at = docs.column("at").combine_chunks().flatten().to_numpy()
        #: the row of self.ids for each block and place, or -1
        self.row = np.full((len(self.blocks), BLOCK), -1)
        self.row[np.searchsorted(self.blocks, blocks), at] = np.arange(len(blocks))
        self.order = np.array(pc.rank(self.ids, tiebreaker="first")) if len(self.ids) else np.empty(0, np.int64)
        number = np.searchsorted(self.blocks, posts.column("block").to_numpy())
        known = np.r_[self.blocks, -1][number] == posts.column("block").to_numpy()
        lists, weights = posts.column("at").combine_chunks(), posts.column("weights").combine_chunks()
        self.places, self.weights = lists.flatten().to_numpy(), weights.flatten().to_numpy()
        ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        terms = posts.column("term").combine_chunks().dictionary_encode()
        #: number of each term; the rows of postings in order of their blocks, and where each block's begin
        self.numbers = {t: n for n, t in enumerate(terms.dictionary.to_pylist())}
        order = np.lexsort((terms.indices.to_numpy(), number))
        order = order[known[order]]
        self.term, self.block, self.top = terms.indices.to_numpy()[order], number[order], posts.column("top").to_numpy()[order]
        self.start, self.end = ends[:-1][order], ends[1:][order]
        self.first = np.searchsorted(self.block, np.arange(len(self.blocks) + 1))

    def search(self, asked: list[list[tuple[str, float]]], k: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query (its terms and weights): rows of self.ids and scores of the best k; and the number of pairs of a query and a block that were scored."""
        held = sorted({self.numbers[t] for q in asked for t, _ in q if t in self.numbers})
        at = np.full(len(self.numbers), -1)
        at[held] = np.arange(len(held))
        weight, top = np.zeros((len(asked), len(held))), np.zeros((len(held), len(self.blocks)))
        for i, q in enumerate(asked):
            for t, w in q:
                if t in self.numbers:
                    weight[i, at[self.numbers[t]]] += w
        use = np.flatnonzero(at[self.term] >= 0)
        np.maximum.at(top, (at[self.term[use]], self.block[use]), self.top[use])
        bound = weight @ top
        least = np.full(len(asked), -np.inf)
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in asked]
        scored = 0
        for block in np.argsort(-bound.sum(0), kind="stable").tolist():
            open_ = np.flatnonzero((bound[:, block] > 0) & (bound[:, block] >= least - 10.0**-DECIMALS))
            if not len(open_):
                continue
            rows = np.arange(self.first[block], self.first[block + 1])
            rows = rows[at[self.term[rows]] >= 0]
            lengths = self.end[rows] - self.start[rows]
            entries = np.repeat(self.start[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            matrix = np.zeros((len(rows), BLOCK))
            matrix[np.repeat(np.arange(len(rows)), lengths), self.places[entries]] = self.weights[entries]
            scores = weight[np.ix_(open_, at[self.term[rows]])] @ matrix
            scores[:, self.row[block] < 0] = 0
            scored += len(open_)
            for i, q in enumerate(open_.tolist()):
                near = np.flatnonzero((scores[i] != 0) & (scores[i] >= least[q] - 10.0**-DECIMALS))
                if not len(near):
                    continue
                found, value = np.r_[best[q][0], self.row[block, near]], np.r_[best[q][1], scores[i, near]]
                first = np.lexsort((self.order[found], -np.round(value, DECIMALS)))[:k]
                best[q] = found[first], value[first]
                if len(first) == k:
                    least[q] = value[first[-1]]
        return [b[0] for b in best], [b[1] for b in best], scored


def _searched(k: int, names: list[str], query_type: pa.DataType):
    """Partitions of (shard, kind, ...): a shard's points (kind 0) and postings (1), then queries (2), block by block."""

    def run(batches):
        docs, posts, shard, at = [], [], None, None
        for batch in batches:
            key, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]).tolist() if len(key) else []
            for start, end in zip(edges, [*edges[1:], len(key)], strict=True):
                part = batch.slice(start, end - start)
                if key[start] != at:
                    docs, posts, shard, at = [], [], None, key[start]
                if kind[start] < 2:
                    (docs if kind[start] == 0 else posts).append(part)
                    continue
                if not docs:
                    continue
                if shard is None:
                    shard, docs, posts = Shard(pa.Table.from_batches(docs), pa.Table.from_batches(posts, batch.schema)), [docs[0].slice(0, 0)], []
                for n in range(part.num_rows):
                    asked = part.column("asked")[n].as_py()
                    rows, values, _ = shard.search([[(t["term"], t["weight"]) for t in q["terms"]] for q in asked], k)
                    ids = [q["query_id"] for q, r in zip(asked, rows, strict=True) for _ in range(len(r))]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, query_type), shard.ids.take(pa.array(np.concatenate(rows).astype(np.int64))), pa.array(np.concatenate(values))], names)

    return run


def _counted(mean: float, k1: float, b: float):
    """Posting rows of texts (block, at, terms), counted where the texts are: a block has several rows of a term where batches or tasks part it."""

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            blocks, block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            at, terms = batch.column("at").to_numpy(), lists.flatten().dictionary_encode()
            if not len(terms):
                continue
            # block, term and place of each word in one number, which sorts and counts them
            code = block.repeat(sizes) * len(terms.dictionary) + terms.indices.to_numpy()
            key, tf = np.unique(code * BLOCK + at.repeat(sizes), return_counts=True)
            length = np.zeros((len(blocks), BLOCK))
            length[block, at] = sizes
            code, place = key >> BLOCK_BITS, key & (BLOCK - 1)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[code // len(terms.dictionary), place] / mean))
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = pa.array(np.r_[first, len(key)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                terms.dictionary.take(pa.array(code[first] % len(terms.dictionary))), pa.array(blocks[code[first] // len(terms.dictionary)], pa.int64()), pa.array(np.maximum.reduceat(weight, first)),
                pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight)),
            ], ["term", "block", "top", "at", "weights"])

    return run


class InvertedIndex:
    """Stored tables below a folder, or below each of several, whose points are parts of one set: docs (block, at, id), postings (by part), lexicon, and facts."""

    def __init__(self, spark: SparkSession, *roots: str):
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]
        self.facts = [json.loads(spark.read.text(f"{r}/facts").first()[0]) for r in self.roots]
        self.blocks = sum(f["blocks"] for f in self.facts)
        #: the values of `group` that count in each folder, if not all do
        self.alive: list[list] | None = None

    def _table(self, name: str, schema: str | None = None, parts: dict[int, list[int]] | None = None) -> DataFrame | None:
        """A table of all folders, with the folder's number; blocks of different folders have different numbers. parts: those to be read, by folder."""
        out = None
        for n, root in enumerate(self.roots):
            if parts is not None and n not in parts:
                continue
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            df = reader.parquet(f"{root}/{name}")
            df = df if parts is None else df.where(F.col("part").isin(parts[n]))
            if n and "block" in df.columns:
                df = df.withColumn("block", F.col("block") + F.lit(n << FOLDER_BITS))
            df = df.withColumn("folder", F.lit(n))
            out = df if out is None else out.unionByName(df)
        return out

    @classmethod
    def of_texts(cls, points: DataFrame, root: str, text: str = "content", k1: float = BM25_K1, b: float = BM25_B) -> InvertedIndex:
        """Lists of saturated, length-damped term frequencies of points (id, text)."""
        staged = cls._staged(points.select("id", term_list(F.col(text)).alias("terms")), root)
        mean = staged.select(F.size("terms").alias("n")).where("n > 0").agg(F.avg("n")).first()[0] or 1.0
        postings = staged.select("block", "at", "terms").mapInArrow(_counted(mean, k1, b), "term string, block long, top double, at array<int>, weights array<double>")
        return cls._written(staged, cls._dealt(postings, parts_of(points, size=TEXT_BYTES)), root)

    @classmethod
    def of_vectors(cls, points: DataFrame, root: str, vector: str = "sparse", group: str | None = None, facts: dict | None = None) -> InvertedIndex:
        """Lists of points (id, sparse: term number -> weight); weights are positive. group: a column whose values can be left out of a search; facts: kept with the index."""
        staged = cls._staged(points.select("id", *([F.col(group).alias("group")] if group else []), F.coalesce(F.map_entries(vector), F.array().cast("array<struct<key:bigint,value:double>>")).alias("terms")), root)
        listed = staged.select("block", "at", F.explode("terms").alias("e")).select(F.col("e.key").cast("string").alias("term"), "block", "at", F.col("e.value").alias("weight"))
        lists = cls._dealt(listed, parts_of(points)).groupBy("part", "term", "block").agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("p"))  # a block's points at most
        return cls._written(staged, lists.select("part", "term", "block", F.array_max("p.weight").alias("top"), F.col("p.at").alias("at"), F.col("p.weight").alias("weights")), root, facts)

    @staticmethod
    def _staged(rows: DataFrame, root: str) -> DataFrame:
        """rows with block and at: the number of a point, fixed by being written."""
        number = F.monotonically_increasing_id()
        numbered = rows.withColumn("number", number)
        numbered.select(F.shiftright("number", BLOCK_BITS).alias("block"), F.col("number").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("at"), *rows.columns).write.mode("overwrite").parquet(f"{root}/staged")
        return rows.sparkSession.read.parquet(f"{root}/staged")

    @staticmethod
    def _dealt(rows: DataFrame, parts: int) -> DataFrame:
        """rows (term, block, ...) with their part, shuffled by it: the only shuffle of postings."""
        part = F.pmod(F.xxhash64("term", F.shiftright("block", SPAN_BITS)), F.lit(parts)).cast("int")
        return rows.withColumn("part", part).repartition(parts, "part")

    @classmethod
    def _written(cls, staged: DataFrame, rows: DataFrame, root: str, facts: dict | None = None) -> InvertedIndex:
        spark = staged.sparkSession
        rows.sortWithinPartitions("part", "term", "block").write.mode("overwrite").partitionBy("part").parquet(f"{root}/postings")
        heads = spark.read.schema(POSTINGS).parquet(f"{root}/postings").groupBy("term").agg(F.sum(F.size("at")).alias("points"), F.max("top").alias("top"), F.collect_set("part").alias("parts"))
        heads.write.mode("overwrite").parquet(f"{root}/lexicon")
        staged.drop("terms").write.mode("overwrite").parquet(f"{root}/docs")
        blocks = staged.select("block").distinct().count()
        spark.range(1).select(F.lit(json.dumps({**(facts or {}), "blocks": blocks})).alias("value")).write.mode("overwrite").text(f"{root}/facts")
        return cls(spark, root)

    def postings_of(self, terms: DataFrame) -> DataFrame | None:
        """Posting rows of terms (term), or None; only the parts that the lexicon names are read."""
        found = terms.select("term").distinct().join(self._table("lexicon"), "term")
        parts: dict[int, list[int]] = {}
        for folder, part in found.select("folder", F.explode("parts")).distinct().collect():  # as many as parts at most
            parts.setdefault(folder, []).append(part)
        if not parts:
            return None
        return self._table("postings", POSTINGS, parts).join(found.select("term").distinct(), "term", "left_semi")

    def topk(self, asked: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank: the best k points for queries asked as (query_id, term, weight), weights positive; within: ids of the points that count."""
        docs = self._table("docs")
        schema = asked.select("query_id").schema.add(docs.schema["id"]).add("score", "double")
        wanted = self.postings_of(asked)
        if wanted is None:
            return self.spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
        if self.alive is not None:
            counts = F.lit(False)
            for n, groups in enumerate(self.alive):
                counts |= (F.col("folder") == n) & F.col("group").isin(groups)
            docs = docs.where(counts)
        kept = docs if within is None else docs.join(within.select("id").distinct(), "id", "left_semi")
        size = max(1, min(SHARD_BLOCKS, self.blocks // (2 * self.spark.sparkContext.defaultParallelism)))
        shard = F.floor(F.col("block") / size).alias("shard")
        lists = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
        groups = max(1, -(-lists.count() // QUERY_BLOCK))
        packed = lists.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("q")).agg(F.collect_list(F.struct("query_id", "terms")).alias("asked"))
        none = lambda kind: F.lit(None).cast(kind)
        kinds = {"ids": f"array<{docs.schema['id'].dataType.simpleString()}>", "term": "string", "top": "double", "at": "array<int>", "weights": "array<double>", "asked": packed.schema["asked"].dataType.simpleString()}

        def row(df: DataFrame, kind: int, block: Column, **has: Column) -> DataFrame:
            return df.select(F.col("shard") if "shard" in df.columns else shard, F.lit(kind).alias("kind"), block.cast("long").alias("block"), *[has.get(c, none(t)).alias(c) for c, t in kinds.items()])

        points = row(kept, 0, F.col("block"), ids=F.array("id"), at=F.array("at"))
        posts = row(wanted, 1, F.col("block"), term=F.col("term"), top=F.col("top"), at=F.col("at"), weights=F.col("weights"))
        # a task needs to be asked: numbers of shards meet blocks of queries, not rows with rows
        shards = docs.select(shard).distinct().withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
        queries = row(packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(shards, "salt"), 2, none("long"), asked=F.col("asked"))
        rows = points.unionByName(posts).unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
        found = rows.mapInArrow(_searched(k, schema.names, to_arrow_schema(schema).field(0).type), schema)
        return first_n(found, ["query_id"], [F.desc(F.round("score", DECIMALS)), "id"], k)
