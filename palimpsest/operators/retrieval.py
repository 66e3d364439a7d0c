"""Search over index points: filters, routing, dense, sparse and fused retrieval, reranking, recall.

All operators take a table of requests (query_id, ...), so that many queries run
as one plan. Where every request meets every row, requests are taken in blocks of
a fixed size. Ranking per query is a window that Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import scalars
from ..functions.text import tokens
from ..sources.folders import shared_folder
from .inverted import InvertedIndex
from .pending import first_n

RRF_K = 60
TOP_K, CANDIDATES = 8, 20
MAX_ATTEMPTS = 3
#: Queries that a task holds at a time.
QUERY_BLOCK = 2048


def visible(points: DataFrame, project: Column | None = None) -> DataFrame:
    """Points that are neither deleted nor superseded, of the project given; without one, of none."""
    live = ~F.coalesce("source_deleted", F.lit(False)) & ~F.coalesce("superseded", F.lit(False))
    return points.where(live & F.col("project_id").eqNullSafe(F.lit(None) if project is None else project))


def in_scope(points: DataFrame, scope: str | None = None, sources: list[str] | None = None) -> DataFrame:
    if scope is not None:
        points = points.where(F.col("scope") == scope)
    return points if sources is None else points.where(F.col("source_table").isin(sources))


def resolve_sources(types: list[str] | None = None, sources: list[str] | None = None, project: bool = False) -> list[str]:
    """Sources of a request: those named, and the categories of the types named; by default all general (or project) ones."""
    types, sources = types or [], sources or []
    known, kinds = dict(schemas.CATEGORY_TYPES), {t for _, t in schemas.CATEGORY_TYPES}
    if set(sources) - set(known) or set(types) - kinds:
        raise ValueError("unknown source or type")
    if not project and set(sources) & set(schemas.PROJECT_CATEGORIES):
        raise ValueError("project sources need a project")
    if not types and not sources:
        return sorted(schemas.PROJECT_CATEGORIES if project else schemas.GENERAL_CATEGORIES)
    typed = {c for c, t in known.items() if t in types and c != "atoms" and (project or c not in schemas.PROJECT_CATEGORIES)}
    return sorted(typed | set(sources))


def expand_sources(requests: DataFrame, category_types: DataFrame) -> DataFrame:
    """Requests (query_id, types, sources, project_id) with resolved_sources and mode."""
    wanted = requests.select("query_id", F.explode("types").alias("type"), F.col("project_id").isNotNull().alias("in_project"))
    named = category_types.where("category <> 'atoms'")
    hits = wanted.join(named, "type").where(F.col("in_project") | ~F.col("category").isin(schemas.PROJECT_CATEGORIES))
    typed = hits.groupBy("query_id").agg(F.collect_set("category").alias("typed"))
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    out = requests.join(typed, "query_id", "left")
    sources = F.coalesce("sources", none)
    default = F.when(F.col("project_id").isNotNull(), lit(schemas.PROJECT_CATEGORIES)).otherwise(lit(schemas.GENERAL_CATEGORIES))
    asked = (F.size(sources) > 0) | (F.size(F.coalesce("types", none)) > 0)
    resolved = F.array_sort(F.when(asked, F.array_union(F.coalesce("typed", none), sources)).otherwise(default))
    return out.withColumn("resolved_sources", resolved).withColumn("mode", natural_mode(F.col("resolved_sources"))).drop("typed")


def natural_mode(sources: Column) -> Column:
    """vector for one of atoms, profiles, users; bm25 for another one; hybrid for more."""
    return F.when(F.size(sources) != 1, "hybrid").when(sources[0].isin(schemas.VECTOR_SOURCES), "vector").otherwise("bm25")


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], key: str = "query_id", block: int = QUERY_BLOCK) -> DataFrame:
    """Union of answer(part) over parts of queries of about `block` rows, so that what a task holds of them is bounded."""
    parts = max(1, -(-queries.count() // block))
    if parts == 1:
        return answer(queries)
    out = None
    for k in range(parts):
        part = answer(queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def _nearest(ids: list, matrix: np.ndarray, k: int, schema: pa.Schema):
    """mapInArrow function: the best k points of each query within a batch."""

    def run(batches):
        for batch in batches:
            keep = [i for i, v in enumerate(batch.column(1)) if v.is_valid and len(v) == matrix.shape[1] and not v.values.null_count]
            if not keep or not ids:
                continue
            point_ids = batch.column(0).take(pa.array(keep))
            x = np.stack([batch.column(1)[i].values.to_numpy(zero_copy_only=False) for i in keep]).astype(np.float64)
            norms = np.sqrt((x * x).sum(1))
            with np.errstate(invalid="ignore", divide="ignore"):
                scores = np.round(matrix @ (x / norms[:, None]).T, 12)
            order = np.array(pc.rank(point_ids, tiebreaker="first"))
            picked, at, value = [], [], []
            for q in range(len(ids)):
                row = scores[q]
                near = np.flatnonzero(np.isfinite(row))
                if len(near) > k:
                    near = near[row[near] >= np.partition(row[near], -k)[-k]]
                near = near[np.lexsort((order[near], -row[near]))][:k]
                picked += [ids[q]] * len(near)
                at.append(near)
                value.append(row[near])
            yield pa.RecordBatch.from_arrays([pa.array(picked, schema.field(0).type), point_ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(value))], schema.names)

    return run


def dense_topk(queries: DataFrame, points: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank: exact cosine of `vector` with every point's `dense`, best k; zero vectors match nothing.

    A stated query set against all rows, in blocks of queries: a task holds a block
    as a matrix, multiplies it with each batch of points and gives the batch's best
    k, so the rows shuffled are k for each query and batch. Scores have 12 decimals.
    """
    out_type = points.select(F.lit(0).alias("query_id"), "id").schema
    schema = queries.select("query_id").schema.add(out_type["id"]).add("score", "double")

    def answer(part: DataFrame) -> DataFrame:
        rows = part.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("v")).where("size(v) > 0").collect()
        width = max([len(r["v"]) for r in rows], default=1)
        usable = [r for r in rows if len(r["v"]) == width and None not in r["v"] and any(r["v"])]
        matrix = np.array([r["v"] for r in usable]).reshape(-1, width)
        matrix = matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))
        found = points.select("id", "dense").mapInArrow(_nearest([r["query_id"] for r in usable], matrix, k, to_arrow_schema(schema)), schema)
        return first_n(found, ["query_id"], [F.desc("score"), "id"], k)

    return in_blocks(queries, answer, block=block)


def lexical_topk(queries: DataFrame, lexical: InvertedIndex, k: int, within: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: sum of the weights that a point has for a query's terms. asked: terms and their weights (query_id, term, weight), by default those of the texts."""
    return lexical.topk(query_weights(queries) if asked is None else asked, k, within)


def fuse(*ranked: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, rank)."""
    parts = [r.select("query_id", "id", "rank") for r in ranked]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    scored = all_.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("score"))
    return first_n(scored, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)


def keep_best(candidates: DataFrame) -> DataFrame:
    """One row for each query and id: the best score, among equals the earliest arrival."""
    return candidates.groupBy("query_id", "id").agg(F.min_by(F.struct("source_table", "score", "arrival"), F.struct(-F.col("score"), "arrival")).alias("b")).select("query_id", "id", "b.*")


def keyword_rerank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (query_id, id, content, score) with rerank_score: term overlap and retrieval score."""
    q = queries.select("query_id", tokens(F.col("query")).alias("query_terms"))
    out = candidates.join(q, "query_id").withColumn("terms", tokens(F.coalesce("content", F.lit(""))))
    return out.withColumn("rerank_score", scalars.keyword_score(F.col("query_terms"), F.col("terms"), F.col("score"))).drop("query_terms", "terms")


def model_rerank(candidates: DataFrame, queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (query_id, id, model_score) where a model gave one, else the keyword score. Scores of no candidate are dropped."""
    return keyword_rerank(candidates, queries).join(scores, ["query_id", "id"], "left").withColumn("rerank_score", F.coalesce("model_score", "rerank_score")).drop("model_score")


def parse_scores(replies: DataFrame, reply: str = "reply", uuids: bool = False) -> DataFrame:
    """query_id, id, model_score of JSON replies; scores beyond 0..1 raise, and with uuids ids that are none."""
    from .validation import require, require_uuid

    rows = replies.select("query_id", F.explode(F.from_json(reply, schemas.SCORES, {"mode": "FAILFAST"})).alias("s")).select("query_id", "s.id", F.col("s.score").alias("model_score"))
    rows = require_uuid(rows, "id") if uuids else rows
    return require(rows, F.col("model_score").between(0, 1), "a score must be between 0 and 1")


def above(scored: DataFrame, least: float | None, score: str = "rerank_score") -> DataFrame:
    if least is not None and not 0 <= least <= 1:
        raise ValueError("the least score must be between 0 and 1")
    return scored if least is None else scored.where(F.col(score) >= least)


def reranker_input(candidates: DataFrame) -> DataFrame:
    """query_id, id, title (null for atoms), content."""
    return candidates.select("query_id", "id", F.when(F.col("source_table") != "atoms", F.col("title")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))


def rerank_payloads(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, payload: a query and its candidates as JSON, for a model that scores them."""
    one = F.struct("id", "title", "content")
    packed = reranker_input(candidates).groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return packed.join(queries.select("query_id", "query"), "query_id").select("query_id", F.to_json(F.struct("query", "candidates"), {"ignoreNullFields": "false"}).alias("payload"))


def scores_told(replies: DataFrame) -> DataFrame:
    """query_id, id, model_score of replies; a reply that is no list of scores from 0 to 1 tells none, and of several scores the first counts."""
    told = replies.withColumn("s", F.from_json("reply", schemas.SCORES)).where(F.forall("s", lambda x: F.coalesce(x["score"].between(0, 1) & x["id"].isNotNull(), F.lit(False))))
    listed = told.select("query_id", F.posexplode("s").alias("pos", "s"))
    return listed.groupBy("query_id", F.col("s.id").alias("id")).agg(F.min_by("s.score", "pos").alias("model_score"))


def stubs(candidates: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Best k of each query as (query_id, id, title, source_table); no reranking."""
    return first_n(candidates, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "id", "title", "source_table")


def hashed_terms(asked: DataFrame) -> DataFrame:
    """Query terms as the numbers that stored vectors have for them."""
    return asked.withColumn("term", F.xxhash64("term").cast("string"))


def query_weights(queries: DataFrame) -> DataFrame:
    """query_id, term, weight 1 of each distinct term of a query."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term"), F.lit(1.0).alias("weight"))


def search(queries: DataFrame, points: DataFrame, mode: str, k: int = TOP_K, lexical: InvertedIndex | None = None, asked: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank in one mode; queries have query_id, query and (but for bm25) vector. lexical: stored lists of these points or more, else lists are made of their texts; asked: see lexical_topk."""
    if mode not in ("vector", "bm25", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    dense = dense_topk(queries, points, k) if mode != "bm25" else None
    if mode == "vector":
        return dense
    within = points if lexical else None
    sparse = lexical_topk(queries, lexical or InvertedIndex.of_texts(points, shared_folder(points.sparkSession, "lexical")), k, within, asked)
    return sparse if mode == "bm25" else fuse(dense, sparse, k=k)


def recall(queries: DataFrame, points: DataFrame, mode: str = "hybrid", k: int = TOP_K, least: float | None = None, lexical: InvertedIndex | None = None) -> DataFrame:
    """Search, rerank and threshold; k is the pool before reranking."""
    if k <= 0:
        raise ValueError("k must be positive")
    found = search(queries, points, mode, k, lexical)
    content = points.select("id", "source_table", "title", "content")
    return above(keyword_rerank(found.join(content, "id"), queries), least)


def attempts(calls: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Calls (run_id, arrival) with their attempt number (null beyond the budget) and the layers it may read."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("arrival"))
    out = calls.withColumn("n", n)
    layers = F.when(F.col("n") < most, "summaries").when(F.col("n") == most, "atoms+summaries").otherwise("exhausted")
    return out.withColumn("attempt", F.when(F.col("n") <= most, F.col("n"))).withColumn("layers", layers).drop("n")


def attempt_sources(attempt: int, project: bool = False) -> list[str]:
    """Source tables of a staged attempt: summaries first, atoms with the last one."""
    if not 1 <= attempt <= MAX_ATTEMPTS:
        raise ValueError("no such attempt")
    return (["atoms"] if attempt == MAX_ATTEMPTS else []) + resolve_sources(project=project)
