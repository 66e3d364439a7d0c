"""Queries of the path from a question to its answers: sources, search, fusion, reranking, hydration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import agent, cells, pooling, provenance, registry, retrieval
from ..operators.inverted import InvertedIndex
from ..sources.folders import fingerprint, shared_folder
from . import model

CATALOG = model.Catalog()
add = CATALOG.add

_VISIBLE = "(SELECT * FROM points WHERE NOT coalesce(source_deleted, false) AND NOT coalesce(superseded, false))"
_TERMS = "regexp_extract_all(lower({}), '[a-z0-9_]{{2,}}')"
_TOKENS = "list_distinct(" + _TERMS + ")"
_COSINE = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"


@add("index_filter_isolation", f"SELECT p.project AS asked_project, scope, source_table, count(*) AS n FROM (SELECT NULL AS project UNION ALL SELECT 1) p JOIN {_VISIBLE} v ON v.project_id IS NOT DISTINCT FROM p.project GROUP BY ALL")
def index_filter_isolation(t):
    points = t("points")
    part = lambda p: retrieval.visible(points, p).withColumn("asked_project", F.lit(None).cast("int") if p is None else p)
    return part(None).unionByName(part(F.lit(1))).groupBy("asked_project", "scope", "source_table").agg(F.count("*").alias("n"))


@add("index_scope_filter", f"SELECT id, source_table FROM {_VISIBLE} WHERE project_id IS NULL AND scope = 'src3' AND source_table IN ('atoms', 'docs', 'tasks')")
def index_scope_filter(t):
    return retrieval.in_scope(retrieval.visible(t("points")), "src3", ["atoms", "docs", "tasks"]).select("id", "source_table")


def _requests(t):
    none, k = F.array().cast("array<string>"), F.col("item_id") % 7
    lit = lambda *x: F.array(*map(F.lit, x))
    types = F.when(k == 1, lit("user")).when(k == 2, lit("agent", "user")).when(k == 3, lit("workspace")).otherwise(none)
    sources = F.when(k == 4, lit("atoms")).when(k == 5, lit("docs")).when(k == 2, lit("atoms", "users")).otherwise(none)
    return t("benchmark").select(F.col("item_id").alias("query_id"), types.alias("types"), sources.alias("sources"), F.when(F.col("item_id") % 3 == 0, F.col("item_id")).alias("project_id"))


@add(
    "type_source_expansion",
    """WITH r AS (SELECT item_id AS query_id, item_id % 3 = 0 AS project, CASE item_id % 7 WHEN 1 THEN ['user'] WHEN 2 THEN ['agent', 'user'] WHEN 3 THEN ['workspace'] ELSE [] END AS types,
      CASE item_id % 7 WHEN 4 THEN ['atoms'] WHEN 5 THEN ['docs'] WHEN 2 THEN ['atoms', 'users'] ELSE [] END AS sources FROM benchmark),
    typed AS (SELECT query_id, list(category) AS c FROM r JOIN category_types k ON list_contains(types, k.type) AND category <> 'atoms' AND (project OR category <> 'project_sections') GROUP BY query_id),
    o AS (SELECT r.query_id, CASE WHEN len(types) + len(sources) = 0 THEN CASE WHEN project THEN ['project_sections'] ELSE (SELECT list(category) FROM category_types WHERE category NOT IN ('atoms', 'project_sections')) END
      ELSE list_distinct(list_concat(coalesce(c, []), sources)) END AS s FROM r LEFT JOIN typed USING (query_id))
    SELECT query_id, array_to_string(list_sort(s), ',') AS resolved, CASE WHEN len(s) <> 1 THEN 'hybrid' WHEN s[1] IN ('profiles', 'users', 'atoms') THEN 'vector' ELSE 'bm25' END AS mode FROM o""",
)
def type_source_expansion(t):
    return retrieval.expand_sources(_requests(t), t("category_types")).select("query_id", F.array_join("resolved_sources", ",").alias("resolved"), "mode")


def _vector_queries(t):
    return t("embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _vector_points(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense"))


@add(
    "dense_topk",
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE.format('q.embedding', 'e.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 8",
)
def dense_topk(t):
    return retrieval.dense_topk(_vector_queries(t), _vector_points(t), retrieval.TOP_K).withColumn("score", F.round("score", 6))


@add(
    "dense_cells",
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COSINE.format('q.embedding', 'e.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) WHERE rank <= 8",
)
def dense_cells(t):
    """dense_topk by stored cells, of which those that can't hold a best vector aren't read."""
    points, folder = _vector_points(t), shared_folder(t("embeddings").sparkSession, "cells")
    return cells.CellIndex.build(points, f"{folder}/index").topk(_vector_queries(t), retrieval.TOP_K, f"{folder}/search").withColumn("score", F.round("score", 6))


_BM25 = f"""posts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS.format('content')}) AS term FROM points) GROUP BY id, term),
    lens AS (SELECT id, sum(tf) AS len FROM posts GROUP BY id),
    w AS (SELECT p.id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens))) AS w FROM posts p JOIN lens ON lens.id = p.id),
    q AS (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM queries),
    s AS (SELECT query_id, id, sum(w) AS score FROM w JOIN q USING (term) GROUP BY query_id, id)"""


_INDEXES: dict[tuple, InvertedIndex] = {}


def _lists(t, points, *read) -> InvertedIndex:
    """The stored inverted lists of points, which are made of the tables named; made once for each application and state of their files."""
    spark = points.sparkSession
    key = (spark.sparkContext.applicationId, points.semanticHash(), *fingerprint(*map(t, read)))
    if key not in _INDEXES:
        _INDEXES[key] = InvertedIndex.of_texts(points, shared_folder(spark, "lexical"))
    return _INDEXES[key]


@add("sparse_topk", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 8")
def sparse_topk(t):
    return retrieval.lexical_topk(t("queries"), _lists(t, t("points"), "documents", "labels"), retrieval.TOP_K).withColumn("score", F.round("score", 6))


def _hybrid(t):
    """Queries with vectors, and points with both content and vector."""
    vectors = _vector_points(t)
    queries = t("queries").join(vectors.withColumnRenamed("dense", "vector"), F.col("query_id") == F.col("id")).select("query_id", "query", "vector")
    points = retrieval.visible(t("points")).join(vectors, "id")
    return queries, points, _lists(t, points, "documents", "labels", "embeddings")


_HYBRID = f"""hp AS (SELECT v.*, e.embedding FROM {_VISIBLE} v JOIN embeddings e ON e.vec_id = v.id WHERE v.project_id IS NULL),
    hq AS (SELECT query_id, query, embedding FROM queries JOIN embeddings ON vec_id = query_id),
    dn AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(hq.embedding AS DOUBLE[]), CAST(hp.embedding AS DOUBLE[])) DESC, id) AS rank FROM hq, hp) WHERE rank <= 8),
    posts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS.format('content')}) AS term FROM hp) GROUP BY id, term),
    lens AS (SELECT id, sum(tf) AS len FROM posts GROUP BY id),
    w AS (SELECT p.id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens))) AS w FROM posts p JOIN lens ON lens.id = p.id),
    q AS (SELECT query_id, unnest({_TOKENS.format('query')}) AS term FROM hq),
    s AS (SELECT query_id, id, sum(w) AS score FROM w JOIN q USING (term) GROUP BY query_id, id),
    sp AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 8),
    f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM sp) GROUP BY query_id, id),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 8)"""


@add("rank_fusion", f"WITH {_HYBRID} SELECT query_id, id, round(score, 6) AS score, rank FROM top")
def rank_fusion(t):
    queries, points, lists = _hybrid(t)
    return retrieval.search(queries, points, "hybrid", lexical=lists).withColumn("score", F.round("score", 6))


@add(
    "hybrid_recall",
    f"""WITH {_HYBRID},
    r AS (SELECT query_id, id, source_table, least(greatest(0.8 * len(list_intersect({_TOKENS.format('hq.query')}, {_TOKENS.format('hp.content')})) / greatest(len({_TOKENS.format('hq.query')}), 1) + 0.2 * least(greatest(score, 0), 1), 0), 1) AS rerank FROM top JOIN hq USING (query_id) JOIN hp USING (id))
    SELECT query_id, id, source_table, round(rerank, 6) AS rerank_score FROM r WHERE rerank >= 0.2""",
)
def hybrid_recall(t):
    queries, points, lists = _hybrid(t)
    return retrieval.recall(queries, points, least=0.2, lexical=lists).select("query_id", "id", "source_table", F.round("rerank_score", 6).alias("rerank_score"))


def _pool(t):
    """Candidates of every query: the best finds of a lexical search over all points, scored by rank."""
    found = retrieval.lexical_topk(t("queries"), _lists(t, t("points"), "documents", "labels"), retrieval.CANDIDATES)
    return found.select("query_id", "id", (1.0 / F.col("rank")).alias("score")).join(t("points").select("id", "source_table", "title", "content"), "id")


_POOL = f"""WITH {_BM25}, pool AS (SELECT r.query_id, asked.query, p.id, p.source_table, p.title, p.content, 1.0 / rank AS score FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) r
    JOIN queries asked ON asked.query_id = r.query_id JOIN points p ON p.id = r.id WHERE rank <= 20)"""
_KEYWORD = f"least(greatest(0.8 * len(list_intersect({_TOKENS.format('query')}, {_TOKENS.format('content')})) / greatest(len({_TOKENS.format('query')}), 1) + 0.2 * score, 0), 1)"


@add("keyword_rerank", f"{_POOL} SELECT query_id, id, round({_KEYWORD}, 6) AS rerank_score FROM pool")
def keyword_rerank(t):
    return retrieval.keyword_rerank(_pool(t), t("queries")).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


_MODEL = f"CASE WHEN id % 3 = 0 THEN (id % 50) / 50.0 ELSE {_KEYWORD} END"


@add("model_rerank", f"{_POOL} SELECT query_id, id, round({_MODEL}, 6) AS rerank_score FROM pool WHERE {_MODEL} >= 0.1")
def model_rerank(t):
    pool = _pool(t)
    replies = pool.where("id % 3 = 0").groupBy("query_id").agg(F.to_json(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), (F.col("id") % 50 / 50.0).alias("score")))).alias("reply"))
    scores = retrieval.parse_scores(replies).withColumn("id", F.col("id").cast("long"))
    return retrieval.above(retrieval.model_rerank(pool, t("queries"), scores), 0.1).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


@add("reranker_input", f"{_POOL} SELECT query_id, id, CASE WHEN source_table <> 'atoms' THEN title END AS title, length(content) AS n FROM pool")
def reranker_input(t):
    return retrieval.reranker_input(_pool(t)).select("query_id", "id", "title", F.length("content").cast("long").alias("n"))


@add("candidate_stubs", f"{_POOL} SELECT query_id, id, title, source_table FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM pool) WHERE n <= 8")
def candidate_stubs(t):
    return retrieval.stubs(_pool(t), retrieval.TOP_K)


@add("dedup_best_candidate", "SELECT query_id, id, source_table, score FROM (SELECT user_id AS query_id, event_id % 20 AS id, event_type AS source_table, round(value) AS score, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY round(value) DESC, event_id) AS n FROM events) WHERE n = 1")
def dedup_best_candidate(t):
    c = t("events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 20).alias("id"), F.col("event_type").alias("source_table"), F.round("value").alias("score"), F.col("event_id").alias("arrival"))
    return retrieval.keep_best(c).select("query_id", "id", "source_table", "score")


@add("pooled_dense", """WITH e AS (SELECT label AS id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS x FROM embeddings), m AS (SELECT id, pos, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY id, pos)
    SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x / (SELECT sqrt(sum(n.x * n.x)) FROM m n WHERE n.id = m.id), 6) AS x FROM m""")
def pooled_dense(t):
    pooled = pooling.pooled_dense(t("embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("dense")))
    return pooled.select("id", F.posexplode("dense").alias("pos", "x")).withColumn("x", F.round("x", 6))


@add("pooled_sparse", "SELECT id, array_to_string(list(CAST(idx AS VARCHAR) ORDER BY idx), ',') AS indices, round(sum(weight), 6) AS total FROM (SELECT l_orderkey % 100 AS id, l_partkey % 64 AS idx, max(l_discount) AS weight FROM lineitem GROUP BY 1, 2) GROUP BY id")
def pooled_sparse(t):
    chunks = t("lineitem").select((F.col("l_orderkey") % 100).alias("id"), (F.col("l_partkey") % 64).alias("idx"), F.col("l_discount").alias("weight"))
    arrays = pooling.sparse_arrays(pooling.pooled_sparse(chunks))
    return arrays.select("id", F.array_join("indices", ",").alias("indices"), F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@add("hydrated_results", """WITH act AS (SELECT a.* FROM atoms a WHERE NOT coalesce(source_deleted, false) AND NOT EXISTS (SELECT 1 FROM atoms b WHERE b.supersedes = a.id)),
    c AS (SELECT event_id AS query_id, event_id * 3 AS id, CASE WHEN event_id % 2 = 0 THEN 'atoms' ELSE 'tasks' END AS source_table, value AS score FROM events)
    SELECT query_id, c.id, source_table, title, content, score FROM c JOIN (SELECT 'atoms' AS t, id, NULL AS title, statement AS content FROM act UNION ALL SELECT category, id, title, summary FROM l2_rows) x ON x.t = c.source_table AND x.id = c.id""")
def hydrated_results(t):
    table = F.when(F.col("event_id") % 2 == 0, "atoms").otherwise("tasks")
    c = t("events").select(F.col("event_id").alias("query_id"), (F.col("event_id") * 3).alias("id"), table.alias("source_table"), F.col("value").alias("score"))
    return provenance.hydrate(c, t("atoms"), t("l2_rows"), t("entities")).select("query_id", "id", "source_table", "title", "content", "score")


@add("recall_budget", "SELECT user_id AS run_id, event_id AS arrival, CASE WHEN n <= 3 THEN n END AS attempt, CASE WHEN n < 3 THEN 'summaries' WHEN n = 3 THEN 'atoms+summaries' ELSE 'exhausted' END AS layers FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def recall_budget(t):
    return retrieval.attempts(t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("arrival")))


def _projects(t):
    """All parts as projects."""
    aliases = F.array("p_brand", F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")))
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), aliases.alias("aliases"))


_ASKED = ["Small Ring", "widget", "brand#7", "blue_widget", "ECONOMY-11", "green  gadget", "ring small"]


@add(
    "project_rank",
    f"""WITH asked AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{' '.join(n.lower().split())}')" for k, n in enumerate(_ASKED))}) AS v(query_id, asked)),
    p AS (SELECT id, name, lower(name) AS norm, list_transform(aliases, lambda a: lower(a)) AS al FROM projects),
    qt AS (SELECT query_id, asked, list_filter(string_split(translate(asked, '-_', '  '), ' '), lambda x: x <> '') AS terms FROM asked),
    cand AS (SELECT query_id, asked, terms, p.id, p.name, norm, al, list_concat([norm], al) AS names FROM qt, p),
    m AS (SELECT *, CASE WHEN asked = norm THEN 0 WHEN list_contains(al, asked) THEN 1 WHEN len(list_filter(names, lambda n: contains(n, asked))) > 0 THEN 2
       WHEN len(list_filter(names, lambda n: len(list_filter(terms, lambda t: NOT (list_contains(string_split(translate(n, '-_', '  '), ' '), t) OR (length(t) >= 4 AND contains(replace(translate(n, '-_', '  '), ' ', ''), t))))) = 0)) > 0 THEN 3 END AS match FROM cand)
    SELECT query_id, match, id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match, norm, id) AS rank FROM m WHERE match IS NOT NULL) WHERE rank <= 10""",
)
def project_rank(t):
    asked = t("region").sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(_ASKED)) + " AS v(query_id, name)")
    return registry.rank_projects(asked, _projects(t))


@add("term_sets", f"SELECT item_id, CAST(len({_TOKENS.format('text')}) AS INTEGER) AS n_terms FROM benchmark")
def term_sets(t):
    return t("benchmark").select("item_id", F.size(tokens(F.col("text"))).alias("n_terms"))


@add("message_intents", """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b[A-Z][A-Z0-9]+-\\d+\\b') OR regexp_matches(lower(text), 'jira|transition|ticket|issue') THEN 'jira' WHEN regexp_matches(lower(text), 'batch|ingest|records|sync|rows|csv') THEN 'complex' WHEN regexp_matches(lower(text), 'user|welcome|draft|editorial|email|u1|u2') THEN 'medium' ELSE 'simple' END AS workflow
    FROM conversations""")
def message_intents(t):
    return t("conversations").select("conv_id", "turn", agent.intent(F.col("text"))["workflow"].alias("workflow"))
