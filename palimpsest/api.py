"""The engine's front: memory operations over a snapshot store, each for many rows at once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions.text import project_name
from .operators import mutations, pooling, provenance, registry, retrieval, validation
from .operators.inverted import InvertedIndex
from .shipping import ship
from .sources import index
from .sources.ledger import Model, ReplyLedger
from .sources.snapshot import BUCKETS, SnapshotStore

REMEMBERED = "remembered"
#: Inverted lists that a lexical search reads together at most.
MOST_LISTS = 8


class Memory:
    """remember, recall, search_candidates, fetch, drill_down, update, forget, list_projects, resolve_project.

    encoder turns a list of texts into vectors of `dimensions`; without one, only
    lexical search is offered. sparse_encoder turns texts into weights by index; without
    one, terms are counted. reranker scores a query's candidates (JSON in, JSON out, asked
    through the ledger of replies); those without a score get one by their terms. Every change is one commit of all tables it touches,
    the index among them.
    """

    def __init__(self, spark: SparkSession, root: str, encoder: Callable[[list[str]], list[list[float]]] | None = None, dimensions: int = 0, default_scope: str | None = None, buckets: int = BUCKETS, reranker: Model | None = None, sparse_encoder: Callable[[list[str]], list[dict[int, float]]] | None = None):
        ship(spark)
        self.reranker, self.sparse_encoder = reranker, sparse_encoder
        self.spark, self.store = spark, SnapshotStore(spark, root, buckets)
        self.encoder, self.dimensions, self.default_scope = encoder, dimensions, default_scope

    def _points(self, points: DataFrame) -> DataFrame:
        """points with vectors: dense ones of their chunks, headed by a summary row's title, and sparse ones."""
        texts = points.select("id", F.col("content").alias("text"), F.coalesce("title", F.lit("")).alias("breadcrumb"))
        sparse = pooling.sparse_encoded(texts, self.sparse_encoder) if self.sparse_encoder else pooling.sparse_vectors(texts)
        out = points.join(sparse, "id", "left")
        out = out.join(pooling.embedded(texts, self.encoder, self.dimensions), "id", "left") if self.encoder else out.withColumn("dense", F.lit(None).cast("array<float>"))
        return out.select(*self.store.table("index_points").columns)

    def index_changes(self, atoms: DataFrame | None, rows: DataFrame | None, all_atoms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """New points of the atoms and rows given, and the ids of those that are to be none any more. all_atoms: whose supersessions count, by default the atoms'."""
        points = []
        if atoms is not None:
            points.append(index.atom_points(atoms, all_atoms))
        if rows is not None:
            points.append(index.row_points(rows))
        touched = points[0] if len(points) == 1 else points[0].unionByName(points[1])
        deleted = F.coalesce("source_deleted", F.lit(False))
        return self._points(touched.where(~deleted)), touched.where(deleted).select("id")

    def _commit_atoms(self, atoms: DataFrame) -> int:
        """Write changed atoms and their points; only the buckets that hold them are written."""
        atoms = self.store.staged(atoms)
        points, hidden = self.index_changes(atoms, None, self.store.table("atoms"))
        return self.store.commit(merge={"atoms": atoms, "index_points": points}, gone={"index_points": hidden})

    def remember(self, statements: DataFrame) -> DataFrame:
        """Atoms that a user states (scope, statement, category); returns id, scope, statement of what was written."""
        checked = validation.require(statements, F.col("category").isin(schemas.ATOM_CATEGORIES), "unknown category")
        checked = validation.require(checked, (F.length(F.trim("statement")) > 0) & (F.length(F.trim("scope")) > 0), "statement and scope are needed")
        new = mutations.asserted(checked, F.expr("uuid()"), REMEMBERED, F.current_timestamp())
        old = self.store.table("atoms")
        lack = [c for c in old.columns if c not in new.columns]
        new = new.select("*", *[(F.lit(False) if c == "source_deleted" else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in lack]).select(*old.columns)
        fresh = self.store.staged(new)  # ids are fixed once they are written
        points, _ = self.index_changes(fresh, None)
        self.store.commit(merge={"index_points": points}, append={"atoms": fresh})
        return fresh.select("id", "scope", "statement")

    def update(self, changes: DataFrame, scope: str | None = None) -> int:
        """Changes (id and any of statement, category, predicate) to atoms (of the scope, if one is given); they count as asserted."""
        fields = [c for c in ("statement", "category", "predicate") if c in changes.columns]
        if "category" in fields:
            changes = validation.require(changes, F.col("category").isNull() | F.col("category").isin(schemas.ATOM_CATEGORIES), "unknown category")
        if scope is not None or self.default_scope is not None:
            changes = self._own(changes, scope)
        changes = self.store.staged(changes)
        return self._commit_atoms(mutations.update_atoms(self.store.rows_of("atoms", changes), changes, fields))

    def _own(self, ids: DataFrame, scope: str | None) -> DataFrame:
        """Rows of ids that name an atom of the scope; another one's raise."""
        own = validation.read_scope(scope, False, self.default_scope)
        scopes = self.store.table("atoms").select(F.col("id").alias("__id"), F.col("scope").alias("__scope"))
        met = ids.join(scopes, F.col("id") == F.col("__id"), "left")
        return validation.require(met, F.col("__scope") == own, "no such atom in the scope").drop("__id", "__scope")

    def forget(self, ids: DataFrame, scope: str | None = None) -> DataFrame:
        """Soft delete of atoms (of the scope, if one is given); returns id, found."""
        own = validation.read_scope(scope, scope is None and self.default_scope is None, self.default_scope)
        ids = self.store.staged(ids)
        known = self.store.rows_of("atoms", ids)
        mine = known if own is None else known.where(F.col("scope") == own)
        out = self.store.staged(mutations.forgotten(mine, ids))
        self._commit_atoms(mutations.forget(mine, ids))
        return out

    def _visible(self, scope: str | None, sources: list[str] | None, types: list[str] | None, project: str | None) -> tuple[DataFrame, list[str]]:
        validation.require_project(self.store.table("project_registry"), project, scope)
        named = retrieval.resolve_sources(types, sources, project is not None)
        points = retrieval.visible(self.store.table("index_points"), None if project is None else F.lit(project))
        return retrieval.in_scope(points, scope, named), named

    def _queries(self, queries: DataFrame) -> DataFrame:
        queries = validation.require(queries, F.length(F.trim("query")) > 0, "a query must not be blank")
        if not self.encoder:
            return queries
        texts = queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"), F.lit("query").alias("breadcrumb"))
        return queries.join(pooling.embedded(texts, self.encoder, self.dimensions).toDF("query_id", "vector"), "query_id")

    def _terms(self, queries: DataFrame) -> DataFrame:
        """query_id, term, weight of queries, with the numbers that stored vectors have for terms."""
        if self.sparse_encoder is None:
            return retrieval.hashed_terms(retrieval.query_weights(queries))
        texts = queries.select(F.col("query_id").alias("id"), F.col("query").alias("text"), F.lit("").alias("breadcrumb"))
        told = pooling.sparse_encoded(texts, self.sparse_encoder)
        return told.select(F.col("id").alias("query_id"), F.explode("sparse").alias("term", "weight")).where("weight > 0").withColumn("term", F.col("term").cast("string"))

    def _reranked(self, found: DataFrame, asked: DataFrame) -> DataFrame:
        """found with rerank_score: by the reranker, or by terms."""
        if self.reranker is None:
            return retrieval.keyword_rerank(found, asked)
        found = self.store.staged(found)
        replies = ReplyLedger(self.store, "rerank").ask(retrieval.rerank_payloads(found, asked), self.reranker)
        return retrieval.model_rerank(found, asked, retrieval.scores_told(replies))

    def _lexical(self) -> InvertedIndex:
        """Inverted lists of the points as they are. Buckets that were written since the lists were made get lists of their own; MOST_LISTS of these are made one again."""
        folder, there = f"{self.store.root}/_lexical", self.store.buckets("index_points")
        state = {str(b): hashlib.sha256("\n".join(paths).encode()).hexdigest() for b, paths in there.items()}
        made = [InvertedIndex(self.spark, f"{folder}/{s.getPath().getName()}") for s in self.store._listed(folder) if self.store._listed(f"{folder}/{s.getPath().getName()}/facts/_SUCCESS")]
        owner = {b: x for x in made for b, key in x.facts[0]["covers"].items() if state.get(b) == key}
        lack = state.keys() - owner.keys()
        if len({x.roots[0] for x in owner.values()}) + bool(lack) > MOST_LISTS:
            owner, lack = {}, state.keys()
        if lack or not owner:
            points = self.store.table("index_points") if not lack else None
            for b in sorted(lack):
                part = self.spark.read.schema(schemas.INDEX_POINTS).parquet(*there[int(b)]).withColumn("bucket", F.lit(b))
                points = part if points is None else points.unionByName(part)
            points = points if lack else points.withColumn("bucket", F.lit(""))
            new = InvertedIndex.of_vectors(points, f"{folder}/{uuid.uuid4().hex}", group="bucket", facts={"covers": {b: state[b] for b in lack}})
            owner |= dict.fromkeys(lack or [""], new)
        used = list({x.roots[0]: x for x in owner.values()})
        lists = InvertedIndex(self.spark, *used)
        lists.alive = [[b for b, x in owner.items() if x.roots[0] == root] for root in used]
        return lists

    def _search(self, queries, k, mode, scope, sources, types, project) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Candidates, queries and points; lexical search reads the stored sparse vectors."""
        if k <= 0:
            raise ValueError("k must be positive")
        points, named = self._visible(scope, sources, types, project)
        if mode is None:
            mode = "hybrid" if len(named) != 1 else "vector" if named[0] in schemas.VECTOR_SOURCES else "bm25"
        asked = self._queries(queries)
        mode = mode if self.encoder else "bm25"
        lists, terms = (None, None) if mode == "vector" else (self._lexical(), self._terms(queries))
        found = retrieval.search(asked, points, mode, k, lists, terms)
        return found.join(points.select("id", "source_table", "title", "content"), "id"), asked, points

    def recall(self, queries: DataFrame, k: int = retrieval.TOP_K, least: float | None = None, mode: str | None = None, scope: str | None = None, sources: list[str] | None = None, types: list[str] | None = None, project: str | None = None, all_scopes: bool = False) -> DataFrame:
        """Answers to queries (query_id, query): hydrated records with their score, reranked; k is the pool before reranking."""
        scope = validation.read_scope(scope, all_scopes, self.default_scope)
        found, asked, _ = self._search(queries, k, mode, scope, sources, types, project)
        scored = retrieval.above(self._reranked(found, asked), least).select("query_id", "id", "source_table", F.col("rerank_score").alias("score"))
        return self._hydrated(scored, scope, project)

    def search_candidates(self, queries: DataFrame, k: int = retrieval.CANDIDATES, mode: str | None = None, scope: str | None = None, sources: list[str] | None = None, types: list[str] | None = None, project: str | None = None, all_scopes: bool = False) -> DataFrame:
        """query_id, id, title, source_table of the best k, not reranked."""
        scope = validation.read_scope(scope, all_scopes, self.default_scope)
        found, _, _ = self._search(queries, k, mode, scope, sources, types, project)
        return retrieval.stubs(found, k)

    def _hydrated(self, scored: DataFrame, scope: str | None, project: str | None) -> DataFrame:
        """Records of the scope (None: any) and of the project or, without one, of none; the best score of a query first."""
        own = lambda name: provenance.of_scope_and_project(self.store.table(name), scope, project)
        met = provenance.hydrate(scored, self.store.table("atoms"), own("l2_rows"), self.store.table("entities"))
        # what supersedes an atom may be of another scope or project, so atoms are parted after it has been seen
        return provenance.ranked(provenance.of_scope_and_project(met, scope, project))

    def fetch(self, ids: DataFrame, scope: str | None = None, project: str | None = None, all_scopes: bool = False) -> DataFrame:
        """Records of ids (id) in the scope, of the project or of none; score 0."""
        scope = validation.read_scope(scope, all_scopes, self.default_scope)
        validation.require_project(self.store.table("project_registry"), project, scope)
        tables = [F.lit(t) for t in ["atoms", *schemas.L2_CATEGORIES]]
        asked = validation.require_uuid(ids, "id").select(F.lit(0).alias("query_id"), "id", F.explode(F.array(*tables)).alias("source_table"), F.lit(0.0).alias("score"))
        return self._hydrated(asked, scope, project).drop("query_id")

    def drill_down(self, ids: DataFrame, source_table: str, scope: str | None = None, project: str | None = None, all_scopes: bool = False) -> DataFrame:
        """Source turns of atoms, or of summary rows through their atoms, oldest first; records of the scope, of the project or of none."""
        if source_table not in dict(schemas.CATEGORY_TYPES):
            raise ValueError(f"unknown source {source_table}")
        scope = validation.read_scope(scope, all_scopes, self.default_scope)
        validation.require_project(self.store.table("project_registry"), project, scope)
        own = lambda name: provenance.of_scope_and_project(self.store.table(name), scope, project)
        edges, turns = self.store.table("atom_sources"), self.store.table("turns")
        wanted = ids.select("id").distinct()
        if source_table == "atoms":
            out = provenance.atom_turns(own("atoms").join(wanted, "id", "left_semi"), edges, turns)
        else:
            rows = own("l2_rows").where(F.col("category") == source_table).join(wanted, "id", "left_semi")
            out = provenance.row_turns(rows, self.store.table("l2_atoms"), edges, turns).drop("source_table")
        return out.orderBy("record_id", "created_at", "id")

    def register_projects(self, projects: DataFrame) -> int:
        """Projects (scope, name, aliases, root_path): new ones, and changes to those of the same name."""
        now = F.current_timestamp()
        new = projects.select(F.expr("uuid()").alias("id"), "scope", "name", project_name(F.col("name")).alias("normalized_name"), "aliases", "root_path", now.alias("created_at"), now.alias("updated_at"))
        new = validation.require(new, F.length("normalized_name") > 0, "a project needs a name")
        return self.store.commit({"project_registry": mutations.register_projects(self.store.table("project_registry"), new)})

    def list_projects(self, scope: str | None = None) -> DataFrame:
        return registry.listed_projects(self.store.table("project_registry"), scope)

    def resolve_project(self, names: DataFrame, scope: str | None = None, limit: int = 3) -> DataFrame:
        """Best projects for names (query_id, name)."""
        known = self.store.table("project_registry")
        return registry.rank_projects(names, known if scope is None else known.where(F.col("scope") == scope), limit)
