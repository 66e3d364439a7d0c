"""Atoms and rows with what they stand on: activity, supersession, source turns, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN_FIELDS = ["id", "session_id", "source", "content", "created_at"]


def superseded_ids(atoms: DataFrame, same_scope: bool = False) -> DataFrame:
    """Ids that some atom supersedes; with same_scope, pairs of id and the scope of that atom."""
    cols = [F.col("supersedes").alias("superseded_id"), *([F.col("scope").alias("superseded_scope")] if same_scope else [])]
    return atoms.where("supersedes IS NOT NULL").select(*cols).distinct()


def active_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with a living source that no other atom supersedes."""
    return atoms.where(~F.coalesce("source_deleted", F.lit(False))).join(superseded_ids(atoms), F.col("id") == F.col("superseded_id"), "left_anti")


def with_superseded_flag(atoms: DataFrame, all_atoms: DataFrame | None = None, same_scope: bool = True) -> DataFrame:
    old = superseded_ids(atoms if all_atoms is None else all_atoms, same_scope)
    on = F.col("id") == F.col("superseded_id")
    if same_scope:
        on &= F.col("scope") == F.col("superseded_scope")
    return atoms.join(old, on, "left").withColumn("superseded", F.col("superseded_id").isNotNull()).drop("superseded_id", "superseded_scope")


def with_entity(atoms: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select(F.col("id").alias("__entity"), F.col("name").alias("entity"))
    return atoms.join(names, F.col("entity_id") == F.col("__entity"), "left").drop("__entity")


def atom_turns(atoms: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct source turns of atoms, of the atom's own scope."""
    a = atoms.select(F.col("id").alias("record_id"), F.col("scope").alias("record_scope"))
    met = a.join(edges, F.col("record_id") == F.col("atom_id")).join(turns, (F.col("turn_id") == turns["id"]) & (turns["scope"] == F.col("record_scope")))
    return met.select("record_id", *[turns[c] for c in TURN_FIELDS]).distinct()


def row_turns(rows: DataFrame, links: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct source turns of summary rows (category, id), through their atoms."""
    r = rows.select(F.col("category").alias("source_table"), F.col("id").alias("record_id"), F.col("scope").alias("record_scope"))
    l = links.select("category", "row_id", F.col("atom_id").alias("linked_atom"))  # noqa: E741
    met = r.join(l, (F.col("source_table") == F.col("category")) & (F.col("record_id") == F.col("row_id"))).join(edges, F.col("linked_atom") == F.col("atom_id"))
    met = met.join(turns, (F.col("turn_id") == turns["id"]) & (turns["scope"] == F.col("record_scope")))
    return met.select("source_table", "record_id", *[turns[c] for c in TURN_FIELDS]).distinct()


def rows_of_atoms(rows: DataFrame, links: DataFrame, atoms: DataFrame) -> DataFrame:
    """Summary rows that are linked with any of the atoms."""
    touched = links.join(atoms.select(F.col("id").alias("__atom")), F.col("atom_id") == F.col("__atom"), "left_semi").select(F.col("category").alias("c"), F.col("row_id").alias("r")).distinct()
    return rows.join(touched, (F.col("category") == F.col("c")) & (F.col("id") == F.col("r")), "left_semi")


_TYPES = {"confidence": "float"}
RECORD = ["entity", "predicate", "origin", "scene_name", "confidence", "owner", "deadline", "status", "project_id"]


def of_scope_and_project(records: DataFrame, scope: str | None = None, project: str | None = None) -> DataFrame:
    """Records of the scope (None: of any), and of the project or, without one, of none."""
    own = records if scope is None else records.where(F.col("scope") == scope)
    return own.where(F.col("project_id").eqNullSafe(F.lit(project)))


def ranked(hydrated: DataFrame) -> DataFrame:
    """Records of each query, the best score first."""
    return hydrated.orderBy("query_id", F.desc("score"), "id")


def hydrate(candidates: DataFrame, atoms: DataFrame, rows: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Candidates (query_id, id, source_table, score) with the content of their active atom or summary row, and its fields of RECORD.

    What has to stay hidden is left out of atoms and rows before (of_scope_and_project).
    """
    facts = active_atoms(atoms)
    if entities is not None:
        facts = with_entity(facts, entities)
    more = lambda df: [(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in RECORD]
    facts = facts.select(*more(facts), F.lit("atoms").alias("t"), F.col("id").alias("i"), F.lit(None).cast("string").alias("title"), F.col("statement").alias("content"), "scope", F.col("category").alias("kind"))
    texts = rows.select(*more(rows), F.col("category").alias("t"), F.col("id").alias("i"), "title", F.col("summary").alias("content"), "scope", F.col("category").alias("kind"))
    met = candidates.join(facts.unionByName(texts), (F.col("source_table") == F.col("t")) & (candidates["id"] == F.col("i")))
    return met.select("query_id", candidates["id"], "source_table", "title", "content", met["scope"], "kind", "score", *[met[c] for c in RECORD])
