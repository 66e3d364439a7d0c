"""Commits of judged batches: atoms, their sources, coverage and cursors, as deltas for one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, uuid5
from .mutations import fresh_entities, match_entities
from .pending import SESSION


#: What the names begin with that new entities' ids follow from.
ENTITY_PREFIX = "entity:"


def still_open(atoms: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Atoms with those of their sources that are still uncovered at commit; atoms that have none left go.

    The judge ran without a lock, so another writer may have covered a turn since.
    Corroboration isn't asked for again.
    """
    open_ids = uncovered.select(F.col("id").alias("turn_id")).distinct()
    kept = atoms.select("atom_id", F.explode("source_turn_ids").alias("turn_id")).distinct().join(open_ids, "turn_id", "left_semi")
    sources = kept.groupBy("atom_id").agg(F.sort_array(F.collect_list("turn_id")).alias("source_turn_ids"))
    return atoms.drop("source_turn_ids").join(sources, "atom_id")


def same_scope_supersedes(atoms: DataFrame, known: DataFrame) -> DataFrame:
    """Atoms whose supersedes is kept only where it names an atom of the same scope and project."""
    old = known.select(F.col("id").alias("k_id"), F.col("scope").alias("k_scope"), F.col("project_id").alias("k_project"))
    on = (F.col("supersedes") == F.col("k_id")) & (F.col("scope") == F.col("k_scope")) & F.col("project_id").eqNullSafe(F.col("k_project"))
    return atoms.join(old, on, "left").withColumn("supersedes", F.col("k_id")).drop("k_id", "k_scope", "k_project")


def commit(judged: DataFrame, batch: DataFrame, uncovered: DataFrame, known: DataFrame, entities: DataFrame, now: Column, project: bool = False) -> dict[str, DataFrame]:
    """Deltas of a judged batch.

    judged: atom_id, scope, project_id, statement, category, scene_name, entity,
    predicate, confidence, supersedes, source_turn_ids. batch: the turns judged.
    Generic batches cover only turns that became a source; project batches cover
    all their turns. The cursor of a session moves to its last turn of the batch.
    Names that match no entity make new ones, whose ids follow from scope and name.
    """
    atoms = same_scope_supersedes(still_open(judged, uncovered), known)
    names = atoms.where("entity IS NOT NULL").select("atom_id", "scope", squeeze(F.col("entity")).alias("name"))
    new = fresh_entities(names, entities, uuid5(F.concat(F.lit(ENTITY_PREFIX), F.col("scope"), F.lit("/"), F.lower("name"))), now)
    named = match_entities(names, entities.unionByName(new.select(*entities.columns))).select("atom_id", "entity_id")
    rows = atoms.join(named, "atom_id", "left").select(
        F.col("atom_id").alias("id"), "scope", "statement", "category", F.lit("inferred").alias("origin"), "scene_name", "entity_id", "predicate",
        F.col("confidence").cast("float").alias("confidence"), "supersedes", F.lit(False).alias("source_deleted"), "project_id", now.alias("created_at"),
    )
    edges = atoms.select("atom_id", F.explode("source_turn_ids").alias("turn_id"))
    covered = batch.select("id") if project else edges.select(F.col("turn_id").alias("id")).distinct()
    last = batch.groupBy(*SESSION).agg(F.max(F.struct("created_at", "id")).alias("last"))
    cursors = last.select(*SESSION, F.col("last.created_at").alias("cursor_at"), F.col("last.id").alias("cursor_id"))
    return {"entities": new, "atoms": rows, "atom_sources": edges, "extraction_coverage": covered, "extraction_attempts": cursors}


def turns_that_are_sources(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of the turns that an atom stands on."""
    return turns.join(edges.select(F.col("turn_id").alias("__t")), F.col("id") == F.col("__t"), "left_semi").select("id").distinct()


def reindexed(delta: DataFrame, atoms: DataFrame) -> DataFrame:
    """Ids whose points change with new atoms: their own, and those that they supersede."""
    return delta.select("id").unionByName(delta.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"))).distinct().join(atoms.select("id"), "id", "left_semi")
