"""Versions of imported documents: what changed, what that deactivates, what has to be summarised anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import liveness

KEY = ["project_id", "relative_path"]


def version_diff(active: DataFrame, files: DataFrame) -> DataFrame:
    """project_id, relative_path, status (new, changed, unchanged, deleted), old_hash, new_hash."""
    old = active.select(*KEY, F.col("content_hash").alias("old_hash"))
    new = files.select(*KEY, F.col("content_hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return old.join(new, KEY, "full_outer").withColumn("status", status)


def import_counts(diff: DataFrame) -> DataFrame:
    """Per project: imported, unchanged, deleted."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return diff.groupBy("project_id").agg(n("new", "changed").alias("imported"), n("unchanged").alias("unchanged"), n("deleted").alias("deleted"))


def next_documents(documents: DataFrame, diff: DataFrame) -> DataFrame:
    """Documents after an import: the new hash of a path is active (an old version of that hash comes back), others aren't."""
    new = diff.where("new_hash IS NOT NULL").select(*KEY, F.col("new_hash"))
    met = documents.join(new, KEY, "left")
    gone = diff.where("status = 'deleted'").select(*KEY, F.lit(True).alias("gone"))
    met = met.join(gone, KEY, "left")
    active = F.when(F.col("new_hash").isNotNull(), F.col("content_hash") == F.col("new_hash")).otherwise(F.col("is_active") & F.col("gone").isNull())
    kept = met.withColumn("is_active", active).select(*documents.columns)
    fresh = diff.where("new_hash IS NOT NULL").join(documents.select(*KEY, F.col("content_hash").alias("new_hash")), [*KEY, "new_hash"], "left_anti")
    made = fresh.select(F.sha2(F.concat_ws("/", F.col("project_id").cast("string"), "relative_path", "new_hash"), 256).alias("id"), *KEY, F.col("new_hash").alias("content_hash"), F.lit(True).alias("is_active"))
    lack = [c for c in documents.columns if c not in made.columns]
    return kept.unionByName(made.select("*", *[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in lack]).select(*documents.columns))


def deactivate_chunks(chunks: DataFrame, documents: DataFrame, paths: DataFrame) -> DataFrame:
    """chunks with those of the paths' documents switched off."""
    off = documents.join(paths.select(*KEY).distinct(), KEY, "left_semi").select(F.col("id").alias("d"))
    met = chunks.join(off, F.col("document_id") == F.col("d"), "left")
    return met.withColumn("is_active", F.col("is_active") & F.col("d").isNull()).drop("d")


def active_sources(edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """atom_id, project_id of atoms that an active chunk of an active document is a source of."""
    return edges.join(_active_turns(chunks, documents), "turn_id").select("atom_id", "project_id").distinct()


def _active_turns(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """turn_id, project_id of active chunks of active documents."""
    on = documents.where("is_active").select(F.col("id").alias("document_id"), "project_id")
    return chunks.where("is_active").select("turn_id", "document_id").join(on, "document_id").select("turn_id", "project_id")


def _own_edges(edges: DataFrame, atoms: DataFrame, turns: DataFrame) -> DataFrame:
    """atom_id, own of the edges of a project's atoms to turns (turn_id, project_id) of that project.

    An atom's project comes first, so that an edge is met or not: a turn of many chunks doesn't repeat it.
    """
    own = edges.select("atom_id", "turn_id").join(atoms.where("project_id IS NOT NULL").select(F.col("id").alias("atom_id"), F.col("project_id").alias("own")), "atom_id")
    met = turns.select(F.col("turn_id").alias("t"), F.col("project_id").alias("p"))
    return own.join(met, (F.col("turn_id") == F.col("t")) & (F.col("own") == F.col("p")), "left_semi").select("atom_id", "own")


def stale_atoms(candidates: DataFrame, atoms: DataFrame, edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Those of candidates (id) without any active source in their project."""
    live = _own_edges(edges, atoms, _active_turns(chunks, documents)).select(F.col("atom_id").alias("a"), F.col("own").alias("p"))
    own = atoms.where("project_id IS NOT NULL").join(candidates.select(F.col("id").alias("c")).distinct(), F.col("id") == F.col("c"), "left_semi")
    return own.join(live, (F.col("id") == F.col("a")) & (F.col("project_id") == F.col("p")), "left_anti")


def touched_atoms(paths: DataFrame, documents: DataFrame, chunks: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """id of the atoms of a project that stand on any chunk of its paths."""
    hit = documents.join(paths.select(*KEY).distinct(), KEY, "left_semi").select(F.col("id").alias("document_id"), "project_id")
    turns = chunks.select("turn_id", "document_id").join(hit, "document_id").select("turn_id", "project_id")
    return _own_edges(edges, atoms, turns).select(F.col("atom_id").alias("id")).distinct()


def deactivation_cascade(paths: DataFrame, documents: DataFrame, chunks: DataFrame, edges: DataFrame, atoms: DataFrame, links: DataFrame, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """What switching paths off does: chunks, documents, stale (atom ids), sections (row ids to delete), refresh (atoms to summarise anew).

    counts: live sources of the atoms touched, as they are with the paths off
    (liveness); without them, they are looked for among all edges.
    """
    gone = paths.select(*KEY).distinct()
    hit = documents.join(gone, KEY, "left_semi").select(F.col("id").alias("document_id"), F.col("project_id").alias("p"))
    touched = touched_atoms(gone, documents, chunks, edges, atoms)
    chunks_after = deactivate_chunks(chunks, documents, gone)
    off = hit.select(F.col("document_id").alias("d"))
    documents_after = documents.join(off, F.col("id") == F.col("d"), "left").withColumn("is_active", F.col("is_active") & F.col("d").isNull()).drop("d")
    # chunks as they were: those switched off have inactive documents now
    stale = stale_atoms(touched, atoms, edges, chunks, documents_after).select("id") if counts is None else liveness.without_sources(touched, atoms, counts)
    own = links.where("category = 'project_sections'")
    sections = own.join(touched.select(F.col("id").alias("t")), F.col("atom_id") == F.col("t"), "left_semi").select("row_id").distinct()
    beside = own.join(sections, "row_id", "left_semi").select(F.col("atom_id").alias("id")).distinct()
    alive = atoms.where(~F.coalesce("source_deleted", F.lit(False)) & F.col("project_id").isNotNull()).select("id")
    refresh = beside.join(alive, "id", "left_semi").join(stale, "id", "left_anti")
    return {"chunks": chunks_after, "documents": documents_after, "stale": stale, "sections": sections, "refresh": refresh}


def latest_versions(documents: DataFrame, order: str) -> DataFrame:
    """The newest version of each path."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(order), "id")
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
