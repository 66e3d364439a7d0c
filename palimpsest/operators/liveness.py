"""How many live sources an atom has in each project: kept, and changed by what an edit adds and takes away.

A live source is an edge from an atom to a turn of an active chunk of an active
document; a turn of several such chunks counts once for each. An edit reads the
chunks of its own documents and the edges of their turns; no other edge is counted
again. Counts that an edit doesn't fit, so that one falls below zero, raise.

Atoms without live sources have no row. Edges, chunks and documents with a null key
count nowhere; a null is_active is inactive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import parts_of

ATOM = ["atom_id", "project_id"]
TURN = ["turn_id", "project_id"]


def live_turns(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """turn_id, project_id, n: active chunks of active documents of each turn."""
    on = documents.where("is_active").select(F.col("id").alias("document_id"), "project_id")
    return chunks.where("is_active").join(on, "document_id").groupBy(*TURN).agg(F.count("*").alias("n"))


def source_counts(edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """atom_id, project_id, live: counted from all edges."""
    return _of_atoms(edges, live_turns(chunks, documents))


def document_changes(edges: DataFrame, before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Changes of counts where the live turns of some documents were `before` and are `after` (as live_turns gives them)."""
    signed = [df.select(*TURN, (F.lit(sign) * F.col("n")).alias("n")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    net = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return _of_atoms(edges, net.groupBy(*TURN).agg(F.sum("n").alias("n")).where("n <> 0"))


def edge_changes(added: DataFrame | None, removed: DataFrame | None, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Changes of counts where edges come and go; documents stay as they are."""
    signed = [df.select("atom_id", "turn_id", F.lit(sign).alias("sign")) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    moved = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    own = chunks.join(moved.select("turn_id").distinct(), "turn_id", "left_semi")
    return _of_atoms(moved, live_turns(own, documents), F.col("sign") * F.col("n"))


def changed_counts(counts: DataFrame, *changes: DataFrame) -> DataFrame:
    """Counts with the changes in them."""
    out = counts.select(*ATOM, "live")
    for change in changes:
        out = out.unionByName(change.select(*ATOM, "live"))
    # dealt anew, so that no task sums up the counts and all their changes at once
    out = out.repartition(parts_of(out), *ATOM).groupBy(*ATOM).agg(F.sum("live").alias("live")).where("live <> 0")
    low = F.raise_error(F.concat(F.lit("fewer than no live sources of atom "), F.col("atom_id").cast("string"))).cast("long")
    return out.withColumn("live", F.when(F.col("live") > 0, F.col("live")).otherwise(low))


def without_sources(candidates: DataFrame, atoms: DataFrame, counts: DataFrame) -> DataFrame:
    """Ids of those candidates (id) that belong to a project and have no live source in it."""
    own = atoms.where("project_id IS NOT NULL").select("id", F.col("project_id").alias("own")).join(candidates.select("id").distinct(), "id", "left_semi")
    live = counts.select(F.col("atom_id").alias("a"), F.col("project_id").alias("p"))
    return own.join(live, (F.col("id") == F.col("a")) & (F.col("own") == F.col("p")), "left_anti").select("id")


def _of_atoms(edges: DataFrame, turns: DataFrame, n=None) -> DataFrame:
    n = F.col("n") if n is None else n
    parts = parts_of(edges)
    met = edges.where("atom_id IS NOT NULL").repartition(parts, "turn_id").join(turns.where("project_id IS NOT NULL").repartition(parts, "turn_id"), "turn_id")
    return met.select(*ATOM, n.alias("n")).repartition(parts, *ATOM).groupBy(*ATOM).agg(F.sum("n").alias("live")).where("live <> 0")
