"""Upserts and soft deletes as old table + delta -> new table; snapshots are swapped by the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not in old, one of each key; rows with a null in the key never collide."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    order = [c for c in new.columns if c not in keys]
    first = new.where(whole).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    added = first.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
    return added.unionByName(new.where(~whole))


def insert_or_keep(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and those rows of new whose key is not there."""
    return old.unionByName(new_rows(old, new, keys))


def insert_or_update(old: DataFrame, new: DataFrame, keys: list[str], update: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Full outer merge. update maps a column to its value for met rows, from o.<column> and n.<column>; others stay old.

    Of several new rows of a key, the last by `order` counts.
    """
    if order:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where("__n = 1").drop("__n")
    o = old.withColumn("__old", F.lit(True)).alias("o")
    n = new.withColumn("__new", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o.{k}") == F.col(f"n.{k}")
    met = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    cols = []
    for c in old.columns:
        fresh = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        value = (update or {}).get(c, F.col(f"o.{c}"))
        cols.append(F.when(met, value).when(F.col("__old").isNotNull(), F.col(f"o.{c}")).otherwise(fresh).alias(c))
    return o.join(n, on, "full_outer").select(*cols)


def new_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and markers (without nulls) of new that are not in old."""
    return new.select(*old.columns).distinct().join(old, old.columns, "left_anti")


def insert_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and markers: a set."""
    return old.unionByName(new.select(*old.columns)).distinct()


def advance_cursor(cursors: DataFrame, attempts: DataFrame) -> DataFrame:
    """The incoming cursor of a session wins."""
    return insert_or_update(cursors, attempts, ["session_id", "scope"], {"cursor_at": F.col("n.cursor_at"), "cursor_id": F.col("n.cursor_id")}, order=["cursor_at", "cursor_id"])


def document_turns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Turns of document chunks: the id stays, what tells of the source is renewed."""
    renewed = ["source_path", "source_heading", "source_start_line", "source_end_line", "source_hash"]
    return insert_or_update(old, new, ["session_id", "scope", "source_event_id"], {c: F.col(f"n.{c}") for c in renewed if c in old.columns})


def register_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names and aliases are replaced, a null root_path leaves the old one."""
    update = {"name": F.col("n.name"), "aliases": F.col("n.aliases"), "root_path": F.coalesce(F.col("n.root_path"), F.col("o.root_path")), "updated_at": F.col("n.updated_at")}
    return insert_or_update(old, new, ["scope", "normalized_name"], {c: v for c, v in update.items() if c in old.columns}, order=["updated_at"])


def match_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (scope, name) with entity_id: the oldest entity of the scope of that name or alias, any case; null if none."""
    labels = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    known = entities.select(F.col("scope").alias("s"), F.struct("created_at", F.col("id").alias("id")).alias("e"), F.explode(labels).alias("label"))
    oldest = known.groupBy("s", "label").agg(F.min("e").alias("e"))
    met = names.join(oldest, (F.col("scope") == F.col("s")) & (F.lower("name") == F.col("label")), "left")
    return met.select(*names.columns, F.col("e.id").alias("entity_id"))


def fresh_entities(names: DataFrame, entities: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """A new entity for each name (scope, name; by lower case) that matches none."""
    fresh = match_entities(names.select("scope", "name"), entities).where("entity_id IS NULL AND length(trim(name)) > 0").groupBy("scope", F.lower("name").alias("__low")).agg(F.min("name").alias("name"))
    return fresh.select(new_id.alias("id"), "scope", "name", F.array().cast("array<string>").alias("aliases"), now.alias("created_at"))


def insert_entities(names: DataFrame, entities: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """entities, and one for each name that matches none."""
    return entities.unionByName(fresh_entities(names, entities, new_id, now))


def covered_by_sources(coverage: DataFrame, edges: DataFrame) -> DataFrame:
    """Markers (id) of turns that an atom stands on; others are cleaned away."""
    return coverage.join(edges.select(F.col("turn_id").alias("__turn")), F.col("id") == F.col("__turn"), "left_semi")


def asserted(statements: DataFrame, new_id: Column, scene: str, now: Column) -> DataFrame:
    """Atoms that a user states: asserted, with full confidence."""
    return statements.select(new_id.alias("id"), "scope", "statement", "category", F.lit("asserted").alias("origin"), F.lit(scene).alias("scene_name"), F.lit(1.0).cast("float").alias("confidence"), now.alias("created_at"))


def inferred(atoms: DataFrame) -> DataFrame:
    return atoms.withColumn("origin", F.lit("inferred"))


def update_atoms(atoms: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Changes (id, fields) where given; a changed atom is asserted, with full confidence."""
    c = changes.select(F.col("id").alias("__id"), *[F.col(f).alias(f"__{f}") for f in fields])
    met = atoms.join(c, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    out = met.select(
        *[
            F.coalesce(f"__{f}", f).alias(f) if f in fields else F.when(hit, "asserted").otherwise(F.col(f)).alias(f) if f == "origin" else F.when(hit, F.lit(1.0)).otherwise(F.col(f)).cast(atoms.schema[f].dataType).alias(f) if f == "confidence" else F.col(f)
            for f in atoms.columns
        ]
    )
    return out


def forget(atoms: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: source_deleted is set."""
    gone = ids.select(F.col("id").alias("__id")).distinct()
    return atoms.join(gone, F.col("id") == F.col("__id"), "left").withColumn("source_deleted", F.coalesce("source_deleted", F.lit(False)) | F.col("__id").isNotNull()).drop("__id")


def forgotten(atoms: DataFrame, ids: DataFrame) -> DataFrame:
    """id, found: whether there was such an atom to forget."""
    there = atoms.where(~F.coalesce("source_deleted", F.lit(False))).select(F.col("id").alias("__id")).distinct()
    return ids.join(there, F.col("id") == F.col("__id"), "left").select("id", F.col("__id").isNotNull().alias("found"))


def delete_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")


def move_scope(table: DataFrame, source: str, target: str) -> DataFrame:
    return table.withColumn("scope", F.when(F.col("scope") == source, target).otherwise(F.col("scope")))


def moved_rows(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """table, moved: rows that move_scope would change."""
    parts = [t.where(F.col("scope") == source).groupBy().agg(F.count("*").alias("moved")).select(F.lit(n).alias("table"), "moved") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(atoms: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Atoms that lost an edge (removed) and have none left."""
    key = ["atom_id", "turn_id"]
    left = edges.join(removed, key, "left_anti").select(F.col("atom_id").alias("a")).distinct()
    lost = removed.select(F.col("atom_id").alias("l")).distinct()
    return atoms.join(lost, F.col("id") == F.col("l"), "left_semi").join(left, F.col("id") == F.col("a"), "left_anti")
