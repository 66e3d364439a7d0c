"""The index table: points of atoms and summary rows, partitioned by where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.provenance import with_superseded_flag


def atom_points(atoms: DataFrame, all_atoms: DataFrame | None = None) -> DataFrame:
    """Points of atoms; all_atoms: whose supersessions count."""
    a = with_superseded_flag(atoms, all_atoms)
    return a.select("id", "scope", F.lit("atoms").alias("source_table"), F.lit(None).cast("string").alias("title"), F.col("statement").alias("content"), "project_id", "source_deleted", "superseded")


def row_points(rows: DataFrame) -> DataFrame:
    return rows.select("id", "scope", F.col("category").alias("source_table"), "title", F.concat_ws("\n", "title", "summary").alias("content"), "project_id", F.lit(False).alias("source_deleted"), F.lit(False).alias("superseded"))


def with_vectors(points: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """points with the dense vectors of the same id; another length raises."""
    sized = vectors.where(F.assert_true(F.size("dense") == dimensions, f"vectors must have {dimensions} components").isNull())
    return points.join(sized.select("id", "dense"), "id", "left")


def upserted(index: DataFrame, points: DataFrame) -> DataFrame:
    """index with the points given in place of those of the same id."""
    return index.join(points.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti").unionByName(points.select(*index.columns))


def write_index(points: DataFrame, path: str, files: int = 64) -> None:
    """One folder for each source, of at most `files` files: a source may hold nearly all points."""
    points.repartition("source_table", F.pmod(F.xxhash64("id"), F.lit(files))).write.mode("overwrite").partitionBy("source_table").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
