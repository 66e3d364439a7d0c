"""Checks of turns, judge output and synthesis output; rows are parted, never looped over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import UUID, squeeze


def turn_problem(source: Column, scope: Column, content: Column, tool_call_id: Column | None = None) -> Column:
    """First reason to reject a turn, or null."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    tool = F.lit(False) if tool_call_id is None else (source == "tool") & blank(tool_call_id)
    known = F.coalesce(source.isin(schemas.SOURCES), F.lit(False))
    return F.when(~known, "source").when(blank(scope), "scope").when(blank(content), "content").when(tool, "tool_call_id")


def split_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid turns, and rejected ones with their problem."""
    told = turns.withColumn("problem", turn_problem(F.col("source"), F.col("scope"), F.col("content"), F.col("tool_call_id") if "tool_call_id" in turns.columns else None))
    return told.where("problem IS NULL").drop("problem"), told.where("problem IS NOT NULL")


def checked(cond: Column, message: str) -> Column:
    """The condition, raising where it isn't true; for filter()."""
    return F.assert_true(F.coalesce(cond, F.lit(False)), message).isNull()


def require(df: DataFrame, cond: Column, message: str) -> DataFrame:
    return df.where(checked(cond, message))


def read_scope(scope: str | None, all_scopes: bool = False, default: str | None = None) -> str | None:
    """The scope that is read: the one named, any (None), or the default."""
    if scope is not None and not scope.strip():
        raise ValueError("the scope must not be blank")
    if all_scopes and scope is not None:
        raise ValueError("a scope and all scopes exclude each other")
    return None if all_scopes else scope or default


def require_project(projects: DataFrame, project: str | None, scope: str | None = None) -> None:
    """Raise where the project named isn't registered (in the scope)."""
    if project is not None:
        known = projects.where(F.col("id") == project)
        if (known if scope is None else known.where(F.col("scope") == scope)).isEmpty():
            raise KeyError(f"no project {project} in the scope")


SCENE_CHARS, TITLE_CHARS = 120, 240


def _text_of(c: str, most: int) -> Column:
    return F.coalesce(F.length(F.trim(c)).between(1, most), F.lit(False))


def atom_problem() -> Column:
    """First reason to reject a judged atom (scene_name, statement, category, confidence), or null."""
    return (
        F.when(~_text_of("scene_name", SCENE_CHARS), "scene_name").when(~_text_of("statement", 1 << 30), "statement")
        .when(~F.coalesce(F.col("category").isin(schemas.ATOM_CATEGORIES), F.lit(False)), "category").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    )


def destination_problem(categories: list[str]) -> Column:
    """First reason to reject a destination (category, title, summary, atom_ids, status), or null."""
    status = F.col("status").isNull() | F.col("status").isin(schemas.TASK_STATUSES)
    return (
        F.when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "category").when(~_text_of("title", TITLE_CHARS), "title")
        .when(~_text_of("summary", 1 << 30), "summary").when(F.coalesce(F.size("atom_ids"), F.lit(0)) < 1, "atom_ids").when(~status, "status")
    )


def require_uuid(df: DataFrame, column: str) -> DataFrame:
    return require(df, F.col(column).rlike(UUID), f"{column} must be a UUID")


def scenes_to_atoms(replies: DataFrame, reply: str = "reply", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per atom of the judge's JSON replies: scene_name, position and fields of the atom. Malformed JSON raises."""
    parsed = replies.select(*keep, F.explode(F.from_json(reply, schemas.SCENES, {"mode": "FAILFAST"})).alias("scene"))
    atoms = parsed.select(*keep, squeeze(F.col("scene.scene_name")).alias("scene_name"), F.posexplode("scene.atoms").alias("position", "atom"))
    return atoms.select(*keep, "scene_name", "position", "atom.*").withColumn("statement", F.trim("statement"))


def validated_atoms(atoms: DataFrame, corroborate: bool = True, drop_invalid: bool = False, floor: float = schemas.CONFIDENCE_FLOOR) -> DataFrame:
    """Atoms (confidence, source_turn_ids, batch_ids) that the judge's rules let pass.

    Sources beyond the batch raise, or drop the atom. Corroboration asks for two
    distinct sources.
    """
    outside = F.size(F.array_except("source_turn_ids", "batch_ids"))
    atoms = atoms.where(F.col("confidence") >= floor)
    atoms = atoms.where(outside == 0) if drop_invalid else require(atoms, outside == 0, "a source is not in the batch")
    return atoms.where(F.size(F.array_distinct("source_turn_ids")) >= (2 if corroborate else 1))


def validated_destinations(destinations: DataFrame, rows: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """Destinations (category, atom_ids, existing_row_id, batch_ids) whose atoms are in the batch and whose row is in their category."""
    known = rows.select(F.col("category").alias("known_category"), F.col("id").alias("known_id"))
    met = destinations.join(known, (F.col("category") == F.col("known_category")) & (F.col("existing_row_id") == F.col("known_id")), "left")
    inside = F.size(F.array_except("atom_ids", "batch_ids")) == 0
    row_ok = F.col("existing_row_id").isNull() | F.col("known_id").isNotNull()
    met = met.where(inside & row_ok) if drop_invalid else require(require(met, inside, "an atom is not in the batch"), row_ok, "the row is not in the category")
    return met.drop("known_category", "known_id")
