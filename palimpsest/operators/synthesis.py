"""Summary rows: confidence gates, matching, upserts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas

NOTE = "Proposed, not yet applied:"


def proposed_notes(destinations: DataFrame, atoms: DataFrame, gate: float = schemas.CONFIDENCE_GATE) -> DataFrame:
    """destination_id, note (null without low atoms), any_high, in the order of atom_ids. Null confidence counts as 0."""
    cited = destinations.select("destination_id", F.posexplode("atom_ids").alias("pos", "cited"))
    met = cited.join(atoms.select(F.col("id").alias("cited"), "statement", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c")), "cited")
    # compared as FLOAT's own decimal: 0.8 stored as FLOAT is not below 0.8
    high = F.round("c", 6) >= gate
    low = F.sort_array(F.collect_list(F.when(~high, F.struct("pos", "statement"))))
    packed = met.groupBy("destination_id").agg(low.alias("low"), F.max(high).alias("any_high"))
    lines = F.array_join(F.transform("low", lambda x: F.concat(F.lit("- "), x["statement"])), "\n")
    return packed.select("destination_id", F.when(F.size("low") > 0, F.concat(F.lit(NOTE + "\n"), lines)).alias("note"), "any_high")


def matched_rows(destinations: DataFrame, rows: DataFrame, by: list[str] = ["category", "scope"]) -> DataFrame:  # noqa: B006
    """destinations with row_id and settled: the row named, else the latest of the same title (any case)."""
    own = rows.select(*[F.col(b).alias(f"r_{b}") for b in by], F.col("id").alias("r_id"), F.col("title").alias("r_title"), F.col("summary").alias("r_summary"), F.col("updated_at").alias("r_updated"))
    same = F.lit(True)
    for b in by:
        same &= F.col(b) == F.col(f"r_{b}")
    named = destinations.where("existing_row_id IS NOT NULL").join(own, same & (F.col("existing_row_id") == F.col("r_id")), "left")
    # one row of each title is kept before destinations meet them: many rows may share a title
    label = F.lower("r_title")
    latest = F.row_number().over(Window.partitionBy(*[f"r_{b}" for b in by], label).orderBy(F.desc("r_updated"), "r_id"))
    newest = own.where(label.isNotNull()).withColumn("__n", latest).where("__n = 1").drop("__n")
    titled = destinations.where("existing_row_id IS NULL").join(newest, same & (F.lower("title") == label), "left")
    out = named.unionByName(titled)
    return out.withColumn("row_id", F.col("r_id")).withColumn("settled", F.col("r_summary")).select(*destinations.columns, "row_id", "settled")


def _with_note(settled: Column, note: Column) -> Column:
    trimmed = F.regexp_replace(settled, r"(?U)\s+$", "")
    return F.when(F.length(settled) > 0, F.concat(trimmed, F.lit("\n\n"), note)).otherwise(note)


def gated_summaries(destinations: DataFrame, atoms: DataFrame, rows: DataFrame, project: bool = False, by: list[str] = ["category", "scope"]) -> DataFrame:  # noqa: B006
    """destination_id, row_id, summary. Low-confidence statements become a note below settled text.

    The new summary settles if an atom of high confidence is cited; for project
    sections it never does beside a low one.
    """
    met = matched_rows(destinations, rows, by).join(proposed_notes(destinations, atoms), "destination_id", "left")
    settled = F.col("settled") if project else F.when(F.col("any_high"), F.col("summary")).otherwise(F.col("settled"))
    gated = F.when(F.col("note").isNull(), F.col("summary")).otherwise(_with_note(settled, F.col("note")))
    return met.select("destination_id", "row_id", gated.alias("summary"))


def upsert_rows(rows: DataFrame, destinations: DataFrame, now: Column, new_id: Column) -> DataFrame:
    """rows after destinations (category, scope, title, summary, owner, deadline, status, row_id or null).

    Owner and deadline of tasks are overwritten, by null too; status stays where
    none is given, and is 'todo' in new tasks.
    """
    task = F.col("category") == "tasks"
    latest = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("destination_id")))
    changes = destinations.where("row_id IS NOT NULL").withColumn("__n", latest).where("__n = 1")
    c = changes.select(F.col("category").alias("c_category"), F.col("row_id").alias("c_id"), *[F.col(x).alias(f"c_{x}") for x in ("title", "summary", "owner", "deadline", "status")])
    met = rows.join(c, (F.col("category") == F.col("c_category")) & (F.col("id") == F.col("c_id")), "left")
    hit = F.col("c_id").isNotNull()
    new = {
        "title": F.when(hit, F.col("c_title")).otherwise(F.col("title")),
        "summary": F.when(hit, F.col("c_summary")).otherwise(F.col("summary")),
        "owner": F.when(hit & task, F.col("c_owner")).otherwise(F.col("owner")),
        "deadline": F.when(hit & task, F.col("c_deadline")).otherwise(F.col("deadline")),
        "status": F.when(hit & task, F.coalesce("c_status", "status")).otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    kept = met.select(*[new.get(x, F.col(x)).alias(x) for x in rows.columns])
    fresh = destinations.where("row_id IS NULL").withColumn("id", new_id).withColumn("status", F.when(task, F.coalesce("status", F.lit("todo"))))
    fresh = fresh.withColumn("updated_at", now).withColumn("created_at", now)
    lack = [x for x in rows.columns if x not in fresh.columns]
    return kept.unionByName(fresh.select(*[F.lit(None).cast(rows.schema[x].dataType).alias(x) if x in lack else F.col(x) for x in rows.columns]))


def link_atoms(destinations: DataFrame) -> DataFrame:
    """(category, row_id, atom_id) edges."""
    return destinations.select("category", "row_id", F.explode("atom_ids").alias("atom_id")).distinct()


def scene_names(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("scope").agg(F.array_sort(F.collect_set("scene_name")).alias("scene_names"))


def category_counts(rows: DataFrame) -> DataFrame:
    """category, n for every summary category, zeros too."""
    names = rows.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{c}'" for c in schemas.L2_CATEGORIES) + ")) AS category")
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    return names.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def existing_rows(rows: DataFrame) -> DataFrame:
    """scope, category, rows (id, title, summary), latest first."""
    item = F.struct("updated_at", "id", "title", "summary")
    packed = rows.groupBy("scope", "category").agg(F.collect_list(item).alias("r"))
    newest = F.array_sort("r", lambda x, y: F.when(x["updated_at"] > y["updated_at"], -1).when(x["updated_at"] < y["updated_at"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0))
    return packed.select("scope", "category", F.transform(newest, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["summary"].alias("summary"))).alias("rows"))
