"""What is due: uncovered turns, pending atoms and trigger status, for all sessions and scopes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import elapsed

SESSION = ["session_id", "scope"]
IDLE_MINUTES, TURN_CAP, ATOM_CAP, RECENT_ATOMS, RECENT_ROWS = 15, 20, 50, 100, 1000


def not_in(df: DataFrame, done: DataFrame, key: str = "id", done_key: str | None = None) -> DataFrame:
    """Rows without a marker."""
    marks = done.select(F.col(done_key or key).alias("__done"))
    return df.join(marks, F.col(key) == F.col("__done"), "left_anti")


def uncovered_turns(turns: DataFrame, coverage: DataFrame, provenance: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Turns that are neither covered, nor a source of an atom, nor a document chunk."""
    open_ = not_in(turns, coverage)
    if provenance is not None:
        open_ = not_in(open_, provenance, "id", "turn_id")
    return open_ if chunks is None else not_in(open_, chunks, "id", "turn_id")


def uncovered_project_turns(turns: DataFrame, chunks: DataFrame, documents: DataFrame, coverage: DataFrame, provenance: DataFrame) -> DataFrame:
    """Turns of active chunks of active documents, with their project, that are neither covered nor a source."""
    live = chunks.where("is_active").join(documents.where("is_active").select(F.col("id").alias("document_id"), "project_id"), "document_id").select("turn_id", "project_id", "chunk_index")
    met = turns.join(live, turns["id"] == live["turn_id"])
    return not_in(not_in(met.drop("turn_id"), coverage), provenance, "id", "turn_id")


def projects_with_open_turns(open_turns: DataFrame) -> DataFrame:
    """Projects whose documents have turns to be extracted."""
    return open_turns.select("project_id", "scope").distinct()


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each key, with their rank; Spark prunes each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def extraction_batches(uncovered: DataFrame, cap: int = TURN_CAP) -> DataFrame:
    return first_n(uncovered, SESSION, ["created_at", "id"], cap)


def pending_atoms(atoms: DataFrame, coverage: DataFrame) -> DataFrame:
    return not_in(atoms, coverage)


def synthesis_batches(pending: DataFrame, keys: list[str] = ["scope"], cap: int = ATOM_CAP) -> DataFrame:  # noqa: B006
    return first_n(pending, keys, ["created_at", "id"], cap)


def recent_atoms(active: DataFrame, n: int = RECENT_ATOMS) -> DataFrame:
    return first_n(active, ["scope"], [F.desc("created_at"), F.desc("id")], n)


def recent_scene(atoms: DataFrame) -> DataFrame:
    """Scene of the newest atom of each scope."""
    return atoms.groupBy("scope").agg(F.max_by("scene_name", F.struct("created_at", "id")).alias("scene_name"))


def _beyond_cursor(turns: DataFrame, cursors: DataFrame) -> DataFrame:
    """turns with is_new: beyond the cursor of the session, or of a session without one."""
    at = cursors.select(*[F.col(k).alias(f"c_{k}") for k in SESSION], "cursor_at", "cursor_id")
    met = turns.join(at, (F.col("session_id") == F.col("c_session_id")) & (F.col("scope") == F.col("c_scope")), "left")
    beyond = F.struct(F.col("created_at").alias("t"), F.col("id").alias("i")) > F.struct(F.col("cursor_at").alias("t"), F.col("cursor_id").alias("i"))
    return met.withColumn("is_new", F.col("c_session_id").isNull() | beyond).drop("c_session_id", "c_scope", "cursor_at", "cursor_id")


def after_cursor(turns: DataFrame, cursors: DataFrame) -> DataFrame:
    """Turns beyond their session's cursor, all where there is none."""
    return _beyond_cursor(turns, cursors).where("is_new").drop("is_new")


def session_status(turns: DataFrame, covered: DataFrame, cursors: DataFrame, now: Column, minutes: int = IDLE_MINUTES, cap: int = TURN_CAP) -> DataFrame:
    """Trigger status of every session: inactivity and volume, each only where there are new turns.

    covered has the ids of turns that are done. Turns are read once: marked by two
    left joins, then aggregated by session.
    """
    marks = covered.select(F.col("id").alias("done_id")).distinct()
    marked = _beyond_cursor(turns.join(marks, F.col("id") == F.col("done_id"), "left"), cursors)
    open_ = F.col("done_id").isNull()
    out = marked.groupBy(*SESSION).agg(F.max("created_at").alias("last_turn_at"), F.count_if(open_).alias("pending"), F.coalesce(F.bool_or(open_ & F.col("is_new")), F.lit(False)).alias("has_new"))
    inactivity = F.col("has_new") & (F.col("pending") > 0) & elapsed(now, F.col("last_turn_at"), minutes)
    volume = F.col("has_new") & (F.col("pending") >= cap)
    return out.withColumn("inactivity", inactivity).withColumn("volume", volume).withColumn("due", inactivity | volume)


def _state_key() -> Column:
    return F.concat_ws("\u0001", *SESSION).alias("key")


def counted_state(turns: DataFrame, covered: DataFrame, cursors: DataFrame) -> DataFrame:
    """The state of every session (as in schemas.SESSION_STATE), from all turns."""
    status = session_status(turns, covered, cursors, F.current_timestamp())
    at = cursors.groupBy(*SESSION).agg(F.max(F.struct("cursor_at", "cursor_id")).alias("c"))
    return status.join(at, SESSION, "left").select(_state_key(), *SESSION, "pending", "last_turn_at", F.col("has_new"), F.col("c.cursor_at").alias("cursor_at"), F.col("c.cursor_id").alias("cursor_id"))


def state_keys(rows: DataFrame) -> DataFrame:
    return rows.select(_state_key()).distinct()


def state_after_turns(state: DataFrame, turns: DataFrame) -> DataFrame:
    """The states of the sessions that turns are new in; state: theirs before, where there was one."""
    old = state.select("key", F.col("pending").alias("p"), F.col("last_turn_at").alias("l"), F.col("has_new").alias("h"), "cursor_at", "cursor_id")
    met = turns.select(_state_key(), *SESSION, "id", "created_at").join(old, "key", "left")
    beyond = F.col("cursor_at").isNull() | (F.struct(F.col("created_at").alias("t"), F.col("id").alias("i")) > F.struct(F.col("cursor_at").alias("t"), F.col("cursor_id").alias("i")))
    grown = met.groupBy("key", *SESSION).agg(F.count("*").alias("n"), F.max("created_at").alias("last"), F.bool_or(beyond).alias("new"), F.first("p").alias("p"), F.first("l").alias("l"), F.first("h").alias("h"), F.first("cursor_at").alias("cursor_at"), F.first("cursor_id").alias("cursor_id"))
    return grown.select("key", *SESSION, (F.coalesce("p", F.lit(0)) + F.col("n")).alias("pending"), F.greatest("last", "l").alias("last_turn_at"), (F.col("new") | F.coalesce("h", F.lit(False))).alias("has_new"), "cursor_at", "cursor_id")


def state_after_batch(state: DataFrame, batch: DataFrame, covered: DataFrame) -> DataFrame:
    """The states of the sessions that had a batch (id, session, created_at) of their first open turns; covered: ids of the turns that are done now.

    What was open and isn't in the batch comes after it, so it is new.
    """
    done = covered.select(F.col("id").alias("done")).distinct()
    had = batch.join(done, F.col("id") == F.col("done"), "left").groupBy(_state_key()).agg(F.count("*").alias("n"), F.count("done").alias("m"), F.max(F.struct("created_at", "id")).alias("c"))
    met = state.join(had, "key")
    return met.select("key", *SESSION, (F.col("pending") - F.col("m")).alias("pending"), "last_turn_at", (F.col("pending") > F.col("n")).alias("has_new"), F.col("c.created_at").alias("cursor_at"), F.col("c.id").alias("cursor_id"))


def state_status(state: DataFrame, now: Column, minutes: int = IDLE_MINUTES, cap: int = TURN_CAP) -> DataFrame:
    """Trigger status of every session, as session_status tells it, from the states."""
    inactivity = F.col("has_new") & (F.col("pending") > 0) & elapsed(now, F.col("last_turn_at"), minutes)
    volume = F.col("has_new") & (F.col("pending") >= cap)
    return state.select(*SESSION, "last_turn_at", "pending", "has_new").withColumn("inactivity", inactivity).withColumn("volume", volume).withColumn("due", inactivity | volume)


def scope_status(pending: DataFrame, now: Column, minutes: int = IDLE_MINUTES, cap: int = ATOM_CAP) -> DataFrame:
    """Synthesis trigger of every scope with pending atoms."""
    out = pending.groupBy("scope").agg(F.count("*").alias("pending"), F.max("created_at").alias("last_atom_at"))
    inactivity, volume = elapsed(now, F.col("last_atom_at"), minutes), F.col("pending") >= cap
    return out.withColumn("inactivity", inactivity).withColumn("volume", volume).withColumn("due", inactivity | volume)


def idle_sessions(turns: DataFrame, minutes: int = IDLE_MINUTES) -> DataFrame:
    """Turns with the number of their burst: a gap of `minutes` or more starts a new one."""
    w = Window.partitionBy(*SESSION).orderBy("created_at", "id")
    gap = elapsed(F.col("created_at"), F.lag("created_at").over(w), minutes)
    return turns.withColumn("burst", F.sum(gap.cast("int")).over(w))


def sessions_with_turns(turns: DataFrame, chunks: DataFrame) -> DataFrame:
    return not_in(turns, chunks, "id", "turn_id").select(*SESSION).distinct()


def scopes_pending(pending: DataFrame) -> DataFrame:
    return pending.where("project_id IS NULL").select("scope").distinct()


def projects_pending(pending: DataFrame) -> DataFrame:
    return pending.where("project_id IS NOT NULL").select("project_id", "scope").distinct()


_TURN = ["id", "source", "content", "tool_name", "tool_call_id", "created_at"]
_PROVENANCE = ["source_path", "source_heading", "source_start_line", "source_end_line", "source_hash"]


def turns_json(batches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, new_turns: the turns of each batch as JSON, oldest first; fields of provenance only where they are set."""
    fixed = F.to_json(F.struct(*[F.col(c) if c in batches.columns else F.lit(None).cast("string").alias(c) for c in _TURN]), {"ignoreNullFields": "false"})
    there = [c for c in _PROVENANCE if c in batches.columns]
    more = F.to_json(F.struct(*there)) if there else F.lit("{}")
    one = F.when(F.length(more) > 2, F.concat(F.substr(fixed, F.lit(1), F.length(fixed) - 1), F.lit(","), F.substr(more, F.lit(2)))).otherwise(fixed)
    packed = batches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", one.alias("turn")))).alias("turns"))
    return packed.select(*keys, F.concat(F.lit("["), F.array_join(F.transform("turns", lambda t: t["turn"]), ","), F.lit("]")).alias("new_turns"))


def extraction_payloads(batches: DataFrame, atoms: DataFrame, entities: DataFrame, keys: list[str] = SESSION, project: bool = False, n: int = RECENT_ATOMS) -> DataFrame:
    """keys, scope, payload: what a judge of each batch is given: turns, the newest scene and atoms of the scope (and project), entities of the scope."""
    own = ["scope", "project_id"] if project else ["scope"]
    known = atoms.where(F.col("project_id").isNotNull() if project else F.col("project_id").isNull())
    recent = first_n(known, own, [F.desc("created_at"), F.desc("id")], n)
    listed = recent.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "statement", "category", "scene_name", "entity_id", "predicate", "confidence", "supersedes"))).alias("recent_atoms"))
    listed = listed.withColumn("recent_scene", F.col("recent_atoms")[0]["scene_name"]).withColumn("recent_atoms", F.transform("recent_atoms", lambda a: a.dropFields("rank")))
    names = entities.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("name", "id", "aliases"))).alias("known_entities"))
    met = turns_json(batches, list(dict.fromkeys([*keys, *own]))).join(listed, own, "left").join(names, "scope", "left")
    empty = lambda c, of: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
    of_project = F.col("project_id") if project else F.lit(None).cast("string")
    context = F.struct("recent_scene", empty("recent_atoms", listed), empty("known_entities", names), of_project.alias("project_id"), F.lit(project).alias("document_mode"))
    rest = F.substr(F.to_json(context, {"ignoreNullFields": "false"}), F.lit(2))
    return met.select(*dict.fromkeys([*keys, *own]), F.concat(F.lit('{"new_turns":'), "new_turns", F.lit(","), rest).alias("payload"))


def synthesis_payloads(batches: DataFrame, rows: DataFrame, entities: DataFrame, categories: list[str], keys: list[str] = ["scope"]) -> DataFrame:  # noqa: B006
    """keys, scope, payload: atoms of each batch, their scenes, and of the rows that there are the latest RECENT_ROWS of each category."""
    own = list(dict.fromkeys([*keys, "scope"]))
    named = batches.join(entities.select(F.col("id").alias("__e"), F.col("name").alias("entity")), F.col("entity_id") == F.col("__e"), "left")
    atom = F.struct("rank", "id", "statement", "category", "scene_name", "entity", "predicate", "confidence")
    packed = named.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(atom)), lambda a: a.dropFields("rank")).alias("new_atoms"), F.array_sort(F.collect_set("scene_name")).alias("scene_names"))
    newest = first_n(rows.where(F.col("category").isin(categories)), [*own, "category"], [F.desc("updated_at"), "id"], RECENT_ROWS)
    there = newest.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("category", "rank", "id", "title", "summary"))), lambda r: r.dropFields("rank")).alias("existing_rows"))
    met = packed.join(there, own, "left").withColumn("existing_rows", F.coalesce("existing_rows", F.array().cast(there.schema["existing_rows"].dataType)))
    return met.select(*own, F.to_json(F.struct(*own, "new_atoms", "scene_names", "existing_rows"), {"ignoreNullFields": "false"}).alias("payload"))


def judge_payloads(batches: DataFrame) -> DataFrame:
    """One JSON payload for each session's batch."""
    turn = F.struct("created_at", "id", "source", "content")
    packed = batches.groupBy(*SESSION).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return packed.select(*SESSION, F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["source"].alias("source"), t["content"].alias("content"))).alias("new_turns"))).alias("payload"))
