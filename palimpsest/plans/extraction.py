"""Queries of the path from turns to atoms: what is due, batches, context, validation, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import agent, pending, provenance, validation
from . import model

CATALOG = model.Catalog()
add = CATALOG.add
IDLE, CAP = 240, 20

_UNCOVERED = "(SELECT t.* FROM turns t WHERE NOT EXISTS (SELECT 1 FROM coverage c WHERE c.id = t.id))"
_AFTER = f"SELECT u.* FROM {_UNCOVERED} u LEFT JOIN cursors k ON u.session_id = k.session_id AND u.scope = k.scope WHERE k.session_id IS NULL OR u.created_at > k.cursor_at OR (u.created_at = k.cursor_at AND u.id > k.cursor_id)"


@add(
    "pending_trigger_status",
    f"""SELECT s.session_id, s.scope, STAMP(s.last_turn_at) AS last_turn_text, coalesce(p.n, 0) AS pending, n.session_id IS NOT NULL AS has_new,
    n.session_id IS NOT NULL AND coalesce(p.n, 0) > 0 AND {model.NOW} - s.last_turn_at >= INTERVAL {IDLE} MINUTE AS inactivity,
    n.session_id IS NOT NULL AND coalesce(p.n, 0) >= {CAP} AS volume,
    n.session_id IS NOT NULL AND ((coalesce(p.n, 0) > 0 AND {model.NOW} - s.last_turn_at >= INTERVAL {IDLE} MINUTE) OR coalesce(p.n, 0) >= {CAP}) AS due
    FROM (SELECT session_id, scope, max(created_at) AS last_turn_at FROM turns GROUP BY session_id, scope) s
    LEFT JOIN (SELECT session_id, scope, count(*) AS n FROM {_UNCOVERED} GROUP BY session_id, scope) p ON s.session_id = p.session_id AND s.scope = p.scope
    LEFT JOIN (SELECT DISTINCT session_id, scope FROM ({_AFTER})) n ON s.session_id = n.session_id AND s.scope = n.scope""",
)
def pending_trigger_status(t):
    out = pending.session_status(t("turns"), t("coverage"), t("cursors"), F.expr(model.NOW), IDLE, CAP)
    return out.select("session_id", "scope", model.stamp("last_turn_at").alias("last_turn_text"), "pending", "has_new", "inactivity", "volume", "due")


@add("uncovered_turns_capped", f"SELECT id, session_id, scope, rank FROM (SELECT u.*, row_number() OVER (PARTITION BY session_id, scope ORDER BY created_at, id) AS rank FROM {_UNCOVERED} u) WHERE rank <= 20")
def uncovered_turns_capped(t):
    return pending.extraction_batches(pending.uncovered_turns(t("turns"), t("coverage"))).select("id", "session_id", "scope", "rank")


@add("new_turns_after_cursor", f"SELECT session_id, scope, count(*) AS n, min(id) AS first_id FROM ({_AFTER}) GROUP BY session_id, scope")
def new_turns_after_cursor(t):
    new = pending.after_cursor(pending.uncovered_turns(t("turns"), t("coverage")), t("cursors"))
    return new.groupBy("session_id", "scope").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_LAST = "TIMESTAMP '2001-08-01 00:00:00'"


@add(
    "synthesis_trigger_by_scope",
    f"""SELECT scope, count(*) AS pending, STAMP(max(created_at)) AS last_text, {_LAST} - max(created_at) >= INTERVAL 15 MINUTE AS inactivity, count(*) >= 50 AS volume, {_LAST} - max(created_at) >= INTERVAL 15 MINUTE OR count(*) >= 50 AS due
    FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM synthesis_coverage s WHERE s.id = a.id) GROUP BY scope""",
)
def synthesis_trigger_by_scope(t):
    out = pending.scope_status(pending.pending_atoms(t("atoms"), t("synthesis_coverage")), F.expr(_LAST))
    return out.select("scope", "pending", model.stamp("last_atom_at").alias("last_text"), "inactivity", "volume", "due")


@add("pending_atoms_capped", "SELECT id, scope, rank FROM (SELECT a.*, row_number() OVER (PARTITION BY scope ORDER BY created_at, id) AS rank FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM synthesis_coverage s WHERE s.id = a.id)) WHERE rank <= 50")
def pending_atoms_capped(t):
    return pending.synthesis_batches(pending.pending_atoms(t("atoms"), t("synthesis_coverage"))).select("id", "scope", "rank")


_ACTIVE = "(SELECT a.* FROM atoms a WHERE NOT coalesce(source_deleted, false) AND NOT EXISTS (SELECT 1 FROM atoms b WHERE b.supersedes = a.id))"


@add("active_atoms", f"SELECT id, scope, category FROM {_ACTIVE}")
def active_atoms(t):
    return provenance.active_atoms(t("atoms")).select("id", "scope", "category")


@add("recent_atoms_context", f"SELECT id, scope, statement, rank FROM (SELECT a.*, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS rank FROM {_ACTIVE} a) WHERE rank <= 100")
def recent_atoms_context(t):
    return pending.recent_atoms(provenance.active_atoms(t("atoms"))).select("id", "scope", "statement", "rank")


@add("recent_scene", "SELECT scope, scene_name FROM (SELECT scope, scene_name, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id DESC) AS rank FROM atoms) WHERE rank = 1")
def recent_scene(t):
    return pending.recent_scene(t("atoms"))


@add("supersession_flags", "SELECT a.id, EXISTS (SELECT 1 FROM atoms b WHERE b.supersedes = a.id AND b.scope = a.scope) AS superseded, e.name AS entity FROM atoms a LEFT JOIN entities e ON a.entity_id = e.id")
def supersession_flags(t):
    return provenance.with_entity(provenance.with_superseded_flag(t("atoms")), t("entities")).select("id", "superseded", "entity")


@add("provenance_one_hop", "SELECT DISTINCT a.id AS record_id, t.id, t.session_id, t.content FROM atoms a JOIN edges e ON e.atom_id = a.id JOIN part_turns t ON t.id = e.turn_id AND t.scope = a.scope")
def provenance_one_hop(t):
    return provenance.atom_turns(t("atoms"), t("edges"), t("part_turns")).select("record_id", "id", "session_id", "content")


@add("provenance_two_hop", "SELECT DISTINCT r.category AS source_table, r.id AS record_id, t.id, t.content FROM l2_rows r JOIN l2_atoms l ON l.category = r.category AND l.row_id = r.id JOIN edges e ON e.atom_id = l.atom_id JOIN part_turns t ON t.id = e.turn_id AND t.scope = r.scope")
def provenance_two_hop(t):
    return provenance.row_turns(t("l2_rows"), t("l2_atoms"), t("edges"), t("part_turns")).select("source_table", "record_id", "id", "content")


@add("rows_of_atoms", "SELECT r.category, r.id FROM l2_rows r WHERE EXISTS (SELECT 1 FROM l2_atoms l JOIN atoms a ON a.id = l.atom_id AND a.source_deleted WHERE l.category = r.category AND l.row_id = r.id)")
def rows_of_atoms(t):
    return provenance.rows_of_atoms(t("l2_rows"), t("l2_atoms"), t("atoms").where("source_deleted")).select("category", "id")


@add(
    "uncovered_project_turns",
    """SELECT t.id, d.project_id, c.chunk_index FROM part_turns t JOIN chunks c ON c.turn_id = t.id AND c.is_active JOIN doc_versions d ON d.id = c.document_id AND d.is_active
    WHERE NOT EXISTS (SELECT 1 FROM coverage k WHERE k.id = t.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.turn_id = t.id AND e.atom_id % 50 = 0)""",
)
def uncovered_project_turns(t):
    return pending.uncovered_project_turns(t("part_turns"), t("chunks"), t("doc_versions"), t("coverage"), t("edges").where("atom_id % 50 = 0")).select("id", "project_id", "chunk_index")


@add("sessions_with_turns", "SELECT DISTINCT session_id, scope FROM part_turns t WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.turn_id = t.id AND c.chunk_index = 2 AND c.document_id % 20 = 0)")
def sessions_with_turns(t):
    return pending.sessions_with_turns(t("part_turns"), t("chunks").where("chunk_index = 2 AND document_id % 20 = 0"))


@add("scopes_pending", "SELECT DISTINCT scope FROM atoms a WHERE project_id IS NULL AND NOT EXISTS (SELECT 1 FROM synthesis_coverage s WHERE s.id = a.id)")
def scopes_pending(t):
    return pending.scopes_pending(pending.pending_atoms(t("atoms"), t("synthesis_coverage")))


@add("projects_pending", "SELECT DISTINCT project_id, scope FROM atoms a WHERE project_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM synthesis_coverage s WHERE s.id = a.id)")
def projects_pending(t):
    return pending.projects_pending(pending.pending_atoms(t("atoms"), t("synthesis_coverage")))


@add(
    "idle_bursts",
    """SELECT session_id, burst, count(*) AS n, min(id) AS first_id FROM (SELECT session_id, id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, scope ORDER BY created_at, id) AS burst
    FROM (SELECT t.*, coalesce(created_at - lag(created_at) OVER (PARTITION BY session_id, scope ORDER BY created_at, id) >= INTERVAL 720 MINUTE, false) AS gap FROM turns t)) GROUP BY session_id, burst""",
)
def idle_bursts(t):
    return pending.idle_sessions(t("turns"), 720).groupBy("session_id", "burst").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@add("turn_validation", "SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'tool') THEN 'source' WHEN trim(text) = '' THEN 'content' END AS problem FROM conversations")
def turn_validation(t):
    c = t("conversations")
    return c.select("conv_id", "turn", validation.turn_problem(F.col("role"), F.lit("s"), F.col("text")).alias("problem"))


_JUDGED = "(SELECT a.id, a.confidence, list(e.turn_id) AS src FROM atoms a JOIN edges e ON e.atom_id = a.id GROUP BY a.id, a.confidence)"


@add("judge_validation", f"SELECT id, CAST(len(list_distinct(src)) AS INTEGER) AS n_sources FROM {_JUDGED} WHERE confidence >= 0.5 AND len(list_filter(src, lambda x: x % 97 = 0)) = 0 AND len(list_distinct(src)) >= 2")
def judge_validation(t):
    atoms, edges = t("atoms").select("id", "confidence"), t("edges")
    sources = edges.groupBy("atom_id").agg(F.collect_list("turn_id").alias("source_turn_ids"))
    judged = atoms.join(sources, F.col("id") == F.col("atom_id")).withColumn("batch_ids", F.filter("source_turn_ids", lambda x: x % 97 != 0))
    return validation.validated_atoms(judged, drop_invalid=True).select("id", F.size(F.array_distinct("source_turn_ids")).alias("n_sources"))


@add("synthesis_validation", "SELECT d.destination_id FROM destinations d LEFT JOIN l2_rows r ON r.category = d.category AND r.id = d.existing_row_id WHERE len(list_filter(d.atom_ids, lambda x: x % 31 = 0)) = 0 AND (d.existing_row_id IS NULL OR r.id IS NOT NULL)")
def synthesis_validation(t):
    d = t("destinations").withColumn("batch_ids", F.filter("atom_ids", lambda x: x % 31 != 0))
    return validation.validated_destinations(d, t("l2_rows"), drop_invalid=True).select("destination_id")


@add("judge_replies", """SELECT event_id, 'first scene' AS scene_name, CAST(0 AS INTEGER) AS position, event_type AS statement, 'fact' AS category, event_id % 10 / 10.0 AS confidence FROM events""")
def judge_replies(t):
    reply = F.concat(F.lit('[{"scene_name":"first  scene ","atoms":[{"statement":" '), F.col("event_type"), F.lit('","category":"fact","confidence":0.'), (F.col("event_id") % 10).cast("string"), F.lit(',"source_turn_ids":["a","b"]}]}]'))
    e = t("events").select("event_id", reply.alias("reply"))
    return validation.scenes_to_atoms(e, keep=("event_id",)).select("event_id", "scene_name", "position", "statement", "category", "confidence")


@add("original_user_query", "SELECT conv_id, query FROM (SELECT conv_id, trim(text) AS query, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE n = 1")
def original_user_query(t):
    return agent.first_user_message(t("conversations"))


@add("elapsed_minutes", f"SELECT event_id, coalesce({model.NOW} - ts >= INTERVAL 15 MINUTE, false) AS idle FROM events")
def elapsed_minutes(t):
    return t("events").select("event_id", scalars.elapsed(F.expr(model.NOW), F.col("ts"), 15).alias("idle"))


@add("judge_payloads")
def judge_payloads(t):
    return pending.judge_payloads(pending.extraction_batches(pending.uncovered_turns(t("turns"), t("coverage"))))
