"""Queries of upkeep: upserts, deletes, versions, summaries, quality gates, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import agent, liveness, mutations, quality_gate, synthesis, versioning
from . import model

CATALOG = model.Catalog()
add = CATALOG.add


@add("turn_upsert", """SELECT session_id, scope, source_event_id, count(*) AS n, min(content) AS content FROM (
    SELECT user_id AS session_id, 's' AS scope, CASE WHEN event_id % 9 <> 0 THEN concat('e', CAST(event_id % 400 AS STRING)) END AS source_event_id, concat('old', CAST(event_id AS STRING)) AS content, event_id FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT * FROM (SELECT DISTINCT ON (session_id, scope, source_event_id) * FROM (SELECT user_id AS session_id, 's' AS scope, concat('e', CAST(event_id % 400 AS STRING)) AS source_event_id, concat('new', CAST(event_id AS STRING)) AS content, event_id FROM events WHERE event_id % 9 <> 0) ORDER BY session_id, scope, source_event_id, content, event_id) n
      WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 10 = 0 AND o.event_id % 9 <> 0 AND o.user_id = n.session_id AND concat('e', CAST(o.event_id % 400 AS STRING)) = n.source_event_id)
    UNION ALL SELECT user_id, 's', NULL, concat('new', CAST(event_id AS STRING)), event_id FROM events WHERE event_id % 9 = 0) GROUP BY ALL""")
def turn_upsert(t):
    e = t("events")
    key = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("e"), (F.col("event_id") % 400).cast("string")))
    rows = lambda tag, df: df.select(F.col("user_id").alias("session_id"), F.lit("s").alias("scope"), key.alias("source_event_id"), F.concat(F.lit(tag), F.col("event_id").cast("string")).alias("content"), "event_id")
    merged = mutations.insert_or_keep(rows("old", e.where("event_id % 10 = 0")), rows("new", e), ["session_id", "scope", "source_event_id"])
    return merged.groupBy("session_id", "scope", "source_event_id").agg(F.count("*").alias("n"), F.min("content").alias("content"))


@add("cursor_advance", f"""SELECT session_id, scope, coalesce(n.id, k.cursor_id) AS cursor_id, STAMP(coalesce(n.at, k.cursor_at)) AS cursor_text FROM cursors k
    FULL JOIN (SELECT session_id, scope, max(created_at) AS at, arg_max(id, created_at) AS id FROM turns WHERE session_id % 2 = 0 GROUP BY session_id, scope) n USING (session_id, scope)""")
def cursor_advance(t):
    last = t("turns").where("session_id % 2 = 0").groupBy("session_id", "scope").agg(F.max("created_at").alias("cursor_at"), F.max_by("id", "created_at").alias("cursor_id"))
    return mutations.advance_cursor(t("cursors"), last).select("session_id", "scope", "cursor_id", model.stamp("cursor_at").alias("cursor_text"))


@add("coalesce_update", """SELECT a.id, coalesce(c.statement, a.statement) AS statement, CASE WHEN c.id IS NULL THEN a.origin ELSE 'asserted' END AS origin, round(CAST(CASE WHEN c.id IS NULL THEN a.confidence ELSE 1.0 END AS DOUBLE), 4) AS confidence
    FROM atoms a LEFT JOIN (SELECT c_custkey * 2 AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS statement FROM customer) c ON c.id = a.id""")
def coalesce_update(t):
    changes = t("customer").select((F.col("c_custkey") * 2).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("statement"))
    out = mutations.update_atoms(t("atoms"), changes, ["statement"])
    return out.select("id", "statement", "origin", F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@add("forget_atoms", "SELECT c_custkey AS id, a.id IS NOT NULL AS found FROM customer c LEFT JOIN atoms a ON a.id = c.c_custkey AND NOT a.source_deleted WHERE c_custkey % 3 = 0")
def forget_atoms(t):
    return mutations.forgotten(t("atoms"), t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")))


@add("atoms_after_forget", "SELECT id, source_deleted OR (id % 3 = 0 AND id IN (SELECT c_custkey FROM customer)) AS source_deleted FROM atoms")
def atoms_after_forget(t):
    return mutations.forget(t("atoms"), t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))).select("id", "source_deleted")


@add("index_delete", "SELECT id, source_table FROM points p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id AND l.quality = 0)")
def index_delete(t):
    return mutations.delete_points(t("points"), t("labels").where("quality = 0").select(F.col("doc_id").alias("id"))).select("id", "source_table")


@add("scope_migration", "SELECT CASE WHEN scope = 'scope1' THEN 'scope9' ELSE scope END AS scope, count(*) AS n FROM atoms GROUP BY 1")
def scope_migration(t):
    return mutations.move_scope(t("atoms"), "scope1", "scope9").groupBy("scope").agg(F.count("*").alias("n"))


@add("scope_migration_counts", "SELECT 'atoms' AS \"table\", count(*) AS moved FROM atoms WHERE scope = 'scope1' UNION ALL SELECT 'l2_rows', count(*) FROM l2_rows WHERE scope = 'scope1' UNION ALL SELECT 'turns', count(*) FROM turns WHERE scope = 'scope1'")
def scope_migration_counts(t):
    return mutations.moved_rows({n: t(n) for n in ("atoms", "l2_rows", "turns")}, "scope1")


@add("orphan_atoms", "SELECT a.id FROM atoms a WHERE EXISTS (SELECT 1 FROM edges e WHERE e.atom_id = a.id AND e.turn_id % 3 <> 0) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.atom_id = a.id AND e.turn_id % 3 = 0)")
def orphan_atoms(t):
    return mutations.orphans(t("atoms"), t("edges"), t("edges").where("turn_id % 3 <> 0")).select("id")


@add("entity_match", f"""WITH n AS (SELECT c_custkey AS key, {model.scope('c_custkey')} AS scope, CASE c_custkey % 3 WHEN 0 THEN upper(concat('maker ', CAST(c_custkey % 37 AS STRING))) WHEN 1 THEN concat('s', CAST(c_custkey % 150 AS STRING)) ELSE concat('Supplier#', lpad(CAST(c_custkey % 90 AS STRING), 9, '0')) END AS name FROM customer),
    l AS (SELECT id, scope, created_at, unnest(list_distinct(list_transform(list_concat([name], aliases), lambda x: lower(x)))) AS label FROM entities)
    SELECT key, (SELECT l.id FROM l WHERE l.scope = n.scope AND l.label = lower(n.name) ORDER BY created_at, l.id LIMIT 1) AS entity_id FROM n""")
def entity_match(t):
    k = F.col("c_custkey")
    s = lambda m: (k % m).cast("string")
    name = F.when(k % 3 == 0, F.upper(F.concat(F.lit("maker "), s(37)))).when(k % 3 == 1, F.concat(F.lit("s"), s(150))).otherwise(F.concat(F.lit("Supplier#"), F.lpad(s(90), 9, "0")))
    names = t("customer").select(k.alias("key"), F.concat(F.lit("scope"), s(5)).alias("scope"), name.alias("name"))
    return mutations.match_entities(names, t("entities")).select("key", "entity_id")


@add("project_registration", """SELECT coalesce(n.norm, o.norm) AS normalized_name, CASE WHEN n.norm IS NULL THEN o.root ELSE coalesce(n.root, o.root) END AS root_path FROM
    (SELECT lower(s_name) AS norm, concat('/old/', s_name) AS root FROM supplier WHERE s_suppkey % 2 = 0) o FULL JOIN (SELECT lower(s_name) AS norm, CASE WHEN s_suppkey % 5 = 0 THEN concat('/new/', s_name) END AS root FROM supplier WHERE s_suppkey % 3 = 0) n ON o.norm = n.norm""")
def project_registration(t):
    s = t("supplier")

    def table(where, root):
        return s.where(where).select(F.lit("a").alias("scope"), text.project_name(F.col("s_name")).alias("normalized_name"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"), root.alias("root_path"), F.lit(1).alias("updated_at"))

    old = table("s_suppkey % 2 = 0", F.concat(F.lit("/old/"), "s_name"))
    new = table("s_suppkey % 3 = 0", F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("/new/"), "s_name")))
    return mutations.register_projects(old, new).select("normalized_name", "root_path")


_STATUS = "CASE WHEN o.relative_path IS NULL THEN 'new' WHEN f.relative_path IS NULL THEN 'deleted' WHEN o.content_hash = f.content_hash THEN 'unchanged' ELSE 'changed' END"
_DIFF = f"(SELECT project_id, relative_path, {_STATUS} AS status, o.content_hash AS old_hash, f.content_hash AS new_hash FROM (SELECT * FROM doc_versions WHERE is_active) o FULL JOIN doc_files f USING (project_id, relative_path))"


def _diff(t):
    return versioning.version_diff(t("doc_versions").where("is_active"), t("doc_files"))


@add("document_version_diff", f"SELECT * FROM {_DIFF}")
def document_version_diff(t):
    return _diff(t)


@add("import_counts", f"SELECT project_id, count(*) FILTER (status IN ('new', 'changed')) AS imported, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM {_DIFF} GROUP BY project_id")
def import_counts(t):
    return versioning.import_counts(_diff(t))


@add("documents_after_import", f"""SELECT relative_path, content_hash, is_active, count(*) AS n FROM (
    SELECT v.relative_path, v.content_hash, CASE WHEN f.content_hash IS NOT NULL THEN v.content_hash = f.content_hash WHEN d.status = 'deleted' THEN false ELSE v.is_active END AS is_active FROM doc_versions v LEFT JOIN doc_files f USING (project_id, relative_path) LEFT JOIN {_DIFF} d USING (project_id, relative_path)
    UNION ALL SELECT relative_path, content_hash, true FROM doc_files f WHERE NOT EXISTS (SELECT 1 FROM doc_versions v WHERE v.project_id = f.project_id AND v.relative_path = f.relative_path AND v.content_hash = f.content_hash)) GROUP BY ALL""")
def documents_after_import(t):
    documents = t("doc_versions").withColumn("id", F.col("id").cast("string"))
    return versioning.next_documents(documents, _diff(t)).groupBy("relative_path", "content_hash", "is_active").agg(F.count("*").alias("n"))


_LIVE = "(SELECT DISTINCT e.atom_id, d.project_id FROM edges e JOIN chunks c ON c.turn_id = e.turn_id AND c.is_active JOIN doc_versions d ON d.id = c.document_id AND d.is_active WHERE d.relative_path NOT IN (SELECT relative_path FROM doc_versions WHERE id % 40 = 7))"


def _cascade(t):
    documents = t("doc_versions")
    gone = documents.where("id % 40 = 7").select("project_id", "relative_path").distinct()
    return versioning.deactivation_cascade(gone, documents, t("chunks"), t("edges"), t("atoms"), t("l2_atoms"))


_PATHS = "(SELECT DISTINCT relative_path FROM doc_versions WHERE id % 40 = 7)"
_HIT = f"(SELECT DISTINCT e.atom_id FROM edges e JOIN chunks c ON c.turn_id = e.turn_id JOIN doc_versions d ON d.id = c.document_id JOIN atoms a ON a.id = e.atom_id WHERE d.relative_path IN {_PATHS} AND a.project_id = d.project_id)"
_STALE = f"(SELECT h.atom_id AS id FROM {_HIT} h JOIN atoms a ON a.id = h.atom_id WHERE NOT EXISTS (SELECT 1 FROM {_LIVE} l WHERE l.atom_id = a.id AND l.project_id = a.project_id))"


@add("stale_atom_cascade", f"SELECT id FROM {_STALE}")
def stale_atom_cascade(t):
    return _cascade(t)["stale"]


_SECTIONS = f"(SELECT DISTINCT row_id FROM l2_atoms WHERE category = 'project_sections' AND atom_id IN (SELECT atom_id FROM {_HIT}))"


_COUNTED = "SELECT e.atom_id, d.project_id, count(*) AS live FROM edges e JOIN chunks c ON c.turn_id = e.turn_id AND c.is_active JOIN doc_versions d ON d.id = c.document_id AND d.is_active"


@add("live_source_counts", f"{_COUNTED} GROUP BY 1, 2")
def live_source_counts(t):
    return liveness.source_counts(t("edges"), t("chunks"), t("doc_versions"))


@add("live_sources_after_edits", f"{_COUNTED} WHERE e.turn_id % 7 <> 3 AND d.relative_path NOT IN {_PATHS} GROUP BY 1, 2")
def live_sources_after_edits(t):
    """Counts from before, with what two edits change: paths are switched off, then edges go."""
    edges, chunks, documents = t("edges"), t("chunks"), t("doc_versions")
    gone = documents.where("id % 40 = 7").select(*versioning.KEY).distinct()
    paths_off = liveness.document_changes(edges, liveness.live_turns(chunks, documents.join(gone, versioning.KEY, "left_semi")), None)
    left = documents.join(gone, versioning.KEY, "left_anti")
    edges_off = liveness.edge_changes(None, edges.where("turn_id % 7 = 3"), chunks, left)
    return liveness.changed_counts(liveness.source_counts(edges, chunks, documents), paths_off, edges_off)


@add("removed_sections", f"SELECT row_id FROM {_SECTIONS}")
def removed_sections(t):
    return _cascade(t)["sections"]


@add("refresh_atoms", f"SELECT DISTINCT l.atom_id AS id FROM l2_atoms l JOIN atoms a ON a.id = l.atom_id WHERE l.category = 'project_sections' AND l.row_id IN (SELECT row_id FROM {_SECTIONS}) AND NOT a.source_deleted AND a.project_id IS NOT NULL AND a.id NOT IN (SELECT id FROM {_STALE})")
def refresh_atoms(t):
    return _cascade(t)["refresh"]


@add("chunks_after_deactivation", f"SELECT c.is_active AND d.id IS NULL AS is_active, count(*) AS n FROM chunks c LEFT JOIN (SELECT id FROM doc_versions WHERE relative_path IN {_PATHS}) d ON d.id = c.document_id GROUP BY 1")
def chunks_after_deactivation(t):
    return _cascade(t)["chunks"].groupBy("is_active").agg(F.count("*").alias("n"))


_MATCH = """matched AS (SELECT d.*, r.id AS row_id, r.summary AS settled FROM destinations d LEFT JOIN l2_rows r ON r.category = d.category AND r.scope = d.scope AND CASE WHEN d.existing_row_id IS NOT NULL THEN r.id = d.existing_row_id
    ELSE r.id = (SELECT x.id FROM l2_rows x WHERE x.category = d.category AND x.scope = d.scope AND lower(x.title) = lower(d.title) ORDER BY updated_at DESC, x.id LIMIT 1) END)"""


@add("title_match_upsert", f"WITH {_MATCH} SELECT destination_id, row_id FROM matched")
def title_match_upsert(t):
    return synthesis.matched_rows(t("destinations"), t("l2_rows")).select("destination_id", "row_id")


_GATED = f"""{_MATCH}, cited AS (SELECT destination_id, unnest(range(1, len(atom_ids) + 1)) AS pos, unnest(atom_ids) AS atom_id FROM destinations),
    notes AS (SELECT destination_id, max(round(CAST(confidence AS DOUBLE), 6) >= 0.8) AS any_high, string_agg(concat('- ', statement), chr(10) ORDER BY pos) FILTER (round(CAST(confidence AS DOUBLE), 6) < 0.8) AS low FROM cited JOIN atoms a ON a.id = atom_id GROUP BY destination_id)"""


def _gate_sql(settled: str) -> str:
    note = "concat('Proposed, not yet applied:', chr(10), low)"
    return f"WITH {_GATED} SELECT destination_id, row_id, CASE WHEN low IS NULL THEN summary WHEN coalesce({settled}, '') = '' THEN {note} ELSE concat(rtrim({settled}), chr(10), chr(10), {note}) END AS summary FROM matched JOIN notes USING (destination_id)"


@add("gated_summary", _gate_sql("(CASE WHEN any_high THEN summary ELSE settled END)"))
def gated_summary(t):
    return synthesis.gated_summaries(t("destinations"), t("atoms"), t("l2_rows"))


@add("gated_section", _gate_sql("settled"))
def gated_section(t):
    return synthesis.gated_summaries(t("destinations"), t("atoms"), t("l2_rows"), project=True)


@add("task_upsert", f"""WITH {_MATCH}, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY destination_id DESC) AS n FROM matched WHERE row_id IS NOT NULL) WHERE n = 1)
    SELECT r.category, r.id, coalesce(ch.title, r.title) AS title, CASE WHEN ch.row_id IS NOT NULL AND r.category = 'tasks' THEN NULL ELSE r.owner END AS owner, CASE WHEN ch.row_id IS NOT NULL AND r.category = 'tasks' AND ch.destination_id % 2 = 0 THEN 'done' ELSE r.status END AS status FROM l2_rows r LEFT JOIN ch ON ch.row_id = r.id AND ch.category = r.category
    UNION ALL SELECT category, -destination_id, title, NULL, CASE WHEN category = 'tasks' THEN CASE WHEN destination_id % 2 = 0 THEN 'done' ELSE 'todo' END END FROM matched WHERE row_id IS NULL""")
def task_upsert(t):
    rows = t("l2_rows")
    d = synthesis.matched_rows(t("destinations"), rows).drop("settled")
    d = d.withColumn("owner", F.lit(None).cast("string")).withColumn("deadline", F.lit(None).cast("long")).withColumn("status", F.when(F.col("destination_id") % 2 == 0, "done"))
    out = synthesis.upsert_rows(rows, d, F.lit(5000).cast("long"), -F.col("destination_id"))
    return out.select("category", "id", "title", "owner", "status")


@add("synthesis_links", "SELECT category, coalesce(existing_row_id, destination_id) AS row_id, count(*) AS n FROM (SELECT category, existing_row_id, destination_id, unnest(atom_ids) FROM destinations) GROUP BY ALL")
def synthesis_links(t):
    d = t("destinations").withColumn("row_id", F.coalesce("existing_row_id", "destination_id"))
    return synthesis.link_atoms(d).groupBy("category", "row_id").agg(F.count("*").alias("n"))


@add("scene_names", "SELECT scope, array_to_string(list_sort(list(DISTINCT scene_name)), '|') AS scenes FROM atoms GROUP BY scope")
def scene_names(t):
    return synthesis.scene_names(t("atoms")).select("scope", F.array_join("scene_names", "|").alias("scenes"))


@add("category_counts", "SELECT category, count(r.id) AS n FROM category_types c LEFT JOIN l2_rows r USING (category) WHERE category <> 'atoms' GROUP BY category")
def category_counts(t):
    return synthesis.category_counts(t("l2_rows"))


@add("existing_rows_context", "SELECT scope, category, array_to_string(list(CAST(id AS VARCHAR) ORDER BY updated_at DESC, id), ',') AS ids FROM l2_rows GROUP BY scope, category")
def existing_rows_context(t):
    return synthesis.existing_rows(t("l2_rows")).select("scope", "category", F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("ids"))


def _records(t):
    bad = F.col("event_id") % (F.col("user_id") % 6 + 1) == 0
    return t("events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("id"), F.when(bad, F.concat(F.lit("n/a "), F.col("event_type"))).otherwise(F.col("value").cast("string")).alias("amount"))


_RECORDS = "(SELECT user_id AS batch_id, event_id AS id, event_type, event_id % (user_id % 6 + 1) = 0 AS bad FROM events)"
_GATE = f"(SELECT batch_id, count(*) AS total, count(*) FILTER (bad) AS invalid, CASE WHEN count(*) FILTER (bad) / count(*) <= CAST(1 AS DOUBLE) - CAST(0.8 AS DOUBLE) THEN 'PASS' WHEN count(*) FILTER (bad) = count(*) THEN 'FATAL' ELSE 'VALIDATION' END AS status, coalesce(string_agg(concat('unparseable amount ''n/a ', event_type, ''''), '; ' ORDER BY id) FILTER (bad), '') AS issues FROM {_RECORDS} GROUP BY batch_id)"


@add("batch_quality_gate", f"SELECT * FROM {_GATE}")
def batch_quality_gate(t):
    return quality_gate.gate(quality_gate.transform(_records(t)))


@add("batch_commit", f"SELECT batch_id, count(*) AS committed FROM {_RECORDS} JOIN {_GATE} USING (batch_id) WHERE status = 'PASS' OR (status = 'VALIDATION' AND batch_id % 2 = 0 AND NOT bad) GROUP BY batch_id")
def batch_commit(t):
    records = quality_gate.transform(_records(t))
    allowed = t("events").where("user_id % 2 = 0").select(F.col("user_id").alias("batch_id")).distinct()
    return quality_gate.commit_counts(quality_gate.committed(records, quality_gate.gate(records), allowed))


@add("recovery_actions", """SELECT event_id, CASE WHEN error IN ('FATAL', 'RESOURCE') THEN 'stop' WHEN (action = 'retry_same' AND (NOT retryable OR error <> 'TRANSIENT')) OR (action IN ('retry_with_correction', 'refresh_and_retry') AND NOT retryable) THEN CASE WHEN error = 'VALIDATION' THEN 'ask_user' ELSE 'stop' END
    WHEN action = 'retry_with_correction' AND event_id % 5 <> 0 THEN 'ask_user' ELSE action END AS action FROM (SELECT event_id, ['retry_same', 'retry_with_correction', 'refresh_and_retry', 'ask_user', 'stop'][1 + event_id % 5] AS action, ['TRANSIENT', 'VALIDATION', 'FATAL', 'RESOURCE'][1 + (event_id // 5) % 4] AS error, (event_id // 20) % 2 = 0 AS retryable FROM events)""")
def recovery_actions(t):
    k = F.col("event_id")
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    action = of(["retry_same", "retry_with_correction", "refresh_and_retry", "ask_user", "stop"], k % 5)
    error = of(["TRANSIENT", "VALIDATION", "FATAL", "RESOURCE"], F.floor(k / 5) % 4)
    return t("events").select("event_id", quality_gate.normalized_action(action, error, F.floor(k / 20) % 2 == 0, k % 5 == 0).alias("action"))


@add("required_fields", "SELECT event_id, CAST((event_type = 'click') AS INTEGER) + CAST(value > 50 AS INTEGER) AS n_missing FROM events")
def required_fields(t):
    e = t("events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"), F.when(~(F.col("value") > 50), F.col("value")).alias("amount"))
    return quality_gate.missing_fields(e, ["kind", "amount"]).select("event_id", F.size("missing").alias("n_missing"))


@add("issue_keys", "SELECT p_partkey, upper(concat('scrum-', CAST(p_partkey AS STRING))) AS issue, upper(concat('ab', CAST(p_size AS STRING), '-', CAST(p_partkey AS STRING))) AS found FROM part")
def issue_keys(t):
    s = lambda c: F.col(c).cast("string")
    return t("part").select("p_partkey", text.issue_key(F.concat(F.lit(" scrum  "), s("p_partkey"))).alias("issue"), text.find_issue_key(F.concat(F.lit("see ab"), s("p_size"), F.lit("-"), s("p_partkey"), F.lit(", then x-y"))).alias("found"))


_RUN_ID = "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING))"
_RUN_KEY = f"concat('{text.EVENT_PREFIX}', {_RUN_ID}, ':"
_ARGS = """CASE conv_id % 5 WHEN 3 THEN 'plain words' WHEN 4 THEN '{}' ELSE concat('{"k": ', CAST(turn AS STRING), ', "q": ["', role, '", null, true]}') END"""


@add("run_events", f"""SELECT {_RUN_ID} AS run_id, 0 AS message, 'assistant' AS source, {_ARGS} AS content, {model.pick('conv_id % 5', ['recall', 'find', 'grep', 'note'])} AS tool_name, CASE WHEN conv_id % 5 < 4 THEN concat('c', CAST(turn AS STRING)) END AS tool_call_id, {_RUN_KEY}message:0:tool:0') AS source_event_id FROM conversations
    UNION ALL SELECT {_RUN_ID}, 1, 'tool', concat('{{"n": ', CAST(turn AS STRING), ', "ok": true}}'), 'recall', CASE WHEN turn % 2 = 0 THEN concat('c', CAST(turn AS STRING)) ELSE {_RUN_KEY}message:1:tool-result') END, {_RUN_KEY}message:1:tool-result') FROM conversations
    UNION ALL SELECT {_RUN_ID}, CASE WHEN role = 'assistant' THEN 2 ELSE -1 END, 'assistant', CASE WHEN role = 'assistant' THEN trim(text) ELSE 'done' END, NULL, NULL, CASE WHEN role = 'assistant' THEN {_RUN_KEY}message:2:content') ELSE {_RUN_KEY}assistant') END FROM conversations WHERE role <> 'assistant' OR trim(text) <> ''
    UNION ALL SELECT {_RUN_ID}, -1, 'assistant', 'done', NULL, NULL, {_RUN_KEY}assistant') FROM conversations WHERE role = 'assistant' AND trim(text) = ''""")
def run_events(t):
    """A run of three messages for each row of conversations, as JSON; its tool call has one of five shapes."""
    shape, call = F.col("conv_id") % 5, F.concat(F.lit("c"), F.col("turn").cast("string"))
    args = F.struct(F.array(F.col("role"), F.lit(None).cast("string"), F.lit("@true")).alias("q"), F.col("turn").alias("k"))
    lit = lambda v, name: F.lit(v).alias(name)
    shapes = [
        F.struct(lit("recall", "tool_name"), call.alias("tool_call_id"), args.alias("tool_args")),
        F.struct(call.alias("id"), F.struct(lit("find", "name"), args.alias("arguments")).alias("function")),
        F.struct(lit("", "tool_name"), call.alias("id"), F.struct(lit("grep", "name"), lit("unread", "arguments")).alias("function"), args.alias("arguments")),
        F.struct(lit("note", "tool_name"), call.alias("tool_call_id"), lit(" plain words ", "tool_args")),
    ]
    told = F.lit('{"tool_args": null, "arguments": {"unread": 1}}')
    for k, s in enumerate(shapes):
        told = F.when(shape == k, F.to_json(s)).otherwise(told)
    told = F.replace(told, F.lit('"@true"'), F.lit("true"))
    result = F.to_json(F.struct(lit("tool", "role"), F.struct(F.lit(True).alias("ok"), F.col("turn").alias("n")).alias("content"), lit("recall", "tool_name"), F.when(F.col("turn") % 2 == 0, call).alias("tool_call_id")))
    last = F.to_json(F.struct("role", F.col("text").alias("content")))
    json = F.concat(F.lit('[{"role": "assistant", "content": null, "tool_calls": ['), told, F.lit("]}, "), result, F.lit(", "), last, F.lit("]"))
    run = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    runs = t("conversations").select(run.alias("run_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("s").alias("scope"), F.lit("done").alias("content"), json.alias("messages"))
    number = F.when(F.col("position.m") < 1 << 30, F.col("position.m")).otherwise(-1)
    return agent.run_events(runs).select("run_id", number.alias("message"), "source", "content", "tool_name", "tool_call_id", "source_event_id")


@add("feedback_phases", """SELECT user_id AS run_id, CASE WHEN d IS NOT NULL THEN d WHEN p THEN 'other_pending' END AS phase FROM (SELECT user_id, arg_min(dec, event_id) FILTER (dec IS NOT NULL) AS d, max(value < 30 AND event_id % 3 = 0) AS p FROM
    (SELECT *, CASE WHEN value > 99.5 THEN 'cancelled' WHEN value > 98 AND event_id % 3 = 1 THEN 'generic_recall' END AS dec FROM events) GROUP BY user_id)""")
def feedback_phases(t):
    v, k = F.col("value"), F.col("event_id") % 3
    option = F.when(v > 99.5, "Cancel").when(v > 98, "Recall memory").when(v < 30, "Other options").otherwise("x")
    header = F.when(k == 0, "Project").when(k == 1, "Other options").otherwise("y")
    return agent.feedback_phase(t("events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), header.alias("header"), option.alias("option")))


@add("embed_chunks")
def embed_chunks(t):
    return t("documents").select("doc_id", F.posexplode(chunking.embedding_chunks(F.col("text"))).alias("chunk_index", "chunk"))


@add("document_chunks")
def document_chunks(t):
    return t("documents").select("doc_id", F.posexplode(chunking.markdown_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


@add("session_uuids")
def session_uuids(t):
    return t("conversations").select("conv_id", text.session_uuid(F.col("conv_id").cast("string")).alias("session")).distinct()
