"""The jobs that keep a memory up to date, each for all sessions, scopes or projects at once.

Judges are hooks: a function from a payload (JSON text) to a reply (JSON text). It is
called on the executors, once for each payload, and its replies are kept (sources.ledger)
before anything is read from them. A payload whose judge fails, or whose reply breaks a
rule, is left out of the commit and told of in the run's errors; the others go on,
and it is asked for again with the next run. A job is one commit of all tables that
it touches, the index among them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schemas
from .api import Memory
from .functions.text import uuid5
from .operators import extraction, liveness, mutations, pending, provenance, synthesis, validation, versioning
from .sources import markdown
from .sources.ledger import ReplyLedger

Judge = Callable[[str], str]
logger = logging.getLogger(__name__)
# Marks of the turns that hold chunks of documents.
DOCUMENT_SOURCE, DOCUMENT_TOOL, DOCUMENT_PREFIX = "tool", "project_document", "project-document:"
PROJECT = ["project_id", "scope"]


@dataclass
class Run:
    """How many payloads a phase was asked for and how many were committed, and what went wrong (phase, key, error).

    failed: phases that ended in an exception, and its text. left: whether a drain ended with work open.
    """

    asked: dict[str, int] = field(default_factory=dict)
    done: dict[str, int] = field(default_factory=dict)
    errors: list[DataFrame] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)
    left: bool = False

    @property
    def ran(self) -> bool:
        return any(self.done.values())

    def add(self, other: Run) -> Run:
        for mine, theirs in ((self.asked, other.asked), (self.done, other.done)):
            for phase, n in theirs.items():
                mine[phase] = mine.get(phase, 0) + n
        self.errors += other.errors
        self.failed |= other.failed
        return self


def _parsed(replies: DataFrame, schema: str) -> DataFrame:
    """replies with parsed; a reply that is no such JSON gets an error."""
    out = replies.withColumn("parsed", F.from_json("reply", schema))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("parsed").isNull(), "the reply is not what was asked for"))).drop("reply")


def _faults(rows: DataFrame, keys: list[str], problem: Column) -> DataFrame:
    """keys, fault: the first problem of each reply that has any."""
    return rows.withColumn("p", problem).where("p IS NOT NULL").groupBy(*keys).agg(F.min("p").alias("fault"))


def _with_faults(replies: DataFrame, faults: DataFrame, keys: list[str]) -> DataFrame:
    return replies.join(faults, keys, "left").withColumn("error", F.coalesce("error", "fault")).drop("fault")


class Jobs:
    """ingest, import_documents, extract, synthesize, run_once, drain."""

    def __init__(self, memory: Memory, extraction_judge: Judge | None = None, synthesis_judge: Judge | None = None, project_extraction_judge: Judge | None = None, project_synthesis_judge: Judge | None = None, idle_minutes: int = pending.IDLE_MINUTES, turn_cap: int = pending.TURN_CAP, atom_cap: int = pending.ATOM_CAP):
        if min(idle_minutes, turn_cap, atom_cap) <= 0:
            raise ValueError("minutes and caps must be positive")
        self.memory, self.store = memory, memory.store
        self.judges = {"extraction": extraction_judge, "synthesis": synthesis_judge, "project_extraction": project_extraction_judge or extraction_judge, "project_synthesis": project_synthesis_judge}
        self.idle_minutes, self.turn_cap, self.atom_cap = idle_minutes, turn_cap, atom_cap

    # --- turns and documents

    def ingest(self, turns: DataFrame, now: Column | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
        """Write turns (columns as in schemas.TURNS but for id and created_at; missing ones are null) and return those that were rejected, with their problem.

        A turn whose session, scope and event id are there already is kept as it is.
        """
        valid, rejected = validation.split_turns(turns)
        old = self.store.table("turns")
        event = F.col("source_event_id") if "source_event_id" in valid.columns else F.lit(None).cast("string")
        named = uuid5(F.concat_ws("/", "session_id", "scope", event))
        # a turn with an event id gets the same id whenever it comes
        given = {"id": F.when(event.isNotNull(), named).otherwise(F.expr("uuid()")), "created_at": F.current_timestamp() if now is None else now}
        new = valid.select(*[given.get(c, F.col(c) if c in valid.columns else F.lit(None)).cast(old.schema[c].dataType).alias(c) for c in old.columns])
        fresh = self.store.staged(mutations.new_rows(old, self.store.staged(new), ["session_id", "scope", "source_event_id"]))
        if self._has_state():
            keys = pending.state_keys(fresh)
            self.store.commit(append={"turns": fresh}, merge={"session_state": pending.state_after_turns(self.store.rows_of("session_state", keys), fresh)}, batch=batch)
        else:  # the first turns that are counted, or those of a store of which none were: all are counted once
            self.store.commit({"session_state": self._counted(old.unionByName(fresh))}, append={"turns": fresh}, batch=batch)
        return rejected

    def _has_state(self) -> bool:
        return "session_state" in self.store.manifest()

    def _counted(self, turns: DataFrame) -> DataFrame:
        """States of all sessions, from all turns."""
        t = self.store.table
        own = pending.not_in(turns, t("project_document_chunks"), "id", "turn_id")
        covered = t("extraction_coverage").unionByName(t("atom_sources").select(F.col("turn_id").alias("id")))
        return pending.counted_state(own, covered, t("extraction_attempts")).select(*t("session_state").columns)

    def status(self, now: Column) -> DataFrame:
        """Trigger status of every session: from their kept states or, if none are kept, from all turns."""
        state = self.store.table("session_state") if self._has_state() else self._counted(self.store.table("turns"))
        return pending.state_status(state, now, self.idle_minutes, self.turn_cap)

    def upkeep(self) -> int:
        """Remove marks of covered turns that no atom stands on, and count the sessions' states and the atoms' live sources anew."""
        t = self.store.table
        self.store.commit({"extraction_coverage": self.store.staged(mutations.covered_by_sources(t("extraction_coverage"), t("atom_sources")))})
        counts = liveness.source_counts(t("atom_sources"), t("project_document_chunks"), t("project_documents"))
        return self.store.commit({"session_state": self.store.staged(self._counted(t("turns"))), "source_counts": self.store.staged(counts.select(*t("source_counts").columns))})

    def import_documents(self, folder: str, project: str, now: Column | None = None) -> dict[str, int]:
        """Import a folder of Markdown files as the documents of a project: counts of imported, unchanged, deleted, chunks, stale atoms, removed sections."""
        t, store = self.store.table, self.store
        known = t("project_registry").where(F.col("id") == project).select("scope").first()
        if known is None:
            raise KeyError(f"no project {project}")
        now = F.current_timestamp() if now is None else now
        files = store.staged(markdown.read_markdown(self.memory.spark, folder).withColumn("project_id", F.lit(project)))
        documents, chunks, atoms, edges = t("project_documents"), t("project_document_chunks"), t("atoms"), t("atom_sources")
        active = documents.where((F.col("project_id") == project) & F.col("is_active"))
        diff = store.staged(versioning.version_diff(active, files))
        gone = diff.where("status IN ('changed', 'deleted')")
        live = self._live_off(gone, documents, chunks, edges, atoms)
        cascade = versioning.deactivation_cascade(gone, documents, chunks, edges, atoms, t("l2_atoms"), live)
        sizes = files.select(*versioning.KEY, F.col("content_hash").alias("h"), F.col("byte_size").alias("size"))
        after = versioning.next_documents(documents, diff).join(sizes, versioning.KEY, "left")
        after = after.withColumn("byte_size", F.when(F.col("h") == F.col("content_hash"), F.col("size")).otherwise(F.col("byte_size"))).select(*documents.columns)
        after = store.staged(after)
        fresh = files.join(diff.where("status IN ('new', 'changed')").select(*versioning.KEY), versioning.KEY, "left_semi")
        cut = markdown.chunked(fresh).withColumn("project_id", F.lit(project))
        event = F.concat(F.lit(f"{DOCUMENT_PREFIX}{project}:"), "relative_path", F.lit(":"), "content_hash", F.lit(":"), F.col("chunk_index").cast("string"))
        cut = store.staged(cut.withColumn("event", event).withColumn("turn_id", uuid5(F.col("event"))))
        turns = t("turns")
        values = {
            "id": F.col("turn_id"), "session_id": F.lit(project), "scope": F.lit(known["scope"]), "source": F.lit(DOCUMENT_SOURCE), "content": F.col("content"), "tool_name": F.lit(DOCUMENT_TOOL), "tool_call_id": F.col("event"),
            "source_event_id": F.col("event"), "source_path": F.col("relative_path"), "source_heading": F.col("heading"), "source_start_line": F.col("start_line"), "source_end_line": F.col("end_line"), "source_hash": F.col("content_hash"), "created_at": now,
        }
        new_turns = cut.select(*[values[c].cast(turns.schema[c].dataType).alias(c) for c in turns.columns])
        ids = after.where("is_active").select(*versioning.KEY, "content_hash", F.col("id").alias("document_id"))
        new_chunks = cut.join(ids, [*versioning.KEY, "content_hash"]).withColumn("is_active", F.lit(True)).select(*chunks.columns)
        update = {c: F.col(f"n.{c}") for c in chunks.columns if c not in ("document_id", "chunk_index")}
        stale, sections = store.staged(cascade["stale"]), store.staged(cascade["sections"])
        refresh = store.staged(cascade["refresh"])
        forgotten = mutations.forget(store.rows_of("atoms", stale), stale)
        rows, links = t("l2_rows"), t("l2_atoms")
        off = sections.select(F.col("row_id").alias("off"))
        own = F.col("category") == schemas.PROJECT_CATEGORIES[0]
        removed = stale.unionByName(sections.select(F.col("row_id").alias("id")))
        chunks_after = store.staged(mutations.insert_or_update(cascade["chunks"], new_chunks, ["document_id", "chunk_index"], update))
        whole, merge, emptied = {}, {"atoms": forgotten}, {"index_points": removed}
        if live is None:
            whole["source_counts"] = store.staged(liveness.source_counts(edges, chunks_after, after).select(*t("source_counts").columns))
        else:
            edited = diff.where("status <> 'unchanged'").select(*versioning.KEY)
            edits = lambda docs: docs.join(edited, versioning.KEY, "left_semi")
            change = store.staged(liveness.document_changes(edges, liveness.live_turns(chunks, edits(documents)), liveness.live_turns(chunks_after, edits(after))))
            merge["source_counts"], emptied["source_counts"] = self._counts_after(change), change
        store.commit({
            **whole, "project_documents": after, "project_document_chunks": chunks_after,
            "turns": mutations.document_turns(turns, new_turns),
            "l2_rows": rows.join(off, own & (F.col("id") == F.col("off")), "left_anti"), "l2_atoms": links.join(off, own & (F.col("row_id") == F.col("off")), "left_anti"),
            "synthesis_coverage": pending.not_in(t("synthesis_coverage"), refresh),
        }, merge=merge, gone=emptied)
        counts = versioning.import_counts(diff).first()
        told = counts.asDict() if counts else {"imported": 0, "unchanged": 0, "deleted": 0}
        told.pop("project_id", None)
        return told | {"chunks": cut.count(), "stale": stale.count(), "sections": sections.count()}

    def _counts_after(self, change: DataFrame) -> DataFrame:
        """Live sources of the atoms of a change, with it; only their buckets are read."""
        return liveness.changed_counts(self.store.rows_of("source_counts", change), change).select(*self.store.table("source_counts").columns)

    def _live_off(self, gone: DataFrame, documents: DataFrame, chunks: DataFrame, edges: DataFrame, atoms: DataFrame) -> DataFrame | None:
        """Live sources of the atoms on the paths that go, without these; None where the store keeps no counts yet."""
        if "source_counts" not in self.store.manifest():
            return None
        off = liveness.live_turns(chunks, documents.join(gone.select(*versioning.KEY), versioning.KEY, "left_semi"))
        change = liveness.document_changes(edges, off, None)
        touched = versioning.touched_atoms(gone, documents, chunks, edges, atoms).select(F.col("id").alias("atom_id"))
        keys = self.store.staged(touched.unionByName(change.select("atom_id")).distinct())
        return self.store.staged(liveness.changed_counts(self.store.rows_of("source_counts", keys), change))

    # --- judged jobs

    def _ask(self, phase: str, payloads: DataFrame, schema: str) -> DataFrame:
        judge = self.judges[phase]
        if judge is None:
            raise ValueError(f"there is no judge for {phase}")
        return _parsed(self.store.staged(ReplyLedger(self.store, phase).ask(payloads, judge)), schema)

    def _checked(self, phase: str, replies: DataFrame, faults: DataFrame, keys: list[str]) -> DataFrame:
        """replies with the faults found in them; those that have one are asked for again with the next run."""
        checked = self.store.staged(_with_faults(replies.drop("parsed"), faults, keys))
        bad = checked.where("error IS NOT NULL").select("asked")
        if not bad.isEmpty():
            ReplyLedger(self.store, phase).reject(bad)
        return checked

    def _told(self, phase: str, replies: DataFrame, keys: list[str]) -> Run:
        errors = replies.where("error IS NOT NULL").select(F.lit(phase).alias("phase"), F.concat_ws("/", *keys).alias("key"), "error")
        n, failed = replies.agg(F.count("*"), F.count("error")).first()
        return Run({phase: n}, {phase: n - failed}, [errors] if failed else [])

    def extract(self, now: Column | None = None, project: bool = False, commit_of: tuple[str, int] | None = None) -> Run:
        """One batch of every session that is due (or of every project with open chunks): judge, check, commit, index."""
        phase, now = ("project_extraction" if project else "extraction"), F.current_timestamp() if now is None else now
        t = self.store.table
        turns, coverage, edges, chunks, atoms, entities = (t(n) for n in ("turns", "extraction_coverage", "atom_sources", "project_document_chunks", "atoms", "entities"))
        if project:
            keys = PROJECT
            open_ = pending.uncovered_project_turns(turns, chunks, t("project_documents"), coverage, edges)
            batch = pending.first_n(open_, keys, ["created_at", "chunk_index", "id"], self.turn_cap)
        else:
            keys = pending.SESSION
            due = self.store.staged(self.status(now).where("due").select(*keys))
            open_ = pending.uncovered_turns(turns.join(due, keys, "left_semi").select(*turns.columns), coverage, edges, chunks)
            batch = pending.extraction_batches(open_, self.turn_cap)
        batch = self.store.staged(batch)
        if batch.isEmpty():
            return Run({phase: 0}, {phase: 0})
        replies = self._ask(phase, pending.extraction_payloads(batch, atoms, entities, keys, project), schemas.SCENES)
        ids = batch.groupBy(*keys).agg(F.collect_list("id").alias("batch_ids"))
        scenes = replies.where("error IS NULL").select(*keys, F.posexplode("parsed").alias("scene", "s"))
        told = scenes.select(*keys, "scene", F.trim("s.scene_name").alias("scene_name"), F.posexplode("s.atoms").alias("position", "a")).select(*keys, "scene", "scene_name", "position", "a.*").join(ids, keys)
        outside = F.size(F.array_except(F.coalesce("source_turn_ids", F.array().cast("array<string>")), "batch_ids")) > 0
        problem = validation.atom_problem() if project else F.coalesce(validation.atom_problem(), F.when(outside & (F.col("confidence") >= schemas.CONFIDENCE_FLOOR), "a source is not in the batch"))
        replies = self._checked(phase, replies, _faults(told, keys, problem), keys)
        good = replies.where("error IS NULL").select(*keys)
        kept = validation.validated_atoms(told.join(good, keys, "left_semi").withColumn("statement", F.trim("statement")), corroborate=not project, drop_invalid=True)
        name = F.concat_ws("/", *keys, F.date_format(now, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat_ws(",", F.array_sort("batch_ids")), "scene", "position")
        judged = kept.select(uuid5(name).alias("atom_id"), "scope", (F.col("project_id") if project else F.lit(None).cast("string")).alias("project_id"), "statement", "category", "scene_name", "entity", "predicate", "confidence", "supersedes", "source_turn_ids")
        delta = extraction.commit(judged, batch.join(good, keys, "left_semi"), open_, atoms, entities, now, project)
        delta = {n: self.store.staged(d) for n, d in delta.items()}
        after = atoms.unionByName(delta["atoms"].select(*atoms.columns))
        cursors, changed = t("extraction_attempts"), extraction.reindexed(delta["atoms"], after)
        points, hidden = self.memory.index_changes(after.join(changed, "id", "left_semi").select(*after.columns), None, after)
        merge, emptied = {"index_points": points}, {"index_points": hidden}
        linked = self.store.staged(mutations.new_edges(edges, delta["atom_sources"]))
        if "source_counts" in self.store.manifest():
            change = self.store.staged(liveness.edge_changes(linked, None, chunks, t("project_documents")))
            merge["source_counts"], emptied["source_counts"] = self._counts_after(change), change
        if not project and self._has_state():
            done = batch.join(good, keys, "left_semi")
            covered = delta["extraction_coverage"].select("id").unionByName(delta["atom_sources"].select(F.col("turn_id").alias("id")))
            merge["session_state"] = pending.state_after_batch(self.store.rows_of("session_state", pending.state_keys(done)), done, covered)
        self.store.commit(
            {"extraction_attempts": mutations.advance_cursor(cursors, delta["extraction_attempts"])}, merge=merge, gone=emptied, batch=commit_of,
            append={
                "atoms": delta["atoms"].select(*atoms.columns), "atom_sources": linked,
                "entities": delta["entities"].select(*entities.columns), "extraction_coverage": mutations.new_edges(coverage, delta["extraction_coverage"]),
            },
        )
        return self._told(phase, replies, keys)

    def synthesize(self, now: Column | None = None, project: bool = False, commit_of: tuple[str, int] | None = None) -> Run:
        """One batch of every scope that is due (or of every project with pending atoms): judge, check, gate, commit, index."""
        phase, now = ("project_synthesis" if project else "synthesis"), F.current_timestamp() if now is None else now
        t = self.store.table
        atoms, rows, links, coverage = (t(n) for n in ("atoms", "l2_rows", "l2_atoms", "synthesis_coverage"))
        keys, categories = (PROJECT, schemas.PROJECT_CATEGORIES) if project else (["scope"], schemas.GENERAL_CATEGORIES)
        open_ = pending.pending_atoms(atoms.where(~F.coalesce("source_deleted", F.lit(False))), coverage).where(F.col("project_id").isNotNull() if project else F.col("project_id").isNull())
        if not project:
            open_ = open_.join(pending.scope_status(open_, now, self.idle_minutes, self.atom_cap).where("due").select("scope"), "scope", "left_semi")
        batch = self.store.staged(pending.synthesis_batches(open_, keys, self.atom_cap))
        if batch.isEmpty():
            return Run({phase: 0}, {phase: 0})
        replies = self._ask(phase, pending.synthesis_payloads(batch, rows, t("entities"), categories, keys), schemas.DESTINATIONS)
        ids = batch.groupBy(*keys).agg(F.collect_list("id").alias("batch_ids"))
        told = replies.where("error IS NULL").select(*keys, F.posexplode("parsed").alias("position", "d")).select(*keys, "position", "d.*").join(ids, keys)
        for c in ("title", "summary"):
            told = told.withColumn(c, F.trim(c))
        if project:  # atoms beyond the batch are left out, and what has none then
            told = told.withColumn("category", F.lit(schemas.PROJECT_CATEGORIES[0])).withColumn("atom_ids", F.array_intersect("atom_ids", "batch_ids")).where(F.size("atom_ids") > 0)
        own = rows.select(F.col("category").alias("r_category"), F.col("id").alias("r_id"), F.col("scope").alias("r_scope"), F.col("project_id").alias("r_project"))
        same = (F.col("existing_row_id") == F.col("r_id")) & (F.col("category") == F.col("r_category")) & (F.col("scope") == F.col("r_scope"))
        told = told.join(own, same & (F.col("project_id") == F.col("r_project")) if project else same, "left")
        problem = F.coalesce(
            validation.destination_problem(categories), F.when(F.size(F.array_except("atom_ids", "batch_ids")) > 0, "an atom is not in the batch"),
            F.when(F.col("existing_row_id").isNotNull() & F.col("r_id").isNull(), "the row is not there"),
        )
        replies = self._checked(phase, replies, _faults(told, keys, problem), keys)
        good = replies.where("error IS NULL").select(*keys)
        name = F.concat_ws("/", *keys, F.date_format(now, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat_ws(",", F.array_sort("batch_ids")), "position")
        wanted = told.join(good, keys, "left_semi").withColumn("destination_id", uuid5(name))
        wanted = self.store.staged(wanted.select("destination_id", *keys, "category", "title", "summary", "atom_ids", "existing_row_id", "owner", "deadline", "status"))
        gated = synthesis.gated_summaries(wanted, atoms, rows, project, [*keys, "category"]).withColumnRenamed("summary", "gated")
        met = wanted.join(gated, "destination_id").drop("summary").withColumnRenamed("gated", "summary")
        # of several new destinations of one title, the last makes the row
        title = Window.partitionBy(*keys, "category", F.coalesce("row_id", F.lower("title"))).orderBy(F.desc("destination_id"))
        met = met.withColumn("own_id", F.coalesce("row_id", F.first("destination_id").over(title))).withColumn("n", F.row_number().over(title))
        met = self.store.staged(met)
        changes = met.where("n = 1").drop("n", "own_id")
        after = synthesis.upsert_rows(rows, changes if project else changes.withColumn("project_id", F.lit(None).cast("string")), now, F.col("destination_id")).select(*rows.columns)
        edges = met.select("category", F.col("own_id").alias("row_id"), F.explode("atom_ids").alias("atom_id")).distinct()
        done = batch.join(good, keys, "left_semi").select("id")
        self.store.commit(
            {"l2_rows": after}, merge={"index_points": self.memory.index_changes(None, after.join(met.select(F.col("own_id").alias("id")).distinct(), "id", "left_semi").select(*after.columns))[0]},
            append={"l2_atoms": mutations.new_edges(links, edges), "synthesis_coverage": mutations.new_edges(coverage, done)}, batch=commit_of,
        )
        return self._told(phase, replies, keys)

    # --- the worker

    def run_once(self, now: Column | None = None, stream: tuple[str, int] | None = None) -> Run:
        """Project extraction, session extraction, synthesis, project synthesis: one batch each. A phase without a judge is passed over.

        A phase that ends in an exception is told of in failed, and the others go on. stream: the name of a stream and
        the number of its batch; a phase that has committed for this batch is not run again, and a failure is raised in
        the end, so that the batch is replayed.
        """
        run, first = Run(), None
        for phase, job in (("project_extraction", lambda **c: self.extract(now, True, **c)), ("extraction", lambda **c: self.extract(now, **c)), ("synthesis", lambda **c: self.synthesize(now, **c)), ("project_synthesis", lambda **c: self.synthesize(now, True, **c))):
            commit_of = (f"{stream[0]}/{phase}", stream[1]) if stream else None
            if self.judges[phase] is None or (commit_of and self.store.seen(*commit_of)):
                continue
            try:
                run.add(job(commit_of=commit_of))
            except Exception as e:
                logger.exception("%s failed", phase)
                run.failed[phase] = f"{type(e).__name__}: {e}"
                first = first or e
        if stream and first:
            raise first
        return run

    def drain(self, now: Column | None = None, most: int = 1000) -> Run:
        """run_once until nothing is committed any more, or `most` times: left tells if that ended it."""
        total = Run()
        while True:
            run = self.run_once(now)
            total.add(run)
            if not run.ran:
                return total
            most -= 1
            if most <= 0:
                total.left = True
                return total

    def import_and_drain(self, folder: str, project: str, now: Column | None = None) -> tuple[dict[str, int], Run]:
        """Import a project's documents, then extract and summarise until none of them is open."""
        counts, total = self.import_documents(folder, project, now), Run()
        for job in (lambda: self.extract(now, True), lambda: self.synthesize(now, True)):
            while True:
                run = job()
                total.add(run)
                if not run.ran:
                    break
        return counts, total


def sections_of(rows: DataFrame, project: str) -> DataFrame:
    """Sections of one project."""
    return provenance.of_scope_and_project(rows.where(F.col("category") == schemas.PROJECT_CATEGORIES[0]), None, project)
