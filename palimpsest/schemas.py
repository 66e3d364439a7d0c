"""Tables of the layered memory and their enumerations."""

from __future__ import annotations

# Fixed values of the data model.
SOURCES = ["user", "assistant", "tool"]
ATOM_CATEGORIES = ["fact", "preference", "decision", "event"]
ORIGINS = ["asserted", "inferred"]
TASK_STATUSES = ["todo", "doing", "done", "blocked", "cancelled"]
CATEGORY_TYPES = [
    ("atoms", "workspace"),
    ("projects", "workspace"),
    ("project_sections", "workspace"),
    ("docs", "workspace"),
    ("tasks", "workspace"),
    ("tools", "agent"),
    ("skills", "agent"),
    ("mcp", "agent"),
    ("workflows", "agent"),
    ("profiles", "user"),
    ("users", "user"),
]
L2_CATEGORIES = [c for c, _ in CATEGORY_TYPES if c != "atoms"]
PROJECT_CATEGORIES = ["project_sections"]
GENERAL_CATEGORIES = [c for c in L2_CATEGORIES if c not in PROJECT_CATEGORIES]
VECTOR_SOURCES = ["profiles", "users", "atoms"]
CONFIDENCE_FLOOR, CONFIDENCE_GATE = 0.5, 0.8


TURNS = "id string, session_id string, scope string, source string, content string, tool_name string, tool_call_id string, source_event_id string, source_path string, source_heading string, source_start_line int, source_end_line int, source_hash string, created_at timestamp"
ATOMS = "id string, scope string, statement string, category string, origin string, scene_name string, entity_id string, predicate string, confidence float, supersedes string, source_deleted boolean, project_id string, created_at timestamp"
ATOM_SOURCES = "atom_id string, turn_id string"
SOURCE_COUNTS = "atom_id string, project_id string, live long"
ENTITIES = "id string, scope string, name string, aliases array<string>, created_at timestamp"
PROJECTS = "id string, scope string, name string, normalized_name string, aliases array<string>, root_path string, created_at timestamp, updated_at timestamp"
L2_ROWS = "category string, id string, scope string, project_id string, title string, summary string, owner string, deadline timestamp, status string, created_at timestamp, updated_at timestamp"
L2_ATOMS = "category string, row_id string, atom_id string"
COVERAGE = "id string"
CURSORS = "session_id string, scope string, cursor_at timestamp, cursor_id string"
DOCUMENTS = "id string, project_id string, relative_path string, content_hash string, byte_size long, is_active boolean"
CHUNKS = "document_id string, turn_id string, chunk_index int, heading string, start_line int, end_line int, is_active boolean"
INDEX_POINTS = "id string, scope string, source_table string, title string, content string, project_id string, source_deleted boolean, superseded boolean, dense array<float>, sparse map<long,double>"
SESSION_STATE = "key string, session_id string, scope string, pending long, last_turn_at timestamp, has_new boolean, cursor_at timestamp, cursor_id string"
SCENES = "array<struct<scene_name:string,atoms:array<struct<statement:string,category:string,entity:string,predicate:string,confidence:double,source_turn_ids:array<string>,supersedes:string>>>>"
DESTINATIONS = "array<struct<category:string,title:string,summary:string,atom_ids:array<string>,existing_row_id:string,owner:string,deadline:timestamp,status:string>>"
SCORES = "array<struct<id:string,score:double>>"

TABLES = {
    "turns": TURNS, "atoms": ATOMS, "atom_sources": ATOM_SOURCES, "entities": ENTITIES, "project_registry": PROJECTS, "l2_rows": L2_ROWS, "l2_atoms": L2_ATOMS,
    "extraction_coverage": COVERAGE, "synthesis_coverage": COVERAGE, "extraction_attempts": CURSORS, "project_documents": DOCUMENTS, "project_document_chunks": CHUNKS, "index_points": INDEX_POINTS, "session_state": SESSION_STATE, "source_counts": SOURCE_COUNTS,
}


def empty(spark, name: str):
    return spark.createDataFrame([], TABLES[name])
