"""The layered memory as views over the star-schema and text tables.

One SQL text serves Spark and, for checks, any engine with the same dialect but
for a few function names, which stand in capitals: LIST, SORTED, STAMP.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORY_TYPES, L2_CATEGORIES
from ..shipping import ship

NOW, CURSOR_AT = "TIMESTAMP '2024-01-29 12:00:00'", "TIMESTAMP '2024-01-29 00:00:00'"
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_SPARK = {"LIST(": "array(", "SORTED(": "array_sort(collect_list("}
_DUCK = {"LIST(": "list_value(", "SORTED(": "list_sort(list(", "STAMP(": "strftime('%Y-%m-%d %H:%M:%S.%f', "}


def pick(expr: str, names: list[str]) -> str:
    """SQL that takes a name by number."""
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


def scope(expr: str) -> str:
    return f"concat('scope', CAST({expr} % 5 AS STRING))"


VIEWS = {
    "turns": f"SELECT event_id AS id, user_id AS session_id, {scope('user_id')} AS scope, {pick('event_id % 3', ['assistant', 'user', 'tool'])} AS source, event_type AS content, ts AS created_at FROM events WHERE ts <= {NOW}",
    "coverage": "SELECT event_id AS id FROM events WHERE event_id % 4 <> 0",
    "cursors": f"SELECT DISTINCT user_id AS session_id, {scope('user_id')} AS scope, {CURSOR_AT} AS cursor_at, CAST(5000 AS BIGINT) AS cursor_id FROM events WHERE user_id % 3 <> 0",
    "atoms": f"""SELECT o_orderkey AS id, {scope('o_custkey')} AS scope, concat('order ', CAST(o_orderkey AS STRING), ' ', lower(o_orderpriority)) AS statement, {pick('o_orderkey % 4', ['fact', 'preference', 'decision', 'event'])} AS category,
        'inferred' AS origin, concat('scene ', o_orderpriority) AS scene_name, o_custkey % 40 AS entity_id, CAST((o_orderkey % 11) * 0.1 AS FLOAT) AS confidence,
        CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes, o_orderkey % 17 = 0 AS source_deleted, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 8 END AS project_id, o_orderdate AS created_at FROM orders""",
    "synthesis_coverage": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0",
    "edges": "SELECT DISTINCT l_orderkey AS atom_id, l_partkey AS turn_id FROM lineitem",
    "part_turns": f"SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS session_id, {scope('p_partkey')} AS scope, 'tool' AS source, p_name AS content, {CURSOR_AT} AS created_at FROM part",
    "l2_rows": f"SELECT {pick('c_custkey % 10', L2_CATEGORIES)} AS category, c_custkey AS id, {scope('c_custkey')} AS scope, CAST(NULL AS BIGINT) AS project_id, concat('Topic ', CAST(c_custkey % 300 AS STRING)) AS title, concat('About ', c_mktsegment, '  ') AS summary, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS owner, CAST(c_nationkey AS BIGINT) AS deadline, CASE WHEN c_custkey % 10 = 3 THEN 'doing' END AS status, CAST(0 AS BIGINT) AS created_at, (c_custkey * 7) % 1000 AS updated_at FROM customer",
    "l2_atoms": f"SELECT DISTINCT {pick('o_custkey % 10', L2_CATEGORIES)} AS category, o_custkey AS row_id, o_orderkey AS atom_id FROM orders",
    "destinations": f"""SELECT o_custkey + 1000000 AS destination_id, {pick('o_custkey % 10', L2_CATEGORIES)} AS category, {scope('o_custkey')} AS scope, CASE WHEN o_custkey % 7 = 0 THEN 'Unheard of' ELSE concat('TOPIC ', CAST(o_custkey % 300 AS STRING)) END AS title, 'New summary' AS summary,
        CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS existing_row_id, SORTED(o_orderkey)) AS atom_ids FROM orders GROUP BY o_custkey""",
    "entities": f"SELECT s_suppkey AS id, {scope('s_suppkey')} AS scope, s_name AS name, LIST(concat('Maker ', CAST(s_suppkey % 30 AS STRING)), concat('S', CAST(s_suppkey AS STRING))) AS aliases, s_nationkey AS created_at FROM supplier",
    "projects": "SELECT p_partkey AS id, p_name AS name, LIST(p_brand, concat(p_type, '-', CAST(p_size AS STRING))) AS aliases FROM part",
    "points": f"""SELECT d.doc_id AS id, d.source AS scope, {pick('d.doc_id % 11', [c for c, _ in CATEGORY_TYPES])} AS source_table, concat('Doc ', CAST(d.doc_id AS STRING)) AS title, d.text AS content, CASE WHEN d.doc_id % 5 = 0 THEN d.doc_id % 2 END AS project_id,
        CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 1 END AS source_deleted, CASE WHEN d.doc_id % 2 = 0 THEN d.doc_id % 13 = 0 END AS superseded FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "doc_versions": "SELECT o_orderkey AS id, o_custkey % 8 AS project_id, concat('docs/', CAST(o_custkey AS STRING), '.md') AS relative_path, concat('h', CAST(o_orderkey % 5 AS STRING)) AS content_hash, o_totalprice AS byte_size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1 AS is_active FROM orders",
    "doc_files": "SELECT c_custkey % 8 AS project_id, concat('docs/', CAST(c_custkey AS STRING), '.md') AS relative_path, concat('h', CAST(c_custkey % 5 AS STRING)) AS content_hash FROM customer WHERE c_custkey % 10 <> 3",
    "chunks": "SELECT DISTINCT l_orderkey AS document_id, l_partkey AS turn_id, l_linenumber AS chunk_index, l_linenumber % 6 <> 0 AS is_active FROM lineitem",
    "category_types": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in CATEGORY_TYPES) + ") AS t(category, type)",
}


def stamp(column: str):
    """A timestamp as text: the same in every session time zone."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _refers(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def _dialect(sql: str, names: dict[str, str]) -> str:
    for general, own in names.items():
        sql = sql.replace(general, own)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model view, or a base table, as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _dialect(VIEWS[name], _SPARK)
    tables = _refers(sql, BASE_TABLES)
    for t in tables:
        sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in tables})


def oracle(sql: str) -> str:
    """SQL for the checking engine, with the views it refers to put before it."""
    needed = _refers(sql, VIEWS)
    head = ", ".join(f"{n} AS ({_dialect(VIEWS[n], _DUCK)})" for n in needed)
    body = _dialect(sql.strip(), _DUCK)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalog(dict):
    """Queries by name; registered with the SQL they are checked against."""

    def add(self, name: str, sql: str | None = None):
        def put(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return build(lambda table: view(spark, sf_dir, table))

            self[name] = Query(run, None if sql is None else oracle(sql))
            return build

        return put
