"""Merkle manifest of a dataset: digests of rows, trees of sources, one root, and proofs.

A row's leaf is the SHA-256 of its fields, each as byte count and value. The leaves
of a tree (a source) ascend by id; every `fanout` consecutive nodes have their
concatenated hex digests hashed, level by level, until one is left. The trees'
subroots, in order of the sources, are hashed likewise to the root.

Leaves are numbered by a range sort: its partitions number the rows of each tree
they hold, and a tree that began in earlier partitions goes on from their counts,
of which a partition needs one at most. Aligned blocks of fanout ** 3 numbers are
groups: a contiguous numpy matrix of 64-byte digests, reshaped by the fanout and
hashed by rows, level by level. Blocks' tops are the nodes of the next round, until
each tree has one. Then the rounds are walked down again: a block gets the siblings
above its top, and index arithmetic finds those of every node within it. So no task
holds more than a block, whatever the size of a tree, and texts are read once and
never shuffled.

Defined results: a null field is "-", so a null text is not an empty one. Rows with
one id are ordered by leaf; equal rows are leaves of their own. A null id comes
first in its tree; a null source is a tree, the first. Columns that aren't fields
are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import fold
from .storage import Scratch, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Levels within a block: its leaves are FANOUT to this power.
BLOCK_LEVELS = 3
#: One of so many documents is tampered with in the query, by the crc32 of its id.
TAMPERED = 5
HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields, in the order given."""
    shown = [f.cast("string") for f in fields]
    return sha256(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown])


# --- order ------------------------------------------------------------------


def _numbered(batches):
    """part (the partition) and nth (the number in its tree's run there) for rows that come in order; tree is the first column."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        trees = batch.column(0).dictionary_encode(null_encoding="encode")
        codes = trees.indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        first = (trees.dictionary[codes[0].item()].as_py(),)
        nth = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        if first == last:  # goes on from the batch before
            nth[: starts[1] if len(starts) > 1 else n] += at
        last, at = (trees.dictionary[codes[-1].item()].as_py(),), int(nth[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(nth, pa.int64())], [*batch.schema.names, "part", "nth"])


def placed(rows: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """rows (tree first) with position: the row's number in its tree, by order."""
    ranged = rows.orderBy(F.col("tree").asc_nulls_first(), *order)
    schema = rows.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth")).schema
    kept = scratch.keep(ranged.mapInArrow(_numbered, schema), name)
    runs = kept.groupBy("part", "tree").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only the first tree of a partition can have begun before it: one row a partition
    carried = runs.select(F.col("part").alias("of_part"), F.col("tree").alias("of_tree"), F.sum("n").over(before).alias("carried")).where("carried > 0")
    met = kept.join(F.broadcast(carried), (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree")), "left")
    return met.select(*rows.columns, (F.col("nth") + F.coalesce("carried", F.lit(0))).alias("position"))


# --- blocks -----------------------------------------------------------------


def raised(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a matrix of hex digests, one a row."""
    whole = len(nodes) // fanout * fanout
    runs = [*nodes[:whole].reshape(-1, fanout * HEX)]
    if whole < len(nodes):
        runs.append(nodes[whole:].reshape(-1))
    return np.frombuffer(b"".join(hashlib.sha256(r).hexdigest().encode() for r in runs), np.uint8).reshape(-1, HEX)


def levels(nodes: np.ndarray, fanout: int, least: int = 0) -> list[np.ndarray]:
    """Matrices from nodes up to the one that is left, over `least` levels at least."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append(raised(out[-1], fanout))
    return out


def siblings(matrices: list[np.ndarray], fanout: int) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """For each level below the top, the siblings before and after the ancestor of each node of the first."""
    index, before, after = np.arange(len(matrices[0])), [], []
    for matrix in matrices[:-1]:
        flat = matrix.tobytes()
        start = index - index % fanout
        end = np.minimum(start + fanout, len(matrix))
        before.append([flat[a:b] for a, b in zip((start * HEX).tolist(), (index * HEX).tolist(), strict=True)])
        after.append([flat[a:b] for a, b in zip(((index + 1) * HEX).tolist(), (end * HEX).tolist(), strict=True)])
        index = index // fanout
    return before, after


def _matrix(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by("position").combine_chunks()
    digests = table.column("node").cast(pa.binary()).to_pylist()
    return table, np.frombuffer(b"".join(digests), np.uint8).reshape(-1, HEX)


def _least(block: int, depth: int) -> int:
    """A block that isn't the first shows that its tree goes on above it; a first one that isn't full is all of its tree."""
    return depth if block else 0


def _top(fanout: int, depth: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, nodes = _matrix(table)
        tree, block = key[0].as_py(), key[1].as_py()
        top = levels(nodes, fanout, _least(block, depth))[-1]
        return pa.table({"tree": pa.array([tree], pa.string()), "position": pa.array([block], pa.int64()), "node": pa.array([top.tobytes()], pa.string())})

    return run


def climbed(nodes: DataFrame, scratch: Scratch, fanout: int, depth: int) -> list[DataFrame]:
    """Rounds of (tree, position, node), from nodes up to one a tree."""
    size, rounds = fanout**depth, [nodes]
    while True:
        blocks = rounds[-1].select("tree", "position", "node", F.floor(F.col("position") / size).alias("block"))
        tops = scratch.keep(blocks.groupBy("tree", "block").applyInArrow(_top(fanout, depth), "tree string, position long, node string"), "tops", small=True)
        rounds.append(tops)
        if tops.where("position > 0").isEmpty():
            return rounds


def _walk(fanout: int, depth: int, columns: list[str], carried: list[str], schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], below: pa.Table, above: pa.Table) -> pa.Table:
        below, nodes = _matrix(below)
        n, up = len(nodes), above.column("path")[0].as_py()
        before, after = siblings(levels(nodes, fanout, _least(key[1].as_py(), depth)), fanout)
        before += [[u["before"].encode()] * n for u in up]
        after += [[u["after"].encode()] * n for u in up]
        flat = [pa.array([x for row in zip(*side, strict=True) for x in row], pa.string()) for side in (before, after)]
        offsets = pa.array(np.arange(n + 1) * len(before), pa.int32())
        path = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["before", "after"]))
        found = {c: below.column(c) for c in columns}
        found |= {c: pa.array([above.column(c)[0].as_py()] * n, above.column(c).type) for c in carried}
        return pa.table(found | {"path": path}).cast(schema)

    return run


def descended(rounds: list[DataFrame], above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The rows of the first round with path: siblings on each level up to the root. above: tree, position, path and more of the last round's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size, carried = fanout**depth, [c for c in above.columns if c not in ("tree", "position", "path")]
    for nodes in rounds[-2::-1]:
        schema = nodes.select("*", *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in carried], F.lit(None).cast(PATH).alias("path")).schema
        work = _walk(fanout, depth, nodes.columns, carried, to_arrow_schema(schema))
        left = nodes.withColumn("block", F.floor(F.col("position") / size)).groupBy("tree", "block")
        above = left.cogroup(above.withColumnRenamed("position", "block").groupBy("tree", "block")).applyInArrow(work, schema)
    return above


# --- the manifest -----------------------------------------------------------


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", presented: Column | None = None, fanout: int = FANOUT, depth: int = BLOCK_LEVELS) -> DataFrame:
    """id_col, tree, position, leaf, presented, subroot, root and path of each row of docs.

    path: the siblings before and after the row's ancestor on each level, from the
    leaf to the root. presented: a digest that someone shows for the row, its leaf
    unless a column of docs says otherwise.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = leaf_digest(*[F.col(f"`{f}`") for f in fields])
    rows = docs.select(F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf.alias("node"), (F.lit(None).cast("string") if presented is None else presented).alias("shown"), F.monotonically_increasing_id().alias("row"))
    leaves = scratch.keep(rows, "leaves")
    ordered = placed(leaves, [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")], scratch, "ordered").drop("row")
    rounds = climbed(ordered, scratch, fanout, depth)
    trees = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    sources = climbed(placed(trees, [F.col("name").asc_nulls_first()], scratch, "trees"), scratch, fanout, depth)
    root = sources[-1].select("tree", "position", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    above = descended(sources, root, fanout, depth).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), F.col("node").alias("subroot"), "root", "path")
    found = descended(rounds, scratch.keep(above, "above", small=True), fanout, depth)
    return found.select(F.col("id").alias(id_col), F.col("tree"), "position", F.col("node").alias("leaf"), F.coalesce("shown", "node").alias("presented"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, from the leaf's to the root's, left to right."""
    return sha256(F.concat_ws("", F.transform(path, lambda level: F.concat(level["before"], level["after"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, level: sha256(level["before"], node, level["after"]))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(fold(F.col("doc_id"), TAMPERED) == 0, leaf_digest(*[F.col(f) for f in FIELDS[:-1]], F.translate("text", _UPPER, _LOWER)))
    proved = manifest(docs, presented=tampered)
    found = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("presented"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# --- SQL --------------------------------------------------------------------

#: Levels that the SQL unrolls; trees of up to FANOUT to this power.
_SQL_LEVELS = 4
#: Remainders of CRC-32 (reflected polynomial 0xEDB88320) for the four low bits: fixed values.
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, from the hexadecimal digits of each byte, low one first."""
    digits = f"list_transform(range(length(hex(encode({text})))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode({text})), CAST(CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END AS BIGINT), 1)) - 1 AS BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, d: xor(c >> 4, {_NIBBLES}[(xor(c, d) & 15) + 1])))"


def _sql_tree(prefix: str, source: str) -> str:
    """CTEs {prefix}0 to {prefix}{levels} of (tree, pos, node) and {prefix}run of (tree, level, run, nodes)."""
    out = [f"{prefix}0 AS ({source})"]
    for k in range(_SQL_LEVELS):
        out.append(f"""{prefix}r{k} AS (SELECT tree, pos // {FANOUT} AS run, list(node ORDER BY pos) AS nodes, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {prefix}{k}) GROUP BY tree, pos // {FANOUT}),
{prefix}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {prefix}r{k})""")
    return ",\n".join(out)


def _sql_paths(prefix: str) -> str:
    """CTE {prefix}path of (tree, pos, before, after): lists over the levels that a tree has."""
    joins, before, after = [], [], []
    for k in range(_SQL_LEVELS):
        own = f"(l.pos // {FANOUT**k}) % {FANOUT}"
        joins.append(f"JOIN {prefix}r{k} AS r{k} ON r{k}.tree IS NOT DISTINCT FROM l.tree AND r{k}.run = l.pos // {FANOUT ** (k + 1)}")
        before.append(f"CASE WHEN r{k}.n > 1 THEN [array_to_string(list_slice(r{k}.nodes, 1, {own}), '')] ELSE [] END")
        after.append(f"CASE WHEN r{k}.n > 1 THEN [array_to_string(list_slice(r{k}.nodes, {own} + 2, {FANOUT}), '')] ELSE [] END")
    flat = lambda parts: f"flatten([{', '.join(parts)}])"
    return f"{prefix}path AS (SELECT l.tree, l.pos, {flat(before)} AS before, {flat(after)} AS after FROM {prefix}0 AS l {' '.join(joins)})"


def _oracle() -> str:
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join([field(c) for c in FIELDS[:-1]] + [field(text)])})"
    fold_all = "list_reduce(list_prepend({'b': '', 'v': shown, 'a': ''}, list_transform(range(1, len(before) + 1), lambda i: {'b': before[i], 'v': '', 'a': after[i]})), lambda x, y: {'b': '', 'v': sha256(y.b || x.v || y.a), 'a': ''}).v"
    return f"""WITH made AS (
  SELECT source AS tree, doc_id, {leaf("text")} AS node, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {leaf("text")} END AS shown FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM made),
{_sql_tree("a", "SELECT tree, pos, node FROM placed")},
{_sql_paths("a")},
subroots AS (SELECT tree AS name, node AS subroot, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS pos FROM a{_SQL_LEVELS}),
{_sql_tree("b", "SELECT '' AS tree, pos, subroot AS node FROM subroots")},
{_sql_paths("b")},
proved AS (
  SELECT p.doc_id, p.node AS leaf, p.shown, s.subroot, t.node AS root, a.before || b.before AS before, a.after || b.after AS after
  FROM placed AS p JOIN apath AS a ON a.tree IS NOT DISTINCT FROM p.tree AND a.pos = p.pos
  JOIN subroots AS s ON s.name IS NOT DISTINCT FROM p.tree JOIN bpath AS b ON b.pos = s.pos CROSS JOIN b{_SQL_LEVELS} AS t),
folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(1, len(before) + 1), lambda i: before[i] || after[i]), '')) AS proof_sha256, {fold_all} AS folded_root FROM proved)
SELECT *, folded_root = root AS verified FROM folded"""


ORACLE = _oracle()
