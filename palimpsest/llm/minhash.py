"""MinHash near-duplicates: banded candidates, odd sketches, exact confirmation.

A document's set is that of its five-word shingles. Documents with equal sets are
one class, which its smallest doc_id stands for. MinHash samples make a class's
band keys, and all SAMPLES of them are folded into an odd sketch: a bitmap of the
parities of the (sample number, value) pairs that hash to each bit. The population
count of the XOR of two sketches tells the number of samples that differ, and so
the similarity, most precisely where it is high. One pass over the texts writes
sets, band keys and sketches; texts are neither read again nor shuffled.

Every banded candidate is verified by sketch first: a pair goes on if its estimate
is within MARGIN of the threshold. What goes on is confirmed on the full sets.
Candidates are taken in two steps, so that a bucket never yields all of its pairs.
First every member of a bucket meets the bucket's smallest member, and the links
found are turned into components. A member's full set is sent once for such a
pair, the smallest member's once for CHUNK pairs. Then buckets that still hold
more than one component are compared in blocks of about BLOCK members: sketches
tell which members have a candidate there; their full sets are sent to the same
pair of blocks, where a task confirms candidates, leaves out what it has already
connected, and hands on the links that connect.

Defined results: texts without words, null texts included, have an empty set and
are linked with nothing. A null doc_id is linked with nothing and has no
component; it is kept. Rows with one doc_id are one vertex; repeated rows each
get a row. Extra columns are ignored. An empty table gives no rows. Very long
texts have one row with their whole set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import Scratch, table
from .textkit import WordHashes, mix, shingle_set, utf8

WIDTH = 5
#: A link: SHARE times the union is at most 100 times the intersection.
SHARE = 85
BANDS, ROWS, SAMPLES = 20, 5, 512
SKETCH_BITS = 2048
#: Odd-sketch estimates below the threshold by more than this are no candidates: about four standard deviations.
MARGIN = 0.07
#: Pairs of a bucket's smallest member that are confirmed together.
CHUNK = 128
#: Members of a mixed bucket that make a block; a task compares the sketches of two blocks.
BLOCK = 1024
#: Ids of sets, and mixed buckets, up to which they are broadcast to what they are picked from; it is shuffled beyond them.
BROADCAST_IDS = 1_000_000
#: Bytes of sets that a task gathers before it sends them.
BATCH_BYTES = 4 << 20
STAGE_SHARE = 80

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_NUMBER = (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) + np.uint64(1)


def samples(shingles: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The first n MinHash values (32 bits each) of a set of 64-bit hashes."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 17) // n)
    for a in range(0, len(low), step):
        h = low[None, a : a + step] * _MULTIPLY[:n]
        h += _ADD[:n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(least, h.min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    rows = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix((key ^ rows[:, r]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r))
    return key


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the samples that hash to each of SKETCH_BITS bits, in 64-bit words."""
    bits = mix(_NUMBER ^ least) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    z = np.minimum(differing_bits / SKETCH_BITS, 0.4999)
    differing = -SKETCH_BITS / 2 * np.log1p(-2 * z)
    return 1.0 - differing / (2 * SAMPLES)


def _describe(batches):
    """doc_id, text -> doc_id, n_shingles, set_key, bands, odd, shingles; the last four are null for an empty set."""
    cache = WordHashes()
    names = ["doc_id", "n_shingles", "set_key", "bands", "odd", "shingles"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        rows, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            s = shingle_set(text, WIDTH, cache)
            if len(s):
                least, raw = samples(s), s.tobytes()
                rows.append((doc, len(s), xxhash.xxh3_128_digest(raw), band_keys(least).view(np.int64), odd_sketch(least).tobytes(), raw))
                held += len(raw)
            else:
                rows.append((doc, 0, None, None, None, None))
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether two sorted sets have share percent of their union in common."""
    a, b = (x, y) if len(x) <= len(y) else (y, x)
    if not len(a) or 100 * len(a) < share * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _by_sketch(share: int):
    """Those pairs (a, b, sketch of a, sketch of b) whose estimate is near the threshold or above."""
    least = share / 100 - MARGIN

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                differing = np.bitwise_count(_sketches(batch.column(2)) ^ _sketches(batch.column(3))).sum(1)
                yield batch.select([0, 1]).filter(pa.array(estimate(differing) >= least))

    return run


def _confirm(share: int):
    """Rows sorted by (lead, chunk, role): first the lead's sets (role 0), then members' (role 1) -> links (a, b)."""

    def run(batches):
        at, leads = None, []
        for batch in batches:
            a, b = [], []
            for lead, chunk, role, id_, raw in zip(*(batch.column(n).to_pylist() for n in ("lead", "chunk", "role", "id")), batch.column("shingles")):
                if (lead, chunk) != at:
                    at, leads = (lead, chunk), []
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    leads.append(s.copy())
                elif any(similar(x, s, share) for x in leads):
                    a.append(lead), b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _near(table: pa.Table, share: int):
    """For each row of two blocks of a bucket: the later rows that its sketch is near, of other components, whose first shared band is the bucket's.

    group (component numbers) may be changed between rows: rows that are together by then aren't given.
    """
    least = share / 100 - MARGIN
    side, diagonal = (table.column(n).to_numpy() for n in ("block", "diagonal"))
    bucket, m = np.int64(table.column("bucket")[0].as_py()), table.num_rows
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(m, BANDS)
    odd = _sketches(table.column("odd"))
    group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
    band = int(np.flatnonzero(bands[0] == bucket)[0])

    def rows():
        for i in range(m - 1):
            ok = group[i + 1 :] != group[i]
            if not diagonal[i]:
                ok &= side[i + 1 :] != side[i]
            js = np.flatnonzero(ok) + i + 1
            if len(js):
                js = js[estimate(np.bitwise_count(odd[js] ^ odd[i]).sum(1)) >= least]
            if band and len(js):
                js = js[~(bands[js, :band] == bands[i, :band]).any(1)]
            if len(js):
                yield i, js

    return group, rows()


def _near_members(share: int):
    """Group function of two blocks: the rows that have a candidate in them, without sketches."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        _, rows = _near(table, share)
        near = np.zeros(table.num_rows, bool)
        for i, js in rows:
            near[i] = near[js] = True
        return table.select(MEMBER).filter(pa.array(near))

    return run


MEMBER = ["bucket", "low", "high", "rep", "component", "block", "diagonal"]


def _block_confirm(share: int):
    """Group function of the members with candidates of two blocks: links that connect what the group can connect."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("rep").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
        group, rows = _near(table, share)
        links = []
        for i, js in rows:
            for j in js.tolist():
                if group[j] != group[i] and similar(sets[i], sets[j], share):
                    group[group == group[j]] = group[i]
                    links.append((ids[i], ids[j]))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets_of(ids: DataFrame, described: DataFrame) -> DataFrame:
    """id, bands, odd and shingles of each set of the documents of ids (one column, id)."""
    wanted = ids.select(F.col("id").alias("wanted"))
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = described.where("set_key IS NOT NULL").join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    return found.dropDuplicates(["doc_id", "set_key"]).select(F.col("doc_id").alias("id"), "bands", "odd", "shingles")


def _star_links(members: DataFrame, classes: DataFrame, described: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """Links of the members of buckets with the bucket's smallest."""
    star = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    sketches = classes.select("rep", "odd")
    met = star.join(sketches.toDF("ra", "oa"), F.col("a") == F.col("ra")).join(sketches.toDF("rb", "ob"), F.col("b") == F.col("rb")).select("a", "b", "oa", "ob")
    pairs = scratch.keep(met.mapInArrow(_by_sketch(share), "a long, b long").distinct(), "pairs", small=True)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = scratch.keep(_sets_of(ids, described).select("id", "shingles"), "sets")
    parts = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = pairs.join(parts, F.col("a") == F.col("lead")).select("lead", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("chunk"), F.col("b").alias("member"))
    leads = dealt.select("lead", "chunk").distinct().join(sets, F.col("lead") == F.col("id")).select("lead", "chunk", F.lit(0).alias("role"), "id", "shingles")
    others = dealt.join(sets, F.col("member") == F.col("id")).select("lead", "chunk", F.lit(1).alias("role"), "id", "shingles")
    rows = leads.unionByName(others).repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "role")
    links = scratch.keep(rows.mapInArrow(_confirm(share), "a long, b long"), "links", small=True)
    scratch.drop(pairs, sets)
    return links


def _block_links(members: DataFrame, names: DataFrame, classes: DataFrame, described: DataFrame, share: int, block: int, scratch: Scratch) -> DataFrame:
    """Links between the components that mixed buckets still hold."""
    named = members.where("n > 2").join(names, F.col("rep") == F.col("id"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    parts = scratch.keep(mixed.select(F.col("bucket").alias("b"), F.ceil(F.col("n") / block).cast("int").alias("parts")), "parts", small=True)
    n = parts.count()
    if not n:
        return members.sparkSession.createDataFrame([], "a long, b long")
    # else Spark splits what a large bucket makes uneven
    given = F.broadcast(parts) if n <= BROADCAST_IDS else parts
    dealt = named.join(given, F.col("bucket") == F.col("b")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.select("bucket", "rep", "component", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "component", "block", (F.col("block") == F.col("other")).alias("diagonal"))

    def with_sets(rows, sets):  # of several sets of one id, those that are in the bucket
        return rows.join(sets, F.col("rep") == F.col("id")).where(F.array_contains("bands", F.col("bucket"))).drop("id").groupBy("bucket", "low", "high")

    sketches = classes.select(F.col("rep").alias("id"), "bands", "odd")
    near = scratch.keep(with_sets(dealt, sketches).applyInArrow(_near_members(share), dealt.schema), "near")
    sets = scratch.keep(_sets_of(near.select(F.col("rep").alias("id")).distinct(), described), "sets")
    links = scratch.keep(with_sets(near, sets).applyInArrow(_block_confirm(share), "a long, b long"), "links", small=True)
    scratch.drop(near, sets, parts)
    return links


def _labelled(docs: DataFrame, share: int, block: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """near_duplicates of docs (doc_id, text), and the written tables that the result reads."""
    described = scratch.keep(docs.mapInArrow(_describe, "doc_id long, n_shingles long, set_key binary, bands array<long>, odd binary, shingles binary"), "described")
    linking = described.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = scratch.keep(linking.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands", "odd")).alias("m")).select("set_key", F.col("m.doc_id").alias("rep"), "m.bands", "m.odd"), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("lead")).where("n > 1")
    members = scratch.keep(buckets.join(shared, "bucket").select("bucket", "rep", "lead", "n"), "members")

    links = _star_links(members, classes, described, share, scratch)
    names = connected_components(links, scratch)
    more = _block_links(members, names, classes, described, share, block, scratch)
    if not more.isEmpty():
        names = connected_components(links.unionByName(more), scratch)
    scratch.drop(members, links, more)

    labelled = classes.select("set_key", "rep").join(names, F.col("rep") == F.col("id"), "left").select(F.col("set_key").alias("k"), F.coalesce("component", "rep").alias("c"))
    plain = described.select("doc_id", "n_shingles", "set_key")
    empty = plain.where("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("c"))
    out = plain.where("set_key IS NOT NULL").join(labelled, F.col("set_key") == F.col("k"), "left").select("doc_id", "n_shingles", "c").unionByName(empty)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return out, [described, classes, names]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _labelled(slim, share, block, Scratch(docs.sparkSession, "minhash"))[0]


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more), that of the smallest doc_id."""
    scratch = Scratch(spark, "near_dedup")
    found, tables = _labelled(docs.select(F.col("doc_id").cast("long"), "text"), STAGE_SHARE, BLOCK, scratch)
    dropped = scratch.keep(found.where("NOT kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped", small=True)
    scratch.drop(*tables)
    if dropped.count() <= BROADCAST_IDS:  # else texts are shuffled once
        dropped = F.broadcast(dropped)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(dropped, F.col("id") == F.col("dropped"), "left_anti").select("row.*")


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""
