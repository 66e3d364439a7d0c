"""Repeated byte strings by distributed prefix doubling over led windows.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier:
in a document of a smaller id, or earlier in the same one.

Positions are ranked by a growing part of their window; Spark sorts pairs of the
rank so far and the bytes that are new, and what is unique leaves. So that a row
need not stand for a single position, the part begins at a leader: the least
SEED-byte name in a window, which equal windows hold at equal offsets. A run of
neighbouring windows with one leader is one row.

* Round 0: ranks are the leaders' names. Runs with a leader that no other run has
  leave. Of runs whose bytes are all the same, only the first goes on; the others
  are repeats as a whole.
* Round r: a run is parted where its offsets from the leader cross a multiple of
  64 >> r. All windows of a part share a core of LENGTH + 1 - (64 >> r) bytes: 69,
  85, 93, 97, 99, 100. Spark sorts the pairs (rank in the round before, name of the
  core); parts that are unique leave, parts whose bytes equal another's are repeats
  but for the first. In the last round a part is one window.

A map task sends equal parts that it holds once only. Ranks with over
BATCH_CLASSES different parts in a batch (a common line in many surroundings) go
past that round's sort, with a marker row that keeps alive what others hold of
them; they are told apart in the rounds to come, where cores are longer. So no task
gets more rows of a rank than BATCH_CLASSES for each batch that was sent.

Repeats are settled in round 0 by two 64-bit names, of the leader and of all bytes
of the run; in later rounds by the bytes themselves.

Defined results: a null text is empty. Rows with a null id are left whole and are
no source. Rows with one id and one text are one document; different texts of one
id are documents in the order of their digests. Very long texts are read in pieces
of PIECE bytes, which share no window. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table
from .textkit import mix, utf8

LENGTH = 100
SEED = 40
BATCH_CLASSES = 16
#: Texts that occur several times, up to which they are broadcast to the rows.
BROADCAST_ROWS = 500_000
#: Rounds after that of the leaders; offsets from the leader are below 1 << ROUNDS.
ROUNDS = 6
#: Bytes of a text that are named at a time; a task holds some ten arrays of eight times as many.
PIECE = 1 << 19
#: Runs, and bytes of parts, that a task gathers before it sends them; rows that it sends at a time.
RUNS_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE = 400_000, 2 << 20, 16_384
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))
_LOW30 = U((1 << 30) - 1)
#: Kinds of rows: to be ranked; a marker of a rank with many; a repeat; to go past the sort.
ROW, MARKER, SPAN, PAST = 0, 1, 2, 3


class Names:
    """Position-independent 64-bit names of the substrings of a piece."""

    _up = _down = np.ones(1, U)

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls._up) <= n:
            size = max(n + 1, 2 * len(cls._up))
            step = lambda base: np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, base, U)]))
            cls._up, cls._down = step(U(_BASE)), step(U(pow(_BASE, -1, 1 << 64)))

    def __init__(self, data: np.ndarray):
        self.powers(len(data))
        self.n = len(data)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_VALUE[data] * self._up[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        return mix((self.sums[length:] - self.sums[:-length]) * self._down[: self.n - length + 1])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leader name, run name, first and last window start, and leader's start of each run of a piece."""
    names = Names(data)
    seeds = names.every(SEED)
    keyed = (seeds & ~_LOW30) | np.arange(len(seeds), dtype=U)
    lead = (_sliding_min(keyed, LENGTH - SEED + 1) & _LOW30).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(lead) - 1]])
    return seeds[lead[first]], names.spans(first, last + LENGTH), first, last, lead[first]


def pieces(text: bytes):
    """(offset, bytes) such that each window of the text is in just one piece."""
    at = 0
    while len(text) - at >= LENGTH:
        yield at, np.frombuffer(text, np.uint8, min(PIECE + LENGTH - 1, len(text) - at), at)
        at += PIECE


_COLUMNS = ["key", "kind", "run", "doc", "pos"]


def _pack(first: np.ndarray, more: np.ndarray, high=0) -> np.ndarray:
    """first window (or byte) | windows after it (or bytes) << 32 | offset of the first window from its leader << 40."""
    return first.astype(np.int64) | (np.asarray(more).astype(np.int64) << 32) | (np.asarray(high).astype(np.int64) << 40)


def _unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos & 0xFFFFFFFF, (pos >> 32) & 0xFF, pos >> 40


def _spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x.astype(U) * U(0x9E3779B97F4A7C15) + y.astype(U)).view(np.int64)


def _fused(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of one document, sorted by start, joined where they touch."""
    if not len(doc):
        return doc, start, end
    new = np.concatenate([[True], start[1:] > np.maximum.accumulate(end)[:-1]])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def _sent(rank: np.ndarray, new_class: np.ndarray, last_round: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of rank and class: masks of those to be ranked, those that go past, and of one row of each rank that does."""
    new_rank = np.concatenate([[True], rank[1:] != rank[:-1]])
    classes = np.bincount(np.cumsum(new_rank) - 1, weights=new_class)[np.cumsum(new_rank) - 1]
    many = classes > (len(rank) if last_round else BATCH_CLASSES)
    return new_class & ~many, new_class & many, new_rank & many


def _run_rows(doc, lead, run, first, last, at):
    """Rows that a map task sends for its runs."""
    order = np.lexsort((first, doc, run, lead))
    doc, lead, run, first, last, at = (x[order] for x in (doc, lead, run, first, last, at))
    new_class = np.concatenate([[True], (lead[1:] != lead[:-1]) | (run[1:] != run[:-1])])
    send, past, marks = _sent(lead, new_class)
    by = np.flatnonzero(~new_class)
    by = by[np.lexsort((first[by], doc[by]))]
    d, s, e = doc[by], first[by], last[by] + LENGTH
    parts = []
    for one in np.split(np.arange(len(d)), np.flatnonzero(d[1:] != d[:-1]) + 1) if len(d) else []:
        parts.append(_fused(d[one], s[one], e[one]))
    d, s, e = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3
    pos = _pack(first, last - first, at - first)
    key, zeros = lead.view(np.int64), lambda n: np.zeros(n, np.int64)
    kind = lambda n, k: np.full(n, k, np.int32)
    return (
        np.concatenate([key[send], key[marks], _spread(d, s), _spread(doc[past], pos[past])]),
        np.concatenate([kind(send.sum(), ROW), kind(marks.sum(), MARKER), kind(len(d), SPAN), kind(past.sum(), PAST)]),
        np.concatenate([run[send].view(np.int64), zeros(marks.sum()), zeros(len(d)), key[past]]),
        np.concatenate([doc[send], zeros(marks.sum()), d, doc[past]]),
        np.concatenate([pos[send], zeros(marks.sum()), _pack(s, e - s), pos[past]]),
    )


def _slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def _find_runs(batches):
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), utf8(batch.column(1))
        seen: dict[bytes, int] = {}
        for i in np.argsort(ids, kind="stable"):  # of equal texts, that of the smallest id speaks
            if texts[i] and len(texts[i]) >= LENGTH:
                seen.setdefault(xxhash.xxh3_128_digest(texts[i]), i)
        found, held = [], 0

        def rows(found):
            return _slices(pa.RecordBatch.from_arrays([pa.array(x) for x in _run_rows(*(np.concatenate(x) for x in zip(*found)))], _COLUMNS))

        for i in sorted(seen.values()):
            for at, data in pieces(texts[i]):
                lead, run, first, last, leader = runs(data)
                found.append((np.full(len(lead), ids[i], np.int64), lead, run, first + at, last + at, leader + at))
                held += len(lead)
            if held > RUNS_AT_ONCE:
                yield from rows(found)
                found, held = [], 0
        if found:
            yield from rows(found)


def _rank(batches):
    """Rows sorted by (key, kind desc, class, doc, pos) -> doc, pos, key, kind (SPAN or ROW) and, where classes are bytes, those bytes.

    A class is a run's name in round 0, a part's bytes later.
    """
    key, shared, held, last = None, False, None, None
    for batch in batches:
        with_bytes = "cut" in batch.schema.names
        k, kind, run, doc, pos = (batch.column(n).to_numpy(zero_copy_only=False) for n in _COLUMNS)
        classes = batch.column("cut").to_pylist() if with_bytes else run.tolist()
        through = kind >= SPAN
        at = np.flatnonzero(through)
        out = [doc[at], pos[at], np.where(kind[at] == SPAN, 0, run[at]), np.where(kind[at] == SPAN, SPAN, ROW).astype(np.int32)]
        cuts = [classes[i] for i in at.tolist()] if with_bytes else None
        own = np.flatnonzero(~through)
        if len(own):
            ko = k[own]
            # keys that lie wholly within the batch and have one row leave at once
            new = np.concatenate([[True], ko[1:] != ko[:-1]])
            alone = new & np.concatenate([new[1:], [False]]) & (kind[own] == ROW)
            alone[0] &= ko[0] != key
            made = []
            for i in own[~alone].tolist():
                kk, d, p, c = k[i], doc[i], pos[i], classes[i]
                if kk != key:
                    key, shared, held, last = kk, False, None, None
                if kind[i] == MARKER:
                    shared = True
                elif last is not None and c == last[0]:
                    if (d, p) != last[1:]:
                        start, more, _ = _unpack(p)
                        made.append((d, start | ((more + LENGTH) << 32), 0, SPAN, None))
                else:
                    last = (c, d, p)
                    if shared:
                        made.append((d, p, kk, ROW, c))
                    elif held is None:
                        held = (d, p, kk, ROW, c)
                    else:
                        made += [held, (d, p, kk, ROW, c)]
                        shared, held = True, None
            if made:
                d, p, kk, what, c = zip(*made)
                out = [np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip(out, (d, p, kk, what))]
                cuts = cuts + list(c) if with_bytes else None
        arrays = [pa.array(x) for x in out]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cuts, pa.binary())] if with_bytes else [])], ["doc", "pos", "key", "kind", *["cut"] * with_bytes])


def _parts(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, cuts: list[bytes], round_: int) -> pa.RecordBatch:
    """Rows to be sorted in a round, of the parts that rows of the round before fall into."""
    first, more, high = _unpack(pos)
    data = np.frombuffer(b"".join(cuts), np.uint8)
    base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))[:-1]])
    names, width = Names(data), 1 << (ROUNDS - round_)
    lower, upper = (high - more) // width, high // width
    row = np.concatenate([np.arange(len(key)), np.flatnonzero(lower != upper)])
    part = np.concatenate([upper, lower[lower != upper]])
    # offsets from the leader of the part's windows, the farthest of which starts first
    far, near = np.minimum(high[row], part * width + width - 1), np.maximum(high[row] - more[row], part * width)
    start = high[row] - far
    size = far - near + LENGTH
    core = names.spans(base[row] + high[row] - part * width, base[row] + high[row] - (part * width + width - 1) + LENGTH)
    rank = mix((key[row].view(U) ^ (part.astype(U) * U(0xD6E8FEB86659FD93))) * U(0x9E3779B97F4A7C15) + core)
    whole = names.spans(base[row] + start, base[row] + start + size)
    doc, first = doc[row], first[row] + start
    order = np.lexsort((first, doc, whole, rank))
    row, start, size, far, near, rank, whole, doc, first = (x[order] for x in (row, start, size, far, near, rank, whole, doc, first))
    cut = [cuts[r][s : s + n] for r, s, n in zip(row.tolist(), start.tolist(), size.tolist())]
    new_class = np.concatenate([[True], (rank[1:] != rank[:-1]) | (whole[1:] != whole[:-1])])
    head = 0
    for i in np.flatnonzero(~new_class).tolist():
        if new_class[i - 1]:
            head = i - 1
        if cut[i] != cut[head]:  # equal names of different bytes: a class of its own
            new_class[i], head = True, i
    send, past, marks = _sent(rank, new_class, round_ == ROUNDS)
    again = np.flatnonzero(~new_class)
    packed, zeros = _pack(first, far - near, far), lambda n: np.zeros(n, np.int64)
    kind = lambda n, k: np.full(n, k, np.int32)
    rank = rank.view(np.int64)
    n_marks = int(marks.sum())
    bytes_of = lambda m: [cut[i] for i in np.flatnonzero(m).tolist()]
    columns = [
        np.concatenate([rank[send], rank[marks], _spread(doc[again], first[again]), _spread(doc[past], packed[past])]),
        np.concatenate([kind(send.sum(), ROW), kind(n_marks, MARKER), kind(len(again), SPAN), kind(past.sum(), PAST)]),
        np.concatenate([zeros(send.sum()), zeros(n_marks), zeros(len(again)), rank[past]]),
        np.concatenate([doc[send], zeros(n_marks), doc[again], doc[past]]),
        np.concatenate([packed[send], zeros(n_marks), _pack(first[again], size[again]), packed[past]]),
    ]
    cuts_out = bytes_of(send) + [None] * (n_marks + len(again)) + bytes_of(past)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cuts_out, pa.binary())], [*_COLUMNS, "cut"])


class _Gathered:
    """Rows of a round, gathered until their bytes are enough to be sent."""

    def __init__(self, round_: int):
        self.round, self.rows, self.held = round_, [], 0

    def add(self, key: int, doc: int, pos: int, cut: bytes):
        self.rows.append((key, doc, pos, cut))
        self.held += len(cut)
        if self.held > BYTES_AT_ONCE:
            yield from self.send()

    def send(self):
        if self.rows:
            key, doc, pos, cuts = zip(*self.rows)
            self.rows, self.held = [], 0
            yield from _slices(_parts(np.array(key, np.int64), np.array(doc, np.int64), np.array(pos, np.int64), list(cuts), self.round))


def _cut_runs(batches):
    """doc, text, wanted (pos, key) -> rows of the first round."""
    gathered = _Gathered(1)
    for batch in batches:
        for doc, text, wanted in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2)):
            for w in wanted:
                pos = w["pos"].as_py()
                first, more = pos & 0xFFFFFFFF, (pos >> 32) & 0xFF
                yield from gathered.add(w["key"].as_py(), doc, pos, text[first : first + more + LENGTH])
    yield from gathered.send()


def _split(round_: int):
    """Rows (doc, pos, key, cut) that a round has left -> rows of the next."""

    def run(batches):
        gathered = _Gathered(round_)
        for batch in batches:
            for doc, pos, key, cut in zip(*(c.to_pylist() for c in batch.columns)):
                yield from gathered.add(key, doc, pos, cut)
        yield from gathered.send()

    return run


def removed_spans(text: bytes, packed: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the removed bytes."""
    pos = np.array(sorted(packed), np.int64)
    start = pos & 0xFFFFFFFF
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + (pos >> 32))[order]
    _, s, e = _fused(np.zeros(len(start), np.int64), start, end)
    return list(zip(s.tolist(), e.tolist()))


def _cut_out(batches):
    for batch in batches:
        out = []
        for text, packed in zip(utf8(batch.column(1)), batch.column(2)):
            spans, kept, at = removed_spans(text, packed.as_py()), hashlib.sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            out.append((sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
        n, k, h = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string())], ["d", "n_removed", "n_spans", "kept_sha256"])


def _free(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark drops them when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


_RANKED = "doc long, pos long, key long, kind int"
_TO_RANK = "key long, kind int, run long, doc long, pos long"


def _sorted(rows: DataFrame, class_: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", F.desc("kind"), class_, "doc", "pos")


def find_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, spans: packed spans (start | length << 32) to remove, of documents (doc, text) that have any.

    Documents equal to one of a smaller id may be missing.
    """
    spark = docs.sparkSession
    ranked = scratch.keep(_sorted(docs.mapInArrow(_find_runs, _TO_RANK), "run").mapInArrow(_rank, _RANKED), "round0")
    _free(spark)
    wanted = ranked.where(f"kind = {ROW}").groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("pos", "key")).alias("wanted"))
    rows = docs.join(wanted, F.col("doc") == F.col("d")).select("doc", "text", "wanted").mapInArrow(_cut_runs, _TO_RANK + ", cut binary")
    rounds = [ranked]
    for r in range(1, ROUNDS + 1):
        ranked = scratch.keep(_sorted(rows, "cut").mapInArrow(_rank, _RANKED + ", cut binary"), f"round{r}", small=True)
        _free(spark)
        rounds.append(ranked)
        left = ranked.where(f"kind = {ROW}").select("doc", "pos", "key", "cut")
        if r == ROUNDS or left.isEmpty():
            break
        rows = left.mapInArrow(_split(r + 1), _TO_RANK + ", cut binary")
    spans = rounds[0].where(f"kind = {SPAN}").select("doc", "pos")
    for more in rounds[1:]:
        spans = spans.unionByName(more.where(f"kind = {SPAN}").select("doc", "pos"))
    spans = scratch.keep(spans.groupBy("doc").agg(F.collect_set("pos").alias("spans")), "spans", small=True)
    scratch.drop(*rounds)
    return spans


def _digests(batches):
    for batch in batches:
        n, key, sha = [], [], []
        for t in utf8(batch.column(1)):
            t = t or b""
            n.append(len(t))
            key.append(xxhash.xxh3_128_digest(t))
            sha.append(hashlib.sha256(t).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "text_key", "sha"])


def _keyed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(t) for t in utf8(batch.column(1))], pa.binary())], ["doc_id", "text", "text_key"])


def _numbers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """n_id, n_key, doc: numbers of the distinct (doc_id, text_key), in that order."""
    at = F.monotonically_increasing_id()
    placed = rows.select("doc_id", "text_key").distinct().orderBy("doc_id", "text_key")
    return scratch.keep(placed.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key"), at.alias("doc")), "numbers")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.keep(docs.mapInArrow(_digests, "doc_id long, n_bytes long, text_key binary, sha string"), "rows")
    named = rows.where("doc_id IS NOT NULL")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi")
    if several.isEmpty():
        named, known = named.withColumn("doc", F.col("doc_id")), known.select(F.col("doc_id").alias("doc"), "text")
    else:  # ids don't tell documents apart: number them
        numbers = _numbers(named, scratch)
        named = named.join(numbers, (F.col("doc_id") == F.col("n_id")) & (F.col("text_key") == F.col("n_key"))).drop("n_id", "n_key")
        keyed = known.mapInArrow(_keyed, "doc_id long, text string, text_key binary")
        known = keyed.join(numbers, (F.col("doc_id") == F.col("n_id")) & (F.col("text_key") == F.col("n_key"))).select("doc", "text")
    spans = find_repeats(known, scratch)
    _free(spark)
    cut = known.join(spans.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d")).select("doc", "text", "spans")
    done = cut.mapInArrow(_cut_out, "d long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["d"])
    firsts = named.groupBy("text_key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("text_key").alias("k"), "first")
    firsts = scratch.keep(firsts, "firsts", small=True)
    if firsts.count() <= BROADCAST_ROWS:  # else Spark splits what a common text makes uneven
        firsts = F.broadcast(firsts)
    copy = F.coalesce(F.col("first") < F.col("doc"), F.lit(False))
    whole = copy & (F.col("n_bytes") >= LENGTH)
    out = named.join(firsts, F.col("text_key") == F.col("k"), "left").join(done, F.col("doc") == F.col("d"), "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    nameless = rows.where("doc_id IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return out.unionByName(nameless)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, c, h[800 * c + 1 : 800 * c + 998] AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 800 + 1)) AS c FROM d)),
w AS (SELECT doc_id, 400 * c + q AS p, md5_number(part[2 * q + 1 : 2 * q + 200]) AS k FROM (SELECT doc_id, c, part, unnest(range(0, greatest(0, length(part) // 2 - 99))) AS q FROM b)),
f AS (SELECT k, min(doc_id * 1000000000 + p) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE doc_id * 1000000000 + p <> first),
g AS (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS n FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(h[2 * x + 1 : 2 * y], '' ORDER BY x) AS kept FROM (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT doc_id, last, length(h) // 2 FROM t JOIN d USING (doc_id)) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
