"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of each benchmark item (an
item of fewer words is one window). All patterns of one length share a shift
table over blocks of two words: where the block that ends at the current word
stands in no pattern, the search moves on by the most it safely can. A block
that ends a pattern leads to a bucket of candidates, which are compared word by
word.

The benchmark is a stated query set: it is dealt into chunks of about
`chunk_bytes` of text (at least one item), and every document is searched for
every chunk. One chunk is what the driver and an executor's task hold at a time.
With several chunks, documents are numbered in a written table once; a chunk's
search gives the numbers, spans and items of the documents that it hits, and no
texts.

Defined results: a null or empty text has no words, is not hit and not
contaminated. Items without words have no windows. The windows of an item with a
null id hit words as others do; only the list of ids and n_items leave it out.
Repeated items with one id count once in n_items. Repeated documents each get a
row; extra columns stay out of the search, and those named n_words, hit_spans or
items are replaced. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table
from .textkit import utf8

WIDTH = 13
#: A document is contaminated if the hit words are at least one in so many.
SHARE = 20
CHUNK_BYTES = 4 << 20
#: Bytes that are no word: all ASCII but 0-9 and a-z (A-Z is lower-cased first).
_TO_SPACE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split() if text else []


class WuManber:
    """Search for word sequences of one length m; block: words in a block."""

    def __init__(self, patterns: dict[tuple[int, ...], dict[int, None]], m: int):
        self.m, self.block = m, min(2, m)
        self.patterns = patterns
        self.default = m - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        #: suffix block -> first block -> patterns
        self.buckets: dict[tuple[int, ...], dict[tuple[int, ...], list[tuple[int, ...]]]] = {}
        for p in patterns:
            for end in range(self.block, m + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets.setdefault(p[m - self.block :], {}).setdefault(p[: self.block], []).append(p)

    def find(self, ids: list[int]):
        """(start, owners) of each occurrence."""
        m, default, shift, n, block = self.m, self.default, self.shift, len(ids), self.block
        i = m - 1
        while i < n:
            key = (ids[i - 1], ids[i]) if block == 2 else (ids[i],)
            s = shift.get(key, default)
            if s:
                i += s
                continue
            start = i - m + 1
            near = self.buckets[key].get(tuple(ids[start : start + block]))
            if near:
                window = tuple(ids[start : i + 1])
                if window in near:
                    yield start, self.patterns[window]
            i += 1


class Benchmark:
    """The searchers of one chunk of items, one for each pattern length."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int = WIDTH):
        self.ids: list[str] = []
        self.vocabulary: dict[bytes, int] = {}
        numbered: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], dict[int, None]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = None if item_id is None else numbered.setdefault(str(item_id), len(numbered))
            seq = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            m = min(width, len(seq))
            for s in range(len(seq) - m + 1):
                owners = by_length.setdefault(m, {}).setdefault(seq[s : s + m], {})
                if k is not None:
                    owners[k] = None
        self.ids = list(numbered)
        self.searchers = [WuManber(p, m) for m, p in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans (start, end) and the ids of the items found."""
        ids = list(map(self.vocabulary.get, words, repeat(0)))
        spans, owners = [], set()
        for searcher in self.searchers:
            for start, found in searcher.find(ids):
                spans.append((start, start + searcher.m))
                owners.update(found)
        return spans, {self.ids[k] for k in owners}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


FOUND = ["n_words", "hit_spans", "items"]


def _searching(items: list, width: int, text_at: int, all_rows: bool):
    """mapInArrow function: the columns but the text, and those of FOUND; without all_rows, of documents that are hit."""

    def run(batches):
        bench = Benchmark(items, width)
        for batch in batches:
            counts, spans_out, items_out = [], [], []
            for text in utf8(batch.column(text_at)):
                words = words_of(text)
                spans, ids = bench.search(words) if words else ([], set())
                counts.append(len(words))
                spans_out.append([x for s in merged(spans) for x in s])
                items_out.append(sorted(ids))
            rest = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if k != text_at]
            out = pa.RecordBatch.from_arrays(
                [*(c for _, c in rest), pa.array(counts, pa.int64()), pa.array(spans_out, pa.list_(pa.int32())), pa.array(items_out, pa.list_(pa.string()))],
                [*(n for n, _ in rest), *FOUND],
            )
            yield out if all_rows else out.filter(pa.array([bool(s) for s in spans_out], pa.bool_()))

    return run


def _merging(batches):
    """number, lists of spans and items by chunk -> number, spans, items."""
    for batch in batches:
        spans = [[x for s in merged([p for one in lists for p in zip(one[::2], one[1::2])]) for x in s] for lists in batch.column(1).to_pylist()]
        items = [sorted({i for one in lists for i in one}) for lists in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["number", "spans", "found"])


def search_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs without text_col, with n_words, hit_spans (start, end, start, ...; in words) and items (ids found), which replace columns of these names."""
    spark = docs.sparkSession
    docs = docs.drop(*(set(FOUND) - {text_col}))
    keyed = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t")).distinct()
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))

    def search(rows: DataFrame, c: int, all_rows: bool) -> DataFrame:
        part = keyed if chunks == 1 else keyed.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == c)
        items = [(r["i"], None if r["t"] is None else bytes(r["t"])) for r in part.collect()]
        out = rows.drop(text_col).select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit_spans"), F.array().cast("array<string>").alias("items"))
        return rows.mapInArrow(_searching(items, width, rows.columns.index(text_col), all_rows), out.schema)

    if chunks == 1:
        return search(docs, 0, True)
    scratch = Scratch(spark, "decontaminate")
    numbered = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias(text_col), F.monotonically_increasing_id().alias("number")), "numbered")
    slim = numbered.select("number", text_col)
    first = scratch.keep(search(slim, 0, True), "chunk0")
    hits = first.where(F.size("hit_spans") > 0)
    for c in range(1, chunks):
        hits = hits.unionByName(scratch.keep(search(slim, c, False), f"chunk{c}", small=True))
    lists = hits.groupBy("number").agg(F.collect_list("hit_spans").alias("s"), F.collect_list("items").alias("i"))
    found = lists.mapInArrow(_merging, "number long, spans array<int>, found array<string>").withColumnRenamed("number", "k")
    met = numbered.select("row", "number").join(first.select(F.col("number").alias("n0"), "n_words"), F.col("number") == F.col("n0")).join(found, F.col("number") == F.col("k"), "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return met.select("row.*", "n_words", F.coalesce("spans", none("int")).alias("hit_spans"), F.coalesce("found", none("string")).alias("items"))


def judge(found: DataFrame, share: int = SHARE) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("words_text"))
    found = search_benchmark(plain, table(spark, sf_dir, "benchmark"), text_col="words_text")
    return judge(found).where(~F.col("contaminated")).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bp AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, md5(array_to_string(w[s : s + m - 1], ' ')) AS h FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM bp)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, s, md5(array_to_string(w[s : s + m - 1], ' ')) AS h FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT doc_id, item_id, dw.m AS m, s FROM dw JOIN bw ON dw.m = bw.m AND dw.h = bw.h),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
