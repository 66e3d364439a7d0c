"""Importance resampling of documents towards a target's distribution.

Features are all runs of 1 to `ngram` words, dealt into buckets by crc32. Both
corpora are counted by bucket: a task counts its rows in one array, and what is
shuffled is an array's entries, not the features. A bucket's gain is the log of the
target's smoothed share over the corpus's; the gains are an array as long as there
are buckets, whatever the input. A document's weight is the mean of its features'
gains, looked up as an array; a Gumbel draw from a hash of its id makes the score, so
that the highest scores are a sample without replacement in proportion to
exp(weight / 1000).

The k-th highest key (score, then id) is found by radix selection: a round counts the
rows by the next digits of their keys, on all cores, and the driver goes on with the
one bin that the k-th row lies in, until that bin is taken whole. Bins are at most
RADIX; the range of each part of the key is measured first, so that digits that are
the same in all rows take no round. Only rows up to the k-th key are sorted (by
range) and ranked.

Defined results: a null or empty text has no words and no features, and weight 0. A
null id is hashed as an empty one and comes last among equal scores. Rows with one
id are rows of their own: among equal scores, the smaller weight, then the fewer
features come first, and of equal rows any. Extra columns are ignored, whatever
their names. Empty tables give no rows; without a target, only smoothing is left of
it.
"""

from __future__ import annotations

import hashlib
import math
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import words_of
from .merkle import crc32_sql
from .storage import Scratch, table
from .textkit import utf8

NGRAM, BUCKETS, SEED = 2, 10_000, 7
#: Documents of fewer words are never drawn; so many of a hundred others are.
LEAST_WORDS, PERCENT = 20, 25
#: Bins of a round of the selection.
RADIX_BITS = 12
_RANGE = 1 << 32
#: Texts whose buckets are counted at a time.
AT_ONCE = 256


def bucket_ids(words: list[bytes], ngram: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ngram words. A run's crc32 goes on from that of the run without its last word."""
    if not words:
        return np.empty(0, np.int64)
    sums = list(map(crc32, words))
    found = list(sums)
    for n in range(1, min(ngram, len(words))):
        sums = list(map(crc32, words[n:], map(crc32, repeat(b" "), sums[:-1])))
        found += sums
    return np.array(found, np.int64) % buckets


def _counted(ngram: int, buckets: int):
    def run(batches):
        counts, waiting = np.zeros(buckets, np.int64), [np.empty(0, np.int64)]
        for batch in batches:
            for text in utf8(batch.column(0)):
                waiting.append(bucket_ids(words_of(text), ngram, buckets))
                if len(waiting) > AT_ONCE:
                    counts += np.bincount(np.concatenate(waiting), minlength=buckets)
                    waiting = [waiting[0]]
        counts += np.bincount(np.concatenate(waiting), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a table's one column, by bucket."""
    summed = texts.mapInArrow(_counted(ngram, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # no more rows than buckets
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the smoothed shares' ratio, floored."""
    buckets, total, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (total + buckets)) / ((s + 1.0) * (wanted + buckets))
    return np.array([math.floor(1000.0 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def _scored(gain: np.ndarray, ngram: int, seed: int):
    def run(batches):
        for batch in batches:
            n_words, n_features, weights, scores = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                ids = bucket_ids(words, ngram, len(gain))
                weight = int(gain[ids].sum()) // len(ids) if len(ids) else 0
                n_words.append(len(words))
                n_features.append(len(ids))
                weights.append(weight)
                scores.append(weight + gumbel(doc_id, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def importance(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of docs (doc_id, text); target: text."""
    gain = gains(bucket_counts(docs.select("text"), ngram, buckets), bucket_counts(target.select("text"), ngram, buckets))
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(_scored(gain, ngram, seed), "doc_id long, n_words long, n_features long, weight long, score long")


# --- selection --------------------------------------------------------------


def _halves(part: Column) -> list[Column]:
    """A long as two numbers of 32 bits, in its order; differences of these don't overflow."""
    return [F.shiftright(part, 32), part.bitwiseAND(F.lit(_RANGE - 1))]


def select_first(rows: DataFrame, parts: list[Column], k: int, bits: int = RADIX_BITS) -> Column:
    """The condition that k rows of `rows` meet, those that come first by parts (longs without nulls), which together tell all rows apart."""
    if k <= 0:
        return F.lit(False)
    halves = [h for part in parts for h in _halves(part)]
    spans = rows.agg(F.count("*").alias("n"), *[f(h).alias(f"{name}{i}") for i, h in enumerate(halves) for name, f in (("low", F.min), ("high", F.max))]).first()
    if k >= spans["n"]:
        return F.lit(True)
    taken, within, left = F.lit(False), F.lit(True), k
    for i, half in enumerate(halves):
        low, width = spans[f"low{i}"], (spans[f"high{i}"] - spans[f"low{i}"]).bit_length()
        offset = half - F.lit(low)
        while width:
            step = min(bits, width)
            width -= step
            digit = F.shiftright(offset, width).bitwiseAND(F.lit((1 << step) - 1))
            for value, n in sorted(rows.where(within).groupBy(digit.alias("digit")).count().collect()):  # at most 2 ** bits rows
                if left <= n:
                    break
                left -= n
            taken, within = taken | (within & (digit < value)), within & (digit == value)
            if left == n:
                return taken | within
    return taken | within


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with rank from 1, by a range sort; where each of its partitions starts is one row a partition."""
    at = F.monotonically_increasing_id()
    placed = scratch.keep(rows.orderBy(*order).select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("of_part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).alias("start"))
    return placed.join(F.broadcast(starts), F.col("part") == F.col("of_part")).select(*rows.columns, (F.col("start") + F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs (doc_id, text); rank is null for those not drawn."""
    scratch = Scratch(docs.sparkSession, "resample")
    scored = scratch.keep(importance(docs, target, ngram, buckets, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    long_enough = F.col("n_words") >= least_words
    offered = scored.where(long_enough)
    key = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("weight"), F.col("n_features"), F.col("row")]
    first = long_enough & select_first(offered, key, percent * offered.count() // 100)
    drawn = ranked(scored.where(first), key, scratch)
    rest = scored.where(~first).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("row")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, with rank (in place of a column of this name). Ids have to be unique."""
    plan = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"), "rank")
    return docs.drop("rank").join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn"))).drop("_drawn")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
v AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS n FROM df JOIN v USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN v USING (f) GROUP BY bucket),
g AS (
  SELECT s.bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + {BUCKETS}.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT row, CAST(sum(gain) AS BIGINT) AS gain FROM df JOIN v USING (f) JOIN g USING (bucket) GROUP BY row),
w AS (
  SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (gain - ((gain % (2 * len(w) - 1)) + (2 * len(w) - 1)) % (2 * len(w) - 1)) // (2 * len(w) - 1) END AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (row)),
c AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM w),
r AS (SELECT *, CASE WHEN n_words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS offered FROM c)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= {PERCENT} * offered // 100 THEN place END AS rank FROM r"""
