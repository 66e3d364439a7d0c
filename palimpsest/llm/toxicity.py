"""Toxicity by a weighted finite-state pattern grammar.

Transducers of insults, threats, targets, negation and reported speech are composed
(module grammar) and run over the words and signs of a text. What is scored is the
clause: insults with their weights, by the marks that the grammar put on them
(negated, reported), raised where the clause addresses someone; threats, which are
a verb of harm in a clause that addresses someone, by the verb's marks. Clauses end
at . ! ? ; and line ends. A word outside of a match adds nothing.

The document's score is a logistic function of its clauses' scores: the strongest,
their sum, and their sum for each PASSAGE words, so that chance matches in a long
text don't add up. Its weights, none of them negative, and the insults with theirs
are learned from labels; what marks count is the grammar's.

Learning uses at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN other labelled rows, but
for those of over LEARN_BYTES, in one task; scoring runs over whole texts.

Defined results: null and empty texts match nothing and get the score of a text
without a match. A null id is not held out and is never a training row. Repeated
rows each get a row; extra columns stay out of the score, and those named score or
predicted are replaced. Where one of the labels is missing, every score is 0.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grammar import HARMS, Lexicon, clauses, normalized, tokens
from .sampling import fold, sample_ids
from .storage import table
from .textkit import WordHashes, shingle_set, utf8

FOLDS, HELD_OUT = 3, 1
SAMPLE_TOXIC, SAMPLE_CLEAN, LEARN_BYTES = 2000, 3000, 1 << 16
THRESHOLD = 0.7
#: Lengths of word beginnings that the lexicon may hold.
STEMS = range(4, 9)
MIN_TOXIC_DOCS, MIN_LOG_ODDS = 3, 2.5
#: Log odds of a word that counts in full.
FULL_ODDS = 6.0
#: Keys expected to be learned by chance; what they are worth shows on rows that they were not learned from.
FALSE_KEYS = 5
#: Smallest shingle hashes by which copies are told.
LOW_HASHES = 5
#: Words that the density of a text's clauses is told for.
PASSAGE = 50
FEATURES = 3

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: All beyond ASCII but Latin letters; without them, words part at ASCII signs alone.
_NOT_PLAIN = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")
_HARM_SET = frozenset(HARMS)


def words_of(text: str) -> list[str]:
    return [w for w in tokens(normalized(text)) if w[0].isalpha()]


def features(scores: list[float], n_words: int) -> np.ndarray:
    """Features of a document from its clauses' scores."""
    if not scores:
        return np.zeros(FEATURES)
    total = sum(scores)
    return np.array([max(scores), math.log1p(total), math.log1p(10 * total * PASSAGE / max(n_words, PASSAGE))])


def evaluate(text: bytes | None, lexicon: Lexicon) -> np.ndarray:
    """Features of a text. The grammar runs over it only if the lexicon or a harm matches some word of it."""
    if not text:
        return np.zeros(FEATURES)
    lowered = normalized(text.decode("utf-8", "replace"))
    if _NOT_PLAIN.search(lowered):
        words = set(tokens(lowered))
    else:
        words = {w.decode("utf-8", "replace") for w in set(lowered.encode().translate(_LETTERS).split())}
    if not any(map(lexicon.weight, words)) and _HARM_SET.isdisjoint(words):
        return np.zeros(FEATURES)
    found = tokens(lowered)
    return features(clauses(found, lexicon), sum(t[0].isalpha() for t in found))


def _by_chance(c1: int, c: int, share: float) -> float:
    """Natural log of an upper bound on P(at least c1 of c are toxic), by Chernoff."""
    q = c1 / c
    if q <= share:
        return 0.0
    return -c * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


def unlike(texts: list[bytes | None]) -> np.ndarray:
    """Mask of the texts that share no low hash of three-word shingles with an earlier one: copies count once."""
    cache, seen, out = WordHashes(), set(), np.ones(len(texts), bool)
    for i, text in enumerate(texts):
        lows = set(shingle_set(text, 3, cache)[:LOW_HASHES].tolist())
        out[i] = seen.isdisjoint(lows)
        seen |= lows
    return out


def learn_lexicon(texts: list[bytes | None], toxic: np.ndarray) -> Lexicon:
    """Word beginnings and words that mark toxic texts.

    A key is kept if its documents are toxic beyond what chance gives to any of
    the keys tried. Of beginnings, the shortest that is kept covers the longer,
    and is then drawn out as far as its documents stay the same.
    """
    single = unlike(texts)
    texts, toxic = [t for t, k in zip(texts, single) if k], toxic[single]
    df, mass = [Counter(), Counter()], [1, 1]
    for text, y in zip(texts, toxic):
        seen = set(words_of((text or b"").decode("utf-8", "replace")))
        keys = {"=" + w for w in seen}
        keys.update(w[:n] for w in seen for n in STEMS if len(w) >= n)
        df[int(y)].update(keys)
        mass[int(y)] += len(seen)
    share = max(mass[1] / sum(mass), float(toxic.mean()))
    tried = {k: c for k, c in df[1].items() if c >= MIN_TOXIC_DOCS}
    limit = math.log(FALSE_KEYS / max(1, len(tried)))
    odds = lambda k: math.log((df[1][k] + 0.1) / (df[0][k] + 0.1) * (1 - share) / share)
    good = {k: odds(k) for k, c in tried.items() if _by_chance(c, c + df[0][k], share) < limit}
    good = {k: o for k, o in good.items() if o >= MIN_LOG_ODDS}
    whole = {k[1:]: o for k, o in good.items() if k[0] == "="}
    stems: dict[str, float] = {}
    for k in sorted((k for k in good if k[0] != "="), key=len):
        if any(k[:n] in stems for n in STEMS if n < len(k)):
            continue
        grown = k
        while longer := next((x for x in tried if len(x) == len(grown) + 1 and x.startswith(grown) and df[1][x] >= 0.98 * df[1][k]), None):
            grown = longer
        stems[grown] = good.get(grown, good[k])
        for n in range(len(k), len(grown)):
            stems.setdefault(grown[:n], 0.0)  # passed on the way, not accepted
    full = lambda keys: {k: min(1.0, o / FULL_ODDS) for k, o in keys.items() if o}
    return Lexicon(full(stems), full(whole))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (last: bias) by Newton's method, classes weighed equally."""
    a = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta = np.zeros(a.shape[1])
    keep = np.full(a.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        g = a.T @ (share * (p - y)) + keep * theta
        h = (a * (share * p * (1 - p))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, g)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit_positive(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """fit_logistic, without the features whose weights would be negative: more of a match never lowers a score."""
    use = np.arange(x.shape[1])
    while True:
        theta = fit_logistic(x[:, use], y)
        if (theta[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = theta[:-1], theta[-1]
            return out
        use = np.delete(use, theta[:-1].argmin())


def _train(batches):
    texts, labels = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        texts += utf8(batch.column(1))
    y = np.array(labels, np.int8)
    model = None
    if (y == 1).any() and (y == 0).any():
        # the lexicon learns from one half and is weighed on the other, so that chance matches get their true worth
        odd = np.arange(len(y)) % 2 == 1
        pick = lambda m: [t for t, k in zip(texts, m) if k]
        whole = learn_lexicon(texts, y)
        if all((y[m] == c).any() for m in (odd, ~odd) for c in (0, 1)):
            half, other = learn_lexicon(pick(odd), y[odd]), learn_lexicon(pick(~odd), y[~odd])
            x = np.concatenate([np.stack([evaluate(t, half) for t in pick(~odd)]), np.stack([evaluate(t, other) for t in pick(odd)])])
            theta = fit_positive(x, np.concatenate([y[~odd], y[odd]]))
        else:
            theta = fit_positive(np.stack([evaluate(t, whole) for t in texts]), y)
        model = {"stems": whole.stems, "whole": whole.whole, "theta": theta}
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> dict | None:
    """Fit on a bounded sample of labelled docs (doc_id, text), none of them held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "toxic").distinct()
    ids = sample_ids(usable.where("toxic = 1"), ["toxic"], toxic).unionByName(sample_ids(usable.where("toxic = 0"), ["toxic"], clean))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARN_BYTES)
    texts = short.join(F.broadcast(ids), "doc_id").select("toxic", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = texts.repartition(1).sortWithinPartitions("h").limit(2 * (toxic + clean)).select("toxic", "text")
    found = rows.mapInArrow(_train, "model binary").collect()
    return pickle.loads(zlib.decompress(bytes(found[0]["model"]))) if found else None


def _scoring(model: dict | None, at: int, threshold: float):
    def run(batches):
        lexicon = Lexicon(model["stems"], model["whole"]) if model else None
        for batch in batches:
            if model is None:
                scores = np.zeros(batch.num_rows)
            else:
                theta = model["theta"]
                scores = np.array([float(evaluate(t, lexicon) @ theta[:-1] + theta[-1]) for t in utf8(batch.column(at))])
                scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            said = (scores >= threshold).astype(np.int32)
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores), pa.array(said)], [*names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without text_col, with score and predicted, which replace columns of these names."""
    docs = docs.drop(*({"score", "predicted"} - {text_col}))
    schema = docs.drop(text_col).select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.mapInArrow(_scoring(model, docs.columns.index(text_col), threshold), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
