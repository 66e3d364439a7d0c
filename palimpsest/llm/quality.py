"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled sample is web
text drawn without labels. The class prior is estimated by best-bin estimation:
a first classifier tells positives from unlabelled text, and the prior is the
least ratio, with a confidence margin, of the shares of unlabelled and of
positive text that score above a cut. The second classifier minimises the
non-negative unbiased risk: pi R_p+ + max(0, R_u- - pi R_p-), with logistic loss.

Features are of the whole text: frequencies of byte classes and of their pairs,
and a few ratios of words and lines. Both samples are bounded (POSITIVES and
UNLABELLED rows); the task that fits the model gets their features, not their texts.

Defined results: a null or empty text scores as a text without any feature. A
null id is not held out and is never a training row. Repeated rows each get a
row; extra columns stay out of the score, and those named score or predicted are
replaced. Where no positives are there to learn
from, every score is 0.5.
"""

from __future__ import annotations

import pickle
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import fold, sample_ids
from .storage import table
from .textkit import utf8

FOLDS, HELD_OUT = 5, 0
POSITIVES, UNLABELLED = 5000, 5000
THRESHOLD = 0.3
SEED = 11

#: Byte classes: one for each kind of ASCII sign that is common in markup or junk, the rest together.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", ";:", "'\"`", "()", "[]{}", "<>", "|", "#", "$", "%", "&", "*", "@", "/\\", "-_", "=+~^"]
CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, CLASSES - 2, np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _k
_CLASS[128:] = CLASSES - 1
_TABLE = _CLASS.tobytes()
RATIOS = 7
WIDTH = CLASSES + CLASSES * CLASSES + RATIOS


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    kinds = np.frombuffer(text.translate(_TABLE), np.uint8)
    n = len(kinds)
    out[:CLASSES] = np.sqrt(np.bincount(kinds, minlength=CLASSES) / n)
    if n > 1:
        pairs = kinds[:-1].astype(np.int16) * CLASSES + kinds[1:]
        out[CLASSES : CLASSES + CLASSES * CLASSES] = np.sqrt(np.bincount(pairs, minlength=CLASSES * CLASSES) / (n - 1))
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    out[-RATIOS:] = (sum(map(eq, words, words[1:])) / w, len(set(words)) / w, len(set(lines)) / len(lines), min(n / w, 40) / 20, np.log1p(n) / 12, np.log1p(n / len(lines)) / 12, np.log1p(len(words)) / 10)
    return out


class Standardised:
    """A linear score of standardised features."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        self.w, self.b = np.zeros(x.shape[1], np.float32), 0.0

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.w + self.b


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(m, -30, 30)))


def fit(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 40, rate: float = 0.02, decay: float = 1e-3, seed: int = SEED) -> Standardised:
    """Logistic loss; with a prior the non-negative PU risk, without one plain positive against unlabelled."""
    model = Standardised(np.vstack([p, u]))
    zp, zu, rng = model.z(p), model.z(u), np.random.default_rng(seed)
    m, v, t = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), 0
    theta = np.zeros(p.shape[1] + 1)
    steps = max(1, max(len(zp), len(zu)) // 256)
    for _ in range(epochs):
        ip, iu = rng.permutation(len(zp)), rng.permutation(len(zu))
        for s in range(steps):
            xp, xu = zp[ip[s::steps]], zu[iu[s::steps]]
            if not len(xp) or not len(xu):
                continue
            gp, gu = _sigmoid(xp @ theta[:-1] + theta[-1]), _sigmoid(xu @ theta[:-1] + theta[-1])
            if prior is None:
                cp, cu = (gp - 1) / len(xp), gu / len(xu)
            else:
                loss = lambda g: -np.log(np.clip(1 - g, 1e-9, 1)).mean()
                if loss(gu) - prior * loss(gp) >= 0:
                    cp, cu = prior * (gp - 1) / len(xp) - prior * gp / len(xp), gu / len(xu)
                else:  # the negative part is below 0: step back on it alone
                    cp, cu = prior * gp / len(xp), -gu / len(xu)
            g = np.append(xp.T @ cp + xu.T @ cu, cp.sum() + cu.sum())
            g[:-1] += decay * theta[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.w, model.b = theta[:-1].astype(np.float32), float(theta[-1])
    return model


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = SEED) -> float:
    """Best-bin estimate of the share of positives in u; half of each sample fits, half is measured."""
    half = lambda x: (x[::2], x[1::2])
    (p0, p1), (u0, u1) = half(p), half(u)
    model = fit(p0, u0, None, epochs=15, seed=seed)
    sp, su = model.margin(p1), model.margin(u1)
    best, least = (1.0, np.inf)
    for cut in np.quantile(sp, np.linspace(0, 0.95, 96)):
        qp, qu = (sp >= cut).mean(), (su >= cut).mean()
        bound = (qu + np.sqrt(np.log(40) / (2 * len(su)))) / qp + np.sqrt(np.log(40) / (2 * len(sp))) / qp
        if bound < least:
            least, best = bound, qu / qp
    return float(np.clip(best, 0.01, 0.99))


def _described(batches):
    for batch in batches:
        x = [features(t).tobytes() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["kind", "x", "h"])


def _train(batches):
    xs, kinds = [], []
    for batch in batches:
        kinds += batch.column(0).to_pylist()
        xs += [np.frombuffer(x, np.float32) for x in batch.column(1).to_pylist()]
    kinds = np.array(kinds, np.int8)
    x = np.stack(xs) if xs else np.zeros((0, WIDTH), np.float32)
    p, u = x[kinds == 1], x[kinds == 0]
    model = None
    if len(p) >= 2 and len(u) >= 2:
        prior = estimate_prior(p, u)
        fitted = fit(p, u, prior)
        model = {"mean": fitted.mean, "scale": fitted.scale, "w": fitted.w, "b": fitted.b, "prior": prior}
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model))], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """Fit on bounded samples of docs (doc_id, text) and labels (doc_id, quality), none of them held out."""
    usable = lambda df: df.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    trusted = sample_ids(usable(labels).where("quality = 1").select("doc_id").distinct(), [], positives).withColumn("kind", F.lit(1))
    plain = sample_ids(usable(docs), [], unlabelled, seed=13).distinct().withColumn("kind", F.lit(0))
    texts = docs.join(F.broadcast(trusted.unionByName(plain)), "doc_id").select("kind", "text", F.xxhash64("doc_id", "text").alias("h"))
    described = texts.mapInArrow(_described, "kind int, x binary, h long")
    rows = described.repartition(1).sortWithinPartitions("kind", "h").limit(positives + 2 * unlabelled).select("kind", "x")
    found = rows.mapInArrow(_train, "model binary").collect()
    return pickle.loads(zlib.decompress(bytes(found[0]["model"]))) if found else None


def _scoring(model: dict | None, at: int, threshold: float):
    def run(batches):
        for batch in batches:
            texts = utf8(batch.column(at))
            if model is None:
                scores = np.full(len(texts), 0.5)
            else:
                scores = np.empty(len(texts))
                for a in range(0, len(texts), 1024):
                    x = np.stack([features(t) for t in texts[a : a + 1024]])
                    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
                    scores[a : a + 1024] = _sigmoid(z @ model["w"] + model["b"])
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


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("scored_text"))
    return score(kept, model, "scored_text").where("predicted = 1").select("row.*")
