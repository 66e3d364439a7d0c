"""Held-out accuracy of the learned operators, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import quality, toxicity

DOC, LABEL = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "evening", "light", "under", "Marta", "said", "not"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        text = prose(rng, rng.randrange(20, 200))
        if not good:
            words = text.split()
            text = rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words), " ".join([words[0]] * len(words))])
        if toxic:
            words = text.split(" ")
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "Scum", "blörg" + rng.choice(["en", "ig", "est", "haft"])]))
            text = " ".join(words)
        docs.append((i, text, "clash"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1)
    return spark.createDataFrame(docs + [(None, "x", None), (5000, None, None), (5001, "", None), (5002, "word " * 30_000, None)], DOC), spark.createDataFrame(labels + [(None, 1, 1), (7000, None, None)], LABEL), labels


def held_out_accuracy(rows, labels, folds, held, threshold):
    truth = [(rows[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % folds == held]
    return np.mean([(s >= threshold) == bool(y) for s, y in truth])


def test_quality(spark, tables):
    docs, labels, known = tables
    model = quality.train(docs, labels)
    assert 0.5 <= model["prior"] <= 0.9
    got = quality.score(docs.select("doc_id", "text"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert held_out_accuracy({r.doc_id: r.score for r in got}, [(i, q) for i, q, _ in known], 5, 0, 0.3) >= 0.93


def test_toxicity(spark, tables):
    docs, labels, known = tables
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert held_out_accuracy({r.doc_id: r.score for r in got}, [(i, t) for i, _, t in known], 3, 1, 0.7) >= 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[5000] == by[5001] < 0.7


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels, known = tables
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in known], LABEL)
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a["w"], b["w"]) and a["prior"] == b["prior"]
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a["stems"] == b["stems"] and np.array_equal(a["theta"], b["theta"])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", "c")], DOC)
    none = spark.createDataFrame([], LABEL)
    assert [r.score for r in quality.score(docs.select("doc_id", "text"), quality.train(docs, none)).collect()] == [0.5]
    assert [r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, none)).collect()] == [0.0]
    assert quality.score(docs.select("doc_id", "text").where("false"), None).collect() == []
    assert toxicity.score(docs.select("doc_id", "text").where("false"), None).collect() == []


def test_non_negative_risk_beats_the_plain_classifier():
    rng = np.random.default_rng(0)
    p = rng.normal(1, 1, (400, 5)).astype(np.float32)
    u = np.vstack([rng.normal(1, 1, (320, 5)), rng.normal(-1, 1, (80, 5))]).astype(np.float32)
    model = quality.fit(p, u, 0.8)
    said = model.margin(u) > 0
    assert (said[:320].mean() + (1 - said[320:].mean())) / 2 > 0.9
    assert abs(quality.estimate_prior(p, u) - 0.8) < 0.15
