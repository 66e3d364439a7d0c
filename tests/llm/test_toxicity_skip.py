"""The skip of texts without a match drops none that the grammar matches."""

import random

import numpy as np

from palimpsest.llm import toxicity
from palimpsest.llm.grammar import Lexicon, clauses, normalized, tokens

KEYS = ["idiot", "qu", "don", "غبي", "म", "блин", "dürr"]


def test_features_are_those_of_the_whole_grammar():
    lexicon = Lexicon({}, dict.fromkeys(KEYS, 0.5))
    rng = random.Random(2)
    signs = [" ", "، ", "؟", "।", "ू", "’", "'", "'t ", ", ", "—", "×", "1", "_", "。", "ʰ", "\U00010100"]
    texts = [k + s + w for k in KEYS for s in signs for w in ("x", "यह", "")]
    texts += ["".join(rng.choice(KEYS + ["good", "Töten", "kill", "You", "ÀÉ", "İ", "ẞ", "l'idiot", "don't"]) + rng.choice(signs) for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    for text in texts:
        found = tokens(normalized(text))
        want = toxicity.features(clauses(found, lexicon), sum(t[0].isalpha() for t in found))
        assert np.array_equal(toxicity.evaluate(text.encode(), lexicon), want), text


def test_score_of_a_key_with_an_elision(spark):
    theta = np.concatenate([np.full(toxicity.FEATURES, 4.0), [-2.0]])
    model = {"stems": {}, "whole": {"idiot": 0.5, "غبي": 0.5}, "theta": theta}
    rows = [(1, "voici l'idiot du village", 0.5, 9), (2, "انت غبي، نعم", None, 9), (3, "le village", 1.0, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int")
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    assert {r.doc_id: r.predicted for r in got.collect()} == {1: 1, 2: 1, 3: 0}
