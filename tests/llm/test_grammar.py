"""The composed transducers against definitions that look at whole clauses."""

import random

import pytest

from palimpsest.llm import grammar, toxicity
from palimpsest.llm.grammar import GRAMMAR, HARMS, KINDS, NEGATION, NEGATORS, REACH, REPORT, REPORTERS, STRENGTH, SYMBOLS, TARGET, TARGETS, THREAT, Lexicon, clauses, normalized, tokens

LEXICON = Lexicon({"blörg": 0.5}, {"moron": 1.0, "idiot": 0.9})


def score(text):
    return clauses(tokens(normalized(text)), LEXICON)


def reported_at(found):
    """For each token: whether a quotation is open, or a verb of saying stands before it in the clause with no quotation since."""
    out, quoted, said = [], False, False
    for t in found:
        kind = KINDS.get(t)
        out.append(quoted or said)
        if kind == "quote":
            quoted, said = not quoted, False
        elif kind == "open":
            quoted, said = True, False
        elif kind == "close":
            said = said and not quoted
            quoted = False
        elif kind == "line":
            quoted = said = False
        elif kind == "end":
            said = False
        elif kind == "reporter":
            said = not quoted
    return out


def brute(text):
    found = tokens(normalized(text))
    reported, out, start = reported_at(found), [], 0
    for end in [*(k for k, t in enumerate(found) if KINDS.get(t) in ("end", "line")), len(found)]:
        clause = range(start, end)
        words = [k for k in clause if KINDS.get(found[k]) not in ("open", "close", "quote")]
        aimed = any(found[k] in TARGETS for k in words)
        mark = lambda k: '"' * reported[k] + "-" * any(found[w] in NEGATORS for w in words[max(0, words.index(k) - REACH) : words.index(k)])  # noqa: B023, E731
        clean = 1.0
        for k in words:
            if found[k] not in KINDS and LEXICON.weight(found[k]):
                clean *= 1 - min(1.0, LEXICON.weight(found[k]) * STRENGTH[mark(k)] * (grammar.AIMED if aimed else 1.0))
        harms = [mark(k) for k in words if found[k] in HARMS]
        if aimed and harms:
            clean *= 1 - min(1.0, grammar.THREAT_WEIGHT * STRENGTH["" if "" in harms else harms[0]] * grammar.AIMED)
        if clean < 1:
            out.append(1 - clean)
        start = end + 1
    return out


def test_equals_brute_force():
    rng = random.Random(6)
    words = ["moron", "idiot", "blörgest", "river", "the", "and", *rng.sample(TARGETS, 5), *rng.sample(NEGATORS, 5), *rng.sample(REPORTERS, 5), *rng.sample(HARMS, 5), "don't", "l'idiot", "t'es"]
    signs = [" "] * 12 + [". ", "! ", "; ", "\n", ' "', '" ', " “", "” ", " «", "» ", " „", ", "]
    n = 0
    for _ in range(6000):
        text = "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(1, 14)))
        want = brute(text)
        assert score(text) == pytest.approx(want), text
        n += len(want)
    assert n > 5000


def test_composition_is_one_machine_after_another():
    rng = random.Random(1)
    for _ in range(2000):
        tape = rng.choices(SYMBOLS, k=rng.randrange(12))
        assert GRAMMAR.run(tape) == THREAT.run(TARGET.run(NEGATION.run(REPORT.run(tape))))


def test_order_of_clauses():
    one = lambda text: sum(score(text))
    assert one("You are an idiot.") > one("idiot") > one("He said she is an idiot.") > one("She is not an idiot.") > 0
    assert one("I will kill you tonight.") > one("idiot") and one("I will kill time.") == 0
    assert one("I would never kill you") < one("I will kill you") / 5
    assert one("l'idiot") == one("l’idiot") == one("idiot") and one("t'es idiot") == one("tu es idiot") > one("idiot")
    assert one("She isn't an idiot") == one("She is not an idiot")
    assert one('"fine" idiot') == one("idiot") and one('"idiot" fine') < one("idiot")
    assert one("„fein“ idiot") == one("idiot") and one("«idiot") < one("idiot") and one("«idiot\nidiot") > one("idiot")
    assert one("morons and oxymoron") == 0 and one("Blörgest") > 0


def test_more_of_a_match_never_lowers_a_score():
    few, many = toxicity.features([0.6], 200), toxicity.features([0.6, 0.3], 200)
    assert (many >= few).all() and (toxicity.features([], 9) == 0).all()


def test_very_long_text():
    text = ("river stone " * 200_000 + "you idiot").encode()
    assert toxicity.evaluate(text, LEXICON)[0] > 0.8
