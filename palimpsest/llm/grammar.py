"""Finite-state transducers, their composition, and the pattern grammar made of them.

A transducer reads a symbol, changes its state and writes a symbol; what it has no
rule for passes unchanged. The composition of two reads what the first reads and
writes what the second writes on what the first wrote; it is built over the pairs
of states that can be reached.

The grammar composes four transducers over the symbols of a text's words and signs:

* REPORT marks insults and harms (") after a verb of saying, to the end of the
  clause or the quotation that follows it, and within quotation marks, which may
  span clauses and end at the closing mark or the end of the line;
* NEGATION marks insults and harms (-) in the REACH words after a negator;
* TARGET marks the end of a clause (+) in which someone is addressed;
* THREAT marks the end of such a clause (!) if it has a verb of harm, with the
  verb's own marks.

A fifth, of insults, goes before them: over the letters of a word, an acceptor of
word beginnings and whole words that gives a weight (class Lexicon).
"""

from __future__ import annotations

import re

# Closed word classes of English, German, French and Spanish.
TARGETS = "you your yours yourself du dich dir dein deine ihr euch euer tu toi ton ta vous votre vos ti tus usted ustedes".split()
NEGATORS = "not no never nobody nothing nicht kein keine niemals nie pas jamais aucun nunca jamás ningún".split()
REPORTERS = "said says wrote writes called calls quoted claimed sagte sagt schrieb nannte dit dirait écrivit appelé dijo dice escribió llamó".split()
HARMS = "kill hurt destroy shoot stab beat burn töten umbringen schlagen verletzen tuer frapper détruire blesser matar golpear destruir herir".split()

#: Words after a negator that it reaches.
REACH = 3
KINDS = {w: k for k, ws in (("target", TARGETS), ("negator", NEGATORS), ("reporter", REPORTERS), ("harm", HARMS)) for w in ws}
KINDS |= dict.fromkeys(".!?;", "end") | {"\n": "line"} | dict.fromkeys("«„", "open") | dict.fromkeys("»”", "close") | dict.fromkeys('"“', "quote")
SYMBOLS = ["word", "insult", "harm", "target", "negator", "reporter", "open", "close", "quote", "end", "line"]
MARKED = ["insult", "harm"]


class Transducer:
    """rules: (state, symbol) -> (state, symbol written)."""

    def __init__(self, start, rules: dict):
        self.start, self.rules = start, rules

    def step(self, state, symbol: str):
        return self.rules.get((state, symbol), (state, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, written = self.step(state, s)
            out.append(written)
        return out


def compose(first: Transducer, second: Transducer, symbols: list[str] = SYMBOLS) -> Transducer:
    """The transducer that writes what `second` writes on what `first` writes; its states are numbered from 0."""
    number = {(first.start, second.start): 0}
    rules, todo = {}, [(first.start, second.start)]
    while todo:
        pair = todo.pop()
        for s in symbols:
            left, between = first.step(pair[0], s)
            right, written = second.step(pair[1], between)
            if (left, right) not in number:
                number[left, right] = len(number)
                todo.append((left, right))
            rules[number[pair], s] = number[left, right], written
    return Transducer(0, rules)


def _report() -> Transducer:
    rules = {("free", "reporter"): ("said", "reporter"), ("said", "end"): ("free", "end"), ("said", "line"): ("free", "line"), ("quoted", "line"): ("free", "line")}
    for state in ("free", "said"):
        rules |= {(state, sign): ("quoted", sign) for sign in ("open", "quote")}
    rules |= {("quoted", sign): ("free", sign) for sign in ("close", "quote")}
    return Transducer("free", rules | {(state, s): (state, s + '"') for state in ("said", "quoted") for s in MARKED})


def _negation() -> Transducer:
    rules = {}
    for left in range(REACH + 1):
        rules |= {(left, "negator"): (REACH, "negator"), (left, "end"): (0, "end"), (left, "line"): (0, "line")}
        if left:
            rules |= {(left, s): (left - 1, s) for s in ("word", "target", "reporter")}
            rules |= {(left, s + mark): (left - 1, s + mark + "-") for s in MARKED for mark in ("", '"')}
    return Transducer(0, rules)


def _target() -> Transducer:
    rules = {("none", "target"): ("aimed", "target"), ("none", "line"): ("none", "end")}
    return Transducer("none", rules | {("aimed", s): ("none", "end+") for s in ("end", "line")})


def _threat() -> Transducer:
    marks = ("", '"', "-", '"-')
    rules = {(("harm" + m), "end"): ("calm", "end") for m in marks} | {("harm" + m, "end+"): ("calm", "end+!" + m) for m in marks}
    rules |= {("calm", "harm" + m): ("harm" + m, "harm" + m) for m in marks}
    return Transducer("calm", rules | {("harm" + m, "harm"): ("harm", "harm") for m in marks[1:]})  # an unmarked verb counts before a marked one


REPORT, NEGATION, TARGET, THREAT = _report(), _negation(), _target(), _threat()
GRAMMAR = compose(compose(compose(REPORT, NEGATION), TARGET), THREAT)

_TOKEN = re.compile("[^\\W\\d_]+|[.!?;\n\"“”«»„]")


def normalized(text: str) -> str:
    """Lower case; "n't" is a word of its own, and so is the person that French elides before a verb."""
    text = text.lower()
    if "’" in text:
        text = text.replace("’", "'")
    if "'" in text:
        text = text.replace("n't", " not")
        if "t'" in text:
            text = _ELIDED.sub("toi ", text)
    return text


_ELIDED = re.compile(r"(?<![^\W\d_])t'(?=[^\W\d_])")


def tokens(text: str) -> list[str]:
    """Words and signs of a normalised text; an apostrophe parts words, so that what French elides stands alone."""
    return _TOKEN.findall(text)


class Lexicon:
    """Word beginnings and whole words with weights; the longest that fits counts."""

    def __init__(self, stems: dict[str, float], whole: dict[str, float]):
        self.stems, self.whole = stems, whole
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.cache.get(word)
        if w is None:
            w = self.whole.get(word, 0.0)
            if not w:
                w = next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), 0.0)
            if len(self.cache) > 500_000:
                self.cache.clear()
            self.cache[word] = w
        return w


#: What a match counts by its marks, in a clause that addresses nobody; an address raises it by AIMED. A threat
#: counts as THREAT_WEIGHT, by its verb's marks.
STRENGTH = {"": 0.6, '"': 0.08, "-": 0.05, '"-': 0.03}
AIMED, THREAT_WEIGHT = 1.6, 1.0


def clauses(found: list[str], lexicon: Lexicon) -> list[float]:
    """Scores (0 to 1) of the clauses with a match, from the tokens of a text."""
    out, rest, state = [], 1.0, GRAMMAR.start
    pending: list[float] = []
    step, weight = GRAMMAR.rules, lexicon.weight
    for token in [*found, "\n"]:
        kind, w = KINDS.get(token), 0.0
        if kind is None:
            w = weight(token)
            kind = "insult" if w else "word"
        state, written = step[state, kind]
        if w:
            pending.append(w * STRENGTH[written[6:]])
        elif written[:3] == "end":
            aim = AIMED if written[3:4] == "+" else 1.0
            rest = 1.0
            for p in pending:
                rest *= 1.0 - min(1.0, p * aim)
            if written[4:5] == "!":
                rest *= 1.0 - min(1.0, THREAT_WEIGHT * STRENGTH[written[5:]] * AIMED)
            if rest < 1.0:
                out.append(1.0 - rest)
            pending = []
    return out
