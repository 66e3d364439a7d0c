"""The pipeline's stages, one on another, against plain versions; run() against the chain."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from palimpsest.llm import quality, sharding

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def split_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())


def plain_near_dedup(texts):
    """Ids that stay: the smallest of each group linked at 80 percent of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = split_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    common = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    name = {i: i for i in sets}
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n) and name[a] != name[b]:
            low, high = sorted((name[a], name[b]))
            name = {i: low if c == high else c for i, c in name.items()}
    return {i for i, c in name.items() if i == c}


def item_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_clean(texts, items):
    """Ids of texts of which less than a twentieth of the words lies in windows of items."""
    windows = {tuple(w[k : k + 13]) for w in map(item_words, items) if w for k in range(max(1, len(w) - 12))}
    lengths = {len(w) for w in windows}
    out = set()
    for i, t in texts.items():
        w = item_words(t)
        hit = {p for n in lengths for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            out.add(i)
    return out


def plain_rates(size, source):
    """Copies that each source is to get: its capped share of all words by its size."""
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, free = {}, {s for s in total if total[s]}
    while free:
        rest, by = sum(total.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / by > 3 * total[s]}
        target |= {s: 3 * total[s] if over else rest * weight[s] / by for s in (over or free)}
        free = free - over if over else set()
    return {s: target.get(s, 0) / total[s] if total[s] else 0 for s in total}


def plain_shards(rows, limit, bits=""):
    """(id, bytes) rows -> shard of each id, by splitting what is too large on one more bit."""
    key = lambda i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b")
    if sum(n for _, n in rows) <= limit:
        return {i: "0:" + bits for i, _ in rows}
    return {i: s for b in "01" for i, s in plain_shards([(i, n) for i, n in rows if key(i).startswith(bits + b)], limit, bits + b).items()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest tables with planted copies and passages added to them."""
    root = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows, passages = docs.collect(), [r.text for r in items.collect()]
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bases = [r for r in rows if r.doc_id in good and len(r.text.split()) >= 100][:6]
    assert len(bases) == 6
    at, planted = 1_000_000, []
    for r, other in zip(bases, [*bases[1:], bases[0]]):
        words, strange = r.text.split()[:100], other.text.split()
        for changed in ((), (50,), (30, 60), (20, 50, 80)):  # the last is below 0.8
            planted.append((at, " ".join(strange[k] if k in changed else w for k, w in enumerate(words)), r.lang, r.source, 0))
            at += 1
    for n, passage in enumerate(passages[:4]):
        planted.append((at + n, " ".join([*bases[n].text.split()[10:60], passage, *bases[n].text.split()[60:90]]), bases[n].lang, bases[n].source, 0))
    named = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*named).unionByName(spark.createDataFrame(planted, named)).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    return root, passages


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    root, passages = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")

    def after(name, before):
        out = STAGES[name](spark, before, root)
        if name != "shard":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model).collect()
    kept = after("quality", docs)
    left = texts(kept)
    assert kept.count() == len(left) and set(left) == {r.doc_id for r in scored if r.predicted == 1}
    planted = {i for i in left if i >= 1_000_000}
    assert len(planted) >= 20

    kept = after("near_dedup", kept)
    expected = plain_near_dedup(left)
    assert len(expected) < len(left) and set(texts(kept)) == expected and kept.count() == len(expected)
    assert len({i for i in expected if i >= 1_000_000}) < len(planted)

    left = texts(kept)
    kept = after("decontaminate", kept)
    expected = plain_clean(left, passages)
    assert len(expected) < len(left) and set(texts(kept)) == expected and kept.count() == len(expected)

    left, source = texts(kept), {r.doc_id: r.source for r in kept.collect()}
    size = {i: len(split_words(t)) for i, t in left.items()}
    rates = plain_rates(size, source)
    mixed = after("mix", kept)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert {(r.doc_id, r.text, r.source) for r in mixed.collect()} <= {(i, left[i], source[i]) for i in left}
    for i in left:
        assert math.floor(rates[source[i]] + 1e-9) <= copies[i] <= math.ceil(rates[source[i]] - 1e-9) <= 3
    for s, rate in rates.items():
        own = [i for i in left if source[i] == s]
        assert abs(sum((copies[i] - rate) * size[i] for i in own)) < max(size[i] for i in own) + 1e-6

    sizes = [(r.doc_id, len((r.text or "").encode())) for r in mixed.collect()]
    for limit, out in ((sharding.LIMIT_BYTES, after("shard", mixed)), (2 * max(n * copies[i] for i, n in sizes), None)):
        out = (sharding.assign_shards(mixed, limit_bytes=limit) if out is None else out).collect()
        expected = plain_shards(sizes, limit)
        assert Counter((r.doc_id, r.shard) for r in out) == Counter((i, expected[i]) for i, _ in sizes)
        held = Counter()
        for i, n in sizes:
            held[expected[i]] += n
        assert {(r.shard, r.shard_bytes) for r in out} == set(held.items())
    assert len(held) > 2


def test_run_is_the_chain(spark, corpus):
    root, _ = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    key = lambda df: Counter((r.doc_id, r.text, r.shard) for r in df.collect())
    assert key(corpus_pipeline.run(spark, root)) == key(docs)
