"""URL rules, sharding, mixing and decontamination on small tables, with odd rows."""

import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import decontaminate, mixing, sharding, url_filter
from palimpsest.llm.storage import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, copies string, shard string, row string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "c", "s", "r", "k") for i, t, s in rows], DOC)


# --- URL rules

URLS = [
    ("http://a.example.net/en/x", "allow", "example.net/en/"), ("http://A.Example.NET/fr/x?y", "block", "net/"), ("https://example.com/de/", "block", "example.com/de/"), ("https://example.com/de", "allow", None), ("http://x.org/fr/1#z", "allow", "org/fr/"),
    ("http://net/", "block", "net/"), ("http://internet/", "allow", None), ("http://a.net", "allow", None), ("http://a.net?x=/", "allow", None), ("no url", "allow", None), (None, "allow", None), ("", "allow", None), ("://net/x", "block", "net/"), ("http://u@a.net:80/x", "allow", None), ("http://.net/x", "block", "net/"), ("http://a.net/\n", "block", "net/"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, (u, _, _) in enumerate(URLS)] + [(0, URLS[0][0], "again", "x"), (None, URLS[1][0], None, None)], "page_id long, url string, html string, rule string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()
    assert len(got) == len(URLS) + 2
    by = {r.page_id: (r.verdict, r.rule) for r in got}
    assert [by[k] for k in range(len(URLS))] == [(v, rule) for _, v, rule in URLS]
    assert by[None] == ("block", "net/")


def test_url_rules_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, url_filter.rule_table(spark)).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge_urls(one, url_filter.rule_table(spark, ())).collect()] == [(1, "a.net", "/x", None, "allow")]


def test_url_ties_block(spark):
    rules = url_filter.rule_table(spark, (("net", "/ab", "allow"), ("b.net", "/", "allow"), ("net", "/abc", "allow"), ("b.net", "/a", "block")))
    one = spark.createDataFrame([(1, "http://b.net/abc")], "page_id long, url string")
    r = url_filter.judge_urls(one, rules).first()
    assert (r.rule, r.verdict) == ("b.net/a", "block")


# --- sharding


def shards(spark, rows, limit):
    got = sharding.assign_shards(docs_of(spark, rows), limit_bytes=limit).collect()
    assert len(got) == len(rows)
    return got


def test_shards_fit_and_only_oversized_buckets_split(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 50), "s") for i in range(400)] + [(1000, "y" * 900, "s"), (None, "z", "s"), (1001, None, "s"), (1002, "", "s")]
    got = shards(spark, rows, 1000)
    size, members = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + len(r.text or "")
        members.setdefault(r.shard, []).append(r)
    assert max(size.values()) <= 1000
    for name, rs in members.items():
        assert {(r.shard_bytes, r.shard_docs) for r in rs} == {(size[name], len(rs))}
        bits = name.removeprefix("0:")
        if bits:  # its parent was too large
            key = lambda r: int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "null").encode()).hexdigest()[:15], 16)
            parent = sum(len(r.text or "") for r in got if format(key(r), "060b").startswith(bits[:-1]))
            assert parent > 1000
    assert got[0].key == "k" and got[0].copies == "c"


def test_shards_of_one_id_beyond_the_limit(spark):
    got = shards(spark, [(7, "x" * 40, "s")] * 60 + [(8, "y" * 500, "s")] * 2 + [(9, "z", "s")], 300)
    size = {}
    for r in got:
        size.setdefault(r.shard, []).append(len(r.text))
    assert all(sum(v) <= 300 or len(v) == 1 for v in size.values())
    assert sum(map(len, size.values())) == 63


def test_shards_empty(spark):
    assert shards(spark, [], 100) == []


def test_write_shards(spark, tmp_path):
    rows = [(i, "x" * 30, "s") for i in range(50)]
    sharding.write_shards(docs_of(spark, rows), str(tmp_path / "out"), limit_bytes=300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() >= 5


# --- mixing


def brute_targets(sizes, weights):
    """Plain resharing of the excess."""
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed and sizes[i]]
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: 3 * sizes[i] for i in over}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1, 1000], [5, 0, 7, 9000, 3], [10], [0, 0], [2**k for k in range(30)], list(range(1, 700))])
def test_targets(spark, sizes):
    w = [1.0 + i % 3 for i in range(len(sizes))]
    names = [chr(0x61 + i % 26) * (i // 26 + 1) if i < 300 else "é" * (i % 40) + chr(0x1F600 + i) for i in range(len(sizes) - 1)]
    names = [*sorted(names), None]  # in Python, too, text is in order of code points
    rows = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(names, sizes))], "doc_id long, source string, size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(rows, Scratch(spark, "test")).collect()}
    assert [got[n] for n in names] == pytest.approx(brute_targets(sizes, w))


def test_pivot_keeps_mass_and_bounds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 500):
        limit = rng.integers(1, 100, n).astype(float)
        mass = limit * rng.random(n)
        out, held = mixing.pivot(mass, limit, rng.random(n))
        assert out.sum() == pytest.approx(mass.sum())
        free = [i for i in range(n) if 0 < out[i] < limit[i]]
        assert free == ([held] if held >= 0 and 0 < out[held] < limit[held] else [])
        assert ((out >= 0) & (out <= limit)).all()


def test_pivot_is_unbiased():
    rng = np.random.default_rng(2)
    mass, limit = np.array([3.0, 4.0, 1.0, 9.0]), np.array([10.0, 5.0, 4.0, 10.0])
    mean = np.mean([mixing.pivot(mass, limit, rng.random(4))[0] for _ in range(20000)], axis=0)
    assert mean == pytest.approx(mass, abs=0.15)


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "b", "b", None])) for i in range(1500)] + [(9000, None, "a"), (9001, "", "b"), (None, "one two", "a")] + [(9002, "x y z", "c")] * 5
    docs = docs_of(spark, rows)
    sizes = mixing.word_counts(docs)
    run = lambda: sorted((tuple(r) for r in mixing.mix_sizes(sizes, leaf_docs=64, fan_in=4).collect()), key=str)
    got = run()
    assert got == run()
    cols = ["doc_id", "source", "size", "n", "source_size", "target", "copies"]
    plan = [dict(zip(cols, r)) for r in got]
    words = lambda t: len((t or "").split())
    by = {}
    for _, t, s in rows:
        by[s] = by.get(s, 0) + words(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([by[s] for s in order], [1.0 + i % 3 for i in range(len(order))])))
    for s in by:
        own = [p for p in plan if p["source"] == s]
        assert {p["source_size"] for p in own} == {by[s]} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(p["copies"] * p["size"] * p["n"] for p in own) - want[s]) <= 40
        assert all(0 <= p["copies"] <= 3 for p in own)
    assert sum(p["n"] for p in plan) == len(rows)
    mixed = mixing.mix_documents(docs, leaf_docs=64, fan_in=4)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(p["copies"] * p["n"] for p in plan)


def test_expected_copies(spark):
    """Over many seeds, a document's mean copies are its source's target over its size, whatever the document."""
    rows = [(i, "s" if i % 3 else "t", 1 + i % 7) for i in range(60)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    runs = [{r.doc_id: (r.copies, r.target / r.source_size, r.source, r.size) for r in mixing.mix_sizes(sizes, seed=k, leaf_docs=8, fan_in=2).collect()} for k in range(12)]
    for source in "st":
        own = [i for i, s, _ in rows if s == source]
        rate = runs[0][own[0]][1]
        assert abs(sum(run[i][0] for run in runs for i in own) / (len(runs) * len(own)) - rate) < 0.12
        assert all(run[i][0] in (int(rate), int(rate) + 1) for run in runs for i in own)
        # draws tie on nothing but the document: equal sizes don't get equal copies
        assert len({tuple(run[i][0] for run in runs) for i in own if rows[i][2] == 3}) > 1


def test_mix_empty(spark):
    assert mixing.mix_sizes(mixing.word_counts(docs_of(spark, []))).collect() == []


# --- decontamination


def plain_words(t):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_found(docs, items, width=13):
    out = {}
    for i, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for item, text in items:
            p = plain_words(text)
            m = min(width, len(p))
            if item is None or not m:
                continue
            windows = {tuple(p[s : s + m]) for s in range(len(p) - m + 1)}
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    ids.add(str(item))
        listed = ",".join(sorted(ids))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 400])
def test_decontamination(spark, chunk_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ab", "c", "dé", "é-f", "g7", "H", "ii", "j_k"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 12, 13, 14, 40])))) for k in range(30)] + [(30, None), (31, " .. "), (None, "c c c"), (5, "H ii g7 c"), (100, "é")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    for i in range(60, 100):
        p = plain_words(rng.choice(items)[1])
        a = rng.randrange(max(1, len(p) - 12))
        docs.append((i, " ".join([word() for _ in range(rng.randrange(40))] + [x.upper() for x in p[a : a + 20]] + [word() for _ in range(rng.randrange(300))])))
    docs += [(200, None), (201, ""), (202, "!!")]
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lang string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(decontaminate.search_benchmark(table, bench, chunk_bytes=chunk_bytes))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()}
    assert got == brute_found(docs, items)


def test_decontamination_empty(spark):
    table = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.judge(decontaminate.search_benchmark(table, none)).collect()] == [0]
    assert decontaminate.search_benchmark(table.where("false"), none).collect() == []


def test_url_rules_of_one_short_prefix(spark):
    """With a short prefix of one digit, rules and expressions share prefixes; the full digest tells them apart."""
    rules = [(f"h{k}.net", f"/{k % 3}", "block" if k % 2 else "allow") for k in range(60)] + [("net", "/", "allow"), ("h1.net", "/1", "block")]
    pages = spark.createDataFrame([(k, f"http://a.h{k}.net/{k % 3}{k}") for k in range(90)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), prefix_digits=1).collect()}
    assert got == {k: (f"h{k}.net/{k % 3}", "block" if k % 2 else "allow") if k < 60 else ("net/", "allow") for k in range(90)}


def test_url_join_is_on_the_short_prefix(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    judged = url_filter.judge_urls(pages, url_filter.rule_table(spark))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line or "MergeJoin" in line]
    assert len(joins) == 1 and "[short#" in joins[0] and "digest" not in joins[0] and "Python" not in plan
