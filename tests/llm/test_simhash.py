"""SimHash fingerprints, tries and components against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash

from terralocus.llm import simhash
from terralocus.llm.components import components, forest


def plain_fingerprint(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def roots(values, links):
    """Smallest value reachable over `links`."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def close_pairs(fps, budget):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= budget]


TEXTS = [None, "", "  \n", "One", "one", "one two", "ONE  two\tthree", "one two three", "a\x1cb c d", "É e é", "x " * 9_000, "ünï códe   nbsp", "w" * 70_000]


@pytest.mark.parametrize("size", [3, 5])
def test_fingerprints(size, monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", 10)
    random.seed(1)
    more = [" ".join(random.choices(["ab", "C", "d\x0b", "é"], k=random.randrange(60))) for _ in range(60)]
    for text in TEXTS + more:
        assert simhash.fingerprint(text or "", size) & (2 ** 64 - 1) == plain_fingerprint(text, size)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(n, seed):
    random.seed(seed)
    base = [random.getrandbits(64) for _ in range(max(n // 12, 1))]
    out = {0, signed(1 << 63), -1}
    while len(out) < n:
        x = random.choice(base)
        for b in random.sample(range(64), random.randrange(5)):
            x ^= 1 << b
        out.add(signed(x))
    return sorted(out)


@pytest.mark.parametrize("budget,hot", [(3, simhash.HOT), (3, 5), (1, 3), (0, simhash.HOT), (7, 4)])
def test_links_connect_all_within_the_budget(spark, monkeypatch, budget, hot):
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    monkeypatch.setattr(simhash, "FOREST", 40)
    fps = clustered(300, budget)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), budget, hot).collect()
    assert all(((r.a ^ r.b) & (2 ** 64 - 1)).bit_count() <= budget * 64 for r in found)
    assert roots(fps, [(r.a, r.b) for r in found]) == roots(fps, close_pairs(fps, budget))


def test_a_third_of_the_fingerprints_share_blocks(spark):
    random.seed(4)
    hot = sorted({signed((0xABCD1234ABCD << 16) | random.getrandbits(16)) for _ in range(150)} | set(clustered(200, 8)))
    frame = spark.createDataFrame([(f,) for f in hot], "fp bigint")
    want = roots(hot, close_pairs(hot, 3))
    for limit in (10, simhash.HOT):
        assert roots(hot, [(r.a, r.b) for r in simhash.links(frame, 3, limit).collect()]) == want


def test_components_of_long_chains_and_stars(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(0, 90)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (-3, 2000), (2000, 1999)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != 5000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest():
    random.seed(3)
    a, b = np.array([random.randrange(200) for _ in range(150)]), np.array([random.randrange(200) for _ in range(150)])
    assert dict(enumerate(forest(200, a, b).tolist())) == roots(range(200), list(zip(a.tolist(), b.tolist())))


def test_whole_operator(spark):
    random.seed(6)
    long = " ".join(random.choices(["alpha", "beta", "gamma", "delta", "eps"], k=400))
    texts = TEXTS + [long, long + " end", long.upper(), "start " + long] * 5
    rows = [(i if i != 1 else None, t, 7, "x", i) for i, t in enumerate(texts)] + [(3, "One", 7, "x", 1), (None, "lonely text here", 7, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, row string, uid int").repartition(4)
    fps = [signed(plain_fingerprint(r[1])) for r in rows]
    root = roots(set(fps), close_pairs(sorted(set(fps)), 3))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted(((r[0], f"{f & (2 ** 64 - 1):016x}", least.get(root[f])) for r, f in zip(rows, fps)), key=repr)
    assert sorted((tuple(r) for r in simhash.judged(frame).collect()), key=repr) == want
    assert simhash.judged(frame.limit(0)).count() == 0


def test_rows_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    root = roots(set(fps.values()), close_pairs(sorted(set(fps.values())), 3))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.judged(docs).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}
