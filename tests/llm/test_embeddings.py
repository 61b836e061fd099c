"""Embedding near-deduplication against all pairs."""

import math

import numpy as np
import pytest

from terralocus.llm import embeddings
from terralocus.llm.tables import table


def plain(rows, cosine=0.93):
    """rows of (vec_id, vector, label) -> sorted (vec_id, n_links, component_id, kept)."""
    units = [embeddings.unit(v) if l is not None else None for _, v, l in rows]
    groups, parent, links = {}, list(range(len(rows))), [0] * len(rows)
    for i, (_, _, l) in enumerate(rows):
        if units[i] is not None:
            groups.setdefault((l, len(units[i])), []).append(i)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for own in groups.values():
        x = np.array([units[i] for i in own])
        near = x @ x.T >= cosine
        for a, i in enumerate(own):
            for b in np.flatnonzero(near[a]):
                if b != a:
                    links[i] += 1
                    parent[find(i)] = find(own[b])
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(least.get(find(i), math.inf), v)
    return sorted(((v, links[i], least.get(find(i)), v == least.get(find(i))) for i, (v, _, _) in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    return sorted((tuple(r) for r in embeddings.judged(frame, **options).collect()), key=repr)


def made(n, seed=1, spread=0.3):
    random = np.random.default_rng(seed)
    base = random.normal(size=(n // 6, 16))
    rows = []
    for i in range(n):
        x = base[i % len(base)] + random.normal(size=16) * spread
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(random.integers(0, 3)) if i % 9 else 0))
    return rows


@pytest.mark.parametrize("slack", [0.5, 1.0])
def test_small_cells_and_blocks_find_all_links(spark, monkeypatch, slack):
    monkeypatch.setattr(embeddings, "CELL", 15)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = made(700)
    want, got = plain(rows), run(spark, rows, slack=slack)
    if slack == 1.0:
        assert got == want
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 0),
            (6, None, 0), (7, [], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0),
            (12, [1e-30, 0.0], 0), (13, [-1.0, -0.0], 0), (14, [-1.0, 0.0], 0), (None, None, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_a_third_of_the_rows_are_one_vector(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "LINKS", 50)
    rows = made(300, seed=5) + [(1000 + i, [1.0] * 16, 0) for i in range(150)]
    assert run(spark, rows) == plain(rows)


def test_recall_on_the_given_table(spark):
    frame = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    got = sorted((tuple(r) for r in embeddings.judged(frame).collect()), key=repr)
    want = plain(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.99 * len(want)


def test_the_query_finds_all_links_across_cells(spark, monkeypatch):
    """Several cells a label, as in a large table, and many links."""
    monkeypatch.setattr(embeddings, "CELL", 15)
    rows = made(700)
    want = plain(rows)
    assert sum(r[1] for r in want) > 400 and run(spark, rows) == want


def test_copies_are_bounded_by_blocks(spark, monkeypatch):
    """However many cells a class is a guest of, it is dealt once to a pair of blocks, and as it was given."""
    monkeypatch.setattr(embeddings, "CELL", 10)
    monkeypatch.setattr(embeddings, "BLOCK", 300)
    frame = spark.createDataFrame([(i, v, 0) for i, v, _ in made(600)], "vec_id bigint, embedding array<float>, label int")
    met, plain_dealt = [], embeddings._dealt
    monkeypatch.setattr(embeddings, "_dealt", lambda members: (met.append((members, plain_dealt(members)[0])), plain_dealt(members))[1])
    embeddings.judged(frame).collect()
    members, dealt = met[0]
    assert members.selectExpr("avg(size(cells))").first()[0] > 4
    per_class = dealt.groupBy("uid").count().selectExpr("max(count)").first()[0]
    assert per_class <= 2 and dealt.groupBy("uid", "low", "high").count().filter("count > 1").isEmpty()
    assert dealt.schema["vector"].dataType.elementType.simpleString() == "float"
