"""Packed products and hard negatives against plain ones."""

import math
import random

import numpy as np
import pytest

from terralocus.llm import negatives as N

SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("low,high,d", [(-200, 200, 64), (-5, 900, 64), (0, 2, 3), (2 ** 26, 2 ** 26 + 50, 64), (-2 ** 24, 2 ** 24, 64), (-2 ** 27, 2 ** 27, 200), (7, 8, 5)])
def test_products_are_exact(low, high, d):
    rng = np.random.default_rng(d)
    a, b = rng.integers(low, high, (7, d)), rng.integers(low, high, (45, d))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a], object)
    assert (N.products(a, b) == want).all()


@pytest.mark.parametrize("whole", [False, True])
def test_fields_stay_apart(whole):
    block = np.array([[3, -4], [5, 6], [-7, 0]])
    packed = N.pack(block, -7, 10, 3, whole)
    assert packed.shape == (1, 2)
    assert [(int(packed[0][0]) >> (10 * j)) & 1023 for j in range(3)] == [10, 12, 0]
    assert N.unpack(packed.astype(object if whole else np.float64).T, 3, 10, 3).tolist() == [[10, 12, 0], [3, 13, 7]]


def plain(rows):
    people = []
    for i, label, v in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        comps = [math.floor(256 * x) for x in np.float32(v).astype(float).tolist()]
        people.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, comps))
    out = []
    first = lambda some: sorted(some, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
    for i, label, v in people:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in people if j != i and len(v) == len(w)]
        for p, pid, _ in first([s for s in scored if s[2]])[:5]:
            fit = first([s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p])[:10]
            out += [(i, pid, rank, nid, p, s) for rank, (s, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def made(n, d=8, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), [rng.gauss(0.2, 0.3) for _ in range(d)]) for i in range(n)]


def got(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in N.judged(frame, **how).collect()), key=str)


def test_against_plain_over_several_blocks_and_runs(spark):
    rows = made(900)
    want = plain(rows)
    assert len(want) > 100
    assert got(spark, rows) == want
    assert got(spark, rows, block=2, run=100) == want


def test_ties_hot_label_nulls_and_lengths(spark):
    rows = made(300, seed=4)
    same = rows[8][2]
    rows += [(1000 + k, 1, same) for k in range(60)] + [(2000 + k, 2, same) for k in range(60)]  # equal scores
    rows += [(3000, None, same), (3001, 1, None), (3002, 1, []), (3003, 1, [None] * 8), (3004, 1, [float("nan")] * 8), (3005, 1, [float("inf")] * 8),
             (4000, 1, [0.5, 0.5]), (4001, 1, [0.5, 0.5]), (4002, 2, [0.2, 0.5]), (None, 2, same), (5000, 1, [0.0] * 8)]
    want = plain(rows)
    assert got(spark, rows) == want and got(spark, rows, block=1, run=50) == want


def test_wide_components_and_those_beyond_a_long(spark):
    rows = [(i, i % 3, [x * 40_000 for x in v]) for i, _, v in made(250, seed=5)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows + [(400, 1, [1e30] * 8), (401, 2, [3e6] * 8)]) == plain(rows)


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [(100, 1, [0.1])]) == []
    rows = made(120, seed=6)
    rows += [rows[30], rows[30], rows[31]]
    assert got(spark, rows) == plain(rows)
    frame = spark.createDataFrame([(*r, 1, "x", [1]) for r in rows], SCHEMA + ", uid int, size string, comps array<int>")
    assert sorted((tuple(r) for r in N.judged(frame).collect()), key=str) == plain(rows)
