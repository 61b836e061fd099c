"""Context-tree weighting against the sequential definition, and the unigram base against counts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terralocus.llm import ctw


class Plain:
    """Sequential context-tree weighting: every node on a symbol's path is updated in turn."""

    def __init__(self, depth):
        self.depth, self.nodes = depth, defaultdict(lambda: [0, 0, 0.0, 0.0])  # zeros, ones, log estimate, log weighted

    def update(self, context, symbol):
        for k in range(8):
            point, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
            for d in range(self.depth, -1, -1):
                path = context[len(context) - d:]
                node = self.nodes[point, path]
                node[2] += math.log((node[bit] + 0.5) / (node[0] + node[1] + 1))
                node[bit] += 1
                if d == self.depth:
                    node[3] = node[2]
                else:
                    below = sum(self.nodes[point, bytes([c]) + path][3] for c in range(256) if (point, bytes([c]) + path) in self.nodes)
                    node[3] = np.logaddexp(math.log(0.5) + node[2], math.log(0.5) + below)

    def total(self):
        """Log probability of all that was seen."""
        return sum(n[3] for (_, path), n in self.nodes.items() if path == b"")


def texts(n=40, seed=2):
    random.seed(seed)
    return ["".join(random.choice(["an", "the ", "ti", "é", "on. ", "你"]) for _ in range(random.randrange(30))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, uid int, row int")


def trees_of(spark, data, depth, least=1.0):
    train = spark.createDataFrame([(bytearray(t.encode()),) for t in data], "bytes binary").repartition(3)
    nodes = ctw.tree_nodes(ctw.counted(train, depth), least, depth).toArrow()
    return ctw.Trees(*(nodes[c].to_numpy() for c in ("node", "zeros", "ones")), depth)


def test_weights_equal_the_sequential_ones(spark, monkeypatch):
    """P(next | all training text) is the ratio of the sequential model's block probabilities."""
    monkeypatch.setattr(ctw, "CHUNK", 37)
    data, depth = texts(12), 2
    trees = trees_of(spark, data, depth)
    plain = Plain(depth)
    for t in data:
        symbols = ctw.START * depth + t.encode() + ctw.END
        for i in range(depth, len(symbols)):
            plain.update(symbols[i - depth:i], symbols[i])
    before = plain.total()
    import copy
    for context, symbol in [(b"th", ord("e")), (b"an", ord("t")), (b"zz", ord("q")), (ctw.START * 2, ord("a")), (b"n.", 255), (b"\xc3\xa9", 0)]:
        asked = copy.deepcopy(plain)
        asked.update(context, symbol)
        code = np.array([(context[0] << 16) | (context[1] << 8) | symbol])
        assert trees.log10(code)[0] * ctw.LN10 == pytest.approx(asked.total() - before, abs=1e-9)


@pytest.mark.parametrize("least", [1.0, 5.0, 1e9])
def test_probabilities_of_all_bytes_add_up_to_one(spark, least):
    trees = trees_of(spark, texts(60), 3, least)
    for context in (b"the", b"n. ", b"qqq", ctw.START * 3):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** trees.log10(base | np.arange(256))).sum() == pytest.approx(1)


def test_scores_and_base(spark, monkeypatch):
    monkeypatch.setattr(ctw, "WORD_SHARE", 0.01)
    monkeypatch.setattr(ctw, "HELD", 50)
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts(120))] + [(200, None, None, None, None), (201, "", "x", 1, 1), (202, "A a b\x0bA new", "x", 1, 1), (None, "an an", "x", 1, 1), (5, "an the", "x", 1, 1)]
    got = {(r.doc_id, i): r for i, r in enumerate(sorted(ctw.judged(frame(spark, rows).repartition(4)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens)))}
    assert len(got) == len(rows)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    counts = Counter()
    for i, t, *_ in rows:
        if not held(i):
            counts.update(lower(t) + [b"<end>"])
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i is None, i, len(lower(t)) + 1, held(i), sum(counts[w] > 0 for w in lower(t) + [b"<end>"]),
                    sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t) + [b"<end>"])) for i, t, *_ in rows), key=lambda r: r[:3])
    for (_, r), w in zip(got.items(), want):
        assert (r.doc_id is None, r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens) == (*w[:5], n)
        assert r.base_score == pytest.approx(w[5], abs=1e-9) and r.score < 0
    assert ctw.judged(frame(spark, []).limit(0)).count() == 0


def test_table_slots(spark):
    trees = trees_of(spark, texts(60), 4)
    table = ctw.Table(trees, bits=3)
    random.seed(1)
    for _ in range(3):
        code = np.array([random.choice([(97 << 8) | random.randrange(256), random.randrange(1 << 40)]) for _ in range(200)])
        assert np.allclose(table.log10(code), trees.log10(code))


def test_held_out_text_is_better_coded_than_by_words(spark):
    rows = ctw.judged(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").collect()
    assert len(rows) > 500
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert sum(r.bits_per_byte for r in rows) / len(rows) < 3


@pytest.mark.parametrize("usual, fold", [(1 << 21, 1 << 17), (500, 64), (0, 1)])
def test_every_node_counts(spark, monkeypatch, usual, fold):
    """Scores are those of the trees of all nodes, also of nodes seen once among more than 2**18 symbols, whichever grams are broadcast."""
    monkeypatch.setattr(ctw, "GRAMS", usual)
    monkeypatch.setattr(ctw, "FOLD", fold)
    monkeypatch.setattr(ctw, "HELD", 3000)
    random.seed(4)
    often = ["the ", "an ", "on. ", "é", "你"]
    rows = [(i, "".join(random.choice(often) if random.random() < 0.9 else chr(random.randrange(97, 123)) for _ in range(900)), "x", 1, 1) for i in range(120)]
    rows += [(900, None, None, 1, 1), (901, "", "x", 1, 1), (None, "zq zq", "x", 1, 1), (902, "\u0416" * 40, "x", 1, 1)]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    learnt = [t or "" for i, t, *_ in rows if not held(i)]
    assert sum(len(t.encode()) + 1 for t in learnt) > 1 << 18
    trees = trees_of(spark, learnt, ctw.DEPTH)
    got = {r.doc_id: r.score for r in ctw.judged(frame(spark, rows).repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        code = ctw.grams([(0, ctw.START * ctw.DEPTH + (t or "").encode() + ctw.END)])[1]
        assert got[i] == pytest.approx(trees.log10(code).sum(), rel=1e-9)


def test_without_training_text_every_bit_is_even(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = ctw.judged(frame(spark, [(i, "abc", "x", 1, 1) for i in held])).collect()
    assert [r.score for r in got] == [pytest.approx(4 * 8 * math.log10(0.5))] * 5
