"""Near copies by whole shingle sets against all pairs."""

import random

import pytest

from terralocus.llm import jaccard as J


def plain_set(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def plain_kept(rows):
    """Smallest ids of the groups of all pairs at 0.8 or more."""
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc), doc)
    return sorted(first.values())


def kept(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted(r.doc_id for r in J.representatives(frame).collect())


def changed(words, similarity, seed):
    """The words with so many single ones changed, apart from each other, that the sets have about this similarity."""
    shared = 2 * similarity / (1 + similarity) * (len(words) - 4)
    out = list(words)
    for k in range(round((len(words) - 4 - shared) / 5)):
        out[5 * k + 4] = f"new{seed}x{k}"
    return out


def planted():
    random.seed(3)
    rows, own = [], lambda n: [f"w{random.randrange(10 ** 6)}" for _ in range(n)]
    for g in range(80):
        words = own(random.choice([8, 12, 40, 204, 400]))
        rows.append(words)
        rows += [changed(words, 0.6 + 0.35 * random.random(), f"{g}_{c}") for c in range(2)]
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def test_pairs_at_all_similarities(spark):
    rows = planted()
    assert kept(spark, rows) == plain_kept(rows)
    assert len(rows) - len(plain_kept(rows)) > 40


@pytest.mark.parametrize("sample,usual,stars,block", [(1, 1 << 20, 3, 1024), (1, 40, 0, 16), (10 ** 9, 1, 1, 7)])
def test_order_and_rounds_do_not_matter(spark, monkeypatch, sample, usual, stars, block):
    """Neither the usual shingles nor comparing with one text first change a result; a group of edited copies and a common passage."""
    for name, value in (("SAMPLE", sample), ("USUAL", usual), ("STARS", stars), ("BLOCK", block), ("TABLE", 64 * block), ("CROWDED", 4)):
        monkeypatch.setattr(J, name, value)
    random.seed(5)
    base, line = [f"b{i}" for i in range(200)], [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in random.sample(range(200), random.randrange(9)):
            words[k] = f"e{random.random()}"
        rows.append(words)
    rows += [[f"o{random.random()}" for _ in range(random.randrange(5, 60))] + line for _ in range(90)]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    assert kept(spark, rows) == plain_kept(rows)


def test_a_repeated_passage_counts_once(spark):
    """Different texts that share a shingle or passage many times stay."""
    line = ["menu", "home", "about", "news", "contact"]
    rows = [(i, " ".join([f"o{i}x{k}" for k in range(200)] + line * 60)) for i in range(6)]
    assert kept(spark, rows) == plain_kept(rows) == list(range(6))


def core_texts(n, core, own):
    return [(i, " ".join([f"c{k}" for k in range(core)] + [f"o{i}x{k}" for k in range(own)])) for i in range(n)]


def test_a_common_core_makes_rows_in_proportion(spark, monkeypatch):
    """Texts that share most of their shingles with no pair at 0.8: twice the texts, twice the rows."""
    made = {}

    def counted(df, name):
        out = staged(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    staged = J.staged
    monkeypatch.setattr(J, "staged", counted)
    rows = {}
    for n in (150, 300):
        made.clear()
        texts = core_texts(n, 85 + 4, 15)
        assert kept(spark, texts) == list(range(n))
        rows[n] = dict(made)
    assert all(rows[300].get(k, 0) <= 2.2 * v + 40 for k, v in rows[150].items()), rows
    assert kept(spark, core_texts(100, 95, 5)) == [0]


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = " ".join(f"w{k % 5000}x{k // 7}" for k in range(200_000))
    texts = [(1, long), (2, long + " end"), (3, None), (4, ""), (4, ""), (5, "one"), (6, "ONE"), (None, "one"), (7, "alone here")]
    frame = spark.createDataFrame([(*r, "u", 5, [1]) for r in texts], "doc_id bigint, text string, uid string, n int, prefix array<int>").repartition(4)
    got = J.representatives(frame)
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 7]
    assert J.representatives(frame.limit(0)).count() == 0


def test_fingerprints_come_first_and_sets_confirm(spark, monkeypatch):
    """Texts linked by fingerprints reach the exact check as pairs, and are no pairs of shingles afterwards."""
    asked, plain = [], J._confirmed
    monkeypatch.setattr(J, "_confirmed", lambda pairs, *a: (asked.append(sorted(tuple(sorted(r)) for r in pairs.select("a", "b").collect())), plain(pairs, *a))[1])
    core = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(core[:200] + [f"x{i}"] + core[200:])) for i in range(6)] + [(10 + i, " ".join(f"u{i}v{k}" for k in range(50))) for i in range(4)]
    assert kept(spark, rows) == plain_kept(rows) == [0, 10, 11, 12, 13]
    assert len(asked[0]) >= 1 and sum(map(len, asked)) < 15


def test_pairs_of_a_block_are_not_all_held():
    """What is connected is not counted again, so nothing grows with the similar pairs of a block."""
    import numpy as np

    n, counted, step = 1500, [0, 0], 100

    def possible():
        for at in range(0, n, step):
            i, j = np.nonzero(np.arange(at, min(at + step, n))[:, None] < np.arange(n)[None, :])
            yield i + at, j

    def similar(i, j):
        counted[0], counted[1] = counted[0] + len(i), max(counted[1], len(i))
        return (i % 2) == (j % 2)

    label = J._joined(n, possible(), similar)
    assert label.tolist() == [k % 2 for k in range(n)]
    assert counted[1] <= J.PAIRS and counted[0] < 0.7 * n * (n - 1) / 2
