"""Removal of repeated passages against a plain search for equal windows."""

import hashlib
import random
from collections import Counter

import pytest

from terralocus.llm import repeats


def plain(texts, window):
    """Per text: (n_bytes, n_removed, n_spans, digest of what stays)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + window] for t in data for i in range(len(t) - window + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        number = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), number, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, window, gram, hot=repeats.HOT):
    import pyspark.sql.functions as F
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, key string, bytes string").repartition(5)
    rows = repeats.cleaned(docs, window=window, gram=gram, hot=hot)
    rows = rows.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n"), "n_spans", F.sha2("kept", 256).alias("s")).collect()
    assert len(rows) == len(texts)
    return [tuple(r)[1:] for r in sorted(rows)]


def made(seed, signs, n=60):
    random.seed(seed)
    word = lambda k: "".join(random.choices(signs, k=k))
    passages = [word(random.randrange(15, 60)) for _ in range(6)]
    texts = []
    for _ in range(n):
        texts.append("".join(random.choice([word(random.randrange(40)), random.choice(passages)[random.randrange(5):]]) for _ in range(random.randrange(8))))
    texts += random.choices(texts, k=10) + [None, "", "short", "ab" * 100, "ab" * 60 + "c", "z" * 300, texts[3] + texts[4]]
    return texts


@pytest.mark.parametrize("hot", [repeats.HOT, 3, 0])
@pytest.mark.parametrize("signs", ["ab", "abcdefgh é你\x00\n"])
def test_against_all_windows(spark, signs, hot):
    texts = made(len(signs), signs)
    assert run(spark, texts, 20, 6, hot) == plain(texts, 20)


def test_small_chunks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 64)
    monkeypatch.setattr(repeats, "PIECES", 7)
    texts = made(9, "abc")
    data = [(t or "").encode() for t in texts]
    places = [(r, s) for row, first, last, _, _ in repeats.anchors_of(data, 20, 6) for r, a, b in zip(row, first, last) for s in range(a, b + 1)]
    assert len(places) == len(set(places)) == sum(max(len(t) - 19, 0) for t in data)
    lead = 14
    pieces = [data[r][a:b + 20] for row, first, last, at, _ in repeats.anchors_of(data, 20, 6) for r, a, b, p in zip(row, first, last, at)]
    left = [int(p - a) for row, first, last, at, _ in repeats.anchors_of(data, 20, 6) for r, a, b, p in zip(row, first, last, at)]
    got = repeats.repeated_windows(pieces, left, 20, 6)
    aligned = Counter((lead - l + i, p[i:i + 20]) for p, l in zip(pieces, left) for i in range(len(p) - 19))
    for i, (p, l) in enumerate(zip(pieces, left)):
        assert [bool(got[i, lead - l + k]) for k in range(len(p) - 19)] == [aligned[lead - l + k, p[k:k + 20]] > 1 for k in range(len(p) - 19)]


def test_production_window_on_given_texts(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(sorted(texts), plain([texts[i] for i in sorted(texts)], 200)))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.judged(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert repeats.judged(docs.limit(0)).count() == 0
