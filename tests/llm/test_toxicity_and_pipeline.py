"""Toxicity on planted words, and the pipeline against its stages done plainly."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terralocus.llm import bpe, mixing, toxicity
from terralocus.llm.tables import table


@pytest.mark.parametrize("text", ["idiot", "IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "ïdíot", "id​iot", "i­diot", "1di0t", "!diot".replace("!", "1")])
def test_folding(text):
    assert toxicity.fold(f"Such an {text}.") == " such an idiot "


def test_folding_leaves_numbers_and_signs_alone():
    assert toxicity.fold("In 1987, 3 of 45 (50%) | a") == " in of a "
    assert toxicity.fold("") == "  " and toxicity.fold("12 34") == "  "


def test_exceptions_and_heaviest_entry():
    model = toxicity.Model({" trash ": 2.0, " tras": 1.0, " lose": 3.0}, [" trash can ", " losery "])
    found = lambda t: model.found(toxicity.fold(t))
    assert found("trash") == 2 and found("trasher") == 1 and found("a trash can") == 0 and found("trash can trash") == 2
    assert found("losery loser") == 3 and found("closer") == 0 and found("trash trash") == 4
    assert toxicity.Model().score("anything") == pytest.approx(1 / (1 + 2.718281828 ** 4))


def planted(n=600, seed=1):
    random.seed(seed)
    plain, bad = ["river", "stone", "green", "walk", "light", "house", "losing", "tree"], ["grubbler", "snarkoid"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = random.choices(plain, k=random.randrange(10, 60)) + (random.choices(bad, k=3) + ["losel" + random.choice("abcdefgh")] if toxic else [])
        random.shuffle(words)
        docs.append((i, " ".join(words), None, "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id bigint, text string, score string, source string, row int"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_learns_words_and_stems_from_labels(spark):
    docs, labels = planted()
    docs += [(None, None, "x", None, None), (9000, "", None, None, None), (9001, "w " * 50_000 + "grubbler " * 20_000, None, None, None), (5, docs[5][1], None, None, None)]
    labels += [(None, 1, 1), (77777, 1, 1), (9001, 1, None), (5, 0, 0)]
    rows = toxicity.judged(*frames(spark, docs, labels)).collect()
    assert len(rows) == len(docs)
    truth = {i: t for i, _, t in labels[:600]}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == truth[r.doc_id] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.predicted for r in rows if r.doc_id in (None, 9000)} == {0} and [r.predicted for r in rows if r.doc_id == 9001] == [1]


def test_without_labels_or_rows(spark):
    docs, labels = frames(spark, [(1, "you stupid moron", None, "s", 1), (2, "good day to all of you", None, "s", 1)], [])
    assert [r.predicted for r in toxicity.judged(docs, labels).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.judged(docs.limit(0), labels).count() == 0
    assert toxicity.clean_rows(docs, labels).columns == docs.columns


def test_held_out_rows_teach_nothing(spark):
    docs, labels = planted(300)
    held = [(i, q, t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    table_, own = frames(spark, docs, held)
    assert toxicity.fit(table_, own).weights == toxicity.built_in().weights


def test_given_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    rows = toxicity.judged(table(spark, folder, "documents").join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted == r.toxic for r in rows) / len(rows)
    recall = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert hits > 0.96 and recall > 0.85


# ---- pipeline ------------------------------------------------------------------------------------

def test_stages_keep_the_columns_and_odd_rows(spark, tmp_path):
    docs, labels = planted(120)
    rows = [(i, t, "en", s, len(t)) for i, t, _, s, _ in docs] + [(None, None, None, None, None), (500, "", "en", "s", 0), (3, docs[3][1], "en", "s", 5), (501, docs[4][1], "de", "z", 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for many in (True, False):
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        now = now if many else now.limit(0)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, str(tmp_path))
            if name == "tokens":
                assert after.filter("round_trip is distinct from true").count() == 0
            else:
                assert after.schema.simpleString() == frame.schema.simpleString()
            after.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{many}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{many}")
        assert bool(now.count()) == many


def test_pipeline_against_plain_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels)
    rows = [r for r in docs.collect() if model.score(r.text or "") < toxicity.THRESHOLD]
    owner = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        owner.setdefault(r.text, r)
    rows = list(owner.values())
    words = {r.doc_id: (r.text or "").lower().split() for r in rows}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len({find(i) for i in ids}) < len(ids)
    rows = [r for r in rows if find(r.doc_id) == r.doc_id]
    # as many copies of each as its hash and the rate of its source say
    kept = spark.createDataFrame(rows, docs.schema)
    rate = {r.source: r.rate for r in mixing.rates(kept).collect()}
    want = []
    for r in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2 ** 52
        n, p, total = 0, 2.718281828459045 ** -rate[r.source], 2.718281828459045 ** -rate[r.source]
        while total <= u:
            n += 1
            p *= rate[r.source] / n
            total += p
        want += [(r.doc_id, r.source, tuple(bpe.encode_text(r.text)))] * n
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == docs.columns + ["ids", "n_tokens", "round_trip"]
    assert out.filter("round_trip").count() == out.count()
    assert sorted((r.doc_id, r.source, tuple(r.ids)) for r in out.collect()) == sorted(want)
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
