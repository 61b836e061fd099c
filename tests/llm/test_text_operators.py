"""BPE, Patricia tries, url rules and Poisson mixing against plain versions on small inputs."""

import base64
import hashlib
import random

import duckdb
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from terralocus.llm import bpe, mixing, patricia, queries, urlrules

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "it's John's 'tis 12's \u00a0 x\u2003y", "x" * 70_000, " " * 70_000, "ab1" * 30_000,
    "naïve café — don't 你好世界。" * 3_000, "tab\tand\r\nline\x1c\x1d end " * 3_000, "don'tdon't'" * 9_000, "<|endoftext|>", "a\u200db\U0001f600" * 5_000]


def frame(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def docs(spark, texts, **more):
    return frame(spark, [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)])


# ---- byte-level BPE ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size", [1, 7, 100, 20_000])
def test_cut_texts_have_the_ids_of_whole_ones(plain, size):
    random.seed(size)
    signs = "ab Z19'sdt\n\t\r.,!-é你\u00a0\u2028\x1c\u0301"
    texts = [t or "" for t in ODD_TEXTS] + ["".join(random.choices(signs, k=random.randrange(400))) for _ in range(300)]
    for text in texts:
        assert "".join(bpe.parts(text, size)) == text
        if len(text) < 3_000 or size > 50:
            assert bpe.encode_text(text, size=size) == plain.encode_ordinary(text)


def test_bpe_round_trip(spark, plain):
    rows = {r.doc_id: r for r in bpe.round_trip(docs(spark, ODD_TEXTS)).collect()}
    for i, text in enumerate(ODD_TEXTS):
        ids = plain.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_keeps_other_columns_and_empty_tables(spark):
    odd = docs(spark, ["x y", None]).withColumn("row", F.lit(1)).withColumn("work", F.lit(None).cast("int")).withColumn("ids", F.lit("old"))
    out = bpe.encode(odd)
    assert set(out.columns) == set(odd.columns)
    assert [len(r.ids) for r in out.orderBy("doc_id").collect()] == [2, 0]
    assert bpe.decode(out).columns == out.columns + ["decoded"]
    assert bpe.round_trip(docs(spark, ["a"]).limit(0)).count() == 0


# ---- Patricia tries ------------------------------------------------------------------------------

def texts_for_tries():
    random.seed(3)
    base = ["".join(random.choices("ab", k=random.randrange(12))) for _ in range(500)]
    return base + ["p" * 5_000 + t for t in base[:200]] + [None, "", None]


@pytest.mark.parametrize("budget", [1, 2_000, 40_000, 1 << 26])
def test_trie_folds_and_spills(budget):
    seen = {}
    trie = patricia.Trie(lambda a, b: (max(a[0], b[0]), a[1] + b[1]), budget)
    for i, text in enumerate(t or "" for t in texts_for_tries()):
        key = text.encode()
        trie.add(key, (i, 1))
        seen[key] = (i, seen.get(key, (0, 0))[1] + 1)
        if trie.full:
            trie.spill()
    found = list(trie.items())
    assert len(found) == len(seen) and dict(found) == seen
    assert trie.spilled or budget > 1e6 or budget == 1


@pytest.mark.parametrize("budget", [2_000, 1 << 26])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_owners(spark, keep, budget):
    texts = texts_for_tries()
    own = patricia.owners(docs(spark, texts).repartition(5), keep=keep, budget=budget).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    pick = max if keep == "largest" else min
    assert {bytes(r.bytes).decode(): (r.row.doc_id, r.group_size) for r in own} == {t: (pick(ids), len(ids)) for t, ids in groups.items()}
    assert len(own) == len(groups)


def test_dedup_of_nulls_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a"), (5, "a"), (5, "a"), (2, "a"), (None, None), (None, ""), (7, "b\x00c"), (8, "b\x00d")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, bytes string, group_size int")
    kept = patricia.unique_rows(table, keep="largest")
    assert kept.columns == table.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect()) == [(-1, ""), (5, "a"), (7, "b\x00c"), (8, "b\x00d")]
    judged = sorted(patricia.judged(table).collect(), key=repr)
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in judged if r.group_size == 4] == [(2, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (None, 5, 4, False)]
    assert all(r.kept and r.keep_id is None for r in judged if r.text_sha256 == hashlib.sha256(b"").hexdigest())
    assert patricia.judged(table.limit(0)).count() == 0 and patricia.unique_rows(table.limit(0)).count() == 0


# ---- url rules -----------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://a.net?x=/", "https://xnet/", "HTTP://Example.NET/en/1",
    "http://example.net/EN/", "http://www.example.net/en/?q#f", "http://badexample.net/en/", "http://example.com/de/", "http://m.example.com/de", "x://y://org/fr/",
    "http://w.org/fr/a://b", "http://a.org/fr", "http://user@b.org/fr/", "http://b.org:80/fr/", "http://É.ORG/fr/\n", "http://" + "long." * 9_000 + "net/" + "p/" * 9_000]


def plain_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[:min(ends)] if ends else rest
    tail = rest[len(host):]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fitting = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fitting.append((len(rule), len(h), rule, verdict))
    return (host, path, *max(fitting)[2:]) if fitting else (host, path, None, "allow")


@pytest.mark.parametrize("inline", [0, 256])
def test_url_rules(spark, inline):
    rules = queries.URL_RULES + [("b.org/fr/", "block"), ("example.net/en/1", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, None), (None, URLS[9], "h")], "page_id bigint, url string, host string")
    rows = urlrules.judge(pages, rules, inline=inline).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_judge(r.row.url, rules)
    assert urlrules.judge(pages.limit(0), rules, inline=inline).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, [], inline=inline).collect()} == {"allow"} if inline else True


def test_rules_are_filed_under_their_rarest_whole_token():
    own = {r.rule: r for r in urlrules.compiled([*queries.URL_RULES, ("*ads*/x", "block"), ("a.com/tra*", "block"), ("*/*", "block")])}
    assert own["example.net/en/"].token == "en" and own["net/"].token == "net" and own["org/fr/"].token in ("fr", "org")
    assert own["*ads*/x"].token == "" and own["a.com/tra*"].token == "a" and own["*/*"].token == ""


def test_wildcards(spark):
    pages = spark.createDataFrame([(u,) for u in ["http://my-ads-x.com/x1", "http://a.com/track/1", "http://a.com/other"]], "url string")
    rows = urlrules.judge(pages, [("*ads*/x", "block"), ("a.com/tr*k/", "block")]).collect()
    assert [r.verdict for r in rows] == ["block", "block", "allow"]


# ---- Poisson mixing ------------------------------------------------------------------------------

def test_copies_follow_the_rates(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "big" if i % 10 else ("small" if i % 20 else None), 1) for i in range(20_000)]
    table = frame(spark, rows)
    rate = {r.source: r.rate for r in mixing.rates(table).collect()}
    mean = {r.source: r.n for r in mixing.replicated(table).groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    sizes = {"big": 18_000, "small": 1_000, None: 1_000}
    for source, n in sizes.items():
        assert abs(mean[source] / n - rate[source]) < 5 * (rate[source] / n) ** 0.5
    spread = {r["n"]: r["count"] for r in mixing.replicated(table.filter("source = 'big'"), power=1.0).groupBy("row.doc_id").agg(F.count("*").alias("n")).groupBy("n").count().collect()}
    assert abs(spread[1] / 18_000 - 0.3679) < 0.015 and abs(spread[2] / 18_000 - 0.1839) < 0.012


def test_mixing_by_join_and_by_broadcast_agree(spark, monkeypatch):
    table = docs(spark, [f"text {i}" for i in range(300)] + [None, "", "text 1"])
    first = sorted(map(repr, mixing.mixed(table).collect()))
    assert first == sorted(map(repr, mixing.mixed(table.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert first == sorted(map(repr, mixing.mixed(table).collect()))


def test_target_weights(spark):
    table = docs(spark, ["abcd"] * 3_000)
    weights = spark.createDataFrame([("s0", 3.0), ("s1", 1.0), ("gone", 5.0)], "source string, weight double")
    rate = {r.source: r.rate for r in mixing.rates(table, weights=weights).collect()}
    assert rate["s2"] == 0 and rate["s0"] == pytest.approx(3 * rate["s1"])
    assert {r.source for r in mixing.mixed(table, weights=weights).select("row.source").distinct().collect()} == {"s0", "s1"}
    assert mixing.mixed(table.limit(0)).count() == 0
    assert mixing.mixed(docs(spark, [None, ""])).count() >= 0


def test_long_rates(spark):
    steps = spark.range(1).select(mixing.poisson_steps(F.lit(1500.0)).alias("s")).first().s
    assert steps[-1] == pytest.approx(1) and steps[1500] == pytest.approx(0.5, abs=0.02)


# ---- registered queries --------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
