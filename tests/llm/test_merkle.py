"""Merkle manifest against a plain version, proofs and tampering."""

import hashlib
import random
import zlib

from terralocus.llm import merkle as M

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text):
    return H(*map(told, row[:4]), told(text))


def climb(nodes):
    """Root and per node its sibling runs with the own slot, from lists of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for n, path in enumerate(paths):
            run, slot = runs[at[n] // 3], at[n] % 3
            path.append((run[:slot], run[slot + 1:]))
            at[n] //= 3
        nodes = [H(*r) for r in runs]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    ends, out = [], []
    for key in sorted(groups):
        own = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        ends.append((climb([leaf(r, r[4]) for r in own]), own))
    root, above = climb([end[0] for end, _ in ends])
    for ((sub, paths), own), up in zip(ends, above):
        for r, path in zip(own, paths):
            whole = path + up
            tampered = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            now = leaf(r, tampered)
            for a, b in whole:
                now = H(*a, now, *b)
            out.append((r[0], leaf(r, r[4]), sub, root, H(*[d for a, b in whole for d in a + b]), now, now == root))
    return out


def key(row):
    return tuple(str(v) for v in row)


def same(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in M.judged(frame).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def test_nulls_ties_repeats_and_hot_source(spark):
    random.seed(2)
    rows = [(i, random.choice(["hot", "hot", "é", "z", None, ""]), "en", i, f"line\n{i}\n") for i in range(160)]
    rows += [rows[5]] * 4 + [(7, "hot", "fr", None, None), (7, "hot", None, 1, ""), (None, "hot", "en", 2, "a\nb"), (None, None, None, None, None)]
    rows.append((900, "alone", "en", 1, "x\n" * 50_000))
    got = same(spark, rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_small_trees(spark):
    one = same(spark, [(1, "a", "en", 1, "t")])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == H()
    for n in (2, 3, 4, 10):
        same(spark, [(i, "a", "en", 1, "t\n") for i in range(n)])
    same(spark, [(i, f"s{i}", "en", 1, "t\n") for i in range(10)])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.judged(empty).count() == 0
    extra = spark.createDataFrame([(1, "s", "en", 1, "a\nb", "x", "y", 3, "z")], SCHEMA + ", grp string, digest string, pos int, `a.b` string")
    assert [tuple(r) for r in M.judged(extra).collect()] == plain([(1, "s", "en", 1, "a\nb")])


def test_nodes_of_a_manifest(spark):
    rows = spark.createDataFrame([(i, "a", "en", 1, "t") for i in range(10)], SCHEMA)
    from pyspark.sql import functions as F
    grown = M.tree(rows.select(M.group_key(F.col("source")).alias("grp"), M.leaf_of([F.col(c) for c in rows.columns]).alias("digest"),
                               F.struct("doc_id").alias("info"), "doc_id"), ["doc_id"])
    count = {r.level: r["count"] for r in grown.nodes().groupBy("level").count().collect()}
    assert count == {0: 10, 1: 4, 2: 2, 3: 1}
    assert grown.subroots().count() == 1
