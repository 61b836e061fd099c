"""Merkle manifest of a table: leaves, group roots, one root, and a proof per row.

A row's leaf is the digest of its fields. Within a group the leaves stand in
order; every `FANOUT` consecutive nodes become one parent until one node, the
group's subroot, remains. The subroots, in order of their groups, form a tree of
their own, whose last node is the root.

Up: conditional aggregates spread the children of a parent into one column per
slot (`c0`, `c1`, `c2`); the digest of these columns side by side is the parent.
Down: a parent's row holds all its children already, so its slots are exploded
with the other columns as siblings; only parents are joined with what is known
of them, never leaves. Places of leaves come from one sort by range and counts
per part, so a group of any share of the rows is many tasks.

Defined results: null fields are `-` in a leaf, and differ from empty ones; rows
without a group form a group of their own, the first; null in the order stands
first; rows equal in group and order stand by their leaves, so repeated rows
are neighbours with proofs of their own; a lone leaf is its group's subroot;
the proof of a tree of one leaf is the digest of nothing; an empty table has no
rows and no root. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.skew import lookup_join, measure
from .tables import staged

FANOUT = 3
PATH = "array<struct<before:string,after:string>>"
# A part's row numbers are in the low bits of Spark's increasing ids.
LOCAL_BITS = 33


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts side by side."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field_text(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return digest(*[field_text(v) for v in values])


def group_key(group: Column) -> Column:
    """Never null; sorts null first, else by the bytes of the text."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


@dataclass(frozen=True)
class Tree:
    """leaves (grp, pos, size, digest, info) and per level the parents (grp, pos, size, digest, c0.., i0..)."""
    leaves: DataFrame
    levels: list[DataFrame]

    def subroots(self) -> DataFrame:
        """(grp, digest, size): the last node of each group, and its number of leaves."""
        tops = self.leaves.filter("size = 1").select("grp", "digest")
        for level in self.levels:
            tops = tops.unionByName(level.filter("size = 1").select("grp", "digest"))
        return tops

    def nodes(self) -> DataFrame:
        """(level, grp, pos, digest) of all nodes, leaves being level 0: what a manifest stores."""
        out = self.leaves.select(F.lit(0).alias("level"), "grp", "pos", "digest")
        for number, level in enumerate(self.levels, 1):
            out = out.unionByName(level.select(F.lit(number).alias("level"), "grp", "pos", "digest"))
        return out


def _numbered(leaves: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """leaves (grp, digest, info, ..) with `pos` from 0 and `size` of their group, and the size of the largest."""
    by = ["grp", *order, "digest", "tie"]
    kept = staged(leaves.withColumn("tie", F.monotonically_increasing_id()), f"{name}-leaves")
    sorted_rows = kept.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = staged(sorted_rows.select("grp", "digest", "info", F.shiftright("at", LOCAL_BITS).alias("part"),
                                       F.col("at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)).alias("at")), f"{name}-sorted")
    runs = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    so_far = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = staged(runs.select("grp", "part", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift"),
                              F.sum("n").over(Window.partitionBy("grp")).alias("size")), f"{name}-runs")
    rows = lookup_join(placed, runs, ["grp", "part"], size=measure(runs))
    most = runs.agg(F.max("size")).first()[0] or 0
    return rows.select("grp", (F.col("at") + F.col("shift")).alias("pos"), "size", "digest", "info"), most


def _parents(nodes: DataFrame, fanout: int, carried: bool) -> DataFrame:
    """One row per parent, its children spread over slot columns."""
    slot = F.pmod("pos", F.lit(fanout))
    in_slot = lambda c, k: F.max(F.when(slot == k, F.col(c)))
    wide = nodes.groupBy("grp", F.floor((F.col("pos") - slot) / fanout).alias("up")).agg(
        F.ceil(F.max("size") / fanout).alias("size"), *[in_slot("digest", k).alias(f"c{k}") for k in range(fanout)],
        *[in_slot("info", k).alias(f"i{k}") for k in range(fanout) if carried])
    return wide.withColumn("digest", digest(*[F.coalesce(f"c{k}", F.lit("")) for k in range(fanout)])).withColumnRenamed("up", "pos")


def tree(leaves: DataFrame, order: list[str], fanout: int = FANOUT, name: str = "merkle") -> Tree:
    """leaves: grp, digest, info (a struct that may be ordered) and the columns of `order`."""
    rows, most = _numbered(leaves, order, name)
    levels, now = [], rows
    while most > 1:
        level = staged(_parents(now.filter("size > 1"), fanout, not levels), f"{name}-level")
        levels.append(level)
        now, most = level.select("grp", "pos", "size", "digest"), -(-most // fanout)
    return Tree(rows, levels)


def _opened(known: DataFrame, level: DataFrame, fanout: int, info: bool) -> DataFrame:
    """known (grp, pos, path, top) of the parents of a level -> the same of their children."""
    def child(k: int) -> Column:
        beside = lambda some: F.concat(F.lit(""), *[F.coalesce(f"c{j}", F.lit("")) for j in some])
        own = F.array(F.struct(beside(range(k)).alias("before"), beside(range(k + 1, fanout)).alias("after")))
        columns = [(F.col("pos") * fanout + k).alias("pos"), F.concat(own, "path").alias("path"), F.col(f"c{k}").alias("digest")]
        return F.when(F.col(f"c{k}").isNotNull(), F.struct(*columns, *([F.col(f"i{k}").alias("info")] if info else [])))

    both = level.drop("size", "digest").join(known, ["grp", "pos"])
    rows = both.select("grp", "top", F.explode(F.array_compact(F.array(*[child(k) for k in range(fanout)]))).alias("one"))
    return rows.select("grp", "top", "one.*")


def opened(grown: Tree, starts: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(info, digest, path, top) of every leaf: `path` holds the digests before and after it, level by level.

    starts (grp, size, path, top): for each group what follows its own levels, and a struct handed down to its leaves.
    """
    known = None
    for number in range(len(grown.levels) - 1, -1, -1):
        # groups whose last node stands on this level
        here = starts.filter((F.col("size") > fanout ** number) & (F.col("size") <= fanout ** (number + 1)))
        here = here.select("grp", F.lit(0).cast("bigint").alias("pos"), "path", "top")
        known = here if known is None else here.unionByName(known.select("grp", "pos", "path", "top"))
        known = _opened(known, grown.levels[number], fanout, number == 0)
    lone = grown.leaves.filter("size = 1").select("grp", "digest", "info").join(starts.select("grp", "path", "top"), "grp")
    lone = lone.select("info", "digest", "path", "top")
    return lone if known is None else known.select("info", "digest", "path", "top").unionByName(lone)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda now, level: digest(level["before"], now, level["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""))


def proofs(rows: DataFrame, group: Column, leaf: Column, info: Column, order: dict[str, Column], fanout: int = FANOUT) -> DataFrame:
    """(info, leaf, subroot, root, path) of every row."""
    keyed = rows.select(group_key(group).alias("grp"), leaf.alias("digest"), info.alias("info"), *[c.alias(n) for n, c in order.items()])
    lower = tree(keyed, list(order), fanout)
    sizes = lower.leaves.filter("pos = 0").select("grp", "size")
    ends = lower.subroots().join(sizes, "grp")
    upper = tree(ends.select(F.lit("").alias("grp"), "digest", F.struct("grp", "size").alias("info"), F.col("grp").alias("name")), ["name"],
                 fanout, "merkle-groups")
    whole = upper.subroots().join(upper.leaves.filter("pos = 0").select("grp", "size"), "grp")
    first = whole.select("grp", "size", F.array().cast(PATH).alias("path"), F.struct(F.col("digest").alias("root")).alias("top"))
    groups = opened(upper, first, fanout)
    starts = staged(groups.select("info.grp", "info.size", "path", F.struct("top.root", F.col("digest").alias("subroot")).alias("top")), "merkle-starts")
    return opened(lower, starts, fanout).select("info", F.col("digest").alias("leaf"), "top.subroot", "top.root", "path")


def judged(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source",
           order: str = "doc_id", altered: str = "text") -> DataFrame:
    """Leaf, roots and proof of every row, and the root that its leaf gives after the test tampering.

    Rows whose id has an even crc32 lose the line feeds of `altered`; rows without id keep them.
    """
    values = {f: F.col(f) for f in fields}
    leaf = leaf_of(list(values.values()))
    hit = (F.crc32(F.col(order).cast("string").cast("binary")) % 2 == 0) & F.contains(F.col(altered), F.lit("\n"))
    other = leaf_of(list({**values, altered: F.replace(F.col(altered), F.lit("\n"), F.lit(""))}.values()))
    info = F.struct(F.col(order).alias("id"), F.when(hit, other).alias("tampered"))
    found = proofs(docs, F.col(group), leaf, info, {"_order": F.col(order)})
    root = folded(F.col("path"), F.coalesce("info.tampered", "leaf"))
    out = found.select(F.col("info.id").alias(order), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same rows as one statement, level by level, for tables of test size."""
    text = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda altered: "sha256(" + " || ".join(text(c) for c in ("doc_id", "source", "lang", "n_chars", altered)) + ")"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)), lambda c, b: {bits}), 4294967295)"

    def levels(name: str, base: str) -> str:
        return f"""{name} AS (
  {base}
  UNION ALL
  SELECT grp, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), lvl + 1, (size + 2) // 3 FROM {name} WHERE size > 1 GROUP BY grp, pos // 3, lvl, size),
{name}_sides AS (SELECT grp, lvl, pos, coalesce(string_agg(digest, '' ORDER BY pos) OVER (below ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY pos) OVER (below ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name} WHERE size > 1 WINDOW below AS (PARTITION BY grp, lvl, pos // 3 ORDER BY pos))"""

    return f"""
WITH RECURSIVE told AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM told),
{levels('low', "SELECT grp, pos, leaf AS digest, 0 AS lvl, size FROM leaves")},
subroots AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS size FROM low WHERE size = 1),
{levels('high', "SELECT '' AS grp, pos, digest, 0 AS lvl, size FROM subroots")},
top AS (SELECT digest AS root FROM high WHERE size = 1),
low_walk AS (
  SELECT doc_id, leaf, grp, pos, 0 AS lvl, size, '' AS proof, tampered AS folded FROM leaves
  UNION ALL
  SELECT doc_id, leaf, grp, pos // 3, lvl + 1, (size + 2) // 3, proof || before || after, sha256(before || folded || after)
    FROM low_walk JOIN low_sides USING (grp, lvl, pos) WHERE size > 1),
high_walk AS (
  SELECT doc_id, leaf, w.grp, s.pos, 0 AS lvl, s.size, proof, folded FROM low_walk w JOIN subroots s USING (grp) WHERE w.size = 1
  UNION ALL
  SELECT doc_id, leaf, w.grp, w.pos // 3, w.lvl + 1, (size + 2) // 3, proof || before || after, sha256(before || folded || after)
    FROM high_walk w JOIN high_sides h ON w.lvl = h.lvl AND w.pos = h.pos WHERE size > 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM high_walk w JOIN subroots s USING (grp), top WHERE w.size = 1"""
