"""Embedding near-deduplication: spherical k-means cells, blocked cosine products.

Vectors are compared only within a label. Equal vectors are one class with a
count. Spherical k-means, fitted on a bounded sample, gives every class its
home cell; a class near the border of another cell is a guest there. For a pair
at cosine c or more, the distance of its unit vectors is at most
r = sqrt(2 - 2c); so if one lies at home in cell b, the other lies at most r
beyond the bisector of its own cell and b. `slack` scales r: 1 finds every pair
for certain; less also does nearly always, as the difference of a pair seldom
points straight across a border.

The classes of a label, in the order of their home cells, are cut into blocks, and
tasks multiply pairs of blocks. A class goes to a pair of blocks only where it is
a guest of a cell of the other one, and once however many of its cells these are; so a
class has as many copies as its label has blocks at most, and moves as it was
given, not as doubles. Tasks return link counts and a spanning forest, not the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and those with null label, link with nothing and stay; vectors of
different lengths do not link; equal vectors link; null ids never name a
component; repeated rows count as vectors of their own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.skew import MOST_PARTS, lookup_join, measure
from .components import components, forest
from .tables import staged

COSINE = 0.93
SLACK = 1.0
# Classes that the fit sees at most, those a label and cell should hold, and cells at most.
SAMPLE, CELL, CELLS, ROUNDS = 16_384, 1_000, 1_024, 12
# Rows, and bytes as doubles, that a block holds at most.
BLOCK, BLOCK_BYTES = 32_768, 16 * 1024 * 1024
# Rows that look for their cells at once, products held at once, and links before a task joins them up.
ROWS_AT_ONCE, PRODUCTS, LINKS = 256, 1 << 22, 2_000_000
# Copies of fewer bytes are not dealt to a part of their own.
PART_BYTES = 1024 * 1024


def _scaled(values) -> tuple[np.ndarray, float] | None:
    """The vector by its largest component, and the norm of that; None where there is no unit vector."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x, math.sqrt(float(x @ x))


def unit(values) -> np.ndarray | None:
    """The unit vector in doubles, or None where there is none."""
    scaled = _scaled(values)
    return None if scaled is None else scaled[0] / scaled[1]


def units(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The unit vectors of rows whose norms `_keyed` gave, the same doubles as `unit` gives."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= norm[:, None]
    return x


def _matrix(column, rows: int) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts from spread rows of `x`, whose order must not depend on the run."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def cells_of(x: np.ndarray, centre: np.ndarray, reach: float) -> list[list[int]]:
    """Per row its home cell, then the other cells where it is a guest."""
    near = x @ centre.T
    home = np.argmax(near, axis=1)
    gap = near[np.arange(len(x)), home][:, None] - near
    across = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))[home]
    guest = (gap <= reach * across) & (np.arange(len(centre))[None, :] != home[:, None])
    return [[int(h), *np.flatnonzero(g).tolist()] for h, g in zip(home, guest)]


def _keyed(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, key, norm, vector): key names the content, null where a vector takes no part."""
    packed = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    out = packed.select("vec_id", "label", F.lit(b"").alias("key"), F.lit(0.0).alias("norm"), "vector").schema
    for f in out.fields:
        f.nullable = True

    def run(batches):
        for batch in batches:
            keys, norms = [], []
            for values, own in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                scaled = None if own is None else _scaled(values)
                keys.append(None if scaled is None else hashlib.md5((np.asarray(values, np.float64) + 0.0).tobytes()).digest())
                norms.append(None if scaled is None else scaled[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(norms, pa.float64()), batch.column(2)],
                                             ["vec_id", "label", "key", "norm", "vector"])

    return packed.mapInArrow(run, out)


def _centres(classes: DataFrame) -> np.ndarray:
    """Centroids for the most usual length, fitted on the classes with the lowest hashes."""
    sizes = classes.groupBy("label", F.size("vector").alias("size")).count().groupBy("size").agg(
        F.sum("count").alias("rows"), F.count("*").alias("labels")).orderBy(F.desc("rows"), "size").first()
    if sizes is None:
        return np.zeros((0, 0))
    taken = classes.filter(F.size("vector") == sizes["size"]).orderBy(F.xxhash64("key"), "key").select("vector", "norm").limit(SAMPLE).collect()
    x = units(np.array([r["vector"] for r in taken]), np.array([r["norm"] for r in taken]))
    k = max(1, min(CELLS, len(x) // 8, math.ceil(sizes["rows"] / (sizes["labels"] * CELL))))
    return kmeans(x, k)


def _members(classes: DataFrame, centre: np.ndarray, reach: float) -> DataFrame:
    """The classes with `size`, their home cell and `cells`, which holds it and those where they are guests."""
    def run(batches):
        for batch in batches:
            fit = np.flatnonzero(pc.equal(pc.list_value_length(batch.column("vector")), centre.shape[1]).to_numpy(zero_copy_only=False))
            cells = [[0]] * batch.num_rows
            for at in range(0, len(fit), ROWS_AT_ONCE):
                part = fit[at:at + ROWS_AT_ONCE]
                rows = batch.take(pa.array(part))
                x = units(_matrix(rows.column("vector"), len(part)), rows.column("norm").to_numpy())
                for i, c in zip(part, cells_of(x, centre, reach)):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c[0] for c in cells], pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                                             [*batch.schema.names, "home", "cells"])

    rows = classes.select("label", "uid", "n", "norm", "vector")
    out = rows.withColumn("home", F.lit(0)).withColumn("cells", F.array(F.lit(0))).schema
    return rows.mapInArrow(run, out).withColumn("size", F.size("vector"))


def linked(x: np.ndarray, y: np.ndarray, cosine: float):
    """Index pairs (i, j) with x[i] . y[j] >= cosine, some rows at a time."""
    step = max(1, PRODUCTS // max(len(y), 1))
    for at in range(0, len(x), step):
        i, j = np.nonzero(x[at:at + step] @ y.T >= cosine)
        yield i + at, j


def grouped(batch: pa.RecordBatch, keys: list[str]):
    """Slices of a sorted batch whose rows share all keys, with their values."""
    fresh = np.zeros(batch.num_rows, bool)
    fresh[:1] = True
    for c in keys:
        column = batch.column(c)
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(fresh).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start), tuple(batch.column(c)[start].as_py() for c in keys)


def _dealt(members: DataFrame) -> tuple[DataFrame, int]:
    """Copies of the members for the pairs of blocks (low, high) of their label where they may find links, and the number of parts these are work for.

    The members of a label are numbered cell by cell, in any order within one, and cut into blocks of equal length.
    """
    own = ["label", "size"]
    counts = members.groupBy(*own, "home").agg(F.count("*").alias("of"))
    by_cell = Window.partitionBy(*own).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"before": F.coalesce(F.sum("of").over(by_cell), F.lit(0)), "all": F.sum("of").over(Window.partitionBy(*own))})
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.col("size"), F.lit(1))))))
    long = F.ceil(F.col("all") / F.ceil(F.col("all") / most))
    counts = counts.withColumns({"long": long, "first": F.floor(F.col("before") / long), "last": F.floor((F.col("before") + F.col("of") - 1) / long)})
    layout = staged(counts.groupBy(*own).agg(
        F.first("long").alias("long"), F.max("last").alias("top"),
        F.map_from_entries(F.collect_list(F.struct("home", F.struct("before", "of", "first", "last")))).alias("cell")), "vector-blocks")
    blocks = F.col("top") + 1
    facts = layout.agg(F.sum(blocks * (blocks + 1) / 2).alias("pairs"), F.sum(blocks * blocks * F.col("long") * (8 * F.col("size") + 64)).alias("bytes")).first()
    placed = lookup_join(members, layout, own, size=measure(layout), spread_by=["uid"])
    home = F.col("cell")[F.col("home")]
    placed = placed.withColumn("block", F.floor((home["before"] + F.pmod(F.xxhash64("uid"), home["of"])) / F.col("long")))
    # a cell may be empty in a label
    blocks = F.transform("cells", lambda c: F.when(F.col("cell")[c].isNotNull(), F.sequence(F.col("cell")[c]["first"], F.col("cell")[c]["last"])).otherwise(F.array().cast("array<bigint>")))
    met = F.when(F.col("top") == 0, F.array(F.col("block"))).otherwise(F.array_distinct(F.flatten(blocks)))
    dealt = placed.select(*own, "block", "uid", "n", "norm", "vector", F.explode(met).alias("other"))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other"), min(int(2 * (facts["pairs"] or 0)), int(facts["bytes"] or 0) // PART_BYTES)


def _compared(members: DataFrame, cosine: float) -> DataFrame:
    """(uid, links, root): what each pair of blocks adds to a class's links, and a class it is connected with."""
    dealt, parts = _dealt(members)
    spark, keys = members.sparkSession, ["label", "size", "low", "high"]
    # a pair is much work for its bytes, so the number of parts is set and small ones are not merged
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(min(max(least, parts), MOST_PARTS), *keys).sortWithinPartitions(*keys)

    def run(batches):
        held, now = [], None
        for batch in batches:
            for part, place in grouped(batch, keys):
                if place != now and held:
                    yield answer(held)
                    held = []
                now = place
                held.append(part)
        if held:
            yield answer(held)

    def answer(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        uid, n, block = (rows[c].to_numpy() for c in ("uid", "n", "block"))
        vector, norm = rows["vector"].combine_chunks(), rows["norm"].to_numpy()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        x, y = (units(_matrix(vector.take(pa.array(some)), len(some)), norm[some]) if len(some) else np.zeros((0, 1)) for some in (one, two))
        links, a, b = np.zeros(len(uid), np.int64), [], []
        for i, j in linked(x, y, cosine) if len(x) and len(y) else ():
            i, j = one[i], two[j]
            if low == high:  # within a block once
                good = i < j
                i, j = i[good], j[good]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            a.append(i), b.append(j)
            if sum(map(len, a)) > LINKS:  # a dense block: go on with what connects the links so far
                root = forest(len(uid), np.concatenate(a), np.concatenate(b))
                a, b = [np.arange(len(uid))], [root]
        root = forest(len(uid), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(uid))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some]), pa.array(uid[root[some]])], ["uid", "links", "root"])

    return dealt.mapInArrow(run, "uid bigint, links bigint, root bigint")


def judged(vectors: DataFrame, cosine: float = COSINE, slack: float = SLACK, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = _keyed(vectors, vec_id, vector, label)
    classes = rows.filter("key is not null").groupBy("label", "key").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"), F.any_value("norm").alias("norm"), F.any_value("vector").alias("vector"))
    classes = staged(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")
    centre = _centres(classes)
    found = staged(_compared(_members(classes, centre, slack * math.sqrt(2 - 2 * cosine)), cosine), "vector-links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found, "uid", "root").withColumnRenamed("node", "uid")
    named = (classes.drop("norm", "vector").join(counts, "uid", "left").join(roots, "uid", "left")
             .withColumn("root", F.coalesce("root", "uid")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(best, "root").select("label", "key", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    together = rows.filter("key is not null").select("vec_id", "label", "key").join(named, ["label", "key"]).select("vec_id", "n_links", "component_id")
    return together.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
