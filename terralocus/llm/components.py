"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low")), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Each round lets all larger neighbours of a node point to its smallest
    neighbour (large star), then all smaller ones (small star). Edges never
    grow beyond twice their number, nothing is collected, and a round's result
    is written before the next begins. Ends when the edges form stars.
    """
    now = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high != low").distinct()
    now = cut_lineage(now)
    before = _digest(now)
    while before[0]:
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        moved = large.join(least, "high").filter("low != m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = cut_lineage(least.select("high", F.col("m").alias("low")).unionByName(moved).distinct())
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the links (a, b)."""
    labels = np.arange(n)
    while True:
        m = np.minimum(labels[a], labels[b])
        after = labels.copy()
        np.minimum.at(after, labels[a], m)
        np.minimum.at(after, labels[b], m)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, labels):
            return labels
        labels = after
