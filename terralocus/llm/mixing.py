"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the mixed corpus
divided by its share now. The number of copies of a document is the inverse of
the Poisson distribution with that mean at a uniform number taken from a hash
of seed and document, so any run and any partitioning gives the same corpus.
Every document is then repeated by its count and all copies are shuffled: dealt
to the partitions by a hash of document, copy and seed, and sorted by it.

Defined results: a null source is a source of its own; a null text has mass 0
and is replicated like any other; rows that repeat an id and text get the same
number of copies each; sources of no mass keep rate 1. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import BROADCAST_ROWS, staged

SEED = 20_240_601
# Exponent of a source's mass in its target weight: 1 keeps the corpus, 0 levels all sources.
POWER = 0.7
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """Per source: source, mass (characters) and rate, the mean number of copies.

    `weights` (source, weight) names target weights; without it they are
    mass ** power. The mixed corpus has the mass of the input in the mean. A
    source that `weights` leaves out, or gives no positive weight, has rate 0.
    """
    mass = staged(docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("mass")), "source-mass")
    if weights is None:
        sized = mass.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(float(power))))
    else:
        own = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight")).withColumnRenamed("source", "_source")
        sized = mass.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna({"weight": 0.0})
        sized = sized.withColumn("weight", F.greatest("weight", F.lit(0.0)))
    total = sized.agg(F.coalesce(F.sum("mass"), F.lit(0)).alias("mass"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    fair = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(float(total["mass"])) / F.col("mass")
    return sized.select("source", "mass", F.round(F.when(F.col("mass") > 0, fair).otherwise(F.lit(1.0)), 9).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies up to where doubles end."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate / k)
        return F.struct(log.alias("log"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.exp(log))).alias("sums"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["sums"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1.0)))


def replicated(docs: DataFrame, seed: int = SEED, power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """`row` (all columns as a struct) and `copy` (1, 2, ...): each document by its number of copies, unshuffled."""
    steps = rates(docs, power, weights).select(F.col("source").alias("_source"), poisson_steps(F.col("rate")).alias("_steps"))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("_key"),
                       uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_u"))
    match = F.col("_key").eqNullSafe(F.col("_source"))
    small = steps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if small:  # one row per source, counted
        joined = rows.join(F.broadcast(steps), match)
    else:  # a source may hold a third of all rows: its step row is repeated per salt
        salted = steps.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_slot", F.floor(F.col("_u") * SALTS).cast("int")).join(salted, match & (F.col("_slot") == F.col("_salt")))
    copies = F.size(F.filter("_steps", lambda c: c <= F.col("_u")))
    counted = joined.select("row", copies.alias("_copies")).filter("_copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def mixed(docs: DataFrame, seed: int = SEED, power: float = POWER, weights: DataFrame | None = None) -> DataFrame:
    """All copies in a global random order; columns of `docs` in `row`, and `copy`."""
    copies = replicated(docs, seed, power, weights)
    place = F.xxhash64(F.lit(seed), F.col("row")["doc_id"], F.col("row")["text"], "copy")
    return copies.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place").drop("_place")
