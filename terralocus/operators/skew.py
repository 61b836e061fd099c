"""Joining a large side with a lookup side when few keys hold many rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A side is broadcast only when its counted size stays below these.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A task's share of an input that is spread before heavy work.
WORK_BYTES = 64 * 1024 * 1024
MOST_PARTS = 100_000
# Rows without a key are spread over so many keys of their own.
NULL_SALTS = 4096

@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    @property
    def fits_broadcast(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def spread_small(df: DataFrame) -> DataFrame:
    """Spreads an input of few bytes over all cores before heavy per-row work.

    A small file is one split, so one task would do all the work. The planner's
    size estimate decides; an input that fills the cores anyway is not moved.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = 16 * 1024 * 1024
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * split else df


def spread_for_work(df: DataFrame, *keys: str) -> DataFrame:
    """Slim rows spread by key before each becomes much work.

    The number of parts is set, so that small-looking parts are not merged
    again before the work that makes them large; it grows with the bytes of the
    tables read.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # bytes of the tables read: the planner's figure for joins of them multiplies
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 50)
    return df.repartition(max(least, min(known // WORK_BYTES, MOST_PARTS)), *keys)


def bytes_of_row(df: DataFrame) -> Column:
    """About the bytes a row takes: real lengths of text, binaries and nested values."""
    total = F.lit(16 + 8 * len(df.columns))
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            length = F.size(value) * 8
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            length = F.octet_length(value)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            length = F.octet_length(F.to_json(F.struct(value)))
        else:
            continue
        total = total + F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
    return total


def measure(df: DataFrame, fixed_bytes: int | None = None) -> Size:
    """Counted rows and bytes; `fixed_bytes` is a known bound per row, which saves reading the rows for it."""
    each = bytes_of_row(df) if fixed_bytes is None else F.lit(fixed_bytes)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).cast("bigint").alias("bytes")).first()
    return Size(row["rows"], row["bytes"])


def lookup_join(big: DataFrame, side: DataFrame, keys: list[str], how: str = "inner",
                size: Size | None = None, spread_by: list[str] | None = None) -> DataFrame:
    """big ⋈ side on `keys`, keeping every row; `how` is inner, left, left_semi or left_anti.

    A side of small counted size is broadcast, so `big` does not move. A large
    side is joined by shuffle, and a key that holds much of `big` is split by
    adaptive execution, which knows the real sizes: `big` is not run ahead to
    count keys, so it may be a stream, and joins may follow each other. Rows
    with a null key match nothing; where they are kept, they are spread by a
    salt instead of meeting in one task. The merge hint keeps the planner from
    broadcasting `big` on its estimate, which knows nothing of exploded rows.
    """
    size = size or measure(side)
    if size.fits_broadcast:
        return big.join(F.broadcast(side), keys, how)
    if how in ("inner", "left_semi"):
        return big.join(side.hint("merge"), keys, how)
    unmatched = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(NULL_SALTS)) + 1
    salted = big.withColumn("_salt", F.when(unmatched, spread).otherwise(F.lit(0).cast("bigint")))
    return salted.join(side.withColumn("_salt", F.lit(0).cast("bigint")).hint("merge"), [*keys, "_salt"], how).drop("_salt")
