"""Reading the corpus tables and staging results in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Sides below this size are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends, work is not repeated."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def bucket_of(doc_id: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; a null id falls into bucket 0 (crc32 of '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % buckets
