"""Candidate source files from storage or from an index file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attributes import is_source_file


def list_storage(spark: SparkSession, folder: str) -> DataFrame:
    """(key, size, last_modified) below a folder on any Hadoop file system; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(folder).select("path", "length", "modificationTime"))
    return files.filter(is_source_file(F.col("path"))).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def list_index(spark: SparkSession, path: str) -> DataFrame:
    """(key) from index files with one name per line; blank lines and # lines are skipped."""
    names = spark.read.text(path).select(F.trim("value").alias("key"))
    return names.filter((F.col("key") != "") & ~F.col("key").startswith("#") & is_source_file(F.col("key")))


def below_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """Object rows (key, etag, ..) below a prefix, with the prefix and etag quotes removed."""
    lead = prefix.strip("/")
    lead = f"{lead}/" if lead else ""
    inside = objects.filter(F.col("key").startswith(lead) & is_source_file(F.col("key")))
    return inside.withColumns({
        "key": F.substring(F.col("key"), F.lit(len(lead) + 1), F.length("key")),
        "etag": F.regexp_replace("etag", '^"|"$', ""),
    })
