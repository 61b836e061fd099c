"""Folders that micro-batches write, one each."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def complete_batches(spark: SparkSession, path: str, name: str = "batch") -> list[int]:
    """Numbers of the folders `<name>=<number>` below `path` whose writing was finished, rising."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(re.search(rf"{name}=(\d+)/_SUCCESS$", str(f.getPath())).group(1)) for f in found or ())
