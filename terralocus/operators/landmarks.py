"""Islands and mountains that cover a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .hits import first_of_shape

LANDFORMS = ("mountain", "range")


def first_islands(features: DataFrame, shape: str = "rings") -> DataFrame:
    """The features that `islands` can name: of one shape and name, only the first counts."""
    named = features.filter(F.coalesce("name", F.lit("")) != "")
    return first_of_shape(named, [shape, "name"], [F.col("fid") == 0, F.col("fid")])


def first_mountains(features: DataFrame, shape: str = "rings") -> DataFrame:
    """The features that `mountains` can pick: of one shape and landform, only the smallest counts."""
    named = features.filter((F.coalesce("name", F.lit("")) != "") & F.col("landform").isin(*LANDFORMS))
    return first_of_shape(named, [shape, "landform"], _by_area())


def _by_area() -> list[Column]:
    area = F.coalesce("area_km2", F.lit(0.0))
    known = area > 0
    return [~known, F.when(known, area).otherwise(F.lit(0.0)), F.col("name"), F.col("fid")]


def islands(island_hits: DataFrame, point: str = "point_id") -> DataFrame:
    """(point, islands): one entry per distinct name, by name; unnamed ones skipped.

    Fragments of one island share its name, so hits need no merging before.
    """
    named = island_hits.filter(F.coalesce("name", F.lit("")) != "")
    per_name = named.groupBy(point, "name").agg(
        F.min_by(F.struct("name_native", "name_source"), F.struct(F.col("fid") == 0, F.col("fid"))).alias("_first"))
    entry = F.struct("name", F.col("_first.name_native"), F.col("_first.name_source"))
    return per_name.groupBy(point).agg(F.array_sort(F.collect_list(entry)).alias("islands"))


def mountains(mountain_hits: DataFrame, point: str = "point_id") -> DataFrame:
    """(point, mountain, range): the smallest named feature of each landform.

    A known area beats an unknown one (NULL or not positive); names, then ids
    break ties. Only a mountain carries its summit height. Fragments need no
    merging before.
    """
    named = mountain_hits.filter(F.coalesce("name", F.lit("")) != "")
    order = F.struct(*_by_area())

    def best(kind: str):
        fits = F.col("landform") == kind
        shown = [F.col("name"), F.col("name_native"), F.col("name_source")]
        if kind == "mountain":
            shown.append(F.col("ele").alias("elevation"))
        return F.min_by(F.when(fits, F.struct(*shown)), F.when(fits, order)).alias(kind)

    return (named.filter(F.col("landform").isin(*LANDFORMS)).groupBy(point)
            .agg(*[best(kind) for kind in LANDFORMS]))
