"""Cell index of a vector layer.

Each polygon becomes one or more slabs: horizontal bands that hold just the
segments a horizontal ray inside the band can meet. A band is cut at its border:
the stretches that segments take up keep these segments, what lies inside between
them needs none (`full_cover`), and what lies outside is not in the index. So a
country outline of a hundred thousand segments costs a point in its interior
no segment test and one near its border a few. Each piece is filed under the at
most nine cells its box touches, on the rung that fits its size, so neither tiny
nor huge polygons blow up the index. Rings are closed, as their formats ask.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry, grid
from ..functions.covers import band_pieces
from ..session import scratch_path, written
from .skew import Size, measure, spread_for_work

SLAB_SEGMENTS = 8
# Slabs of the first cut; each is cut again by the segments it holds, so none of
# a long outline's segments is looked at once per slab.
FIRST_SLABS = 64


# What the containment join reads of an index row, beside the carried columns and the cell.
PIECE = ["xmin", "xmax", "slab_lo", "slab_hi", "slab_last", "full_cover", "inner", "beyond", "segments"]


@dataclass(frozen=True)
class LayerIndex:
    """Index rows plus the small facts the join needs.

    With `members` (_shape, carried columns), the rows carry the shape only.
    """
    rows: DataFrame
    rungs: list[tuple[int, int]]
    size: Size
    carried: list[str]
    boxes_only: bool = False
    members: DataFrame | None = None
    members_size: Size | None = None


def _profile_rows(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rung pairs in use (at most one per pair of rungs) with counted rows and bytes."""
    segments = F.coalesce(F.size("segments"), F.lit(0))
    text = [F.coalesce(F.octet_length(F.col(n)), F.lit(0)) for n, kind in rows.select(*carried).dtypes if kind == "string"]
    row_bytes = segments * 48 + 128
    for length in text:
        row_bytes = row_bytes + length
    return rows.groupBy("rung_x", "rung_y").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_bytes).alias("bytes"), F.every(F.col("segments").isNull()).alias("boxes"))


def _with_profile(rows: DataFrame, profile: DataFrame, carried: list[str]) -> LayerIndex:
    stats = profile.collect()
    return LayerIndex(
        rows=rows,
        rungs=sorted((r["rung_x"], r["rung_y"]) for r in stats),
        size=Size(sum(r["rows"] for r in stats), sum(r["bytes"] for r in stats)),
        carried=carried,
        boxes_only=all(r["boxes"] for r in stats),
    )


def _profile(rows: DataFrame, carried: list[str]) -> LayerIndex:
    return _with_profile(rows, _profile_rows(rows, carried), carried)


def _cut(df: DataFrame, slabs: Column) -> DataFrame:
    """Each slab in `slabs` slabs of equal height, with the segments that reach into them."""
    height = F.col("slab_hi") - F.col("slab_lo")
    df = df.withColumn("_slabs", slabs).withColumn("_slab", F.explode(F.sequence(F.lit(0), F.col("_slabs") - 1)))
    last = F.col("_slab") == F.col("_slabs") - 1
    df = df.withColumns({
        "_lo": F.when(F.col("_slab") == 0, F.col("slab_lo")).otherwise(F.col("slab_lo") + height * F.col("_slab") / F.col("_slabs")),
        "_hi": F.when(last, F.col("slab_hi")).otherwise(F.col("slab_lo") + height * (F.col("_slab") + 1) / F.col("_slabs")),
        "slab_last": F.col("slab_last") & last})
    reach = F.filter("segments", lambda e: (F.greatest(e["ay"], e["by"]) >= F.col("_lo")) & (F.least(e["ay"], e["by"]) <= F.col("_hi")))
    return df.withColumns({"segments": F.when(F.col("_slabs") == 1, F.col("segments")).otherwise(reach),
                           "slab_lo": F.col("_lo"), "slab_hi": F.col("_hi")}).drop("_lo", "_hi", "_slab", "_slabs")


def index_rows(polygons: DataFrame, carry: list[str], rings: str = "rings") -> DataFrame:
    """(carried columns, box, slab, full_cover, inner, beyond, segments, cell) rows of a polygon layer.

    Where `full_cover` holds, the box lies in the polygon and `segments` is
    NULL: rectangles with their border, and `inner` pieces without their west and
    east ends. Polygons without geometry are left out.
    """
    df = polygons.filter(F.col(rings).isNotNull() & (F.size(rings) > 0))
    box = geometry.bounds(F.col(rings))
    # a small file is one split, and cutting outlines is much work
    df = spread_for_work(df.select(*carry, F.col(rings).alias("_rings"), *[c.alias(n) for n, c in box.items()]), *carry[:1])
    df = df.withColumn("_edges", geometry.edges(F.col("_rings")))
    is_box = (
        (F.size("_rings") == 1)
        & (F.size("_edges") == 4)
        & F.forall("_edges", lambda e: (e["ax"] == e["bx"]) != (e["ay"] == e["by"]))
        & (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))
    )
    flat = is_box | (F.col("ymax") <= F.col("ymin"))
    df = df.withColumns({
        "slab_lo": F.col("ymin"), "slab_hi": F.col("ymax"), "slab_last": F.lit(True), "_flat": flat,
        "segments": F.when(~is_box, F.col("_edges"))})
    first = F.least(F.lit(FIRST_SLABS), F.ceil(F.size("segments") / SLAB_SEGMENTS).cast("int"))
    df = df.drop("_edges", "_rings").withColumn("_banded", F.size("segments") > SLAB_SEGMENTS)
    df = _cut(df, F.when(F.col("_flat"), F.lit(1)).otherwise(first))
    df = _cut(df, F.when(F.col("_flat"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.size("segments") / SLAB_SEGMENTS).cast("int"))))
    return _filed(_at_border(df), carry)


def _at_border(df: DataFrame) -> DataFrame:
    """Bands of more than a few segments as pieces along their border."""
    own = F.struct(F.col("xmin").alias("x0"), F.col("xmax").alias("x1"), F.lit(False).alias("inner"), F.lit(0).alias("beyond"), F.col("segments").alias("segments"))
    cut = band_pieces(F.when(F.col("_cut"), F.col("segments")), F.col("slab_lo"), F.col("slab_hi"))
    many = ~F.col("_flat") & (F.col("_banded") | (F.size("segments") > SLAB_SEGMENTS))
    df = df.withColumn("_cut", F.coalesce(many, F.lit(False)))
    df = df.withColumn("_piece", F.explode(F.when(F.col("_cut"), cut).otherwise(F.array(own))))
    return df.withColumns({"xmin": F.col("_piece.x0"), "xmax": F.col("_piece.x1"), "inner": F.col("_piece.inner"),
                           "beyond": F.col("_piece.beyond"), "segments": F.col("_piece.segments")})


def _filed(df: DataFrame, carry: list[str]) -> DataFrame:
    """Pieces under the cells of the rung that fits their box."""
    df = df.withColumns({
        "full_cover": F.col("segments").isNull(),
        "rung_x": grid.rung_of(F.col("xmax") - F.col("xmin")),
        "rung_y": grid.rung_of(F.col("slab_hi") - F.col("slab_lo")),
    })
    cells = grid.box_cells(F.col("xmin"), F.col("slab_lo"), F.col("xmax"), F.col("slab_hi"),
                           F.col("rung_x"), F.col("rung_y"))
    return df.select(*carry, *PIECE, "rung_x", "rung_y", F.explode(cells).alias("cell"))


def box_index_rows(features: DataFrame, carry: list[str]) -> DataFrame:
    """Same shape for features known by their box only (xmin, ymin, xmax, ymax)."""
    df = features.filter(F.col("xmin").isNotNull() & F.col("ymin").isNotNull())
    return _filed(df.select(
        *carry, "xmin", "xmax", F.col("ymin").alias("slab_lo"), F.col("ymax").alias("slab_hi"), F.lit(True).alias("slab_last"),
        F.lit(False).alias("inner"), F.lit(0).alias("beyond"), F.lit(None).cast(geometry.EDGES_TYPE).alias("segments")), carry)


def build_index(polygons: DataFrame, carry: list[str], rings: str = "rings") -> LayerIndex:
    return _profile(written(index_rows(polygons, carry, rings), "index"), carry)


def build_box_index(features: DataFrame, carry: list[str]) -> LayerIndex:
    return _profile(written(box_index_rows(features, carry), "index"), carry)


def save_index(rows: DataFrame, path: str, carry: list[str]) -> None:
    """Write index rows ordered by cell, so that a later scan can skip row groups, and their profile."""
    rows.repartitionByRange(F.col("cell")).sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    _profile_rows(kept, carry).coalesce(1).write.mode("overwrite").parquet(f"{path}/profile")


def load_index(spark: SparkSession, path: str, carry: list[str]) -> LayerIndex:
    """A saved index; `carry` may be fewer columns than were saved."""
    return _with_profile(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/profile"), carry)


def save_by_shape(features: DataFrame, path: str, carry: list[str], shape: list[str], rows_of: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    """An index in which features of equal `shape` columns share their rows; `rows_of` is `index_rows` or `box_index_rows`.

    What covers a point is the same for features of one shape, so points meet
    each shape once and its features at the end.
    """
    known = features.filter(reduce(and_, [F.col(c).isNotNull() for c in shape])).select(*dict.fromkeys([*carry, *shape]))
    known.select(*shape).distinct().withColumn("_shape", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/shapes")
    shapes = features.sparkSession.read.parquet(f"{path}/shapes")
    known.join(shapes, shape).select("_shape", *carry).write.mode("overwrite").parquet(f"{path}/members")
    save_index(rows_of(shapes, ["_shape"]), path, ["_shape"])


def load_by_shape(spark: SparkSession, path: str, carry: list[str]) -> LayerIndex:
    """An index of `save_by_shape`; `carry` may be fewer columns than were saved."""
    members = spark.read.parquet(f"{path}/members").select("_shape", *carry)
    return replace(load_index(spark, path, ["_shape"]), carried=carry, members=members, members_size=measure(members))


def build_by_shape(features: DataFrame, carry: list[str], shape: list[str], rows_of: Callable[[DataFrame, list[str]], DataFrame]) -> LayerIndex:
    path = scratch_path(features.sparkSession, "index")
    save_by_shape(features, path, carry, shape, rows_of)
    return load_by_shape(features.sparkSession, path, carry)
