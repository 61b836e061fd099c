"""Points joined with polygon and box layers through their cell index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry, grid
from .layer_index import PIECE, LayerIndex, box_index_rows, build_by_shape, index_rows
from .skew import lookup_join, spread_small


def match_index(points: DataFrame, index: LayerIndex, x: str = "lon", y: str = "lat") -> DataFrame:
    """Every (point, feature) pair whose feature covers the point, once each.

    Keeps all columns of `points` and the index's carried columns. Points
    without coordinates match nothing. Pieces of `full_cover` are hits by
    their box; only border pieces meet their segments.
    """
    px, py = F.col(x), F.col(y)
    if not index.rungs:
        empty = points.filter(F.lit(False))
        kinds = (index.rows if index.members is None else index.members).schema
        return empty.select("*", *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in index.carried])
    located = spread_small(points).filter(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py))
    if len(index.rungs) == 1:
        (rx, ry), = index.rungs
        cells = located.withColumn("cell", grid.pack(F.lit(rx), F.lit(ry), grid.slot(px, rx), grid.slot(py, ry)))
    else:
        cells = located.withColumn("cell", F.explode(grid.point_cells(px, py, index.rungs)))
    carried = index.carried if index.members is None else ["_shape"]
    side = index.rows.select(*carried, *PIECE, "cell")
    pairs = lookup_join(cells, side, ["cell"], size=index.size, spread_by=[x, y, *points.columns[:1]])
    in_piece = (
        F.when(F.col("inner"), (px > F.col("xmin")) & (px < F.col("xmax"))).otherwise(px.between(F.col("xmin"), F.col("xmax")))
        & (py >= F.col("slab_lo"))
        & ((py < F.col("slab_hi")) | (F.col("slab_last") & (py <= F.col("slab_hi"))))
    )
    hits = pairs.filter(in_piece)
    if not index.boxes_only:
        # few segments are left in a piece, so the test stays in the JVM
        hits = hits.filter(F.col("full_cover") | geometry.covers(F.col("segments"), px, py, F.col("beyond")))
    hits = hits.select(*points.columns, *carried)
    if index.members is None:
        return hits
    members = index.members.select("_shape", *index.carried)
    return lookup_join(hits, members, ["_shape"], size=index.members_size).select(*points.columns, *index.carried)


def polygons_at(points: DataFrame, polygons: DataFrame, carry: list[str], x: str = "lon", y: str = "lat",
                rings: str = "rings") -> DataFrame:
    """Boundary-inclusive containment join of points and a polygon layer."""
    rows_of = lambda shapes, carry: index_rows(shapes, carry, rings)
    return match_index(points, build_by_shape(polygons, carry, [rings], rows_of), x, y)


def boxes_at(points: DataFrame, features: DataFrame, carry: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Bounding-box join of points and a layer of other geometry."""
    return match_index(points, build_by_shape(features, carry, ["xmin", "ymin", "xmax", "ymax"], box_index_rows), x, y)
