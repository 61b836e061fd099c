"""Raster sampling and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralocus.operators import raster as R
from terralocus.operators.points import reproject_points

from . import sqlparts as S
from .inputs import mapping, raster
from .registry import check
from .views import view

_PTS = "SELECT point_id, lon, lat FROM [all_pts]"
_SAMPLES = S.raster_samples(_PTS)


def _sampled(spark, d):
    """All layers at all points, each in its own system."""
    table = raster(spark, d)
    pts = view(spark, d, "all_pts").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(4326).alias("srid"))
    return R.sample_covering(reproject_points(pts, [4326, 3857], (4326,)), table, table.layers)


@check("raster_join", f"SELECT point_id, source_id, layer_id, raw FROM ({_SAMPLES})")
def raster_join(spark, d):
    return _sampled(spark, d).select("point_id", "source_id", "layer_id", "raw")


@check("raster_categorical", f"""SELECT point_id, CAST(raw AS BIGINT) AS value, name AS label,
    CASE WHEN name IS NULL THEN 'pixel value ' || CAST(CAST(raw AS BIGINT) AS VARCHAR) || ' has no mapping entry' END AS error
    FROM ({_SAMPLES}) LEFT JOIN [legend_values] ON value = raw WHERE source_id = 'cover'""")
def raster_categorical(spark, d):
    hits, errors = R.categorical_values(_sampled(spark, d), mapping(spark, d))
    shown = hits.select("point_id", F.col("fid").alias("value"), F.col("properties")["label"].alias("label"), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(errors.select("point_id", "value", F.lit(None).cast("string").alias("label"), "error"))


@check("raster_continuous", f"""SELECT point_id, source_id, layer_id,
    CASE layer_id WHEN 'height' THEN 'meters' WHEN 'hem' THEN 'accuracy' WHEN 'zone' THEN 'zone' ELSE 'value' END AS property,
    CASE WHEN source_id = 'climate' THEN raw*0.5+3 ELSE raw END AS value FROM ({_SAMPLES}) WHERE source_id <> 'cover'""")
def raster_continuous(spark, d):
    return R.continuous_values(_sampled(spark, d)).select("point_id", "source_id", "layer_id", "property", "value")


_ROUTE = "SELECT point_id, lon*4 AS lon, (lat-50)*4 AS lat FROM [all_pts]"


@check("tile_route", f"""SELECT point_id, r.lat_cell, r.lon_cell, CASE WHEN r.lat_cell<0 THEN 'S' ELSE 'N' END || printf('%02d', abs(r.lat_cell)) || '_' ||
    CASE WHEN r.lon_cell<0 THEN 'W' ELSE 'E' END || printf('%03d', abs(r.lon_cell)) || '.tif' AS tile, t.lat_cell IS NOT NULL AS present
    FROM (SELECT point_id, CAST(floor(lat/2)*2 AS INT) AS lat_cell, CAST(floor(lon/2)*2 AS INT) AS lon_cell FROM ({_ROUTE})) r
    LEFT JOIN [dem_cells] t ON t.lat_cell = r.lat_cell AND t.lon_cell = r.lon_cell""")
def tile_route(spark, d):
    pts = view(spark, d, "all_pts").select("point_id", (F.col("lon") * 4).alias("lon"), ((F.col("lat") - 50) * 4).alias("lat"))
    routed = pts.withColumns(R.cell_of(F.col("lon"), F.col("lat"), F.lit(2)))
    present = view(spark, d, "dem_cells").withColumn("present", F.lit(True))
    return routed.join(present, ["lat_cell", "lon_cell"], "left").select(
        "point_id", "lat_cell", "lon_cell", R.tile_name("{ns}{lat}_{ew}{lon}.tif", F.col("lat_cell"), F.col("lon_cell")).alias("tile"),
        F.coalesce("present", F.lit(False)).alias("present"))


@check("elevation", f"""WITH s AS ({_SAMPLES}), z AS (SELECT point_id, raw FROM s WHERE layer_id='height'), a AS (SELECT point_id, raw FROM s WHERE layer_id='hem')
    SELECT point_id, coalesce(z.raw, 0.0) AS meters, z.raw IS NULL AS sea_level, CASE WHEN z.raw IS NOT NULL THEN coalesce(a.raw, 4.0) END AS accuracy_m,
    CASE WHEN z.raw IS NULL THEN 'sea-level convention' WHEN a.raw IS NOT NULL THEN 'per pixel' ELSE 'constant' END AS accuracy_basis
    FROM [all_pts] LEFT JOIN z USING (point_id) LEFT JOIN a USING (point_id)""")
def elevation(spark, d):
    pts = view(spark, d, "all_pts").select("point_id", "lon", "lat")
    heights = R.terrain(pts, raster(spark, d), ("dem", "height"), ("dem", "hem"), window=False)
    return R.elevation(pts, heights, 4.0, "constant", "per pixel").drop("lon", "lat", "exposure")


@check("builtup_gate", f"""SELECT point_id, coalesce(raw >= 100, TRUE) AS allowed FROM [all_pts] LEFT JOIN
    (SELECT point_id, raw FROM ({_SAMPLES}) WHERE source_id='urban') USING (point_id)""")
def builtup_gate(spark, d):
    return R.builtup_gate(view(spark, d, "all_pts"), raster(spark, d), ("urban", "built")).select("point_id", "allowed")


_STEP = "(30.0/111320.0)"
_WINDOW = " UNION ALL ".join(
    f"""SELECT point_id, '{c}' AS cell, fmod(px + ({e})*30.0/(111320.0*cos(py*{S.PI}/180)) + 540, 360.0) - 180 AS lon, py + ({n})*{_STEP} AS lat
    FROM (SELECT point_id, lon AS px, lat AS py FROM [all_pts])"""
    for c, (e, n) in {"nw": (-1, 1), "n": (0, 1), "ne": (1, 1), "w": (-1, 0), "c": (0, 0), "e": (1, 0), "sw": (-1, -1), "s": (0, -1), "se": (1, -1)}.items())
_Z = f"""SELECT point_id, {', '.join(f"max(CASE WHEN cell='{c}' THEN raw END) AS {c}" for c in ('nw','n','ne','w','c','e','sw','s','se'))}
    FROM ({S.raster_samples(_WINDOW)}) WHERE layer_id='height' GROUP BY 1 HAVING count(*) = 9"""
EXPOSURE = f"""SELECT point_id, round(slope, 4) AS slope_deg, round(rise*100, 4) AS slope_percent, slope < 2 AS flat,
    CASE WHEN slope >= 2 THEN round(CASE WHEN az<0 THEN az+360 ELSE az END, 4) END AS aspect_deg,
    CASE WHEN slope >= 2 THEN {S.compass('az')} ELSE '' END AS aspect_compass FROM
    (SELECT *, degrees(atan(rise)) AS slope, degrees(atan2(-gx, -gy)) AS az FROM
    (SELECT *, sqrt(gx*gx+gy*gy) AS rise FROM (SELECT point_id, ((ne+2*e+se)-(nw+2*w+sw))/240.0 AS gx, ((nw+2*n+ne)-(sw+2*s+se))/240.0 AS gy FROM ({_Z}))))"""


@check("exposure", EXPOSURE)
def exposure(spark, d):
    pts = view(spark, d, "all_pts").select("point_id", "lon", "lat")
    got = R.terrain(pts, raster(spark, d), ("dem", "height")).filter(F.col("exposure").isNotNull()).select("point_id", "exposure.*")
    return got.select("point_id", *[F.round(c, 4).alias(c) for c in ("slope_deg", "slope_percent")], "flat",
                      F.round("aspect_deg", 4).alias("aspect_deg"), "aspect_compass")
