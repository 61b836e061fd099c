"""Slope and aspect of a 3x3 height window."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .labels import compass

# Fixed values.
SPACING_M = 30.0
FLAT_BELOW_DEG = 2.0
M_PER_DEG = 111320.0
MAX_ABS_LAT = 85.0
# name -> (steps east, steps north)
WINDOW = {
    "nw": (-1, 1), "n": (0, 1), "ne": (1, 1),
    "w": (-1, 0), "c": (0, 0), "e": (1, 0),
    "sw": (-1, -1), "s": (0, -1), "se": (1, -1),
}


def wrap_lon(lon: Column) -> Column:
    """Longitude brought into [-180, 180) the way a truncated remainder does."""
    return (lon + 540) % 360 - 180


def window_positions(lon: Column, lat: Column, spacing_m: float = SPACING_M) -> Column:
    """ARRAY<STRUCT<cell, lon, lat>>: the nine sample positions around a point."""
    step_lat = F.lit(spacing_m / M_PER_DEG)
    step_lon = F.lit(spacing_m) / (F.cos(lat * F.lit(math.pi) / 180) * M_PER_DEG)
    return F.array(*[
        F.struct(
            F.lit(cell).alias("cell"),
            wrap_lon(lon + step_lon * float(east)).alias("lon"),
            (lat + step_lat * float(north)).alias("lat"),
        )
        for cell, (east, north) in WINDOW.items()
    ])


def slope_aspect(z: dict[str, Column], spacing_m: float = SPACING_M) -> Column:
    """STRUCT of slope, grade, aspect, compass and flat flag; NULL if a height is missing."""
    east = (z["ne"] + z["e"] * 2 + z["se"] - (z["nw"] + z["w"] * 2 + z["sw"])) / (8 * spacing_m)
    north = (z["nw"] + z["n"] * 2 + z["ne"] - (z["sw"] + z["s"] * 2 + z["se"])) / (8 * spacing_m)
    rise = F.hypot(east, north)
    slope = F.degrees(F.atan(rise))
    flat = slope < FLAT_BELOW_DEG
    downhill = F.degrees(F.atan2(-east, -north))
    aspect = F.when(downhill < 0, downhill + 360).otherwise(downhill)
    complete = z["c"].isNotNull()
    for height in z.values():
        complete = complete & height.isNotNull()
    return F.when(complete, F.struct(
        slope.alias("slope_deg"),
        (rise * 100).alias("slope_percent"),
        F.when(~flat, aspect).alias("aspect_deg"),
        F.when(flat, F.lit("")).otherwise(compass(aspect)).alias("aspect_compass"),
        flat.alias("flat"),
        F.lit(float(spacing_m)).alias("sample_spacing_m"),
    ))
