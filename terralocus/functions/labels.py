"""Compass roses, distance rounding and bearing labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Clockwise roses from north.
ROSE_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
ROSE_16 = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def compass(azimuth: Column, points: int = 8) -> Column:
    """Nearest rose point; any `points` other than 16 means the 8-point rose."""
    rose = ROSE_16 if points == 16 else ROSE_8
    sector = F.round(F.pmod(azimuth, F.lit(360.0)) / (360.0 / len(rose))).cast("int")
    return F.when(azimuth.isNotNull(), F.get(F.array(*map(F.lit, rose)), F.pmod(sector, F.lit(len(rose)))))


def round_distance(km: Column) -> Column:
    """Half kilometres below 10 km, whole kilometres from there on."""
    return F.when(km < 10, F.round(km * 2) / 2).otherwise(F.round(km))


def km_text(km: Column) -> Column:
    whole = km == F.floor(km)
    return F.when(whole, F.format_string("%.0f", km)).otherwise(F.format_string("%.1f", km))


def bearing_label(km: Column, direction: Column, name: Column) -> Column:
    """'4 km E Name' for an already rounded distance."""
    return F.concat(km_text(km), F.lit(" km "), direction, F.lit(" "), name)
