"""Distances and bearings on the WGS84 ellipsoid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# WGS84 semi-major axis (m), flattening, mean radius (km).
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
MEAN_RADIUS_KM = 6371.0088

# A great-circle distance on the mean sphere and the geodesic differ by less
# than this share, so (1 + SPHERE_SLACK) turns the first into a safe bound.
SPHERE_SLACK = 0.0062
# Shortest length of one degree of latitude (km), rounded down.
MIN_KM_PER_DEG = 110.5

_MAX_ROUNDS = 60


def vincenty(lon1, lat1, lon2, lat2):
    """Vincenty's inverse problem on arrays: (km, azimuth at point 1 in degrees).

    Coincident points give 0 km and a NaN azimuth; pairs that do not converge
    (nearly antipodal) give NaN for both.
    """
    b_axis = WGS84_A * (1.0 - WGS84_F)
    lon1, lat1, lon2, lat2 = (np.asarray(v, dtype=np.float64) for v in (lon1, lat1, lon2, lat2))
    diff = np.radians(lon2 - lon1)
    u1 = np.arctan((1.0 - WGS84_F) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1.0 - WGS84_F) * np.tan(np.radians(lat2)))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = diff
    done = np.zeros(diff.shape, dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(_MAX_ROUNDS):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cos_s = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_al = np.where(sin_s == 0, 0.0, cu1 * cu2 * sl / np.where(sin_s == 0, 1.0, sin_s))
            cos2_al = 1.0 - sin_al * sin_al
            cos_2m = np.where(cos2_al == 0, 0.0, cos_s - 2 * su1 * su2 / np.where(cos2_al == 0, 1.0, cos2_al))
            c = WGS84_F / 16 * cos2_al * (4 + WGS84_F * (4 - 3 * cos2_al))
            new = diff + (1 - c) * WGS84_F * sin_al * (
                sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m * cos_2m - 1))
            )
            done = np.abs(new - lam) < 1e-12
            lam = new
            if bool(np.all(done | np.isnan(lam))):
                break
        u_sq = cos2_al * (WGS84_A**2 - b_axis**2) / b_axis**2
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        delta = big_b * sin_s * (
            cos_2m
            + big_b / 4 * (
                cos_s * (2 * cos_2m**2 - 1)
                - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)
            )
        )
        km = b_axis * big_a * (sigma - delta) / 1000.0
        turn = np.degrees(np.arctan2(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam)))
        # a hair west of north is 0: `turn % 360` would give 360 for it
        azimuth = np.fmod(turn + 360.0, 360.0)
    same = (lon1 == lon2) & (lat1 == lat2)
    # a last step below 1e-9 rad (millimetres) still counts as converged
    settled = done | (np.abs(new - lam) < 1e-9)
    km = np.where(same, 0.0, np.where(settled, km, np.nan))
    azimuth = np.where(same | ~settled, np.nan, azimuth)
    return km, azimuth


@pandas_udf(DoubleType())
def _distance_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(vincenty(lon1, lat1, lon2, lat2)[0])


@pandas_udf(DoubleType())
def _azimuth_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(vincenty(lon1, lat1, lon2, lat2)[1])


def _nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in km (Arrow batches; the iteration has no built-in)."""
    return _nan_to_null(_distance_udf(lon1, lat1, lon2, lat2))


def azimuth_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing 1 -> 2 in [0, 360); NULL when the points coincide."""
    return _nan_to_null(_azimuth_udf(lon1, lat1, lon2, lat2))


def sphere_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on the mean sphere; a cheap JVM-side pre-filter."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return 2 * MEAN_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def radius_box(lon: Column, lat: Column, radius_km: Column | float) -> dict[str, Column]:
    """Half-widths in degrees of the published radius box, cosine floored at 0.01."""
    r = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    half_lat = r / 111.32
    half_lon = r / (F.greatest(F.cos(lat * F.lit(np.pi) / 180), F.lit(0.01)) * 111.32)
    return {
        "min_x": lon - half_lon,
        "max_x": lon + half_lon,
        "min_y": lat - half_lat,
        "max_y": lat + half_lat,
    }
