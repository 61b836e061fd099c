import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralocus.functions import attributes as A
from terralocus.functions import crs, geometry, labels, terrain
from terralocus.functions.geodesy import vincenty


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("azimuth,points,label", [
    (22, 8, "N"), (45, 8, "NE"), (359, 8, "N"), (-90, 8, "W"), (720, 8, "N"), (22, 16, "NNE"), (338, 16, "NNW"), (180, 5, "S")])
def test_compass(spark, azimuth, points, label):
    assert one(spark, labels.compass(F.lit(float(azimuth)), points))[0] == label


def test_compass_of_nothing_is_null(spark):
    assert one(spark, labels.compass(F.lit(None).cast("double")))[0] is None


@pytest.mark.parametrize("km,shown", [(0.24, 0), (0.25, 0.5), (3.7, 3.5), (3.8, 4), (9.9, 10), (10.4, 10), (10.6, 11)])
def test_round_distance(spark, km, shown):
    assert one(spark, labels.round_distance(F.lit(km)))[0] == shown


def test_labels(spark):
    row = one(spark, labels.bearing_label(F.lit(4.0), F.lit("E"), F.lit("Würzburg")), labels.bearing_label(F.lit(3.5), F.lit("SW"), F.lit("Volkach")))
    assert tuple(row) == ("4 km E Würzburg", "3.5 km SW Volkach")


def test_distance_and_azimuth():
    km, az = vincenty([10.0, 10.0, 0.0], [50.0, 50.0, 0.0], [10.1, 10.0, 0.0], [50.0, 50.0, 1.0])
    assert 7.0 < km[0] < 7.5 and 88 < az[0] < 92
    assert km[1] == 0 and math.isnan(az[1])
    assert km[2] == pytest.approx(110.5744, abs=1e-3)  # one degree of meridian at the equator


def test_known_geodesic():
    # Flinders Peak - Buninyong, the classical check of the method
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    a = (dms(144, 25, 29.52440), dms(-37, 57, 3.72030))
    b = (dms(143, 55, 35.38390), dms(-37, 39, 10.15610))
    km, az = vincenty([a[0]], [a[1]], [b[0]], [b[1]])
    assert km[0] == pytest.approx(54.972271, abs=2e-4)
    assert az[0] == pytest.approx(dms(306, 52, 5.37), abs=1e-3)


def _plane(gx, gy):
    """Heights of a plane falling towards (gx east, gy north)."""
    return {name: F.lit(100.0 + gx * 30 * e + gy * 30 * n) for name, (e, n) in terrain.WINDOW.items()}


@pytest.mark.parametrize("gx,gy,compass,aspect", [
    (0, 1, "S", 180), (0, -1, "N", 0), (-1, 0, "E", 90), (1, 0, "W", 270), (-1, 1, "SE", 135)])
def test_tilted_planes(spark, gx, gy, compass, aspect):
    k = math.tan(math.radians(10)) / math.hypot(gx, gy)
    got = one(spark, terrain.slope_aspect(_plane(gx * k, gy * k)).alias("e"))["e"]
    assert got["slope_deg"] == pytest.approx(10, abs=1e-6)
    assert got["aspect_compass"] == compass and got["aspect_deg"] == pytest.approx(aspect, abs=1e-6)
    assert not got["flat"]


@pytest.mark.parametrize("deg,flat", [(1.5, True), (2.5, False)])
def test_flat_threshold(spark, deg, flat):
    got = one(spark, terrain.slope_aspect(_plane(math.tan(math.radians(deg)), 0)).alias("e"))["e"]
    assert got["flat"] is flat and (got["aspect_deg"] is None) is flat


def test_missing_height_gives_no_exposure(spark):
    z = _plane(0.1, 0.1) | {"sw": F.lit(None).cast("double")}
    assert one(spark, terrain.slope_aspect(z).alias("e"))["e"] is None


@pytest.mark.parametrize("path,sid", [
    ("/a/b/x.gpkg", "x"), (".gpkg", ".gpkg"), ("a.tar.zip", "a.tar"), ("", ""), ("dir/", "dir"), (".", ""), ("/", "/"), ("plain", "plain")])
def test_source_id(spark, path, sid):
    assert one(spark, A.source_id(F.lit(path)))[0] == sid


@pytest.mark.parametrize("text,value", [("8", 8), ("+4", 4), (" 8 ", None), ("8a", None), ("", None), ("99999999999", None)])
def test_level_number(spark, text, value):
    assert one(spark, A.level_number(F.lit(text)))[0] == value


@pytest.mark.parametrize("text,point", [
    ("POINT(10 50)", (10, 50)), ("POINT Z(1.5  -2 3)", (1.5, -2)), ("POINT(1)", None), ("nothing", None), ("POINT(a b)", None)])
def test_parse_point(spark, text, point):
    got = one(spark, geometry.parse_point(F.lit(text)).alias("p"))["p"]
    assert (None if got is None else tuple(got)) == point


def test_point_wkt(spark):
    row = one(spark, geometry.point_wkt(F.lit(1.5), F.lit(2.0)), geometry.point_wkt(F.lit(1.5), F.lit(2.0), F.lit(3.0)))
    assert tuple(row) == ("POINT(1.500000 2.000000)", "POINT Z(1.500000 2.000000 3.000000)")


POINTS = [(9.0, 50.0), (10.0, 49.0), (6.5, 51.2), (12.3, 47.9), (15.0, 54.0)]


@pytest.mark.parametrize("srid,tolerance", [(3857, 1e-9), (25832, 1e-9), (25833, 1e-9), (31466, 2e-6), (31467, 2e-6)])
def test_projection_round_trip(spark, srid, tolerance):
    df = spark.createDataFrame([(*p, 4326, srid) for p in POINTS], "x double, y double, srid int, back int")
    there = crs.reproject(df, "x", "y", "srid", srid, "tx", "ty")
    again = crs.reproject(there, "tx", "ty", "back", 4326, "bx", "by").collect()
    for row in again:
        assert abs(row["bx"] - row["x"]) < tolerance and abs(row["by"] - row["y"]) < tolerance


def test_projection_values(spark):
    df = spark.createDataFrame([(9.0, 0.0, 4326), (9.0, 50.0, 4326), (180.0, 0.0, 4326), (1.0, 2.0, 999)], "x double, y double, srid int")
    utm = [tuple(r) for r in crs.reproject(df, "x", "y", "srid", 25832, "tx", "ty").select("tx", "ty").collect()]
    assert utm[0] == pytest.approx((500000, 0), abs=1e-6)
    assert utm[1] == pytest.approx((500000, 5538630.7027), abs=1e-3)
    assert utm[3] == (None, None)
    mercator = crs.reproject(df, "x", "y", "srid", 3857, "tx", "ty").collect()
    assert mercator[2]["tx"] == pytest.approx(20037508.342789244, abs=1e-6)
    # the same system keeps its exact values
    assert crs.reproject(df, "x", "y", "srid", 4326, "tx", "ty").first()["tx"] == 9.0


def test_covers_column_on_rings_with_a_hole(spark):
    rng = np.random.default_rng(3)
    ring = [(0.0, 0.0), (4.0, 1.0), (8.0, 0.0), (7.0, 6.0), (3.0, 3.0), (1.0, 7.0), (0.0, 0.0)]
    hole = [(5.0, 2.0), (6.0, 2.0), (6.0, 3.0), (5.0, 3.0), (5.0, 2.0)]
    rings = [[{"x": x, "y": y} for x, y in r] for r in (ring, hole)]
    pts = [(float(x), float(y)) for x, y in rng.integers(0, 17, (400, 2)) / 2]
    df = spark.createDataFrame([(rings, x, y) for x, y in pts], "rings array<array<struct<x:double,y:double>>>, x double, y double")
    df = df.withColumn("segments", geometry.edges(F.col("rings")))
    rows = df.select(geometry.covers(F.col("segments"), F.col("x"), F.col("y")).alias("a"), "x", "y").collect()
    by_place = {(r["x"], r["y"]): r["a"] for r in rows}
    for spot, expected in {(5.5, 2.5): False, (5.0, 2.5): True, (4.0, 1.0): True, (3.0, 3.5): False}.items():
        if spot in by_place:
            assert by_place[spot] is expected


def test_azimuth_stays_below_a_full_turn():
    """-14 to 166 degrees goes over the pole: a hair west of north, which is 0 and not 360."""
    lon, lat = -10 + (10240 * 7919 % 40960) / 1024, 35 + (10240 * 104729 % 30720) / 1024
    lon2, lat2 = -170 + (10240 * 613 % 348160) / 1024, -20 + (10240 * 877 % 102400) / 1024
    _, az = vincenty([lon, 0.0], [lat, 0.0], [lon2, -1e-14], [lat2, 60.0])
    assert (az < 360).all() and az[0] == pytest.approx(0, abs=1e-9)
