"""Batch answers, raster layers in other systems, joins that keep rows without a key."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralocus.functions import geometry
from terralocus.operators import raster as R
from terralocus.operators import skew
from terralocus.operators.layer_index import SLAB_SEGMENTS, build_index
from terralocus.operators.points import reproject_points
from terralocus.plans.query import Catalog, VectorLayer, answer_batch, hits_and_errors
from terralocus.sources.sinks import answer_lines

INPUTS = "idx bigint, id string, lon double, lat double, x double, y double, srid int"
SOURCES = "source_id string, status string, license_name string, license_url string, license_attribution string, name string"
LAYERS = "source_id string, layer_id string, srid int, grid_deg int, nodata double, value_type string, output_property string, scale double, offset double"


def inputs(spark):
    return spark.createDataFrame([(1, "a", 2.0, 2.0, None, None, None), (2, "", None, None, 200.0, 2.0, 0), (3, None, None, None, None, None, None),
                                  (4, "m", None, None, 222638.98, 222684.21, 3857)], INPUTS)


def catalog(spark, **more):
    sources = spark.createDataFrame([("s", "ready", "CC0", "http://l", "me", "Squares"), ("off", "loading", "", "", "", None)], SOURCES)
    box = spark.createDataFrame([(7, "west", 3)], "fid bigint, name string, pop int").withColumn(
        "rings", geometry.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0)))
    return Catalog(sources, [VectorLayer("s", "squares", 0, "POLYGON", box, ["name", "pop"])], **more)


def test_nothing_to_ask_gives_empty_answers(spark):
    empty = Catalog(spark.createDataFrame([], SOURCES), [])
    rows = answer_batch(inputs(spark), empty, srids=(4326, 3857)).collect()
    assert len(rows) == 4 and all(r["results"] == [] and r["total_features"] == 0 for r in rows)


def test_answers_have_license_name_geometry_and_place(spark):
    answers = answer_batch(inputs(spark), catalog(spark), srids=(4326, 3857), with_geometry=True)
    lines = {r["point_id"]: r for r in (json.loads(x["value"]) for x in answer_lines(answers).collect())}
    result, = lines[1]["results"]
    assert (result["source_name"], result["license"], result["feature_count"]) == ("Squares", {"name": "CC0", "url": "http://l", "attribution": "me"}, 1)
    feature, = result["features"]
    assert feature["properties"] == {"name": "west", "pop": 3} and feature["fid"] == 7
    assert feature["geometry"]["type"].upper() == "POLYGON" and feature["geometry"]["wkt"].startswith("POLYGON")
    assert lines[1]["wgs84"] == {"lon": 2.0, "lat": 2.0} and lines[4]["results"][0]["features"][0]["fid"] == 7
    assert lines[2]["invalid"]["field"] == "longitude" and lines[3]["error"] and lines[3]["results"] == [] and lines[3]["wgs84"] is None


def image(spark, srid, x0, y0, step, values, kind="continuous", nodata=None, source="s"):
    layers = spark.createDataFrame([(source, "l", srid, None, nodata, kind, "v", None, None)], LAYERS)
    images = spark.createDataFrame([(source, "l", 0, 0, x0, y0, step, step, values.shape[1], values.shape[0], values.ravel().tolist())],
                                   "source_id string, layer_id string, lat_cell int, lon_cell int, x0 double, y0 double, dx double, dy double, width int, height int, pixels array<double>")
    return R.Raster(layers, images.drop("pixels"), R.cut_blocks(images))


@pytest.mark.parametrize("srid,lon,lat", [(3857, 9.0, 50.0), (25832, 9.0, 50.0), (25833, 15.0, 52.0), (4326, 9.0, 50.0)])
def test_layers_are_sampled_in_their_own_system(spark, srid, lon, lat):
    pts = spark.createDataFrame([(1, lon, lat, 4326), (2, lon + 20, lat, 4326), (3, None, lat, 4326)], "point_id bigint, x double, y double, srid int")
    located = reproject_points(pts, [srid, 4326], (4326,))
    at = located.filter("point_id = 1").first()
    x, y = at[f"x_{srid}"], at[f"y_{srid}"]
    # known places: the central meridians of the zones are at 500 km, 9 degrees east at 1001.875 km in Mercator
    assert x == pytest.approx({3857: 1001875.417, 25832: 500000.0, 25833: 500000.0, 4326: 9.0}[srid], abs=1e-3)
    step = 0.1 if srid == 4326 else 1000.0
    raster = image(spark, srid, x - 4.5 * step, y + 2.5 * step, step, np.arange(100.0).reshape(10, 10))
    got = R.sample_covering(located, raster, raster.layers).collect()
    assert [(r["point_id"], r["raw"]) for r in got] == [(1, 24.0)]


def test_only_chosen_ready_layers_are_sampled_and_failures_stay_apart(spark):
    values = np.array([[1.0, 2.0], [3.0, 4.0]])
    table = spark.createDataFrame([("s", "l", 1, '{"a":1}'), ("s", "l", 4, '{"a":"x"}')], "source_id string, layer_id string, value bigint, properties string")
    good = image(spark, 4326, 0.0, 4.0, 2.0, values, "categorical")
    off = image(spark, 4326, 0.0, 4.0, 2.0, values, "categorical", source="off")
    both = R.Raster(good.layers.unionByName(off.layers), good.tiles.unionByName(off.tiles), good.blocks.unionByName(off.blocks))
    pts = spark.createDataFrame([(1, 1.0, 3.0, 4326), (2, 3.0, 3.0, 4326), (3, 3.0, 1.0, 4326)], "point_id bigint, x double, y double, srid int")
    hits, errors = hits_and_errors(pts, catalog(spark, raster=both, mapping=table), srids=(4326,))
    assert sorted((r["point_id"], r["properties"]) for r in hits.filter("layer = 'l'").collect()) == [(1, '{"a":1}'), (3, '{"a":"x"}')]
    assert [tuple(r) for r in errors.collect()] == [(2, "s", "l", "pixel value 2 has no mapping entry")]
    assert hits.filter("layer = 'squares'").count() == 3


def test_layers_without_a_projection_are_errors(spark):
    """Vector and raster layers in a system that is not supported, and points in one; equal systems need no projection."""
    known = catalog(spark, raster=image(spark, 2056, 0.0, 4.0, 2.0, np.array([[1.0, 2.0], [3.0, 4.0]])))
    square = known.layers[0]
    known = replace(known, layers=[square, replace(square, name="swiss", ordinal=1, srid=2056), replace(square, source_id="off", srid=2056)])
    pts = spark.createDataFrame([(1, 1.0, 3.0, 4326), (2, 1.0, 3.0, 2056), (3, 1.0, 3.0, 27700)], "point_id bigint, x double, y double, srid int")
    hits, errors = hits_and_errors(pts, known, srids=(4326,))
    assert sorted((r["point_id"], r["layer"]) for r in hits.collect()) == [(1, "squares"), (2, "l"), (2, "swiss")]
    assert sorted((r["point_id"], r["layer"], r["error"]) for r in errors.collect()) == [
        (p, layer, f"no projection from system {a} to {b}") for p, layer, a, b in
        [(1, "l", 4326, 2056), (1, "swiss", 4326, 2056), (2, "squares", 2056, 4326), (3, "l", 27700, 2056), (3, "squares", 27700, 4326), (3, "swiss", 27700, 2056)]]


@pytest.mark.parametrize("limit", [0, 1_000])
@pytest.mark.parametrize("how,want", [("inner", [1, 1]), ("left", [None, None, 1, 1, 2]), ("left_semi", [1, 1]), ("left_anti", [None, None, 2])])
def test_rows_without_a_key(spark, monkeypatch, how, want, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    big = spark.createDataFrame([(1, 0), (None, 1), (2, 2), (None, 3), (1, 4)], "k int, v int")
    side = spark.createDataFrame([(1, "x"), (None, "never"), (9, "y")], "k int, t string")
    rows = skew.lookup_join(big, side, ["k"], how, spread_by=["v"]).collect()
    assert sorted((r["k"] for r in rows), key=lambda k: (k is not None, k)) == want
    if how == "left":
        assert {r["t"] for r in rows if r["k"] is None} == {None}


def test_sizes_count_real_bytes(spark):
    wide = spark.createDataFrame([("x" * 5_000, [1.0] * 100, {"k": "v" * 300})] * 3, "a string, b array<double>, c map<string,string>")
    size = skew.measure(wide)
    assert size.rows == 3 and 3 * 6_000 < size.bytes < 3 * 8_000


def test_long_outlines_keep_short_slabs(spark):
    t = np.linspace(0, 2 * np.pi, 20_000, endpoint=False)
    r = 10 + np.sin(40 * t)
    ring = [{"x": float(a), "y": float(b)} for a, b in zip(r * np.cos(t), r * np.sin(t))]
    tiny = [{"x": 5.0 + dx, "y": 5.0 + dy} for dx, dy in ((0, 0), (1e-6, 0), (0, 1e-6), (0, 0))]
    table = spark.createDataFrame([(1, [ring + ring[:1]]), (2, [tiny])], "fid bigint, rings array<array<struct<x:double,y:double>>>")
    index = build_index(table, ["fid"])
    longest = index.rows.agg(F.max(F.size("segments"))).first()[0]
    assert longest <= 128
    assert min(r[0] for r in index.rungs) < -8
