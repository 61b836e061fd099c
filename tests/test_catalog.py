import random

import pytest
from pyspark.sql import functions as F

from checks.files import make_geopackage
from terralocus.functions.wkb import point_wkb, polygon_wkb
from terralocus.operators import catalog as C
from terralocus.operators import file_events as E
from terralocus.operators import manifests as M
from terralocus.operators import telemetry as T
from terralocus.operators.points import choose_sources, validate_points
from terralocus.sources import geopackage as K
from terralocus.sources import listing as I

EVENTS = "path string, t_ms bigint, op string, seq bigint"


def fold(events, quiet=500):
    """Bursts event by event: the rule the mergeable form must equal."""
    out, open_ = [], {}
    for path, t, op, _ in sorted(events, key=lambda e: (e[1], e[3])):
        op = {"remove": "delete", "rename": "delete", "create": "create"}.get(op, "modify")
        cur = open_.get(path)
        if cur and t - cur[2] >= quiet:
            out.append(cur)
            cur = None
        if cur is None:
            open_[path] = [path, t, t, op, 1]
            continue
        cur[2], cur[4] = t, cur[4] + 1
        if cur[3] == "delete" and op == "create":
            cur[3] = "create"
        elif op == "delete":
            cur[3] = "delete"
    return sorted(tuple(c) for c in [*out, *open_.values()])


@pytest.mark.parametrize("bucket", [1000, 5000, 10**9])
def test_debounce_matches_the_fold(spark, bucket):
    rng = random.Random(bucket)
    events, t = [], 0
    for seq in range(900):
        t += rng.choice([0, 1, 120, 400, 499, 500, 700])
        path = "a.gpkg" if rng.random() < 0.5 else rng.choice(["b.gpkg", "c.zip"])
        events.append((path, t, rng.choice(["create", "write", "chmod", "remove", "rename"]), seq))
    df = spark.createDataFrame([*events, ("x.txt", 1, "create", -1)], EVENTS)
    got = sorted((r["path"], r["start_ms"], r["end_ms"], r["op"], r["events"]) for r in E.debounce(df, bucket_ms=bucket).collect())
    assert got == fold(events)


def test_apply_events(spark):
    catalog = spark.createDataFrame([("a", "x/a.gpkg"), ("b", "x/b.gpkg")], "source_id string, path string")
    bursts = spark.createDataFrame([("x/a.gpkg", "delete", 1), ("y/c.zip", "create", 2), ("x/b.gpkg", "delete", 3), ("z/b.gpkg", "modify", 9)], "path string, op string, end_ms bigint")
    assert sorted(map(tuple, E.apply_events(catalog, bursts).collect())) == [("b", "z/b.gpkg"), ("c", "y/c.zip")]


def test_sync_plan(spark):
    listing = spark.createDataFrame([("d/a.gpkg", "1"), ("d/b.zip", "2"), ("d/note.txt", "3"), ("e/b.zip", "4")], "key string, etag string")
    loaded = spark.createDataFrame([("b", "d/b.zip", "old"), ("gone", "d/gone.zip", "1")], "source_id string, path string, etag string")
    plan = {r["source_id"]: r["action"] for r in C.sync_plan(listing, loaded.drop("etag")).collect()}
    assert plan == {"a": "add", "b": "keep", "gone": "remove"}
    assert {r["source_id"]: r["action"] for r in C.sync_plan(listing, loaded, changed=True).collect()}["b"] == "update"
    assert [tuple(r) for r in C.id_collisions(listing).collect()] == [("b", "e/b.zip", "d/b.zip")]


def test_status_of_a_source_without_layers(spark):
    sources = spark.createDataFrame([("a", "ready", True), ("b", "ready", False), ("c", "error", True)], "source_id string, status string, indexed boolean")
    layers = spark.createDataFrame([("c", True), ("c", False)], "source_id string, has_index boolean")
    status = C.catalog_status(sources, layers)
    assert {r["source_id"]: r["ready"] for r in status.collect()} == {"a": True, "b": False, "c": False}
    assert tuple(C.catalog_totals(status).first()) == (3, 1, 1)


def test_source_choice(spark):
    sources = spark.createDataFrame([("a", "ready"), ("b", "error")], "source_id string, status string")
    assert [r[0] for r in choose_sources(sources, None).select("source_id").collect()] == ["a"]
    assert choose_sources(sources, ["b"]).count() == 0
    with pytest.raises(ValueError, match="nope"):
        choose_sources(sources, ["a", "nope"])


def test_validation_rejects_nan_and_keeps_zero(spark):
    rows = [(0.0, 0.0, 4326), (float("nan"), 0.0, 4326), (180.0, -90.0, 4326), (180.1, 0.0, 4326), (0.0, 90.5, 4326), (9e6, 9e6, 3857)]
    got = [r["invalid"] and r["invalid"]["field"] for r in validate_points(spark.createDataFrame(rows, "x double, y double, srid int")).collect()]
    assert got == [None, "longitude", None, "longitude", "latitude", None]


def test_legend(spark):
    lines = spark.createDataFrame([("title",), ("1:  Af   Tropical, rainforest   [0 0 255]",), (" 30: EF Polar [102 102 102] ",)], "line string")
    assert [tuple(r) for r in M.parse_legend(lines).orderBy("value").collect()] == [
        (1, "Af", "Tropical, rainforest", "Tropical", "#0000FF"), (30, "EF", "Polar", "Polar", "#666666")]
    with pytest.raises(ValueError, match="duplicate"):
        M.parse_legend(lines.union(spark.createDataFrame([("1: BWh x [1 2 3]",)], "line string")))
    with pytest.raises(ValueError, match="no legend rows"):
        M.parse_legend(lines.limit(1))


def test_traces(spark):
    s = spark.sql("""SELECT * FROM VALUES
      ('a','1',NULL,'GET /q',TIMESTAMP'2024-01-01 00:00:00',TIMESTAMP'2024-01-01 00:00:02','Ok'),
      ('a','2','1','db',TIMESTAMP'2024-01-01 00:00:01',TIMESTAMP'2024-01-01 00:00:05','Error'),
      ('b','3',NULL,'GET /x',TIMESTAMP'2024-01-01 00:00:00',NULL,'Unset'),
      ('c','4','9','orphan',TIMESTAMP'2024-01-01 00:00:00',TIMESTAMP'2024-01-01 00:00:01','Ok'),
      ('d','5',NULL,'POST /q',TIMESTAMP'2024-01-02 00:00:00',TIMESTAMP'2024-01-02 00:00:01','Error')
      AS t(trace_id,span_id,parent_span_id,name,start,end,status_code)""")
    found = T.trace_search(s).collect()
    assert [(r["trace_id"], r["root_name"], r["status_code"], r["span_count"], r["duration_ms"]) for r in found] == [
        ("d", "POST /q", "Error", 1, 1000.0), ("a", "GET /q", "Ok", 2, 5000.0)]
    assert [r["trace_id"] for r in T.trace_search(s, status="Error").collect()] == ["d"]
    assert [r["trace_id"] for r in T.trace_search(s, name_contains="get", limit=1).collect()] == ["a"]
    assert [r["span_id"] for r in T.get_trace(s, "a").collect()] == ["1", "2"]
    stats = T.trace_stats(s).first()
    assert (stats["traces_stored"], stats["error_traces_stored"], stats["traces_active"], stats["spans_active"]) == (1, 1, 2, 1)


def test_geopackage(spark, tmp_path):
    square = polygon_wkb([[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]])
    rows = [(i, f"n{i}" if i % 2 else None, i * 10, square if i else None) for i in range(0, 25)]
    make_geopackage(str(tmp_path / "one.gpkg"), {"areas": ("POLYGON", [("name", "TEXT"), ("n", "INTEGER")], rows),
                                                 "spots": ("POINT", [("v", "REAL")], [(1, 1.5, point_wkb(3, 4))])},
                    [(1, None, "text/plain", "plain words"), (2, "http://c", "application/json", '{"license": {"name": "CC0"}, "description": ""}')])
    make_geopackage(str(tmp_path / "two.GPKG"), {"areas": ("POLYGON", [("name", "TEXT"), ("n", "INTEGER")], [(7, "x", 1, square)])})
    areas = K.read_layer(spark, str(tmp_path), "areas", rows_per_task=10)
    assert areas.rdd.getNumPartitions() == 4
    got = sorted((r["source_id"], r["fid"], r["name"], r["n"], r["geom_wkb"] is None) for r in areas.collect())
    assert got == sorted([*[("one", i, f"n{i}" if i % 2 else None, i * 10, i == 0) for i in range(25)], ("two", 7, "x", 1, False)])
    paths = I.list_storage(spark, str(tmp_path)).selectExpr("key AS path")
    layers = sorted((r["source_id"], r["layer"], r["geometry_type"], r["srid"]) for r in K.read_catalog(paths).collect())
    assert layers == [("one", "areas", "POLYGON", 4326), ("one", "spots", "POINT", 4326), ("two", "areas", "POLYGON", 4326)]
    meta = C.source_metadata(K.read_metadata(paths), "http://c").collect()
    assert [(m["source_id"], m["license"]["name"], m["description"]) for m in meta] == [("one", "CC0", "plain words")]


def test_listing_below_prefix(spark):
    objects = spark.createDataFrame([("p/q/a.gpkg", '"e1"'), ("p/q/sub/b.ZIP", '"e2"'), ("p/x.gpkg", '"e3"'), ("p/q/c.txt", '"e4"')], "key string, etag string")
    assert sorted(map(tuple, I.below_prefix(objects, "/p/q/").collect())) == [("a.gpkg", "e1"), ("sub/b.ZIP", "e2")]


def test_percentiles_are_rows_of_the_group(spark):
    """More distinct durations than an approximate sketch keeps; one group holds nothing, one a single row, one only ties."""
    schema = "method string, route string, duration_s double"
    many = spark.range(60_000).select(F.lit("GET").alias("method"), F.lit("").alias("route"), ((F.col("id") * 7919 % 60_000) + 1).cast("double").alias("duration_s"))
    few = spark.createDataFrame([(None, "/a", 4.0), ("PUT", "/a", None)] + [("POST", "/b", 2.5)] * 7, schema)
    got = {(r.method, r.path): (r.p50, r.p95, r.p99) for r in T.duration_percentiles(many.unionByName(few)).collect()}
    assert got == {("GET", "unknown"): (30_000.0, 57_000.0, 59_400.0), (None, "/a"): (4.0,) * 3, ("PUT", "/a"): (None,) * 3, ("POST", "/b"): (2.5,) * 3}
