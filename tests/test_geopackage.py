"""GeoPackages whose files differ."""

import io
import struct

import pytest

from checks.files import make_geopackage
from terralocus.functions.wkb import point_wkb, polygon_wkb
from terralocus.sources import geopackage as K


def folder(tmp_path):
    make_geopackage(str(tmp_path / "a.gpkg"), {"p": ("POINT", [("name", "TEXT"), ("n", "INTEGER"), ("size", "INTEGER")], [(1, "x", 5, 1, point_wkb(1.0, 2.0)), (10**9, "y", None, 2, None)])})
    make_geopackage(str(tmp_path / "b.GPKG"), {"p": ("POINT", [("size", "REAL"), ("n", "TEXT"), ("late", "BOOLEAN")], [(i, 0.5, "t", i % 2, point_wkb(0.0, 0.0)) for i in range(1, 8)]),
                                               "other": ("POINT", [], [(1, None)])})
    make_geopackage(str(tmp_path / "c.gpkg"), {"other": ("POINT", [("z", "TEXT")], [(1, "z", None)])})
    return str(tmp_path)


def test_columns_of_all_files_and_sparse_ids(spark, tmp_path):
    path = folder(tmp_path)
    for df in (K.read_layer(spark, path, "p", rows_per_task=3), K.read_layer(spark, f"file://{path}", "p")):
        assert dict(df.dtypes) == {"fid": "bigint", "name": "string", "n": "string", "size": "double", "late": "boolean", "geom_wkb": "binary", "source_id": "string"}
        rows = sorted(df.collect(), key=lambda r: (r.source_id, r.fid))
        assert [(r.source_id, r.fid, r.name, r.n, r.size, r.late) for r in rows[:3]] == [("a", 1, "x", "5", 1.0, None), ("a", 10**9, "y", None, 2.0, None), ("b", 1, None, "t", 0.5, True)]
        assert len(rows) == 9 and bytes(rows[0].geom_wkb) == point_wkb(1.0, 2.0) and rows[1].geom_wkb is None
    assert K._ranges(K.connect(f"{path}/a.gpkg"), {"layer": "p"}, 100) == [(1, 10**9 + 1)]


def test_only_asked_columns(spark, tmp_path):
    df = K.read_layer(spark, folder(tmp_path), "p", columns=["size"])
    assert df.columns == ["fid", "size", "source_id"] and df.count() == 9


def test_data_source_merges_too(spark, tmp_path):
    spark.dataSource.register(K.GeoPackageSource)
    df = spark.read.format("geopackage").option("layer", "p").option("rowsPerTask", "2").load(folder(tmp_path))
    assert df.count() == 9 and dict(df.dtypes)["size"] == "double"


def test_files_that_are_not_mounted_are_copied(spark, tmp_path, monkeypatch):
    path = folder(tmp_path)
    monkeypatch.setattr(K, "_is_mounted", lambda p: False)
    assert K.read_layer(spark, path, "p").count() == 9


def grid(tmp_path, rtree):
    """100 x 20 points, a square over several of them, and a row without geometry."""
    points = [(1 + x + 100 * y, f"p{x}", point_wkb(float(x), float(y))) for x in range(100) for y in range(20)]
    square = polygon_wkb([[(10.5, 3.5), (12.5, 3.5), (12.5, 5.5), (10.5, 5.5), (10.5, 3.5)]])
    make_geopackage(str(tmp_path / f"g{int(rtree)}.gpkg"), {"p": ("GEOMETRY", [("name", "TEXT")], [*points, (5000, "square", square), (5001, "none", None)])}, rtree=rtree)
    return str(tmp_path / f"g{int(rtree)}.gpkg")


@pytest.mark.parametrize("rtree", [True, False])
def test_extent_reads_only_matching_rows(spark, tmp_path, monkeypatch, rtree):
    path = grid(tmp_path, rtree)
    extent = (12.0, 4.0, 14.0, 5.5)
    want = {1 + x + 100 * y for x in (12, 13, 14) for y in (4, 5)} | {5000}
    for columns in (None, ["name"]):
        df = K.read_layer(spark, path, "p", rows_per_task=3, columns=columns, extent=extent)
        assert {r["fid"] for r in df.collect()} == want
    assert K.read_layer(spark, path, "p", extent=(500.0, 500.0, 600.0, 600.0)).count() == 0
    # rows that leave SQLite, and the shares they are dealt in
    con = K.connect(path)
    layer = K._layer_of(con, "p")
    shares = K._ranges_within(con, layer, 3, extent)
    assert sum(hi - lo for lo, hi in shares) < 1_000 if rtree else shares[-1][1] == 5002
    looked = []
    monkeypatch.setattr(K, "meets", lambda box, e, old=K.meets: looked.append(box) or old(box, e))
    fields = [f for f in K.read_layer(spark, path, "p", columns=["name"]).schema.fields if f.name != "source_id"]
    rows = [b for lo, hi in shares for b in K._read_rows(path, path, "p", fields, lo, hi, extent)]
    assert sum(b.num_rows for b in rows) == 7 and len(looked) == (7 if rtree else 2002)


def test_envelopes():
    box = struct.pack("<4d", 1.0, 2.0, 3.0, 4.0)
    assert K.envelope(b"GP\x00\x03" + struct.pack("<i", 4326) + box + point_wkb(9.0, 9.0)) == (1.0, 3.0, 2.0, 4.0)
    assert K.envelope(K.wrap_wkb(point_wkb(5.0, 6.0), 4326)) == (5.0, 6.0, 5.0, 6.0) and K.envelope(None) is None
    assert not K.meets(None, (0, 0, 1, 1)) and K.meets((1, 1, 2, 2), (0, 0, 1, 1)) and not K.meets((1.1, 1, 2, 2), (0, 0, 1, 1))


def test_ids_and_extent_as_options(spark, tmp_path):
    path = grid(tmp_path, True)
    schema = K.GeoPackageSource({"path": path, "layer": "p"}).schema()
    reader = K._Reader(schema, {"path": path, "layer": "p", "rowsPerTask": "50", "ids": "120,180"})
    assert [(p.lo, p.hi) for p in reader.partitions()] == [(120, 151), (151, 180)] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 60
    spark.dataSource.register(K.GeoPackageSource)
    read = spark.read.format("geopackage").option("layer", "p").option("extent", "0,0,20,1")
    assert read.load(path).count() == 42
    assert {r["fid"] for r in read.option("ids", "6,10").load(path).collect()} == {6, 7, 8, 9}


def test_files_are_fetched_in_parts(monkeypatch):
    monkeypatch.setattr(K, "PART_BYTES", 7)
    out = io.BytesIO()
    assert K.fetch_in_parts(io.BytesIO(bytes(range(100))), out) == 100 and out.getvalue() == bytes(range(100))
