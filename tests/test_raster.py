import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.files import make_bundle, make_tiff
from terralocus.operators import raster as R
from terralocus.sources import raster_bundle as B, tiff
from terralocus.sources.ranges import Member

LAYERS = ("source_id string, layer_id string, srid int, grid_deg int, nodata double, value_type string, output_property string, scale double, offset double")


def globe(spark, nodata=0.0, **over):
    image = np.zeros((128, 256))
    dx = 360 / 256
    lon, lat = np.meshgrid(-180 + (np.arange(256) + 0.5) * dx, 90 - (np.arange(128) + 0.5) * dx)
    image[(lon > 0) & (lon < 40) & (lat > 0) & (lat < 40)] = 100
    image[(lon > 60) & (lon < 100) & (lat > 0) & (lat < 40)] = 200
    kind = over.get("value_type", "categorical")
    layers = spark.createDataFrame([("s", "l", 4326, None, nodata, kind, None, over.get("scale"), over.get("offset"))], LAYERS)
    images = spark.createDataFrame([("s", "l", 0, 0, -180.0, 90.0, dx, dx, 256, 128, image.ravel().tolist())],
                                   "source_id string, layer_id string, lat_cell int, lon_cell int, x0 double, y0 double, dx double, dy double, width int, height int, pixels array<double>")
    return R.Raster(layers, images.drop("pixels"), R.cut_blocks(images))


def points(spark, *xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, lon double, lat double")


def mapping(spark):
    return spark.createDataFrame([("s", "l", 100, {"name": "west"}), ("s", "l", 200, {"name": "east"})],
                                 "source_id string, layer_id string, value bigint, properties map<string,string>")


def sample(spark, raster, *xy):
    return R.sample_pixels(R.assign_layers(points(spark, *xy), raster.layers), raster, spread_by=["point_id"])


SPOTS = [(20, 20), (80, 20), (50, 20), (-100, -50), (500, 0)]


def test_categorical(spark):
    hits, errors = R.categorical_values(sample(spark, globe(spark), *SPOTS), mapping(spark))
    assert sorted((r["point_id"], r["fid"], r["properties"]["name"]) for r in hits.collect()) == [(0, 100, "west"), (1, 200, "east")]
    assert errors.count() == 0


def test_unmapped_value_is_an_error_of_that_point(spark, shuffled):
    hits, errors = R.categorical_values(sample(spark, globe(spark, nodata=None), *SPOTS), mapping(spark))
    assert hits.count() == 2
    assert sorted((r["point_id"], r["value"]) for r in errors.collect()) == [(2, 0), (3, 0)]
    with pytest.raises(Exception, match="no mapping entry"):
        R.categorical_values(sample(spark, globe(spark, nodata=None), *SPOTS), mapping(spark), strict=True)[0].collect()


def test_continuous(spark):
    plain = R.continuous_values(sample(spark, globe(spark, value_type="continuous"), *SPOTS)).collect()
    assert sorted((r["point_id"], r["property"], r["value"]) for r in plain) == [(0, "value", 100.0), (1, "value", 200.0)]
    scaled = R.continuous_values(sample(spark, globe(spark, value_type="continuous", scale=0.5, offset=3.0), (20, 20))).first()
    assert scaled["value"] == 53.0


@pytest.mark.parametrize("lon,lat,grid,cell,name", [
    (10.3, 49.7, 1, (49, 10), "N49_E010"), (-0.5, -0.5, 1, (-1, -1), "S01_W001"), (151.2, -33.9, 1, (-34, 151), "S34_E151"),
    (-24.5, 72.1, 1, (72, -25), "N72_W025"), (11.0, 49.0, 2, (48, 10), "N48_E010")])
def test_tile_route(spark, lon, lat, grid, cell, name):
    c = R.cell_of(F.lit(lon), F.lit(lat), F.lit(grid))
    row = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).withColumn("n", R.tile_name("{ns}{lat}_{ew}{lon}", F.col("lat_cell"), F.col("lon_cell"))).first()
    assert (row["lat_cell"], row["lon_cell"]) == cell and row["n"] == name


def test_elevation_and_gate(spark):
    raster = globe(spark, value_type="continuous")
    pts = points(spark, (20, 20), (20, -20))
    heights = R.terrain(pts, raster, ("s", "l"))
    got = {r["point_id"]: r for r in R.elevation(pts, heights, 4.0, "constant", "per pixel").collect()}
    assert (got[0]["meters"], got[0]["sea_level"], got[0]["accuracy_m"]) == (100.0, False, 4.0)
    assert (got[1]["meters"], got[1]["sea_level"], got[1]["accuracy_m"], got[1]["accuracy_basis"]) == (0.0, True, None, "sea-level convention")
    assert {r["point_id"]: r["allowed"] for r in R.builtup_gate(pts, raster, ("s", "l"), 150.0).collect()} == {0: False, 1: True}
    assert R.builtup_gate(pts, None, None).filter("allowed").count() == 2


def test_exposure_needs_the_window_and_the_latitude(spark):
    pts = points(spark, (20, 20), (0.00001, 20), (20, 89), (20, 39.999))
    image = globe(spark, nodata=None, value_type="continuous")
    got = {r["point_id"]: r["exposure"] for r in R.terrain(pts, image, ("s", "l")).collect()}
    assert got[0]["flat"] and got[2] is None
    missing = {r["point_id"]: r["exposure"] for r in R.terrain(pts, globe(spark, value_type="continuous"), ("s", "l")).collect()}
    assert missing[0]["flat"] and missing[1] is None


@pytest.mark.parametrize("dtype", ["u1", "i1", "<u2", "<i2", "<u4", "<i4", "<f4", "<f8"])
@pytest.mark.parametrize("compression,tile", [(1, 0), (5, 0), (8, 16)])
def test_tiff_round_trip(dtype, compression, tile):
    rng = np.random.default_rng(4)
    pixels = rng.integers(0, 100, (37, 45)).astype(dtype)
    got = B.read_tiff(make_tiff(pixels, 10.0, 50.0, 0.25, compression, tile))
    assert (got["width"], got["height"], got["x0"], got["y0"], got["dx"]) == (45, 37, 10.0, 50.0, 0.25)
    assert np.array_equal(got["pixels"].reshape(37, 45), pixels.astype(float))


def test_real_lzw_codes():
    # TIFF LZW of b"\x07\x07\x07\x08\x08\x07\x07\x06\x06" as the format's own example gives it
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert tiff.unlzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_bundles_are_read_and_bad_ones_reported(spark, tmp_path):
    pixels = np.arange(16, dtype="u1").reshape(4, 4)
    base = {"schema_version": 1, "name": "x", "license": {"name": "CC0"}, "crs": "EPSG:4326"}
    make_bundle(str(tmp_path / "good.zip"), {**base, "id": "good", "layers": [{"id": "a", "file": "a.tif", "value_mapping": "m.json", "nodata": 3}]},
                {"a.tif": make_tiff(pixels, 0.0, 4.0, 1.0), "m.json": b'{"5": {"name": "five", "rank": 5, "open": true, "note": null}}'})
    make_bundle(str(tmp_path / "wrong.zip"), {**base, "id": "other", "layers": []}, {})
    make_bundle(str(tmp_path / "broken.zip"), {**base, "id": "broken", "layers": [{"id": "a", "file": "a.tif", "mapping": {}}]}, {"a.tif": b"no image"})
    (tmp_path / "junk.zip").write_bytes(b"not a zip")
    one = {"id": "a", "file": "a.tif", "mapping": {"1": {}}}
    image = {"a.tif": make_tiff(pixels, 0.0, 4.0, 1.0)}
    make_bundle(str(tmp_path / "twice.zip"), {**base, "id": "twice", "layers": [one, one]}, image)
    make_bundle(str(tmp_path / "crs.zip"), {**base, "id": "crs", "crs": "EPSG:99999", "layers": [one]}, image)
    make_bundle(str(tmp_path / "field.zip"), {**base, "id": "field", "layers": [{**one, "no_data": 3}]}, image)
    make_bundle(str(tmp_path / "sampled.zip"), {**base, "id": "sampled", "layers": [{**one, "sampling": "cubic"}]}, image)
    paths = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.zip"))], "path string")
    bundles = B.read_bundles(paths, block=2)
    B.write_tables(bundles, str(tmp_path / "tables"))
    raster = B.load_raster(spark, str(tmp_path / "tables"), 2)
    assert sorted(r["source_id"] for r in bundles.rejects.collect()) == ["broken", "crs", "field", "junk", "sampled", "twice", "wrong"]
    why = {r["source_id"]: r["error"] for r in bundles.rejects.collect()}
    assert "layer_id_unique a" in why["twice"] and "crs_supported" in why["crs"] and "unknown field no_data" in why["field"] and "sampling a" in why["sampled"]
    got = {r["point_id"]: r["raw"] for r in R.sample_pixels(R.assign_layers(points(spark, (1.5, 2.5), (3.5, 3.5), (0.0, 0.5)), raster.layers.filter("source_id = 'good'")), raster).collect()}
    assert got == {0: 5.0, 2: 12.0}  # pixel 3 is nodata
    assert [(r["value"], r["properties"]) for r in bundles.mapping.collect()] == [(5, '{"name":"five","rank":5,"open":true,"note":null}')]


def lzw_of(data: bytes) -> bytes:
    """A plain LZW writer with growing codes."""
    table, codes, width, now, bits = {}, [], 9, b"", []

    def put(code):
        bits.append(f"{code:0{width}b}")

    table, n = {bytes([i]): i for i in range(256)}, 258
    put(256)
    for b in data:
        longer = now + bytes([b])
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer], n = n, n + 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
        if n == 4094:
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        now = bytes([b])
    if now:
        put(table[now])
        n += 1
        width = 9 + (n > 511) + (n > 1023) + (n > 2047)
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaaaa" * 50, bytes(range(256)) * 40, np.random.default_rng(1).integers(0, 4, 60_000).astype("u1").tobytes(),
                                  np.random.default_rng(2).integers(0, 256, 30_000).astype("u1").tobytes()])
def test_lzw_of_growing_codes(data):
    assert tiff.unlzw(lzw_of(data)) == data


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("dtype,predictor", [("<f4", 3), ("<f8", 3), ("<i2", 2), ("<u4", 2)])
@pytest.mark.parametrize("tile", [0, 16])
def test_predictors_and_big_files(dtype, predictor, tile, big):
    rng = np.random.default_rng(5)
    pixels = (rng.normal(300, 90, (37, 45)) if dtype[1] == "f" else rng.integers(0, 30_000, (37, 45))).astype(dtype)
    got = B.read_tiff(make_tiff(pixels, 10.0, 50.0, 0.25, 8, tile, predictor, big))
    assert np.array_equal(got["pixels"].reshape(37, 45), pixels.astype(float))


def test_missing_tiles_are_nodata():
    pixels = np.full((40, 40), -9.0, dtype="<f4")
    pixels[:16, 16:32] = 5
    got = B.read_tiff(make_tiff(pixels, 0.0, 40.0, 1.0, 8, 16, 3, True, -9.0))
    assert np.array_equal(got["pixels"].reshape(40, 40), pixels.astype(float))


@pytest.mark.parametrize("block", [8, 16, 24, 32, 100])
@pytest.mark.parametrize("tile", [0, 16])
def test_units_hold_whole_blocks_once(tile, block):
    pixels = np.arange(70 * 90, dtype="<f4").reshape(70, 90)
    data = make_tiff(pixels, 0.0, 70.0, 1.0, 1, tile)
    read = lambda at, n: data[at:at + n]
    head = tiff.header(read)
    seen = np.zeros((70, 90), int)
    for x, y, w, h, chunks in tiff.units(head, block):
        assert x % block == 0 and y % block == 0
        assert np.array_equal(tiff.read_unit(read, head, x, y, w, h, chunks), pixels[y:y + h, x:x + w])
        seen[y:y + h, x:x + w] += 1
    assert (seen == 1).all()


@pytest.mark.parametrize("packed", [False, True])
def test_a_tile_reads_only_its_ranges(tmp_path, packed):
    pixels = np.random.default_rng(3).normal(0, 1, (512, 512)).astype("<f8")
    make_bundle(str(tmp_path / "b.zip"), {}, {"a.tif": make_tiff(pixels, 0.0, 512.0, 1.0, 1, 32, 3, True)}, packed)

    class Counted:
        def __init__(self, path):
            self.file, self.bytes = open(path, "rb"), 0

        def read(self, n=-1):
            out = self.file.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

    file = Counted(tmp_path / "b.zip")
    member = Member("", "a.tif", file)
    assert member.stored is not packed
    head = tiff.header(member.read_at)
    before = file.bytes
    unit = list(tiff.units(head, 32))[77]
    x, y = unit[:2]
    assert np.array_equal(tiff.read_unit(member.read_at, head, *unit), pixels[y:y + 32, x:x + 32])
    if not packed:
        assert before < 30_000 and file.bytes - before == 32 * 32 * 8
    with pytest.raises(ValueError):
        member.read_at(member.size - 1, 2)


def test_an_image_with_a_broken_tile_is_refused_whole(spark, tmp_path):
    pixels = np.arange(64 * 64, dtype="<f4").reshape(64, 64)
    good = make_tiff(pixels, 0.0, 64.0, 1.0, 8, 16, 3)
    bad = bytearray(good)
    bad[-40:-20] = b"x" * 20  # the last tile does not unpack
    layers = [{"id": n, "file": f"{n}.tif", "value_type": "continuous"} for n in ("good", "bad", "none")]
    make_bundle(str(tmp_path / "b.zip"), {"schema_version": 1, "id": "b", "name": "b", "license": {"name": "CC0"}, "crs": "EPSG:4326", "layers": layers},
                {"good.tif": good, "bad.tif": bytes(bad)})
    bundles = B.read_bundles(spark.createDataFrame([(str(tmp_path / "b.zip"),)], "path string"), block=16)
    assert sorted(r["layer_id"] for r in bundles.rejects.collect()) == ["bad", "none"]
    assert {(r["layer_id"], r["width"]) for r in bundles.raster.tiles.collect()} == {("good", 64)}
    blocks = bundles.raster.blocks.collect()
    assert len(blocks) == 16 and sum(sum(b["pixels"]) for b in blocks) == pixels.sum()
