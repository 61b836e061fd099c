"""GeoPackages and raster bundles written by Spark tasks from the views."""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from terralocus.functions.wkb import point_wkb, polygon_wkb
from terralocus.sources.geopackage import envelope, local_path, wrap_wkb


def make_geopackage(path: str, layers: dict, metadata: list | None = None, rtree: bool = False) -> None:
    """layers: name -> (geometry type, [(column, sql type)], rows of (fid, *values, wkb)); with `rtree`, layers have their R-tree."""
    partial = f"{path}.part"
    if os.path.exists(partial):
        os.remove(partial)
    con = sqlite3.connect(partial)
    con.execute("CREATE TABLE gpkg_contents(table_name TEXT, data_type TEXT, identifier TEXT, description TEXT, srs_id INT)")
    con.execute("CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT, z INT, m INT)")
    for name, (kind, columns, rows) in layers.items():
        con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?, 4326)", (name, name, f"layer {name}"))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (name, kind))
        declared = "".join(f', "{c}" {t}' for c, t in columns)
        con.execute(f'CREATE TABLE "{name}"(fid INTEGER PRIMARY KEY{declared}, geom BLOB)')
        marks = ", ".join("?" * (len(columns) + 2))
        con.executemany(f'INSERT INTO "{name}" VALUES ({marks})',
                        [(*row[:-1], None if row[-1] is None else wrap_wkb(row[-1], 4326)) for row in rows])
        if rtree:
            boxes = [(row[0], envelope(row[-1])) for row in rows]
            con.execute(f'CREATE VIRTUAL TABLE "rtree_{name}_geom" USING rtree(id, minx, maxx, miny, maxy)')
            con.executemany(f'INSERT INTO "rtree_{name}_geom" VALUES (?, ?, ?, ?, ?)', [(i, b[0], b[2], b[1], b[3]) for i, b in boxes if b])
    if metadata is not None:
        con.execute("CREATE TABLE gpkg_metadata(id INTEGER PRIMARY KEY, md_scope TEXT, md_standard_uri TEXT, mime_type TEXT, metadata TEXT)")
        con.executemany("INSERT INTO gpkg_metadata VALUES (?, 'dataset', ?, ?, ?)", metadata)
    con.commit()
    con.close()
    os.replace(partial, path)


def write_geopackages(places: DataFrame, units: DataFrame, folder: str, rtree: bool = False) -> None:
    """Rows spread over files of about 50,000 rows by their id; one task writes one file. With `rtree`, all but the first file have R-trees."""
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)
    files = 4 + places.count() // 50_000
    both = places.select(F.lit(1).alias("is_place"), "fid", "name", "place", "population", F.col("place_lon").alias("a"),
                         F.col("place_lat").alias("b"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("e"))
    both = both.unionByName(units.select(
        F.lit(0).alias("is_place"), "fid", "name", F.col("admin_level").alias("place"), F.col("parent_id").alias("population"),
        F.col("xmin").alias("a"), F.col("ymin").alias("b"), F.col("xmax").alias("c"), F.col("ymax").alias("e")))

    def write(pdf):
        part = int(pdf["part"].iloc[0])
        value = lambda v: None if v != v or v is None else int(v)
        spots = [(int(r.fid), r.name_, r.place, value(r.population), point_wkb(r.a, r.b))
                 for r in pdf[pdf.is_place == 1].rename(columns={"name": "name_"}).itertuples()]
        boxes = [(int(r.fid), r.name_, r.place, value(r.population), polygon_wkb([[(r.a, r.b), (r.c, r.b), (r.c, r.e), (r.a, r.e), (r.a, r.b)]]))
                 for r in pdf[pdf.is_place == 0].rename(columns={"name": "name_"}).itertuples()]
        make_geopackage(f"{root}/part{part:04d}.gpkg", {
            "places": ("POINT", [("name", "TEXT"), ("place", "TEXT"), ("population", "INTEGER")], spots),
            "units": ("POLYGON", [("name", "TEXT"), ("admin_level", "TEXT"), ("parent_id", "INTEGER")], boxes)}, rtree=rtree and part > 0)
        return pdf[["part"]].head(1)

    both.withColumn("part", (F.col("fid") % files).cast("int")).groupBy("part").applyInPandas(write, "part int").write.format("noop").mode("overwrite").save()


def _lzw(data: bytes) -> bytes:
    """Valid but uncompressed LZW: literals with a clear code before codes widen."""
    codes = []
    for i in range(0, len(data), 250):
        codes += [256, *data[i:i + 250]]
    codes.append(257)
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def _predicted(chunk: np.ndarray, predictor: int) -> bytes:
    """Bytes of a chunk as a writer stores them under the predictor."""
    if predictor == 2:
        return np.diff(chunk, axis=1, prepend=np.zeros((len(chunk), 1), chunk.dtype)).astype(chunk.dtype).tobytes()
    if predictor == 3:
        size = chunk.dtype.itemsize
        planes = np.ascontiguousarray(chunk.astype(f">f{size}")).view(np.uint8).reshape(len(chunk), -1, size).transpose(0, 2, 1).reshape(len(chunk), -1)
        return np.diff(planes, axis=1, prepend=np.zeros((len(chunk), 1), np.uint8)).astype(np.uint8).tobytes()
    return np.ascontiguousarray(chunk).tobytes()


def make_tiff(pixels: np.ndarray, x0: float, y0: float, d: float, compression: int = 1, tile: int = 0, predictor: int = 1,
              big: bool = False, sparse: float | None = None) -> bytes:
    """Little-endian GeoTIFF of one band, in strips of 8 rows or in square tiles; `sparse` leaves out tiles of that value only."""
    height, width = pixels.shape
    kinds = {"u": 1, "i": 2, "f": 3}
    pack = {1: bytes, 5: _lzw, 8: zlib.compress}[compression]
    if tile:
        padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), dtype=pixels.dtype)
        padded[:height, :width] = pixels
        chunks = [padded[y:y + tile, x:x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
    else:
        chunks = [pixels[y:y + 8] for y in range(0, height, 8)]
    blobs = [b"" if sparse is not None and (c == sparse).all() else pack(_predicted(c, predictor)) for c in chunks]
    n, wide, inline = len(blobs), "Q" if big else "I", 8 if big else 4
    tags = [(256, "I", [width]), (257, "I", [height]), (258, "H", [pixels.dtype.itemsize * 8]), (259, "H", [compression]),
            (262, "H", [1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [kinds[pixels.dtype.kind]]), (33550, "d", [d, d, 0.0]),
            (33922, "d", [0.0, 0.0, 0.0, x0, y0, 0.0])]
    tags += [(322, "I", [tile]), (323, "I", [tile]), (324, wide, None), (325, wide, [len(b) for b in blobs])] if tile else \
            [(273, wide, None), (278, "I", [8]), (279, wide, [len(b) for b in blobs])]
    if sparse is not None:
        tags.append((42113, "s", str(sparse).encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    lengths = [len(v) if isinstance(v, bytes) else struct.calcsize(f"<{n if v is None else len(v)}{t}") for _, t, v in tags]
    first = 16 if big else 8
    head = first + (8 if big else 2) + len(tags) * (20 if big else 12) + inline
    start = head + sum(size for size in lengths if size > inline)
    offsets = [0 if not b else start + sum(map(len, blobs[:i])) for i, b in enumerate(blobs)]
    entries, extra = b"", b""
    for code, kind, values in tags:
        values = offsets if values is None else values
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{kind}", *values)
        where = raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack("<" + wide, head + len(extra))
        extra += raw if len(raw) > inline else b""
        entries += struct.pack("<HH" + wide, code, {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}[kind], len(values)) + where
    begin = b"II" + (struct.pack("<HHHQQ", 43, 8, 0, 16, len(tags)) if big else struct.pack("<HIH", 42, 8, len(tags)))
    return begin + entries + bytes(inline) + extra + b"".join(blobs)


def make_bundle(path: str, manifest: dict, members: dict[str, bytes], packed: bool = False) -> None:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        z.writestr("raster.yaml", json.dumps(manifest))
        for name, data in members.items():
            z.writestr(name, data)
    with open(f"{path}.part", "wb") as f:
        f.write(buffer.getvalue())
    os.replace(f"{path}.part", path)


def write_bundles(cells: DataFrame, labels: DataFrame, folder: str) -> None:
    """One bundle per latitude band: tiled heights and a class layer with the given labels.

    `labels(value, name)` is at most one row per region.
    """
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)
    table = {str(r["value"]): {"label": r["name"], "rank": 10 * r["value"], "even": r["value"] % 2 == 0, "note": None} for r in labels.collect()}

    def write(pdf):
        lat = int(pdf["lat_cell"].iloc[0])
        r, c = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
        members = {}
        for lon in pdf["lon_cell"]:
            pixels = ((r * 31 + c * 17 + lat * 7 + (int(lon) + 20) * 13) % 256).astype("<i2")
            name = f"N{lat:02d}_{'W' if lon < 0 else 'E'}{abs(int(lon)):03d}.tif"
            members[f"tiles/{name}"] = make_tiff(pixels, float(lon), lat + 1.0, 1 / 32, (1, 5, 8)[lat % 3], 16 if lat % 2 else 0)
        members["kind.tif"] = make_tiff(np.full((4, 4), 1 + lat % 5, dtype="u1"), -10.0, 65.0, 10.0)
        layer = {"id": "kind", "file": "kind.tif", "nodata": 0}
        if lat % 2:
            layer["value_mapping"] = "kind.json"
            members["kind.json"] = json.dumps(table).encode()
        else:
            layer["mapping"] = table
        make_bundle(f"{root}/band-{lat}.zip", {
            "schema_version": 1, "id": f"band-{lat}", "name": f"Band {lat}", "license": {"name": "CC0"}, "crs": "EPSG:4326",
            "layers": [{"id": "height", "value_type": "continuous", "nodata": 255, "tiles": {"dir": "tiles", "pattern": "{ns}{lat}_{ew}{lon}.tif"}}, layer],
        }, members)
        return pdf[["lat_cell"]].head(1)

    cells.groupBy("lat_cell").applyInPandas(write, "lat_cell int").write.format("noop").mode("overwrite").save()


def write_broken_bundles(cells: DataFrame, folder: str) -> None:
    """One bundle per latitude band, four of five with a fault of their own."""
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)

    def write(pdf):
        lat = int(pdf["lat_cell"].iloc[0])
        layer = {"id": "kind", "file": "kind.tif", "mapping": {"1": {"label": "one"}}}
        manifest = {"schema_version": 1, "id": f"odd-{lat}", "name": "Odd", "license": {"name": "CC0"}, "crs": "EPSG:4326", "layers": [layer]}
        fault = lat % 5
        if fault == 1:
            manifest["layers"] = [layer, layer]
        elif fault == 2:
            manifest["crs"] = "EPSG:1"
        elif fault == 3:
            layer["no_data"] = 0
        elif fault == 4:
            layer["sampling"] = "cubic"
        make_bundle(f"{root}/odd-{lat}.zip", manifest, {"kind.tif": make_tiff(np.ones((4, 4), dtype="u1"), -10.0, 65.0, 10.0)})
        return pdf[["lat_cell"]].head(1)

    cells.groupBy("lat_cell").applyInPandas(write, "lat_cell int").write.format("noop").mode("overwrite").save()


def write_float_bundles(cells: DataFrame, folder: str) -> None:
    """One bundle per latitude band: heights in metres and parts of a metre, one image of 16-pixel tiles over all its cells.

    All have the floating-point predictor; every second is a big file, every third a packed member.
    """
    root = local_path(folder)
    os.makedirs(root, exist_ok=True)

    def write(pdf):
        lat, lons = int(pdf["lat_cell"].iloc[0]), sorted(int(v) for v in pdf["lon_cell"])
        r, c = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
        image = np.full((32, 32 * (lons[-1] - lons[0] + 1)), -1.0, dtype="<f4" if lat % 2 else "<f8")
        for lon in lons:
            at = 32 * (lon - lons[0])
            image[:, at:at + 32] = ((r * 31 + c * 17 + lat * 7 + (lon + 20) * 13) % 256) / 4
        data = make_tiff(image, float(lons[0]), lat + 1.0, 1 / 32, 8 if lat % 4 else 1, 16, 3, lat % 2 == 0, -1.0)
        make_bundle(f"{root}/float-{lat}.zip", {
            "schema_version": 1, "id": f"float-{lat}", "name": f"Float {lat}", "license": {"name": "CC0"}, "crs": "EPSG:4326",
            "layers": [{"id": "height", "value_type": "continuous", "nodata": -1, "file": "height.tif"}]}, {"height.tif": data}, lat % 3 == 0)
        return pdf[["lat_cell"]].head(1)

    cells.groupBy("lat_cell").applyInPandas(write, "lat_cell int").write.format("noop").mode("overwrite").save()
