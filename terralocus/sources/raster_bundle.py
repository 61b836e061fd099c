"""Raster bundles (ZIP of manifest, GeoTIFFs, value tables) into raster tables.

Every step is a Spark job: manifests are read per bundle, directories per image,
pixels per internal tile. A row names the byte ranges of a tile, so one image
of many gigabytes is spread over all tasks, and a task holds one tile.
"""

from __future__ import annotations

import json
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.attributes import epsg_code, is_known_srid, source_id
from ..operators.manifests import raster_violations
from ..operators.raster import BLOCK, Raster
from ..operators.skew import lookup_join, spread_for_work
from ..session import cut_lineage, scratch_path
from . import tiff
from .ranges import Member, open_file

LAYER_TYPE = ("struct<id:string,description:string,file:string,tiles:struct<dir:string,pattern:string,grid_deg:int>,"
              "band:int,nodata:double,sampling:string,value_type:string,output_property:string,scale:double,offset:double,"
              "mapping:map<string,string>,value_mapping:string>")
MANIFEST_TYPE = ("struct<schema_version:int,id:string,name:string,description:string,"
                 "license:struct<name:string,attribution:string,url:string>,crs:string,"
                 f"layers:array<{LAYER_TYPE}>>")
# The fields a manifest and its layers may have.
MANIFEST_FIELDS = ["schema_version", "id", "name", "description", "license", "crs", "layers"]
LAYER_FIELDS = ["id", "description", "file", "tiles", "band", "nodata", "sampling", "value_type", "output_property", "scale",
                "offset", "mapping", "value_mapping"]
MANIFEST_NAME = r"[^/]*raster\.ya?ml"


def read_tiff(data: bytes, band: int = 1) -> dict:
    """First image of a GeoTIFF in memory: size, origin, pixel size, samples as float64."""
    def read(offset: int, n: int) -> bytes:
        return data[offset:offset + n]

    head = tiff.header(read, band)
    image = np.zeros((head["height"], head["width"]))
    for x, y, width, height, chunks in tiff.units(head, 1):
        image[y:y + height, x:x + width] = tiff.read_unit(read, head, x, y, width, height, chunks)
    return {**{k: head[k] for k in ("width", "height", "x0", "y0", "dx", "dy")}, "pixels": image.ravel()}


def _parse(text: bytes):
    """YAML, or JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def _text_keys(value):
    if isinstance(value, dict):
        return {str(k): _text_keys(v) for k, v in value.items()}
    return [_text_keys(v) for v in value] if isinstance(value, list) else value


def _read_manifest(path: str) -> tuple[str | None, str | None, str | None]:
    """(manifest JSON, member names JSON, error); value tables are put in line."""
    try:
        with open_file(path) as f, zipfile.ZipFile(f) as z:
            names = z.namelist()
            found = [n for n in names if re.fullmatch(MANIFEST_NAME, n)]
            if not found:
                return None, None, "no manifest at the root"
            doc = _text_keys(_parse(z.read(found[0])))
            for layer in doc.get("layers", []):
                if layer.get("value_mapping") and not layer.get("mapping"):
                    layer["mapping"] = _text_keys(_parse(z.read(layer["value_mapping"])))
                for key in layer.get("mapping") or {}:
                    int(key)
            return json.dumps(doc), json.dumps(names), None
    except (OSError, KeyError, ValueError, AttributeError, TypeError, zipfile.BadZipFile) as e:
        return None, None, f"{type(e).__name__}: {e}"


@dataclass(frozen=True)
class Bundles:
    manifests: DataFrame
    raster: Raster
    mapping: DataFrame
    rejects: DataFrame


def read_manifests(paths: DataFrame) -> DataFrame:
    """(path, source_id, manifest STRUCT, members, error), one row per bundle."""
    def run(batches):
        for pdf in batches:
            pdf[["doc", "names", "error"]] = [_read_manifest(p) for p in pdf["path"]]
            yield pdf
    named = spread_for_work(paths.select("path", source_id(F.col("path")).alias("source_id")), "path")
    raw = named.mapInPandas(run, "path string, source_id string, doc string, names string, error string")
    raw = raw.withColumns({"manifest": F.from_json("doc", MANIFEST_TYPE), "members": F.from_json("names", "array<string>")})
    rows = raw.join(_broken_rules(raw), "source_id", "left")
    broken = F.when(F.size("rules") > 0, F.concat(F.lit("broken rules: "), F.array_join("rules", ", ")))
    return rows.select("path", "source_id", "manifest", "members", F.coalesce("error", broken).alias("error"))


def _broken_rules(raw: DataFrame) -> DataFrame:
    """(source_id, rules): every rule of the manifest contract that a readable bundle breaks."""
    read = raw.filter("error IS NULL")
    manifests = read.select(
        "source_id", "manifest.schema_version", "manifest.id", "manifest.name", F.col("manifest.license.name").alias("license_name"),
        "manifest.crs", F.size("manifest.layers").alias("layer_count"))
    layer = read.select("source_id", F.explode("manifest.layers").alias("l"))
    own_table = F.when(F.coalesce("l.value_mapping", F.lit("")) == "", F.map_keys("l.mapping"))  # a sidecar is read into the mapping
    layers = layer.select(
        "source_id", F.col("l.id").alias("layer_id"), "l.file", F.col("l.tiles.dir").alias("tiles_dir"), F.col("l.tiles.pattern").alias("tiles_pattern"),
        F.col("l.tiles.grid_deg").alias("grid_deg"), "l.band", "l.sampling", "l.value_type", own_table.alias("mapping_keys"), "l.value_mapping")
    found = raster_violations(manifests, layers).select("source_id", F.concat_ws(" ", "rule", "layer_id").alias("rule"))
    # a misspelt field would else be ignored
    texts = F.coalesce(F.from_json("doc", "layers array<string>")["layers"], F.array().cast("array<string>"))
    fields = F.array_union(
        F.array_except(F.json_object_keys("doc"), F.array(*map(F.lit, MANIFEST_FIELDS))),
        F.array_except(F.flatten(F.transform(texts, F.json_object_keys)), F.array(*map(F.lit, LAYER_FIELDS))))
    unknown = read.select("source_id", F.explode(fields).alias("f")).select("source_id", F.concat(F.lit("unknown field "), "f").alias("rule"))
    system = manifests.filter(~is_known_srid(F.coalesce(epsg_code(F.col("crs")), F.lit(0)))).select("source_id", F.lit("crs_supported").alias("rule"))
    return found.unionByName(unknown).unionByName(system).groupBy("source_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def value_mapping(manifests: DataFrame) -> DataFrame:
    """(source_id, layer_id, value, properties) of inline and sidecar tables; properties are JSON text, so types stay."""
    layers = manifests.filter("error IS NULL").select("source_id", F.explode("manifest.layers").alias("l"))
    return layers.select("source_id", F.col("l.id").alias("layer_id"), F.explode("l.mapping").alias("k", "properties")).select(
        "source_id", "layer_id", F.col("k").cast("bigint").alias("value"), "properties")


def raster_layers(manifests: DataFrame) -> DataFrame:
    one = manifests.filter("error IS NULL").select("source_id", "manifest.crs", F.explode("manifest.layers").alias("l"))
    return one.select(
        "source_id", F.col("l.id").alias("layer_id"), epsg_code(F.col("crs")).alias("srid"),
        F.when(F.col("l.tiles").isNotNull(), F.coalesce("l.tiles.grid_deg", F.lit(1))).alias("grid_deg"),
        F.col("l.nodata").alias("nodata"), F.coalesce("l.value_type", F.lit("categorical")).alias("value_type"),
        F.coalesce("l.output_property", F.lit("value")).alias("output_property"),
        F.coalesce("l.scale", F.lit(1.0)).alias("scale"), F.coalesce("l.offset", F.lit(0.0)).alias("offset"))


def _members(manifests: DataFrame) -> DataFrame:
    """One row per image to read: the layer's file, or each tile its pattern matches."""
    one = manifests.filter("error IS NULL").select("path", "source_id", "members", F.explode("manifest.layers").alias("l"))
    tiled = F.col("l.tiles").isNotNull()
    # the pattern as a regular expression with the cell's parts as groups
    pattern = F.regexp_replace(F.concat_ws("/", "l.tiles.dir", "l.tiles.pattern"), r"([.()\[\]+*?^$|])", r"\\$1")
    for token, group in {"{ns}": "(?<ns>[NS])", "{lat}": "(?<lat>[0-9]{2,})", "{ew}": "(?<ew>[EW])", "{lon}": "(?<lon>[0-9]{3,})"}.items():
        pattern = F.replace(pattern, F.lit(token), F.lit(group))
    files = F.when(tiled, F.filter("members", lambda m: m.endswith(".tif") | m.endswith(".tiff"))).otherwise(F.array(F.col("l.file")))
    return one.select("path", "source_id", F.col("l.id").alias("layer_id"), F.coalesce("l.band", F.lit(1)).alias("band"),
                      F.when(tiled, pattern).alias("pattern"), F.explode(files).alias("member")).filter(
        F.col("pattern").isNull() | F.rlike("member", F.concat(F.lit(r"\A(?:"), "pattern", F.lit(r")\z"))))


_HEAD = "source_id string, layer_id string, lat_cell int, lon_cell int, x0 double, y0 double, dx double, dy double, width int, height int"
UNIT_SCHEMA = (f"{_HEAD}, path string, member string, part int, layout string, ux int, uy int, unit_width int, unit_height int, "
               "chunks array<struct<x:int,y:int,offset:bigint,size:bigint>>, error string")
IMAGE_SCHEMA = f"{_HEAD}, bx int, by int, block_width int, pixels array<double>, error string"
_LAYOUT = ["width", "height", "chunk_width", "chunk_height", "tiled", "samples", "sample", "dtype", "compression", "predictor", "empty"]
_FAULTS = (ValueError, KeyError, OSError, struct.error, zlib.error, zipfile.BadZipFile, IndexError, EOFError, NotImplementedError)
# Rows that leave a task at once.
UNITS_AT_ONCE = 500


def _frames(rows, schema: str):
    """Data frames of some rows each, missing columns being null."""
    import pandas as pd

    names = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", schema)]
    whole = {c.strip().split()[0]: "Int32" for c in re.split(r",(?![^<]*>)", schema) if c.strip().endswith(" int")}
    held = []
    for row in rows:
        held.append({c: row.get(c) for c in names})
        if len(held) == UNITS_AT_ONCE:
            yield pd.DataFrame(held, columns=names).astype(whole)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype(whole)


def read_directories(manifests: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per internal tile of every image, with its byte ranges, or one with the reason an image was refused.

    Tiles that whole blocks do not fit into come in the least groups they fit
    into. `part` spreads the tiles of an image; those of a packed ZIP member, which
    can only be unpacked in order, have one part.
    """
    def units_of(row):
        lat = lon = 0
        if row.pattern:
            hit = re.fullmatch(row.pattern.replace("(?<", "(?P<"), row.member)
            lat = int(hit["lat"]) * (-1 if hit["ns"] == "S" else 1)
            lon = int(hit["lon"]) * (-1 if hit["ew"] == "W" else 1)
        base = {"source_id": row.source_id, "layer_id": row.layer_id, "lat_cell": lat, "lon_cell": lon, "path": row.path, "member": row.member}
        try:
            member = Member(row.path, row.member)
        except _FAULTS as e:
            yield {**base, "error": f"{row.member}: {e}"}
            return
        try:
            head = tiff.header(member.read_at, row.band)
            base |= {k: head[k] for k in ("x0", "y0", "dx", "dy", "width", "height")} | {"layout": json.dumps({k: head[k] for k in _LAYOUT})}
            for n, (x, y, width, height, chunks) in enumerate(tiff.units(head, block)):
                yield {**base, "part": n if member.stored else 0, "ux": x, "uy": y, "unit_width": width, "unit_height": height,
                       "chunks": [{"x": a, "y": b, "offset": o, "size": s} for a, b, o, s in chunks]}
        except _FAULTS as e:
            yield {**base, "error": f"{row.member}: {e}"}
        finally:
            member.close()

    def run(batches):
        for pdf in batches:
            yield from _frames((unit for row in pdf.itertuples() for unit in units_of(row)), UNIT_SCHEMA)

    return spread_for_work(_members(manifests), "path", "member").mapInPandas(run, UNIT_SCHEMA)


def blocks_of(pixels: np.ndarray, width: int, height: int, block: int):
    """(bx, by, block_width, pixels) of one image, row by row of blocks."""
    image = np.asarray(pixels, np.float64).reshape(height, width)
    for by in range(-(-height // block)):
        for bx in range(-(-width // block)):
            part = image[by * block:(by + 1) * block, bx * block:(bx + 1) * block]
            yield bx, by, part.shape[1], part.ravel()


def read_images(directories: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per block of every tile in `directories`, or one with the reason a tile could not be read."""
    def blocks(row, member):
        head = {k: getattr(row, k) for k in ("source_id", "layer_id", "lat_cell", "lon_cell", "x0", "y0", "dx", "dy", "width", "height")}
        try:
            chunks = [(c["x"], c["y"], c["offset"], c["size"]) for c in row.chunks]
            part = tiff.read_unit(member().read_at, json.loads(row.layout), row.ux, row.uy, row.unit_width, row.unit_height, chunks)
        except _FAULTS as e:
            yield {**head, "error": f"{row.member}: {e}"}
            return
        for bx, by, width, pixels in blocks_of(part, row.unit_width, row.unit_height, block):
            yield {**head, "bx": bx + row.ux // block, "by": by + row.uy // block, "block_width": width, "pixels": pixels}

    def run(batches):
        opened = {}

        def member_of(row):
            key = (row.path, row.member)
            if key not in opened:
                for old in opened.values():
                    old.close()
                opened.clear()
                opened[key] = Member(*key)
            return opened[key]

        def rows(pdf):
            for row in pdf.itertuples():
                yield from blocks(row, lambda row=row: member_of(row))

        for pdf in batches:
            yield from _frames(rows(pdf), IMAGE_SCHEMA)

    units = directories.filter(F.col("error").isNull())
    dealt = spread_for_work(units, "path", "member", "part").sortWithinPartitions("path", "member", F.col("chunks")[0]["offset"])
    refused = directories.filter(F.col("error").isNotNull()).selectExpr(*[
        f"cast({'null' if n in ('bx', 'by', 'block_width', 'pixels') else n} as {t}) as {n}" for n, t in (c.strip().split(" ", 1) for c in IMAGE_SCHEMA.split(", "))])
    return dealt.mapInPandas(run, IMAGE_SCHEMA).unionByName(refused)


def read_bundles(paths: DataFrame, block: int = BLOCK) -> Bundles:
    """Bundles whose manifests keep all rules; the others, and unreadable images, are rejects with a reason.

    Every tile is decoded once: its blocks are written to the shared folder
    and tiles, blocks and rejects are read from there.
    """
    spark = paths.sparkSession
    manifests = cut_lineage(read_manifests(paths))
    path = scratch_path(spark, "images")
    read_images(cut_lineage(read_directories(manifests, block)), block).write.parquet(path)
    images = spark.read.parquet(path)
    key = ["source_id", "layer_id", "lat_cell", "lon_cell"]
    # an image with a tile that cannot be read is refused whole
    broken = images.filter(F.col("error").isNotNull()).groupBy(*key).agg(F.min("error").alias("error"))
    good = lookup_join(images.filter(F.col("error").isNull()).drop("error"), broken.select(*key), key, "left_anti")
    rejects = manifests.filter(F.col("error").isNotNull()).select("source_id", F.lit(None).cast("string").alias("layer_id"), "error")
    rejects = rejects.unionByName(broken.select("source_id", "layer_id", "error"))
    tiles = good.filter("bx = 0 AND by = 0").drop("bx", "by", "block_width", "pixels")
    blocks = good.select(*key, "bx", "by", "block_width", "pixels")
    return Bundles(manifests, Raster(raster_layers(manifests), tiles, blocks, block), value_mapping(manifests), rejects)


def write_raster(raster: Raster, path: str) -> None:
    raster.layers.write.mode("overwrite").parquet(f"{path}/layers")
    raster.tiles.write.mode("overwrite").parquet(f"{path}/tiles")
    raster.blocks.write.mode("overwrite").partitionBy("source_id", "layer_id").parquet(f"{path}/blocks")


def write_tables(bundles: Bundles, path: str) -> None:
    """The tables of an ingest; queries read them."""
    write_raster(bundles.raster, path)
    bundles.mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    bundles.rejects.write.mode("overwrite").parquet(f"{path}/rejects")


def load_raster(spark, path: str, block: int = BLOCK) -> Raster:
    return Raster(*[spark.read.parquet(f"{path}/{t}") for t in ("layers", "tiles", "blocks")], block)
