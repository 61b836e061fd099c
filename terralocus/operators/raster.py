"""Nearest-pixel sampling of raster layers kept as blocks of pixels.

Tables:
  layers(source_id, layer_id, srid, grid_deg, nodata, value_type, output_property, scale, offset)
  tiles (source_id, layer_id, lat_cell, lon_cell, x0, y0, dx, dy, width, height)
  blocks(source_id, layer_id, lat_cell, lon_cell, bx, by, block_width, pixels)

grid_deg is NULL for a layer with a single image, filed under cell (0, 0).
Row 0 is the northernmost. Pixels are cut into BLOCK x BLOCK blocks, so that a
joined row carries a few kilobytes however large the image is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import terrain as window3
from .containment import match_index
from .layer_index import build_box_index
from .points import WGS84_SRID
from .skew import lookup_join, measure

BLOCK = 32
BUILTUP_MIN = 100.0
_LAYER = ["source_id", "layer_id"]
_TILE = [*_LAYER, "lat_cell", "lon_cell"]


@dataclass(frozen=True)
class Raster:
    layers: DataFrame
    tiles: DataFrame
    blocks: DataFrame
    block: int = BLOCK


def cell_of(lon: Column, lat: Column, grid_deg: Column) -> dict[str, Column]:
    """South-west corner of the tile, floored (also for negative values)."""
    return {
        "lat_cell": (F.floor(lat / grid_deg) * grid_deg).cast("int"),
        "lon_cell": (F.floor(lon / grid_deg) * grid_deg).cast("int"),
    }


def tile_name(pattern: Column | str, lat_cell: Column, lon_cell: Column) -> Column:
    """Tile file name from a pattern with {ns} {lat} {ew} {lon}."""
    text = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = {
        "{ns}": F.when(lat_cell < 0, F.lit("S")).otherwise(F.lit("N")),
        "{ew}": F.when(lon_cell < 0, F.lit("W")).otherwise(F.lit("E")),
        "{lat}": F.format_string("%02d", F.abs(lat_cell).cast("int")),
        "{lon}": F.format_string("%03d", F.abs(lon_cell).cast("int")),
    }
    for token, value in parts.items():
        text = F.replace(text, F.lit(token), value)
    return text


def cut_blocks(images: DataFrame, block: int = BLOCK) -> DataFrame:
    """Whole images (tile columns + pixels ARRAY<DOUBLE>) into block rows, without a shuffle."""
    across = F.ceil(F.col("width") / block).cast("int")
    down = F.ceil(F.col("height") / block).cast("int")
    df = images.withColumn("by", F.explode(F.sequence(F.lit(0), down - 1)))
    df = df.withColumn("bx", F.explode(F.sequence(F.lit(0), across - 1)))
    width = F.least(F.lit(block), F.col("width") - F.col("bx") * block).cast("int")
    height = F.least(F.lit(block), F.col("height") - F.col("by") * block).cast("int")
    first = F.col("by") * block * F.col("width") + F.col("bx") * block
    rows = F.sequence(F.lit(0), height - 1)
    pixels = F.flatten(F.transform(rows, lambda r: F.slice("pixels", (first + r * F.col("width") + 1).cast("int"), width)))
    return df.select(*_TILE, "bx", "by", width.alias("block_width"), pixels.alias("pixels"))


_PARAMS = ["grid_deg", "nodata", "value_type", "output_property", "scale", "offset"]


def assign_layers(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Every point with every one of a few named layers, for callers that sample fixed layers.

    `sample_covering` finds the layers that cover a point without naming all pairs.
    """
    keys = layers.select(*_LAYER).agg(F.array_sort(F.collect_set(F.struct(*_LAYER))).alias("_layers")).first()["_layers"]
    each = F.array(*[F.struct(F.lit(r[0]).alias("source_id"), F.lit(r[1]).alias("layer_id")) for r in keys])
    return points.withColumn("_layer", F.explode(each)).select(
        "*", F.col("_layer.source_id"), F.col("_layer.layer_id")).drop("_layer")


def _read_pixels(df: DataFrame, raster: Raster, x: str, y: str, kept: list[str], spread: list[str]) -> DataFrame:
    """From points with their tile to `raw`; nodata and points outside the image drop out."""
    block = raster.block
    df = df.withColumns({
        "px": F.floor((F.col(x) - F.col("x0")) / F.col("dx")).cast("int"),
        "py": F.floor((F.col("y0") - F.col(y)) / F.col("dy")).cast("int"),
    })
    inside = (F.col("px") >= 0) & (F.col("py") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") < F.col("height"))
    df = df.filter(inside).withColumns({
        "bx": F.floor(F.col("px") / block).cast("int"),
        "by": F.floor(F.col("py") / block).cast("int"),
    })
    blocks = raster.blocks.select(*_TILE, "bx", "by", "block_width", "pixels")
    # full blocks bound the bytes; the pixels themselves are not read for it
    size = measure(raster.blocks, fixed_bytes=block * block * 8 + 128)
    df = lookup_join(df, blocks, [*_TILE, "bx", "by"], size=size, spread_by=spread)
    at = (F.col("py") - F.col("by") * block) * F.col("block_width") + F.col("px") - F.col("bx") * block
    df = df.withColumn("raw", F.get("pixels", at))
    return df.filter(F.col("nodata").isNull() | (F.col("raw") != F.col("nodata"))).select(
        *kept, "raw", "value_type", "output_property", "scale", "offset")


def sample_pixels(asked: DataFrame, raster: Raster, x: str = "lon", y: str = "lat",
                  spread_by: list[str] | None = None) -> DataFrame:
    """Adds `raw` and the layer's parameters to rows (.., source_id, layer_id), whose x and y are in the layer's system.

    Rows outside the image, over a missing tile, or on nodata drop out.
    """
    spread = spread_by or [x, y]
    df = lookup_join(asked, raster.layers.select(*_LAYER, *_PARAMS), _LAYER, spread_by=spread)
    cells = cell_of(F.col(x), F.col(y), F.col("grid_deg"))
    df = df.withColumns({name: F.coalesce(value, F.lit(0)) for name, value in cells.items()})
    df = lookup_join(df, raster.tiles, _TILE, spread_by=spread)
    return _read_pixels(df, raster, x, y, asked.columns, spread)


def sample_covering(points: DataFrame, raster: Raster, layers: DataFrame, point: str = "point_id") -> DataFrame:
    """(point, source_id, layer_id, raw, parameters) of every one of `layers` that has a pixel at a point.

    `points` carry x_<srid> and y_<srid> for the systems of the layers, null
    where they cannot be transformed. Points meet the tiles that cover them
    through the cell index of the tiles' boxes, so a layer costs nothing where
    it has no tile.
    """
    params = layers.select(*_LAYER, "srid", *_PARAMS)
    tiles = lookup_join(raster.tiles, params, _LAYER)
    boxes = tiles.withColumns({
        "xmin": F.col("x0"), "xmax": F.col("x0") + F.col("dx") * F.col("width"),
        "ymin": F.col("y0") - F.col("dy") * F.col("height"), "ymax": F.col("y0")})
    carry = [*_TILE, "x0", "y0", "dx", "dy", "width", "height", *_PARAMS]
    found = None
    for srid in sorted(r[0] for r in params.select(F.coalesce("srid", F.lit(WGS84_SRID))).distinct().collect()):
        slim = points.select(point, F.col(f"x_{srid}").alias("_x"), F.col(f"y_{srid}").alias("_y"))
        own = boxes.filter(F.coalesce("srid", F.lit(WGS84_SRID)) == srid)
        hits = match_index(slim, build_box_index(own, carry), "_x", "_y")
        cell = cell_of(F.col("_x"), F.col("_y"), F.col("grid_deg"))
        hits = hits.filter(F.col("grid_deg").isNull() | ((F.col("lat_cell") == cell["lat_cell"]) & (F.col("lon_cell") == cell["lon_cell"])))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        empty = points.select(point, F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y")).filter(F.lit(False))
        found = empty.join(boxes.select(*carry), F.lit(False))
    return _read_pixels(found, raster, "_x", "_y", [point, *_LAYER], [point])


def valued(samples: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Samples of both kinds with fid, properties (JSON text) and error, in one pass.

    A categorical pixel takes the properties of its value, and one without a
    mapping entry is an error of that layer at that point; a continuous pixel
    gives its scaled value under the layer's output property.
    """
    categorical = F.col("value_type") == "categorical"
    coded = samples.withColumn("value", F.when(categorical, F.col("raw").cast("bigint")))
    if mapping is None:
        coded = coded.withColumn("_mapped", F.lit(None).cast("string"))
    else:
        text = F.col("properties") if mapping.schema["properties"].dataType == T.StringType() else F.to_json("properties")
        table = mapping.select(*_LAYER, "value", text.alias("_mapped"))
        coded = lookup_join(coded, table, [*_LAYER, "value"], "left")
    name = F.coalesce(F.nullif(F.col("output_property"), F.lit("")), F.lit("value"))
    number = F.col("raw") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
    message = F.format_string("pixel value %d has no mapping entry", F.col("value"))
    kept = [c for c in samples.columns if c not in ("raw", "value_type", "output_property", "scale", "offset")]
    return coded.select(
        *kept, F.when(categorical, F.col("value")).otherwise(F.lit(0).cast("bigint")).alias("fid"),
        F.when(categorical, F.col("_mapped")).otherwise(F.to_json(F.create_map(name, number))).alias("properties"),
        F.when(categorical & F.col("_mapped").isNull(), message).alias("error"))


def categorical_values(samples: DataFrame, mapping: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, errors) of categorical samples; the feature id is the pixel value.

    An unmapped value is an error of that layer at that point only.
    """
    coded = samples.filter(F.col("value_type") == "categorical").withColumn("value", F.col("raw").cast("bigint"))
    table = mapping.select(*_LAYER, "value", "properties").withColumn("_mapped", F.lit(True))
    joined = lookup_join(coded, table, [*_LAYER, "value"], "left")
    missing = F.col("_mapped").isNull()
    message = F.format_string("pixel value %d has no mapping entry", F.col("value"))
    if strict:
        joined = joined.withColumn("_mapped", F.when(missing, F.raise_error(message)).otherwise(F.lit(True)))
    keep = [c for c in samples.columns if c not in ("raw", "value_type", "output_property", "scale", "offset")]
    hits = joined.filter(~missing).select(*keep, F.col("value").alias("fid"), "properties")
    errors = joined.filter(missing).select(*keep, "value", message.alias("error"))
    return hits, errors


def continuous_values(samples: DataFrame) -> DataFrame:
    """raw * scale + offset under the layer's output property."""
    return samples.filter(F.col("value_type") == "continuous").withColumns({
        "property": F.coalesce(F.nullif(F.col("output_property"), F.lit("")), F.lit("value")),
        "value": F.col("raw") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0)),
    }).drop("raw", "value_type", "output_property", "scale", "offset")


def _on_layer(points: DataFrame, layer: tuple[str, str]) -> DataFrame:
    return points.withColumns({"source_id": F.lit(layer[0]), "layer_id": F.lit(layer[1])})


def _values(asked: DataFrame, raster: Raster, spread_by: list[str]) -> DataFrame:
    return continuous_values(sample_pixels(asked, raster, spread_by=spread_by))


def terrain(points: DataFrame, raster: Raster, dem: tuple[str, str], accuracy: tuple[str, str] | None = None,
            point: str = "point_id", lon: str = "lon", lat: str = "lat", window: bool = True) -> DataFrame:
    """(point, metres, accuracy, exposure) from one sampling pass.

    Up to ten positions per point (the 3x3 window plus the accuracy layer) are
    sampled by one join and folded back by a partially aggregated group.
    Points with no DEM pixel are absent.
    """
    def place(source, cell, at_x, at_y):
        return F.struct(F.lit(source[0]).alias("source_id"), F.lit(source[1]).alias("layer_id"),
                        cell.alias("cell"), at_x.alias("lon"), at_y.alias("lat"))

    x, y = F.col(lon), F.col(lat)
    centre = F.array(place(dem, F.lit("c"), x, y))
    spots = centre
    if window:
        ring = F.filter(window3.window_positions(x, y), lambda s: s["cell"] != "c")
        around = F.transform(ring, lambda s: place(dem, s["cell"], s["lon"], s["lat"]))
        spots = F.when(F.abs(y) <= window3.MAX_ABS_LAT, F.concat(centre, around)).otherwise(centre)
    if accuracy:
        spots = F.concat(spots, F.array(place(accuracy, F.lit("acc"), x, y)))
    asked = points.select(F.col(point), F.explode(spots).alias("_s")).select(point, "_s.*")
    got = _values(asked, raster, [point, "cell"])
    cells = [*window3.WINDOW, "acc"]
    folded = got.groupBy(point).agg(*[F.max(F.when(F.col("cell") == c, F.col("value"))).alias(f"z_{c}") for c in cells])
    z = {c: F.col(f"z_{c}") for c in window3.WINDOW}
    exposure = window3.slope_aspect(z) if window else F.lit(None)
    return folded.filter(F.col("z_c").isNotNull()).select(
        point, F.col("z_c").alias("metres"), F.col("z_acc").alias("accuracy"), exposure.alias("exposure"))


# Bases of an elevation's accuracy.
SEA_LEVEL_BASIS = "sea-level convention"


def elevation(points: DataFrame, heights: DataFrame, accuracy_m: float, basis: str, point_basis: str,
              point: str = "point_id") -> DataFrame:
    """Elevation columns (and the exposure) for every point from the `terrain` result.

    No pixel means sea level: 0 m by convention and no accuracy figure.
    """
    sea = F.col("metres").isNull()
    per_point = F.col("accuracy").isNotNull()
    return points.join(heights, point, "left").withColumns({
        "meters": F.coalesce("metres", F.lit(0.0)),
        "sea_level": sea,
        "accuracy_m": F.when(sea, F.lit(None)).when(per_point, F.col("accuracy")).otherwise(F.lit(float(accuracy_m))),
        "accuracy_basis": F.when(sea, F.lit(SEA_LEVEL_BASIS)).when(per_point, F.lit(point_basis)).otherwise(F.lit(basis)),
    }).drop("metres", "accuracy")


def builtup_gate(points: DataFrame, raster: Raster | None, layer: tuple[str, str] | None,
                 minimum: float = BUILTUP_MIN, point: str = "point_id") -> DataFrame:
    """Adds `allowed`: TRUE without a layer or coverage, else sample >= minimum."""
    if raster is None or layer is None:
        return points.withColumn("allowed", F.lit(True))
    sampled = _values(_on_layer(points.select(point, "lon", "lat"), layer), raster, [point])
    values = sampled.select(point, F.col("value").alias("_built"))
    return points.join(values, point, "left").withColumn(
        "allowed", F.coalesce(F.col("_built") >= minimum, F.lit(True))).drop("_built")
