"""Library inputs built from the views: rings, rasters, catalogs, gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terralocus.functions import geometry
from terralocus.operators.landmarks import first_islands, first_mountains
from terralocus.operators.layer_index import LayerIndex, box_index_rows, index_rows, load_by_shape, save_by_shape
from terralocus.operators.nearest import PlaceIndex, load_places, prepare_places, save_places
from terralocus.operators.raster import Raster, cut_blocks
from terralocus.plans.gazetteer import ADMIN_COLUMNS, ISLAND_COLUMNS, MOUNTAIN_COLUMNS, Gazetteer, with_tiers
from terralocus.plans.query import Catalog, VectorLayer

from terralocus.session import scratch_path
from terralocus.sources.raster_bundle import load_raster, write_raster

from .views import view

BLOCK = 16


def with_rectangles(df: DataFrame) -> DataFrame:
    return df.withColumn("rings", geometry.rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def diamond(cx: Column, cy: Column, r: Column) -> Column:
    return geometry.ring((cx - r, cy), (cx, cy - r), (cx + r, cy), (cx, cy + r))


def with_diamonds(df: DataFrame) -> DataFrame:
    cx, cy = F.col("cx"), F.col("cy")
    outer, inner = diamond(cx, cy, F.col("r")), diamond(cx, cy, F.col("hole"))
    return df.withColumn("rings", F.when(F.col("hole") > 0, F.array(outer, inner)).otherwise(F.array(outer)))


def admin(spark, d) -> DataFrame:
    return with_rectangles(view(spark, d, "admin"))


def islands(spark, d) -> DataFrame:
    return with_diamonds(view(spark, d, "islands"))


def mountains(spark, d) -> DataFrame:
    return with_diamonds(view(spark, d, "mountains"))


def saved_index(spark, d, name: str) -> LayerIndex:
    """The index of `admin`, `islands`, `mountains` or `roads`, or of the features that landmarks name, built once per session and folder."""
    table, carry = {
        "admin": (admin, ADMIN_COLUMNS), "islands": (islands, ISLAND_COLUMNS), "mountains": (mountains, MOUNTAIN_COLUMNS),
        "first_islands": (lambda s, f: first_islands(islands(s, f)), ISLAND_COLUMNS),
        "first_mountains": (lambda s, f: first_mountains(mountains(s, f)), MOUNTAIN_COLUMNS),
        "roads": (lambda s, f: view(s, f, "roads"), ["fid", "name"])}[name]

    def write(path: str) -> None:
        shape, rows_of = (["xmin", "ymin", "xmax", "ymax"], box_index_rows) if name == "roads" else (["rings"], index_rows)
        save_by_shape(table(spark, d), path, carry, shape, rows_of)

    return load_by_shape(spark, written(spark, d, f"{name}-index", write), carry)


# layer -> (pixel formula over row, col, lat_cell, lon_cell), also spelled in SQL for the oracle
TILE_PIXELS = {
    ("dem", "height"): "({row} * 31 + {col} * 17 + lat_cell * 7 + (lon_cell + 20) * 13) % 256",
    ("dem", "hem"): "({row} + {col}) % 9 + 1",
    ("urban", "built"): "({row} * 13 + {col} * 29) % 300",
}
# one image each over lon -10..30, lat 35..65, half-degree pixels
IMAGE_PIXELS = {
    ("cover", "class"): "({row} * 7 + {col} * 3) % 6",
    ("climate", "temp"): "({row} * 5 + {col} * 11) % 200",
}
# one image in Web Mercator metres, 64 x 64 pixels of 100 km from its north-western corner
MERCATOR = {("web", "zone"): "({row} * 7 + {col} * 3) % 50"}
MERCATOR_X0, MERCATOR_Y0, MERCATOR_STEP = -2_000_000.0, 10_000_000.0, 100_000.0
LAYER_ROWS = [
    ("dem", "height", 4326, 1, 255.0, "continuous", "meters", 1.0, 0.0),
    ("dem", "hem", 4326, 1, None, "continuous", "accuracy", 1.0, 0.0),
    ("urban", "built", 4326, 1, None, "continuous", "value", 1.0, 0.0),
    ("cover", "class", 4326, None, 0.0, "categorical", None, None, None),
    ("climate", "temp", 4326, None, 7.0, "continuous", "", 0.5, 3.0),
    ("web", "zone", 3857, None, 11.0, "continuous", "zone", 1.0, 0.0),
]


def raster_images(spark, d) -> DataFrame:
    tiles = view(spark, d, "tiles")
    value = F.lit(None).cast("array<double>")
    for (source, layer), text in TILE_PIXELS.items():
        cells = F.expr(f"transform(sequence(0, 1023), i -> cast({text.format(row='(i div 32)', col='(i % 32)')} as double))")
        value = F.when((F.col("source_id") == source) & (F.col("layer_id") == layer), cells).otherwise(value)
    tiled = tiles.withColumns({
        "x0": F.col("lon_cell").cast("double"), "y0": (F.col("lat_cell") + 1).cast("double"),
        "dx": F.lit(1 / 32), "dy": F.lit(1 / 32), "width": F.lit(32), "height": F.lit(32), "pixels": value})
    whole = spark.createDataFrame([(s, l) for s, l in IMAGE_PIXELS], "source_id string, layer_id string")
    value = F.lit(None).cast("array<double>")
    for (source, layer), text in IMAGE_PIXELS.items():
        cells = F.expr(f"transform(sequence(0, 4799), i -> cast({text.format(row='(i div 80)', col='(i % 80)')} as double))")
        value = F.when(F.col("source_id") == source, cells).otherwise(value)
    whole = whole.withColumns({
        "lat_cell": F.lit(0), "lon_cell": F.lit(0), "x0": F.lit(-10.0), "y0": F.lit(65.0), "dx": F.lit(0.5), "dy": F.lit(0.5),
        "width": F.lit(80), "height": F.lit(60), "pixels": value})
    (source, layer), text = next(iter(MERCATOR.items()))
    cells = F.expr(f"transform(sequence(0, 4095), i -> cast({text.format(row='(i div 64)', col='(i % 64)')} as double))")
    metres = spark.createDataFrame([(source, layer)], "source_id string, layer_id string").withColumns({
        "lat_cell": F.lit(0), "lon_cell": F.lit(0), "x0": F.lit(MERCATOR_X0), "y0": F.lit(MERCATOR_Y0),
        "dx": F.lit(MERCATOR_STEP), "dy": F.lit(MERCATOR_STEP), "width": F.lit(64), "height": F.lit(64), "pixels": cells})
    return tiled.unionByName(whole).unionByName(metres)


# written once per session and folder, as an ingest job would
_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, d: str, name: str, write) -> str:
    """Path of a table set below the shared folder; `write(path)` fills it on first use."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def raster(spark: SparkSession, d: str) -> Raster:
    def write(path: str) -> None:
        layers = spark.createDataFrame(
            LAYER_ROWS, "source_id string, layer_id string, srid int, grid_deg int, nodata double, value_type string, "
                        "output_property string, scale double, offset double")
        images = raster_images(spark, d)
        write_raster(Raster(layers, images.drop("pixels"), cut_blocks(images, BLOCK), BLOCK), path)

    return load_raster(spark, written(spark, d, "raster", write), BLOCK)


def mapping(spark, d) -> DataFrame:
    return view(spark, d, "legend_values").select(
        F.lit("cover").alias("source_id"), F.lit("class").alias("layer_id"), "value",
        F.create_map(F.lit("label"), F.col("name")).alias("properties"))


SOURCE_ROWS = [
    ("admin", "ready", "ODbL-1.0", "", ""), ("lands", "ready", "", "", "by hand"), ("roads", "ready", "", "", ""),
    ("cover", "ready", "CC0", "", ""), ("climate", "loading", "", "", ""), ("dem", "ready", "CC0", "", ""),
    ("urban", "error", "", "", ""), ("web", "ready", "", "", "open"),
]


def catalog(spark, d, with_raster: bool = True) -> Catalog:
    sources = spark.createDataFrame(
        SOURCE_ROWS, "source_id string, status string, license_name string, license_url string, license_attribution string")
    units = admin(spark, d)
    layers = [
        VectorLayer("admin", "units", 0, "MULTIPOLYGON", units, ["name", "admin_level", "country_iso"], index=saved_index(spark, d, "admin")),
        VectorLayer("lands", "islands", 0, "POLYGON", islands(spark, d), ["name", "name_native"], index=saved_index(spark, d, "islands")),
        VectorLayer("lands", "mountains", 1, "polygon", mountains(spark, d), ["name", "landform"], index=saved_index(spark, d, "mountains")),
        VectorLayer("roads", "roads", 0, "LINESTRING", view(spark, d, "roads"), ["name"], index=saved_index(spark, d, "roads")),
    ]
    if with_raster:
        return Catalog(sources, layers, raster(spark, d), mapping(spark, d))
    return Catalog(sources, layers)


def tiered_places(spark, d) -> DataFrame:
    def write(path: str) -> None:
        with_tiers(view(spark, d, "places"), admin(spark, d), view(spark, d, "meanings"), "state").write.parquet(path)

    return spark.read.parquet(written(spark, d, "places", write))


def saved_places(spark, d) -> PlaceIndex:
    """The places of the gazetteer by class, prepared once per session and folder."""
    path = written(spark, d, "place-index", lambda p: save_places(prepare_places(tiered_places(spark, d), "place", pyramid=False), p))
    return load_places(spark, path)


def gazetteer_tables(spark, d, **options) -> Gazetteer:
    units, meanings = admin(spark, d), view(spark, d, "meanings")
    places = tiered_places(spark, d)
    return Gazetteer(
        admin=units, places=places, meanings=meanings, name_sources=view(spark, d, "name_sources"),
        islands=islands(spark, d), mountains=mountains(spark, d), raster=raster(spark, d),
        dem=("dem", "height"), dem_accuracy=("dem", "hem"), builtup=("urban", "built"),
        admin_index=saved_index(spark, d, "admin"), island_index=saved_index(spark, d, "first_islands"),
        mountain_index=saved_index(spark, d, "first_mountains"), place_index=saved_places(spark, d), **options)
