"""Readers, writers and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from terralocus.functions.wkb import box_of_wkb, rings_of_wkb
from terralocus.operators.containment import match_index
from terralocus.operators.spots import spot_rows
from terralocus.operators.skew import Size
from terralocus.session import scratch_path
from terralocus.sources import geopackage as K
from terralocus.sources import listing as I
from terralocus.sources import raster_bundle as B
from terralocus.sources import sinks as O
from terralocus.operators import telemetry as T
from terralocus.plans.query import answer_batch
from terralocus.streaming.enrich import answer_stream, enrich_stream, listed_hits, reloading, snapshot_answers
from terralocus.streaming.file_events import debounce_stream, follow_catalog, initial_catalog, read_catalog
from terralocus.streaming.spans import follow_spans, open_spans

from . import sqlparts as S
from .files import write_broken_bundles, write_bundles, write_float_bundles, write_geopackages
from .inputs import catalog, saved_index, written
from .catalog_suite import ACTIVE, APPLIED, BURSTS
from .registry import check
from .spatial_suite import ALL_HITS
from .views import VIEWS, expand, view


def _geopackages(spark, d) -> str:
    return written(spark, d, "gpkg", lambda p: write_geopackages(view(spark, d, "places"), view(spark, d, "admin"), p))


def _bundles(spark, d) -> B.Bundles:
    def write(path):
        regions = view(spark, d, "legend_values")
        write_bundles(view(spark, d, "dem_cells"), regions, path)
    folder = written(spark, d, "bundles", write)
    paths = I.list_storage(spark, folder).select(F.col("key").alias("path"))
    return B.read_bundles(paths, block=16)


@check("scan_gpkg", """SELECT 'places' AS layer, fid, name, place AS kind, population AS number, place_lon AS xmin, place_lat AS ymin, place_lon AS xmax, place_lat AS ymax FROM [places]
    UNION ALL SELECT 'units', fid, name, admin_level, parent_id, xmin, ymin, xmax, ymax FROM [admin]""")
def scan_gpkg(spark, d):
    folder = _geopackages(spark, d)
    places = K.read_layer(spark, folder, "places", rows_per_task=500).select(
        F.lit("places").alias("layer"), "fid", "name", F.col("place").alias("kind"), F.col("population").alias("number"), box_of_wkb("geom_wkb").alias("box"))
    units = K.read_layer(spark, folder, "units", rows_per_task=500)
    units = units.withColumn("rings", rings_of_wkb("geom_wkb")).filter(F.size("rings") == 1).select(
        F.lit("units").alias("layer"), "fid", "name", F.col("admin_level").alias("kind"), F.col("parent_id").alias("number"), box_of_wkb("geom_wkb").alias("box"))
    return places.unionByName(units).select("layer", "fid", "name", "kind", "number", "box.*")


@check("scan_gpkg_extent", """SELECT 'places' AS layer, fid, name FROM [places] WHERE place_lon BETWEEN 2.5 AND 11 AND place_lat BETWEEN 44 AND 50.25
    UNION ALL SELECT 'units', fid, name FROM [admin] WHERE xmax >= 2.5 AND xmin <= 11 AND ymax >= 44 AND ymin <= 50.25""")
def scan_gpkg_extent(spark, d):
    """Rows that meet an extent, by the files' R-trees; the first file has none."""
    folder = written(spark, d, "gpkg-rtree", lambda p: write_geopackages(view(spark, d, "places"), view(spark, d, "admin"), p, rtree=True))
    read = lambda layer: K.read_layer(spark, folder, layer, rows_per_task=500, columns=["name"], extent=(2.5, 44.0, 11.0, 50.25)).select(
        F.lit(layer).alias("layer"), "fid", "name")
    return read("places").unionByName(read("units"))


@check("scan_raster_bundle", """SELECT 'band-' || CAST(lat_cell AS VARCHAR) AS source_id, 'height' AS layer_id, lat_cell, lon_cell, 32 AS width, 32 AS height,
    CAST(sum((r * 31 + c * 17 + lat_cell * 7 + (lon_cell + 20) * 13) % 256) AS DOUBLE) AS total
    FROM [dem_cells], (SELECT unnest(range(32)) AS r), (SELECT unnest(range(32)) AS c) GROUP BY ALL
    UNION ALL SELECT DISTINCT 'band-' || CAST(lat_cell AS VARCHAR), 'kind', 0, 0, 4, 4, CAST(16 * (1 + lat_cell % 5) AS DOUBLE) FROM [dem_cells]""")
def scan_raster_bundle(spark, d):
    bundles = _bundles(spark, d)
    key = ["source_id", "layer_id", "lat_cell", "lon_cell"]
    per_block = bundles.raster.blocks.select(*key, F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("s"))
    sums = per_block.groupBy(*key).agg(F.sum("s").alias("total"))
    return bundles.raster.tiles.join(sums, key).select(*key, "width", "height", "total")


@check("scan_raster_cog", """SELECT 'float-' || CAST(lat_cell AS VARCHAR) AS source_id, lat_cell, lon_cell, count(*) AS pixels,
    CAST(sum((r * 31 + c * 17 + lat_cell * 7 + (lon_cell + 20) * 13) % 256) AS DOUBLE) / 4 AS total
    FROM [dem_cells], (SELECT unnest(range(32)) AS r), (SELECT unnest(range(32)) AS c) GROUP BY ALL""")
def scan_raster_cog(spark, d):
    """Tiles of float images (floating-point predictor, big files, packed members, missing tiles) by their byte ranges."""
    folder = written(spark, d, "float-bundles", lambda p: write_float_bundles(view(spark, d, "dem_cells"), p))
    bundles = B.read_bundles(I.list_storage(spark, folder).select(F.col("key").alias("path")), block=16)
    # each block of 16 pixels lies within one degree cell of 32
    tiles = bundles.raster.tiles.select("source_id", "layer_id", "x0", "y0", "dx")
    known = bundles.raster.blocks.join(tiles, ["source_id", "layer_id"]).withColumn("pixels", F.filter("pixels", lambda v: v != -1))
    cell = (F.col("x0") + F.floor(F.col("bx") / 2)).cast("int").alias("lon_cell")
    return known.filter(F.size("pixels") > 0).groupBy("source_id", (F.col("y0") - 1).cast("int").alias("lat_cell"), cell).agg(
        F.sum(F.size("pixels")).cast("bigint").alias("pixels"), F.sum(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@check("scan_value_mapping", """SELECT DISTINCT 'band-' || CAST(lat_cell AS VARCHAR) AS source_id, 'kind' AS layer_id, value, name AS label,
    10 * value AS rank, value % 2 = 0 AS even FROM [dem_cells], [legend_values]""")
def scan_value_mapping(spark, d):
    typed = F.from_json("properties", "label string, rank bigint, even boolean", {"mode": "FAILFAST"})
    return _bundles(spark, d).mapping.select("source_id", "layer_id", "value", typed.alias("p")).select("source_id", "layer_id", "value", "p.*")


@check("bundle_rejects", """SELECT DISTINCT 'odd-' || CAST(lat_cell AS VARCHAR) AS source_id, 'broken rules: ' || CASE lat_cell % 5 WHEN 1 THEN 'layer_id_unique kind'
    WHEN 2 THEN 'crs_supported' WHEN 3 THEN 'unknown field no_data' ELSE 'sampling kind' END AS error FROM [dem_cells] WHERE lat_cell % 5 <> 0""")
def bundle_rejects(spark, d):
    folder = written(spark, d, "odd-bundles", lambda p: write_broken_bundles(view(spark, d, "dem_cells"), p))
    paths = I.list_storage(spark, folder).select(F.col("key").alias("path"))
    return B.read_bundles(paths).rejects.select("source_id", "error")


_INDEX = """SELECT CASE p_partkey % 9 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '' WHEN 2 THEN '  ' || p_name || CAST(p_partkey AS STRING) || '.GPKG ' WHEN 3 THEN p_name || CAST(p_partkey AS STRING) || '.txt'
    ELSE 'a/' || CAST(p_partkey AS STRING) || '.zip' END AS value, p_partkey, p_name FROM {part}"""


@check("scan_listing", """SELECT CASE WHEN p_partkey % 9 = 2 THEN p_name || CAST(p_partkey AS STRING) || '.GPKG' ELSE 'a/' || CAST(p_partkey AS STRING) || '.zip' END AS key
    FROM {part} WHERE p_partkey % 9 = 2 OR p_partkey % 9 > 3""")
def scan_listing(spark, d):
    path = written(spark, d, "listing", lambda p: spark.sql(expand(_INDEX, "spark", d)).select("value").write.text(p))
    return I.list_index(spark, path)


@check("sink_ndjson", "SELECT fid, name, capital, population FROM [places]")
def sink_ndjson(spark, d):
    answers = view(spark, d, "places").select("fid", "name", "capital", "population")
    path = scratch_path(spark, "ndjson")
    O.write_ndjson(answers, path)
    return spark.read.schema(answers.schema).json(path)


@check("sink_layers", """SELECT CAST(CAST(floor(place_lat/10) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(place_lon/10) AS BIGINT) AS VARCHAR) AS grid_cell, count(*) AS n, sum(fid) AS fids FROM [places] GROUP BY 1""")
def sink_layers(spark, d):
    path = scratch_path(spark, "layer")
    O.write_layer(view(spark, d, "places"), path, F.col("place_lon"), F.col("place_lat"))
    back = spark.read.parquet(path).withColumn("grid_cell", F.col("grid_cell").cast("string"))
    return back.groupBy("grid_cell").agg(F.count(F.lit(1)).alias("n"), F.sum("fid").alias("fids"))


def _point_stream(spark, d):
    """The events file as a stream of points."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events.createOrReplaceTempView("_event_stream")
    return spark.sql(VIEWS["pts"].replace("{events}", "_event_stream"))


@check("stream_enrich", f"SELECT point_id, fid, name FROM [pts] JOIN [admin] ON {S.IN_BOX}")
def stream_enrich(spark, d):
    index = replace(saved_index(spark, d, "admin"), carried=["fid", "name"])
    out = scratch_path(spark, "stream")
    enriched = enrich_stream(_point_stream(spark, d), index).select("point_id", "fid", "name")
    query = (enriched.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


@check("stream_enrich_shuffled", f"SELECT point_id, fid, name FROM [pts] JOIN [admin] ON {S.IN_BOX}")
def stream_enrich_shuffled(spark, d):
    """The stream with an index that counts as too large to broadcast."""
    index = replace(saved_index(spark, d, "admin"), carried=["fid", "name"], size=Size(10**9, 10**12))
    out = scratch_path(spark, "stream")
    enriched = enrich_stream(_point_stream(spark, d), index).select("point_id", "fid", "name")
    query = (enriched.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


@check("hot_reload", f"""SELECT point_id, fid, 1 AS version FROM [pts] JOIN [admin] ON {S.IN_BOX} WHERE point_id % 2 = 0 UNION ALL
    SELECT point_id, fid, 2 FROM [pts] JOIN [islands] ON {S.IN_DIAMOND} WHERE point_id % 2 = 1""")
def hot_reload(spark, d):
    """Even points arrive first; before the odd ones the catalog changes from units to islands."""
    out, arriving = scratch_path(spark, "reload"), scratch_path(spark, "arriving")
    pts = view(spark, d, "pts").select("point_id", "lon", "lat")
    for odd in (0, 1):
        pts.filter(F.col("point_id") % 2 == odd).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    asked = []

    def version():
        asked.append(1)
        return len(asked)

    def load(number):
        return number, saved_index(spark, d, "admin" if number == 1 else "islands")

    def answer(batch, catalog):
        number, index = catalog
        # a line for the points of a spot, not one for each of their hits
        lines = spot_rows(batch, lambda p: listed_hits(match_index(p, replace(index, carried=["fid"])), index.members_size.rows))
        return lines.select(F.transform("points", lambda p: p["point_id"]).alias("points"), "fids", F.lit(number).alias("version"))

    answer_stream(stream, reloading(load, version, answer), out, f"{out}-state", once=True).awaitTermination()
    lines = spark.read.schema("points array<bigint>, fids array<bigint>, version int").json(f"{out}/batch=*")
    return lines.select(F.explode("points").alias("point_id"), "fids", "version").select("point_id", F.explode("fids").alias("fid"), "version")


_ANSWERED = """SELECT idx AS point_id, CAST(coalesce(n, 0) AS BIGINT) AS total_features, (i.lon IS NULL OR i.lat IS NULL) AND (i.x IS NULL OR i.y IS NULL) AS refused, i.idx % 3 AS arrival
    FROM [inputs] i LEFT JOIN (SELECT point_id, count(*) AS n FROM ({}) GROUP BY 1) h ON h.point_id = i.idx"""


@check("stream_answers", _ANSWERED.format(ALL_HITS))
def stream_answers(spark, d):
    """Whole answers as a stream: stopped after the first file, and started again from its checkpoint for the other two."""
    out, arriving = scratch_path(spark, "answers"), scratch_path(spark, "asked")
    inputs = view(spark, d, "inputs")

    def run(parts):
        for part in parts:
            inputs.filter(F.col("idx") % 3 == part).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(inputs.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        snapshot_answers(stream, lambda version: catalog(spark, d), lambda: 1, lambda batch, known: answer_batch(batch, known, srids=(4326, 3857), together=True, max_features=None),
                         out, f"{out}/state", once=True).awaitTermination()

    run([0])
    run([1, 2])
    lines = spark.read.schema("points array<struct<point_id: bigint, error: string>>, total_features bigint").json(f"{out}/answers/batch=*")
    lines = lines.select("total_features", F.inline("points"))
    return lines.select("point_id", "total_features", F.col("error").isNotNull().alias("refused"), (F.col("point_id") % 3).alias("arrival"))


def _event_stream(spark, d, run):
    """Calls `run(stream)` twice, the file events arriving in four files: rows come up to 20 seconds after later ones.

    The second call goes on from the checkpoint of the first. A last event, far off, closes all bursts.
    """
    arriving = scratch_path(spark, "file-events")
    events = view(spark, d, "file_events").select("path", F.timestamp_millis("t_ms").alias("ts"), "op", "seq", "t_ms")
    ends = events.agg(F.min("t_ms").alias("low"), F.max("t_ms").alias("high")).first()
    late = F.col("t_ms") + F.col("seq") * 7919 % 20_000 - ends["low"]
    part = F.least(F.floor(late * 4 / (ends["high"] - ends["low"] + 1)), F.lit(3))
    closing = events.limit(1).select(F.lit("data/closing.gpkg").alias("path"), F.timestamp_millis(F.lit(ends["high"] + 10_000_000)).alias("ts"), F.lit("write").alias("op"), F.lit(-1).cast("bigint").alias("seq"))
    for parts in ((0, 1), (2, 3)):
        for n in parts:
            events.filter(part == n).select("path", "ts", "op", "seq").coalesce(1).write.mode("append").parquet(arriving)
        if parts[-1] == 3:
            closing.coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(closing.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        run(debounce_stream(stream, "30 seconds"))


@check("stream_debounce", f"SELECT path, op, start_ms, end_ms, events FROM ({BURSTS})")
def stream_debounce(spark, d):
    """Bursts of a stream with late rows, stopped and started again in the middle."""
    out = scratch_path(spark, "bursts")

    def run(bursts):
        bursts.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()

    _event_stream(spark, d, run)
    return spark.read.parquet(out).select("path", "op", F.unix_millis("start").alias("start_ms"), (F.unix_millis("end") - 500).alias("end_ms"), "events")


@check("stream_catalog", APPLIED)
def stream_catalog(spark, d):
    """The catalog log after the same stream, with snapshots on the way."""
    root = scratch_path(spark, "catalog-log")
    initial_catalog(view(spark, d, "loaded"), root)
    _event_stream(spark, d, lambda bursts: follow_catalog(bursts, root, f"{root}/state", compact_every=2, once=True).awaitTermination())
    return read_catalog(spark, root)


@check("stream_active_spans", ACTIVE)
def stream_active_spans(spark, d):
    """Spans still open after a stream of starts and ends in three files, some ends ahead of their starts; started again after two."""
    root = scratch_path(spark, "open-spans")
    spans = view(spark, d, "spans").select("trace_id", "span_id", "name", "start", "end", F.pmod(F.xxhash64("span_id"), F.lit(3)).alias("arrival"))
    starts = spans.select("trace_id", "span_id", "name", "start", F.lit(None).cast("timestamp_ntz").alias("end"), "arrival")
    ends = spans.filter(F.col("end").isNotNull()).select(
        "trace_id", "span_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp_ntz").alias("start"), "end", (2 - F.col("arrival")).alias("arrival"))
    rows = starts.unionByName(ends)
    for parts in ((0, 1), (2,)):
        for n in parts:
            rows.filter(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(f"{root}/arriving")
        stream = spark.readStream.schema(rows.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/arriving")
        # ends wait for their starts however late these are: the files are not in order of time
        follow_spans(stream, root, f"{root}/state", compact_every=2, lone_end="10000 days", once=True).awaitTermination()
    return T.active_spans(open_spans(spark, root), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
