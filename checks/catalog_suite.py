"""Catalog, sync, file events, manifests, legends, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralocus.operators import catalog as C
from terralocus.operators import file_events as E
from terralocus.operators import manifests as M
from terralocus.operators import telemetry as T

from .registry import check
from .views import div, expand, view

_LEVEL_LAYER = "CASE admin_level WHEN '2' THEN 'countries' WHEN '4' THEN 'states' ELSE 'municipalities' END"


@check("layer_catalog", f"""SELECT country_iso AS source_id, layer, 'all ' || layer AS description, 'POLYGON' AS geometry_type, 4326 AS srid, layer <> 'states' AS has_index,
    n AS feature_count, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM (SELECT country_iso, {_LEVEL_LAYER} AS layer, count(*) AS n,
    min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM [admin] GROUP BY ALL)
    UNION ALL SELECT DISTINCT country_iso, 'empty', 'all empty', 'POLYGON', 4326, TRUE, 0, NULL, NULL, NULL, NULL FROM [admin]""")
def layer_catalog(spark, d):
    units = view(spark, d, "admin").withColumn("layer", F.expr(_LEVEL_LAYER)).withColumnRenamed("country_iso", "source_id")
    declared = units.select("source_id", "layer").distinct().unionByName(units.select("source_id", F.lit("empty").alias("layer")).distinct())
    declared = declared.select("source_id", "layer", F.concat(F.lit("all "), "layer").alias("description"), F.lit("POLYGON").alias("geometry_type"),
                               F.lit(4326).alias("srid"), (F.col("layer") != "states").alias("has_index"))
    return C.layer_catalog(declared, units).select("*", "extent.*").drop("extent")


CONTRACT = "https://example.org/dataset-metadata.json"
_META = f"""SELECT 's' || CAST({div('s_suppkey', 4)} AS STRING) AS source_id, s_suppkey AS id,
    CASE s_suppkey % 5 WHEN 0 THEN '{CONTRACT}' WHEN 1 THEN 'http://other' WHEN 2 THEN '{CONTRACT}' ELSE NULL END AS uri,
    CASE s_suppkey % 5 WHEN 3 THEN 'text/xml' WHEN 4 THEN NULL ELSE 'application/json' END AS mime,
    CASE s_suppkey % 5 WHEN 0 THEN '{{"license":{{"name":"L' || CAST(s_suppkey AS STRING) || '","attribution":"by ' || s_name || '"}},"description":"' ||
        CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'D' || CAST(s_suppkey AS STRING) END || '"}}'
      WHEN 1 THEN '{{"license":{{"name":"wrong"}}}}' WHEN 2 THEN '{{broken' ELSE 'plain ' || CAST(s_suppkey AS STRING) END AS metadata FROM {{supplier}}"""


@check("source_metadata", f"""SELECT source_id, arg_max('L' || CAST(id AS STRING), id) FILTER (id % 5 = 0) AS license_name,
    CASE WHEN bool_or(id % 5 = 0) THEN '' END AS license_url, arg_max('by ' || s_name, id) FILTER (id % 5 = 0) AS license_attribution,
    coalesce(arg_max('D' || CAST(id AS STRING), id) FILTER (id % 5 = 0 AND id % 10 <> 0), arg_min('plain ' || CAST(id AS STRING), id) FILTER (id % 5 IN (3, 4)), '') AS description
    FROM (SELECT m.*, s_name FROM ({_META}) m JOIN {{supplier}} ON s_suppkey = id) GROUP BY 1""")
def source_metadata(spark, d):
    rows = spark.sql(expand(_META, "spark", d))
    got = C.source_metadata(rows, CONTRACT)
    return got.select("source_id", *[F.col(f"license.{c}").alias(f"license_{c}") for c in ("name", "url", "attribution")], "description")


_STATUS = """SELECT s.source_id, s.status, s.indexed AND coalesce(l.a, TRUE) AS ready FROM [sources] s
    LEFT JOIN (SELECT source_id, bool_and(has_index) AS a FROM [layers] GROUP BY 1) l USING (source_id)"""


@check("catalog_status", f"""SELECT source_id, status, ready, CAST(NULL AS BIGINT) AS sources_loaded, CAST(NULL AS BIGINT) AS sources_ready, CAST(NULL AS BIGINT) AS sources_failed FROM ({_STATUS})
    UNION ALL SELECT NULL, NULL, NULL, count(*), count(*) FILTER (ready), count(*) FILTER (status='error') FROM ({_STATUS})""")
def catalog_status(spark, d):
    status = C.catalog_status(view(spark, d, "sources"), view(spark, d, "layers"))
    return status.unionByName(C.catalog_totals(status), allowMissingColumns=True)


@check("source_listing", """SELECT s.source_id, s.name, s.kind, s.size, s.status, CASE WHEN license_name <> '' OR coalesce(license_attribution,'') <> '' THEN license_name END AS license_name,
    coalesce(l.layers, '') AS layers FROM [sources] s LEFT JOIN (SELECT source_id, string_agg(layer || '/' || geometry_type || '/' || CAST(feature_count AS VARCHAR), ',' ORDER BY layer_ord) AS layers
    FROM [layers] GROUP BY 1) l USING (source_id)""")
def source_listing(spark, d):
    rows = C.source_listing(view(spark, d, "sources"), view(spark, d, "layers"))
    text = F.array_join(F.transform("layers", lambda x: F.concat_ws("/", x["layer"], x["geometry_type"], x["feature_count"].cast("string"))), ",")
    return rows.select("source_id", "name", "kind", "size", "status", F.col("license.name").alias("license_name"), text.alias("layers"))


_SUPPORTED = "(lower(key) LIKE '%.gpkg' OR lower(key) LIKE '%.zip')"
_STEM = "regexp_extract(key, '([^/]*)\\.[^./]*$', 1)"


@check("sync_plan", f"""SELECT coalesce(w.source_id, l.source_id) AS source_id, coalesce(w.key, l.path) AS path,
    CASE WHEN l.source_id IS NULL THEN 'add' WHEN w.source_id IS NULL THEN 'remove' WHEN w.etag IS DISTINCT FROM l.etag THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT {_STEM} AS source_id, min(key) AS key, arg_min(etag, key) AS etag FROM [listing] WHERE {_SUPPORTED} GROUP BY 1) w
    FULL JOIN [loaded] l ON l.source_id = w.source_id""")
def sync_plan(spark, d):
    return C.sync_plan(view(spark, d, "listing"), view(spark, d, "loaded"), changed=True)


@check("id_collisions", f"""SELECT source_id, key AS refused_path, kept_path FROM (SELECT DISTINCT key, {_STEM} AS source_id, min(key) OVER (PARTITION BY {_STEM}) AS kept_path
    FROM [listing] WHERE {_SUPPORTED}) WHERE key <> kept_path""")
def id_collisions(spark, d):
    return C.id_collisions(view(spark, d, "listing"))


_OPS = "CASE WHEN op IN ('remove','rename') THEN 'delete' WHEN op = 'create' THEN 'create' ELSE 'modify' END"
BURSTS = f"""SELECT path, burst, min(t_ms) AS start_ms, max(t_ms) AS end_ms, max(t_ms) + 500 AS emit_ms, count(*) AS events,
    list_reduce(list_prepend('', list(k ORDER BY t_ms, seq)), lambda cur, op: CASE WHEN cur = '' THEN op WHEN cur = 'delete' AND op = 'create' THEN 'create' WHEN op = 'delete' THEN 'delete' ELSE cur END) AS op
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS burst FROM
      (SELECT *, {_OPS} AS k, CASE WHEN t_ms - lag(t_ms) OVER (PARTITION BY path ORDER BY t_ms, seq) < 500 THEN 0 ELSE 1 END AS fresh FROM [file_events] WHERE path LIKE '%.gpkg')) GROUP BY 1, 2"""


@check("file_event_debounce", f"SELECT path, op, start_ms, end_ms, emit_ms, events FROM ({BURSTS})")
def file_event_debounce(spark, d):
    return E.debounce(view(spark, d, "file_events"), bucket_ms=60_000)


APPLIED = f"""WITH last AS (SELECT 's' || regexp_extract(path, 's([0-9]+)', 1) AS source_id, arg_max(op, end_ms) AS op, arg_max(path, end_ms) AS path FROM ({BURSTS}) GROUP BY 1)
    SELECT source_id, path FROM [loaded] WHERE source_id NOT IN (SELECT source_id FROM last) UNION ALL SELECT source_id, path FROM last WHERE op <> 'delete'"""


@check("apply_events", APPLIED)
def apply_events(spark, d):
    return E.apply_events(view(spark, d, "loaded"), E.debounce(view(spark, d, "file_events")))


_MANIFESTS = """SELECT 'm' || CAST(p_partkey AS STRING) AS source_id, CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS schema_version,
    CASE p_partkey % 13 WHEN 0 THEN 'Bad_Id' WHEN 1 THEN 'other' ELSE 'm' || CAST(p_partkey AS STRING) END AS id,
    CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'CC0' END AS license_name,
    CASE WHEN p_partkey % 3 = 0 THEN '4326' ELSE 'EPSG:4326' END AS crs, CAST(p_size % 4 AS INT) AS layer_count FROM {part}"""
_MLAYERS = """SELECT 'm' || CAST(p_partkey AS STRING) AS source_id, CASE WHEN p_size % 9 = 0 THEN 'A b' ELSE 'lay-' || CAST(p_size % 3 AS STRING) END AS layer_id,
    CASE p_size % 6 WHEN 0 THEN 'a.tif' WHEN 1 THEN '/abs.tif' WHEN 2 THEN 'b.png' WHEN 3 THEN NULL ELSE 'c.tiff' END AS file,
    CASE WHEN p_size % 6 = 3 OR p_size % 10 = 0 THEN 'tiles' END AS tiles_dir, CASE WHEN p_size % 6 = 3 THEN '{ns}{lat}.tif' END AS tiles_pattern,
    CAST(p_size % 2 AS INT) AS grid_deg, CAST(p_size % 4 AS INT) AS band, CASE WHEN p_size % 8 = 0 THEN 'cubic' WHEN p_size % 8 = 1 THEN '' ELSE 'nearest' END AS sampling,
    CASE WHEN p_size % 3 = 0 THEN 'continuous' WHEN p_size % 3 = 1 THEN 'categorical' END AS value_type,
    p_size % 4 < 2 AS has_map, p_size % 7 = 0 AS bad_key, CASE p_size % 5 WHEN 0 THEN 'v.json' WHEN 1 THEN 'v.csv' END AS value_mapping FROM {part}"""


def _rules(rules: dict[str, str], keys: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{name}' AS rule FROM {source} WHERE {hit}" for name, hit in rules.items())


_BUNDLE_RULES = {
    "schema_version": "schema_version <> 1", "id_pattern": "NOT regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*')", "id_is_stem": "id <> source_id",
    "name_required": "coalesce(name,'') = ''", "license_required": "coalesce(license_name,'') = ''", "crs_pattern": "NOT regexp_full_match(crs, 'EPSG:[0-9]+')",
    "layers_required": "layer_count < 1"}
_HF, _HT, _CO, _HS = "(file IS NOT NULL)", "(tiles_dir IS NOT NULL OR tiles_pattern IS NOT NULL)", "(coalesce(value_type,'categorical') = 'continuous')", "(value_mapping IS NOT NULL)"
_LAYER_RULES = {
    "layer_id_pattern": "layer_id = 'A b'", "file_xor_tiles": f"{_HF} = {_HT}", "file_pattern": "file IN ('/abs.tif', 'b.png')",
    "tiles_complete": f"{_HT} AND (tiles_dir IS NULL OR tiles_pattern IS NULL)", "tiles_grid": f"{_HT} AND grid_deg < 1", "tiles_continuous": f"{_HT} AND NOT {_CO}",
    "continuous_without_mapping": f"{_CO} AND (has_map OR {_HS})", "mapping_xor_sidecar": f"NOT {_CO} AND has_map = {_HS}", "sidecar_pattern": "value_mapping = 'v.csv'",
    "mapping_keys": "has_map AND bad_key", "band": "band < 1", "sampling": "sampling = 'cubic'"}
# spelled out: the statement must not follow the library's own list
_REQUIRED = ["places_layer", "places_rank_column", "places_name_column", "places_admin_fk", "admin_layer",
             "admin_level_column", "admin_name_column", "admin_parent_fk", "country_column"]
_GAZ = {f"missing {n}": f"(p_partkey * {7 + i}) % {5 + i} = 0" for i, n in enumerate(_REQUIRED)}


@check("manifest_validate", f"""WITH m AS ({_MANIFESTS}), l AS ({_MLAYERS}), g AS (SELECT 'g' || CAST(p_partkey AS STRING) AS source_id, * FROM {{part}})
    {_rules(_BUNDLE_RULES, 'source_id, CAST(NULL AS VARCHAR) AS layer_id', 'm')} UNION ALL {_rules(_LAYER_RULES, 'source_id, layer_id', 'l')}
    UNION ALL SELECT source_id, layer_id, 'layer_id_unique' FROM l GROUP BY ALL HAVING count(*) > 1 UNION ALL {_rules(_GAZ, 'source_id, CAST(NULL AS VARCHAR)', 'g')}""")
def manifest_validate(spark, d):
    manifests = spark.sql(expand(_MANIFESTS, "spark", d))
    layers = spark.sql(expand(_MLAYERS, "spark", d)).withColumn(
        "mapping_keys", F.when(F.col("has_map"), F.when(F.col("bad_key"), F.array(F.lit("01"))).otherwise(F.array(F.lit("1"), F.lit("-2")))))
    part = spark.read.parquet(f"{d}/part.parquet")
    gaz = part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("source_id"),
                      *[F.when((F.col("p_partkey") * (7 + i)) % (5 + i) != 0, F.lit("col")).alias(n) for i, n in enumerate(_REQUIRED)])
    return M.raster_violations(manifests, layers).unionByName(M.gazetteer_violations(gaz), allowMissingColumns=True)


_LEGEND = """SELECT p_brand AS legend, CASE p_partkey % 6 WHEN 0 THEN 'header ' || p_name WHEN 1 THEN '' ELSE '  ' || CAST(p_partkey AS STRING) || ' :  ' ||
    CASE p_partkey % 4 WHEN 0 THEN 'Af' WHEN 1 THEN 'BWh' WHEN 2 THEN 'xf' ELSE 'ET' END || '  ' || p_name || ', ' || p_type || '   [' || CAST(p_partkey % 256 AS STRING) || ' ' ||
    CAST(p_size AS STRING) || ' 255] ' END AS line, p_partkey, p_name, p_type, p_size FROM {part}"""


@check("legend_parse", f"""SELECT legend, p_partkey AS value, CASE p_partkey % 4 WHEN 0 THEN 'Af' WHEN 1 THEN 'BWh' WHEN 2 THEN 'xf' ELSE 'ET' END AS code, p_name || ', ' || p_type AS description,
    CASE p_partkey % 4 WHEN 0 THEN 'Tropical' WHEN 1 THEN 'Arid' WHEN 2 THEN 'Unknown' ELSE 'Polar' END AS "group", '#' || printf('%02X', p_partkey % 256) || printf('%02X', p_size) || 'FF' AS color
    FROM ({_LEGEND}) WHERE p_partkey % 6 > 1""")
def legend_parse(spark, d):
    return M.parse_legend(spark.sql(expand(_LEGEND, "spark", d)), keys=["legend"])


_TRACES = """SELECT trace_id, arg_max(name, struct_pack(e := "end", s := span_id)) FILTER (parent_span_id IS NULL AND "end" IS NOT NULL) AS root_name,
    arg_max(status_code, struct_pack(e := "end", s := span_id)) FILTER (parent_span_id IS NULL AND "end" IS NOT NULL) AS status_code,
    min(start) AS start, max("end") AS "end", count(*) AS span_count, (epoch_us(max("end")) - epoch_us(min(start))) / 1000.0 AS duration_ms
    FROM [spans] GROUP BY 1 HAVING count(*) FILTER ("end" IS NULL) = 0 AND count(*) FILTER (parent_span_id IS NULL AND "end" IS NOT NULL) > 0"""


@check("trace_search", f"""SELECT * FROM ({_TRACES}) WHERE duration_ms >= 1000 AND contains(lower(root_name), 'get /s') AND "end" >= TIMESTAMP '2024-01-03 00:00:00'
    ORDER BY "end" DESC, trace_id LIMIT 50""")
def trace_search(spark, d):
    since = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return T.trace_search(view(spark, d, "spans"), min_duration_ms=1000, name_contains="GET /S", since=since, limit=50)


ACTIVE = """SELECT trace_id, span_id, name, start, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(start)) / 1000.0 AS age_ms FROM [spans] WHERE "end" IS NULL"""


@check("active_spans", ACTIVE)
def active_spans(spark, d):
    return T.active_spans(view(spark, d, "spans"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@check("trace_stats", f"""SELECT (SELECT count(*) FROM ({_TRACES}) WHERE status_code <> 'Error') AS traces_stored, (SELECT count(*) FROM ({_TRACES}) WHERE status_code = 'Error') AS error_traces_stored,
    (SELECT min("end") FROM ({_TRACES})) AS oldest_end, (SELECT max("end") FROM ({_TRACES})) AS newest_end,
    (SELECT count(DISTINCT trace_id) FROM [spans]) - (SELECT count(*) FROM ({_TRACES})) AS traces_active, (SELECT count(*) FROM [spans] WHERE "end" IS NULL) AS spans_active""")
def trace_stats(spark, d):
    return T.trace_stats(view(spark, d, "spans"))


_ROUTE = "CASE WHEN route = '' THEN 'unknown' ELSE route END"
_STATUS_CLASS = "CASE WHEN status_code >= 500 THEN '5xx' WHEN status_code >= 400 THEN '4xx' WHEN status_code >= 300 THEN '3xx' WHEN status_code >= 200 THEN '2xx' ELSE 'unknown' END"


@check("request_metrics", f"""SELECT method, {_ROUTE} AS path, {_STATUS_CLASS} AS status, CAST(NULL AS VARCHAR) AS source_id, count(*) AS n FROM [requests] GROUP BY ALL
    UNION ALL SELECT NULL, NULL, status, source_id, count(*) FROM [requests] GROUP BY ALL""")
def request_metrics(spark, d):
    rows = view(spark, d, "requests")
    per_route = T.request_counts(rows).withColumnRenamed("requests", "n")
    return per_route.unionByName(T.query_counts(rows).withColumnRenamed("queries", "n"), allowMissingColumns=True)


_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


@check("duration_histogram", f"""SELECT method, path, le, count(*) FILTER (duration_s <= le) AS cumulative, count(*) AS count, sum(duration_s) AS sum_s
    FROM (SELECT *, {_ROUTE} AS path FROM [requests]), (SELECT unnest([{', '.join(f'CAST({b} AS DOUBLE)' for b in _BOUNDS)}, CAST('Infinity' AS DOUBLE)]) AS le) GROUP BY ALL""")
def duration_histogram(spark, d):
    return T.duration_histogram(view(spark, d, "requests"))


@check("duration_percentiles", f"""SELECT method, {_ROUTE} AS path, quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95, quantile_disc(duration_s, 0.99) AS p99
    FROM [requests] GROUP BY ALL""")
def duration_percentiles(spark, d):
    return T.duration_percentiles(view(spark, d, "requests"))
