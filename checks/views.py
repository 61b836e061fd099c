"""Inputs of the checks, derived from the given tables.

Each view is one SELECT in the dialect Spark and DuckDB share, so both engines
see the same bits: coordinates are dyadic fractions, all else is integers and
text. `{table}` stands for a base table, `[view]` for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def div(a: str, b: int) -> str:
    return f"CAST(floor(CAST({a} AS DOUBLE) / {b}) AS BIGINT)"


STATE_X = "-10.0 + 8 * n_regionkey"
STATE_Y = f"35.0 + 6 * {div('n_nationkey', 5)}"
ISO = "upper(substr(r_name, 1, 2))"

VIEWS = {
    # points all over the area
    "pts": """SELECT event_id AS point_id,
        -10 + CAST((event_id * 7919) % 40960 AS DOUBLE) / 1024 AS lon,
        35 + CAST((event_id * 104729) % 30720 AS DOUBLE) / 1024 AS lat FROM {events}""",
    # the same plus points on a quarter-degree lattice, where edges and corners are
    "all_pts": """SELECT point_id * 2 AS point_id, lon, lat FROM [pts] UNION ALL
        SELECT event_id * 2 + 1 AS point_id,
        -10 + CAST((event_id * 7919) % 161 AS DOUBLE) / 4 AS lon,
        35 + CAST((event_id * 104729) % 121 AS DOUBLE) / 4 AS lat FROM {events}""",
    "inputs": """SELECT event_id AS idx,
        CASE WHEN event_id % 3 = 0 THEN 'p' || CAST(event_id AS STRING) WHEN event_id % 3 = 1 THEN '' END AS id,
        CASE WHEN event_id % 7 <> 0 THEN -10 + CAST((event_id * 7919) % 40960 AS DOUBLE) / 1024 END AS lon,
        CASE WHEN event_id % 11 <> 0 THEN 35 + CAST((event_id * 104729) % 30720 AS DOUBLE) / 1024 END AS lat,
        CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 400 AS DOUBLE) END AS x,
        CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 200 AS DOUBLE) END AS y,
        CASE WHEN event_id % 4 = 0 THEN 3857 WHEN event_id % 4 = 1 THEN 0 END AS srid FROM {events}""",
    "wide_pts": """SELECT point_id, lon * 9 AS x, (lat - 50) * 7 AS y,
        CASE WHEN point_id % 4 = 0 THEN 3857 ELSE 4326 END AS srid FROM [pts]""",
    # three nested levels of rectangles with integer or quarter corners
    "admin": f"""SELECT CAST(1 + r_regionkey AS BIGINT) AS fid, CAST(NULL AS BIGINT) AS parent_id, '2' AS admin_level,
        r_name AS name, '' AS name_native, 'src-' || CAST(r_regionkey AS STRING) AS name_source, {ISO} AS country_iso,
        CAST(-10 + 8 * r_regionkey AS DOUBLE) AS xmin, CAST(35 AS DOUBLE) AS ymin,
        CAST(-2 + 8 * r_regionkey AS DOUBLE) AS xmax, CAST(65 AS DOUBLE) AS ymax FROM {{region}}
      UNION ALL
      SELECT CAST(100 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), '4', n_name, '',
        'src-' || CAST(n_nationkey AS STRING), {ISO},
        CAST({STATE_X} AS DOUBLE), CAST({STATE_Y} AS DOUBLE), CAST({STATE_X} + 8 AS DOUBLE), CAST({STATE_Y} + 6 AS DOUBLE)
      FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
      UNION ALL
      SELECT 1000 + s_suppkey, CASE WHEN s_suppkey % 23 = 0 THEN 0 ELSE CAST(100 + s_nationkey AS BIGINT) END,
        CASE WHEN s_suppkey % 17 = 0 THEN 'fill' WHEN s_suppkey % 19 = 0 THEN ' 8' ELSE '8' END, s_name, '',
        CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'src-' || CAST(s_suppkey % 40 AS STRING) END,
        CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE {ISO} END,
        CAST({STATE_X} + CAST((s_suppkey * 37) % 28 AS DOUBLE) / 4 AS DOUBLE),
        CAST({STATE_Y} + CAST((s_suppkey * 53) % 20 AS DOUBLE) / 4 AS DOUBLE),
        CAST({STATE_X} + CAST((s_suppkey * 37) % 28 + 1 + s_suppkey % 4 AS DOUBLE) / 4 AS DOUBLE),
        CAST({STATE_Y} + CAST((s_suppkey * 53) % 20 + 1 + {div('s_suppkey', 4)} % 4 AS DOUBLE) / 4 AS DOUBLE)
      FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    # the municipalities cut in two halves with the same attributes
    "fragments": """SELECT fid * 2 AS fid, name, country_iso, xmin, ymin, (xmin + xmax) / 2 AS xmax, ymax FROM [admin] WHERE fid >= 1000
      UNION ALL SELECT fid * 2 + 1, name, country_iso, (xmin + xmax) / 2, ymin, xmax, ymax FROM [admin] WHERE fid >= 1000""",
    # diamonds |x-cx|+|y-cy| <= r, some with an open diamond hole
    "islands": """SELECT 1 + s_suppkey AS fid,
        CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'Isle ' || CAST(s_suppkey % 20 AS STRING) END AS name,
        'native ' || CAST(s_suppkey AS STRING) AS name_native, 'src-' || CAST(s_suppkey % 30 AS STRING) AS name_source,
        -9 + CAST((s_suppkey * 41) % 152 AS DOUBLE) / 4 AS cx, 37 + CAST((s_suppkey * 67) % 104 AS DOUBLE) / 4 AS cy,
        CASE s_suppkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS r,
        CASE WHEN s_suppkey % 2 = 0 THEN 0.25 ELSE 0.0 END AS hole FROM {supplier}""",
    "mountains": """SELECT 1 + s_suppkey AS fid,
        CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'Peak ' || CAST(s_suppkey % 50 AS STRING) END AS name,
        '' AS name_native, 'src-' || CAST(s_suppkey % 30 AS STRING) AS name_source,
        CASE WHEN s_suppkey % 11 = 0 THEN 'hill' WHEN s_suppkey % 2 = 0 THEN 'range' ELSE 'mountain' END AS landform,
        CASE WHEN s_suppkey % 5 <> 0 THEN CAST(100 + s_suppkey AS DOUBLE) END AS ele,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 0.0 ELSE CAST((s_suppkey * 13) % 50 AS DOUBLE) END AS area_km2,
        -9 + CAST((s_suppkey * 29) % 152 AS DOUBLE) / 4 AS cx, 37 + CAST((s_suppkey * 31) % 104 AS DOUBLE) / 4 AS cy,
        CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 4.0 END AS r, 0.0 AS hole FROM {supplier}""",
    # boxes of line features
    "roads": """SELECT 1 + s_suppkey AS fid, 'Road ' || CAST(s_suppkey AS STRING) AS name,
        -10 + CAST((s_suppkey * 43) % 150 AS DOUBLE) / 4 AS xmin, 35 + CAST((s_suppkey * 59) % 110 AS DOUBLE) / 4 AS ymin,
        -10 + CAST((s_suppkey * 43) % 150 + s_suppkey % 9 AS DOUBLE) / 4 AS xmax,
        35 + CAST((s_suppkey * 59) % 110 + s_suppkey % 5 AS DOUBLE) / 4 AS ymax FROM {supplier}""",
    "places": f"""SELECT 1 + c_custkey AS fid, 'Place ' || CAST(c_custkey AS STRING) AS name, '' AS name_native,
        'src-' || CAST(c_custkey % 28 AS STRING) AS name_source,
        CASE c_custkey % 10 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'town' WHEN 3 THEN 'town' WHEN 9 THEN 'hamlet' ELSE 'village' END AS place,
        CASE WHEN c_custkey % 4 = 0 THEN CAST(100 + c_nationkey AS BIGINT) WHEN c_custkey % 8 = 1 THEN 0
             WHEN c_custkey % 8 = 5 THEN 1000 + c_custkey % 10 ELSE CAST(100 + c_nationkey AS BIGINT) END AS admin_id,
        CASE WHEN c_custkey % 11 = 0 THEN 'XX' ELSE {ISO} END AS country_iso,
        CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal * 100) AS BIGINT) END AS population,
        CASE c_custkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN '4' WHEN 2 THEN '6' WHEN 3 THEN '9' END AS capital,
        CASE WHEN c_custkey % 3 = 0 THEN 'Q' || CAST(c_custkey AS STRING) END AS wikidata,
        {STATE_X} + CAST((c_custkey * 613) % 8192 AS DOUBLE) / 1024 AS place_lon,
        {STATE_Y} + CAST((c_custkey * 397) % 6144 AS DOUBLE) / 1024 AS place_lat
      FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "level_raw": f"""SELECT {ISO} AS country_iso, 2 AS level, 'Land' AS local_term, 'country' AS equivalent FROM {{region}}
      UNION ALL SELECT {ISO}, 4, 'Staat ' || r_name, CASE WHEN r_name = 'MIDDLE EAST' THEN '' ELSE 'state' END FROM {{region}}
      UNION ALL SELECT {ISO}, 8, 'Gemeinde', 'municipality' FROM {{region}}
      UNION ALL SELECT {ISO}, 6, 'Kreis', NULL FROM {{region}}""",
    "equivalents": """SELECT DISTINCT equivalent, 'about ' || equivalent AS description FROM [level_raw] WHERE equivalent <> ''""",
    "meanings": """SELECT l.country_iso, l.level, l.equivalent, e.description, l.local_term
      FROM [level_raw] l JOIN [equivalents] e ON l.equivalent = e.equivalent""",
    "name_sources": """SELECT 'src-' || CAST(n_nationkey AS STRING) AS code, 'S' || CAST(n_nationkey AS STRING) AS short,
        'from ' || n_name AS long, CASE WHEN n_nationkey % 3 <> 0 THEN 'ISO ' || CAST(n_nationkey AS STRING) END AS standard FROM {nation}""",
    # raster tiles of 32 x 32 pixels per degree; which exist follows from the parts
    "dem_cells": f"""SELECT DISTINCT CAST(35 + p_partkey % 30 AS INT) AS lat_cell,
        CAST(-10 + {div('p_partkey', 30)} % 40 AS INT) AS lon_cell FROM {{part}} WHERE p_size % 7 <> 0""",
    "tiles": """SELECT 'dem' AS source_id, 'height' AS layer_id, lat_cell, lon_cell FROM [dem_cells]
      UNION ALL SELECT 'dem', 'hem', lat_cell, lon_cell FROM [dem_cells] WHERE (lat_cell + lon_cell) % 2 = 0
      UNION ALL SELECT 'urban', 'built', lat_cell, lon_cell FROM [dem_cells] WHERE lat_cell % 3 = 0""",
    "legend_values": """SELECT CAST(1 + r_regionkey AS BIGINT) AS value, r_name AS name FROM {region} WHERE r_regionkey < 4""",
    "sources": """SELECT 's' || CAST(p_partkey AS STRING) AS source_id, p_name AS name,
        CASE WHEN p_partkey % 3 = 0 THEN 'raster' ELSE 'vector' END AS kind, CAST(p_size AS BIGINT) AS size,
        CASE p_partkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'loading' ELSE 'ready' END AS status, p_size % 5 <> 0 AS indexed,
        CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS license_name, '' AS license_url,
        CASE WHEN p_partkey % 6 = 0 THEN 'by ' || p_type END AS license_attribution FROM {part}""",
    "layers": """SELECT DISTINCT 's' || CAST(l_partkey AS STRING) AS source_id, l_linenumber AS layer_ord,
        'layer' || CAST(l_linenumber AS STRING) AS layer, CASE l_linenumber % 3 WHEN 0 THEN 'POINT' WHEN 1 THEN 'POLYGON' ELSE 'LINESTRING' END AS geometry_type,
        4326 AS srid, (l_partkey + l_linenumber) % 9 <> 0 AS has_index, CAST(l_partkey % 100 AS BIGINT) AS feature_count FROM {lineitem}""",
    "listing": """SELECT 'maps/' || CASE WHEN p_partkey % 10 = 9 THEN 'old/' ELSE '' END || 's' ||
          CAST(CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 1 ELSE p_partkey END AS STRING) ||
          CASE p_partkey % 5 WHEN 0 THEN '.gpkg' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.txt' ELSE '.zip' END AS key,
        CAST(p_size AS BIGINT) AS size, 'e' || CAST(p_size AS STRING) AS etag FROM {part}""",
    "loaded": """SELECT 's' || CAST(p_partkey AS STRING) AS source_id, 'maps/s' || CAST(p_partkey AS STRING) || '.gpkg' AS path,
        'e' || CAST(p_size % 40 AS STRING) AS etag FROM {part} WHERE p_size % 3 <> 0""",
    "file_events": f"""SELECT event_id AS seq, 'data/s' || CAST({div('event_id', 4)} % 50 AS STRING) ||
          CASE WHEN {div('event_id', 4)} % 6 = 5 THEN '.txt' ELSE '.gpkg' END AS path,
        1704067200000 + {div('event_id', 4)} * 450 + (event_id % 4) * ((event_id * 37) % 300) AS t_ms,
        CASE event_type WHEN 'view' THEN 'write' WHEN 'click' THEN 'create' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'rename' ELSE 'chmod' END AS op
        FROM {{events}}""",
    "spans": f"""SELECT 't' || CAST({div('event_id', 5)} AS STRING) AS trace_id, CAST(event_id AS STRING) AS span_id,
        CASE WHEN event_id % 5 <> 0 THEN CAST(event_id - event_id % 5 AS STRING) END AS parent_span_id,
        CASE WHEN event_id % 5 = 0 THEN 'GET /' || event_type ELSE event_type END AS name, ts AS start,
        CASE WHEN user_id % 11 <> 0 THEN ts + make_interval_ms END AS "end",
        CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'view' THEN 'Ok' ELSE 'Unset' END AS status_code FROM {{events}}""",
    "requests": """SELECT event_id AS request_id, CASE WHEN user_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE event_type WHEN 'view' THEN '/api/v1/query' WHEN 'click' THEN '/api/v1/sources/{sourceId}' WHEN 'error' THEN '' ELSE '/api/v1/gazetteer' END AS route,
        CAST(CASE user_id % 9 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 100 ELSE 200 END AS INT) AS status_code,
        CAST(floor(value * 100) AS DOUBLE) / 8192 AS duration_s, 's' || CAST(user_id % 20 AS STRING) AS source_id,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM {events}""",
}

# The one dialect difference: adding whole milliseconds to a timestamp.
_MS = {
    "spark": "make_dt_interval(0, 0, 0, CAST(CAST(floor(value * 10) AS INT) AS DECIMAL(18, 6)) / 1000)",
    "duckdb": "to_milliseconds(CAST(floor(value * 10) AS BIGINT))",
}


def expand(text: str, dialect: str, folder: str = "") -> str:
    """SQL with views and tables filled in for one engine."""
    while re.search(r"\[[a-z_]+\]", text):
        text = re.sub(r"\[([a-z_]+)\]", lambda m: f"({VIEWS[m[1]]})", text)
    text = text.replace("make_interval_ms", _MS[dialect])
    if dialect == "spark":
        text = text.replace('"end"', "`end`")
        return re.sub(r"\{([a-z]+)\}", lambda m: f"parquet.`{folder}/{m[1]}.parquet`" if m[1] in TABLES else m[0], text)
    return re.sub(r"\{([a-z]+)\}", lambda m: m[1] if m[1] in TABLES else m[0], text)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.sql(expand(VIEWS[name], "spark", folder))


def duck(text: str) -> str:
    """A DuckDB statement from text with [view] and {table} marks."""
    return expand(text, "duckdb")
