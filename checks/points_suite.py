"""Points, scalar functions, extents, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralocus.functions import attributes as A
from terralocus.functions import geometry, labels
from terralocus.functions.crs import reproject
from terralocus.functions.geodesy import azimuth_deg, distance_km, radius_box
from terralocus.operators import hits as H
from terralocus.operators import points as P

from . import sqlparts as S
from .inputs import with_rectangles
from .registry import check
from .views import view


@check("resolve_points", """SELECT idx,
    CASE WHEN lon IS NOT NULL AND lat IS NOT NULL THEN lon WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS x,
    CASE WHEN lon IS NOT NULL AND lat IS NOT NULL THEN lat WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS y,
    CASE WHEN coalesce(srid, 3857) = 0 THEN 4326 ELSE coalesce(srid, 3857) END AS srid,
    CASE WHEN coalesce(id, '') = '' THEN CAST(idx AS VARCHAR) ELSE id END AS echo_id,
    CASE WHEN (lon IS NULL OR lat IS NULL) AND (x IS NULL OR y IS NULL) THEN 'coordinates required: provide lon/lat or x/y' END AS error
    FROM [inputs]""")
def resolve_points(spark, d):
    return P.resolve_points(view(spark, d, "inputs"), batch_srid=3857)


@check("validate_points", """SELECT point_id, x, y, srid,
    CASE WHEN srid=4326 AND abs(x)>180 THEN 'longitude' WHEN srid=4326 AND abs(y)>90 THEN 'latitude' END AS field,
    CASE WHEN srid=4326 AND abs(x)>180 THEN x WHEN srid=4326 AND abs(y)>90 THEN y END AS value,
    CASE WHEN srid=4326 AND abs(x)>180 THEN '[-180, 180]' WHEN srid=4326 AND abs(y)>90 THEN '[-90, 90]' END AS "constraint"
    FROM [wide_pts]""")
def validate_points(spark, d):
    return P.validate_points(view(spark, d, "wide_pts")).select("point_id", "x", "y", "srid", "invalid.*")


def _zone(meridian: int) -> str:
    """Easting and northing of a transverse Mercator zone (GRS80, 0.9996) by Krueger's series up to n^4."""
    n = "(1/298.257222101)/(2-1/298.257222101)"
    k = f"(2*sqrt({n})/(1+{n}))"
    atanh = "(0.5*ln((1+({0}))/(1-({0}))))"
    q = f"({atanh.format('sin(radians(lat))')} - {k}*{atanh.format(k + '*sin(radians(lat))')})"
    turned = f"SELECT point_id, (exp({q})-exp(-{q}))/2 AS t, radians(lon-{meridian}) AS d FROM [pts]"
    plane = f"SELECT point_id, atan2(t, cos(d)) AS xi, {atanh.format('sin(d)/sqrt(1+t*t)')} AS eta FROM ({turned})"
    factors = [f"({n}/2-2*pow({n},2)/3+5*pow({n},3)/16+41*pow({n},4)/180)", f"(13*pow({n},2)/48-3*pow({n},3)/5+557*pow({n},4)/1440)",
               f"(61*pow({n},3)/240-103*pow({n},4)/140)", f"(49561*pow({n},4)/161280)"]
    east = "".join(f" + {f}*cos({2 * j}*xi)*(exp({2 * j}*eta)-exp(-{2 * j}*eta))/2" for j, f in enumerate(factors, 1))
    north = "".join(f" + {f}*sin({2 * j}*xi)*(exp({2 * j}*eta)+exp(-{2 * j}*eta))/2" for j, f in enumerate(factors, 1))
    scale = f"0.9996*6378137.0/(1+{n})*(1+pow({n},2)/4+pow({n},4)/64)"
    return f"SELECT point_id, round(500000 + {scale}*(eta{east}), 1) AS x, round({scale}*(xi{north}), 1) AS y FROM ({plane})"


@check("reproject_points", f"""SELECT p.point_id, round(radians(lon)*6378137.0, 3) AS mercator_x,
    round(ln(tan({S.PI}/4 + radians(lat)/2))*6378137.0, 3) AS mercator_y, a.x AS zone32_x, a.y AS zone32_y, b.x AS zone33_x, b.y AS zone33_y
    FROM [pts] p JOIN ({_zone(9)}) a USING (point_id) JOIN ({_zone(15)}) b USING (point_id)""")
def reproject_points(spark, d):
    pts = view(spark, d, "pts").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(4326).alias("srid"))
    out = P.reproject_points(pts, [3857, 25832, 25833], sources=(4326,))
    near = lambda c, digits: F.round(c, digits)
    return out.select(
        "point_id", near("x_3857", 3).alias("mercator_x"), near("y_3857", 3).alias("mercator_y"), near("x_25832", 1).alias("zone32_x"),
        near("y_25832", 1).alias("zone32_y"), near("x_25833", 1).alias("zone33_x"), near("y_25833", 1).alias("zone33_y"))


@check("reproject_back", """SELECT point_id, round(lon*1024, 4) AS zone32_lon, round(lat*1024, 4) AS zone32_lat, round(lon*1024, 4) AS zone33_lon, round(lat*1024, 4) AS zone33_lat FROM [pts]""")
def reproject_back(spark, d):
    """To each zone and back again, in 1024ths of a degree, which the points lie on."""
    out = view(spark, d, "pts").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(4326).alias("srid"))
    out = P.reproject_points(out, [25832, 25833], sources=(4326,))
    for zone in (25832, 25833):
        out = reproject(out.withColumn("_s", F.lit(zone)), f"x_{zone}", f"y_{zone}", "_s", 4326, f"lon_{zone}", f"lat_{zone}", sources=(zone,)).drop("_s")
    return out.select("point_id", *[(F.round(F.col(f"{c}_{z}") * 1024, 4) + 0.0).alias(f"zone{str(z)[-2:]}_{c}") for z in (25832, 25833) for c in ("lon", "lat")])


@check("source_filter", """SELECT source_id, status, kind FROM [sources] WHERE status='ready' AND source_id IN ('s0','s2','s3','s7','s8','s10','s150')""")
def source_filter(spark, d):
    wanted = ["s2", "s3", "s2", "s0", "s10", "s7", "s8", "s150"]
    return P.choose_sources(view(spark, d, "sources"), wanted).select("source_id", "status", "kind")


def _property_map(df):
    return F.create_map(
        F.lit("name"), F.col("name"), F.lit("capital"), F.col("capital"), F.lit("wikidata"), F.col("wikidata"),
        F.lit("country"), F.col("country_iso"))


@check("property_filter", """SELECT fid, name, capital, CAST(2 AS INT) AS kept FROM [places]""")
def property_filter(spark, d):
    places = view(spark, d, "places")
    kept = H.keep_map_properties(_property_map(places), ["name", "capital"])
    typed = H.keep_properties(places, ["name", "capital"], ["fid"]).withColumnRenamed("name", "typed_name")
    mapped = places.select("fid", kept.alias("m"))
    return mapped.join(typed, "fid").select("fid", F.col("typed_name").alias("name"), F.try_element_at("m", F.lit("capital")).alias("capital"), F.size("m").alias("kept"))


@check("drop_null_properties", """SELECT fid, 2 + CAST(capital IS NOT NULL AS INT) + CAST(wikidata IS NOT NULL AS INT) AS kept,
    '{' || CASE WHEN capital IS NOT NULL THEN '"capital":"' || capital || '",' ELSE '' END || '"name":"' || name || '"' ||
    CASE WHEN wikidata IS NOT NULL THEN ',"wikidata":"' || wikidata || '"' ELSE '' END || '}' AS packed FROM [places]""")
def drop_null_properties(spark, d):
    places = view(spark, d, "places")
    return places.select("fid", F.size(H.drop_null_values(_property_map(places))).alias("kept"),
                         H.pack_properties(places, ["name", "capital", "wikidata"]).alias("packed"))


@check("extent_filter", """SELECT point_id, fid, (lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax) AS inside,
    xmin<=xmax AND ymin<=ymax AS valid, abs(xmax-xmin) AS width, abs(ymax-ymin) AS height, (xmin+xmax)/2 AS center_x, (ymin+ymax)/2 AS center_y
    FROM (SELECT *, 100 + point_id % 25 AS fid FROM [all_pts]) JOIN [admin] USING (fid)""")
def extent_filter(spark, d):
    pts = view(spark, d, "all_pts").withColumn("fid", F.lit(100) + F.col("point_id") % 25)
    box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    units = view(spark, d, "admin").select("fid", "xmin", "ymin", "xmax", "ymax")
    return pts.join(units, "fid").select(
        "point_id", "fid", A.extent_contains(*box, F.col("lon"), F.col("lat")).alias("inside"),
        *[c.alias(n) for n, c in A.extent_measures(*box).items()])


_TYPES = """CASE event_id % 8 WHEN 0 THEN 'POINT' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'linestring' WHEN 3 THEN 'MULTILINESTRING'
    WHEN 4 THEN 'Polygon' WHEN 5 THEN 'MULTIPOLYGON' WHEN 6 THEN 'GEOMETRY' ELSE 'RASTER' END"""


@check("geom_type_class", f"""SELECT kind, upper(kind) IN ('POINT','MULTIPOINT') AS is_point, upper(kind) IN ('LINESTRING','MULTILINESTRING') AS is_line,
    upper(kind) IN ('POLYGON','MULTIPOLYGON') AS is_polygon, count(*) AS n FROM (SELECT {_TYPES} AS kind FROM {{events}}) GROUP BY 1""")
def geom_type_class(spark, d):
    kinds = spark.read.parquet(f"{d}/events.parquet").select(F.expr(_TYPES).alias("kind"))
    k = F.col("kind")
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(
        "kind", geometry.is_point_type(k).alias("is_point"), geometry.is_line_type(k).alias("is_line"),
        geometry.is_polygon_type(k).alias("is_polygon"), "n")


_WKT = """CASE event_id % 6 WHEN 0 THEN 'POINT(' || CAST(event_id % 180 AS STRING) || ' ' || CAST(event_id % 90 AS STRING) || ')'
    WHEN 1 THEN 'POINT Z(' || CAST(event_id % 180 AS STRING) || '.5   -' || CAST(event_id % 90 AS STRING) || ' 7)'
    WHEN 2 THEN 'LINESTRING(1 2, 3 4)' WHEN 3 THEN 'POINT(a ' || CAST(event_id AS STRING) || ')' WHEN 4 THEN 'EMPTY' ELSE 'POINT ( 5 )' END"""


@check("parse_wkt", f"""SELECT event_id AS point_id, CASE WHEN instr(wkt,'(') > 1 THEN trim(split_part(wkt,'(',1)) ELSE '' END AS kind,
    CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 180 AS DOUBLE) WHEN event_id % 6 = 1 THEN event_id % 180 + 0.5 WHEN event_id % 6 = 2 THEN NULL END AS lon,
    CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 90 AS DOUBLE) WHEN event_id % 6 = 1 THEN -1.0 * (event_id % 90) END AS lat,
    'POINT(' || CAST(event_id % 180 AS STRING) || '.000000 ' || CAST(event_id % 90 AS STRING) || '.000000)' AS made
    FROM (SELECT event_id, {_WKT} AS wkt FROM {{events}})""")
def parse_wkt(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("point_id"), F.expr(_WKT).alias("wkt"))
    at = geometry.parse_point(F.col("wkt"))
    i = F.col("point_id")
    return rows.select(
        "point_id", geometry.wkt_type(F.col("wkt")).alias("kind"), at["lon"].alias("lon"), at["lat"].alias("lat"),
        geometry.point_wkt((i % 180).cast("double"), (i % 90).cast("double"), F.lit(0.0)).alias("made"))


_PATHS = """CASE p_partkey % 8 WHEN 0 THEN 'a/b/s' || CAST(p_partkey AS STRING) || '.gpkg' WHEN 1 THEN 's' || CAST(p_partkey AS STRING) || '.tar.ZIP'
    WHEN 2 THEN '.gpkg' WHEN 3 THEN 'dir/' WHEN 4 THEN '' WHEN 5 THEN 'plain' || CAST(p_partkey AS STRING) WHEN 6 THEN '/x/.zip' ELSE 'k' || CAST(p_partkey AS STRING) || '.txt' END"""


@check("derive_source_id", f"""SELECT p_partkey, path, CASE p_partkey % 8 WHEN 0 THEN 's' || CAST(p_partkey AS STRING) WHEN 1 THEN 's' || CAST(p_partkey AS STRING) || '.tar'
    WHEN 2 THEN '.gpkg' WHEN 3 THEN 'dir' WHEN 4 THEN '' WHEN 5 THEN path WHEN 6 THEN '.zip' ELSE 'k' || CAST(p_partkey AS STRING) END AS source_id,
    p_partkey % 8 IN (0, 1, 2, 6) AS supported FROM (SELECT p_partkey, {_PATHS} AS path FROM {{part}})""")
def derive_source_id(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_PATHS).alias("path"))
    return rows.select("p_partkey", "path", A.source_id(F.col("path")).alias("source_id"), A.is_source_file(F.col("path")).alias("supported"))


_PAIRS = """SELECT point_id, lon, lat, -170 + CAST((point_id * 613) % 348160 AS DOUBLE) / 1024 AS lon2,
    -20 + CAST((point_id * 877) % 102400 AS DOUBLE) / 1024 AS lat2 FROM [pts]"""


def _pairs(spark, d):
    i = F.col("point_id")
    return view(spark, d, "pts").withColumns({
        "lon2": ((i * 613) % 348160).cast("double") / 1024 - 170, "lat2": ((i * 877) % 102400).cast("double") / 1024 - 20})


@check("geodesic_distance", f"SELECT point_id, round(km, 3) AS km FROM ({S.vincenty(_PAIRS, 'lon', 'lat', 'lon2', 'lat2', 14)})")
def geodesic_distance(spark, d):
    km = distance_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return _pairs(spark, d).select("point_id", F.round(km, 3).alias("km"))


@check("azimuth", f"SELECT point_id, round(az, 4) AS azimuth FROM ({S.vincenty(_PAIRS, 'lon', 'lat', 'lon2', 'lat2', 14)})")
def azimuth(spark, d):
    az = azimuth_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return _pairs(spark, d).select("point_id", F.round(az, 4).alias("azimuth"))


@check("compass", f"SELECT point_id, az, {S.compass('az')} AS rose8, {S.compass('az', 16)} AS rose16 FROM (SELECT point_id, CAST((point_id*13) % 14400 AS DOUBLE)/8 - 720 AS az FROM [pts])")
def compass(spark, d):
    az = ((F.col("point_id") * 13) % 14400).cast("double") / 8 - 720
    return view(spark, d, "pts").select("point_id", az.alias("az"), labels.compass(az).alias("rose8"), labels.compass(az, 16).alias("rose16"))


@check("round_distance", "SELECT point_id, km, CASE WHEN km < 10 THEN round(km*2)/2 ELSE round(km) END AS shown FROM (SELECT point_id, CAST(point_id % 4000 AS DOUBLE)/128 AS km FROM [pts])")
def round_distance(spark, d):
    km = (F.col("point_id") % 4000).cast("double") / 128
    return view(spark, d, "pts").select("point_id", km.alias("km"), labels.round_distance(km).alias("shown"))


@check("bearing_label", f"""SELECT point_id, {S.km_label('km', 'rose', "'Town'")} AS label FROM
    (SELECT point_id, CAST(point_id % 4000 AS DOUBLE)/128 AS km, {S.compass('CAST(point_id % 360 AS DOUBLE)')} AS rose FROM [pts])""")
def bearing_label(spark, d):
    km = labels.round_distance((F.col("point_id") % 4000).cast("double") / 128)
    rose = labels.compass((F.col("point_id") % 360).cast("double"))
    return view(spark, d, "pts").select("point_id", labels.bearing_label(km, rose, F.lit("Town")).alias("label"))


@check("knn_bbox", f"""SELECT point_id, round(lon-w, 6) AS min_x, round(lon+w, 6) AS max_x, round(y-h, 6) AS min_y, round(y+h, 6) AS max_y FROM
    (SELECT point_id, lon, y, 60/111.32 AS h, 60/(111.32*greatest(cos(y*{S.PI}/180), 0.01)) AS w FROM (SELECT point_id, lon, lat*1.375 AS y FROM [pts]))""")
def knn_bbox(spark, d):
    pts = view(spark, d, "pts").withColumn("y", F.col("lat") * 1.375)
    return pts.select("point_id", *[F.round(c, 6).alias(n) for n, c in radius_box(F.col("lon"), F.col("y"), 60.0).items()])


@check("typed_property", """SELECT fid, name AS text_name, '' AS text_of_number, coalesce(population, 0) AS population, CAST(0 AS BIGINT) AS int_of_text,
    CAST(trunc(place_lon) AS BIGINT) AS lon_whole, CAST(admin_id AS DOUBLE) AS admin_float, CAST(0 AS DOUBLE) AS float_of_text,
    CASE place WHEN 'village' THEN 1 WHEN 'town' THEN 2 WHEN 'city' THEN 3 ELSE 0 END AS class_rank, CASE WHEN fid % 2 = 0 THEN CAST(fid AS INT) END AS epsg,
    fid IN (4326, 3857, 25832, 25833, 31466, 31467) AS known_srid, place = 'town' OR country_iso = 'town' AS has_town, capital AS custom_capital FROM [places]""")
def typed_property(spark, d):
    p = view(spark, d, "places")
    crs = F.concat(F.when(F.col("fid") % 2 == 0, F.lit("EPSG:")).otherwise(F.lit("urn:")), F.col("fid").cast("string"))
    return p.select(
        "fid", A.string_property(p, "name").alias("text_name"), A.string_property(p, "population").alias("text_of_number"),
        A.int_property(p, "population").alias("population"), A.int_property(p, "name").alias("int_of_text"),
        A.int_property(p, "place_lon").alias("lon_whole"), A.float_property(p, "admin_id").alias("admin_float"),
        A.float_property(p, "name").alias("float_of_text"), A.class_rank(F.col("place")).alias("class_rank"),
        A.epsg_code(crs).alias("epsg"), A.is_known_srid(F.col("fid")).alias("known_srid"),
        A.has_keyword(F.array("place", "country_iso"), "town").alias("has_town"),
        A.custom_value(F.create_map(F.lit("capital"), F.col("capital")), "capital").alias("custom_capital"))


@check("license_text", """SELECT source_id, coalesce(license_name,'')='' AND coalesce(license_url,'')='' AND coalesce(license_attribution,'')='' AS empty,
    CASE WHEN coalesce(license_attribution,'')<>'' THEN license_attribution ELSE license_name END AS shown FROM [sources]""")
def license_text(spark, d):
    name, url, by = (F.col(f"license_{c}") for c in ("name", "url", "attribution"))
    return view(spark, d, "sources").select("source_id", A.license_is_empty(name, url, by).alias("empty"), A.license_text(name, by).alias("shown"))


_N = lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


@check("geometry_output", f"""SELECT fid, 'POLYGON((' || {_N('xmin')} || ' ' || {_N('ymin')} || ', ' || {_N('xmax')} || ' ' || {_N('ymin')} || ', ' || {_N('xmax')} || ' ' || {_N('ymax')}
    || ', ' || {_N('xmin')} || ' ' || {_N('ymax')} || ', ' || {_N('xmin')} || ' ' || {_N('ymin')} || '))' AS wkt, 'POLYGON' AS kind FROM [admin]""")
def geometry_output(spark, d):
    wkt = geometry.polygon_wkt(F.col("rings"))
    return with_rectangles(view(spark, d, "admin")).select("fid", wkt.alias("wkt"), geometry.wkt_type(wkt).alias("kind"))


@check("locality_sort", "SELECT point_id, CAST(floor(lat) AS BIGINT) AS tile_lat, CAST(floor(lon) AS BIGINT) AS tile_lon, TRUE AS ordered FROM [pts]")
def locality_sort(spark, d):
    # position inside a task is checked against the order it must have
    ordered = P.sort_by_locality(view(spark, d, "pts"))

    def follow(batches):
        last = None
        for pdf in batches:
            keys = list(zip(pdf["lat"].floordiv(1), pdf["lon"].floordiv(1), pdf["lat"], pdf["lon"]))
            flags = []
            for key in keys:
                flags.append(last is None or key >= last)
                last = key
            yield pdf.assign(tile_lat=pdf["lat"].floordiv(1).astype("int64"), tile_lon=pdf["lon"].floordiv(1).astype("int64"), ordered=flags)[
                ["point_id", "tile_lat", "tile_lon", "ordered"]]

    return ordered.mapInPandas(follow, "point_id bigint, tile_lat bigint, tile_lon bigint, ordered boolean")
