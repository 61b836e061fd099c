"""Hierarchy, landmarks, bearing and the whole gazetteer answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralocus.functions.attributes import level_number
from terralocus.operators import bearing as B
from terralocus.operators import hierarchy as A
from terralocus.operators import landmarks as L
from terralocus.operators import subset as U
from terralocus.operators.nearest import nearest
from terralocus.operators.spots import at_spots, spots_of
from terralocus.plans import gazetteer as G
from terralocus.plans.query import answer_batch

from . import sqlparts as S
from .inputs import admin, catalog, gazetteer_tables, islands, mountains, saved_index, tiered_places, written
from .raster_suite import EXPOSURE
from .registry import check
from .views import view


def _admin_hits(spark, d, points):
    return G.covering(points, admin(spark, d), G.ADMIN_COLUMNS, saved_index(spark, d, "admin"))


def _shared(spark, d, answer, points="all_pts"):
    """`answer(points)` made once per spot, without the coordinates."""
    return at_spots(view(spark, d, points), answer).drop("lon", "lat")


def _closure(spark, d):
    def write(path):
        A.ancestor_closure(view(spark, d, "admin")).write.parquet(path)
    return spark.read.parquet(written(spark, d, "closure", write))


@check("level_meaning", rf"""SELECT fid, a.country_iso, a.level, equivalent, description, local_term FROM
    (SELECT fid, country_iso, {S.LEVEL} AS level FROM [admin]) a LEFT JOIN [meanings] m ON m.country_iso = a.country_iso AND m.level = a.level""")
def level_meaning(spark, d):
    meanings = A.level_meanings(view(spark, d, "level_raw"), view(spark, d, "equivalents"))
    units = view(spark, d, "admin").select("fid", "country_iso", level_number(F.col("admin_level")).alias("level"))
    return A.with_meaning(units, meanings)


@check("name_provenance", """SELECT fid, name_source, coalesce(short,'') AS short, coalesce(long,'') AS long, coalesce(standard,'') AS standard
    FROM [places] LEFT JOIN [name_sources] ON code = name_source""")
def name_provenance(spark, d):
    return A.with_provenance(view(spark, d, "places").select("fid", "name_source"), view(spark, d, "name_sources"))


_CHAIN = f"""SELECT point_id, list(struct_pack(level := level, name := name, fid := fid, src := name_source) ORDER BY level DESC, name, fid) AS chain FROM
    (SELECT point_id, min(fid) AS fid, name, name_source, {S.LEVEL} AS level FROM {S.ADMIN_HITS} GROUP BY point_id, name, name_source, admin_level, country_iso, parent_id) WHERE level IS NOT NULL GROUP BY 1"""
_LOCATED = f"""SELECT h.point_id, coalesce(any_value(c.iso), '') AS country_iso FROM {S.ADMIN_HITS} h LEFT JOIN
    (SELECT point_id, country_iso AS iso FROM (SELECT point_id, country_iso, row_number() OVER (PARTITION BY point_id ORDER BY {S.LEVEL} DESC, country_iso) AS rn
      FROM {S.ADMIN_HITS} WHERE country_iso <> '' AND {S.LEVEL} IS NOT NULL) WHERE rn = 1) c ON c.point_id = h.point_id GROUP BY 1"""


@check("locate", rf"""SELECT l.point_id, l.country_iso, u.level, u.name, coalesce(m.equivalent,'') AS equivalent, coalesce(m.local_term,'') AS local_term,
    coalesce(m.description,'') AS description, u.pos FROM ({_LOCATED}) l LEFT JOIN
    (SELECT point_id, name, level, iso, row_number() OVER (PARTITION BY point_id ORDER BY level DESC, name, fid) - 1 AS pos FROM
      (SELECT point_id, fid, name, country_iso AS iso, {S.LEVEL} AS level FROM {S.ADMIN_HITS}) WHERE level IS NOT NULL) u ON u.point_id = l.point_id
    LEFT JOIN [meanings] m ON m.country_iso = u.iso AND m.level = u.level""")
def locate(spark, d):
    def answer(p):  # the chain is taken apart per spot, so no point carries it whole
        located = A.locate(_admin_hits(spark, d, p), view(spark, d, "meanings"))
        rows = located.select("point_id", "country_iso", F.posexplode_outer("hierarchy").alias("pos", "u"))
        return rows.select("point_id", "country_iso", F.col("pos").cast("bigint").alias("pos"), "u.level", "u.name", "u.equivalent", "u.local_term", "u.description")

    return _shared(spark, d, answer)


@check("country_of_point", f"SELECT point_id, point_country AS country_iso FROM {S.POINT_COUNTRY}")
def country_of_point(spark, d):
    return _shared(spark, d, lambda p: A.point_countries(_admin_hits(spark, d, p)))


@check("resolve_chain", f"""SELECT c.fid, c.depth, c.anc_fid, coalesce(a.parent_id, 0) AS parent_id, {S.STORED_LEVEL} AS level, a.name, a.country_iso
    FROM {S.CLOSURE} c JOIN [admin] a ON a.fid = c.anc_fid""")
def resolve_chain(spark, d):
    units = view(spark, d, "admin")
    return A.resolve_chain(units.select("fid"), units, A.ancestor_closure(units))


@check("tier_ancestor", f"""SELECT 'place' AS kind, p.fid AS id, t.tier_fid FROM [places] p JOIN {S.TIERS} t ON t.fid = p.admin_id
    UNION ALL SELECT 'point', point_id, point_tier FROM {S.POINT_TIER}""")
def tier_ancestor(spark, d):
    places = tiered_places(spark, d).filter("tier_fid IS NOT NULL").select(F.lit("place").alias("kind"), F.col("fid").alias("id"), "tier_fid")
    points = _shared(spark, d, lambda p: A.point_tiers(_admin_hits(spark, d, p), view(spark, d, "meanings"), "state"))
    return places.unionByName(points.select(F.lit("point").alias("kind"), F.col("point_id").alias("id"), "tier_fid"))


@check("islands", f"""SELECT point_id, name, arg_min(name_native, fid) AS name_native, arg_min(name_source, fid) AS name_source,
    row_number() OVER (PARTITION BY point_id ORDER BY name) - 1 AS pos FROM [all_pts] JOIN [islands] ON {S.IN_DIAMOND} WHERE name <> '' GROUP BY point_id, name""")
def islands_check(spark, d):
    index = saved_index(spark, d, "first_islands")

    def answer(p):
        found = L.islands(G.covering(p, islands(spark, d), G.ISLAND_COLUMNS, index, merge=False))
        return found.select("point_id", F.posexplode("islands").alias("pos", "i")).select("point_id", F.col("pos").cast("bigint").alias("pos"), "i.*")

    return _shared(spark, d, answer)


_MOUNTAIN = f"""SELECT * FROM (SELECT point_id, landform, name, ele, name_source, row_number() OVER (PARTITION BY point_id, landform
    ORDER BY coalesce(area_km2,0) <= 0, CASE WHEN area_km2 > 0 THEN area_km2 ELSE 0 END, name, fid) AS rn
    FROM [all_pts] JOIN [mountains] ON {S.IN_DIAMOND} WHERE name <> '' AND landform IN ('mountain','range')) WHERE rn = 1"""


@check("mountains", f"""WITH m AS ({_MOUNTAIN}) SELECT point_id, max(CASE WHEN landform='mountain' THEN name END) AS mountain,
    max(CASE WHEN landform='mountain' THEN ele END) AS elevation, max(CASE WHEN landform='range' THEN name END) AS range_name FROM m GROUP BY 1""")
def mountains_check(spark, d):
    index = saved_index(spark, d, "first_mountains")
    found = _shared(spark, d, lambda p: L.mountains(G.covering(p, mountains(spark, d), G.MOUNTAIN_COLUMNS, index, merge=False)))
    return found.select("point_id", F.col("mountain.name").alias("mountain"), "mountain.elevation", F.col("range.name").alias("range_name"))


def _summary(spark, d, points):
    return A.admin_summary(_admin_hits(spark, d, points), view(spark, d, "meanings"), "state")


def _asked(spark, d, points):
    known = _summary(spark, d, points).select("point_id", "point_country", "point_tier")
    return points.join(known, "point_id", "left")


def _gathered(spark, d, points, policy):
    return B.gather(_asked(spark, d, points), tiered_places(spark, d), policy)


_RANK = S.gathered(S.RANK_REACH, 10)
_COMPOSITE = S.gathered(S.COMPOSITE_REACH, 250)


@check("bearing_candidates", f"SELECT point_id, place, fid, rank, round(km, 3) AS km FROM ({_COMPOSITE}) WHERE {S.GUARDS}")
def bearing_candidates(spark, d):
    def answer(p):  # rounded per spot: a point has hundreds of these rows
        found = B.guarded(_gathered(spark, d, p, B.COMPOSITE_POLICY))
        return found.select("point_id", "place", "fid", "rank", F.round("distance_km", 3).alias("km"))

    return _shared(spark, d, answer, "pts")


@check("salience_rank", f"""SELECT point_id, fid, place, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY
    NOT ({S.CLASS_RANK} >= 2 AND km <= 5), CASE WHEN {S.CLASS_RANK} >= 2 AND km <= 5 THEN 0 ELSE -({S.CLASS_RANK}) END, km, name, fid) AS rn
    FROM ({_RANK}) WHERE {S.GUARDS}) WHERE rn = 1""")
def salience_rank(spark, d):
    best = _shared(spark, d, lambda p: B.most_salient(_gathered(spark, d, p, B.RANK_POLICY), B.RANK_POLICY, B.rank_strategy), "pts")
    return best.select("point_id", "fid", "place", F.round("distance_km", 3).alias("km"))


@check("salience_composite", f"""SELECT point_id, fid, round(score, 4) AS score FROM (SELECT *, {S.SCORE} AS score, row_number() OVER
    (PARTITION BY point_id ORDER BY {S.SCORE} DESC, km, name, fid) AS rn FROM ({_COMPOSITE}) WHERE {S.GUARDS}) WHERE rn = 1""")
def salience_composite(spark, d):
    best = _shared(spark, d, lambda p: B.most_salient(_gathered(spark, d, p, B.COMPOSITE_POLICY), B.COMPOSITE_POLICY, B.composite_strategy), "pts")
    return best.select("point_id", "fid", F.round(B.composite_score(), 4).alias("score"))


_INSIDE = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, {S.CLASS_RANK} DESC, fid) AS rn FROM ({_RANK})
    WHERE rank <= 5 AND km <= {S.INSIDE_RADIUS} AND {S.GUARDS}) WHERE rn = 1"""


@check("inside_place", f"SELECT point_id, fid, place, round(km, 3) AS km FROM ({_INSIDE})")
def inside_place(spark, d):
    near = lambda p: B.gather_inside(_asked(spark, d, p), tiered_places(spark, d), B.RANK_POLICY)
    found = _shared(spark, d, lambda p: B.inside_places(near(p), B.RANK_POLICY), "pts")
    return found.select("point_id", "fid", "place", F.round("distance_km", 3).alias("km"))


_BEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY {S.SCORE} DESC, km, name, fid) AS rn FROM ({_COMPOSITE}) WHERE {S.GUARDS}) WHERE rn = 1"""
_ALLOWED = S.raster_samples("SELECT point_id, lon, lat FROM [pts]")
_AZ = S.vincenty("SELECT point_id AS pid, lon AS qlon, lat AS qlat, place_lon AS alon, place_lat AS alat, name, name_source, place, km AS dist, inside FROM fixes", "alon", "alat", "qlon", "qlat")
_FIX = f"""WITH gate AS (SELECT point_id, coalesce(raw >= 100, TRUE) AS allowed FROM [pts] LEFT JOIN (SELECT point_id, raw FROM ({_ALLOWED}) WHERE source_id='urban') USING (point_id)),
    ins AS ({_INSIDE}), best AS ({_BEST}),
    fixes AS (SELECT i.point_id, i.lon, i.lat, place_lon, place_lat, name, name_source, place, km, TRUE AS inside FROM ins i JOIN gate g ON g.point_id = i.point_id AND g.allowed
      UNION ALL SELECT b.point_id, b.lon, b.lat, place_lon, place_lat, name, name_source, place, km, FALSE FROM best b
        WHERE b.point_id NOT IN (SELECT i.point_id FROM ins i JOIN gate g ON g.point_id = i.point_id AND g.allowed))
    SELECT pid AS point_id, name AS reference, place AS class, round(dist, 3) AS km, inside, name_source,
    round(CASE WHEN inside OR dist < 1 THEN 0.0 ELSE az END, 4) AS azimuth, CASE WHEN inside OR dist < 1 THEN '' ELSE {S.compass('az')} END AS compass,
    CASE WHEN inside THEN 'in ' || name WHEN dist < 1 THEN 'prope ' || name ELSE {S.km_label('dist', S.compass('az'), 'name')} END AS label FROM ({_AZ})"""


@check("bearing", f"SELECT * EXCLUDE (name_source) FROM ({_FIX})")
def bearing(spark, d):
    fix = _shared(spark, d, lambda p: G.bearings(p, _summary(spark, d, p), gazetteer_tables(spark, d)), "pts")
    return fix.select("point_id", "reference", "class", F.round("distance_km", 3).alias("km"), "inside",
                      F.round("azimuth", 4).alias("azimuth"), "compass", "label")


def _on_pts(text: str) -> str:
    return text.replace("[all_pts]", "[pts]")


_CODES = f"""SELECT point_id, code, min(o) AS o FROM (
    SELECT point_id, src AS code, 1000 + i AS o FROM (SELECT point_id, unnest(chain).src AS src, generate_subscripts(chain, 1) AS i FROM ({_on_pts(_CHAIN)}))
    UNION ALL SELECT point_id, name_source, 2000 + row_number() OVER (PARTITION BY point_id ORDER BY name) FROM
      (SELECT point_id, name, arg_min(name_source, fid) AS name_source FROM [pts] JOIN [islands] ON {S.IN_DIAMOND} WHERE name <> '' GROUP BY point_id, name)
    UNION ALL SELECT point_id, name_source, CASE landform WHEN 'range' THEN 3000 ELSE 3001 END FROM ({_on_pts(_MOUNTAIN)})
    UNION ALL SELECT point_id, name_source, 4000 FROM ({_FIX})) WHERE coalesce(code,'') <> '' GROUP BY point_id, code"""


@check("provenance_set", f"""SELECT point_id, string_agg(code, ',' ORDER BY o) AS codes, string_agg(coalesce(short,''), ',' ORDER BY o) AS shorts
    FROM ({_CODES}) c LEFT JOIN [name_sources] n USING (code) GROUP BY 1""")
def provenance_set(spark, d):
    answers = G.gazetteer(view(spark, d, "pts"), gazetteer_tables(spark, d))
    return answers.filter(F.size("sources") > 0).select(
        "point_id", F.array_join(F.transform("sources", lambda s: s["code"]), ",").alias("codes"),
        F.array_join(F.transform("sources", lambda s: s["short"]), ",").alias("shorts"))


_SAMPLED = S.raster_samples("SELECT point_id, lon, lat FROM [pts]")


_WHOLE = f"""WITH fix AS ({_FIX}), loc AS ({_on_pts(_LOCATED)}), ch AS ({_on_pts(_CHAIN)}), isl AS (SELECT point_id, count(DISTINCT name) AS n FROM [pts] JOIN [islands] ON {S.IN_DIAMOND} WHERE name <> '' GROUP BY 1),
    mt AS ({_on_pts(_MOUNTAIN)}), ex AS ({_on_pts(EXPOSURE)}), z AS (SELECT point_id, raw FROM ({_SAMPLED}) WHERE layer_id='height')
    SELECT p.point_id, loc.country_iso, coalesce(len(ch.chain), 0) AS levels, ch.chain[1].name AS most_local, isl.n AS islands, m1.name AS mountain, m2.name AS mountain_range,
    fix.label, fix.inside, ex.slope_deg, coalesce(z.raw, 0.0) AS meters, z.raw IS NULL AS sea_level, 'ODbL-1.0' AS license
    FROM [pts] p LEFT JOIN loc USING (point_id) LEFT JOIN ch USING (point_id) LEFT JOIN isl USING (point_id) LEFT JOIN fix USING (point_id)
    LEFT JOIN ex USING (point_id) LEFT JOIN z USING (point_id) LEFT JOIN mt m1 ON m1.point_id = p.point_id AND m1.landform='mountain'
    LEFT JOIN mt m2 ON m2.point_id = p.point_id AND m2.landform='range'"""


def _shown(answers, g=""):
    """The compared parts of gazetteer answers, which stand at the top or within a struct."""
    at = lambda name: F.col(f"{g}.{name}" if g else name)
    return answers.select(
        "point_id", at("admin.country_iso").alias("country_iso"), F.coalesce(F.size(at("admin.hierarchy")), F.lit(0)).cast("bigint").alias("levels"),
        F.get(at("admin.hierarchy"), 0)["name"].alias("most_local"), F.when(at("islands").isNotNull(), F.size(at("islands"))).cast("bigint").alias("islands"),
        at("mountains.mountain.name").alias("mountain"), at("mountains.range.name").alias("mountain_range"),
        at("bearing.label").alias("label"), at("bearing.inside").alias("inside"), F.round(at("exposure.slope_deg"), 4).alias("slope_deg"),
        at("elevation.meters").alias("meters"), at("elevation.sea_level").alias("sea_level"), at("license.name").alias("license"))


@check("gazetteer", _WHOLE)
def gazetteer(spark, d):
    return _shown(G.gazetteer(view(spark, d, "pts"), gazetteer_tables(spark, d, license=("ODbL-1.0", "", ""))))


@check("answer_with_gazetteer", _WHOLE)
def answer_with_gazetteer(spark, d):
    pts = view(spark, d, "pts")
    number = lambda name: F.lit(None).cast("double").alias(name)
    inputs = pts.select(F.col("point_id").alias("idx"), F.lit("").alias("id"), "lon", "lat", number("x"), number("y"), F.lit(0).alias("srid"))
    answers = answer_batch(inputs, catalog(spark, d), gazetteer=gazetteer_tables(spark, d, license=("ODbL-1.0", "", "")), srids=(4326,))
    return _shown(answers, "gazetteer")


_NEAR10 = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, place ORDER BY km, fid) AS rank FROM
    ({S.near_places('SELECT point_id, lon, lat FROM [pts]', '[places]', 120.0, "place IN ('village','town','city')")})) WHERE rank <= 10"""


@check("extract_subset", f"""WITH near AS ({_NEAR10}) SELECT 'place' AS kind, fid FROM near GROUP BY fid UNION ALL
    SELECT 'unit', fid FROM (SELECT fid FROM [pts] JOIN [admin] ON {S.IN_BOX} UNION SELECT anc_fid FROM near JOIN {S.CLOSURE} c ON c.fid = near.admin_id)""")
def extract_subset(spark, d):
    pts = spots_of(view(spark, d, "pts"))  # which units and places are needed is the same for all points of a spot
    near = nearest(pts, view(spark, d, "places"), U.SUBSET_K, U.SUBSET_RADIUS_KM, ["admin_id"], group="place", values=["village", "town", "city"])
    covering = G.match_index(pts, G.build_index(admin(spark, d), ["fid"]))
    units = U.needed_units(covering, near, _closure(spark, d))
    kept_units = U.keep_needed(view(spark, d, "admin"), units).select(F.lit("unit").alias("kind"), "fid")
    kept_places = U.keep_needed(view(spark, d, "places"), U.needed_places(near)).select(F.lit("place").alias("kind"), "fid")
    return kept_places.unionByName(kept_units)


@check("trim_sidecar", """SELECT * FROM [level_raw] WHERE coalesce(equivalent,'') <> '' AND country_iso IN
    (SELECT country_iso FROM [places] WHERE country_iso <> '' UNION SELECT country_iso FROM [admin] WHERE country_iso <> '')""")
def trim_sidecar(spark, d):
    present = U.countries_present(view(spark, d, "places"), view(spark, d, "admin"))
    return U.trim_sidecar(view(spark, d, "level_raw"), present)


@check("sample_units", """SELECT fid, country_iso || '/L8 ' || name AS label, country_iso, (xmin+xmax)/2 AS lon, (ymin+ymax)/2 AS lat FROM
    (SELECT *, row_number() OVER (PARTITION BY country_iso ORDER BY fid) AS rn, CASE country_iso WHEN 'AS' THEN 3 ELSE 5 END AS n
     FROM [admin] WHERE admin_level = '8' AND country_iso <> '' AND name <> '') WHERE rn <= n""")
def sample_units(spark, d):
    per_country = view(spark, d, "level_raw").select("country_iso").distinct().withColumn("n", F.when(F.col("country_iso") == "AS", 3).otherwise(5))
    return U.sample_units(admin(spark, d), 8, per_country)
