"""Pieces of plain SQL the oracles share."""

from __future__ import annotations

from .inputs import IMAGE_PIXELS, LAYER_ROWS, TILE_PIXELS, MERCATOR, MERCATOR_STEP, MERCATOR_X0, MERCATOR_Y0

PI = "3.141592653589793"


def vincenty(source: str, lon1: str, lat1: str, lon2: str, lat2: str, rounds: int = 8) -> str:
    """`source` rows plus km and azimuth; the iteration unrolled into nested SELECTs."""
    a, f = "6378137.0", "(1.0/298.257223563)"
    b = f"({a}*(1.0-{f}))"
    sql = f"""SELECT *, radians({lon2}-{lon1}) AS v_l, atan((1.0-{f})*tan(radians({lat1}))) AS v_u1,
        atan((1.0-{f})*tan(radians({lat2}))) AS v_u2, radians({lon2}-{lon1}) AS v_lam FROM ({source})"""
    for _ in range(rounds):
        sql = f"""SELECT * EXCLUDE (v_lam), v_lam AS v_old,
          sqrt((cos(v_u2)*sin(v_lam))*(cos(v_u2)*sin(v_lam)) + (cos(v_u1)*sin(v_u2)-sin(v_u1)*cos(v_u2)*cos(v_lam))*(cos(v_u1)*sin(v_u2)-sin(v_u1)*cos(v_u2)*cos(v_lam))) AS v_ss,
          sin(v_u1)*sin(v_u2)+cos(v_u1)*cos(v_u2)*cos(v_lam) AS v_cs FROM ({sql})"""
        sql = f"""SELECT *, atan2(v_ss, v_cs) AS v_sig,
          CASE WHEN v_ss = 0 THEN 0.0 ELSE cos(v_u1)*cos(v_u2)*sin(v_old)/v_ss END AS v_sa FROM ({sql})"""
        sql = f"""SELECT *, 1.0-v_sa*v_sa AS v_ca,
          CASE WHEN 1.0-v_sa*v_sa = 0 THEN 0.0 ELSE v_cs-2*sin(v_u1)*sin(v_u2)/(1.0-v_sa*v_sa) END AS v_cm FROM ({sql})"""
        sql = f"""SELECT * EXCLUDE (v_old), v_old, {f}/16*v_ca*(4+{f}*(4-3*v_ca)) AS v_c FROM ({sql})"""
        sql = f"""SELECT * EXCLUDE (v_old, v_c), v_l+(1-v_c)*{f}*v_sa*(v_sig+v_c*v_ss*(v_cm+v_c*v_cs*(2*v_cm*v_cm-1))) AS v_lam FROM ({sql})"""
        last, sql = sql, f"SELECT * EXCLUDE (v_ss, v_cs, v_sig, v_sa, v_ca, v_cm) FROM ({sql})"
    usq = f"(v_ca*({a}*{a}-{b}*{b})/({b}*{b}))"
    sql = f"""SELECT *, 1+{usq}/16384*(4096+{usq}*(-768+{usq}*(320-175*{usq}))) AS v_A,
        {usq}/1024*(256+{usq}*(-128+{usq}*(74-47*{usq}))) AS v_B FROM ({last})"""
    return f"""SELECT * EXCLUDE (v_l, v_u1, v_u2, v_lam, v_ss, v_cs, v_sig, v_sa, v_ca, v_cm, v_A, v_B),
        CASE WHEN {lon1}={lon2} AND {lat1}={lat2} THEN 0.0 ELSE {b}*v_A*(v_sig-v_B*v_ss*(v_cm+v_B/4*(v_cs*(2*v_cm*v_cm-1)
          -v_B/6*v_cm*(4*v_ss*v_ss-3)*(4*v_cm*v_cm-3))))/1000.0 END AS km,
        CASE WHEN {lon1}={lon2} AND {lat1}={lat2} THEN NULL ELSE
          fmod(degrees(atan2(cos(v_u2)*sin(v_lam), cos(v_u1)*sin(v_u2)-sin(v_u1)*cos(v_u2)*cos(v_lam)))+360.0, 360.0) END AS az
        FROM ({sql})"""


def compass(az: str, points: int = 8) -> str:
    rose = {8: "['N','NE','E','SE','S','SW','W','NW']",
            16: "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"}[points]
    n = f"(fmod({az}, 360.0) + CASE WHEN fmod({az}, 360.0) < 0 THEN 360.0 ELSE 0.0 END)"
    return f"list_extract({rose}, CAST(round({n}/{360.0 / points}) AS INT) % {points} + 1)"


def km_label(km: str, rose: str, name: str) -> str:
    r = f"(CASE WHEN {km} < 10 THEN round({km}*2)/2 ELSE round({km}) END)"
    return (f"(CASE WHEN {r}=floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE CAST(CAST(floor({r}) AS BIGINT) AS VARCHAR) || '.5' END"
            f" || ' km ' || {rose} || ' ' || {name})")


IN_BOX = "lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"
IN_DIAMOND = "(abs(lon-cx)+abs(lat-cy) <= r AND NOT (abs(lon-cx)+abs(lat-cy) < hole))"


def raster_samples(points: str) -> str:
    """(points.*, source_id, layer_id, raw) of every layer by formula; nodata dropped."""
    nodata = {(r[0], r[1]): r[4] for r in LAYER_ROWS}
    parts = []
    for key, text in TILE_PIXELS.items():
        value = text.format(row="prow", col="pcol")
        parts.append(f"""SELECT p.* EXCLUDE (lat_cell, lon_cell, prow, pcol), '{key[0]}' AS source_id, '{key[1]}' AS layer_id,
          CAST({value} AS DOUBLE) AS raw FROM (SELECT *, CAST(floor(lat) AS INT) AS lat_cell, CAST(floor(lon) AS INT) AS lon_cell,
          CAST(floor((floor(lat)+1-lat)*32) AS INT) AS prow, CAST(floor((lon-floor(lon))*32) AS INT) AS pcol FROM ({points})) p
          JOIN (SELECT lat_cell, lon_cell FROM [tiles] WHERE source_id='{key[0]}' AND layer_id='{key[1]}') t USING (lat_cell, lon_cell)
          WHERE prow < 32""")
    for key, text in IMAGE_PIXELS.items():
        value = text.format(row="prow", col="pcol")
        parts.append(f"""SELECT p.* EXCLUDE (prow, pcol), '{key[0]}' AS source_id, '{key[1]}' AS layer_id, CAST({value} AS DOUBLE) AS raw
          FROM (SELECT *, CAST(floor((65-lat)*2) AS INT) AS prow, CAST(floor((lon+10)*2) AS INT) AS pcol FROM ({points})) p
          WHERE prow BETWEEN 0 AND 59 AND pcol BETWEEN 0 AND 79""")
    for key, text in MERCATOR.items():  # the Web Mercator formula, then the pixel
        value = text.format(row="prow", col="pcol")
        parts.append(f"""SELECT p.* EXCLUDE (prow, pcol), '{key[0]}' AS source_id, '{key[1]}' AS layer_id, CAST({value} AS DOUBLE) AS raw
          FROM (SELECT *, CAST(floor(({MERCATOR_Y0} - 6378137.0 * ln(tan(pi()/4 + radians(lat)/2))) / {MERCATOR_STEP}) AS INT) AS prow,
          CAST(floor((6378137.0 * radians(lon) - {MERCATOR_X0}) / {MERCATOR_STEP}) AS INT) AS pcol FROM ({points})) p
          WHERE prow BETWEEN 0 AND 63 AND pcol BETWEEN 0 AND 63""")
    drops = " OR ".join(f"(source_id='{s}' AND layer_id='{l}' AND raw={v})" for (s, l), v in nodata.items() if v is not None)
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE NOT ({drops})"


ADMIN_HITS = f"(SELECT point_id, lon, lat, a.* FROM [all_pts] p JOIN [admin] a ON {IN_BOX})"
LEVEL = r"(CASE WHEN regexp_full_match(admin_level, '[+-]?[0-9]+') THEN CAST(admin_level AS INT) END)"
STORED_LEVEL = r"coalesce(TRY_CAST(regexp_extract(admin_level, '^\s*([+-]?[0-9]+)', 1) AS INT), 0)"
POINT_COUNTRY = f"""(SELECT point_id, country_iso AS point_country FROM (SELECT point_id, country_iso,
  row_number() OVER (PARTITION BY point_id ORDER BY coalesce({LEVEL}, -1) DESC, country_iso) AS rn
  FROM {ADMIN_HITS} WHERE country_iso <> '') WHERE rn = 1)"""
POINT_TIER = f"""(SELECT point_id, min(fid) AS point_tier FROM (SELECT h.*, {LEVEL} AS level FROM {ADMIN_HITS} h) h
  JOIN [meanings] m ON m.country_iso = h.country_iso AND m.level = h.level WHERE equivalent = 'state' GROUP BY 1)"""
CLOSURE = """(WITH RECURSIVE c(fid, anc_fid, depth) AS (SELECT fid, fid, 0 FROM [admin] UNION ALL
  SELECT c.fid, a.parent_id, depth + 1 FROM c JOIN [admin] a ON a.fid = c.anc_fid JOIN [admin] up ON up.fid = a.parent_id
  WHERE coalesce(a.parent_id, 0) <> 0 AND depth < 32) SELECT * FROM c)"""
TIERS = f"""(SELECT c.fid, arg_min(c.anc_fid, c.depth) AS tier_fid FROM {CLOSURE} c JOIN
  (SELECT fid, country_iso, {STORED_LEVEL} AS level FROM [admin]) a ON a.fid = c.anc_fid
  JOIN [meanings] m ON m.country_iso = a.country_iso AND m.level = a.level WHERE equivalent = 'state' GROUP BY 1)"""
TIERED_PLACES = f"(SELECT p.*, t.tier_fid FROM [places] p LEFT JOIN {TIERS} t ON t.fid = p.admin_id)"


def near_places(points: str, places: str, radius: float, where: str = "TRUE") -> str:
    """points x places within the radius with km (box first, then the exact distance)."""
    box = (f"abs(lat-place_lat) <= {radius}/110.5 AND abs(lon-place_lon) <= "
           f"{radius}*1.01/(111.0*cos(radians(least(abs(lat)+{radius}/110.5, 89.0))))")
    pairs = f"SELECT q.*, s.* FROM ({points}) q JOIN (SELECT * FROM {places} WHERE {where}) s ON {box}"
    return f"SELECT * FROM ({vincenty(pairs, 'lon', 'lat', 'place_lon', 'place_lat')}) WHERE km <= {radius}"


ASKED = f"""SELECT p.point_id, p.lon, p.lat, c.point_country, t.point_tier FROM [pts] p
  LEFT JOIN (SELECT * FROM {POINT_COUNTRY.replace('[all_pts]', '[pts]')}) c USING (point_id)
  LEFT JOIN (SELECT * FROM {POINT_TIER.replace('[all_pts]', '[pts]')}) t USING (point_id)"""
GUARDS = """(coalesce(point_country,'')='' OR coalesce(country_iso,'')=point_country)
  AND (point_tier IS NULL OR (coalesce(admin_id,0)<>0 AND coalesce(tier_fid=point_tier, FALSE)))"""


def gathered(radii: dict[str, float], k: int) -> str:
    parts = []
    for cls, radius in radii.items():
        parts.append(near_places(ASKED, TIERED_PLACES, radius, f"place = '{cls}'"))
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, place ORDER BY km, fid) AS rank FROM ({union}))
      WHERE rank <= {k}"""


RANK_REACH = {"village": 5.0, "town": 18.0, "city": 60.0}
COMPOSITE_REACH = {"village": 120.0, "town": 120.0, "city": 120.0}
INSIDE_RADIUS = "CASE place WHEN 'village' THEN 0.8 WHEN 'town' THEN 1.5 WHEN 'city' THEN 3.0 ELSE 0.0 END"
CLASS_RANK = "CASE place WHEN 'village' THEN 1 WHEN 'town' THEN 2 WHEN 'city' THEN 3 ELSE 0 END"
SCORE = """((CASE WHEN coalesce(population,0)>0 THEN log10(CAST(population AS DOUBLE)+1)*1.0
  ELSE CASE place WHEN 'city' THEN 4.3 WHEN 'town' THEN 3.3 WHEN 'village' THEN 2.3 ELSE 0.0 END END)
  + CASE coalesce(capital,'') WHEN 'yes' THEN 2.0 WHEN '2' THEN 2.0 WHEN '3' THEN 1.5 WHEN '4' THEN 1.2 WHEN '5' THEN 0.6 WHEN '6' THEN 0.4 WHEN '7' THEN 0.2 ELSE 0.0 END*0.8
  + CASE WHEN coalesce(wikidata,'')<>'' THEN 0.3 ELSE 0.0 END - km*0.04)"""
