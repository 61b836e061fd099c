import pytest
from pyspark.sql import functions as F

from terralocus.functions import geometry
from terralocus.operators import bearing as B
from terralocus.operators import hierarchy as A
from terralocus.operators import landmarks as L
from terralocus.operators import subset as U
from terralocus.plans import gazetteer as G

ADMIN = "fid bigint, parent_id bigint, admin_level string, name string, name_native string, name_source string, country_iso string, x0 double, y0 double, x1 double, y1 double"
PLACES = ("fid bigint, place string, name string, name_native string, name_source string, admin_id bigint, country_iso string, "
          "population bigint, capital string, wikidata string, place_lon double, place_lat double")


def admin(spark, extra=()):
    rows = [(1, None, "2", "Country", "", "", "DE", 0.0, 40.0, 20.0, 60.0), (2, 1, "4", "Bavaria", "", "s1", "DE", 9.0, 49.0, 11.0, 51.0),
            (3, 2, "8", "Gemeinde", "", "s2", "DE", 9.9, 49.95, 10.05, 50.05), *extra]
    df = spark.createDataFrame(rows, ADMIN)
    return df.withColumn("rings", geometry.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


def places(spark, rows):
    return spark.createDataFrame([(i, cls, name, "", "s9", adm, iso, pop, cap, wiki, x, y)
                                  for i, (cls, name, adm, iso, pop, cap, wiki, x, y) in enumerate(rows, 1)], PLACES)


def meanings(spark):
    return spark.createDataFrame([("DE", 2, "country", "a country", "Land"), ("DE", 4, "state", "a state", "Bundesland"),
                                  ("DE", 8, "municipality", "a town", "Gemeinde"), ("AT", 4, "state", "a state", "Land")],
                                 "country_iso string, level int, equivalent string, description string, local_term string")


def points(spark, *xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, lon double, lat double")


def test_chain_and_closure(spark, shuffled):
    units = admin(spark)
    chain = A.resolve_chain(units.filter("fid = 3").select("fid"), units, A.ancestor_closure(units)).orderBy("depth").collect()
    assert [(r["level"], r["parent_id"]) for r in chain] == [(8, 2), (4, 1), (2, 0)]


def test_closure_stops_at_cycles_and_follows_long_chains(spark):
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "fid bigint, parent_id bigint")
    depths = sorted(r["depth"] for r in A.ancestor_closure(cycle).filter("fid = 1").collect())
    assert depths == list(range(33))
    line = spark.createDataFrame([(i, i - 1) for i in range(1, 60)], "fid bigint, parent_id bigint")
    reach = A.ancestor_closure(line).groupBy("fid").agg(F.max("depth").alias("d")).collect()
    assert all(r["d"] == min(r["fid"] - 1, 32) for r in reach)


def test_country_rules(spark):
    hits = spark.createDataFrame([
        (1, 1, "8", "DE"), (1, 2, "2", "FR"), (2, 1, "4", "PS"), (2, 2, "4", "IL"), (3, 1, "fill", "AA"), (3, 2, "2", "ZZ"),
        (4, 1, "8", ""), (4, 2, "2", "DE"), (5, 1, "8", "")], "point_id bigint, fid bigint, admin_level string, country_iso string")
    assert dict(map(tuple, A.point_countries(hits).collect())) == {1: "DE", 2: "IL", 3: "ZZ", 4: "DE"}


def test_locate(spark):
    extra = [(4, 1, "fill", "Sea", "", "", "", 30.0, 40.0, 31.0, 41.0)]
    hits = G.covering(points(spark, (10, 50), (9, 50), (30.5, 40.5), (70, 70)), admin(spark, extra), G.ADMIN_COLUMNS)
    got = {r["point_id"]: r for r in A.locate(hits, meanings(spark)).collect()}
    assert [u["level"] for u in got[0]["hierarchy"]] == [8, 4, 2]
    assert [u["equivalent"] for u in got[0]["hierarchy"]] == ["municipality", "state", "country"]
    assert [u["name"] for u in got[1]["hierarchy"]] == ["Bavaria", "Country"]
    assert got[2]["hierarchy"] == [] and got[2]["country_iso"] == ""  # covered, but by no numbered level
    assert 3 not in got


def test_sidecar_must_define_its_equivalents(spark):
    raw = spark.createDataFrame([("DE", 4, "Land", "state"), ("DE", 6, "Kreis", "")], "country_iso string, level int, local_term string, equivalent string")
    defined = spark.createDataFrame([("country", "d")], "equivalent string, description string")
    with pytest.raises(ValueError, match="not defined"):
        A.level_meanings(raw, defined)


def test_mountains_and_islands(spark):
    hits = spark.createDataFrame([
        (1, 1, "Alpen", "", "", "range", None, 200000.0), (1, 2, "Steigerwald", "", "", "range", 400.0, 1694.0),
        (1, 3, "Schwanberg", "", "", "mountain", 474.0, 0.5), (1, 4, "", "", "", "range", None, 1.0),
        (2, 5, "Unknown", "", "", "range", None, None), (3, 6, "Hill", "", "", "hill", None, 1.0)],
        "point_id bigint, fid bigint, name string, name_native string, name_source string, landform string, ele double, area_km2 double")
    got = {r["point_id"]: r for r in L.mountains(hits).collect()}
    assert got[1]["range"]["name"] == "Steigerwald" and "elevation" not in got[1]["range"]
    assert got[1]["mountain"]["name"] == "Schwanberg" and got[1]["mountain"]["elevation"] == 474
    assert got[2]["range"]["name"] == "Unknown" and got[2]["mountain"] is None and 3 not in got
    isl = spark.createDataFrame([(1, 2, "B", "x", ""), (1, 1, "B", "y", ""), (1, 3, "A", "", ""), (1, 4, "", "", "")],
                                "point_id bigint, fid bigint, name string, name_native string, name_source string")
    assert [(i["name"], i["name_native"]) for i in L.islands(isl).first()["islands"]] == [("A", ""), ("B", "y")]


@pytest.mark.parametrize("place,km,population,capital,wikidata,score", [
    ("city", 10.0, 9999, "", "", 3.6), ("village", 0.0, 0, "", "", 2.3), ("town", 0.0, 0, "3", "", 4.5), ("town", 0.0, None, None, "Q1", 3.6),
    ("city", 25.0, 9999, "", None, 3.0)])
def test_composite_score(spark, place, km, population, capital, wikidata, score):
    df = spark.createDataFrame([(place, km, population, capital, wikidata)], "place string, distance_km double, population bigint, capital string, wikidata string")
    assert df.select(B.composite_score()).first()[0] == pytest.approx(score)


def ranked(spark, rows):
    df = spark.createDataFrame([(1, i, p, n, d) for i, (p, n, d) in enumerate(rows)], "point_id bigint, fid bigint, place string, name string, distance_km double")
    full = df.withColumns({"point_country": F.lit(None).cast("string"), "point_tier": F.lit(None).cast("bigint"), "country_iso": F.lit("DE"),
                           "admin_id": F.lit(0).cast("bigint"), "tier_fid": F.lit(None).cast("bigint")})
    got = B.most_salient(full, B.RANK_POLICY, B.rank_strategy).collect()
    return got[0]["name"] if got else None


def test_rank_strategy(spark):
    assert ranked(spark, [("village", "V", 1.0), ("city", "C", 50.0)]) == "C"
    assert ranked(spark, [("town", "T", 4.0), ("city", "C", 50.0)]) == "T"      # near enough to win outright
    assert ranked(spark, [("town", "T", 6.0), ("city", "C", 61.0)]) == "T"      # city out of reach
    assert ranked(spark, [("village", "V", 6.0)]) is None
    assert ranked(spark, [("town", "B", 3.0), ("town", "A", 3.0)]) == "A"


def make(spark, place_rows, **options):
    units = admin(spark, [(5, 1, "4", "Hesse", "", "", "DE", 11.0, 49.0, 13.0, 51.0)])
    spots = G.with_tiers(places(spark, place_rows), units, meanings(spark), "state")
    return G.Gazetteer(admin=units, places=spots, meanings=meanings(spark), **options)


def test_bearing_labels_and_guards(spark):
    rows = [("village", "Dorf", 3, "DE", 0, None, None, 10.0, 50.0), ("city", "Stadt", 2, "DE", 500000, None, None, 10.5, 50.0),
            ("city", "Anderswo", 5, "DE", 9000000, "yes", "Q1", 11.2, 50.0), ("city", "Ausland", 2, "FR", 9000000, "yes", "Q1", 10.6, 50.0),
            ("city", "Heimlos", 0, "DE", 9000000, "yes", "Q1", 10.61, 50.0)]
    g = make(spark, rows)
    pts = points(spark, (10.001, 50.0), (10.45, 50.0), (10.5, 50.02), (10.5, 50.2), (70.0, 0.0))
    got = {r["point_id"]: r for r in G.bearings(pts, G.summarise(pts, g), g).collect()}
    assert got[0]["label"] == "in Dorf" and got[0]["inside"] and got[0]["compass"] == ""
    assert got[1]["label"] == "3.5 km W Stadt"
    assert got[2]["label"] == "in Stadt"
    assert got[3]["label"] == "22 km N Stadt" and got[3]["azimuth"] == pytest.approx(0, abs=1e-6)
    assert 4 not in got


def test_near_without_inside_is_prope(spark):
    policy = B.BearingPolicy(candidate_radius_km=120.0, inside_radius={"village": 0.1})
    g = make(spark, [("village", "Dorf", 3, "DE", 0, None, None, 10.0, 50.0)], policy=policy)
    pts = points(spark, (10.005, 50.0))
    fix = G.bearings(pts, G.summarise(pts, g), g).first()
    assert fix["label"] == "prope Dorf" and not fix["inside"] and fix["compass"] == "" and fix["azimuth"] == 0


def test_whole_answer_without_optional_layers(spark):
    g = make(spark, [("city", "Stadt", 2, "DE", 500000, None, None, 10.5, 50.0)], license=("ODbL-1.0", "", ""))
    got = {r["point_id"]: r for r in G.gazetteer(points(spark, (10.0, 50.0), (70.0, 0.0)), g).collect()}
    assert got[0]["admin"]["country_iso"] == "DE" and got[0]["bearing"]["reference"] == "Stadt"
    assert got[0]["islands"] is None and got[0]["elevation"] is None and got[0]["license"]["name"] == "ODbL-1.0"
    assert [x["code"] for x in got[0]["sources"]] == ["s2", "s1", "s9"]
    # sections have one type, with or without the layers behind them
    bare = {f.name: f.dataType.simpleString() for f in G.gazetteer(points(spark, (10.0, 50.0)), g).schema.fields}
    assert (bare["mountains"], bare["exposure"], bare["elevation"], bare["islands"]) == (G.MOUNTAINS_TYPE, G.EXPOSURE_TYPE, G.ELEVATION_TYPE, G.ISLANDS_TYPE)
    assert got[1]["admin"] is None and got[1]["bearing"] is None and got[1]["sources"] == []


def test_subset_gives_the_same_answers(spark):
    rows = [("village", f"V{i}", 3, "DE", 10 * i, None, None, 10 + i / 50, 50 + i / 90) for i in range(40)]
    rows += [("city", f"C{i}", 2, "DE", 1000 * i, None, None, 10 + i / 10, 50.3) for i in range(15)]
    g = make(spark, rows, policy=B.RANK_POLICY, strategy=B.rank_strategy)
    pts = points(spark, (10.0, 50.0), (10.4, 50.1))
    hits = G.covering(pts, g.admin, G.ADMIN_COLUMNS)
    near = B.gather(pts.withColumns({"point_country": F.lit("DE"), "point_tier": F.lit(2)}), g.places, B.RANK_POLICY)
    units = U.needed_units(hits, near, A.ancestor_closure(g.admin))
    small = G.Gazetteer(admin=U.keep_needed(g.admin, units), places=U.keep_needed(g.places, U.needed_places(near)), meanings=g.meanings,
                        policy=B.RANK_POLICY, strategy=B.rank_strategy)
    assert small.places.count() < g.places.count()
    shown = lambda x: G.gazetteer(pts, x).select("point_id", F.to_json("admin").alias("a"), F.to_json("bearing").alias("b"))
    assert U.differences(shown(g), shown(small)).count() == 0


@pytest.mark.parametrize("rings", [
    [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]],
    [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]],
    [[(0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10), (0, 0)]]])
def test_interior_point_is_inside(spark, rings):
    shaped = [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    df = spark.createDataFrame([(shaped,)], "rings array<array<struct<x:double,y:double>>>")
    at = U.interior_point(F.col("rings"))
    df = df.select("rings", at["lon"].alias("lon"), at["lat"].alias("lat"))
    assert df.select(geometry.covers(geometry.edges(F.col("rings")), F.col("lon"), F.col("lat"))).first()[0]


def test_enrichment_flag():
    assert [G.wants_gazetteer(v) for v in (None, "", "yes", "0", "FALSE", "no", "off", "maybe")] == [True, True, True, False, False, False, False, True]


def test_inside_places_need_their_own_radius_only(spark):
    """Searching no farther than a place's own radius finds the same place; the candidates beyond are not met."""
    rows = [(("village", "town", "city")[i % 3], f"P{i}", 2, "DE", None, None, None, 10 + (i * 37 % 101) / 1500, 50 + (i * 53 % 103) / 1500) for i in range(240)]
    asked = points(spark, *[(10 + (i * 7 % 23) / 400, 50 + (i * 11 % 29) / 400) for i in range(60)]).withColumns(
        {"point_country": F.lit("DE"), "point_tier": F.lit(None).cast("bigint")})
    table = places(spark, rows).withColumn("tier_fid", F.lit(2).cast("bigint"))
    near, all_reached = (g(asked, table, B.RANK_POLICY) for g in (B.gather_inside, B.gather))
    of = lambda c: sorted(tuple(r) for r in B.inside_places(c, B.RANK_POLICY).select("point_id", "fid", "place", F.round("distance_km", 6)).collect())
    assert of(near) == of(all_reached) and len(of(near)) > 10
    assert near.filter(F.col("distance_km") > 3.0).isEmpty() and near.count() < all_reached.count()
