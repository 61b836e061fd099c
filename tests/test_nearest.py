import numpy as np
import pytest
from pyspark.sql import functions as F

from terralocus.functions.geodesy import vincenty
from terralocus.operators import nearest as N
from terralocus.operators.nearest import load_places, nearest, prepare_places, save_places

PLACES = "fid bigint, place string, place_lon double, place_lat double"


def places(spark, rows):
    return spark.createDataFrame([(i, g, float(x), float(y)) for i, (g, x, y) in enumerate(rows, 1)], PLACES)


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, lon double, lat double")


def brute(xy, rows, k, radius, groups):
    out = set()
    for i, (x, y) in enumerate(xy):
        for g in groups:
            own = [(j, px, py) for j, (name, px, py) in enumerate(rows, 1) if name == g]
            if not own:
                continue
            ids, px, py = map(np.array, zip(*own))
            km, _ = vincenty(np.full(len(ids), x), np.full(len(ids), y), px, py)
            near = sorted((d, int(j)) for d, j in zip(km, ids) if d <= radius)[:k]
            out |= {(i, g, j, r) for r, (_, j) in enumerate(near, 1)}
    return out


def found(df):
    rows = df.select("point_id", "place", "fid", "rank").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_mini_gazetteer(spark):
    rows = [("city", 10.0, 50.0), ("town", 10.1, 50.0), ("village", 10.02, 50.0)]
    hits = nearest(points(spark, [(10, 50)]), places(spark, rows), 3, 60.0, ["place"]).orderBy("rank").collect()
    assert [h["fid"] for h in hits] == [1, 3, 2] and 6.5 < hits[2]["distance_km"] < 8
    close = nearest(points(spark, [(10, 50)]), places(spark, rows), 3, 1.0, [], group="place", values=["town"])
    assert close.count() == 0
    assert nearest(points(spark, [(10, 50)]), places(spark, rows), 0, 60.0, []).count() == 1


def scattered(seed, n):
    rng = np.random.default_rng(seed)
    spread = [("town" if i % 3 else "city", *rng.uniform((-5, 40), (5, 50))) for i in range(n)]
    crowd = [("town", *(rng.normal((0.3, 45.2), 0.02))) for _ in range(n)]
    copies = [("town", 0.31, 45.21)] * 60
    xy = [tuple(p) for p in rng.uniform((-4, 41), (4, 49), (60, 2))] + [tuple(p) for p in rng.normal((0.3, 45.2), 0.05, (60, 2))] + [(0.31, 45.21)]
    return [(g, float(x), float(y)) for g, x, y in spread + crowd + copies], [(float(x), float(y)) for x, y in xy]


@pytest.mark.parametrize("k,radius", [(3, 120.0), (25, 30.0), (250, 120.0)])
def test_dense_areas_match_brute_force(spark, k, radius):
    rows, xy = scattered(k, 300)
    got = found(nearest(points(spark, xy), places(spark, rows), k, radius, [], group="place", values=["city", "town"]))
    assert got == brute(xy, rows, k, radius, ["city", "town"])


def test_shuffled_join_gives_the_same(spark, shuffled):
    rows, xy = scattered(11, 200)
    got = found(nearest(points(spark, xy), places(spark, rows), 5, 60.0, [], group="place", values=["city", "town"]))
    assert got == brute(xy, rows, 5, 60.0, ["city", "town"])


def test_date_line_and_poles(spark):
    rng = np.random.default_rng(2)
    lon = rng.uniform(175, 185, 150)
    rows = [("p", float(x - 360 if x > 180 else x), float(y)) for x, y in zip(lon, rng.uniform(-10, 10, 150))]
    rows += [("p", float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 150), rng.uniform(85, 90, 150))]
    xy = [(180.0, 0.0), (-180.0, 1.0), (179.99, -3.0), (-179.5, 4.0), (0.0, 90.0), (12.0, 89.9), (170.0, 88.0), (-40.0, 86.0)]
    got = found(nearest(points(spark, xy), places(spark, rows), 20, 200.0, ["place"]))
    assert got == brute(xy, rows, 20, 200.0, ["p"])


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("crowd", [0, 400])
def test_groups_are_ranked_alike_whatever_the_size(spark, monkeypatch, large, crowd):
    """Null groups, null ids and more than 256 groups; sparse and dense; broadcast and shuffled."""
    from terralocus.operators import skew
    if large:
        monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(7)
    rows = [(i or None, f"g{i}" if i % 5 else None, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((-1, 44), (1, 46), (330, 2)))]
    rows += [(1000 + i, None if i % 2 else "crowd", float(x), float(y)) for i, (x, y) in enumerate(rng.normal((0.2, 45.1), 0.01, (crowd, 2)))]
    xy = [(0.2, 45.1), (-0.5, 44.5), (0.9, 45.9)]
    got = nearest(points(spark, xy), spark.createDataFrame(rows, PLACES), 2, 40.0, ["place_lon"], group="place")
    found = {(r["point_id"], r["place"], r["fid"], r["rank"]) for r in got.collect()}
    want = set()
    for i, (x, y) in enumerate(xy):
        km, _ = vincenty(np.full(len(rows), x), np.full(len(rows), y), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]))
        for g in {r[1] for r in rows}:
            near = sorted((d, r[0] if r[0] is not None else -1, r[0]) for d, r in zip(km, rows) if r[1] == g and d <= 40)[:2]
            want |= {(i, g, fid, n) for n, (_, _, fid) in enumerate(near, 1)}
    assert found == want


def test_a_hundred_thousand_places_in_one_cell(spark):
    """Exact, and the pairs per point stay in proportion to k whatever the crowd."""
    n, k = 100_000, 5
    rng = np.random.default_rng(9)
    px, py = 10.004 + rng.uniform(0, 0.006, n), 50.004 + rng.uniform(0, 0.006, n)
    xy = [(10.006, 50.006), (10.007, 50.0071), (10.0, 50.0), (10.02, 50.0), (9.9, 49.95), (10.3, 50.2), (13.0, 50.0), (10.004, 50.004)]
    frame = spark.createDataFrame([(px.tolist(), py.tolist())], "px array<double>, py array<double>").select(F.posexplode(F.arrays_zip("px", "py")).alias("i", "v"))
    frame = frame.select(F.col("i").cast("bigint").alias("fid"), F.lit("crowd").alias("place"), F.col("v.px").alias("place_lon"), F.col("v.py").alias("place_lat"))
    pts = points(spark, xy)
    index = prepare_places(frame, "place", pyramid=False)
    rows = index.rows.select("fid", "_group", "_plon", "_plat")
    pairs = N.candidate_pairs(pts, index, rows, k, 120.0, "point_id", "lon", "lat").groupBy("point_id").count().collect()
    assert len(pairs) == 7 and max(r["count"] for r in pairs) <= 2 * N.enough(k)
    got = {(r["point_id"], r["fid"], r["rank"]) for r in nearest(pts, index, k, 120.0, [], group="place").collect()}
    want = set()
    for i, (x, y) in enumerate(xy):
        near = np.argsort(np.hypot((px - x) * np.cos(np.radians(50)), py - y))[:2_000]
        km, _ = vincenty(np.full(len(near), x), np.full(len(near), y), px[near], py[near])
        want |= {(i, j, r) for r, (d, j) in enumerate(sorted((d, int(j)) for d, j in zip(km, near))[:k], 1) if d <= 120}
    assert got == want


def test_prepared_places_give_the_same(spark, tmp_path):
    rows, xy = scattered(13, 250)
    save_places(prepare_places(places(spark, rows), "place"), str(tmp_path / "places"))
    index = load_places(spark, str(tmp_path / "places"))
    assert index.size.rows == len(rows) and index.unique
    for k, radius in ((4, 120.0), (30, 25.0)):
        got = found(nearest(points(spark, xy), index, k, radius, [], group="place", values=["town"]))
        assert got == brute(xy, rows, k, radius, ["town"])
    with pytest.raises(ValueError):
        nearest(points(spark, xy), index, 1, 1.0, [])


def test_cell_bounds_hold(spark):
    rng = np.random.default_rng(5)
    n = 400
    level = rng.integers(0, 12, n)
    lon, lat, px, py = rng.uniform(-180, 180, n), rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-90, 90, n)
    frame = spark.createDataFrame([(int(a), *map(float, v)) for a, *v in zip(level, lon, lat, px, py)], "level int, lon double, lat double, px double, py double")
    side = F.pow(F.lit(2.0), 3 - F.col("level"))
    cell = N._cell(F.floor((F.col("px") + 180) / side), F.floor((F.col("py") + 90) / side))
    near, far = N._cell_km(F.col("lon"), F.col("lat"))
    true = N.distance_km(F.col("lon"), F.col("lat"), F.col("px"), F.col("py"))
    assert frame.withColumn("cell", cell).withColumns({"near": near, "far": far, "km": true}).filter("km < near - 1e-6 or km > far + 1e-6").count() == 0


def test_a_crowded_group_leaves_the_others_to_the_plain_way(spark, monkeypatch):
    """Only groups that are crowded around a point are looked for by counts, and pairs beyond the k-th place's bound are no pairs."""
    rows, xy = scattered(7, 300)
    met, plain = [], N._narrowed
    monkeypatch.setattr(N, "_narrowed", lambda front, *a: (met.append({r[0] for r in front.select("_group.value").distinct().collect()}), plain(front, *a))[1])
    index = prepare_places(places(spark, rows), "place")
    got = found(nearest(points(spark, xy), index, 3, 30.0, [], group="place"))
    assert got == brute(xy, rows, 3, 30.0, ["city", "town"])
    assert met and all(groups == {"town"} for groups in met)
    pairs = N.candidate_pairs(points(spark, xy[60:]), index, index.rows.filter("_copy <= 3").select("place", "fid", "_group", "_plon", "_plat"), 3, 30.0, "point_id", "lon", "lat")
    towns = pairs.filter("place = 'town'").groupBy("point_id").count()
    assert towns.agg({"count": "max"}).first()[0] <= N.enough(3)


@pytest.mark.parametrize("crowd", [1 << 15, 20])
def test_places_dealt_by_cell_match_brute_force(spark, shuffled, monkeypatch, crowd):
    """Cells of many points are dealt in parts, and crowds go by their counts."""
    monkeypatch.setattr(N, "DEALT_CROWD", crowd)
    monkeypatch.setattr(N, "CELL_POINTS", 7)
    monkeypatch.setattr(N, "enough", lambda k: 20)
    rows, xy = scattered(17, 200)
    hits = nearest(points(spark, xy), places(spark, rows), 4, 60.0, [], group="place")
    assert "_salt" in hits._jdf.queryExecution().optimizedPlan().toString()
    assert found(hits) == brute(xy, rows, 4, 60.0, ["city", "town"])


def test_pairs_are_measured_once_and_cut_before_they_move(spark, shuffled):
    """One distance a pair, and between the join and the next exchange the rows of a point are cut to k."""
    rows, xy = scattered(19, 50)
    hits = nearest(points(spark, xy), places(spark, rows), 4, 60.0, [], group="place")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    above = plan[:plan.index("SortMergeJoin")]
    assert above.count("Exchange") == 1 and "WindowGroupLimit" in above[above.index("Exchange"):]


@pytest.fixture
def arrays(monkeypatch, shuffled):
    """Every table of places is large, and points come to a task in few and small slices."""
    for name, value in (("ARRAY_ROWS", 0), ("ARRAY_POINTS", 7), ("ARRAY_SLICE", 5), ("ARRAY_PRODUCTS", 300)):
        monkeypatch.setattr(N, name, value)


@pytest.mark.parametrize("places_a_cell", [0, 1 << 19])
def test_places_ranked_in_arrays_match_brute_force(spark, arrays, monkeypatch, places_a_cell):
    """Cells as fine as the radius asks and coarser ones; no pair leaves the task that made it but the nearest, with their ranks."""
    monkeypatch.setattr(N, "ARRAY_PLACES", places_a_cell)
    rows, xy = scattered(23, 150)
    hits = nearest(points(spark, xy), places(spark, rows), 25, 30.0, ["place_lon"], group="place", values=["city", "town"])
    assert found(hits) == brute(xy, rows, 25, 30.0, ["city", "town"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Window" not in plan[:plan.index("MapInArrow")]


def test_arrays_at_the_date_line_and_with_null_groups(spark, arrays, monkeypatch):
    test_date_line_and_poles(spark)
    test_groups_are_ranked_alike_whatever_the_size(spark, monkeypatch, True, 0)
