import numpy as np
import pytest
from pyspark.sql import functions as F

from terralocus.functions import geometry
from terralocus.operators import hits as H
from terralocus.operators.containment import boxes_at, match_index, polygons_at
from terralocus.operators.layer_index import box_index_rows, build_by_shape, build_index, index_rows, load_index, save_index

RINGS = "array<array<struct<x:double,y:double>>>"


def table(spark, polygons):
    rows = [(fid, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for fid, rings in polygons]
    return spark.createDataFrame(rows, f"fid bigint, rings {RINGS}")


def points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id bigint, lon double, lat double")


def brute(xy, rings):
    """Even-odd containment with the boundary, point by point on the driver."""
    x, y = np.asarray(xy, dtype=float).T
    odd, on = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            c = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
            on |= (c == 0) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
            odd ^= ((ay <= y) != (by <= y)) & ((c > 0) == (by > ay))
    return odd | on


REGIONS = [(1, "west", 100, 0, 4), (2, "east", 200, 6, 10), (3, "tiled", 300, 12, 13), (4, "tiled", 300, 13, 14),
           (5, "borderA", 400, 16, 17), (6, "borderB", 500, 17, 18)]


def regions(spark):
    df = spark.createDataFrame([(f, n, p, float(a), float(b)) for f, n, p, a, b in REGIONS], "fid bigint, name string, pop int, x0 double, x1 double")
    return df.withColumn("rings", geometry.rectangle(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(4.0)))


def test_regions(spark):
    pts = points(spark, [(2, 2), (8, 2), (5, 2), (20, 20), (0, 2), (13, 2), (17, 2)])
    hits = polygons_at(pts, regions(spark), ["fid", "name", "pop"]).drop("lon", "lat")
    kept = H.merge_fragments(hits, ["point_id"], ["name", "pop"])
    got = sorted((r["point_id"], r["name"], r["fid"]) for r in kept.collect())
    assert got == [(0, "west", 1), (1, "east", 2), (4, "west", 1), (5, "tiled", 3), (6, "borderA", 5), (6, "borderB", 6)]


def star(cx, cy, r, n, rng):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    radius = r * rng.uniform(0.3, 1, n)
    ring = [(round(cx + a * np.cos(t), 3), round(cy + a * np.sin(t), 3)) for a, t in zip(radius, angle)]
    return [*ring, ring[0]]


def mixed_polygons(seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for fid in range(1, 41):
        size = float(rng.choice([0.05, 0.5, 3, 20]))
        cx, cy = rng.uniform(-30, 30, 2)
        rings = [star(cx, cy, size, int(rng.integers(3, 400)), rng)]
        if fid % 3 == 0:
            rings.append(star(cx, cy, size * 0.2, 12, rng))
        if fid % 5 == 0:
            rings.append(star(cx + 3 * size, cy, size, 30, rng))
        out.append((fid, rings))
    vertices = [v for _, rings in out for ring in rings for v in ring]
    xy = [*rng.uniform(-40, 40, (1500, 2)), *[vertices[i] for i in rng.integers(0, len(vertices), 300)]]
    xy += [(rings[0][0][0], rings[0][0][1]) for _, rings in out]
    return out, [(float(x), float(y)) for x, y in xy]


def expected_pairs(polygons, xy):
    return {(i, fid) for fid, rings in polygons for i in np.flatnonzero(brute(xy, rings))}


def test_polygons_match_brute_force(spark):
    polygons, xy = mixed_polygons()
    hits = polygons_at(points(spark, xy), table(spark, polygons), ["fid"]).select("point_id", "fid").collect()
    assert len(hits) == len(set(hits))  # each pair once, slabs and cells notwithstanding
    assert {tuple(h) for h in hits} == expected_pairs(polygons, xy)


def test_shuffled_and_salted_join_gives_the_same(spark, shuffled):
    polygons, xy = mixed_polygons(7)
    xy = xy + [(0.1, 0.1)] * 800  # one cell with a third of all points
    index = build_index(table(spark, polygons), ["fid"])
    assert not index.size.fits_broadcast
    hits = match_index(points(spark, xy), index).select("point_id", "fid").collect()
    assert len(hits) == len(set(hits))
    assert {tuple(h) for h in hits} == expected_pairs(polygons, xy)


def test_saved_index_gives_the_same(spark, tmp_path):
    polygons, xy = mixed_polygons(9)
    index = build_index(table(spark, polygons), ["fid"])
    save_index(index.rows, str(tmp_path / "index"), ["fid"])
    loaded = load_index(spark, str(tmp_path / "index"), ["fid"])
    assert loaded.rungs == index.rungs and loaded.size == index.size
    hits = match_index(points(spark, xy), loaded).select("point_id", "fid").collect()
    assert {tuple(h) for h in hits} == expected_pairs(polygons, xy)


def test_unit_grid(spark):
    cells = [(40 * i + j, [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]]) for i in range(40) for j in range(40)]
    rng = np.random.default_rng(1)
    xy = [(float(x), float(y)) for x, y in rng.uniform(0, 40, (1000, 2))] + [(5.0, 5.0), (7.5, 9.0), (0.0, 0.0)]
    index = build_index(table(spark, cells), ["fid"])
    assert index.boxes_only
    hits = {tuple(h) for h in match_index(points(spark, xy), index).select("point_id", "fid").collect()}
    assert hits == expected_pairs(cells, xy)
    assert sum(1 for p, _ in hits if p == 1000) == 4 and sum(1 for p, _ in hits if p == 1002) == 1


def test_empty_layer_and_missing_coordinates(spark):
    empty = table(spark, [(1, [[(0, 0), (1, 0), (1, 1), (0, 0)]])]).filter("fid > 1")
    assert polygons_at(points(spark, [(0, 0)]), empty, ["fid"]).count() == 0
    pts = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.5, 0.25)], "point_id bigint, lon double, lat double")
    layer = table(spark, [(1, [[(0, 0), (1, 0), (1, 1), (0, 0)]]), (2, [])])
    assert [r["point_id"] for r in polygons_at(pts, layer, ["fid"]).collect()] == [3]


def test_boxes(spark):
    layer = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5.0), (2, 1.0, 1.0, 30.0, 2.0), (3, None, None, None, None)],
                                  "fid bigint, xmin double, ymin double, xmax double, ymax double")
    got = sorted(tuple(r) for r in boxes_at(points(spark, [(0, 5), (1, 1), (31, 1)]), layer, ["fid"]).select("point_id", "fid").collect())
    assert got == [(0, 1), (1, 2)]


def test_fragments_keep_smallest_id_or_text(spark):
    rows = [(1, 7, "a", None, "W2"), (1, 3, "a", None, "W9"), (1, 9, "a", None, "W1"), (1, 4, "b", None, "W1"),
            (2, 0, "c", 1, "Z"), (2, 0, "c", 1, "A"), (3, 0, "d", 1, "A"), (3, 5, "d", 1, "Z")]
    df = spark.createDataFrame(rows, "point_id bigint, fid bigint, name string, n int, wkt string")
    got = sorted((r["point_id"], r["name"], r["fid"], r["wkt"]) for r in H.merge_fragments(df, ["point_id"], ["name", "n"], wkt="wkt").collect())
    assert got == [(1, "a", 3, "W9"), (1, "b", 4, "W1"), (2, "c", 0, "A"), (3, "d", 5, "Z")]


@pytest.mark.parametrize("cap", [1, 3])
def test_cap_in_catalog_order(spark, cap):
    df = spark.createDataFrame([(1, "s", o, f) for o in (1, 0) for f in (3, 1, 2)], "point_id bigint, source_id string, layer_ord int, fid bigint")
    got = sorted((r["layer_ord"], r["fid"]) for r in H.cap_hits(df, max_features=cap).collect())
    assert got == [(0, 1), (0, 2), (0, 3)][:cap]


def plain_pieces(ring, lo, hi, xy):
    """What the pieces of a band say about each point: inside, or None where none holds it."""
    from terralocus.functions.covers import pieces

    a, b = np.array(ring[:-1], float), np.array(ring[1:], float)
    reach = (np.maximum(a[:, 1], b[:, 1]) >= lo) & (np.minimum(a[:, 1], b[:, 1]) <= hi)
    a, b = a[reach], b[reach]
    found = list(pieces(a[:, 0], a[:, 1], b[:, 0], b[:, 1], lo, hi))
    out = []
    for x, y in xy:
        holds = [p for p in found if (p[0] < x < p[1] if p[2] else p[0] <= x <= p[1])]
        assert len(holds) <= 1
        if not holds:
            out.append(False)
        elif holds[0][2]:
            out.append(True)
        else:
            rows = holds[0][4]
            c = (b[rows, 0] - a[rows, 0]) * (y - a[rows, 1]) - (x - a[rows, 0]) * (b[rows, 1] - a[rows, 1])
            on = (c == 0) & (np.minimum(a[rows, 0], b[rows, 0]) <= x) & (x <= np.maximum(a[rows, 0], b[rows, 0])) & (
                np.minimum(a[rows, 1], b[rows, 1]) <= y) & (y <= np.maximum(a[rows, 1], b[rows, 1]))
            odd = ((a[rows, 1] <= y) != (b[rows, 1] <= y)) & ((c > 0) == (b[rows, 1] > a[rows, 1]))
            out.append(bool(on.any()) or (int(odd.sum()) + holds[0][3]) % 2 == 1)
    return out


def test_pieces_of_a_band_agree_with_the_whole_ring():
    rng = np.random.default_rng(11)
    for n in range(60):
        # whole numbers: vertices on band limits, flat edges, edges that touch
        ring = [tuple(map(int, p)) for p in rng.integers(0, 9, (int(rng.integers(3, 30)), 2))]
        ring.append(ring[0])
        lo = int(rng.integers(0, 8))
        hi = lo + int(rng.integers(1, 3))
        xy = [(x / 2, y) for x in range(-1, 19) for y in (lo, lo + 0.25, (lo + hi) / 2, hi - 1e-9)]
        assert plain_pieces(ring, lo, hi, xy) == brute(xy, [ring]).tolist(), (ring, lo, hi)


def long_outline(n=50_000):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = 10 + np.sin(40 * t) + 0.01 * np.sin(4000 * t)
    ring = [(float(a), float(b)) for a, b in zip(r * np.cos(t), r * np.sin(t))]
    return [*ring, ring[0]]


def test_full_cover_of_a_long_outline_and_a_diamond(spark):
    ring = long_outline()
    diamonds = [(k, [[(k - 1, 3), (k, 2), (k + 1, 3), (k, 4), (k - 1, 3)]]) for k in range(2, 6)]
    rng = np.random.default_rng(4)
    xy = [(float(x), float(y)) for x, y in rng.uniform(-12, 12, (1500, 2))] + [ring[i] for i in range(0, 50_000, 997)] + [(2.0, 2.0), (2.5, 3.0), (1.0, 3.0)]
    polygons = [(1, [ring]), *diamonds]
    index = build_index(table(spark, polygons), ["fid"])
    rows = index.rows.cache()
    assert rows.filter("full_cover != (segments is null)").count() == 0
    assert rows.agg(F.max(F.size("segments"))).first()[0] <= 64
    pts = points(spark, xy)
    hits = match_index(pts, index).select("point_id", "fid").collect()
    assert len(hits) == len(set(hits)) and {tuple(h) for h in hits} == expected_pairs(polygons, xy)
    # nearly all of the outline's own hits need no segment
    inside = match_index(pts, build_index(table(spark, polygons[:1]), ["fid"])).count()
    sure = rows.filter("full_cover and fid = 1").select("xmin", "xmax", "slab_lo", "slab_hi").distinct()
    by_box = pts.join(sure, (F.col("lon") > F.col("xmin")) & (F.col("lon") < F.col("xmax")) & (F.col("lat") >= F.col("slab_lo")) & (F.col("lat") < F.col("slab_hi")))
    assert by_box.count() > 0.9 * inside
    plan = match_index(pts, index)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.split("InMemoryRelation")[0]


def test_features_of_one_shape_share_their_rows(spark, shuffled):
    """Copies of a shape add no index rows, and each is a hit of its own; features without a shape are none."""
    one, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    layer = table(spark, [(i, [one, hole]) for i in range(300)] + [(i, [one]) for i in range(300, 302)]).unionByName(
        spark.createDataFrame([(999, None)], f"fid bigint, rings {RINGS}"))
    index = build_by_shape(layer, ["fid"], ["rings"], index_rows)
    alone = build_index(table(spark, [(0, [one, hole]), (1, [one])]), ["fid"])
    assert index.size.rows == alone.size.rows
    hits = match_index(points(spark, [(2, 2), (0.5, 0.5), (9, 9)]), index)
    assert hits.columns == ["point_id", "lon", "lat", "fid"]
    assert sorted(map(tuple, hits.select("point_id", "fid").collect())) == [(0, 300), (0, 301)] + [(1, i) for i in range(302)]


def test_boxes_of_one_shape(spark):
    rows = [(i, f"r{i}", 0.0, 0.0, 2.0, 1.0) for i in range(50)] + [(60, "x", None, 0.0, 1.0, 1.0), (61, "y", 0.0, 0.0, None, 1.0)]
    layer = spark.createDataFrame(rows, "fid bigint, name string, xmin double, ymin double, xmax double, ymax double")
    assert build_by_shape(layer, ["fid"], ["xmin", "ymin", "xmax", "ymax"], box_index_rows).members.count() == 50
    hits = boxes_at(points(spark, [(1, 1), (3, 0)]), layer, ["fid", "name", "xmin"])
    assert sorted(map(tuple, hits.select("point_id", "fid", "name", "xmin").collect())) == [(0, i, f"r{i}", 0.0) for i in range(50)]
