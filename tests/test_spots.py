from pyspark.sql import functions as F

from checks.inputs import catalog
from checks.views import view
from terralocus.functions import geometry
from terralocus.operators import layer_index as LI
from terralocus.operators.containment import polygons_at
from terralocus.operators.spots import at_spots
from terralocus.plans import query as Q

SF = "/root/testdata/sf0.001"


def crowd(spark, at_one=300):
    """Many points at one spot, one elsewhere, some without coordinates or with an odd one."""
    rows = [(i, 1.0, 2.0) for i in range(at_one)] + [(1000, 5.0, 5.0), (1001, None, 2.0), (1002, None, 2.0), (1003, float("nan"), 2.0), (1004, 9.0, 9.0), (1005, 0.0, 0.0), (1006, -0.0, 0.0)]
    return spark.createDataFrame(rows, "point_id bigint, lon double, lat double").withColumn("tag", F.concat(F.lit("t"), F.col("point_id")))


def boxes(spark):
    rows = [(1, 0.0, 0.0, 4.0, 4.0), (2, 0.5, 1.0, 6.0, 6.0), (3, -1.0, -1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "fid bigint, xmin double, ymin double, xmax double, ymax double")
    return df.select("fid", geometry.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("rings"))


def test_points_at_a_spot_are_asked_for_once(spark):
    """Every point keeps its own columns and gets all hits, but the join sees one point per spot."""
    asked = []

    def hits(points):
        asked.extend(points.collect())
        return polygons_at(points, boxes(spark), ["fid"])

    pts = crowd(spark)
    got = sorted((r.point_id, r.tag, r.fid) for r in at_spots(pts, hits).collect())
    plain = sorted((r.point_id, r.tag, r.fid) for r in polygons_at(pts, boxes(spark), ["fid"]).collect())
    assert got == plain and len(got) == 300 * 3 + 1 + 2 * 2
    assert len(asked) == 6  # of 307 points


def test_points_without_an_answer_stay_where_asked(spark):
    out = at_spots(crowd(spark), lambda p: polygons_at(p, boxes(spark), ["fid"]), how="left")
    assert {r.point_id for r in out.filter("fid IS NULL").collect()} == {1001, 1002, 1003, 1004}


def test_whole_answers_of_a_crowd(spark, monkeypatch):
    """Answers of points repeated under other ids are those of the points; the layers meet each spot once."""
    inputs = view(spark, SF, "inputs").filter("idx < 40")
    more = inputs.unionByName(inputs.withColumn("idx", F.col("idx") + 100_000)).unionByName(inputs.withColumn("idx", F.col("idx") + 200_000))
    met, plain = [], Q.hits_and_errors
    monkeypatch.setattr(Q, "hits_and_errors", lambda points, *a, **k: (met.append(points.count()), plain(points, *a, **k))[1])
    places = catalog(spark, SF, with_raster=False)
    shown = lambda df: {r.point_id: (r.results, r.total_features, r.layer_errors, r.wgs84, r.error, r.invalid) for r in df.collect()}
    one, three = shown(Q.answer_batch(inputs, places, srids=(4326, 3857))), shown(Q.answer_batch(more, places, srids=(4326, 3857)))
    assert len(three) == 3 * len(one) == 120 and all(three[k] == one[k % 100_000] for k in three)
    assert met[0] == met[1] <= 40


def test_features_of_one_shape_are_met_once(spark):
    """Of copies of a shape only those stay that an answer can name, and answers are those of all features."""
    from terralocus.operators import hits as H
    from terralocus.operators import landmarks as L

    rows = [(100 * n + fid, f"n{fid % 3 if n % 2 else fid}", "range" if n % 3 else "mountain", None if n % 5 == 0 else float(n % 7)) + box
            for n in range(40) for fid, *box in [(1, 0.0, 0.0, 4.0, 4.0), (2, 0.5, 1.0, 6.0, 6.0), (3, -1.0, -1.0, 1.0, 2.0)] for box in [tuple(box)]]
    df = spark.createDataFrame(rows, "fid bigint, name string, landform string, area_km2 double, xmin double, ymin double, xmax double, ymax double")
    shapes = df.select("fid", "name", "landform", "area_km2", F.lit("").alias("name_native"), F.lit("s").alias("name_source"), F.lit(1.0).alias("ele"),
                       geometry.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("rings"))
    pts = crowd(spark, 3)
    carry = ["fid", "name", "name_native", "name_source", "landform", "ele", "area_km2"]
    at = lambda features: polygons_at(pts, features, carry).withColumns({"source_id": F.lit("x"), "layer_ord": F.lit(0)})
    shown = lambda out: sorted(map(str, out.collect()))
    for few, answer in ((L.first_islands(shapes), L.islands), (L.first_mountains(shapes), L.mountains),
                        (H.first_of_shape(shapes, ["rings"], ["fid"], 2), lambda hits: H.cap_hits(hits, max_features=2))):
        assert few.count() <= 9 < shapes.count() and shown(answer(at(few))) == shown(answer(at(shapes)))


def test_points_of_a_spot_share_a_row(spark, monkeypatch):
    """Spot rows hold the pairs of `at_spots`; a full spot is cut into rows, and points without an answer stay where asked."""
    from terralocus.operators import spots as P

    pts, hits = crowd(spark), lambda p: polygons_at(p, boxes(spark), ["fid"]).groupBy("point_id").agg(F.collect_list("fid").alias("fids"))
    rows = P.spot_rows(pts, hits, how="left").collect()
    assert len(rows) == 6 and sum(len(r.points) for r in rows) == 307
    monkeypatch.setattr(P, "POINTS_A_ROW", 100)
    cut = P.spot_rows(pts, hits).collect()
    assert len(cut) == 5 and max(len(r.points) for r in cut) < 200
    got = sorted((p.point_id, p.tag, fid) for r in cut for p in r.points for fid in r.fids)
    assert got == sorted((r.point_id, r.tag, r.fid) for r in at_spots(pts, lambda p: polygons_at(p, boxes(spark), ["fid"])).collect())


def test_streams_write_a_line_for_a_spot(spark, tmp_path, monkeypatch):
    """Points repeated under other ids add no lines to a stream's answers, and the rows read back are those of all points."""
    from checks import sources_suite

    few = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 50")
    wide = spark.createDataFrame([(1, -10.0, 35.0, 30.0, 65.0), (2, 0.0, 40.0, 20.0, 60.0)], "fid bigint, xmin double, ymin double, xmax double, ymax double")
    wide = wide.select("fid", geometry.rectangle(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("rings"))
    monkeypatch.setattr(sources_suite, "saved_index", lambda *a: LI.build_by_shape(wide, ["fid"], ["rings"], LI.index_rows))
    written, plain = [], sources_suite.answer_stream
    monkeypatch.setattr(sources_suite, "answer_stream", lambda stream, answer, path, *a, **k: (written.append(path), plain(stream, answer, path, *a, **k))[1])
    lines = []
    for copies in (1, 4):
        # coordinates repeat every 122,880 ids, of one parity
        folder = str(tmp_path / f"copies{copies}")
        more = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("event_id", F.col("event_id") + 122_880 * F.col("copy")).drop("copy")
        more.coalesce(1).write.parquet(f"{folder}/events.parquet")
        got = sources_suite.hot_reload(spark, folder).collect()
        want = polygons_at(view(spark, folder, "pts"), wide, ["fid"]).selectExpr("point_id", "fid", "1 + point_id % 2").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        lines.append(spark.read.text(f"{written[-1]}/batch=*").count())
    assert lines == [50, 50]


def test_an_answer_without_a_cap_has_all_hits(spark):
    """The statements of the checks name all hits, so more than the usual cap come at size."""
    from terralocus.operators import hits as H

    hits = spark.range(1200).selectExpr("1 AS point_id", "'lands' AS source_id", "0 AS layer_ord", "id AS fid")
    assert H.cap_hits(hits).count() == 1000 and H.cap_hits(hits, max_features=None).count() == 1200
