import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from terralocus.streaming.batches import complete_batches
from terralocus.streaming.enrich import answer_stream, reloading, snapshot_answers
from terralocus.streaming.file_events import compact_catalog, debounce_stream, follow_catalog, initial_catalog, read_catalog

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def test_debounced_stream_updates_the_catalog(spark, tmp_path):
    schema = "path string, ts timestamp, op string, seq bigint"
    source, root = str(tmp_path / "events"), str(tmp_path / "catalog")
    rows = [("d/a.gpkg", at(0), "create", 1), ("d/a.gpkg", at(300), "write", 2), ("d/b.gpkg", at(100), "create", 3), ("d/b.gpkg", at(200), "remove", 4),
            ("d/a.gpkg", at(2000), "remove", 5), ("d/a.gpkg", at(2200), "create", 6), ("d/end.gpkg", at(60000), "create", 7)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = debounce_stream(stream, "1 second").writeStream.format("memory").queryName("bursts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["path"], r["op"], r["events"]) for r in spark.table("bursts").collect())
    assert got == [("d/a.gpkg", "create", 2), ("d/a.gpkg", "create", 2), ("d/b.gpkg", "delete", 2)]

    initial_catalog(spark.createDataFrame([("old/b.gpkg",), ("old/z.zip",)], "path string"), root)
    query = follow_catalog(debounce_stream(stream, "1 second"), root, str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, read_catalog(spark, root).collect())) == [("a", "d/a.gpkg"), ("z", "old/z.zip")]


def test_late_rows_quiet_time_and_restart(spark, tmp_path):
    """Rows late by less than the watermark join their burst, later ones are dropped; state outlives the restart."""
    schema = "path string, ts timestamp, op string, seq bigint"
    source, out = str(tmp_path / "events"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        debounce_stream(stream, "5 seconds").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    arrive(("a.gpkg", at(0), "create", 1), ("b.gpkg", at(4000), "write", 2))
    arrive(("a.gpkg", at(400), "remove", 3), ("c.gpkg", at(20000), "create", 4))  # late, within the watermark; the session was kept
    arrive(("b.gpkg", at(100), "create", 5), ("c.gpkg", at(20500), "remove", 6))  # too late; and exactly the quiet time apart
    arrive(("end.gpkg", at(90000), "create", 7))
    got = sorted((r["path"], r["op"], r["events"]) for r in spark.read.parquet(out).collect())
    assert got == [("a.gpkg", "delete", 2), ("b.gpkg", "modify", 1), ("c.gpkg", "create", 1), ("c.gpkg", "delete", 1)]


def test_catalog_log_is_merged_compacted_and_repeatable(spark, tmp_path):
    root = str(tmp_path / "log")
    initial_catalog(spark.createDataFrame([("old/a.gpkg",), ("old/b.gpkg",)], "path string"), root)

    def delta(batch, *rows):
        spark.createDataFrame(list(rows), "source_id string, op string, path string, end_ms bigint").write.mode("overwrite").parquet(f"{root}/deltas/batch={batch}")

    now = lambda: sorted(map(tuple, read_catalog(spark, root).collect()))
    delta(0, ("a", "modify", "new/a.gpkg", 10), ("c", "create", "new/c.gpkg", 11))
    delta(1, ("b", "delete", "old/b.gpkg", 20))
    want = [("a", "new/a.gpkg"), ("c", "new/c.gpkg")]
    assert now() == want
    compact_catalog(spark, root, 2)
    assert now() == want and complete_batches(spark, f"{root}/snapshots", "version") == [0, 2]
    delta(2, ("c", "delete", "new/c.gpkg", 30), ("b", "create", "late/b.gpkg", 15))  # an older change of b does not return
    assert now() == [("a", "new/a.gpkg")]
    delta(2, ("c", "delete", "new/c.gpkg", 30))  # the batch again
    assert now() == [("a", "new/a.gpkg")]
    (tmp_path / "log" / "deltas" / "batch=3").mkdir()  # begun, not finished
    assert now() == [("a", "new/a.gpkg")]


def test_a_repeated_batch_asks_the_version_it_was_given(spark, tmp_path):
    """The first attempt fails after its version was noted and the catalog moves on before the restart."""
    source, out, current, broken = str(tmp_path / "in"), str(tmp_path / "out"), [1], [True]
    spark.range(4).coalesce(1).write.parquet(source)

    def answer(batch, version):
        if broken[0]:
            raise RuntimeError("lost")
        return batch.selectExpr("id", f"{version} AS version")

    def start():
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        return snapshot_answers(stream, lambda v: v, lambda: current[0], answer, out, str(tmp_path / "state"), once=True)

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    broken[0], current[0] = False, 2
    start().awaitTermination()
    spark.range(4, 6).coalesce(1).write.mode("append").parquet(source)
    start().awaitTermination()
    got = {(r["id"], r["version"]) for r in spark.read.json(f"{out}/answers/batch=*").select("id", "version").collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)}


def test_reload_follows_the_version(spark, tmp_path):
    loads, current = [], [1]

    def load(version):
        loads.append(version)
        return version

    run = reloading(load, lambda: current[0], lambda batch, v: batch.selectExpr("*", f"{v} AS version"))
    batch = spark.range(2)
    assert {r["version"] for r in run(batch).collect()} == {1}
    run(batch)
    current[0] = 2
    assert {r["version"] for r in run(batch).collect()} == {2}
    assert loads == [1, 2]


def test_answers_leave_as_lines(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    answer_stream(stream, lambda b: b.selectExpr("id", "id * 2 AS twice"), out, str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.json(f"{out}/batch=*").select("id", "twice").collect()) == [(i, 2 * i) for i in range(5)]
