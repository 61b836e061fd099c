import datetime as dt

from terralocus.streaming.batches import complete_batches
from terralocus.streaming.spans import FACTS, compact_spans, follow_spans, open_spans, span_facts

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def begun(span, minutes):
    return ("t", span, f"GET /{span}", at(minutes), None)


def ended(span, minutes):
    return ("t", span, None, None, at(minutes))


def test_open_spans_after_every_batch_with_a_restart(spark, tmp_path):
    """Starts and ends in any order, a span told in one row, null ids, a repeated row and an empty batch."""
    arrivals = [
        [begun("a", 0), begun("b", 1), ended("c", 2), ("t", "d", "d", at(0), at(3))],
        [ended("a", 4), begun("c", 1), ("t", None, "none", at(5), None), begun("b", 1)],
        [],
        [begun("e", 6), ended("e", 7), ("u", "b", "other", at(8), None)],
        [ended("b", 9), ended("late", 9)],
        [begun("late", 8), ("t", None, None, None, at(9))],
    ]
    source, root = str(tmp_path / "spans"), str(tmp_path / "log")
    seen = []
    for n, rows in enumerate(arrivals):
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(source)
        seen += rows
        if n == 3:
            continue  # two files are waiting when the stream comes back
        stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(source)
        follow_spans(stream, root, str(tmp_path / "state"), compact_every=2, once=True).awaitTermination()
        known = {}
        for trace, span, name, start, end in seen:
            old = known.get((trace, span), (None, None, None))
            known[trace, span] = tuple(y if x is None else x for x, y in zip((name, start, end), old))
        want = {(*k, name, start) for k, (name, start, end) in known.items() if start and not end}
        got = [(r.trace_id, r.span_id, r.name, r.start) for r in open_spans(spark, root).collect()]
        assert len(got) == len(set(got)) and set(got) == want, n
    assert complete_batches(spark, f"{root}/snapshots", "version")


def test_a_snapshot_keeps_open_spans_and_young_ends(spark, tmp_path):
    root = str(tmp_path / "log")
    assert open_spans(spark, root).count() == 0
    rows = [begun("open", 0), begun("done", 0), ended("done", 1), ended("old", 5), ended("young", 50), begun("new", 70)]
    spark.createDataFrame(rows, FACTS).write.parquet(f"{root}/deltas/batch=0")
    compact_spans(spark, root, 1, "30 minutes")
    assert sorted(r.span_id for r in span_facts(spark, root).collect()) == ["new", "open", "young"]
    spark.createDataFrame([begun("young", 49), ended("open", 71)], FACTS).write.parquet(f"{root}/deltas/batch=1")
    assert [r.span_id for r in open_spans(spark, root).collect()] == ["new"]
    assert sorted(r.span_id for r in open_spans(spark, root, 1).collect()) == ["new", "open"]
