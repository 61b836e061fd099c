"""Spans that are still open, kept up to date by a stream of starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import complete_batches

SPAN = ["trace_id", "span_id"]
FACTS = "trace_id string, span_id string, name string, start timestamp_ntz, end timestamp_ntz"
# Micro-batches between two snapshots, and how long an end waits for a start that arrives after it.
COMPACT_EVERY, LONE_END = 20, "1 hour"


def _merged(rows: DataFrame) -> DataFrame:
    """One row per span: what any of its rows tells."""
    return rows.groupBy(*SPAN).agg(*[F.max(c).alias(c) for c in ("name", "start", "end")])


def span_facts(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """All that is known of spans that have not both begun and ended before the newest snapshot.

    Version n of a snapshot holds all batches below n. With `upto`, only batches below it count.
    """
    versions = [v for v in complete_batches(spark, f"{root}/snapshots", "version") if upto is None or v <= upto]
    first = versions[-1] if versions else 0
    paths = [f"{root}/snapshots/version={first}"] if versions else []
    paths += [f"{root}/deltas/batch={b}" for b in complete_batches(spark, f"{root}/deltas") if b >= first and (upto is None or b < upto)]
    return _merged(spark.read.schema(FACTS).parquet(*paths)) if paths else spark.createDataFrame([], FACTS)


def open_spans(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(trace_id, span_id, name, start, end) of the spans that have begun and not ended, `end` being null, as of the last
    finished batch; `operators.telemetry.active_spans` gives their age."""
    return span_facts(spark, root, upto).filter(F.col("start").isNotNull() & F.col("end").isNull())


def compact_spans(spark: SparkSession, root: str, version: int, lone_end: str = LONE_END) -> None:
    """Writes what batches below `version` leave to know: open spans, and ends of the last `lone_end` without a start.

    Spans that have ended leave the log here, so it grows with the open ones. A
    start that comes more than `lone_end` after its end counts as open.
    """
    facts = span_facts(spark, root, version)
    newest = facts.agg(F.max(F.greatest("start", "end")).alias("newest"))  # one row
    waits = F.col("start").isNull() & (F.col("end") >= F.col("newest") - F.expr(f"interval {lone_end}"))
    kept = facts.join(F.broadcast(newest)).filter(F.col("end").isNull() | waits).drop("newest")
    kept.write.mode("overwrite").parquet(f"{root}/snapshots/version={version}")


def follow_spans(rows: DataFrame, root: str, checkpoint: str, compact_every: int = COMPACT_EVERY, lone_end: str = LONE_END, once: bool = False):
    """Keeps the log of open spans under `root` from a stream of rows (trace_id, span_id, name, start, end).

    A row tells the start, the end or both of a span, in any order; what it does not
    tell is null. A micro-batch writes its own folder, one row per span, so a
    batch that is run again replaces its own rows. Between two snapshots a row may be repeated.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        _merged(batch).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_spans(batch.sparkSession, root, batch_id + 1, lone_end)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
