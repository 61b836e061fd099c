"""Debounced file events as a stream, and the catalog as a log of what they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.attributes import is_source_file, source_id
from ..operators.file_events import QUIET_MS, final_operation, operation
from .batches import complete_batches

CHANGES = "source_id string, op string, path string, end_ms bigint"
# Micro-batches between two snapshots of the catalog.
COMPACT_EVERY = 20


def debounce_stream(events: DataFrame, watermark: str = "10 seconds", quiet_ms: int = QUIET_MS) -> DataFrame:
    """(path, op, start, end, events) once a path has been quiet.

    `events(path, ts, op, seq)`. A session window per path with mergeable
    facts as its aggregates, so sessions keep three values, not their events.
    Rows may come late by up to the watermark and still join their burst; later
    ones are dropped. The state outlives a restart from the checkpoint. Events
    exactly the quiet time apart are two bursts, as in the batch form.
    """
    kind = operation(F.col("op"))
    at = F.struct(F.col("ts").alias("t"), F.col("seq").alias("s"))
    sessions = (
        events.filter(is_source_file(F.col("path"))).withWatermark("ts", watermark)
        # sessions that touch become one, so they end just before the quiet time is over
        .groupBy("path", F.session_window("ts", f"{quiet_ms * 1000 - 1} microseconds").alias("w"))
        .agg(F.min_by(kind, at).alias("_first"), F.max(F.when(kind == "delete", at)).alias("_del"),
             F.max(F.when(kind == "create", at)).alias("_new"), F.count(F.lit(1)).alias("events"))
    )
    return sessions.select("path", final_operation(F.col("_first"), F.col("_del"), F.col("_new")).alias("op"),
                           F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "events")


def initial_catalog(sources: DataFrame, root: str) -> None:
    """The catalog that the stream starts from: (path) of the sources known."""
    known = sources.select(source_id(F.col("path")).alias("source_id"), F.lit("create").alias("op"), "path", F.lit(None).cast("bigint").alias("end_ms"))
    known.write.mode("overwrite").parquet(f"{root}/snapshots/version=0")


def _last_changes(changes: DataFrame) -> DataFrame:
    """Per id the last change; the catalog's own rows, without time, come before all."""
    at = F.struct(F.coalesce("end_ms", F.lit(-1 << 62)).alias("t"), "path")
    return changes.groupBy("source_id").agg(F.max_by(F.struct("op", "path", "end_ms"), at).alias("_last")).select("source_id", "_last.*")


def catalog_changes(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """(source_id, op, path, end_ms): the last change of every id, from the newest snapshot and the deltas after it.

    Version n of a snapshot holds all batches below n. With `upto`, only
    batches below it count.
    """
    versions = [v for v in complete_batches(spark, f"{root}/snapshots", "version") if upto is None or v <= upto]
    start = versions[-1] if versions else 0
    paths = [f"{root}/snapshots/version={start}"] if versions else []
    paths += [f"{root}/deltas/batch={b}" for b in complete_batches(spark, f"{root}/deltas") if b >= start and (upto is None or b < upto)]
    if not paths:
        return spark.createDataFrame([], CHANGES)
    return _last_changes(spark.read.schema(CHANGES).parquet(*paths))


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(source_id, path) as of the last finished batch, merged on reading."""
    return catalog_changes(spark, root).filter("op <> 'delete'").select("source_id", "path")


def compact_catalog(spark: SparkSession, root: str, version: int) -> None:
    """Writes the snapshot of all batches below `version`; deletes stay in it, so that older changes cannot return."""
    catalog_changes(spark, root, version).write.mode("overwrite").parquet(f"{root}/snapshots/version={version}")


def follow_catalog(bursts: DataFrame, root: str, checkpoint: str, compact_every: int = COMPACT_EVERY, once: bool = False):
    """Appends debounced events to the catalog log under `root`.

    A micro-batch writes its own changes only, one row per id, and now and then
    a snapshot; the catalog is never rewritten for a batch. Running a batch
    again replaces its own folder.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = batch.select(source_id(F.col("path")).alias("source_id"), "op", "path", F.unix_millis("end").alias("end_ms"))
        _last_changes(changes).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_catalog(spark, root, batch_id + 1)

    writer = bursts.writeStream.foreachBatch(apply).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
