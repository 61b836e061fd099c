"""File change events: debouncing and applying to the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attributes import is_source_file, source_id

# Quiet time, and how raw operations count.
QUIET_MS = 500
DELETES = ["remove", "rename", "delete"]
# Bursts are first found within buckets of this length.
BUCKET_MS = 3_600_000


def operation(raw: Column) -> Column:
    lowered = F.lower(raw)
    return F.when(lowered.isin(*DELETES), F.lit("delete")).when(lowered == "create", F.lit("create")).otherwise(F.lit("modify"))


def final_operation(first: Column, last_delete: Column, last_create: Column) -> Column:
    """The outcome of a burst from three facts that merge in any order.

    A delete beats all before it, a later create turns it into a create, and
    without a delete the first operation stands.
    """
    return (F.when(last_delete.isNull(), first)
            .when(last_create > last_delete, F.lit("create"))
            .otherwise(F.lit("delete")))


def _fold() -> list[Column]:
    return [
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min_by("first_op", "first_at").alias("first_op"), F.min("first_at").alias("first_at"),
        F.max("last_delete").alias("last_delete"), F.max("last_create").alias("last_create"),
        F.sum("events").alias("events"),
    ]


def _bursts(rows: DataFrame, keys: list[str], quiet_ms: int) -> DataFrame:
    """Numbers bursts within `keys` by gaps of at least the quiet time and folds each."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "first_at")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start_ms") - reach < quiet_ms, 0).otherwise(1)
    marked = rows.withColumn("_new", fresh).withColumn("_burst", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_burst").agg(*_fold())


def debounce(events: DataFrame, path: str = "path", t_ms: str = "t_ms", op: str = "op", seq: str = "seq",
             quiet_ms: int = QUIET_MS, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(path, op, start_ms, end_ms, emit_ms, events): one row per burst and path.

    Three exact steps, so that a path with most of the events is no hot spot:
    events in the same slot of one quiet time always belong together and are
    folded by a partially aggregated group; bursts are then found per (path,
    bucket of slots); only the first and last burst of a bucket can join a
    neighbour, and just those go into a per-path pass.
    """
    kind = operation(F.col(op))
    at = F.struct(F.col(t_ms).alias("t"), F.col(seq).alias("s"))
    rows = events.filter(is_source_file(F.col(path))).select(
        F.col(path).alias("path"), F.floor(F.col(t_ms) / quiet_ms).alias("_slot"),
        F.col(t_ms).alias("start_ms"), F.col(t_ms).alias("end_ms"), kind.alias("first_op"), at.alias("first_at"),
        F.when(kind == "delete", at).alias("last_delete"), F.when(kind == "create", at).alias("last_create"),
        F.lit(1).cast("bigint").alias("events"),
    )
    slots = max(1, bucket_ms // quiet_ms)
    folded = rows.groupBy("path", "_slot").agg(*_fold()).withColumn("_bucket", F.floor(F.col("_slot") / slots)).drop("_slot")
    local = _bursts(folded, ["path", "_bucket"], quiet_ms)
    low, high = F.col("_bucket") * (slots * quiet_ms), (F.col("_bucket") + 1) * (slots * quiet_ms)
    edge = (F.col("start_ms") < low + quiet_ms) | (F.col("end_ms") >= high - quiet_ms)
    local = local.withColumn("_edge", edge)
    inner = local.filter(~F.col("_edge")).drop("_edge", "_bucket", "_burst")
    outer = _bursts(local.filter("_edge").drop("_edge", "_bucket", "_burst"), ["path"], quiet_ms).drop("_burst")
    return inner.unionByName(outer).select(
        "path", final_operation(F.col("first_op"), F.col("last_delete"), F.col("last_create")).alias("op"),
        "start_ms", "end_ms", (F.col("end_ms") + quiet_ms).alias("emit_ms"), "events")


def apply_events(catalog: DataFrame, bursts: DataFrame) -> DataFrame:
    """Catalog (source_id, path) after the bursts: the last one per id decides.

    Create and modify put the path in; delete takes the id out.
    """
    at = F.struct("end_ms", "path")
    last = bursts.withColumn("source_id", source_id(F.col("path"))).groupBy("source_id").agg(
        F.max_by(F.struct("op", "path"), at).alias("_last")).select("source_id", "_last.*")
    untouched = catalog.join(last, "source_id", "left_anti").select("source_id", "path")
    return untouched.unionByName(last.filter(F.col("op") != "delete").select("source_id", "path"))
