"""Points arrive continuously, answers leave as JSON lines."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.containment import match_index
from ..operators.layer_index import LayerIndex
from ..sources.sinks import answer_lines
from .batches import complete_batches

# Ids that one line of a stream lists, about.
IDS_A_LINE = 65_536


def enrich_stream(points: DataFrame, index: LayerIndex) -> DataFrame:
    """Stream-static containment join: no state, no watermark needed."""
    return match_index(points, index)


def answer_stream(points: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  once: bool = False):
    """Runs a batch plan on every micro-batch and appends its answers as JSON lines.

    Each batch writes its own folder, so a batch that is run again after a
    lost executor replaces its output instead of repeating it. With `once`,
    what has arrived is answered and the stream stops. Lines are packed (gzip).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        answer_lines(answer(batch)).write.mode("overwrite").text(f"{path}/batch={batch_id}", compression="gzip")

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def reloading(load: Callable[[int], object], version: Callable[[], int],
              answer: Callable[[DataFrame, object], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A batch plan whose static side follows the catalog version.

    `version()` is asked once per micro-batch; `load(version)` runs again only
    when it moved, so sources appear and vanish without a restart.
    """
    held: dict[str, object] = {}

    def run(batch: DataFrame) -> DataFrame:
        current = version()
        if held.get("version") != current:
            held["version"], held["catalog"] = current, load(current)
        return answer(batch, held["catalog"])

    return run


def listed_hits(hits: DataFrame, features: int, point: str = "point_id", fid: str = "fid") -> DataFrame:
    """(point, fids): the ids of a point's hits as lists, of which none holds much more than `IDS_A_LINE` of the layer's `features`."""
    part = F.pmod(F.xxhash64(fid), F.lit(max(1, -(-features // IDS_A_LINE))))
    return hits.groupBy(point, part.alias("_part")).agg(F.collect_list(fid).alias("fids")).drop("_part")


def pinned_version(spark: SparkSession, pins: str, batch_id: int, version: Callable[[], int]) -> int:
    """The catalog version of a micro-batch: what its first run was given, also when it runs again."""
    if batch_id not in complete_batches(spark, pins):
        spark.createDataFrame([(version(),)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{pins}/batch={batch_id}")
    return spark.read.schema("version bigint").parquet(f"{pins}/batch={batch_id}").first()["version"]


def snapshot_answers(inputs: DataFrame, load: Callable[[int], object], version: Callable[[], int],
                     answer: Callable[[DataFrame, object], DataFrame], path: str, checkpoint: str, once: bool = False):
    """Whole answers of a stream of inputs, each micro-batch on one catalog version.

    `answer(batch, catalog)` is a batch plan, such as `answer_batch`; `load(version)`
    gives the catalog and runs again only when the version moved. A batch names its
    version under `pins` before it answers and writes its lines under
    `answers/batch=<id>`. So a batch that is run again, after a lost executor
    or a restart, asks the same catalog and replaces its own lines, also where the
    catalog moved on in between.
    """
    held: dict[str, object] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        pinned = pinned_version(batch.sparkSession, f"{path}/pins", batch_id, version)
        if held.get("version") != pinned:
            held["version"], held["catalog"] = pinned, load(pinned)
        answer_lines(answer(batch, held["catalog"])).write.mode("overwrite").text(f"{path}/answers/batch={batch_id}", compression="gzip")

    writer = inputs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
