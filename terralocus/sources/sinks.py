"""Answer and layer writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _with_objects(answers: DataFrame) -> DataFrame:
    """Feature properties as objects where answers hold them as JSON text."""
    if "results" not in answers.columns:
        return answers
    def opened(feature: Column) -> Column:
        return feature.withField("properties", F.parse_json(feature["properties"]))
    return answers.withColumn("results", F.transform("results", lambda r: r.withField("features", F.transform(r["features"], opened))))


def answer_lines(answers: DataFrame) -> DataFrame:
    """(value): one JSON object per answer."""
    return _with_objects(answers).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(answers: DataFrame, path: str) -> None:
    answer_lines(answers).write.mode("overwrite").text(path)


def stream_ndjson(answers: DataFrame, path: str, checkpoint: str):
    return (answer_lines(answers).writeStream.format("text").option("checkpointLocation", checkpoint)
            .outputMode("append").start(path))


def write_layer(layer: DataFrame, path: str, lon: Column, lat: Column, cell_deg: float = 10.0) -> None:
    """Parquet partitioned by a coarse grid cell, for pruning by place.

    Rows of a cell are brought together first, so that a cell has few files; the
    rebalancing splits a cell that is larger than a task's share.
    """
    cell = F.concat_ws("_", F.floor(lat / cell_deg).cast("string"), F.floor(lon / cell_deg).cast("string"))
    together = layer.withColumn("grid_cell", cell).hint("rebalance", "grid_cell")
    together.write.mode("overwrite").partitionBy("grid_cell").parquet(path)
