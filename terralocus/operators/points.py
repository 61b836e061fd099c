"""Input points: coordinates, validation, reprojection, source choice, locality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import crs

WGS84_SRID = 4326


def resolve_points(inputs: DataFrame, batch_srid: int = 0, index: str = "idx") -> DataFrame:
    """Adds x, y, srid, echo_id and error text to rows of (idx, id, lon, lat, x, y, srid).

    A complete lon/lat pair beats x/y; the row's SRID beats the batch's; 0
    means WGS84; (0, 0) is a legal point. Rows without a pair stay, with an error.
    """
    srid = F.coalesce(F.nullif(F.coalesce(F.col("srid"), F.lit(batch_srid)), F.lit(0)), F.lit(WGS84_SRID))
    geographic = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    planar = F.col("x").isNotNull() & F.col("y").isNotNull()
    return inputs.withColumns({
        "x": F.when(geographic, F.col("lon")).when(planar, F.col("x")),
        "y": F.when(geographic, F.col("lat")).when(planar, F.col("y")),
        "srid": srid,
        "echo_id": F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col(index).cast("string")),
        "error": F.when(~geographic & ~planar, F.lit("coordinates required: provide lon/lat or x/y")),
    }).drop("lon", "lat", "id")


def validate_points(points: DataFrame) -> DataFrame:
    """Adds `invalid` STRUCT<field, value, constraint>; NULL for good rows.

    Only WGS84 rows have limits. NaN is rejected.
    """
    def bad(axis, limit):
        return F.isnan(axis) | (axis < -limit) | (axis > limit)

    def report(field, axis, limit):
        return F.struct(F.lit(field).alias("field"), axis.alias("value"),
                        F.lit(f"[-{limit}, {limit}]").alias("constraint"))

    x, y, geographic = F.col("x"), F.col("y"), F.col("srid") == WGS84_SRID
    return points.withColumn(
        "invalid",
        F.when(geographic & bad(x, 180), report("longitude", x, 180))
        .when(geographic & bad(y, 90), report("latitude", y, 90)),
    )


def reproject_points(points: DataFrame, targets: list[int], sources: tuple[int, ...] = crs.SUPPORTED) -> DataFrame:
    """Adds x_<srid>, y_<srid> once per distinct target; NULL where not transformable."""
    for target in sorted(set(targets)):
        points = crs.reproject(points, "x", "y", "srid", target, f"x_{target}", f"y_{target}", sources)
    return points


def choose_sources(sources: DataFrame, wanted: list[str] | None) -> DataFrame:
    """Ready sources, or the ready ones among the wanted ids; an unknown id raises."""
    if not wanted:
        return sources.filter(F.col("status") == "ready")
    ids = sorted(set(wanted))
    known = {r["source_id"] for r in sources.filter(F.col("source_id").isin(*ids)).select("source_id").distinct().collect()}
    missing = [i for i in ids if i not in known]
    if missing:
        raise ValueError(f"unknown source: {', '.join(missing)}")
    return sources.filter(F.col("source_id").isin(*ids) & (F.col("status") == "ready"))


def sort_by_locality(points: DataFrame, lon: str = "lon", lat: str = "lat", point: str = "point_id") -> DataFrame:
    """Neighbouring points side by side: by one-degree tile, then by position.

    The id closes the range key, so even copies of one point spread over tasks.
    """
    tile = [F.floor(F.col(lat)), F.floor(F.col(lon))]
    return points.repartitionByRange(*tile, lat, lon, point).sortWithinPartitions(*tile, lat, lon)
