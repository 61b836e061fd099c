"""From hits to answers: fragments, caps, unions, nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_CAP = 1000


def merge_fragments(hits: DataFrame, keys: list[str], attributes: list[str], fid: str = "fid",
                    wkt: str | None = None) -> DataFrame:
    """One row per point and set of attribute values (typed, NULL equals NULL).

    The kept fragment has the smallest non-zero id, else the smallest WKT.
    A grouped minimum, so fragments meet partially aggregated.
    """
    others = [c for c in hits.columns if c not in keys and c not in attributes]
    order = [(F.coalesce(F.col(fid), F.lit(0)) == 0).alias("_no_id"), F.coalesce(F.col(fid), F.lit(0)).alias("_id")]
    if wkt:
        order.append(F.coalesce(F.col(wkt), F.lit("")).alias("_wkt"))
    best = F.min_by(F.struct(*others), F.struct(*order))
    return hits.groupBy(*keys, *attributes).agg(best.alias("_kept")).select(*keys, *attributes, "_kept.*")


def cap_hits(hits: DataFrame, point: str = "point_id", order: list[str] | None = None,
             max_features: int | None = DEFAULT_CAP) -> DataFrame:
    """At most `max_features` hits per point and source, in catalog order; all where it is None."""
    if max_features is None:
        return hits
    w = Window.partitionBy(point, "source_id").orderBy(*(order or ["layer_ord", "fid"]))
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_features).drop("_rn")


def first_of_shape(features: DataFrame, shape: list[str], order: list, kept: int = 1) -> DataFrame:
    """The first `kept` features of each value of `shape`, which names the geometry (and what else tells results apart).

    What covers a point is the same for features of one shape, so those that
    `kept` others come before are never among the first `kept` of a point.
    """
    w = Window.partitionBy(*shape).orderBy(*order)
    return features.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= kept).drop("_rn")


def keep_properties(hits: DataFrame, wanted: list[str] | None, keys: list[str]) -> DataFrame:
    """Only the named attribute columns; features stay even without any."""
    if not wanted:
        return hits
    return hits.select(*keys, *[c for c in hits.columns if c in wanted and c not in keys])


def keep_map_properties(properties: Column, wanted: list[str] | None) -> Column:
    if not wanted:
        return properties
    return F.map_filter(properties, lambda k, _: k.isin(*wanted))


def drop_null_values(properties: Column) -> Column:
    return F.map_filter(properties, lambda _, v: v.isNotNull())


def pack_properties(df: DataFrame, attributes: list[str]) -> Column:
    """Attributes as one JSON object; NULL attributes vanish."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(attributes)])) if attributes else F.lit("{}")


def union_hits(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def nest_answers(points: DataFrame, hits: DataFrame, point: str = "point_id") -> DataFrame:
    """One row per point: results per source with name, license, feature arrays and counts.

    Hits are capped per point and source before they come here, or are all that
    the layers have there. They are brought together by point once, so both groups and the join
    find them in place. Points without hits keep an empty array. Properties stay JSON text;
    the line writer turns them into objects.
    """
    hits = hits.repartition(point)
    shown = [c for c in ("geometry",) if c in hits.columns]
    features = F.array_sort(F.collect_list(F.struct("layer_ord", "fid", "layer", "properties", *shown)))
    about = [c for c in ("source_name", "license") if c in hits.columns]
    per_source = hits.groupBy(point, "source_id").agg(features.alias("features"), *[F.any_value(c).alias(c) for c in about])
    results = per_source.groupBy(point).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("source_id"),
            F.size("features").alias("feature_count"),
            F.col("features"),
            *about,
        ))).alias("results"),
        F.sum(F.size("features")).cast("bigint").alias("total_features"),
    )
    empty = F.array().cast(results.schema["results"].dataType)
    return points.join(results, point, "left").withColumns({
        "results": F.coalesce("results", empty),
        "total_features": F.coalesce("total_features", F.lit(0).cast("bigint")),
    })
