"""The source catalog: metadata, status, listings, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.attributes import extent_struct, is_source_file, license_struct, source_id
from .skew import lookup_join

CONTRACT_TYPE = "struct<license:struct<name:string,url:string,attribution:string>,description:string>"


def layer_catalog(layers: DataFrame, features: DataFrame) -> DataFrame:
    """One row per layer with feature count and extent (all zero means none).

    `layers(source_id, layer, description, geometry_type, srid, has_index)`,
    `features(source_id, layer, xmin, ymin, xmax, ymax)`.
    """
    stats = features.groupBy("source_id", "layer").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.min("xmin").alias("_x0"), F.min("ymin").alias("_y0"), F.max("xmax").alias("_x1"), F.max("ymax").alias("_y1"))
    return layers.join(stats, ["source_id", "layer"], "left").select(
        *layers.columns,
        F.coalesce("feature_count", F.lit(0)).alias("feature_count"),
        extent_struct(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1")).alias("extent"),
    )


def source_metadata(rows: DataFrame, contract_uri: str) -> DataFrame:
    """(source_id, license, description) from metadata rows (source_id, id, uri, mime, metadata).

    The contract row is JSON under `contract_uri`; malformed ones are skipped,
    the last good one wins. Otherwise the first row that is not JSON describes
    the source; other JSON rows are ignored.
    """
    is_json = F.coalesce("mime", F.lit("")) == "application/json"
    text = F.coalesce("metadata", F.lit(""))
    doc = F.from_json(text, CONTRACT_TYPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    readable = F.try_variant_get(F.try_parse_json(text), "$", "variant").isNotNull()
    contract = is_json & (F.coalesce("uri", F.lit("")) == contract_uri) & readable
    tagged = rows.withColumns({"_doc": F.when(contract, doc), "_text": text})
    stated = F.col("_doc").isNotNull()
    with_text = stated & (F.coalesce(F.col("_doc.description"), F.lit("")) != "")
    fallback = ~is_json & (F.col("_text") != "")
    agg = tagged.groupBy("source_id").agg(
        F.max_by("_doc.license", F.when(stated, F.col("id"))).alias("_lic"),
        F.max_by("_doc.description", F.when(with_text, F.col("id"))).alias("_said"),
        F.min_by("_text", F.when(fallback, F.col("id"))).alias("_plain"),
    )
    part = {c: F.coalesce(F.col(f"_lic.{c}"), F.lit("")) for c in ("name", "url", "attribution")}
    return agg.select(
        "source_id",
        license_struct(part["name"], part["url"], part["attribution"]).alias("license"),
        F.coalesce("_said", "_plain", F.lit("")).alias("description"),
    )


def catalog_status(sources: DataFrame, layers: DataFrame) -> DataFrame:
    """Per source: status and readiness (indexed and every layer indexed)."""
    indexed = layers.groupBy("source_id").agg(F.every("has_index").alias("_all"))
    return sources.join(indexed, "source_id", "left").select(
        "source_id", "status", (F.col("indexed") & F.coalesce("_all", F.lit(True))).alias("ready"))


def catalog_totals(status: DataFrame) -> DataFrame:
    """One row: sources loaded, ready and failed."""
    return status.agg(
        F.count(F.lit(1)).alias("sources_loaded"),
        F.count_if(F.col("ready")).alias("sources_ready"),
        F.count_if(F.col("status") == "error").alias("sources_failed"),
    )


def source_listing(sources: DataFrame, layers: DataFrame) -> DataFrame:
    """Every source with its licence (NULL when empty) and its layers in order."""
    entry = F.struct("layer_ord", "layer", "geometry_type", "srid", "has_index", "feature_count")
    per_source = layers.groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("layers"))
    joined = sources.join(per_source, "source_id", "left")
    empty = F.array().cast(per_source.schema["layers"].dataType)
    return joined.select(
        "source_id", "name", "kind", "size", "status",
        license_struct(F.col("license_name"), F.col("license_url"), F.col("license_attribution")).alias("license"),
        F.coalesce("layers", empty).alias("layers"),
    )


def one_path_per_id(listing: DataFrame, path: str = "key") -> DataFrame:
    """Supported files only, one per derived id: the smallest path."""
    named = listing.filter(is_source_file(F.col(path))).withColumn("source_id", source_id(F.col(path)))
    others = [c for c in listing.columns if c != path]
    grouped = named.groupBy("source_id").agg(F.min_by(F.struct(path, *others), F.col(path)).alias("_one"))
    return grouped.select("source_id", "_one.*")


def id_collisions(listing: DataFrame, path: str = "key") -> DataFrame:
    """Paths refused because a smaller path has the same derived id.

    The same path listed twice is a reload, not a collision. The winner per id
    comes from a grouped minimum; the refusals are joined back to it.
    """
    named = listing.filter(is_source_file(F.col(path))).select(
        F.col(path), source_id(F.col(path)).alias("source_id")).distinct()
    first = named.groupBy("source_id").agg(F.min(path).alias("kept_path"), F.count(F.lit(1)).alias("_n"))
    clashing = first.filter(F.col("_n") > 1).drop("_n")
    return lookup_join(named, clashing, ["source_id"], spread_by=[path]).filter(F.col(path) != F.col("kept_path")).select(
        "source_id", F.col(path).alias("refused_path"), "kept_path")


def sync_plan(listing: DataFrame, loaded: DataFrame, changed: bool = False, path: str = "key") -> DataFrame:
    """(source_id, action, path): add, remove or keep by derived id.

    `loaded(source_id, path)`. With `changed`, a kept id whose etag differs
    (both sides carry etag) becomes `update`.
    """
    wanted = one_path_per_id(listing, path).withColumnRenamed(path, "_listed")
    have = loaded.withColumnRenamed("path", "_loaded")
    if changed:
        have = have.withColumnRenamed("etag", "_etag")
    both = wanted.join(have, "source_id", "full_outer")
    action = F.when(F.col("_loaded").isNull(), F.lit("add")).when(F.col("_listed").isNull(), F.lit("remove"))
    if changed:
        action = action.when(~F.col("etag").eqNullSafe(F.col("_etag")), F.lit("update"))
    return both.select("source_id", action.otherwise(F.lit("keep")).alias("action"),
                       F.coalesce("_listed", "_loaded").alias("path"))
