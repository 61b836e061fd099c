"""Smallest datasets that give the same answers, and the points to check them with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry
from .skew import lookup_join

SUBSET_K = 10
SUBSET_RADIUS_KM = 120.0


def needed_units(admin_hits: DataFrame, candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """(fid) of units that cover a point, or are ancestors of a candidate's unit."""
    covering = admin_hits.select("fid").distinct()
    starts = candidates.filter(F.coalesce("admin_id", F.lit(0)) != 0).select(F.col("admin_id").alias("fid")).distinct()
    above = lookup_join(closure, starts, ["fid"], "left_semi").select(F.col("anc_fid").alias("fid"))
    return covering.unionByName(above).distinct()


def needed_places(candidates: DataFrame, k: int = SUBSET_K) -> DataFrame:
    """(fid) of the first k candidates per point and class."""
    return candidates.filter(F.col("rank") <= k).select("fid").distinct()


def keep_needed(features: DataFrame, needed: DataFrame, fid: str = "fid") -> DataFrame:
    return lookup_join(features, needed.withColumnRenamed("fid", fid) if fid != "fid" else needed, [fid], "left_semi")


def differences(full: DataFrame, subset: DataFrame) -> DataFrame:
    """Answers that differ, each tagged with the side it is on; empty means verified."""
    only_full = full.exceptAll(subset).withColumn("side", F.lit("full"))
    return only_full.unionByName(subset.exceptAll(full).withColumn("side", F.lit("subset")))


def countries_present(*tables: DataFrame) -> DataFrame:
    """Distinct non-empty country codes of several layers."""
    codes = None
    for table in tables:
        part = table.select("country_iso").distinct()
        codes = part if codes is None else codes.unionByName(part)
    return codes.filter(F.coalesce("country_iso", F.lit("")) != "").distinct()


def trim_sidecar(raw: DataFrame, countries: DataFrame) -> DataFrame:
    """Sidecar rows of the given countries that have an equivalent."""
    return lookup_join(raw.filter(F.coalesce("equivalent", F.lit("")) != ""), countries, ["country_iso"], "left_semi")


def interior_point(rings: Column) -> Column:
    """STRUCT<lon, lat> inside: the box centre when covered, else the middle of the
    widest span of the horizontal line through it (or through a vertex-free line nearby)."""
    box = geometry.bounds(rings)
    segs = geometry.edges(rings)
    cx, cy = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    ys = F.array_sort(F.array_distinct(F.flatten(F.transform(segs, lambda e: F.array(e["ay"], e["by"])))))
    above = F.coalesce(F.array_min(F.filter(ys, lambda v: v > cy)), box["ymax"])
    below = F.coalesce(F.array_max(F.filter(ys, lambda v: v <= cy)), box["ymin"])
    level = (above + below) / 2
    crossing = F.filter(segs, lambda e: (e["ay"] <= level) != (e["by"] <= level))
    xs = F.array_sort(F.transform(crossing, lambda e: e["ax"] + (level - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
    spans = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda i: i + 1 < F.size(xs)),
        lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("w"), ((F.get(xs, i + 1) + F.get(xs, i)) / 2).alias("m")))
    widest = F.when(F.size(xs) >= 2, F.array_max(spans))
    # the box centre always lies in the box; test it against the segments
    return F.when(geometry.covers(segs, cx, cy), F.struct(cx.alias("lon"), cy.alias("lat"))).otherwise(
        F.struct(widest["m"].alias("lon"), level.alias("lat")))


def sample_units(admin: DataFrame, level: int, per_country: DataFrame) -> DataFrame:
    """(label, country_iso, lon, lat): the first n named units per country at one level.

    `per_country(country_iso, n)`; smallest ids first.
    """
    named = admin.filter((F.col("admin_level") == str(level)) & (F.coalesce("name", F.lit("")) != ""))
    sized = lookup_join(named, per_country, ["country_iso"])
    w = Window.partitionBy("country_iso").orderBy("fid")
    limit = per_country.agg(F.max("n")).first()[0] or 0
    picked = (sized.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
              .filter(F.col("_rn") <= F.col("n")))
    at = interior_point(F.col("rings"))
    return picked.select(
        "fid", F.concat(F.col("country_iso"), F.lit(f"/L{level} "), F.col("name")).alias("label"),
        "country_iso", at["lon"].alias("lon"), at["lat"].alias("lat"))
