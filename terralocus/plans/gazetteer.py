"""The gazetteer answer: admin chain, landmarks, bearing, terrain, elevation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.attributes import license_struct
from ..operators import bearing as B
from ..operators import hierarchy as A
from ..operators import landmarks as L
from ..operators import raster as R
from ..operators.containment import match_index
from ..operators.hits import merge_fragments
from ..operators.layer_index import LayerIndex, build_index
from ..operators.nearest import PlaceIndex
from ..operators.skew import lookup_join
from ..operators.spots import at_spots
from ..session import cut_lineage

ADMIN_COLUMNS = ["fid", "parent_id", "admin_level", "name", "name_native", "name_source", "country_iso"]
ISLAND_COLUMNS = ["fid", "name", "name_native", "name_source"]
MOUNTAIN_COLUMNS = ["fid", "name", "name_native", "name_source", "landform", "ele", "area_km2"]

# Types of the sections, the same whether a dataset has them or not.
_NAMES = "name:string,name_native:string,name_source:string"
ISLANDS_TYPE = f"array<struct<{_NAMES}>>"
MOUNTAINS_TYPE = f"struct<mountain:struct<{_NAMES},elevation:double>,range:struct<{_NAMES}>>"
EXPOSURE_TYPE = ("struct<slope_deg:double,slope_percent:double,aspect_deg:double,aspect_compass:string,flat:boolean,"
                 "sample_spacing_m:double>")
ELEVATION_TYPE = ("struct<meters:double,accuracy_m:double,accuracy_basis:string,horizontal_accuracy_m:double,vertical_datum:string,"
                  "sea_level:boolean,surface_model:string,source:struct<name:string,url:string,attribution:string>>")


@dataclass(frozen=True)
class ElevationMeta:
    accuracy_m: float = 4.0
    basis: str = "dataset constant"
    point_basis: str = "per point"
    horizontal_m: float = 6.0
    vertical_datum: str = "EGM2008"
    surface_model: str = "DSM"


@dataclass(frozen=True)
class Gazetteer:
    """Role tables; `prepare` adds what is computed once per dataset."""
    admin: DataFrame
    places: DataFrame
    meanings: DataFrame
    name_sources: DataFrame | None = None
    islands: DataFrame | None = None
    mountains: DataFrame | None = None
    raster: R.Raster | None = None
    dem: tuple[str, str] | None = None
    dem_accuracy: tuple[str, str] | None = None
    builtup: tuple[str, str] | None = None
    builtup_min: float = R.BUILTUP_MIN
    elevation_meta: ElevationMeta = ElevationMeta()
    license: tuple[str, str, str] = ("", "", "")
    dem_license: tuple[str, str, str] = ("", "", "")
    policy: B.BearingPolicy = B.COMPOSITE_POLICY
    strategy: B.Strategy = B.composite_strategy
    # indexes hold all features, or of islands and mountains those of landmarks.first_islands and first_mountains
    admin_index: LayerIndex | None = None
    island_index: LayerIndex | None = None
    mountain_index: LayerIndex | None = None
    place_index: PlaceIndex | None = None


def with_tiers(places: DataFrame, admin: DataFrame, meanings: DataFrame, tier: str, closure: DataFrame | None = None) -> DataFrame:
    """Places with the tier ancestor of their unit; computed once per dataset."""
    closure = A.ancestor_closure(admin) if closure is None else closure
    tiers = A.tier_ancestors(admin, closure, meanings, tier).withColumnRenamed("fid", "admin_id")
    return lookup_join(places, tiers, ["admin_id"], "left", spread_by=["fid"])


def covering(points: DataFrame, polygons: DataFrame, columns: list[str], index: LayerIndex | None = None,
             merge: bool = True) -> DataFrame:
    """Polygons at each point; with `merge`, fragments of one feature become one hit.

    Hits are brought together by point once; every later group, window and join
    on the point finds them in place. A point's hits are few, so no key is hot.
    """
    index = index or build_index(polygons, columns)
    found = match_index(points.select("point_id", "lon", "lat"), index).drop("lon", "lat").repartition("point_id")
    return merge_fragments(found, ["point_id"], [c for c in columns if c != "fid"]) if merge else found


def bearings(points: DataFrame, summary: DataFrame, g: Gazetteer) -> DataFrame:
    """Fix per point. `g.places` carry tier_fid; `points(point_id, lon, lat)`; `summary` from admin_summary."""
    known = summary.select("point_id", "point_country", "point_tier")
    asked = points.select("point_id", "lon", "lat").join(known, "point_id", "left")
    if g.raster is not None and g.builtup is not None:
        asked = R.builtup_gate(asked, g.raster, g.builtup, g.builtup_min)
    else:
        asked = asked.withColumn("allowed", F.lit(True))
    candidates = B.gather(asked, g.places if g.place_index is None else g.place_index, g.policy)
    return B.fixes(asked, candidates, g.places, g.policy, g.strategy)


def summarise(points: DataFrame, g: Gazetteer) -> DataFrame:
    """The admin summary per covered point."""
    return A.admin_summary(covering(points, g.admin, ADMIN_COLUMNS, g.admin_index), g.meanings, g.policy.constraint_tier)


def gazetteer(points: DataFrame, g: Gazetteer) -> DataFrame:
    """One row per point with every section; a section without a result is NULL. Points at one spot share their answer."""
    return at_spots(points, lambda spots: spot_answers(spots, g))


def spot_answers(points: DataFrame, g: Gazetteer) -> DataFrame:
    """`gazetteer` of points of which no two share their coordinates.

    The admin containment is computed once and written out, because both the
    chain and the bearing read it. All sections share the point key, so the
    final joins line up.
    """
    slim = points.select("point_id", "lon", "lat")
    summary = cut_lineage(summarise(slim, g))
    out = points.join(summary.select("point_id", F.struct("country_iso", "hierarchy").alias("admin")), "point_id", "left")
    codes = [F.coalesce(F.transform("admin.hierarchy", lambda u: u["name_source"]), F.array().cast("array<string>"))]

    if g.islands is not None:
        out = out.join(L.islands(covering(slim, L.first_islands(g.islands), ISLAND_COLUMNS, g.island_index, merge=False)), "point_id", "left")
        codes.append(F.coalesce(F.transform("islands", lambda i: i["name_source"]), F.array().cast("array<string>")))
    else:
        out = out.withColumn("islands", F.lit(None).cast(ISLANDS_TYPE))
    if g.mountains is not None:
        found = L.mountains(covering(slim, L.first_mountains(g.mountains), MOUNTAIN_COLUMNS, g.mountain_index, merge=False))
        out = out.join(found.select("point_id", F.struct("mountain", "range").alias("mountains")), "point_id", "left")
        codes.append(F.array("mountains.range.name_source", "mountains.mountain.name_source"))
    else:
        out = out.withColumn("mountains", F.lit(None).cast(MOUNTAINS_TYPE))

    fix = bearings(slim, summary, g)
    parts = [c for c in fix.columns if c != "point_id"]
    out = out.join(fix.select("point_id", F.struct(*parts).alias("bearing")), "point_id", "left")
    codes.append(F.array("bearing.name_source"))

    if g.raster is not None and g.dem is not None:
        heights = R.terrain(slim, g.raster, g.dem, g.dem_accuracy)
        meta = g.elevation_meta
        source = license_struct(*map(F.lit, g.dem_license))
        levels = R.elevation(slim, heights, meta.accuracy_m, meta.basis, meta.point_basis).select(
            "point_id", "exposure",
            F.struct("meters", "accuracy_m", "accuracy_basis", F.lit(meta.horizontal_m).alias("horizontal_accuracy_m"),
                     F.lit(meta.vertical_datum).alias("vertical_datum"), "sea_level",
                     F.lit(meta.surface_model).alias("surface_model"), source.alias("source")).alias("elevation"))
        out = out.join(levels, "point_id", "left")
    else:
        out = out.withColumns({"exposure": F.lit(None).cast(EXPOSURE_TYPE), "elevation": F.lit(None).cast(ELEVATION_TYPE)})

    out = out.withColumn("_codes", A.provenance_codes(*codes))
    if g.name_sources is not None:
        out = describe_sources(out, g.name_sources)
    else:
        text = F.lit(None).cast("string")
        out = out.withColumn("sources", F.transform("_codes", lambda c: F.struct(
            c.alias("code"), text.alias("short"), text.alias("long"), text.alias("standard")))).drop("_codes")
    return out.withColumn("license", license_struct(*map(F.lit, g.license)))


def describe_sources(answers: DataFrame, name_sources: DataFrame) -> DataFrame:
    """Turns `_codes` into `sources`, each distinct code described once, in order."""
    coded = answers.select("point_id", F.posexplode("_codes").alias("pos", "code"))
    described = A.with_provenance(coded, name_sources, "code").groupBy("point_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "short", "long", "standard"))).alias("_s"))
    listed = described.select("point_id", F.transform("_s", lambda s: s.dropFields("pos")).alias("sources"))
    joined = answers.drop("_codes").join(listed, "point_id", "left")
    return joined.withColumn("sources", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType)))


def wants_gazetteer(flag: str | None) -> bool:
    """Enrichment is on unless the flag is 0, false, no or off."""
    return (flag or "").lower() not in ("0", "false", "no", "off")
