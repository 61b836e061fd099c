"""What is at these points: every layer of every source, one answer per point."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry
from ..functions.attributes import license_struct
from ..functions.crs import SUPPORTED
from ..operators import hits as H
from ..operators.containment import match_index
from ..operators.layer_index import LayerIndex, build_box_index, build_index
from ..operators.points import WGS84_SRID, choose_sources, reproject_points, resolve_points, validate_points
from ..operators.raster import Raster, sample_covering, valued
from ..operators.skew import lookup_join
from ..operators.spots import at_spots, spot_rows
from .gazetteer import Gazetteer, gazetteer as describe, wants_gazetteer


@dataclass(frozen=True)
class VectorLayer:
    """A feature table: fid, attributes, and rings (polygons) or a box (other types).

    The declared type decides: exactly POLYGON or MULTIPOLYGON (any case) gets
    the containment test, everything else the box test.
    """
    source_id: str
    name: str
    ordinal: int
    geometry_type: str
    features: DataFrame
    attributes: list[str]
    srid: int = WGS84_SRID
    index: LayerIndex | None = None

    @property
    def is_polygon(self) -> bool:
        return self.geometry_type.upper() in ("POLYGON", "MULTIPOLYGON")


@dataclass(frozen=True)
class Catalog:
    """sources(source_id, status, license_name, license_url, license_attribution, and name if known) and their layers."""
    sources: DataFrame
    layers: list[VectorLayer]
    raster: Raster | None = None
    mapping: DataFrame | None = None


# what the answer at a point follows from
PLACE = ("x", "y", "srid")
HIT_COLUMNS = ["point_id", "source_id", "layer_ord", "layer", "fid", "properties"]
_EMPTY = "source_id string, layer_ord int, layer string, fid bigint, properties string"


def layer_hits(points: DataFrame, layer: VectorLayer, properties: list[str] | None = None,
               with_geometry: bool = False) -> DataFrame:
    """Flat hits of one vector layer; only wanted attributes are read.

    Fragments are merged on all attributes, so the merge sees them even when
    the answer shows fewer. A geometry is fetched by id after the match, so the
    index never carries it: the layer's `wkt` column where it has one, else the
    polygon of its rings.
    """
    px, py = f"x_{layer.srid}", f"y_{layer.srid}"
    slim = points.select("point_id", px, py)
    carry = ["fid", *layer.attributes]
    if layer.index is not None:
        index = replace(layer.index, carried=carry)
    else:
        index = (build_index if layer.is_polygon else build_box_index)(layer.features, carry)
    found = match_index(slim, index, px, py).drop(px, py)
    if layer.is_polygon:
        found = H.merge_fragments(found, ["point_id"], layer.attributes)
    shown = [a for a in layer.attributes if not properties or a in properties]
    out = found.withColumns({
        "source_id": F.lit(layer.source_id), "layer_ord": F.lit(layer.ordinal), "layer": F.lit(layer.name),
        "properties": H.pack_properties(found, shown),
    })
    if not with_geometry:
        return out.select(*HIT_COLUMNS)
    if "wkt" in layer.features.columns:
        text = F.col("wkt")
    elif "rings" in layer.features.columns:
        text = geometry.polygon_wkt(F.col("rings"))
    else:
        return out.select(*HIT_COLUMNS)
    shape = F.struct(F.initcap(geometry.wkt_type(F.col("_wkt"))).alias("type"), F.col("_wkt").alias("wkt"))
    shapes = layer.features.select("fid", text.alias("_wkt"))
    return lookup_join(out, shapes, ["fid"], "left", spread_by=["point_id"]).select(
        *HIT_COLUMNS, F.when(F.col("_wkt").isNotNull(), shape).alias("geometry"))


def raster_hits(points: DataFrame, catalog: Catalog, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, errors) of the raster layers of the `chosen` sources, each sampled once in its own system."""
    layers = catalog.raster.layers
    if chosen is not None:
        layers = lookup_join(layers, chosen.select("source_id").distinct(), ["source_id"], "left_semi")
    found = valued(sample_covering(points, catalog.raster, layers), catalog.mapping)
    hits = found.filter(F.col("error").isNull()).select(
        "point_id", "source_id", F.lit(0).alias("layer_ord"), F.col("layer_id").alias("layer"), "fid", "properties")
    return hits, found.filter(F.col("error").isNotNull()).select("point_id", "source_id", F.col("layer_id").alias("layer"), "error")


def unplaced(points: DataFrame, layers: list[tuple[str, str, int]]) -> DataFrame | None:
    """(point_id, source_id, layer, error) of the layers (source_id, layer, srid) to whose system no projection leads from the
    point's; None where that cannot be. Points of supported systems are asked for layers in other systems only."""
    def among(some):
        return F.array(*[F.struct(F.lit(s).alias("source_id"), F.lit(n).alias("layer"), F.lit(k).cast("int").alias("to")) for s, n, k in some])

    if not layers:
        return None
    foreign = [x for x in layers if x[2] not in SUPPORTED]
    away = ~F.col("srid").isin(*SUPPORTED)
    asked = F.when(away, among(layers))
    rows = points.select("point_id", "srid", F.explode(asked.otherwise(among(foreign)) if foreign else asked).alias("l"))
    text = F.concat(F.lit("no projection from system "), F.col("srid").cast("string"), F.lit(" to "), F.col("l.to").cast("string"))
    return rows.filter(F.col("srid") != F.col("l.to")).select("point_id", "l.source_id", "l.layer", text.alias("error"))


def hits_and_errors(points: DataFrame, catalog: Catalog, wanted: list[str] | None = None,
                    properties: list[str] | None = None, max_features: int | None = H.DEFAULT_CAP,
                    on_layer_error: Callable[[VectorLayer, Exception], None] | None = None,
                    srids: tuple[int, ...] = SUPPORTED, with_geometry: bool = False) -> tuple[DataFrame, DataFrame]:
    """All layers' hits, capped per point and source, with source name and licence; and (point, layer) errors.

    `points(point_id, x, y, srid)` are projected once per distinct SRID of the
    layers. `srids` names the systems the points come in; naming few keeps the
    plan short. A point and layer without a projection between their systems are an
    error; where both are in one system, none is needed, whichever it is. A layer whose plan cannot be built contributes nothing; it is
    reported to `on_layer_error`, or raised where there is none.
    """
    chosen = choose_sources(catalog.sources, wanted)
    named = sorted({x.source_id for x in catalog.layers})
    ids = {r[0] for r in chosen.filter(F.col("source_id").isin(*named)).select("source_id").collect()} if named else set()
    layers = [x for x in catalog.layers if x.source_id in ids]
    raster_srids = [] if catalog.raster is None else [
        r[0] for r in catalog.raster.layers.select(F.coalesce("srid", F.lit(WGS84_SRID))).distinct().collect()]
    located = reproject_points(points, [*(x.srid for x in layers), *raster_srids, WGS84_SRID], srids)
    parts = []
    for layer in layers:
        try:
            parts.append(layer_hits(located, layer, properties, with_geometry))
        except Exception as error:
            if on_layer_error is None:
                raise
            on_layer_error(layer, error)
    spark = points.sparkSession
    errors, named_layers = None, [(x.source_id, x.name, x.srid) for x in layers]
    if catalog.raster is not None:
        found, errors = raster_hits(located, catalog, chosen)
        parts.append(found)
        for_raster = lookup_join(catalog.raster.layers, chosen.select("source_id").distinct(), ["source_id"], "left_semi")
        named_layers += map(tuple, for_raster.select("source_id", "layer_id", F.coalesce("srid", F.lit(WGS84_SRID))).collect())
    if not parts:  # nothing to ask: empty results for every point
        parts.append(points.select("point_id").filter(F.lit(False)).join(spark.createDataFrame([], _EMPTY), F.lit(False)))
    away = unplaced(points, named_layers)
    if away is not None:
        errors = away if errors is None else errors.unionByName(away)
    if errors is None:
        errors = points.select("point_id", *[F.lit("").alias(c) for c in ("source_id", "layer", "error")]).filter(F.lit(False))
    hits = H.cap_hits(H.union_hits(parts), order=["layer_ord", "layer", "fid"], max_features=max_features)
    name = F.coalesce("name", "source_id") if "name" in chosen.columns else F.col("source_id")
    about = chosen.select("source_id", name.alias("source_name"), license_struct(
        F.col("license_name"), F.col("license_url"), F.col("license_attribution")).alias("license"))
    return lookup_join(hits, about, ["source_id"], spread_by=["point_id"]), errors


def all_hits(points: DataFrame, catalog: Catalog, *args, **options) -> DataFrame:
    """The hits of `hits_and_errors`, made once per spot."""
    return at_spots(points.select("point_id", *PLACE), lambda spots: hits_and_errors(spots, catalog, *args, **options)[0], PLACE).drop(*PLACE)


def sample_errors(points: DataFrame, catalog: Catalog, wanted: list[str] | None = None, srids: tuple[int, ...] = SUPPORTED) -> DataFrame:
    """(point_id, source_id, layer, error): layers that failed at a point, which does not affect the others."""
    return at_spots(points.select("point_id", *PLACE), lambda spots: hits_and_errors(spots, catalog, wanted, srids=srids)[1], PLACE).drop(*PLACE)


def answer_batch(inputs: DataFrame, catalog: Catalog, batch_srid: int = 0, gazetteer: Gazetteer | None = None,
                 gazetteer_flag: str | None = None, srids: tuple[int, ...] = SUPPORTED, together: bool = False, **options) -> DataFrame:
    """Inputs (idx, id, lon, lat, x, y, srid) to one answer per input, bad rows kept with their error.

    An answer has its results, the layers that failed there, the place in
    WGS84, and, with a gazetteer and unless the flag says no, its sections. With `together`,
    inputs at one place share the row of their answer and are listed in `points`.
    """
    checked = validate_points(resolve_points(inputs, batch_srid)).withColumnRenamed("idx", "point_id")
    checked = checked.withColumn("_good", F.col("error").isNull() & F.col("invalid").isNull())

    def answered(spots: DataFrame) -> DataFrame:
        return spot_answers(spots.filter("_good").select("point_id", *PLACE), catalog, gazetteer if wants_gazetteer(gazetteer_flag) else None, srids, **options)

    # nested answers are long, so nothing but the result holds one per point
    answers = (spot_rows if together else at_spots)(checked, answered, (*PLACE, "_good"), how="left").drop("_good")
    none = lambda name: F.array().cast(answers.schema[name].dataType)
    return answers.withColumns({
        "results": F.coalesce("results", none("results")), "total_features": F.coalesce("total_features", F.lit(0).cast("bigint")),
        "layer_errors": F.coalesce("layer_errors", none("layer_errors"))})


def spot_answers(good: DataFrame, catalog: Catalog, gazetteer: Gazetteer | None = None, srids: tuple[int, ...] = SUPPORTED, **options) -> DataFrame:
    """(point_id, results, total_features, layer_errors, wgs84, and gazetteer where there is one) of valid points (point_id, x, y, srid)."""
    hits, errors = hits_and_errors(good, catalog, srids=srids, **options)
    answers = H.nest_answers(good.select("point_id"), hits)
    failed = errors.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "layer", "error"))).alias("layer_errors"))
    answers = answers.join(failed, "point_id", "left").withColumn(
        "layer_errors", F.coalesce("layer_errors", F.array().cast(failed.schema["layer_errors"].dataType)))
    x, y = F.col(f"x_{WGS84_SRID}"), F.col(f"y_{WGS84_SRID}")
    located = reproject_points(good, [WGS84_SRID], srids).filter(x.isNotNull() & y.isNotNull()).select("point_id", x.alias("lon"), y.alias("lat"))
    answers = answers.join(located.select("point_id", F.struct("lon", "lat").alias("wgs84")), "point_id", "left")
    if gazetteer is None:
        return answers
    enriched = describe(located, gazetteer)
    sections = [c for c in enriched.columns if c not in ("point_id", "lon", "lat")]
    return answers.join(enriched.select("point_id", F.struct(*sections).alias("gazetteer")), "point_id", "left")
