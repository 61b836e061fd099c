"""Bearing anchors: candidates, salience, "in X", labels."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import PLACE_CLASSES, class_rank
from ..functions.geodesy import azimuth_deg
from ..functions.labels import bearing_label, compass, round_distance
from .nearest import PlaceIndex, nearest
from .skew import lookup_join

INSIDE_K = 5
RANK_K = 10
COMPOSITE_K = 250


@dataclass(frozen=True)
class BearingPolicy:
    """Fixed values of the default policy; radii in km per place class."""
    reach: dict[str, float] = field(default_factory=lambda: {"village": 5.0, "town": 18.0, "city": 60.0})
    inside_radius: dict[str, float] = field(default_factory=lambda: {"village": 0.8, "town": 1.5, "city": 3.0})
    prefer_nearest_km: float = 5.0
    constraint_tier: str = "state"
    near_label_km: float = 1.0
    compass_points: int = 8
    candidate_radius_km: float = 0.0

    @property
    def limit(self) -> int:
        return COMPOSITE_K if self.candidate_radius_km > 0 else RANK_K

    def gather_radius(self, place_class: str) -> float:
        return self.candidate_radius_km if self.candidate_radius_km > 0 else self.reach.get(place_class, 0.0)


RANK_POLICY = BearingPolicy()
COMPOSITE_POLICY = BearingPolicy(candidate_radius_km=120.0)


@dataclass(frozen=True)
class CompositeWeights:
    """Fixed values of the composite score."""
    population: float = 1.0
    wikidata: float = 0.3
    decay_per_km: float = 0.04
    capital_scale: float = 0.8
    class_prior: dict[str, float] = field(default_factory=lambda: {"city": 4.3, "town": 3.3, "village": 2.3})
    capital_bonus: dict[str, float] = field(default_factory=lambda: {
        "yes": 2.0, "2": 2.0, "3": 1.5, "4": 1.2, "5": 0.6, "6": 0.4, "7": 0.2})


def _per_class(table: dict[str, float], key: Column) -> Column:
    out = F.lit(0.0)
    for name, value in table.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


# A salience strategy turns candidate columns into (eligible, ordering struct):
# the smallest ordering among the eligible rows of a point wins.
Strategy = Callable[["BearingPolicy"], tuple[Column, Column]]


def rank_strategy(policy: BearingPolicy) -> tuple[Column, Column]:
    """Nearest town-or-larger close by; else highest class in reach, nearer, smaller name."""
    reach = _per_class(policy.reach, F.col("place"))
    d = F.col("distance_km")
    rank = class_rank(F.col("place"))
    override = (F.lit(policy.prefer_nearest_km > 0) & (rank >= 2) & (d <= policy.prefer_nearest_km))
    order = F.struct(
        (~override).alias("later"), F.when(override, F.lit(0)).otherwise(-rank).alias("cls"),
        d.alias("km"), F.col("name").alias("nm"), F.col("fid").alias("id"))
    return (reach > 0) & (d <= reach), order


def composite_score(weights: CompositeWeights = CompositeWeights()) -> Column:
    population = F.coalesce(F.col("population"), F.lit(0))
    base = F.when(population > 0, F.log10(population.cast("double") + 1) * weights.population).otherwise(
        _per_class(weights.class_prior, F.col("place")))
    capital = _per_class(weights.capital_bonus, F.coalesce("capital", F.lit(""))) * weights.capital_scale
    known = F.when(F.coalesce("wikidata", F.lit("")) != "", F.lit(weights.wikidata)).otherwise(F.lit(0.0))
    return base + capital + known - F.col("distance_km") * weights.decay_per_km


def composite_strategy(policy: BearingPolicy, weights: CompositeWeights = CompositeWeights()) -> tuple[Column, Column]:
    """Highest score; ties go to the nearer place, then the smaller name."""
    order = F.struct(
        (-composite_score(weights)).alias("loss"), F.col("distance_km").alias("km"),
        F.col("name").alias("nm"), F.col("fid").alias("id"))
    return F.lit(True), order


# what guards and strategies read; the winner's other columns are looked up afterwards
PLACE_COLUMNS = ["name", "admin_id", "country_iso", "population", "capital", "wikidata", "tier_fid"]
SHOWN_COLUMNS = ["name_native", "name_source", "place_lon", "place_lat"]


def gather(points: DataFrame, places: DataFrame | PlaceIndex, policy: BearingPolicy) -> DataFrame:
    """Nearest places per class, cut at the policy's limit before any guard.

    `points` carry point_country and point_tier (NULL when unknown); `places`
    carry tier_fid, or are an index of such prepared for group `place`. Adds
    distance_km and the rank within the class.
    """
    return _nearest_per_class(points, places, policy.limit, {c: policy.gather_radius(c) for c in reversed(PLACE_CLASSES)})


def gather_inside(points: DataFrame, places: DataFrame | PlaceIndex, policy: BearingPolicy) -> DataFrame:
    """The rows of `gather` that `inside_places` looks at, and no others.

    Places within a class's own radius come first in its ranking by distance, so
    their ranks are the same when nothing farther is searched.
    """
    radii = {c: min(policy.gather_radius(c), policy.inside_radius.get(c, 0.0)) for c in reversed(PLACE_CLASSES)}
    return _nearest_per_class(points, places, min(policy.limit, INSIDE_K), radii)


def _nearest_per_class(points: DataFrame, places: DataFrame | PlaceIndex, k: int, radii: dict[str, float]) -> DataFrame:
    kept = [c for c in PLACE_COLUMNS if c in (places.rows if isinstance(places, PlaceIndex) else places).columns]
    by_radius: dict[float, list[str]] = {}
    for name, radius in radii.items():
        if radius > 0:
            by_radius.setdefault(radius, []).append(name)
    parts = [
        nearest(points, places, k, radius, kept, group="place", values=names)
        for radius, names in by_radius.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def guarded(candidates: DataFrame) -> DataFrame:
    """Drops places of another country or another unit of the constraint tier."""
    country_ok = (F.coalesce("point_country", F.lit("")) == "") | (
        F.coalesce("country_iso", F.lit("")) == F.col("point_country"))
    tier_ok = F.col("point_tier").isNull() | (
        (F.coalesce("admin_id", F.lit(0)) != 0) & F.coalesce(F.col("tier_fid") == F.col("point_tier"), F.lit(False)))
    return candidates.filter(country_ok & tier_ok)


def inside_places(candidates: DataFrame, policy: BearingPolicy, point: str = "point_id") -> DataFrame:
    """One row per point that stands within a place's own radius: the nearest such place.

    Per class only the five nearest are looked at, and that before the guards.
    """
    radius = _per_class(policy.inside_radius, F.col("place"))
    near = guarded(candidates.filter((F.col("rank") <= INSIDE_K) & (radius > 0) & (F.col("distance_km") <= radius)))
    return _pick(near, F.struct(F.col("distance_km").alias("km"), (-class_rank(F.col("place"))).alias("cls"),
                                F.col("fid").alias("id")), point)


def _pick(rows: DataFrame, order: Column, point: str) -> DataFrame:
    shown = [c for c in rows.columns if c != point]
    return rows.groupBy(point).agg(F.min_by(F.struct(*shown), order).alias("_best")).select(point, "_best.*")


def most_salient(candidates: DataFrame, policy: BearingPolicy, strategy: Strategy, point: str = "point_id") -> DataFrame:
    """The winning anchor per point (partially aggregated, no sort)."""
    eligible, order = strategy(policy)
    return _pick(guarded(candidates).filter(eligible), order, point)


def fixes(points: DataFrame, candidates: DataFrame, places: DataFrame, policy: BearingPolicy, strategy: Strategy,
          point: str = "point_id") -> DataFrame:
    """(point, reference.., distance_km, azimuth, compass, label, inside).

    `points` carry `allowed` (the built-up gate). One grouped pass finds both
    the place the point stands in and the best anchor; the first wins. Inside
    and near fixes have azimuth 0 and no compass point. Points without any
    anchor are absent.
    """
    radius = _per_class(policy.inside_radius, F.col("place"))
    eligible, order = strategy(policy)
    standing = F.col("allowed") & (F.col("rank") <= INSIDE_K) & (radius > 0) & (F.col("distance_km") <= radius)
    shown = F.struct("name", "place", "fid", "distance_km", "lon", "lat")
    inside_order = F.struct(F.col("distance_km").alias("km"), (-class_rank(F.col("place"))).alias("cls"), F.col("fid").alias("id"))
    best = guarded(candidates).groupBy(point).agg(
        F.min_by(F.when(standing, shown), F.when(standing, inside_order)).alias("_in"),
        F.min_by(F.when(eligible, shown), F.when(eligible, order)).alias("_best"),
    )
    best = best.withColumn("inside", F.col("_in").isNotNull()).withColumn("_fix", F.coalesce("_in", "_best"))
    best = best.filter(F.col("_fix").isNotNull()).select(point, "inside", "_fix.*")
    best = lookup_join(best, places.select("fid", *SHOWN_COLUMNS), ["fid"], spread_by=[point])
    d, name = F.col("distance_km"), F.col("name")
    directed = ~F.col("inside") & (d >= policy.near_label_km)
    best = best.withColumn("_az", F.when(directed, azimuth_deg(F.col("place_lon"), F.col("place_lat"), F.col("lon"), F.col("lat"))))
    rose = compass(F.col("_az"), policy.compass_points)
    return best.select(
        point, F.col("name").alias("reference"), "name_native", "name_source", F.col("place").alias("class"), "distance_km",
        F.coalesce("_az", F.lit(0.0)).alias("azimuth"),
        F.coalesce(rose, F.lit("")).alias("compass"),
        F.when(F.col("inside"), F.concat(F.lit("in "), name))
        .when(F.col("_az").isNull(), F.concat(F.lit("prope "), name))
        .otherwise(bearing_label(round_distance(d), rose, name)).alias("label"),
        "inside",
    )
