"""k nearest features of a point layer within a radius.

Places are filed on a grid that fits the radius, and points ask the cells their
circle can touch. Where these hold too many places, a pyramid of counts leads
the way: the counts of all cells of ever finer grids. A point's cells are kept
by the nearest and the farthest a place in them can be; as soon as the cells
nearest by the farthest hold k places, all cells beyond that distance go, and the
crowded ones that remain are looked at one step finer. So a point meets a number
of places in proportion to k, however many stand around it. Large tables of places
are dealt by cell, and tasks rank a cell's places for its points in arrays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.geodesy import MEAN_RADIUS_KM, MIN_KM_PER_DEG, SPHERE_SLACK, distance_km, sphere_km, vincenty
from ..session import written
from .skew import MOST_PARTS, Size, lookup_join, measure, spread_for_work

# Grid sides in degrees, coarsest first; all divide 360 and are exact in binary. Points search on the first ten, the
# pyramid of counts goes on to less than a metre, two steps at a time.
LEVELS = 21
SIDES = [8.0 / 2**n for n in range(10)]
STEP = 2
# Cells with so few places are not looked at more finely.
LEAF = 8
# Where places are dealt by cell, a group is a crowd above so many places; points of a cell that meet its places in one task.
DEALT_CROWD, CELL_POINTS = 1 << 15, 4_096
# Bytes of places, each in all its cells, that a task meets points with.
PLACE_BYTES = 4 * 1024 * 1024
# From so many places on, tasks rank in arrays: places that a cell holds at most if it is coarser than the radius asks,
# points of a cell in one task, points that look for places together, and products held at once.
ARRAY_ROWS, ARRAY_PLACES, ARRAY_POINTS, ARRAY_SLICE, ARRAY_PRODUCTS = 200_000, 1 << 19, 1 << 16, 256, 1 << 22
_LAT_BITS = 27
# Longest length of one degree (km), rounded up.
MAX_KM_PER_DEG = 111.7


def enough(k: int) -> int:
    """Places that a point may meet per group before its cells are looked at more finely."""
    return 8 * k + 64


def _side_for(radius_km: float) -> float:
    """The finest side that still spans half the radius in latitude."""
    fitting = [s for s in SIDES if 2 * s * MIN_KM_PER_DEG >= radius_km]
    return fitting[-1] if fitting else SIDES[0]


def _cell(lon_slot: Column, lat_slot: Column) -> Column:
    return F.shiftleft(lon_slot.cast("bigint"), _LAT_BITS) + lat_slot.cast("bigint")


def _lon_slot(lon: Column, side: float) -> Column:
    return F.pmod(F.floor((lon + 180.0) / side), F.lit(int(360 / side)))


def _lat_slot(lat: Column, side: float) -> Column:
    return F.floor((lat + 90.0) / side)


def _reach_cells(lon: Column, lat: Column, radius_km: Column, side: float) -> Column:
    """All cells the radius circle can touch; wraps at 180 degrees, covers the poles."""
    n = int(360 / side)
    reach_lat = radius_km / MIN_KM_PER_DEG + 1e-9
    angle = radius_km * (1 + SPHERE_SLACK) / MEAN_RADIUS_KM
    over_pole = (F.abs(lat) + reach_lat) >= 89.999
    ratio = F.sin(angle) / F.cos(F.radians(lat))
    reach_lon = F.when(over_pole | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(ratio)) + 1e-9)
    west, east = F.floor((lon - reach_lon + 180.0) / side), F.floor((lon + reach_lon + 180.0) / side)
    lon_slots = F.when(east - west >= n - 1, F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).otherwise(
        F.transform(F.sequence(west, east), lambda v: F.pmod(v, F.lit(n)))
    )
    lat_slots = F.sequence(_lat_slot(F.greatest(lat - reach_lat, F.lit(-90.0)), side),
                           _lat_slot(F.least(lat + reach_lat, F.lit(90.0)), side))
    return F.flatten(F.transform(lon_slots, lambda i: F.transform(lat_slots, lambda j: _cell(i, j))))


@dataclass(frozen=True)
class PlaceIndex:
    """Places made ready for any number of `nearest` calls.

    rows: their columns, `_group`, `_plon`, `_plat`, and `_copy`, the rank among places at one spot.
    pyramid: (_group, level, cell, up, n), n places in a cell, `up` being the cell STEP levels above; None where it is
    counted when needed.
    """
    rows: DataFrame
    pyramid: DataFrame | None
    size: Size
    unique: bool
    group: str | None

    def counts(self, level: int) -> DataFrame:
        if self.pyramid is None:
            return _counts(self.rows, [level])
        return self.pyramid.filter(F.col("level") == level)


def _place_rows(places: DataFrame, group: str | None, lon: str, lat: str, fid: str) -> DataFrame:
    places = places.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    spot = Window.partitionBy(*([group] if group else []), lon, lat).orderBy(fid)
    # a struct is equal to itself even where its field is null
    own_group = F.struct((F.col(group) if group else F.lit(0)).alias("value"))
    return places.withColumns({"_copy": F.row_number().over(spot), "_group": own_group, "_plon": F.col(lon), "_plat": F.col(lat)})


def _counts(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Places per group and cell on the given levels, in one pass."""
    at = [F.struct(F.lit(n).alias("level"), _lon_slot(F.col("_plon"), 8.0 / 2**n).cast("bigint").alias("i"),
                   _lat_slot(F.col("_plat"), 8.0 / 2**n).cast("bigint").alias("j")) for n in levels]
    filed = rows.select("_group", F.explode(F.array(*at)).alias("at")).groupBy("_group", "at").agg(F.count(F.lit(1)).alias("n"))
    return filed.select("_group", "at.level", _cell(F.col("at.i"), F.col("at.j")).alias("cell"),
                        _cell(F.shiftright("at.i", STEP), F.shiftright("at.j", STEP)).alias("up"), "n")


def prepare_places(places: DataFrame, group: str | None = None, place_lon: str = "place_lon", place_lat: str = "place_lat",
                   fid: str = "fid", pyramid: bool = True) -> PlaceIndex:
    """Index of a place table; without `pyramid`, counts are made by the calls that need them."""
    rows = _place_rows(places, group, place_lon, place_lat, fid)
    size = measure(rows)
    unique = size.fits_broadcast and rows.select(fid).distinct().count() == size.rows
    return PlaceIndex(rows, _counts(rows, list(range(LEVELS))) if pyramid else None, size, unique, group)


def save_places(index: PlaceIndex, path: str) -> None:
    index.rows.write.mode("overwrite").parquet(f"{path}/rows")
    counts = _counts(index.rows.sparkSession.read.parquet(f"{path}/rows"), list(range(LEVELS)))
    counts.repartitionByRange("level", "cell").sortWithinPartitions("level", "cell").write.mode("overwrite").parquet(f"{path}/pyramid")
    facts = [(index.size.rows, index.size.bytes, index.unique, index.group)]
    index.rows.sparkSession.createDataFrame(facts, "rows bigint, bytes bigint, unique boolean, grouped string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_places(spark: SparkSession, path: str) -> PlaceIndex:
    facts = spark.read.parquet(f"{path}/facts").first()
    return PlaceIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/pyramid"), Size(facts["rows"], facts["bytes"]), facts["unique"], facts["grouped"])


def _crowded(index: PlaceIndex, level: int, most: int, radius_km: float) -> DataFrame:
    """(_group, _cell): groups of which more places than `most` can be within the radius of a point in the cell."""
    side = SIDES[level]
    reach = radius_km + side * MAX_KM_PER_DEG * 0.71
    lon, lat = F.shiftright("cell", _LAT_BITS) * side - 180 + side / 2, F.col("cell").bitwiseAND(F.lit((1 << _LAT_BITS) - 1)) * side - 90 + side / 2
    counts = index.counts(level)
    # only groups of so many places in all can be a crowd anywhere
    many = written(counts.groupBy("_group").agg(F.sum("n").alias("all")).filter(F.col("all") > most).select("_group"), "large-groups")
    counts = lookup_join(counts, many, ["_group"], "left_semi", spread_by=["cell"])
    spread = counts.select("_group", "n", F.explode(_reach_cells(lon, F.least(lat, F.lit(90.0)), F.lit(reach), side)).alias("_cell"))
    return spread.groupBy("_group", "_cell").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("_group", "_cell")


def _cell_km(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Least and most km from a point to places in the cell (level, cell): bounds, not exact.

    The distance to the centre and the way from there to a corner, along the
    parallel and the meridian.
    """
    side = F.pow(F.lit(2.0), 3 - F.col("level"))
    x = F.shiftright("cell", _LAT_BITS) * side - 180 + side / 2
    y = F.least(F.col("cell").bitwiseAND(F.lit((1 << _LAT_BITS) - 1)) * side - 90 + side / 2, F.lit(90.0))
    way = side / 2 * MAX_KM_PER_DEG * (1 + F.cos(F.radians(y)))
    km = distance_km(lon, lat, x, y)
    known = km.isNotNull() & ~F.isnan(km)
    return F.when(known, F.greatest(km - way, F.lit(0.0))).otherwise(F.lit(0.0)), F.when(known, km + way).otherwise(F.lit(float("inf")))


def _narrowed(front: DataFrame, k: int, radius_km: float, point: str, lon: str, lat: str) -> DataFrame:
    """front (.., _group, level, cell, n) without the cells that k places of nearer ones rule out; adds `_limit`, within which the k-th is, `split` and `again`."""
    near, far = _cell_km(F.col(lon), F.col(lat))
    own = Window.partitionBy(point, "_group")
    filled = F.sum("n").over(own.orderBy("_far", "level", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = front.withColumns({"_near": near, "_far": far}).withColumn("_filled", filled)
    # the k-th place is within this, so no other need be farther
    limit = F.least(F.coalesce(F.min(F.when(F.col("_filled") >= k, F.col("_far"))).over(own), F.lit(float("inf"))), F.lit(radius_km))
    rows = rows.withColumn("_limit", limit).filter(F.col("_near") <= F.col("_limit") + 1e-6)
    rows = rows.withColumn("split", (F.sum("n").over(own) > enough(k)) & (F.col("n") > LEAF) & (F.col("level") + STEP < LEVELS))
    return rows.withColumn("again", F.max("split").over(own)).drop("_near", "_far", "_filled")


def _within(lon: str, lat: str, km: Column) -> Column:
    """Whether a place may be within so many km of the ellipsoid, by the sphere."""
    return sphere_km(F.col(lon), F.col(lat), F.col("_plon"), F.col("_plat")) <= km * (1 + SPHERE_SLACK) + 1e-6


def _dense_pairs(points: DataFrame, crowded: DataFrame, crowded_size: Size, index: PlaceIndex, rows: DataFrame, level: int, k: int,
                 radius_km: float, point: str, lon: str, lat: str, values: list[str] | None) -> DataFrame:
    """Pairs of points (with their _cell) and the groups crowded there, found by way of the pyramid."""
    pyramid = index.pyramid if index.pyramid is not None else written(_counts(index.rows, list(range(level, LEVELS))), "counts")
    if values:
        pyramid = pyramid.filter(F.col("_group.value").isin(*values))
    size = measure(pyramid, fixed_bytes=96)
    cells = F.explode(_reach_cells(F.col(lon), F.col(lat), F.lit(radius_km), SIDES[level]))
    met = lookup_join(points, crowded, ["_cell"], size=crowded_size, spread_by=[point]).drop("_cell").withColumn("cell", cells)
    points = points.drop("_cell")
    front = lookup_join(met, pyramid.filter(F.col("level") == level).drop("up"), ["_group", "cell"], size=size, spread_by=[point])
    columns = [*points.columns, "_group", "level", "cell", "n"]
    found = None
    for _ in range(level, LEVELS, STEP):
        looked = written(_narrowed(front.select(*columns), k, radius_km, point, lon, lat), "front")
        done = looked.filter(~F.col("again")).select(*columns, "_limit")
        found = done if found is None else found.unionByName(done)
        more = looked.filter("again")
        if more.isEmpty():
            break
        down = more.filter("split").select(*points.columns, "_group", (F.col("level") + STEP).alias("level"), F.col("cell").alias("up"))
        finer = lookup_join(down, pyramid, ["_group", "level", "up"], size=size, spread_by=[point])
        front = finer.select(*columns).unionByName(more.filter(~F.col("split")).select(*columns))
    used = sorted(r[0] for r in found.select("level").distinct().collect())
    at = F.array(*[F.struct(F.lit(n).alias("level"), _cell(_lon_slot(F.col("_plon"), 8.0 / 2**n), _lat_slot(F.col("_plat"), 8.0 / 2**n)).alias("cell")) for n in used])
    filed = rows.withColumn("_at", F.explode(at)).select(*rows.columns, "_at.level", "_at.cell") if used else rows.withColumns({"level": F.lit(0), "cell": F.lit(0).cast("bigint")})
    filed_size = Size(index.size.rows * max(len(used), 1), index.size.bytes * max(len(used), 1))
    pairs = lookup_join(found, filed, ["_group", "level", "cell"], size=filed_size, spread_by=[point])
    return pairs.filter(_within(lon, lat, F.col("_limit"))).drop("level", "cell", "n", "_limit")


def _met_by_cell(points: DataFrame, filed: DataFrame, size: Size, point: str) -> tuple[DataFrame, list[str]]:
    """points (.., _cell) with all rows of `filed` for their cell, and the columns by which all rows of a point are in one task.

    A cell of many points is dealt in parts, each with all its places.
    """
    spark, together = points.sparkSession, ["_cell"]
    full = points.groupBy("_cell").count().filter(F.col("count") > CELL_POINTS)
    full = written(full.select("_cell", F.ceil(F.col("count") / CELL_POINTS).alias("_parts")), "full-cells")
    full_size = measure(full, fixed_bytes=32)
    if full_size.rows:
        # only then: a constant would be left out of the join, which would then deal the rows once more
        together = ["_cell", "_salt"]
        points = lookup_join(points, full, ["_cell"], "left", size=full_size, spread_by=[point])
        points = points.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(point), F.col("_parts")), F.lit(0).cast("bigint"))).drop("_parts")
        filed = lookup_join(filed, full, ["_cell"], "left", size=full_size)
        filed = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1))).drop("_parts")
    # the number is set, so that parts of few bytes, which become many pairs, are not merged; a place is in a dozen cells
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(least, min(12 * size.bytes // PLACE_BYTES, MOST_PARTS))
    points, filed = (df.repartition(parts, *together) for df in (points, filed))
    return points.join(filed.hint("merge"), together), together


def _spread_counts(index: PlaceIndex, level: int, radius_km: float) -> DataFrame:
    """(_cell, n): at least as many places as can be within the radius of a point in the cell."""
    side = SIDES[level]
    lon, lat = F.shiftright("cell", _LAT_BITS) * side - 180 + side / 2, F.col("cell").bitwiseAND(F.lit((1 << _LAT_BITS) - 1)) * side - 90 + side / 2
    reach = F.lit(radius_km + side * MAX_KM_PER_DEG * 0.71)
    counts = index.counts(level).groupBy("cell").agg(F.sum("n").alias("n"))
    return counts.select("n", F.explode(_reach_cells(lon, F.least(lat, F.lit(90.0)), reach, side)).alias("_cell")).groupBy("_cell").agg(F.sum("n").alias("n"))


def _array_level(index: PlaceIndex, base: int, radius_km: float) -> int:
    """The coarsest level, at most two above `base`, whose cells do not hold too many places: the coarser, the fewer copies of a place."""
    for level in range(max(0, base - 2), base):
        if (_spread_counts(index, level, radius_km).agg(F.max("n")).first()[0] or 0) <= ARRAY_PLACES:
            return level
    return base


def _ranked_by_cell(points: DataFrame, filed: DataFrame, rows: DataFrame, k: int, radius_km: float, point: str, lon: str, lat: str, group: str | None,
                    fid: str, side: float) -> DataFrame:
    """The k nearest of each group with distance and rank: `filed` are `rows` by `_cell`, all that are in reach of it.

    The places of a cell come first in its task, then its points in any number, so a task
    holds the places of one cell and some points.
    """
    spark = points.sparkSession
    own = points.withColumn("_cell", _cell(_lon_slot(F.col(lon), side), _lat_slot(F.col(lat), side)))
    cells = written(own.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / ARRAY_POINTS).alias("_parts")), "cells")
    size = measure(cells, fixed_bytes=32)
    dealt = cells.agg(F.sum("_parts")).first()[0] or 0
    filed = lookup_join(filed, cells, ["_cell"], size=size, spread_by=["_plon", "_plat"])
    own = lookup_join(own, cells, ["_cell"], size=size, spread_by=[point])
    place, asked = F.struct(*rows.columns), F.struct(*points.columns)
    kinds = {"_r": rows.select(place.alias("_r")).schema["_r"].dataType, "_p": points.select(asked.alias("_p")).schema["_p"].dataType}
    filed = filed.select("_cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_salt"), F.lit(0).alias("_kind"),
                         place.alias("_r"), F.lit(None).cast(kinds["_p"]).alias("_p"))
    own = own.select("_cell", F.pmod(F.xxhash64(point), F.col("_parts")).alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast(kinds["_r"]).alias("_r"), asked.alias("_p"))
    # the number is set: few bytes here are much work
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    both = filed.unionByName(own).repartition(min(max(least, 2 * dealt), MOST_PARTS), "_cell", "_salt").sortWithinPartitions("_cell", "_salt", "_kind")
    kept = [i for i, c in enumerate(rows.columns) if c != "_group"]
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*kinds["_p"].fields, *(kinds["_r"].fields[i] for i in kept)]]
                       + [T.StructField("distance_km", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    at = {c: rows.columns.index(c) for c in ("_plon", "_plat", fid, *([group] if group else []))}
    own_lon, own_lat = points.columns.index(lon), points.columns.index(lat)
    names = [f.name for f in out.fields]

    def run(batches):
        now, places, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("_cell", "_salt", "_kind")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:]):
                if (keys[0, a], keys[1, a]) != now:
                    now, places, ready = (keys[0, a], keys[1, a]), [], None
                if keys[2, a] == 0:
                    places.append(batch.column("_r").slice(a, b - a))
                elif places:
                    if ready is None:
                        ready = prepared(pa.concat_arrays(places))
                    yield from answered(ready, batch.column("_p").slice(a, b - a))

    def prepared(place):
        columns = place.flatten()
        codes = columns[at[group]].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if group else np.zeros(len(place), np.int64)
        order = np.argsort(codes, kind="stable")
        place = place.take(pa.array(order))
        columns = place.flatten()
        x, y = (columns[at[c]].to_numpy(zero_copy_only=False) for c in ("_plon", "_plat"))
        # ids in order, null first
        ids = columns[at[fid]].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return place, codes[order], x, y, ids, _on_sphere(x, y)

    def answered(ready, asked):
        place, codes, px, py, ids, on = ready
        columns = asked.flatten()
        x, y = (columns[i].to_numpy(zero_copy_only=False) for i in (own_lon, own_lat))
        for some in _slices(x, y):
            for i, j in _near_pairs(_on_sphere(x[some], y[some]), on, codes, k, radius_km):
                i = some[i]
                km, _ = vincenty(x[i], y[i], px[j], py[j])
                order = np.lexsort((ids[j], np.where(np.isnan(km), np.inf, km), codes[j], i))
                i, j, km = i[order], j[order], km[order]
                fresh = np.ones(len(i), bool)
                fresh[1:] = (i[1:] != i[:-1]) | (codes[j[1:]] != codes[j[:-1]])
                number = np.arange(len(i))
                rank = number - np.maximum.accumulate(np.where(fresh, number, 0)) + 1
                good = (rank <= k) & (km <= radius_km)
                i, j = pa.array(i[good]), pa.array(j[good])
                found = place.take(j).flatten()
                yield pa.RecordBatch.from_arrays([*asked.take(i).flatten(), *(found[n] for n in kept), pa.array(km[good]), pa.array(rank[good].astype(np.int32))], names)

    return both.mapInArrow(run, out)


def _on_sphere(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _slices(lon: np.ndarray, lat: np.ndarray):
    """Positions of points close to each other, some at a time; those without a place on the globe are left out."""
    known = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
    i, j = np.floor(lon[known] * 2), np.floor(lat[known] * 2)
    order = np.lexsort((i, j))
    known, i, j = known[order], i[order], j[order]
    ends = np.flatnonzero(np.append((i[1:] != i[:-1]) | (j[1:] != j[:-1]), True)) + 1 if len(known) else []
    start = 0
    for end in ends:
        for a in range(start, end, ARRAY_SLICE):
            yield known[a:min(a + ARRAY_SLICE, end)]
        start = end


def _near_pairs(q: np.ndarray, on: np.ndarray, codes: np.ndarray, k: int, radius_km: float):
    """Positions (point, place) on the sphere that may be among the k nearest of a group (equal `codes`, which rise) on the ellipsoid and within the radius.

    A place among the k nearest is no farther than the k-th, and either distance turns into
    a bound of the other by the slack. A point's pairs come together.
    """
    def square(angle):  # of the chord, and a little more than its rounding
        return 4 * np.sin(np.minimum(angle, np.pi) / 2) ** 2 + 1e-13

    slack, tiny = 1 + SPHERE_SLACK, 1e-6 / MEAN_RADIUS_KM
    reach = radius_km * slack / MEAN_RADIUS_KM + tiny
    middle = q.mean(axis=0)
    long = np.linalg.norm(middle)
    spread = np.inf if long < 0.5 else np.arccos(np.clip(q @ (middle / long), -1, 1)).max() + 1e-7
    around = np.arange(len(on)) if reach + spread >= np.pi else np.flatnonzero(on @ (middle / long) >= np.cos(reach + spread) - 1e-12)
    if not len(around):
        return
    on, own = on[around], codes[around]
    edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    step = max(1, ARRAY_PRODUCTS // len(around))
    for at in range(0, len(q), step):
        chord = 2 - 2 * (q[at:at + step] @ on.T)
        limit, i, j = np.full(len(chord), square(reach)), [], []
        for a, b in zip(edges, edges[1:]):
            bound = limit
            if b - a > k:
                last = np.maximum(np.partition(chord[:, a:b], k - 1, axis=1)[:, k - 1], 0) + 1e-13
                bound = np.minimum(limit, square(2 * np.arcsin(np.minimum(np.sqrt(last) / 2, 1)) * slack * slack + tiny))
            r, c = np.nonzero(chord[:, a:b] <= bound[:, None])
            i.append(r + at), j.append(around[c + a])
        yield np.concatenate(i), np.concatenate(j)


def candidate_pairs(points: DataFrame, index: PlaceIndex, rows: DataFrame, k: int, radius_km: float, point: str, lon: str, lat: str,
                    values: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a place that may be among its k nearest: all of those, and of a crowd few more than `enough`."""
    parts = _pair_parts(points, index, rows, k, radius_km, point, lon, lat, values)
    return reduce(DataFrame.unionByName, [pairs.select(*points.columns, *rows.columns) for pairs, _ in parts])


def _pair_parts(points: DataFrame, index: PlaceIndex, rows: DataFrame, k: int, radius_km: float, point: str, lon: str, lat: str,
                values: list[str] | None, ranked_as: tuple[str | None, str] | None = None) -> list[tuple[DataFrame, list[str] | None]]:
    """`candidate_pairs` in parts, each with the columns besides the point by which its rows lie together; a point and group is in one part.

    With `ranked_as` (group, id), the pairs of dealt places are the k nearest, with distance and rank; None stands for their columns.
    """
    base = SIDES.index(_side_for(radius_km))
    size, side = index.size, SIDES[base]
    most = enough(k) if size.fits_broadcast else max(enough(k), DEALT_CROWD)
    crowded = _crowded(index, base, most, radius_km) if size.rows > most else None
    if crowded is not None and values:
        crowded = crowded.filter(F.col("_group.value").isin(*values))
    crowded = written(crowded, "crowded") if crowded is not None else None
    crowded_size = measure(crowded, fixed_bytes=48) if crowded is not None else Size(0, 0)
    shown = [*points.columns, *rows.columns]
    marked = points.withColumn("_cell", _cell(_lon_slot(F.col(lon), side), _lat_slot(F.col(lat), side)))
    dense = []
    if crowded_size.rows:
        found = _dense_pairs(marked, crowded, crowded_size, index, rows, base, k, radius_km, point, lon, lat, values)
        dense = [(found.filter(_within(lon, lat, F.lit(radius_km))).select(*shown), [])]
    if not size.fits_broadcast:
        # places go to all cells they can be reached from, points to their own: a point's pairs are cut to k where they are made
        if ranked_as is not None and not crowded_size.rows:
            side = SIDES[_array_level(index, base, radius_km)]
        filed = rows.withColumn("_cell", F.explode(_reach_cells(F.col("_plon"), F.col("_plat"), F.lit(float(radius_km)), side)))
        if crowded_size.rows:
            filed = lookup_join(filed, crowded, ["_group", "_cell"], "left_anti", size=crowded_size, spread_by=["_plon", "_plat"])
        if ranked_as is not None:
            return [(_ranked_by_cell(points, filed, rows, k, radius_km, point, lon, lat, *ranked_as, side), None), *dense]
        pairs, together = _met_by_cell(marked, filed, size, point)
        return [(pairs.filter(_within(lon, lat, F.lit(radius_km))), together), *dense]
    plain = points
    if crowded_size.rows:
        groups = rows.select("_group").distinct().count()
        full = crowded.groupBy("_cell").count().filter(F.col("count") >= groups).select("_cell")
        plain = lookup_join(marked, full, ["_cell"], "left_anti", size=crowded_size, spread_by=[point]).select(*points.columns)
    filed = rows.withColumn("_cell", _cell(_lon_slot(F.col("_plon"), side), _lat_slot(F.col("_plat"), side)))
    asked = plain.withColumn("_cell", F.explode(_reach_cells(F.col(lon), F.col(lat), F.lit(float(radius_km)), side)))
    pairs = lookup_join(asked, filed, ["_cell"], size=size, spread_by=[point]).drop("_cell")
    pairs = pairs.filter(_within(lon, lat, F.lit(radius_km)))
    if crowded_size.rows:
        # groups that are not crowded around a point meet it in full, the others by way of their counts
        own = _cell(_lon_slot(F.col(lon), side), _lat_slot(F.col(lat), side))
        pairs = lookup_join(pairs.withColumn("_cell", own), crowded, ["_group", "_cell"], "left_anti", size=crowded_size, spread_by=[point]).select(*shown)
    return [(pairs.select(*shown), []), *dense]


def nearest(points: DataFrame, places: DataFrame | PlaceIndex, k: int, radius_km: float, carry: list[str],
            group: str | None = None, values: list[str] | None = None, point: str = "point_id",
            lon: str = "lon", lat: str = "lat", place_lon: str = "place_lon", place_lat: str = "place_lat",
            fid: str = "fid") -> DataFrame:
    """Up to k nearest places per point (and per `group` value) within `radius_km`.

    Adds the carried columns, `distance_km` and `rank` (1 = nearest, ties by
    id). `group` keeps a separate ranking per value of that column, null being
    a value like any other; `values` names the values wanted. `places` may be an
    index prepared for the same `group`, which saves counting them again.

    Two exact reductions keep dense areas affordable: of places at one spot
    only the k with the smallest ids can be among the nearest, and crowds are
    searched by way of their counts.
    """
    k = max(1, k)
    keys = [group] if group else []
    if not isinstance(places, PlaceIndex):
        if group and values:
            places = places.filter(F.col(group).isin(*values))
        places = prepare_places(places, group, place_lon, place_lat, fid, pyramid=False)
    elif places.group != group:
        raise ValueError(f"places are prepared for group {places.group!r}, not {group!r}")
    index, size = places, places.size
    columns = list(dict.fromkeys([*keys, fid, *carry]))
    rows = index.rows.filter(F.col("_copy") <= k)
    if group and values:
        rows = rows.filter(F.col(group).isin(*values))
    rows = rows.select(*columns, "_group", "_plon", "_plat")
    located = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())

    details = None
    if size.fits_broadcast:
        # without a shuffle by cell, a few input splits would do all the work
        located = spread_for_work(located, point)
        extra = [c for c in columns if c not in (*keys, fid)]
        if extra and index.unique:
            # ranked rows carry ids only; the other columns join the k that remain
            details = F.broadcast(rows.select(F.col(fid).alias("_id"), *extra))
            rows = rows.drop(*extra)

    def ranked(pairs: DataFrame, together: list[str]) -> DataFrame:
        own = Window.partitionBy(*together, point, *keys).orderBy(F.col("distance_km").asc_nulls_last(), fid)
        hits = pairs.withColumn("distance_km", distance_km(F.col(lon), F.col(lat), F.col("_plon"), F.col("_plat")))
        if not size.fits_broadcast and not together:
            # brought together by point once: the ranks and later joins on the point find the rows in place
            hits = hits.repartition(point)
        # what is beyond the radius comes last and is cut after the ranks; a filter before them would measure every pair twice
        return hits.withColumn("rank", F.row_number().over(own)).filter((F.col("rank") <= k) & (F.col("distance_km") <= radius_km)).drop(*together)

    # ids that are no integers are left to the ranks of the plan
    arrays = size.rows >= ARRAY_ROWS and isinstance(rows.schema[fid].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    found = _pair_parts(located, index, rows, k, float(radius_km), point, lon, lat, values, (group, fid) if arrays else None)
    shown = [*points.columns, *rows.drop("_group").columns, "distance_km", "rank"]
    hits = reduce(DataFrame.unionByName, [(pairs if together is None else ranked(pairs, together)).select(*shown) for pairs, together in found])
    if details is not None:
        hits = hits.join(details, F.col(fid).eqNullSafe(F.col("_id")))
    return hits.select(
        *points.columns, *columns,
        F.col("_plon").alias(place_lon), F.col("_plat").alias(place_lat), "distance_km", "rank",
    )
