"""Rings, edges, boundary-inclusive containment and WKT.

A polygon (or multipolygon) is ARRAY<ARRAY<STRUCT<x,y>>>: every closed ring of
every part. Holes need no marking, parity handles them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EDGES_TYPE = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*corners: tuple[Column, Column]) -> Column:
    """A closed ring from its corners; the first corner is repeated at the end."""
    return F.array(*[vertex(x, y) for x, y in (*corners, corners[0])])


def rectangle(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(ring((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)))


def edges(rings: Column) -> Column:
    """All segments of all rings."""
    def of_ring(r: Column) -> Column:
        n = F.size(r) - 1
        return F.zip_with(
            F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n),
            lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
        )
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), of_ring))


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def _cross(e: Column, x: Column, y: Column) -> Column:
    return (e["bx"] - e["ax"]) * (y - e["ay"]) - (x - e["ax"]) * (e["by"] - e["ay"])


def covers(segments: Column, x: Column, y: Column, crossed: Column | None = None) -> Column:
    """TRUE inside, on the outer boundary and on a hole's boundary.

    One pass over the segments: the running value is -1 once the point lies
    on a segment, otherwise the parity of crossings of the ray towards +x.
    Both tests use the sign of the same cross product. `crossed` is the parity
    of what the ray meets beyond these segments.
    """
    def step(state: Column, e: Column) -> Column:
        c = _cross(e, x, y)
        on_edge = (
            (c == 0)
            & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
            & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        )
        spans = (e["ay"] <= y) != (e["by"] <= y)
        crosses = spans & ((c > 0) == (e["by"] > e["ay"]))
        return (F.when((state < 0) | on_edge, F.lit(-1))
                .when(crosses, 1 - state)
                .otherwise(state))
    return F.aggregate(segments, F.lit(0) if crossed is None else crossed, step) != 0


def polygon_wkt(rings: Column) -> Column:
    """WKT of rings that form one polygon (outer ring first)."""
    def text(v: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", v), r"\.?0+$", ""), "^-0$", "0")
    def of_ring(r: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", text(p["x"]), text(p["y"]))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, of_ring), ", "), F.lit(")"))


def point_wkt(x: Column, y: Column, z: Column | None = None) -> Column:
    """POINT text with six decimals; POINT Z when a non-zero height is given."""
    flat = F.format_string("POINT(%.6f %.6f)", x, y)
    if z is None:
        return flat
    return F.when(F.coalesce(z, F.lit(0.0)) != 0, F.format_string("POINT Z(%.6f %.6f %.6f)", x, y, z)).otherwise(flat)


def wkt_type(text: Column) -> Column:
    """What stands before the first parenthesis; empty when there is none."""
    head = F.instr(text, "(")
    return F.when(head > 1, F.trim(F.substring_index(text, "(", 1))).otherwise(F.lit(""))


def parse_point(text: Column) -> Column:
    """STRUCT<lon,lat> of the first two numbers in the first parentheses, or NULL."""
    body = F.regexp_extract(text, r"^[^()]*\(([^)]*)\)", 1)
    fields = F.split(F.trim(F.regexp_replace(body, r"\s+", " ")), " ")
    lon = F.get(fields, 0).try_cast("double")
    lat = F.get(fields, 1).try_cast("double")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def _class_of(kind: Column, names: list[str]) -> Column:
    return F.upper(kind).isin(*names)


def is_point_type(kind: Column) -> Column:
    return _class_of(kind, ["POINT", "MULTIPOINT"])


def is_line_type(kind: Column) -> Column:
    return _class_of(kind, ["LINESTRING", "MULTILINESTRING"])


def is_polygon_type(kind: Column) -> Column:
    return _class_of(kind, ["POLYGON", "MULTIPOLYGON"])
