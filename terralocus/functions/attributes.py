"""Typed reads of loosely typed attributes, ids, licences, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

# Reference systems known by name.
KNOWN_SRIDS = {
    4326: "WGS 84",
    3857: "Web Mercator",
    25832: "ETRS89 / UTM zone 32N",
    25833: "ETRS89 / UTM zone 33N",
    31466: "DHDN / Gauß-Krüger zone 2",
    31467: "DHDN / Gauß-Krüger zone 3",
}
# Place classes, smallest first, and file endings of sources.
PLACE_CLASSES = ["village", "town", "city"]
SOURCE_ENDINGS = [".gpkg", ".zip"]


def string_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def string_property(df: DataFrame, name: str) -> Column:
    """Text of a text column; empty for NULL and for every other type."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.coalesce(F.col(name), F.lit(""))
    return F.lit("")


def int_property(df: DataFrame, name: str) -> Column:
    """Whole part of a numeric column; 0 for NULL and for every other type."""
    if _is_number(df, name):
        return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.lit(0).cast("bigint")


def float_property(df: DataFrame, name: str) -> Column:
    """Numeric column as DOUBLE; 0 for NULL and for every other type."""
    if _is_number(df, name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def level_number(text: Column) -> Column:
    """Admin level as INT; NULL unless the text is a plain signed integer."""
    return F.when(text.cast("string").rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def class_rank(token: Column) -> Column:
    """0 unknown, 1 village, 2 town, 3 city."""
    out = F.lit(0)
    for rank, name in enumerate(PLACE_CLASSES, start=1):
        out = F.when(token == name, rank).otherwise(out)
    return out


def epsg_code(text: Column) -> Column:
    """n of 'EPSG:n', NULL for anything else."""
    return F.regexp_extract(text, r"^EPSG:([0-9]+)$", 1).try_cast("int")


def is_known_srid(srid: Column) -> Column:
    return srid.isin(*KNOWN_SRIDS)


def source_id(path: Column) -> Column:
    """File stem; a name that is only an ending stays whole."""
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    stem = F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)
    # trailing slashes alone name the root folder
    only_root = path.rlike("^/+$")
    return F.when(only_root, F.lit("/")).when(base == ".", F.lit("")).when(stem == "", base).otherwise(stem)


def is_source_file(name: Column) -> Column:
    lowered = F.lower(name)
    hit = lowered.endswith(SOURCE_ENDINGS[0])
    for ending in SOURCE_ENDINGS[1:]:
        hit = hit | lowered.endswith(ending)
    return hit


def license_is_empty(name: Column, url: Column, attribution: Column) -> Column:
    return (string_or_empty(name) == "") & (string_or_empty(url) == "") & (string_or_empty(attribution) == "")


def license_text(name: Column, attribution: Column) -> Column:
    return F.coalesce(F.nullif(attribution, F.lit("")), string_or_empty(name))


def license_struct(name: Column, url: Column, attribution: Column) -> Column:
    """STRUCT<name,url,attribution>, NULL when every part is empty."""
    return F.when(
        ~license_is_empty(name, url, attribution),
        F.struct(name.alias("name"), url.alias("url"), attribution.alias("attribution")),
    )


def has_keyword(keywords: Column, word: str) -> Column:
    return F.coalesce(F.array_contains(keywords, word), F.lit(False))


def custom_value(custom: Column, key: str) -> Column:
    return F.try_element_at(custom, F.lit(key))


def extent_struct(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Bounding box struct, NULL when all four values are zero or any is missing."""
    all_zero = (min_x == 0) & (min_y == 0) & (max_x == 0) & (max_y == 0)
    return F.when(
        ~all_zero,
        F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y")),
    )


def extent_contains(min_x: Column, min_y: Column, max_x: Column, max_y: Column, x: Column, y: Column) -> Column:
    return x.between(min_x, max_x) & y.between(min_y, max_y)


def extent_measures(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> dict[str, Column]:
    return {
        "valid": (min_x <= max_x) & (min_y <= max_y),
        "width": F.abs(max_x - min_x),
        "height": F.abs(max_y - min_y),
        "center_x": (min_x + max_x) / 2,
        "center_y": (min_y + max_y) / 2,
    }
