"""Nested answers compared field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage


def _leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """ARRAY<STRUCT<path, value>> of everything below a value; empty and missing values are leaves of their own."""
    own = F.array(F.struct(path.alias("path"), value.cast("string").alias("value") if isinstance(kind, T.AtomicType) else
                           F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")))).alias("value")))
    if isinstance(kind, T.StructType):
        fields = [_leaves(value.getField(f.name), f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
        inside = F.concat(*fields) if fields else own
        return F.when(value.isNull(), F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("value")))).otherwise(inside)
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda v, i: _leaves(v, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(F.coalesce(F.size(value), F.lit(0)) <= 0, F.array(F.struct(
            path.alias("path"), F.when(value.isNotNull(), F.lit("[]")).alias("value")))).otherwise(F.flatten(each))
    return own


def leaves(answers: DataFrame, key: str) -> DataFrame:
    """(key, path, value): one row per field of every answer, `path` such as `admin.hierarchy[0].name`."""
    return answers.select(key, F.explode(_all_leaves(answers, key)).alias("leaf")).select(key, "leaf.*")


def _all_leaves(answers: DataFrame, key: str, row: str | None = None) -> Column:
    at = lambda n: F.col(f"{row}.`{n}`" if row else f"`{n}`")
    return F.concat(*[_leaves(at(f.name), f.dataType, F.lit(f.name)) for f in answers.schema.fields if f.name != key])


def answer_differences(expected: DataFrame, found: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, path, kind, expected, found) of all fields that differ; empty means verified.

    kind: `missing` and `added` fields or whole answers, `changed` values. Numbers
    are compared as they print. Answers meet once by key, equal ones go no
    further, and only what differs is taken apart. Columns of either side that the
    other lacks count as fields; keys are unique on each side, null keys meet.
    """
    side = lambda answers, name: answers.select(F.col(key).alias(f"{name}_key"), F.lit(True).alias(f"in_{name}"), _all_leaves(answers, key).alias(name))
    both = side(expected, "expected").join(side(found, "found"), F.col("expected_key").eqNullSafe(F.col("found_key")), "full")
    both = both.filter(~F.col("expected").eqNullSafe(F.col("found"))).withColumn(
        key, F.when(F.col("in_expected"), F.col("expected_key")).otherwise(F.col("found_key")))
    whole = F.col("in_expected").isNull() | F.col("in_found").isNull()
    lone = both.filter(whole).select(key, F.lit("").alias("path"), F.when(F.col("in_found").isNull(), F.lit("missing")).otherwise(F.lit("added")).alias("kind"),
                                     F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("found"))
    shared = both.filter(~whole)
    # each side's leaves by path; a path stands once on a side
    paths = F.array_union(F.transform("expected", lambda x: x["path"]), F.transform("found", lambda x: x["path"]))
    as_map = lambda c: F.map_from_entries(F.col(c))
    looked = shared.select(key, F.explode(paths).alias("path"), as_map("expected").alias("e"), as_map("found").alias("f"))
    told = looked.select(key, "path", F.when(~F.map_contains_key("f", F.col("path")), F.lit("missing")).when(
        ~F.map_contains_key("e", F.col("path")), F.lit("added")).otherwise(F.lit("changed")).alias("kind"),
        F.try_element_at("e", F.col("path")).alias("expected"), F.try_element_at("f", F.col("path")).alias("found"))
    return told.filter((F.col("kind") != "changed") | ~F.col("expected").eqNullSafe(F.col("found"))).unionByName(lone)
