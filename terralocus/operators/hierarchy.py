"""Administrative chains: level meanings, ancestors, countries, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.attributes import level_number
from ..session import cut_lineage
from .skew import lookup_join

MAX_DEPTH = 32


def level_meanings(raw: DataFrame, equivalents: DataFrame) -> DataFrame:
    """Sidecar rows (country_iso, level, local_term, equivalent) with descriptions.

    Entries without an equivalent are ignored; one that `equivalents`
    (equivalent, description) does not define raises.
    """
    used = raw.filter(F.coalesce("equivalent", F.lit("")) != "")
    stray = used.join(equivalents, "equivalent", "left_anti").select("country_iso", "level", "equivalent").limit(1).collect()
    if stray:
        row = stray[0]
        raise ValueError(f"country {row[0]} level {row[1]}: equivalent {row[2]!r} is not defined")
    return used.join(equivalents, "equivalent", "left").select(
        "country_iso", "level", "equivalent", "description", "local_term")


def with_meaning(units: DataFrame, meanings: DataFrame, country: str = "country_iso", level: str = "level") -> DataFrame:
    """Adds equivalent, description, local_term; NULL where the sidecar is silent."""
    table = meanings.select(F.col("country_iso").alias(country), F.col("level").alias(level),
                            "equivalent", "description", "local_term")
    return lookup_join(units, table, [country, level], "left")


def with_provenance(rows: DataFrame, sources: DataFrame, code: str = "name_source") -> DataFrame:
    """Adds short, long, standard for a code; unknown codes keep only the code."""
    table = sources.select(F.col("code").alias(code), "short", "long", "standard")
    out = lookup_join(rows, table, [code], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("short", "long", "standard")})


def provenance_codes(*groups: Column) -> Column:
    """Distinct non-empty codes in first-seen order."""
    return F.array_distinct(F.filter(F.concat(*groups), lambda c: c.isNotNull() & (c != "")))


def stored_level(text: Column) -> Column:
    """Level of a chain row: the leading integer of the text, 0 without one."""
    return F.coalesce(F.regexp_extract(text.cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def ancestor_closure(admin: DataFrame, fid: str = "fid", parent: str = "parent_id") -> DataFrame:
    """(fid, anc_fid, depth) of every unit and ancestor, the unit itself at depth 0.

    A parent of NULL or 0, or one that is not in the table, ends a chain; depth
    32 ends a cycle. Chains are doubled per round, so a tree of depth d takes
    log2(d) joins; each round is written out and the loop ends with the tree.
    """
    units = admin.select(F.col(fid).alias("fid"), F.coalesce(F.col(parent), F.lit(0)).cast("bigint").alias("anc_fid"))
    up = units.filter(F.col("anc_fid") != 0)
    known = units.select(F.col("fid").alias("anc_fid"))
    pairs = cut_lineage(lookup_join(up, known, ["anc_fid"], "left_semi", spread_by=["fid"]).withColumn("depth", F.lit(1)))
    reach = 1
    while reach < MAX_DEPTH:
        tips = pairs.filter(F.col("depth") == reach)
        if tips.isEmpty():
            break
        further = pairs.select(F.col("fid").alias("_tip"), F.col("anc_fid").alias("_anc"), F.col("depth").alias("_more"))
        longer = lookup_join(tips.withColumnRenamed("anc_fid", "_tip"), further, ["_tip"], spread_by=["fid"])
        longer = longer.select("fid", F.col("_anc").alias("anc_fid"), (F.col("depth") + F.col("_more")).alias("depth"))
        pairs = cut_lineage(pairs.unionByName(longer.filter(F.col("depth") <= MAX_DEPTH)))
        reach *= 2
    own = units.select("fid", F.col("fid").alias("anc_fid"), F.lit(0).alias("depth"))
    return own.unionByName(pairs)


def resolve_chain(starts: DataFrame, admin: DataFrame, closure: DataFrame, start: str = "fid") -> DataFrame:
    """(start columns, depth, anc_fid, parent_id, level, name, country_iso), most local first by depth."""
    chain = lookup_join(starts, closure.withColumnRenamed("fid", start) if start != "fid" else closure, [start])
    units = admin.select(
        F.col("fid").alias("anc_fid"), F.coalesce("parent_id", F.lit(0)).cast("bigint").alias("parent_id"),
        stored_level(F.col("admin_level")).alias("level"), "name", "country_iso")
    return lookup_join(chain, units, ["anc_fid"])


def tier_ancestors(admin: DataFrame, closure: DataFrame, meanings: DataFrame, tier: str) -> DataFrame:
    """(fid, tier_fid): the first unit of a chain whose level means `tier`."""
    units = admin.select(F.col("fid").alias("anc_fid"), "country_iso", stored_level(F.col("admin_level")).alias("level"))
    of_tier = with_meaning(units, meanings).filter(F.col("equivalent") == tier).select("anc_fid")
    chain = lookup_join(closure, of_tier, ["anc_fid"], "left_semi", spread_by=["fid"])
    return chain.groupBy("fid").agg(F.min_by("anc_fid", "depth").alias("tier_fid"))


def admin_summary(admin_hits: DataFrame, meanings: DataFrame, tier: str = "", point: str = "point_id") -> DataFrame:
    """All a point needs from the units that cover it, from one grouped pass.

    (point, country_iso, hierarchy, point_country, point_tier):
    * hierarchy: units whose level is a number, most local first, then by name;
      empty when there is none
    * country_iso: the most local numbered unit's code, smaller code on ties
    * point_country: the same with levels that are no number ranking last
    * point_tier: the covering unit whose level means `tier`, smallest id first
    """
    units = with_meaning(admin_hits.withColumn("level", level_number(F.col("admin_level"))), meanings)
    numbered = F.col("level").isNotNull()
    has_code = F.coalesce("country_iso", F.lit("")) != ""

    def code_where(hit: Column, level: Column) -> Column:
        return F.min_by(F.when(hit, F.col("country_iso")), F.when(hit, F.struct(-level, F.col("country_iso"))))

    entry = F.struct(
        (-F.col("level")).alias("order"), F.col("name"), F.col("fid"), F.col("level"), F.col("name_native"),
        F.col("name_source"), F.col("equivalent"), F.col("local_term"), F.col("description"))
    grouped = units.groupBy(point).agg(
        code_where(numbered & (F.col("level") >= 0) & has_code, F.col("level")).alias("country_iso"),
        F.array_sort(F.collect_list(F.when(numbered, entry))).alias("_chain"),
        code_where(has_code, F.coalesce("level", F.lit(-1))).alias("point_country"),
        F.min(F.when(numbered & (F.col("equivalent") == tier) & F.lit(tier != ""), F.col("fid"))).alias("point_tier"),
    )
    chain = F.transform("_chain", lambda u: F.struct(
        u["level"].alias("level"), u["name"].alias("name"), u["name_native"].alias("name_native"),
        u["name_source"].alias("name_source"),
        *[F.coalesce(u[c], F.lit("")).alias(c) for c in ("equivalent", "local_term", "description")]))
    return grouped.select(point, F.coalesce("country_iso", F.lit("")).alias("country_iso"), chain.alias("hierarchy"),
                          "point_country", "point_tier")


def point_tiers(admin_hits: DataFrame, meanings: DataFrame, tier: str, point: str = "point_id") -> DataFrame:
    """(point, tier_fid) of the points a unit of the tier covers."""
    return admin_summary(admin_hits, meanings, tier, point).filter(F.col("point_tier").isNotNull()).select(
        point, F.col("point_tier").alias("tier_fid"))


def point_countries(admin_hits: DataFrame, point: str = "point_id") -> DataFrame:
    """(point, country_iso) of the most local covering unit with an ISO code.

    Levels that are no number rank -1; ties go to the smaller code.
    """
    level = F.coalesce(level_number(F.col("admin_level")), F.lit(-1))
    return (admin_hits.filter(F.coalesce("country_iso", F.lit("")) != "")
            .groupBy(point).agg(F.min_by("country_iso", F.struct(-level, F.col("country_iso"))).alias("country_iso")))


def locate(admin_hits: DataFrame, meanings: DataFrame, point: str = "point_id") -> DataFrame:
    """(point, country_iso, hierarchy) for every covered point."""
    return admin_summary(admin_hits, meanings, point=point).select(point, "country_iso", "hierarchy")
