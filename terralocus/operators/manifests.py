"""Rule checks over manifests and legends held as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of the bundle contract.
ID_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"
CRS_PATTERN = r"^EPSG:[0-9]+$"
FILE_PATTERN = r"^[^/].*\.tiff?$"
SIDECAR_PATTERN = r"^[^/].*\.(ya?ml|json)$"
KEY_PATTERN = r"^-?(0|[1-9][0-9]*)$"
MAX_ID = 128
GAZETTEER_REQUIRED = [
    "places_layer", "places_rank_column", "places_name_column", "places_admin_fk", "admin_layer",
    "admin_level_column", "admin_name_column", "admin_parent_fk", "country_column",
]
# The group of a code's first letter.
LEGEND_GROUPS = {"A": "Tropical", "B": "Arid", "C": "Temperate", "D": "Cold", "E": "Polar"}


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _broken(rules: dict[str, Column]) -> Column:
    """ARRAY<STRING> of the names of the rules that hold."""
    return F.filter(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in rules.items()]),
                    lambda r: r.isNotNull())


def raster_violations(manifests: DataFrame, layers: DataFrame) -> DataFrame:
    """(source_id, layer_id, rule) for every broken rule; layer_id NULL for bundle rules.

    `manifests(source_id, schema_version, id, name, license_name, crs, layer_count)`,
    `layers(source_id, layer_id, file, tiles_dir, tiles_pattern, grid_deg, band, sampling,
    value_type, mapping_keys ARRAY<STRING>, value_mapping)`.
    """
    bundle = {
        "schema_version": F.coalesce("schema_version", F.lit(0)) != 1,
        "id_pattern": _empty("id") | ~F.col("id").rlike(ID_PATTERN) | (F.length("id") > MAX_ID),
        "id_is_stem": F.coalesce("id", F.lit("")) != F.col("source_id"),
        "name_required": _empty("name"),
        "license_required": _empty("license_name"),
        "crs_pattern": _empty("crs") | ~F.col("crs").rlike(CRS_PATTERN),
        "layers_required": F.coalesce("layer_count", F.lit(0)) < 1,
    }
    has_file, has_tiles = ~_empty("file"), ~_empty("tiles_dir") | ~_empty("tiles_pattern")
    continuous = F.coalesce("value_type", F.lit("categorical")) == "continuous"
    has_map, has_sidecar = F.col("mapping_keys").isNotNull(), ~_empty("value_mapping")
    layer = {
        "layer_id_pattern": _empty("layer_id") | ~F.col("layer_id").rlike(ID_PATTERN) | (F.length("layer_id") > MAX_ID),
        "file_xor_tiles": has_file == has_tiles,
        "file_pattern": has_file & ~F.col("file").rlike(FILE_PATTERN),
        "tiles_complete": has_tiles & (_empty("tiles_dir") | _empty("tiles_pattern") | F.col("tiles_dir").startswith("/")),
        "tiles_grid": has_tiles & (F.coalesce("grid_deg", F.lit(1)) < 1),
        "tiles_continuous": has_tiles & ~continuous,
        "continuous_without_mapping": continuous & (has_map | has_sidecar),
        "mapping_xor_sidecar": ~continuous & (has_map == has_sidecar),
        "sidecar_pattern": has_sidecar & ~F.col("value_mapping").rlike(SIDECAR_PATTERN),
        "mapping_keys": has_map & (F.size("mapping_keys") == 0) | F.exists("mapping_keys", lambda k: ~k.rlike(KEY_PATTERN)),
        "band": F.coalesce("band", F.lit(1)) < 1,
        "sampling": ~F.coalesce(F.nullif(F.col("sampling"), F.lit("")), F.lit("nearest")).isin("nearest"),
        "value_type": ~F.coalesce("value_type", F.lit("categorical")).isin("categorical", "continuous"),
    }
    of_bundles = manifests.select("source_id", F.lit(None).cast("string").alias("layer_id"), F.explode(_broken(bundle)).alias("rule"))
    of_layers = layers.select("source_id", "layer_id", F.explode(_broken(layer)).alias("rule"))
    twice = (layers.groupBy("source_id", "layer_id").count().filter("count > 1")
             .select("source_id", "layer_id", F.lit("layer_id_unique").alias("rule")))
    return of_bundles.unionByName(of_layers).unionByName(twice)


def gazetteer_violations(manifests: DataFrame) -> DataFrame:
    """(source_id, rule): required mappings that are missing."""
    rules = {f"missing {name}": _empty(name) for name in GAZETTEER_REQUIRED}
    return manifests.select("source_id", F.explode(_broken(rules)).alias("rule"))


def parse_legend(lines: DataFrame, line: str = "line", keys: list[str] | None = None, check: bool = True) -> DataFrame:
    """(keys.., value, code, description, group, color) of the lines that are legend rows.

    With `check`, no rows at all or a value given twice (per key) raises.
    """
    keys = keys or []
    blank = r"\s+"
    whole = F.btrim(F.regexp_replace(F.col(line), blank, " "))
    # value : code description [red green blue]
    value, rest = F.btrim(F.substring_index(whole, ":", 1)), F.btrim(F.substr(whole, F.instr(whole, ":") + 1))
    opened = F.locate("[", F.reverse(rest))  # the last bracket, counted from the end
    named = F.split(F.btrim(F.substr(rest, F.lit(1), F.length(rest) - opened)), " ", 2)
    colors = F.split(F.btrim(F.translate(F.substring_index(rest, "[", -1), "]", "")), " ")
    parsed = lines.select(
        *keys, value.try_cast("bigint").alias("value"),
        F.get(named, 0).alias("code"), F.btrim(F.get(named, 1)).alias("description"),
        F.transform(colors, lambda c: c.try_cast("int")).alias("_colors"),
        (F.contains(whole, F.lit(":")) & F.endswith(rest, F.lit("]")) & (opened > 0) & value.rlike("^[0-9]+$")).alias("_framed"))
    shaped = (F.col("_framed") & F.col("value").isNotNull() & F.col("code").rlike("^[A-Za-z]+$") & (F.coalesce("description", F.lit("")) != "")
              & (F.size("_colors") == 3) & F.forall("_colors", lambda c: c.isNotNull()))
    group = F.lit("Unknown")
    for letter, name in LEGEND_GROUPS.items():
        group = F.when(F.upper(F.substring("code", 1, 1)) == letter, F.lit(name)).otherwise(group)
    rows = parsed.filter(shaped).select(
        *keys, "value", "code", "description", group.alias("group"),
        F.format_string("#%02X%02X%02X", *[F.get("_colors", i) for i in range(3)]).alias("color"))
    if check:
        if rows.isEmpty():
            raise ValueError("no legend rows")
        twice = legend_duplicates(rows, keys).limit(1).collect()
        if twice:
            raise ValueError(f"duplicate pixel value {twice[0]['value']} in legend")
    return rows


def legend_duplicates(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or []), "value").count().filter("count > 1")
