"""GeoPackage feature tables as a Spark data source.

    spark.dataSource.register(GeoPackageSource)
    spark.read.format("geopackage").option("layer", "places").load("/data/gpkg")

The geometry comes out as plain WKB. `read_layer` does the same for many files:
they are inspected in tasks, and each task reads a share of the rows of one file.
"""

from __future__ import annotations

import io
import os
import sqlite3
import struct
import tempfile
from urllib.parse import quote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from ..functions.attributes import source_id
from ..functions.wkb import parts
from ..operators.skew import spread_for_work
from ..session import cut_lineage
from .ranges import open_file

ROWS_PER_TASK = 100_000
# Beyond so many shares of rows, a task reads several.
MAX_TASKS = 100_000
# Bytes of the optional envelope by its header code.
ENVELOPE_BYTES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def local_path(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(local_path(path))}?mode=ro&immutable=1", uri=True)


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB inside a GeoPackage geometry; other blobs are passed on as they are."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPE_BYTES.get((blob[3] >> 1) & 7, 0):]


def wrap_wkb(wkb: bytes, srid: int) -> bytes:
    return b"GP\x00\x01" + struct.pack("<i", srid) + wkb


def feature_layers(con: sqlite3.Connection) -> list[dict]:
    """Layers of type features with their geometry column, type and SRID."""
    rows = con.execute(
        "SELECT c.table_name, coalesce(c.description, ''), g.column_name, g.geometry_type_name, g.srs_id "
        "FROM gpkg_contents c JOIN gpkg_geometry_columns g ON g.table_name = c.table_name "
        "WHERE c.data_type = 'features' ORDER BY c.table_name").fetchall()
    return [dict(zip(("layer", "description", "geom", "geometry_type", "srid"), r)) for r in rows]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _spark_type(declared: str):
    kind = declared.upper()
    if "BOOL" in kind:
        return BooleanType()
    if "INT" in kind:
        return LongType()
    if any(t in kind for t in ("REAL", "DOUB", "FLOA")):
        return DoubleType()
    if "BLOB" in kind:
        return BinaryType()
    return StringType()


def _files(path: str) -> list[str]:
    root = local_path(path)
    if os.path.isfile(root):
        return [root]
    found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.lower().endswith(".gpkg")]
    return sorted(found)


def _layer_of(con: sqlite3.Connection, wanted: str | None) -> dict | None:
    return next((x for x in feature_layers(con) if wanted in (None, x["layer"])), None)


def _declared(con: sqlite3.Connection, layer: dict) -> list[tuple[str, str]]:
    """(column, Spark type) of the attributes, without id and geometry."""
    rows = con.execute(f"PRAGMA table_info({_quoted(layer['layer'])})").fetchall()
    return [(r[1], _spark_type(r[2] or "").simpleString()) for r in rows if r[1] not in ("fid", layer["geom"])]


def _ranges(con: sqlite3.Connection, layer: dict, step: int) -> list[tuple[int, int]]:
    """Row-id ranges [lo, hi) of `step` rows each, however the ids are spread."""
    table = _quoted(layer["layer"])
    rows = con.execute(f"SELECT min(rowid), max(rowid) + 1 FROM (SELECT rowid, (row_number() OVER (ORDER BY rowid) - 1) / ? AS part FROM {table}) "
                       "GROUP BY part ORDER BY part", (step,))
    return rows.fetchall()


Extent = tuple[float, float, float, float]


def _index_of(con: sqlite3.Connection, layer: dict) -> str | None:
    """Name of the layer's R-tree, where the file has one."""
    name = f"rtree_{layer['layer']}_{layer['geom']}"
    return name if con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (name,)).fetchone() else None


def _indexed_ids(con: sqlite3.Connection, layer: dict, extent: Extent) -> tuple[str, tuple] | None:
    """Query of the row ids whose box in the R-tree meets the extent (xmin, ymin, xmax, ymax); it may give a few more."""
    name = _index_of(con, layer)
    if name is None:
        return None
    xmin, ymin, xmax, ymax = map(float, extent)
    return f"SELECT id FROM {_quoted(name)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?", (xmin, xmax, ymin, ymax)


def _ranges_within(con: sqlite3.Connection, layer: dict, step: int, extent: Extent | None) -> list[tuple[int, int]]:
    """Ranges of `step` rows to read: of those an R-tree finds in the extent, else of all rows."""
    found = None if extent is None else _indexed_ids(con, layer, extent)
    if found is None:
        return _ranges(con, layer, step)
    rows = con.execute(f"SELECT min(id), max(id) + 1 FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) / ? AS part FROM ({found[0]})) GROUP BY part ORDER BY part",
                       (step, *found[1]))
    return rows.fetchall()


def envelope(blob: bytes | None) -> Extent | None:
    """(xmin, ymin, xmax, ymax) of a geometry, from its header where that has it; None without coordinates."""
    if blob is None:
        return None
    if blob[:2] == b"GP" and (blob[3] >> 1) & 7:
        x0, x1, y0, y1 = struct.unpack_from("<4d" if blob[3] & 1 else ">4d", blob, 8)
        return x0, y0, x1, y1
    found = [xy for _, xy in parts(strip_header(blob))[0] if len(xy)]
    if not found:
        return None
    low, high = np.min([xy.min(axis=0) for xy in found], axis=0), np.max([xy.max(axis=0) for xy in found], axis=0)
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def meets(box: Extent | None, extent: Extent) -> bool:
    return box is not None and box[2] >= extent[0] and box[0] <= extent[2] and box[3] >= extent[1] and box[1] <= extent[3]


def merged_schema(columns: list[tuple[str, str]]) -> StructType:
    """One field per column name of any file; whole and broken numbers meet as double, other types as text."""
    kinds: dict[str, set[str]] = {}
    for name, kind in columns:
        kinds.setdefault(name, set()).add(kind)
    of = {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "binary": BinaryType(), "string": StringType()}
    pick = lambda found: of[next(iter(found))] if len(found) == 1 else DoubleType() if found <= {"bigint", "double"} else StringType()
    return StructType([StructField("path", StringType()), StructField("fid", LongType()),
                       *[StructField(n, pick(k)) for n, k in kinds.items()], StructField("geom_wkb", BinaryType())])


def _read_rows(path: str, shown: str, wanted: str | None, fields: list[StructField], lo: int | None, hi: int | None, extent: Extent | None = None):
    """Arrow batches of one row-id range (all rows without one); only the asked columns are fetched.

    With an extent, only rows whose box meets it: an R-tree names them, so that
    others are not fetched; without one each row's own box decides.
    """
    import pyarrow as pa

    con = connect(path)
    layer = _layer_of(con, wanted)
    stored = {c[1] for c in con.execute(f"PRAGMA table_info({_quoted(layer['layer'])})")}
    pick = {"path": "NULL", "geom_wkb": _quoted(layer["geom"]), "fid": "fid" if "fid" in stored else "rowid"}
    picks = [pick.get(f.name) or (_quoted(f.name) if f.name in stored else "NULL") for f in fields]
    limits, values = [] if lo is None else [f"rowid >= {int(lo)} AND rowid < {int(hi)}"], ()
    found = None if extent is None else _indexed_ids(con, layer, extent)
    if found is not None:
        bound = "" if lo is None else f" AND id >= {int(lo)} AND id < {int(hi)}"
        limits, values = [*limits, f"rowid IN ({found[0]}{bound})"], found[1]
    if extent is not None:
        picks.append(_quoted(layer["geom"]))
    where = f" WHERE {' AND '.join(limits)}" if limits else ""
    rows = con.execute(f"SELECT {', '.join(picks)} FROM {_quoted(layer['layer'])}{where}", values)
    kinds = {LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64(), BooleanType: pa.bool_(),
             BinaryType: pa.binary(), StringType: pa.string()}
    target = pa.schema([(f.name, kinds[type(f.dataType)]) for f in fields])
    while chunk := rows.fetchmany(10_000):
        columns = []
        if extent is not None:
            chunk = [row[:-1] for row in chunk if meets(envelope(row[-1]), extent)]
            if not chunk:
                continue
        for field, values in zip(target, zip(*chunk)):
            if field.name == "path":
                values = [shown] * len(chunk)
            elif field.name == "geom_wkb":
                values = [strip_header(v) for v in values]
            elif field.type == pa.bool_():
                values = [None if v is None else bool(v) for v in values]
            elif field.type == pa.float64():
                values = [None if v is None else float(v) for v in values]
            elif field.type == pa.string():
                values = [v if v is None or isinstance(v, str) else str(v) for v in values]
            columns.append(pa.array(values, type=field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=target)
    con.close()


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class GeoPackageSource(DataSource):
    """For a few files on a mounted path; `read_layer` inspects many files in tasks.

    Options: layer, rowsPerTask, extent (xmin,ymin,xmax,ymax) and ids (lo,hi: rows
    with lo <= fid < hi). They are options, not pushed filters: Spark keeps what
    it pushed to a Python reader for later queries on the same frame.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> StructType:
        found = None
        for path in _files(self.options["path"]):
            con = connect(path)
            layer = _layer_of(con, self.options.get("layer"))
            if layer:
                found = (found or []) + _declared(con, layer)
            con.close()
        if found is None:
            raise ValueError("no GeoPackage with that layer")
        return merged_schema(found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.path, self.layer = options["path"], options.get("layer")
        self.step = int(options.get("rowsPerTask", ROWS_PER_TASK))
        given = options.get("extent")
        self.extent = tuple(float(v) for v in given.split(",")) if given else None
        given = options.get("ids")
        self.low, self.high = map(int, given.split(",")) if given else (None, None)

    def _bounded(self, lo: int, hi: int) -> tuple[int, int]:
        return (lo, hi) if self.low is None else (max(lo, self.low), min(hi, self.high))

    def partitions(self):
        out = []
        for path in _files(self.path):
            con = connect(path)
            layer = _layer_of(con, self.layer)
            bounded = [self._bounded(*r) for r in (_ranges_within(con, layer, self.step, self.extent) if layer else ())]
            out += [_Range(path, lo, hi) for lo, hi in bounded if lo < hi]
            con.close()
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range):
        if part.path:
            yield from _read_rows(part.path, part.path, self.layer, self.schema.fields, part.lo, part.hi, self.extent)


def _is_mounted(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


# Stores whose files Arrow reads in parts; of others a file comes as one binary value.
PARTS_SCHEMES = ("s3", "gs", "gcs", "abfs", "abfss", "hdfs")
PART_BYTES = 8 << 20


def fetch_in_parts(source, target) -> int:
    """Copies an open file to another, a part at a time; returns its bytes."""
    total = 0
    while part := source.read(PART_BYTES):
        target.write(part)
        total += len(part)
    target.flush()
    return total


def read_layer(spark: SparkSession, path: str, layer: str, rows_per_task: int = ROWS_PER_TASK, columns: list[str] | None = None,
               extent: Extent | None = None) -> DataFrame:
    """Rows of one layer over all GeoPackages below `path`, with source_id from the file name.

    Tasks look into the files; the schema is the union of all files' columns (or
    the asked `columns` of them), and rows are dealt by count. With an `extent`
    (xmin, ymin, xmax, ymax in the layer's system), only rows whose box meets it are read, by the
    file's R-tree where it has one; rows without geometry meet none. On a store that
    is not mounted, a file is copied to the task that reads it: in parts, of any size,
    where Arrow has a client for the store, else as one binary value of at most 2 GiB.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[gG][pP][kK][gG]").option("recursiveFileLookup", "true").load(path)
    mounted = _is_mounted(path)
    in_parts = urlparse(path).scheme in PARTS_SCHEMES
    files = listed.select("path", *([] if mounted or in_parts else ["content"]))
    files = spread_for_work(files, "path")

    def local(row):
        if mounted:
            return local_path(row.path), None
        held = tempfile.NamedTemporaryFile(suffix=".gpkg")  # this task's own copy
        with open_file(row.path) if in_parts else io.BytesIO(row.content) as source:
            fetch_in_parts(source, held)
        return held.name, held

    def look(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                name, held = local(row)
                con = connect(name)
                found = _layer_of(con, layer)
                if found:
                    ranges = _ranges_within(con, found, rows_per_task, extent) if mounted else [(None, None)]
                    rows.append((row.path, [{"name": n, "kind": k} for n, k in _declared(con, found)], [{"lo": a, "hi": b} for a, b in ranges]))
                con.close()
            yield pd.DataFrame(rows, columns=["path", "columns", "ranges"])

    seen = cut_lineage(files.mapInPandas(look, "path string, columns array<struct<name:string,kind:string>>, ranges array<struct<lo:bigint,hi:bigint>>"))
    kinds = seen.select(F.posexplode("columns").alias("pos", "c")).groupBy("c.name", "c.kind").agg(F.min("pos").alias("pos")).orderBy("pos", "name", "kind").collect()
    if not kinds and seen.isEmpty():
        raise ValueError("no GeoPackage with that layer")
    schema = merged_schema([(r["name"], r["kind"]) for r in kinds])
    if columns is not None:
        schema = StructType([f for f in schema.fields if f.name in ("path", "fid") or f.name in columns])
    fields = schema.fields
    if mounted:
        asked = seen.select("path", F.explode("ranges").alias("r")).select("path", "r.lo", "r.hi")
        asked = asked.repartition(max(1, min(asked.count(), MAX_TASKS)), "path", "lo")  # a few bytes each, much work each
    else:
        asked = files.join(seen.select("path"), "path", "left_semi").withColumns({"lo": F.lit(None).cast("bigint"), "hi": F.lit(None).cast("bigint")})

    def read(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                name, held = local(row)
                bounds = (int(row.lo), int(row.hi)) if mounted else (None, None)
                yield from _read_rows(name, row.path, layer, fields, *bounds, extent)

    out = asked.mapInArrow(read, schema)
    return out.withColumn("source_id", source_id(F.col("path"))).drop("path")


CATALOG_SCHEMA = ("path string, source_id string, layer string, description string, geom string, "
                  "geometry_type string, srid int, has_index boolean")
METADATA_SCHEMA = "path string, source_id string, id bigint, uri string, mime string, metadata string, error string"


def _per_file(paths: DataFrame, reader, schema: str) -> DataFrame:
    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = [r for p, s in zip(pdf["path"], pdf["source_id"]) for r in reader(p, s)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    named = paths.select("path", source_id(F.col("path")).alias("source_id"))
    return spread_for_work(named, "path").mapInPandas(run, schema)


def read_catalog(paths: DataFrame) -> DataFrame:
    """Feature layers of every GeoPackage in `paths(path)`, one task per share of files."""
    def one(path, sid):
        con = connect(path)
        tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master")}
        rows = [(path, sid, x["layer"], x["description"], x["geom"], x["geometry_type"], x["srid"],
                 f"rtree_{x['layer']}_{x['geom']}" in tables) for x in feature_layers(con)]
        con.close()
        return rows
    return _per_file(paths, one, CATALOG_SCHEMA)


def read_metadata(paths: DataFrame) -> DataFrame:
    """Metadata rows of every GeoPackage; files without the table give none."""
    def one(path, sid):
        con = connect(path)
        try:
            rows = con.execute("SELECT id, md_standard_uri, mime_type, metadata FROM gpkg_metadata ORDER BY id").fetchall()
        except sqlite3.OperationalError:
            rows = []
        con.close()
        return [(path, sid, *r, None) for r in rows]
    return _per_file(paths, one, METADATA_SCHEMA)
