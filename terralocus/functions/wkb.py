"""WKB to rings, boxes and points, one Arrow batch at a time."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

VERTEX = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
RINGS = ArrayType(ArrayType(VERTEX))
BOX = StructType([StructField(n, DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])

# WKB geometry codes (2D) and their names.
POINT, LINE, POLYGON = 1, 2, 3
COLLECTIONS = (4, 5, 6, 7)
TYPE_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING",
              6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def parts(data: bytes, at: int = 0) -> tuple[list[tuple[int, np.ndarray]], int]:
    """Every simple part as (code, n x 2 array); polygons give one part per ring."""
    order = "<" if data[at] == 1 else ">"
    code, = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:  # EWKB srid flag
        at += 4
    high = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
    measured = bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)
    dims = 2 + high + measured
    base = (code & 0xFFFF) % 1000

    def coords(n: int, start: int) -> tuple[np.ndarray, int]:
        flat = np.frombuffer(data, dtype=order + "f8", count=n * dims, offset=start)
        return flat.reshape(n, dims)[:, :2].astype(np.float64), start + n * dims * 8

    if base == POINT:
        xy, at = coords(1, at)
        return [(POINT, xy)], at
    count, = struct.unpack_from(order + "I", data, at)
    at += 4
    if base == LINE:
        xy, at = coords(count, at)
        return [(LINE, xy)], at
    out: list[tuple[int, np.ndarray]] = []
    for _ in range(count):
        if base == POLYGON:
            n, = struct.unpack_from(order + "I", data, at)
            xy, at = coords(n, at + 4)
            out.append((POLYGON, xy))
        elif base in COLLECTIONS:
            inner, at = parts(data, at)
            out.extend(inner)
        else:
            raise ValueError(f"unsupported geometry code {code}")
    return out, at


@arrow_udf(RINGS)
def rings_of_wkb(wkb: pa.Array) -> pa.Array:
    """All polygon rings; NULL for NULL or for geometry without polygons.

    Coordinates stay flat arrays with offsets, so no object is made per vertex.
    """
    rings, lengths, counts = [], [], []
    for data in wkb:
        found = [xy for code, xy in parts(data.as_py())[0] if code == POLYGON] if data.is_valid else []
        rings += found
        lengths += [len(xy) for xy in found]
        counts.append(len(found))
    flat = np.concatenate(rings) if rings else np.zeros((0, 2))
    offsets = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    vertices = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    per_ring = pa.ListArray.from_arrays(offsets(lengths), vertices)
    return pa.ListArray.from_arrays(offsets(counts), per_ring, mask=pa.array([n == 0 for n in counts]))


@pandas_udf(BOX)
def box_of_wkb(wkb: pd.Series) -> pd.DataFrame:
    def one(data):
        found = [] if data is None else [xy for _, xy in parts(bytes(data))[0] if len(xy)]
        if not found:
            return (None, None, None, None)
        xy = np.concatenate(found)
        return (*xy.min(axis=0), *xy.max(axis=0))
    return pd.DataFrame([one(d) for d in wkb], columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


def polygon_wkb(rings) -> bytes:
    """Little-endian POLYGON from lists of (x, y)."""
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out.append(np.asarray(ring, dtype="<f8").tobytes())
    return b"".join(out)


def point_wkb(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)
