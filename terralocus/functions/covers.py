"""Bands of an outline cut into pieces that are wholly inside or hold its border."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructType

SEGMENT = StructType()
for _name in ("ax", "ay", "bx", "by"):
    SEGMENT.add(_name, DoubleType())
PIECES = ArrayType(StructType().add("x0", DoubleType()).add("x1", DoubleType()).add("inner", BooleanType()).add("beyond", IntegerType())
                   .add("segments", ArrayType(SEGMENT)))
# Rounding of a place computed on a segment, as a share of its coordinates.
ROUNDING = 1e-14


def pieces(ax, ay, bx, by, lo: float, hi: float):
    """(x0, x1, inner, beyond, rows) of what a band [lo, hi] of closed rings holds, from west to east.

    The stretches of x that segments take up inside the band are its border
    pieces, with the segments in `rows`. No border lies between two of them, so
    all points there are inside or all are outside: those inside are `inner`
    pieces, their ends not included. A chain of segments enters and leaves the
    band within one stretch, so `beyond`, the parity of what a ray towards +x
    crosses east of a stretch, is the same for every height in the band.
    """
    if not len(ax):
        return
    down, up = np.minimum(ay, by), np.maximum(ay, by)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (bx - ax) / (by - ay)
        at = [ax + (np.clip(y, down, up) - ay) * slope for y in (lo, hi)]
    flat = ay == by
    slack = ROUNDING * (np.abs(ax) + np.abs(bx))
    west, east = np.minimum(ax, bx), np.maximum(ax, bx)
    start = np.where(flat, west, np.clip(np.minimum(*at) - slack, west, east))
    end = np.where(flat, east, np.clip(np.maximum(*at) + slack, west, east))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    last = np.append(first[1:], len(order)) - 1
    crossed = np.add.reduceat(((ay <= lo) != (by <= lo))[order].astype(np.int64), first)
    beyond = (crossed[::-1].cumsum()[::-1] - crossed) % 2
    for n, (i, j) in enumerate(zip(first.tolist(), last.tolist())):
        yield float(start[i]), float(reach[j]), False, int(beyond[n]), order[i:j + 1]
        if beyond[n] and n + 1 < len(first):
            yield float(reach[j]), float(start[first[n + 1]]), True, 1, order[:0]


@arrow_udf(PIECES)
def band_pieces(segments: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """The pieces of each band; NULL for NULL."""
    values, offsets = segments.values, segments.offsets.to_numpy()
    whole = [values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
    known = segments.is_valid().to_numpy(zero_copy_only=False)
    low, high = lo.to_numpy(zero_copy_only=False), hi.to_numpy(zero_copy_only=False)
    columns, rows, counts = ([], [], [], []), [], np.zeros(len(segments), np.int64)
    for n in np.flatnonzero(known).tolist():
        a, b = offsets[n], offsets[n + 1]
        for *piece, own in pieces(*(c[a:b] for c in whole), low[n], high[n]):
            for column, value in zip(columns, piece):
                column.append(value)
            rows.append(own + a)
            counts[n] += 1
    taken = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    inner = np.array(columns[2], bool)
    lists = pa.ListArray.from_arrays(pa.array(ends), values.take(taken), mask=pa.array(inner))
    kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.int32())
    struct = pa.StructArray.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), lists], ["x0", "x1", "inner", "beyond", "segments"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), struct, mask=pa.array(~known))
