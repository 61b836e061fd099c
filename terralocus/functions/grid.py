"""A ladder of square grids used as join keys.

Cell sides are powers of four (so exact in binary); a box is filed on the
smallest rung whose side is at least half its width and, separately, half its
height. It then touches at most three cells per axis, whatever its size, and a
cell is at most twice as wide as the boxes filed on it (finest rung aside).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# From parcels of a millimetre (in degrees) to whole planets (in metres).
MIN_RUNG = -14
MAX_RUNG = 12
_RUNGS = MAX_RUNG - MIN_RUNG + 1
_MASK = (1 << 27) - 1


def side(rung: int) -> float:
    return 4.0**rung


def rung_of(extent: Column) -> Column:
    """Smallest rung whose side is about half of extent or more, as INT.

    The cells of a box are listed from its own bounds, so a rung that is off
    by rounding costs a cell more, never a match.
    """
    steps = F.ceil(F.log2(F.greatest(extent, F.lit(side(MIN_RUNG))) / 2) / 2)
    return F.least(F.greatest(steps, F.lit(MIN_RUNG)), F.lit(MAX_RUNG)).cast("int")


def _side_col(rung: Column) -> Column:
    return F.pow(F.lit(4.0), rung.cast("double"))


def slot(value: Column, rung: Column | int) -> Column:
    """Index of the cell along one axis."""
    width = F.lit(side(rung)) if isinstance(rung, int) else _side_col(rung)
    return F.floor(value / width).cast("bigint")


def pack(rung_x: Column, rung_y: Column, ix: Column, iy: Column) -> Column:
    """One BIGINT key. Far cells may share a key; the box test after the join decides."""
    code = (rung_x - MIN_RUNG) * _RUNGS + (rung_y - MIN_RUNG)
    return F.shiftleft(code.cast("bigint"), 54).bitwiseOR(
        F.shiftleft(ix.bitwiseAND(F.lit(_MASK)), 27)
    ).bitwiseOR(iy.bitwiseAND(F.lit(_MASK)))


def box_cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, rung_x: Column, rung_y: Column) -> Column:
    """ARRAY<BIGINT> of the at most nine cells a box touches."""
    xs = F.sequence(slot(xmin, rung_x), slot(xmax, rung_x))
    ys = F.sequence(slot(ymin, rung_y), slot(ymax, rung_y))
    return F.flatten(F.transform(xs, lambda ix: F.transform(ys, lambda iy: pack(rung_x, rung_y, ix, iy))))


def point_cells(x: Column, y: Column, rungs: list[tuple[int, int]]) -> Column:
    """ARRAY<BIGINT>: the point's cell on every rung pair a layer uses."""
    return F.array(*[
        pack(F.lit(rx), F.lit(ry), slot(x, rx), slot(y, ry)) for rx, ry in rungs
    ])
