"""GeoTIFF by ranges: the first directory, then one group of tiles at a time.

Classic and big files, strips or tiles, one or separate planes, plain, LZW or
deflate, predictors 1 to 3. Missing tiles (no bytes) are nodata, or zero.
"""

from __future__ import annotations

import math
import struct
import zlib
from typing import Callable

import numpy as np

# Tags, field sizes and sample formats in use.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strips",
        277: "bands", 278: "rows_per_strip", 279: "strip_bytes", 284: "planar", 317: "predictor", 322: "tile_width",
        323: "tile_height", 324: "tiles", 325: "tile_bytes", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata"}
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
DTYPE = {(1, 8): "u1", (2, 8): "i1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
CLEAR, END = 256, 257

ReadAt = Callable[[int, int], bytes]


def _widths() -> np.ndarray:
    """Bits of the codes that may follow a clear code, by their number; the width changes one code early."""
    entries = np.arange(258, 258 + 4096) - 1
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


_AFTER_CLEAR = _widths()
_STARTS = np.concatenate(([0], np.cumsum(_AFTER_CLEAR)))


def unlzw(data: bytes) -> bytes:
    """TIFF flavour of LZW: most significant bit first, early width change.

    After a clear code the widths of all further codes are known, so the codes
    up to the next one are cut out of the bits at once.
    """
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    total, at, out = len(data) * 8, 0, []
    while at + 9 <= total:
        n = int(np.searchsorted(_STARTS[1:], total - at, side="right"))
        places = at + _STARTS[:n]
        first = places >> 3
        window = (raw[first] << 16) | (raw[first + 1] << 8) | raw[first + 2]
        codes = (window >> (24 - (places & 7) - _AFTER_CLEAR[:n])) & ((1 << _AFTER_CLEAR[:n]) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else n
        table, before = [bytes([i]) for i in range(256)] + [b"", b""], b""
        for code in codes[:stop].tolist():
            entry = table[code] if code < len(table) else before + before[:1]
            if before:
                table.append(before + entry[:1])
            out.append(entry)
            before = entry
        if stop == n or codes[stop] == END:
            break
        at += int(_STARTS[stop + 1])
    return b"".join(out)


UNPACK = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}


def header(read: ReadAt, band: int = 1) -> dict:
    """Size, place and layout of the first image; ValueError for what is not supported.

    `read(offset, n)` gives bytes of the file. `offsets` and `sizes` are those of
    the chunks of the band's plane.
    """
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack_from(order + "H", start, 2)[0] if order else 0
    if version == 42:
        at, = struct.unpack_from(order + "I", start, 4)
        count, = struct.unpack(order + "H", read(at, 2))
        at, entry, form, inline = at + 2, 12, "HHI", 4
    elif version == 43:
        at, = struct.unpack(order + "Q", read(8, 8))
        count, = struct.unpack(order + "Q", read(at, 8))
        at, entry, form, inline = at + 8, 20, "HHQ", 8
    else:
        raise ValueError("not a TIFF")
    rows = read(at, count * entry)
    tag: dict[str, tuple] = {}
    for i in range(count):
        code, kind, n = struct.unpack_from(order + form, rows, i * entry)
        if code not in TAGS or kind not in FIELD:
            continue
        values = order + (f"{n}s" if kind == 2 else FIELD[kind] * n if len(FIELD[kind]) > 1 else f"{n}{FIELD[kind]}")
        where = i * entry + struct.calcsize("<" + form)
        size = struct.calcsize(values)
        if size > inline:
            place, = struct.unpack_from(order + ("I" if inline == 4 else "Q"), rows, where)
            tag[TAGS[code]] = struct.unpack(values, read(place, size))
        else:
            tag[TAGS[code]] = struct.unpack_from(values, rows, where)
    one = lambda name, default: tag.get(name, (default,))[0]
    width, height, bands = one("width", 0), one("height", 0), one("bands", 1)
    dtype = DTYPE.get((one("format", 1), one("bits", 8)))
    if dtype is None:
        raise ValueError("sample type is not numeric")
    if one("photometric", 1) == 0:
        raise ValueError("inverted photometric interpretation")
    if not 1 <= band <= bands:
        raise ValueError(f"band {band} out of range (image has {bands})")
    compression, predictor = one("compression", 1), one("predictor", 1)
    if compression not in UNPACK or predictor not in (1, 2, 3) or (predictor == 3 and dtype[0] != "f"):
        raise ValueError(f"compression {compression} or predictor {predictor} is not supported")
    if "scale" not in tag or "tie" not in tag:
        raise ValueError("no georeference")
    if "tiles" in tag:
        chunk_width, chunk_height, offsets, sizes = one("tile_width", 0), one("tile_height", 0), tag["tiles"], tag["tile_bytes"]
    else:
        chunk_width, chunk_height = width, min(one("rows_per_strip", height), height)
        offsets, sizes = tag["strips"], tag["strip_bytes"]
    if min(width, height, chunk_width, chunk_height) < 1:
        raise ValueError("empty image")
    plane = -(-width // chunk_width) * -(-height // chunk_height)
    apart = one("planar", 1) != 1 and bands > 1
    first = (band - 1) * plane if apart else 0
    if len(offsets) < first + plane or len(sizes) < first + plane:
        raise ValueError("chunks are missing from the directory")
    dx, dy = tag["scale"][:2]
    col, row, _, x, y = tag["tie"][:5]
    try:
        empty = float(one("nodata", b"0").strip(b"\0 ").decode() or 0)
    except ValueError:
        empty = 0.0
    return {"width": width, "height": height, "x0": x - col * dx, "y0": y + row * dy, "dx": dx, "dy": dy,
            "chunk_width": chunk_width, "chunk_height": chunk_height, "tiled": "tiles" in tag,
            "samples": 1 if apart else bands, "sample": 0 if apart else band - 1, "dtype": order + dtype,
            "compression": compression, "predictor": predictor, "empty": empty,
            "offsets": offsets[first:first + plane], "sizes": sizes[first:first + plane]}


def samples(data: bytes, head: dict, rows: int) -> np.ndarray:
    """rows x chunk_width of the wanted sample, as float64."""
    width, number, kind = head["chunk_width"], head["samples"], np.dtype(head["dtype"])
    raw = np.frombuffer(UNPACK[head["compression"]](data), np.uint8, count=rows * width * number * kind.itemsize)
    if head["predictor"] == 3:
        # bytes of a row: all first bytes of its samples, then all second ones, each the difference to the sample before
        own = raw.reshape(rows, width * kind.itemsize, number).cumsum(axis=1, dtype=np.uint8)
        own = own.reshape(rows, kind.itemsize, width * number).transpose(0, 2, 1)
        values = np.ascontiguousarray(own).view(f">f{kind.itemsize}").reshape(rows, width, number)
    else:
        values = raw.view(kind).reshape(rows, width, number)
        if head["predictor"] == 2:
            values = np.cumsum(values, axis=1, dtype=kind)
    return values[:, :, head["sample"]].astype(np.float64)


def units(head: dict, block: int):
    """(ux, uy, width, height, chunks) of the least groups of chunks that whole blocks fit into; chunks are (x, y, offset, size).

    A file of square tiles that hold whole blocks has one tile in each group.
    """
    def side(chunk: int, whole: int) -> int:
        return whole if chunk >= whole else min(math.lcm(chunk, block), -(-whole // block) * block)

    cw, ch = head["chunk_width"], head["chunk_height"]
    uw, uh = side(cw, head["width"]), side(ch, head["height"])
    across = -(-head["width"] // cw)
    for y in range(0, head["height"], uh):
        for x in range(0, head["width"], uw):
            own = []
            for r in range(y // ch, -(-min(y + uh, head["height"]) // ch)):
                for c in range(x // cw, -(-min(x + uw, head["width"]) // cw)):
                    n = r * across + c
                    own.append((c * cw, r * ch, head["offsets"][n], head["sizes"][n]))
            yield x, y, min(uw, head["width"] - x), min(uh, head["height"] - y), own


def read_unit(read: ReadAt, head: dict, x: int, y: int, width: int, height: int, chunks) -> np.ndarray:
    """height x width samples of a group, float64; only its chunks are read."""
    out = np.full((height, width), head["empty"])
    for cx, cy, offset, size in chunks:
        if size == 0:
            continue
        rows = head["chunk_height"] if head["tiled"] else min(head["chunk_height"], head["height"] - cy)
        part = samples(read(offset, size), head, rows)
        left, top = max(cx, x), max(cy, y)
        right, low = min(cx + part.shape[1], x + width), min(cy + part.shape[0], y + height)
        out[top - y:low - y, left - x:right - x] = part[top - cy:low - cy, left - cx:right - cx]
    return out
