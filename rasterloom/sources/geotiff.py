"""Single-band GeoTIFF in and out with numpy and zlib: 256-pixel deflated tiles, header first, overviews by halving."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np

from rasterloom.errors import SourceError
from rasterloom.plans.blocks import Grid

TILE = 256
# fixed values of the format: field sizes by type, and (sample format, bits) of the number kinds
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8", (6, 64): "c8", (6, 128): "c16"}


@dataclass
class Raster:
    """Header of a file: grid, number kind, where its tiles or strips are."""

    grid: Grid | None
    kind: np.dtype
    rows: int
    cols: int
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    compression: int
    nodata: float | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def header_end(self) -> int:
        return min(self.offsets, default=0)


def _entry(tag: int, kind: int, values) -> tuple[int, int, int, bytes]:
    if kind == 2:
        data = values.encode() + b"\0"
        return tag, 2, len(data), data
    return tag, kind, len(values), struct.pack(f"<{len(values)}{CODES[kind]}", *values)


def encode(array: np.ndarray, grid: Grid | None = None, metadata: dict[str, str] | None = None, nodata: float | None = None, overviews: bool = True) -> bytes:
    """File contents of an array."""
    array = np.ascontiguousarray(array)
    known = {np.dtype(v).newbyteorder("<"): k for k, v in KINDS.items()}
    if array.ndim != 2 or array.dtype.newbyteorder("<") not in known:
        raise SourceError(f"a raster has two axes and a plain number kind, not {array.shape} of {array.dtype}")
    levels = [array]
    while overviews and max(levels[-1].shape) > TILE:
        levels.append(np.ascontiguousarray(levels[-1][::2, ::2]))
    packed = []
    for level in levels:
        padded = np.zeros([-(-n // TILE) * TILE for n in level.shape], level.dtype)
        padded[: level.shape[0], : level.shape[1]] = level
        packed.append([zlib.compress(padded[r : r + TILE, c : c + TILE].astype(level.dtype.newbyteorder("<")).tobytes(), 6) for r in range(0, padded.shape[0], TILE) for c in range(0, padded.shape[1], TILE)])
    sample, bits = known[array.dtype.newbyteorder("<")]

    def directory(k: int, first: int) -> list[tuple[int, int, int, bytes]]:
        offsets, at = [], first
        for tile in packed[k]:
            offsets.append(at)
            at += len(tile)
        e = [_entry(254, 4, [1 if k else 0]), _entry(256, 4, [levels[k].shape[1]]), _entry(257, 4, [levels[k].shape[0]]), _entry(258, 3, [bits]), _entry(259, 3, [8]), _entry(262, 3, [1]), _entry(277, 3, [1]),
             _entry(322, 3, [TILE]), _entry(323, 3, [TILE]), _entry(324, 4, offsets), _entry(325, 4, [len(t) for t in packed[k]]), _entry(339, 3, [sample])]
        if k == 0 and grid is not None:
            model = 2 if grid.epsg == 4326 else 1
            e += [_entry(33550, 12, [grid.gt[1], -grid.gt[5], 0.0]), _entry(33922, 12, [0.0, 0.0, 0.0, grid.gt[0], grid.gt[3], 0.0]),
                  _entry(34735, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, 2048 if model == 2 else 3072, 0, 1, grid.epsg])]
        if k == 0 and metadata:
            items = "".join(f'<Item name="{escape(str(n), {chr(34): "&quot;"})}">{escape(str(v))}</Item>' for n, v in metadata.items())
            e.append(_entry(42112, 2, f"<GDALMetadata>{items}</GDALMetadata>"))
        if k == 0 and nodata is not None:
            e.append(_entry(42113, 2, repr(float(nodata))))
        return sorted(e)

    heads = [6 + 12 * len(d) + sum(len(v) + len(v) % 2 for *_, v in d if len(v) > 4) for d in (directory(k, 0) for k in range(len(levels)))]
    data_at = [8 + sum(heads)]
    for p in packed[:-1]:
        data_at.append(data_at[-1] + sum(map(len, p)))
    out, at = [struct.pack("<2sHI", b"II", 42, 8)], 8
    for k, size in enumerate(heads):
        entries = directory(k, data_at[k])
        extra, rows = at + 6 + 12 * len(entries), []
        tail = b""
        for tag, kind, count, value in entries:
            if len(value) <= 4:
                rows.append(struct.pack("<HHI4s", tag, kind, count, value.ljust(4, b"\0")))
            else:
                rows.append(struct.pack("<HHII", tag, kind, count, extra + len(tail)))
                tail += value + b"\0" * (len(value) % 2)
        at += size
        out += [struct.pack("<H", len(entries)), *rows, struct.pack("<I", at if k + 1 < len(levels) else 0), tail]
    return b"".join(out + [t for p in packed for t in p])


def header(data: bytes) -> Raster:
    """What the first directory says; enough of the file's start must be given."""
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise SourceError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        where = at + 2 + 12 * k + 8
        if size > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if kind == 2:
            tags[tag] = (data[where : where + count].split(b"\0")[0].decode("utf-8", "replace"),)
        elif kind in CODES:
            tags[tag] = struct.unpack_from(f"{order}{count}{CODES[kind]}", data, where)
    one = lambda t, d: tags.get(t, (d,))[0]
    if one(277, 1) != 1:
        raise SourceError("a raster of one band is needed")
    if one(259, 1) not in (1, 8, 32946) or one(317, 1) != 1:
        raise SourceError(f"compression {one(259, 1)} with predictor {one(317, 1)} is not supported")
    kind = KINDS.get((one(339, 1), one(258, 1)))
    if kind is None:
        raise SourceError(f"samples of format {one(339, 1)} and {one(258, 1)} bits are not supported")
    rows, cols = one(257, 0), one(256, 0)
    grid = None
    if 33550 in tags and 33922 in tags:
        keys = tags.get(34735, ())
        epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), 0)
        s, t = tags[33550], tags[33922]
        grid = Grid(epsg, (t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1]), rows, cols)
    tiled = 322 in tags
    tile = (one(323, 0), one(322, 0)) if tiled else (min(one(278, rows), rows), cols)
    found = re.findall(r'<Item name="([^"]*)"[^>]*>(.*?)</Item>', one(42112, ""), re.S)
    nodata = float(one(42113, "nan")) if 42113 in tags else None
    return Raster(grid, np.dtype(order + kind), rows, cols, tile, tags[324 if tiled else 273], tags[325 if tiled else 279], one(259, 1), nodata, {unescape(n, {"&quot;": '"'}): unescape(v) for n, v in found})


def decode(data: bytes, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """Samples of the window (rows, then columns, half open); only tiles that meet it are unpacked."""
    h = header(data)
    r0, r1, c0, c1 = window or (0, h.rows, 0, h.cols)
    if not (0 <= r0 <= r1 <= h.rows and 0 <= c0 <= c1 <= h.cols):
        raise SourceError(f"window {window} is not inside {h.rows} x {h.cols}")
    out = np.zeros((r1 - r0, c1 - c0), h.kind.newbyteorder("="))
    across = -(-h.cols // h.tile[1])
    for r in range(r0 // h.tile[0], -(-r1 // h.tile[0]) if r1 > r0 else 0):
        for c in range(c0 // h.tile[1], -(-c1 // h.tile[1]) if c1 > c0 else 0):
            k = r * across + c
            raw = data[h.offsets[k] : h.offsets[k] + h.counts[k]]
            raw = zlib.decompress(raw) if h.compression != 1 else raw
            tile = np.frombuffer(raw, h.kind)
            tile = tile.reshape(-1, h.tile[1]) if tile.size % h.tile[1] == 0 else tile[: tile.size // h.tile[1] * h.tile[1]].reshape(-1, h.tile[1])
            a, b = r * h.tile[0], c * h.tile[1]
            y0, y1, x0, x1 = max(r0, a), min(r1, a + len(tile)), max(c0, b), min(c1, b + h.tile[1])
            out[y0 - r0 : y1 - r0, x0 - c0 : x1 - c0] = tile[y0 - a : y1 - a, x0 - b : x1 - b]
    return out
