"""A small GeoTIFF reader: band 1 of strips and tiles, plain or packed by deflate, LZW or byte runs, and where its cells lie."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Tags of the TIFF and GeoTIFF formats.
WIDTH, HEIGHT, BITS, COMPRESSION = 256, 257, 258, 259
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, TRANSFORMATION = 33550, 33922, 34264
_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


@dataclass(frozen=True)
class Raster:
    """Cell values, and the affine map (a, b, c, d, e, f): x = a + b * column + c * row, y = d + e * column + f * row."""

    values: np.ndarray
    affine: tuple[float, float, float, float, float, float] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def _tags(data: bytes, order: str) -> dict[int, tuple]:
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for k in range(n):
        tag, kind, count, inline = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * k)
        form = _SIZES.get(kind)
        if form:
            size = struct.calcsize(form) * count
            place = at + 2 + 12 * k + 8 if size <= 4 else struct.unpack(order + "I", inline)[0]
            found[tag] = struct.unpack_from(f"{order}{count}{form}", data, place)
    return found


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first: 256 clears the table, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    bits, held = 0, 0
    for byte in data:
        bits, held = (bits << 8 | byte) & 0xFFFFFF, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count below 128 is followed by so many bytes and one more, one above by a byte to repeat; 128 is nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


#: The format's numbers of compressions.
_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


def read(data: bytes) -> Raster:
    """Raises ValueError or struct.error for what isn't such a file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF")
    tags = _tags(data, order)
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(SAMPLE_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags[BITS][0] // 8}")
    packed, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if packed not in _UNPACK or predictor not in (1, 2):
        raise ValueError(f"compression {packed}, predictor {predictor}")
    planar = tags.get(PLANAR, (1,))[0] == 2
    depth = 1 if planar else samples
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS_PER_STRIP, (height,))[0]))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    values = np.zeros((height, width))
    across = -(-width // bw)
    for k in range(across * -(-height // bh)):  # band 1's blocks come first
        raw = data[offsets[k] : offsets[k] + counts[k]]
        raw = _UNPACK[packed](raw)
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        block = np.frombuffer(raw, dtype, rows * bw * depth).reshape(rows, bw, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: height - y, : width - x, 0]
        values[y : y + part.shape[0], x : x + part.shape[1]] = part
    affine = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        affine = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIE_POINTS in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIE_POINTS]
        affine = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    return Raster(values, affine)


def write(values: np.ndarray, affine: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0), deflate: bool = False, pack: tuple[int, Callable[[bytes], bytes]] | None = None) -> bytes:
    """A one-strip float64 GeoTIFF (for tests and exports); affine: x and y of the upper left corner, cell width and height. pack: a compression's number and function."""
    body = values.astype("<f8").tobytes()
    number, packer = pack or ((8, zlib.compress) if deflate else (1, bytes))
    body = packer(body)
    x, y, sx, sy = affine
    height, width = values.shape
    extra = struct.pack("<3d", sx, sy, 0.0) + struct.pack("<6d", 0, 0, 0, x, y, 0)
    at = 8 + len(extra)
    rows = [
        (WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 64), (COMPRESSION, 3, 1, number), (STRIP_OFFSETS, 4, 1, at),
        (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, height), (STRIP_COUNTS, 4, 1, len(body)), (SAMPLE_FORMAT, 3, 1, 3),
        (PIXEL_SCALE, 12, 3, 8), (TIE_POINTS, 12, 6, 32),
    ]
    directory = struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, at + len(body)) + extra + body + directory
