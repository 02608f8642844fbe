"""Contour lines of rasters: a relational form in native expressions, and whole tiles to WKB by marching squares.

Values belong to cell centres; a level crosses an edge between neighbours if one is at least the level and the other below
it, at the place that linear interpolation gives. Where all four edges of a square are crossed, the mean decides.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from geoledger.sources.geotiff import Raster, read


def segments(tiles: DataFrame, tile_id: str, interval: float, base: float = 0.0) -> DataFrame:
    """(tile_id, level, x1, y1, x2, y2) of every contour segment, in columns and rows of the tile.

    tiles: the id, ``values`` array<double> row by row, ``width``, ``height``. No Python and no shuffle: squares are
    exploded where their tile is.
    """
    squares = tiles.where("width > 1 and height > 1").select(
        F.col(tile_id), "values", "width", F.explode(F.expr("sequence(0, cast((width - 1) * (height - 1) - 1 as int))")).alias("square")
    )
    corner = lambda dx, dy: f"values[(y + {dy}) * width + x + {dx}]"
    squares = squares.selectExpr("*", "cast(square % (width - 1) as int) as x", "cast(square div (width - 1) as int) as y")
    squares = squares.selectExpr(f"`{tile_id}`", "x", "y", f"{corner(0, 0)} as a", f"{corner(1, 0)} as b", f"{corner(1, 1)} as c", f"{corner(0, 1)} as d")
    first, last = f"cast(ceil((least(a, b, c, d) - {base}D) / {interval}D) as bigint)", f"cast(floor((greatest(a, b, c, d) - {base}D) / {interval}D) as bigint)"
    levels = squares.selectExpr("*", f"explode(if({first} <= {last}, sequence({first}, {last}), array())) as step").selectExpr("*", f"{base}D + step * {interval}D as level")
    cut = lambda p, q, x, y: f"if(({p} >= level) != ({q} >= level), struct(cast({x} as double) as x, cast({y} as double) as y), null)"
    at = lambda p, q: f"(level - {p}) / ({q} - {p})"
    top, right = cut("a", "b", f"x + {at('a', 'b')}", "y"), cut("b", "c", "x + 1", f"y + {at('b', 'c')}")
    bottom, left = cut("d", "c", f"x + {at('d', 'c')}", "y + 1"), cut("a", "d", "x", f"y + {at('a', 'd')}")
    cuts = levels.selectExpr("*", f"{top} as t", f"{right} as r", f"{bottom} as m", f"{left} as l")
    saddle = "if(((a + b + c + d) / 4 >= level) = (a >= level), array(struct(t as p, r as q), struct(l as p, m as q)), array(struct(t as p, l as q), struct(m as p, r as q)))"
    plain = "filter(array(t, r, m, l), e -> e is not null)"
    pairs = f"case when t is not null and r is not null and m is not null and l is not null then {saddle} when size({plain}) = 2 then array(struct({plain}[0] as p, {plain}[1] as q)) else array() end"
    out = cuts.selectExpr(f"`{tile_id}`", "level", f"inline({pairs})")
    return out.selectExpr(f"`{tile_id}`", "level", "p.x as x1", "p.y as y1", "q.x as x2", "q.y as y2")


def _edges(v: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of crossed edges, one for each segment, and where each edge is crossed (column, row), if it is.

    Edge numbers: 2k runs right from cell k, 2k + 1 runs down from it.
    """
    up = v >= level
    h, w = v.shape
    cell = np.arange(h * w).reshape(h, w)
    across, down = up[:, :-1] != up[:, 1:], up[:-1] != up[1:]
    places = np.zeros((2 * h * w, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        px = np.arange(w - 1) + (level - v[:, :-1]) / (v[:, 1:] - v[:, :-1])
        py = np.arange(h - 1)[:, None] + (level - v[:-1]) / (v[1:] - v[:-1])
    (y, x), (y2, x2) = np.nonzero(across), np.nonzero(down)
    places[2 * cell[y, x]] = np.stack((px[y, x], y), axis=1)
    places[2 * cell[y2, x2] + 1] = np.stack((x2, py[y2, x2]), axis=1)
    sides = np.stack([2 * cell[:-1, :-1], 2 * cell[:-1, 1:] + 1, 2 * cell[1:, :-1], 2 * cell[:-1, :-1] + 1], axis=-1)
    crossed = np.stack([across[:-1], down[:, 1:], across[1:], down[:, :-1]], axis=-1)
    n = crossed.sum(axis=-1)
    two = sides[n == 2][crossed[n == 2]].reshape(-1, 2)
    mean = (v[:-1, :-1] + v[:-1, 1:] + v[1:, :-1] + v[1:, 1:]) / 4 >= level
    all_four = n == 4
    same = all_four & (mean == up[:-1, :-1])
    other = all_four & ~same
    t, r, m, l = np.moveaxis(sides, -1, 0)
    pairs = [two, *(np.stack((p[k], q[k]), axis=1) for k, p, q in ((same, t, r), (same, l, m), (other, t, l), (other, m, r)))]
    return np.concatenate(pairs), places


def _lines(pairs: np.ndarray) -> list[list[int]]:
    """Chains of edges: open lines first from their ends, then rings."""
    near: dict[int, list[int]] = defaultdict(list)
    for k, (p, q) in enumerate(pairs.tolist()):
        near[p].append(k)
        near[q].append(k)
    used, lines = [False] * len(pairs), []

    def walk(start: int) -> None:
        line, at = [start], start
        while free := [k for k in near[at] if not used[k]]:
            used[free[0]] = True
            p, q = pairs[free[0]].tolist()
            at = q if at == p else p
            line.append(at)
        if len(line) > 1:
            lines.append(line)

    for start in sorted(k for k, v in near.items() if len(v) == 1):
        walk(start)
    for start in sorted(near):
        walk(start)
    return lines


def contour_lines(raster: Raster, interval: float = 10.0, base: float = 0.0) -> list[list[tuple[float, float]]]:
    """Lines of all levels base + k * interval, in the raster's coordinates. Sentinel values are values like others."""
    v = raster.values
    if min(v.shape) < 2 or not interval > 0:
        return []
    a, b, c, d, e, f = raster.affine
    out = []
    for k in range(int(np.ceil((v.min() - base) / interval)), int(np.floor((v.max() - base) / interval)) + 1):
        pairs, places = _edges(v, base + k * interval)
        for line in _lines(pairs):
            x, y = places[line].T + 0.5
            out.append(list(zip((a + b * x + c * y).tolist(), (d + e * x + f * y).tolist())))
    return out


def contours_wkb(data: bytes | None, interval: float | None = 10.0, base: float | None = 0.0) -> bytes | None:
    """One little-endian MultiLineString of a raster file's contours; None if it has none, is empty or can't be read."""
    if not data:
        return None
    try:
        step, first = 10.0 if pd.isna(interval) else float(interval), 0.0 if pd.isna(base) else float(base)
        lines = contour_lines(read(bytes(data)), step, first)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, OverflowError):
        return None
    if not lines:
        return None
    body = b"".join(struct.pack("<BII", 1, 2, len(p)) + np.array(p, "<f8").tobytes() for p in lines)
    return struct.pack("<BII", 1, 5, len(lines)) + body


def _series(raster: pd.Series, interval: pd.Series, base: pd.Series) -> pd.Series:
    """Each row has its own interval and base."""
    return pd.Series([contours_wkb(r, i, b) for r, i, b in zip(raster, interval, base)], dtype=object)


generate_contours = pandas_udf(_series, BinaryType())
