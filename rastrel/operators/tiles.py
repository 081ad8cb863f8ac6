"""Neighbourhoods on tiles: dense blocks of pixels with a margin of their neighbours, worked on as arrays.

One exchange brings each tile's pixels and margin together, however many stencils follow; windows over pixel rows, as in
`stencil`, need one or two for each. A tile is bounded, whatever the image's size. The margin must reach as far as the
stencils in a row do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile.
TILE = 512

Block = dict[str, np.ndarray]


def on_tiles(px: DataFrame, f: Callable[[Block], Block], inputs: tuple[str, ...], outputs: tuple[str, ...], margin: int, tile: int = TILE) -> DataFrame:
    """raster_id, r, c and the outputs (doubles) of f, for each pixel of dense rasters from row and column 0.

    f gets the inputs as arrays of doubles, NaN where there is no pixel, and returns arrays of that shape. At the image's
    edges arrays end, elsewhere they go on for the margin.
    """
    reach = lambda x, last: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(x) - margin) / tile)).cast("int"), F.least(F.floor(F.col(last) / tile), F.floor((F.col(x) + margin) / tile)).cast("int")))
    size = px.groupBy("raster_id").agg(F.max("r").alias("_lr"), F.max("c").alias("_lc"))
    d = px.select("raster_id", "r", "c", *[F.col(i).cast("double").alias(i) for i in inputs]).join(size, "raster_id")
    d = d.withColumn("_tr", reach("r", "_lr")).withColumn("_tc", reach("c", "_lc")).drop("_lr", "_lc")
    kinds = px.select("raster_id", "r", "c").schema
    for o in outputs:
        kinds = kinds.add(o, "double")

    def work(t: pa.Table) -> pa.Table:
        r, c = t["r"].to_numpy(), t["c"].to_numpy()
        r0, c0, shape = int(r.min()), int(c.min()), (int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1)
        at = (r - r0, c - c0)
        block = {}
        for i in inputs:
            block[i] = np.full(shape, np.nan)
            block[i][at] = t[i].to_numpy(zero_copy_only=False)
        made = f(block)
        own = np.flatnonzero((r // tile == t["_tr"][0].as_py()) & (c // tile == t["_tc"][0].as_py()))
        kept = t.select(["raster_id", "r", "c"]).take(pa.array(own))
        for o in outputs:
            kept = kept.append_column(o, pa.array(made[o][at][own].astype(np.float64), from_pandas=True))
        return kept

    return d.groupBy("raster_id", "_tr", "_tc").applyInArrow(lambda t: work(t), kinds)


def moved(a: np.ndarray, dr: int, dc: int, fill: float) -> np.ndarray:
    """What lies dr rows below and dc columns right of each pixel; `fill` beyond the array."""
    out = np.full(a.shape, fill, float)
    h, w = a.shape
    r, c = slice(max(0, -dr), min(h, h - dr)), slice(max(0, -dc), min(w, w - dc))
    if r.start < r.stop and c.start < c.stop:
        out[r, c] = a[r.start + dr : r.stop + dr, c.start + dc : c.stop + dc]
    return out


def along(a: np.ndarray, reach: int, step: tuple[int, int], most: bool) -> np.ndarray:
    """Least (or most) of the 2 * reach + 1 pixels along a direction, as far as there are any; spans double in length."""
    pick, fill = (np.maximum, -np.inf) if most else (np.minimum, np.inf)
    (dr, dc), length, n = step, 2 * reach + 1, 1
    out = np.pad(np.where(np.isnan(a), fill, a), reach, constant_values=fill)
    while 2 * n <= length:
        out = pick(out, moved(out, n * dr, n * dc, fill))
        n *= 2
    if n < length:
        out = pick(out, moved(out, (length - n) * dr, (length - n) * dc, fill))
    r, c = reach - reach * dr, reach - reach * dc  # each span begins at its first pixel, and is wanted at its middle
    return out[r : r + a.shape[0], c : c + a.shape[1]]


def rectangle(a: np.ndarray, height: int, width: int, most: bool) -> np.ndarray:
    return along(along(a, width // 2, (0, 1), most), height // 2, (1, 0), most)


def opened(a: np.ndarray, height: int, width: int) -> np.ndarray:
    return rectangle(rectangle(a, height, width, False), height, width, True)


def opened_along(a: np.ndarray, size: int, step: tuple[int, int]) -> np.ndarray:
    return along(along(a, size // 2, step, False), size // 2, step, True)


def ellipse(a: np.ndarray, half_widths: dict[int, int], most: bool) -> np.ndarray:
    """Least or most of an ellipse, of which half the width of each row is given."""
    pick, fill = (np.maximum, -np.inf) if most else (np.minimum, np.inf)
    out, lines = np.full(a.shape, fill), {}
    for dy, w in half_widths.items():
        if w not in lines:
            lines[w] = along(a, w, (0, 1), most)
        out = pick(out, moved(lines[w], dy, 0, fill))
    return out


def blur(a: np.ndarray, weights: list[float], mirror: bool = True) -> np.ndarray:
    """Separable blur; the array mirrored at its ends, or its last pixels repeated."""
    k = len(weights) // 2
    for axis in (1, 0):
        p = np.pad(a, [(k, k) if x == axis else (0, 0) for x in (0, 1)], "reflect" if mirror else "edge")
        at = lambda i: np.take(p, range(i, i + a.shape[axis]), axis)  # noqa: E731, B023
        total = at(0) * weights[0]
        for i in range(1, len(weights)):
            total = total + at(i) * weights[i]
        a = total
    return a


def laplacian(a: np.ndarray) -> np.ndarray:
    """The four neighbours less four times the pixel, mirrored at the ends."""
    p = np.pad(a, 1, "reflect")
    return (p[1:-1, :-2] + p[1:-1, 2:]) + (p[:-2, 1:-1] + p[2:, 1:-1]) - 4 * a
