"""Neighbourhoods on pixel tables (raster_id, r, c, ...).

Rectangles are separable: a window along the rows, then one along the columns, each over many columns of values at
once, so a pass costs one exchange however many masks it carries. Frames end at the image, which is what morphology
asks for; blurs mirror the image at its edges without repeating them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.operators import tiles


def rows():
    return W.partitionBy("raster_id", "r").orderBy("c")


def columns():
    return W.partitionBy("raster_id", "c").orderBy("r")


def diagonal():
    return W.partitionBy("raster_id", F.col("r") - F.col("c")).orderBy("r")


def anti():
    return W.partitionBy("raster_id", F.col("r") + F.col("c")).orderBy("r")


def erode(px: DataFrame, cols: dict[str, str], height: int, width: int, f=F.min) -> DataFrame:
    """Adds, for each new: old of cols, the least of a height x width rectangle."""
    h, w = height // 2, width // 2
    px = px.withColumns({f"_{n}": f(old).over(rows().rangeBetween(-w, w)) for n, old in cols.items()})
    return px.withColumns({n: f(f"_{n}").over(columns().rangeBetween(-h, h)) for n in cols}).drop(*[f"_{n}" for n in cols])


def dilate(px: DataFrame, cols: dict[str, str], height: int, width: int) -> DataFrame:
    return erode(px, cols, height, width, F.max)


def opened(px: DataFrame, cols: dict[str, str], height: int, width: int) -> DataFrame:
    px = erode(px, {f"_o{n}": old for n, old in cols.items()}, height, width)
    return dilate(px, {n: f"_o{n}" for n in cols}, height, width).drop(*[f"_o{n}" for n in cols])


def closed(px: DataFrame, cols: dict[str, str], height: int, width: int) -> DataFrame:
    px = dilate(px, {f"_o{n}": old for n, old in cols.items()}, height, width)
    return erode(px, {n: f"_o{n}" for n in cols}, height, width).drop(*[f"_o{n}" for n in cols])


def opened_diagonal(px: DataFrame, new: str, old: str, size: int, along=diagonal) -> DataFrame:
    """Opening by a diagonal line of so many pixels."""
    k = size // 2
    px = px.withColumn("_d", F.min(old).over(along().rangeBetween(-k, k)))
    return px.withColumn(new, F.max("_d").over(along().rangeBetween(-k, k))).drop("_d")


def half_widths(size: int) -> dict[int, int]:
    """Half the width of each row of an ellipse in a square of this size."""
    r = size // 2
    return {dy: math.floor(r * math.sqrt(1 - dy * dy / (r * r)) + 0.5) for dy in range(-r, r + 1)}


def ellipse(px: DataFrame, new: str, old: str, size: int, f=F.max) -> DataFrame:
    """Adds the most (or least) of an ellipse: one window along the rows for each width, then the rows above and below."""
    half = half_widths(size)
    px = px.withColumns({f"_w{w}": f(old).over(rows().rangeBetween(-w, w)) for w in sorted(set(half.values()))})
    parts = [f(f"_w{w}").over(columns().rangeBetween(dy, dy)) for dy, w in half.items()]
    both = F.greatest(*parts) if f is F.max else F.least(*parts)  # both skip the nulls beyond the image
    return px.withColumn(new, both).drop(*[f"_w{w}" for w in set(half.values())])


def gaussian(size: int) -> list[float]:
    """Weights of a blur whose deviation follows from its size; those of 3 are a quarter, a half, a quarter."""
    if size == 3:
        return [0.25, 0.5, 0.25]
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def _weighted(old: Column, weights: Sequence[float], over, at: str, last: Column, mirror: bool) -> Column:
    """Weighted sum along a window, the line mirrored at its ends, or its last pixels repeated."""
    k = len(weights) // 2
    near = F.collect_list(old).over(over.rowsBetween(-k, k))
    first = F.greatest(F.lit(0), F.col(at) - k)

    def term(i: int) -> Column:
        j = F.col(at) + (i - k)
        j = F.when(F.abs(j) > last, 2 * last - F.abs(j)).otherwise(F.abs(j)) if mirror else F.greatest(F.lit(0), F.least(last, j))
        return F.element_at(near, (j - first + 1).cast("int")) * F.lit(weights[i])

    total = term(0)
    for i in range(1, len(weights)):
        total = total + term(i)
    return total


def blur(px: DataFrame, cols: dict[str, str], weights: Sequence[float], mirror: bool = True) -> DataFrame:
    """Adds the separable blur of dense rasters that have more pixels a side than half the weights."""
    whole = W.partitionBy("raster_id", "r")
    px = px.withColumn("_cl", F.max("c").over(whole))
    px = px.withColumns({f"_b{n}": _weighted(F.col(old), weights, rows(), "c", F.col("_cl"), mirror) for n, old in cols.items()})
    px = px.withColumn("_rl", F.max("r").over(W.partitionBy("raster_id", "c")))
    px = px.withColumns({n: _weighted(F.col(f"_b{n}"), weights, columns(), "r", F.col("_rl"), mirror) for n in cols})
    return px.drop("_cl", "_rl", *[f"_b{n}" for n in cols])


def gradient(px: DataFrame, new: str, old: str) -> DataFrame:
    """Most less least of 3 x 3."""
    px = erode(px, {"_lo": old}, 3, 3)
    return dilate(px, {"_hi": old}, 3, 3).withColumn(new, F.col("_hi") - F.col("_lo")).drop("_lo", "_hi")


def laplacian(px: DataFrame, new: str, old: str) -> DataFrame:
    """The four neighbours less four times the pixel, mirrored at the edges."""
    before, after = lambda w: F.lag(old).over(w), lambda w: F.lead(old).over(w)
    px = px.withColumn("_h", F.coalesce(before(rows()), after(rows())) + F.coalesce(after(rows()), before(rows())))
    px = px.withColumn("_v", F.coalesce(before(columns()), after(columns())) + F.coalesce(after(columns()), before(columns())))
    return px.withColumn(new, F.col("_h") + F.col("_v") - 4 * F.col(old)).drop("_h", "_v")


def texture(px: DataFrame, new: str, old: str) -> DataFrame:
    """Blur of 15 of the absolute Laplacian."""
    px = laplacian(px, "_l", old).withColumn("_l", F.abs("_l"))
    return blur(px, {new: "_l"}, gaussian(15)).drop("_l")


def contrast(px: DataFrame, new: str, old: str, size: int = 15) -> DataFrame:
    """Distance from the mean of a box."""
    return blur(px, {"_m": old}, [1.0 / size] * size).withColumn(new, F.abs(F.col(old) - F.col("_m"))).drop("_m")


def ground(px: DataFrame, new: str, old: str, pixel_metres: float, reach: float = 35.0) -> DataFrame:
    """Terrain from a surface: opening by an ellipse of odd size, at least 5 and at most 201."""
    size = min(201, max(5, int(reach / pixel_metres)) | 1)
    half = half_widths(size)
    made = tiles.on_tiles(px, lambda v: {"_g": tiles.ellipse(tiles.ellipse(v[old], half, False), half, True)}, (old,), ("_g",), 2 * (size // 2))
    return px.join(made, ["raster_id", "r", "c"]).withColumnRenamed("_g", new)


def window_max(points: DataFrame, px: DataFrame, value: str, radius: int) -> DataFrame:
    """points (raster_id, id, r, c) with the most of value within radius rows and columns; a point meets the cells of a
    grid that its window reaches, so the join is on equal keys."""
    cell = 2 * radius + 1
    grid = lambda x: F.floor(F.col(x) / cell).cast("int")
    span = lambda x: F.explode(F.array_distinct(F.array(F.floor((F.col(x) - radius) / cell).cast("int"), F.floor((F.col(x) + radius) / cell).cast("int"))))
    p = points.withColumn("_gr", span("r")).withColumn("_gc", span("c"))
    v = px.select("raster_id", grid("r").alias("_gr"), grid("c").alias("_gc"), F.col("r").alias("_r"), F.col("c").alias("_c"), F.col(value).alias("_v"))
    near = p.join(v, ["raster_id", "_gr", "_gc"]).where((F.abs(F.col("_r") - F.col("r")) <= radius) & (F.abs(F.col("_c") - F.col("c")) <= radius))
    return near.groupBy("raster_id", "id", "r", "c").agg(F.max("_v").alias("most"))


def window_read(px: DataFrame, value: str, row: int, col: int, height: int, width: int) -> DataFrame:
    """A window of each raster, 0 beyond the image. What a window that begins before the image reads is laid at its corner."""
    cell = px.select("raster_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))))
    whole = cell.select("raster_id", F.expr(f"cast(k div {width} as int)").alias("i"), F.expr(f"cast(k % {width} as int)").alias("j"))
    inside = px.where(F.col("r").between(max(0, row), row + height - 1) & F.col("c").between(max(0, col), col + width - 1))
    inside = inside.select("raster_id", (F.col("r") - max(0, row)).alias("i"), (F.col("c") - max(0, col)).alias("j"), value)
    return whole.join(inside, ["raster_id", "i", "j"], "left").select("raster_id", "i", "j", F.coalesce(value, F.lit(0.0)).alias(value))
