"""Geometry as column expressions over arrays of struct<x, y>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrel.functions.crs import METRES


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def closed(ring: Column) -> Column:
    """The ring with its first point at its end."""
    first, last = ring[0], F.element_at(ring, -1)
    return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def _over_segments(line: Column, f) -> Column:
    """Sum of f(a, b) over a line's segments; 0 for fewer than two points."""
    n = F.size(line)
    steps = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + f(line[i], line[i + 1]))


def area(ring: Column, kx=1.0, ky=1.0) -> Column:
    """Shoelace area of a closed ring whose axes are scaled; seen from its first point, where products keep their digits."""
    x, y = ring[0]["x"], ring[0]["y"]
    return F.abs(_over_segments(ring, lambda a, b: (a["x"] - x) * (b["y"] - y) - (b["x"] - x) * (a["y"] - y))) / 2.0 * kx * ky


def length(line: Column, kx=1.0, ky=1.0) -> Column:
    return _over_segments(line, lambda a, b: F.hypot((b["x"] - a["x"]) * kx, (b["y"] - a["y"]) * ky))


def metric_scale(ring: Column) -> Column:
    """Metres of a degree of longitude at the mean latitude of a ring's points, its end included."""
    mean = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p["y"]) / F.size(ring)
    return F.when(F.abs(mean) <= 90, F.cos(F.radians(mean))).otherwise(1.0) * METRES


def road_length(line: Column) -> Column:
    """Metres along a line, each segment at its middle latitude; 35 for fewer than two points."""
    step = lambda a, b: F.hypot((b["x"] - a["x"]) * METRES * F.cos(F.radians((a["y"] + b["y"]) / 2.0)), (b["y"] - a["y"]) * METRES)
    return F.when(F.size(line) >= 2, F.round(_over_segments(line, step), 2)).otherwise(35.0)


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def centre(ring: Column) -> tuple[Column, Column]:
    """Mean of the points as they are, a closing one counted."""
    total = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    return total("x"), total("y")


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds a point, by the parity of crossings."""
    hit = lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0)
    return _over_segments(ring, hit) % 2 == 1


def segment_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / n))).otherwise(0.0)
    return F.hypot(x - (x0 + t * dx), y - (y0 + t * dy))


def crown_height(height: Column) -> Column:
    """A tree's height as it is drawn, held to 3 to 7.5 metres."""
    return F.greatest(F.lit(3.0), F.least(F.lit(7.5), height))


def crown_ring(x: Column, y: Column, diameter: Column, points: int = 10) -> Column:
    """A tree's crown as a regular polygon, its diameter held to 1.8 to 4 metres."""
    radius = F.greatest(F.lit(1.8), F.least(F.lit(4.0), diameter)) / 2.0
    lat, lon = radius / METRES, radius / (METRES * F.cos(F.radians(y)))
    ring = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: point(x + lon * F.cos(i * (2 * math.pi / points)), y + lat * F.sin(i * (2 * math.pi / points))))
    return F.concat(ring, F.slice(ring, 1, 1))
