"""From components to features: footprints, crowns, parcels, water."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.functions import geometry, planar
from rastrel.operators import components, stencil

#: Fixed: land cover classes, id to name and colour.
LAND_COVER = ((1, "water", "#0077be"), (2, "forest", "#228b22"), (3, "cropland", "#7cfc00"), (4, "built_up", "#dc143c"), (5, "bare_soil", "#d2b48c"), (6, "roads", "#696969"), (7, "grassland", "#90ee90"))


def _mask(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """A component's mask with a margin of one pixel, and where its corner lies."""
    r0, c0 = int(pdf.r.min()) - 1, int(pdf.c.min()) - 1
    m = np.zeros((int(pdf.r.max()) - r0 + 2, int(pdf.c.max()) - c0 + 2), bool)
    m[pdf.r - r0, pdf.c - c0] = True
    return m, r0, c0


def contours(labelled: DataFrame) -> DataFrame:
    """raster_id, label, ring (corners through pixel centres), contour_area and perimeter, in pixels."""

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = _mask(pdf)
        ring = planar.corners(planar.trace(m)) + [c0, r0]
        return pd.DataFrame([(pdf.raster_id.iloc[0], pdf.label.iloc[0], [{"x": x, "y": y} for x, y in ring.tolist()], planar.area(ring), planar.perimeter(ring))], columns=["raster_id", "label", "ring", "contour_area", "perimeter"])

    return labelled.groupBy("raster_id", "label").applyInPandas(outline, "raster_id string, label long, ring array<struct<x:double,y:double>>, contour_area double, perimeter double")


def roof_statistics(px: DataFrame) -> DataFrame:
    """height_max, height_min, height_mean and roof_profile of components' pixels (raster_id, label, ndsm); fixed values
    for fewer than 3 samples of half a metre."""
    high = F.when((F.col("ndsm") >= 0.5) & ~F.isnan("ndsm"), F.col("ndsm"))
    s = px.groupBy("raster_id", "label").agg(
        F.count(high).alias("n"), F.percentile(high, 0.95).alias("p95"), F.percentile(high, 0.10).alias("p10"), F.avg(high).alias("mean"), F.stddev_pop(high).alias("spread")
    )
    enough = F.col("n") >= 3
    pick = lambda x, rest: F.round(F.when(enough, F.col(x)).otherwise(rest), 2)
    return s.select(
        "raster_id", "label", pick("p95", 6.5).alias("height_max"), pick("p10", 3.2).alias("height_min"), pick("mean", 5.0).alias("height_mean"),
        F.when(~enough | (F.col("spread") < 0.8), "flat").otherwise("sloped").alias("roof_profile"),
    )


_FOOTPRINTS = (
    "raster_id string, label long, part int, ring array<struct<x:double,y:double>>, area_sqm double, perimeter_m double, orientation_deg double, confidence double, "
    "needs_review boolean, vertex_reduction_pct double, how string"
)


def footprints(labelled: DataFrame, metres: float, to_geo, least: float = 2.0, most: float = 45000.0, widest: float = 250.0, slimmest: float = 4.5) -> DataFrame:
    """Building footprints of components (raster_id, label, r, c, score): boxes, squared outlines, or, for blocks too large
    to be one building, boxes around their parts."""
    least, least_part = max(least, 35.0 if metres >= 0.3 else 3.0), max(least, 20.0 if metres >= 0.3 else 2.0)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        m, r0, c0 = _mask(pdf)
        contour = planar.corners(planar.trace(m))
        key = (pdf.raster_id.iloc[0], pdf.label.iloc[0])

        def add(ring, area, around, angle, sure, review, fewer, how):
            x, y = to_geo(ring[:, 0] + c0, ring[:, 1] + r0)
            pts = [{"x": round(float(a), 7), "y": round(float(b), 7)} for a, b in zip(x, y, strict=True)]
            out.append((*key, len(out) + 1, [*pts, pts[0]], round(area, 2), round(around, 2), round(angle, 1), sure, review, fewer, how))

        pixels = planar.area(contour) if len(contour) > 2 else 0.0
        area = pixels * metres**2
        if area >= least:
            centre, w, h, angle = planar.least_box(contour)
            turn = planar.folded(angle, w, h)
            if max(area, w * h * metres**2) > most or max(w, h) * metres > widest:
                far = planar.distance(m)
                peaks = far >= max(1.8, 0.32 * far.max())
                limit = max(3, int(widest / (2 * max(metres, 0.01))))
                for cx, cy in _centroids(peaks):
                    side = max(4, int(2 * min(1.8 * far[int(cy), int(cx)], limit)))
                    if least_part <= side**2 * metres**2 <= most:
                        add(planar.box_points(np.array([cx, cy]), side, side, turn), side**2 * metres**2, 4 * side * metres, 0.0, 0.85, False, 88.0, "part")
                if not out:
                    add(planar.box_points(centre, w, h, angle), area, planar.perimeter(contour) * metres, turn, 0.85, False, 75.0, "block")
            elif min(w, h) > 0 and max(w, h) / max(min(w, h), 1.0) <= slimmest and area <= most:
                ring = planar.box_points(centre, w, h, angle)
                how = "box"
                if pixels / max(w * h, 1.0) < 0.65:
                    snapped = planar.squared(planar.trace(m), turn, centre)
                    ring, how = (planar.repaired(snapped), "squared") if snapped is not None else (ring, "box")
                sure = float(pdf.score.mean())
                add(ring, area, planar.perimeter(contour) * metres, turn, round(sure, 3), sure < 0.70, 82.0, how)
        return pd.DataFrame(out, columns=[x.split()[0] for x in _FOOTPRINTS.split(", ")])

    return labelled.groupBy("raster_id", "label").applyInPandas(make, _FOOTPRINTS)


def _centroids(mask: np.ndarray) -> list[tuple[float, float]]:
    """Centroids of a mask's components."""
    left = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}
    out = []
    while left:
        front = [min(left)]
        left.discard(front[0])
        part = []
        while front:
            r, c = front.pop()
            part.append((r, c))
            for q in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    front.append(q)
        out.append(tuple(np.mean(part, 0)[::-1]))
    return out


_PARCELS = "raster_id string, label long, ring array<struct<x:double,y:double>>, area_sqm double, area_hectares double, confidence double, needs_review boolean"


def parcels(labelled: DataFrame, metres: float, to_geo, least_pixels: float, least: tuple[float, float], tolerance: float, confidence: float, most: float = math.inf) -> DataFrame:
    """Simplified outlines of components from `least` (at 0.3 m a pixel and more, below) up to `most` square metres."""
    floor = least[0] if metres >= 0.3 else least[1]

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        m, r0, c0 = _mask(pdf)
        contour = planar.trace(m)
        pixels = planar.area(contour) if len(contour) > 2 else 0.0
        area = round(pixels * metres**2, 2)
        ring = planar.repaired(planar.simplified_ring(contour, tolerance * planar.perimeter(contour))) if len(contour) > 2 else contour
        if pixels >= least_pixels and floor <= area <= most and len(ring) >= 3:
            x, y = to_geo(ring[:, 0] + c0, ring[:, 1] + r0)
            pts = [{"x": float(a), "y": float(b)} for a, b in zip(x, y, strict=True)]
            out.append((pdf.raster_id.iloc[0], pdf.label.iloc[0], [*pts, pts[0]], area, round(area / 1e4, 3), confidence, False))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _PARCELS.split(", ")])

    return labelled.groupBy("raster_id", "label").applyInPandas(make, _PARCELS)


def farms(labelled: DataFrame, metres: float, to_geo) -> DataFrame:
    return parcels(labelled, metres, to_geo, 500, (800.0, 100.0), 0.015, 0.91, 1_000_000.0)


def waters(labelled: DataFrame, metres: float, to_geo) -> DataFrame:
    return parcels(labelled, metres, to_geo, 120, (150.0, 50.0), 0.008, 0.95)


def distances(labelled: DataFrame) -> DataFrame:
    """raster_id, label, r, c, far: chamfer distance of each pixel to the outside of its component."""

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        m, r0, c0 = _mask(pdf)
        return pdf[["raster_id", "label", "r", "c"]].assign(far=planar.distance(m)[pdf.r - r0, pdf.c - c0])

    return labelled.groupBy("raster_id", "label").applyInPandas(far, "raster_id string, label long, r int, c int, far double")


def trees(px: DataFrame, score: str, metres: float, origin: tuple[float, float], step: tuple[float, float], heights: bool = True) -> DataFrame:
    """Trees of dense rasters (raster_id, r, c, score, ndsm): crowns' cores are where the distance to a canopy's edge
    exceeds a fifth of the raster's greatest."""
    least = max(1.5, 4 if metres < 0.2 else 1.5)
    d = px.withColumn("_m", (F.col(score) >= 0.45).cast("int"))
    d = stencil.ellipse(stencil.ellipse(d, "_e", "_m", 5, F.min), "_o", "_e", 5)
    far = components.shared_table(distances(components.label(d.where("_o = 1").select("raster_id", "r", "c"))), "canopies")
    top = far.groupBy("raster_id").agg(F.max("far").alias("top"))
    core = far.join(top, "raster_id").where(F.col("far") > 0.2 * F.col("top")).select("raster_id", "r", "c")
    s = components.statistics(components.label(core)).select("raster_id", F.col("seq").alias("id"), "cx", "cy", F.round("cy").cast("int").alias("r"), F.round("cx").cast("int").alias("c"))
    s = s.join(far.select("raster_id", "r", "c", "far"), ["raster_id", "r", "c"]).where(F.col("far").between(least, 120))
    s = s.join(px.select("raster_id", "r", "c", F.round(score, 3).alias("confidence")), ["raster_id", "r", "c"])
    if heights:
        reach = F.greatest(F.lit(2), F.round("far").cast("int"))
        near = s.select("raster_id", "id", F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)).alias("r"), (F.col("c") - reach).alias("c0"), (F.col("c") + reach).alias("c1"))
        most = near.join(px.select("raster_id", "r", "c", "ndsm"), ["raster_id", "r"]).where(F.col("c").between(F.col("c0"), F.col("c1")))
        s = s.join(most.groupBy("raster_id", "id").agg(F.round(F.max("ndsm"), 2).alias("height_m")), ["raster_id", "id"]).where("height_m >= 1.5")
    else:
        s = s.withColumn("height_m", F.lit(6.5))
    diameter = F.round(2 * F.col("far") * metres, 2)
    return s.select(
        "raster_id", "id", F.round(origin[0] + F.col("cx") * step[0], 7).alias("x"), F.round(origin[1] - F.col("cy") * step[1], 7).alias("y"),
        F.when(F.col("height_m") > 0, F.col("height_m")).otherwise(6.5).alias("height_m"), diameter.alias("crown_diameter_m"),
        F.round(math.pi * diameter * diameter / 4, 2).alias("crown_area_sqm"), "confidence", (F.col("confidence") < 0.75).alias("needs_review"),
    )


#: Crossings of edges and rows that are sorted at once.
_CROSSINGS = 1_000_000


def polygon_spans(features: DataFrame, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """raster_id, id, r, c0, c1: runs of pixels whose centres lie in features (raster_id, id, ring), from the crossings of
    their edges with each row. Features with coordinates that are null or not finite have none."""

    def spans(x: np.ndarray, y: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if not len(x):
            return
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        after = np.arange(1, len(x) + 1)
        after[np.append(start[1:], len(x)) - 1] = start
        low, high = np.ceil(np.minimum(y, y[after])).astype(np.int64), np.ceil(np.maximum(y, y[after])).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(high - low)])[start]
        cuts = start[np.flatnonzero(np.diff(before // _CROSSINGS)) + 1]
        for at, to in zip([0, *cuts], [*cuts, len(x)], strict=True):
            n = (high - low)[at:to]
            e = np.repeat(np.arange(at, to), n)
            r = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + low[e]
            f = after[e]
            cross = (x[f] - x[e]) * (r - y[e]) / (y[f] - y[e]) + x[e]
            order = np.lexsort((cross, r, owner[e]))
            c, first = np.ceil(cross[order]).astype(np.int64), order[::2]
            some = c[::2] < c[1::2]
            yield owner[e[first]][some], r[first][some], c[::2][some], c[1::2][some] - 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ring, n = batch.column("ring"), batch.column("ring").value_lengths().fill_null(0).to_numpy()
            points = ring.flatten()
            x, y = (points.field(k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
            x, y = (x - origin[0]) / step[0], (origin[1] - y) / step[1]
            owner = np.repeat(np.arange(len(n)), n)
            bad = np.unique(owner[~(np.isfinite(x) & np.isfinite(y))])
            ok = ~np.isin(owner, bad)
            for own, r, c0, c1 in spans(x[ok], y[ok], owner[ok]):
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([batch.column("raster_id").take(own), batch.column("id").take(own), *[pa.array(v.astype(np.int32)) for v in (r, c0, c1)]], ["raster_id", "id", "r", "c0", "c1"])

    kinds = {f.name: f.dataType.simpleString() for f in features.schema}
    return features.select("raster_id", "id", "ring").mapInArrow(run, f"raster_id {kinds['raster_id']}, id {kinds['id']}, r int, c0 int, c1 int")


def polygon_pixels(features: DataFrame, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """raster_id, id, r, c: pixels whose centres lie in features (raster_id, id, ring)."""
    return polygon_spans(features, origin, step).select("raster_id", "id", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def line_pixels(lines: DataFrame, reach: float) -> DataFrame:
    """raster_id, id, r, c: pixels within `reach` of segments (raster_id, id, x0, y0, x1, y1, in pixels)."""
    low, high = lambda a, b: F.floor(F.least(a, b) - reach).cast("int"), lambda a, b: F.ceil(F.greatest(a, b) + reach).cast("int")
    d = lines.withColumn("r", F.explode(F.sequence(low("y0", "y1"), high("y0", "y1")))).withColumn("c", F.explode(F.sequence(low("x0", "x1"), high("x0", "x1"))))
    near = geometry.segment_distance(F.col("c"), F.col("r"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= reach
    return d.where(near).select("raster_id", "id", "r", "c").distinct()
