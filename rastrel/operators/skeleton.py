"""Skeletons and their graphs: thinning, degrees, spur pruning, chains, centrelines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.functions import planar

_STEPS = ((0, 1), (1, -1), (1, 0), (1, 1))


def thin_once(px: DataFrame, mask: str, second: bool = False) -> DataFrame:
    """One pass of Zhang-Suen thinning on a dense mask, by neighbours along windows: adds thinned."""
    across, down = W.partitionBy("raster_id", "r").orderBy("c"), W.partitionBy("raster_id", "c").orderBy("r")
    at = lambda col, w, k: F.coalesce(F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w), F.lit(0))
    d = px.withColumns({"_w": at(mask, across, 1), "_e": at(mask, across, -1)})
    d = d.withColumns({"_n": at(mask, down, 1), "_s": at(mask, down, -1), "_nw": at("_w", down, 1), "_ne": at("_e", down, 1), "_sw": at("_w", down, -1), "_se": at("_e", down, -1)})
    ring = [F.col(x) for x in ("_n", "_ne", "_e", "_se", "_s", "_sw", "_w", "_nw")]
    filled = sum(ring, F.lit(0))
    rises = sum((((a == 0) & (b == 1)).cast("int") for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)), F.lit(0))
    n, e, s, w = (F.col(x) for x in ("_n", "_e", "_s", "_w"))
    open_to = (n * e * w == 0) & (n * s * w == 0) if second else (n * e * s == 0) & (e * s * w == 0)
    gone = (F.col(mask) == 1) & filled.between(2, 6) & (rises == 1) & open_to
    return d.withColumn("thinned", F.when(gone, 0).otherwise(F.col(mask))).drop("_n", "_ne", "_e", "_se", "_s", "_sw", "_w", "_nw")


def edges(skeleton: DataFrame) -> DataFrame:
    """raster_id, r0, c0, r1, c1 of neighbouring skeleton pixels, each pair once: equi-joins on shifted coordinates."""
    a = skeleton.select("raster_id", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(F.array(*[F.struct(F.lit(x).alias("dr"), F.lit(y).alias("dc")) for x, y in _STEPS])).alias("d"))
    a = a.select("raster_id", "r0", "c0", (F.col("r0") + F.col("d.dr")).alias("r1"), (F.col("c0") + F.col("d.dc")).alias("c1"))
    return a.join(skeleton.select("raster_id", F.col("r").alias("r1"), F.col("c").alias("c1")), ["raster_id", "r1", "c1"]).select("raster_id", "r0", "c0", "r1", "c1")


def degrees(skeleton: DataFrame) -> DataFrame:
    """raster_id, r, c, degree of every skeleton pixel."""
    e = edges(skeleton)
    ends = e.select("raster_id", F.col("r0").alias("r"), F.col("c0").alias("c")).unionByName(e.select("raster_id", F.col("r1").alias("r"), F.col("c1").alias("c")))
    n = ends.groupBy("raster_id", "r", "c").agg(F.count("*").alias("degree"))
    return skeleton.select("raster_id", "r", "c").join(n, ["raster_id", "r", "c"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


Graph = dict[tuple[int, int], list[tuple[int, int]]]


def graph(skeleton: np.ndarray) -> Graph:
    """Neighbours of each pixel, in raster order."""
    pixels = {(int(r), int(c)) for r, c in zip(*np.nonzero(skeleton), strict=True)}
    around = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
    return {p: [q for dr, dc in around if (q := (p[0] + dr, p[1] + dc)) in pixels] for p in sorted(pixels)}


def path_length(path: list[tuple[int, int]], metres: float) -> float:
    return sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False)) * metres


def pruned(g: Graph, least: float, metres: float) -> Graph:
    """Without dead ends shorter than `least` metres, until there are none; a dead end goes up to the first pixel that
    isn't one of two neighbours, which stays."""
    g = {p: list(n) for p, n in g.items()}
    changed = True
    while changed:
        changed = False
        for end in [p for p, n in g.items() if len(n) == 1]:
            if end not in g:
                continue
            path, seen = [end], {end}
            while len(g[path[-1]]) <= 2:
                on = [q for q in g[path[-1]] if q not in seen]
                if not on:
                    break
                path.append(on[0])
                seen.add(on[0])
                if len(g[on[0]]) != 2:
                    break
            if path_length(path, metres) < least and len(path) > 1:
                for p in path[:-1]:
                    for q in g.pop(p):
                        if q in g:
                            g[q].remove(p)
                changed = True
    return g


def chains(g: Graph) -> list[list[tuple[int, int]]]:
    """Paths between pixels that don't have two neighbours. Where all have two, one path of all in raster order."""
    knots = [p for p, n in g.items() if len(n) != 2]
    if not knots:
        return [list(g)] if g else []
    out, walked = [], set()
    for knot in knots:
        for to in g[knot]:
            if frozenset((knot, to)) in walked:
                continue
            path = [knot, to]
            walked.add(frozenset(path))
            while len(g[path[-1]]) == 2:
                on = next((q for q in g[path[-1]] if q != path[-2]), None)
                if on is None or frozenset((path[-1], on)) in walked:
                    break
                walked.add(frozenset((path[-1], on)))
                path.append(on)
            out.append(path)
    return out


def straightened(path: list[tuple[int, int]], degrees: float = 15.0) -> list[tuple[int, int]]:
    """Without points where the way from the last one kept turns by less than so many degrees."""
    if len(path) < 3:
        return path
    kept, least = [path[0]], math.cos(math.radians(degrees))
    for here, on in zip(path[1:-1], path[2:], strict=True):
        a, b = (here[0] - kept[-1][0], here[1] - kept[-1][1]), (on[0] - here[0], on[1] - here[1])
        n = math.hypot(*a) * math.hypot(*b)
        if n > 1e-8 and max(-1.0, min(1.0, (a[0] * b[0] + a[1] * b[1]) / n)) < least:
            kept.append(here)
    return [*kept, path[-1]]


_LINES = "raster_id string, label long, line array<struct<x:double,y:double>>, points int, length_m double, width_m double, confidence double, needs_review boolean"


def centrelines(labelled: DataFrame, metres: float, to_geo, least: float = 15.0) -> DataFrame:
    """Road centrelines of components (raster_id, label, r, c, score). to_geo: (column, row) to (x, y), on arrays.

    From 0.3 m a pixel on, spurs are at least 35 m long and lines 45 m, else `least`.
    """
    spur, shortest = (max(35.0, least), max(45.0, least)) if metres >= 0.3 else (least, least)

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf.r.min() - 1, pdf.c.min() - 1
        shape = (pdf.r.max() - r0 + 2, pdf.c.max() - c0 + 2)
        mask, score = np.zeros(shape, bool), np.zeros(shape)
        mask[pdf.r - r0, pdf.c - c0], score[pdf.r - r0, pdf.c - c0] = True, pdf.score
        far, out = planar.distance(mask), []
        for path in chains(pruned(graph(planar.thinned(mask)), spur, metres)):
            path = straightened(path)
            length = round(path_length(path, metres), 2)
            if len(path) < 2 or length < shortest:
                continue
            r, c = np.array(path).T
            line = planar.simplified(np.stack(to_geo(c + float(c0), r + float(r0)), 1), 2e-5)
            sure = round(float(score[r, c].mean()), 3)
            out.append((pdf.raster_id.iloc[0], pdf.label.iloc[0], [{"x": x, "y": y} for x, y in line.tolist()], len(line), length, round(float(2 * far[r, c].mean() * metres), 2), sure, sure < 0.75))
        return pd.DataFrame(out, columns=["raster_id", "label", "line", "points", "length_m", "width_m", "confidence", "needs_review"])

    return labelled.groupBy("raster_id", "label").applyInPandas(lines, _LINES)
