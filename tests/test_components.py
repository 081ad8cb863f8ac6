"""Connected components against a plain flood fill."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.operators import components


def filled(m):
    """The least place that each pixel reaches, pixel by pixel."""
    out = {}
    for r, c in zip(*np.nonzero(m), strict=True):
        if (r, c) in out:
            continue
        name, todo = int(r) * components.ROW + int(c), [(r, c)]
        out[r, c] = name
        while todo:
            a, b = todo.pop()
            for i in range(max(0, a - 1), min(m.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(m.shape[1], b + 2)):
                    if m[i, j] and (i, j) not in out:
                        out[i, j] = name
                        todo.append((i, j))
    return {(int(r), int(c)): x for (r, c), x in out.items()}


def shapes():
    u = np.zeros((120, 9), bool)
    u[:, 0] = u[:, 8] = u[119] = True
    comb = np.zeros((1000, 12), bool)
    comb[:, ::3] = True
    comb[999] = True
    spiral, (r, c), turn = np.zeros((61, 61), bool), (0, 0), 0
    step, left = [(0, 1), (1, 0), (0, -1), (-1, 0)], 60
    spiral[0, 0] = True
    for length in [60, 60, 60] + [x for k in range(58, 2, -2) for x in (k, k)]:
        for _ in range(length):
            r, c = r + step[turn % 4][0], c + step[turn % 4][1]
            spiral[r, c] = True
        turn += 1
    assert left and spiral.sum() > 1000
    dust = np.random.default_rng(3).random((90, 70)) < 0.42
    zigzag = np.zeros((80, 41), bool)
    for i in range(80):
        zigzag[i, abs(i % 80 - 40)] = True
    return {"u": u, "comb": comb, "spiral": spiral, "dust": dust, "zigzag": zigzag}


@pytest.mark.parametrize(("tile", "few"), [(1024, 500_000), (8, 500_000), (16, 0)])
def test_components_equal_a_flood_fill(spark, tile, few):
    masks = shapes()
    rows = [(name, int(r), int(c)) for name, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)]
    d = spark.createDataFrame(rows, "raster_id string, r int, c int")
    got = {}
    for x in components.label(d, tile, few).collect():
        got.setdefault(x.raster_id, {})[x.r, x.c] = x.label
    assert got == {name: filled(m) for name, m in masks.items()}
    assert len(set(got["u"].values())) == len(set(got["comb"].values())) == len(set(got["spiral"].values())) == len(set(got["zigzag"].values())) == 1


def test_no_pixels_and_no_end(spark):
    d = spark.createDataFrame([], "raster_id string, r int, c int")
    assert components.label(d).count() == 0
    chain = spark.range(50).select(F.lit("a").alias("raster_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components.star(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.star(chain, rounds=1)
