"""Queries on whole scenes: class scores, features, the demonstration."""

from __future__ import annotations

import sqlite3
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from rastrel.operators import attributes, components, features, mapalgebra, skeleton, stencil, vectorize
from rastrel.plans import pipeline
from rastrel.plans.features import elements
from rastrel.plans.registry import query
from rastrel.sources import rasters, scenes, vectors

#: Side of the demonstration scene in queries, and its pixel: degrees and metres.
SIDE = 600
STEP = (0.006 / SIDE, 0.006 / SIDE)
ORIGIN = (scenes.DEMO_BOUNDS[0], scenes.DEMO_BOUNDS[3])
METRES = 0.006 * 111320 / SIDE


def _geo(c, r):
    return ORIGIN[0] + c * STEP[0], ORIGIN[1] - r * STEP[1]


def _demo(spark):
    return scenes.demo_scene(spark, SIDE)


@query(f"WITH d AS ({scenes.demo_sql(600)}) SELECT red, green, blue, count(*) AS pixels, sum(dsm - dtm) AS height FROM d GROUP BY red, green, blue")
def s7_demo_scene(spark, sf_dir):
    """The demonstration scene at its full size, by colour."""
    return scenes.demo_scene(spark).groupBy("red", "green", "blue").agg(F.count("*").alias("pixels"), F.sum(F.col("dsm") - F.col("dtm")).alias("height"))


_R, _C = "OVER (PARTITION BY r ORDER BY c", "OVER (PARTITION BY c ORDER BY r"
_D, _A = "OVER (PARTITION BY r - c ORDER BY r", "OVER (PARTITION BY r + c ORDER BY r"
_BANDS = f"""d AS (SELECT *, (red + green + blue) / 3.0::DOUBLE AS bright, greatest(dsm - dtm, 0) AS h FROM ({scenes.demo_sql(SIDE)})),
t AS (SELECT *, sqrt((pow(red - bright, 2) + pow(green - bright, 2) + pow(blue - bright, 2)) / 3.0::DOUBLE) AS dev FROM d)"""


def _span(f: str, x: str, k: int, over: str) -> str:
    return f"{f}({x}) {over} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def _rectangle(name: str, of: str, new: str, old: str, height: int, width: int, fs=("min", "max")) -> str:
    """Table expressions that add new: old, eroded and dilated (or one of them) by a rectangle."""
    out, at = "", of
    for i, f in enumerate(fs):
        last = i + 1 == len(fs)
        out += f", {name}{i}a AS (SELECT *, {_span(f, old if not i else f'{new}_', width // 2, _R)} AS {new}_w{i} FROM {at}), {name}{i} AS (SELECT *, {_span(f, f'{new}_w{i}', height // 2, _C)} AS {new if last else new + '_'} FROM {name}{i}a)"
        at = f"{name}{i}"
    return out


def _corridors(of: str) -> str:
    """Table expressions that add road to `of`'s columns with paved."""
    out = _rectangle("ca", of, "c1", "paved", 3, 13) + _rectangle("cb", "ca1", "c2", "paved", 13, 3)
    out += f", cc AS (SELECT *, {_span('min', 'paved', 5, _D)} AS e3, {_span('min', 'paved', 5, _A)} AS e4 FROM cb1), cd AS (SELECT *, greatest(c1, c2, {_span('max', 'e3', 5, _D)}, {_span('max', 'e4', 5, _A)}) AS way FROM cc)"
    return out + _quarters("cw", "cd", "way", "ways") + ", road AS (SELECT *, least(0.95::DOUBLE, greatest(0, ways * 1.8::DOUBLE)) AS road FROM cwb)"


def _quarters(name: str, of: str, old: str, new: str) -> str:
    """A blur of a quarter, a half, a quarter, mirrored, each way."""
    side = lambda x, w: f"coalesce(lag({x}) {w}), lead({x}) {w})) * 0.25::DOUBLE + {x} * 0.5::DOUBLE + coalesce(lead({x}) {w}), lag({x}) {w})) * 0.25::DOUBLE"
    return f", {name}a AS (SELECT *, {side(old, _R)} AS {new}_ FROM {of}), {name}b AS (SELECT *, {side(f'{new}_', _C)} AS {new} FROM {name}a)"


def _kernel(name: str, of: str, old: str, new: str, weights: list[float]) -> str:
    """A mirrored blur by a kernel, each way, by a join with where each pixel's weights lie."""
    k, last = len(weights) // 2, SIDE - 1
    values = ", ".join(f"({i - k}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    out = f", {name}k AS (SELECT x::INTEGER AS x, ({last} - abs({last} - abs(x + o)))::INTEGER AS y, w FROM range({SIDE}) a(x), (VALUES {values}) b(o, w))"
    out += f", {name}a AS (SELECT q.r, k.x AS c, sum(k.w * q.{old}) AS v FROM {of} q JOIN {name}k k ON q.c = k.y GROUP BY q.r, k.x)"
    return out + f", {name}b AS (SELECT k.x AS r, q.c, sum(k.w * q.v) AS {new} FROM {name}a q JOIN {name}k k ON q.r = k.y GROUP BY k.x, q.c), {name} AS (SELECT * FROM {of} JOIN {name}b USING (r, c))"


def _grown(name: str, of: str, old: str, new: str, size: int) -> str:
    """Dilation by an ellipse: by the width of each of its rows, then over the rows."""
    half = stencil.half_widths(size)
    wide = ", ".join(f"{_span('max', old, w, _R)} AS w{w}" for w in sorted(set(half.values())))
    rows = ", ".join(f"{'lag' if dy < 0 else 'lead'}(w{w}, {abs(dy)}) {_C})" for dy, w in half.items())
    return f", {name}w AS (SELECT *, {wide} FROM {of}), {name} AS (SELECT * EXCLUDE ({', '.join(f'w{w}' for w in sorted(set(half.values())))}), greatest({rows}) AS {new} FROM {name}w)"


def _classes(of: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{k}' AS layer, count(*) FILTER ({k} >= {cut}) AS pixels, round(sum({k}), 4) AS score FROM {of}" for k, cut in mapalgebra.CUTS.items())
    return f" SELECT layer, pixels::BIGINT AS pixels, score::DOUBLE AS score FROM ({parts})"


_QUICK = (
    f"""WITH {_BANDS}, g AS (SELECT * REPLACE (dev * pow(1.5::DOUBLE, 0.5::DOUBLE) AS dev), (2 * green - red - blue) / (red + green + blue + 1e-6) AS excess, coalesce(abs(bright - lag(bright) {_R})), 0) + coalesce(abs(bright - lag(bright) {_C})), 0) AS grad,
 (sum(bright) {_R} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) + greatest(0, 7 - c) * first_value(bright) {_R}) + greatest(0, c + 7 - {SIDE - 1}) * first_value(bright) OVER (PARTITION BY r ORDER BY c DESC)) / 15.0::DOUBLE AS m1 FROM t),
m AS (SELECT *, abs(bright - (sum(m1) {_C} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) + greatest(0, 7 - r) * first_value(m1) {_C}) + greatest(0, r + 7 - {SIDE - 1}) * first_value(m1) OVER (PARTITION BY c ORDER BY r DESC)) / 15.0::DOUBLE) AS contrast, green > red AND green > blue AS leafy FROM g),
w AS (SELECT *, CASE WHEN leafy AND excess > 0.01 THEN greatest(0.4::DOUBLE, least(1.0::DOUBLE, excess * 4.5::DOUBLE)) ELSE 0.0::DOUBLE END AS tree,
 CASE WHEN ((blue > green - 5 AND blue > red + 2 AND excess < 0.02) OR (grad < 8 AND NOT leafy AND bright > 30 AND bright < 170 AND dev < 18) OR (bright < 36 AND NOT leafy)) AND grad < 16 AND NOT leafy THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS water,
 red > green + 3 AND red > blue + 5 AND bright > 50 AND bright < 200 AND grad < 7 AND NOT leafy AS bare FROM m),
k AS (SELECT *, tree < 0.3 AND water < 0.2 AS clear FROM w),
roofs AS (SELECT *, bright > 130 AND contrast > 5 AND clear AS tin, red > green + 8 AND red > blue + 10 AND bright > 55 AND bright < 185 AND grad > 8 AND clear AND NOT bare AS clay, bright > 65 AND bright < 245 AND dev < 30 AND contrast > 2.8 AND grad > 6 AND clear AS flat FROM k),
pave AS (SELECT *, (dev < 24 AND bright > 35 AND bright < 185 AND clear AND NOT clay AND NOT bare)::INTEGER AS paved FROM roofs)"""
    + _corridors("pave")
    + """, x AS (SELECT *, CASE WHEN flat AND contrast > 4.5 THEN 0.0::DOUBLE ELSE road END AS way1 FROM road),
y AS (SELECT *, CASE WHEN (tin OR clay OR flat OR grad > 12) AND clear AND NOT bare AND way1 <= 0.45 THEN 0.90::DOUBLE ELSE 0.0::DOUBLE END AS built FROM x),
z AS (SELECT *, CASE WHEN h >= 1.8 THEN tree ELSE tree * 0.15::DOUBLE END AS trees, CASE WHEN excess > 0.05 AND tree < 0.35 AND built < 0.2 AND NOT bare AND h < 1.0 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS farms, CASE WHEN h < 1.2 THEN way1 ELSE 0.0::DOUBLE END AS roads FROM y),
f AS (SELECT *, greatest(built, CASE WHEN h >= 2.5 AND trees < 0.3 AND NOT bare THEN 0.94::DOUBLE ELSE 0.0::DOUBLE END) AS buildings FROM z)"""
    + _classes("f")
)

_SCORES = (
    f"""WITH {_BANDS}, g AS (SELECT *, (2.0::DOUBLE * green - red - blue) / greatest(red + green + blue, 1.0::DOUBLE) AS excess, floor(0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue + 0.5::DOUBLE) AS gray FROM t)"""
    + _rectangle("lo", "g", "low", "gray", 3, 3, ("min",))
    + _rectangle("hi", "lo0", "high", "gray", 3, 3, ("max",))
    + f""", l AS (SELECT *, high - low AS grad, abs(coalesce(lag(gray) {_R}), lead(gray) {_R})) + coalesce(lead(gray) {_R}), lag(gray) {_R})) + coalesce(lag(gray) {_C}), lead(gray) {_C})) + coalesce(lead(gray) {_C}), lag(gray) {_C})) - 4 * gray) AS lap FROM hi0)"""
    + _kernel("tx", "l", "lap", "texture", stencil.gaussian(15))
    + _kernel("ct", "tx", "bright", "mean", [1.0 / 15] * 15)
    + """, v AS (SELECT *, abs(bright - mean) AS contrast, green > red + 4 AND green > blue + 4 AND excess > 0.03 AS leafy FROM ct),
b AS (SELECT *, (red > green + 3 AND red > blue + 5 AND bright > 50 AND bright < 200 AND texture < 5 AND grad < 12 AND NOT leafy)::INTEGER AS bare, (leafy AND texture < 3.5 AND grad < 8)::INTEGER AS lawn FROM v)"""
    + _grown("gb", "b", "bare", "bares", 11)
    + _grown("gl", "gb", "lawn", "lawns", 7)
    + """, w AS (SELECT *, greatest(bares, lawns) = 1 AS open_, CASE WHEN leafy THEN greatest(0.4::DOUBLE, least(1.0::DOUBLE, excess * 4.5::DOUBLE)) ELSE 0.0::DOUBLE END * CASE WHEN h >= 1.8 THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END AS trees, grad < 8 AND NOT leafy AS calm FROM gl),
wet AS (SELECT *, CASE WHEN ((blue > red + 5 AND blue > green - 5 AND bright < 160 AND excess < 0.05) OR (green > red + 3 AND green > blue + 3 AND excess >= 0 AND excess < 0.12 AND bright < 110 AND texture < 4 AND calm)
  OR (bright < 100 AND texture < 3.5 AND calm AND red - blue < 25 AND dev < 16 AND bare = 0)) AND NOT leafy AND NOT open_ AND grad <= 12 THEN 0.96::DOUBLE ELSE 0.0::DOUBLE END AS water FROM w),
k AS (SELECT *, trees < 0.3 AND water < 0.25 AS clear FROM wet), pave AS (SELECT *, (dev < 26 AND bright > 35 AND bright < 195 AND clear)::INTEGER AS paved FROM k)"""
    + _corridors("pave")
    + """, roofs AS (SELECT *, CASE WHEN h < 1.4 THEN road ELSE 0.0::DOUBLE END * CASE WHEN open_ THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS way1, bright > 130 AND contrast > 5 AND clear AS tin,
  red > green + 8 AND red > blue + 10 AND bright > 55 AND bright < 185 AND trees < 0.25 AND grad > 8 AND contrast > 4 AND bare = 0 AS clay, bright > 65 AND bright < 245 AND dev < 30 AND contrast > 2.8 AND grad > 6 AND clear AS flat FROM road),
x AS (SELECT *, CASE WHEN flat AND contrast > 4.5 THEN 0.0::DOUBLE ELSE way1 END AS roads, (tin OR clay OR flat OR (grad > 12 AND clear AND contrast > 6))::INTEGER AS roof FROM roofs)"""
    + _rectangle("so", "x", "solid", "roof", 3, 3)
    + _quarters("rb", "so1", "solid", "roofed")
    + """, y AS (SELECT *, greatest(CASE WHEN roads > 0.45 OR water > 0.25 OR trees > 0.4 OR open_ THEN 0.0::DOUBLE ELSE greatest(0, least(0.95::DOUBLE, roofed * 1.5::DOUBLE)) END, CASE WHEN h >= 2.5 AND trees < 0.3 AND NOT open_ THEN 0.94::DOUBLE ELSE 0.0::DOUBLE END) AS buildings FROM rbb),
z AS (SELECT *, (excess > 0.06 AND trees < 0.35 AND buildings < 0.2 AND NOT open_ AND texture < 8 AND h < 1.0)::INTEGER AS farm FROM y)"""
    + _rectangle("fi", "z", "field", "farm", 11, 11)
    + ", f AS (SELECT *, CASE WHEN farm = 1 AND field = 1 THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END AS farms FROM fi1)"
    + _classes("f")
)


def _by_class(d):
    parts = [F.struct(F.lit(k).alias("layer"), F.col(k).alias("score"), (F.col(k) >= cut).cast("int").alias("held")) for k, cut in mapalgebra.CUTS.items()]
    d = d.select(F.explode(F.array(*parts)).alias("s")).select("s.*")
    return d.groupBy("layer").agg(F.sum("held").alias("pixels"), F.round(F.sum("score"), 4).alias("score"))


@query(_SCORES)
def p6_p14_class_scores(spark, sf_dir):
    """Pixels and sums of scores of each class on the demonstration scene."""
    return _by_class(mapalgebra.scores(_demo(spark)))


@query(_QUICK)
def p13_quick_scores(spark, sf_dir):
    """The same by the second set of thresholds."""
    return _by_class(mapalgebra.quick_scores(_demo(spark)))


_HIGH = f"""WITH d AS ({scenes.demo_sql(SIDE)}), h AS (SELECT r, c, dsm - dtm AS h, CASE WHEN dsm - dtm > 11 THEN 1 ELSE 2 END AS label FROM d WHERE dsm - dtm > 5)"""


@query(_HIGH + " SELECT label::BIGINT AS label, round(quantile_cont(h + r * 0.011, 0.95), 2) AS height_max, round(quantile_cont(h + r * 0.011, 0.10), 2) AS height_min, round(avg(h + r * 0.011), 2) AS height_mean, CASE WHEN stddev_pop(h + r * 0.011) < 0.8 THEN 'flat' ELSE 'sloped' END AS roof_profile FROM h GROUP BY label")
def v7_roof_statistics(spark, sf_dir):
    """Roofs of two sets of pixels that rise to the south."""
    h = mapalgebra.ndsm(F.col("dsm"), F.col("dtm"))
    d = _demo(spark).where(h > 5).select("raster_id", F.when(h > 11, 1).otherwise(2).cast("long").alias("label"), (h + F.col("r") * 0.011).alias("ndsm"))
    return vectorize.roof_statistics(d).drop("raster_id")


def _high(spark):
    h = mapalgebra.ndsm(F.col("dsm"), F.col("dtm"))
    on = _demo(spark).where((h > 5) & (F.col("red") > 100)).withColumn("score", F.lit(0.9)).withColumn("ndsm", h)
    return components.label(on.select("raster_id", "r", "c")).join(on, ["raster_id", "r", "c"])


@query()
def v2_contours(spark, sf_dir):
    """V2: outlines of the demonstration's two buildings."""
    return vectorize.contours(_high(spark).select("raster_id", "label", "r", "c")).select("label", F.size("ring").alias("corners"), "contour_area", F.round("perimeter", 6).alias("perimeter"))


@query()
def v3_footprints(spark, sf_dir):
    """Footprints of the demonstration's two buildings."""
    d = vectorize.footprints(_high(spark).select("raster_id", "label", "r", "c", "score"), 0.5, _geo)
    return d.select("label", "part", "how", "area_sqm", "perimeter_m", "orientation_deg", "confidence", "needs_review", F.size("ring").alias("points"))


@query()
def v9_trees(spark, sf_dir):
    """The demonstration's trees."""
    d = mapalgebra.spectral(_demo(spark)).withColumn("ndsm", mapalgebra.ndsm(F.col("dsm"), F.col("dtm")))
    d = d.withColumn("trees", mapalgebra.tree_score(F.col("ndsm")))
    return vectorize.trees(d, "trees", METRES, ORIGIN, STEP).drop("raster_id")


@query()
def v10_v11_parcels(spark, sf_dir):
    """The demonstration's lake as water, its lawn as a parcel."""
    d = _demo(spark)
    blue, lawn = d.where("blue > 190 and red < 100"), d.where("green = 120 and red = 50")
    label = lambda x: components.label(x.select("raster_id", "r", "c"))
    water = vectorize.waters(label(blue), METRES, _geo).withColumn("layer", F.lit("water"))
    farms = vectorize.farms(label(lawn), METRES, _geo).withColumn("layer", F.lit("farms"))
    return water.unionByName(farms).select("layer", "label", "area_sqm", "area_hectares", F.size("ring").alias("points"))


@query()
def g7_centrelines(spark, sf_dir):
    """Centrelines of the demonstration's crossing roads."""
    on = _demo(spark).where("red = 130").withColumn("score", F.lit(0.9))
    d = components.label(on.select("raster_id", "r", "c")).join(on.select("raster_id", "r", "c", "score"), ["raster_id", "r", "c"])
    return skeleton.centrelines(d, METRES, _geo).select("label", "points", "length_m", "width_m", "confidence", "needs_review")


@query(
    f"""WITH k AS (SELECT id, seq, 61 + (seq // 2) * (5 + id % 3) AS r, 5 + id * 7 + (seq % 2) * 4 AS c FROM range(20) a(id), range(4) b(seq)),
ray AS (SELECT id, seq, w, min(s) FILTER (NOT (r + s * dr BETWEEN 30 AND 60 AND c + s * dc BETWEEN 0 AND {SIDE - 1})) AS miss FROM k, (VALUES (1, -1, -1), (2, -1, 0), (3, 0, -1), (4, -1, 1)) v(w, dc, dr), range(1, 90) t(s) GROUP BY id, seq, w),
n AS (SELECT id, coalesce(miss, 90) - 1 AS steps FROM ray)
SELECT id, greatest(5.0::DOUBLE, least(140.0::DOUBLE, round(quantile_cont(steps, 0.75) * 0.5::DOUBLE * tan(radians(58::DOUBLE)), 1))) AS shadow_m FROM n WHERE steps >= 4 GROUP BY id HAVING count(*) >= 3"""
)
def f13_shadow_height(spark, sf_dir):
    """heights from the dark strips beside boxes; the scene is dark north of row 60."""
    d = _demo(spark).withColumns({b: F.when(F.col("r").between(30, 60), 20.0).otherwise(200.0) for b in ("red", "green", "blue")})
    ids = spark.range(20).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    corners = ids.selectExpr("'demo' raster_id", "id", "k seq", "cast(61 + (k div 2) * (5 + id % 3) as int) r", "cast(5 + id * 7 + (k % 2) * 4 as int) c")
    return attributes.shadow_heights(corners, d, 0.5).select("id", "shadow_m")


@query()
def e1_demo_features(spark, sf_dir):
    """Features of the demonstration scene, from its pixels."""
    d = pipeline.process_scene(_demo(spark), METRES, ORIGIN, STEP)
    return d.select("layer", "feature_id", "geom_type", "area_sqm", "length_m", "height_max", "height_m", "confidence", "needs_review")


@query()
def e1_demo_summary(spark, sf_dir):
    """The summary of the demonstration scene without heights."""
    return features.summary(pipeline.process_scene(_demo(spark), METRES, ORIGIN, STEP, heights=False))


@query()
def e2_extract_aoi(spark, sf_dir):
    """The demonstration's features conflated with a reference map of tagged elements."""
    d = _demo(spark)
    out = pipeline.extract_aoi(d, elements(spark, sf_dir), METRES, ORIGIN, STEP, (d, "dtm", ORIGIN, STEP))
    return out.select("layer", "feature_id", "given", "geom_type", "name", "area_sqm", "length_m", "height_max", "height_min", "shadow_m", "terrain_elevation_m")


@query()
def e3_upload(spark, sf_dir):
    """Features of the demonstration scene with the ground estimated from its surface."""
    d = pipeline.uploaded(_demo(spark), METRES, ORIGIN, STEP)
    return d.select("layer", "feature_id", "geom_type", "area_sqm", "length_m", "height_max", "height_m", "confidence")


@query(f"WITH d AS ({scenes.demo_sql(60)}) SELECT r, c, red, green, blue FROM d")
def s1_tiff_scan(spark, sf_dir):
    """The demonstration scene at 60 x 60, written as a TIFF file to the shared folder and scanned."""
    d = scenes.demo_scene(spark, 60).toPandas().sort_values(["r", "c"])
    data = np.stack([d[b].to_numpy().reshape(60, 60) for b in ("red", "green", "blue")]).astype(np.uint8)
    path = components.shared_file(spark, "scene.tif", rasters.write_tiff(data, scenes.DEMO_BOUNDS))
    return rasters.rgb(rasters.tiffs(spark, path)[0]).select("r", "c", "red", "green", "blue")


_TILES = "SELECT 15 AS z, 10 + k AS x, 20::BIGINT AS y, i, j, (i * 7 + j + k) * 1.0::DOUBLE AS red, (i + j * 3) * 1.0::DOUBLE AS green, (k * 50) * 1.0::DOUBLE AS blue FROM range(2) a(k), range(16) b(i), range(16) c(j)"


def _tiles(spark):
    return spark.range(2 * 256).selectExpr(
        "15 z", "10 + id div 256 x", "cast(20 as bigint) y", "cast(id % 256 div 16 as int) i", "cast(id % 16 as int) j",
        "(id % 256 div 16 * 7 + id % 16 + id div 256) * 1.0D red", "(id % 256 div 16 + id % 16 * 3) * 1.0D green", "(id div 256 * 50) * 1.0D blue",
    )


@query(
    f"""WITH t AS ({_TILES}), g AS (SELECT x, y, i, j FROM range(10, 13) a(x), range(20, 22) b(y), range(16) c(i), range(16) d(j))
SELECT ((y - 20) * 16 + i)::INTEGER AS r, ((x - 10) * 16 + j)::INTEGER AS c, coalesce(red, 128) AS red, coalesce(green, 128) AS green, coalesce(blue, 128) AS blue FROM g LEFT JOIN t USING (x, y, i, j)"""
)
def s2_mosaic(spark, sf_dir):
    """Tiles of 16 x 16 laid out, grey where a tile is missing."""
    grid = spark.range(6).selectExpr("1 id", "15 z", "10 + id % 3 x", "20 + id div 3 y")
    return rasters.mosaic(grid, _tiles(spark), 16).drop("raster_id")


@query(f"WITH t AS ({_TILES}) SELECT i::INTEGER AS i, j::INTEGER AS j, red * 256 + green + blue / 256 - 32768 AS metres FROM t WHERE x = 11")
def s5_terrain(spark, sf_dir):
    """Elevations of the tile that holds an area's corner."""
    area = spark.sql("select 1 id, 11.5D / 32768 * 360 - 180 min_lon, degrees(atan(sinh(pi() * (1 - 2 * 20.5D / 32768)))) max_lat")
    return rasters.terrain(area, _tiles(spark), 15).select("i", "j", "metres")


@query()
def n8_distance(spark, sf_dir):
    """Chamfer distance within the demonstration's two buildings."""
    return vectorize.distances(_high(spark).select("raster_id", "label", "r", "c")).select("label", "r", "c", F.round("far", 6).alias("far"))


@query()
def n11_to_utm(spark, sf_dir):
    """The demonstration's green band on a grid of 10 m in UTM."""
    d = _demo(spark)
    out = rasters.to_utm(d, "green", scenes.DEMO_BOUNDS, (SIDE, SIDE), 43, False, 10.0)
    return out.select("i", "j", F.round("green", 6).alias("green"))


@query("SELECT n_nationkey::BIGINT AS id, 70.0::DOUBLE + n_nationkey AS x, 10.0::DOUBLE + n_regionkey AS y FROM nation")
def k2_k3_file_round_trip(spark, sf_dir):
    """K2, K3, K4: nations as points in a shapefile and a GeoPackage, read back from both."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) id", "70.0D + n_nationkey x", "10.0D + n_regionkey y").orderBy("id").collect()
    layer = ("Point", [([[(r["x"], r["y"])]], {"id": r["id"]}) for r in rows], [("id", "int")])
    shapes = vectors.read_shapefile(vectors.shapefile(*layer)[".shp"])
    with tempfile.TemporaryDirectory() as d:
        vectors.write_geopackage(Path(d, "a.gpkg"), {"nations": layer})
        with sqlite3.connect(Path(d, "a.gpkg")) as db:
            ids = [x for (x,) in db.execute("SELECT id FROM nations ORDER BY fid")]
    return spark.createDataFrame([(i, *s[0][0]) for i, s in zip(ids, shapes, strict=True)], "id long, x double, y double")
