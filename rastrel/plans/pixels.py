"""Queries on pixels: map algebra, stencils, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.operators import components, mapalgebra, skeleton, stencil, tiling
from rastrel.plans.registry import query
from rastrel.sources import scenes
from rastrel.sources.scenes import EMBEDDING_SQL

EMB = f"WITH px AS ({EMBEDDING_SQL})"


def _emb(spark, sf_dir):
    return scenes.embedding_raster(spark, sf_dir)


@query(
    EMB + """, h AS (SELECT greatest(dsm - dtm, 0) AS h FROM px)
SELECT CASE WHEN h >= 8 THEN 3 WHEN h >= 3 THEN 2 WHEN h >= 1.5 THEN 1 ELSE 0 END AS stratum, count(*) AS pixels, round(max(h), 6) AS highest FROM h GROUP BY 1"""
)
def p1_ndsm_strata(spark, sf_dir):
    """Height above terrain, its strata, and how many pixels each has."""
    d = _emb(spark, sf_dir).select(mapalgebra.ndsm(F.col("dsm"), F.col("dtm")).alias("h"))
    return d.groupBy(mapalgebra.stratum(F.col("h")).alias("stratum")).agg(F.count("*").alias("pixels"), F.round(F.max("h"), 6).alias("highest"))


@query(
    EMB + """, d AS (SELECT r, c, red, green, blue, CASE WHEN red + green = 0 THEN 1e-6 ELSE red + green END AS a, CASE WHEN green + blue = 0 THEN 1e-6 ELSE green + blue END AS b FROM px)
SELECT r, c, round(greatest(-1, least(1, (red - green) / a)), 9) AS ndvi, round(greatest(-1, least(1, (green - blue) / b)), 9) AS ndwi FROM d"""
)
def p3_ndvi_ndwi(spark, sf_dir):
    nd = lambda a, b: F.round(mapalgebra.normalised_difference(F.col(a), F.col(b)), 9)
    return _emb(spark, sf_dir).select("r", "c", nd("red", "green").alias("ndvi"), nd("green", "blue").alias("ndwi"))


@query(EMB + " SELECT r, c, red * 256.0::DOUBLE + green + blue / 256.0::DOUBLE - 32768.0::DOUBLE AS metres FROM px")
def p4_terrarium_decode(spark, sf_dir):
    return _emb(spark, sf_dir).select("r", "c", mapalgebra.terrarium(F.col("red"), F.col("green"), F.col("blue")).alias("metres"))


_SPECTRAL = """, s AS (SELECT *, (red + green + blue) / 3.0::DOUBLE AS brightness, (2.0::DOUBLE * green - red - blue) / greatest(red + green + blue, 1.0::DOUBLE) AS green_excess,
round(0.299::DOUBLE * red + 0.587::DOUBLE * green + 0.114::DOUBLE * blue) AS gray FROM px),
sp AS (SELECT *, sqrt((pow(red - brightness, 2) + pow(green - brightness, 2) + pow(blue - brightness, 2)) / 3.0::DOUBLE) AS deviation FROM s)"""


@query(EMB + _SPECTRAL + " SELECT r, c, round(brightness, 6) AS brightness, round(green_excess, 6) AS green_excess, gray, round(deviation, 6) AS deviation FROM sp")
def p5_spectral_features(spark, sf_dir):
    """P5, P6."""
    d = mapalgebra.spectral(_emb(spark, sf_dir))
    return d.select("r", "c", F.round("brightness", 6).alias("brightness"), F.round("green_excess", 6).alias("green_excess"), "gray", F.round("deviation", 6).alias("deviation"))


@query(
    EMB + _SPECTRAL + """ SELECT r, c, round(CASE WHEN green > red + 4 AND green > blue + 4 AND green_excess > 0.03 THEN greatest(0.4::DOUBLE, least(1, green_excess * 4.5::DOUBLE)) ELSE 0 END
  * CASE WHEN greatest(dsm - dtm, 0) >= 1.8 THEN 1 ELSE 0.15::DOUBLE END, 6) AS trees FROM sp"""
)
def p7_tree_score(spark, sf_dir):
    d = mapalgebra.spectral(_emb(spark, sf_dir)).withColumn("ndsm", mapalgebra.ndsm(F.col("dsm"), F.col("dtm")))
    return d.select("r", "c", F.round(mapalgebra.tree_score(F.col("ndsm")), 6).alias("trees"))


def _frame(along, across, order, k, f="min"):
    return f"{f}(%s) OVER (PARTITION BY {along} ORDER BY {order} RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING)"


def _rect(new, old, h, w, f, source):
    a, b = _frame("r", "c", "c", w // 2, f) % old, _frame("c", "r", "r", h // 2, f) % f"{new}_x"
    return f"{new}_1 AS (SELECT *, {a} AS {new}_x FROM {source}), {new}_t AS (SELECT * EXCLUDE ({new}_x), {b} AS {new} FROM {new}_1)"


MASK = EMB + ", m AS (SELECT r, c, v, (v > 0.05)::INTEGER AS m FROM px)"


def _mask(spark, sf_dir):
    return _emb(spark, sf_dir).select("raster_id", "r", "c", "v", (F.col("v") > 0.05).cast("int").alias("m"))


@query(MASK + ", " + _rect("eroded", "m", 3, 3, "min", "m") + ", " + _rect("dilated", "m", 5, 5, "max", "eroded_t") + " SELECT r, c, m, eroded, dilated FROM dilated_t")
def n1_erode_dilate(spark, sf_dir):
    """3 x 3 erosion and 5 x 5 dilation of one mask."""
    d = stencil.dilate(stencil.erode(_mask(spark, sf_dir), {"eroded": "m"}, 3, 3), {"dilated": "m"}, 5, 5)
    return d.select("r", "c", "m", "eroded", "dilated")


@query(
    MASK + ", " + ", ".join([_rect("a", "m", 3, 13, "min", "m"), _rect("opened", "a", 3, 13, "max", "a_t"), _rect("b", "m", 5, 5, "max", "opened_t"), _rect("closed", "b", 5, 5, "min", "b_t")])
    + ", d1 AS (SELECT *, min(m) OVER (PARTITION BY r - c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS e1, min(m) OVER (PARTITION BY r + c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS e2 FROM closed_t)"
    + " SELECT r, c, opened, closed, max(e1) OVER (PARTITION BY r - c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS diagonal, max(e2) OVER (PARTITION BY r + c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS anti FROM d1"
)
def n2_open_close(spark, sf_dir):
    """Opening by 3 x 13 and by both diagonals of 11, closing by 5 x 5."""
    d = stencil.closed(stencil.opened(_mask(spark, sf_dir), {"opened": "m"}, 3, 13), {"closed": "m"}, 5, 5)
    d = stencil.opened_diagonal(stencil.opened_diagonal(d, "diagonal", "m", 11), "anti", "m", 11, stencil.anti)
    return d.select("r", "c", "opened", "closed", "diagonal", "anti")


def _ellipse(new, old, source, size, f):
    offsets = ", ".join(f"({dy}, {dx})" for dy, w in stencil.half_widths(size).items() for dx in range(-w, w + 1))
    return f"{new}_o(dy, dx) AS (VALUES {offsets}), {new}_t AS (SELECT p.r, p.c, any_value(p.m) AS m, {f}(q.{old}) AS {new} FROM {source} p CROSS JOIN {new}_o o JOIN {source} q ON q.r = p.r + o.dy AND q.c = p.c + o.dx GROUP BY p.r, p.c)"


@query(MASK + ", " + _ellipse("e", "m", "m", 5, "min") + ", " + _ellipse("opened", "e", "e_t", 5, "max") + ", " + _ellipse("grown", "m", "m", 7, "max") + " SELECT r, c, opened, grown FROM opened_t JOIN grown_t USING (r, c)")
def n3_ellipse(spark, sf_dir):
    """Opening by an ellipse of 5, dilation by one of 7."""
    d = stencil.ellipse(stencil.ellipse(_mask(spark, sf_dir), "e", "m", 5, F.min), "opened", "e", 5)
    return stencil.ellipse(d, "grown", "m", 7).select("r", "c", "opened", "grown")


def _blur(new, old, source, weights):
    k = len(weights) // 2
    values = ", ".join(f"({i - k}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
    mirror = lambda x, last: f"CASE WHEN abs({x}) > {last} THEN 2 * {last} - abs({x}) ELSE abs({x}) END"
    return (
        f"{new}_w(o, w) AS (VALUES {values}), {new}_n AS (SELECT max(r) AS lr, max(c) AS lc FROM {source}), "
        f"{new}_h AS (SELECT p.r, p.c, sum(q.{old} * w) AS x FROM {source} p CROSS JOIN {new}_w CROSS JOIN {new}_n JOIN {source} q ON q.r = p.r AND q.c = {mirror('p.c + o', 'lc')} GROUP BY p.r, p.c), "
        f"{new}_t AS (SELECT p.r, p.c, sum(q.x * w) AS {new} FROM {new}_h p CROSS JOIN {new}_w CROSS JOIN {new}_n JOIN {new}_h q ON q.c = p.c AND q.r = {mirror('p.r + o', 'lr')} GROUP BY p.r, p.c)"
    )


@query(EMB + ", " + _blur("gauss", "red", "px", stencil.gaussian(3)) + ", " + _blur("mean", "red", "px", [1 / 15] * 15) + " SELECT r, c, round(gauss, 6) AS gauss, round(abs(red - mean), 6) AS contrast FROM px JOIN gauss_t USING (r, c) JOIN mean_t USING (r, c)")
def n4_blur_contrast(spark, sf_dir):
    """Gaussian blur of 3, distance from the mean of a box of 15."""
    d = stencil.contrast(stencil.blur(_emb(spark, sf_dir), {"gauss": "red"}, stencil.gaussian(3)), "contrast", "red")
    return d.select("r", "c", F.round("gauss", 6).alias("gauss"), F.round("contrast", 6).alias("contrast"))


_LAPLACE = """, q AS (SELECT *, lag(red) OVER w AS l, lead(red) OVER w AS n, lag(red) OVER v2 AS u, lead(red) OVER v2 AS d FROM px WINDOW w AS (PARTITION BY r ORDER BY c), v2 AS (PARTITION BY c ORDER BY r)),
lap AS (SELECT r, c, abs(coalesce(l, n) + coalesce(n, l) + coalesce(u, d) + coalesce(d, u) - 4 * red) AS x, coalesce(l, n) + coalesce(n, l) + coalesce(u, d) + coalesce(d, u) - 4 * red AS laplacian FROM q)"""


@query(
    EMB + _LAPLACE + ", " + _rect("lo", "red", 3, 3, "min", "px") + ", " + _rect("hi", "red", 3, 3, "max", "lo_t") + ", " + _blur("texture", "x", "lap", stencil.gaussian(15))
    + " SELECT r, c, hi - lo AS gradient, laplacian, round(texture, 6) AS texture FROM hi_t JOIN lap USING (r, c) JOIN texture_t USING (r, c)"
)
def n5_gradient_laplacian(spark, sf_dir):
    """Morphological gradient, Laplacian, texture."""
    d = stencil.laplacian(stencil.gradient(_emb(spark, sf_dir), "gradient", "red"), "laplacian", "red")
    return stencil.texture(d, "texture", "red").select("r", "c", "gradient", "laplacian", F.round("texture", 6).alias("texture"))


@query(EMB + ", m AS (SELECT r, c, dsm AS m FROM px), " + _ellipse("e", "m", "m", 5, "min") + ", " + _ellipse("dtm", "e", "e_t", 5, "max") + " SELECT r, c, round(dtm, 9) AS dtm FROM dtm_t")
def n6_ground_filter(spark, sf_dir):
    d = stencil.ground(_emb(spark, sf_dir).select("raster_id", "r", "c", "dsm"), "dtm", "dsm", 7.0)
    return d.select("r", "c", F.round("dtm", 9).alias("dtm"))


@query(EMB + " SELECT p.r AS id, p.r, p.c, max(q.dsm) AS most FROM px p JOIN px q ON q.r BETWEEN p.r - 2 AND p.r + 2 AND q.c BETWEEN p.c - 2 AND p.c + 2 WHERE p.c = p.r % 64 GROUP BY p.r, p.c")
def n7_height_sample_max(spark, sf_dir):
    px = _emb(spark, sf_dir)
    points = px.where("c = r % 64").select("raster_id", F.col("r").alias("id"), "r", "c")
    return stencil.window_max(points, px, "dsm", 2).select("id", "r", "c", "most")


@query(EMB + " SELECT i::INTEGER AS i, j::INTEGER AS j, coalesce(v, 0) AS v FROM range(80) a(i) CROSS JOIN range(80) b(j) LEFT JOIN px ON px.r = i AND px.c = j + 10 AND i < 70 AND px.c < 90")
def n10_window_read(spark, sf_dir):
    """A window that begins 10 rows before the image and goes beyond its right side."""
    return stencil.window_read(_emb(spark, sf_dir), "v", -10, 10, 80, 80).select("i", "j", "v")


@query(
    """WITH m(raster_id, h, w) AS (SELECT n_nationkey, 300 + 97 * n_nationkey, 500 + 41 * n_nationkey FROM nation),
a AS (SELECT raster_id, h, w, unnest(list_distinct(list_concat(range(0, greatest(h - 512, 0) + 1, 448), [greatest(h - 512, 0)]))) AS r0 FROM m),
b AS (SELECT *, unnest(list_distinct(list_concat(range(0, greatest(w - 512, 0) + 1, 448), [greatest(w - 512, 0)]))) AS c0 FROM a)
SELECT raster_id::BIGINT AS raster_id, r0::BIGINT AS r0, c0::BIGINT AS c0, least(512, h - r0)::BIGINT AS height, least(512, w - c0)::BIGINT AS width FROM b"""
)
def l1_window_grid(spark, sf_dir):
    meta = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as bigint) raster_id", "300 + 97 * n_nationkey height", "500 + 41 * n_nationkey width")
    return tiling.windows(meta).select(*[F.col(c).cast("long") for c in ("raster_id", "r0", "c0", "height", "width")])


@query("SELECT i::INTEGER AS i, j::INTEGER AS j, round(greatest(0.05::DOUBLE, least(1, exp(-(pow(i - 31.5::DOUBLE, 2) + pow(j - 31.5::DOUBLE, 2)) / 512.0::DOUBLE))), 9) AS w FROM range(64) a(i), range(64) b(j)")
def l2_apodize(spark, sf_dir):
    d = spark.range(64 * 64).selectExpr("cast(id div 64 as int) i", "cast(id % 64 as int) j")
    return d.select("i", "j", F.round(tiling.weight(F.col("i"), F.col("j"), 64), 9).alias("w"))


@query(
    EMB + """, n AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px),
rs AS (SELECT unnest(list_distinct(list_concat(range(0, greatest(h - 32, 0) + 1, 24), [greatest(h - 32, 0)]))) AS r0 FROM n), cs AS (SELECT unnest(list_distinct(list_concat(range(0, greatest(w - 32, 0) + 1, 24), [greatest(w - 32, 0)]))) AS c0 FROM n),
t AS (SELECT r, c, v + 0.5::DOUBLE AS s, greatest(0.05::DOUBLE, least(1, exp(-(pow(r - r0 - 15.5::DOUBLE, 2) + pow(c - c0 - 15.5::DOUBLE, 2)) / 128.0::DOUBLE))) AS w FROM px JOIN rs ON r0 <= r AND r < r0 + 32 JOIN cs ON c0 <= c AND c < c0 + 32)
SELECT r, c, round(greatest(0, least(1, sum(s * w) / greatest(sum(w), 1e-6))), 9) AS blended, round(sum(w), 9) AS weight FROM t GROUP BY r, c"""
)
def l3_blend_tiles(spark, sf_dir):
    d = _emb(spark, sf_dir).withColumn("s", F.col("v") + 0.5)
    return tiling.blend(d, "s", 32, 8).select("r", "c", F.round("blended", 9).alias("blended"), F.round("weight", 9).alias("weight"))


@query(EMB + ", k AS (SELECT ceil((greatest(max(r), max(c)) + 1) / 100.0)::BIGINT AS k FROM px) SELECT (r // k)::INTEGER AS i, (c // k)::INTEGER AS j, round(avg(red), 6) AS red, round(avg(green), 6) AS green, round(avg(blue), 6) AS blue FROM px, k GROUP BY 1, 2")
def k6_preview(spark, sf_dir):
    d = tiling.preview(_emb(spark, sf_dir), ["red", "green", "blue"], 100)
    return d.select("i", "j", *[F.round(b, 6).alias(b) for b in ("red", "green", "blue")])


@query(EMB + ", b AS (SELECT DISTINCT r // 3 AS i, c // 3 AS j FROM px WHERE v > 0.3) SELECT r, c, CASE WHEN b.i IS NULL THEN red ELSE 0 END AS red FROM px LEFT JOIN b ON i = r // 3 AND j = c // 3")
def p15_mask_exclusion(spark, sf_dir):
    """One class's score goes where another class has pixels, whole 3 x 3 blocks of it here."""
    px = _emb(spark, sf_dir)
    hot = px.where("v > 0.3").select("raster_id", F.floor(F.col("r") / 3).alias("i"), F.floor(F.col("c") / 3).alias("j")).distinct()
    nine = F.explode(F.sequence(F.lit(0), F.lit(8)))
    other = hot.withColumn("k", nine).selectExpr("raster_id", "cast(3 * i + k div 3 as int) r", "cast(3 * j + k % 3 as int) c")
    return mapalgebra.excluded(px, other, "red").select("r", "c", "red")


_THIN = EMB + """, g AS (SELECT r, c, (v > 0)::INTEGER AS m FROM px),
h AS (SELECT *, coalesce(lag(m) OVER w, 0) AS w_, coalesce(lead(m) OVER w, 0) AS e FROM g WINDOW w AS (PARTITION BY r ORDER BY c)),
a AS (SELECT r, c, m, w_ AS w, e, coalesce(lag(m) OVER d, 0) AS n, coalesce(lead(m) OVER d, 0) AS s, coalesce(lag(w_) OVER d, 0) AS nw, coalesce(lag(e) OVER d, 0) AS ne, coalesce(lead(w_) OVER d, 0) AS sw, coalesce(lead(e) OVER d, 0) AS se FROM h WINDOW d AS (PARTITION BY c ORDER BY r)),
b AS (SELECT *, n + ne + e + se + s + sw + w + nw AS filled, (n < ne)::INTEGER + (ne < e)::INTEGER + (e < se)::INTEGER + (se < s)::INTEGER + (s < sw)::INTEGER + (sw < w)::INTEGER + (w < nw)::INTEGER + (nw < n)::INTEGER AS rises FROM a)"""


@query(_THIN + " SELECT r, c, CASE WHEN m = 1 AND filled BETWEEN 2 AND 6 AND rises = 1 AND n * e * s = 0 AND e * s * w = 0 THEN 0 ELSE m END AS thinned FROM b")
def g1_thin_once(spark, sf_dir):
    d = _emb(spark, sf_dir).select("raster_id", "r", "c", (F.col("v") > 0).cast("int").alias("m"))
    return skeleton.thin_once(d, "m").select("r", "c", "thinned")


@query(EMB + ", s AS (SELECT r, c FROM px WHERE v > 0.1) SELECT a.r, a.c, count(b.r) AS degree FROM s a LEFT JOIN s b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) GROUP BY a.r, a.c")
def g2_skeleton_degree(spark, sf_dir):
    return skeleton.degrees(_emb(spark, sf_dir).where("v > 0.1").select("raster_id", "r", "c")).select("r", "c", "degree")


@query(
    EMB.replace("WITH", "WITH RECURSIVE") + """, s AS (SELECT r, c, r * 64 + c AS k FROM px WHERE v > 0.15),
l AS (SELECT a.k AS a, b.k AS b FROM s a JOIN s b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach(a, root) AS (SELECT k, k FROM s UNION SELECT l.b, reach.root FROM reach JOIN l ON l.a = reach.a),
lab AS (SELECT a AS k, min(root) AS root FROM reach GROUP BY a)
SELECT row_number() OVER (ORDER BY root) AS seq, count(*) AS pixels, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, round(avg(c), 9) AS cx, round(avg(r), 9) AS cy FROM s JOIN lab USING (k) GROUP BY root"""
)
def v1_connected_components(spark, sf_dir):
    """V1: components of eight neighbours, numbered in raster order, with their statistics."""
    s = components.statistics(components.label(_emb(spark, sf_dir).where("v > 0.15").select("raster_id", "r", "c")))
    return s.select(F.col("seq").cast("long"), "pixels", "r0", "r1", "c0", "c1", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))
