"""Queries on geometry: coordinates, measures, conflation and exclusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.functions import crs, geometry
from rastrel.operators import components, conflate, features, vectorize
from rastrel.plans.registry import query, table
from rastrel.sources import rasters, scenes
from rastrel.sources.scenes import EMBEDDING_SQL, EVENT_SQL, ORDER_SQL, PART_SQL

PARTS, EVENTS, ORDERS = f"WITH p AS ({PART_SQL})", f"WITH e AS ({EVENT_SQL})", f"WITH o AS ({ORDER_SQL})"


def _boxes(spark, sf_dir):
    return scenes.part_boxes(spark, sf_dir)


def _rings(spark, sf_dir):
    return _boxes(spark, sf_dir).withColumn("ring", geometry.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))


def _lines(spark, sf_dir):
    return scenes.order_segments(spark, sf_dir).withColumn("line", F.array(geometry.point(F.col("x0"), F.col("y0")), geometry.point(F.col("x1"), F.col("y1"))))


@query(EVENTS + " SELECT id, floor((x + 180) / 360 * 131072)::BIGINT AS tx, floor((1 - asinh(tan(radians(y))) / pi()) / 2 * 131072)::BIGINT AS ty FROM e")
def f1_slippy_tiles(spark, sf_dir):
    d = scenes.event_points(spark, sf_dir)
    return d.select("id", crs.tile_x(F.col("x"), F.lit(17)).alias("tx"), crs.tile_y(F.col("y"), F.lit(17)).alias("ty"))


_AREAS = "SELECT n_nationkey::BIGINT AS id, 72.8::DOUBLE + n_nationkey * 0.01::DOUBLE AS min_lon, 19.0::DOUBLE + n_nationkey * 0.005::DOUBLE AS min_lat, 72.8::DOUBLE + n_nationkey * 0.0115::DOUBLE + 0.002::DOUBLE AS max_lon, 19.0::DOUBLE + n_nationkey * 0.006::DOUBLE + 0.002::DOUBLE AS max_lat, 14 + n_nationkey % 5 AS zoom FROM nation"
_TX, _TY = "floor((%s + 180) / 360 * pow(2, %s))::BIGINT", "floor((1 - asinh(tan(radians(%s))) / pi()) / 2 * pow(2, %s))::BIGINT"


def _areas(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) id", "72.8D + n_nationkey * 0.01D min_lon", "19.0D + n_nationkey * 0.005D min_lat", "72.8D + n_nationkey * 0.0115D + 0.002D max_lon", "19.0D + n_nationkey * 0.006D + 0.002D max_lat", "14 + n_nationkey % 5 zoom"
    )


@query(
    f"""WITH a AS ({_AREAS}), b AS (SELECT *, ({_TX % ('max_lon', 'zoom')} - {_TX % ('min_lon', 'zoom')} + 1) * ({_TY % ('min_lat', 'zoom')} - {_TY % ('max_lat', 'zoom')} + 1) AS n FROM a),
z AS (SELECT *, CASE WHEN n > 25 THEN greatest(15, zoom - 1) ELSE zoom END AS z FROM b),
g AS (SELECT id, z::INTEGER AS z, unnest(range({_TX % ('min_lon', 'z')}, {_TX % ('max_lon', 'z')} + 1)) AS x, {_TY % ('max_lat', 'z')} AS y0, {_TY % ('min_lat', 'z')} AS y1 FROM z)
SELECT id, z, x, unnest(range(y0, y1 + 1)) AS y FROM g"""
)
def s3_aoi_tile_grid(spark, sf_dir):
    return rasters.tile_grid(_areas(spark, sf_dir))


@query(EVENTS + " SELECT id, CASE WHEN y - 19.07 + (id % 3 - 1) * 40 >= 0 THEN 32600 ELSE 32700 END + greatest(1, least(60, floor((x + id % 200 - 100 + 180) / 6)::INTEGER + 1)) AS epsg FROM e")
def f2_utm_epsg(spark, sf_dir):
    d = scenes.event_points(spark, sf_dir)
    return d.select("id", crs.utm_epsg(F.col("x") + F.col("id") % 200 - 100, F.col("y") - 19.07 + (F.col("id") % 3 - 1) * 40).alias("epsg"))


@query(EVENTS + " SELECT id, round(x, 7) AS lon, round(y, 7) AS lat FROM e")
def f3_utm_round_trip(spark, sf_dir):
    """to UTM and back; what comes back is what went in, to 1e-7 degrees."""
    d = scenes.event_points(spark, sf_dir).withColumn("zone", crs.utm_zone(F.col("x")))
    e, n = crs.utm_forward(F.col("x"), F.col("y"), F.col("zone"))
    lon, lat = crs.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("n") < 0)
    return d.withColumn("e", e).withColumn("n", n).select("id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(EVENTS + " SELECT id, trunc((x - 72.87::DOUBLE) / 1e-5::DOUBLE)::INTEGER AS c, trunc((19.09::DOUBLE - y) / 1e-5::DOUBLE)::INTEGER AS r, round(72.87::DOUBLE + trunc((x - 72.87::DOUBLE) / 1e-5::DOUBLE) * 1e-5::DOUBLE, 9) AS lon FROM e")
def f4_pixel_geo(spark, sf_dir):
    d = scenes.event_points(spark, sf_dir)
    c, r = crs.to_pixel(F.col("x"), F.col("y"), F.lit(72.87), F.lit(19.09), F.lit(1e-5), F.lit(1e-5))
    lon, _ = crs.to_geo(c, r, F.lit(72.87), F.lit(19.09), F.lit(1e-5), F.lit(1e-5))
    return d.select("id", c.alias("c"), r.alias("r"), F.round(lon, 9).alias("lon"))


@query(
    PARTS + """, k AS (SELECT *, cos(radians((3 * y0 + 2 * y1) / 5)) * 111320 AS kx FROM p)
SELECT id, round((x1 - x0) * kx * (y1 - y0) * 111320, 2) AS area_sqm, round(2 * (x1 - x0) * kx + 2 * (y1 - y0) * 111320, 2) AS perimeter_m, round((3 * x0 + 2 * x1) / 5, 9) AS cx FROM k"""
)
def f5_polygon_measures(spark, sf_dir):
    """area, perimeter and centre of closed rings, in metres at their mean latitude."""
    d = _rings(spark, sf_dir)
    k = geometry.metric_scale(F.col("ring"))
    return d.select("id", F.round(geometry.area(F.col("ring"), k, crs.METRES), 2).alias("area_sqm"), F.round(geometry.length(F.col("ring"), k, crs.METRES), 2).alias("perimeter_m"), F.round(geometry.centre(F.col("ring"))[0], 9).alias("cx"))


@query(ORDERS + " SELECT id, round(sqrt(pow((x1 - x0) * 111320 * cos(radians((y0 + y1) / 2)), 2) + pow((y1 - y0) * 111320, 2)), 2) AS length_m FROM o")
def f6_polyline_length(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", geometry.road_length(F.col("line")).alias("length_m"))


@query(f"WITH a AS ({_AREAS}) SELECT id, round((max_lon - min_lon) * 111320 * cos(radians((min_lat + max_lat) / 2)) * (max_lat - min_lat) * 111320 / 10000, 3) AS hectares FROM a")
def f7_aoi_hectares(spark, sf_dir):
    """F7, C9."""
    d = _areas(spark, sf_dir)
    wide = (F.col("max_lon") - F.col("min_lon")) * crs.METRES * F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2))
    return d.select("id", F.round(wide * (F.col("max_lat") - F.col("min_lat")) * crs.METRES / 1e4, 3).alias("hectares"))


@query(EVENTS + " SELECT id, i::INTEGER AS i, round(x + greatest(1.8, least(4, height / 10)) / 2 / (111320 * cos(radians(y))) * cos(i * 2 * pi() / 10), 9) AS px, round(y + greatest(1.8, least(4, height / 10)) / 2 / 111320 * sin(i * 2 * pi() / 10), 9) AS py, greatest(3.0::DOUBLE, least(7.5::DOUBLE, height / 20)) AS drawn FROM e, range(10) t(i)")
def f12_tree_crown_ring(spark, sf_dir):
    d = scenes.event_points(spark, sf_dir)
    d = d.select("id", geometry.crown_height(F.col("height") / 20).alias("drawn"), F.posexplode(F.slice(geometry.crown_ring(F.col("x"), F.col("y"), F.col("height") / 10), 1, 10)).alias("i", "p"))
    return d.select("id", "i", F.round("p.x", 9).alias("px"), F.round("p.y", 9).alias("py"), "drawn")


@query(PARTS + " SELECT id FROM p WHERE NOT (greatest(x1 - x0, 0.21 * (y1 - y0)) / least(x1 - x0, 0.21 * (y1 - y0)) > 6 AND greatest(x1 - x0, 0.21 * (y1 - y0)) * 111320 > 8)")
def j5_linear_infrastructure(spark, sf_dir):
    """Buildings but those whose least box is long and narrow (boxes here are flattened, 8 m is long)."""
    d = _boxes(spark, sf_dir).withColumn("y1", F.col("y0") + 0.21 * (F.col("y1") - F.col("y0")))
    d = d.withColumn("ring", geometry.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).select("id", "ring")
    return conflate.without_linear(d, longest=8.0).select("id")


_SHARE = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))"


@query(PARTS + f", f AS (SELECT id, x0 + 3e-5::DOUBLE AS x0, y0 + 2e-5::DOUBLE AS y0, x1 + 3e-5::DOUBLE AS x1, y1 + 2e-5::DOUBLE AS y1 FROM p) SELECT id FROM f a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.kind = 0 AND {_SHARE} > 0.45)")
def j4_building_conflation(spark, sf_dir):
    """Found buildings that no single reference building covers by more than 45 %."""
    p = _boxes(spark, sf_dir)
    moved = p.select("id", *[(F.col(c) + d).alias(c) for c, d in (("x0", 3e-5), ("y0", 2e-5), ("x1", 3e-5), ("y1", 2e-5))])
    return conflate.without_overlapping_boxes(moved, p.where("kind = 0")).select("id")


_LINES = f"""WITH o AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, round(sqrt(pow((x1 - x0) * 111320 * cos(radians((y0 + y1) / 2)), 2) + pow((y1 - y0) * 111320, 2)), 2) AS length_m FROM ({ORDER_SQL}))"""
#: Share of a line in the union of intervals (id, low, high) along it: each adds what lies beyond all before it.
_UNION = """u AS (SELECT id, greatest(0, high - greatest(low, coalesce(max(high) OVER (PARTITION BY id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS more FROM i WHERE high > low),
s AS (SELECT id, sum(more) AS share FROM u GROUP BY id)"""


@query(
    _LINES
    + f""", a AS (SELECT * FROM o WHERE id % 5 <> 0 AND length_m >= 45), b AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM o WHERE id % 5 = 0),
m AS (SELECT a.id, a.x0 - b.x0 AS fx, a.y0 - b.y0 AS fy, a.x0 - b.x1 AS gx, a.y0 - b.y1 AS gy, a.dx, a.dy, a.dx * a.dx + a.dy * a.dy AS nn, b.n, CASE WHEN b.n > 0 THEN b.dx / b.n END AS ux, CASE WHEN b.n > 0 THEN b.dy / b.n END AS uy
  FROM a JOIN b ON least(a.x0, a.x1) - {conflate.ROAD_CORRIDOR} <= greatest(b.x0, b.x1) AND least(b.x0, b.x1) <= greatest(a.x0, a.x1) + {conflate.ROAD_CORRIDOR}
   AND least(a.y0, a.y1) - {conflate.ROAD_CORRIDOR} <= greatest(b.y0, b.y1) AND least(b.y0, b.y1) <= greatest(a.y0, a.y1) + {conflate.ROAD_CORRIDOR}),
q AS (SELECT *, fx * dx + fy * dy AS h, gx * dx + gy * dy AS k, fx * ux + fy * uy AS la, dx * ux + dy * uy AS ls, fy * ux - fx * uy AS pa, dy * ux - dx * uy AS ps FROM m),
w AS (SELECT *, h * h - nn * (fx * fx + fy * fy - pow({conflate.ROAD_CORRIDOR}::DOUBLE, 2)) AS r1, k * k - nn * (gx * gx + gy * gy - pow({conflate.ROAD_CORRIDOR}::DOUBLE, 2)) AS r2,
  CASE WHEN n = 0 THEN 1e9 WHEN abs(ls) < 1e-300 THEN CASE WHEN la BETWEEN 0 AND n THEN -1e9 ELSE 1e9 END ELSE least(-la / ls, (n - la) / ls) END AS l1,
  CASE WHEN n = 0 THEN -1e9 WHEN abs(ls) < 1e-300 THEN CASE WHEN la BETWEEN 0 AND n THEN 1e9 ELSE -1e9 END ELSE greatest(-la / ls, (n - la) / ls) END AS h1,
  CASE WHEN n = 0 THEN 1e9 WHEN abs(ps) < 1e-300 THEN CASE WHEN abs(pa) <= {conflate.ROAD_CORRIDOR} THEN -1e9 ELSE 1e9 END ELSE least((-{conflate.ROAD_CORRIDOR} - pa) / ps, ({conflate.ROAD_CORRIDOR} - pa) / ps) END AS l2,
  CASE WHEN n = 0 THEN -1e9 WHEN abs(ps) < 1e-300 THEN CASE WHEN abs(pa) <= {conflate.ROAD_CORRIDOR} THEN 1e9 ELSE -1e9 END ELSE greatest((-{conflate.ROAD_CORRIDOR} - pa) / ps, ({conflate.ROAD_CORRIDOR} - pa) / ps) END AS h2 FROM q),
z AS (SELECT id, CASE WHEN r1 >= 0 THEN (-h - sqrt(r1)) / nn END AS a1, CASE WHEN r1 >= 0 THEN (-h + sqrt(r1)) / nn END AS b1, CASE WHEN r2 >= 0 THEN (-k - sqrt(r2)) / nn END AS a2, CASE WHEN r2 >= 0 THEN (-k + sqrt(r2)) / nn END AS b2,
  CASE WHEN greatest(l1, l2) <= least(h1, h2) THEN greatest(l1, l2) END AS a3, CASE WHEN greatest(l1, l2) <= least(h1, h2) THEN least(h1, h2) END AS b3 FROM w),
i AS (SELECT id, greatest(0, least(1, least(a1, a2, a3))) AS low, greatest(0, least(1, greatest(b1, b2, b3))) AS high FROM z WHERE coalesce(a1, a2, a3) IS NOT NULL),
{_UNION}
SELECT id, length_m, 'reference' AS source FROM b UNION ALL SELECT a.id, length_m, 'found' FROM a LEFT JOIN s USING (id) WHERE coalesce(share, 0) <= {conflate.ROAD_OVERLAP}"""
)
def j1_road_conflation(spark, sf_dir):
    """Reference roads, and found ones of 45 m and more that run no more than 12 % in their corridors."""
    d = _lines(spark, sf_dir).withColumn("length_m", geometry.road_length(F.col("line")))
    reference, found = d.where("id % 5 = 0"), d.where("id % 5 <> 0 and length_m >= 45")
    shares = conflate.line_share_in_corridors(found, reference, conflate.ROAD_CORRIDOR, conflate.ROAD_OVERLAP)
    kept = conflate.without(found, shares, conflate.ROAD_OVERLAP)
    return reference.select("id", "length_m", F.lit("reference").alias("source")).unionByName(kept.select("id", "length_m", F.lit("found").alias("source")))


@query(
    _LINES
    + f""", p AS ({PART_SQL}), a AS (SELECT * FROM o WHERE length_m >= 25),
m AS (SELECT a.id, a.dx, a.dy, p.x0 - a.x0 AS l, p.x1 - a.x0 AS r, p.y0 - a.y0 AS d, p.y1 - a.y0 AS t FROM a JOIN p ON least(a.x0, a.x1) <= p.x1 AND p.x0 <= greatest(a.x0, a.x1) AND least(a.y0, a.y1) <= p.y1 AND p.y0 <= greatest(a.y0, a.y1)),
i AS (SELECT id, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least(l / dx, r / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least(d / dy, t / dy) END) AS low,
  least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest(l / dx, r / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest(d / dy, t / dy) END) AS high FROM m),
{_UNION}
SELECT a.id, length_m FROM a LEFT JOIN s USING (id) WHERE coalesce(share, 0) <= {conflate.INSIDE_OVERLAP}"""
)
def j6_roads_off_buildings(spark, sf_dir):
    """Roads of 25 m and more, no more than 12 % of them in buildings together."""
    d = _lines(spark, sf_dir).withColumn("length_m", geometry.road_length(F.col("line"))).where("length_m >= 25")
    shares = conflate.line_share_in_rings(d, _rings(spark, sf_dir))
    return conflate.without(d, shares, conflate.INSIDE_OVERLAP).select("id", "length_m")


@query()
def j7_water_off_buildings_and_roads(spark, sf_dir):
    """Water no more than 8 % on roofs together and 12 % on roads' corridors."""
    r = _rings(spark, sf_dir)
    water = r.where("kind = 2")
    on_roofs = conflate.ring_share_in_rings(water, r.where("kind = 1").withColumn("ring", F.transform("ring", lambda p: geometry.point(p["x"] + 5e-5, p["y"] + 1e-5))), conflate.ROOF_OVERLAP)
    kept = components.shared_table(conflate.without(water, on_roofs, conflate.ROOF_OVERLAP).select("id", "ring"), "water")
    on_roads = conflate.ring_share_in_corridors(kept, _lines(spark, sf_dir), conflate.WATER_CORRIDOR, conflate.PAVED_OVERLAP)
    return conflate.without(kept, on_roads, conflate.PAVED_OVERLAP).select("id")


_NEAR = "sqrt(pow(e.x - (o.x0 + t * (o.x1 - o.x0)), 2) + pow(e.y - (o.y0 + t * (o.y1 - o.y0)), 2)) < 5e-5"


@query(
    f"""WITH p AS ({PART_SQL}), e AS ({EVENT_SQL}), o AS (SELECT *, pow(x1 - x0, 2) + pow(y1 - y0, 2) AS n FROM ({ORDER_SQL})),
onroad AS (SELECT DISTINCT id FROM (SELECT e.id, e.x, e.y, o.x0, o.y0, o.x1, o.y1, CASE WHEN n > 0 THEN greatest(0, least(1, ((e.x - o.x0) * (o.x1 - o.x0) + (e.y - o.y0) * (o.y1 - o.y0)) / n)) ELSE 0 END AS t
  FROM e JOIN o ON e.x > least(o.x0, o.x1) - 5e-5 AND e.x < greatest(o.x0, o.x1) + 5e-5 AND e.y > least(o.y0, o.y1) - 5e-5 AND e.y < greatest(o.y0, o.y1) + 5e-5) s WHERE {_NEAR.replace('e.', '').replace('o.', '')})
SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE e.x > x0 AND e.x < x1 AND e.y > y0 AND e.y < y1) AND id NOT IN (SELECT id FROM onroad)"""
)
def j8_tree_exclusion(spark, sf_dir):
    """Trees that stand neither in buildings or water nor in a road's corridor."""
    e = scenes.event_points(spark, sf_dir)
    in_boxes = conflate.points_in_boxes(e, _boxes(spark, sf_dir))
    on_roads = conflate.points_near_segments(e, scenes.order_segments(spark, sf_dir), conflate.TREE_CORRIDOR)
    return e.join(in_boxes, "id", "left_anti").join(on_roads, "id", "left_anti").select("id")


@query(
    f"""WITH p AS ({PART_SQL}), px AS ({EMBEDDING_SQL}), n AS (SELECT max(r) AS mr, max(c) AS mc FROM px),
k AS (SELECT id, greatest(0, least(mr, trunc((19.08::DOUBLE - (y0 + y1) / 2) / 2e-5::DOUBLE)::INTEGER)) AS r, greatest(0, least(mc, trunc(((x0 + x1) / 2 - 72.87::DOUBLE) / 3e-4::DOUBLE)::INTEGER)) AS c FROM p, n)
SELECT id, coalesce(dtm, 12.0) AS dtm FROM k LEFT JOIN px USING (r, c)"""
)
def j9_terrain_at_centre(spark, sf_dir):
    """The terrain's value at each footprint's centre, held to the raster."""
    p = _boxes(spark, sf_dir).selectExpr("id", "(x0 + x1) / 2 x", "(y0 + y1) / 2 y")
    return conflate.sampled(p, scenes.embedding_raster(spark, sf_dir), "dtm", (72.87, 19.08), (3e-4, 2e-5), 12.0).select("id", "dtm")


@query(
    f"""WITH p AS (SELECT id, (x0 - 72.87::DOUBLE) / 2e-6::DOUBLE AS x0, (x1 - 72.87::DOUBLE) / 2e-6::DOUBLE AS x1, (19.1::DOUBLE - y1) / 2e-6::DOUBLE AS y0, (19.1::DOUBLE - y0) / 2e-6::DOUBLE AS y1 FROM ({PART_SQL})),
a AS (SELECT *, unnest(range(ceil(y0)::BIGINT, floor(y1)::BIGINT + 1)) AS r FROM p), b AS (SELECT *, unnest(range(ceil(x0)::BIGINT, floor(x1)::BIGINT + 1)) AS c FROM a)
SELECT id, count(*) AS pixels, min(r)::INTEGER AS r0, max(c)::INTEGER AS c1 FROM b WHERE r >= y0 AND r < y1 AND c >= x0 AND c < x1 GROUP BY id"""
)
def v8_rasterise(spark, sf_dir):
    """V8: the pixels of polygons, as runs in rows."""
    f = _rings(spark, sf_dir).select(F.lit("s").alias("raster_id"), "id", "ring")
    d = vectorize.polygon_spans(f, (72.87, 19.1), (2e-6, 2e-6))
    return d.groupBy("id").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("pixels"), F.min("r").alias("r0"), F.max("c1").alias("c1"))


@query(EVENTS + """, a AS (SELECT id, x AS x0, y AS y0, x + (id % 7 - 3) * 4e-5::DOUBLE AS x1, y + (id % 5 - 2) * 6e-5::DOUBLE AS y1 FROM e),
s AS (SELECT id, least(x0, x1) AS min_lon, least(y0, y1) AS min_lat, greatest(x0, x1) AS max_lon, greatest(y0, y1) AS max_lat FROM a),
q AS (SELECT *, (max_lat - min_lat) * 111320 * (max_lon - min_lon) * 111320 * cos(radians((min_lat + max_lat) / 2)) AS sqm FROM s)
SELECT id, min_lon, min_lat, max_lon, max_lat, round(sqm / 10000, 2) AS hectares FROM q WHERE sqm > 100""")
def c9_selected_areas(spark, sf_dir):
    """Rectangles drawn from any corner, if they are of over 100 square metres."""
    d = scenes.event_points(spark, sf_dir).selectExpr("id", "x x0", "y y0", "x + (id % 7 - 3) * 4e-5D x1", "y + (id % 5 - 2) * 6e-5D y1")
    return features.selected(d)
