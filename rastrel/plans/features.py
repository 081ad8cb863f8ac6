"""Queries on features: tags, heights, summaries, styles, edits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastrel.functions import geometry
from rastrel.operators import attributes, features, vectorize
from rastrel.plans.registry import query, table
from rastrel.sources import scenes, vectors
from rastrel.sources.scenes import PART_SQL

_TAGS = """CASE p_partkey % 6 WHEN 0 THEN MAP {'building': p_type, 'height': p_size || ' m', 'name': p_name} WHEN 1 THEN MAP {'building:part': 'yes', 'height': p_size || ' meters', 'building:levels': (p_size % 12)::VARCHAR}
WHEN 2 THEN MAP {'highway': 'residential'} WHEN 3 THEN MAP {'natural': 'water'} WHEN 4 THEN MAP {'landuse': 'basin', 'highway': 'path'} ELSE MAP {'amenity': 'bench'} END"""
ELEMENTS = f"WITH el AS (SELECT p_partkey AS id, p_size, {_TAGS} AS tags FROM part)"


def elements(spark, sf_dir):
    """Parts as reference elements with tags and the corners of a box, open."""
    p = table(spark, sf_dir, "part")
    s = lambda *kv: "map(" + ", ".join(kv) + ")"
    tags = f"""case p_partkey % 6 when 0 then {s("'building'", "p_type", "'height'", "concat(p_size, ' m')", "'name'", "p_name")}
      when 1 then {s("'building:part'", "'yes'", "'height'", "concat(p_size, ' meters')", "'building:levels'", "cast(p_size % 12 as string)")} when 2 then {s("'highway'", "'residential'")}
      when 3 then {s("'natural'", "'water'")} when 4 then {s("'landuse'", "'basin'", "'highway'", "'path'")} else {s("'amenity'", "'bench'")} end"""
    d = scenes.part_boxes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1").join(p.select(F.col("p_partkey").alias("id"), "p_size", F.expr(tags).alias("tags")), "id")
    ring = geometry.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return d.withColumn("points", F.slice(ring, 1, 4)).select("id", "p_size", "tags", "points")


@query(
    ELEMENTS + """ SELECT id, CASE WHEN map_contains(tags, 'building') OR map_contains(tags, 'building:part') THEN 'buildings' WHEN map_contains(tags, 'highway') THEN 'roads'
WHEN map_contains(tags, 'natural') OR map_contains(tags, 'landuse') THEN 'water' END AS layer FROM el"""
)
def h1_tag_route(spark, sf_dir):
    return elements(spark, sf_dir).select("id", attributes.route(F.col("tags"), F.col("points")).alias("layer"))


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size * 5e-5::DOUBLE * 105000 * (p_partkey % 9 * 1e-4::DOUBLE * 111320) > 3000 OR greatest(p_size * 5e-5::DOUBLE * 105000, p_partkey % 9 * 1e-4::DOUBLE * 111320) > 110)")
def h2_compound_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(~attributes.is_compound(F.col("p_size") * 5e-5, F.col("p_partkey") % 9 * 1e-4)).select(F.col("p_partkey").alias("id"))


@query(
    ELEMENTS + """ SELECT id, round(coalesce(round(try_cast(trim(replace(tags['height'], 'm', '')) AS DOUBLE), 1), round(try_cast(tags['building:levels'] AS DOUBLE) * 3.3::DOUBLE, 1)), 1) AS height FROM el"""
)
def h3_height_parse(spark, sf_dir):
    d = elements(spark, sf_dir)
    return d.select("id", attributes.parsed_height(F.col("tags")["height"], F.col("tags")["building:levels"]).alias("height"))


@query(
    """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size / 2.0::DOUBLE END AS told, CASE WHEN p_partkey % 3 = 0 THEN p_size % 12 END AS levels, CASE WHEN p_partkey % 7 = 0 THEN p_size / 4.0::DOUBLE END AS shadow,
  lower(CASE p_partkey % 5 WHEN 0 THEN 'Apartments' WHEN 1 THEN 'office' ELSE p_type END) AS kind, lower(p_name || CASE WHEN p_partkey % 11 = 0 THEN ' Tower' ELSE '' END) AS name FROM part),
h AS (SELECT id, CASE WHEN told > 6.5 THEN told WHEN levels IS NOT NULL THEN round(levels * 3.3::DOUBLE, 1) WHEN shadow >= 3 THEN shadow
  WHEN regexp_matches(kind, 'apartment|residential|hotel') OR regexp_matches(name, 'chs|society|tower|heights|enclave|residency|court') THEN 21.0::DOUBLE WHEN regexp_matches(kind, 'commercial|office|hospital') THEN 15.0::DOUBLE
  ELSE round(8.0::DOUBLE + (id * 7 % 5) * 1.2::DOUBLE, 1) END AS height_max FROM b)
SELECT id, height_max, greatest(3.0::DOUBLE, round(height_max - 2.0::DOUBLE, 1)) AS height_min FROM h"""
)
def h4_height_tiers(spark, sf_dir):
    """H4, H5."""
    p = table(spark, sf_dir, "part")
    when = lambda m, x: F.when(F.col("p_partkey") % m == 0, x)
    kind = when(5, "Apartments").when(F.col("p_partkey") % 5 == 1, "office").otherwise(F.col("p_type"))
    name = F.concat("p_name", when(11, " Tower").otherwise(""))
    h = attributes.tiered_height(when(4, F.col("p_size") / 2.0), when(3, (F.col("p_size") % 12).cast("string")), when(7, F.col("p_size") / 4.0), kind, name, F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("id"), h.alias("height_max")).withColumn("height_min", attributes.least_height(F.col("height_max")))


#: A layer table of all that customers and suppliers stand for: region is a task, nation a raster.
LAYERS = """WITH f AS (SELECT c_nationkey AS raster_id, c_custkey AS feature_id, c_custkey % 5 AS k, round(abs(c_acctbal) / 100, 2) AS length_m, (c_custkey % 100) / 100.0::DOUBLE AS confidence FROM customer
UNION ALL SELECT s_nationkey, 1000000000 + s_suppkey, s_suppkey % 5, round(abs(s_acctbal) / 100, 2), CASE WHEN s_suppkey % 10 <> 0 THEN (s_suppkey % 100) / 100.0::DOUBLE END FROM supplier),
l AS (SELECT raster_id, feature_id, ['buildings', 'roads', 'trees', 'farms', 'water'][k + 1] AS layer, CASE WHEN k = 1 AND feature_id % 7 <> 0 THEN length_m END AS length_m, confidence FROM f)"""


def layers(spark, sf_dir):
    """raster_id, feature_id, layer, length_m, confidence. Lengths are rounded as SQL rounds doubles: the hundredfold to a
    whole number (Spark's own round takes the decimal that a double prints as, which is another one at ties)."""
    c = table(spark, sf_dir, "customer").selectExpr("c_nationkey raster_id", "c_custkey feature_id", "c_custkey % 5 k", "round(abs(c_acctbal) / 100 * 100) / 100 length_m", "(c_custkey % 100) / 100.0D confidence")
    s = table(spark, sf_dir, "supplier").selectExpr("s_nationkey raster_id", "1000000000 + s_suppkey feature_id", "s_suppkey % 5 k", "round(abs(s_acctbal) / 100 * 100) / 100 length_m", "case when s_suppkey % 10 <> 0 then (s_suppkey % 100) / 100.0D end confidence")
    d = c.unionByName(s)
    name = F.element_at(F.array(*[F.lit(x) for x in features.LAYERS]), (F.col("k") + 1).cast("int"))
    return d.select("raster_id", "feature_id", name.alias("layer"), F.when((F.col("k") == 1) & (F.col("feature_id") % 7 != 0), F.col("length_m")).alias("length_m"), "confidence")


@query(
    LAYERS + """ SELECT raster_id, count(*) FILTER (layer = 'buildings') AS building_count, count(*) FILTER (layer = 'roads') AS road_segment_count, count(*) FILTER (layer = 'trees') AS tree_count,
count(*) FILTER (layer = 'farms') AS farm_parcel_count, count(*) FILTER (layer = 'water') AS water_body_count, round(coalesce(sum(coalesce(length_m, 45)) FILTER (layer = 'roads'), 0) / 1000, 3) AS total_road_km,
round(coalesce(avg(confidence) FILTER (layer = 'buildings'), 0), 3) AS avg_building_confidence FROM l GROUP BY raster_id"""
)
def a1_layer_summary(spark, sf_dir):
    """A1, A2, A4."""
    return features.summary(layers(spark, sf_dir), ("raster_id",))


@query(LAYERS + " SELECT count(*) FILTER (confidence < 0.75) AS flagged, count(confidence) AS total FROM l")
def a3_flagged(spark, sf_dir):
    return features.flagged(layers(spark, sf_dir), 0.75)


@query(LAYERS + " SELECT feature_id, layer, coalesce(CASE layer WHEN 'buildings' THEN confidence < 0.70 WHEN 'roads' THEN confidence < 0.75 WHEN 'trees' THEN confidence < 0.75 END, false) AS needs_review FROM l")
def h6_review_flags(spark, sf_dir):
    return layers(spark, sf_dir).select("feature_id", "layer", attributes.needs_review(F.col("layer"), F.col("confidence")).alias("needs_review"))


@query(LAYERS + " SELECT feature_id, layer, CASE WHEN coalesce(confidence, 1) >= 0.8 THEN 'shown' ELSE 'faded' END AS style FROM l WHERE layer IN ('buildings', 'water')")
def c1_c2_visible_styled(spark, sf_dir):
    """The layers switched on, styled against the slider."""
    d = features.visible(layers(spark, sf_dir), ["buildings", "water"])
    return d.select("feature_id", "layer", features.opacity(F.col("confidence"), 0.8).alias("style"))


_RAMP = [(0, (253, 186, 116)), (9, (251, 146, 60)), (18, (249, 115, 22)), (30, (234, 88, 12)), (45, (194, 65, 12))]


def _ramp_sql(k):
    parts = " ".join(f"WHEN h < {b} THEN {ca[k]} + (h - {a}) / {b - a}.0::DOUBLE * ({cb[k] - ca[k]})" for (a, ca), (b, cb) in zip(_RAMP, _RAMP[1:], strict=False))
    return f"round(CASE WHEN h <= 0 THEN {_RAMP[0][1][k]} {parts} ELSE {_RAMP[-1][1][k]} END)::INTEGER"


@query(f"WITH h AS (SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_size * 1.1::DOUBLE - 3 END, 10.0::DOUBLE) AS h FROM part) SELECT id, {_ramp_sql(0)} AS red, {_ramp_sql(1)} AS green, {_ramp_sql(2)} AS blue FROM h")
def c4_height_colour_ramp(spark, sf_dir):
    red, green, blue = features.ramp(F.col("h"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 1.1 - 3).alias("h"))
    return d.select("id", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query(
    LAYERS + """, e AS (SELECT 1 + event_id % 2000 AS feature_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, round(value, 2) AS length_m FROM events),
last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY seq DESC) = 1)
SELECT feature_id, layer, length_m, confidence FROM l WHERE feature_id NOT IN (SELECT feature_id FROM last) UNION ALL SELECT feature_id, 'roads', length_m, 1.0::DOUBLE FROM last WHERE op = 'upsert'"""
)
def c5_c7_edit_merge(spark, sf_dir):
    """Features after edits; the last edit of each holds."""
    f = layers(spark, sf_dir).select("feature_id", "layer", "length_m", "confidence")
    e = table(spark, sf_dir, "events").selectExpr("1 + event_id % 2000 feature_id", "event_id seq", "case when event_type = 'error' then 'delete' else 'upsert' end op", "'roads' layer", "round(value, 2) length_m", "1.0D confidence")
    return features.merged(f, e, ("feature_id",))


@query(LAYERS + ", q AS (SELECT feature_id, layer, confidence FROM l WHERE (layer = 'buildings' AND confidence < 0.70) OR (layer IN ('roads', 'trees') AND confidence < 0.75)) SELECT * FROM q ORDER BY confidence, layer, feature_id LIMIT 25")
def review_queue(spark, sf_dir):
    """The 25 least sure features that need review."""
    d = layers(spark, sf_dir).select("feature_id", "layer", "confidence")
    return features.review_queue(d.withColumn("needs_review", attributes.needs_review(F.col("layer"), F.col("confidence"))), 25).drop("needs_review")


@query(
    LAYERS + """ SELECT feature_id, CASE layer WHEN 'roads' THEN 'Road Line' ELSE upper(layer[1]) || layer[2:] END || CASE WHEN length_m IS NOT NULL THEN ' | ' || printf('%.1f', round(length_m)) || ' sqm' ELSE '' END || ' | ' || printf('%.0f', coalesce(confidence, 1) * 100) || '%' AS line FROM l"""
)
def c8_inspector(spark, sf_dir):
    kind = F.when(F.col("layer") == "roads", "road_line").otherwise(F.col("layer"))
    return layers(spark, sf_dir).select("feature_id", features.described(kind, F.round("length_m"), F.lit(None).cast("double"), F.col("confidence")).alias("line"))


@query("SELECT id, name, colour FROM (VALUES " + ", ".join(f"({i}, '{n}', '{c}')" for i, n, c in vectorize.LAND_COVER) + ") v(id, name, colour)")
def v14_land_cover(spark, sf_dir):
    return spark.createDataFrame(vectorize.LAND_COVER, "id int, name string, colour string")


@query(LAYERS + " SELECT layer, feature_id, length_m, CASE WHEN layer = 'trees' THEN confidence END AS sure FROM l WHERE layer IN ('roads', 'trees', 'water')")
def k5_export_union(spark, sf_dir):
    """K5: layers with columns of their own in one table."""
    d = layers(spark, sf_dir)
    parts = {"roads": d.where("layer = 'roads'").select("feature_id", "length_m"), "trees": d.where("layer = 'trees'").select("feature_id", F.col("confidence").alias("sure")), "water": d.where("layer = 'water'").select("feature_id")}
    return vectors.union_layers(parts).select("layer", "feature_id", "length_m", "sure")


@query(
    f"""WITH p AS ({PART_SQL}) SELECT '{{"type":"Feature","id":"' || id || '","geometry":{{"type":"Point","coordinates":[' || (id % 90) || '.0,' || (id % 45) || '.0]}},"properties":{{"id":' || id || ',"p_size":' || p_size || '}}}}' AS value FROM p"""
)
def k1_geojson_rows(spark, sf_dir):
    p = scenes.part_boxes(spark, sf_dir)
    at = F.array(F.array(geometry.point((F.col("id") % 90).cast("double"), (F.col("id") % 45).cast("double"))))
    return vectors.geojson_rows(p.select(F.col("id").alias("feature_id"), F.lit("Point").alias("geom_type"), at.alias("rings"), "id", "p_size"), ["id", "p_size"])


@query(LAYERS + " SELECT feature_id, confidence, (confidence < 0.7)::INTEGER AS needs_revi FROM l")
def k2_field_projection(spark, sf_dir):
    d = layers(spark, sf_dir).select("feature_id", "confidence", (F.col("confidence") < 0.7).alias("needs_review"))
    return vectors.field_projection(d, ["feature_id", "confidence", "needs_review"])


@query(LAYERS + " SELECT layer, count(*) AS features FROM l GROUP BY layer")
def k4_manifest(spark, sf_dir):
    """K4, A5."""
    return vectors.manifest(layers(spark, sf_dir))


@query(
    ELEMENTS
    + f""", b AS (SELECT el.id, tags, p.x0, p.y0, p.x1, p.y1, cos(radians((3 * p.y0 + 2 * p.y1) / 5)) * 111320 AS kx,
  CASE WHEN map_contains(tags, 'building') OR map_contains(tags, 'building:part') THEN 'buildings' WHEN map_contains(tags, 'highway') THEN 'roads' WHEN map_contains(tags, 'natural') OR map_contains(tags, 'landuse') THEN 'water' END AS layer
  FROM el JOIN ({PART_SQL}) p ON p.id = el.id),
k AS (SELECT *, layer = 'buildings' AS house, (x1 - x0) * 105000 AS wide, (y1 - y0) * 111320 AS tall FROM b WHERE layer IS NOT NULL)
SELECT layer, id, CASE WHEN house THEN 'Polygon' ELSE 'LineString' END AS geom_type, CASE WHEN house THEN 'OpenStreetMap / Municipal Ground Truth' ELSE 'OpenStreetMap Ground Truth' END AS source,
  coalesce(tags['name'], CASE layer WHEN 'buildings' THEN 'Building' WHEN 'roads' THEN 'Unnamed Road' ELSE 'Water Body' END) AS name, CASE WHEN house THEN coalesce(tags['building'], tags['building:part'], 'yes') END AS building_type,
  CASE WHEN house THEN round((x1 - x0) * kx * (y1 - y0) * 111320, 2) END AS area_sqm,
  CASE WHEN house THEN coalesce(round(try_cast(trim(replace(tags['height'], 'm', '')) AS DOUBLE), 1), round(try_cast(tags['building:levels'] AS DOUBLE) * 3.3::DOUBLE, 1)) END AS height_max, CASE WHEN house THEN tags['building:levels'] END AS building_levels,
  CASE WHEN layer = 'roads' THEN round((x1 - x0) * 111320 * cos(radians(y0)) + (y1 - y0) * 111320 + (x1 - x0) * 111320 * cos(radians(y1)), 2) END AS length_m
FROM k WHERE NOT house OR NOT (wide * tall > 3000 OR greatest(wide, tall) > 110)"""
)
def s4_reference_layers(spark, sf_dir):
    """Reference features of all layers from tagged elements."""
    d = attributes.reference_features(elements(spark, sf_dir))
    return d.select("layer", "id", "geom_type", "source", "name", "building_type", "area_sqm", "height_max", "building_levels", "length_m")


_SUMMARY = """count(*) FILTER (layer = 'buildings') AS building_count, count(*) FILTER (layer = 'roads') AS road_segment_count, count(*) FILTER (layer = 'trees') AS tree_count,
count(*) FILTER (layer = 'water') AS water_body_count, round(coalesce(sum(coalesce(length_m, 45)) FILTER (layer = 'roads'), 0) / 1000, 3) AS total_road_km"""


@query(
    LAYERS + f""", m AS (SELECT raster_id, {_SUMMARY} FROM l WHERE confidence >= 0.3 OR confidence IS NULL GROUP BY raster_id),
b AS (SELECT raster_id, count(*) FILTER (layer = 'farms') AS farm_parcel_count, round(coalesce(avg(confidence) FILTER (layer = 'buildings'), 0), 3) AS avg_building_confidence FROM l GROUP BY raster_id)
SELECT * FROM m JOIN b USING (raster_id)"""
)
def a2_merged_summary(spark, sf_dir):
    """A2: the summary after features went; fields and the mean confidence are those from before."""
    d = layers(spark, sf_dir)
    return features.merged_summary(d, d.where("confidence >= 0.3 or confidence is null"), ("raster_id",))


_SHAPES = "CASE WHEN layer = 'roads' THEN 'LineString' WHEN layer = 'trees' THEN 'Point' ELSE 'Polygon' END"


@query(LAYERS + f" SELECT layer, feature_id, {_SHAPES} AS geom_type FROM l WHERE layer IN ('buildings', 'roads', 'trees') AND {_SHAPES} IN ('Polygon', 'LineString')")
def c3_geometry_filter(spark, sf_dir):
    """Features of some layers with some kinds of geometry."""
    d = layers(spark, sf_dir).withColumn("geom_type", F.expr(_SHAPES.lower().replace("linestring", "LineString").replace("point", "Point").replace("polygon", "Polygon")))
    return features.visible(d, ["buildings", "roads", "trees"], ["Polygon", "LineString"]).select("layer", "feature_id", "geom_type")


@query(f"""WITH p AS (SELECT *, x0 + (id % 3) * 0 AS gx FROM ({PART_SQL})), twice AS (SELECT id, x0, y0, x1, y1 FROM p UNION ALL SELECT 1000000 + id, x0, y0, x1, y1 FROM p WHERE id % 4 = 0),
gone AS (SELECT * FROM p WHERE id % 12 = 0)
SELECT id AS feature_id FROM twice t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = t.id OR (g.x0 = t.x0 AND g.y0 = t.y0 AND g.x1 = t.x1 AND g.y1 = t.y1))""")
def c6_delete_by_geometry(spark, sf_dir):
    """Deleted features go, and those drawn alike under another id."""
    p = scenes.part_boxes(spark, sf_dir)
    p = p.select(F.col("id").alias("feature_id"), geometry.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))
    twice = p.unionByName(p.where("feature_id % 4 = 0").withColumn("feature_id", 1000000 + F.col("feature_id")))
    return features.without_geometry(twice, p.where("feature_id % 12 = 0")).select("feature_id")
