"""Compositions: a scene to features, an area conflated with its reference map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.functions import geometry
from rastrel.operators import attributes, components, conflate, features, mapalgebra, skeleton, stencil, vectorize


def _component_pixels(px: DataFrame, layer: str, shapes: list[tuple]) -> DataFrame:
    """raster_id, label, r, c, score, ndsm of the components of a layer's mask, after openings and closings of rectangles."""
    d = px.withColumn("_m", (F.col(layer) >= mapalgebra.CUTS[layer]).cast("int"))
    for f, size in shapes:
        d = f(d, {"_m": "_m"}, size, size)
    on = components.shared_table(d.where("_m = 1").select("raster_id", "r", "c", F.col(layer).alias("score"), "ndsm"), layer)
    return components.label(on.select("raster_id", "r", "c")).join(on, ["raster_id", "r", "c"])


def process_scene(px: DataFrame, metres: float, origin: tuple[float, float], step: tuple[float, float], heights: bool = True) -> DataFrame:
    """Features of a dense scene (raster_id, r, c, red, green, blue, dsm, dtm): layer, raster_id, feature_id, geom_type, ring
    and attributes. Classes exclude one another in the order buildings, roads, water, trees; farms stand by themselves."""
    x0, y0, dx, dy = *origin, *step

    def to_geo(c, r):
        return x0 + c * dx, y0 - r * dy

    px = components.shared_table(mapalgebra.scores(px, heights), "scores")
    built = components.shared_table(_component_pixels(px, "buildings", [(stencil.closed, 5), (stencil.opened, 3)]), "built")
    foot = components.shared_table(vectorize.footprints(built.select("raster_id", "label", "r", "c", "score"), metres, to_geo), "footprints")
    roofs = vectorize.roof_statistics(built)
    foot = foot.join(roofs, ["raster_id", "label"], "left") if heights else foot
    foot = components.shared_table(features.numbered(foot.withColumn("layer", F.lit("buildings")), ["label", "part"]), "buildings")
    if not heights:
        h = attributes.tiered_height(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("seq"))
        foot = foot.withColumns({"height_max": h, "height_min": attributes.least_height(h), "height_mean": h, "roof_profile": F.lit("flat")})
    roofed = vectorize.polygon_pixels(foot.select("raster_id", F.col("seq").alias("id"), "ring"), origin, step)
    grown = roofed.select("raster_id", F.explode(F.sequence(F.col("r") - 2, F.col("r") + 2)).alias("r"), "c").select("raster_id", "r", F.explode(F.sequence(F.col("c") - 2, F.col("c") + 2)).alias("c"))
    px = components.shared_table(mapalgebra.excluded(px, grown, "roads"), "scores")
    ways = components.shared_table(skeleton.centrelines(_component_pixels(px, "roads", []).select("raster_id", "label", "r", "c", "score"), metres, to_geo), "ways")
    ways = components.shared_table(features.numbered(ways.withColumn("layer", F.lit("roads")), ["label", "length_m", "points"]), "roads")
    to_px = F.transform("line", lambda p: geometry.point((p["x"] - x0) / dx, (y0 - p["y"]) / dy))
    paved = vectorize.line_pixels(conflate.segments(ways.select(F.struct("raster_id", "seq").alias("id"), to_px.alias("line"))).select("id.raster_id", "id", "x0", "y0", "x1", "y1"), 3.0)
    px = mapalgebra.excluded(mapalgebra.excluded(px, roofed, "water"), paved, "water")
    px = components.shared_table(px, "scores")
    wet = components.shared_table(vectorize.waters(_component_pixels(px, "water", []).select("raster_id", "label", "r", "c"), metres, to_geo), "wet")
    wet = components.shared_table(features.numbered(wet.withColumn("layer", F.lit("water")), ["label"]), "water")
    wetted = vectorize.polygon_pixels(wet.select("raster_id", F.col("seq").alias("id"), "ring"), origin, step)
    px = mapalgebra.excluded(mapalgebra.excluded(mapalgebra.excluded(px, roofed, "trees"), wetted, "trees"), paved, "trees")
    px = components.shared_table(px, "scores")
    crowns = features.numbered(vectorize.trees(px, "trees", metres, origin, step, heights).withColumn("layer", F.lit("trees")), ["id"])
    fields = vectorize.farms(_component_pixels(px, "farms", [(stencil.opened, 5)]).select("raster_id", "label", "r", "c"), metres, to_geo)
    fields = features.numbered(fields.withColumn("layer", F.lit("farms")), ["label"])
    polygon = lambda d: d.withColumn("geom_type", F.lit("Polygon")).drop("label", "part", "how")
    ways = ways.withColumnRenamed("line", "ring").withColumn("geom_type", F.lit("LineString")).drop("label", "points")
    crowns = crowns.withColumn("ring", F.array(geometry.point(F.col("x"), F.col("y")))).withColumn("geom_type", F.lit("Point")).drop("id", "x", "y")
    out = polygon(foot)
    for d in (ways, crowns, polygon(fields), polygon(wet)):
        out = out.unionByName(d, allowMissingColumns=True)
    return components.shared_table(out.withColumn("feature_id", F.col("seq").cast("string")), "features")


def uploaded(px: DataFrame, metres: float, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Features of a scene that came with a surface (dsm) alone: the ground is estimated from it."""
    return process_scene(stencil.ground(px.drop("dtm"), "dtm", "dsm", metres), metres, origin, step)


def extract_aoi(px: DataFrame, elements: DataFrame, metres: float, origin: tuple[float, float], step: tuple[float, float], terrain: tuple[DataFrame, str, tuple[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """An area's features: those found on its image (one raster), conflated with a reference map's elements (id, tags,
    points), with heights from shadows and terrain. terrain: pixels, their value, origin and step."""
    found = process_scene(px, metres, origin, step, heights="dsm" in px.columns)
    return conflated(found, attributes.reference_features(elements), (px, metres, origin, step), terrain)


def _shadows(houses: DataFrame, image: tuple[DataFrame, float, tuple[float, float], tuple[float, float]]) -> DataFrame:
    """id, shadow_m of buildings (id, ring), by the image's dark strips beside their corners."""
    px, metres, (x0, y0), (dx, dy) = image
    raster = px.select("raster_id").first()
    corners = houses.select("id", F.posexplode("ring").alias("seq", "p"))
    corners = corners.select(F.lit(raster and raster[0]).alias("raster_id"), "id", "seq", ((F.lit(y0) - F.col("p.y")) / dy).cast("int").alias("r"), ((F.col("p.x") - x0) / dx).cast("int").alias("c"))
    return attributes.shadow_heights(corners, px, metres).select("id", "shadow_m")


def conflated(found: DataFrame, reference: DataFrame, image: tuple | None = None, terrain: tuple | None = None) -> DataFrame:
    """Found features (process_scene's of one raster) with a reference map's (attributes.reference_features').

    Reference features stand; found ones stay where the reference hasn't got them. Linear structures among buildings go
    before roads are held against buildings, then water against both, then trees against all. image (pixels, metres,
    origin, step) gives buildings heights from shadows, terrain (pixels, value, origin, step) the elevation at their
    centres, 12 m where there is none.
    """
    named = lambda d, layer: d.where(F.col("layer") == layer)
    ids = lambda d, base: d.withColumn("id", F.xxhash64(F.lit(base), "layer", "feature_id"))
    both = ids(reference.withColumn("feature_id", F.col("id").cast("string")).drop("id"), "reference").withColumn("given", F.lit(True))
    both = components.shared_table(both.unionByName(ids(found, "found").withColumn("given", F.lit(False)), allowMissingColumns=True), "both")
    given, new = both.where("given"), both.where("not given")
    lines = lambda d: d.withColumnRenamed("ring", "line")
    roads = named(new, "roads").where("length_m >= 45")
    roads = conflate.without(roads, conflate.line_share_in_corridors(lines(roads), lines(named(given, "roads")), conflate.ROAD_CORRIDOR), conflate.ROAD_OVERLAP)
    roads = components.shared_table(named(given, "roads").unionByName(roads), "roads")
    houses = named(new, "buildings").where("area_sqm between 15 and 65000")
    houses = conflate.without(houses, conflate.ring_share_in_rings(houses, named(given, "buildings"), conflate.BUILDING_OVERLAP), conflate.BUILDING_OVERLAP)
    houses = components.shared_table(conflate.without_linear(named(given, "buildings").unionByName(houses)), "buildings")
    number = F.row_number().over(W.partitionBy("layer").orderBy("given", "feature_id"))
    houses = houses.join(_shadows(houses, image), "id", "left") if image else houses.withColumn("shadow_m", F.lit(None).cast("double"))
    h = attributes.tiered_height(F.col("height_max"), F.col("building_levels"), F.col("shadow_m"), F.col("building_type"), F.col("name"), number)
    houses = houses.withColumn("height_max", h).withColumns({"height_min": attributes.least_height(F.col("height_max")), "height_mean": F.col("height_max")})
    if terrain:
        centre = geometry.centre(F.col("ring"))
        at = conflate.sampled(houses.select("id", centre[0].alias("x"), centre[1].alias("y")), *terrain, 12.0)
        houses = houses.join(at.select("id", F.round(terrain[1], 1).alias("terrain_elevation_m")), "id", "left")
    houses = components.shared_table(houses, "buildings")
    roads = roads.where("length_m >= 25")
    roads = conflate.without(roads, conflate.line_share_in_rings(lines(roads), houses), conflate.INSIDE_OVERLAP)
    roads = components.shared_table(roads, "roads")
    water = named(new, "water").where("area_sqm >= 120").unionByName(named(given, "water").where("geom_type = 'Polygon'"))
    water = components.shared_table(conflate.without(water, conflate.ring_share_in_rings(water, houses, conflate.ROOF_OVERLAP), conflate.ROOF_OVERLAP), "water")
    water = conflate.without(water, conflate.ring_share_in_corridors(water, lines(roads), conflate.WATER_CORRIDOR, conflate.PAVED_OVERLAP), conflate.PAVED_OVERLAP)
    water = components.shared_table(water, "water")
    trees = named(new, "trees")
    at = trees.select("id", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"))
    rings = houses.select("ring").unionByName(water.select("ring"))
    trees = trees.join(conflate.points_in_rings(at, rings), "id", "left_anti").join(conflate.points_near_segments(at, conflate.segments(lines(roads)), conflate.TREE_CORRIDOR), "id", "left_anti")
    out = houses
    for d in (roads, water, trees, named(new, "farms")):
        out = out.unionByName(d, allowMissingColumns=True)
    return out.drop("id")
