"""Attribution by rules: tags to classes, heights in tiers, heights from shadows, review flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.functions import geometry
from rastrel.functions.crs import METRES, METRES_LON

#: Fixed: source names, words that tell towers and commercial buildings, storeys' height, confidences below which layers are reviewed.
REFERENCE_BUILDING, REFERENCE = "OpenStreetMap / Municipal Ground Truth", "OpenStreetMap Ground Truth"
TOWER_TYPES, TOWER_NAMES = ("apartment", "residential", "hotel"), ("chs", "society", "tower", "heights", "enclave", "residency", "court")
COMMERCIAL_TYPES = ("commercial", "office", "hospital")
STOREY = 3.3
REVIEW = {"buildings": 0.70, "roads": 0.75, "trees": 0.75}
SHADOW_WAYS = ((-1, -1), (-1, 0), (0, -1), (-1, 1))


def route(tags: Column, ring: Column) -> Column:
    """Class of an element by its tags (a map), the first that fits: building, road, water; null for none or under two points."""
    has = lambda k: F.map_contains_key(tags, F.lit(k))
    building, road = has("building") | has("building:part"), has("highway")
    water = has("waterway") | (F.coalesce(tags["natural"], F.lit("")) == "water") | has("water") | F.coalesce(tags["landuse"], F.lit("")).isin("reservoir", "basin")
    kind = F.when(building, F.when(F.size(ring) >= 3, "buildings")).when(road, "roads").when(water, "water")
    return F.when(F.size(ring) >= 2, kind)


def is_compound(width_deg: Column, height_deg: Column) -> Column:
    """Campus and zone boundaries: over 3000 square metres, or 110 m a side."""
    dx, dy = width_deg * METRES_LON, height_deg * METRES
    return (dx * dy > 3000.0) | (F.greatest(dx, dy) > 110.0)


def parsed_height(height: Column, levels: Column) -> Column:
    """Metres from a height tag, else from its levels. All m's go before the unit's other letters could, so only "m" is a unit."""
    told = F.round(F.trim(F.replace(height, F.lit("m"), F.lit(""))).try_cast("double"), 1)
    return F.coalesce(told, F.round(levels.try_cast("double") * STOREY, 1))


def _any_of(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def tiered_height(told: Column, levels: Column, shadow: Column, kind: Column, name: Column, number: Column) -> Column:
    """Metres: what is told if over 6.5, else by levels, else by shadow from 3 m on, else by type and name."""
    kind, name = F.lower(F.coalesce(kind, F.lit("yes"))), F.lower(F.coalesce(name, F.lit("")))
    by_levels = F.round(levels.try_cast("double") * STOREY, 1)
    tower = _any_of(kind, TOWER_TYPES) | _any_of(name, TOWER_NAMES)
    rest = F.when(tower, 21.0).when(_any_of(kind, COMMERCIAL_TYPES), 15.0).otherwise(F.round(8.0 + (number * 7 % 5) * 1.2, 1))
    return F.coalesce(F.when(told > 6.5, told), by_levels, F.when(shadow >= 3.0, shadow), rest)


def least_height(height: Column) -> Column:
    return F.greatest(F.lit(3.0), F.round(height - 2.0, 1))


def needs_review(layer: Column, confidence: Column) -> Column:
    limit = F.create_map(*[F.lit(x) for kv in REVIEW.items() for x in kv])[layer]
    return F.coalesce(confidence < limit, F.lit(False))


def shadow_heights(corners: DataFrame, px: DataFrame, metres: float, sun: float = 58.0, reach: int = 89) -> DataFrame:
    """raster_id, id, shadow_m from footprints' corners (raster_id, id, seq from 0, r, c) and bright pixels (red, green, blue).

    Rays go from every so many-th corner in four directions for as long as pixels are dark (under 45); those of 4 steps
    on count, and of 3 of them their 75th percentile gives the height, held to 5 to 140 m. A ray's cells meet the dark
    pixels on equal keys, and its length is the step before the first that misses.
    """
    n = F.count("*").over(W.partitionBy("raster_id", "id"))
    start = corners.withColumn("_n", n).where(F.col("seq") % F.greatest(F.lit(1), F.floor(F.col("_n") / 16)) == 0)
    ways = F.array(*[F.struct(F.lit(x).alias("dc"), F.lit(y).alias("dr")) for x, y in SHADOW_WAYS])
    rays = start.select("raster_id", "id", "seq", "r", "c", F.posexplode(ways).alias("way", "d"))
    cells = rays.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    cells = cells.select("raster_id", "id", "seq", "way", "s", (F.col("r") + F.col("s") * F.col("d.dr")).alias("r"), (F.col("c") + F.col("s") * F.col("d.dc")).alias("c"))
    dark = px.where((F.col("red") + F.col("green") + F.col("blue")) / 3.0 < 45).select("raster_id", "r", "c", F.lit(1).alias("dark"))
    met = cells.join(dark, ["raster_id", "r", "c"], "left").groupBy("raster_id", "id", "seq", "way").agg(F.min(F.when(F.col("dark").isNull(), F.col("s"))).alias("miss"))
    steps = met.select("raster_id", "id", (F.coalesce("miss", F.lit(reach + 1)) - 1).alias("steps")).where("steps >= 4")
    h = steps.groupBy("raster_id", "id").agg(F.count("*").alias("rays"), F.percentile("steps", 0.75).alias("p")).where("rays >= 3")
    return h.select("raster_id", "id", F.greatest(F.lit(5.0), F.least(F.lit(140.0), F.round(F.col("p") * metres * math.tan(math.radians(sun)), 1))).alias("shadow_m"))


def reference_features(elements: DataFrame) -> DataFrame:
    """Features of the three reference layers from elements (id, tags map, points array of struct<x, y>)."""
    d = elements.withColumn("layer", route(F.col("tags"), F.col("points"))).where("layer is not null")
    ring = F.when(F.col("layer") == "buildings", geometry.closed(F.col("points"))).otherwise(F.col("points"))
    d = d.withColumn("ring", ring)
    b = geometry.bounds(F.col("ring"))
    d = d.where((F.col("layer") != "buildings") | ~is_compound(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]))
    tags, k = F.col("tags"), geometry.metric_scale(F.col("ring"))
    levels = F.coalesce(F.nullif(tags["building:levels"], F.lit("")), tags["levels"])
    height = parsed_height(tags["height"], levels)
    of = lambda layer, x: F.when(F.col("layer") == layer, x)
    first, last = F.col("ring")[0], F.element_at("ring", -1)
    loop = (F.size("ring") >= 3) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    return d.select(
        "layer", "id", F.when((F.col("layer") == "buildings") | (of("water", loop)), "Polygon").otherwise("LineString").alias("geom_type"), "ring",
        F.when(F.col("layer") == "buildings", REFERENCE_BUILDING).otherwise(REFERENCE).alias("source"),
        F.coalesce(tags["name"], F.when(F.col("layer") == "buildings", "Building").when(F.col("layer") == "roads", "Unnamed Road").otherwise("Water Body")).alias("name"),
        F.when(F.col("layer") == "buildings", 0.98).otherwise(1.0).alias("confidence"),
        of("buildings", F.coalesce(tags["building"], tags["building:part"], F.lit("yes"))).alias("building_type"),
        of("buildings", F.round(geometry.area(F.col("ring"), k, METRES), 2)).alias("area_sqm"),
        of("buildings", F.round(geometry.length(F.col("ring"), k, METRES), 2)).alias("perimeter_m"),
        of("buildings", height).alias("height_max"), of("buildings", F.round(height - 3.0, 1)).alias("height_min"), of("buildings", levels).alias("building_levels"),
        of("buildings", F.coalesce(tags["roof:shape"], F.lit("flat"))).alias("roof_profile"), of("roads", F.coalesce(tags["highway"], F.lit("road"))).alias("highway_type"),
        of("roads", geometry.road_length(F.col("ring"))).alias("length_m"),
    )
