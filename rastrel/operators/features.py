"""Feature tables: summaries, filters, styles, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rastrel.functions.crs import METRES

LAYERS = ("buildings", "roads", "trees", "farms", "water")
#: Fixed: heights and colours (red, green, blue) that the ramp goes through.
RAMP = ((0.0, (253, 186, 116)), (9.0, (251, 146, 60)), (18.0, (249, 115, 22)), (30.0, (234, 88, 12)), (45.0, (194, 65, 12)))


def summary(features: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each layer, kilometres of road and the mean confidence of buildings; one aggregate, no pivot job.

    features: layer, length_m, confidence. A road without a length counts 45 m; no building, 0.
    """
    n = lambda layer: F.count_if(F.col("layer") == layer)
    return features.groupBy(*by).agg(
        n("buildings").alias("building_count"), n("roads").alias("road_segment_count"), n("trees").alias("tree_count"), n("farms").alias("farm_parcel_count"), n("water").alias("water_body_count"),
        F.round(F.coalesce(F.sum(F.when(F.col("layer") == "roads", F.coalesce("length_m", F.lit(45.0)))), F.lit(0.0)) / 1000.0, 3).alias("total_road_km"),
        F.round(F.coalesce(F.avg(F.when(F.col("layer") == "buildings", F.col("confidence"))), F.lit(0.0)), 3).alias("avg_building_confidence"),
    )


def merged_summary(found: DataFrame, merged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The summary after conflation. Fields aren't conflated and the mean confidence is that of the buildings found, so those
    two are taken from before."""
    before = summary(found, by).select(*by, F.col("farm_parcel_count").alias("_farms"), F.col("avg_building_confidence").alias("_sure"))
    after = summary(merged, by)
    both = after.join(before, list(by), "left") if by else after.crossJoin(before)  # a row each
    return both.withColumns({"farm_parcel_count": F.coalesce("_farms", F.lit(0)), "avg_building_confidence": F.coalesce("_sure", F.lit(0.0))}).drop("_farms", "_sure")


def selected(areas: DataFrame, least: float = 100.0) -> DataFrame:
    """Areas (id, and two corners x0, y0, x1, y1 in any order) of over 100 square metres: id, bounds and hectares."""
    low_x, high_x, low_y, high_y = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    sqm = (high_y - low_y) * METRES * (high_x - low_x) * METRES * F.cos(F.radians((low_y + high_y) / 2))
    return areas.where(sqm > least).select("id", low_x.alias("min_lon"), low_y.alias("min_lat"), high_x.alias("max_lon"), high_y.alias("max_lat"), F.round(sqm / 1e4, 2).alias("hectares"))


def flagged(features: DataFrame, least: float) -> DataFrame:
    """Of the features with a confidence, how many are below `least`."""
    return features.agg(F.count_if(F.col("confidence") < least).alias("flagged"), F.count("confidence").alias("total"))


def visible(features: DataFrame, layers: list[str], geometries: list[str] | None = None) -> DataFrame:
    kept = features.where(F.col("layer").isin(layers))
    return kept if geometries is None else kept.where(F.col("geom_type").isin(geometries))


def opacity(confidence: Column, least: float) -> Column:
    """Style of a feature against the slider: features without a confidence count as sure."""
    return F.when(F.coalesce(confidence, F.lit(1.0)) >= least, "shown").otherwise("faded")


def ramp(height: Column) -> list[Column]:
    """Red, green and blue of a height, linear between the ramp's stops; 10 m where there is none."""
    h = F.coalesce(height, F.lit(10.0))
    out = []
    for k in range(3):
        x = F.lit(float(RAMP[-1][1][k]))
        for (a, ca), (b, cb) in zip(RAMP[-2::-1], RAMP[:0:-1], strict=True):
            x = F.when(h < b, ca[k] + (h - a) / (b - a) * (cb[k] - ca[k])).otherwise(x)
        out.append(F.round(F.when(h <= RAMP[0][0], float(RAMP[0][1][k])).otherwise(x)).cast("int"))
    return out


def merged(features: DataFrame, edits: DataFrame, key: tuple[str, ...] = ("layer", "feature_id")) -> DataFrame:
    """Features after edits (columns of features, and op: upsert or delete, seq: the order of edits).

    The last edit of a feature holds; it is found by one aggregate a key, not by sorting all its edits.
    """
    last = edits.groupBy(*key).agg(F.max(F.struct("seq", "op", F.struct(*features.columns).alias("row"))).alias("e"))
    untouched = features.join(last.select(*key), list(key), "left_anti")
    return untouched.unionByName(last.where("e.op = 'upsert'").select("e.row.*").select(*features.columns))


def without_geometry(features: DataFrame, gone: DataFrame, column: str = "ring") -> DataFrame:
    """Features but those whose id or geometry is among `gone`'s."""
    left = features.join(gone.select("feature_id").distinct(), "feature_id", "left_anti")
    return left.join(gone.select(F.to_json(column).alias("_g")).distinct(), F.to_json(left[column]) == F.col("_g"), "left_anti")


def numbered(features: DataFrame, order: list[str], by: tuple[str, ...] = ("raster_id", "layer")) -> DataFrame:
    """Adds seq, from 1 in each raster and layer."""
    return features.withColumn("seq", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def review_queue(features: DataFrame, n: int) -> DataFrame:
    """The n least sure features that need review."""
    return features.where("needs_review").orderBy("confidence", "layer", "feature_id").limit(n)


def described(kind: Column, area: Column, height: Column, confidence: Column) -> Column:
    """A line for the inspector."""
    return F.concat_ws(
        " | ", F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.when(area.isNotNull(), F.concat(F.format_string("%.1f", area), F.lit(" sqm"))),
        F.when(height.isNotNull(), F.concat(F.format_string("%.1f", height), F.lit(" m"))), F.concat(F.format_string("%.0f", F.coalesce(confidence, F.lit(1.0)) * 100), F.lit("%")),
    )
