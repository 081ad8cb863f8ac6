"""Scenes: rasters as pixel tables, and vector layers, derived from tables or generated.

Pixel tables have raster_id, r, c, red, green, blue, dsm, dtm, one row a pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the demonstration scene, in pixels of a 600 x 600 image; boxes are rows then columns, half open.
LAKE = (100, 100, 60)
ROADS = ((280, 320, 0, 600), (0, 600, 380, 420))
BLOCK = (160, 240, 180, 320)
WING = ((360, 460, 150, 230), (420, 460, 230, 310))
TREES = ((180, 480), (220, 520), (260, 490), (140, 530), (350, 480), (390, 530), (450, 500))
CROWN = 16
DEMO_BOUNDS = (72.87, 19.07, 72.876, 19.076)


def demo_expressions(x: str = "x", y: str = "y") -> dict[str, str]:
    """Bands and surfaces of the demonstration scene as SQL expressions of pixel coordinates, alike in Spark and DuckDB."""
    box = lambda b: f"({y} >= {b[0]} AND {y} < {b[1]} AND {x} >= {b[2]} AND {x} < {b[3]})"
    disc = lambda cx, cy, r: f"(({x} - {cx}) * ({x} - {cx}) + ({y} - {cy}) * ({y} - {cy}) <= {r * r})"
    tree, wing = " OR ".join(disc(*t, CROWN) for t in TREES), " OR ".join(map(box, WING))
    road, lake, block = " OR ".join(map(box, ROADS)), disc(*LAKE), box(BLOCK)
    kinds = ((tree, (20, 170, 30), 58.5), (wing, (220, 170, 150), 58.0), (block, (210, 190, 180), 62.0), (road, (130, 130, 130), 50.0), (lake, (20, 60, 200), 50.0))
    case = lambda pick, rest: "CASE " + " ".join(f"WHEN {k[0]} THEN {pick(k)}" for k in kinds) + f" ELSE {rest} END"
    bands = {n: f"CAST({case(lambda k, i=i: k[1][i], (50, 120, 50)[i])} AS DOUBLE)" for i, n in enumerate(("red", "green", "blue"))}
    return bands | {"dsm": f"CAST({case(lambda k: k[2], 50.0)} AS DOUBLE)", "dtm": "CAST(50.0 AS DOUBLE)"}


def demo_scene(spark: SparkSession, size: int = 600) -> DataFrame:
    """The demonstration scene at size x size pixels (a divisor of 600)."""
    k = 600 // size
    px = spark.range(size * size).select(F.lit("demo").alias("raster_id"), F.expr(f"cast(id div {size} as int)").alias("r"), F.expr(f"cast(id % {size} as int)").alias("c"))
    xy = px.withColumns({"x": F.col("c") * k, "y": F.col("r") * k})
    return xy.select("raster_id", "r", "c", *[F.expr(e).alias(n) for n, e in demo_expressions().items()])


def demo_sql(size: int) -> str:
    k = 600 // size
    cols = ", ".join(f"{e} AS {n}" for n, e in demo_expressions().items())
    return f"SELECT 'demo' AS raster_id, r, c, {cols} FROM (SELECT (i // {size})::INTEGER AS r, (i % {size})::INTEGER AS c, (i % {size}) * {k} AS x, (i // {size}) * {k} AS y FROM range({size * size}) t(i))"


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as the rows of one dense raster, their numbers as its bands and surfaces."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("r"), "embedding", F.posexplode("embedding").alias("c", "f"))
    v = lambda k: F.element_at("embedding", (F.col("c") + k) % 64 + 1).cast("double")
    band = lambda k: F.floor((v(k) + 0.6) * 212).cast("double")
    return e.select(F.lit("emb").alias("raster_id"), "r", "c", v(0).alias("v"), band(0).alias("red"), band(1).alias("green"), band(2).alias("blue"), (50 + 40 * v(0)).alias("dsm"), (50 + 20 * v(1)).alias("dtm"))


EMBEDDING_SQL = """SELECT 'emb' AS raster_id, r, c, v, floor((v + 0.6) * 212) AS red, floor((v1 + 0.6) * 212) AS green, floor((v2 + 0.6) * 212) AS blue, 50 + 40 * v AS dsm, 50 + 20 * v1 AS dtm
FROM (SELECT r, c, e[c + 1]::DOUBLE AS v, e[(c + 1) % 64 + 1]::DOUBLE AS v1, e[(c + 2) % 64 + 1]::DOUBLE AS v2 FROM (SELECT vec_id::INTEGER AS r, embedding AS e, unnest(range(64))::INTEGER AS c FROM embeddings))"""


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as axis-aligned buildings: id, x0, y0, x1, y1, and what tags say of them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.selectExpr(
        "p_partkey as id", "72.87 + (p_partkey % 200) * 1e-4 as x0", "19.07 + (p_partkey div 200) * 1e-4 as y0",
        "72.87 + (p_partkey % 200) * 1e-4 + (10 + p_size) * 2e-6 as x1", "19.07 + (p_partkey div 200) * 1e-4 + (10 + p_partkey % 37) * 2e-6 as y1",
        "p_size", "p_name as name", "p_type as building_type", "p_partkey % 3 as kind",
    )


PART_SQL = """SELECT p_partkey AS id, 72.87::DOUBLE + (p_partkey % 200) * 1e-4::DOUBLE AS x0, 19.07::DOUBLE + (p_partkey // 200) * 1e-4::DOUBLE AS y0,
72.87::DOUBLE + (p_partkey % 200) * 1e-4::DOUBLE + (10 + p_size) * 2e-6::DOUBLE AS x1, 19.07::DOUBLE + (p_partkey // 200) * 1e-4::DOUBLE + (10 + p_partkey % 37) * 2e-6::DOUBLE AS y1,
p_size, p_name AS name, p_type AS building_type, p_partkey % 3 AS kind FROM part"""


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trees: id, x, y, height, confidence."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("event_id as id", "72.87 + (event_id * 7919 % 20000) * 1e-6 as x", "19.07 + (event_id * 104729 % 10000) * 1e-6 as y", "value as height", "(event_id % 100) / 100.0D as confidence")


EVENT_SQL = """SELECT event_id AS id, 72.87::DOUBLE + (event_id * 7919 % 20000) * 1e-6::DOUBLE AS x, 19.07::DOUBLE + (event_id * 104729 % 10000) * 1e-6::DOUBLE AS y, value AS height, (event_id % 100) / 100.0::DOUBLE AS confidence FROM events"""


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as road segments: id, x0, y0, x1, y1."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr(
        "o_orderkey as id", "72.87 + (o_orderkey * 31 % 20000) * 1e-6 as x0", "19.07 + (o_orderkey * 17 % 10000) * 1e-6 as y0",
        "72.87 + (o_orderkey * 31 % 20000) * 1e-6 + (o_orderkey % 13 - 6) * 1e-4 as x1", "19.07 + (o_orderkey * 17 % 10000) * 1e-6 + (o_orderkey % 11 - 5) * 1e-4 as y1",
        "(o_orderkey % 100) / 100.0D as confidence",
    )


ORDER_SQL = """SELECT o_orderkey AS id, 72.87::DOUBLE + (o_orderkey * 31 % 20000) * 1e-6::DOUBLE AS x0, 19.07::DOUBLE + (o_orderkey * 17 % 10000) * 1e-6::DOUBLE AS y0,
72.87::DOUBLE + (o_orderkey * 31 % 20000) * 1e-6::DOUBLE + (o_orderkey % 13 - 6) * 1e-4::DOUBLE AS x1, 19.07::DOUBLE + (o_orderkey * 17 % 10000) * 1e-6::DOUBLE + (o_orderkey % 11 - 5) * 1e-4::DOUBLE AS y1,
(o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders"""
