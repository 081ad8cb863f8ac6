"""Connected components of pixel sets, eight neighbours to a pixel.

Pixels are labelled within tiles first, each tile in one pass over its runs. Labels that touch across the tiles' borders
are links, few beside the pixels, and their components decide: on the driver while the links are few, else by stars that
contract in the shared folder until none is left to contract.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and columns of a tile, and links across tiles (24 bytes each) that the driver joins itself.
TILE, FEW_LINKS = 1024, 500_000
#: A pixel's place in raster order: its row, then its column.
ROW = 1 << 31

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that spark.checkpoint.dir names. Where that is unset: in one of ours on a local
    master; a cluster without it is an error, as no folder of one machine serves the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = folder or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="rastrel-"))
    return f"{folder.rstrip('/')}/rastrel/{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(spark: SparkSession, name: str, raw: bytes) -> str:
    """A file in the shared folder, through Spark's file systems."""
    jvm, path = spark.sparkContext._jvm, f"{shared_folder(spark)}/{name}"
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(raw))
    out.close()
    return path


def joined(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of the sorted nodes reaches over links a - b."""
    root = np.arange(len(nodes))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)  # roots hook to the least root beside them
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes[root]


def flood(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Label of each pixel: the place of its component's first pixel in raster order."""
    place = r.astype(np.int64) * ROW + c
    place, back = np.unique(place, return_inverse=True)
    if not len(place):
        return place
    starts = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
    run = np.cumsum(np.isin(np.arange(len(place)), starts)) - 1
    first, last = place[starts], place[np.append(starts[1:], len(place)) - 1]
    # Runs that begin in the row above before this one's end, a corner included, and that haven't ended before it begins.
    low, high = np.searchsorted(last, first - ROW - 1), np.searchsorted(first, last - ROW + 1, "right")
    n = np.maximum(high - low, 0)
    above = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return joined(first, first[above], np.repeat(first, n))[run][back]


def star(links: DataFrame, rounds: int = 200) -> DataFrame:
    """raster_id, label, root (the least label it reaches) of all labels with links (raster_id, a, b). Each round every label
    links what is above it to the least that it reaches, then what it reaches below; an error if that doesn't end."""
    key, state = ["raster_id", "a"], None
    now = shared_table(links.select("raster_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = now.unionByName(now.select("raster_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(key).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, key).where("b > a").select("raster_id", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(key).agg(F.min("b").alias("m"))
        below = large.join(low, key).where("b <> m").select("raster_id", F.col("b").alias("a"), F.col("m").alias("b"))
        now = shared_table(below.unionByName(low.select("raster_id", "a", F.col("m").alias("b"))).distinct(), "links")
        told = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("raster_id", "a", "b").cast("decimal(38,0)"))).first())
        if told == state:
            return now.select("raster_id", F.col("a").alias("label"), F.col("b").alias("root"))
        state = told
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def label(px: DataFrame, tile: int = TILE, few_links: int = FEW_LINKS) -> DataFrame:
    """raster_id, r, c, label (the place of the component's first pixel in raster order: row * 2^31 + column)."""
    d = px.select("raster_id", F.col("r").cast("int"), F.col("c").cast("int"))
    schema = d.schema.add("label", "long")

    def one(t: pa.Table) -> pa.Table:
        r, c = t["r"].to_numpy(), t["c"].to_numpy()
        return pa.table({"raster_id": t["raster_id"], "r": t["r"], "c": t["c"], "label": pa.array(flood(r, c))})

    cell = lambda x: F.floor(F.col(x) / tile).cast("int")
    tiled = d.withColumns({"_tr": cell("r"), "_tc": cell("c")}).groupBy("raster_id", "_tr", "_tc").applyInArrow(one, schema)
    tiled = shared_table(tiled, "tiled")
    # Pixels in a tile's last row or column, and what touches them in the next tiles.
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    edge = tiled.where((F.pmod("r", F.lit(tile)) == tile - 1) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
    near = edge.withColumn("n", F.explode(at)).select("raster_id", (F.col("r") + F.col("n.i")).alias("r"), (F.col("c") + F.col("n.j")).alias("c"), F.col("label").alias("a"))
    far = tiled.where(F.pmod("r", F.lit(tile)).isin(0, tile - 1) | F.pmod("c", F.lit(tile)).isin(0, tile - 1)).select("raster_id", "r", "c", F.col("label").alias("b"))
    links = shared_table(near.join(far, ["raster_id", "r", "c"]).where("a <> b").select("raster_id", "a", "b").distinct(), "links")
    n = links.count()
    if not n:
        return tiled
    if n > few_links:
        roots = star(links)
    else:
        rows = []
        by_raster: dict = {}
        for x in links.collect():
            by_raster.setdefault(x["raster_id"], []).append((x["a"], x["b"]))
        for raster, pairs in by_raster.items():
            a, b = np.array(pairs, np.int64).T
            nodes = np.unique(np.concatenate([a, b]))
            rows += zip([raster] * len(nodes), nodes.tolist(), joined(nodes, a, b).tolist(), strict=True)
        roots = px.sparkSession.createDataFrame(rows, links.select("raster_id", F.col("a").alias("label"), F.col("b").alias("root")).schema)
    return tiled.join(roots, ["raster_id", "label"], "left").select("raster_id", "r", "c", F.coalesce("root", "label").alias("label"))


def statistics(labelled: DataFrame) -> DataFrame:
    """raster_id, seq (from 1, in raster order), pixels, box and centroid of each component."""
    s = labelled.groupBy("raster_id", "label").agg(
        F.count("*").alias("pixels"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg("c").alias("cx"), F.avg("r").alias("cy")
    )
    return s.select("raster_id", F.row_number().over(W.partitionBy("raster_id").orderBy("label")).alias("seq"), "label", "pixels", "r0", "r1", "c0", "c1", "cx", "cy")
