"""Raster sources: images and TIFF files to pixel tables, slippy tiles, terrain tiles, arriving files."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.functions import crs
from rastrel.operators import mapalgebra
from rastrel.sources import tiff

#: Fixed: where an image without georeference is put, and its width in degrees; grey of a tile that can't be had; side of a tile.
FALLBACK, FALLBACK_SPAN, GREY, SIDE = (72.87, 19.07), 0.005, 128, 256
_PIXELS = "raster_id string, r int, c int, bands array<double>"
_META = "raster_id string, bands int, height int, width int, min_x double, min_y double, max_x double, max_y double, crs string, nodata double"


def opened(uri: str):
    """A seekable stream of a file in any of pyarrow's file systems."""
    fs, name = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))
    return fs.open_input_file(name)


def parse_tiff(raw: bytes) -> tuple[np.ndarray, dict[int, tuple]]:
    """Array (bands, height, width) and tags of a whole TIFF file."""
    f = io.BytesIO(raw)
    t = tiff.Tiff.opened(f)
    out = np.zeros((t.height, t.width, t.bands), t.kind)
    for at in range(t.grid[0] * t.grid[1]):
        r, c, data = t.read(f, at)
        out[r : r + data.shape[0], c : c + data.shape[1]] = data
    return out.transpose(2, 0, 1), t.tags


def write_tiff(data: np.ndarray, bounds: tuple[float, float, float, float] | None = None) -> bytes:
    """An uncompressed TIFF of (bands, height, width), with scale and tie point for bounds (min_x, min_y, max_x, max_y)."""
    bands, height, width = data.shape
    sample = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    pixels = np.ascontiguousarray(data.transpose(1, 2, 0)).astype(data.dtype.newbyteorder("<")).tobytes()
    bits = 8 * data.dtype.itemsize
    tags = [(256, 4, (width,)), (257, 4, (height,)), (258, 3, (bits,) * bands), (259, 3, (1,)), (262, 3, (2 if bands >= 3 else 1,)), (273, 4, (8,)), (277, 3, (bands,)), (278, 4, (height,)), (279, 4, (len(pixels),)), (339, 3, (sample,) * bands)]
    if bounds:
        tags += [(33550, 12, ((bounds[2] - bounds[0]) / width, (bounds[3] - bounds[1]) / height, 0.0)), (33922, 12, (0.0, 0.0, 0.0, bounds[0], bounds[3], 0.0))]
    at = 8 + len(pixels) + len(pixels) % 2
    extra, entries = b"", b""
    begin = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(values), begin + len(extra))
            extra += raw
    return b"II*\0" + struct.pack("<I", at) + pixels.ljust(at - 8, b"\0") + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def placed(width: int, height: int, tags: dict[int, tuple], bounds=None) -> tuple[float, float, float, float]:
    """Bounds of a raster: told ones, else from scale and tie point, else the fallback box in the image's proportions."""
    if bounds:
        return bounds
    if 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
        left, top = x - i * sx, y + j * sy
        return left, top - height * sy, left + width * sx, top
    return FALLBACK[0], FALLBACK[1], FALLBACK[0] + FALLBACK_SPAN, FALLBACK[1] + FALLBACK_SPAN * height / width


def tiffs(spark: SparkSession, path: str, bounds=None) -> tuple[DataFrame, DataFrame]:
    """Pixels and metadata of the TIFF files at a path, one raster a file; at most three bands are kept.

    Files are dealt to tasks by their blocks (strips or tiles), each of which is read by itself, so that neither a file nor
    what it unpacks to has to fit in memory. Samples that a file declares to be no data are NaN.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    heads = "path string, blocks int, bands int, height int, width int, min_x double, min_y double, max_x double, max_y double, crs string, nodata double"

    def head(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for name in pdf.path:
                with opened(name) as f:
                    t = tiff.Tiff.opened(f)
                rows.append((name, t.grid[0] * t.grid[1], min(3, t.bands), t.height, t.width, *placed(t.width, t.height, t.tags, bounds), f"EPSG:{t.epsg() or 4326}", t.nodata()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in heads.split(", ")]).astype({"nodata": float})

    def pixels(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            for name, at in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if held is None or held[0] != name:
                    f = opened(name)
                    held = name, f, tiff.Tiff.opened(f)
                _, f, t = held
                r0, c0, data = t.read(f, at)
                data = data[..., :3].astype(float)
                if t.nodata() is not None:
                    data[data == t.nodata()] = np.nan
                for a in range(0, data.shape[0], max(1, 65536 // data.shape[1])):  # some rows at a time
                    part = data[a : a + max(1, 65536 // data.shape[1])]
                    h, w, bands = part.shape
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1) * bands, pa.int32()), pa.array(part.ravel()))
                    r, c = np.divmod(np.arange(h * w), w)
                    yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * (h * w)), pa.array((r + r0 + a).astype(np.int32)), pa.array((c + c0).astype(np.int32)), lists], names=["raster_id", "r", "c", "bands"])

    found = files.mapInPandas(head, heads)
    blocks = found.select("path", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    tasks = spark.sparkContext.defaultParallelism * 4
    dealt = blocks.repartition(tasks, "path", F.floor(F.col("block") / 16))
    meta = found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("raster_id"), *[x.split()[0] for x in _META.split(", ")[1:]])
    return dealt.mapInArrow(pixels, _PIXELS), meta


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of PNG, JPEG and TIFF images as Spark's image source decodes them; what is transparent is laid on white."""
    d = spark.read.format("image").load(path).select("image.*")

    def pixels(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for row in pdf.itertuples():
                data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels).astype(float)
                if row.nChannels == 4:
                    share = data[..., 3:] / 255.0
                    data = np.floor(data[..., :3] * share + 255.0 * (1 - share))
                data = data[..., ::-1] if data.shape[2] == 3 else data  # bytes come blue first
                for r in range(row.height):
                    yield pd.DataFrame({"raster_id": row.origin.rpartition("/")[2], "r": r, "c": np.arange(row.width), "bands": list(data[r])}).astype({"r": "int32", "c": "int32"})

    return d.mapInPandas(pixels, _PIXELS)


def rgb(pixels: DataFrame) -> DataFrame:
    """red, green, blue of pixels with bands; one band stands for all three, and blue is the first where there are two."""
    at = lambda i, rest: F.when(F.size("bands") > i, F.col("bands")[i]).otherwise(F.col("bands")[rest])
    return pixels.select("raster_id", "r", "c", F.col("bands")[0].alias("red"), at(1, 0).alias("green"), at(2, 0).alias("blue"))


def tile_grid(areas: DataFrame, most: int = 25) -> DataFrame:
    """id, z, x, y of the tiles of areas (id, min_lon, min_lat, max_lon, max_lat, zoom). Areas of more than 25 tiles go one
    zoom down, once, to 15 at least."""

    def corners(d: DataFrame, z: str) -> DataFrame:
        return d.withColumns({"x0": crs.tile_x(F.col("min_lon"), F.col(z)), "x1": crs.tile_x(F.col("max_lon"), F.col(z)), "y0": crs.tile_y(F.col("max_lat"), F.col(z)), "y1": crs.tile_y(F.col("min_lat"), F.col(z))})

    d = corners(areas, "zoom")
    many = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) > most
    d = corners(d.withColumn("z", F.when(many, F.greatest(F.lit(15), F.col("zoom") - 1)).otherwise(F.col("zoom"))), "z")
    d = d.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return d.select("id", F.col("z").cast("int"), "x", "y")


def mosaic(grid: DataFrame, tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Pixels of areas from tiles (z, x, y, i, j, red, green, blue, i down and j across a tile); grey where there is none."""
    first = grid.groupBy("id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    cells = grid.join(first, "id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    d = cells.join(tiles, ["z", "x", "y", "i", "j"], "left")
    band = lambda b: F.coalesce(b, F.lit(float(GREY))).alias(b)
    return d.select(F.col("id").alias("raster_id"), ((F.col("y") - F.col("y0")) * side + F.col("i")).cast("int").alias("r"), ((F.col("x") - F.col("x0")) * side + F.col("j")).cast("int").alias("c"), *[band(b) for b in ("red", "green", "blue")])


def mosaic_bounds(grid: DataFrame) -> DataFrame:
    """Bounds of each area's mosaic: the outer corners of its tiles."""
    b = grid.groupBy("id", "z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return b.select("id", "z", crs.tile_lon(F.col("x0"), F.col("z")).alias("min_x"), crs.tile_lat(F.col("y1") + 1, F.col("z")).alias("min_y"), crs.tile_lon(F.col("x1") + 1, F.col("z")).alias("max_x"), crs.tile_lat(F.col("y0"), F.col("z")).alias("max_y"))


def terrain(areas: DataFrame, tiles: DataFrame, zoom: int = 14) -> DataFrame:
    """Elevations (id, i, j, metres) of the one tile that holds an area's north-west corner."""
    z = F.lit(zoom)
    at = areas.select("id", z.alias("z"), crs.tile_x(F.col("min_lon"), z).alias("x"), crs.tile_y(F.col("max_lat"), z).alias("y"))
    return at.join(tiles, ["z", "x", "y"]).select("id", "i", "j", mapalgebra.terrarium(F.col("red"), F.col("green"), F.col("blue")).alias("metres"))


def resampled(px: DataFrame, value: str, targets: DataFrame) -> DataFrame:
    """Bilinear values at targets (raster_id, i, j, and r, c as doubles in the source's pixels), from the four around."""
    t = targets.withColumns({"_r": F.floor("r").cast("int"), "_c": F.floor("c").cast("int")})
    t = t.withColumns({"fr": F.col("r") - F.col("_r"), "fc": F.col("c") - F.col("_c")})
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    t = t.withColumn("k", F.explode(four))
    share = lambda k, f: F.when(F.col(k) == 1, F.col(f)).otherwise(1 - F.col(f))
    t = t.select("raster_id", "i", "j", (F.col("_r") + F.col("k.a")).alias("r"), (F.col("_c") + F.col("k.b")).alias("c"), (share("k.a", "fr") * share("k.b", "fc")).alias("w"))
    near = t.where("w > 0").join(px.select("raster_id", "r", "c", F.col(value).alias("_v")), ["raster_id", "r", "c"])
    return near.groupBy("raster_id", "i", "j").agg((F.sum(F.col("_v") * F.col("w")) / F.sum("w")).alias(value))


def to_utm(px: DataFrame, value: str, meta: tuple[float, float, float, float], shape: tuple[int, int], zone: int, south: bool, metres: float) -> DataFrame:
    """A raster resampled to a north-up grid of so many metres in UTM."""
    spark, (x0, y0, x1, y1), (h, w) = px.sparkSession, meta, shape
    box = spark.createDataFrame([(x, y) for x in (x0, x1) for y in (y0, y1)], "lon double, lat double")
    e, n = crs.utm_forward(F.col("lon"), F.col("lat"), F.lit(zone))
    e0, e1, n0, n1 = box.agg(F.min(e), F.max(e), F.min(n), F.max(n)).first()
    rows, cols = max(1, int((n1 - n0) / metres)), max(1, int((e1 - e0) / metres))
    grid = px.select("raster_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    lon, lat = crs.utm_inverse(e0 + (F.col("j") + 0.5) * metres, n1 - (F.col("i") + 0.5) * metres, F.lit(zone), F.lit(south))
    at = grid.select("raster_id", "i", "j", ((lon - x0) / ((x1 - x0) / w) - 0.5).alias("c"), ((y1 - lat) / ((y1 - y0) / h) - 0.5).alias("r"))
    return resampled(px, value, at)


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the raster files that come to a folder: path, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").load(path).select("path", "length", "content")


def georeference(meta: DataFrame) -> DataFrame:
    """Adds the centre, UTM code, resolution in degrees and in metres (from the projected corners) of rasters."""
    lon, lat = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    d = meta.withColumns({"centre_x": lon, "centre_y": lat, "utm_epsg": crs.utm_epsg(lon, lat), "res_x": (F.col("max_x") - F.col("min_x")) / F.col("width"), "res_y": (F.col("max_y") - F.col("min_y")) / F.col("height")})
    zone = F.col("utm_epsg") % 100
    e0, n0 = crs.utm_forward(F.col("min_x"), F.col("min_y"), zone)
    e1, n1 = crs.utm_forward(F.col("max_x"), F.col("max_y"), zone)
    known: Column = crs.is_geographic(F.col("crs"), F.col("min_x"), F.col("min_y"))
    dx, dy = F.when(known, e1 - e0).otherwise(F.col("max_x") - F.col("min_x")), F.when(known, n1 - n0).otherwise(F.col("max_y") - F.col("min_y"))
    return d.withColumn("metres", (F.abs(dx) / F.col("width") + F.abs(dy) / F.col("height")) / 2)
