"""Plane geometry and scores against known values and plain numpy versions."""

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastrel.functions import planar
from rastrel.operators import components, conflate, features, mapalgebra, skeleton, stencil, vectorize
from rastrel.plans import pipeline
from rastrel.sources import rasters, scenes, vectors


geo = lambda c, r: (72.87 + np.asarray(c) * 1e-5, 19.075 - np.asarray(r) * 1e-5)  # noqa: E731  goes to workers by value


def pixels(spark, mask, score=0.9):
    rows = [("a", int(r), int(c), score, 8.5) for r, c in zip(*np.nonzero(mask), strict=True)]
    d = spark.createDataFrame(rows, "raster_id string, r int, c int, score double, ndsm double")
    return components.label(d.select("raster_id", "r", "c")).join(d, ["raster_id", "r", "c"])


def test_rectangle_is_traced_through_pixel_centres():
    m = np.zeros((60, 70), bool)
    m[10:50, 10:60] = True
    ring = planar.corners(planar.trace(m))
    assert len(ring) == 4 and planar.area(ring) == 39 * 49 and planar.perimeter(ring) == 2 * (39 + 49)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_traced_area_obeys_pick(seed):
    rng = np.random.default_rng(seed)
    m = np.zeros((14, 14), bool)
    for _ in range(5):
        r, c = rng.integers(1, 9, 2)
        m[r : r + 4, c : c + 4] = True
    parts = list(vectorize._centroids(m))
    if len(parts) == 1:
        ring = planar.trace(m)
        inside = planar.rasterised(ring, 14, 14) | m
        assert planar.area(ring) == pytest.approx(inside.sum() - len(ring) / 2 - 1)


def test_least_box_of_turned_rectangle():
    box = planar.box_points(np.array([5.0, 7.0]), 8, 3, 30)
    centre, w, h, angle = planar.least_box(np.concatenate([box, box * 0.5 + [2.5, 3.5]]))
    assert np.allclose(centre, [5, 7]) and {round(w, 6), round(h, 6)} == {8, 3}
    assert abs(planar.folded(angle, w, h) - 30) < 1e-6


def test_overlap_with_union_counts_once():
    a = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    b, c = a + [2, 0], a + [2, 1]
    assert planar.overlap_area(a, [b]) == pytest.approx(8)
    assert planar.overlap_area(a, [b, c]) == pytest.approx(8)
    assert planar.overlap_area(a, [a + 9]) == 0
    assert planar.length_inside(np.array([(-1, 2), (9, 2)], float), [b, c]) == pytest.approx(4)


def test_bow_tie_keeps_its_larger_half():
    bow = np.array([(0, 0), (4, 4), (4, 0), (0, 2)], float)
    fixed = planar.repaired(bow)
    assert planar.area(fixed) == pytest.approx(max(planar.area(np.array([(4 / 3, 4 / 3), (4, 4), (4, 0)])), planar.area(np.array([(0, 0), (4 / 3, 4 / 3), (0, 2)]))))


def test_chamfer_distance():
    m = np.zeros((9, 9), bool)
    m[2:7, 2:7] = True
    assert planar.distance(m)[4, 4] == pytest.approx(3.0)


def test_thinning_keeps_one_line():
    m = np.zeros((9, 30), bool)
    m[3:6, 2:28] = True
    t = planar.thinned(m)
    assert t[4].sum() >= 20 and t.sum() == t[4].sum()


def test_road_t_gives_lines(spark):
    m = np.zeros((120, 120), bool)
    m[55:65, 10:110] = True
    m[60:110, 55:65] = True
    rows = skeleton.centrelines(pixels(spark, m).select("raster_id", "label", "r", "c", "score"), 0.05, geo, 0.5).collect()
    assert rows and all(r.length_m > 0.5 for r in rows) and max(r.length_m for r in rows) < 6


def test_spur_is_pruned_and_chain_is_straight():
    g = skeleton.graph(np.eye(30, dtype=bool))
    assert len(skeleton.chains(g)) == 1
    assert skeleton.straightened(skeleton.chains(g)[0]) == [(0, 0), (29, 29)]
    m = np.zeros((10, 40), bool)
    m[5, :] = True
    m[2:5, 20] = True
    left = skeleton.pruned(skeleton.graph(m), 6.0, 1.0)
    assert all(p[0] >= 4 for p in left)


def test_footprint_of_rectangle_and_l(spark):
    m = np.zeros((120, 120), bool)
    m[20:80, 20:50] = True
    m[50:80, 50:90] = True
    r = vectorize.footprints(pixels(spark, m).select("raster_id", "label", "r", "c", "score"), 0.1, geo).collect()
    assert len(r) == 1 and r[0].how == "box"
    assert r[0].area_sqm == pytest.approx(28.715, abs=0.006)  # the outline cuts the inner corner, which is half a pixel
    roof = vectorize.roof_statistics(pixels(spark, m)).collect()[0]
    assert roof.height_max == 8.5 and roof.roof_profile == "flat"


def test_large_block_is_split(spark):
    m = np.zeros((80, 200), bool)
    m[5:75, 5:75] = m[5:75, 100:170] = True
    m[38:42, 75:100] = True
    r = vectorize.footprints(pixels(spark, m).select("raster_id", "label", "r", "c", "score"), 1.0, geo, most=20000.0, widest=100.0).collect()
    assert len(r) == 2 and {x.how for x in r} == {"part"}


def test_tree_disc(spark):
    d = spark.range(6400).selectExpr("'a' raster_id", "cast(id div 80 as int) r", "cast(id % 80 as int) c")
    on = (F.col("r") - 40) ** 2 + (F.col("c") - 40) ** 2 <= 144
    d = d.withColumns({"score": F.when(on, 0.9).otherwise(0.0), "ndsm": F.when(on, 14.5).otherwise(0.0)})
    t = vectorize.trees(d, "score", 0.05, (72.87, 19.075), (1e-5, 1e-5)).collect()
    assert len(t) == 1 and t[0].height_m == 14.5 and t[0].crown_diameter_m > 0.5 and not t[0].needs_review


def _numpy_scores(red, green, blue, height):
    """The class scores in plain numpy, with mirrored and clipped borders spelled out."""

    def moved(a, dr, dc, fill):
        out = np.full(a.shape, fill, float)
        h, w = a.shape
        rs, cs = slice(max(0, -dr), min(h, h - dr)), slice(max(0, -dc), min(w, w - dc))
        out[rs, cs] = a[rs.start + dr : rs.stop + dr, cs.start + dc : cs.stop + dc]
        return out

    def morph(a, offsets, f):
        return f([moved(a, dr, dc, np.inf if f is least else -np.inf) for dr, dc in offsets])

    least, most = lambda xs: np.minimum.reduce(xs), lambda xs: np.maximum.reduce(xs)
    rect = lambda h, w: [(i, j) for i in range(-(h // 2), h // 2 + 1) for j in range(-(w // 2), w // 2 + 1)]
    opened = lambda a, o: morph(morph(a, o, least), o, most)
    ellipse = lambda k: [(dy, dx) for dy, w in stencil.half_widths(k).items() for dx in range(-w, w + 1)]

    def blur(a, w):
        k = len(w) // 2
        for axis in (1, 0):
            p = np.pad(a, [(k, k) if x == axis else (0, 0) for x in (0, 1)], "reflect")
            a = sum(wi * np.take(p, range(i, i + a.shape[axis]), axis) for i, wi in enumerate(w))
        return a

    bright = (red + green + blue) / 3
    excess = (2 * green - red - blue) / np.maximum(red + green + blue, 1)
    dev = np.std([red, green, blue], axis=0)
    gray = np.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5)
    grad = morph(gray, rect(3, 3), most) - morph(gray, rect(3, 3), least)
    p = np.pad(gray, 1, "reflect")
    texture = blur(abs(p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray), stencil.gaussian(15))
    contrast = abs(bright - blur(bright, [1 / 15] * 15))
    veg = (green > red + 4) & (green > blue + 4) & (excess > 0.03)
    tree = np.where(veg, np.clip(excess * 4.5, 0.4, 1), 0) * np.where(height >= 1.8, 1, 0.15)
    bare = (red > green + 3) & (red > blue + 5) & (bright > 50) & (bright < 200) & (texture < 5) & (grad < 12) & ~veg
    lawn = veg & (texture < 3.5) & (grad < 8)
    ground = (morph(bare * 1.0, ellipse(11), most) > 0) | (morph(lawn * 1.0, ellipse(7), most) > 0)
    calm = (grad < 8) & ~veg
    wet = (blue > red + 5) & (blue > green - 5) & (bright < 160) & (excess < 0.05)
    wet |= (green > red + 3) & (green > blue + 3) & (excess >= 0) & (excess < 0.12) & (bright < 110) & (texture < 4) & calm
    wet |= (bright < 100) & (texture < 3.5) & calm & (red - blue < 25) & (dev < 16) & ~bare
    water = np.where(wet & ~veg & ~ground & (grad <= 12), 0.96, 0)
    clear = (tree < 0.3) & (water < 0.25)
    paved = 1.0 * ((dev < 26) & (bright > 35) & (bright < 195) & clear)
    line = lambda s: [(i, s * i) for i in range(-5, 6)]
    way = np.maximum.reduce([opened(paved, rect(3, 13)), opened(paved, rect(13, 3)), opened(paved, line(1)), opened(paved, line(-1))])
    road = np.clip(blur(way, [0.25, 0.5, 0.25]) * 1.8, 0, 0.95)
    road = np.where(height < 1.4, road, 0) * np.where(ground, 0.15, 1)
    tin = (bright > 130) & (contrast > 5) & clear
    clay = (red > green + 8) & (red > blue + 10) & (bright > 55) & (bright < 185) & (tree < 0.25) & (grad > 8) & (contrast > 4) & ~bare
    flat = (bright > 65) & (bright < 245) & (dev < 30) & (contrast > 2.8) & (grad > 6) & clear
    edge = (grad > 12) & clear & (tin | clay | flat | (contrast > 6))
    road = np.where(flat & (contrast > 4.5), 0, road)
    roof = blur(opened(1.0 * (tin | clay | flat | edge), rect(3, 3)), [0.25, 0.5, 0.25])
    built = np.where((road > 0.45) | (water > 0.25) | (tree > 0.4) | ground, 0, np.clip(roof * 1.5, 0, 0.95))
    built = np.maximum(built, 0.94 * ((height >= 2.5) & (tree < 0.3) & ~ground))
    farm = (excess > 0.06) & (tree < 0.35) & (built < 0.2) & ~ground & (texture < 8) & (height < 1)
    farm = 0.85 * farm * opened(1.0 * farm, rect(11, 11))
    return {"buildings": built, "roads": road, "trees": tree, "farms": farm, "water": water}


def test_class_scores_equal_numpy(spark):
    rng = np.random.default_rng(3)
    size = 60
    d = scenes.demo_scene(spark, size).toPandas().sort_values(["r", "c"])
    bands = {b: d[b].to_numpy().reshape(size, size) + rng.integers(0, 9, (size, size)) for b in ("red", "green", "blue")}
    for b in bands:
        d[b] = bands[b].ravel()
    got = mapalgebra.scores(spark.createDataFrame(d)).toPandas().sort_values(["r", "c"])
    want = _numpy_scores(**bands, height=(d.dsm - d.dtm).to_numpy().reshape(size, size))
    for layer, x in want.items():
        assert np.allclose(got[layer].to_numpy().reshape(size, size), x, atol=1e-9), layer


def test_tiff_round_trip(spark, tmp_path):
    data = (np.arange(3 * 8 * 5) % 251).reshape(3, 8, 5).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(rasters.write_tiff(data, (72.87, 19.07, 72.875, 19.078)))
    (tmp_path / "b.tif").write_bytes(rasters.write_tiff(data[:1].astype(np.float32) / 7))
    px, meta = rasters.tiffs(spark, str(tmp_path))
    rows = {(r.raster_id, r.r, r.c): r.bands for r in px.collect()}
    assert rows["a.tif", 3, 2] == data[:, 3, 2].tolist() and rows["b.tif", 7, 4] == [float(np.float32(data[0, 7, 4]) / np.float32(7))]
    m = {r.raster_id: r for r in rasters.georeference(meta).collect()}
    assert (m["a.tif"].height, m["a.tif"].width, m["a.tif"].utm_epsg) == (8, 5, 32643) and m["a.tif"].max_y == pytest.approx(19.078)
    assert m["b.tif"].min_x == 72.87 and m["b.tif"].max_y == pytest.approx(19.07 + 0.005 * 8 / 5)


def build_tiff(data, big=False, tile=None, rows=None, how=1, predictor=1, apart=False, order="<", nodata=None, epsg=None):
    """A TIFF file of (bands, height, width) in whatever form, block by block."""
    bands, height, width = data.shape
    h, w = (tile, tile) if tile else (rows or height, width)
    kind = data.dtype.newbyteorder(order)

    def packed(block):  # rows, columns, samples
        if predictor == 2:
            block = np.diff(block.astype(data.dtype), axis=1, prepend=np.zeros_like(block[:, :1])).astype(data.dtype)
        raw = np.ascontiguousarray(block.astype(kind)).tobytes()
        if predictor == 3:
            parts = np.ascontiguousarray(block.astype(data.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(block), -1, data.dtype.itemsize).transpose(0, 2, 1).reshape(len(block), -1)
            raw = np.diff(parts, axis=1, prepend=np.zeros_like(parts[:, :1])).astype(np.uint8).tobytes()
        if how == 8:
            return zlib.compress(raw)
        if how == 32773:
            return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))
        return lzw(raw) if how == 5 else raw

    planes = [data[b : b + 1] for b in range(bands)] if apart else [data]
    blocks = []
    for p in planes:
        for r in range(0, height, h):
            for c in range(0, width, w):
                part = p[:, r : r + h, c : c + w].transpose(1, 2, 0)
                blocks.append(packed(np.pad(part, ((0, h - part.shape[0]) if tile else (0, 0), (0, w - part.shape[1]) if tile else (0, 0), (0, 0)))))
    number, place, entry, at = ("Q", "Q", "HHQ", 16) if big else ("H", "I", "HHI", 8)
    offsets = [at + sum(map(len, blocks[:i])) for i in range(len(blocks))]
    sample = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tags = {256: ("I", (width,)), 257: ("I", (height,)), 258: ("H", (8 * data.dtype.itemsize,) * bands), 259: ("H", (how,)), 277: ("H", (bands,)), 284: ("H", (2 if apart else 1,)), 317: ("H", (predictor,)), 339: ("H", (sample,) * bands)}
    tags |= {322: ("I", (w,)), 323: ("I", (h,)), 324: (place, offsets), 325: (place, [len(b) for b in blocks])} if tile else {273: (place, offsets), 278: ("I", (h,)), 279: (place, [len(b) for b in blocks])}
    if nodata is not None:
        tags[42113] = ("s", nodata.encode() + b"\0")
    if epsg:
        tags[34735] = ("H", (1, 1, 0, 1, 3072, 0, 1, epsg))
    begin = at + sum(map(len, blocks))
    codes, extra, entries = {"H": 3, "I": 4, "Q": 16, "s": 2}, b"", b""
    tail = begin + struct.calcsize("=" + number) + len(tags) * (20 if big else 12) + struct.calcsize("=" + place)
    for tag, (form, values) in sorted(tags.items()):
        raw = values if form == "s" else struct.pack(f"{order}{len(values)}{form}", *values)
        entries += struct.pack(order + entry, tag, codes[form], len(values))
        if len(raw) <= struct.calcsize("=" + place):
            entries += raw.ljust(struct.calcsize("=" + place), b"\0")
        else:
            entries += struct.pack(order + place, tail + len(extra))
            extra += raw
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, begin) if big else struct.pack(order + "HI", 42, begin))
    return head + b"".join(blocks) + struct.pack(order + number, len(tags)) + entries + struct.pack(order + place, 0) + extra


def lzw(raw):
    """Codes that grow one early, a clear at the start and where the table is full."""
    bits, n, table, width = 0, 0, {}, 9

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    def clear():
        nonlocal table, width
        table = {bytes([i]): i for i in range(256)} | {None: 256, "end": 257}

    clear()
    put(256)
    have = b""
    for b in raw:
        if have + bytes([b]) in table:
            have += bytes([b])
            continue
        put(table[have])
        table[have + bytes([b])] = len(table)
        width = 9 + (len(table) > 511) + (len(table) > 1023) + (len(table) > 2047)
        if len(table) > 4093:
            put(256)
            clear()
            width = 9
        have = bytes([b])
    put(table[have])
    table["last"] = len(table)
    width = 9 + (len(table) > 511) + (len(table) > 1023) + (len(table) > 2047)
    put(257)
    pad = -n % 8
    return (bits << pad).to_bytes((n + pad) // 8, "big")


def test_tiff_forms(spark, tmp_path):
    """Strips and tiles, plain and compressed, classic and big, of several types: all read as what was written."""
    rng = np.random.default_rng(5)
    bytes_, shorts = rng.integers(0, 255, (3, 61, 47)).astype(np.uint8), rng.integers(0, 9000, (1, 61, 47)).astype(np.uint16)
    floats, ramp = rng.normal(0, 5, (1, 61, 47)).astype(np.float32), (np.arange(3 * 61 * 47) // 50 % 256).reshape(3, 61, 47).astype(np.uint8)
    forms = [(bytes_, {"rows": 7}), (bytes_, {"tile": 16, "how": 8, "predictor": 2}), (bytes_, {"big": True, "tile": 32, "how": 5}), (ramp, {"how": 5, "rows": 20, "predictor": 2}), (shorts, {"order": ">", "rows": 10, "how": 8, "predictor": 2}),
             (floats, {"how": 8, "predictor": 3, "rows": 9}), (floats, {"tile": 16, "order": ">", "big": True}), (bytes_, {"apart": True, "tile": 16, "how": 32773}), (shorts, {"nodata": "77", "epsg": 32643})]
    shorts[0, 3, 4] = 77
    for i, (data, form) in enumerate(forms):
        raw = build_tiff(data, **form)
        assert np.array_equal(rasters.parse_tiff(raw)[0], data), form
        (tmp_path / f"{i}.tif").write_bytes(raw)
    px, meta = rasters.tiffs(spark, str(tmp_path))
    got = px.toPandas()
    for i, (data, _) in enumerate(forms):
        mine = got[got.raster_id == f"{i}.tif"].sort_values(["r", "c"])
        want = data.astype(float).copy()
        if i == 8:
            want[data == 77] = np.nan
        assert np.array_equal(np.stack(mine.bands.to_list()).T.reshape(data.shape), want, equal_nan=True)
    assert {r.raster_id: (r.crs, r.nodata) for r in meta.collect()}["8.tif"] == ("EPSG:32643", 77.0)
    with pytest.raises(ValueError):
        rasters.parse_tiff(b"II*\0")


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
        raw = b"".join(b"\0" + row.tobytes() for row in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    a = np.arange(36, dtype=np.uint8).reshape(4, 3, 3)
    (tmp_path / "a.png").write_bytes(png(a))
    rows = {(r.r, r.c): (r.red, r.green, r.blue) for r in rasters.rgb(rasters.images(spark, str(tmp_path))).collect()}
    assert rows == {(i, j): tuple(map(float, a[i, j])) for i in range(4) for j in range(3)}


def test_mosaic_fills_missing_tiles(spark):
    grid = spark.createDataFrame([(1, 15, 10, 20), (1, 15, 11, 20)], "id long, z int, x long, y long")
    tiles = spark.createDataFrame([(15, 10, 20, i, j, 1.0, 2.0, 3.0) for i in range(2) for j in range(2)], "z int, x long, y long, i int, j int, red double, green double, blue double")
    rows = {(r.r, r.c): r.red for r in rasters.mosaic(grid, tiles, 2).collect()}
    assert rows == {(i, j): 1.0 if j < 2 else 128.0 for i in range(2) for j in range(4)}
    b = rasters.mosaic_bounds(grid).first()
    assert b.max_x - b.min_x == pytest.approx(2 * 360 / 2**15)


def test_utm_resampling_keeps_a_plane(spark):
    h = w = 40
    d = spark.range(h * w).selectExpr("'a' raster_id", f"cast(id div {w} as int) r", f"cast(id % {w} as int) c", f"cast(id % {w} as double) v")
    out = rasters.to_utm(d, "v", (72.87, 19.07, 72.874, 19.074), (h, w), 43, False, 10.0).toPandas()
    assert len(out) > 1000 and out.v.between(0, w - 1).all()
    assert out.groupby("j").v.mean().is_monotonic_increasing


def test_shapefile_and_geopackage(tmp_path):
    import sqlite3

    outer = [(72.871, 19.071), (72.873, 19.071), (72.873, 19.073), (72.871, 19.073), (72.871, 19.071)]
    hole = [(72.8715, 19.0715), (72.8725, 19.0715), (72.8725, 19.0725), (72.8715, 19.0725), (72.8715, 19.0715)]
    fs, fields = [([outer, hole], {"bldg_id": 99, "has_court": True, "height_max": 14.2})], [("bldg_id", "int"), ("has_court", "int"), ("height_max", "float")]
    files = vectors.shapefile("Polygon", fs, fields)
    (rings,) = vectors.read_shapefile(files[".shp"])
    assert len(rings) == 2 and set(rings[1]) == set(hole) and b"99" in files[".dbf"]
    assert vectors.write_geopackage(tmp_path / "a.gpkg", {"b": ("Polygon", fs, fields), "none": ("Point", [], [])})
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        assert db.execute("select bldg_id, height_max from b").fetchall() == [(99, 14.2)]
        assert db.execute("select count(*) from gpkg_contents").fetchone() == (1,)
    vectors.bundle({"b": ("Polygon", fs, fields)}, {"b": ['{"type":"Feature"}']}, tmp_path / "a.zip")
    import zipfile

    assert {"metadata.json", "b.geojson", "b.shp", "b.dbf", "b.prj", "layers.gpkg"} <= set(zipfile.ZipFile(tmp_path / "a.zip").namelist())


def test_polygon_spans_equal_points_in_rings(spark, monkeypatch):
    """Runs of pixels of random stars, some open, one in itself, against every pixel's centre; the work is cut in parts."""
    monkeypatch.setattr(vectorize, "_CROSSINGS", 50)
    rng, rows, want = np.random.default_rng(3), [], set()
    for i in range(40):
        ring = np.round(rng.uniform(-5, 25, (int(rng.integers(3, 9)), 2)), int(rng.integers(0, 3)))
        c, r = (v.ravel() for v in np.meshgrid(np.arange(-6, 27), np.arange(-6, 27)))
        want |= {("a", i, int(b), int(a)) for a, b in zip(c[planar.inside(ring, np.stack([c, r], 1))], r[planar.inside(ring, np.stack([c, r], 1))], strict=True)}
        points = [{"x": float(x), "y": -float(y)} for x, y in ring]
        rows.append(("a", i, points + points[: i % 2]))
    rows += [("a", 90, None), ("a", 91, []), ("a", 92, [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": None}, {"x": 5.0, "y": 5.0}])]
    d = spark.createDataFrame(rows, "raster_id string, id long, ring array<struct<x:double,y:double>>").coalesce(1)
    spans = vectorize.polygon_spans(d, (0.0, 0.0), (1.0, 1.0)).collect()
    got = [(s.raster_id, s.id, s.r, c) for s in spans for c in range(s.c0, s.c1 + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(spans) < len(got) / 2
    assert {tuple(p) for p in vectorize.polygon_pixels(d, (0.0, 0.0), (1.0, 1.0)).collect()} == want


def test_points_near_dense_segments(spark):
    """Against brute force, copies and odd rows included; where most is near, few pairs are looked at."""
    rng = np.random.default_rng(5)
    p, s = rng.uniform(0, 0.01, (400, 2)), rng.uniform(0, 0.01, (300, 1, 2)) + rng.uniform(-0.001, 0.001, (300, 2, 2))
    s[:20, 1] = s[:20, 0]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([p, p[:50]]))] + [(900, None, 0.001), (901, 0.001, None)]
    segments = [(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(np.concatenate([s, s[:30]]))] + [(900, None, 0.0, 0.01, 0.01)]
    e = s[:, 1] - s[:, 0]
    f = p[:, None] - s[:, 0]
    t = np.clip((f * e).sum(2) / np.maximum((e * e).sum(1), 1e-300), 0, 1)
    near = (np.hypot(*np.moveaxis(f - t[..., None] * e, 2, 0)) < 1e-4).any(1)
    got = conflate.points_near_segments(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(segments, "id long, x0 double, y0 double, x1 double, y1 double"), 1e-4)
    assert sorted(r.id for r in got.collect()) == [i for i, b in enumerate(np.concatenate([near, near[:50]])) if b] and 0 < near.sum() < 400
    pairs = []
    conflate._any(1000, 1000, lambda i, j: pairs.append(len(i) * len(j)) or np.ones((len(i), len(j)), bool))
    assert sum(pairs) < 10_000


def test_line_shares_over_a_limit(spark):
    """With a limit the same lines are over it as without, among lines of one and of more segments; near ones are settled
    without meeting all others."""
    rng = np.random.default_rng(7)
    walk = lambda n: np.cumsum(np.concatenate([rng.uniform(0, 0.02, (1, 2)), rng.uniform(-0.001, 0.001, (n, 2))]), 0)
    table = lambda n, k: spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in walk(1 + i % k)]) for i in range(n)], "id long, line array<struct<x:double,y:double>>")
    found, reference = table(200, 3).cache(), table(300, 2).cache()
    over = lambda d: {r.id for r in d.collect() if r.share > 0.12}
    exact = conflate.line_share_in_corridors(found, reference, 1e-4)
    assert over(conflate.line_share_in_corridors(found, reference, 1e-4, 0.12)) == over(exact) and 10 < len(over(exact)) < 190
    pieces, most = conflate._pieces(reference), {r.id: r.share for r in exact.collect()}
    quick = {r.id: r.share for r in conflate._lines_quickly(found, pieces, 1e-4, 0.12).collect()}
    assert all(x <= most.get(i, 0.0) + 1e-9 for i, x in quick.items()) and sum(x > 0.12 for x in quick.values()) > 10


def test_ring_shares_over_a_limit(spark):
    """With a limit the same rings are over it as by their whole unions; rings within one corridor meet no list of roads."""
    rng = np.random.default_rng(9)
    at = lambda p: [{"x": float(x), "y": float(y)} for x, y in p]
    corner = rng.uniform(0, 0.003, (60, 2))
    rings = [(i, at([c, c + [8e-5, 0], c + [8e-5, 5e-5], c + [0, 5e-5], c])) for i, c in enumerate(corner)]
    start = rng.uniform(0, 0.0015, (40, 2))
    lines = [(i, at([a, a + d])) for i, (a, d) in enumerate(zip(start, rng.uniform(-4e-4, 4e-4, (40, 2)), strict=True))]
    r = spark.createDataFrame(rings, "id long, ring array<struct<x:double,y:double>>")
    ln = spark.createDataFrame(lines + lines[:10], "id long, line array<struct<x:double,y:double>>")
    caps = [planar.capsule(*(np.array([(p["x"], p["y"]) for p in x])), 1e-4) for _, x in lines]
    want = {i for i, x in rings if planar.overlap_area(ring := np.array([(p["x"], p["y"]) for p in x[:-1]]), caps) > 0.12 * planar.area(ring)}
    got = {s.id for s in conflate.ring_share_in_corridors(r, ln, 1e-4, 0.12).collect() if s.share > 0.12}
    assert got == want and 5 < len(want) < 55
    quick = {s.id for s in conflate._rings_quickly(r, conflate._pieces(ln), 1e-4).collect() if s.share == 1.0}
    assert quick and quick <= want


def test_conflation_shares(spark):
    line = lambda i, *p: (i, [{"x": x, "y": y} for x, y in p])
    kind = "id long, line array<struct<x:double,y:double>>"
    found = spark.createDataFrame([line(1, (0.0, 0.0), (0.01, 0.0)), line(2, (0.0, 0.001), (0.01, 0.001)), line(3, (0.5, 0.5), (0.51, 0.5))], kind)
    reference = spark.createDataFrame([line(9, (-0.01, 0.0001), (0.005, 0.0001))], kind)
    shares = {r.id: r.share for r in conflate.line_share_in_corridors(found, reference, 0.00018).collect()}
    assert shares[1] == pytest.approx(0.515, abs=0.01) and shares.get(2, 0) == 0 and 3 not in shares


def test_conflated_layers(spark):
    from rastrel.operators import attributes

    found = pipeline.process_scene(scenes.demo_scene(spark, 150), 4.4528, (72.87, 19.076), (4e-5, 4e-5))
    box = lambda x0, y0, x1, y1: [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    rows = [(1, {"building": "apartments", "height": "12 m"}, box(72.8718, 19.0742, 72.8721, 19.0744)), (2, {"highway": "primary"}, [{"x": 72.87, "y": 19.073}, {"x": 72.876, "y": 19.073}])]
    reference = attributes.reference_features(spark.createDataFrame(rows, "id long, tags map<string,string>, points array<struct<x:double,y:double>>"))
    out = pipeline.conflated(found, reference).toPandas()
    assert {"buildings", "roads", "water"} <= set(out.layer)
    assert (out[out.layer == "buildings"].height_max > 0).all() and (out[(out.layer == "buildings") & out.given].height_max == 12.0).all()


def test_whole_area(spark):
    """The chain over one area: what the map has stands with its own heights, elevations are the terrain's, and a dark strip
    beside a building without a told height gives it one."""
    origin, step, metres = (72.87, 19.076), (4e-5, 4e-5), 4.4528
    d = scenes.demo_scene(spark, 150)
    dark = F.col("r").between(20, 33) & F.col("c").between(8, 40)
    d = d.withColumns({b: F.when(dark, 10.0).otherwise(F.col(b)) for b in ("red", "green", "blue")})
    box = lambda r0, c0, r1, c1: [{"x": origin[0] + c * step[0], "y": origin[1] - r * step[1]} for r, c in ((r0, c0), (r0, c1), (r1, c1), (r1, c0))]
    rows = [(1, {"building": "apartments", "height": "12 m"}, box(45, 45, 49, 52)), (2, {"building": "yes"}, box(34, 20, 36, 23))]
    elements = spark.createDataFrame(rows, "id long, tags map<string,string>, points array<struct<x:double,y:double>>")
    out = pipeline.extract_aoi(d, elements, metres, origin, step, (d, "dtm", origin, step)).toPandas()
    given = out[(out.layer == "buildings") & (out.given == True)].set_index("feature_id")  # noqa: E712
    assert given.height_max["1"] == 12.0 and (given.terrain_elevation_m == 50.0).all()
    assert given.shadow_m["2"] > 3 and given.height_max["2"] == given.shadow_m["2"]


def test_stream_of_files(spark, tmp_path):
    from rastrel.streaming import ingest

    data = np.full((3, 20, 20), 120, np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tif").write_bytes(rasters.write_tiff(data))
    q = ingest.pixels_to_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400


def test_edits_last_write_wins(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "feature_id long, name string")
    e = spark.createDataFrame([(1, "x", "upsert", 1), (1, "y", "delete", 2), (3, "z", "upsert", 1), (3, "zz", "upsert", 5)], "feature_id long, name string, op string, seq long")
    assert sorted(map(tuple, features.merged(f, e, ("feature_id",)).collect())) == [(2, "b"), (3, "zz")]


def test_perimeter_of_triangle():
    assert math.isclose(planar.perimeter(np.array([(0, 0), (3, 0), (3, 4)])), 12)
