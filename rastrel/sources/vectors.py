"""Vector sources and sinks: reference elements, GeoJSON, shapefiles, GeoPackage, bundles.

Row-wise forms (GeoJSON lines, table projections) are DataFrames that any writer takes; single files of a layer are
written by the task or driver that gets the rows in a stream, a row at a time.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.functions import geometry

#: Fixed: the coordinate system's names.
URN = "urn:ogc:def:crs:OGC:1.3:CRS84"
PRJ = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def reference_elements(spark: SparkSession, path: str) -> DataFrame:
    """id, tags, points of the elements of reference responses (JSON with an elements array); none for a broken file."""
    schema = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    points = F.transform(F.coalesce("e.geometry", F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: geometry.point(p["lon"], p["lat"]))
    return d.select("e.id", F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"), points.alias("points"))


def geojson(geom_type: Column, rings: Column) -> Column:
    """A geometry's GeoJSON. rings: an array of arrays of points; lines and points use the first."""
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, pair), ","), F.lit("]"))
    inner = F.when(geom_type == "Polygon", F.concat(F.lit("["), F.array_join(F.transform(rings, ring), ","), F.lit("]"))).when(geom_type == "Point", pair(rings[0][0])).otherwise(ring(rings[0]))
    return F.concat(F.lit('{"type":"'), geom_type, F.lit('","coordinates":'), inner, F.lit("}"))


def geojson_rows(features: DataFrame, properties: list[str]) -> DataFrame:
    """value: one GeoJSON feature a row, from feature_id, geom_type, rings and properties."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    return features.select(F.concat(F.lit('{"type":"Feature","id":"'), F.col("feature_id").cast("string"), F.lit('","geometry":'), geojson(F.col("geom_type"), F.col("rings")), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(rows: Iterable[str], path: Path) -> None:
    """A FeatureCollection of GeoJSON features, written as they come."""
    with path.open("w") as f:
        f.write('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"%s"}},"features":[' % URN)
        for i, row in enumerate(rows):
            f.write(("," if i else "") + "\n" + row)
        f.write("\n]}\n")


def field_projection(features: DataFrame, properties: list[str]) -> DataFrame:
    """Properties as a shapefile's table takes them: names of ten characters, truth as 0 and 1, what isn't a number as text."""
    out = []
    for name, kind in features.select(*properties).dtypes:
        short = name[:10]
        if kind == "boolean":
            out.append(F.col(name).cast("int").alias(short))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            out.append(F.col(name).alias(short))
        else:
            out.append(F.col(name).cast("string").alias(short))
    return features.select(*out)


def shapefile(kind: str, features: list[tuple[list[list[tuple[float, float]]], dict]], fields: list[tuple[str, str]]) -> dict[str, bytes]:
    """The .shp, .shx, .dbf and .prj of features (rings of points, properties). kind: Point, LineString or Polygon;
    fields: name and one of int, float, str."""
    code = {"Point": 1, "LineString": 3, "Polygon": 5}[kind]
    shapes, index, at = io.BytesIO(), io.BytesIO(), 50
    box = [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for i, (rings, _) in enumerate(features, 1):
        if kind == "Polygon":  # the outer ring clockwise, holes the other way
            turn = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False))
            rings = [r if (turn(r) < 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
        points = [p for r in rings for p in r]
        own = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)]
        box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        if kind == "Point":
            body = struct.pack("<i2d", code, *points[0])
        else:
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            body = struct.pack("<i4d2i", code, *own, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shapes.write(struct.pack(">2i", i, len(body) // 2) + body)
        index.write(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, code, *(box if features else [0.0] * 4), 0, 0, 0, 0)
    forms = {"int": (b"N", 18, 0), "float": (b"F", 24, 8), "str": (b"C", 120, 0)}
    sizes = [forms[t] for _, t in fields]
    table = struct.pack("<4BIHH20x", 3, 125, 1, 1, len(features), 33 + 32 * len(fields), 1 + sum(s[1] for s in sizes))
    for (name, _), (letter, size, places) in zip(fields, sizes, strict=True):
        table += struct.pack("<11sc4xBB14x", name[:10].encode("ascii", "replace"), letter, size, places)
    table += b"\r"
    for _, props in features:
        table += b" "
        for (name, t), (_, size, places) in zip(fields, sizes, strict=True):
            v = props.get(name)
            text = "" if v is None else f"{int(v)}" if t == "int" else f"{v:.{places}f}" if t == "float" else str(v)
            raw = text.encode("utf-8", "replace")[:size]
            table += raw.ljust(size) if t == "str" else raw.rjust(size)
    return {".shp": head(50 + len(shapes.getvalue()) // 2) + shapes.getvalue(), ".shx": head(50 + 4 * len(features)) + index.getvalue(), ".dbf": table + b"\x1a", ".prj": PRJ.encode()}


def read_shapefile(shp: bytes) -> list[list[list[tuple[float, float]]]]:
    """The rings of each shape."""
    out, at = [], 100
    while at < len(shp):
        (words,), body = struct.unpack_from(">i", shp, at + 4), at + 8
        (code,) = struct.unpack_from("<i", shp, body)
        if code == 1:
            out.append([[struct.unpack_from("<2d", shp, body + 4)]])
        else:
            parts, n = struct.unpack_from("<2i", shp, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", shp, body + 44), n]
            points = [struct.unpack_from("<2d", shp, body + 44 + 4 * parts + 16 * k) for k in range(n)]
            out.append([points[a:b] for a, b in zip(starts, starts[1:], strict=False)])
        at = body + 2 * words
    return out


def write_geopackage(path: Path, layers: dict[str, tuple[str, list[tuple[list, dict]], list[tuple[str, str]]]]) -> bool:
    """A GeoPackage with a table for each layer that has features; whether one was written."""
    layers = {k: v for k, v in layers.items() if v[1]}
    if not layers:
        return False
    path.unlink(missing_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, '')", [("WGS 84", 4326, "EPSG", 4326, PRJ), ("undefined", -1, "NONE", -1, "undefined"), ("undefined geographic", 0, "NONE", 0, "undefined")])
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT UNIQUE, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
        for name, (kind, features, fields) in layers.items():
            types = {"int": "INTEGER", "float": "REAL", "str": "TEXT"}
            db.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB' + "".join(f', "{f}" {types[t]}' for f, t in fields) + ")")
            points = [p for rings, _ in features for r in rings for p in r]
            box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)]
            db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', '2000-01-01T00:00:00.000Z', ?, ?, ?, ?, 4326)", (name, name, *box))
            db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, 4326, 0, 0)", (name, kind.upper()))
            rows = [(b"GP\0\1" + struct.pack("<i", 4326) + wkb(kind, rings), *[props.get(f) for f, _ in fields]) for rings, props in features]
            db.executemany(f'INSERT INTO "{name}" (geom' + "".join(f', "{f}"' for f, _ in fields) + ") VALUES (?" + ", ?" * len(fields) + ")", rows)
    return True


def wkb(kind: str, rings: list) -> bytes:
    points = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    if kind == "Point":
        return struct.pack("<BI2d", 1, 1, *rings[0][0])
    if kind == "LineString":
        return struct.pack("<BI", 1, 2) + points(rings[0])
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(points, rings))


def manifest(features: DataFrame) -> DataFrame:
    """layer, features: what a bundle says it holds; no row for an empty layer."""
    return features.groupBy("layer").agg(F.count("*").alias("features"))


def bundle(layers: dict[str, tuple[str, list[tuple[list, dict]], list[tuple[str, str]]]], geojson_of: dict[str, list[str]], path: Path) -> None:
    """A ZIP with metadata, and GeoJSON, shapefile and GeoPackage of the layers that have features. Every bundle has a folder of its own."""
    import tempfile

    held = {k: v for k, v in layers.items() if v[1]}
    with tempfile.TemporaryDirectory() as d, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("metadata.json", json.dumps({"total_features": sum(len(v[1]) for v in held.values()), "layers": {k: len(v[1]) for k, v in held.items()}}, indent=2))
        for name, (kind, features, fields) in held.items():
            write_geojson(geojson_of.get(name, []), Path(d, f"{name}.geojson"))
            z.write(Path(d, f"{name}.geojson"), f"{name}.geojson")
            for ext, raw in shapefile(kind, features, fields).items():
                z.writestr(f"{name}{ext}", raw)
        if write_geopackage(Path(d, "layers.gpkg"), held):
            z.write(Path(d, "layers.gpkg"), "layers.gpkg")


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All layers in one table, columns by name."""
    out = None
    for name, d in layers.items():
        d = d.withColumn("layer", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
