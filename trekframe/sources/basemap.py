"""Basemap features: GeoJSON outlines, lines and places, and the packed map file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.functions.geo import mercator

#: The packed file's magic word and version.
MAGIC, VERSION = b"MAP3", 1
PACKED = "path string, section int, kind string, feature int, name string, type string, ring int, n int, x double, y double, rank int"


def _features(spark: SparkSession, path: str) -> DataFrame:
    """(name, scalerank, type, coordinates: JSON text) of the features of GeoJSON files."""
    schema = "features array<struct<properties: struct<name: string, name_en: string, nameascii: string, featurecla: string, scalerank: int>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry IS NOT NULL")
    return f.select("f.properties.*", "f.geometry.type", "f.geometry.coordinates")


def geojson_polygons(spark: SparkSession, path: str, kind: str, precision: int = 4, eps: float = 0.0) -> DataFrame:
    """(name, type, polygon, rings: array of rings of array<struct<x, y>>) of Polygon and MultiPolygon features; rings of under three points are left out."""
    name = F.coalesce("name", "name_en", "featurecla", F.initcap(F.lit(kind)))
    one = F.array(F.from_json("coordinates", "array<array<array<double>>>"))
    parts = F.when(F.col("type") == "Polygon", one).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rows = _features(spark, path).where(F.col("type").isin("Polygon", "MultiPolygon")).select(name.alias("name"), F.posexplode(parts).alias("polygon", "rings"))
    rings = F.filter(F.transform("rings", lambda r: _line(r, precision, eps)), lambda r: F.size(r) >= 3)
    return rows.select("name", F.lit(kind).alias("type"), "polygon", rings.alias("rings")).where(F.size("rings") > 0)


def geojson_lines(spark: SparkSession, path: str, kind: str, precision: int = 4, eps: float = 0.0) -> DataFrame:
    """(name, type, line, points) of LineString and MultiLineString features of at least two points."""
    name = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("name", "name_en", "featurecla")), F.lit(kind))
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    parts = F.when(F.col("type") == "LineString", one).when(F.col("type") == "MultiLineString", F.from_json("coordinates", "array<array<array<double>>>"))
    rows = _features(spark, path).where(F.col("type").isin("LineString", "MultiLineString")).select(name.alias("name"), F.posexplode(parts).alias("line", "points"))
    return rows.select("name", F.lit(kind).alias("type"), "line", _line(F.col("points"), precision, eps).alias("points")).where(F.size("points") >= 2)


def geojson_places(spark: SparkSession, path: str, precision: int = 4) -> DataFrame:
    """(name, lat, lng, rank) of features with a name and a position; rank 5 where none is given."""
    name = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("name", "name_en", "nameascii")))
    at = F.from_json("coordinates", "array<double>")
    rows = _features(spark, path).select(name.alias("name"), at.alias("at"), F.coalesce("scalerank", F.lit(5)).alias("rank")).where("name IS NOT NULL AND size(at) >= 2")
    return rows.select("name", F.round(F.col("at")[1], precision).alias("lat"), F.round(F.col("at")[0], precision).alias("lng"), "rank")


def _line(points, precision: int, eps: float):
    """Points as structs, rounded; without those nearer than eps to the line of their neighbours."""
    p = F.transform(points, lambda q: F.struct(F.round(q[0], precision).alias("x"), F.round(q[1], precision).alias("y")))
    if not eps:
        return p

    def off(q, a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = F.sqrt(dx * dx + dy * dy)
        return F.when(long > 0, F.abs(dy * (q["x"] - a["x"]) - dx * (q["y"] - a["y"])) / long).otherwise(F.sqrt((q["x"] - a["x"]) ** 2 + (q["y"] - a["y"]) ** 2))

    return F.filter(p, lambda q, i: (i == 0) | (i == F.size(p) - 1) | (off(q, F.get(p, i - 1), F.get(p, i + 1)) > eps))


# --- the packed file: two sections of polygons, lines and places, in Mercator coordinates, big-endian ---


def _points(xy: np.ndarray) -> bytes:
    """Bounds (least and greatest x, then y), the number of values, and the values as 32-bit floats; a step over the map's edge goes on beyond it."""
    step = np.diff(xy[:, 0], prepend=xy[:1, 0])
    xy = np.stack([xy[0, 0] + np.cumsum(step - np.round(step)), xy[:, 1]], axis=1)
    low, high = xy.min(axis=0), xy.max(axis=0)
    return struct.pack(">4fi", low[0], high[0], low[1], high[1], xy.size) + xy.astype(">f4").tobytes()


def _text(value: str | None) -> bytes:
    data = (value or "").encode()
    return struct.pack(">i", len(data)) + data


def packed_section(polygons: list[dict], lines: list[dict], places: list[dict]) -> bytes:
    """One section; each ring and line is a list of projected (x, y)."""
    out = [struct.pack(">i", len(polygons))]
    for p in polygons:
        out += [_text(p["name"]), bytes([p["type"] == "lake"]), struct.pack(">i", len(p["rings"])), *(_points(np.array(r, float)) for r in p["rings"])]
    out.append(struct.pack(">i", len(lines)))
    for p in lines:
        out += [_text(p["name"]), _text(p["type"]), _points(np.array(p["points"], float))]
    out.append(struct.pack(">i", len(places)))
    for p in places:
        out += [_text(p["name"]), struct.pack(">2fi", p["x"], p["y"], p["rank"])]
    return b"".join(out)


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        got = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return got

    def text(self) -> str:
        (n,) = self.take(">i")
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def points(self) -> list[tuple[float, float]]:
        (*_, n) = self.take(">4fi")
        v = self.take(f">{n}f")
        return list(zip(v[::2], v[1::2]))


def unpacked(data: bytes) -> Iterator[tuple]:
    """(section, kind, feature, name, type, ring, n, x, y, rank) of a packed file, point by point."""
    if data[:4] != MAGIC or struct.unpack(">i", data[4:8])[0] != VERSION:
        raise ValueError("not a version 1 map file")
    c = _Cursor(data)
    c.at = 8
    for section in range(2):
        for i in range(c.take(">i")[0]):
            name, lake = c.text(), c.take(">B")[0]
            for ring in range(c.take(">i")[0]):
                yield from ((section, "polygon", i, name, "lake" if lake else "land", ring, k, x, y, None) for k, (x, y) in enumerate(c.points()))
        for i in range(c.take(">i")[0]):
            name, kind = c.text(), c.text()
            yield from ((section, "line", i, name, kind, 0, k, x, y, None) for k, (x, y) in enumerate(c.points()))
        for i in range(c.take(">i")[0]):
            name = c.text()
            x, y, rank = c.take(">2fi")
            yield section, "place", i, name, None, None, 0, x, y, rank


def packed_features(files: DataFrame) -> DataFrame:
    """S13 over files(path, content)."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKED.split(", ")]
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for row in unpacked(data):
                    out.append((path, *row))
                    if len(out) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, PACKED)


def packed_maps(features: DataFrame) -> DataFrame:
    """(map, content) of features(map, section, kind, feature, name, type, ring, n, lat, lng, rank): one packed file a map, which its reader holds whole."""
    at = mercator("lat", "lng")
    rows = features.withColumn("p", at).select("map", "section", "kind", "feature", F.coalesce("ring", F.lit(0)).alias("ring"), "n", "name", "type", "rank", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    line = rows.groupBy("map", "section", "kind", "feature", "ring").agg(F.first("name").alias("name"), F.first("type").alias("type"), F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("n", "x", "y"))).alias("pts"))
    whole = line.groupBy("map").agg(F.sort_array(F.collect_list(F.struct("section", "kind", "feature", "ring", "name", "type", "rank", "pts"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                content = MAGIC + struct.pack(">i", VERSION)
                for section in range(2):
                    found: dict[str, dict[int, dict]] = {"polygon": {}, "line": {}, "place": {}}
                    for r in parts:
                        if r["section"] == section:
                            f = found[r["kind"]].setdefault(r["feature"], {"name": r["name"], "type": r["type"], "rings": [], "rank": r["rank"]})
                            f["rings"].append([(q["x"], q["y"]) for q in r["pts"]])
                    lines = [f | {"points": f["rings"][0]} for f in found["line"].values()]
                    places = [f | {"x": f["rings"][0][0][0], "y": f["rings"][0][0][1]} for f in found["place"].values()]
                    content += packed_section(list(found["polygon"].values()), lines, places)
                out.append(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["map", "content"])

    return whole.mapInArrow(run, f"map {features.schema['map'].dataType.simpleString()}, content binary")
