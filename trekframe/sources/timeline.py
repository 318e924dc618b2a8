"""Location-history JSON: elements are split one by one, so broken ones and a cut-off end cost only themselves.

``split_elements`` streams a text and yields the objects of its top container;
``TimelineSource`` is a Python data source over it (S1), one input partition per
file.  ``records`` dispatches shapes and builds visits, movements and points
with column expressions over VARIANT values (S2-S8).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trekframe.functions.geo import without_null_island
from trekframe.functions.hashing import coordinate
from trekframe.functions.text import activity_mode, place_name
from trekframe.functions.timefn import parse_instant

CONTAINERS = ("semanticSegments", "timelineObjects", "rawSignals", "locations")


_MARK = re.compile(r'["\\{}\[\]]')


def split_elements(pieces: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(container, text, status) per array element; status is ok, malformed or truncated.  Holds one element at a time."""
    depth, start, in_string, skip, key = 0, 0, False, False, ""
    name: list[str] = []  # the last string outside elements: a container's key
    element: list[str] | None = None
    for piece in pieces:
        at = free = 0  # what is kept up to, and where an escaped character ends
        if skip:
            skip, free = False, 1
        for m in _MARK.finditer(piece):
            i, ch = m.start(), m[0]
            if i < free:
                continue
            if in_string:
                if ch == "\\":
                    skip, free = i + 1 == len(piece), i + 2
                elif ch == '"':
                    in_string = False
                    if element is None:
                        name.append(piece[at:i])
                continue
            if ch == '"':
                in_string = True
                if element is None:
                    name, at = [], i + 1
            elif ch in "{[":
                if ch == "[" and element is None:
                    key = "".join(name)
                if ch == "{" and element is None and key in CONTAINERS:
                    element, start, at = [], depth, i
                depth += 1
            elif ch in "}]":
                depth -= 1
                if element is not None and depth <= start:
                    element.append(piece[at : i + 1])
                    text = "".join(element)
                    try:
                        json.loads(text)
                        yield key, text, "ok"
                    except ValueError:
                        yield key, text, "malformed"
                    element, depth = None, start
                elif element is None and ch == "]":
                    key = ""
        if element is not None:
            element.append(piece[at:])
        elif in_string:
            name.append(piece[at:])
    if element is not None:
        yield key, "".join(element), "truncated"


class TimelineReader(DataSourceReader):
    """Opens paths that every worker mounts; for others, such as object stores, use ``elements``."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            yield from ((partition.value, *x) for x in split_elements(iter(lambda: f.read(1 << 16), "")))


class TimelineSource(DataSource):
    """spark.dataSource.register(TimelineSource); spark.read.format("timeline").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "timeline"

    def schema(self) -> str:
        return "path string, container string, element string, status string"

    def reader(self, schema) -> DataSourceReader:
        return TimelineReader(self.options)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """S1 by Spark's own reader, for paths that only Spark can open.

    Files are read in fragments that end at each closing brace, so that neither a
    row nor a task holds a whole file; a file's fragments stream through the
    splitter in their order.
    """
    import pyarrow as pa

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        out = []
        for name, own in groupby(rows, key=lambda r: r[0]):
            for found in split_elements(_rejoined(x or "" for _, x in own)):
                out.append((name, *found))
                if len(out) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["path", "container", "element", "status"])
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["path", "container", "element", "status"])

    parts = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    parts = parts.repartition("path").sortWithinPartitions("path", "block", "n").select("path", "value")
    return parts.mapInArrow(kernel, "path string, container string, element string, status string")


def _rejoined(fragments: Iterator[str]) -> Iterator[str]:
    """Fragments with the brace that ended each but the last."""
    before = None
    for x in fragments:
        if before is not None:
            yield before + "}"
        before = x
    if before is not None:
        yield before


def _s(v: str, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def _point_text(prefix: str) -> Column:
    """H1: a point's text under a field, plain or nested."""
    return F.coalesce(_s("v", f"{prefix}.latLng"), _s("v", f"{prefix}.LatLng"), _s("v", prefix))


def _e7(prefix: str, k: str) -> Column:
    return F.try_variant_get("v", f"$.{prefix}.{k}E7", "bigint")


def records(found: DataFrame) -> DataFrame:
    """(kind, path, start_ms, end_ms, name, place_id, mode, confidence, metres, lat, lng, lat2, lng2, points, provenance) of all recognised elements."""
    e = found.where("status = 'ok'").withColumn("v", F.try_parse_json("element"))
    has = lambda path: F.try_variant_get("v", f"$.{path}", "variant").isNotNull()
    raw = F.col("container").isin("rawSignals", "locations")
    shape = F.when(has("visit"), "visit.topCandidate").when(has("activity"), "activity").when(has("placeVisit"), "placeVisit").when(has("activitySegment"), "activitySegment").when(raw, "raw")
    e = e.withColumn("shape", shape).where("shape IS NOT NULL")

    def by_shape(**value: Column) -> Column:
        out = None
        for name, v in value.items():
            test = F.col("shape") == ("visit.topCandidate" if name == "visit" else name)
            out = F.when(test, v) if out is None else out.when(test, v)
        return out

    def legacy(side: str, kind: str) -> Column:
        return F.coalesce(_s("v", f"{kind}.duration.{side}Timestamp"), _s("v", f"{kind}.duration.{side}TimestampMs"))

    def path_of(kind: str) -> Column:
        """The points of a simplified raw path, each with its own time or the record's start."""
        at = lambda x, k: F.try_variant_get(x, f"$.{k}", "string")
        e7 = lambda x, k: F.try_variant_get(x, f"$.{k}E7", "bigint")
        text = lambda x: F.coalesce(at(x, "latLng"), at(x, "LatLng"))
        lat = lambda x: F.coalesce(e7(x, "latitude"), F.try_variant_get(x, "$.latE7", "bigint"))
        lng = lambda x: F.coalesce(e7(x, "longitude"), F.try_variant_get(x, "$.lngE7", "bigint"))
        point = lambda x: F.struct(parse_instant(at(x, "timestamp")).alias("ts_ms"), coordinate(text(x), lat(x), lng(x)).alias("p"))
        found = F.filter(F.transform(F.try_variant_get("v", f"$.{kind}.simplifiedRawPath.points", "array<variant>"), point), lambda x: x["p"].isNotNull())
        return F.coalesce(found, F.array().cast("array<struct<ts_ms:bigint,p:struct<lat:double,lng:double>>>"))

    number = lambda path, default: F.coalesce(F.try_variant_get("v", f"$.{path}", "double"), F.lit(default))
    signal = F.coalesce(_s("v", "timestamp"), _s("v", "timestampMs"))
    # one column after another: each is worked out once
    e = e.withColumns({
        "start": by_shape(visit=_s("v", "startTime"), activity=_s("v", "startTime"), placeVisit=legacy("start", "placeVisit"), activitySegment=legacy("start", "activitySegment"), raw=signal),
        "end": by_shape(visit=_s("v", "endTime"), activity=_s("v", "endTime"), placeVisit=legacy("end", "placeVisit"), activitySegment=legacy("end", "activitySegment"), raw=signal),
        "kind": by_shape(visit=F.lit("VISIT"), activity=F.lit("MOVE"), placeVisit=F.lit("VISIT"), activitySegment=F.lit("MOVE"), raw=F.lit("POINT")),
        "at": by_shape(visit=_point_text("visit.topCandidate.placeLocation"), activity=F.coalesce(_point_text("activity.start"), _point_text("activity.startLocation")), placeVisit=_point_text("placeVisit.location"), activitySegment=_point_text("activitySegment.startLocation"), raw=_point_text("position")),
        "lat_e7": by_shape(visit=_e7("visit.topCandidate.placeLocation", "latitude"), activity=_e7("activity.start", "latitude"), placeVisit=_e7("placeVisit.location", "latitude"), activitySegment=_e7("activitySegment.startLocation", "latitude"), raw=F.try_variant_get("v", "$.latitudeE7", "bigint")),
        "lng_e7": by_shape(visit=_e7("visit.topCandidate.placeLocation", "longitude"), activity=_e7("activity.start", "longitude"), placeVisit=_e7("placeVisit.location", "longitude"), activitySegment=_e7("activitySegment.startLocation", "longitude"), raw=F.try_variant_get("v", "$.longitudeE7", "bigint")),
        "at2": by_shape(activity=F.coalesce(_point_text("activity.end"), _point_text("activity.endLocation")), activitySegment=_point_text("activitySegment.endLocation")),
        "lat2_e7": by_shape(activity=_e7("activity.end", "latitude"), activitySegment=_e7("activitySegment.endLocation", "latitude")),
        "lng2_e7": by_shape(activity=_e7("activity.end", "longitude"), activitySegment=_e7("activitySegment.endLocation", "longitude")),
        "points": by_shape(activity=path_of("activity"), activitySegment=path_of("activitySegment")),
        "raw_name": by_shape(visit=_s("v", "visit.topCandidate.placeName"), placeVisit=_s("v", "placeVisit.location.name")),
        "semantic": by_shape(visit=_s("v", "visit.topCandidate.semanticType")),
        "place_id": by_shape(visit=_s("v", "visit.topCandidate.placeId"), placeVisit=_s("v", "placeVisit.location.placeId")),
        "raw_mode": by_shape(activity=F.coalesce(*(_s("v", f"activity.{k}") for k in ("topCandidate.type", "topCandidate.activityType", "type", "activityType"))), activitySegment=_s("v", "activitySegment.activityType")),
        "confidence": by_shape(visit=number("visit.topCandidate.probability", 0.95), activity=number("activity.topCandidate.probability", 0.85), placeVisit=number("placeVisit.placeConfidence", 0.90), activitySegment=number("activitySegment.confidence", 0.85)),
        "metres": by_shape(activity=F.coalesce(F.try_variant_get("v", "$.activity.distanceMeters", "double"), F.try_variant_get("v", "$.activity.distance", "double")), activitySegment=F.try_variant_get("v", "$.activitySegment.distance", "double")),
    }).drop("v", "element")
    e = e.withColumns({"start_ms": parse_instant("start"), "end_ms": parse_instant("end"), "p": coordinate("at", "lat_e7", "lng_e7"), "q": coordinate("at2", "lat2_e7", "lng2_e7")})
    mode = F.when(F.col("kind") == "MOVE", activity_mode("raw_mode"))
    old = F.col("shape") == "activitySegment"  # its ends are the path's where it names none
    first, last = F.get("points", F.lit(0))["p"], F.try_element_at("points", F.lit(-1))["p"]
    e = e.withColumns({"mode": mode, "p": F.coalesce("p", F.when(old, first)), "q": F.coalesce("q", F.when(old, F.coalesce(last, "p", first)))})
    seen = F.size("points") > 0
    origin = F.when(F.col("kind") == "MOVE", F.when(seen, "SIMPLIFIED_OBSERVED").when(F.col("mode") == "AIRPLANE", "ESTIMATED_GEODESIC").otherwise("ENDPOINT_INTERPOLATED"))
    points = F.transform("points", lambda x: F.struct(F.coalesce(x["ts_ms"], F.col("start_ms")).alias("ts_ms"), x["p"]["lat"].alias("lat"), x["p"]["lng"].alias("lng")))
    e = e.where(~old | F.col("p").isNotNull())
    return e.select("kind", "path", "start_ms", "end_ms", place_name("raw_name", "semantic").alias("name"), "place_id", "mode", "confidence", "metres", "p.lat", "p.lng", F.col("q.lat").alias("lat2"), F.col("q.lng").alias("lng2"), points.alias("points"), origin.alias("provenance"))


def path_points(found: DataFrame) -> DataFrame:
    """Points of timelinePath with time: their own, else the start plus minutes, else the start."""
    e = found.where("status = 'ok'").withColumn("v", F.try_parse_json("element")).withColumn("start", parse_instant(_s("v", "startTime")))
    rows = F.try_variant_get("v", "$.timelinePath", "array<variant>")
    p = e.select("path", "start", F.explode(rows).alias("p"))
    at = F.coalesce(parse_instant(_s("p", "time")), F.col("start") + F.try_variant_get("p", "$.durationMinutesOffsetFromStartTime", "bigint") * 60_000, "start")
    point = coordinate(F.coalesce(_s("p", "point.latLng"), _s("p", "point")))
    return p.select("path", at.alias("ts_ms"), point["lat"].alias("lat"), point["lng"].alias("lng")).where("lat IS NOT NULL")


def import_status(found: DataFrame) -> DataFrame:
    """Per file SUCCESS, PARTIAL_WITH_WARNINGS, FATAL_UNSUPPORTED_FORMAT or nothing where no element was found (FATAL_MALFORMED_INPUT for the caller)."""
    known = records(found).groupBy("path").agg(F.count("*").alias("n"))
    bad = found.groupBy("path").agg(F.count_if(F.col("status") != "ok").alias("bad"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "FATAL_UNSUPPORTED_FORMAT").when(F.col("bad") > 0, "PARTIAL_WITH_WARNINGS").otherwise("SUCCESS")
    return bad.join(known, "path", "left").select("path", status.alias("status"), F.coalesce("n", F.lit(0)).alias("records"), "bad")


def media_catalog(images: DataFrame, videos: DataFrame, start_ms: int, end_ms: int, slack_ms: int = 86_400_000) -> DataFrame:
    """Both collections, by any of four times within the range and a day's slack, by capture time.  Filters reach the scans."""
    a, b = start_ms - slack_ms, end_ms + slack_ms
    hit = F.col("taken").between(a, b) | F.col("taken").between(a // 1000, b // 1000) | F.col("added").between(a // 1000, b // 1000) | F.col("modified").between(a // 1000, b // 1000)
    cols = ["id", "name", "taken", "added", "modified"]
    pick = lambda df, kind: df.where(hit).select(F.lit(kind).alias("kind"), *cols)
    return pick(images, "IMG").unionByName(pick(videos, "VID"))


def newest(images: DataFrame, videos: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n of each collection, for a catalog without usable times."""
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id").orderBy(F.desc("id")).limit(n)
    return pick(images, "IMG").unionByName(pick(videos, "VID"))


def zone_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated zone boxes with # comments; rows without six columns are left out."""
    schema = "zone string, min_lat double, max_lat double, min_lng double, max_lng double, entry string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="DROPMALFORMED").where("entry IS NOT NULL")


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """Outlines of a GeoJSON file: (name, ring, x, y, n) with a ring's points in order; rings of under three points are left out."""
    schema = "features array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rings = f.where("f.geometry.type = 'Polygon'").select(F.col("f.properties.name").alias("name"), F.posexplode("f.geometry.coordinates").alias("ring", "points")).where(F.size("points") >= 3)
    return rings.select("name", "ring", F.posexplode("points").alias("n", "p")).select("name", "ring", "n", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def restore_archive(texts: DataFrame, cap: int = 32 << 20) -> DataFrame:
    """archives(text): what passes the size cap, format and version, and the constraints; ok says whether."""
    schema = "format string, version int, trip struct<id: string, title: string, visits: array<struct<id: string, start_ms: bigint, end_ms: bigint, lat: double, lng: double>>>"
    a = texts.select("text", F.from_json("text", schema).alias("a"))
    fine = F.forall("a.trip.visits", lambda v: (v["end_ms"] >= v["start_ms"]) & without_null_island(v["lat"], v["lng"]).isNotNull() & (F.trim(v["id"]) != ""))
    ok = (F.octet_length("text") <= cap) & (F.col("a.format") == "trip-archive") & (F.col("a.version") == 1) & (F.trim("a.trip.id") != "") & F.coalesce(fine, F.lit(False))
    return a.select("a.trip", F.coalesce(ok, F.lit(False)).alias("ok"))


def feature_lines(rings: DataFrame) -> DataFrame:
    """rings(name, ring, n, x, y) as one GeoJSON feature text per name, rings and points in order."""
    line = rings.groupBy("name", "ring").agg(F.sort_array(F.collect_list(F.struct("n", F.array("x", "y").alias("p")))).alias("pts"))
    whole = line.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("ring", F.transform("pts", lambda q: q["p"]).alias("pts")))).alias("rs"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.transform("rs", lambda r: r["pts"]).alias("coordinates"))
    return whole.select("name", F.to_json(F.struct(F.struct("name").alias("properties"), geometry.alias("geometry"))).alias("value"))
