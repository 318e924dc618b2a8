"""Queries of sources and sinks.  Files are written by the query itself, in the session's shared folder, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.sources import basemap as BM
from trekframe.sources import media as MD
from trekframe.sources import snapshots as SN
from trekframe.sources import store as K
from trekframe.sources import timeline as TL

from .base import query, read


def folder(spark) -> str:
    """A new folder where every executor can read: the shared one, or a temporary one where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/trekframe-{uuid.uuid4().hex}"


def _export(spark, d):
    """Every order as an element of one of six shapes, in files of at most ten thousand orders, written line by line."""
    k = F.col("o_orderkey")
    t, later = (1_700_000_000_000 + k * 1000).cast("string"), (1_700_000_000_000 + k * 1000 + 600_000).cast("string")
    a, e7 = (k % 80 + 1).cast("string"), ((k % 80 + 1) * 10_000_000).cast("string")
    text = lambda form, *values: F.format_string(form, *values)
    shapes = [
        text('{"startTime": "%s", "endTime": "%s", "visit": {"topCandidate": {"placeName": "place %s", "placeId": "p%s", "placeLocation": {"latLng": "%s°, 5°"}}}}', t, later, k.cast("string"), a, a),
        text('{"startTime": "%s", "endTime": "%s", "activity": {"topCandidate": {"type": "IN_TRAIN", "probability": 0.5}, "distanceMeters": 1200, "start": {"latLng": "%s°, 5°"}, "end": {"latLng": "%s°, 6°"}, "simplifiedRawPath": {"points": [{"latE7": %s, "lngE7": 50000000, "timestamp": "%s"}, {"latE7": %s, "lngE7": 55000000}]}}}', t, later, a, a, e7, later, e7),
        text(r'{"placeVisit": {"location": {"latitudeE7": %s, "longitudeE7": 50000000, "name": "old } place \"%s\""}, "duration": {"startTimestampMs": "%s", "endTimestampMs": "%s"}, "placeConfidence": "HIGH_CONFIDENCE"}}', e7, k.cast("string"), t, later),
        text('{"activitySegment": {"duration": {"startTimestampMs": "%s", "endTimestampMs": "%s"}, "activityType": "FLYING", "distance": 900000, "simplifiedRawPath": {"points": [{"latE7": %s, "lngE7": 10000000}, {"latE7": %s, "lngE7": 20000000}]}}}', t, later, e7, e7),
        text('{"startTime": "%s", "endTime": "%s", "timelinePath": [{"point": "%s°, 5°", "durationMinutesOffsetFromStartTime": 5}, {"point": "%s°, 6°", "time": "%s"}, {"point": "nowhere"}]}', t, later, a, a, later),
        text('{"activitySegment": {"duration": {"startTimestampMs": "%s"}, "activityType": "WALKING", "endLocation": {"latitudeE7": %s, "longitudeE7": 50000000}}}', t, e7),
    ]
    element = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        element = F.when(k % 6 == i, shape).otherwise(element)
    rows = read(spark, d, "orders").select(F.floor(k / 10_000).alias("f"), k.alias("n"), element.alias("e"))
    signals = read(spark, d, "orders").where("o_orderkey % 4 = 0").select((F.floor(k / 10_000) + 1_000_000_000).alias("f"), k.alias("n"), text('{"timestampMs": "%s", "latitudeE7": %s, "longitudeE7": 70000000}', t, e7).alias("e"))
    # a window keeps a file's lines in one task; a repartition above a join on the same key may be left out and the join read by mapper, which cuts files
    w = Window.partitionBy("f").orderBy("n")
    lines = rows.unionByName(signals).withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    head = F.when(F.col("before").isNull(), F.concat(F.lit('{"'), F.when(F.col("f") >= 1_000_000_000, "locations").otherwise("semanticSegments"), F.lit('": ['))).otherwise(F.lit(""))
    lines = lines.select("f", "n", F.concat(head, "e", F.when(F.col("after").isNull(), "]}").otherwise(",")).alias("value"))
    out = folder(spark)
    lines.sortWithinPartitions("f", "n").select("f", "value").write.partitionBy("f").text(out)
    return TL.elements(spark, out)


@query("s1_s8_timeline_json", """WITH o AS (SELECT o_orderkey AS k, 1700000000000 + o_orderkey * 1000 AS t, (o_orderkey % 80 + 1)::DOUBLE AS a FROM orders)
  SELECT 'VISIT' AS kind, t AS start_ms, t + 600000 AS end_ms, 'place ' || k AS name, 'p' || (k % 80 + 1) AS place_id, NULL AS mode, 0.95::DOUBLE AS confidence, NULL::DOUBLE AS metres, a AS lat, 5::DOUBLE AS lng, NULL::DOUBLE AS lng2, NULL::INT AS n_points, NULL AS provenance FROM o WHERE k % 6 = 0
  UNION ALL SELECT 'MOVE', t, t + 600000, NULL, NULL, 'TRAIN', 0.5, 1200, a, 5, 6, 2, 'SIMPLIFIED_OBSERVED' FROM o WHERE k % 6 = 1
  UNION ALL SELECT 'VISIT', t, t + 600000, 'old } place "' || k || '"', NULL, NULL, 0.9, NULL, a, 5, NULL, NULL, NULL FROM o WHERE k % 6 = 2
  UNION ALL SELECT 'MOVE', t, t + 600000, NULL, NULL, 'AIRPLANE', 0.85, 900000, a, 1, 2, 2, 'SIMPLIFIED_OBSERVED' FROM o WHERE k % 6 = 3
  UNION ALL SELECT 'POINT', t, t, NULL, NULL, NULL, NULL, NULL, a, 7, NULL, NULL, NULL FROM o WHERE k % 4 = 0""")
def s1(spark, d):
    """Visits, activities, old visits, old segments whose ends come from their path, and raw signals; segments without a start are left out."""
    r = TL.records(_export(spark, d))
    return r.select("kind", "start_ms", "end_ms", "name", "place_id", "mode", "confidence", "metres", "lat", "lng", "lng2", F.when(F.col("kind") == "MOVE", F.size("points")).alias("n_points"), "provenance")


@query("s4_path_points", """WITH o AS (SELECT 1700000000000 + o_orderkey * 1000 AS t, (o_orderkey % 80 + 1)::DOUBLE AS a FROM orders WHERE o_orderkey % 6 = 4)
  SELECT t + 300000 AS ts_ms, a AS lat, 5::DOUBLE AS lng FROM o UNION ALL SELECT t + 600000, a, 6 FROM o""")
def s4(spark, d):
    return TL.path_points(_export(spark, d)).select("ts_ms", "lat", "lng")


_TAKEN = "m AS (SELECT event_id AS id, event_id % 2 AS kind, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000 END AS taken, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 END AS added FROM events)"


@query("s9_media_catalog", f"WITH {_TAKEN} SELECT CASE kind WHEN 0 THEN 'IMG' ELSE 'VID' END AS kind, id FROM m WHERE taken BETWEEN 1704499200000 - 86400000 AND 1704585600000 + 86400000 OR taken BETWEEN 1704499200 - 86400 AND 1704585600 + 86400 OR added BETWEEN 1704499200 - 86400 AND 1704585600 + 86400")
def s9(spark, d):
    from trekframe.functions.timefn import millis

    k, ms = F.col("event_id"), millis("ts")
    s = F.floor(ms / 1000)
    m = read(spark, d, "events").select(k.alias("id"), F.lit("x").alias("name"), F.when(k % 4 == 1, s).when(k % 4 > 0, ms).alias("taken"), F.when(k % 3 == 0, s).alias("added"), F.lit(None).cast("bigint").alias("modified"))
    return TL.media_catalog(m.where("id % 2 = 0"), m.where("id % 2 = 1"), 1_704_499_200_000, 1_704_585_600_000).select("kind", "id")


@query("s10_newest_media", "(SELECT 'IMG' AS kind, event_id AS id FROM events WHERE event_id % 2 = 0 ORDER BY id DESC LIMIT 1000) UNION ALL (SELECT 'VID', event_id FROM events WHERE event_id % 2 = 1 ORDER BY event_id DESC LIMIT 1000)")
def s10(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"))
    return TL.newest(e.where("id % 2 = 0"), e.where("id % 2 = 1"))


@query("s14_zone_boxes", "SELECT n_name AS zone, n_nationkey::DOUBLE AS min_lat, 'e' || n_nationkey AS entry FROM nation")
def s14(spark, d):
    out = folder(spark)
    k = F.col("n_nationkey")
    line = F.concat_ws("\t", "n_name", k.cast("double").cast("string"), (k + 1.0).cast("string"), k.cast("double").cast("string"), (k + 2.0).cast("string"), F.concat(F.lit("e"), k.cast("string")))
    rows = read(spark, d, "nation").select(line.alias("value"))
    rows.union(spark.createDataFrame([("# a comment",), ("short\t1.0",)], "value string")).write.text(out)
    return TL.zone_boxes(spark, out).select("zone", "min_lat", "entry")


@query("s15_keyed_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey")
def s15(spark, d):
    return read(spark, d, "orders").where("o_custkey = 7").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("s17_k7_archive_round_trip", "SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(count(*) AS INT) AS visits, o_custkey % 10 <> 3 AND o_custkey % 10 <> 7 AS ok FROM orders GROUP BY o_custkey")
def s17(spark, d):
    """Trips of two kinds break a constraint: a stay that ends before it starts, or one at the null island."""
    bad = F.col("o_custkey") % 10
    v = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(1).cast("bigint").alias("start_ms"), F.when(bad == 3, 0).otherwise(2).cast("bigint").alias("end_ms"), F.when(bad == 7, 0.0).otherwise(1.0).alias("lat"), F.when(bad == 7, 0.0).otherwise(2.0).alias("lng"))
    t = read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.lit("t").alias("title"), F.collect_list(v).alias("visits"))
    return TL.restore_archive(K.export_archive(t).where("fits")).select("trip.id", F.size("trip.visits").alias("visits"), "ok")


@query("k1_k6_store", "SELECT o_custkey % 20 AS trip_id, o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'renamed' ELSE o_orderstatus END AS name FROM orders WHERE o_custkey % 20 <> 3 AND o_orderkey % 11 <> 0")
def k1(spark, d):
    """Replace, upsert, update, delete, delete a trip and drop orphans, then read."""
    s = K.Store(spark, folder(spark))
    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("trip_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    s.replace_trips("visits", o.unionByName(o.limit(0)), ["id"])
    s.upsert("visits", o.where("id % 7 = 0").withColumn("name", F.lit("x")), ["id"])
    s.update("visits", F.col("id") % 7 == 0, {"name": F.lit("renamed")})
    s.delete("visits", F.col("id") % 11 == 0)
    s.drop_trips(["visits"], [3])
    s.replace_trips("parents", o.where("trip_id <> 3"))
    s.drop_orphans("visits", "parents", "id")
    return s.read("visits").select(F.col("trip_id").cast("bigint"), "id", "name")


@query("k4_dual_write", """WITH o AS (SELECT o_custkey % 20 AS trip_id, o_orderkey AS id, o_orderstatus AS name FROM orders), r AS (SELECT *, 'named ' || id AS value FROM o WHERE id % 7 = 0)
  SELECT trip_id, CAST(o.id AS VARCHAR) AS id, coalesce(r.value, name) AS name FROM o LEFT JOIN r USING (trip_id, id, name) UNION ALL SELECT trip_id, 'VISIT_NAME:' || id, value FROM r""")
def k4(spark, d):
    """Names set by a user, in the entity's table and, for good, in that of overrides."""
    s = K.Store(spark, folder(spark))
    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("trip_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    r = o.where("id % 7 = 0").select("trip_id", "id", F.concat(F.lit("named "), F.col("id")).alias("value"))
    s.replace_trips("visits", o)
    old = r.select("trip_id", F.concat(F.lit("VISIT_NAME:"), F.col("id")).alias("id"), F.lit("VISIT_NAME").alias("target_type"), F.col("id").cast("string").alias("target_id"), F.lit("old").alias("value"))
    s.replace_trips("overrides", old.where("CAST(target_id AS BIGINT) % 2 = 0"))
    s.override("visits", "overrides", "VISIT_NAME", "id", "name", r)
    both = s.read("visits").select("trip_id", F.col("id").cast("string").alias("id"), "name")
    return both.unionByName(s.read("overrides").select("trip_id", "id", F.col("value").alias("name"))).withColumn("trip_id", F.col("trip_id").cast("bigint"))


@query("k11_migration", "SELECT o_orderkey AS id, false AS is_override, NULL::VARCHAR AS zone FROM orders")
def k11(spark, d):
    """An old table with rows twice: of rows with one key the first stays."""
    old = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return K.migrated(old.unionByName(old.where("id % 3 = 0")), 1, key=["id"]).select("id", "is_override", "zone")


@query("a15_incremental_preparation", "SELECT doc_id AS id, n_chars * 2 AS v FROM documents")
def a15(spark, d):
    items = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.sha2(F.col("n_chars").cast("string"), 256).alias("print"))
    work = lambda todo: todo.select("id", "print", (F.col("n_chars") * 2).alias("v"))
    cached = work(items.where("id % 3 > 0")).withColumn("print", F.when(F.col("id") % 5 > 0, F.col("print")).otherwise("stale"))
    return K.prepared(items, cached, work).select("id", "v")


@query("s12_s16_k12_rings", "SELECT n_name AS name, 0 AS ring, CAST(k AS INT) AS n, CASE WHEN k IN (1, 2) THEN n_nationkey + 1 ELSE n_nationkey END::DOUBLE AS x, CASE WHEN k >= 2 THEN 1 ELSE 0 END::DOUBLE AS y FROM nation, range(4) t(k)")
def s12(spark, d):
    """Outlines written as one GeoJSON document and read back."""
    k, n = F.col("n_nationkey").cast("double"), F.col("n")
    rings = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(0).alias("ring"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    rings = rings.select("name", "ring", "n", F.when(n.isin(1, 2), k + 1).otherwise(k).alias("x"), F.when(n >= 2, 1.0).otherwise(0.0).alias("y"))
    out = folder(spark)
    document = TL.feature_lines(rings).agg(F.array_join(F.sort_array(F.collect_list("value")), ",\n").alias("all"))  # a map's outlines: one document by its format
    document.select(F.concat(F.lit('{"features": ['), "all", F.lit("]}")).alias("value")).write.text(out)
    return TL.geojson_rings(spark, out).select("name", "ring", "n", "x", "y")


@query("f16_plausible_speed", "SELECT l_orderkey, l_linenumber, l_quantity * 30 > 1150 AS impossible, l_quantity * 30 BETWEEN 360 AND 1150 AS flight FROM lineitem")
def f16(spark, d):
    v = F.col("l_quantity") * 30
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (v > 1150).alias("impossible"), v.between(360, 1150).alias("flight"))


@query("f2_k5_contained_after_delete", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def f2(spark, d):
    o = read(spark, d, "orders")
    return o.where((F.col("o_orderstatus") != "F") & F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))).select("o_orderkey")


@query("s16_geojson_features", """WITH k AS (SELECT n_nationkey::DOUBLE AS k, n_name AS name FROM nation)
  SELECT 'polygon' AS kind, name, 'land' AS type, 0 AS part, 4 AS n, round(k + 0.12347, 4) AS x, k AS y, NULL::INT AS rank FROM k UNION ALL SELECT 'polygon', 'Land', 'land', p, 3, k + p, k, NULL FROM k, range(2) r(p)
  UNION ALL SELECT 'line', 'road', 'ROAD', 0, 3, k, k, NULL FROM k UNION ALL SELECT 'line', 'E' || CAST(k AS INT), 'ROAD', p, 2, k + p, k, NULL FROM k, range(2) r(p)
  UNION ALL SELECT 'place', name, NULL, NULL, NULL, k, k, CAST(CASE WHEN k % 2 = 0 THEN k ELSE 5 END AS INT) FROM k""")
def s16(spark, d):
    """One document a nation with outlines, lines and places of every kind; short rings, short lines and places without a name go."""
    k = F.col("n_nationkey").cast("double")
    n = lambda x: F.round(x, 6).cast("string")
    point = lambda x, y: F.concat(F.lit("["), n(x), F.lit(","), n(y), F.lit("]"))
    many = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    feature = lambda props, kind, coordinates: F.concat(F.lit('{"properties": '), props, F.lit(f', "geometry": {{"type": "{kind}", "coordinates": '), coordinates, F.lit("}}"))
    square = many(point(k + 0.12347, k), point(k + 1, k), point(k + 1, k + 1), point(k, k + 1))
    triangle = lambda i: many(point(k + i, k), point(k + i + 1, k), point(k + i, k + 1))
    named = F.concat(F.lit('{"name": "'), "n_name", F.when(k % 2 == 0, F.concat(F.lit('", "scalerank": '), k.cast("int").cast("string"), F.lit("}"))).otherwise('"}'))
    document = many(
        feature(named, "Polygon", many(square, many(point(k, k), point(k, k)))), feature(F.lit("{}"), "MultiPolygon", many(many(triangle(0)), many(triangle(1)))), feature(F.lit('{"name": "", "featurecla": "road"}'), "LineString", many(point(k, k), point(k + 1, k), point(k + 1, k + 1))),
        feature(F.concat(F.lit('{"name_en": "E'), k.cast("int").cast("string"), F.lit('"}')), "MultiLineString", many(many(point(k, k), point(k, k + 1)), many(point(k + 1, k), point(k, k + 1)), many(point(k, k)))), feature(named, "Point", point(k, k)), feature(F.lit("{}"), "Point", point(k, k)),
        F.lit('{"properties": {"name": "nowhere"}, "geometry": null}'),
    )
    out = folder(spark)
    read(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"features": '), document, F.lit("}")).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(out)
    none = lambda t: F.lit(None).cast(t)
    p = BM.geojson_polygons(spark, out, "land").select(F.lit("polygon").alias("kind"), "name", "type", F.col("polygon").alias("part"), F.get("rings", F.lit(0)).alias("points"))
    lines = BM.geojson_lines(spark, out, "ROAD").select(F.lit("line").alias("kind"), "name", "type", F.col("line").alias("part"), "points")
    both = p.unionByName(lines).select("kind", "name", "type", "part", F.size("points").alias("n"), F.get("points", F.lit(0))["x"].alias("x"), F.get("points", F.lit(0))["y"].alias("y"), none("int").alias("rank"))
    places = BM.geojson_places(spark, out).where("name <> ''").select(F.lit("place").alias("kind"), "name", none("string").alias("type"), none("int").alias("part"), none("int").alias("n"), F.col("lng").alias("x"), F.col("lat").alias("y"), "rank")
    return both.unionByName(places)


_MERC = "round(CAST(CAST(0.5 - ln(tan(radians({y}) / 2 + pi() / 4)) / (2 * pi()) AS FLOAT) AS DOUBLE), 5)"


@query("s13_k12_packed_maps", f"""WITH k AS (SELECT n_regionkey AS r, n_nationkey AS f, n_name AS name, n_nationkey::DOUBLE AS k FROM nation), f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY f) - 1 AS i FROM k),
  q AS (SELECT r AS map, 0 AS section, 'polygon' AS kind, i, name, CASE WHEN f % 2 = 0 THEN 'lake' ELSE 'land' END AS type, 0 AS ring, n, k + n % 2 AS lng, k + n // 2 AS lat, NULL::INT AS rank FROM f, range(3) t(n)
    UNION ALL SELECT r, 1, 'line', i, name, 'ROAD', 0, n, k + n, k, NULL FROM f, range(2) t(n) UNION ALL SELECT r, 1, 'place', i, name, NULL, NULL, 0, k, k, CAST(f % 4 AS INT) FROM f)
  SELECT CAST(map AS VARCHAR) AS map, section, kind, CAST(i AS INT) AS feature, name, type, CAST(ring AS INT) AS ring, CAST(n AS INT) AS n, round(CAST(CAST((lng + 180) / 360 AS FLOAT) AS DOUBLE), 5) AS x, {_MERC.format(y='lat')} AS y, rank FROM q""")
def s13(spark, d):
    """A packed map for each region, written and read again."""
    k, n = F.col("n_nationkey"), F.col("n")
    rows = read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("map"), "n_nationkey", F.col("n_name").alias("name"))
    shape = lambda section, kind, kind_of, size, lng, lat, rank: rows.select("map", F.lit(section).alias("section"), F.lit(kind).alias("kind"), k.cast("int").alias("feature"), "name", kind_of.alias("type"), F.lit(0).alias("ring"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("n")).select("map", "section", "kind", "feature", "name", "type", "ring", "n", lng.cast("double").alias("lng"), lat.cast("double").alias("lat"), rank.cast("int").alias("rank"))
    all_ = shape(0, "polygon", F.when(k % 2 == 0, "lake").otherwise("land"), 3, k + n % 2, k + F.floor(n / 2), F.lit(None)).unionByName(shape(1, "line", F.lit("ROAD"), 2, k + n, k, F.lit(None))).unionByName(shape(1, "place", F.lit(None).cast("string"), 1, k, k, k % 4))
    files = BM.packed_maps(all_).select(F.col("map").alias("path"), "content")
    return BM.packed_features(files).select(F.col("path").alias("map"), "section", "kind", "feature", "name", "type", "ring", "n", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "rank")


@query("s11_media_metadata", """WITH p AS (SELECT p_partkey AS k FROM part) SELECT CAST(k AS VARCHAR) AS path, CASE WHEN k % 4 < 3 THEN '2026:07:01 10:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':00' END AS taken, CASE WHEN k % 4 = 0 THEN '+02:00' END AS "offset",
  CASE k % 4 WHEN 0 THEN k % 80 + 0.5 WHEN 1 THEN -(k % 80 + 0.5) WHEN 3 THEN k % 80 + 0.25 END::DOUBLE AS lat, CASE k % 4 WHEN 0 THEN 10.25 WHEN 1 THEN -10.25 WHEN 3 THEN -20.5 END::DOUBLE AS lng, CASE k % 4 WHEN 0 THEN 12 WHEN 1 THEN -12 WHEN 3 THEN 7 END::DOUBLE AS alt FROM p""")
def s11(spark, d):
    """A file for each part: photos of both byte orders with and without position, and videos."""
    k = F.col("p_partkey")
    be = lambda n, x: F.unhex(F.lpad(F.hex(F.lit(x) if isinstance(x, int) else x), 2 * n, "0"))
    le = lambda n, x: F.unhex(F.concat(*(F.substring(F.hex(be(n, x)), 2 * i + 1, 2) for i in reversed(range(n)))))
    text = lambda x: F.encode(x if not isinstance(x, str) else F.lit(x), "ISO-8859-1")
    time = F.concat(F.lit("2026:07:01 10:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":00"))

    def tiff(i, mark, south, west, below, offset):
        """Main directory at 8, Exif directory at 50, GPS directory at 80, values from 160 on."""
        entry = lambda tag, kind, n, value: F.concat(i(2, tag), i(2, kind), i(4, n), value)
        short = lambda x: F.concat(text(x), F.unhex(F.lit("00" * (4 - len(x)))))
        main = F.concat(i(2, 2), entry(0x8769, 4, 1, i(4, 50)), entry(0x8825, 4, 1, i(4, 80)), i(4, 0), F.unhex(F.lit("00" * 12)))
        own = F.concat(i(2, 2), entry(0x9003, 2, 20, i(4, 160)), entry(0x9011, 2, 7, i(4, 180)) if offset else entry(0x0100, 3, 1, i(4, 0)), i(4, 0))
        gps = F.concat(i(2, 6), entry(1, 2, 2, short("S" if south else "N")), entry(2, 5, 3, i(4, 188)), entry(3, 2, 2, short("W" if west else "E")), entry(4, 5, 3, i(4, 212)), entry(5, 1, 1, F.unhex(F.lit("01000000" if below else "00000000"))), entry(6, 5, 1, i(4, 236)), i(4, 0), F.unhex(F.lit("00" * 2)))
        values = F.concat(text(time), F.unhex(F.lit("00")), text("+02:00"), F.unhex(F.lit("0000")), i(4, k % 80), i(4, 1), i(4, 30), i(4, 1), i(4, 0), i(4, 1), i(4, 10), i(4, 1), i(4, 15), i(4, 1), i(4, 0), i(4, 1), i(4, 24), i(4, 2))
        return F.concat(text(mark), i(2, 42), i(4, 8), main, own, gps, values)

    def jpeg(body):
        return F.concat(F.unhex(F.lit("FFD8FFE00004AAAA")), F.unhex(F.lit("FFE1")), be(2, F.octet_length(body) + 8), text("Exif"), F.unhex(F.lit("0000")), body, F.unhex(F.lit("FFDA0000")))

    old = F.concat(text("MM"), be(2, 42), be(4, 8), be(2, 1), be(2, 0x0132), be(2, 2), be(4, 20), be(4, 26), be(4, 0), text(time), F.unhex(F.lit("00")))
    spot = F.concat(F.lit("+"), F.lpad((k % 80).cast("string"), 2, "0"), F.lit(".25-020.50+7.0/"))
    box = lambda kind, body: F.concat(be(4, F.octet_length(body) + 8), kind, body)
    movie = F.concat(box(text("ftyp"), text("isom0000")), box(text("moov"), F.concat(box(text("mvhd"), text("....")), box(text("udta"), box(F.unhex(F.lit("A978797A")), F.concat(be(2, F.octet_length(text(spot))), be(2, 0), text(spot)))))))
    content = F.when(k % 4 == 0, jpeg(tiff(be, "MM", False, False, False, True))).when(k % 4 == 1, jpeg(tiff(le, "II", True, True, True, False))).when(k % 4 == 2, jpeg(old)).otherwise(movie)
    return MD.metadata(read(spark, d, "part").select(k.cast("string").alias("path"), content.alias("content")))


def _trip_tables(spark, d):
    """Trips, stays, movements and photos of customers, from orders and line items."""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("trip_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    li = read(spark, d, "lineitem").join(o.select("trip_id", F.col("id").alias("l_orderkey")), "l_orderkey")
    item = li.select("trip_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("name"), "l_linenumber")
    trips = o.groupBy("trip_id").agg(F.min("id").alias("id"), F.lit("trip").alias("name"))
    return {"trips": trips, "visits": o, "segments": item.where("l_linenumber % 2 = 0").drop("l_linenumber"), "media": item.where("l_linenumber % 2 = 1").drop("l_linenumber")}


@query("s18_versioned_snapshot", """WITH o AS (SELECT o_custkey % 50 AS trip_id, o_orderkey AS id FROM orders), i AS (SELECT trip_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS even FROM lineitem JOIN o ON id = l_orderkey),
  t AS (SELECT 'visits' AS tbl, trip_id, id FROM o UNION ALL SELECT CASE WHEN even THEN 'segments' ELSE 'media' END, trip_id, id FROM i UNION ALL SELECT 'trips', trip_id, min(id) FROM o GROUP BY trip_id),
  v AS (SELECT 1 AS version, * FROM t UNION ALL SELECT 2, * FROM t WHERE trip_id % 5 <> 0 UNION ALL SELECT 2, tbl, trip_id, id FROM t WHERE trip_id % 5 = 0 AND tbl <> 'media' AND id % 3 = 0)
  SELECT version, tbl, trip_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v GROUP BY version, tbl, trip_id""")
def s18(spark, d):
    """Four tables replaced in one commit, for a fifth of the trips: both versions are read, a writer that comes too late fails, the memo is used."""
    s = SN.Snapshots(spark, folder(spark))
    every = _trip_tables(spark, d)
    s.commit(every, keys={"visits": "first"})
    some = {n: df.where("trip_id % 5 = 0 AND id % 3 = 0" if n != "media" else "false") for n, df in every.items()}
    s.commit(some, every["trips"].where("trip_id % 5 = 0"), {"visits": "second"})
    rows = [s.memo(n, "second", lambda: every["visits"]).select("trip_id", "id").withColumns({"tbl": F.lit(n), "version": F.lit(2)}) if n == "visits" else s.read(n, 2).select("trip_id", "id").withColumns({"tbl": F.lit(n), "version": F.lit(2)}) for n in every]
    rows += [s.read(n, 1).select("trip_id", "id").withColumns({"tbl": F.lit(n), "version": F.lit(1)}) for n in every]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out.groupBy("version", "tbl", "trip_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
