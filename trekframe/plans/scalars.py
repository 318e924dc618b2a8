"""Queries of the scalar functions: predicates, geometry, text, time and hashing."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import geo, hashing, text, timefn
from trekframe.operators.classify import transport

from .base import PINGS, STAYS, hav, pings, query, read, stays

_NEXT = f"WITH {PINGS}, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM pings WINDOW w AS (PARTITION BY trip ORDER BY ts_ms, id))"


def _next(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("trip").orderBy("ts_ms", "id")
    return pings(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)}).where("lat2 IS NOT NULL")


@query("m1_haversine", f"{_NEXT} SELECT id, round({hav('lat', 'lng', 'lat2', 'lng2')}, 3) AS metres FROM n WHERE lat2 IS NOT NULL")
def m1(spark, d):
    return _next(spark, d).select("id", F.round(geo.haversine("lat", "lng", "lat2", "lng2"), 3).alias("metres"))


_BEAR = "atan2(sin(radians(lng2 - lng)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lng2 - lng)))"


@query("m2_bearing", f"{_NEXT} SELECT id, round(fmod(degrees({_BEAR}) + 360.0, 360.0), 6) AS degrees FROM n WHERE lat2 IS NOT NULL")
def m2(spark, d):
    return _next(spark, d).select("id", F.round(geo.bearing("lat", "lng", "lat2", "lng2"), 6).alias("degrees"))


@query("m3_m8_slerp", f"""{_NEXT}, q AS (SELECT *, {hav('lat', 'lng', 'lat2', 'lng2')} / 6371000.0 AS dd FROM n WHERE lat2 IS NOT NULL),
  s AS (SELECT id, lat, lng, dd, sin(0.75 * dd) / sin(dd) AS a, sin(0.25 * dd) / sin(dd) AS b, radians(lat) AS p1, radians(lng) AS l1, radians(lat2) AS p2, radians(lng2) AS l2 FROM q WHERE dd >= 1e-9),
  v AS (SELECT id, a * cos(p1) * cos(l1) + b * cos(p2) * cos(l2) AS x, a * cos(p1) * sin(l1) + b * cos(p2) * sin(l2) AS y, a * sin(p1) + b * sin(p2) AS z FROM s)
  SELECT id, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lng FROM v
  UNION ALL SELECT id, round(lat, 6), round(lng, 6) FROM q WHERE dd < 1e-9""")
def m3(spark, d):
    path = geo.great_circle_path("lat", "lng", "lat2", "lng2", F.lit(4))
    return _next(spark, d).select("id", path[1].alias("p")).select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


_LOCAL = """cos(radians((lat + lat2) / 2)) AS k, radians(lng2 - lng) AS dx, radians(lat2 - lat) AS dy, radians(-73.99 - lng) AS px, radians(40.5 - lat) AS py"""


@query("m4_point_to_segment", f"""{_NEXT}, q AS (SELECT id, {_LOCAL} FROM n WHERE lat2 IS NOT NULL),
  r AS (SELECT id, dx * k * 6371000.0 AS x2, dy * 6371000.0 AS y2, px * k * 6371000.0 AS x, py * 6371000.0 AS y FROM q),
  t AS (SELECT *, CASE WHEN x2 * x2 + y2 * y2 > 0 THEN least(1.0, greatest(0.0, (x * x2 + y * y2) / (x2 * x2 + y2 * y2))) ELSE 0 END AS t FROM r)
  SELECT id, round(sqrt(pow(x - t * x2, 2) + pow(y - t * y2, 2)), 2) AS metres FROM t""")
def m4(spark, d):
    return _next(spark, d).select("id", F.round(geo.point_to_segment(F.lit(40.5), F.lit(-73.99), "lat", "lng", "lat2", "lng2"), 2).alias("metres"))


@query("m5_m14_line_distance", f"""WITH {STAYS}, q AS (SELECT id, lat, lng, {hav('40.0', '-74.0', 'lat', 'lng')} / 6371000.0 AS d13,
    atan2(sin(radians(lng + 74.0)) * cos(radians(lat)), cos(radians(40.0)) * sin(radians(lat)) - sin(radians(40.0)) * cos(radians(lat)) * cos(radians(lng + 74.0))) AS t13,
    atan2(sin(radians(1.0)) * cos(radians(41.0)), cos(radians(40.0)) * sin(radians(41.0)) - sin(radians(40.0)) * cos(radians(41.0)) * cos(radians(1.0))) AS t12 FROM stays)
  SELECT id, round(abs(asin(sin(d13) * sin(t13 - t12))) * 6371000.0, 2) AS cross_m, round(abs(1.0 * lng - 1.0 * lat - 73.0 * 40.0 + 41.0 * 74.0) / sqrt(2.0), 6) AS planar FROM q""")
def m5(spark, d):
    s = stays(spark, d)
    return s.select("id", F.round(geo.cross_track("lat", "lng", F.lit(40.0), F.lit(-74.0), F.lit(41.0), F.lit(-73.0)), 2).alias("cross_m"), F.round(geo.planar_point_to_line("lng", "lat", F.lit(-74.0), F.lit(40.0), F.lit(-73.0), F.lit(41.0)), 6).alias("planar"))


@query("m6_mercator", f"""WITH {STAYS} SELECT id, round((lng + 180) / 360, 9) AS x, round(0.5 - ln(tan(radians(lat) / 2 + pi() / 4)) / (2 * pi()), 9) AS y, round(lat, 6) AS back_lat, round(lng, 6) AS back_lng FROM stays""")
def m6(spark, d):
    s = stays(spark, d).withColumn("m", geo.mercator("lat", "lng")).withColumn("u", geo.unmercator("m.x", "m.y"))
    return s.select("id", F.round("m.x", 9).alias("x"), F.round("m.y", 9).alias("y"), F.round("u.lat", 6).alias("back_lat"), F.round("u.lng", 6).alias("back_lng"))


@query("m7_m9_angles", """WITH a AS (SELECT event_id, (event_id % 720 - 360)::DOUBLE AS x, (event_id * 7 % 360 - 180)::DOUBLE AS r FROM events),
  w AS (SELECT *, x - r AS d, ((x - r + 180) % 360 + 360) % 360 - 180 AS m FROM a)
  SELECT event_id, CASE WHEN abs(d) <= 180 THEN x ELSE r + m END AS unwrapped, m AS turn, (r + greatest(-15, least(15, m)) + 360) % 360 AS eased FROM w""")
def m7(spark, d):
    a = read(spark, d, "events").select("event_id", (F.col("event_id") % 720 - 360).cast("double").alias("x"), (F.col("event_id") * 7 % 360 - 180).cast("double").alias("r"))
    return a.select("event_id", geo.unwrap_longitude("x", "r").alias("unwrapped"), geo.angle_delta("r", "x").alias("turn"), geo.turn_towards("r", "x", F.lit(15.0)).alias("eased"))


@query("m10_m13_m15_camera", f"""WITH {STAYS}, s AS (SELECT *, least(1.0, greatest(0.0, confidence * 1.2 - 0.1)) AS t FROM stays)
  SELECT id, round(t * t * (3 - 2 * t), 6) AS ease, CASE mode WHEN 'WALK' THEN 0.02 WHEN 'CAR' THEN 0.4 WHEN 'TRAIN' THEN 1.0 WHEN 'AIRPLANE' THEN 8.0 ELSE 0.2 END::DOUBLE AS span,
  round(metres * least(1920 / metres, 1080 / (metres / 2)), 3) AS fit_w FROM s""")
def m10(spark, d):
    s = stays(spark, d)
    span = geo.camera_span("mode", {"WALK": 0.02, "CAR": 0.4, "TRAIN": 1.0, "AIRPLANE": 8.0}, 0.2)
    return s.select("id", F.round(geo.smoothstep(F.col("confidence") * 1.2 - 0.1), 6).alias("ease"), span.alias("span"), F.round(geo.aspect_fit("metres", F.col("metres") / 2, F.lit(1920), F.lit(1080))["w"], 3).alias("fit_w"))


@query("m11_viewport", f"""WITH {STAYS}, b AS (SELECT trip, min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM stays GROUP BY trip),
  s AS (SELECT trip, (a + b) / 2 AS lat, (c + d) / 2 AS lng, greatest(1e-6, (b - a) * 1.25) AS h, greatest(1e-6, (d - c) * 1.25) AS w FROM b)
  SELECT trip, round(lat, 6) AS lat, round(lng, 6) AS lng, round(greatest(h, w / 0.5), 6) AS lat_span, round(greatest(w, h * 0.5), 6) AS lng_span FROM s""")
def m11(spark, d):
    b = stays(spark, d).groupBy("trip").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d"))
    return b.withColumn("v", geo.viewport("a", "c", "b", "d", F.lit(0.5))).select("trip", *(F.round(f"v.{k}", 6).alias(k) for k in ("lat", "lng", "lat_span", "lng_span")))


_ZOOM = " ".join(f"WHEN (floor(x1 * {1 << z}) - floor(x0 * {1 << z}) + 1) * (floor(y1 * {1 << z}) - floor(y0 * {1 << z}) + 1) <= 24 THEN {z}" for z in range(17, 1, -1))


@query("m12_tile_cover", f"""WITH {STAYS}, m AS (SELECT trip, (lng + 180) / 360 AS x, 0.5 - ln(tan(radians(lat) / 2 + pi() / 4)) / (2 * pi()) AS y FROM stays),
  b AS (SELECT trip, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m GROUP BY trip), z AS (SELECT *, CASE {_ZOOM} ELSE 2 END AS zoom FROM b)
  SELECT trip, CAST(zoom AS INT) AS zoom, CAST(unnest(range(CAST(floor(x0 * pow(2, zoom)) AS BIGINT), CAST(floor(x1 * pow(2, zoom)) AS BIGINT) + 1)) AS BIGINT) AS x, y FROM (
    SELECT *, unnest(range(CAST(floor(y0 * pow(2, zoom)) AS BIGINT), CAST(floor(y1 * pow(2, zoom)) AS BIGINT) + 1)) AS y FROM z)""")
def m12(spark, d):
    m = stays(spark, d).withColumn("m", geo.mercator("lat", "lng")).groupBy("trip").agg(F.min("m.x").alias("x0"), F.max("m.x").alias("x1"), F.min("m.y").alias("y0"), F.max("m.y").alias("y1"))
    z = m.withColumn("zoom", geo.tile_zoom("x0", "y0", "x1", "y1"))
    return z.select("trip", "zoom", F.inline(geo.tile_cover("x0", "y0", "x1", "y1", "zoom"))).drop("d")


@query("f1_f3_date_window", f"""WITH {STAYS}, w AS (SELECT epoch_ms(TIMESTAMP '1996-03-01') - 14 * 3600000 AS a, epoch_ms(TIMESTAMP '1996-03-10') + 86400000 + 12 * 3600000 - 1 AS b)
  SELECT id, start_ms BETWEEN a AND b AS contained, end_ms >= a AND start_ms <= b AS overlaps FROM stays, w WHERE end_ms >= a AND start_ms <= b""")
def f1(spark, d):
    a, b = timefn.date_window(F.lit("1996-03-01"), F.lit("1996-03-10"))
    s = stays(spark, d)
    hit = (F.col("end_ms") >= a) & (F.col("start_ms") <= b)
    return s.where(hit).select("id", F.col("start_ms").between(a, b).alias("contained"), hit.alias("overlaps"))


@query("f4_f5_points", """WITH p AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS lat, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value * 2 - 100 END AS lng FROM events)
  SELECT event_id, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS valid, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0) AS usable FROM p""")
def f4(spark, d):
    zero = F.col("event_id") % 7 == 0
    p = read(spark, d, "events").select("event_id", F.when(zero, 0.0).otherwise(F.col("value")).alias("lat"), F.when(zero, 0.0).otherwise(F.col("value") * 2 - 100).alias("lng"))
    return p.select("event_id", geo.valid_point("lat", "lng").alias("valid"), geo.without_null_island("lat", "lng").isNotNull().alias("usable"))


@query("f6_genuine_displacement", f"""WITH {STAYS}, m AS (SELECT trip, mode, sum(metres) AS metres, greatest(1000, max(end_ms) - min(start_ms)) AS ms FROM stays GROUP BY ALL)
  SELECT trip, mode, metres FROM m WHERE metres >= 150 AND metres / 1000 / (ms / 3600000) >= 0.02""")
def f6(spark, d):
    m = stays(spark, d).groupBy("trip", "mode").agg(F.sum("metres").alias("metres"), F.greatest(F.lit(1000), F.max("end_ms") - F.min("start_ms")).alias("ms"))
    return m.where((F.col("metres") >= 150) & (F.col("metres") / 1000 / (F.col("ms") / 3_600_000) >= 0.02)).select("trip", "mode", "metres")


_MEDIA = """media AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, ['IMG_', 'Screenshot_', 'download-', 'PXL_', 'note ', 'screencapture', 'received_', 'thumb_'][CAST(event_id % 8 AS INT) + 1] || event_id || '.jpg' AS name,
  ['DCIM/Camera', 'Pictures/Screenshots', 'Download', 'Pictures/WhatsApp', 'Pictures', 'Browser'][CAST(event_id % 6 AS INT) + 1] AS path, ['Camera', 'Chrome', 'misc'][CAST(event_id % 3 AS INT) + 1] AS bucket,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS taken, event_id % 5 = 0 AS original, event_id % 10 = 0 AS shift, event_id % 3 = 0 AS gps, user_id FROM events)"""


def media(spark, d):
    e, pick = read(spark, d, "events"), lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    ts = timefn.millis("ts")
    return e.select(
        "event_id", ts.alias("ts_ms"), F.concat(pick(["IMG_", "Screenshot_", "download-", "PXL_", "note ", "screencapture", "received_", "thumb_"], 8), F.col("event_id").cast("string"), F.lit(".jpg")).alias("name"),
        pick(["DCIM/Camera", "Pictures/Screenshots", "Download", "Pictures/WhatsApp", "Pictures", "Browser"], 6).alias("path"), pick(["Camera", "Chrome", "misc"], 3).alias("bucket"),
        F.when(F.col("event_id") % 4 != 0, ts).alias("taken"), (F.col("event_id") % 5 == 0).alias("original"), (F.col("event_id") % 10 == 0).alias("shift"), (F.col("event_id") % 3 == 0).alias("gps"), "user_id",
    )


_EXT = "download|telegram|whatsapp|kakaotalk|reddit|twitter|instagram|facebook|save"
_EVIDENCE = f"""CASE WHEN regexp_matches(lower(path), 'screenshot') OR regexp_matches(lower(bucket), 'screenshot') OR regexp_matches(lower(name), '^(screenshot|screen_shot)|screencapture') THEN 'SCREENSHOT'
  WHEN regexp_matches(lower(path), '{_EXT}|browser') OR regexp_matches(lower(bucket), '{_EXT}|chrome') THEN CASE WHEN gps AND (shift OR original) THEN 'STRONG_CAPTURE' ELSE 'DOWNLOADED_OR_EXTERNAL' END
  WHEN (shift AND original) OR (gps AND (taken IS NOT NULL OR original)) OR (cam AND (original OR taken IS NOT NULL)) THEN 'STRONG_CAPTURE' WHEN cam OR original OR taken IS NOT NULL THEN 'LIKELY_CAPTURE' ELSE 'WEAK_DATE_ONLY' END"""
_CAM = "(SELECT *, regexp_matches(lower(path), 'dcim|camera') OR regexp_matches(lower(bucket), 'camera|100andro') OR regexp_matches(lower(name), '^(img_|dsc_|pxl_|mvi_|cimg)') AS cam FROM media)"


@query("f7_capture_evidence", f"WITH {_MEDIA} SELECT event_id, {_EVIDENCE} AS evidence FROM {_CAM}")
def f7(spark, d):
    return media(spark, d).select("event_id", text.capture_evidence("path", "bucket", "name", "taken", "original", "shift", "gps").alias("evidence"))


@query("f8_f9_eligibility", f"""WITH {_MEDIA}, e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'UNKNOWN' ELSE {_EVIDENCE} END AS known FROM {_CAM}),
  f AS (SELECT event_id, gps, CASE WHEN known <> 'UNKNOWN' THEN known WHEN shift OR (original AND gps) THEN 'STRONG_CAPTURE' WHEN original OR taken > 0 THEN 'LIKELY_CAPTURE' WHEN gps THEN 'STRONG_CAPTURE' ELSE 'WEAK_DATE_ONLY' END AS evidence FROM e)
  SELECT event_id, evidence, evidence IN ('STRONG_CAPTURE', 'LIKELY_CAPTURE') OR (gps AND event_id % 7 = 0) AS eligible FROM f""")
def f8(spark, d):
    known = F.when(F.col("event_id") % 2 == 0, "UNKNOWN").otherwise(text.capture_evidence("path", "bucket", "name", "taken", "original", "shift", "gps"))
    told = lambda x: F.when(F.col(x), "x")
    own = text.effective_evidence(known, told("original"), told("shift"), "taken", "gps")
    return media(spark, d).select("event_id", own.alias("evidence"), (own.isin("STRONG_CAPTURE", "LIKELY_CAPTURE") | (F.col("gps") & (F.col("event_id") % 7 == 0))).alias("eligible"))


@query("f10_day_range_gate", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders) SELECT o_orderkey FROM o WHERE day IS NULL OR day BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def f10(spark, d):
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    return read(spark, d, "orders").where(day.isNull() | day.between("1995-01-01", "1995-06-30")).select("o_orderkey")


@query("f11_x11_story_eligibility", f"""WITH {_MEDIA}, p AS (SELECT event_id, name, event_id % 11 = 0 AS pinned, CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts_ms END AS t, ts_ms - (event_id % 13) * 100000 AS a, ts_ms - (event_id % 13) * 100000 + 700000 AS b FROM media)
  SELECT event_id, CASE WHEN NOT pinned AND bad THEN 'INELIGIBLE_SCREENSHOT_OR_DOWNLOAD' WHEN t IS NULL THEN 'INELIGIBLE_TIME_UNCERTAIN' WHEN t BETWEEN a AND b THEN 'ELIGIBLE' WHEN t BETWEEN a - 300000 AND b + 300000 THEN 'CLAMPED_TO_PARENT' ELSE 'INELIGIBLE_TIMESTAMP_CONFLICT' END AS status,
  CASE WHEN NOT pinned AND bad THEN coalesce(t, a) WHEN t IS NULL THEN a WHEN t BETWEEN a AND b THEN t WHEN t BETWEEN a - 300000 AND a THEN a WHEN t BETWEEN b AND b + 300000 THEN b ELSE t END AS ts
  FROM (SELECT *, regexp_matches(lower(name), 'screenshot|screen_shot|screencap|download|received_|thumb|icon') AS bad FROM p)""")
def f11(spark, d):
    a = F.col("ts_ms") - F.col("event_id") % 13 * 100_000
    got = text.story_eligibility("name", F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 6 != 0, F.col("ts_ms")), F.lit("EXIF_EXACT"), a, a + 700_000)
    return media(spark, d).select("event_id", got.alias("g")).select("event_id", "g.status", "g.ts")


@query("f12_f13_f15_f21_projections", """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 9 = 0 THEN 'renamed ' || o_orderkey END, o_orderpriority) AS name, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS visit, CASE WHEN o_custkey % 2 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN o_custkey END AS segment,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'UNKNOWN' END AS status, o_orderkey % 9 = 0 OR coalesce(o_totalprice > 200000, false) AS is_override FROM orders""")
def f12(spark, d):
    o = read(spark, d, "orders")
    renamed = F.col("o_orderkey") % 9 == 0
    visit = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))
    return o.select("o_orderkey", F.coalesce(F.when(renamed, F.concat(F.lit("renamed "), F.col("o_orderkey").cast("string"))), "o_orderpriority").alias("name"), visit.alias("visit"), F.when(visit.isNull() & (F.col("o_custkey") % 3 == 0), F.col("o_custkey")).alias("segment"), F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("UNKNOWN").alias("status"), (renamed | F.coalesce(F.col("o_totalprice") > 200000, F.lit(False))).alias("is_override"))


@query("f17_f18_f20_f24_culling", f"""WITH {STAYS}, b AS (SELECT trip, min(lat) AS y0, max(lat) AS y1, min(lng) AS x0, max(lng) AS x1, count(*) AS n FROM stays GROUP BY trip)
  SELECT trip, (x1 >= -73.9 AND x0 <= -73.7 OR x1 + 360 >= -73.9 AND x0 + 360 <= -73.7 OR x1 - 360 >= -73.9 AND x0 - 360 <= -73.7) AND y1 >= 40.2 AND y0 <= 40.4 AS visible, 40.3 BETWEEN y0 - 1e-9 AND y1 + 1e-9 AS candidate, CASE WHEN x1 - x0 < 15 THEN 'regional' ELSE 'world' END AS detail FROM b WHERE n >= 3""")
def f17(spark, d):
    b = stays(spark, d).groupBy("trip").agg(F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.count("*").alias("n")).where("n >= 3")
    turn = lambda k: (F.col("x1") + k >= -73.9) & (F.col("x0") + k <= -73.7)
    return b.select("trip", ((turn(0) | turn(360) | turn(-360)) & (F.col("y1") >= 40.2) & (F.col("y0") <= 40.4)).alias("visible"), F.lit(40.3).between(F.col("y0") - 1e-9, F.col("y1") + 1e-9).alias("candidate"), F.when(F.col("x1") - F.col("x0") < 15, "regional").otherwise("world").alias("detail"))


@query("f22_f23_playback_classes", f"""WITH {STAYS}, t AS (SELECT *, epoch_ms(TIMESTAMP '1996-06-01') AS now FROM stays)
  SELECT id, CASE WHEN now BETWEEN start_ms AND end_ms THEN 'ACTIVE' WHEN end_ms < now AND now - end_ms < 86400000 THEN 'RECENT' WHEN end_ms < now THEN 'OLD' WHEN start_ms - now < 43200000 THEN 'SOON' ELSE 'LATER' END AS class,
  abs((end_ms - start_ms) / 1000 - metres * 3.4) <= greatest(1.5, 0.08 * metres * 3.4) AND (end_ms - start_ms) / 1000 <= 3600000 AS on_time FROM t""")
def f22(spark, d):
    now = F.lit(833_587_200_000)
    kind = F.when(now.between(F.col("start_ms"), F.col("end_ms")), "ACTIVE").when((F.col("end_ms") < now) & (now - F.col("end_ms") < 86_400_000), "RECENT").when(F.col("end_ms") < now, "OLD").when(F.col("start_ms") - now < 43_200_000, "SOON").otherwise("LATER")
    actual, planned = (F.col("end_ms") - F.col("start_ms")) / 1000, F.col("metres") * 3.4
    return stays(spark, d).select("id", kind.alias("class"), ((F.abs(actual - planned) <= F.greatest(F.lit(1.5), 0.08 * planned)) & (actual <= 3_600_000)).alias("on_time"))


_ACT = ["IN_PASSENGER_VEHICLE", "WALKING", "MOTORCYCLING", "IN_TRAIN", "FLYING", "IN_FERRY", "ON_FOOT", "STILL", "IN_BUS", "IN_TRAM"]
_ACT_SQL = " ".join(f"WHEN contains(a, '{p}') THEN '{m}'" for p, m in text.ACTIVITY_PARTS)


@query("x1_activity_mode", f"WITH e AS (SELECT event_id, {_ACT}[CAST(event_id % 10 AS INT) + 1] AS a FROM events) SELECT event_id, CASE {_ACT_SQL} ELSE 'UNKNOWN' END AS mode FROM e")
def x1(spark, d):
    a = F.element_at(F.array(*map(F.lit, _ACT)), (F.col("event_id") % 10 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", text.activity_mode(a).alias("mode"))


_NAMES = ["Home", " unknown ", "INFERRED_WORK", "Cafe  Blue", "null", "12 Main Street", "집", "Newport 2", "", "세종로 12"]


@query("x2_x4_names", f"""WITH e AS (SELECT event_id, {_NAMES}[CAST(event_id % 10 AS INT) + 1] AS n, ['TYPE_HOME', 'INFERRED_WORK', 'X'][CAST(event_id % 3 AS INT) + 1] AS s FROM events), t AS (SELECT *, trim(regexp_replace(n, '\\s+', ' ', 'g')) AS k FROM e)
  SELECT event_id, CASE WHEN trim(n) <> '' AND upper(trim(n)) <> 'UNKNOWN' THEN trim(n) WHEN contains(s, 'HOME') THEN 'Home' WHEN contains(s, 'WORK') THEN 'Work' END AS place, CASE WHEN lower(k) NOT IN ('', 'unknown', 'null') THEN k END AS real, lower(k) IN ('home', 'work', 'inferred_home', 'inferred_work', '집', '직장') AS generic, CASE WHEN regexp_matches(n, '(?i)\\bhome\\b|집') THEN true ELSE false END AS home FROM t""")
def x2(spark, d):
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    e = read(spark, d, "events").select("event_id", pick(_NAMES, 10).alias("n"), pick(["TYPE_HOME", "INFERRED_WORK", "X"], 3).alias("s"))
    return e.select("event_id", text.place_name("n", "s").alias("place"), text.real_name("n").alias("real"), text.is_generic("n").alias("generic"), text.is_home("n").alias("home"))


@query("x5_x9_redaction", f"""WITH e AS (SELECT event_id, {_NAMES}[CAST(event_id % 10 AS INT) + 1] AS n FROM events)
  SELECT event_id, CASE WHEN regexp_matches(n, '(?i)\\b(home|inferred_home|work|inferred_work)\\b') OR regexp_matches(n, '집|자택|[0-9]') THEN 'Private place' ELSE n END AS label,
  CASE WHEN regexp_matches(n, '(?i)\\b(home|inferred_home|work|inferred_work)\\b|자택|^집$') OR regexp_matches(n, '(?i)\\b\\d+\\s+.+\\b(street|st|road|rd|avenue|ave|drive|dr|lane|ln|court|ct|boulevard|blvd)\\b') OR regexp_matches(n, '[가-힣]+(?:로|길)\\s*\\d+') THEN 'My Travel Story' ELSE n END AS title, regexp_replace(n, '[^a-zA-Z0-9_-]', '_', 'g') AS file, coalesce(regexp_matches(n, '(?i)\\bhome\\b|집'), false) AS home FROM e""")
def x5(spark, d):
    e = read(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 10 + 1).cast("int")).alias("n"))
    return e.select("event_id", text.generalised("n").alias("label"), text.redact_title("n").alias("title"), text.safe_file_name("n").alias("file"), text.is_home("n").alias("home"))


@query("x10_file_name_time", """WITH f AS (SELECT o_orderkey, 'IMG_' || CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 20 YEAR, '%Y%m%d') WHEN o_orderkey % 4 = 1 THEN '20261399' ELSE '20240101' END || '_' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || '3015.jpg' AS n FROM orders)
  SELECT o_orderkey, epoch_ms(try_strptime(regexp_extract(n, '20\\d{6}_\\d{6}'), '%Y%m%d_%H%M%S')) AS local_ms FROM f""")
def x10(spark, d):
    k = F.col("o_orderkey")
    day = F.when(k % 4 == 0, F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 240), "yyyyMMdd")).when(k % 4 == 1, "20261399").otherwise("20240101")
    n = F.concat(F.lit("IMG_"), day, F.lit("_"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit("3015.jpg"))
    return read(spark, d, "orders").select("o_orderkey", timefn.millis(text.file_name_time(n)).alias("local_ms"))


@query("x12_label_category", """WITH e AS (SELECT event_id, [['Selfie', 'sky'], ['Dish', 'Food'], ['Car', 'beach'], ['Tower'], ['Water', 'tree'], ['stone']][CAST(event_id % 6 AS INT) + 1] AS l FROM events)
  SELECT event_id, ['people', 'food', 'activity', 'places', 'scenery', 'other'][CAST(event_id % 6 AS INT) + 1] AS category FROM e""")
def x12(spark, d):
    l = F.array(*(F.array(*map(F.lit, x)) for x in (["Selfie", "sky"], ["Dish", "Food"], ["Car", "beach"], ["Tower"], ["Water", "tree"], ["stone"])))
    return read(spark, d, "events").select("event_id", text.label_category(F.element_at(l, (F.col("event_id") % 6 + 1).cast("int"))).alias("category"))


@query("x13_x15_texts", f"""WITH {STAYS} SELECT id, CASE WHEN metres * 7 / 1000 >= 100 THEN format('{{:,}}', CAST(round_even(metres * 7 / 1000, 0) AS BIGINT)) ELSE printf('%.1f', metres * 7 / 1000) END AS distance,
  CASE WHEN id % 6 = 0 THEN 'Estimated' WHEN id % 5 = 0 THEN 'Stop' ELSE upper(mode[1]) || lower(mode[2:]) END AS label,
  CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'zone unknown' WHEN id % 2 = 0 THEN 'arrives in UTC' WHEN id % 3 = 0 THEN 'departs in Asia/Tokyo' ELSE 'Asia/Tokyo → UTC' END AS zones FROM stays""")
def x13(spark, d):
    k = F.col("id")
    return stays(spark, d).select("id", text.distance_text(F.col("metres") * 7).alias("distance"), text.mode_label("mode", F.when(k % 6 == 0, F.lit("bridge_1")), k % 5 == 0).alias("label"), text.movement_text(F.when(k % 2 != 0, F.lit("Asia/Tokyo")), F.when(k % 3 != 0, F.lit("UTC"))).alias("zones"))


@query("x3_j18_place_label", """WITH e AS (SELECT event_id, ['Home', 'work', 'Cafe', 'unknown', NULL][CAST(event_id % 5 AS INT) + 1] AS n, ['1 Elm, X', '42, Y', NULL][CAST(event_id % 3 AS INT) + 1] AS a, CASE WHEN event_id % 7 < 5 THEN 'City' END AS c, CASE WHEN event_id % 11 < 6 THEN 'Rock' END AS l, (event_id % 13 * 3000)::DOUBLE AS lm, CASE WHEN event_id % 7 < 5 THEN (event_id % 17 * 3000)::DOUBLE END AS cm FROM events)
  SELECT event_id, CASE WHEN lower(n) = 'home' THEN coalesce('Home · ' || c, 'Home') WHEN lower(n) = 'work' THEN coalesce('Work · ' || c, 'Work') WHEN lower(n) NOT IN ('', 'unknown', 'null') THEN n WHEN a IS NOT NULL AND NOT regexp_matches(split_part(a, ',', 1), '^\\d+$') THEN split_part(a, ',', 1)
  WHEN l IS NOT NULL AND (lm < 15000 OR cm IS NULL OR lm < cm) THEN l WHEN c IS NOT NULL THEN 'Near ' || c ELSE 'Unlabeled stop' END AS label FROM e""")
def x3(spark, d):
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    k = F.col("event_id")
    city = k % 7 < 5
    got = text.display_label(pick(["Home", "work", "Cafe", "unknown", None], 5), pick(["1 Elm, X", "42, Y", None], 3), F.when(city, "City"), F.when(k % 11 < 6, "Rock"), (k % 13 * 3000).cast("double"), F.when(city, (k % 17 * 3000).cast("double")))
    return read(spark, d, "events").select("event_id", got.alias("label"))


_RAW = ["1782871200000", "2026-07-01T14:00:00Z", "2026-07-01T10:00:00-04:00", "2026-07-01T14:00:00", "garbage", "", "1782871200", "1782871200000000", "12"]


@query("d1_d2_instants", """WITH e AS (SELECT event_id, CAST(event_id % 9 AS INT) + 1 AS k FROM events)
  SELECT event_id, [1782871200000, 1782914400000, 1782914400000, NULL, NULL, NULL, 1782871200000, 1782871200000, NULL][k] AS ms, [946684800000, 946684800000, NULL][CAST(event_id % 3 AS INT) + 1] AS taken FROM e""")
def d1(spark, d):
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % n + 1).cast("int"))
    return read(spark, d, "events").select("event_id", timefn.parse_instant(pick(_RAW, 9)).alias("ms"), timefn.normalise_taken(pick([946684800000, 946684800, 5], 3)).alias("taken"))


@query("d3_exif_local", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_ms(o_orderdate) END AS ms FROM orders")
def d3(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "2026:13:45 99:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return read(spark, d, "orders").select("o_orderkey", timefn.millis(timefn.exif_local(raw)).alias("ms"))


@query("d6_d7_local_day", """WITH e AS (SELECT event_id, ts, ['America/New_York', 'Asia/Tokyo', 'UTC', NULL][CAST(event_id % 4 AS INT) + 1] AS z FROM events), l AS (SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE z AS DATE) AS day FROM e)
  SELECT event_id, day, CASE WHEN day IS NULL THEN DATE '2024-01-10' ELSE greatest(DATE '2024-01-10', least(DATE '2024-01-20', day)) END AS anchored FROM l""")
def d6(spark, d):
    z = F.element_at(F.array(*map(F.lit, ["America/New_York", "Asia/Tokyo", "UTC", None])), (F.col("event_id") % 4 + 1).cast("int"))
    day = timefn.local_date(timefn.millis("ts"), z)
    a, b = F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")
    return read(spark, d, "events").select("event_id", day.alias("day"), F.when(day.isNull(), a).otherwise(timefn.clamp_day(day, a, b)).alias("anchored"))


@query("d9_d11_durations", f"""WITH {STAYS}, s AS (SELECT id, start_ms, end_ms, (end_ms - start_ms) // 7 AS ms, (end_ms - start_ms) // 7000 AS sec FROM stays)
  SELECT id, CASE WHEN ms // 3600000 > 0 THEN (ms // 3600000) || 'h ' || (ms // 60000 % 60) || 'm' ELSE (ms // 60000) || 'm' END AS text,
  CASE WHEN sec // 3600 > 0 THEN (sec // 3600) || ':' || lpad(CAST(sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') ELSE (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS clock, CAST(greatest(1, start_ms // 86400000 - 9000 + 1) AS INT) AS day_number, start_ms // 86400000 AS utc_day FROM s""")
def d9(spark, d):
    s = stays(spark, d).withColumn("ms", F.expr("(end_ms - start_ms) div 7")).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.expr("start_ms div 86400000").cast("int")))
    first = F.date_add(F.lit("1970-01-01").cast("date"), 9000)
    return s.select("id", timefn.duration_text("ms").alias("text"), timefn.clock_text(F.expr("(end_ms - start_ms) div 7000")).alias("clock"), timefn.day_number("day", first).alias("day_number"), timefn.utc_day("start_ms").alias("utc_day"))


@query("d4_wall_clock", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 48 * 30 AS BIGINT)) AS t FROM orders), c AS (SELECT o_orderkey, t, unnest([4, 5]) AS h FROM o),
  i AS (SELECT o_orderkey, epoch_ms(t + to_hours(h)) AS ms FROM c WHERE ((t + to_hours(h)) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' = t) SELECT o.o_orderkey, CAST(count(ms) AS INT) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM o LEFT JOIN i ON i.o_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def d4(spark, d):
    """0, 1 or 2 instants of local times in New York.  SQL tries both of its offsets and keeps those whose local time is the one given."""
    t = F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(mins=(F.col("o_orderkey") % 48 * 30).cast("int"))
    o = read(spark, d, "orders").select("o_orderkey", timefn.wall_clock_instants(t, F.lit("America/New_York")).alias("i"))
    return o.select("o_orderkey", F.size("i").alias("n"), F.array_min("i").alias("first_ms"), F.array_max("i").alias("last_ms"))


@query("h1_h2_parsing", """WITH e AS (SELECT event_id, event_id % 5 AS k, (event_id % 80)::DOUBLE AS a, (event_id % 170)::DOUBLE AS b FROM events)
  SELECT event_id, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN k = 3 THEN NULL ELSE a END AS lat, ['x', 'y'] AS items FROM e""")
def h1(spark, d):
    k, a, b = F.col("event_id") % 5, F.col("event_id") % 80, F.col("event_id") % 170
    t = F.when(k == 0, F.concat(a.cast("string"), F.lit("°, "), b.cast("string"), F.lit("°"))).when(k == 1, F.concat(F.lit("geo:"), a.cast("string"), F.lit(","), b.cast("string"))).when(k == 3, "nowhere")
    e7 = lambda x: F.when(k != 3, x * 10_000_000)
    items = hashing.json_list(F.when(k < 3, '["x", "y"]').otherwise("x, ,y"))
    return read(spark, d, "events").select("event_id", hashing.coordinate(t, e7(a), e7(b))["lat"].alias("lat"), items.alias("items"))


@query("h3_h5_ids", """SELECT event_id, sha256('visit:' || event_id || ':' || user_id || ':' || event_type)[1:24] AS id FROM events""")
def h3(spark, d):
    return read(spark, d, "events").select("event_id", hashing.stable_id("visit", "event_id", "user_id", "event_type").alias("id"))


@query("h5_fingerprint", "SELECT l_orderkey, sha256('[' || array_to_string(list_sort(list(l_partkey)), ',') || ']') AS print FROM lineitem GROUP BY l_orderkey")
def h5(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(hashing.fingerprint(F.collect_list("l_partkey")).alias("print"))


@query("h7_h9_photo_scores", """WITH f AS (SELECT vec_id, label, embedding, least(1.0, abs(embedding[1]) * 5000 / 900) * 240 + abs(embedding[2]) * 120 AS q FROM embeddings),
  g AS (SELECT a.vec_id, a.label, CAST(trunc(a.q) AS INT) AS quality, bit_count(xor(a.vec_id * 2654435761, b.vec_id * 2654435761)) <= 6 AND list_sum(list_transform(range(1, 9), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) < 0.9 AS alike FROM f a JOIN f b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, quality, alike, (CASE WHEN label = 0 THEN 100000 ELSE 0 END) + (CASE WHEN label % 2 = 0 THEN 400 ELSE 0 END + 200 + 100 - CASE WHEN label = 3 THEN 300 ELSE 0 END) // 8 + quality AS score FROM g""")
def h7(spark, d):
    q = hashing.quality_score(F.abs(F.col("embedding")[0].cast("double")) * 5000, F.abs(F.col("embedding")[1].cast("double")))
    e = read(spark, d, "embeddings").withColumns({"quality": q, "hash": F.col("vec_id") * 2654435761, "color": F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))})
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("hash_b"), F.col("color").alias("color_b"))
    j = e.join(b, "vec_id")
    name = F.when(F.col("label") == 3, "Screenshot_1.png").otherwise("IMG_1.jpg")
    score = hashing.representative_score(F.col("label") == 0, F.col("label") % 2 == 0, F.lit(False), F.lit("MEDIASTORE"), F.lit("image/jpeg"), name, "quality")
    return j.select("vec_id", "quality", hashing.similar_images("hash", "hash_b", "color", "color_b", max_color=0.9).alias("alike"), score.alias("score"))


@query("a6_transport_mode", f"""WITH {STAYS}, s AS (SELECT id, mode, (end_ms - start_ms) / 40 AS ms, metres * (1 + part % 40) AS dm, metres * (1 + part % 40) * 0.9 AS sm, confidence, id % 50 = 0 AS ov FROM stays),
  v AS (SELECT *, dm / 1000 / (ms / 3600000) AS v, sm / 1000 / (ms / 3600000) AS st FROM s), w AS (SELECT *, sm >= 200000 AND st BETWEEN 360 AND 1150 AS flight FROM v)
  SELECT id, CASE WHEN ov THEN mode WHEN v > 1150 OR st > 1150 THEN 'UNKNOWN' WHEN mode <> 'UNKNOWN' AND NOT (mode IN ('WALK', 'RUN') AND v > 45 AND dm > 5000) AND NOT (mode IN ('CAR', 'BUS', 'WALK', 'RUN', 'BICYCLE') AND flight) THEN mode
  WHEN dm < 60 AND ms >= 600000 THEN 'UNKNOWN' WHEN flight THEN 'AIRPLANE' WHEN v BETWEEN 145 AND 350 THEN 'TRAIN' WHEN v BETWEEN 28 AND 140 THEN 'CAR' WHEN v BETWEEN 14 AND 28 THEN 'BICYCLE' WHEN v BETWEEN 6.5 AND 10.5 THEN 'RUN' WHEN v BETWEEN 6.5 AND 14 THEN 'BICYCLE' WHEN v BETWEEN 0.4 AND 6.5 AND dm >= 50 THEN 'WALK' ELSE 'UNKNOWN' END AS mode FROM w""")
def a6(spark, d):
    s = stays(spark, d)
    dm = F.col("metres") * (1 + F.col("part") % 40)
    got = transport("mode", "confidence", F.col("id") % 50 == 0, dm, dm * 0.9, (F.col("end_ms") - F.col("start_ms")) / 40)
    return s.select("id", got["mode"].alias("mode"))


@query("d5_timestamp_hierarchy", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'EXIF_EXACT' WHEN event_id % 5 = 1 THEN 'MEDIASTORE' WHEN event_id % 5 = 2 THEN 'FILENAME_INFERRED' ELSE 'UNKNOWN' END AS confidence,
  CASE WHEN event_id % 5 = 0 THEN 1783193400000 WHEN event_id % 5 = 1 THEN 1783178000000 WHEN event_id % 5 = 2 THEN 1783179000000 END AS ms FROM events""")
def d5(spark, d):
    """EXIF time with offset, then the catalog's time, then the file name's in the only candidate zone, else unknown: never the present."""
    k = F.col("event_id") % 5
    exif, offset, taken = F.when(k == 0, "2026:07:04 15:30:00"), F.when(k == 0, "-04:00"), F.when(k == 1, 1783178000)
    name = F.when(k == 2, "IMG_20260704_153000.jpg").otherwise("IMG_1.jpg")
    exact = timefn.parse_instant(F.concat(F.date_format(timefn.exif_local(exif), "yyyy-MM-dd'T'HH:mm:ss"), offset))
    named = timefn.wall_clock_instants(text.file_name_time(name), F.lit("UTC"))
    out = lambda s, t: F.struct(F.lit(s).alias("confidence"), t.cast("bigint").alias("ms"))
    got = F.when(exact.isNotNull(), out("EXIF_EXACT", exact)).when(timefn.normalise_taken(taken).isNotNull(), out("MEDIASTORE", timefn.normalise_taken(taken))).when(F.size(named) == 1, out("FILENAME_INFERRED", F.get(named, F.lit(0)))).otherwise(out("UNKNOWN", F.lit(None)))
    return read(spark, d, "events").select("event_id", got.alias("g")).select("event_id", "g.*")


@query("d12_overlay_date", """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 > 0 THEN 'Asia/Tokyo' END AS a, CASE WHEN event_id % 4 > 0 THEN 'America/New_York' END AS b, event_id % 2 = 0 AS arrived FROM events), z AS (SELECT *, CASE WHEN arrived THEN coalesce(b, a) ELSE coalesce(a, b) END AS z FROM e)
  SELECT event_id, CASE WHEN z IS NULL THEN strftime(ts, '%Y-%m-%d') || ' UTC' ELSE strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE z, '%Y-%m-%d') END AS text FROM z""")
def d12(spark, d):
    k = F.col("event_id")
    return read(spark, d, "events").select("event_id", timefn.overlay_date(timefn.millis("ts"), F.when(k % 3 > 0, F.lit("Asia/Tokyo")), F.when(k % 4 > 0, F.lit("America/New_York")), k % 2 == 0).alias("text"))


@query("x15_export_title", "SELECT o_custkey, array_to_string(['Trip ' || o_custkey, (date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) + 1) || ' days', printf('%.1f km', CAST(count(*) AS DOUBLE)), count(*) || ' Memories'], ' | ') AS title FROM orders GROUP BY o_custkey")
def x15(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"), F.count("*").alias("n"))
    return o.select("o_custkey", text.export_title(F.concat(F.lit("Trip "), F.col("o_custkey").cast("string")), "a", "b", F.col("n") * 1000.0, "n").alias("title"))
