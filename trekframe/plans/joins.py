"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions.geo import haversine
from trekframe.operators import joins as J
from trekframe.operators import zones as Z

from .base import PINGS, STAYS, hav, pings, query, read, stays


@query("j1_trip_cards", """WITH n AS (SELECT l_orderkey, count(*) AS photos FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)
  SELECT c_custkey AS trip_id, c_name AS title, o_orderkey AS visit_id, CAST(o_orderdate AS DATE) AS day, coalesce(n_name, o_orderpriority) AS name, n_name IS NOT NULL OR coalesce(o_orderstatus = 'F', false) AS is_override, coalesce(photos, 0) AS photos
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 100 LEFT JOIN n ON l_orderkey = o_orderkey""")
def j1_trip_cards(spark, d):
    """Trips, their visits, renames and photo counts, counted before the join."""
    photos = read(spark, d, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.count("*").alias("photos"))
    renames = read(spark, d, "nation").select("n_nationkey", "n_name")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    t = read(spark, d, "customer").select("c_custkey", "c_name").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    t = t.join(renames, F.col("n_nationkey") == F.col("o_orderkey") % 100, "left").join(photos, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return t.select(
        F.col("c_custkey").alias("trip_id"), F.col("c_name").alias("title"), F.col("o_orderkey").alias("visit_id"), F.col("o_orderdate").cast("date").alias("day"), F.coalesce("n_name", "o_orderpriority").alias("name"),
        (F.col("n_name").isNotNull() | F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))).alias("is_override"), F.coalesce("photos", F.lit(0)).alias("photos"),
    )


_OV = "ov AS (SELECT n_nationkey * 37 AS k, 'VISIT_NAME' AS kind, n_name AS v FROM nation)"


@query("j2_j3_overrides_and_parents", f"""WITH {_OV} SELECT l_orderkey, l_linenumber, coalesce(v, o_orderpriority) AS name, p_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN ov ON k = l_orderkey AND kind = 'VISIT_NAME' LEFT JOIN part ON p_partkey = l_partkey""")
def j2(spark, d):
    ov = read(spark, d, "nation").select((F.col("n_nationkey") * 37).alias("k"), F.lit("VISIT_NAME").alias("kind"), F.col("n_name").alias("v")).where("kind = 'VISIT_NAME'")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = li.join(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(ov, F.col("k") == F.col("l_orderkey"), "left")
    return out.join(read(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("v", "o_orderpriority").alias("name"), "p_name")


#: Points of the same trips and months as the stays.
_AT = "obs AS (SELECT o_orderkey AS id, o_custkey % 100 + 1 AS trip, epoch_ms(o_orderdate) + (o_orderkey % 24) * 3600000 AS ts_ms, (400000 + (o_orderkey % 90) * 100)::DOUBLE / 10000 AS lat, (-740000 + (o_orderkey % 30) * 100)::DOUBLE / 10000 AS lng, o_orderkey % 3 = 0 AS gps FROM orders)"


def at(spark, d):
    from trekframe.functions.timefn import millis

    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("id"), (F.col("o_custkey") % 100 + 1).alias("trip"), (millis("o_orderdate") + k % 24 * 3_600_000).alias("ts_ms"), ((400000 + k % 90 * 100).cast("double") / 10000).alias("lat"), ((-740000 + k % 30 * 100).cast("double") / 10000).alias("lng"), (k % 3 == 0).alias("gps"))


def own(s):
    """Stays under other names, to join with points."""
    return s.select("trip", F.col("id").alias("stay"), "start_ms", "end_ms", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), "mode", "confidence", "metres")


@query("j4_points_fused", f"WITH {STAYS}, {_AT} SELECT obs.id, stays.id AS stay FROM obs JOIN stays ON obs.trip = stays.trip AND ts_ms BETWEEN start_ms - 30000 AND end_ms + 30000")
def j4(spark, d):
    return J.interval_join(at(spark, d), own(stays(spark, d)), ["trip"], "ts_ms", "start_ms", "end_ms", 3_600_000, 30_000).select("id", "stay")


@query("j5_points_covered", f"WITH {STAYS}, {_AT} SELECT id FROM obs WHERE EXISTS (SELECT 1 FROM stays WHERE obs.trip = stays.trip AND ts_ms BETWEEN start_ms AND end_ms)")
def j5(spark, d):
    return J.interval_join(at(spark, d), own(stays(spark, d)), ["trip"], "ts_ms", "start_ms", "end_ms", how="semi").select("id").distinct()


@query("j6_points_uncovered", f"WITH {STAYS}, {_AT} SELECT id FROM obs WHERE NOT EXISTS (SELECT 1 FROM stays WHERE obs.trip = stays.trip AND ts_ms BETWEEN start_ms AND end_ms)")
def j6(spark, d):
    return J.uncovered(at(spark, d), own(stays(spark, d)), ["trip"], "id", "ts_ms", "start_ms", "end_ms").select("id")


@query("j7_j8_active_stay", f"WITH {STAYS}, {_AT}, m AS (SELECT obs.id, stays.id AS stay, row_number() OVER (PARTITION BY obs.id ORDER BY start_ms, end_ms, stays.id) AS r FROM obs JOIN stays ON obs.trip = stays.trip AND ts_ms BETWEEN start_ms AND end_ms) SELECT obs.id, m.stay FROM obs LEFT JOIN m ON m.id = obs.id AND r = 1")
def j7(spark, d):
    a = at(spark, d)
    m = J.interval_join(a, own(stays(spark, d)), ["trip"], "ts_ms", "start_ms", "end_ms").groupBy("id").agg(F.min(F.struct("start_ms", "end_ms", "stay")).alias("b"))
    return a.select("id").join(m, "id", "left").select("id", F.col("b.stay").alias("stay"))


_D = hav("obs.lat", "obs.lng", "stays.lat", "stays.lng")


@query("j9_j10_nearest_stay_in_window", f"""WITH {STAYS}, {_AT}, m AS (SELECT obs.id, stays.id AS stay, round({_D}, 3) AS m FROM obs JOIN stays ON obs.trip = stays.trip AND ts_ms BETWEEN start_ms - 7200000 AND end_ms + 7200000),
  b AS (SELECT id, stay, m, row_number() OVER (PARTITION BY id ORDER BY m, stay) AS r FROM m) SELECT id, stay, m FROM b WHERE r = 1 AND m <= 30000""")
def j9(spark, d):
    near = J.interval_join(at(spark, d), own(stays(spark, d)), ["trip"], "ts_ms", "start_ms", "end_ms", pad=7_200_000).withColumn("m", F.round(haversine("lat", "lng", "s_lat", "s_lng"), 3))
    return near.groupBy("id").agg(F.min(F.struct("m", "stay")).alias("b")).select("id", "b.stay", "b.m").where("m <= 30000")


_CLOSE = "ob AS (SELECT id, trip, ts_ms, 40 + (lat - 40) / 20 AS lat, -74 + (lng + 74) / 20 AS lng FROM obs), st AS (SELECT id, trip, start_ms, end_ms, 40 + (lat - 40) / 20 AS lat, -74 + (lng + 74) / 20 AS lng FROM stays)"


@query("j9_nearest_stay", f"""WITH {STAYS}, {_AT}, {_CLOSE}, m AS (SELECT ob.id, st.id AS stay, round({hav('ob.lat', 'ob.lng', 'st.lat', 'st.lng')}, 3) AS m FROM ob JOIN st ON ob.trip = st.trip AND ts_ms BETWEEN start_ms - 7200000 AND end_ms + 7200000),
  b AS (SELECT id, stay, m, row_number() OVER (PARTITION BY id ORDER BY m, stay) AS r FROM m) SELECT id, stay, m FROM b WHERE r = 1 AND m <= 300""")
def j9n(spark, d):
    """J9 within its own 300 m, over a town's streets; the gates of J10 are in a7_photo_match."""
    near = lambda df: df.withColumns({"lat": 40 + (F.col("lat") - 40) / 20, "lng": -74 + (F.col("lng") + 74) / 20})
    return J.nearest_stay(near(at(spark, d)), near(stays(spark, d)))


@query("j11_nearest_point", f"""WITH {PINGS}, a AS (SELECT id, trip, ts_ms + 600000 AS t FROM pings WHERE id % 10 = 0), p AS (SELECT * FROM pings WHERE id % 10 <> 0),
  m AS (SELECT a.id, p.id AS point, abs(p.ts_ms - t) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY abs(p.ts_ms - t), p.ts_ms, p.id) AS r FROM a JOIN p ON a.trip = p.trip)
  SELECT id, point, gap // 60000 <= 30 AS usable, round(greatest(0.4, least(0.75, 1 - gap // 60000 / 40)), 6) AS confidence FROM m WHERE r = 1""")
def j11(spark, d):
    p = pings(spark, d)
    a = p.where("id % 10 = 0").select("id", "trip", (F.col("ts_ms") + 600_000).alias("t"))
    got = J.nearest_in_time(a, p.where("id % 10 <> 0").select("trip", "ts_ms", F.col("id").alias("point")), ["trip"], "t", "ts_ms", ["point"]).where("r_point IS NOT NULL")
    minutes = F.floor(F.abs(F.col("r_ts_ms") - F.col("t")) / 60_000)
    return got.select("id", F.col("r_point").alias("point"), (minutes <= 30).alias("usable"), F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.75), 1 - minutes / 40)), 6).alias("confidence"))


@query("j12_overlap_flags", f"WITH {STAYS}, {_AT} SELECT obs.id, coalesce(bool_or(mode = 'WALK'), false) AS on_foot, coalesce(bool_or(mode <> 'WALK'), false) AS riding FROM obs LEFT JOIN stays ON obs.trip = stays.trip AND ts_ms BETWEEN start_ms AND end_ms GROUP BY obs.id")
def j12(spark, d):
    a = at(spark, d)
    m = J.interval_join(a, own(stays(spark, d)), ["trip"], "ts_ms", "start_ms", "end_ms").groupBy("id").agg(F.bool_or(F.col("mode") == "WALK").alias("w"), F.bool_or(F.col("mode") != "WALK").alias("r"))
    return a.select("id").join(m, "id", "left").select("id", F.coalesce("w", F.lit(False)).alias("on_foot"), F.coalesce("r", F.lit(False)).alias("riding"))


@query("j14_overlapping_pairs", f"WITH {STAYS} SELECT a.trip, a.id, count(*) AS n FROM stays a JOIN stays b ON a.trip = b.trip AND a.mode = 'WALK' AND b.mode = 'CAR' AND greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms) GROUP BY a.trip, a.id")
def j14(spark, d):
    s = stays(spark, d)
    b = s.where("mode = 'CAR'").select("trip", F.col("id").alias("b_id"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return J.overlap_join(s.where("mode = 'WALK'").select("trip", "id", "start_ms", "end_ms"), b, ["trip"]).groupBy("trip", "id").agg(F.count("*").alias("n"))


@query("j15_preceding_segment", f"""WITH {STAYS}, m AS (SELECT a.id, b.id AS before, row_number() OVER (PARTITION BY a.trip, a.id, a.start_ms, a.end_ms ORDER BY b.end_ms DESC, b.id DESC) AS r FROM stays a JOIN stays b ON a.trip = b.trip AND a.mode = 'WALK' AND b.mode = 'CAR' AND b.end_ms <= a.start_ms + 60000) SELECT DISTINCT id, before FROM m WHERE r = 1""")
def j15(spark, d):
    s = stays(spark, d)
    left = s.where("mode = 'WALK'").select("trip", "id", (F.col("start_ms") + 60_000).alias("t"))
    return J.asof(left, s.where("mode = 'CAR'").select("trip", "end_ms", F.col("id").alias("before")), ["trip"], "t", "end_ms", ["before"]).where("r_before IS NOT NULL").select("id", F.col("r_before").alias("before")).distinct()


@query("j16_omitted_in_gaps", f"""WITH {STAYS}, k AS (SELECT trip, end_ms AS a, lead(start_ms) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS b FROM stays WHERE mode = 'WALK'),
  g AS (SELECT trip, a, b FROM k WHERE b > a) SELECT DISTINCT s.id FROM stays s JOIN g ON s.trip = g.trip AND s.mode = 'TRAIN' AND s.start_ms >= g.a - 60000 AND s.end_ms <= g.b + 60000""")
def j16(spark, d):
    from pyspark.sql.window import Window

    s = stays(spark, d)
    nxt = F.lead("start_ms").over(Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id"))
    gaps = s.where("mode = 'WALK'").select("trip", F.col("end_ms").alias("a"), nxt.alias("b")).where("b > a")
    rail = s.where("mode = 'TRAIN'").select("trip", "id", "start_ms", F.col("end_ms").alias("rail_end"))
    return J.interval_join(rail, gaps, ["trip"], "start_ms", "a", "b", 86_400_000, 60_000).where("rail_end <= b + 60000").select("id").distinct()


_CITIES = "c AS (SELECT s_suppkey AS ord, s_name AS place, (390000 + (s_suppkey * 37 % 40) * 1000)::DOUBLE / 10000 AS p_lat, (-750000 + (s_suppkey * 53 % 40) * 1000)::DOUBLE / 10000 AS p_lng FROM supplier)"


def cities(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("ord"), F.col("s_name").alias("place"), ((390000 + k * 37 % 40 * 1000).cast("double") / 10000).alias("p_lat"), ((-750000 + k * 53 % 40 * 1000).cast("double") / 10000).alias("p_lng"))


@query("j17_nearest_place", f"""WITH {_AT}, {_CITIES}, m AS (SELECT id, place, ord, round({hav('lat', 'lng', 'p_lat', 'p_lng')}, 6) AS m FROM obs, c), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, ord) AS r FROM m WHERE m < 60000)
  SELECT obs.id, place, round(m, 3) AS m FROM obs LEFT JOIN b ON b.id = obs.id AND r = 1""")
def j17(spark, d):
    return J.nearest_place(at(spark, d), cities(spark, d), 60_000, "id").select("id", "place", F.round("place_m", 3).alias("m"))


_RINGS = "e(kind, x1, y1, x2, y2) AS (VALUES ('land', -74.5, 39.5, -72.5, 39.5), ('land', -72.5, 39.5, -72.5, 40.55), ('land', -72.5, 40.55, -74.5, 40.75), ('land', -74.5, 40.75, -74.5, 39.5), ('lake', -73.95, 40.15, -73.85, 40.15), ('lake', -73.85, 40.15, -73.85, 40.35), ('lake', -73.85, 40.35, -73.95, 40.35), ('lake', -73.95, 40.35, -73.95, 40.15))"
_EDGES = [("land", -74.5, 39.5, -72.5, 39.5), ("land", -72.5, 39.5, -72.5, 40.55), ("land", -72.5, 40.55, -74.5, 40.75), ("land", -74.5, 40.75, -74.5, 39.5), ("lake", -73.95, 40.15, -73.85, 40.15), ("lake", -73.85, 40.15, -73.85, 40.35), ("lake", -73.85, 40.35, -73.95, 40.35), ("lake", -73.95, 40.35, -73.95, 40.15)]


@query("j19_j20_point_in_polygon", f"""WITH {_AT}, {_RINGS}, n AS (SELECT id, kind, count(*) % 2 AS odd FROM obs, e WHERE (y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, kind)
  SELECT obs.id, coalesce(max(odd) FILTER (kind = 'land'), 0) = 1 AND coalesce(max(odd) FILTER (kind = 'lake'), 0) = 0 AS land FROM obs LEFT JOIN n USING (id) GROUP BY obs.id""")
def j20(spark, d):
    edges = spark.createDataFrame(_EDGES, "kind string, x1 double, y1 double, x2 double, y2 double")
    return J.point_in_rings(at(spark, d).select("id", "lat", "lng"), edges, "id").select("id", "land")


@query("j21_day_spine", """WITH t AS (SELECT o_custkey % 100 AS trip, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY ALL), s AS (SELECT trip, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM t),
  n AS (SELECT o_custkey % 100 AS trip, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) SELECT s.trip, s.day, coalesce(n, 0) AS items, row_number() OVER (PARTITION BY s.trip ORDER BY s.day) AS day_index FROM s LEFT JOIN n ON n.trip = s.trip AND n.day = s.day""")
def j21(spark, d):
    """Every calendar day of a trip, empty ones too, numbered from 1."""
    from pyspark.sql.window import Window

    o = read(spark, d, "orders").select((F.col("o_custkey") % 100).alias("trip"), F.col("o_orderdate").cast("date").alias("day"))
    span = o.groupBy("trip").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("trip", F.explode(F.sequence("a", "b")).alias("day"))
    n = o.groupBy("trip", "day").agg(F.count("*").alias("n"))
    return span.join(n, ["trip", "day"], "left").select("trip", "day", F.coalesce("n", F.lit(0)).alias("items"), F.row_number().over(Window.partitionBy("trip").orderBy("day")).cast("bigint").alias("day_index"))


@query("j22_contextual_photos", "SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS parent_day, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) <> CAST(l_shipdate AS DATE)")
def j22(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("parent_day"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day")).join(o, "l_orderkey").where("parent_day <> day")


@query("j23_k6_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j23(spark, d):
    parents = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(parents, "o_custkey", "left_anti").select("o_orderkey")


@query("j24_work_set", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.n_chars % 2)")
def j24(spark, d):
    saved = read(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("key"))
    return read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("key")).join(saved, ["doc_id", "key"], "left_anti").select("doc_id")


@query("j25_raw_segment_lookup", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON CAST(o_orderkey AS VARCHAR) = split_part(l_orderkey || '_' || l_linenumber, '_', 1)")
def j25(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("raw"), "o_orderstatus")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.substring_index(F.concat_ws("_", "l_orderkey", "l_linenumber"), "_", 1).alias("raw"))
    return li.join(o, "raw").drop("raw")


#: A zone for each supplier: twelve corners about its centre and a hole of four; some centres lie near the antimeridian.
_SHAPE = [(40, 0), (34, 13), (26, 31), (9, 30), (0, 41), (-15, 28), (-33, 30), (-28, 8), (-41, -3), (-29, -21), (-2, -38), (27, -19)]
_HOLE = [(12, 0), (0, 14), (-11, 1), (1, -13)]
_CORNERS = ", ".join(f"({r}, {i}, {x}, {y})" for r, ring in enumerate((_SHAPE, _HOLE)) for i, (x, y) in enumerate(ring))
_SCALE = "(1 + s_suppkey % 5)"
_ZONES = f"""corner(ring, seq, dx, dy) AS (VALUES {_CORNERS}), vx AS (SELECT s_suppkey AS zone, ring, seq, (s_suppkey * 7919 % 36000 + dx * {_SCALE} * 3)::DOUBLE / 100 - 180 AS x, (s_suppkey * 104729 % 13000 + dy * {_SCALE} * 3)::DOUBLE / 100 - 65 AS y FROM supplier, corner),
  ze AS (SELECT zone, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM vx WINDOW w AS (PARTITION BY zone, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  wp AS (SELECT event_id AS id, (event_id * 7907 % 36000)::DOUBLE / 100 + 0.005 - 180 AS lng, (event_id * 6397 % 14000)::DOUBLE / 100 + 0.005 - 70 AS lat FROM events)"""


def zone_rings(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("zone")).withColumn("c", F.explode(F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(i).alias("seq"), F.lit(x).cast("bigint").alias("dx"), F.lit(y).cast("bigint").alias("dy")) for r, ring in enumerate((_SHAPE, _HOLE)) for i, (x, y) in enumerate(ring))))).select("zone", "c.*")
    wide = 1 + F.col("zone") % 5
    x = (F.col("zone") * 7919 % 36000 + F.col("dx") * wide * 3).cast("double") / 100 - 180
    y = (F.col("zone") * 104729 % 13000 + F.col("dy") * wide * 3).cast("double") / 100 - 65
    return s.select("zone", "ring", "seq", (F.pmod(x + 180.0, F.lit(360.0)) - 180.0).alias("lng"), y.alias("lat"))


@query("j19_zone_of_point", f"""WITH {_ZONES}, t AS (SELECT wp.id, zone, count(*) % 2 AS odd FROM wp, range(-1, 2) q(turn), ze WHERE (y1 > lat) <> (y2 > lat) AND lng + 360 * turn < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY wp.id, zone, turn)
  SELECT wp.id, min(zone) AS zone FROM wp LEFT JOIN t ON t.id = wp.id AND odd = 1 GROUP BY wp.id""")
def j19z(spark, d):
    """The zone of points all over the globe, of as many rings as suppliers, with holes, some across the antimeridian."""
    k = F.col("event_id")
    points = read(spark, d, "events").select(k.alias("id"), ((k * 7907 % 36000).cast("double") / 100 + 0.005 - 180).alias("lng"), ((k * 6397 % 14000).cast("double") / 100 + 0.005 - 70).alias("lat"))
    return Z.zone_of_point(points, Z.zone_index(Z.ring_edges(zone_rings(spark, d))), "id").select("id", "zone")
