"""Queries of the sequence operators and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions import geo
from trekframe.operators import composite as C
from trekframe.operators import joins as J
from trekframe.operators import playback as PB
from trekframe.operators import routes as R
from trekframe.operators import sequence as S

from .base import MODES, PINGS, STAYS, hav, pings, query, read, stays

_W = "WINDOW w AS (PARTITION BY trip ORDER BY ts_ms, id)"


@query("w1_sessions", f"WITH {PINGS}, f AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER w > 7200000, true) AS new FROM pings {_W}) SELECT id, trip, CAST(sum(CAST(new AS INT)) OVER w AS BIGINT) AS session FROM f {_W}")
def w1(spark, d):
    return S.sessions(pings(spark, d), ["trip"], "ts_ms", "id").select("id", "trip", "session")


_STEP = hav("lag(lat) OVER w", "lag(lng) OVER w", "lat", "lng")
_DWELL = f"f AS (SELECT *, NOT coalesce({_STEP} < 100 AND ts_ms - lag(ts_ms) OVER w < 1800000, false) AS new FROM pings WINDOW w AS (PARTITION BY day ORDER BY ts_ms, id)), c AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY day ORDER BY ts_ms, id) AS BIGINT) AS cluster FROM f)"


@query("w2_dwell_clusters", f"WITH {PINGS}, {_DWELL} SELECT id, day, cluster FROM c")
def w2(spark, d):
    return S.dwell_clusters(pings(spark, d), ["day"], "ts_ms", "id").select("id", "day", "cluster")


@query("g8_g9_a3_dwell_or_move", f"""WITH {PINGS}, {_DWELL}, m AS (SELECT *, avg(lat) OVER g AS clat, degrees(atan2(avg(sin(radians(lng))) OVER g, avg(cos(radians(lng))) OVER g)) AS clng, first(lat) OVER o AS lat0, first(lng) OVER o AS lng0, last(lat) OVER o AS lat1, last(lng) OVER o AS lng1 FROM c
    WINDOW g AS (PARTITION BY day, cluster), o AS (PARTITION BY day, cluster ORDER BY ts_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  s AS (SELECT day, cluster, count(*) AS n, max(ts_ms) - min(ts_ms) AS ms, any_value(clat) AS clat, any_value(clng) AS clng, max({hav('clat', 'clng', 'lat', 'lng')}) AS radius, any_value({hav('lat0', 'lng0', 'lat1', 'lng1')}) AS net FROM m GROUP BY day, cluster)
  SELECT day, cluster, n, round(clat, 6) AS lat, round(clng, 6) AS lng, round(radius, 2) AS radius, CASE WHEN ms >= 600000 AND radius <= 150 AND net <= 100 AND (net / greatest(1, ms / 1000) <= 0.6 OR net <= 60) THEN 'VISIT' WHEN n >= 2 OR net > 50 THEN 'MOVEMENT' ELSE 'NONE' END AS kind FROM s""")
def a3(spark, d):
    """A3 with G8, G9: clusters of points are stays or movements."""
    c = S.dwell_clusters(pings(spark, d), ["day"], "ts_ms", "id")
    from trekframe.operators.composite import cluster_stats

    s = cluster_stats(c, ["day", "cluster"], "ts_ms", "id")
    return s.select("day", "cluster", "n", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("radius", 2).alias("radius"), "kind")


_ISL = "f AS (SELECT *, NOT coalesce(start_ms < max(end_ms) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new FROM stays), isl AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS BIGINT) AS island FROM f)"


@query("w3_islands", f"WITH {STAYS}, {_ISL} SELECT trip, id, island FROM isl")
def w3(spark, d):
    return S.islands(stays(spark, d), ["trip"], ["id"]).select("trip", "id", "island")


@query("w4_atomic_intervals", f"""WITH {STAYS}, {_ISL}, b AS (SELECT DISTINCT trip, island, unnest([start_ms, end_ms]) AS a FROM isl), t AS (SELECT *, lead(a) OVER (PARTITION BY trip, island ORDER BY a) AS b FROM b)
  SELECT t.trip, t.island, t.a, t.b, count(*) AS candidates FROM t JOIN isl ON isl.trip = t.trip AND isl.island = t.island AND start_ms <= t.a AND end_ms >= t.b WHERE t.b IS NOT NULL GROUP BY ALL""")
def w4(spark, d):
    return S.atomic_counts(S.islands(stays(spark, d), ["trip"], ["id"]), ["trip", "island"])


_NB = f"""n AS (SELECT trip, id, lead(start_ms) OVER w - end_ms AS gap, {hav('lat', 'lng', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS jump FROM stays WINDOW w AS (PARTITION BY trip ORDER BY start_ms, end_ms, id))"""


@query("w5_w6_w7_g6_diagnostics", f"""WITH {STAYS}, {_NB} SELECT trip, count(*) FILTER (gap < 0) AS violations, count(*) FILTER (gap BETWEEN 0 AND 1000 AND jump > 500) AS discontinuities, count(*) FILTER (jump BETWEEN 1 AND 500 AND gap >= 0) AS connectors,
  count(*) FILTER (jump > 5000 OR gap > 3600000) AS true_gaps, count(*) FILTER (gap BETWEEN 0 AND 300000 AND jump > 1000 AND (gap <= 1000 OR jump / (gap / 1000) > 150)) AS backtracks FROM n GROUP BY trip""")
def w5(spark, d):
    n = S.neighbours(stays(spark, d), ["trip"], ["id"])
    return n.groupBy("trip").agg(*(F.count_if(k).alias(a) for k, a in (("violation", "violations"), ("discontinuity", "discontinuities"), ("connector", "connectors"), ("true_gap", "true_gaps"), ("backtrack", "backtracks"))))


@query("w8_merged_episodes", f"""WITH {STAYS}, f AS (SELECT *, NOT coalesce(lag(mode) OVER w = mode AND mode <> 'AIRPLANE' AND start_ms - lag(end_ms) OVER w BETWEEN 0 AND 900000 AND {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} <= 50000, false) AS new FROM stays WINDOW w AS (PARTITION BY trip ORDER BY start_ms, end_ms, id)),
  e AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS BIGINT) AS episode FROM f)
  SELECT trip, episode, any_value(mode) AS mode, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM e GROUP BY trip, episode""")
def w8(spark, d):
    return S.merged_episodes(stays(spark, d), ["trip"], ["id"], most_m=50_000.0).drop("confidence")


_PTS = "list({'ts_ms': ts_ms, 'lat': lat, 'lng': lng} ORDER BY ts_ms, id)"


#: A traveller's week as one number.
WEEK = "trip * 10000 + ts_ms div 604800000"


def tracks(spark, d, alt: bool = False):
    """A traveller's points of a week in order, as an array."""
    p = pings(spark, d).withColumn("track", F.expr(WEEK)).withColumn("alt", (F.col("id") % 5 * 90).cast("double"))
    row = F.sort_array(F.collect_list(F.struct("ts_ms", "id", "lat", "lng", "alt")))
    return p.groupBy("track").agg(row.alias("points"))


_TRACK = "t AS (SELECT *, trip * 10000 + ts_ms // 604800000 AS track, (id % 5 * 90)::DOUBLE AS alt FROM pings)"


@query("w9_consecutive_dedupe", f"""WITH RECURSIVE {PINGS}, {_TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ts_ms, id) AS k FROM t),
  g AS (SELECT track, k, lat, lng, 1 AS kept FROM r WHERE k = 1 UNION ALL SELECT r.track, r.k, CASE WHEN {hav('g.lat', 'g.lng', 'r.lat', 'r.lng')} >= 25 THEN r.lat ELSE g.lat END, CASE WHEN {hav('g.lat', 'g.lng', 'r.lat', 'r.lng')} >= 25 THEN r.lng ELSE g.lng END, CASE WHEN {hav('g.lat', 'g.lng', 'r.lat', 'r.lng')} >= 25 THEN 1 ELSE 0 END FROM g JOIN r ON r.track = g.track AND r.k = g.k + 1)
  SELECT track, CAST(sum(kept) AS INT) AS kept FROM g GROUP BY track""")
def w9(spark, d):
    return tracks(spark, d).select("track", F.size(S.dedupe_points("points", 25.0)).alias("kept"))


@query("w10_w13_clean_and_measure", f"""WITH {PINGS}, {_TRACK}, s AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id))
  SELECT track, CAST(count(*) FILTER (step IS NULL OR step > 0.5) AS INT) AS kept, round(coalesce(sum(step), 0), 3) AS metres, round(coalesce(sum(step), 0), 2) AS run FROM s GROUP BY track""")
def w10(spark, d):
    return tracks(spark, d).select("track", F.size(S.clean_points("points")).alias("kept"), F.round(S.path_length("points"), 3).alias("metres"), F.round(F.element_at(S.cumulative("points"), -1), 2).alias("run"))


_TO = "radians(-73.99 - lng) * cos(radians((lat + lat2) / 2)) * 6371000.0 AS x, radians(40.5 - lat) * 6371000.0 AS y, radians(lng2 - lng) * cos(radians((lat + lat2) / 2)) * 6371000.0 AS x2, radians(lat2 - lat) * 6371000.0 AS y2"


@query("p6_path_distance", f"""WITH {PINGS}, {_TRACK}, n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, count(*) OVER (PARTITION BY track) AS k FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)), v AS (SELECT *, {_TO} FROM n),
  f AS (SELECT *, CASE WHEN x2 * x2 + y2 * y2 > 0 THEN least(1.0, greatest(0.0, (x * x2 + y * y2) / (x2 * x2 + y2 * y2))) ELSE 0 END AS t FROM v)
  SELECT track, round(min(CASE WHEN k = 1 THEN {hav('40.5', '-73.99', 'lat', 'lng')} WHEN lat2 IS NOT NULL THEN sqrt(pow(x - t * x2, 2) + pow(y - t * y2, 2)) END), 2) AS metres FROM f GROUP BY track""")
def p6(spark, d):
    return tracks(spark, d).select("track", F.round(S.distance_to_path(F.lit(40.5), F.lit(-73.99), "points"), 2).alias("metres"))


@query("p7_display_route", f"""WITH {PINGS}, {_TRACK}, s AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} / greatest(0.001, (ts_ms - lag(ts_ms) OVER w) / 1000) AS v0, {hav('lat', 'lng', 'lead(lat) OVER w', 'lead(lng) OVER w')} / greatest(0.001, (lead(ts_ms) OVER w - ts_ms) / 1000) AS v1, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS chord FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)),
  k AS (SELECT * FROM s WHERE NOT coalesce(v0 > CASE WHEN track % 2 = 0 THEN 400 ELSE 100 END AND v1 > CASE WHEN track % 2 = 0 THEN 400 ELSE 100 END AND chord < 500, false)), m AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM k WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)), n AS (SELECT track, count(*) FILTER (step IS NULL OR step > 0.5) AS n FROM m GROUP BY track)
  SELECT track, CAST(CASE WHEN track % 2 = 0 AND n <= 2 THEN 65 ELSE n END AS INT) AS n_points FROM n""")
def p7(spark, d):
    mode = F.when(F.col("track") % 2 == 0, "AIRPLANE").otherwise("CAR")
    routes = S.display_route(tracks(spark, d), "points", mode, F.get("points", F.lit(0)), F.element_at("points", -1))
    return routes.select("track", F.size("route").alias("n_points"))


@query("w11_w12_spikes", f"""WITH {PINGS}, {_TRACK}, s AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} / greatest(0.001, (ts_ms - lag(ts_ms) OVER w) / 1000) AS v0, {hav('lat', 'lng', 'lead(lat) OVER w', 'lead(lng) OVER w')} / greatest(0.001, (lead(ts_ms) OVER w - ts_ms) / 1000) AS v1, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS chord, lag(alt) OVER w AS a, lead(alt) OVER w AS b FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id))
  SELECT track, CAST(count(*) FILTER (NOT coalesce(v0 > 0.05 AND v1 > 0.05 AND chord < 500, false)) AS INT) AS kept, round(sum(CASE WHEN (alt - a > 100 AND alt - b > 100) OR (a - alt > 100 AND b - alt > 100) THEN (a + b) / 2 ELSE alt END), 3) AS altitude FROM s GROUP BY track""")
def w11(spark, d):
    t = tracks(spark, d)
    alt = F.aggregate(S.without_altitude_impulses("points"), F.lit(0.0), lambda a, x: a + x["alt"])
    return t.select("track", F.size(S.without_spikes("points", 0.05)).alias("kept"), F.round(alt, 3).alias("altitude"))


_B = "(degrees(atan2(sin(radians(nlng - lng)) * cos(radians(nlat)), cos(radians(lat)) * sin(radians(nlat)) - sin(radians(lat)) * cos(radians(nlat)) * cos(radians(nlng - lng)))) + 360)"


@query("w14_heading", f"""WITH {PINGS}, {_TRACK}, n AS (SELECT *, lead(lat) OVER w AS nlat, lead(lng) OVER w AS nlng FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)), b0 AS (SELECT *, fmod({_B}, 360.0) AS b FROM n),
  b1 AS (SELECT track, id, ts_ms, coalesce(b, lag(b) OVER w, 0) AS b FROM b0 WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)), d AS (SELECT *, coalesce(fmod(fmod(b - lag(b) OVER w + 180, 360) + 360, 360) - 180, b) AS turn FROM b1 WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)),
  u AS (SELECT *, sum(turn) OVER (PARTITION BY track ORDER BY ts_ms, id) AS u FROM d), h AS (SELECT id, 0.2 * coalesce(lag(u) OVER w, u) + 0.6 * u + 0.2 * coalesce(lead(u) OVER w, u) AS s FROM u WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id))
  SELECT id, round(sin(radians(s)), 4) + 0.0::DOUBLE AS s, round(cos(radians(s)), 4) + 0.0::DOUBLE AS c FROM h""")
def w14(spark, d):
    p = pings(spark, d).withColumn("track", F.expr(WEEK))
    h = S.heading_track(p, ["track"], ["ts_ms", "id"])
    return h.select("id", (F.round(F.sin(F.radians("heading")), 4) + 0.0).alias("s"), (F.round(F.cos(F.radians("heading")), 4) + 0.0).alias("c"))


@query("w15_monotonic", f"""WITH RECURSIVE {STAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS k FROM stays),
  g AS (SELECT trip, k, id, start_ms AS s, greatest(start_ms + 1000, end_ms) AS e FROM r WHERE k = 1 UNION ALL SELECT r.trip, r.k, r.id, greatest(r.start_ms, g.e), greatest(greatest(r.start_ms, g.e) + 1000, r.end_ms) FROM g JOIN r ON r.trip = g.trip AND r.k = g.k + 1)
  SELECT trip, id, s, e FROM g""")
def w15(spark, d):
    return S.monotonic(stays(spark, d), ["trip"], ["id"]).select("trip", "id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


@query("w16_story_offsets", f"""WITH {STAYS} SELECT trip, id, coalesce(sum(end_ms - start_ms) OVER w, 0)::BIGINT AS story_start, coalesce(sum(CASE WHEN mode = 'UNKNOWN' THEN 0 ELSE metres END) OVER w, 0)::DOUBLE AS start_m FROM stays WINDOW w AS (PARTITION BY trip ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w16(spark, d):
    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return stays(spark, d).select("trip", "id", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(w), F.lit(0)).alias("story_start"), F.coalesce(F.sum(F.when(F.col("mode") == "UNKNOWN", 0.0).otherwise(F.col("metres"))).over(w), F.lit(0.0)).alias("start_m"))


@query("w17_g18_unwrapped_view", """WITH e AS (SELECT event_id AS id, user_id AS trip, ts, (event_id * 97 % 360 - 180)::DOUBLE AS lng FROM events), d AS (SELECT *, lng - lag(lng) OVER (PARTITION BY trip ORDER BY ts, id) AS d FROM e),
  s AS (SELECT *, CASE WHEN d IS NULL THEN lng WHEN abs(d) <= 180 THEN d ELSE ((d + 180) % 360 + 360) % 360 - 180 END AS s FROM d), u AS (SELECT trip, id, sum(s) OVER (PARTITION BY trip ORDER BY ts, id) AS u FROM s) SELECT trip, min(u) AS low, max(u) AS high FROM u GROUP BY trip""")
def w17(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("trip"), "ts", (F.col("event_id") * 97 % 360 - 180).cast("double").alias("lng"))
    return S.unwrapped(e, ["trip"], ["ts", "id"]).groupBy("trip").agg(F.min("unwrapped").alias("low"), F.max("unwrapped").alias("high"))


@query("g18_viewport_reference", """WITH e AS (SELECT DISTINCT user_id AS trip, (event_id * 97 % 360)::DOUBLE AS x FROM events), g AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY trip ORDER BY x), first(x) OVER (PARTITION BY trip ORDER BY x) + 360) AS nx FROM e)
  SELECT trip, arg_max(fmod(nx, 360), {'g': nx - x, 'x': -x}) AS west, 360 - max(nx - x) AS span FROM g GROUP BY trip""")
def g18(spark, d):
    """The view's western edge is where the largest gap between longitudes ends."""
    e = read(spark, d, "events").select(F.col("user_id").alias("trip"), (F.col("event_id") * 97 % 360).cast("double").alias("x")).distinct()
    w = Window.partitionBy("trip").orderBy("x")
    g = e.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(w) + 360))
    return g.groupBy("trip").agg(F.max_by(F.pmod("nx", F.lit(360.0)), F.struct(F.col("nx") - F.col("x"), -F.col("x"))).alias("west"), (360 - F.max(F.col("nx") - F.col("x"))).alias("span"))


@query("w19_k9_k10_budget", "WITH d AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS running FROM documents) SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM d WHERE running <= 20000")
def w19(spark, d):
    return J.running_budget(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "n_chars", 20_000, [F.desc("doc_id")], ["source"]).select("doc_id", "source", "running")


@query("p2_p3_position_at", f"""WITH {PINGS}, {_TRACK}, c AS (SELECT track, ts_ms, id, lat, lng, sum(coalesce(step, 0)) OVER (PARTITION BY track ORDER BY ts_ms, id) AS along FROM (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id))),
  n AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, lead(along) OVER w AS along2, max(along) OVER (PARTITION BY track) / 3 AS goal, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)),
  p AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY along DESC, k DESC) AS r FROM n WHERE along <= goal AND along2 IS NOT NULL)
  SELECT track, round(lat + (lat2 - lat) * CASE WHEN along2 > along THEN (goal - along) / (along2 - along) ELSE 0 END, 3) AS lat FROM p WHERE r = 1""")
def p2(spark, d):
    rows = tracks(spark, d).where(F.size("points") > 1)
    return S.at_fraction(rows, "points", F.lit(1 / 3)).select("track", F.round("position.lat", 3).alias("lat"))


@query("t1_trip_sort", "SELECT c_custkey, row_number() OVER (ORDER BY lower(c_name) DESC, c_custkey) AS by_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS by_created FROM customer ORDER BY by_name")
def t1(spark, d):
    """Two orders over all trips; each place is counted range by range."""
    from .sources_sinks import folder

    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.collate("c_name", "UNICODE_CI_AI").alias("key"))
    by_name = S.numbered(c, [F.desc("key"), F.col("c_custkey")], "by_name", folder(spark)).select("c_custkey", "by_name")
    by_created = S.numbered(c.drop("key"), [F.desc("c_acctbal"), F.col("c_custkey")], "by_created", folder(spark)).select("c_custkey", "by_created")
    return by_name.join(by_created, "c_custkey").orderBy("by_name")


@query("t11_card_order", f"WITH {STAYS} SELECT trip, id, part, row_number() OVER (ORDER BY trip % 7 DESC, trip, start_ms, id, part) AS place FROM stays")
def t11(spark, d):
    """Cards of all trips: those made last first, then by trip, start of the stay and its id; places are counted range by range."""
    from .sources_sinks import folder

    s = stays(spark, d).select("trip", "id", "part", "start_ms", (F.col("trip") % 7).alias("created"))
    return S.numbered(s, [F.desc("created"), F.asc("trip"), F.asc("start_ms"), F.asc("id"), F.asc("part")], "place", folder(spark)).select("trip", "id", "part", "place")


@query("t2_t3_t11_ordered_items", f"""WITH {STAYS} SELECT trip, id, row_number() OVER (PARTITION BY trip ORDER BY start_ms, end_ms, confidence DESC, id) AS r FROM stays""")
def t2(spark, d):
    return stays(spark, d).select("trip", "id", F.row_number().over(Window.partitionBy("trip").orderBy("start_ms", "end_ms", F.desc("confidence"), "id")).cast("bigint").alias("r"))


@query("t6_key_visits", f"""WITH {STAYS}, p AS (SELECT *, CASE WHEN id % 97 = 0 THEN 0 WHEN start_ms = min(start_ms) OVER (PARTITION BY trip) OR end_ms = max(end_ms) OVER (PARTITION BY trip) THEN 1 ELSE 2 END AS p FROM stays), k AS (SELECT trip, id, row_number() OVER (PARTITION BY trip ORDER BY p, end_ms - start_ms DESC, id) AS r FROM p) SELECT trip, id FROM k WHERE r <= 25""")
def t6(spark, d):
    """Required ones, then first and last, then the longest, up to 25 a trip."""
    t = Window.partitionBy("trip")
    rank = F.when(F.col("id") % 97 == 0, 0).when((F.col("start_ms") == F.min("start_ms").over(t)) | (F.col("end_ms") == F.max("end_ms").over(t)), 1).otherwise(2)
    s = stays(spark, d).withColumn("p", rank).withColumn("long", F.col("end_ms") - F.col("start_ms"))
    return s.withColumn("r", F.row_number().over(t.orderBy("p", F.desc("long"), "id"))).where("r <= 25").select("trip", "id")


@query("t9_top_labels", "SELECT user_id, list(event_id ORDER BY value DESC, event_id)[1:8] AS top FROM events WHERE value >= 65 GROUP BY user_id")
def t9(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    best = read(spark, d, "events").where("value >= 65").select("user_id", "event_id", "value").withColumn("r", F.row_number().over(w)).where("r <= 8")
    return best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", "event_id"))).alias("l")).select("user_id", F.transform("l", lambda x: x["event_id"]).alias("top"))


@query("t10_newest", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def t10(spark, d):
    return read(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(1000)


_A, _Z = "track % 10000 * 604800000 + 172800000", "track % 10000 * 604800000 + 432000000"


@query("p4_sliced_paths", f"""WITH {PINGS}, {_TRACK}, n AS (SELECT *, lead(ts_ms) OVER w AS ts2, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, first(lat) OVER w AS lat0, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)),
  cutat AS (SELECT track, unnest([0, 1]) AS side, unnest([{_A}, {_Z}]) AS at FROM (SELECT DISTINCT track FROM t)),
  ends AS (SELECT c.track, c.side, c.at, CASE WHEN min(n.ts_ms) >= c.at THEN arg_min(n.lat, n.k) WHEN max(n.ts_ms) < c.at THEN arg_max(n.lat, n.k) ELSE max(n.lat + (n.lat2 - n.lat) * (c.at - n.ts_ms) / greatest(1, n.ts2 - n.ts_ms)) FILTER (n.ts_ms < c.at AND n.ts2 >= c.at) END AS lat,
    CASE WHEN min(n.ts_ms) >= c.at THEN arg_min(n.lng, n.k) WHEN max(n.ts_ms) < c.at THEN arg_max(n.lng, n.k) ELSE max(n.lng + (n.lng2 - n.lng) * (c.at - n.ts_ms) / greatest(1, n.ts2 - n.ts_ms)) FILTER (n.ts_ms < c.at AND n.ts2 >= c.at) END AS lng FROM cutat c JOIN n ON n.track = c.track GROUP BY c.track, c.side, c.at),
  v AS (SELECT track, side AS g, 0 AS k, lat, lng FROM ends WHERE side = 0 UNION ALL SELECT track, 1, k, lat, lng FROM n WHERE ts_ms > {_A} AND ts_ms < {_Z} UNION ALL SELECT track, 2, 0, lat, lng FROM ends WHERE side = 1),
  s AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM v WINDOW w AS (PARTITION BY track ORDER BY g, k))
  SELECT track, CAST(greatest(2, count(*) FILTER (step IS NULL OR step > 1)) AS INT) AS n_points, round(max(lat) FILTER (g = 0), 3) AS first_lat, round(max(lat) FILTER (g = 2), 3) AS last_lat FROM s GROUP BY track""")
def p4(spark, d):
    """From the tenth to the fortieth minute of each track's track."""
    t = tracks(spark, d).withColumn("cut", C.sliced("points", F.expr(_A), F.expr(_Z)))
    return t.select("track", F.size("cut").alias("n_points"), F.round(F.get("cut", F.lit(0))["lat"], 3).alias("first_lat"), F.round(F.element_at("cut", -1)["lat"], 3).alias("last_lat"))


@query("p5_split_paths", f"""WITH {PINGS}, {_TRACK}, s AS (SELECT *, {hav('lat', 'lng', '40.5', '-73.9999')} AS far, coalesce({hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0) AS step, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY track ORDER BY ts_ms, id)), r AS (SELECT *, sum(step) OVER (PARTITION BY track ORDER BY k) AS run FROM s),
  h AS (SELECT track, count(*) AS n, min(far) AS near, arg_min(k, (far, k)) AS pos, max(run) AS total FROM r GROUP BY track), c AS (SELECT h.*, (SELECT count(*) FROM r WHERE r.track = h.track AND r.run <= h.total * 0.37::DOUBLE) AS k FROM h)
  SELECT track, CAST(CASE WHEN near <= 3000 THEN pos WHEN k >= n THEN n ELSE k + 1 END AS INT) AS n_before, CAST(CASE WHEN near <= 3000 THEN n - pos + 1 WHEN k >= n THEN 1 ELSE n - k + 1 END AS INT) AS n_after FROM c""")
def p5(spark, d):
    t = tracks(spark, d).withColumn("cut", C.split_at_place("points", F.lit(40.5), F.lit(-73.9999), F.lit(0.37)))
    return t.select("track", F.size("cut.before").alias("n_before"), F.size("cut.after").alias("n_after"))


def tours(spark, d):
    """A route for each customer: its orders in time, some metres apart; and its mode."""
    k, w = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders")
    paths = o.select((F.col("o_custkey") % 10).alias("trip"), F.col("o_custkey").alias("move"), F.row_number().over(w).cast("bigint").alias("seq"), F.lit(None).cast("bigint").alias("ts_ms"), ((400000 + k % 50 * 4).cast("double") / 10000).alias("lat"), ((-740000 + k * 7 % 50 * 4).cast("double") / 10000).alias("lng"))
    modes = paths.select("trip", "move").distinct().withColumn("mode", F.element_at(F.array(*map(F.lit, MODES)), (F.col("move") % 5 + 1).cast("int")))
    return modes, R.legs(paths)


_BEAR = "fmod(degrees(atan2(sin(radians({y} - {b})) * cos(radians({x})), cos(radians({a})) * sin(radians({x})) - sin(radians({a})) * cos(radians({x})) * cos(radians({y} - {b})))) + 360, 360.0)"
_TOUR = f"""pth AS (SELECT o_custkey AS move, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, (400000 + o_orderkey % 50 * 4)::DOUBLE / 10000 AS lat1, (-740000 + o_orderkey * 7 % 50 * 4)::DOUBLE / 10000 AS lng1 FROM orders),
  l0 AS (SELECT *, lead(lat1) OVER w AS lat2, lead(lng1) OVER w AS lng2 FROM pth WINDOW w AS (PARTITION BY move ORDER BY seq)), l1 AS (SELECT *, {hav('lat1', 'lng1', 'lat2', 'lng2')} AS metres FROM l0 WHERE lat2 IS NOT NULL),
  lg AS (SELECT *, coalesce(sum(metres) OVER (PARTITION BY move ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS run FROM l1), tot AS (SELECT p.move, coalesce(max(t), 0)::DOUBLE AS total, ['WALK', 'CAR', 'TRAIN', 'AIRPLANE', 'UNKNOWN'][CAST(p.move % 5 AS INT) + 1] AS mode FROM (SELECT DISTINCT move FROM pth) p LEFT JOIN (SELECT move, sum(metres) AS t FROM l1 GROUP BY move) q ON q.move = p.move GROUP BY p.move),
  st AS (SELECT *, greatest(5.0::DOUBLE, least(50.0::DOUBLE, total / 100)) AS step, CASE mode WHEN 'WALK' THEN 15 WHEN 'CAR' THEN 80 WHEN 'TRAIN' THEN 200 WHEN 'AIRPLANE' THEN 50000 ELSE 50 END::DOUBLE AS look FROM tot WHERE total >= 1),
  sm AS (SELECT move, look, total, i, least(i * step, total) AS d FROM (SELECT *, unnest(range(0, CAST(floor(round(total / step, 6)) AS BIGINT) + 2)) AS i FROM st)),
  qd AS (SELECT move, i, 0 AS w, d AS a FROM sm UNION ALL SELECT move, i, 1, least(d + look, total) FROM sm UNION ALL SELECT move, i, 2, greatest(d - look, 0) FROM sm),
  on_leg AS (SELECT q.*, lat1, lng1, lat2, lng2, metres / 6371000.0::DOUBLE AS ww, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (a - run) / metres)) AS f FROM qd q ASOF JOIN (SELECT * FROM lg WHERE metres > 0) l ON l.move = q.move AND q.a >= l.run),
  uv AS (SELECT *, sin((1 - f) * ww) / sin(ww) AS u, sin(f * ww) / sin(ww) AS v FROM on_leg), xyz AS (SELECT *, u * cos(radians(lat1)) * cos(radians(lng1)) + v * cos(radians(lat2)) * cos(radians(lng2)) AS x, u * cos(radians(lat1)) * sin(radians(lng1)) + v * cos(radians(lat2)) * sin(radians(lng2)) AS y, u * sin(radians(lat1)) + v * sin(radians(lat2)) AS z FROM uv),
  pos AS (SELECT move, i, w, a, CASE WHEN ww < 1e-9 THEN lat1 ELSE degrees(atan2(z, sqrt(x * x + y * y))) END AS lat, CASE WHEN ww < 1e-9 THEN lng1 ELSE degrees(atan2(y, x)) END AS lng FROM xyz),
  b0 AS (SELECT h.move, h.i, h.a AS d, CASE WHEN n.a - h.a >= 1.5 THEN {_BEAR.format(a='h.lat', b='h.lng', x='n.lat', y='n.lng')} WHEN h.a - p.a >= 1.5 THEN {_BEAR.format(a='p.lat', b='p.lng', x='h.lat', y='h.lng')} END AS b FROM pos h JOIN pos n ON n.move = h.move AND n.i = h.i AND n.w = 1 JOIN pos p ON p.move = h.move AND p.i = h.i AND p.w = 2 WHERE h.w = 0),
  b1 AS (SELECT move, i, d, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY move ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS b FROM b0),
  tn AS (SELECT *, coalesce(fmod(fmod(b - lag(b) OVER (PARTITION BY move ORDER BY i) + 180.01::DOUBLE, 360) + 360, 360) - 180.01::DOUBLE, b) AS turn FROM b1), un AS (SELECT *, sum(turn) OVER (PARTITION BY move ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM tn),
  hd AS (SELECT move, i, d, 0.2 * coalesce(lag(u) OVER w, u) + 0.6 * u + 0.2 * coalesce(lead(u) OVER w, u) AS h FROM un WINDOW w AS (PARTITION BY move ORDER BY i) UNION ALL SELECT move, 0, 0, 0 FROM tot WHERE total < 1)"""


@query("w14_heading_track", f"WITH {_TOUR} SELECT move, CAST(i AS BIGINT) AS i, round(d, 3) AS at, round(sin(radians(h)), 3) + 0.0::DOUBLE AS s, round(cos(radians(h)), 3) + 0.0::DOUBLE AS c FROM hd")
def w14t(spark, d):
    """Headings at equal distances, looking ahead along the route."""
    h = F.radians("heading")
    return PB.heading_samples(*tours(spark, d)).select("move", "i", F.round("at", 3).alias("at"), (F.round(F.sin(h), 3) + 0.0).alias("s"), (F.round(F.cos(h), 3) + 0.0).alias("c"))
