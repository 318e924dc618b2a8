"""Queries of the aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.timefn import millis

from .base import PINGS, STAYS, pings, query, read, stays


@query("g2_cards_to_trips", "SELECT o_custkey AS trip, count(*) AS visits, min(o_orderkey) AS first_visit, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def g2(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("trip")).agg(F.count("*").alias("visits"), F.min("o_orderkey").alias("first_visit"), F.sort_array(F.collect_list("o_orderkey")).alias("ids"))


@query("g1_g4_g22_counts_and_distances", f"WITH {STAYS}, e AS (SELECT trip, start_ms // 86400000 AS day, sum(metres) AS m, count(*) AS n FROM stays WHERE mode <> 'UNKNOWN' GROUP BY ALL) SELECT trip, sum(m) AS metres, CAST(sum(n) AS BIGINT) AS moves, count(*) AS days FROM e GROUP BY trip")
def g4(spark, d):
    e = stays(spark, d).where("mode <> 'UNKNOWN'").groupBy("trip", F.expr("start_ms div 86400000").alias("day")).agg(F.sum("metres").alias("m"), F.count("*").alias("n"))
    return e.groupBy("trip").agg(F.sum("m").alias("metres"), F.sum("n").alias("moves"), F.count("*").alias("days"))


@query("g5_pipeline_diagnostics", "SELECT event_type, count(*) AS scanned, count(*) FILTER (value > 50) AS eligible, count(*) FILTER (value > 90 AND user_id % 2 = 0) AS matched, count(DISTINCT user_id) AS owners, count(*) FILTER (props IS NULL) AS unknown FROM events GROUP BY event_type")
def g5(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("scanned"), F.count_if(F.col("value") > 50).alias("eligible"), F.count_if((F.col("value") > 90) & (F.col("user_id") % 2 == 0)).alias("matched"), F.count_distinct("user_id").alias("owners"), F.count_if(F.col("props").isNull()).alias("unknown"))


@query("g10_cluster_merge", f"""WITH {STAYS}, v AS (SELECT *, part % 50 = 0 OR id % 31 = 0 AS own, CASE WHEN id % 4 > 0 THEN 'place' WHEN id % 8 = 0 THEN ' unknown ' END AS name, id % 3 > 0 AS known FROM stays)
  SELECT trip, part % 500 AS k, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_max(id, {{'a': own, 'b': name = 'place', 'p': known, 'c': confidence, 'd': end_ms - start_ms, 'i': id}}) AS best, bool_or(own) AS any_override FROM (SELECT * REPLACE (coalesce(name, '') AS name) FROM v) GROUP BY trip, part % 500""")
def g10(spark, d):
    """The best record by six keys: a user's name, a name, a place id, confidence, length, id."""
    k, i = F.col("part"), F.col("id")
    name = F.when(i % 4 > 0, "place").when(i % 8 == 0, " unknown ")
    named = F.coalesce((F.trim(name) != "") & (F.upper(F.trim(name)) != "UNKNOWN"), F.lit(False))
    s = stays(spark, d).withColumns({"own": (k % 50 == 0) | (i % 31 == 0), "named": named, "known": i % 3 > 0, "k": k % 500})
    best = F.max_by("id", F.struct("own", "named", "known", "confidence", (F.col("end_ms") - F.col("start_ms")).alias("d"), "id"))
    return s.groupBy("trip", "k").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), best.alias("best"), F.bool_or("own").alias("any_override"))


@query("g11_distinct_first_wins", f"WITH {PINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip, lat, lng ORDER BY ts_ms, id) AS r FROM pings) SELECT id FROM r WHERE r = 1")
def g11(spark, d):
    w = Window.partitionBy("trip", "lat", "lng").orderBy("ts_ms", "id")
    return pings(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("id")


@query("g12_zone_consensus", """WITH z AS (SELECT unnest(['America/New_York', 'Asia/Tokyo', 'UTC']) AS z, unnest([1, 2, 0]) AS k), c AS (SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE z AS DATE) AS day FROM events LEFT JOIN z ON event_id % 3 >= k)
  SELECT event_id, CASE WHEN count(DISTINCT day) = 1 THEN 'CONSENSUS' WHEN count(DISTINCT day) = 0 THEN 'UNKNOWN' ELSE 'AMBIGUOUS' END AS status, CASE WHEN count(DISTINCT day) = 1 THEN min(day) END AS day FROM c GROUP BY event_id""")
def g12(spark, d):
    from trekframe.functions.timefn import local_date

    zones = F.filter(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(k).alias("k")) for z, k in (("America/New_York", 1), ("Asia/Tokyo", 2), ("UTC", 0)))), lambda x: x["k"] <= F.col("event_id") % 3)
    ms = millis("ts")
    days = F.array_distinct(F.transform(zones, lambda x: local_date(ms, x["z"])))
    e = read(spark, d, "events").select("event_id", days.alias("days"))
    return e.select("event_id", F.when(F.size("days") == 1, "CONSENSUS").when(F.size("days") == 0, "UNKNOWN").otherwise("AMBIGUOUS").alias("status"), F.when(F.size("days") == 1, F.col("days")[0]).alias("day"))


@query("g13_day_coverage", f"WITH {STAYS}, a AS (SELECT start_ms // 86400000 AS day, part, count(*) AS n FROM stays GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, part) AS r FROM a) SELECT day, CAST(sum(n) AS BIGINT) AS items, list(part ORDER BY r) FILTER (r <= 5) AS top FROM r GROUP BY day")
def g13(spark, d):
    a = stays(spark, d).groupBy(F.expr("start_ms div 86400000").alias("day"), "part").agg(F.count("*").alias("n"))
    r = a.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "part")))
    top = F.sort_array(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "part"))))
    return r.groupBy("day").agg(F.sum("n").alias("items"), F.transform(top, lambda x: x["part"]).alias("top"))


@query("g14_g15_anchor_scores", f"""WITH {STAYS}, s AS (SELECT *, part % 4 AS clusters, part % 9 AS photos, end_ms - start_ms AS ms, metres * 3 AS dist FROM stays),
  c AS (SELECT *, least(2000, ms // 60000 * 10) + clusters * 700 + least(1000, photos * 40) + CASE WHEN dist >= 50000 THEN 1500 ELSE 0 END + CASE WHEN dist >= 100000 THEN 800 ELSE 0 END + CASE WHEN id % 50 = 0 THEN 3000 ELSE 0 END + CASE WHEN part % 3 > 0 THEN 500 ELSE 0 END + CASE WHEN ms >= 21600000 THEN 1500 ELSE 0 END - CASE WHEN ms < 2400000 AND id % 50 <> 0 AND clusters <= 1 AND dist < 50000 THEN 1800 ELSE 0 END AS score FROM s)
  SELECT id, trip, score, score >= 2000 OR photos >= 5 OR id % 50 = 0 OR ms >= 10800000 OR (dist >= 80000 AND clusters > 0) AS important, CASE WHEN photos > 0 AND clusters = 0 THEN 'NO_VALID_CLUSTER' END AS excluded FROM c""")
def g14(spark, d):
    from trekframe.operators.story import anchor_score

    s = stays(spark, d).withColumns({"clusters": F.col("part") % 4, "photos": F.col("part") % 9, "ms": F.col("end_ms") - F.col("start_ms"), "dist": F.col("metres") * 3})
    got = anchor_score("ms", "clusters", "photos", "photos", "dist", F.col("id") % 50 == 0, F.col("part") % 3 > 0, F.lit(False))
    return s.withColumn("g", got).select("id", "trip", "g.score", "g.important", F.when((F.col("photos") > 0) & (F.col("clusters") == 0), "NO_VALID_CLUSTER").alias("excluded"))


@query("g16_top_candidate", f"WITH {STAYS}, m AS (SELECT trip, part, max(confidence) AS top FROM stays GROUP BY ALL) SELECT s.trip, s.part, CASE WHEN count(*) > 1 THEN NULL ELSE min(id) END AS winner, count(*) AS ties FROM stays s JOIN m ON m.trip = s.trip AND m.part = s.part AND confidence = top GROUP BY ALL")
def g16(spark, d):
    w = Window.partitionBy("trip", "part")
    s = stays(spark, d).withColumn("top", F.max("confidence").over(w)).where("confidence = top")
    return s.groupBy("trip", "part").agg(F.when(F.count("*") == 1, F.min("id")).alias("winner"), F.count("*").alias("ties"))


@query("g17_title", "WITH n AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, array_to_string(list(p ORDER BY k)[1:5], ', ') AS title FROM n GROUP BY o_custkey")
def g17(spark, d):
    l = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    names = F.slice(F.array_distinct(F.transform(l, lambda x: x["o_orderpriority"])), 1, 5)
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(names, ", ").alias("title"))


@query("g19_ring_boxes", f"WITH {STAYS} SELECT trip, min(lat) AS y0, max(lat) AS y1, min(lng) AS x0, max(lng) AS x1 FROM stays GROUP BY trip")
def g19(spark, d):
    p = stays(spark, d).groupBy("trip").agg(F.collect_list(F.struct("lat", "lng")).alias("ring"))
    take = lambda f, k: f(F.transform("ring", lambda x: x[k]))
    return p.select("trip", take(F.array_min, "lat").alias("y0"), take(F.array_max, "lat").alias("y1"), take(F.array_min, "lng").alias("x0"), take(F.array_max, "lng").alias("x1"))


@query("g21_suppression_counts", f"WITH {STAYS}, m AS (SELECT *, max(confidence) OVER (PARTITION BY trip, part) AS top FROM stays) SELECT CASE WHEN mode = 'UNKNOWN' THEN 'NO_MODE' WHEN confidence < top THEN 'LOWER_CONFIDENCE' ELSE 'KEPT' END AS reason, count(*) AS n FROM m GROUP BY reason")
def g21(spark, d):
    m = stays(spark, d).withColumn("top", F.max("confidence").over(Window.partitionBy("trip", "part")))
    return m.groupBy(F.when(F.col("mode") == "UNKNOWN", "NO_MODE").when(F.col("confidence") < F.col("top"), "LOWER_CONFIDENCE").otherwise("KEPT").alias("reason")).agg(F.count("*").alias("n"))


@query("g23_map_priority", f"""WITH {STAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS a, row_number() OVER (PARTITION BY trip ORDER BY start_ms DESC, end_ms DESC, id DESC) AS z FROM stays)
  SELECT id, trip, CASE WHEN id % 500 = 1 THEN 1000 WHEN a = 1 THEN 900 WHEN z = 1 THEN 800 WHEN id % 50 = 0 THEN 700 WHEN part % 9 > 0 THEN 500 + part % 9 ELSE (end_ms - start_ms) // 3600000 END AS priority FROM r""")
def g23(spark, d):
    first = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id")
    last = Window.partitionBy("trip").orderBy(F.desc("start_ms"), F.desc("end_ms"), F.desc("id"))
    s = stays(spark, d).withColumns({"a": F.row_number().over(first), "z": F.row_number().over(last)})
    k = F.when(F.col("id") % 500 == 1, 1000).when(F.col("a") == 1, 900).when(F.col("z") == 1, 800).when(F.col("id") % 50 == 0, 700).when(F.col("part") % 9 > 0, 500 + F.col("part") % 9).otherwise(F.expr("(end_ms - start_ms) div 3600000"))
    return s.select("id", "trip", k.alias("priority"))


@query("set_operations", f"""WITH {STAYS}, w AS (SELECT DISTINCT trip, start_ms // 86400000 AS day FROM stays WHERE mode = 'WALK'), c AS (SELECT DISTINCT trip, start_ms // 86400000 AS day FROM stays WHERE mode = 'CAR')
  SELECT 'either' AS kind, count(*) AS n FROM (FROM w UNION FROM c) UNION ALL SELECT 'both', count(*) FROM (FROM w INTERSECT FROM c) UNION ALL SELECT 'walk only', count(*) FROM (FROM w EXCEPT FROM c)""")
def sets(spark, d):
    s = stays(spark, d).withColumn("day", F.expr("start_ms div 86400000"))
    w, c = (s.where(F.col("mode") == m).select("trip", "day") for m in ("WALK", "CAR"))
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(w.union(c).distinct(), "either").union(n(w.intersect(c), "both")).union(n(w.distinct().join(c, ["trip", "day"], "left_anti"), "walk only"))


@query("f25_flatten_days", "WITH n AS (SELECT o_custkey, o_orderkey, unnest([o_orderkey % 7, o_orderkey % 5, o_orderkey % 7]) AS item FROM orders) SELECT DISTINCT o_custkey, item FROM n")
def f25(spark, d):
    k = F.col("o_orderkey")
    days = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", F.array(k % 7, k % 5, k % 7).alias("items"))).alias("days"))
    return days.select("o_custkey", F.explode("days").alias("day")).select("o_custkey", F.explode("day.items").alias("item")).dropDuplicates(["o_custkey", "item"])
