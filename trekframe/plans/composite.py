"""Queries of the grouped kernels.  Where SQL can't say the same, tests compare with golden cases and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.operators import composite as C
from trekframe.operators import moments as MO
from trekframe.operators import joins as J
from trekframe.operators import sequence as S

from .base import STAYS, hav, query, read, stays
from .joins import _AT


def visits(spark, d):
    k = F.col("part")
    return stays(spark, d).select("trip", "id", F.when(k % 4 > 0, F.concat(F.lit("place "), (k % 7).cast("string"))).alias("name"), F.when(k % 3 > 0, F.concat(F.lit("id"), (k % 11).cast("string"))).alias("place_id"), "lat", "lng", "start_ms", "end_ms", "confidence", (k % 50 == 0).alias("is_override"))


@query("j13_one_stay_pairs", f"""WITH {STAYS}, v AS (SELECT trip, id * 1000000 + part AS id, lat, lng, start_ms, end_ms FROM stays), p AS (SELECT a.trip, a.id AS a, b.id AS b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS shared, greatest(1, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)) AS shorter, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS far, abs(a.start_ms - b.start_ms) <= 10000 AND abs(a.end_ms - b.end_ms) <= 10000 AS same
    FROM v a JOIN v b ON a.trip = b.trip AND a.end_ms + 10002 > b.start_ms AND b.end_ms + 10002 > a.start_ms AND (a.start_ms, a.end_ms, a.id) < (b.start_ms, b.end_ms, b.id))
  SELECT trip, a, b FROM p WHERE same OR (shared > 0 AND ((shared / shorter >= 0.9 AND far <= 1500) OR (shared / shorter >= 0.5 AND far <= 500) OR (shared >= 600000 AND far <= 500)))""")
def j13(spark, d):
    s = stays(spark, d)
    return C.one_stay_pairs(s.select("trip", (F.col("id") * 1_000_000 + F.col("part")).alias("id"), "lat", "lng", "start_ms", "end_ms"))


@query("a4_canonical_stays")
def a4(spark, d):
    return C.canonicalise_stays(visits(spark, d)).drop("island")


@query("a4_no_overlap", f"WITH {STAYS} SELECT trip, min(start_ms) AS first_ms, 0::BIGINT AS overlaps FROM stays GROUP BY trip")
def a4b(spark, d):
    """Of each trip: no stay overlaps another, and the first begins where the first record does."""
    n = S.neighbours(C.canonicalise_stays(visits(spark, d)), ["trip"], ["id"])
    return n.groupBy("trip").agg(F.min("start_ms").alias("first_ms"), F.count_if("violation").alias("overlaps"))


def moves(spark, d):
    """Movements with timed points, with a bare path and without; ids are made unique."""
    k = F.col("part")
    origin = F.element_at(F.array(*map(F.lit, ["OBSERVED", "SIMPLIFIED_OBSERVED", "UNKNOWN"])), (k % 3 + 1).cast("int"))
    ms = F.col("end_ms") - F.col("start_ms")
    point = lambda f, timed: F.struct((F.when(F.lit(timed), F.col("start_ms") + (ms * f).cast("bigint"))).alias("ts_ms"), (F.col("lat") + 0.01 * f).alias("lat"), (F.col("lng") + 0.01 * f * f).alias("lng"))
    path = F.when(k % 4 == 0, F.array(*(point(f, True) for f in (0.0, 0.25, 0.5, 1.0)))).when(k % 4 == 1, F.array(*(point(f, False) for f in (0.0, 0.5, 1.0)))).cast(C.PATH)
    return stays(spark, d).select("trip", (F.col("id") * 1_000_000 + k).alias("id"), "mode", "lat", "lng", (F.col("lat") + 0.01).alias("lat2"), (F.col("lng") + 0.01).alias("lng2"), "start_ms", "end_ms", "confidence", (k % 60 == 7).alias("is_override"), origin.alias("provenance"), path.alias("path"))


@query("a5_canonical_moves")
def a5(spark, d):
    """Viterbi over candidates is beyond SQL; what it covers is checked by a5_no_overlap, its choices by tests against all paths."""
    return C.canonicalise_moves(moves(spark, d)).drop("island").withColumn("path", F.size("path"))


@query("a5_no_overlap", f"""WITH {STAYS}, o AS (SELECT trip, start_ms, end_ms, coalesce(max(end_ms) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_ms) AS seen FROM stays)
  SELECT trip, CAST(sum(greatest(0, end_ms - greatest(start_ms, seen))) AS BIGINT) AS covered_ms, 0::BIGINT AS overlaps FROM o GROUP BY trip""")
def a5b(spark, d):
    """Of each trip: movements cover just the time that the records cover, once."""
    n = S.neighbours(C.canonicalise_moves(moves(spark, d)), ["trip"], ["id"])
    return n.groupBy("trip").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.count_if("violation").alias("overlaps"))


@query("a5_w8_merged_moves")
def a5c(spark, d):
    """The chosen movements, with neighbours of one mode joined."""
    return S.merged_episodes(C.canonicalise_moves(moves(spark, d)), ["trip"], ["id"]).select("trip", "episode", "mode", "start_ms", "end_ms", "members")


@query("g6_canonical_diagnostics")
def g6(spark, d):
    """All counters of each trip; they hang on the choices of a5, so tests compare them with a slow version."""
    m = moves(spark, d)
    g = C.canonical_diagnostics(C.canonicalise_with_records(m), m)
    return g.withColumns({c: F.concat_ws("; ", c) for c in ("discontinuity_notes", "backtrack_notes")})


@query("g6_accounts", f"""WITH {STAYS}, m AS (SELECT trip, id * 1000000 + part AS id, start_ms, end_ms FROM stays), f AS (SELECT *, NOT coalesce(start_ms < max(end_ms) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new FROM m),
  i AS (SELECT trip, island, count(*) AS n FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS island FROM f) GROUP BY trip, island)
  SELECT trip, CAST(sum(n) AS BIGINT) AS raw, count(*) FILTER (n > 1) AS groups, CAST(sum(n) AS BIGINT) AS accounted, 0::BIGINT AS violations FROM i GROUP BY trip""")
def g6b(spark, d):
    """What SQL can say of the records: every movement either stays or has a record, and none overlaps another."""
    r = C.canonicalise_with_records(moves(spark, d))
    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id")
    kept = r.where("reason IS NULL").withColumn("over", F.coalesce(F.lead("start_ms").over(w) < F.col("end_ms"), F.lit(False)))
    a = kept.groupBy("trip").agg(F.sum("n_raw").alias("raw"), F.sum("n_groups").alias("groups"), (F.count_distinct("id") + F.sum("n_gone")).alias("accounted"), F.count_if("over").alias("violations"))
    return a


_CHANGE = "CASE WHEN p.id = q.id THEN 0.0::DOUBLE WHEN {far} > 1500 THEN '-infinity'::DOUBLE ELSE (CASE WHEN p.mode = q.mode THEN -15 ELSE -40 END)::DOUBLE - 0.05::DOUBLE * {far} END".format(far=hav("p.lat", "p.lng", "q.lat", "q.lng"))
_FAR = hav("p.lat", "p.lng", "q.lat", "q.lng")
#: Movements that stand still, at most half a kilometre apart, so that SQL can place them at every boundary; their worths differ, so that no two paths tie.
_VITERBI = f"""{STAYS}, m AS (SELECT trip, (id * 1000000 + part) * 10000 + start_ms // 86400000 % 10000 AS id, mode, 40 + (lat - 40) / 200 AS lat, -74 + (lng + 74) / 200 AS lng, start_ms, end_ms, CASE part % 3 WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE 10 END::DOUBLE * CASE WHEN part % 60 = 7 THEN 1.5::DOUBLE ELSE confidence::DOUBLE + (part * 7 + id % 1009)::DOUBLE * 1e-7::DOUBLE END AS own FROM stays),
  f AS (SELECT *, NOT coalesce(start_ms < max(end_ms) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS new FROM m), i AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS BIGINT) AS island FROM f),
  cut AS (SELECT DISTINCT trip, island, unnest([start_ms, end_ms]) AS a FROM i), iv0 AS (SELECT *, lead(a) OVER (PARTITION BY trip, island ORDER BY a) AS b FROM cut), iv AS (SELECT *, row_number() OVER (PARTITION BY trip, island ORDER BY a) AS k FROM iv0 WHERE b IS NOT NULL),
  ca AS (SELECT iv.trip, iv.island, k, a, b, list({{'id': id, 'mode': mode, 'lat': lat, 'lng': lng, 'worth': own * (b - a)::DOUBLE / greatest(1, end_ms - start_ms)}} ORDER BY start_ms, end_ms, id) AS cs FROM iv JOIN i ON i.trip = iv.trip AND i.island = iv.island AND start_ms <= a AND end_ms >= b GROUP BY ALL),
  g AS (SELECT trip, island, k, cs, list_transform(cs, lambda c: c.worth) AS score, [0]::BIGINT[] AS back FROM ca WHERE k = 1
    UNION ALL SELECT trip, island, k, cs, list_transform(come, lambda t, j: list_max(t) + cs[j].worth), list_transform(come, lambda t: CAST(list_position(t, list_max(t)) AS BIGINT)) FROM (
      SELECT ca.trip, ca.island, ca.k, ca.cs, list_transform(ca.cs, lambda q: list_transform(g.cs, lambda p, i: g.score[i] + {_CHANGE})) AS come FROM g JOIN ca ON ca.trip = g.trip AND ca.island = g.island AND ca.k = g.k + 1)),
  en AS (SELECT trip, island, max(k) AS k FROM g GROUP BY trip, island),
  w AS (SELECT g.trip, g.island, g.k, CAST(list_position(score, list_max(score)) AS BIGINT) AS n, list_max(score) AS top FROM g JOIN en ON en.trip = g.trip AND en.island = g.island AND en.k = g.k
    UNION ALL SELECT w.trip, w.island, w.k - 1, g.back[w.n], w.top FROM w JOIN g ON g.trip = w.trip AND g.island = w.island AND g.k = w.k WHERE w.k > 1),
  ch AS (SELECT w.trip, w.island, w.k, w.top, ca.a, ca.b, ca.cs, ca.cs[w.n] AS q, lag(ca.cs[w.n]) OVER (PARTITION BY w.trip, w.island ORDER BY w.k) AS p FROM w JOIN ca ON ca.trip = w.trip AND ca.island = w.island AND ca.k = w.k),
  rp AS (SELECT trip, island, bool_or(top = '-infinity'::DOUBLE OR coalesce(p.id <> q.id AND {_FAR} > 500, false)) AS repaired FROM ch GROUP BY trip, island),
  be AS (SELECT trip, island, arg_min(id, (-own * (end_ms > start_ms)::INT, start_ms, end_ms, id)) AS best FROM i GROUP BY trip, island),
  pk AS (SELECT ch.trip, ch.island, k, a, b, cs, CASE WHEN NOT repaired THEN q.id WHEN list_contains(list_transform(cs, lambda c: c.id), best) THEN best ELSE cs[list_position(list_transform(cs, lambda c: c.worth), list_max(list_transform(cs, lambda c: c.worth)))].id END AS id FROM ch JOIN rp ON rp.trip = ch.trip AND rp.island = ch.island JOIN be ON be.trip = ch.trip AND be.island = ch.island),
  sp AS (SELECT *, sum(CAST(coalesce(before <> id, true) AS INT)) OVER (PARTITION BY trip, island ORDER BY k) AS span FROM (SELECT *, lag(id) OVER (PARTITION BY trip, island ORDER BY k) AS before FROM pk)),
  kept AS (SELECT trip, island, id, min(a) AS start_ms, max(b) AS end_ms FROM sp GROUP BY trip, island, id, span)"""


def still_moves(spark, d):
    k = F.col("part")
    origin = F.element_at(F.array(*map(F.lit, ["OBSERVED", "SIMPLIFIED_OBSERVED", "UNKNOWN"])), (k % 3 + 1).cast("int"))
    lat, lng = 40 + (F.col("lat") - 40) / 200, -74 + (F.col("lng") + 74) / 200
    return stays(spark, d).select("trip", ((F.col("id") * 1_000_000 + k) * 10_000 + F.expr("start_ms div 86400000") % 10_000).alias("id"), "mode", lat.alias("lat"), lng.alias("lng"), lat.alias("lat2"), lng.alias("lng2"), "start_ms", "end_ms", (F.col("confidence").cast("double") + (k * 7 + F.col("id") % 1009).cast("double") * 1e-7).alias("confidence"), (k % 60 == 7).alias("is_override"), origin.alias("provenance"), F.lit(None).cast(C.PATH).alias("path"))


@query("a5_chosen_moves", f"WITH RECURSIVE {_VITERBI} SELECT trip, id, start_ms, end_ms FROM kept")
def a5v(spark, d):
    """The choices of A5 over movements that stand still: Viterbi in SQL, the fallback of a path with a jump included."""
    return C.canonicalise_moves(still_moves(spark, d)).select("trip", "id", "start_ms", "end_ms")


@query("g21_records_of_still_moves", f"""WITH RECURSIVE {_VITERBI}, hd AS (SELECT trip, island, arg_min(id, start_ms) AS first FROM kept GROUP BY trip, island), md AS (SELECT DISTINCT kept.trip, kept.island, mode FROM kept JOIN m ON m.trip = kept.trip AND m.id = kept.id)
  SELECT i.trip, i.id, CASE WHEN md.mode IS NULL THEN 'CONFLICTING_MODE_LOWER_CONFIDENCE' ELSE 'SAME_MODE_NESTED' END AS reason, hd.first AS replaced_by FROM i JOIN hd ON hd.trip = i.trip AND hd.island = i.island LEFT JOIN md ON md.trip = i.trip AND md.island = i.island AND md.mode = i.mode WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.trip = i.trip AND kept.id = i.id)""")
def g21s(spark, d):
    return C.canonicalise_with_records(still_moves(spark, d)).where("reason IS NOT NULL").select("trip", "id", "reason", "replaced_by")


_NEXT = hav("lat", "lng", "lead(lat) OVER w", "lead(lng) OVER w")


@query("g6_counters_of_still_moves", f"""WITH RECURSIVE {_VITERBI}, k0 AS (SELECT kept.*, mode, lat, lng, m.start_ms AS s0, m.end_ms AS e0 FROM kept JOIN m ON m.trip = kept.trip AND m.id = kept.id),
  j AS (SELECT *, NOT coalesce(lag(mode) OVER w = mode AND mode <> 'AIRPLANE' AND start_ms - lag(end_ms) OVER w BETWEEN 0 AND 900000 AND {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} <= 500, false) AS new FROM k0 WINDOW w AS (PARTITION BY trip ORDER BY start_ms, end_ms, id)),
  ep AS (SELECT trip, episode, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(lat, start_ms) AS lat, arg_min(lng, start_ms) AS lng, arg_max(lat, start_ms) AS lat2, arg_max(lng, start_ms) AS lng2, arg_min(id, start_ms) AS first, count(*) AS n FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY start_ms, end_ms, id) AS episode FROM j) GROUP BY trip, episode),
  nx AS (SELECT *, lead(start_ms) OVER w - end_ms AS gap, {hav('lat2', 'lng2', 'lead(lat) OVER w', 'lead(lng) OVER w')} AS jump FROM ep WINDOW w AS (PARTITION BY trip ORDER BY start_ms)),
  cf AS (SELECT pk.trip, count(*) FILTER (c.id <> pk.id AND c.mode = m.mode) AS same, count(*) FILTER (c.id <> pk.id AND c.mode <> m.mode) AS other FROM (SELECT trip, id, unnest(cs) AS c FROM pk) pk JOIN m ON m.trip = pk.trip AND m.id = pk.id GROUP BY pk.trip),
  ra AS (SELECT trip, count(*) AS raw, count(*) FILTER (NOT EXISTS (SELECT 1 FROM kept WHERE kept.trip = i.trip AND kept.id = i.id)) AS gone FROM i GROUP BY trip), gr AS (SELECT trip, count(*) FILTER (n > 1) AS groups FROM (SELECT trip, island, count(*) AS n FROM i GROUP BY trip, island) GROUP BY trip),
  fx AS (SELECT trip, count(*) FILTER (repaired) AS repaired FROM rp GROUP BY trip), sl AS (SELECT trip, count(*) FILTER (start_ms <> s0 OR end_ms <> e0) AS cut FROM k0 GROUP BY trip)
  SELECT nx.trip, any_value(raw) AS raw, any_value(groups) AS groups, any_value(same) AS same_mode_conflicts, any_value(other) AS other_mode_conflicts, any_value(gone) AS suppressed, any_value(cut) AS cut, any_value(repaired) AS repaired, CAST(sum(n) - count(*) AS BIGINT) AS joined, count(*) AS episodes,
    count(*) FILTER (jump BETWEEN 1 AND 500 AND gap BETWEEN 0 AND 900000) AS connectors, count(*) FILTER (NOT (jump BETWEEN 1 AND 500 AND gap BETWEEN 0 AND 900000) AND (jump > 5000 OR gap > 3600000)) AS true_gaps, count(*) FILTER (gap < 0) AS violations, count(*) FILTER (gap BETWEEN 0 AND 1000 AND jump > 500) AS discontinuities, count(*) FILTER (gap BETWEEN 0 AND 300000 AND jump > 1000) AS backtracks
  FROM nx JOIN ra ON ra.trip = nx.trip JOIN gr ON gr.trip = nx.trip JOIN cf ON cf.trip = nx.trip JOIN fx ON fx.trip = nx.trip JOIN sl ON sl.trip = nx.trip GROUP BY nx.trip""")
def g6s(spark, d):
    """The counters of G6, but for the kinds and notes of jumps, where SQL can follow the choices."""
    m = still_moves(spark, d)
    return C.canonical_diagnostics(C.canonicalise_with_records(m), m).select("trip", "raw", "groups", "same_mode_conflicts", "other_mode_conflicts", "suppressed", "cut", "repaired", "joined", "episodes", "connectors", "true_gaps", "violations", "discontinuities", "backtracks")


@query("g21_suppression_records")
def g21r(spark, d):
    """Each movement that canonicalisation drops, why, and what replaced it."""
    return C.canonicalise_with_records(moves(spark, d)).where("reason IS NOT NULL").select("trip", "id", "reason", "replaced_by")


def activities(spark, d):
    """Movements with and without ends, a raw path, an own path and a stated distance; ids are made unique."""
    k = F.col("part")
    point = lambda dy, dx: F.struct((F.col("lat") + dy).alias("lat"), (F.col("lng") + dx).alias("lng"))
    timed = lambda i, dy, dx: F.struct((F.col("start_ms") + i).alias("ts_ms"), F.lit(i).cast("bigint").alias("id"), (F.col("lat") + dy).alias("lat"), (F.col("lng") + dx).alias("lng"))
    s = stays(spark, d).where("mode <> 'WALK'")
    return s.select(
        "trip", (F.col("id") * 1_000_000 + k).alias("id"), "mode", "start_ms", "end_ms", F.when(k % 2 == 0, F.col("metres")).otherwise(0.0).alias("metres"), F.when(k % 4 != 1, point(0.0, 0.0)).alias("a"), F.when(k % 4 != 2, point(0.05, 0.05)).alias("b"),
        F.when(k % 5 == 1, F.array(timed(1, 0.0, 0.0), timed(2, 0.01, 0.0), timed(3, 0.02, 0.01))).alias("raw"), F.when(k % 3 == 0, F.array(timed(1, 0.02, 0.0), timed(2, 0.02, 0.01))).alias("own"),
    )


@query("a1_path_fusion", f"""WITH {STAYS}, {_AT}, act AS (SELECT trip, id * 1000000 + part AS id, mode, CASE WHEN part % 2 = 0 THEN metres ELSE 0 END AS metres, part, lat, lng, list(struct_pack(y := o_lat, x := o_lng) ORDER BY ts_ms, o_id) FILTER (o_id IS NOT NULL) AS seen
    FROM (SELECT stays.*, obs.id AS o_id, obs.ts_ms, obs.lat AS o_lat, obs.lng AS o_lng FROM stays LEFT JOIN obs ON obs.trip = stays.trip AND obs.ts_ms BETWEEN start_ms - 30000 AND end_ms + 30000 WHERE mode <> 'WALK') GROUP BY ALL),
  p AS (SELECT *, list_concat(CASE WHEN part % 4 <> 1 THEN [struct_pack(y := lat, x := lng)] ELSE [] END, CASE WHEN part % 5 = 1 THEN [struct_pack(y := lat, x := lng), struct_pack(y := lat + 0.01::DOUBLE, x := lng), struct_pack(y := lat + 0.02::DOUBLE, x := lng + 0.01::DOUBLE)] WHEN len(seen) > 0 THEN seen WHEN part % 3 = 0 THEN [struct_pack(y := lat + 0.02::DOUBLE, x := lng), struct_pack(y := lat + 0.02::DOUBLE, x := lng + 0.01::DOUBLE)] ELSE [] END,
    CASE WHEN part % 4 <> 2 THEN [struct_pack(y := lat + 0.05::DOUBLE, x := lng + 0.05::DOUBLE)] ELSE [] END) AS path FROM act),
  q AS (SELECT trip, id, unnest(range(1, len(path) + 1)) AS i, unnest(path) AS v FROM p), s AS (SELECT trip, id, i, {hav('lag(v.y) OVER w', 'lag(v.x) OVER w', 'v.y', 'v.x')} AS step FROM q WINDOW w AS (PARTITION BY trip, id ORDER BY i)),
  n AS (SELECT trip, id, count(*) FILTER (step IS NULL OR step >= 1) AS n, sum(step) AS run FROM s GROUP BY trip, id)
  SELECT p.trip, p.id, CAST(n AS INT) AS n_points, round(CASE WHEN metres > 0 THEN metres ELSE coalesce(run, 0) END, 3) AS metres, CASE WHEN part % 5 = 1 THEN 'SIMPLIFIED_OBSERVED' WHEN len(seen) > 0 OR part % 3 = 0 THEN 'OBSERVED' WHEN mode = 'AIRPLANE' THEN 'ESTIMATED_GEODESIC' ELSE 'ENDPOINT_INTERPOLATED' END AS provenance FROM p JOIN n ON n.trip = p.trip AND n.id = p.id""")
def a1(spark, d):
    """Points lie a kilometre apart or on one another, so SQL finds near repeats by the step before."""
    from .joins import at

    return C.fused_paths(activities(spark, d), at(spark, d)).select("trip", "id", F.size("path").alias("n_points"), F.round("metres", 3).alias("metres"), "provenance")


@query("p1_simplified_paths")
def p1(spark, d):
    """The fused paths, simplified: recursion over the farthest point is beyond SQL; tests compare with brute force."""
    from .joins import at

    return C.simplified(C.fused_paths(activities(spark, d), at(spark, d)), "path").select("trip", "id", F.size("path").alias("kept"))


@query("a2_fallback_movement", f"""WITH {STAYS}, {_AT}, u AS (SELECT * FROM obs WHERE NOT EXISTS (SELECT 1 FROM stays WHERE obs.trip = stays.trip AND ts_ms BETWEEN start_ms AND end_ms)),
  f AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER w > 129600000, true) AS new FROM u WINDOW w AS (PARTITION BY trip ORDER BY ts_ms, id)), s AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY trip ORDER BY ts_ms, id) AS BIGINT) AS session FROM f),
  t AS (SELECT *, {hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')} AS step FROM s WINDOW w AS (PARTITION BY trip, session ORDER BY ts_ms, id)), m AS (SELECT trip, session, count(*) AS n, sum(step) AS metres, max(ts_ms) - min(ts_ms) AS ms FROM t GROUP BY trip, session)
  SELECT trip, session, n, round(metres, 3) AS metres FROM m WHERE n > 1 AND metres >= 150 AND metres / 1000 / (greatest(1000, ms) / 3600000) >= 0.5""")
def a2(spark, d):
    from trekframe.functions.geo import haversine

    from .joins import at, own

    free = J.uncovered(at(spark, d), own(stays(spark, d)), ["trip"], "id", "ts_ms", "start_ms", "end_ms")
    s = S.sessions(free, ["trip"], "ts_ms", "id", 36 * 3_600_000)
    w = Window.partitionBy("trip", "session").orderBy("ts_ms", "id")
    s = s.withColumn("step", haversine(F.lag("lat").over(w), F.lag("lng").over(w), "lat", "lng"))
    m = s.groupBy("trip", "session").agg(F.count("*").alias("n"), F.sum("step").alias("metres"), (F.max("ts_ms") - F.min("ts_ms")).alias("ms"))
    speed = F.col("metres") / 1000 / (F.greatest(F.lit(1000), F.col("ms")) / 3_600_000)
    return m.where((F.col("n") > 1) & (F.col("metres") >= 150) & (speed >= 0.5)).select("trip", "session", "n", F.round("metres", 3).alias("metres"))


@query("a9_photo_moments", f"""WITH RECURSIVE p AS (SELECT CAST(label AS BIGINT) AS parent, vec_id AS id, vec_id * 40000 AS ts, 40.0::DOUBLE AS lat, (vec_id % 2)::DOUBLE / 1000 AS lng, vec_id % 3 AS h, list_transform(embedding[1:8], lambda v: CAST(v / 10 AS DOUBLE)) AS c, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
  g AS (SELECT parent, id, ts, r, 0 AS cluster, true AS is_first, [struct_pack(ts := ts, lat := lat, lng := lng, h := h, c := c, k := 0)] AS firsts FROM p WHERE r = 1
  UNION ALL SELECT parent, id, ts, r, CASE WHEN hit IS NULL THEN len(firsts) ELSE hit.k END, hit IS NULL, CASE WHEN hit IS NULL THEN list_append(firsts, struct_pack(ts := ts, lat := lat, lng := lng, h := h, c := c, k := CAST(len(firsts) AS INT))) ELSE firsts END
    FROM (SELECT x.*, g.firsts, list_filter(g.firsts, lambda f: x.ts - f.ts <= 180000 AND {hav('f.lat', 'f.lng', 'x.lat', 'x.lng')} <= 300 AND bit_count(xor(x.h, f.h)) <= 6 AND list_sum(list_transform(range(1, 9), lambda i: abs(x.c[i] - f.c[i]))) < 0.22)[1] AS hit FROM g JOIN p x ON x.parent = g.parent AND x.r = g.r + 1))
  SELECT parent, id, ts AS ts_ms, CAST(cluster AS INT) AS cluster, is_first FROM g""")
def a9(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    p = e.select(F.col("label").cast("bigint").alias("parent"), F.col("vec_id").alias("id"), (F.col("vec_id") * 40_000).alias("ts_ms"), F.lit(40.0).alias("lat"), (F.col("vec_id") % 2 / 1000).alias("lng"), (F.col("vec_id") % 3).alias("hash"), F.transform(F.slice("embedding", 1, 8), lambda x: (x / 10).cast("double")).alias("color"))
    p = p.withColumns({"visit": F.lit(None).cast("bigint"), "best": F.lit(False)})
    return MO.cluster_photos(p).drop("first")


def _burst_photos(spark, d):
    k = F.col("vec_id")
    color = F.transform(F.slice("embedding", 1, 8), lambda x: (x / 10).cast("double"))
    return read(spark, d, "embeddings").select(
        F.col("label").cast("bigint").alias("parent"), k.alias("id"), (k * 2000).alias("ts_ms"), F.lit(40.0).alias("lat"), (k % 3 / 1000).alias("lng"), F.when(k % 11 > 0, k % 3).alias("hash"), color.alias("color"), F.when(k % 2 == 0, k % 4).alias("visit"), (k % 23 == 0).alias("best"), (k * 37 % 1000).alias("score")
    )


@query("a9_bursts", f"""WITH RECURSIVE p AS (SELECT CAST(label AS BIGINT) AS parent, vec_id AS id, vec_id * 2000 AS ts, 40.0::DOUBLE AS lat, (vec_id % 3)::DOUBLE / 1000 AS lng, CASE WHEN vec_id % 11 > 0 THEN vec_id % 3 END AS h, list_transform(embedding[1:8], lambda v: CAST(v / 10 AS DOUBLE)) AS c, CASE WHEN vec_id % 2 = 0 THEN vec_id % 4 END AS visit, vec_id % 23 = 0 AS best, vec_id * 37 % 1000 AS score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
  g AS (SELECT parent, id, ts, score, r, 0 AS cluster, 1 AS n, [struct_pack(ts := ts, lat := lat, lng := lng, h := h, c := c, v := visit, best := best, k := 0)] AS firsts FROM p WHERE r = 1
  UNION ALL SELECT parent, id, ts, score, r, CASE WHEN hit IS NULL THEN n ELSE hit.k END, CASE WHEN hit IS NULL THEN n + 1 ELSE n END, CASE WHEN hit IS NULL THEN list_append(live, struct_pack(ts := ts, lat := lat, lng := lng, h := h, c := c, v := visit, best := best, k := CAST(n AS INT))) ELSE live END
    FROM (SELECT x.*, g.n, list_filter(g.firsts, lambda f: x.ts - f.ts <= 60000) AS live, list_filter(g.firsts, lambda f: x.ts - f.ts <= 60000 AND NOT x.best AND NOT f.best AND x.h IS NOT NULL AND f.h IS NOT NULL AND ({hav('f.lat', 'f.lng', 'x.lat', 'x.lng')} <= 50 OR coalesce(x.visit = f.v, false)) AND coalesce(bit_count(xor(x.h, f.h)) <= 6, false) AND list_sum(list_transform(range(1, 9), lambda i: abs(x.c[i] - f.c[i]))) < 0.22)[1] AS hit FROM g JOIN p x ON x.parent = g.parent AND x.r = g.r + 1))
  SELECT parent, CAST(cluster AS INT) AS cluster, arg_min(id, (-score, ts, id)) AS id, count(*) AS members FROM g GROUP BY parent, cluster""")
def a9b(spark, d):
    """Bursts within a minute, near in place or at one stay; each comes down to its best photo."""
    p = _burst_photos(spark, d)
    return MO.collapsed(MO.cluster_photos(p, MO.BURST), p)


@query("t4_hero_and_thumbnails", f"""WITH RECURSIVE {STAYS}, p AS MATERIALIZED (SELECT trip, id, part % 1000 AS score, part % 6 AS category FROM stays),
  g AS (SELECT trip, id, score, category, 0 AS rank, [id] AS ids, [category] AS cats FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY score DESC, id) AS r FROM p) WHERE r = 1
  UNION ALL SELECT trip, id, score, category, rank + 1, list_append(ids, id), list_append(cats, category) FROM (SELECT p.*, g.rank, g.ids, g.cats, row_number() OVER (PARTITION BY p.trip ORDER BY p.score - CASE WHEN list_contains(g.cats, p.category) THEN 180 ELSE 0 END DESC, p.id) AS r FROM g JOIN p ON p.trip = g.trip AND NOT list_contains(g.ids, p.id) WHERE g.rank < 3) WHERE r = 1)
  SELECT trip, id, score, category, rank FROM g""")
def t4(spark, d):
    return C.heroes(stays(spark, d).select("trip", "id", (F.col("part") % 1000).alias("score"), (F.col("part") % 6).alias("category")))


@query("t5_budgeted_moments")
def t5(spark, d):
    """Four passes that depend on one another: beyond SQL; tests compare with a version that follows the rules one pick at a time."""
    k = F.col("part")
    p = stays(spark, d).select(
        "trip", "id", (k % 40).alias("anchor"), (k % 40 % 9).alias("day"), (k % 40 * 131 % 1000).alias("importance"), (k % 40 % 3 == 0).alias("important"), (k % 40 % 7 == 1).alias("moving"), (k % 1000).alias("score"),
        (k % 6).alias("category"), F.col("start_ms").alias("ts_ms"), (F.col("id") % 400 == 0).alias("pinned"),
    )
    return C.budgeted_moments(p).select("trip", "id", "anchor", "score", "ts_ms")


_USE = "2 * ln(1 + hours) + 2 * ln(1 + photos) + 2 * least(3, len(list_filter(days, lambda x: NOT list_contains(covered, x))))"


@query("g3_visit_summary", f"""WITH RECURSIVE {STAYS}, s AS MATERIALIZED (SELECT trip, 'place ' || (part % 12) AS label, sum(least(24.0::DOUBLE, (end_ms - start_ms) / 3600000)) AS hours, count(*) AS photos, list(DISTINCT start_ms // 86400000) AS days, min(start_ms) AS first, CASE WHEN part % 12 = 0 THEN 0 ELSE 1 END AS priority FROM stays GROUP BY trip, part % 12),
  g AS (SELECT trip, 0 AS n, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS covered FROM (SELECT DISTINCT trip FROM s)
  UNION ALL SELECT trip, n + 1, list_append(names, label), list_concat(covered, days) FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY priority, u DESC, first) AS r FROM (SELECT s.*, g.n, g.names, g.covered, {_USE} AS u FROM g JOIN s ON s.trip = g.trip AND NOT list_contains(g.names, s.label) WHERE g.n < 3)) WHERE r = 1),
  c AS (SELECT trip, count(*) AS k FROM s GROUP BY trip) SELECT g.trip, names, k - n AS others FROM g JOIN c ON c.trip = g.trip WHERE n = least(3, k)""")
def g3(spark, d):
    s = stays(spark, d).groupBy("trip", (F.col("part") % 12).alias("k")).agg(F.sum(F.least(F.lit(24.0), (F.col("end_ms") - F.col("start_ms")) / 3_600_000)).alias("hours"), F.count("*").alias("photos"), F.collect_set(F.expr("start_ms div 86400000")).alias("days"), F.min("start_ms").alias("first"))
    s = s.withColumns({"label": F.concat(F.lit("place "), F.col("k").cast("string")), "priority": F.when(F.col("k") == 0, 0).otherwise(1)})
    return C._grouped(s, ["trip"], C.representative_names, C.SUMMARY)


@query("h6_g20_image_features", """WITH px AS (SELECT p_partkey AS id, i // 12 AS y, i % 12 AS x, CAST((i * 7919 + p_partkey * 104729) % 16777216 AS BIGINT) AS v FROM part, range(144) r(i)),
  c AS (SELECT id, y, x, v >> 16 & 255 AS r, v >> 8 & 255 AS g, v & 255 AS b FROM px), q AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS grey FROM c),
  bit AS (SELECT id, sum(CASE WHEN l.grey > m.grey THEN (1::HUGEINT << CAST(k AS INT)) ELSE 0 END) AS h FROM range(64) t(k) JOIN q l ON l.y = k // 8 * 12 // 8 AND l.x = k % 8 * 12 // 9 JOIN q m USING (id) WHERE m.y = l.y AND m.x = (k % 8 + 1) * 12 // 9 GROUP BY id),
  inn AS (SELECT id, y, x, grey, r, g, b, lag(grey) OVER h AS a1, lead(grey) OVER h AS a2, lag(grey) OVER w AS a3, lead(grey) OVER w AS a4 FROM q WINDOW h AS (PARTITION BY id, y ORDER BY x), w AS (PARTITION BY id, x ORDER BY y)),
  f AS (SELECT id, var_pop(a1 + a2 + a3 + a4 - 4 * grey) AS sharp, 1 - avg(CASE WHEN grey < 5 OR grey > 250 THEN 1.0::DOUBLE ELSE 0 END) AS fine, list_transform(range(8), lambda z: len(list_filter(list(CASE WHEN r >= 128 THEN 4 ELSE 0 END + CASE WHEN g >= 128 THEN 2 ELSE 0 END + CASE WHEN b >= 128 THEN 1 ELSE 0 END), lambda o: o = z)) / 100) AS color FROM inn WHERE y BETWEEN 1 AND 10 AND x BETWEEN 1 AND 10 GROUP BY id)
  SELECT f.id, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash, round(sharp, 3) AS sharpness, round(fine, 6) AS exposure, CAST(color AS DOUBLE[]) AS color FROM f JOIN bit ON bit.id = f.id""")
def h6(spark, d):
    n = F.col("p_partkey")
    px = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: (i * 7919 + n * 104729) % 16_777_216)
    # a small file makes many images: its rows are dealt out before they get their pixels
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = C.extract_features(read(spark, d, "part").select("p_partkey").repartition(parts, "p_partkey").select(n.alias("id"), F.lit(12).alias("width"), F.lit(12).alias("height"), px.alias("pixels")))
    return f.select("id", "hash", F.round("sharpness", 3).alias("sharpness"), F.round("exposure", 6).alias("exposure"), F.transform("color", lambda x: F.round(x, 6)).alias("color"))


@query("a10_around_stays", f"""WITH {STAYS}, m AS (SELECT DISTINCT trip, id, start_ms, end_ms FROM stays WHERE mode = 'CAR'), h AS (SELECT m.*, v.start_ms AS vs, v.end_ms AS ve FROM m JOIN stays v ON v.trip = m.trip AND v.mode = 'WALK' AND greatest(v.start_ms, m.start_ms) < least(v.end_ms, m.end_ms)),
  t AS (SELECT trip, id, start_ms, end_ms, unnest([start_ms, end_ms, vs, ve]) AS t FROM h), c AS (SELECT *, t AS a, lead(t) OVER (PARTITION BY trip, id, start_ms, end_ms ORDER BY t) AS b FROM (SELECT DISTINCT * FROM t)),
  free AS (SELECT * FROM c WHERE a >= start_ms AND b <= end_ms AND NOT EXISTS (SELECT 1 FROM stays v WHERE v.trip = c.trip AND v.mode = 'WALK' AND v.start_ms <= c.a AND v.end_ms >= c.b AND v.start_ms < v.end_ms))
  SELECT trip, id, a AS start_ms, b AS end_ms FROM free WHERE b - a >= 1000""")
def a10(spark, d):
    """Free time as the operator finds it by a running end, and in SQL by the pieces between all boundaries that no stay covers.

    Line items repeat their ids: a movement is one trip, id and time, so another
    record of its id neither cuts it nor adds to it.
    """
    s = stays(spark, d)
    v = s.where("mode = 'WALK'").select("trip", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return C.around_stays(s.where("mode = 'CAR'").select("trip", "id", "start_ms", "end_ms"), v).drop("piece")
