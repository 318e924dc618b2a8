"""Routes, zones, story windows, records of canonicalisation, days, snapshots and kept cards, against slow versions and at their edges."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trekframe.operators import composite as C
from trekframe.operators import days as DY
from trekframe.operators import joins as J
from trekframe.operators import moments as MO
from trekframe.operators import playback as PB
from trekframe.operators import routes as R
from trekframe.operators import story as ST
from trekframe.operators import zones as Z
from trekframe.sources import snapshots as SN
from trekframe.streaming import cards as CA

LOOPS = ("NestedLoop", "CartesianProduct")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- zones ---


def odd(lat, lng, rings):
    n = 0
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            for turn in (-360, 0, 360):
                if (y1 > lat) != (y2 > lat) and lng + turn < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    n += 1
    return n


def test_zones_against_even_odd(spark):
    r = random.Random(4)
    rings, rows = {}, []
    for z in range(60):
        lat, lng, size = r.uniform(-70, 70), r.uniform(-180, 180), r.choice([0.05, 0.4, 3, 12])
        shape = [(lat + size * r.uniform(0.4, 1) * math.sin(a), lng + size * r.uniform(0.4, 1) * math.cos(a)) for a in sorted(r.uniform(0, 6.28) for _ in range(r.randint(3, 14)))]
        hole = [(lat + (y - lat) * 0.3, lng + (x - lng) * 0.3) for y, x in shape]
        rings[z] = [shape, hole] if z % 2 else [shape]
        rows += [(z, k, i, y, (x + 180) % 360 - 180) for k, ring in enumerate(rings[z]) for i, (y, x) in enumerate(ring)]
    points = []
    for i in range(3000):
        y, x = rings[i % 60][0][i % len(rings[i % 60][0])]
        points.append((i, max(-89.0, min(89.0, y + r.gauss(0, 1))), (x + r.gauss(0, 1) + 180) % 360 - 180))
    index = Z.zone_index(Z.ring_edges(spark.createDataFrame(rows, "zone long, ring int, seq int, lat double, lng double")))
    got = Z.zone_of_point(spark.createDataFrame(points, "id long, lat double, lng double"), index, "id")
    assert not any(x in plan(got) for x in LOOPS)
    # each of the three turns holds a whole ring, so a point is inside if the count over all of them is odd
    want = {i: next((z for z in range(60) if odd(lat, lng, rings[z]) % 2), None) for i, lat, lng in points}
    found = {x.id: x.zone for x in got.collect()}
    assert found == want and sum(z is not None for z in want.values()) > 300
    # a cell wholly inside holds no edge; so does nothing of the world outside
    assert index.where("edges IS NULL").count() > 0 and index.where("edges IS NULL AND NOT odd").count() == 0


def test_zones_of_nothing(spark):
    none = Z.zone_index(Z.ring_edges(spark.createDataFrame([], "zone long, ring int, seq int, lat double, lng double")))
    assert Z.zone_of_point(spark.createDataFrame([(1, 0.0, 0.0), (2, None, None)], "id long, lat double, lng double"), none, "id").where("zone IS NULL").count() == 2


# --- routes ---


def test_distance_to_route_against_all_legs(spark):
    r = random.Random(8)
    paths, points = [], []
    for move in range(30):
        lat, lng = r.uniform(-60, 60), r.choice([179.95, -179.9, 10.0, -74.0])
        for seq in range(r.randint(2, 15)):
            paths.append((1, move, seq, None, lat, (lng + 180) % 360 - 180))
            lat, lng = lat + r.gauss(0, 0.2), lng + r.gauss(0, 0.2)
        points += [(1, move, move * 100 + k, paths[-1][4] + r.gauss(0, 0.05), (paths[-1][5] + r.gauss(0, 0.05) + 180) % 360 - 180) for k in range(40)]
    route = R.legs(spark.createDataFrame(paths, "trip long, move long, seq long, ts_ms long, lat double, lng double"))
    legs = route.withColumn("reach", F.when(F.col("move") % 3 == 0, 50_000.0).otherwise(3000.0))
    p = spark.createDataFrame(points, "trip long, move long, id long, lat double, lng double")
    got = R.near_route(p, legs, ["trip", "move"], "id")
    assert not any(x in plan(got) for x in LOOPS)
    slow = p.join(legs, ["trip", "move"]).withColumn("metres", R.point_to_segment("lat", "lng", "lat1", "lng1", "lat2", "lng2")).where("metres <= reach").groupBy("trip", "move", "id").agg(F.min("metres").alias("metres"))
    want = {x.id: x.metres for x in slow.collect()}
    found = {x.id: x.metres for x in got.collect()}
    assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i]) for i in want) and 200 < len(want) < 1200


def test_photos_on_a_route_far_from_its_start(spark):
    """A drive passes the photo an hour after it began 80 km away; without a position it is put on the road."""
    moves = spark.createDataFrame([(1, 7, 0, 7_200_000, "CAR", 40.0, -74.0, 40.0, -72.0), (1, 8, 9_000_000, 9_900_000, "AIRPLANE", 10.0, 179.5, 10.0, -179.5)], "trip long, id long, start_ms long, end_ms long, mode string, lat double, lng double, lat2 double, lng2 double")
    paths = spark.createDataFrame([(1, 7, k, None, 40.0, -74.0 + 0.5 * k) for k in range(5)], "trip long, move long, seq long, ts_ms long, lat double, lng double")
    visits = spark.createDataFrame([(1, 3, 20_000_000, 21_000_000, 50.0, 5.0)], "trip long, id long, start_ms long, end_ms long, lat double, lng double")
    photo = lambda i, ts, lat, lng, own=False: (1, i, ts, lat, lng, lat is not None, own, 5 if own else None, None, 0.5)
    photos = [photo(1, 3_600_000, 40.01, -73.0), photo(2, 3_600_000, None, None), photo(3, 3_600_000, 40.2, -73.0), photo(4, None, 1.0, 2.0), photo(5, None, None, None), photo(6, 3_600_000, 1.0, 2.0, True), photo(7, 9_450_000, None, None), photo(8, 22_000_000, 50.001, 5.0), photo(9, 22_000_000, 50.01, 5.0), photo(10, 50_000_000, None, None), photo(11, 20_500_000, None, None)]
    p = spark.createDataFrame(photos, "trip long, id long, ts_ms long, lat double, lng double, gps boolean, own boolean, visit long, move long, confidence double")
    points = spark.createDataFrame([(1, 1, 50_000_000 + 20 * 60_000, 3.0, 4.0)], "trip long, id long, ts_ms long, lat double, lng double")
    got = {r.id: r for r in R.match_photos(p, visits, moves, points, paths).collect()}
    assert got[1].move == 7 and got[1].confidence == 0.98 and got[1].lat == 40.01
    assert got[2].move == 7 and got[2].lng == pytest.approx(-73.0, abs=1e-3) and got[2].confidence == 0.6 and got[2].source == "TIMELINE_INTERPOLATED"
    assert got[3].move is None and got[3].source == "GPS_EXACT"
    assert (got[4].lat, got[4].confidence, got[5].lat, got[5].confidence, got[5].source) == (1.0, 0.98, None, 0.0, "UNKNOWN")
    assert (got[6].visit, got[6].confidence, got[6].source) == (5, 0.5, "USER")
    assert got[7].move == 8 and abs(got[7].lng) == pytest.approx(180.0, abs=1e-6) and got[7].confidence == 0.70
    assert got[8].visit == 3 and got[9].visit is None
    assert (got[10].lat, got[10].confidence) == (3.0, 0.5) and (got[11].visit, got[11].lat, got[11].confidence) == (3, 50.0, 0.92)


def test_heading_track_of_a_long_route(spark):
    """A hundred thousand points on one route that goes east, then north."""
    n = 50_000
    paths = spark.range(2 * n).selectExpr("1L AS trip", "1L AS move", "id AS seq", "CAST(NULL AS LONG) AS ts_ms", f"CASE WHEN id < {n} THEN 0.0D ELSE (id - {n}) / 1e6D END AS lat", f"LEAST(id, {n}) / 1e6D AS lng")
    route = R.legs(paths)
    track = PB.heading_samples(spark.createDataFrame([(1, 1, "CAR"), (1, 2, "CAR")], "trip long, move long, mode string"), route)
    rows = {r.i: r for r in track.where("move = 1").collect()}
    total = 2 * 0.05 * math.pi / 180 * 6_371_000
    assert len(rows) == int(total / 50) + 2 and rows[0].heading == pytest.approx(90, abs=0.1) and rows[len(rows) - 1].heading % 360 == pytest.approx(0, abs=0.1)
    turn = [i for i in rows if 5 < rows[i].heading < 85]
    assert turn and all(abs(rows[i].at - total / 2) < 200 for i in turn)
    assert [tuple(r)[1:] for r in track.where("move = 2").collect()] == [(2, 0, 0.0, 0.0)]
    at = PB.heading_at(spark.createDataFrame([(1, 1, -5.0), (1, 1, 1e9), (1, 1, 25.0), (1, 2, 3.0)], "trip long, move long, d double"), track, "d")
    assert sorted(round(r.heading) % 360 for r in at.collect()) == [0, 0, 90, 90]


# --- story ---


def slow_windows(start, seconds, move, photos):
    """Windows laid one after another; photos: (share, shown at most) in order."""
    out, last, n = [], start, len(photos)
    for k, (share, most) in enumerate(photos):
        shown = min(most, max(1.0, seconds / n * 0.9))
        settle = 0 if move else min(0.35, seconds * 0.12)
        a = max(start + settle, last + 0.05, min(start + seconds - (n - k) * (shown + 0.05), start + seconds * share - shown / 2))
        b = min(start + seconds, a + shown)
        if b > a + 0.01:
            out.append((a, b))
            last = b
    return out


def test_photo_windows_and_holds(spark):
    r = random.Random(6)
    episodes, moments, want = [], [], {}
    for e in range(200):
        n, seconds, move = r.randint(0, 8), r.choice([1.3, 3.0, 8.0, 20.0]), e % 2 == 0
        t = sorted(r.randint(-50, 1050) for _ in range(n))
        episodes.append((e % 5, e, "MOVE" if move else "VISIT", e * 1000, e * 1000 + 1000, seconds, e * 20.0))
        moments += [(e % 5, e, e * 100 + i, e * 1000 + x, i % 3 == 0) for i, x in enumerate(t)]
        want[e] = slow_windows(e * 20.0, seconds, move, [(max(0.05, min(0.95, x / 1000)), 2.5 if i % 3 == 0 else 1.8) for i, x in enumerate(t)])
    ep = spark.createDataFrame(episodes, "trip long, id long, kind string, start_ms long, end_ms long, seconds double, story_start double")
    mo = spark.createDataFrame(moments, "trip long, parent long, media long, ts_ms long, best boolean")
    windows = ST.photo_windows(ep, mo)
    got = {}
    for x in windows.orderBy("media").collect():
        got.setdefault(x.id, []).append((x.shown_from, x.shown_to))
    for e in want:
        assert [pytest.approx(w, abs=1e-5) for w in want[e]] == got.get(e, [])
    # with room for every photo, windows lie in their episodes, one after another, and movements stand still in them
    ep = ST.schedule(ST.with_photo_room(ep.drop("story_start"), mo))
    held, shown = ST.with_holds(ep, ST.photo_windows(ep, mo))
    bad = ST.window_violations(held, shown).agg(*(F.sum(c).alias(c) for c in ("windows", "orphans", "outside", "strangers", "overlapping"))).first()
    assert bad.windows == len(moments) and bad[1:] == (0, 0, 0, 0)
    p = ST.hold_progress(ST.story_samples(held, 500), held, shown).collect()
    by = {}
    for x in sorted(p, key=lambda x: (x.trip, x.k)):
        before = by.get(x.id)
        assert before is None or x.progress >= before.progress - 1e-9
        if before is not None and x.held and before.held and x.media == before.media:
            assert x.progress == pytest.approx(before.progress)
        by[x.id] = x
    assert sum(x.held for x in p) > 50 and ST.window_violations(ep.limit(0), shown).agg(F.sum("orphans")).first()[0] == len(moments)


# --- canonicalisation ---


def test_records_of_what_went(spark):
    r = random.Random(11)
    rows = []
    for i in range(120):
        a = r.randint(0, 4000)
        rows.append((i % 3, i, r.choice(["CAR", "TRAIN", "WALK"]), 40.0, -74.0 + r.choice([0, 0.001, 0.05]), 40.0, -74.0 + r.choice([0, 0.001, 0.05]), a, a + r.randint(1, 300), r.random(), i % 17 == 0, r.choice(["OBSERVED", "UNKNOWN"]), None))
    moves = spark.createDataFrame(rows, f"trip long, id long, mode string, lat double, lng double, lat2 double, lng2 double, start_ms long, end_ms long, confidence double, is_override boolean, provenance string, path {C.PATH}")
    records = C.canonicalise_with_records(moves)
    plain = {tuple(x) for x in C.canonicalise_moves(moves).select("trip", "id", "start_ms", "end_ms").collect()}
    every = records.collect()
    kept = [x for x in every if x.reason is None]
    assert {(x.trip, x.id, x.start_ms, x.end_ms) for x in kept} == plain
    gone = [x for x in every if x.reason]
    stay = {(x.trip, x.id) for x in kept}
    assert {(t, i) for t, i, *_ in rows} == stay | {(x.trip, x.id) for x in gone} and not stay & {(x.trip, x.id) for x in gone}
    mode = {(t, i): m for t, i, m, *_ in rows}
    for x in gone:
        island = [(k.trip, k.id) for k in kept if (k.trip, k.island) == (x.trip, x.island)]
        assert (x.reason == "SAME_MODE_NESTED") == (x.mode in {mode[k] for k in island}) and x.replaced_by == min((k.start_ms, k.id) for k in kept if (k.trip, k.island) == (x.trip, x.island))[1]
    # conflicts, counted interval by interval
    for key in {(x.trip, x.island) for x in every}:
        own = [q for q in rows if (q[0], q[1]) in {(x.trip, x.id) for x in every if (x.trip, x.island) == key}]
        cuts = sorted({t for q in own for t in (q[7], q[8])})
        same = other = 0
        for a, b in zip(cuts, cuts[1:]):
            winner = next((k for k in kept if (k.trip, k.island) == key and k.start_ms <= a and b <= k.end_ms), None)
            for q in own:
                if winner is not None and q[7] <= a and b <= q[8] and q[1] != winner.id:
                    same, other = same + (q[2] == winner.mode), other + (q[2] != winner.mode)
        mine = [k for k in kept if (k.trip, k.island) == key]
        assert (sum(k.n_same_mode for k in mine), sum(k.n_other_mode for k in mine), sum(k.n_raw for k in mine)) == (same, other, len(own))
        assert sum(k.n_cut for k in mine) == sum(k.sliced for k in mine)
    g = C.canonical_diagnostics(records, moves).collect()
    assert sum(x.raw for x in g) == 120 and sum(x.suppressed for x in g) == len(gone) and all(x.violations == 0 and x.episodes + x.joined == sum(k.trip == x.trip for k in kept) for x in g)
    assert all(x.discontinuities == x.source_gaps + x.introduced_jumps == len(x.discontinuity_notes) and x.backtracks == len(x.backtrack_notes) for x in g)


def test_jumps_of_the_source_and_introduced(spark):
    e = spark.createDataFrame([(1, 0, 1, "CAR", 0, 10, 0.0, 0.0, 0.0, 0.1), (1, 1, 2, "CAR", 10, 20, 0.0, 0.2, 0.0, 0.3), (1, 2, 3, "CAR", 500, 600, 0.0, 0.4, 0.0, 0.5)], "trip long, episode long, first long, mode string, start_ms long, end_ms long, lat double, lng double, lat2 double, lng2 double")
    raw = lambda lng: spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, lng), (1, 2, 0.0, 0.2, 0.0, 0.3), (1, 3, 0.0, 0.3, 0.0, 0.5)], "trip long, id long, lat double, lng double, lat2 double, lng2 double")
    kinds = lambda lng: [x.discontinuity for x in C.timeline_jumps(e, raw(lng)).orderBy("episode").collect()]
    assert kinds(0.1) == ["SOURCE_TIMELINE_GAP", "CANONICALIZER_INTRODUCED_JUMP", None]
    assert kinds(0.2) == ["CANONICALIZER_INTRODUCED_JUMP", "CANONICALIZER_INTRODUCED_JUMP", None]


# --- photos ---


def test_clusters_against_all_firsts(spark):
    r = random.Random(9)
    rows, t = [], 0
    for i in range(400):
        t += r.choice([0, 500, 20_000, 50_000, 300_000])
        rows.append((i % 3, i, None if i % 50 == 7 else t, None if i % 31 == 0 else 40.0 + r.choice([0, 0.0001, 0.01]), -74.0, None if i % 13 == 0 else r.choice([0, 7, -1]), [0.1] * 8 if r.random() < 0.8 else [0.9] * 8, r.choice([None, 1, 2]), i % 29 == 0))
    df = spark.createDataFrame(rows, "parent long, id long, ts_ms long, lat double, lng double, hash long, color array<double>, visit long, best boolean")
    names = df.columns
    for rule in (MO.MOMENT, MO.BURST):
        want = {}
        for parent in range(3):
            firsts = []
            for q in sorted((dict(zip(names, x)) for x in rows if x[0] == parent), key=lambda q: (q["ts_ms"] is None, q["ts_ms"] or 0, q["id"])):
                hit = None
                for k, f in enumerate(firsts):
                    near = None not in (q["lat"], f["lat"]) and C.metres(q["lat"], q["lng"], f["lat"], f["lng"]) <= rule.within_m
                    if None in (q["ts_ms"], f["ts_ms"], q["hash"], f["hash"]) or q["ts_ms"] - f["ts_ms"] > rule.within_ms or rule.picks_alone and (q["best"] or f["best"]):
                        continue
                    if (near or rule.same_visit and q["visit"] is not None and q["visit"] == f["visit"]) and C._alike(q, f):
                        hit = k
                        break
                if hit is None:
                    firsts.append(q)
                want[q["id"]] = len(firsts) - 1 if hit is None else hit
        assert {x.id: x.cluster for x in MO.cluster_photos(df, rule).collect()} == want


def test_clusters_of_one_long_parent(spark):
    n = 200_000
    df = spark.range(n).selectExpr("1L AS parent", "id", "id * 1000 AS ts_ms", "40.0D AS lat", "-74.0D AS lng", "5L AS hash", "array_repeat(0.1D, 8) AS color", "CAST(NULL AS LONG) AS visit", "false AS best")
    got = MO.cluster_photos(df).agg(F.count("*"), F.max("cluster"), F.count_if("is_first")).first()
    assert tuple(got) == (n, (n - 1) // 181, (n - 1) // 181 + 1)


# --- days ---


def test_days_edges(spark):
    day = lambda x: f"2024-03-{x:02d}"
    trips = spark.createDataFrame([(1, day(1), day(3)), (2, day(5), day(5))], "trip long, start_day string, end_day string").withColumns({c: F.col(c).cast("date") for c in ("start_day", "end_day")})
    ms = lambda d, h: (d - 1) * 86_400_000 + h * 3_600_000 + 1_709_251_200_000
    visits = spark.createDataFrame([(1, 10, "Inn", ms(1, 20), ms(2, 9), "UTC"), (1, 11, None, ms(3, 1), ms(3, 2), "America/New_York"), (1, 12, "far", ms(9, 1), ms(9, 2), "UTC"), (1, 13, "no zone", ms(2, 1), ms(2, 2), None)], "trip long, id long, name string, start_ms long, end_ms long, zone string")
    moves = spark.createDataFrame([(1, 20, "TRAIN", ms(2, 10), ms(3, 1), "UTC", None, 500.0)], "trip long, id long, mode string, start_ms long, end_ms long, zone string, end_zone string, metres double")
    photos = spark.createDataFrame([(1, 1, ms(1, 21), day(1), 10, 20), (1, 2, ms(2, 8), day(2), 10, None), (1, 3, ms(2, 7), day(2), 10, None), (1, 4, None, day(3), None, 20), (1, 5, 9, day(3), None, None), (1, 6, 9, None, 10, None), (1, 7, 9, day(9), 10, None), (1, 8, 7, day(3), 99, None)], "trip long, id long, ts_ms long, day string, visit long, move long").withColumn("day", F.col("day").cast("date"))
    got = DY.day_items(trips, visits, moves, photos)
    rows = [(x.trip, x.day_index, x.place, x.kind, x.id, x.label, x.n_photos) for x in got.orderBy("trip", "day", "place").collect()]
    assert rows == [
        (1, 1, 1, "VISIT", 10, "Inn", 1), (1, 1, 2, "VISIT", 13, "no zone", 0), (1, 2, 1, "CONTEXT_VISIT", 10, "Inn — continued stay", 2), (1, 2, 2, "MOVE", 20, "TRAIN", 0), (1, 2, 3, "VISIT", 11, None, 0),
        (1, 3, 1, "CONTEXT_MOVE", 20, "During train", 1), (1, 3, 2, "UNASSIGNED", None, None, 1), (1, 3, 3, "CONTEXT_VISIT", 99, "Continued stay", 1), (2, 1, None, None, None, None, None),
    ]
    sums = [tuple(x)[2:] for x in DY.day_summaries(got, moves).orderBy("trip", "day").collect()]
    assert sums == [(1, 2, 1, 0, 0.0), (2, 3, 2, 0, 500.0), (3, 3, 3, 1, 0.0), (1, 0, 0, 0, 0.0)]


# --- snapshots ---


def test_a_stopped_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    s = SN.Snapshots(spark, f"file://{tmp_path}/s", buckets=4)
    rows = lambda v, trips=range(6): spark.createDataFrame([(t, f"{v}{t}") for t in trips], "trip_id long, name string")
    names = ["trips", "visits", "segments", "media"]
    assert s.versions() == [] and s.manifest() is None
    assert s.commit({n: rows("a") for n in names}) == 1
    calls, put = [], s._put

    def stop(path, text):
        calls.append(path)
        raise OSError("stopped")

    monkeypatch.setattr(s, "_put", stop)
    with pytest.raises(OSError):
        s.commit({n: rows("b", [1, 2]) for n in names})
    assert calls and s.versions() == [1] and all({x.name for x in s.read(n).collect()} == {f"a{t}" for t in range(6)} for n in names)

    def stop_between(df, *_):  # after two of the four tables
        raise RuntimeError("lost")

    monkeypatch.setattr(s, "_put", put)
    broken = rows("b", [1, 2]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        s.commit({"trips": rows("b", [1, 2]), "visits": rows("b", [1, 2]), "segments": broken, "media": rows("b", [1, 2])})
    assert s.versions() == [1] and all({x.name for x in s.read(n).collect()} == {f"a{t}" for t in range(6)} for n in names)
    assert s.commit({n: rows("c", [1, 2]) if n != "media" else rows("c", []) for n in names}, rows("c", [1, 2])) == 2
    assert {x.name for x in s.read("visits").collect()} == {"a0", "c1", "c2", "a3", "a4", "a5"} and {x.name for x in s.read("media").collect()} == {"a0", "a3", "a4", "a5"}
    assert {x.name for x in s.read("media", 1).collect()} == {f"a{t}" for t in range(6)}
    # two writers of one version: the second fails and leaves the first's
    with pytest.raises(SN.Conflict):
        s._put(f"manifests/{2:012d}.json", "{}")
    assert s.manifest()["version"] == 2
    # rows of a version to come, of another format, are not read
    s._put(f"manifests/{3:012d}.json", '{"format": 9}')
    assert s.manifest() is None
    s.expire(keep=1)
    assert s.versions() == [3] and SN.Snapshots(spark, f"file://{tmp_path}/none").manifest() is None


def test_memo_by_input_key(spark, tmp_path):
    s = SN.Snapshots(spark, f"file://{tmp_path}/m", buckets=2)
    made = []

    def compute(tag):
        def run():
            made.append(tag)
            return spark.createDataFrame([(1, tag), (2, tag)], "trip_id long, name string")

        return run

    for key in ("k1", "k1", "k2"):
        assert {x.name for x in s.memo("features", key, compute(key)).collect()} == {key}
    s.commit({"features": spark.createDataFrame([(1, "edited")], "trip_id long, name string")})
    assert {x.name for x in s.memo("features", "k2", compute("again")).collect()} == {"again"} and made == ["k1", "k2", "again"]


def test_cards_after_a_batch_run_twice(spark, tmp_path):
    s = SN.Snapshots(spark, f"file://{tmp_path}/c", buckets=2)
    rows = lambda *x: spark.createDataFrame([*x], "trip_id long, id long, version long, name string, deleted boolean")
    cards = lambda df: df.groupBy("trip_id").agg(F.count("*").alias("n"), F.max("name").alias("name"))
    run = lambda n, *x: CA.apply_batch(s, rows(*x), n, "visits", "cards", cards, ["id"], deleted=F.col("deleted"))
    read = lambda: {x.trip_id: (x.n, x.name) for x in s.read("cards").collect()}
    run(0, (1, 1, 1, "a", False), (1, 2, 1, "b", False), (2, 3, 1, "c", False))
    assert read() == {1: (2, "b"), 2: (1, "c")}
    run(1, (1, 2, 3, "z", False), (2, 3, 2, "c", True))
    run(1, (1, 2, 9, "twice", False))  # run again after a failure: left out
    assert read() == {1: (2, "z")} and s.versions() == [1, 2]
    run(2, (1, 2, 2, "late", False), (2, 3, 1, "late", False), (3, 4, 1, "new", False))
    assert read() == {1: (2, "z"), 3: (1, "new")}


def test_overlaps_of_long_intervals(spark):
    """Ten years, and an end by mistake in the year 5000, cost a few buckets."""
    year = 31_557_600_000
    a = spark.createDataFrame([(1, 1, 0, 10 * year), (1, 2, 5, 3000 * year), (1, 3, year, year + 1)], "trip long, id long, start_ms long, end_ms long")
    b = a.selectExpr("trip", "id AS b_id", "start_ms AS b_start", "end_ms AS b_end")
    got = J.overlap_join(a, b, ["trip"])
    assert sorted((x.id, x.b_id) for x in got.collect()) == [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    assert not any(x in plan(got) for x in LOOPS)
