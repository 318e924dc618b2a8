"""Golden cases, invariants, idempotence and registered queries of the journey operators."""

from __future__ import annotations

import json
import os
import random
import struct
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.functions import arrays, geo, hashing, text, timefn
from trekframe.operators import composite as C
from trekframe.operators import joins as J
from trekframe.operators import sequence as S
from trekframe.operators.classify import transport
from trekframe.plans import registry
from trekframe.sources import basemap as BM
from trekframe.sources import media as MD
from trekframe.sources import store as K
from trekframe.sources import timeline as TL

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- functions ---


def test_geo(spark):
    assert 300_000 < one(spark, geo.haversine(F.lit(40.7580), F.lit(-73.9855), F.lit(42.3656), F.lit(-71.0096))) < 315_000
    assert one(spark, geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0))) == pytest.approx(90, abs=0.1)
    mid = one(spark, geo.slerp(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0), F.lit(0.5)))
    assert 4.9 < mid.lat < 5.1 and 4.9 < mid.lng < 5.1
    assert one(spark, geo.unwrap_longitude(F.lit(-179.0), F.lit(179.0))) == 181 and one(spark, geo.unwrap_longitude(F.lit(180.0), F.lit(0.0))) == 180
    assert one(spark, geo.point_to_segment(F.lit(0.0), F.lit(180.0), F.lit(0.0), F.lit(179.0), F.lit(0.0), F.lit(-179.0))) == pytest.approx(0, abs=1e-6)
    assert one(spark, geo.iso6709(F.lit("+37.5-122.25/"))).lng == -122.25 and one(spark, geo.without_null_island(F.lit(0.0), F.lit(0.0))) is None


@pytest.mark.parametrize(("raw", "want"), [("2026-07-01T14:00:00Z", 1782914400000), ("2026-07-01T10:00:00-04:00", 1782914400000), ("1782871200000", 1782871200000), ("2026-07-01T14:00:00", None), ("garbage", None), (None, None), ("", None), ("1782871200", 1782871200000)])
def test_parse_instant(spark, raw, want):
    assert one(spark, timefn.parse_instant(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("local", "n"), [("2026-03-08 02:30:00", 0), ("2026-11-01 01:30:00", 2), ("2026-07-01 12:00:00", 1)])
def test_wall_clock(spark, local, n):
    got = one(spark, timefn.wall_clock_instants(F.lit(local).cast("timestamp_ntz"), F.lit("America/New_York")))
    assert len(got) == n and (n != 2 or got[1] - got[0] == 3_600_000)


def test_text_and_hashing(spark):
    assert one(spark, text.redact_label(F.lit("123 Main Street"))) == "Private place" and one(spark, text.redact_label(F.lit("Home"))) == "Private place"
    assert [one(spark, text.redact_title(F.lit(t))) for t in ("Newport 2", "Summer 2026", "12 Oak Lane")] == ["Newport 2", "Summer 2026", "My Travel Story"]
    assert one(spark, hashing.coordinate(F.lit("42.3550°, -71.0656°"))).lat == 42.355 and one(spark, hashing.coordinate(F.lit("geo:1,2"))).lng == 2
    assert one(spark, hashing.json_list(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, hashing.json_list(F.lit("a, ,b"))) == ["a", "b"]
    assert len(one(spark, hashing.stable_id("visit", F.lit(1), F.lit(1e7)))) == 24


def test_transport(spark):
    def mode(m, distance, minutes, straight=None):
        return one(spark, transport(F.lit(m), F.lit(0.5), F.lit(False), F.lit(float(distance)), F.lit(float(straight or distance)), F.lit(minutes * 60_000)))["mode"]

    assert [mode("UNKNOWN", *x) for x in ((1500, 20), (45_000, 30), (11_000_000, 840), (4250, 27), (10_000, 30), (20, 30), (150_000, 50), (80_000, 60))] == ["WALK", "CAR", "AIRPLANE", "RUN", "BICYCLE", "UNKNOWN", "TRAIN", "CAR"]
    assert mode("UNKNOWN", 5_500_000, 10) == "UNKNOWN" and mode("BUS", 1000, 60) == "BUS" and mode("WALK", 60_000, 60) == "CAR"


# --- joins ---


def test_interval_join_against_brute_force(spark):
    r = random.Random(2)
    points = [(i, i % 3, r.randint(-10**6, 10**9)) for i in range(200)]
    spans = [(i, i % 3, a, a + r.choice([0, 10, 10**4, 10**7, 10**9])) for i in range(80) for a in [r.randint(-10**6, 10**9)]] + [(99, 0, 5, 4)]
    got = J.interval_join(spark.createDataFrame(points, "p int, k int, t bigint"), spark.createDataFrame(spans, "i int, k int, a bigint, b bigint"), ["k"], "t", "a", "b", bucket=1000, pad=7)
    assert sorted((x.p, x.i) for x in got.collect()) == sorted((p, i) for p, k, t in points for i, m, a, b in spans if k == m and b >= a and a - 7 <= t <= b + 7)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "k int, t bigint")
    right = spark.createDataFrame([(1, 4, "a"), (1, 10, "b"), (1, 14, "c")], "k int, u bigint, v string")
    rows = lambda df: sorted((x.k, x.t, x.r_v) for x in df.collect())
    assert rows(J.asof(left, right, ["k"], "t", "u", ["v"])) == [(1, 5, "a"), (1, 10, "b"), (2, 7, None)]
    assert rows(J.asof(left, right, ["k"], "t", "u", ["v"], "forward")) == [(1, 5, "b"), (1, 10, "b"), (2, 7, None)]
    assert rows(J.nearest_in_time(left.withColumn("t", F.col("t") + 2), right, ["k"], "t", "u", ["v"])) == [(1, 7, "a"), (1, 12, "b"), (2, 9, None)]


def test_no_plan_compares_all_pairs(spark):
    for name in ("j4_points_fused", "j7_j8_active_stay", "j9_j10_nearest_stay_in_window", "j12_overlap_flags", "j14_overlapping_pairs", "j17_nearest_place", "j19_j20_point_in_polygon", "a7_photo_match"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


# --- sequences and kernels ---


def test_boundaries_of_sessions_and_dwells(spark):
    e = spark.createDataFrame([(1, 0, 1, 0.0, 0.0), (1, 7_200_000, 2, 0.0, 0.0), (1, 14_400_001, 3, 0.0, 0.0)], "k int, t bigint, id int, lat double, lng double")
    assert [x.session for x in S.sessions(e, ["k"], "t", "id").orderBy("t").collect()] == [1, 1, 2]
    d = e.withColumn("t", F.col("id") * 1_800_000)  # a gap of just 30 minutes ends a dwell
    assert [x.cluster for x in S.dwell_clusters(d, ["k"], "t", "id").orderBy("t").collect()] == [1, 2, 3]


def test_rdp():
    assert C.rdp([(0.0, x / 10) for x in range(5)]) == [0, 4]
    assert C.rdp([(0.0, 0.0), (0.01, 0.05), (0.0, 0.1)]) == [0, 1, 2] and C.rdp([]) == [] and C.rdp([(1.0, 1.0)]) == [0]


STAY = {"trip": 1, "island": 1, "name": None, "place_id": None, "confidence": 0.5, "is_override": False, "lat": 40.0, "lng": -74.0}


def test_canonical_stays():
    a = STAY | {"id": 1, "start_ms": 0, "end_ms": 3_194_000, "confidence": 0.6}
    b = STAY | {"id": 2, "start_ms": 295_000, "end_ms": 3_157_000, "confidence": 0.95, "name": "Cafe", "lat": 40.0006}
    assert [(x["start_ms"], x["end_ms"], x["name"]) for x in C.canonical_stays([b, a])] == [(0, 3_194_000, "Cafe")]
    far = C.canonical_stays([a, STAY | {"id": 3, "start_ms": 3_000_000, "end_ms": 5_000_000, "lat": 40.2}])
    assert len(far) == 2 and far[0]["end_ms"] <= far[1]["start_ms"]
    assert C.canonical_stays(far) == far


MOVE = {"trip": 1, "island": 1, "mode": "CAR", "confidence": 0.8, "provenance": "OBSERVED", "sliced": False, "lat": 40.0, "lng": -74.0, "lat2": 40.1, "lng2": -74.0}


def test_canonical_moves():
    a = MOVE | {"id": 1, "start_ms": 0, "end_ms": 3_600_000}
    nested = MOVE | {"id": 2, "start_ms": 600_000, "end_ms": 1_200_000, "lat": 45.0, "lat2": 45.1}
    assert [(x["id"], x["start_ms"], x["end_ms"]) for x in C.canonical_moves([nested, a])] == [(1, 0, 3_600_000)]
    after = MOVE | {"id": 3, "start_ms": 3_000_000, "end_ms": 7_200_000, "lat": C.position(C.track(a), 3_600_000)[0], "lat2": 40.3}
    got = C.canonical_moves([a, after])
    assert got[0]["end_ms"] <= got[-1]["start_ms"] and {x["id"] for x in got} <= {1, 3}


def test_canonical_moves_against_all_paths():
    """The choice scores as much as the best of all sequences of candidates, whose steps stay within 1500 m."""
    from itertools import product

    r = random.Random(6)
    for _ in range(60):
        rows = []
        for i in range(4):
            s = r.randint(0, 20) * 60_000
            e = s + r.randint(1, 30) * 60_000
            path = [{"ts_ms": s + (e - s) * k // 3 if i % 2 else None, "lat": 40 + r.random() / 50, "lng": -74.0} for k in range(4)] if r.random() < 0.7 else None
            rows.append(MOVE | {"id": i, "start_ms": s, "end_ms": e, "mode": r.choice(["CAR", "BUS"]), "confidence": r.random(), "provenance": r.choice(list(C.GEOMETRY)), "path": path, "is_override": r.random() < 0.2, "lat2": 40.005})
        edges = sorted({t for s in rows for t in (s["start_ms"], s["end_ms"])})
        steps = [(a, b, on) for a, b in zip(edges, edges[1:]) if (on := [s for s in rows if s["start_ms"] <= a and b <= s["end_ms"]])]
        tracks = {s["id"]: C.track(s) for s in rows}
        far = lambda p, q, t: C.metres(*C.position(tracks[p["id"]], t), *C.position(tracks[q["id"]], t))  # noqa: B023, E731

        def score(way):
            total = sum(C._worth(s, a, b) for s, (a, b, _) in zip(way, steps))  # noqa: B023
            for p, q, (a, _, _) in zip(way, way[1:], steps[1:]):  # noqa: B023
                if p["id"] != q["id"]:
                    total -= (15 if p["mode"] == q["mode"] else 40) + 0.05 * far(p, q, a) if far(p, q, a) <= 1500 else np.inf  # noqa: B023
            return total

        ways = list(product(*(on for *_, on in steps)))
        best = max(map(score, ways))
        got = C.canonical_moves(rows)
        assert all(p["end_ms"] <= q["start_ms"] for p, q in zip(got, got[1:])) and sum(s["end_ms"] - s["start_ms"] for s in got) == sum(b - a for a, b, _ in steps)
        chosen = [next(rows[g["id"]] for g in got if g["start_ms"] <= a and b <= g["end_ms"]) for a, b, _ in steps]
        jump = lambda way: any(p["id"] != q["id"] and far(p, q, a) > 500 for p, q, (a, _, _) in zip(way, way[1:], steps[1:]))  # noqa: B023, E731
        if best > -np.inf and not any(jump(w) for w in ways if score(w) > best - 1e-9):
            assert score(chosen) == pytest.approx(best)
        for g in got:
            if g.get("path"):
                assert g["path"][0]["ts_ms"] == g["start_ms"] and g["path"][-1]["ts_ms"] == g["end_ms"]


def test_photo_kernels():
    p = {"parent": 1, "lat": 40.0, "lng": 1.0, "hash": 5, "color": [0.1] * 8}
    rows = [p | {"id": i, "ts_ms": i * 2000} for i in range(50)]
    assert {x["cluster"] for x in C.photo_moments(rows)} == {0}
    assert {x["cluster"] for x in C.photo_moments([r | {"hash": None} for r in rows[:3]])} == {0, 1, 2}
    q = {"trip": 1, "anchor": 7, "pinned": False, "important": True, "day": 1, "importance": 9, "moving": False, "category": 1}
    many = [q | {"id": i, "ts_ms": i, "score": i, "clusters": 190} for i in range(190)]
    assert [x["id"] for x in C.budgeted(many)] == [187, 188, 189] and len(C.budgeted(many, "SHORT")) == 1
    assert len(C.budgeted([x | {"pinned": True} for x in many[:40]])) == 40
    two = [q | {"id": i, "ts_ms": i, "score": s, "clusters": 2, "category": c, "anchor": a} for i, (s, c, a) in enumerate([(500, 1, 7), (450, 1, 7), (300, 2, 7), (20, 3, 8)])]
    assert [x["id"] for x in C.budgeted(two)] == [0, 2, 3]
    hero = C.hero_and_thumbnails([{"trip": 1, "id": i, "score": s, "category": c} for i, (s, c) in enumerate([(500, 1), (450, 1), (300, 2), (10, 3)])])
    assert [x["id"] for x in hero] == [0, 2, 1, 3]


def test_image_features():
    flat = np.full((8, 9, 3), 100)
    assert C.image_features(flat)[:3] == (0, 0.0, 1.0) and C.image_features(flat)[3] == [1.0] + [0.0] * 7
    assert bin(C.image_features(np.repeat(np.arange(9)[None, ::-1, None] * 20, 8, 0).repeat(3, 2))[0] & (1 << 64) - 1).count("1") == 64


def test_paths(spark):
    path = [{"ts_ms": t * 600_000, "lat": 40 + t / 100, "lng": -74.0} for t in range(7)]
    pts = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in p.items())) for p in path))
    got = one(spark, C.sliced(pts, F.lit(300_000), F.lit(2_100_000)))
    assert len(got) == 5 and got[0][0] == pytest.approx(40.005, abs=1e-6) and got[-1][0] == pytest.approx(40.035, abs=1e-6)
    assert [round(x.lat, 6) for x in one(spark, C.sliced(pts, F.lit(-5), F.lit(600_001)))] == [40.0, 40.01] and len(one(spark, C.sliced(pts, F.lit(9_000_000), F.lit(9_000_001)))) == 2
    line = F.array(*(F.struct(F.lit(x).alias("lat"), F.lit(0.0).alias("lng")) for x in (40.0, 40.1, 40.2)))
    cut = one(spark, C.split_at_place(line, F.lit(40.1), F.lit(0.001), F.lit(0.9)))
    assert cut.before[-1].lat == cut.after[0].lat == 40.1 and len(cut.after) == 2
    cut = one(spark, C.split_at_place(line, F.lit(0.0), F.lit(0.0), F.lit(0.75)))
    assert cut.before[-1].lat == cut.after[0].lat == pytest.approx(40.15, abs=1e-6) and len(cut.before) == 3 and len(cut.after) == 2
    assert len(one(spark, C.split_at_place(line, F.lit(0.0), F.lit(0.0), F.lit(1.0))).after) == 1
    m, v = spark.createDataFrame([(1, 1, 0, 10_000)], "trip int, id int, start_ms bigint, end_ms bigint"), spark.createDataFrame([(1, 2000, 3000), (1, 2500, 2600), (1, 9500, 20_000)], "trip int, b_start bigint, b_end bigint")
    assert sorted((x.piece, x.start_ms, x.end_ms) for x in C.around_stays(m, v).collect()) == [(0, 0, 2000), (1, 3000, 9500)]


def test_array_folds(spark):
    pts = F.array(*(F.struct(F.lit(a).alias("lat"), F.lit(0.0).alias("lng")) for a in (0.0, 0.000001, 0.001, 0.002)))
    assert len(one(spark, S.dedupe_points(pts))) == 3 and one(spark, S.path_length(pts)) == pytest.approx(222.39, abs=0.01)
    e = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 3000, 3500), (1, 3, 4000, 9000), (1, 4, 4000, 9000), (2, 1, 7, 7)], "trip int, id int, start_ms bigint, end_ms bigint")
    got = S.monotonic(e, ["trip"], ["id"]).orderBy("trip", "id").collect()
    assert [(x.start_ms, x.end_ms) for x in got] == [(0, 5000), (5000, 6000), (6000, 9000), (9000, 10_000), (7, 1007)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97])
def test_running_states(spark, n):
    values = [random.Random(n).randint(-9, 9) for _ in range(n)]
    got = one(spark, arrays.running(F.array(*map(F.lit, values)).cast("array<int>"), F.lit(1), lambda a, x: (a * 3 + x) % 1000))
    want, a = [], 1
    for x in values:
        want.append(a)
        a = int(np.fmod(a * 3 + x, 1000))
    assert got == want


def test_numbered_over_ranges(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 37 % 101 // 3) for i in range(300)], "id int, v int")
    got = {r.id: r.place for r in S.numbered(df, [F.desc("v"), F.col("id")], "place", f"{tmp_path}/n", 5).collect()}
    assert got == {i: k + 1 for k, (i, _) in enumerate(sorted(((i, i * 37 % 101 // 3) for i in range(300)), key=lambda x: (-x[1], x[0])))}
    assert S.numbered(df.limit(0), [F.col("id")], "place", f"{tmp_path}/e").count() == 0


def test_budget_keeps_what_the_kernel_would_pick(spark):
    """Rows dropped before the kernel change nothing."""
    r = random.Random(8)
    names = [x.split()[0] for x in C.MOMENT.split(", ")]
    anchors = {(t, a): (a % 50, r.randint(0, 99), r.random() < 0.4, r.random() < 0.2) for t in range(3) for a in range(90)}
    rows = []
    for i in range(1500):
        t, a = r.randrange(3), min(r.randrange(90), r.randrange(90))
        day, importance, important, moving = anchors[t, a]
        rows.append((t, i, a, day, importance, important, moving, 0, r.randint(0, 500), r.randrange(3), r.randint(0, 10**6), r.random() < 0.01))
    size = {k: sum((x[0], x[2]) == k for x in rows) for k in anchors}
    whole = [dict(zip(names, x)) | {"clusters": size[x[0], x[2]]} for x in rows]
    df = spark.createDataFrame(rows, C.MOMENT).drop("clusters")
    for profile in C.BUDGETS:
        want = {x["id"] for t in range(3) for x in C.budgeted([y for y in whole if y["trip"] == t], profile)}
        assert {x.id for x in C.budgeted_moments(df, profile).collect()} == want


def test_canonical_stays_rules():
    far = {"lat": 41.0}
    a = STAY | {"id": 1, "start_ms": 0, "end_ms": 10_000_000, "confidence": 0.9, "name": "Cafe"}
    inner = STAY | far | {"id": 2, "start_ms": 4_000_000, "end_ms": 5_000_000, "confidence": 0.6}
    assert [x["id"] for x in C.canonical_stays([a, inner])] == [1]
    strong = STAY | far | {"id": 3, "start_ms": 0, "end_ms": 12_000_000, "confidence": 0.9, "is_override": True}
    assert [(x["id"], x["start_ms"], x["end_ms"]) for x in C.canonical_stays([a, strong])] == [(3, 0, 12_000_000)]
    later = STAY | far | {"id": 4, "start_ms": 8_000_000, "end_ms": 20_000_000, "confidence": 0.9, "name": "Bar"}
    assert [(x["id"], x["start_ms"], x["end_ms"]) for x in C.canonical_stays([a, later])] == [(1, 0, 9_000_000), (4, 9_000_000, 20_000_000)]
    known = a | {"id": 0, "place_id": "p", "confidence": 0.1}
    assert [x["id"] for x in C.canonical_stays([a, known])] == [0]
    r = random.Random(1)
    for _ in range(200):
        rows = [STAY | {"id": i, "start_ms": s, "end_ms": s + r.randint(0, 4_000_000), "lat": 40 + r.choice([0, 0.003, 0.3, 0.5]), "confidence": r.random(), "name": r.choice([None, "", "x", "UNKNOWN"]), "is_override": r.random() < 0.2} for i in range(8) for s in [r.randint(0, 8_000_000)]]
        out = C.canonical_stays(rows)
        assert all(p["end_ms"] <= q["start_ms"] for p, q in zip(out, out[1:])) and C.canonical_stays(rows[::-1]) == out and out


def test_fused_paths(spark):
    none = "array<struct<ts_ms:bigint,id:bigint,lat:double,lng:double>>"
    p = "struct<lat:double,lng:double>"
    rows = [(1, 1, "CAR", 0, 100_000, 0.0, (40.0, 0.0), (40.2, 0.0), None, None), (1, 2, "CAR", 500_000, 600_000, 77.0, None, None, [(1, 1, 40.0, 0.0)], None), (1, 3, "AIRPLANE", 900_000, 950_000, 0.0, (1.0, 1.0), (2.0, 2.0), None, []), (1, 4, "CAR", 990_000, 995_000, 0.0, None, None, None, None)]
    a = spark.createDataFrame(rows, f"trip bigint, id bigint, mode string, start_ms bigint, end_ms bigint, metres double, a {p}, b {p}, raw {none}, own {none}")
    pts = spark.createDataFrame([(1, 7, 130_000, 40.1, 0.0), (1, 8, 130_001, 40.1, 0.01), (1, 9, -1, 40.0, 0.0)], "trip bigint, id bigint, ts_ms bigint, lat double, lng double")
    got = {r.id: r for r in C.fused_paths(a, pts).collect()}
    assert sorted(got) == [1, 2, 3] and [x.lat for x in got[1].path] == [40.0, 40.1, 40.2] and got[1].provenance == "OBSERVED"
    assert got[2].metres == 77 and got[2].provenance == "SIMPLIFIED_OBSERVED" and got[3].provenance == "ESTIMATED_GEODESIC" and got[3].metres > 150_000


def test_splitter_over_any_cut():
    """Escapes, strings and braces may be cut anywhere."""
    doc = json.dumps({"x": {"semanticSegments": 1}, "semanticSegments": [{"a": 'q"}{\\'}, {"b": [{"c": "\\\\"}]}], "other": [{"z": 1}], "locations": [{"d": "\n]"}]}) + '{"rawSignals": [{"e": 1}, {"f": '
    want = list(TL.split_elements(iter([doc])))
    assert [w[2] for w in want] == ["ok", "ok", "ok", "ok", "truncated"] and json.loads(want[0][1]) == {"a": 'q"}{\\'}
    for n in (1, 2, 3, 7):
        assert list(TL.split_elements(doc[i : i + n] for i in range(0, len(doc), n))) == want


# --- sources and sinks ---

VISIT = {"startTime": "2026-07-01T10:00:00Z", "endTime": "2026-07-01T11:00:00Z", "visit": {"topCandidate": {"placeName": "UNKNOWN", "semanticType": "INFERRED_HOME", "placeLocation": {"latLng": "42.3550°, -71.0656°"}}}}
RIDE = {"startTime": "2026-07-01T11:00:00Z", "endTime": "2026-07-01T12:00:00Z", "activity": {"topCandidate": {"type": "IN_BUS"}, "distanceMeters": 1500, "start": {"latLng": "1°, 2°"}}, "timelinePath": [{"point": "3°, 4°", "durationMinutesOffsetFromStartTime": 15}]}
OLD = {"placeVisit": {"location": {"latitudeE7": 423601000, "longitudeE7": -710589000, "name": "Park"}, "duration": {"startTimestampMs": "1782871200000", "endTimestamp": "2026-07-01T11:00:00Z"}, "placeConfidence": "HIGH_CONFIDENCE"}}


def test_timeline(spark, tmp_path):
    good = {"semanticSegments": [VISIT, RIDE], "timelineObjects": [OLD], "rawSignals": [{"timestamp": "2026-07-01T10:00:00Z", "position": {"LatLng": "5°, 6°"}}]}
    files = {"good": json.dumps(good), "cut": json.dumps({"semanticSegments": [VISIT, RIDE]})[:-60], "bad": '{"semanticSegments": [' + json.dumps(VISIT) + ', {"x": nope}, ' + json.dumps(RIDE) + "]}", "alien": '{"locations": [{"a": "]}\\""}], "other": [{"b": 1}]}'}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    found = TL.elements(spark, str(tmp_path))
    rows = [r for r in TL.records(found).collect() if r.path.endswith("good.json")]
    by = {(r.kind, r.start_ms): r for r in rows}
    assert len(rows) == 4 and by["VISIT", 1782900000000].name == "Home" and by["VISIT", 1782900000000].confidence == 0.95 and by["MOVE", 1782903600000].mode == "BUS"
    assert (by["VISIT", 1782871200000].lat, by["VISIT", 1782871200000].confidence) == (42.3601, 0.90) and by["POINT", 1782900000000].lat == 5
    assert {(r.ts_ms, r.lat) for r in TL.path_points(found).collect()} == {(1782904500000, 3.0)}
    status = {r.path.rpartition("/")[2]: (r.status, r.bad) for r in TL.import_status(found).collect()}
    assert status["good.json"] == ("SUCCESS", 0) and status["cut.json"] == ("PARTIAL_WITH_WARNINGS", 1) and status["bad.json"] == ("PARTIAL_WITH_WARNINGS", 1)
    spark.dataSource.register(TL.TimelineSource)
    assert spark.read.format("timeline").load(str(tmp_path / "good.json")).count() == 4


def test_media_files_that_are_broken(spark):
    files = [("a", b""), ("b", None), ("c", b"\xff\xd8\xff\xe1\xff\xff" + b"Exif\0\0MM"), ("d", b"\0\0\0\x08ftyp" + b"\0\0\0\x20moov"), ("e", b"plain"), ("f", b"\xff\xd8\xff\xe1\0\x20Exif\0\0II\x2a\0\xff\xff\xff\x7f")]
    got = MD.metadata(spark.createDataFrame([(p, bytearray(x) if x is not None else None) for p, x in files], "path string, content binary")).collect()
    assert len(got) == len(files) and all(r[1:] == (None,) * 5 for r in got)


def test_ring_files(spark, tmp_path):
    ring = [(0.5, 0.25), (0.75, 0.25), (0.75, 0.5)]
    section = BM.packed_section([{"name": "é", "type": "lake", "rings": [ring]}], [{"name": "r", "type": "ROAD", "points": [(0.99, 0.5), (0.01, 0.5)]}], [{"name": "p", "x": 0.5, "y": 0.5, "rank": 3}])
    data = b"MAP3" + struct.pack(">i", 1) + section + BM.packed_section([], [], [])
    got = BM.packed_features(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).collect()
    assert [(r.x, r.y) for r in got if r.kind == "polygon"] == ring and {(r.name, r.type) for r in got if r.kind == "polygon"} == {("é", "lake")}
    assert [round(r.x, 2) for r in got if r.kind == "line"] == [0.99, 1.01] and [r.rank for r in got if r.kind == "place"] == [3]
    with pytest.raises(ValueError):
        list(BM.unpacked(b"MAP2" + data[4:]))
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]], [[0, 0], [1, 1]]]}}]}))
    assert TL.geojson_rings(spark, str(tmp_path / "g.json")).count() == 3


def test_store(spark, tmp_path):
    s = K.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "trip_id int, id int, name string")
    s.replace_trips("v", rows)
    s.replace_trips("v", rows.where("trip_id = 1 AND id = 1"))
    assert sorted(r.id for r in s.read("v").collect()) == [1, 3]
    s.upsert("v", spark.createDataFrame([(1, 9, "z"), (1, 1, "A")], "trip_id int, id int, name string"), ["id"])
    assert {(r.id, r.name) for r in s.read("v").collect()} == {(1, "A"), (9, "z"), (3, "c")}
    s.update("v", F.col("id") == 3, {"name": F.lit("C")})
    s.delete("v", F.col("id") == 9)
    assert {(r.id, r.name) for r in s.read("v").collect()} == {(1, "A"), (3, "C")}
    s.replace_trips("p", rows.where("id = 1"))
    assert s.drop_orphans("v", "p", "id") == 1 and [r.id for r in s.read("v").collect()] == [1]
    assert set(K.migrated(rows, 1).columns) == {"trip_id", "id", "name", "confidence", "is_override", "zone"}


# --- the driver's contract ---


def test_playback_clock_of_every_player(spark, tmp_path):
    rows = [(user, 5 * user + k) for user in (3, 19, 20, 77) for k in range(5)]
    spark.createDataFrame(rows, "user_id bigint, event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["playback_clock"](spark, str(tmp_path)).collect()
    assert sorted((r.player, r.n) for r in got) == rows


def test_story_samples_see_all_stays(spark):
    from trekframe.plans import story
    from trekframe.plans.base import stays

    s = stays(spark, SF)
    trips = {}
    for r in sorted(story.episodes(spark, SF).collect(), key=lambda r: (r.start_ms, r.end_ms, r.id)):
        trips.setdefault(r.trip, []).append(r)
    assert sum(map(len, trips.values())) == s.count() - len(trips) and max(map(len, trips.values())) > 30
    want = set()
    for trip, rows in trips.items():
        total, at, k = sum(r.seconds for r in rows), 0.0, 0
        for r in rows:
            at += r.seconds
            while k < 20 and k * total / 20 < at - 1e-6:
                want.add((trip, k, r.id))
                k += 1
    assert {(r.trip, r.k, r.id) for r in registry.queries()["a12_a13_evaluate"](spark, SF).collect()} == want


def test_entry_without_corpus_operators(tmp_path):
    """The library and the other queries work where the corpus operators are absent."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'j1_trip_cards' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=120)


@pytest.mark.parametrize("name", ["j1_trip_cards", "w3_islands", "j7_j8_active_stay", "j11_nearest_point", "g10_cluster_merge", "a6_transport_mode", "d6_d7_local_day", "m1_haversine"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.queries()[name](spark, SF).toArrow(), con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in sorted(t.column_names)))))
    assert rows(got) == rows(want)
