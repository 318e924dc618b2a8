"""Work that grew faster than need be (findings of round 3): what is worked out once, what is joined once, what is not shuffled."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.operators import composite as C
from trekframe.plans import registry


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_an_arc_share_its_length(spark):
    """The distance stood 29 times in the expression of each point of a great circle."""
    ends = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 5.0, 5.0), (-10.0, 179.0, 10.0, -179.0)], "a double, b double, x double, y double")
    path = ends.select(geo.great_circle_path("a", "b", "x", "y", F.lit(4)).alias("p"))
    assert optimized(path).upper().count("ATAN2(") <= 4
    rows = [r.p for r in path.collect()]
    assert [len(p) for p in rows] == [5, 5, 5] and [tuple(p) for p in rows[1]] == [(5.0, 5.0)] * 5
    one = [r.p for r in ends.select(geo.slerp("a", "b", "x", "y", F.lit(0.25)).alias("p")).collect()]
    assert [p[1] for p in rows] == one and abs(rows[2][2].lat) < 1e-9 and abs(abs(rows[2][2].lng) - 180) < 1e-9


def test_slices_find_each_end_once(spark):
    """Vertices before an end were counted anew for every coordinate of every use of the made-up point."""
    k = F.col("id")
    t = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((i * 60_000).cast("bigint").alias("ts_ms"), (40 + i * (k + 1) * 0.001).cast("double").alias("lat"), F.lit(5.0).alias("lng"))).alias("points"))
    cut = t.select("id", C.sliced("points", F.lit(90_000), F.lit(330_000)).alias("p"))
    assert optimized(cut).upper().count("FILTER(") <= 8
    for r in cut.collect():
        assert [round((x.lat - 40) / (r.id + 1) * 1000, 3) for x in r.p] == [1.5, 2, 3, 4, 5, 5.5]


def test_images_of_one_size_are_worked_on_together(spark, monkeypatch):
    """Sizes mixed in a batch, more pixels than are taken at a time: as one image after another; and parts are dealt out before they are images."""
    monkeypatch.setattr(C, "PIXELS", 400)
    rng = np.random.default_rng(7)
    images = [(i, w, h, rng.integers(0, 1 << 24, w * h).tolist()) for i, (w, h) in enumerate([(12, 12), (9, 8), (12, 12), (20, 10), (9, 8), (12, 12), (12, 12)])]
    got = {r.id: r for r in C.extract_features(spark.createDataFrame(images, "id bigint, width int, height int, pixels array<int>").coalesce(1)).collect()}
    assert len(got) == len(images)
    for i, w, h, pixels in images:
        p = np.array(pixels).reshape(h, w)
        rgb = np.stack([p >> 16, p >> 8 & 255, p & 255], axis=2)
        grey = rgb @ np.array([0.299, 0.587, 0.114])
        bits = [grey[y * h // 8, x * w // 9] > grey[y * h // 8, (x + 1) * w // 9] for y in range(8) for x in range(8)]
        lap = [grey[y - 1, x] + grey[y + 1, x] + grey[y, x - 1] + grey[y, x + 1] - 4 * grey[y, x] for y in range(1, h - 1) for x in range(1, w - 1)]
        inner = grey[1:-1, 1:-1]
        assert got[i].hash & (1 << 64) - 1 == sum(1 << k for k, b in enumerate(bits) if b) and abs(got[i].sharpness - np.var(lap)) < 1e-6
        assert abs(got[i].exposure - (1 - ((inner < 5) | (inner > 250)).mean())) < 1e-12
        assert got[i].color == [float(((rgb[1:-1, 1:-1] >= 128) @ np.array([4, 2, 1]) == c).mean()) for c in range(8)]


def test_parts_are_dealt_out_before_they_are_images(spark):
    assert "RepartitionByExpression" in optimized(registry.queries()["h6_g20_image_features"](spark, "/root/testdata/sf0.001"))


def test_pairs_of_stays_are_joined_once(spark):
    """Both records of a pair were joined to the other's interval, though the first always holds the second's start."""
    day, rows = 86_400_000, []
    for i in range(240):
        start = (i * 7919 % 900) * 600_000 if i % 5 else (i % 11) * day - 3_000 * (i % 7)
        rows.append((i % 3, i, 40.0 + i % 4 * 0.004, 5.0, start, start + (i * 31 % 50) * 3_600_000 + (i % 3) * 4_000))
    rows += [(7, 1, 40.0, 5.0, 0, 0), (7, 2, 50.0, 5.0, 10_000, 10_000), (7, 3, 40.0, 5.0, 20_000, 5_000), (7, 4, 40.0, 5.0, 0, 400 * day), (7, 5, 40.0, 5.0, day, 400 * day)]
    got = C.one_stay_pairs(spark.createDataFrame(rows, "trip bigint, id bigint, lat double, lng double, start_ms bigint, end_ms bigint"))
    assert optimized(got).count("Join Inner") == 1
    names = ("trip", "id", "lat", "lng", "start_ms", "end_ms")
    visits = [dict(zip(names, r)) for r in rows]
    key = lambda v: (v["start_ms"], v["end_ms"], v["id"])
    want = [(a["trip"], a["id"], b["id"]) for a in visits for b in visits if a["trip"] == b["trip"] and key(a) < key(b) and C.one_stay(a, b)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def test_activities_without_points_are_not_shuffled(spark):
    """Wide rows of every activity were joined with the points met, also of trips without any; near repeats go one after another."""
    p = lambda *xs: [(i, i, y / 100_000, 5.0) for i, y in enumerate(xs)]
    acts = [(1, 1, "CAR", 0, 1000, 0.0, (0.0, 5.0), None, None, None), (1, 2, "CAR", 0, 1000, 7.0, None, None, p(0, 0.6, 1.2, 1.2, 5), p(9)), (2, 3, "AIRPLANE", 0, 1000, 0.0, (0.0, 5.0), (1.0, 5.0), None, None), (2, 4, "CAR", 0, 1000, 0.0, None, None, None, p(0, 0.6, 1.2, 1.2, 5)), (2, 5, "CAR", 0, 1, 0.0, None, None, None, None)]
    a = spark.createDataFrame(acts, f"trip bigint, id bigint, mode string, start_ms bigint, end_ms bigint, metres double, a struct<lat:double,lng:double>, b struct<lat:double,lng:double>, raw {C.POINTS}, own {C.POINTS}")
    got = C.fused_paths(a, spark.createDataFrame([(1, 8, 500, 0.001, 5.0)], "trip bigint, id bigint, ts_ms bigint, lat double, lng double"))
    assert optimized(got).startswith("Union") or "\nUnion" in optimized(got) or "+- Union" in optimized(got) or ":- Union" in optimized(got)
    rows = {r.id: ([round(x.lat * 100_000, 3) for x in r.path], round(r.metres, 1), r.provenance) for r in got.collect()}
    assert rows == {1: ([0, 100], 111.2, "OBSERVED"), 2: ([0, 1.2, 5], 7.0, "SIMPLIFIED_OBSERVED"), 3: ([0, 100_000], 111194.9, "ESTIMATED_GEODESIC"), 4: ([0, 1.2, 5], 5.6, "OBSERVED")}


def test_paths_of_a_batch_are_simplified_together():
    """Each path by itself, point by point in Python, as the first of the farthest stays."""

    def heading(p, q):
        a, b, d = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
        return math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))

    def cross(p, a, b):
        d = C.metres(*a, *p) / C.R
        return d * C.R if C.metres(*a, *b) < 1e-6 else abs(math.asin(math.sin(d) * math.sin(heading(a, p) - heading(a, b)))) * C.R

    def plain(path):
        if len(path) < 3:
            return list(range(len(path)))
        far = [cross(q, path[0], path[-1]) for q in path[1:-1]]
        k = 1 + max(range(len(far)), key=lambda i: (far[i], -i))
        return [0, len(path) - 1] if far[k - 1] <= 20.0 else plain(path[: k + 1])[:-1] + [k + i for i in plain(path[k:])]

    rng = np.random.default_rng(3)
    paths = [[tuple(q) for q in rng.normal(40, 0.01, (n, 2)).round(4)] for n in [1, 2, 3, 40, 7, 1, 150, 5]] + [[(1.0, 1.0), (1.0, 1.1), (1.0, 1.1), (1.0, 1.0)]]
    ends = np.cumsum([len(p) for p in paths])
    flat = np.array([q for p in paths for q in p])
    keep = C.kept_places(flat[:, 0], flat[:, 1], ends - [len(p) for p in paths], ends - 1, 20.0)
    assert [np.flatnonzero(keep[e - len(p) : e]).tolist() for p, e in zip(paths, ends)] == [plain(p) for p in paths]
