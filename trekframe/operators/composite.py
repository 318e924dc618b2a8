"""Statistics of clusters and the kernels that need a sequence at a time."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.functions.arrays import let, running
from trekframe.functions.geo import haversine


def cluster_stats(df: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """Centre (longitudes on the circle), radius, net displacement, and VISIT, MOVEMENT or NONE."""
    first, last = F.min(F.struct(ts, tie, "lat", "lng")), F.max(F.struct(ts, tie, "lat", "lng"))
    centre = F.degrees(F.atan2(F.avg(F.sin(F.radians("lng"))), F.avg(F.cos(F.radians("lng")))))
    s = df.groupBy(*by).agg(F.count("*").alias("n"), (F.max(ts) - F.min(ts)).alias("ms"), F.avg("lat").alias("c_lat"), centre.alias("c_lng"), first.alias("a"), last.alias("b"))
    r = df.join(s.select(*by, "c_lat", "c_lng"), by).groupBy(*by).agg(F.max(haversine("c_lat", "c_lng", "lat", "lng")).alias("radius"))
    net = haversine("a.lat", "a.lng", "b.lat", "b.lng")
    s = s.join(r, by).withColumn("net", net).withColumn("speed", F.col("net") / F.greatest(F.lit(1.0), F.col("ms") / 1000))
    still = (F.col("ms") >= 600_000) & (F.col("radius") <= 150) & (F.col("net") <= 100) & ((F.col("speed") <= 0.6) | (F.col("net") <= 60))
    kind = F.when(still, "VISIT").when((F.col("n") >= 2) | (F.col("net") > 50), "MOVEMENT").otherwise("NONE")
    return s.select(*by, "n", "ms", F.col("c_lat").alias("lat"), F.col("c_lng").alias("lng"), "radius", "net", "speed", kind.alias("kind"))


# --- kernels: plain functions over one small group, and the operators that deal groups out ---



R = 6_371_000.0


def metres(lat1, lng1, lat2, lng2) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def kept_places(lat: np.ndarray, lng: np.ndarray, first: np.ndarray, last: np.ndarray, eps: float) -> np.ndarray:
    """Which points stay of paths that lie one after another, each from first to last: all paths' open stretches are cut at once, level by level."""
    y, x = np.radians(lat), np.radians(lng)
    sin, cos = np.sin(y), np.cos(y)

    def angle(i, j):
        h = np.sin((y[j] - y[i]) / 2) ** 2 + cos[i] * cos[j] * np.sin((x[j] - x[i]) / 2) ** 2
        return 2 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))

    def heading(i, j):
        return np.arctan2(np.sin(x[j] - x[i]) * cos[j], cos[i] * sin[j] - sin[i] * cos[j] * np.cos(x[j] - x[i]))

    keep = np.zeros(len(lat), bool)
    keep[first], keep[last] = True, True
    a, b = first, last
    while True:
        a, b = a[b - a >= 2], b[b - a >= 2]
        if not len(a):
            return keep
        n = b - a - 1
        offset = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        i = np.arange(len(of)) - offset[of] + a[of] + 1
        d, point = angle(a[of], i), (angle(a, b) * R < 1e-6)[of]
        turn = np.where(point, 0.0, heading(a[of], i) - heading(a, b)[of])
        far = np.where(point, d, np.abs(np.arcsin(np.clip(np.sin(d) * np.sin(turn), -1.0, 1.0)))) * R
        far = np.where(np.isnan(far), np.inf, far)  # a point without a place stays
        most = np.maximum.reduceat(far, offset)
        top = np.flatnonzero(far >= most[of] - 1e-6)
        begin, end = (np.searchsorted(of[top], np.arange(len(a)), side) for side in ("left", "right"))
        k = i[top[begin]]
        # where rounding decides, between points as far or at eps, one point's formula does
        for j in np.flatnonzero(np.isfinite(most) & (most > eps - 1e-6) & ((end - begin > 1) | (most < eps + 1e-6))).tolist():
            at = lambda n: (float(lat[n]), float(lng[n]))
            some = i[top[begin[j] : end[j]]].tolist()
            exact = [_cross(at(n), at(a[j]), at(b[j])) for n in some]
            most[j] = max(exact)
            k[j] = some[exact.index(most[j])]  # the first of equals
        cut = most > eps
        keep[k[cut]] = True
        a, b = np.concatenate([a[cut], k[cut]]), np.concatenate([k[cut], b[cut]])


def _bearing(p, q) -> float:
    a, b, d = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
    return math.atan2(math.sin(d) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(d))


def _cross(p, a, b) -> float:
    d = metres(*a, *p) / R
    if metres(*a, *b) < 1e-6:
        return d * R
    return abs(math.asin(max(-1.0, min(1.0, math.sin(d) * math.sin(_bearing(a, p) - _bearing(a, b)))))) * R


def rdp(points: list[tuple[float, float]], eps: float = 20.0) -> list[int]:
    """Kept places of a path; the point farthest from the great circle through the ends stays if beyond eps, the first of equals."""
    if not points:
        return []
    lat, lng = np.array(points, float).T
    return np.flatnonzero(kept_places(lat, lng, np.array([0]), np.array([len(points) - 1]), eps)).tolist()


def simplified(df: DataFrame, points: str, eps: float = 20.0) -> DataFrame:
    """P1 over array<struct<lat, lng, ...>>: Arrow batches of paths; those of fewer than three points stay as they are."""

    @F.arrow_udf("array<int>")
    def kept(lats: pa.Array, lngs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lats), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        some = sizes > 0
        keep = kept_places(lats.flatten().to_numpy(zero_copy_only=False), lngs.flatten().to_numpy(zero_copy_only=False), (ends - sizes)[some], ends[some] - 1, eps)
        place = np.arange(len(keep)) - np.repeat(ends - sizes, sizes)
        bounds = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place[keep], pa.int32()))

    long = lambda k: F.when(F.size(points) > 2, F.transform(points, lambda x: x[k].cast("double")))
    some = F.transform("__kept", lambda i: F.element_at(F.col(points), i + 1))
    return df.withColumn("__kept", kept(long("lat"), long("lng"))).withColumn(points, F.when(F.size(points) > 2, some).otherwise(F.col(points))).drop("__kept")


# A1 -------------------------------------------------------------------------------------------

POINTS = "array<struct<ts_ms:bigint,id:bigint,lat:double,lng:double>>"


def fused_paths(activities: DataFrame, points: DataFrame, pad: int = 30_000) -> DataFrame:
    """A1 over activities(trip, id, mode, start_ms, end_ms, metres, a, b, raw, own) and points(trip, id, ts_ms, lat, lng).

    A path is the activity's start a, then the first of these that holds a point:
    its raw path, the points of its time, its own path; then its end b.  Points
    under a metre from the one kept before go.  A stated distance outranks the
    path's.  Activities without any point are left out.
    """
    from .joins import group_hash, interval_join

    # only activities without a raw path ask for points, and only in trips that have some; the wide rows of all others are not shuffled
    none = F.array().cast(POINTS)
    here = points.select(group_hash(["trip"]).alias("__group"), F.lit(True).alias("__here")).distinct()
    marked = activities.withColumns({c: F.coalesce(c, none) for c in ("raw", "own")}).withColumn("__group", group_hash(["trip"])).join(F.broadcast(here), "__group", "left")
    asks = F.coalesce("__here", F.lit(False)) & (F.size("raw") == 0)
    asking, rest = (marked.where(x).drop("__group", "__here") for x in (asks, ~asks))
    times = asking.select("trip", F.col("id").alias("activity"), "start_ms", "end_ms")
    met = interval_join(points.select("trip", F.col("id").alias("point"), "ts_ms", "lat", "lng"), times, ["trip"], "ts_ms", "start_ms", "end_ms", pad=pad, prune=False)
    seen = met.groupBy("trip", F.col("activity").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ts_ms", F.col("point").alias("id"), "lat", "lng"))).alias("seen"))
    end = lambda p, t: F.when(F.col(p).isNotNull(), F.array(F.struct(F.col(t).alias("ts_ms"), F.lit(None).cast("bigint").alias("id"), F.col(p)["lat"].alias("lat"), F.col(p)["lng"].alias("lng")))).otherwise(none)
    has = lambda p: F.size(p) > 0
    asking = asking.drop("raw").join(seen, ["trip", "id"], "left").withColumns({"seen": F.coalesce("seen", none), "raw": none})
    df = asking.unionByName(rest.withColumn("seen", none))
    path = F.concat(end("a", "start_ms"), F.when(has("raw"), F.col("raw")).when(has("seen"), F.col("seen")).otherwise(F.col("own")), end("b", "end_ms"))
    origin = F.when(has("raw"), "SIMPLIFIED_OBSERVED").when(has("seen") | has("own"), "OBSERVED").when(F.col("mode") == "AIRPLANE", "ESTIMATED_GEODESIC").otherwise("ENDPOINT_INTERPOLATED")
    df = df.withColumns({"path": path, "provenance": origin}).where(F.size("path") > 0)
    of = lambda k: F.transform("path", lambda x: x[k])
    df = df.withColumn("__way", F.arrow_udf(way_of, "struct<kept:array<int>,metres:double>")(of("lat"), of("lng")))
    some = F.transform("__way.kept", lambda i: F.element_at("path", i + 1))
    df = df.withColumns({"path": F.coalesce(some, "path"), "metres": F.when(F.col("metres") > 0, F.col("metres")).otherwise(F.col("__way.metres"))})
    return df.drop("seen", "raw", "own", "a", "b", "__way")


def way_of(lats: pa.Array, lngs: pa.Array) -> pa.Array:
    """Of each path, none of them empty, the places of the points at least a metre from the one kept before (null: all), and the metres along these.

    Steps of all paths are measured at once; only paths with a step under a metre are gone through point by point.
    """
    sizes = pc.list_value_length(lats).to_numpy(zero_copy_only=False).astype(np.int64)
    lat, lng = (c.flatten().to_numpy(zero_copy_only=False).astype(float) for c in (lats, lngs))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    y, x = np.radians(lat), np.radians(lng)
    h = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.radians(np.diff(lng)) / 2) ** 2
    step = np.zeros(len(lat))
    step[1:] = 2 * R * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))
    step[starts] = 0.0
    near = ~(step >= 1.0)
    near[starts] = False
    way = np.add.reduceat(step, starts) if len(starts) else np.zeros(0)
    kept: list = [None] * len(sizes)
    for k in np.flatnonzero(np.add.reduceat(near, starts, dtype=np.int64)).tolist() if len(starts) else []:
        a, b = int(starts[k]), int(ends[k])
        places, total, last = [0], 0.0, (float(lat[a]), float(lng[a]))
        for i in range(a + 1, b):
            point = (float(lat[i]), float(lng[i]))
            far = metres(*last, *point)
            if far >= 1.0:
                places.append(i - a)
                total, last = total + far, point
        kept[k], way[k] = places, total
    return pa.StructArray.from_arrays([pa.array(kept, pa.list_(pa.int32())), pa.array(way)], names=["kept", "metres"])


# A4 -------------------------------------------------------------------------------------------


#: What makes two records one stay: least share of the shorter time, least shared time, greatest distance.
ONE_STAY = [(0.9, 0, 1500.0), (0.5, 0, 500.0), (0.0, 600_000, 500.0)]
SAME_TIME_MS, NEAR_M, CLEARLY = 10_000, 500.0, 0.2


def one_stay(a: dict, b: dict) -> bool:
    """Two records of one stay: of the same time, or sharing enough of it near enough."""
    if max(abs(a[t] - b[t]) for t in ("start_ms", "end_ms")) <= SAME_TIME_MS:
        return True
    shared = min(a["end_ms"], b["end_ms"]) - max(a["start_ms"], b["start_ms"])
    shorter = max(1, min(v["end_ms"] - v["start_ms"] for v in (a, b)))
    far = metres(a["lat"], a["lng"], b["lat"], b["lng"]) if shared > 0 else math.inf
    return any(shared / shorter >= share and shared >= ms and far <= most for share, ms, most in ONE_STAY)


def one_stay_pairs(visits: DataFrame) -> DataFrame:
    """J13 over visits(trip, id, lat, lng, start_ms, end_ms): (trip, a, b) of the pairs, a before b, that ``one_stay`` joins."""
    from .joins import interval_join

    side = lambda p: visits.select("trip", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lng", "start_ms", "end_ms")))
    # A pair's first record starts first, so it holds the other's start: one join finds every pair, once.
    # Stays last hours, so buckets of a day cut few of them; records of the same time need not meet, hence the pad.
    apart = 2 * (SAME_TIME_MS // 2 + 1)
    met = interval_join(side("b"), side("a"), ["trip"], "b_start_ms", "a_start_ms", "a_end_ms", 86_400_000, apart, prune=False)
    meets = (F.col("a_end_ms") + apart > F.col("b_start_ms")) & (F.col("b_end_ms") + apart > F.col("a_start_ms"))
    pairs = met.where(meets & (F.struct("a_start_ms", "a_end_ms", "a_id") < F.struct("b_start_ms", "b_end_ms", "b_id")))
    shared = F.least("a_end_ms", "b_end_ms") - F.greatest("a_start_ms", "b_start_ms")
    shorter = F.greatest(F.lit(1), F.least(F.col("a_end_ms") - F.col("a_start_ms"), F.col("b_end_ms") - F.col("b_start_ms")))
    same = (F.abs(F.col("a_start_ms") - F.col("b_start_ms")) <= SAME_TIME_MS) & (F.abs(F.col("a_end_ms") - F.col("b_end_ms")) <= SAME_TIME_MS)
    pairs = pairs.withColumns({"shared": shared, "share": shared / shorter, "far": haversine("a_lat", "a_lng", "b_lat", "b_lng")})
    fits = F.lit(False)
    for share, ms, most in ONE_STAY:
        fits = fits | ((F.col("share") >= share) & (F.col("shared") >= ms) & (F.col("far") <= most))
    return pairs.where(same | ((F.col("shared") > 0) & fits)).select("trip", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def _filled(x: str | None) -> bool:
    return bool(x and x.strip())


def united(group: list[dict]) -> dict:
    """The time of all records, and the rest of the best by six keys."""
    keys = lambda v: (v["is_override"], _filled(v["name"]) and v["name"].upper() != "UNKNOWN", _filled(v["place_id"]), v["confidence"], v["end_ms"] - v["start_ms"], v["id"])
    times = {"start_ms": min(v["start_ms"] for v in group), "end_ms": max(v["end_ms"] for v in group)}
    return {**max(group, key=keys), **times, "is_override": any(v["is_override"] for v in group)}


def border(a: dict, b: dict) -> int:
    """When b takes over from a, for stays that overlap apart: their middle, or the far end of the clearly better one that holds the other's."""
    worth = lambda v: 100 * v["is_override"] + 10 * _filled(v["name"]) + v["confidence"]
    if worth(a) >= worth(b) + CLEARLY and b["end_ms"] <= a["end_ms"]:
        return a["end_ms"]
    if worth(b) >= worth(a) + CLEARLY and b["start_ms"] <= a["start_ms"]:
        return a["start_ms"]
    return min(max((a["end_ms"] + b["start_ms"]) // 2, a["start_ms"] + 1000), max(a["end_ms"], a["start_ms"] + 1000))


#: Records further apart than this cannot be of one stay: both ends may differ by 10 s.
MEET_MS = 10_001


def canonical_stays(rows: list[dict]) -> list[dict]:
    """A4: each record joins the first group that holds one of its stay; then no two stays overlap.

    Where two groups' stays overlap they become one if near, else a border
    divides their time, and one left without time goes.  One that takes all of
    its predecessor's place still begins no earlier than the stay before that.
    """
    groups: list[list[dict]] = []
    live: list[tuple[int, list[dict]]] = []  # groups, with their records that a later one can still match
    for v in sorted(rows, key=lambda v: (v["start_ms"], v["end_ms"], -v["confidence"], v["id"])):
        live = [(k, own) for k, g in live if (own := [x for x in g if x["end_ms"] + MEET_MS > v["start_ms"]])]
        k = next((k for k, own in live if any(one_stay(x, v) for x in own)), len(groups))
        if k == len(groups):
            groups.append([])
            live.append((k, []))
        groups[k].append(v)
        next(own for i, own in live if i == k).append(v)
    free, out = -math.inf, []
    for v in sorted(map(united, groups), key=lambda v: v["start_ms"]):
        if out and v["start_ms"] < out[-1]["end_ms"]:
            a = out.pop()
            if metres(a["lat"], a["lng"], v["lat"], v["lng"]) <= NEAR_M:
                out.append(united([a, v]))
                continue
            at = border(a, v)
            if at > a["start_ms"]:
                out.append(a | {"end_ms": at})
            free = out[-1]["end_ms"] if out else -math.inf
            v = v | {"start_ms": max(v["start_ms"], at, free) if at > a["start_ms"] else max(v["start_ms"], free)}
            if v["end_ms"] <= v["start_ms"]:
                continue
        out.append(v)
    return out


STAY = "trip bigint, island bigint, id bigint, name string, place_id string, lat double, lng double, start_ms bigint, end_ms bigint, confidence double, is_override boolean"


def _values(a: pa.Array) -> list:
    """An Arrow column as Python values, as ``to_pylist`` gives them; columns without nulls and nested ones at once, not value by value."""
    if pa.types.is_list(a.type):
        flat, sizes, at, out = _values(a.flatten()), _values(pc.list_value_length(a)), 0, []
        for n in sizes:
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(a.type) and not a.null_count:
        names = a.type.names
        return [dict(zip(names, x)) for x in zip(*map(_values, a.flatten()))]
    if a.null_count or pa.types.is_nested(a.type) or pa.types.is_temporal(a.type):
        return a.to_pylist()
    return a.to_numpy(zero_copy_only=False).tolist()


def _grouped(df: DataFrame, by: list[str], kernel, schema: str) -> DataFrame:
    """kernel over each group's rows.  Groups stream through sorted partitions, so many small ones share a batch."""
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), PATH: pa.list_(pa.struct([("ts_ms", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])

        now, group, out = None, [], []
        for batch in batches:
            names, columns = batch.schema.names, [_values(c) for c in batch.columns]
            keys = zip(*(columns[names.index(c)] for c in by))
            for key, values in zip(keys, zip(*columns)):
                row = dict(zip(names, values))
                if key != now:
                    out += kernel(group) if group else []
                    now, group = key, []
                group.append(row)
            if len(out) >= 4096:
                yield packed(out)
                out = []
        out += kernel(group) if group else []
        if out:
            yield packed(out)

    # a kernel's time hangs on its rows, not their bytes: a number of its own keeps small partitions from being put together into few long tasks
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema)


def canonicalise_stays(visits: DataFrame) -> DataFrame:
    """A4 over visits(trip, id, name, place_id, lat, lng, start_ms, end_ms, confidence, is_override).

    Islands, padded by the 10 s at which two records may match without meeting,
    are independent; those of one visit need no kernel.
    """
    from pyspark.sql.window import Window

    from .sequence import islands

    rows = islands(visits, ["trip"], ["id"], pad=MEET_MS).withColumn("__n", F.count("*").over(Window.partitionBy("trip", "island")))
    cols = [x.split()[0] for x in STAY.split(", ")]
    return rows.where("__n = 1").select(*cols).unionByName(_grouped(rows.where("__n > 1").select(*cols), ["trip", "island"], canonical_stays, STAY))


# A5 -------------------------------------------------------------------------------------------

#: Worth of a movement's geometry by its origin.
GEOMETRY = {"OBSERVED": 100.0, "SIMPLIFIED_OBSERVED": 80.0, "ESTIMATED_GEODESIC": 60.0, "ENDPOINT_INTERPOLATED": 30.0, "CONTINUITY_ESTIMATE": 20.0, "UNKNOWN": 10.0}
PATH = "array<struct<ts_ms:bigint,lat:double,lng:double>>"
MOVE = f"trip bigint, island bigint, id bigint, mode string, lat double, lng double, lat2 double, lng2 double, start_ms bigint, end_ms bigint, confidence double, is_override boolean, provenance string, path {PATH}, sliced boolean"
Track = tuple[list[float], list[tuple[float, float]]]


def track(s: dict) -> Track:
    """Times and places of a movement: its timed points, or its path's vertices at their share of its length, or its ends."""
    path = s.get("path") or []
    timed = sorted((p["ts_ms"], p["lat"], p["lng"]) for p in path if p["ts_ms"] is not None)
    if len(timed) > 1:
        return [t for t, *_ in timed], [(y, x) for _, y, x in timed]
    spots = [(p["lat"], p["lng"]) for p in path] if len(path) > 1 else [(s["lat"], s["lng"]), (s["lat2"], s["lng2"])]
    run = [0.0]
    for p, q in zip(spots, spots[1:]):
        run.append(run[-1] + metres(*p, *q))
    long = max(1, s["end_ms"] - s["start_ms"])
    return [s["start_ms"] + long * (r / run[-1] if run[-1] else i / (len(run) - 1)) for i, r in enumerate(run)], spots


def position(of: Track, t: float) -> tuple[float, float]:
    """Where a movement is at a time: on the great circle between the places before and after."""
    times, spots = of
    i = bisect_left(times, t)
    if i == 0 or i == len(times):
        return spots[min(i, len(times) - 1)]
    f, a, b = (t - times[i - 1]) / max(1e-9, times[i] - times[i - 1]), spots[i - 1], spots[i]
    if a == b:
        return a
    d = metres(*a, *b) / R
    if d < 1e-9 or f >= 1:
        return b if f >= 1 else a
    u, v = math.sin((1 - f) * d) / math.sin(d), math.sin(f * d) / math.sin(d)
    p, q = [(math.cos(math.radians(x)) * math.cos(math.radians(y)), math.cos(math.radians(x)) * math.sin(math.radians(y)), math.sin(math.radians(x))) for x, y in (a, b)]
    x, y, z = (u * i + v * j for i, j in zip(p, q))
    return math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x))


def between(of: Track, a: int, b: int, least_m: float = 1.0) -> list[dict]:
    """The track from a to b: a place at each end, and its vertices between, over least_m from the one before."""
    times, spots = of
    out = [(a, *position(of, a))]
    for t, p in zip(times[bisect_right(times, a) : bisect_left(times, b)], spots[bisect_right(times, a) : bisect_left(times, b)]):
        if metres(*out[-1][1:], *p) > least_m:
            out.append((int(t), *p))
    end = (b, *position(of, b))
    if len(out) > 1 and metres(*out[-1][1:], *end[1:]) <= least_m:
        out.pop()
    return [dict(zip(("ts_ms", "lat", "lng"), x)) for x in [*out, end]]


#: What a path of over two vertices, and points of its own time, add to a movement's worth; a user's word for it.
BY_PATH, BY_POINTS, BY_USER = 20.0, 15.0, 1.5


def _own(s: dict) -> tuple[float, int]:
    """What a whole movement is worth, and the milliseconds it is worth that for."""
    path = s.get("path") or []
    own = GEOMETRY[s["provenance"]] * (BY_USER if s.get("is_override") else s["confidence"]) + BY_PATH * (len(path) > 2) + BY_POINTS * any(p["ts_ms"] is not None for p in path)
    return own, max(1, s["end_ms"] - s["start_ms"])


def _worth(s: dict, a: int, b: int) -> float:
    own, ms = _own(s)
    return own * (b - a) / ms


def canonical_moves(rows: list[dict]) -> list[dict]:
    """A5: one movement at a time: Viterbi over the atomic intervals of an island, then equal neighbours joined and cut out.

    Staying costs nothing; a change costs 15, or 40 to another mode, and 0.05 a
    metre, and is ruled out beyond 1500 m.  A path with a jump over 500 m inside
    falls back to the single best movement.
    """
    return _resolved(rows)[0]


def canonical_records(rows: list[dict]) -> list[dict]:
    """As canonical_moves, with a record of each movement that went, and what was counted on the island's first row.

    A movement goes as SAME_MODE_NESTED if one of its mode stays in the island,
    else as CONFLICTING_MODE_LOWER_CONFIDENCE; what replaced it is the island's
    first movement that stays.  Counted are the records, the conflicts in each
    atomic interval with one of the same mode and of another, what was cut,
    what went, and whether a jump was repaired.
    """
    kept, counts = _resolved(rows)
    if not kept:
        return []
    stay = {s["id"] for s in kept}
    gone = [s for s in sorted(rows, key=lambda s: (s["start_ms"], s["end_ms"], s["id"])) if s["id"] not in stay]
    modes = {s["mode"] for s in rows if s["id"] in stay}
    zero = dict.fromkeys(COUNTS, 0)
    out = [s | zero | {"reason": None, "replaced_by": None} for s in kept]
    out[0] |= counts | {"n_raw": len(rows), "n_groups": 1, "n_gone": len(gone)}
    reason = lambda s: "SAME_MODE_NESTED" if s["mode"] in modes else "CONFLICTING_MODE_LOWER_CONFIDENCE"
    return out + [s | zero | {"reason": reason(s), "replaced_by": kept[0]["id"]} for s in gone]


COUNTS = ["n_raw", "n_groups", "n_same_mode", "n_other_mode", "n_cut", "n_gone", "n_repaired"]


def _resolved(rows: list[dict]) -> tuple[list[dict], dict[str, int]]:
    rows = sorted(rows, key=lambda s: (s["start_ms"], s["end_ms"], s["id"]))
    edges = sorted({t for s in rows for t in (s["start_ms"], s["end_ms"])})
    last, tracks, seen = {s["id"]: s for s in rows}, {}, {}
    worths = {id(s): _own(s) for s in rows}
    steps, on, k = [], [], 0
    for a, b in zip(edges, edges[1:]):  # a sweep: those on are in the order of rows
        on = [s for s in on if s["end_ms"] >= b]
        while k < len(rows) and rows[k]["start_ms"] <= a:
            on += [rows[k]] if rows[k]["end_ms"] >= b else []
            k += 1
        if on:
            steps.append((a, b, on))
    if not steps:
        return [], {}

    def of(s: dict) -> Track:
        if s["id"] not in tracks:
            tracks[s["id"]] = track(last[s["id"]])
        return tracks[s["id"]]

    def place(s: dict, t: int) -> tuple[float, float]:
        """Where a movement is at a time, worked out once: it is asked for as one that ends, goes on and begins."""
        key = (s["id"], t)
        if key not in seen:
            seen[key] = position(of(s), t)
        return seen[key]

    def change(p: dict, q: dict, t: int) -> float:
        if p["id"] == q["id"]:
            return 0.0
        far = metres(*place(p, t), *place(q, t))
        return -math.inf if far > 1500 else -(15 if p["mode"] == q["mode"] else 40) - 0.05 * far

    def worth(s: dict, a: int, b: int) -> float:
        own, ms = worths[id(s)]
        return own * (b - a) / ms

    def first_best(values: list[float]) -> int:
        return values.index(max(values))

    score, back = [worth(s, *steps[0][:2]) for s in steps[0][2]], []
    for (_, _, before), (a, b, now) in zip(steps, steps[1:]):
        table = [[x + change(p, q, a) for x, p in zip(score, before)] for q in now]
        come = [first_best(line) for line in table]
        back.append(come)
        score = [line[k] + worth(q, a, b) for line, k, q in zip(table, come, now)]
    k = first_best(score)
    path = [k]
    for come in reversed(back):
        path.append(k := come[k])
    chosen = [on[i] for (_, _, on), i in zip(steps, reversed(path))]
    repaired = max(score) == -math.inf or any(p["id"] != q["id"] and metres(*place(p, a), *place(q, a)) > 500 for p, q, (a, _, _) in zip(chosen, chosen[1:], steps[1:]))
    if repaired:
        low, high = steps[0][0], steps[-1][1]
        best = rows[first_best([worth(s, max(low, s["start_ms"]), min(high, s["end_ms"])) for s in rows])]
        chosen = [best if best in on else on[first_best([worth(s, a, b) for s in on])] for a, b, on in steps]
    out: list[dict] = []
    for s, (a, b, _) in zip(chosen, steps):
        if out and out[-1]["id"] == s["id"] and out[-1]["end_ms"] == a:
            out[-1]["end_ms"] = b
        else:
            out.append(s | {"start_ms": a, "end_ms": b, "__of": s})
    for s in out:
        whole = s.pop("__of")
        s["sliced"] = (s["start_ms"], s["end_ms"]) != (whole["start_ms"], whole["end_ms"])
        s["lat"], s["lng"] = place(whole, s["start_ms"])
        s["lat2"], s["lng2"] = place(whole, s["end_ms"])
        if s.get("path"):
            s["path"] = between(of(whole), s["start_ms"], s["end_ms"])
    others = [x["mode"] == s["mode"] for s, (_, _, on) in zip(chosen, steps) for x in on if x["id"] != s["id"]]
    return out, {"n_same_mode": sum(others), "n_other_mode": len(others) - sum(others), "n_cut": sum(s["sliced"] for s in out), "n_repaired": int(repaired)}


RECORD = MOVE + ", reason string, replaced_by bigint, " + ", ".join(f"{n} bigint" for n in COUNTS)


def canonicalise_with_records(moves: DataFrame) -> DataFrame:
    """canonicalise_moves with a row for each movement that went, its reason (null where it stays) and what replaced it."""
    from pyspark.sql.window import Window

    from .sequence import islands

    rows = islands(moves, ["trip"], ["id"]).withColumns({"__n": F.count("*").over(Window.partitionBy("trip", "island")), "sliced": F.lit(False)})
    cols = [x.split()[0] for x in MOVE.split(", ")]
    alone = {"reason": F.lit(None).cast("string"), "replaced_by": F.lit(None).cast("bigint")} | {n: F.lit(int(n == "n_raw")).cast("bigint") for n in COUNTS}
    return rows.where("__n = 1").select(*cols).withColumns(alone).unionByName(_grouped(rows.where("__n > 1").select(*cols), ["trip", "island"], canonical_records, RECORD))


def joined_moves(moves: DataFrame) -> DataFrame:
    """W8 over canonical moves: neighbours of one mode, not by air, at most 15 min and 500 m from end to start, become one; first is the id that it begins with."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id")
    before = lambda x: F.lag(x).over(w)
    same = (before("mode") == F.col("mode")) & (F.col("mode") != "AIRPLANE") & (F.col("start_ms") - before("end_ms")).between(0, 900_000) & (haversine(before("lat2"), before("lng2"), "lat", "lng") <= 500)
    m = moves.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("bigint")).withColumn("episode", F.sum("__new").over(w))
    head, tail = F.struct("start_ms", "end_ms", "id"), F.struct("start_ms", "end_ms", "id", "lat2", "lng2")
    return m.groupBy("trip", "episode").agg(
        F.min_by("id", head).alias("first"), F.first("mode").alias("mode"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("lat", head).alias("lat"), F.min_by("lng", head).alias("lng"),
        F.max_by("lat2", tail).alias("lat2"), F.max_by("lng2", tail).alias("lng2"), F.count("*").alias("members"), *(F.sum(n).alias(n) for n in COUNTS),
    )


def timeline_jumps(episodes: DataFrame, raw: DataFrame) -> DataFrame:
    """W5-W7 from each of joined_moves to the next: gap_ms, jump_m and what they are.

    A jump over 500 m within a second is the source's if the records from which
    both come lie over 400 m apart themselves, or are one; else canonicalisation
    has made it.  raw(trip, id, lat, lng, lat2, lng2) are the records.
    """
    e = _neighbours(episodes)
    return e.join(_typed_jumps(e, raw).select("trip", "episode", "discontinuity"), ["trip", "episode"], "left").drop("hit")


def _neighbours(episodes: DataFrame) -> DataFrame:
    """joined_moves with what lies between each and the next, and whether that is a jump to be typed (hit)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "first")
    nxt = lambda x: F.lead(x).over(w)
    e = episodes.withColumns({"next": nxt("first"), "gap_ms": nxt("start_ms") - F.col("end_ms"), "jump_m": haversine("lat2", "lng2", nxt("lat"), nxt("lng"))})
    hit = F.coalesce(F.col("gap_ms").between(0, 1000) & (F.col("jump_m") > 500), F.lit(False))
    e = e.withColumn("hit", hit)
    small = F.col("jump_m").between(1, 500) & F.col("gap_ms").between(0, 900_000)
    fast = F.col("gap_ms").between(0, 300_000) & (F.col("jump_m") > 1000) & ((F.col("gap_ms") <= 1000) | (F.col("jump_m") / (F.col("gap_ms") / 1000) > 150))
    sure = lambda x: F.coalesce(x, F.lit(False))
    return e.withColumns({"violation": sure(F.col("gap_ms") < 0), "connector": sure(small), "true_gap": sure(~small & ((F.col("jump_m") > 5000) | (F.col("gap_ms") > 3_600_000))), "backtrack": sure(fast)})


def _typed_jumps(neighbours: DataFrame, raw: DataFrame) -> DataFrame:
    """(trip, episode, first, next, jump_m, discontinuity) of the jumps among _neighbours; the records of both sides are met in one join."""
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("first").alias("id")), F.struct(F.lit("b").alias("side"), F.col("next").alias("id")))
    ends = neighbours.where("hit").select("trip", "episode", "first", "next", "jump_m", F.inline(sides)).join(raw.select("trip", "id", "lat", "lng", "lat2", "lng2"), ["trip", "id"])
    # a record's ends, not those that its piece was cut to; where a side has none the jump stays untyped
    at = lambda side, lat, lng: F.max(F.when(F.col("side") == side, F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng"))))
    both = ends.groupBy("trip", "episode").agg(F.first("first").alias("first"), F.first("next").alias("next"), F.first("jump_m").alias("jump_m"), at("a", "lat2", "lng2").alias("a"), at("b", "lat", "lng").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    source = (F.col("first") == F.col("next")) | (haversine("a.lat", "a.lng", "b.lat", "b.lng") > 400)
    return both.select("trip", "episode", "first", "next", "jump_m", F.when(source, "SOURCE_TIMELINE_GAP").otherwise("CANONICALIZER_INTRODUCED_JUMP").alias("discontinuity"))


def canonical_diagnostics(records: DataFrame, raw: DataFrame) -> DataFrame:
    """For each trip the counters of canonicalisation, and its jumps and backtracks as text, over canonicalise_with_records."""
    from .staged import staged

    # jumps are found and typed in two branches, so the episodes are written once, with their neighbours: each branch would resolve every island anew, and deal them out anew
    e = staged(_neighbours(joined_moves(records.where("reason IS NULL"))), "episodes")
    told = lambda test, text: F.sort_array(F.collect_list(F.when(test, text)))
    jump = F.format_string("%s %d m %d-%d", "discontinuity", F.col("jump_m").cast("bigint"), "first", "next")
    back = F.format_string("%d km in %d s %d-%d", (F.col("jump_m") / 1000).cast("bigint"), F.expr("gap_ms div 1000"), "first", "next")
    d = F.col("discontinuity")
    jumps = _typed_jumps(e, raw).groupBy("trip").agg(F.count(d).alias("n"), F.count_if(d == "SOURCE_TIMELINE_GAP").alias("source"), F.count_if(d == "CANONICALIZER_INTRODUCED_JUMP").alias("introduced"), told(d.isNotNull(), jump).alias("notes"))
    trips = e.groupBy("trip").agg(
        F.sum("n_raw").alias("raw"), F.sum("n_groups").alias("groups"), F.sum("n_same_mode").alias("same_mode_conflicts"), F.sum("n_other_mode").alias("other_mode_conflicts"), F.sum("n_gone").alias("suppressed"), F.sum("n_cut").alias("cut"), F.sum("n_repaired").alias("repaired"),
        (F.sum("members") - F.count("*")).alias("joined"), F.count("*").alias("episodes"), F.count_if("connector").alias("connectors"), F.count_if("true_gap").alias("true_gaps"), F.count_if("violation").alias("violations"),
        F.count_if("backtrack").alias("backtracks"), told(F.col("backtrack"), back).alias("backtrack_notes"),
    )
    none = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    all_of = trips.join(jumps, "trip", "left").withColumns({"discontinuities": none("n"), "source_gaps": none("source"), "introduced_jumps": none("introduced"), "discontinuity_notes": F.coalesce("notes", F.array().cast("array<string>"))})
    last = ["discontinuities", "source_gaps", "introduced_jumps", "backtracks", "discontinuity_notes", "backtrack_notes"]
    return all_of.select(*(x for x in trips.columns if x not in last), *last)


def canonicalise_moves(moves: DataFrame) -> DataFrame:
    """A5 over moves(trip, id, mode, lat, lng, lat2, lng2, start_ms, end_ms, confidence, is_override, provenance, path); islands of one skip the kernel."""
    from pyspark.sql.window import Window

    from .sequence import islands

    rows = islands(moves, ["trip"], ["id"]).withColumns({"__n": F.count("*").over(Window.partitionBy("trip", "island")), "sliced": F.lit(False)})
    cols = [x.split()[0] for x in MOVE.split(", ")]
    return rows.where("__n = 1").select(*cols).unionByName(_grouped(rows.where("__n > 1").select(*cols), ["trip", "island"], canonical_moves, MOVE))


# A9, T4, T5 -----------------------------------------------------------------------------------


def _alike(a: dict, b: dict) -> bool:
    return bin((a["hash"] ^ b["hash"]) & (1 << 64) - 1).count("1") <= 6 and sum(abs(x - y) for x, y in zip(a["color"], b["color"])) < 0.22


PHOTO = "parent bigint, id bigint, ts_ms bigint, cluster int, is_first boolean"


def photo_moments(rows: list[dict], window_ms: int = 180_000, most_m: float = 300.0) -> list[dict]:
    """A photo joins the first cluster whose first photo is near in time and place and looks alike; without features it never does."""
    firsts: list[dict] = []
    out, low = [], 0
    for p in sorted(rows, key=lambda x: (x["ts_ms"], x["id"])):
        while low < len(firsts) and p["ts_ms"] - firsts[low]["ts_ms"] > window_ms:
            low += 1
        fits = lambda f: p["hash"] is not None and f["hash"] is not None and metres(p["lat"], p["lng"], f["lat"], f["lng"]) <= most_m and _alike(p, f)
        k = next((i for i in range(low, len(firsts)) if fits(firsts[i])), None)
        if k is None:
            firsts.append(p)
        out.append(p | {"cluster": len(firsts) - 1 if k is None else k, "is_first": k is None})
    return out


def hero_and_thumbnails(rows: list[dict], n: int = 3, repeat: int = 180) -> list[dict]:
    """T4: the best photo, then n more, each pick scored anew: a category already shown costs 180."""
    left, out, shown = sorted(rows, key=lambda x: x["id"]), [], set()
    while left and len(out) <= n:
        best = max(left, key=lambda x: (x["score"] - (repeat if x["category"] in shown else 0), -x["id"]))
        left.remove(best)
        shown.add(best["category"])
        out.append(best | {"rank": len(out)})
    return out


MOMENT = "trip bigint, id bigint, anchor bigint, day bigint, importance bigint, important boolean, moving boolean, clusters bigint, score bigint, category bigint, ts_ms bigint, pinned boolean"
BUDGETS = {"SHORT": 15, "STANDARD": 35, "FULL_STORY": 60}


def budgeted(rows: list[dict], profile: str = "STANDARD", repeat: int = 180) -> list[dict]:
    """T5 of one trip: a row is a cluster's best photo, with its anchor's day and importance.

    Pinned ones always.  Then, while the budget lasts: one of each important stay,
    a day at a time in turn; one of each stay left out; for all but the short
    story, important stays of two clusters or more up to two, of three or more up
    to three, where a category already shown for the stay costs 180; and one of
    each movement.  Stays and movements come by importance, photos by score.
    """
    budget, out = BUDGETS[profile], {r["id"]: r for r in rows if r["pinned"]}
    by_anchor: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["ts_ms"], r["id"])):
        by_anchor.setdefault(r["anchor"], []).append(r)
    order = sorted(by_anchor, key=lambda a: (-by_anchor[a][0]["importance"], a))
    used = {a: sum(r["pinned"] for r in own) for a, own in by_anchor.items()}

    def take(anchor: int, limit: int = 1, key=None) -> bool:
        left = [r for r in by_anchor[anchor] if r["id"] not in out]
        for r in sorted(left, key=key) if key else left[:1]:
            if len(out) < budget and (key is None or used[anchor] < limit):
                out[r["id"]] = r
                used[anchor] += 1
        return bool(left)

    stays = [a for a in order if not by_anchor[a][0]["moving"]]
    major = [a for a in stays if by_anchor[a][0]["important"]]
    days: dict[int, list[int]] = {}
    for a in major:
        days.setdefault(by_anchor[a][0]["day"], []).append(a)
    while len(out) < budget and any(days.values()):
        for day in sorted(days):
            while days[day] and not take(days[day].pop(0)):
                pass
    for a in stays:
        if not used[a]:
            take(a)
    if profile != "SHORT":
        for a in major:
            n = by_anchor[a][0]["clusters"]
            if n >= 2:
                shown = {r["category"] for r in out.values() if r["anchor"] == a}
                take(a, 3 if n >= 3 else 2, lambda r: (-(r["score"] - (repeat if r["category"] in shown else 0)), r["ts_ms"], r["id"]))  # noqa: B023
    for a in order:
        if by_anchor[a][0]["moving"]:
            take(a)
    return sorted(out.values(), key=lambda r: (r["ts_ms"], r["id"]))


def budgeted_moments(moments: DataFrame, profile: str = "STANDARD") -> DataFrame:
    """T5 over moments(trip, id, anchor, day, importance, important, moving, score, category, ts_ms, pinned).

    What no pass can reach goes before the kernel, so a trip of any size comes to
    a bounded number of rows beside its pinned ones: of an anchor, the first
    three of each category; of anchors, as many as the budget by importance in
    each of as many first days, of all stays twice as many, and of all movements.
    """
    from pyspark.sql.window import Window

    n = BUDGETS[profile]
    own = Window.partitionBy("trip", "anchor")
    m = moments.withColumns({"clusters": F.count("*").over(own), "__own": F.row_number().over(Window.partitionBy("trip", "anchor", "category").orderBy(F.desc("score"), "ts_ms", "id"))})
    m = m.where("pinned OR __own <= 3 + 3").drop("__own")
    free = m.where("NOT pinned").select("trip", "anchor", "day", "importance", "important", "moving").dropDuplicates(["trip", "anchor"])
    by = [F.desc("importance"), F.col("anchor")]
    kind = F.row_number().over(Window.partitionBy("trip", "moving").orderBy(*by))
    in_day = F.row_number().over(Window.partitionBy("trip", "day").orderBy(F.desc("important"), *by))
    major = F.when(F.col("important") & ~F.col("moving"), F.col("day"))
    days = free.where(major.isNotNull()).select("trip", "day").distinct().withColumn("__day", F.row_number().over(Window.partitionBy("trip").orderBy("day"))).where(F.col("__day") <= n)
    pick = free.withColumns({"__kind": kind, "__in_day": in_day}).join(days, ["trip", "day"], "left")
    pick = pick.where((F.col("__kind") <= 2 * n) | (F.col("important") & ~F.col("moving") & (F.col("__in_day") <= n) & F.col("__day").isNotNull())).select("trip", "anchor")
    held = m.join(pick, ["trip", "anchor"], "left_semi").where("NOT pinned").unionByName(m.where("pinned"))
    return _grouped(held.select(*(x.split()[0] for x in MOMENT.split(", "))), ["trip"], lambda rows: budgeted(rows, profile), MOMENT)


def heroes(photos: DataFrame, n: int = 3, repeat: int = 180) -> DataFrame:
    """T4 over photos(trip, id, score, category): of each category only the first n + 1 can be picked, so only they meet the kernel."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("trip", "category").orderBy(F.desc("score"), "id")
    few = photos.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n + 1).select("trip", "id", "score", "category")
    return _grouped(few, ["trip"], lambda rows: hero_and_thumbnails(rows, n, repeat), "trip bigint, id bigint, score bigint, category bigint, rank int")


# H6, G20 --------------------------------------------------------------------------------------


def images_features(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """H6, G20 of n images h x w x 3 of one size, at least 8 x 9: difference hash, variance of the Laplacian, share not clipped, histogram of 8 colours."""
    n, h, w = pixels.shape[:3]
    grey = pixels @ np.array([0.299, 0.587, 0.114])
    at = grey[:, np.arange(8) * h // 8][:, :, np.arange(9) * w // 9]
    bits = (at[:, :, :-1] > at[:, :, 1:]).reshape(n, 64)
    digest = np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]
    inner = grey[:, 1:-1, 1:-1]
    laplace = grey[:, 1:-1, :-2] + grey[:, 1:-1, 2:] + grey[:, :-2, 1:-1] + grey[:, 2:, 1:-1] - 4 * inner
    high = (pixels[:, 1:-1, 1:-1] >= 128) @ np.array([4, 2, 1])
    size = (h - 2) * (w - 2)
    colour = np.bincount((np.arange(n)[:, None] * 8 + high.reshape(n, size)).reshape(-1), minlength=8 * n).reshape(n, 8) / size
    return digest, laplace.reshape(n, size).var(axis=1), 1 - ((inner < 5) | (inner > 250)).reshape(n, size).mean(axis=1), colour


def image_features(pixels: np.ndarray) -> tuple[int, float, float, list[float]]:
    """H6, G20 of one h x w x 3 image."""
    digest, sharp, fine, colour = images_features(pixels[None])
    return int(digest[0]), float(sharp[0]), float(fine[0]), colour[0].tolist()


FEATURES = "id bigint, hash bigint, sharpness double, exposure double, color array<double>"
#: Pixels that ``extract_features`` works on at a time.
PIXELS = 1 << 20


def extract_features(images: DataFrame) -> DataFrame:
    """images(id, width, height, pixels: array<int> of 0xRRGGBB) to features, in Arrow batches; images of one size in a batch are worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wide, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("id", "width", "height"))
            column = batch.column("pixels")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            for w, h in sorted(set(zip(wide.tolist(), high.tolist()))):
                same, most = np.flatnonzero((wide == w) & (high == h)), max(1, PIXELS // (w * h))
                for k in range(0, len(same), most):
                    rows = same[k : k + most]
                    p = np.stack([flat[starts[i] : ends[i]] for i in rows]).astype(np.int64).reshape(len(rows), h, w)
                    digest, sharp, fine, colour = images_features(np.stack([p >> 16 & 255, p >> 8 & 255, p & 255], axis=3))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 8, pa.int32()), pa.array(colour.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(digest, pa.int64()), pa.array(sharp), pa.array(fine), lists], names=["id", "hash", "sharpness", "exposure", "color"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, FEATURES)


# G3 -------------------------------------------------------------------------------------------

SUMMARY = "trip bigint, names array<string>, others bigint"


def representative_names(rows: list[dict]) -> list[dict]:
    """Up to three labels, by priority, then use: hours, photos and days not yet covered."""
    groups: dict = {}
    for r in sorted(rows, key=lambda x: x["first"]):
        groups.setdefault(r["label"], r)
    left, out, days = list(groups.values()), [], set()
    while left and len(out) < 3:
        use = lambda g: 2 * math.log(1 + g["hours"]) + 2 * math.log(1 + g["photos"]) + 2 * min(3, len(set(g["days"]) - days))
        best = min(left, key=lambda g: (g["priority"], -use(g), g["first"]))
        out.append(best["label"])
        days |= set(best["days"])
        left.remove(best)
    return [{"trip": rows[0]["trip"], "names": out, "others": len(left)}]


# P4, P5, A10 ----------------------------------------------------------------------------------


def sliced(points, a, b, least_m: float = 1.0) -> Column:
    """The part of a timed path from a to b: made-up points at both ends, and the vertices between, over least_m from the one before.

    points: array<struct<ts_ms, lat, lng, ...>> in order of time, not empty.  An
    end within least_m of the last vertex kept takes its place.
    """
    from trekframe.functions.geo import c, distance, slerp

    at = lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))

    def when(p, t):
        def mid(q):
            f = (t - q["a"]["ts_ms"]) / F.greatest(F.lit(1), q["b"]["ts_ms"] - q["a"]["ts_ms"])
            return slerp(q["a"]["lat"], q["a"]["lng"], q["b"]["lat"], q["b"]["lng"], f)

        around = lambda i: let(F.struct(F.get(p, i - 1).alias("a"), F.get(p, i).alias("b")), mid)
        before = F.size(F.filter(p, lambda x: x["ts_ms"] < t))  # vertices before t
        return let(before, lambda i: F.when(i == 0, at(F.get(p, F.lit(0)))).when(i == F.size(p), at(F.element_at(p, -1))).otherwise(around(i)))

    def cut(p):
        inner = F.transform(F.filter(p, lambda x: (x["ts_ms"] > c(a)) & (x["ts_ms"] < c(b))), at)
        return let(F.concat(F.array(when(p, c(a))), inner), lambda q: let(when(p, c(b)), lambda end: closed(q, end)))

    def closed(q, end):
        last = running(q, F.get(q, F.lit(-1)), lambda k, x: F.when(k.isNull() | (distance(k, x) > least_m), x).otherwise(k))
        pairs = F.zip_with(q, last, lambda x, k: F.struct(x.alias("x"), (k.isNull() | (distance(k, x) > least_m)).alias("keep")))
        kept = F.transform(F.filter(pairs, lambda r: r["keep"]), lambda r: r["x"])
        return let(kept, lambda k: F.when((F.size(k) < 2) | (distance(F.element_at(k, -1), end) > least_m), F.concat(k, F.array(end))).otherwise(F.concat(F.slice(k, 1, F.size(k) - 1), F.array(end))))

    return let(c(points), cut)


def split_at_place(points, lat, lng, fraction, most_m: float = 3000.0) -> Column:
    """P5: struct<before, after>: the path cut at a place: at its nearest vertex within most_m, else at a fraction of its length."""
    from trekframe.functions.geo import c, haversine

    from .sequence import cumulative

    at = lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))
    both = lambda x, y: F.struct(x.alias("before"), y.alias("after"))
    part = lambda p, i, n: F.slice(p, i, n)

    def cut(p):
        n = F.size(p)
        far = F.transform(p, lambda x: haversine(x["lat"], x["lng"], lat, lng))
        return let(far, lambda d: F.when(F.array_min(d) <= most_m, let(F.array_position(d, F.array_min(d)).cast("int"), lambda k: both(part(p, F.lit(1), k), part(p, k, n)))).otherwise(let(cumulative(p), lambda run: by_length(p, n, run))))

    def by_length(p, n, run):
        goal = F.element_at(run, -1) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(fraction)))
        k = F.size(F.filter(run, lambda x: x <= goal))  # vertices up to the goal

        def middle(i):
            a, b, u, v = F.get(p, i - 1), F.get(p, i), F.get(run, i - 1), F.get(run, i)
            f = F.when(v > u, (goal - u) / (v - u)).otherwise(0.0)
            mid = F.struct((a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"), (a["lng"] + (b["lng"] - a["lng"]) * f).alias("lng"))
            return both(F.concat(part(p, F.lit(1), i), F.array(mid)), F.concat(F.array(mid), part(p, i + 1, n)))

        return let(k, lambda i: F.when(i >= n, both(p, part(p, n, F.lit(1)))).otherwise(middle(i)))

    return let(F.transform(c(points), at), cut)


def around_stays(moves: DataFrame, stays: DataFrame, least_ms: int = 1000) -> DataFrame:
    """A10: the parts of moves(trip, id, start_ms, end_ms) outside the stays(trip, b_start, b_end) that overlap them, by number; parts under a second are dropped."""
    from pyspark.sql.window import Window

    from .joins import overlap_join

    w = Window.partitionBy("trip", "id", "start_ms", "end_ms").orderBy("b_start", "b_end")
    held = F.coalesce(F.max("b_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("start_ms"))
    o = overlap_join(moves, stays, ["trip"]).withColumns({"after": F.greatest("start_ms", held), "last": F.lead("b_start").over(w).isNull()})
    tail = F.struct(F.greatest("after", "b_end").alias("a"), F.col("end_ms").alias("b"))
    parts = F.when(F.col("last"), F.array(F.struct(F.col("after").alias("a"), F.col("b_start").alias("b")), tail)).otherwise(F.array(F.struct(F.col("after").alias("a"), F.col("b_start").alias("b"))))
    cut = o.select("trip", "id", "start_ms", "end_ms", F.inline(parts)).where(F.col("b") - F.col("a") >= least_ms)
    n = F.row_number().over(Window.partitionBy("trip", "id", "start_ms", "end_ms").orderBy("a"))
    return cut.select("trip", "id", (n - 1).alias("piece"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
