"""Photos and points against routes: distance to a polyline, position by time or share of the way, and photo matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.geo import haversine, point_to_segment, slerp, wrapped_delta

from .joins import asof, in_groups, interval_join, nearest_in_time
from .staged import staged

#: Cells round the globe at each level; a level's cells are four times as wide as those before.
AROUND = [4096 // 4**i for i in range(7)]


def legs(paths: DataFrame) -> DataFrame:
    """paths(trip, move, seq, ts_ms, lat, lng) as legs between neighbours: t1, lat1, lng1, t2, lat2, lng2, metres, run before the leg, total."""
    w = Window.partitionBy("trip", "move").orderBy("seq")
    nxt = lambda x: F.lead(x).over(w)
    n = paths.select("trip", "move", "seq", F.col("ts_ms").alias("t1"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), nxt("ts_ms").alias("t2"), nxt("lat").alias("lat2"), nxt("lng").alias("lng2")).where("lat2 IS NOT NULL")
    n = n.withColumn("metres", haversine("lat1", "lng1", "lat2", "lng2"))
    before = F.coalesce(F.sum("metres").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return n.withColumns({"run": before, "total": F.sum("metres").over(Window.partitionBy("trip", "move"))})


def _cells(df: DataFrame, south: Column, west: Column, north: Column, east: Column) -> DataFrame:
    """Rows dealt to the cells of the finest level at which they cover at most three by three."""
    wide, level = F.greatest(north - south, east - west), F.lit(len(AROUND) - 1)
    for i in reversed(range(len(AROUND) - 1)):
        level = F.when(wide <= 2 * 360 / AROUND[i], i).otherwise(level)
    df = df.withColumns({"__s": south, "__w": west, "__n": north, "__e": east, "__level": level})
    n = F.element_at(F.array(*map(F.lit, AROUND)), F.col("__level") + 1)
    to = lambda x: F.floor(F.col(x) * n / 360)
    df = df.withColumn("__y", F.explode(F.sequence(to("__s"), to("__n"))))
    return df.withColumn("__x", F.explode(F.array_distinct(F.transform(F.sequence(to("__w"), to("__e")), lambda x: F.pmod(x, n))))).drop("__s", "__w", "__n", "__e")


def near_route(points: DataFrame, route: DataFrame, on: list[str], key: str) -> DataFrame:
    """(key, metres): the least distance from points(*on, key, lat, lng) to the legs of route(*on, ..., reach), where it is within their reach.

    A leg with its reach round it is dealt to cells as large as itself, so a point
    meets only legs near it, of its own route: the work does not grow with points
    times legs.  Legs may cross the antimeridian.
    """
    rise = F.col("reach") / 111_000
    far = F.lit(180.0)
    turn = F.col("lng1") + wrapped_delta(F.col("lng2") - F.col("lng1"))
    spread = F.least(far, rise / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("lat1"), F.abs("lat2")) + rise)))))
    dealt = _cells(route, F.least("lat1", "lat2") - rise, F.least(F.col("lng1"), turn) - spread, F.greatest("lat1", "lat2") + rise, F.greatest(F.col("lng1"), turn) + spread)
    levels = dealt.select("__level").distinct()
    at = points.withColumn("__level", F.explode(F.array(*map(F.lit, range(len(AROUND)))))).join(F.broadcast(levels), "__level", "left_semi")  # at most seven rows
    n = F.element_at(F.array(*map(F.lit, AROUND)), F.col("__level") + 1)
    at = at.withColumns({"__y": F.floor(F.col("lat") * n / 360), "__x": F.pmod(F.floor(F.col("lng") * n / 360), n)})
    both = at.join(dealt, [*on, "__level", "__y", "__x"]).withColumn("metres", point_to_segment("lat", "lng", "lat1", "lng1", "lat2", "lng2"))
    return both.where(F.col("metres") <= F.col("reach")).groupBy(*on, key).agg(F.min("metres").alias("metres"))


def on_route(points: DataFrame, route: DataFrame, key: str) -> DataFrame:
    """(trip, key, lat, lng): where points(trip, move, key, ts_ms, share) are on their route.

    Between the timed ends of the first leg that holds the time; where no leg
    does, at the share of the way.
    """
    names = ["trip", "move"]
    timed = route.where("t1 IS NOT NULL AND t2 IS NOT NULL AND t2 >= t1")
    held = interval_join(points.select(*names, key, "ts_ms"), timed, names, "ts_ms", "t1", "t2", prune=False)
    first = held.groupBy(*names, key).agg(F.min(F.struct("seq", "ts_ms", "t1", "t2", "lat1", "lng1", "lat2", "lng2", "metres")).alias("h"))
    part = F.when(F.col("h.t2") > F.col("h.t1"), (F.col("h.ts_ms") - F.col("h.t1")) / (F.col("h.t2") - F.col("h.t1"))).otherwise(0.0)
    by_time = first.select(*names, key, slerp("h.lat1", "h.lng1", "h.lat2", "h.lng2", part, "h.metres").alias("p"))
    rest = points.join(by_time.select(*names, key), [*names, key], "left_anti")
    total = route.groupBy(*names).agg(F.max("total").alias("total"))
    rest = rest.join(total, names).withColumn("target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share"))) * F.col("total"))
    found = asof(rest.select(*names, key, "target"), route.select(*names, "run", "seq", "metres", "lat1", "lng1", "lat2", "lng2"), names, "target", "run", ["seq", "metres", "lat1", "lng1", "lat2", "lng2"])
    part = F.when(F.col("r_metres") > 0, F.least(F.lit(1.0), (F.col("target") - F.col("r_run")) / F.col("r_metres"))).otherwise(0.0)
    by_share = found.where("r_seq IS NOT NULL").select(*names, key, slerp("r_lat1", "r_lng1", "r_lat2", "r_lng2", part, "r_metres").alias("p"))
    return by_time.unionByName(by_share).select("trip", key, "p.lat", "p.lng")


#: Metres to a stay, to a route, to a flight's route, and to a stay near in time; how near that is; minutes to a point.
TO_STAY, TO_ROUTE, TO_FLIGHT, TO_NEAR_STAY, NEAR_MS, NEAR_MINUTES = 1500, 3000, 50_000, 300, 7_200_000, 30


def match_photos(photos: DataFrame, visits: DataFrame, moves: DataFrame, points: DataFrame, paths: DataFrame) -> DataFrame:
    """A7 over photos(trip, id, ts_ms, lat, lng, gps, own, visit, move, confidence): match, position and how sure that is.

    visits(trip, id, start_ms, end_ms, lat, lng); moves the same with mode, lat2
    and lng2; paths(trip, move, seq, ts_ms, lat, lng) of the moves that have one,
    the others go straight from end to end; points(trip, id, ts_ms, lat, lng).

    A position that its user set (own) stays with what it was matched to.  A photo
    without a time keeps an exact position and is matched to nothing.  With an
    exact position: the stay of its time within 1500 m; the move of its time whose
    route passes within 3 km (50 km by air); of the stays within 2 h the nearest,
    if within 300 m; else nothing.  Without: the stay of its time and its place;
    the move and the place on its route; the nearest point within 30 whole
    minutes; else nothing.  What is on at a photo's time, and the routes asked
    for, are written once, since every rule reads them.
    """
    auto = photos.where("NOT own AND ts_ms IS NOT NULL").select("trip", "id", "ts_ms", "lat", "lng", "gps")

    visits, moves, paths, points = (in_groups(df, photos, ["trip"]) for df in (visits, moves, paths, points))
    m = moves.withColumnRenamed("id", "move")
    # what is on at a photo's time, stays and moves in one join
    span = ("start_ms", "end_ms", "id")
    both = visits.select("trip", F.lit("v").alias("side"), *span, "lat", "lng", F.lit(None).cast("string").alias("mode")).unionByName(moves.select("trip", F.lit("s").alias("side"), *span, F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), "mode"))
    both = both.withColumnsRenamed({x: f"a_{x}" for x in (*span, "lat", "lng", "mode")})
    held = interval_join(auto.select("trip", "id", "ts_ms"), both, ["trip"], "ts_ms", "a_start_ms", "a_end_ms", prune=False)
    first = lambda side, *more: F.min(F.when(F.col("side") == side, F.struct(*(F.col(f"a_{x}").alias(x) for x in (*span, *more)))))
    j = staged(auto.join(held.groupBy("trip", "id").agg(first("v", "lat", "lng").alias("v"), first("s", "mode").alias("s")), ["trip", "id"], "left"), "photos")
    # of the routes only those that a photo may lie on are worked out
    asked = j.where("s IS NOT NULL AND (gps OR v IS NULL)").select("trip", F.col("s.id").alias("move")).distinct()
    straight = F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), "lat", "lng"), F.struct(F.lit(1).cast("bigint").alias("seq"), F.col("lat2").alias("lat"), F.col("lng2").alias("lng")))
    m = m.join(asked, ["trip", "move"], "left_semi")
    own = paths.join(asked, ["trip", "move"], "left_semi").select("trip", "move", F.col("seq").cast("bigint").alias("seq"), "ts_ms", "lat", "lng")
    bare = m.join(own.select("trip", "move").distinct(), ["trip", "move"], "left_anti").select("trip", "move", F.inline(straight)).withColumn("ts_ms", F.lit(None).cast("bigint"))
    route = staged(legs(own.unionByName(bare.select(own.columns))), "routes")
    reach = F.when(F.col("mode") == "AIRPLANE", TO_FLIGHT).otherwise(TO_ROUTE).cast("double")
    reached = near_route(j.where("gps AND s IS NOT NULL").select("trip", F.col("s.id").alias("move"), "id", "lat", "lng"), route.join(m.select("trip", "move", reach.alias("reach")), ["trip", "move"]), ["trip", "move"], "id")
    length = F.col("s.end_ms") - F.col("s.start_ms")
    share = F.when(length > 0, (F.col("ts_ms") - F.col("s.start_ms")) / length).otherwise(0.0)
    placed = on_route(j.where("NOT gps AND v IS NULL AND s IS NOT NULL").select("trip", F.col("s.id").alias("move"), "id", "ts_ms", share.alias("share")), route, "id")
    near = interval_join(auto.where("gps").select("trip", "id", "ts_ms", "lat", "lng"), visits.select("trip", F.col("id").alias("n_id"), "start_ms", "end_ms", F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng")), ["trip"], "ts_ms", "start_ms", "end_ms", pad=NEAR_MS, prune=False)
    near = near.groupBy("trip", "id").agg(F.min(F.struct(F.round(haversine("lat", "lng", "n_lat", "n_lng"), 3).alias("m"), "n_id")).alias("n"))
    timed = nearest_in_time(j.where("NOT gps AND v IS NULL AND s IS NULL").select("trip", "id", "ts_ms"), points.select("trip", F.col("ts_ms").alias("at"), F.col("id").alias("point"), "lat", "lng"), ["trip"], "ts_ms", "at", ["point", "lat", "lng"])
    j = j.join(reached.select("trip", "id", F.lit(True).alias("reached")), ["trip", "id"], "left").join(placed.select("trip", "id", F.struct("lat", "lng").alias("p")), ["trip", "id"], "left").join(near, ["trip", "id"], "left")
    j = j.join(timed.select("trip", "id", "r_at", F.struct(F.col("r_lat").alias("lat"), F.col("r_lng").alias("lng")).alias("r")), ["trip", "id"], "left")
    kind = {f.name: f.dataType for f in photos.schema}
    none = F.lit(None)

    def got(visit, move, confidence, lat, lng, source):
        return F.struct(visit.cast(kind["visit"]).alias("visit"), move.cast(kind["move"]).alias("move"), F.lit(confidence).cast("double").alias("confidence") if not isinstance(confidence, Column) else confidence.cast("double").alias("confidence"), lat.cast("double").alias("lat"), lng.cast("double").alias("lng"), F.lit(source).alias("source"))

    v, s, exact = F.col("v.id"), F.col("s.id"), F.col("gps")
    minutes = F.floor(F.abs(F.col("r_at") - F.col("ts_ms")) / 60_000)
    along = F.when(F.col("s.mode") == "AIRPLANE", 0.70).when(length < 1_800_000, 0.85).otherwise(0.60)
    here = lambda visit, move: got(visit, move, 0.98, F.col("lat"), F.col("lng"), "GPS_EXACT")
    pick = (
        F.when(exact & (haversine("lat", "lng", "v.lat", "v.lng") <= TO_STAY), here(v, none)).when(exact & F.col("reached"), here(none, s)).when(exact & (F.col("n.m") <= TO_NEAR_STAY), here(F.col("n.n_id"), none))
        .when(exact, here(none, none)).when(v.isNotNull(), got(v, none, 0.92, F.col("v.lat"), F.col("v.lng"), "VISIT_INFERRED")).when(s.isNotNull(), got(none, s, along, F.col("p.lat"), F.col("p.lng"), "TIMELINE_INTERPOLATED"))
        .when(minutes <= NEAR_MINUTES, got(none, none, F.greatest(F.lit(0.4), F.least(F.lit(0.75), 1 - minutes / 40)), F.col("r.lat"), F.col("r.lng"), "TIMELINE_INTERPOLATED")).otherwise(got(none, none, 0.1, none, none, "TIME_ONLY"))
    )
    rest = photos.where("own OR ts_ms IS NULL")
    kept = F.when(F.col("own"), got(F.col("visit"), F.col("move"), F.col("confidence"), F.col("lat"), F.col("lng"), "USER")).when(exact, here(none, none)).otherwise(got(none, none, 0.0, none, none, "UNKNOWN"))
    return j.select("trip", "id", pick.alias("p")).unionByName(rest.select("trip", "id", kept.alias("p"))).select("trip", "id", "p.*")
