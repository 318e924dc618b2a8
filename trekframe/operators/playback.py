"""The state of a story's playback: position, heading, speed and camera along routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.geo import angle_delta, bearing, c, slerp, smoothstep

from .joins import asof

#: Metres by which a heading looks ahead, by mode; others take the last.
LOOK_AHEAD = [("WALK", 15.0), ("RUN", 15.0), ("BICYCLE", 30.0), ("CAR", 80.0), ("BUS", 80.0), ("TRAIN", 200.0), ("SUBWAY", 200.0), ("AIRPLANE", 50_000.0), ("FERRY", 150.0)]
LOOK_AHEAD_ELSE = 50.0


def look_ahead(mode) -> Column:
    out = F.lit(LOOK_AHEAD_ELSE)
    for m, metres in LOOK_AHEAD:
        out = F.when(c(mode) == m, F.lit(metres)).otherwise(out)
    return out


def positions(points: DataFrame, route: DataFrame, at: str) -> DataFrame:
    """points(trip, move, ...) with lat and lng at the distance ``at`` along route (routes.legs), by a merge of distances and vertices.

    One shuffle by route, and work in proportion to its points and its vertices; a
    distance beyond an end is at that end.
    """
    legs = route.where("metres > 0").select("trip", "move", "run", "seq", "metres", "lat1", "lng1", "lat2", "lng2")
    on = asof(points.withColumn("__at", F.greatest(F.lit(0.0), at)), legs, ["trip", "move"], "__at", "run", ["seq", "metres", "lat1", "lng1", "lat2", "lng2"])
    share = F.least(F.lit(1.0), (F.col("__at") - F.col("r_run")) / F.col("r_metres"))
    return on.withColumn("__share", share).withColumn("__p", slerp("r_lat1", "r_lng1", "r_lat2", "r_lng2", "__share", "r_metres")).select(*points.columns, F.col("__p.lat").alias("lat"), F.col("__p.lng").alias("lng"))


#: Degrees within which a turn is straight back; on the globe a route's way back is some ten-thousandths off 180.
BACK = 0.01


def turn(a, b) -> Column:
    """The shortest turn from heading a to b; one straight back, within BACK, is about -180, whichever side rounding puts it."""
    d = c(b) - c(a)
    return d - 360.0 * F.floor((d + 180.0 + BACK) / 360.0)


def heading_samples(routes: DataFrame, route: DataFrame) -> DataFrame:
    """(trip, move, i, at, heading) at equal distances along each of routes(trip, move, mode), with legs in ``route``.

    A step is a hundredth of the way, from 5 to 50 m.  The heading is the bearing to
    the place some metres ahead, by mode; within 1.5 m of the end, from the place as
    far behind; else that of the sample before.  Turns are summed (straight back counts
    as -180), so that headings go on beyond 360, and smoothed 0.2 / 0.6 / 0.2.
    Routes under a metre have the one heading 0.
    """
    total = route.groupBy("trip", "move").agg(F.max("total").alias("total"))
    r = routes.select("trip", "move", look_ahead("mode").alias("look")).join(total, ["trip", "move"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    none = r.where("total < 1").select("trip", "move", F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("at"), F.lit(0.0).alias("heading"))
    r = r.where("total >= 1").withColumn("step", F.greatest(F.lit(5.0), F.least(F.lit(50.0), F.col("total") / 100)))
    s = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.round(F.col("total") / F.col("step"), 6)) + 1))).withColumn("at", F.least(F.col("i") * F.col("step"), "total"))
    spots = F.array(F.struct(F.lit("here").alias("which"), F.col("at").alias("d")), F.struct(F.lit("ahead").alias("which"), F.least(F.col("at") + F.col("look"), F.col("total")).alias("d")), F.struct(F.lit("behind").alias("which"), F.greatest(F.col("at") - F.col("look"), F.lit(0.0)).alias("d")))
    p = positions(s.select("trip", "move", "i", "at", F.inline(spots)), route, "d")
    three = p.groupBy("trip", "move", "i", "at").agg(*(F.max(F.when(F.col("which") == w, F.struct("d", "lat", "lng"))).alias(w) for w in ("here", "ahead", "behind")))
    to = lambda a, b: F.when(F.col(f"{b}.d") - F.col(f"{a}.d") >= 1.5, bearing(f"{a}.lat", f"{a}.lng", f"{b}.lat", f"{b}.lng"))
    w = Window.partitionBy("trip", "move").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    h = three.withColumn("own", F.coalesce(to("here", "ahead"), to("behind", "here")))
    h = h.withColumn("own", F.coalesce(F.last("own", ignorenulls=True).over(so_far), F.lit(0.0)))
    h = h.withColumn("turn", F.coalesce(turn(F.lag("own").over(w), F.col("own")), F.col("own"))).withColumn("sum", F.sum("turn").over(so_far))
    smooth = 0.2 * F.coalesce(F.lag("sum").over(w), "sum") + 0.6 * F.col("sum") + 0.2 * F.coalesce(F.lead("sum").over(w), "sum")
    return h.select("trip", "move", "i", "at", F.pmod(F.pmod(smooth, F.lit(360.0)) + 360.0, F.lit(360.0)).alias("heading")).unionByName(none)


def heading_at(points: DataFrame, track: DataFrame, at: str) -> DataFrame:
    """points(trip, move, ...) with the heading at the distance ``at``: between two samples by the shorter turn, beyond the ends that of the end."""
    w = Window.partitionBy("trip", "move").orderBy("i")
    t = track.withColumns({"next_at": F.lead("at").over(w), "next": F.lead("heading").over(w)}).select("trip", "move", F.col("at").alias("from"), "i", "heading", "next_at", "next")
    on = asof(points.withColumn("__at", F.greatest(F.lit(0.0), at)), t, ["trip", "move"], "__at", "from", ["i", "heading", "next_at", "next"])
    share = F.when(F.col("r_next_at") > F.col("r_from"), F.least(F.lit(1.0), (F.col("__at") - F.col("r_from")) / (F.col("r_next_at") - F.col("r_from")))).otherwise(0.0)
    turned = F.when(F.col("r_next").isNull(), F.col("r_heading")).otherwise(F.pmod(F.col("r_heading") + angle_delta(F.col("r_heading"), F.col("r_next")) * share + 360.0, F.lit(360.0)))
    return on.select(*points.columns, turned.alias("heading"))


def _headed(points: DataFrame, route: DataFrame, keys: list[str]) -> DataFrame:
    """(trip, move, *keys, h_lat, h_lng, l_lat, l_lng, heading) of points(trip, move, *keys, mode, at, lead): place and heading at ``at``, and the place at ``lead``.

    The heading is heading_at's over heading_samples.  Smoothing looks one sample
    to either side, so it hangs on the four samples round the point alone: a point
    costs fourteen places on its route, however long the route is.
    """
    total = route.groupBy("trip", "move").agg(F.max("total").alias("total"))
    p = points.join(total, ["trip", "move"]).withColumns({"__look": look_ahead("mode"), "__step": F.greatest(F.lit(5.0), F.least(F.lit(50.0), F.col("total") / 100)), "__d": F.greatest(F.lit(0.0), F.col("at"))})
    p = p.withColumn("__n", F.floor(F.round(F.col("total") / F.col("__step"), 6)) + 1)
    i = F.floor(F.col("__d") / F.col("__step"))
    i = F.when(i * F.col("__step") > F.col("__d"), i - 1).when((i + 1) * F.col("__step") <= F.col("__d"), i + 1).otherwise(i)
    p = p.withColumn("__i", F.when(F.col("__d") >= F.col("total"), F.col("__n")).otherwise(F.least("__n", i)))
    four = range(-1, 3)
    at = {k: F.least(F.greatest(F.lit(0), F.least("__n", F.col("__i") + k)) * F.col("__step"), F.col("total")) for k in four}
    spots = [F.col("at"), F.col("lead")]
    for k in four:
        spots += [at[k], F.least(at[k] + F.col("__look"), F.col("total")), F.greatest(at[k] - F.col("__look"), F.lit(0.0))]
    own = F.struct("__d", "total", "__n", "__i", "__step", "__look")
    far = p.select("trip", "move", *keys, own.alias("own"), F.posexplode(F.array(*spots)).alias("spot", "d")).withColumn("own", F.when(F.col("spot") == 0, F.col("own")))  # once, not with each spot
    found = positions(far, route, "d").groupBy("trip", "move", *keys).agg(F.max("own").alias("own"), *(F.max(F.when(F.col("spot") == n, F.struct("d", "lat", "lng"))).alias(f"s{n}") for n in range(len(spots))))
    found = found.select("trip", "move", *keys, "own.*", *(f"s{n}" for n in range(len(spots))))
    to = lambda a, b: F.when(F.col(f"{b}.d") - F.col(f"{a}.d") >= 1.5, bearing(f"{a}.lat", f"{a}.lng", f"{b}.lat", f"{b}.lng"))
    # on a route of a metre and a half a sample has a place 1.5 m ahead or behind; on a shorter one none has
    found = found.withColumns({f"b{k + 1}": F.coalesce(to(f"s{2 + 3 * (k + 1)}", f"s{3 + 3 * (k + 1)}"), to(f"s{4 + 3 * (k + 1)}", f"s{2 + 3 * (k + 1)}"), F.lit(0.0)) for k in four})

    def smooth(k: int) -> Column:
        here = F.col("__i") + k
        back = F.when(here > 0, turn(F.col(f"b{k}"), F.col(f"b{k + 1}"))).otherwise(0.0)
        on = F.when(here < F.col("__n"), turn(F.col(f"b{k + 1}"), F.col(f"b{k + 2}"))).otherwise(0.0)
        return F.pmod(F.pmod(F.col(f"b{k + 1}") - 0.2 * back + 0.2 * on, F.lit(360.0)) + 360.0, F.lit(360.0))

    found = found.withColumns({"h0": smooth(0), "h1": smooth(1)})
    a, b = F.col("s5.d"), F.col("s8.d")
    share = F.when(b > a, F.least(F.lit(1.0), (F.col("__d") - a) / (b - a))).otherwise(0.0)
    heading = F.when(F.col("__i") >= F.col("__n"), F.col("h0")).otherwise(F.pmod(F.col("h0") + angle_delta(F.col("h0"), F.col("h1")) * share + 360.0, F.lit(360.0)))
    return found.select("trip", "move", *keys, F.col("s0.lat").alias("h_lat"), F.col("s0.lng").alias("h_lng"), F.col("s1.lat").alias("l_lat"), F.col("s1.lng").alias("l_lng"), F.when(F.col("total") < 1, 0.0).otherwise(heading).alias("heading"))


#: Degrees that the camera spans, by mode; cars by metres of the way; at arrival and in a stay.
SPANS, SPAN_FAR, SPAN_MIDDLE, SPAN_NEAR, SPAN_ARRIVAL, SPAN_STAY = [("AIRPLANE", 6.0), ("FERRY", 0.18), ("TRAIN", 0.28), ("WALK", 0.045), ("BICYCLE", 0.045)], (80_000, 0.22), (20_000, 0.14), 0.085, 0.065, (0.080, 0.060)
DAY_MS, DAY_SHOWN_MS = 86_400_000, 4_000_000


def with_way_before(episodes: DataFrame) -> DataFrame:
    """Episodes(trip, id, kind, start_ms, end_ms, metres) with the metres of movements before each, way_before, and the trip's start, trip_ms."""
    order = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("kind") == "MOVE", F.col("metres")).otherwise(0.0)).over(order), F.lit(0.0))
    return episodes.withColumns({"way_before": before, "trip_ms": F.min("start_ms").over(Window.partitionBy("trip"))})


def state_on_route(progress: DataFrame, route: DataFrame) -> DataFrame:
    """The state at story times on the episodes' routes.

    progress(trip, id, k, media, progress) with what its episodes have from
    with_way_before, and their mode, lat, lng and seconds, as story.told_progress
    keeps them, so that nothing is joined back; route: legs by (trip, move = id).
    Of episodes only those at a sample's time are met here, however many a trip
    has, and routes of others need not be worked out.  A movement eases in and out of its way, looks ahead along
    its heading, and its camera leads it by up to 0.22 of the way to a place ahead;
    a stay stands at its place while the camera settles.  Speed rises and falls
    over a tenth of the way and is 0 while a photo is shown.
    """
    total = route.groupBy("trip", F.col("move").alias("id")).agg(F.max("total").alias("total"))
    p = progress.withColumnsRenamed({"lat": "e_lat", "lng": "e_lng"}).join(total, ["trip", "id"], "left")
    p = p.withColumn("total", F.coalesce("total", F.lit(0.0))).withColumn("at", F.col("total") * smoothstep("progress"))
    p = p.withColumn("lead", F.least("total", F.col("at") + F.greatest(F.lit(200.0), F.least(F.lit(35_000.0), F.col("total") * 0.18))))
    moving = p.where("kind = 'MOVE' AND total > 0").select("trip", F.col("id").alias("move"), "k", "mode", "at", "lead")
    both = _headed(moving, route, ["k"]).withColumnRenamed("move", "id")
    s = p.join(both, ["trip", "id", "k"], "left")
    move, f = F.col("kind") == "MOVE", F.col("progress")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    lat, lng = F.coalesce("h_lat", "e_lat"), F.coalesce("h_lng", "e_lng")
    span = F.when(F.col("total") > SPAN_FAR[0], SPAN_FAR[1]).when(F.col("total") > SPAN_MIDDLE[0], SPAN_MIDDLE[1]).otherwise(SPAN_NEAR)
    for m, degrees in SPANS:
        span = F.when(F.col("mode") == m, degrees).otherwise(span)
    near = clamp((f - 0.85) / 0.15)
    span = F.when((f > 0.85) & (F.col("mode") != "AIRPLANE"), span * (1 - near) + SPAN_ARRIVAL * near).otherwise(span)
    settle = clamp(f / 0.35)
    weight = 0.22 * F.when(f > 0.82, clamp(1 - (f - 0.82) / 0.18)).otherwise(F.least(F.lit(1.0), f / 0.12))
    lean = lambda a, b: F.when(F.col(b).isNotNull(), a * (1 - weight) + F.col(b) * weight).otherwise(a)
    hours = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) / 3_600_000
    mean = F.col("metres") / 1000 / hours
    base = F.when(mean.between(0.5, 1200.0), mean).when(F.col("seconds") > 0, F.col("total") / 1000 / (F.col("seconds") / 3600)).otherwise(0.0)
    envelope = smoothstep(F.least(clamp(f / 0.10), clamp((1 - f) / 0.10)))
    ts = F.col("start_ms") + ((F.col("end_ms") - F.col("start_ms")) * f).cast("bigint")
    s = s.withColumn("ts_ms", ts)
    day = F.expr(f"(ts_ms - trip_ms) div {DAY_MS}") + 1
    return s.select(
        "trip", "k", "id", "media", "ts_ms", lat.alias("lat"), lng.alias("lng"), F.when(move, F.coalesce("heading", F.lit(0.0))).otherwise(0.0).alias("heading"), F.when(move & F.col("media").isNull(), base * envelope).otherwise(0.0).alias("kmh"),
        F.when(move, lean(lat, "l_lat")).otherwise(lat).alias("camera_lat"), F.when(move, lean(lng, "l_lng")).otherwise(lng).alias("camera_lng"), F.when(move, span).otherwise(SPAN_STAY[0] * (1 - settle) + SPAN_STAY[1] * settle).alias("span"),
        day.alias("day"), ((day > 1) & (F.expr(f"(ts_ms - trip_ms) % {DAY_MS}") < DAY_SHOWN_MS)).alias("new_day"), (F.col("way_before") + F.when(move, F.col("metres") * clamp(F.col("at") / F.greatest(F.lit(1.0), "total"))).otherwise(0.0)).alias("travelled"),
    )
