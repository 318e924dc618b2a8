"""Anchors, day assignment and the story's timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.geo import c, haversine


def anchor_score(ms, clusters, photos, eligible, arrival_m, is_override, is_named, pinned) -> Column:
    """struct<score, important> of a stay by dwell, photo clusters, arrival and labels; short stops without reason lose 1800."""
    when = lambda test, n: F.when(test, n).otherwise(0)
    short = (c(ms) < 2_400_000) & ~c(is_override) & (c(clusters) <= 1) & ~c(pinned) & (c(arrival_m) < 50_000)
    score = (
        F.least(F.lit(2000), F.floor(c(ms) / 60_000) * 10) + c(clusters) * 700 + F.least(F.lit(1000), c(eligible) * 40) + when(c(arrival_m) >= 50_000, 1500) + when(c(arrival_m) >= 100_000, 800)
        + when(c(is_override), 3000) + when(c(is_named), 500) + when(c(pinned), 5000) + when(c(ms) >= 21_600_000, 1500) - when(short, 1800)
    )
    important = (score >= 2000) | (c(photos) >= 5) | c(is_override) | (c(ms) >= 10_800_000) | ((c(arrival_m) >= 80_000) & (c(clusters) > 0))
    return F.struct(score.cast("bigint").alias("score"), important.alias("important"))


def assign_day(parent_day, own_day, consensus_day, status) -> Column:
    """The parent's day, the photo's own, what all zones agree on, or none, and how sure that is."""
    out = lambda d, s: F.struct(d.alias("day"), F.lit(s).alias("confidence"))
    none = out(F.lit(None).cast("date"), "UNKNOWN")
    return F.when(c(parent_day).isNotNull(), out(c(parent_day), "PARENT")).when(c(own_day).isNotNull(), out(c(own_day), "OWN_ZONE")).when(c(status) == "CONSENSUS", out(c(consensus_day), "CONSENSUS")).when(c(status) == "AMBIGUOUS", out(F.lit(None).cast("date"), "AMBIGUOUS")).otherwise(none)


#: Seconds of a movement by mode; others take the last.
MODE_SECONDS = [("AIRPLANE", 5.5), ("TRAIN", 4.0), ("FERRY", 4.0), ("CAR", 3.5), ("BUS", 3.5), ("BICYCLE", 2.8)]


def story_seconds(kind, mode, metres, photos) -> Column:
    """Story time of an episode: movements by mode and route length, at most 18 s; stays 2 s and 1.8 s a photo after the first at 2.5 s."""
    base = F.lit(2.2)
    for m, s in MODE_SECONDS:
        base = F.when(c(mode) == m, F.lit(s)).otherwise(base)
    move = F.least(F.lit(18.0), base + 1.8 * F.log(1 + c(metres) / 5000))
    stay = 2.0 + F.when(c(photos) > 0, 2.5 + 1.8 * (c(photos) - 1)).otherwise(0.0)
    return F.round(F.when(c(kind) == "MOVE", move).otherwise(stay), 6)


def bridges(episodes: DataFrame) -> DataFrame:
    """Between neighbours over 150 m apart in time order, a made-up movement of 2 + 0.5 ln(1 + km) s, from 2 to 5."""
    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id")
    n = episodes.withColumns({"n_lat": F.lead("lat").over(w), "n_lng": F.lead("lng").over(w), "n_start": F.lead("start_ms").over(w)})
    far = haversine("lat", "lng", "n_lat", "n_lng")
    gap = n.withColumn("metres", far).where((F.col("metres") > 150) & (F.col("n_start") > F.col("end_ms")))
    return gap.select("trip", F.concat(F.lit("bridge_"), F.col("id").cast("string")).alias("id"), F.col("end_ms").alias("start_ms"), F.col("n_start").alias("end_ms"), "metres", bridge_seconds("metres").alias("seconds"))


def build_story(items: DataFrame, max_stays: int = 25, max_moves: int = 30) -> DataFrame:
    """A11 over items(trip, id, kind: VISIT or MOVE, start_ms, end_ms, mode, metres, photos, required, lat, lng, lat2, lng2): the story's episodes.

    Of stays and of movements those that are required stay, then the first and
    the last, then the longest, up to a number each.  They are put in order of
    time; between neighbours apart in place and time comes a made-up movement.
    Times never run backwards, and every episode has its seconds and its start.
    """
    from .sequence import monotonic

    stay = F.col("kind") == "VISIT"
    of = Window.partitionBy("trip", "kind")
    edge = (F.row_number().over(of.orderBy("start_ms", "end_ms", "id")) == 1) | (F.row_number().over(of.orderBy(F.desc("start_ms"), F.desc("end_ms"), F.desc("id"))) == 1)
    first = F.when(F.col("required"), 0).when(F.col("__edge"), 1).otherwise(2)
    i = items.withColumn("__edge", edge).withColumns({"__first": first, "__long": F.when(stay, (F.col("end_ms") - F.col("start_ms")).cast("double")).otherwise(F.col("metres"))})
    i = i.withColumn("__r", F.row_number().over(of.orderBy("__first", F.desc("__long"), "id"))).where(F.col("__r") <= F.when(stay, max_stays).otherwise(max_moves))
    i = i.withColumn("seconds", story_seconds("kind", "mode", "metres", "photos"))
    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id")
    n = i.withColumns({"n_lat": F.lead("lat").over(w), "n_lng": F.lead("lng").over(w), "n_start": F.lead("start_ms").over(w), "far": haversine("lat2", "lng2", F.lead("lat").over(w), F.lead("lng").over(w))})
    names = ["trip", "id", "kind", "start_ms", "end_ms", "seconds"]
    own = F.struct(F.col("id").cast("string").alias("id"), "kind", "start_ms", "end_ms", "seconds")
    made = F.struct(F.concat(F.lit("bridge_"), F.col("id").cast("string")).alias("id"), F.lit("BRIDGE").alias("kind"), F.col("end_ms").alias("start_ms"), F.col("n_start").alias("end_ms"), bridge_seconds("far").alias("seconds"))
    apart = F.coalesce((F.col("far") > 150) & (F.col("n_start") > F.col("end_ms")), F.lit(False))
    episodes = n.select("trip", F.inline(F.when(apart, F.array(own, made)).otherwise(F.array(own)))).select(names)
    return schedule(monotonic(episodes, ["trip"], ["id"]))


def bridge_seconds(metres) -> Column:
    """Seconds of a made-up movement: 2 + 0.5 ln(1 + km), from 2 to 5."""
    return F.round(F.least(F.lit(5.0), F.greatest(F.lit(2.0), 2 + 0.5 * F.log(1 + c(metres) / 1000))), 6)


def schedule(episodes: DataFrame) -> DataFrame:
    """story_start of each episode: the seconds before it, per trip."""
    w = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return episodes.withColumn("story_start", F.round(F.coalesce(F.sum("seconds").over(w), F.lit(0.0)), 6))


def evaluate(episodes: DataFrame, samples: int = 20) -> DataFrame:
    """The state at evenly spaced story times: episode, progress and position on its great circle.

    Each episode makes its own samples, so nothing is compared across episodes.
    episodes(trip, id, story_start, seconds, total, lat, lng, lat2, lng2)
    """
    from trekframe.functions.geo import slerp

    step = F.col("total") / samples
    first, last = F.ceil(F.round(F.col("story_start") / step, 9)), F.ceil(F.round((F.col("story_start") + F.col("seconds")) / step, 9)) - 1
    s = episodes.where(last >= first).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("t", F.col("k") * step)
    s = s.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("story_start")) / F.col("seconds"))))
    return s.withColumn("p", slerp("lat", "lng", "lat2", "lng2", "progress")).select("trip", "k", "id", F.round("progress", 6).alias("progress"), F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


#: Seconds a photo is shown, of a moment's representative and of others; the least, the room a photo takes, and the gap between two.
SHOWN_BEST, SHOWN, SHOWN_LEAST, ROOM, ROOM_SPARE, GAP = 2.5, 1.8, 1.0, 2.6, 0.6, 0.05


def micros(seconds) -> Column:
    """Seconds as whole microseconds, a half up; by way of nanoseconds, so that a half is one however it was summed."""
    n = F.round(c(seconds) * 1e9).cast("bigint") + 500
    return ((n - F.pmod(n, F.lit(1000))) / 1000).cast("bigint")


def with_photo_room(episodes: DataFrame, moments: DataFrame) -> DataFrame:
    """episodes(trip, id, seconds) lengthened so that each of their moments(trip, parent) has room, and n_moments."""
    n = moments.groupBy("trip", F.col("parent").alias("id")).agg(F.count("*").alias("n_moments"))
    e = episodes.join(n, ["trip", "id"], "left").withColumn("n_moments", F.coalesce("n_moments", F.lit(0)))
    return e.withColumn("seconds", with_room("seconds", "n_moments"))


def with_room(seconds, n) -> Column:
    """Seconds of an episode, lengthened so that n moments have room."""
    return F.round(F.greatest(c(seconds), F.when(c(n) > 0, c(n) * ROOM + ROOM_SPARE).otherwise(0.0)), 6)


def photo_windows(episodes: DataFrame, moments: DataFrame) -> DataFrame:
    """When each of moments(trip, parent, media, ts_ms, best) is shown within its episode.

    episodes(trip, id, kind, start_ms, end_ms, seconds, story_start).  In order of
    time each photo is centred at its share of the episode, but starts no earlier
    than the one before ends and leaves room for those to come; one that would
    start within a hundredth second of the episode's end is left out, and so are
    all after it.  A start is the greatest of its own bound and the start before
    plus what that is shown, so it is a running maximum over prefix sums: one
    window by episode, no fold.  Result: trip, id, media, shown_from, shown_to.
    """
    at = Window.partitionBy("trip", "id").orderBy("ts_ms", "media")
    every = Window.partitionBy("trip", "id")
    m = moments.withColumnRenamed("parent", "id").join(episodes, ["trip", "id"])
    m = _laid(m.withColumns({"n": F.count("*").over(every), "k": F.row_number().over(at)}), at)
    return m.where(_SHOWS).select("trip", "id", "media", (F.col("__a") / 1e6).alias("shown_from"), (F.col("__b") / 1e6).alias("shown_to"))


#: Whether a photo is shown at all.
_SHOWS = "__b > __a + 10000"


def _laid(m: DataFrame, at) -> DataFrame:
    """photo_windows' rows, photo k of n of their episode, with the window's ends __a and __b in microseconds; at: an episode's photos in order, before which a row k = 0 may stand."""
    share = F.greatest(F.lit(0.05), F.least(F.lit(0.95), (F.col("ts_ms") - F.col("start_ms")) / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))))
    shown = F.least(F.when(F.col("best"), SHOWN_BEST).otherwise(SHOWN), F.greatest(F.lit(SHOWN_LEAST), F.col("seconds") / F.greatest(F.lit(1), "n") * 0.9))
    m = m.withColumns({"shown": shown, "stop": F.col("story_start") + F.col("seconds"), "settle": F.when(F.col("kind") == "MOVE", 0.0).otherwise(F.least(F.lit(0.35), F.col("seconds") * 0.12))})
    # the first photo keeps the gap to the episode's start as well
    earliest = F.col("story_start") + F.when(F.col("k") == 1, F.greatest("settle", F.lit(GAP))).otherwise(F.col("settle"))
    latest = F.col("stop") - (F.col("n") - F.col("k") + 1) * (F.col("shown") + GAP)
    own = F.when(F.col("k") > 0, F.greatest(earliest, F.least(latest, F.col("story_start") + F.col("seconds") * share - F.col("shown") / 2)))
    before = F.coalesce(F.sum(F.when(F.col("k") > 0, F.col("shown") + GAP).otherwise(0.0)).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    m = m.withColumns({"own": own, "before": before})
    start = F.col("before") + F.max(F.col("own") - F.col("before")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("start", start).withColumns({"__a": micros("start"), "__b": micros(F.least("stop", F.col("start") + F.col("shown")))})
    return m.drop("shown", "stop", "settle", "own", "before", "start")


def with_holds(episodes: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes, windows) in which movements stand still while a photo is shown, instead of going on faster between photos.

    A movement's photo holds the route at the middle of its window; the movement
    lasts longer by all its holds, and all later episodes and windows move.
    """
    held = windows.groupBy("trip", "id").agg(F.sum(F.col("shown_to") - F.col("shown_from")).alias("held"))
    order = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    e = episodes.join(held, ["trip", "id"], "left").withColumn("held", F.when(F.col("kind") == "MOVE", F.coalesce("held", F.lit(0.0))).otherwise(0.0))
    e = e.withColumn("shift", F.coalesce(F.sum("held").over(order), F.lit(0.0)))
    w = windows.join(e.select("trip", "id", "kind", "shift"), ["trip", "id"])
    # in whole microseconds, so that the middle of a window is the same however the times before it were summed; a half goes up
    a, b, shift = micros("shown_from"), micros("shown_to"), micros("shift")
    prior = F.coalesce(F.sum(b - a).over(Window.partitionBy("trip", "id").orderBy("shown_from", "media").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    start = _moved(a, b, prior, shift)
    w = w.withColumns({"start": start, "length": b - a}).select("trip", "id", "media", (F.col("start") / 1e6).alias("shown_from"), ((F.col("start") + F.col("length")) / 1e6).alias("shown_to"))
    e = e.withColumns({"seconds": F.round(F.col("seconds") + F.col("held"), 6), "story_start": F.round(F.col("story_start") + F.col("shift"), 6), "held": F.round("held", 6)}).drop("shift")
    return e, w


def _moved(a: Column, b: Column, prior: Column, shift: Column) -> Column:
    """When a window from a to b begins, in microseconds, after holds of ``prior`` in its own episode and of ``shift`` before it."""
    middle = ((a + b + 1 - F.pmod(a + b + 1, F.lit(2))) / 2).cast("bigint")
    return F.when(F.col("kind") == "MOVE", middle + prior).otherwise(a) + shift


def told(episodes: DataFrame) -> DataFrame:
    """photo_windows and with_holds of episodes(trip, id, kind, start_ms, end_ms, seconds, story_start, moments) that hold their moments: array<struct<ts_ms, media, best>>.

    A row k = 0 for each episode and one for each of its photos in order, with all
    columns of the episode but moments.  seconds, story_start and held are those
    with holds; media, shown_from and shown_to are null where none is shown.  All windows run within a trip over
    rows in one order: a trip's rows are dealt out once, however many steps follow.
    """
    kind = episodes.schema["moments"].dataType
    photos = F.coalesce(F.sort_array("moments"), F.array().cast(kind))
    rows = episodes.select(*(x for x in episodes.columns if x != "moments"), F.size(photos).alias("n"), F.posexplode(F.concat(F.array(F.lit(None).cast(kind.elementType)), photos)).alias("k", "__m"))
    at = Window.partitionBy("trip", "start_ms", "end_ms", "id").orderBy("k")
    order = Window.partitionBy("trip").orderBy("start_ms", "end_ms", "id", "k")
    m = _laid(rows.select("*", "__m.ts_ms", "__m.media", "__m.best"), at)
    shows, move = F.coalesce(F.expr(_SHOWS), F.lit(False)), F.col("kind") == "MOVE"
    m = m.withColumns({"__length": F.when(shows, F.col("__b") - F.col("__a")), "__hold": F.when(shows & move, F.col("__b") - F.col("__a")).otherwise(0)})
    so_far = lambda w: F.coalesce(F.sum("__hold").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumns({"__prior": so_far(at), "__shift": so_far(order), "__held": F.sum("__hold").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    shift = F.col("__shift") - F.col("__prior")
    m = m.withColumn("__start", F.when(F.col("__length").isNotNull(), _moved(F.col("__a"), F.col("__b"), F.col("__prior"), shift)))
    own = [x for x in rows.columns if x not in ("seconds", "story_start", "n", "k", "__m")]
    return m.select(
        *own, F.round(F.col("seconds") + F.col("__held") / 1e6, 6).alias("seconds"), F.round(F.col("story_start") + shift / 1e6, 6).alias("story_start"), (F.col("__held") / 1e6).alias("held"), "k", F.when(F.col("__start").isNotNull(), F.col("media")).alias("media"),
        (F.col("__start") / 1e6).alias("shown_from"), ((F.col("__start") + F.col("__length")) / 1e6).alias("shown_to"),
    )


def told_progress(told: DataFrame, samples: int) -> DataFrame:
    """hold_progress at evenly spaced story times of each trip, of told's rows: (trip, k, t, id, media, hold, progress) and the columns of the episode.

    An episode's row has the times before its first photo, a photo's row those
    until the next, so each row makes its own samples and nothing is compared.
    """
    at = Window.partitionBy("trip", "start_ms", "end_ms", "id").orderBy("k")
    total = F.max(F.col("story_start") + F.col("seconds")).over(Window.partitionBy("trip"))
    behind = F.coalesce(F.sum(F.col("shown_to") - F.col("shown_from")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = told.withColumns({"__step": total / samples, "__next": F.lead("shown_from").over(at), "__behind": behind}).where("k = 0 OR shown_from IS NOT NULL")
    first, last = _sample_range(F.col("__step"))
    # a sample more on either side, so that rounding loses none
    first, last = F.greatest(first, F.floor(F.col("shown_from") / F.col("__step")) - 1), F.least(last, F.ceil(F.col("__next") / F.col("__step")) + 1)
    s = r.where(last >= first).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("t", F.col("k") * F.col("__step"))
    s = s.where("(shown_from IS NULL OR t >= shown_from) AND (__next IS NULL OR t < __next)")
    within = F.coalesce(F.col("t") < F.col("shown_to"), F.lit(False))
    # what a hold has lasted so far counts and goes again, as in the SQL: a time at a day's end hangs on the last digit
    lasted = F.col("t") - F.col("shown_from")
    behind = F.when(within, F.col("__behind") + lasted - lasted).otherwise(F.col("__behind") + F.coalesce(F.col("shown_to") - F.col("shown_from"), F.lit(0.0)))
    hold = within & (F.col("kind") == "MOVE")
    s = s.withColumns({"media": F.when(within, F.col("media")), "hold": hold, "progress": _progress(F.when(hold, F.col("shown_from")).otherwise(F.col("t")), F.when(F.col("kind") == "MOVE", behind).otherwise(0.0))})
    return s.drop("shown_from", "shown_to", "__behind", "__step", "__next")


def _progress(clock: Column, behind: Column) -> Column:
    """Share of an episode's seconds without holds that has gone by at a story time, with so many seconds of holds behind."""
    travel = F.col("seconds") - F.col("held")
    return F.when(travel > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (clock - F.col("story_start") - behind) / travel))).otherwise(1.0)


def hold_progress(samples: DataFrame, episodes: DataFrame, windows: DataFrame) -> DataFrame:
    """samples(trip, id, k, t) of story times within episodes, with the photo shown and the progress on the route.

    Story time runs on in a movement's holds, its route's clock does not: progress
    is the time since the episode's start less the holds behind, over the
    episode's seconds without holds.  Samples and windows are stacked by time, and
    a running sum and the last window are carried to each sample: one shuffle by
    episode, whatever the number of holds.
    """
    none = F.lit(None)
    s = samples.select("trip", "id", "t", F.lit(1).alias("side"), "k", none.cast(windows.schema["media"].dataType).alias("media"), none.cast("double").alias("from"), none.cast("double").alias("to"))
    w = windows.select("trip", "id", F.col("shown_from").alias("t"), F.lit(0).alias("side"), none.cast(samples.schema["k"].dataType).alias("k"), "media", F.col("shown_from").alias("from"), F.col("shown_to").alias("to"))
    at = Window.partitionBy("trip", "id").orderBy("t", "side", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("media", "from", "to")), ignorenulls=True).over(at)
    both = s.unionByName(w).withColumns({"last": last, "behind": F.coalesce(F.sum(F.col("to") - F.col("from")).over(at), F.lit(0.0))}).where("side = 1")
    j = both.join(episodes.select("trip", "id", "kind", "seconds", "story_start", "held"), ["trip", "id"])
    within = F.coalesce(F.col("t") < F.col("last.to"), F.lit(False))
    hold = within & (F.col("kind") == "MOVE")
    clock = F.when(hold, F.col("last.from")).otherwise(F.col("t"))
    behind = F.when(F.col("kind") != "MOVE", 0.0).when(hold, F.col("behind") - (F.col("last.to") - F.col("last.from"))).otherwise(F.col("behind"))
    return j.select("trip", "k", "t", "id", F.when(within, F.col("last.media")).alias("media"), hold.alias("held"), _progress(clock, behind).alias("progress"))


def story_samples(episodes: DataFrame, samples: int) -> DataFrame:
    """(trip, id, k, t): evenly spaced story times of each trip; each episode makes its own, so nothing is compared across episodes."""
    total = episodes.groupBy("trip").agg(F.max(F.col("story_start") + F.col("seconds")).alias("total"))
    e = episodes.join(total, "trip").withColumn("step", F.col("total") / samples)
    first, last = _sample_range(F.col("step"))
    return e.where(last >= first).withColumn("k", F.explode(F.sequence(first.cast("int"), last.cast("int")))).select("trip", "id", "k", (F.col("k") * F.col("step")).alias("t"))


def _sample_range(step: Column) -> tuple[Column, Column]:
    """The first and the last sample within an episode."""
    return F.ceil(F.round(F.col("story_start") / step, 6)), F.ceil(F.round((F.col("story_start") + F.col("seconds")) / step, 6)) - 1


def window_violations(episodes: DataFrame, windows: DataFrame) -> DataFrame:
    """For each trip its windows, those without a parent, out of their parent by over 0.02 s, whose middle lies in another episode, or that overlap the one before."""
    return told_violations(windows.join(episodes.select("trip", "id", "story_start", "seconds"), ["trip", "id"], "left"))


def told_violations(w: DataFrame) -> DataFrame:
    """window_violations of windows that hold the story_start and seconds of their episode, null where it is missing."""
    stop, middle = F.col("story_start") + F.col("seconds"), (F.col("shown_from") + F.col("shown_to")) / 2
    before = F.lag("shown_to").over(Window.partitionBy("trip").orderBy("shown_from", "media"))
    w = w.withColumn("overlaps", F.coalesce(F.col("shown_from") < before - 1e-5, F.lit(False)))
    known = F.col("story_start").isNotNull()
    return w.groupBy("trip").agg(
        F.count("*").alias("windows"), F.count_if(~known).alias("orphans"), F.count_if(known & ((F.col("shown_from") < F.col("story_start") - 0.02) | (F.col("shown_to") > stop + 0.02))).alias("outside"),
        F.count_if(known & ~((middle >= F.col("story_start")) & (middle < stop))).alias("strangers"), F.count_if("overlaps").alias("overlapping"),
    )
