"""Days of a trip: stays, movements and photos in order, day by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.functions.timefn import local_date

#: Items of one time stand in this order.
KINDS = ["VISIT", "MOVE", "CONTEXT_VISIT", "CONTEXT_MOVE", "UNASSIGNED"]


def _clamped(first: Column, last: Column) -> Column:
    """The first day, brought into the trip where the span meets it."""
    a, b = F.col("start_day"), F.col("end_day")
    return F.when((last >= a) & (first <= b), F.greatest(a, F.least(b, first))).otherwise(first)


def anchor_visits(visits: DataFrame, trips: DataFrame) -> DataFrame:
    """visits(trip, id, start_ms, end_ms, zone, ...) with the day they belong to: that of their start in their zone; without a zone they span the trip."""
    v = visits.join(trips.select("trip", "start_day", "end_day"), "trip")
    first, last = F.coalesce(local_date("start_ms", "zone"), "start_day"), F.coalesce(local_date("end_ms", "zone"), "end_day")
    return v.withColumn("day", _clamped(first, last)).drop("start_day", "end_day")


def anchor_moves(moves: DataFrame, trips: DataFrame) -> DataFrame:
    """moves(trip, id, start_ms, end_ms, zone, end_zone, ...) with their day: the earlier of those of start and end, each in its own zone."""
    m = moves.join(trips.select("trip", "start_day", "end_day"), "trip")
    m = m.withColumns({"a": F.coalesce(local_date("start_ms", "zone"), "start_day"), "b": F.coalesce(local_date("end_ms", F.coalesce("end_zone", "zone")), "end_day")})
    return m.withColumn("day", _clamped(F.least("a", "b"), F.greatest("a", "b"))).drop("a", "b", "start_day", "end_day")


def day_items(trips: DataFrame, visits: DataFrame, moves: DataFrame, photos: DataFrame, known_visits: DataFrame | None = None) -> DataFrame:
    """The items of every day: (trip, day, day_index, place, kind, id, label, n_photos, ts_ms).

    trips(trip, start_day, end_day); visits with name, moves with mode, both as in
    anchor_visits and anchor_moves; photos(trip, id, ts_ms, day, visit, move).
    known_visits: the canonical ones, which name a stay; by default ``visits``.

    A photo with two parents keeps the stay.  On its parent's day it counts to the
    parent's item; on another day, or where the parent is not there, to a group of
    that parent's photos, at the time of the first; without a parent to the day's
    unassigned block, which comes first.  Photos without a day in the trip are
    left out.  Items are numbered by time, then kind, then id; days from 1, days
    without an item too, with null items.
    """
    v, m = anchor_visits(visits, trips), anchor_moves(moves, trips)
    p = photos.withColumn("move", F.when(F.col("visit").isNull(), F.col("move"))).join(trips.select("trip", "start_day", "end_day"), "trip").where("day BETWEEN start_day AND end_day").drop("start_day", "end_day")
    # a parent may be there on one day only, so its day is joined by its key
    p = p.join(v.select("trip", F.col("id").alias("visit"), F.col("day").alias("v_day")).distinct(), ["trip", "visit"], "left").join(m.select("trip", F.col("id").alias("move"), F.col("day").alias("m_day")).distinct(), ["trip", "move"], "left")
    home = F.coalesce(F.col("v_day") == F.col("day"), F.lit(False)) | F.coalesce(F.col("m_day") == F.col("day"), F.lit(False))
    kind = F.when(F.col("visit").isNotNull(), F.when(home, "VISIT").otherwise("CONTEXT_VISIT")).when(F.col("move").isNotNull(), F.when(home, "MOVE").otherwise("CONTEXT_MOVE")).otherwise("UNASSIGNED")
    count = p.groupBy("trip", "day", kind.alias("kind"), F.coalesce("visit", "move").alias("id")).agg(F.count("*").alias("n_photos"), F.min_by(F.coalesce("ts_ms", F.lit(0)), F.struct(F.col("ts_ms").isNull(), "ts_ms", "id")).alias("first_ms"))
    own = v.select("trip", "day", F.lit("VISIT").alias("kind"), "id", F.col("name").alias("label"), F.col("start_ms").alias("ts_ms")).unionByName(m.select("trip", "day", F.lit("MOVE").alias("kind"), "id", F.col("mode").alias("label"), F.col("start_ms").alias("ts_ms")))
    own = own.join(count.drop("first_ms"), ["trip", "day", "kind", "id"], "left").withColumn("n_photos", F.coalesce("n_photos", F.lit(0)))
    names = (visits if known_visits is None else known_visits).select("trip", "id", F.concat(F.coalesce("name", F.lit("Place")), F.lit(" — continued stay")).alias("v_label"))
    modes = moves.select("trip", "id", F.concat(F.lit("During "), F.lower("mode")).alias("m_label"))
    other = count.where("kind NOT IN ('VISIT', 'MOVE')")
    stays = other.where("kind = 'CONTEXT_VISIT'").join(names, ["trip", "id"], "left").withColumn("label", F.coalesce("v_label", F.lit("Continued stay"))).drop("v_label")
    rides = other.where("kind = 'CONTEXT_MOVE'").join(modes, ["trip", "id"], "left").withColumn("label", F.coalesce("m_label", F.lit("During transit"))).drop("m_label")
    rest = other.where("kind = 'UNASSIGNED'").withColumns({"label": F.lit(None).cast("string"), "first_ms": F.lit(0).cast("bigint")})
    items = stays.unionByName(rides).unionByName(rest).withColumnRenamed("first_ms", "ts_ms").unionByName(own)
    order = Window.partitionBy("trip", "day").orderBy("ts_ms", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "id")
    items = items.withColumn("place", F.row_number().over(order))
    days = trips.select("trip", "start_day", F.explode(F.sequence("start_day", "end_day")).alias("day")).select("trip", "day", (F.datediff("day", "start_day") + 1).alias("day_index"))
    return days.join(items, ["trip", "day"], "left").select("trip", "day", "day_index", "place", "kind", "id", "label", "n_photos", "ts_ms")


def day_summaries(items: DataFrame, moves: DataFrame) -> DataFrame:
    """For each day its items, photos, unassigned photos and the metres of the movements anchored to it."""
    metres = moves.select("trip", "id", "metres").withColumn("kind", F.lit("MOVE"))
    i = items.join(metres, ["trip", "kind", "id"], "left")
    n = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return i.groupBy("trip", "day", "day_index").agg(F.count("kind").alias("n_items"), n("n_photos").alias("n_photos"), n(F.when(F.col("kind") == "UNASSIGNED", F.col("n_photos"))).alias("n_unassigned"), F.coalesce(F.sum("metres"), F.lit(0.0)).alias("metres"))
