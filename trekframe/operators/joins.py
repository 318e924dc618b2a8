"""Interval, as-of and nearest joins that never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEP = 16


def _levels(bucket: int) -> list[int]:
    return [bucket * STEP**i for i in range(8)]


#: Hashes of groups that ``in_groups`` tells apart: the most rows that it broadcasts.
GROUPS = 1 << 16


def group_hash(on: list[str]) -> Column:
    """One of a bounded number of values for a group."""
    return F.pmod(F.xxhash64(*on), F.lit(GROUPS))


def in_groups(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose group may have a row in others, before any shuffle of df: all of a group that has one, and few of other groups.

    The groups of others come as hashes of a bounded number of values, so they
    are broadcast whatever their number; two groups of one hash only keep rows
    that the join behind drops.
    """
    hashed = group_hash(on).alias("__group")
    here = others.select(hashed).distinct()
    return df.select("*", hashed).join(F.broadcast(here), "__group", "left_semi").drop("__group")


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], ts: str, start: str, end: str, bucket: int = 3_600_000, pad: int = 0, how: str = "inner", prune: bool = True) -> DataFrame:
    """Rows of points with the intervals that hold their ts, both ends included, widened by pad.

    An interval is dealt to the buckets it covers, at the finest of eight bucket
    sizes, each 16 times the one before, at which it covers at most 17.  A point
    is in one bucket of each size that some interval has; the others go before the
    shuffle.  So long and short intervals cost the same, a pair meets once, and
    the join is an equi-join on (on, size, bucket).  Intervals of groups without
    any point go before they are dealt; ``prune`` off spares reading points twice.
    """
    if prune:
        intervals = in_groups(intervals, points, on)
    s, e = F.col(start) - pad, F.col(end) + pad
    size = F.lit(_levels(bucket)[-1])
    for b in reversed(_levels(bucket)[:-1]):
        size = F.when(e - s <= b * STEP, F.lit(b)).otherwise(size)
    sized = intervals.where(e >= s).withColumn("__size", size.cast("bigint"))
    cut = sized.withColumn("__bucket", F.explode(F.sequence(F.floor(s / F.col("__size")), F.floor(e / F.col("__size")))))
    sizes = F.array(*(F.lit(b).cast("bigint") for b in _levels(bucket)))
    dealt = points.withColumn("__size", F.explode(sizes)).join(F.broadcast(sized.select("__size").distinct()), "__size", "left_semi")  # at most eight rows
    dealt = dealt.select(*points.columns, "__size").withColumn("__bucket", F.floor(F.col(ts) / F.col("__size")))
    names = [*on, "__size", "__bucket"]
    if how == "inner":
        return dealt.join(cut, names).where(F.col(ts).between(s, e)).drop("__size", "__bucket")
    cond = [dealt[n] == cut[n] for n in names] + [(dealt[ts] >= cut[start] - pad) & (dealt[ts] <= cut[end] + pad)]
    if how == "semi":
        return dealt.join(cut, cond, "left_semi").drop("__size", "__bucket")
    raise ValueError(how)


def uncovered(points: DataFrame, intervals: DataFrame, on: list[str], key: str, ts: str, start: str, end: str, bucket: int = 3_600_000, pad: int = 0) -> DataFrame:
    """Points in no interval."""
    held = interval_join(points, intervals, on, ts, start, end, bucket, pad, "semi").select(*on, key).distinct()
    return points.join(held, [*on, key], "left_anti")


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], bucket: int = 3_600_000) -> DataFrame:
    """Pairs of a(start_ms, end_ms) and b(b_start, b_end) with max(start) < min(end).

    Of two intervals that overlap one holds the other's start.  So each side's
    starts are joined to the other's intervals by ``interval_join``, whose levels
    keep an interval of any length to a few buckets, and equal starts count once.
    """
    start = interval_join(b, a, on, "b_start", "start_ms", "end_ms", bucket)
    later = interval_join(a, b, on, "start_ms", "b_start", "b_end", bucket).where("start_ms > b_start")
    meets = F.greatest("start_ms", "b_start") < F.least("end_ms", "b_end")
    names = [*a.columns, *(c for c in b.columns if c not in on)]
    return start.select(names).unionByName(later.select(names)).where(meets)


def asof(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, values: list[str], direction: str = "backward", tie: list[str] | None = None) -> DataFrame:
    """left with the right row last at or before lt, or first at or after it, as ``r_`` columns.

    One shuffle: both sides are stacked and a window carries the last right row;
    forward it runs from the last time to the first, since a frame that ends at
    the partition's end is worked out anew for every row.  Equal times count as
    before and as after.
    """
    back = direction == "backward"
    row = F.struct(F.col(rt).alias(rt), *(F.col(v) for v in values))
    stack_l = left.withColumns({"__t": F.col(lt), "__side": F.lit(1 if back else 0), "__r": F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType), "__l": F.struct(*left.columns)})
    stack_r = right.withColumns({"__t": F.col(rt), "__side": F.lit(0 if back else 1), "__r": row, "__l": F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType), "__tie": F.struct(*(tie or values))})
    cols = [*on, "__t", "__side", "__r", "__l"]
    both = stack_l.withColumn("__tie", F.lit(None).cast(stack_r.schema["__tie"].dataType)).select(*cols, "__tie").unionByName(stack_r.select(*cols, "__tie"))
    order = [F.asc(k) if back else F.desc(k) for k in ("__t", "__side", "__tie")]
    pick = F.last("__r", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    done = both.withColumn("__r", pick).where("__l IS NOT NULL")
    return done.select("__l.*", *(F.col(f"__r.{v}").alias(f"r_{v}") for v in [rt, *values]))


def nearest_in_time(left: DataFrame, right: DataFrame, on: list[str], lt: str, rt: str, values: list[str]) -> DataFrame:
    """left with the right row nearest in time, the earlier one on a tie."""
    names = [rt, *values]
    before = asof(left, right, on, lt, rt, values, "backward")
    before = before.select(*left.columns, *(F.col(f"r_{v}").alias(f"b_{v}") for v in names))
    after = asof(before, right, on, lt, rt, values, "forward")
    use = F.col(f"b_{rt}").isNotNull() & (F.col(f"r_{rt}").isNull() | (F.col(lt) - F.col(f"b_{rt}") <= F.col(f"r_{rt}") - F.col(lt)))
    return after.select(*left.columns, *(F.when(use, F.col(f"b_{v}")).otherwise(F.col(f"r_{v}")).alias(f"r_{v}") for v in names))


def first_of_spot(places: DataFrame) -> DataFrame:
    """Of places(place, p_lat, p_lng, ord) at one spot the first listed: no other can be nearest there."""
    return places.groupBy("p_lat", "p_lng").agg(F.min(F.struct("ord", "place")).alias("b")).select("p_lat", "p_lng", "b.ord", "b.place")


def nearest_place(points: DataFrame, places: DataFrame, most_m: float, key: str, cell: float | None = None) -> DataFrame:
    """points(lat, lng) with the nearest place(place, p_lat, p_lng, ord) strictly within most_m, the first listed on a tie.

    Places are dealt to the grid cells that their reach touches, so a point meets
    those of its own cell only.  Cells measure half the reach: a point meets few
    places out of reach, and points spread over many keys; the places' side is
    broadcast by size, or hot cells split, at run time.
    """
    from trekframe.functions.geo import haversine

    rise = most_m / 111_000
    cell = cell or 360 / max(1, int(720 / rise))
    spread = F.least(F.lit(180.0), F.lit(rise) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), F.abs("p_lat") + rise)))))
    rows = F.sequence(F.floor((F.col("p_lat") - rise) / cell), F.floor((F.col("p_lat") + rise) / cell))
    cols = F.sequence(F.floor((F.col("p_lng") - spread) / cell), F.floor((F.col("p_lng") + spread) / cell))
    turn = round(360 / cell)
    grid = first_of_spot(places).withColumn("__y", F.explode(rows)).withColumn("__x", F.explode(F.array_distinct(F.transform(cols, lambda x: F.pmod(x, F.lit(turn))))))
    at = points.withColumns({"__y": F.floor(F.col("lat") / cell), "__x": F.pmod(F.floor(F.col("lng") / cell), F.lit(turn))})
    d = haversine("lat", "lng", "p_lat", "p_lng")
    near = at.join(grid, ["__y", "__x"]).where(F.abs(F.col("lat") - F.col("p_lat")) <= rise * 1.01).withColumn("__d", d).where(F.col("__d") < most_m)
    best = near.groupBy(key).agg(F.min(F.struct(F.round("__d", 6).alias("d"), "ord", "place")).alias("b")).select(key, F.col("b.place").alias("place"), F.col("b.d").alias("place_m"))
    return points.join(best, key, "left")


def nearest_stay(points: DataFrame, stays: DataFrame, within_ms: int = 7_200_000, most_m: float = 300.0) -> DataFrame:
    """(id, stay, m) of points(trip, id, ts_ms, lat, lng): of the stays(trip, id, start_ms, end_ms, lat, lng) near in time the nearest, if it is near in place."""
    from trekframe.functions.geo import haversine

    s = stays.select("trip", F.col("id").alias("stay"), "start_ms", "end_ms", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    near = interval_join(points, s, ["trip"], "ts_ms", "start_ms", "end_ms", pad=within_ms).withColumn("m", F.round(haversine("lat", "lng", "s_lat", "s_lng"), 3))
    return near.groupBy("id").agg(F.min(F.struct("m", "stay")).alias("b")).select("id", "b.stay", "b.m").where(F.col("m") <= most_m)


def point_in_rings(points: DataFrame, edges: DataFrame, key: str, row: float = 0.0625) -> DataFrame:
    """points(lng, lat) with land: even-odd over edges(kind, x1, y1, x2, y2); a lake outweighs land.

    Edges are dealt to the rows of latitude that they cross, a sixteenth of a
    degree high: a point meets the edges of its own row that do not lie west of
    it.  Crossings are summed by point before and after the shuffle.
    """
    dealt = edges.where("y1 <> y2").withColumn("__y", F.explode(F.sequence(F.floor(F.least("y1", "y2") / row), F.floor(F.greatest("y1", "y2") / row))))
    at = points.withColumn("__y", F.floor(F.col("lat") / row))
    crosses = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lng") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    odd = at.join(dealt, "__y").where(F.greatest("x1", "x2") >= F.col("lng")).where(crosses).groupBy(key, "kind").agg((F.count("*") % 2).alias("odd"))
    flags = odd.groupBy(key).agg(*(F.max(F.when(F.col("kind") == k, F.col("odd")).otherwise(0)).alias(k) for k in ("land", "lake")))
    return points.join(flags, key, "left").withColumn("land", (F.coalesce("land", F.lit(0)) == 1) & (F.coalesce("lake", F.lit(0)) == 0)).drop("lake")


def latest_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert (K2): rows of old whose key is not in new, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def running_budget(df: DataFrame, size: str, limit: int, order: list[Column], by: list[str]) -> DataFrame:
    """Rows whose running size stays within limit, in order, for each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= limit)
