"""Key selection and time scaling of a story, and label placement."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import monotonic

#: Seconds of a movement by mode, as drawn and at least; others take the last.
MOVES = [(("AIRPLANE",), 5.5, 3.5), (("TRAIN", "SUBWAY"), 4.0, 2.5), (("CAR", "BUS", "FERRY"), 3.5, 2.0), (("BICYCLE",), 2.8, 1.8), ((), 2.2, 1.4)]
DAY_MS = 86_400_000


def story_targets(items: DataFrame, target: float | None = None) -> DataFrame:
    """(trip, n_stays, n_moves, target, max_stays, max_moves): a trip's story seconds by its days, stays, movements and length, and how many of each may stay."""
    stay, last = F.col("kind") == "VISIT", F.struct("start_ms", "end_ms", "id")
    of = lambda test, v: F.when(test, v)
    s = items.groupBy("trip").agg(
        F.count_if(stay).alias("n_stays"), F.count_if(~stay).alias("n_moves"), (F.sum(of(~stay, F.col("metres"))) / 1000).alias("km"), F.coalesce(F.min(of(stay, F.col("start_ms"))), F.min("start_ms")).alias("a"),
        F.coalesce(F.max(of(stay, last))["end_ms"], F.max(last)["end_ms"]).alias("b"),
    )
    days = F.greatest(F.lit(1), F.expr(f"(b - a) div {DAY_MS}") + 1)
    part = lambda d, v, m: days * 14.0 * d + F.least(F.lit(40), "n_stays") * 3.2 * v + F.least(F.lit(40), "n_moves") * 3.8 * m + F.least(F.lit(40.0), F.coalesce("km", F.lit(0.0)) / 300)
    within = lambda x, a, b: F.least(F.lit(b), F.greatest(F.lit(a), x))
    own = F.when(days >= 3, within(part(0.45, 0.35, 0.30), 90.0, 150.0)).otherwise(within(part(0.40, 0.35, 0.25), 30.0, 90.0)) if target is None else F.lit(float(target))
    s = s.withColumn("target", own)
    least, most = (6, (40, 45)) if target is None else (4, (10, 12))
    count = lambda seconds, top: F.least(F.lit(top), F.greatest(F.lit(least), F.floor(F.col("target") / seconds)))
    return s.select("trip", "n_stays", "n_moves", "target", count(3.0, most[0]).alias("max_stays"), count(2.5, most[1]).alias("max_moves"))


def compressed_story(items: DataFrame, target: float | None = None) -> DataFrame:
    """T7, A14 over items(trip, id, kind: VISIT or MOVE, start_ms, end_ms, mode, metres, photos, pinned, is_override) that do not overlap within their kind.

    Kept are all stays up to ten and all movements up to twelve, else the first,
    the last and the most telling ones: stays with a pinned photo or a user's
    name, with photos, then the longest; flights, movements set by a user, then
    the farthest.  Seconds are scaled to the target, but not below a least; times
    never run backwards.  Adds seconds, story_start and total.
    """
    stay = F.col("kind") == "VISIT"
    w = Window.partitionBy("trip", "kind").orderBy("start_ms", "end_ms", "id")
    i = items.join(story_targets(items, target), "trip").withColumns({"__n": F.row_number().over(w), "__all": F.when(stay, F.col("n_stays")).otherwise(F.col("n_moves"))})
    edge = (F.col("__n") == 1) | (F.col("__n") == F.col("__all"))
    first = F.when(edge, 0).when(stay & (F.col("pinned") | F.col("is_override")), 1).when(stay & (F.col("photos") > 0), 2).otherwise(3)
    long = F.when(F.col("__first") < 3, 0).when(stay, F.col("end_ms") - F.col("start_ms")).otherwise(F.col("metres"))
    flies = F.when((F.col("__first") == 3) & ~stay, (F.col("mode") == "AIRPLANE").cast("int") * 2 + F.col("is_override").cast("int")).otherwise(0)
    i = i.withColumn("__first", first).withColumns({"__long": long, "__flies": flies})
    rank = F.row_number().over(Window.partitionBy("trip", "kind").orderBy("__first", F.desc("__flies"), F.desc("__long"), "__n"))
    i = i.withColumn("__rank", rank).where(F.when(stay, (F.col("n_stays") <= 10) | (F.col("__rank") <= F.col("max_stays"))).otherwise((F.col("n_moves") <= 12) | (F.col("__rank") <= F.col("max_moves"))))
    dwell = F.col("end_ms") - F.col("start_ms")
    pair = lambda a, b: F.struct(F.lit(a).alias("base"), F.lit(b).alias("least"))
    seconds = F.when(stay & (F.col("photos") > 1), pair(3.5, 2.0)).when(stay & (F.col("photos") > 0), pair(3.0, 1.5)).when(stay & ((dwell >= 3_600_000) | F.col("is_override")), pair(2.5, 1.2)).when(stay, pair(1.5, 0.8))
    for modes, base, least in MOVES[:-1]:
        seconds = seconds.when(F.col("mode").isin(*modes), pair(base, least))
    i = i.withColumn("__s", seconds.otherwise(pair(*MOVES[-1][1:])))
    trip = Window.partitionBy("trip")
    scale = F.col("target") / F.sum("__s.base").over(trip)
    i = i.withColumn("__scale", scale).withColumn("seconds", F.greatest(F.col("__s.least") * F.least(F.lit(1.0), "__scale"), F.col("__s.base") * F.col("__scale")))
    i = monotonic(i.select(*items.columns, "seconds"), ["trip"], ["id"])
    before = trip.orderBy("start_ms", "end_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return i.withColumns({"story_start": F.coalesce(F.sum("seconds").over(before), F.lit(0.0)), "total": F.sum("seconds").over(trip)})


# T8 -------------------------------------------------------------------------------------------

#: A label's height, its padding, and how far it keeps from its point and the right edge.
HEIGHT, PADDING, RIGHT, LEFT_GAP, EDGE = 26.0, 8.0, 14.0, 12.0, 16.0
LABEL = "frame bigint, id bigint, x0 double, y0 double, x1 double, y1 double"


def placed_labels(labels: DataFrame, width: float, height: float) -> DataFrame:
    """T8 over labels(frame, id, text, priority, x, y, text_width): the boxes that fit, the higher priority first.

    A box lies to the right of its point, or to the left near the edge.  It is
    left out if it meets an earlier one, leaves the view, has no text, or repeats
    a ``Near`` or ``Stop near`` text.  A frame's labels stream by priority past
    the boxes placed, whose number is bounded by the view.
    """
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, placed, said, out = None, [], set(), []
        for batch in batches:
            for r in batch.to_pylist():
                if r["frame"] != now:
                    now, placed, said = r["frame"], [], set()
                wide = r["text_width"] + 2 * PADDING
                x0 = r["x"] - wide - LEFT_GAP if r["x"] + wide > width - EDGE else r["x"] + RIGHT
                y0 = r["y"] - HEIGHT / 2
                x1, y1 = x0 + wide, y0 + HEIGHT + PADDING
                near = r["text"].startswith(("Near", "Stop near"))
                if (near and r["text"] in said) or x0 < 0 or y0 < 0 or x1 > width or y1 > height:
                    continue
                if any(a0 < x1 and x0 < a1 and b0 < y1 and y0 < b1 for a0, b0, a1, b1 in placed):
                    continue
                placed.append((x0, y0, x1, y1))
                said |= {r["text"]} if near else set()
                out.append((r["frame"], r["id"], x0, y0, x1, y1))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in LABEL.split(", ")])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in LABEL.split(", ")])

    rows = labels.where("trim(coalesce(text, '')) <> ''").select("frame", "id", "text", "x", "y", "text_width", F.col("priority"))
    return rows.repartition("frame").sortWithinPartitions("frame", F.desc("priority"), "id").mapInArrow(run, LABEL)
