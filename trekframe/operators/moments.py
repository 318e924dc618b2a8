"""Clusters of photos: moments and bursts, greedy in time, with clusters that close as time goes on."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .composite import _alike, metres
from .sequence import sessions


@dataclass(frozen=True)
class Rule:
    """When a photo joins a cluster's first: near in time, and in place or at the same stay; a user's pick may stand alone."""

    within_ms: int
    within_m: float
    same_visit: bool = False
    picks_alone: bool = False


#: Photos of one moment of a story, and of one burst in a diary.
MOMENT, BURST = Rule(180_000, 300.0), Rule(60_000, 50.0, True, True)


class Clusters:
    """The clusters that a later photo can still join: those whose first photo is within the rule's time."""

    def __init__(self, rule: Rule):
        self.rule, self.open, self.n = rule, deque(), 0

    def place(self, p: dict) -> tuple[bool, int, int]:
        """(whether it is a first, its cluster's first photo, firsts since that one); photos come in order of time."""
        r = self.rule
        while self.open and p["ts_ms"] - self.open[0][1]["ts_ms"] > r.within_ms:
            self.open.popleft()
        if p["hash"] is not None and not (r.picks_alone and p["best"]):  # without features nothing is alike
            for k, f in self.open:
                if self._fits(p, f):
                    return False, f["id"], self.n - 1 - k
        self.open.append((self.n, p))
        self.n += 1
        return True, p["id"], 0

    def _fits(self, p: dict, f: dict) -> bool:
        r = self.rule
        if f["hash"] is None or r.picks_alone and f["best"]:
            return False
        near = None not in (p["lat"], p["lng"], f["lat"], f["lng"]) and metres(p["lat"], p["lng"], f["lat"], f["lng"]) <= r.within_m
        return (near or r.same_visit and p["visit"] is not None and p["visit"] == f["visit"]) and _alike(p, f)


def cluster_photos(photos: DataFrame, rule: Rule = MOMENT) -> DataFrame:
    """A9 over photos(parent, id, ts_ms, lat, lng, hash, color, visit, best): (parent, id, ts_ms, cluster, is_first, first).

    Each photo joins the oldest cluster of its parent whose first photo it fits,
    else begins one; clusters are numbered by their firsts.  Photos further apart
    than the rule's time never meet, so a parent is cut there, and what a task
    holds is the firsts of that time, not the parent.  Photos without a time are
    clusters of their own, after the others.
    """
    s = sessions(photos.where("ts_ms IS NOT NULL"), ["parent"], "ts_ms", "id", rule.within_ms)
    fields = [("parent", pa.int64()), ("id", pa.int64()), ("ts_ms", pa.int64()), ("is_first", pa.bool_()), ("first", pa.int64()), ("back", pa.int64())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Clusters(rule)
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if (p["parent"], p["session"]) != now:
                    now, held = (p["parent"], p["session"]), Clusters(rule)
                out.append((p["parent"], p["id"], p["ts_ms"], *held.place(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out), fields)] if out else [pa.array([], k) for _, k in fields], names=[n for n, _ in fields])

    cols = ["parent", "session", "id", "ts_ms", "lat", "lng", "hash", "color", "visit", "best"]
    got = s.select(*cols).repartition("parent", "session").sortWithinPartitions("parent", "session", "ts_ms", "id").mapInArrow(kernel, "parent bigint, id bigint, ts_ms bigint, is_first boolean, first bigint, back bigint")
    late = photos.where("ts_ms IS NULL").select("parent", "id", "ts_ms", F.lit(True).alias("is_first"), F.col("id").alias("first"), F.lit(0).cast("bigint").alias("back"))
    order = Window.partitionBy("parent").orderBy(F.asc_nulls_last("ts_ms"), "id").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.col("is_first").cast("int")).over(order) - 1 - F.col("back")
    return got.unionByName(late).withColumn("cluster", number.cast("int")).select("parent", "id", "ts_ms", "cluster", "is_first", "first")


def collapsed(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each cluster the photo with the highest of scores(parent, id, score), the earliest on a tie, and how many it stands for."""
    s = clusters.join(scores.select("parent", "id", "score"), ["parent", "id"])
    return s.groupBy("parent", "cluster").agg(F.min_by("id", F.struct(-F.col("score"), F.col("ts_ms").isNull(), "ts_ms", "id")).alias("id"), F.count("*").alias("members"))
