"""Streaming: playback continuity, the clock, and windows over events."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

CHECK = "player bigint, frames bigint, progress_back bigint, episode_back bigint, reactivated bigint, jumps bigint"
STATE = "frames bigint, progress double, episode bigint, lat double, lng double, done array<bigint>, progress_back bigint, episode_back bigint, reactivated bigint, jumps bigint"


def within(ranges: list[int], n: int) -> bool:
    """Whether n lies in one of the ranges first, last, first, last and so on, ascending and apart."""
    k = bisect_left(ranges, n)
    return k % 2 == 1 or k < len(ranges) and ranges[k] == n


def with_number(ranges: list[int], n: int) -> list[int]:
    """The ranges with n as well; neighbours become one, so a story seen in order is one range."""
    if within(ranges, n):
        return ranges
    k = bisect_left(ranges, n)
    left, right = k > 0 and ranges[k - 1] == n - 1, k < len(ranges) and ranges[k] == n + 1
    return ranges[: k - 1 if left else k] + ([] if left else [n]) + ([] if right else [n]) + ranges[k + 1 if right else k :]


def _frame(state: dict | None, f) -> dict:
    """One frame's effect: four counters of steps back and jumps over 200 km; scrubbing only moves the baseline."""
    from trekframe.operators.composite import metres

    s = dict(state) if state else {"frames": 0, "progress": -1.0, "episode": -1, "lat": None, "lng": None, "done": [], "progress_back": 0, "episode_back": 0, "reactivated": 0, "jumps": 0}
    s["frames"] += 1
    if not f.scrubbing:
        if s["progress"] >= 0:
            s["progress_back"] += f.progress < s["progress"] - 0.0001
            s["episode_back"] += 0 <= f.episode < s["episode"]
            s["reactivated"] += within(s["done"], f.episode)
            s["jumps"] += s["lat"] is not None and f.episode >= s["episode"] and metres(s["lat"], s["lng"], f.lat, f.lng) > 200_000
        if 0 <= s["episode"] < f.episode:
            s["done"] = with_number(s["done"], s["episode"])
    return s | {"progress": f.progress, "episode": f.episode, "lat": f.lat, "lng": f.lng}


def continuity(frames: DataFrame) -> DataFrame:
    """Counters per player over a stream of frames(player, n, progress, episode, lat, lng, scrubbing), frames in order of n in each batch."""
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else None
        if s:
            s["done"] = list(s["done"])
        for f in pd.concat(list(parts)).sort_values("n").itertuples():
            s = _frame(s, f)
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame([(key[0], *(int(s[n]) for n in ("frames", "progress_back", "episode_back", "reactivated", "jumps")))], columns=[x.split()[0] for x in CHECK.split(", ")])

    return frames.groupBy("player").applyInPandasWithState(run, CHECK, STATE, "update", GroupStateTimeout.NoTimeout)


def continuity_batch(frames: DataFrame) -> DataFrame:
    """The same counters of a finished table without scrubbing, by windows."""
    from trekframe.functions.geo import haversine

    w = Window.partitionBy("player").orderBy("n")
    lag = lambda c: F.lag(c).over(w)
    top = F.max("episode").over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = frames.withColumns({"pb": F.col("progress") < lag("progress") - 0.0001, "eb": F.col("episode") < lag("episode"), "again": F.col("episode") < top, "far": (F.col("episode") >= lag("episode")) & (haversine(lag("lat"), lag("lng"), "lat", "lng") > 200_000)})
    return f.groupBy("player").agg(F.count("*").alias("frames"), F.count_if("pb").alias("progress_back"), F.count_if("eb").alias("episode_back"), F.count_if("again").alias("reactivated"), F.count_if("far").alias("jumps"))


ZERO = {"at": 0.0, "p": 0.0, "speed": 1.0, "on": False}


def clock(events: DataFrame, duration_s: float) -> DataFrame:
    """The playback clock over a table events(player, n, at_s, action, value): progress at each event; start, pause, seek and speed; it stops at 1.

    Each player's events stream past one state in order of n, however many they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, dict(ZERO)
        for batch in batches:
            players, progress = batch.column(0).to_pylist(), []
            for player, at_s, action, value in zip(players, *(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if player != now:
                    now, s = player, dict(ZERO)
                s = ticked(s, at_s, action, value, duration_s)
                progress.append(s["p"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(progress, pa.float64())], names=["player", "n", "progress"])

    rows = events.select("player", "n", F.col("at_s").cast("double"), "action", F.col("value").cast("double")).repartition("player").sortWithinPartitions("player", "n")
    return rows.mapInArrow(run, f"player {kinds['player']}, n {kinds['n']}, progress double")


def ticked(state: dict, at_s: float, action: str, value: float, duration_s: float) -> dict:
    """The clock after one event."""
    p = min(1.0, state["p"] + ((at_s - state["at"]) * state["speed"] / duration_s if state["on"] else 0.0))
    on = False if p >= 1 else {"start": True, "resume": True, "pause": False}.get(action, state["on"])
    return {"at": at_s, "p": value if action == "seek" else p, "speed": value if action == "speed" else state["speed"], "on": on}


def clock_stream(events: DataFrame, duration_s: float) -> DataFrame:
    """The playback clock over a stream of events, each player's in order of n in each batch; what is kept of a player is one state."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, out = dict(zip(ZERO, state.get)) if state.exists else dict(ZERO), []
        for e in pd.concat(list(parts)).sort_values("n").itertuples():
            s = ticked(s, e.at_s, e.action, e.value, duration_s)
            out.append((key[0], e.n, s["p"]))
        state.update(tuple(s.values()))
        yield pd.DataFrame(out, columns=["player", "n", "progress"])

    return events.groupBy("player").applyInPandasWithState(run, "player bigint, n bigint, progress double", "at double, p double, speed double, on boolean", "append", GroupStateTimeout.NoTimeout)


def eta(ticks: DataFrame, stall_s: float = 15.0, from_share: float = 0.12, from_s: float = 4.0) -> DataFrame:
    """Seconds left of ticks(job, at_s, share): unknown early on, and after stall_s without progress."""
    w = Window.partitionBy("job").orderBy("at_s")
    t = ticks.withColumn("__up", F.when(F.col("share") > F.coalesce(F.lag("share").over(w), F.lit(-1.0)), F.col("at_s")))
    t = t.withColumn("__last", F.max("__up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = (F.col("share") >= from_share) & (F.col("at_s") >= from_s) & (F.col("at_s") - F.col("__last") <= stall_s)
    return t.withColumn("eta_s", F.when(known, F.col("at_s") * (1 - F.col("share")) / F.col("share"))).drop("__up", "__last")


def hourly(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Beyond the journey operators: tumbling windows with a watermark over events(ts, event_type, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Beyond the journey operators: session windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
