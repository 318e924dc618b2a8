"""Reactive re-query: results that follow a stream of changes, a trip at a time (2.11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trekframe.sources.snapshots import Snapshots


def newest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of the rows of one key the one with the greatest version, of equal ones that with the least hash."""
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.xxhash64(*rows.columns))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def apply_batch(store: Snapshots, batch: DataFrame, number: int, table: str, result: str, compute: Callable[[DataFrame], DataFrame], key: list[str], version: str = "version", deleted: Column | None = None) -> None:
    """Merges a batch of changes into ``table`` and computes ``result`` anew for the trips that the batch touches, both in one commit.

    Rows carry a version: one that comes late, after a newer one of its key, loses.
    Deleted rows stay in the table, so that nothing older brings them back, but are
    not shown to ``compute``.  A trip without a row left loses its result.  The
    batch's number is kept with the commit: a batch that is run again, as after a
    failure, is left out if it has been committed.
    """
    m = store.manifest()
    if m is not None and int(m["keys"].get(table, -1)) >= number:
        return
    trips = batch.select("trip_id").distinct()
    rows = batch
    if m is not None and table in m["tables"]:
        rows = store.read(table).join(trips, "trip_id", "left_semi").unionByName(batch)
    rows = newest(rows, ["trip_id", *key], version)
    shown = rows if deleted is None else rows.where(~F.coalesce(deleted, F.lit(False)))
    store.commit({table: rows, result: compute(shown)}, trips, {table: str(number), result: str(number)})


def follow(changes: DataFrame, store: Snapshots, table: str, result: str, compute: Callable[[DataFrame], DataFrame], key: list[str], checkpoint: str, version: str = "version", deleted: Column | None = None, trigger: dict | None = None):
    """Starts the query that keeps ``result`` in step with a stream of changes(trip_id, *key, version, ...); readers see whole batches only."""
    apply = lambda batch, number: None if batch.isEmpty() else apply_batch(store, batch, number, table, result, compute, key, version, deleted)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
