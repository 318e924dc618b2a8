"""Cases of the findings of round 4."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trekframe.operators import story as ST
from trekframe.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def told_episodes(spark):
    """Episodes with no, few and too many photos, of one time and out of the episode, in trips of several."""
    i = F.col("id")
    e = spark.range(120).select((i % 3).alias("trip"), "id", F.element_at(F.array(F.lit("MOVE"), F.lit("STAY")), (i % 2 + 1).cast("int")).alias("kind"), (i * 1_000_000).alias("start_ms"), (i * 1_000_000 + i % 5 * 400_000).alias("end_ms"), (2.0 + i % 7 * 1.3).alias("seconds"))
    photo = "struct(start_ms + (j * 37 + id * 13) % 110 * 8000 - 40000 AS ts_ms, id * 100 + j AS media, (id + j) % 3 = 0 AS best)"
    e = e.withColumn("moments", F.expr(f"CASE WHEN id % 11 <> 4 THEN transform(sequence(1L, 1 + id * 7 % 9), j -> {photo}) WHEN id % 2 = 0 THEN array() END"))
    return ST.schedule(e.withColumn("seconds", F.when(i % 10 < 8, ST.with_room("seconds", F.size(F.coalesce("moments", F.array())))).otherwise(F.col("seconds"))))


def test_told_agrees_with_the_steps_one_by_one(spark):
    e = told_episodes(spark)
    moments = e.select("trip", F.col("id").alias("parent"), F.inline("moments"))
    bare = e.drop("moments")
    held, windows = ST.with_holds(bare, ST.photo_windows(bare, moments))
    told = ST.told(e)
    rows = lambda df: sorted(map(tuple, df.collect()))
    names = ["trip", "id", "media", "shown_from", "shown_to"]
    shown = rows(told.where("shown_from IS NOT NULL").select(names))
    assert shown == rows(windows.select(names)) and len(shown) < moments.count()
    assert told.where("k = 0").count() == 120
    for got, want in zip(rows(told.where("k = 0").select("trip", "id", "seconds", "story_start", "held")), rows(held.select("trip", "id", "seconds", "story_start", "held"))):
        assert got == pytest.approx(want, abs=1e-9)
    got = rows(ST.told_progress(told, 300).select("trip", "id", "k", "t", "media", "hold", "progress"))
    want = rows(ST.hold_progress(ST.story_samples(held, 300), held, windows).select("trip", "id", "k", "t", "media", "held", "progress"))
    assert len(got) == 900 and [(*g[:3], *g[4:6]) for g in got] == [(*w[:3], *w[4:6]) for w in want]
    for g, w in zip(got, want):
        assert (g[3], g[6]) == pytest.approx((w[3], w[6]), abs=1e-9)
    assert rows(ST.told_violations(told.where("shown_from IS NOT NULL"))) == rows(ST.window_violations(held, windows))


@pytest.mark.parametrize("name", ["a12_hold_progress", "a13_photo_windows"])
def test_a_story_is_dealt_out_once(spark, name):
    """One shuffle of the line items: episodes, photos and windows took nine and more."""
    p = plan(registry.queries()[name](spark, SMALL))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_routes_are_worked_out_only_where_they_are_looked_at(spark):
    """Holds are worked out once and written; vertices and legs come of the movements at a sample's time."""
    p = plan(registry.queries()["a12_state_on_route"](spark, SMALL))
    assert "trekframe-progress" in p and "lineitem" not in p


def test_no_index_of_zones_is_broadcast(spark):
    """Estimates leave out what explode makes: an index of 60 000 zones was held to be below 10 MB and went through the driver."""
    p = plan(registry.queries()["j19_zone_of_point"](spark, SMALL))
    assert "SortMergeJoin [cx" in p and "HashJoin [cx" not in p and "HashJoin [zone" not in p


def test_episodes_of_diagnostics_are_not_dealt_out_again(spark):
    """What lies between neighbours is written with them; only jumps and the records that they are typed by are shuffled, once each, then counters by trip."""
    from trekframe.operators import composite as C

    k = F.col("id")
    m = spark.range(300).select((k % 5).alias("trip"), "id", F.lit("CAR").alias("mode"), (40 + k % 9 * 0.02).alias("lat"), F.lit(5.0).alias("lng"), (40 + k % 4 * 0.02).alias("lat2"), F.lit(5.0).alias("lng2"), (k * 1000).alias("start_ms"), (k * 1000 + 4500 + k % 2 * 500).alias("end_ms"))
    m = m.withColumns({"confidence": F.lit(0.5), "is_override": F.lit(False), "provenance": F.lit("OBSERVED"), "path": F.lit(None).cast(C.PATH)})
    records = C.canonicalise_with_records(m)
    got = C.canonical_diagnostics(records, m)
    p = plan(got)
    assert "Window" not in p and p.count("trekframe-episodes") == 2 and "[trip#" in p
    jumps = C.timeline_jumps(C.joined_moves(records.where("reason IS NULL")), m)
    want = {r.trip: r for r in jumps.groupBy("trip").agg(F.count("discontinuity").alias("n"), F.count_if("backtrack").alias("back"), F.count_if(F.col("discontinuity") == "SOURCE_TIMELINE_GAP").alias("source"), F.count("*").alias("episodes")).collect()}
    rows = got.collect()
    assert len(rows) == 5 and sum(r.discontinuities for r in rows) > 20
    for r in rows:
        w = want[r.trip]
        assert (r.discontinuities, r.source_gaps, r.introduced_jumps, r.backtracks, r.episodes) == (w.n, w.source, w.n - w.source, w.back, w.episodes) and len(r.discontinuity_notes) == w.n
