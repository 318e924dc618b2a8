"""Further cases of the findings of round 3: work that does not grow with rows which can't meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.operators import joins as J


def test_intervals_of_groups_without_points_are_not_dealt(spark):
    hour = 3_600_000
    points = spark.createDataFrame([(1, 10, 2 * hour), (1, 11, 40 * hour), (None, 12, 0)], "trip bigint, id bigint, ts_ms bigint")
    stays = spark.range(5000).select((F.col("id") % 1000).alias("trip"), F.col("id").alias("stay"), (F.col("id") % 7 * hour).alias("start_ms"), (F.col("id") % 7 * hour + 3 * hour).alias("end_ms"))
    few = J.in_groups(stays, points, ["trip"])
    assert few.where("trip = 1").count() == 5 and few.count() < 60
    got = J.interval_join(points, stays, ["trip"], "ts_ms", "start_ms", "end_ms")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "__group" in plan
    assert sorted((r.id, r.stay) for r in got.collect()) == sorted((10, k) for k in range(1, 5000, 1000) if k % 7 <= 2 <= k % 7 + 3)
    held = J.interval_join(points, stays, ["trip"], "ts_ms", "start_ms", "end_ms", how="semi")
    assert [r.id for r in held.collect()] == [10]
    assert sorted(r.id for r in J.uncovered(points, stays, ["trip"], "id", "ts_ms", "start_ms", "end_ms").collect()) == [11, 12]


def test_forward_asof_carries_its_row_once(spark):
    left = spark.range(2000).select(F.lit(1).alias("trip"), (F.col("id") * 10).alias("t"))
    right = spark.createDataFrame([(1, 95, 7), (1, 100, 9), (1, 100, 8), (1, 15_000, 1), (2, 0, 5)], "trip int, at bigint, x int")
    got = J.asof(left, right, ["trip"], "t", "at", ["x"], "forward")
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan.replace("$", "")
    want = lambda t: (95, 7) if t <= 95 else (100, 8) if t <= 100 else (15_000, 1) if t <= 15_000 else (None, None)
    rows = got.collect()
    assert len(rows) == 2000 and all((r.r_at, r.r_x) == want(r.t) for r in rows)
