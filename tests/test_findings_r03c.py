"""Further cases of the findings of round 3: kernels in tasks of like length, islands resolved once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from trekframe.operators import composite as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(spark):
    k = F.col("id")
    point = lambda f: F.struct((F.col("start_ms") + f * 1000).cast("bigint").alias("ts_ms"), (F.col("lat") + f / 1000).alias("lat"), F.col("lng"))
    m = spark.range(400).select((k % 7).alias("trip"), "id", F.element_at(F.array(F.lit("CAR"), F.lit("WALK")), (k % 2 + 1).cast("int")).alias("mode"), (40 + k % 3 * 0.01).alias("lat"), F.lit(5.0).alias("lng"), (40 + k % 5 * 0.01).alias("lat2"), F.lit(5.0).alias("lng2"), (k * 1000).alias("start_ms"))
    m = m.withColumns({"end_ms": F.col("start_ms") + 5000 + k % 4 * 3000, "confidence": 0.5 + k % 11 / 100, "is_override": k % 60 == 7, "provenance": F.lit("OBSERVED")})
    return m.withColumn("path", F.when(k % 3 == 0, F.array(point(0), point(2), point(4))).cast(C.PATH))


def test_values_are_those_of_to_pylist():
    path = pa.list_(pa.struct([("ts_ms", pa.int64()), ("lat", pa.float64())]))
    columns = [
        pa.array([1, 2, 3, 4]), pa.array([1, None, 3, 4]), pa.array([0.5, float("inf"), -0.0, 1e300]), pa.array(["a", "b", None, "d"]), pa.array(["a", "b", "", "d"]), pa.array([True, False, True, True]), pa.array([None, True, None, False]),
        pa.array([[{"ts_ms": 1, "lat": 2.0}], None, [], [{"ts_ms": None, "lat": 1.0}, {"ts_ms": 5, "lat": None}]], path), pa.array([[None, {"ts_ms": 1, "lat": 2.0}], None, [], []], path), pa.array([["x", None], [], None, ["y"]]), pa.array([None] * 4, path),
    ]
    for a in columns:
        for part in (a, a[1:], a[1:3], a[:0]):
            assert C._values(part) == part.to_pylist(), a.type


def test_kernels_run_in_a_number_of_tasks_of_their_own(spark):
    """Partitions put together by size made a few long tasks of the kernels, whose time hangs on rows."""
    assert "REPARTITION_BY_NUM" in plan(C.canonicalise_moves(moves(spark)))


def test_diagnostics_resolve_every_island_once(spark):
    m = moves(spark)
    records = C.canonicalise_with_records(m)
    got = C.canonical_diagnostics(records, m)
    assert "MapInArrow" in plan(records) and "MapInArrow" not in plan(got)
    want = {r.trip: r for r in records.groupBy("trip").agg(F.sum("n_raw").alias("raw"), F.sum("n_gone").alias("gone")).collect()}
    assert {r.trip: (r.raw, r.suppressed) for r in got.collect()} == {t: (r.raw, r.gone) for t, r in want.items()}


def test_export_keeps_each_file_in_one_task(spark, tmp_path):
    """A join that becomes a broadcast at run time is read by mapper: a repartition by its key above it is left out, and files were cut in two."""
    from trekframe.plans import registry

    spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("o_orderkey")).repartition(4).write.parquet(f"{tmp_path}/orders.parquet")
    told = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "100000"}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        got = registry.queries()["s4_path_points"](spark, str(tmp_path))
        want = spark.range(40_000).where("id % 6 = 4").selectExpr("1700000000000 + id * 1000 AS t", "double(id % 80 + 1) AS a")
        want = want.selectExpr("t + 300000 AS ts_ms", "a AS lat", "5.0d AS lng").unionByName(want.selectExpr("t + 600000 AS ts_ms", "a AS lat", "6.0d AS lng"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        for k in told:
            spark.conf.unset(k)


def test_atomic_counts_join_nothing_back(spark):
    from trekframe.operators import sequence as S

    rows = [(t, i, 0, a, a + n) for t in (1, 2) for i, (a, n) in enumerate([(0, 10), (0, 10), (2, 3), (5, 0), (5, 9), (12, 2), (13, 1)])]
    s = spark.createDataFrame(rows, "trip bigint, id bigint, island bigint, start_ms bigint, end_ms bigint")
    got = S.atomic_counts(s, ["trip", "island"])
    assert "Join" not in plan(got)
    edges = sorted({t for r in rows for t in r[3:]})
    want = [(t, 0, a, b, n) for t in (1, 2) for a, b in zip(edges, edges[1:]) if (n := sum(r[0] == t and r[3] <= a and r[4] >= b for r in rows))]
    assert sorted((r.trip, r.island, r.a, r.b, r.candidates) for r in got.collect()) == want
