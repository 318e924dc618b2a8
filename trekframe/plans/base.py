"""Registration of queries with their oracle SQL, and adapters from the driver's tables to the operators' inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.functions.timefn import millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Coordinates are whole ten-thousandths, so both engines get the same doubles.
PINGS = """pings AS (SELECT event_id AS id, user_id AS trip, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 // 86400000 AS day,
  (400000 + ((event_id // 40) % 50) * 200 + (event_id % 3) * 2)::DOUBLE / 10000 AS lat, (-740000 + (event_id % 2) * 2)::DOUBLE / 10000 AS lng, event_type, value FROM events)"""


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of travellers from events; ``day`` bounds the global sequence's windows."""
    e = read(spark, sf_dir, "events").withColumn("ts_ms", millis("ts"))
    lat = (400000 + F.expr("(event_id div 40) % 50") * 200 + F.expr("event_id % 3") * 2).cast("double") / 10000
    lng = (-740000 + F.expr("event_id % 2") * 2).cast("double") / 10000
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("trip"), "ts_ms", F.expr("ts_ms div 86400000").alias("day"), lat.alias("lat"), lng.alias("lng"), "event_type", "value")


STAYS = """stays AS (SELECT l_suppkey AS trip, l_orderkey * 10 + l_linenumber AS id, epoch_ms(l_shipdate) AS start_ms, epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000 AS end_ms,
  (400000 + (l_partkey % 100) * 100)::DOUBLE / 10000 AS lat, (-740000 + (l_partkey % 37) * 100)::DOUBLE / 10000 AS lng, 1 - l_discount AS confidence, CAST(l_quantity AS BIGINT) * 1000.0::DOUBLE AS metres,
  l_partkey AS part, ['WALK', 'CAR', 'TRAIN', 'AIRPLANE', 'UNKNOWN'][CAST(l_partkey % 5 AS INT) + 1] AS mode FROM lineitem)"""
MODES = ["WALK", "CAR", "TRAIN", "AIRPLANE", "UNKNOWN"]


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of trips from line items: a supplier is a trip, a shipment a stay or a movement."""
    li = read(spark, sf_dir, "lineitem").withColumn("start_ms", millis("l_shipdate"))
    hours = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("trip"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "start_ms", (F.col("start_ms") + hours * 3_600_000).alias("end_ms"),
        ((400000 + F.expr("l_partkey % 100") * 100).cast("double") / 10000).alias("lat"), ((-740000 + F.expr("l_partkey % 37") * 100).cast("double") / 10000).alias("lng"),
        (1 - F.col("l_discount")).alias("confidence"), (hours * F.lit(1000.0)).alias("metres"), F.col("l_partkey").alias("part"),
        F.element_at(F.array(*map(F.lit, MODES)), (F.expr("l_partkey % 5") + 1).cast("int")).alias("mode"),
    )


def hav(a: str, b: str, x: str, y: str) -> str:
    """Haversine in SQL."""
    h = f"(pow(sin(radians({x} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({x})) * pow(sin(radians({y} - {b}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0::DOUBLE, 1 - {h}))))"
