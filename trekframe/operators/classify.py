"""Transport mode of a movement by rules on speed and distance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trekframe.functions.geo import c


@dataclass(frozen=True)
class Thresholds:
    """Fixed values."""

    stationary_ms: int = 600_000
    drift_m: float = 60.0
    walk_kmh: float = 6.5
    run_kmh: float = 14.0
    car_kmh: float = 140.0
    rail_from_kmh: float = 145.0
    rail_to_kmh: float = 350.0
    flight_kmh: float = 360.0
    possible_kmh: float = 1150.0
    flight_m: float = 200_000.0


def transport(mode, confidence, is_override, distance_m, straight_m, duration_ms, t: Thresholds = Thresholds()) -> Column:
    """struct<mode, confidence>; speeds between the bands are UNKNOWN."""
    hours = c(duration_ms) / 3_600_000.0
    v = F.when(hours > 0, c(distance_m) / 1000.0 / hours).otherwise(0.0)
    straight = F.when(hours > 0, c(straight_m) / 1000.0 / hours).otherwise(0.0)
    out = lambda m, p: F.struct(F.lit(m).alias("mode"), F.lit(p).cast("float").alias("confidence"))
    own = F.struct(c(mode).alias("mode"), c(confidence).cast("float").alias("confidence"))
    flight = (c(straight_m) >= t.flight_m) & straight.between(t.flight_kmh, t.possible_kmh)
    on_foot = c(mode).isin("WALK", "RUN") & (v > 45) & (c(distance_m) > 5000)
    must_fly = c(mode).isin("CAR", "BUS", "WALK", "RUN", "BICYCLE") & flight
    return (
        F.when(c(is_override), own).when((v > t.possible_kmh) | (straight > t.possible_kmh), out("UNKNOWN", 0.15))
        .when((c(mode) != "UNKNOWN") & ~on_foot & ~must_fly, own).when((c(distance_m) < t.drift_m) & (c(duration_ms) >= t.stationary_ms), out("UNKNOWN", 0.90))
        .when(flight & (c(straight_m) > 500_000), out("AIRPLANE", 0.95)).when(flight, out("AIRPLANE", 0.85)).when(v.between(t.rail_from_kmh, t.rail_to_kmh), out("TRAIN", 0.75))
        .when(v.between(45, t.car_kmh), out("CAR", 0.80)).when(v.between(28, 45), out("CAR", 0.70)).when(v.between(t.run_kmh, 28), out("BICYCLE", 0.75))
        .when(v.between(t.walk_kmh, 10.5), out("RUN", 0.65)).when(v.between(t.walk_kmh, t.run_kmh), out("BICYCLE", 0.60))
        .when(v.between(0.4, t.walk_kmh) & (c(distance_m) >= 50), out("WALK", 0.88)).otherwise(out("UNKNOWN", 0.30))
    )
