"""Geodesic and map-projection column functions.  Angles in degrees, lengths in metres; points are struct<lat, lng>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trekframe.functions.arrays import let

EARTH_M = 6_371_000.0
MAX_MERCATOR_LAT = 85.05112878


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def valid_point(lat, lng) -> Column:
    """latitude and longitude within range and finite; null counts as invalid."""
    ok = c(lat).between(-90, 90) & c(lng).between(-180, 180) & ~F.isnan(c(lat)) & ~F.isnan(c(lng))
    return F.coalesce(ok, F.lit(False))


def without_null_island(lat, lng) -> Column:
    """the point, or null where it is (0, 0) or invalid."""
    return F.when(valid_point(lat, lng) & ~((c(lat) == 0) & (c(lng) == 0)), F.struct(c(lat).alias("lat"), c(lng).alias("lng")))


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """M1."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lng2) - c(lng1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def distance(p: Column, q: Column) -> Column:
    return haversine(p["lat"], p["lng"], q["lat"], q["lng"])


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """M2: initial bearing in [0, 360)."""
    p1, p2, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lng2) - c(lng1))
    y, x = F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def _arc(lat1, lng1, lat2, lng2, metres=None) -> Column:
    """What points of one great circle share: its angle d, its ends and their sines and cosines."""
    ends = {"p1": lat1, "l1": lng1, "p2": lat2, "l2": lng2}
    d = (haversine(lat1, lng1, lat2, lng2) if metres is None else c(metres)) / EARTH_M
    trig = (f(F.radians(c(x))).alias(f"{n}_{k}") for k, x in ends.items() for n, f in (("sin", F.sin), ("cos", F.cos)))
    return F.struct(d.alias("d"), c(lat1).alias("lat"), c(lng1).alias("lng"), *trig)


def _along(e: Column, t: Column) -> Column:
    """The point at fraction t of an arc."""

    def mid(w):
        x = w["a"] * e["cos_p1"] * e["cos_l1"] + w["b"] * e["cos_p2"] * e["cos_l2"]
        y = w["a"] * e["cos_p1"] * e["sin_l1"] + w["b"] * e["cos_p2"] * e["sin_l2"]
        z = w["a"] * e["sin_p1"] + w["b"] * e["sin_p2"]
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    shares = F.struct((F.sin((1 - t) * e["d"]) / F.sin(e["d"])).alias("a"), (F.sin(t * e["d"]) / F.sin(e["d"])).alias("b"))
    point = lambda v: F.struct(F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"), F.degrees(F.atan2(v["y"], v["x"])).alias("lng"))
    return F.when(e["d"] < 1e-9, F.struct(e["lat"].alias("lat"), e["lng"].alias("lng"))).otherwise(let(let(shares, mid), point))


def slerp(lat1, lng1, lat2, lng2, t, metres=None) -> Column:
    """M3: the point at fraction t of the great circle; the first point where both nearly coincide.  metres: their distance, where it is known."""
    return let(_arc(lat1, lng1, lat2, lng2, metres), lambda e: _along(e, c(t)))


def wrapped_delta(d) -> Column:
    """A difference of angles brought into (-180, 180]."""
    x = F.pmod(c(d) + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(c(d)) <= 180, c(d)).otherwise(x)


def point_to_segment(lat, lng, lat1, lng1, lat2, lng2) -> Column:
    """M4: distance to a segment in a local equirectangular plane, clamped to its ends, across the antimeridian."""
    k = F.lit(EARTH_M)
    cos = F.cos(F.radians((c(lat1) + c(lat2)) / 2))
    x2, y2 = F.radians(wrapped_delta(c(lng2) - c(lng1))) * cos * k, F.radians(c(lat2) - c(lat1)) * k
    x, y = F.radians(wrapped_delta(c(lng) - c(lng1))) * cos * k, F.radians(c(lat) - c(lat1)) * k
    n = x2 * x2 + y2 * y2
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * x2 + y * y2) / n))).otherwise(0.0)
    return F.sqrt(F.pow(x - t * x2, 2) + F.pow(y - t * y2, 2))


def cross_track(lat, lng, lat1, lng1, lat2, lng2) -> Column:
    """M5: distance to the infinite great circle through two points; to the first where they coincide."""
    d13 = haversine(lat1, lng1, lat, lng) / EARTH_M
    angle = F.radians(bearing(lat1, lng1, lat, lng) - bearing(lat1, lng1, lat2, lng2))
    far = F.abs(F.asin(F.sin(d13) * F.sin(angle))) * EARTH_M
    return F.when(haversine(lat1, lng1, lat2, lng2) < 1e-6, d13 * EARTH_M).otherwise(far)


def mercator(lat, lng) -> Column:
    """M6: the unit square, y downwards."""
    p = F.radians(F.least(F.lit(MAX_MERCATOR_LAT), F.greatest(F.lit(-MAX_MERCATOR_LAT), c(lat))))
    y = 0.5 - F.log(F.tan(p / 2 + F.lit(0.7853981633974483))) / F.lit(6.283185307179586)
    return F.struct(((c(lng) + 180) / 360).alias("x"), y.alias("y"))


def unmercator(x, y) -> Column:
    lat = F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * c(y)))))
    return F.struct(lat.alias("lat"), (c(x) * 360 - 180).alias("lng"))


def unwrap_longitude(lng, ref) -> Column:
    """M7: the longitude shifted by full turns to within 180 degrees of ref; exactly 180 stays."""
    return c(ref) + wrapped_delta(c(lng) - c(ref))


def great_circle_path(lat1, lng1, lat2, lng2, n) -> Column:
    """M8: n + 1 points from end to end."""
    return let(_arc(lat1, lng1, lat2, lng2), lambda e: F.transform(F.sequence(F.lit(0), c(n).cast("int")), lambda i: _along(e, i.cast("double") / c(n))))


def sample_count(lat1, lng1, lat2, lng2) -> Column:
    """M8: one sample each 20 km, from 1 to 1024."""
    return F.least(F.lit(1024), F.greatest(F.lit(1), F.ceil(haversine(lat1, lng1, lat2, lng2) / 20_000).cast("int")))


def angle_delta(a, b) -> Column:
    """M9: the shortest turn from a to b, in [-180, 180)."""
    return F.pmod(c(b) - c(a) + 180.0, F.lit(360.0)) - 180.0


def turn_towards(a, b, most) -> Column:
    """M9: a turned towards b by at most so many degrees."""
    d = angle_delta(a, b)
    return F.pmod(c(a) + F.greatest(-c(most), F.least(c(most), d)) + 360.0, F.lit(360.0))


def smoothstep(t) -> Column:
    """M10."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(t)))
    return x * x * (3 - 2 * x)


def viewport(min_lat, min_lng, max_lat, max_lng, aspect, margin=0.25) -> Column:
    """Centre and span in degrees of a box with a margin, widened to the screen's width to height."""
    h = F.greatest(F.lit(1e-6), (c(max_lat) - c(min_lat)) * (1 + margin))
    w = F.greatest(F.lit(1e-6), (c(max_lng) - c(min_lng)) * (1 + margin))
    return F.struct(
        ((c(min_lat) + c(max_lat)) / 2).alias("lat"), ((c(min_lng) + c(max_lng)) / 2).alias("lng"),
        F.greatest(h, w / c(aspect)).alias("lat_span"), F.greatest(w, h * c(aspect)).alias("lng_span"),
    )


def tile_zoom(x0, y0, x1, y1, most=24, low=2, high=17) -> Column:
    """The greatest zoom at which a footprint in the unit square covers at most so many tiles."""
    out = F.lit(low)
    for z in range(low, high + 1):
        n = float(1 << z)
        tiles = (F.floor(c(x1) * n) - F.floor(c(x0) * n) + 1) * (F.floor(c(y1) * n) - F.floor(c(y0) * n) + 1)
        out = F.when(tiles <= most, F.lit(z)).otherwise(out)
    return out


def tile_cover(x0, y0, x1, y1, zoom) -> Column:
    """array<struct<x, y, d>> of a footprint's tiles at a zoom; x wraps round, d is the squared distance to the centre in tiles."""
    n = F.pow(F.lit(2.0), c(zoom))
    span = lambda a, b: F.sequence(F.floor(c(a) * n), F.floor(c(b) * n))
    cx, cy = (c(x0) + c(x1)) / 2 * n, (c(y0) + c(y1)) / 2 * n
    row = lambda y: F.transform(span(x0, x1), lambda x: F.struct(F.pmod(x, n.cast("bigint")).alias("x"), y.alias("y"), (F.pow(x + 0.5 - cx, 2) + F.pow(y + 0.5 - cy, 2)).alias("d")))
    return F.flatten(F.transform(span(y0, y1), row))


def camera_span(mode, table: dict, default: float) -> Column:
    """A span looked up by transport mode."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c(mode) == k, F.lit(v)).otherwise(out)
    return out


def planar_point_to_line(x, y, x1, y1, x2, y2) -> Column:
    """Distance to the line through two points of a plane; to the first where they coincide."""
    n = F.sqrt(F.pow(c(x2) - c(x1), 2) + F.pow(c(y2) - c(y1), 2))
    return F.when(n > 0, F.abs((c(y2) - c(y1)) * c(x) - (c(x2) - c(x1)) * c(y) + c(x2) * c(y1) - c(y2) * c(x1)) / n).otherwise(F.sqrt(F.pow(c(x) - c(x1), 2) + F.pow(c(y) - c(y1), 2)))


def aspect_fit(w, h, box_w, box_h) -> Column:
    """The size that fits a box."""
    k = F.least(c(box_w) / c(w), c(box_h) / c(h))
    return F.struct((c(w) * k).alias("w"), (c(h) * k).alias("h"))


def iso6709(text) -> Column:
    """A point from +DD.DDDD-DDD.DDDD/ text, or null."""
    p = r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)"
    lat, lng = (F.regexp_extract(c(text), p, i).try_cast("double") for i in (1, 2))
    return without_null_island(lat, lng)
