"""Coordinates from text, JSON lists, stable ids and image similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c, without_null_island


def coordinate(text, lat_e7=None, lng_e7=None) -> Column:
    """H1: 'lat°, lng°' or 'geo:lat,lng' text, else E7 integers; (0, 0) and impossible points are null."""
    t = F.regexp_replace(F.regexp_replace(c(text), "^geo:", ""), "[°\\s]", "")
    parts = F.split(t, ",")
    own = without_null_island(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))
    if lat_e7 is None:
        return own
    return F.coalesce(own, without_null_island(c(lat_e7) / 1e7, c(lng_e7) / 1e7))


def json_list(text) -> Column:
    """H2: a JSON list of strings; failing that, comma-separated parts, trimmed, without empty ones."""
    parsed = F.from_json(c(text), "array<string>")
    cut = F.filter(F.transform(F.split(c(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(c(text)).startswith("[") & parsed.isNotNull(), parsed).otherwise(cut)


def encode_polyline(points) -> Column:
    """H3."""
    return F.to_json(c(points))


def decode_polyline(text) -> Column:
    """H3."""
    return F.from_json(c(text), "array<struct<lat:double,lng:double>>")


def stable_id(prefix, *parts) -> Column:
    """H4: the first 12 bytes of SHA-256 over colon-joined parts, in hex."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(prefix), *(c(p).cast("string") for p in parts)), 256), 1, 24)


def fingerprint(items) -> Column:
    """H5: a digest of an array, whatever its order."""
    return F.sha2(F.to_json(F.sort_array(c(items))), 256)


def similar_images(hash_a, hash_b, color_a, color_b, max_bits=6, max_color=0.22) -> Column:
    """H7: at most so many differing hash bits and less than so much histogram difference."""
    gap = F.aggregate(F.zip_with(c(color_a), c(color_b), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return (F.bit_count(c(hash_a).bitwiseXOR(c(hash_b))) <= max_bits) & (gap < max_color)


def quality_score(sharpness, exposure) -> Column:
    """H8: sharpness up to a ceiling, and exposure; cut to a whole number."""
    return (F.least(F.lit(1.0), c(sharpness) / 900) * 240 + c(exposure) * 120).cast("int")


def representative_score(pinned, gps_exact, has_visit, time_confidence, mime, name, quality) -> Column:
    """H9: a pinned photo far above all; an eighth of the evidence, cut towards zero; and the quality, or a middling one."""
    n = F.lower(c(name))
    when = F.when(c(time_confidence) == "EXIF_EXACT", 300).when(c(time_confidence) == "EXIF_LOCAL", 250).when(c(time_confidence) == "MEDIASTORE", 200).when(c(time_confidence) == "FILENAME_INFERRED", 150).otherwise(50)
    evidence = (
        F.when(c(gps_exact) & c(has_visit), 500).when(c(gps_exact), 400).otherwise(0) + when + F.when(c(mime).startswith("video/"), 0).otherwise(100)
        - F.when(n.rlike("screenshot|screen_shot|screencap"), 300).otherwise(0) - F.when(n.rlike("download|received_"), 200).otherwise(0) - F.when(n.rlike("thumb|preview|icon"), 200).otherwise(0)
    )
    return F.when(c(pinned), 100_000).otherwise(0) + (evidence / 8).cast("int") + F.coalesce(c(quality), F.lit(180))
