"""Text rules: activity names, labels, file names and redaction, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

#: Parts of activity names in the order they are tried, and their modes.
ACTIVITY_PARTS = [
    ("FLYING", "AIRPLANE"), ("AIRPLANE", "AIRPLANE"), ("FLIGHT", "AIRPLANE"), ("TRAIN", "TRAIN"), ("SUBWAY", "SUBWAY"), ("METRO", "SUBWAY"), ("TRAM", "SUBWAY"), ("BUS", "BUS"),
    ("PASSENGER_VEHICLE", "CAR"), ("IN_VEHICLE", "CAR"), ("DRIVE", "CAR"), ("CAR", "CAR"), ("CYCLING", "BICYCLE"), ("BICYCLE", "BICYCLE"), ("RUNNING", "RUN"), ("WALKING", "WALK"),
    ("ON_FOOT", "WALK"), ("FERRY", "FERRY"), ("BOAT", "FERRY"),
]
#: Fixed values.
GENERIC_NAMES = ["home", "work", "inferred_home", "inferred_work", "집", "직장"]
NO_NAMES = ["", "unknown", "null"]
#: Folders that tell downloads and messaging apps.
EXTERNAL_FOLDERS = ["download", "telegram", "whatsapp", "kakaotalk", "reddit", "twitter", "instagram", "facebook", "save"]
#: Words of a file name that is no photo for a story.
NOT_STORY = ["screenshot", "screen_shot", "screencap", "download", "received_", "thumb", "icon"]


def activity_mode(kind) -> Column:
    """The first part found decides."""
    u, out = F.upper(F.coalesce(c(kind), F.lit(""))), None
    for part, mode in ACTIVITY_PARTS:
        test = u.contains(part)
        out = F.when(test, mode) if out is None else out.when(test, mode)
    return out.otherwise("UNKNOWN")


def place_name(name, semantic) -> Column:
    """A real name, else Home or Work by the semantic type, else null."""
    n = F.trim(c(name))
    s = F.upper(F.coalesce(c(semantic), F.lit("")))
    return F.when((n != "") & (F.upper(n) != "UNKNOWN"), n).when(s.contains("HOME"), "Home").when(s.contains("WORK"), "Work")


def collapsed(text) -> Column:
    """X4."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


def is_generic(text) -> Column:
    """X4."""
    return F.lower(collapsed(text)).isin(GENERIC_NAMES)


def real_name(text) -> Column:
    """The collapsed name, or null where it says nothing."""
    return F.when(~F.lower(collapsed(text)).isin(NO_NAMES), collapsed(text))


def display_label(name, address, city, landmark, landmark_m, city_m) -> Column:
    """Home and Work with their city, a name, the address's first part, a close landmark, the nearest city, or a fixed text."""
    n, lower = F.trim(c(name)), F.lower(F.trim(c(name)))
    with_city = lambda w: F.when(c(city).isNotNull(), F.concat(F.lit(f"{w} · "), c(city))).otherwise(F.lit(w))
    first = F.trim(F.element_at(F.split(c(address), ","), 1))
    return (
        F.when(lower.isin("home", "inferred_home"), with_city("Home")).when(lower.isin("work", "inferred_work"), with_city("Work"))
        .when(~lower.isin(NO_NAMES), n).when((first != "") & ~first.rlike(r"^\d+$"), first)
        .when(c(landmark).isNotNull() & ((c(landmark_m) < 15_000) | c(city_m).isNull() | (c(landmark_m) < c(city_m))), c(landmark))
        .when(c(city).isNotNull(), F.concat(F.lit("Near "), c(city))).otherwise("Unlabeled stop")
    )


#: Words and patterns of private labels and titles.
HOME_WORDS = r"(?i)\b(home|inferred_home|work|inferred_work)\b"
PRIVATE_LABEL = r"집|자택|\p{Nd}"
PRIVATE_TITLE = "자택|^집$"
STREET = r"(?i)\b\d+\s+.+\b(street|st|road|rd|avenue|ave|drive|dr|lane|ln|court|ct|boulevard|blvd)\b"
KOREAN_ROAD = r"[가-힣]+(?:로|길)\s*\d+"
HOME = r"(?i)\bhome\b|집"


def redact_label(text) -> Column:
    """Labels with home or work words, or any digit."""
    return F.when(c(text).rlike(HOME_WORDS) | c(text).rlike(PRIVATE_LABEL), "Private place").otherwise(c(text))


def redact_title(text) -> Column:
    """Titles with home or work words, a street address, or a Korean road name with a number."""
    private = c(text).rlike(f"{HOME_WORDS}|{PRIVATE_TITLE}") | c(text).rlike(STREET) | c(text).rlike(KOREAN_ROAD)
    return F.when(private, "My Travel Story").otherwise(c(text))


def generalised(name) -> Column:
    """The label of an exported stop; its address is dropped by the caller."""
    return redact_label(F.coalesce(c(name), F.lit("Stop")))


def is_home(text) -> Column:
    """X8."""
    return F.coalesce(c(text).rlike(HOME), F.lit(False))


def safe_file_name(text) -> Column:
    """X9."""
    return F.regexp_replace(c(text), r"[^a-zA-Z0-9_-]", "_")


def file_name_time(name) -> Column:
    """A local time from yyyyMMdd_HHmmss in a file name; impossible dates are null."""
    m = F.regexp_extract(c(name), r"(20\d{2}\d{2}\d{2}_\d{6})", 1)
    iso = F.concat_ws("", F.substring(m, 1, 4), F.lit("-"), F.substring(m, 5, 2), F.lit("-"), F.substring(m, 7, 2), F.lit(" "), F.substring(m, 10, 2), F.lit(":"), F.substring(m, 12, 2), F.lit(":"), F.substring(m, 14, 2))
    return F.when(m != "", iso.try_cast("timestamp_ntz"))


def story_name(name) -> Column:
    """X11: whether a file name may stand for a photo of a story."""
    return ~F.lower(c(name)).rlike("|".join(NOT_STORY))


#: Parts of folders and file names of screenshots, of browsers and of cameras.
SCREEN_FOLDER, SCREEN_NAME = "screenshot", "^(screenshot|screen_shot)|screencapture"
BROWSER_PATH, BROWSER_BUCKET = "browser", "chrome"
CAMERA_PATH, CAMERA_BUCKET, CAMERA_NAME = "dcim|camera", "camera|100andro", "^(img_|dsc_|pxl_|mvi_|cimg)"


def capture_evidence(path, bucket, name, taken, exif_original, exif_offset, gps) -> Column:
    """screenshots first, then downloads and messaging apps, then signs of a camera.  The last three say what is there."""
    p, b, n = (F.lower(F.coalesce(c(x), F.lit(""))) for x in (path, bucket, name))
    either = lambda words: p.rlike("|".join(words)) | b.rlike("|".join(words))
    screenshot = either([SCREEN_FOLDER]) | n.rlike(SCREEN_NAME)
    external = either(EXTERNAL_FOLDERS) | p.contains(BROWSER_PATH) | b.contains(BROWSER_BUCKET)
    camera = p.rlike(CAMERA_PATH) | b.rlike(CAMERA_BUCKET) | n.rlike(CAMERA_NAME)
    has_taken = c(taken).isNotNull()
    strong = (c(exif_offset) & c(exif_original)) | (c(gps) & (has_taken | c(exif_original))) | (camera & (c(exif_original) | has_taken))
    return (
        F.when(screenshot, "SCREENSHOT").when(external & c(gps) & (c(exif_offset) | c(exif_original)), "STRONG_CAPTURE").when(external, "DOWNLOADED_OR_EXTERNAL")
        .when(strong, "STRONG_CAPTURE").when(camera | c(exif_original) | has_taken, "LIKELY_CAPTURE").otherwise("WEAK_DATE_ONLY")
    )


def effective_evidence(evidence, exif_original, exif_offset, taken, gps) -> Column:
    """F8: what is known, else what the metadata says."""
    original, offset = F.trim(F.coalesce(c(exif_original), F.lit(""))) != "", F.trim(F.coalesce(c(exif_offset), F.lit(""))) != ""
    own = F.when(offset | (original & c(gps)), "STRONG_CAPTURE").when(original | (c(taken) > 0), "LIKELY_CAPTURE").when(c(gps), "STRONG_CAPTURE").otherwise("WEAK_DATE_ONLY")
    return F.when(c(evidence) != "UNKNOWN", c(evidence)).otherwise(own)


def story_eligibility(name, is_pinned, ts, confidence, start, end, tolerance=300_000) -> Column:
    """struct<status, ts>; a time up to five minutes outside its parent is moved to the parent's edge."""
    t, a = c(ts), c(start)
    b = F.greatest(a, c(end))
    out = lambda s, x: F.struct(F.lit(s).alias("status"), x.cast("bigint").alias("ts"))
    return (
        F.when(~c(is_pinned) & ~story_name(name), out("INELIGIBLE_SCREENSHOT_OR_DOWNLOAD", F.coalesce(t, a)))
        .when(t.isNull() | (c(confidence) == "UNKNOWN"), out("INELIGIBLE_TIME_UNCERTAIN", a)).when(t.between(a, b), out("ELIGIBLE", t))
        .when(t.between(a - tolerance, a), out("CLAMPED_TO_PARENT", a)).when(t.between(b, b + tolerance), out("CLAMPED_TO_PARENT", b))
        .otherwise(out("INELIGIBLE_TIMESTAMP_CONFLICT", t))
    )


#: Label words of a photo category, in the order they are tried.
CATEGORIES = [
    ("people", ["person", "people", "selfie", "portrait", "baby", "child"]), ("food", ["food", "cuisine", "meal", "drink", "dessert"]),
    ("activity", ["sport", "sports", "vehicle", "boat", "bicycle", "car", "adventure"]), ("places", ["building", "architecture", "tower", "temple", "city"]),
    ("scenery", ["landscape", "mountain", "sky", "water", "beach", "forest", "nature", "plant"]),
]


def label_category(labels) -> Column:
    """X12."""
    out = None
    for name, words in CATEGORIES:
        test = F.arrays_overlap(F.transform(c(labels), lambda x: F.lower(x)), F.array(*map(F.lit, words)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


def distance_text(m) -> Column:
    """One decimal under 100 km, else whole kilometres; with separators."""
    km = c(m) / 1000
    return F.when(km >= 100, F.format_string("%,.0f", km)).otherwise(F.format_string("%,.1f", km))


def mode_label(mode, segment_id, at_stop) -> Column:
    """Bridges are estimated, a stop is a stop, else the mode with a capital."""
    return F.when(F.coalesce(c(segment_id).startswith("bridge_"), F.lit(False)), "Estimated").when(c(at_stop), "Stop").otherwise(F.initcap(F.lower(c(mode))))


def movement_text(start_zone, end_zone) -> Column:
    """Which of the two zones are known, and whether they differ."""
    s, e = c(start_zone), c(end_zone)
    return F.when(s.isNull() & e.isNull(), "zone unknown").when(s.isNull(), F.concat(F.lit("arrives in "), e)).when(e.isNull(), F.concat(F.lit("departs in "), s)).when(s == e, s).otherwise(F.concat(s, F.lit(" → "), e))


def export_title(title, first, last, metres, memories) -> Column:
    """Title and end-card fields."""
    days = (F.datediff(c(last), c(first)) + 1).cast("string")
    return F.concat_ws(" | ", c(title), F.concat(days, F.lit(" days")), F.format_string("%.1f km", c(metres) / 1000), F.concat(c(memories).cast("string"), F.lit(" Memories")))
