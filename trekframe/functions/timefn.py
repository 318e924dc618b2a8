"""Date and time column functions.  Instants are epoch milliseconds; unknown is null, never a made-up value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import c

DAY_MS = 86_400_000


def millis(ts) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC whatever the session's zone."""
    t = c(ts)
    return F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS + F.hour(t) * 3_600_000 + F.minute(t) * 60_000 + F.floor(F.extract(F.lit("SECOND"), t) * 1000).cast("bigint")


def as_timestamp(ms) -> Column:
    return F.timestamp_millis(c(ms))


def parse_instant(text) -> Column:
    """Numbers by size as micro-, milliseconds or seconds; ISO text with Z or an offset; all else, and text without a zone, is null."""
    t = F.trim(c(text))
    n = t.try_cast("bigint")
    number = F.when(n > 100_000_000_000_000, F.expr("1") * F.floor(n / 1000)).when(n > 100_000_000_000, n).when(n > 1_000_000_000, n * 1000)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})$"), F.unix_millis(t.try_cast("timestamp")))
    return F.when(t.rlike(r"^-?\d+$"), number.cast("bigint")).otherwise(iso)


def normalise_taken(n) -> Column:
    """A capture time in milliseconds or seconds, from the year 2000 on."""
    k = c(n).cast("bigint")
    return F.when(k >= 946_684_800_000, k).when(k.between(946_684_800, 4_102_444_800), k * 1000)


def exif_local(text) -> Column:
    """D3: 'yyyy:MM:dd HH:mm:ss' as a timestamp without zone."""
    t = F.regexp_replace(F.trim(c(text)), r"^(\d{4})[:-](\d{2})[:-](\d{2})", "$1-$2-$3")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"), F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}", 0).try_cast("timestamp_ntz"))


def _local(ms, zone) -> Column:
    """Wall clock of an instant in a zone, as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), c(zone), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_interval(secs=(c(ms) / 1000).cast("decimal(18,6)")))


def local_date(ms, zone) -> Column:
    """The calendar day of an instant in a zone column; null without a zone."""
    return _local(ms, zone).cast("date")


def wall_clock_instants(local, zone) -> Column:
    """The 0, 1 or 2 instants at which a zone's clocks show a local time, ascending.

    Offsets in force a day before and a day after are tried; an instant counts if it reads back as the same wall clock.
    """
    naive = millis(local)
    offset = lambda at: millis(_local(at, zone)) - at
    tries = F.array(naive - offset(naive - DAY_MS), naive - offset(naive + DAY_MS))
    return F.array_sort(F.array_distinct(F.filter(tries, lambda x: millis(_local(x, zone)) == naive)))


def clamp_day(day, first, last) -> Column:
    """D7."""
    return F.greatest(c(first), F.least(c(last), c(day)))


def duration_text(ms) -> Column:
    """D9: 'Xh Ym', or 'Ym' under an hour."""
    minutes = F.floor(F.greatest(F.lit(0), c(ms)) / 60_000)
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def clock_text(seconds) -> Column:
    """D9: 'm:ss' or 'h:mm:ss'."""
    s = F.greatest(F.lit(0), c(seconds)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def day_number(day, start) -> Column:
    """1 for the first day, never less."""
    return F.greatest(F.datediff(c(day), c(start)) + 1, F.lit(1))


def utc_day(ms) -> Column:
    """Whole days since the epoch, towards zero."""
    return F.expr("1").cast("bigint") * (c(ms) / DAY_MS).cast("bigint")


def overlay_date(ms, departure_zone, arrival_zone, arrived) -> Column:
    """The day in the zone of departure until arrival, then of arrival; UTC is said where neither is known."""
    zone = F.when(c(arrived), F.coalesce(c(arrival_zone), c(departure_zone))).otherwise(F.coalesce(c(departure_zone), c(arrival_zone)))
    text = lambda z: F.date_format(_local(ms, z), "yyyy-MM-dd")
    return F.when(zone.isNotNull(), text(zone)).otherwise(F.concat(text(F.lit("UTC")), F.lit(" UTC")))


def date_window(first, last) -> tuple[Column, Column]:
    """from the first day's start at UTC+14 to the last day's end at UTC-12, less 1 ms."""
    day = lambda d: F.datediff(c(d).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    return day(first) - 14 * 3_600_000, day(last) + DAY_MS + 12 * 3_600_000 - 1
