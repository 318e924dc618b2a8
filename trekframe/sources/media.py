"""Capture time, offset and position out of photo and video files.

A photo's are in the Exif segment of a JPEG file, a TIFF structure of tagged
values; a video's position is an ISO 6709 text in its container's user data.
Only the head of a file up to those parts is looked at, by Spark's binary reader
and an Arrow kernel; a file that is broken, or none of these, gives nulls.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

METADATA = "path string, taken string, offset string, lat double, lng double, alt double"

#: Tags of the main and the Exif directory, and of the GPS directory.
TAKEN, ANY_TIME, OFFSET_TAKEN, ANY_OFFSET, EXIF, GPS = 0x9003, 0x0132, 0x9011, 0x9010, 0x8769, 0x8825
LAT_REF, LAT, LNG_REF, LNG, ALT_REF, ALT = 1, 2, 3, 4, 5, 6
#: Bytes of each type of value.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_POSITION = re.compile(rb"([+-]\d{1,3}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?(?:CRS[^/]*)?/")


def _exif_segment(data: bytes) -> bytes | None:
    """The TIFF structure of a JPEG file's Exif segment."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def _directory(tiff: bytes, at: int, order: str) -> dict[int, object]:
    """Tags of one directory: texts, numbers, or lists of rationals."""
    out: dict[int, object] = {}
    for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, entry)
        size = SIZES.get(kind, 0) * n
        place = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", tiff, entry + 8)[0]
        if not size or place + size > len(tiff):
            continue
        if kind == 2:
            out[tag] = tiff[place : place + size].split(b"\0")[0].decode("ascii", "replace").strip()
        elif kind in (5, 10):
            v = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", tiff, place)
            out[tag] = [a / b if b else None for a, b in zip(v[::2], v[1::2])]
        else:
            out[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind], tiff, place)[0]
    return out


def _degrees(parts, sign: bool) -> float | None:
    if not isinstance(parts, list) or len(parts) < 3 or None in parts[:3]:
        return None
    return (parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if sign else 1)


def photo(data: bytes) -> tuple:
    """(taken, offset, lat, lng, alt) of a JPEG file; a height of 0 is none."""
    tiff = _exif_segment(data)
    if tiff is None:
        return None, None, None, None, None
    order = "<" if tiff[:2] == b"II" else ">"
    main = _directory(tiff, struct.unpack_from(f"{order}I", tiff, 4)[0], order)
    own = _directory(tiff, main[EXIF], order) if EXIF in main else {}
    gps = _directory(tiff, main[GPS], order) if GPS in main else {}
    lat, lng = _degrees(gps.get(LAT), gps.get(LAT_REF) == "S"), _degrees(gps.get(LNG), gps.get(LNG_REF) == "W")
    high = (gps.get(ALT) or [None])[0]
    alt = None if not high or lat is None else -high if gps.get(ALT_REF) == 1 else high
    if lat is None or lng is None:
        lat = lng = None
    return own.get(TAKEN) or main.get(ANY_TIME), own.get(OFFSET_TAKEN) or own.get(ANY_OFFSET), lat, lng, alt


def _boxes(data: bytes, a: int, b: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the content of each box."""
    while a + 8 <= b:
        size, kind = struct.unpack_from(">I", data, a)[0], data[a + 4 : a + 8]
        head = 8
        if size == 1 and a + 16 <= b:
            size, head = struct.unpack_from(">Q", data, a + 8)[0], 16
        end = b if size == 0 else min(b, a + size)
        if end < a + head:
            return
        yield kind, a + head, end
        a = end


def video(data: bytes) -> tuple:
    """(None, None, lat, lng, alt) of an MP4 or QuickTime file."""
    for kind, a, b in _boxes(data, 0, len(data)):
        for inner, c, d in _boxes(data, a, b) if kind == b"moov" else ():
            for name, e, f in _boxes(data, c, d) if inner == b"udta" else ():
                m = _POSITION.search(data, e, f) if name == b"\xa9xyz" else None
                if m:
                    return None, None, float(m[1]), float(m[2]), float(m[3]) if m[3] and float(m[3]) else None
    return None, None, None, None, None


def metadata(files: DataFrame) -> DataFrame:
    """(path, taken, offset, lat, lng, alt) of files(path, content), as Spark's binaryFile source gives them."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def read(data: bytes | None) -> tuple:
        try:
            return video(data) if data and data[4:8] == b"ftyp" else photo(data or b"")
        except (struct.error, IndexError, KeyError, TypeError):  # a broken file
            return (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *read(d)) for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in METADATA.split(", ")])

    return files.select("path", "content").mapInArrow(run, METADATA)
