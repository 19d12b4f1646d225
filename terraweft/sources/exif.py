"""Positions in JPEG files: a minimal writer and reader of the EXIF block, and the scan of a folder."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.functions.geo import from_sexagesimal
from terraweft.session import split_join

# The tags of the position block, and the sizes of the field kinds.
GPS_BLOCK, LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT, HEADING_REF, HEADING = 0x8825, 1, 2, 3, 4, 5, 6, 16, 17
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _sexagesimal(x: float) -> list[tuple[int, int]]:
    x = abs(x)
    d = int(x)
    m = int((x - d) * 60)
    return [(d, 1), (m, 1), (int(((x - d) * 60 - m) * 60 * 100), 100)]


def tagged_jpeg(lat: float, lon: float, alt: float, heading: float) -> bytes:
    """A JPEG with nothing but a position block."""
    rationals = {LAT: _sexagesimal(lat), LON: _sexagesimal(lon), ALT: [(int(abs(alt) * 100), 100)], HEADING: [(int(heading % 360 * 100), 100)]}
    plain = {LAT_REF: b"N\0" if lat >= 0 else b"S\0", LON_REF: b"E\0" if lon >= 0 else b"W\0", HEADING_REF: b"T\0"}
    tags = sorted([*rationals, *plain, ALT_REF])
    start = 8 + 2 + 12 + 4
    data_at = start + 2 + 12 * len(tags) + 4
    entries, data = b"", b""
    for t in tags:
        if t in rationals:
            entries += struct.pack(">HHII", t, 5, len(rationals[t]), data_at + len(data))
            data += b"".join(struct.pack(">II", *r) for r in rationals[t])
        elif t == ALT_REF:
            entries += struct.pack(">HHIB3x", t, 1, 1, int(alt < 0))
        else:
            entries += struct.pack(">HHI4s", t, 2, 2, plain[t])
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHIII", 1, GPS_BLOCK, 4, 1, start, 0) + struct.pack(">H", len(tags)) + entries + struct.pack(">I", 0) + data
    block = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xd9"


def tags_of(content: bytes | None) -> dict[int, list]:
    """The position block's fields of a JPEG; empty where it has none or is damaged."""
    try:
        at = 2
        while content[at : at + 2] != b"\xff\xe1" or content[at + 4 : at + 8] != b"Exif":
            if content[at] != 0xFF or content[at + 1] == 0xDA:
                return {}
            at += 2 + struct.unpack_from(">H", content, at + 2)[0]
        tiff = content[at + 10 :]
        order = {b"MM": ">", b"II": "<"}[tiff[:2]]

        def block(offset: int) -> dict[int, tuple[int, int, int]]:
            count = struct.unpack_from(order + "H", tiff, offset)[0]
            return {t: (kind, n, offset + 2 + 12 * k + 8) for k in range(count) for t, kind, n in [struct.unpack_from(order + "HHI", tiff, offset + 2 + 12 * k)]}

        pointer = block(struct.unpack_from(order + "I", tiff, 4)[0])[GPS_BLOCK][2]
        out: dict[int, list] = {}
        for t, (kind, n, place) in block(struct.unpack_from(order + "I", tiff, pointer)[0]).items():
            if SIZES[kind] * n > 4:
                place = struct.unpack_from(order + "I", tiff, place)[0]
            if kind == 5:
                v = struct.unpack_from(f"{order}{2 * n}I", tiff, place)
                out[t] = [a / b if b else None for a, b in zip(v[::2], v[1::2], strict=True)]
            elif kind == 2:
                out[t] = [tiff[place : place + n].rstrip(b"\0").decode("ascii", "replace")]
            else:
                out[t] = list(struct.unpack_from(f"{order}{n}{'B' if SIZES[kind] == 1 else 'H' if SIZES[kind] == 2 else 'I'}", tiff, place))
    except (KeyError, IndexError, struct.error, TypeError):
        return {}
    return out


def positions(files: DataFrame, key: str) -> DataFrame:
    """key, lat, lon, alt and heading (null where unknown) of files with a column content."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [tags_of(c) for c in b.content]
            one = lambda t: [f.get(t, [None])[0] for f in found]  # noqa: B023, E731
            many = lambda t: [f[t] if len(f.get(t, ())) == 3 else None for f in found]  # noqa: B023, E731
            yield pd.DataFrame({key: b[key], "a": many(LAT), "o": many(LON), "ar": one(LAT_REF), "o_r": one(LON_REF), "h": one(ALT), "hr": one(ALT_REF), "heading": one(HEADING)})

    read = files.select(key, "content").mapInPandas(run, f"{key} {kind}, a array<double>, o array<double>, ar string, o_r string, h double, hr int, heading double")
    degrees = lambda v, r: from_sexagesimal(F.col(v)[0], F.col(v)[1], F.col(v)[2], F.col(r))
    return read.select(key, degrees("a", "ar").alias("lat"), degrees("o", "o_r").alias("lon"), F.when(F.col("hr") == 1, -F.col("h")).otherwise(F.col("h")).alias("alt"), "heading")


def in_capture_order(photos: DataFrame) -> DataFrame:
    """The photographs that a session is rebuilt from, numbered by their path: adds seq.

    photos has session, kind ("mosaic_images" or "images"), path and alt. A session with clean pictures leaves the degraded
    ones out; those on the ground (alt below 1 m) are left out afterwards. A session without a picture gives no row.
    """
    clean = photos.groupBy("session").agg(F.bool_or(F.col("kind") == "mosaic_images").alias("_clean"))
    kept = split_join(photos, clean, "session").where((F.col("kind") == "mosaic_images") == F.col("_clean")).drop("_clean").where("alt >= 1.0")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("path")))


def session_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The photographs of the sessions under a folder in order: path, session (its folder), position and seq."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    inside = r"^(.*?)/?(mosaic_images|images)?/[^/]*$"
    found = positions(files, "path").withColumn("session", F.regexp_extract("path", inside, 1)).withColumn("kind", F.regexp_extract("path", inside, 2))
    return in_capture_order(found).drop("kind")
