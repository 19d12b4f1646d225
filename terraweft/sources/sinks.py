"""Writers: reports, waypoint files, geotagged photographs, job lines and map pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, path: str) -> None:
    """One JSON document a row, in as many files as there are tasks; Spark's commit makes it whole or absent."""
    df.write.mode("overwrite").json(path)


def waypoint_files(lines: DataFrame, path: str) -> None:
    """One folder of text a mission: the header and its lines in order."""
    head = lines.select("mission", F.lit(-1).alias("row"), F.lit("QGC WPL 110").alias("line")).distinct()
    every = head.unionByName(lines.select("mission", "row", "line"))
    every.repartition("mission").sortWithinPartitions("mission", "row").select("mission", F.col("line").alias("value")).write.mode("overwrite").partitionBy("mission").text(path)


def job_lines(df: DataFrame, path: str) -> None:
    """Matching jobs as JSON arrays, one a line, appended as whole files: a reader never sees half a line."""
    df.select(F.to_json(F.array(F.col("path").cast("string"), *(F.col(c).cast("string") for c in ("lat", "lon", "alt")))).alias("value")).write.mode("append").text(path)


def read_job_lines(lines: DataFrame) -> DataFrame:
    """The same as a table or stream: path, lat, lon, alt; lines that are no array of four are left out."""
    a = F.from_json("value", "array<string>")
    return lines.where(F.size(a) == 4).select(a[0].alias("path"), *(a[i].cast("double").alias(c) for i, c in ((1, "lat"), (2, "lon"), (3, "alt"))))


def dual_write(degraded: DataFrame, clean: DataFrame, folder: str) -> None:
    """A batch of frames under images (as the camera shows them) and mosaic_images (clean, which a rebuild prefers).

    Both frames must come from one settled batch; the clean ones are written last, so that they are never without the others.
    """
    degraded.write.mode("append").parquet(f"{folder}/images")
    clean.write.mode("append").parquet(f"{folder}/mosaic_images")


def complete_lines(log: Column, offset: Column) -> Column:
    """Struct of lines and offset: what a log (bytes) holds after an offset, up to its last line end, and the offset behind it.

    A line without its end is still being written: it is left for the next reading.
    """
    rest = F.substring(log, (offset + 1).cast("int"), F.octet_length(log))
    # In this coding a letter is a byte, so that an unfinished letter at the end does no harm.
    taken = F.length(F.regexp_extract(F.decode(rest, "ISO-8859-1"), r"(?s)^(.*\n)", 1))
    text = F.make_valid_utf8(F.substring(rest, F.lit(1), taken - 1).cast("string"))
    lines = F.when(taken == 0, F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    return F.struct(lines.alias("lines"), (offset + taken).alias("offset"))


def png(rows: np.ndarray) -> bytes:
    """An 8-bit picture of shape (rows, columns, 1, 3 or 4)."""
    height, width, channels = rows.shape
    kind = {1: 0, 3: 2, 4: 6}[channels]
    raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rows)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def map_tiles(cells: DataFrame, tile: int = 256) -> DataFrame:
    """tile_row, tile_col, picture: the map as PNG tiles of grey and coverage; each tile is made where its cells are."""
    import pandas as pd

    dealt = cells.select((F.col("row") / tile).cast("int").alias("tile_row"), (F.col("col") / tile).cast("int").alias("tile_col"), (F.col("row") % tile).cast("int").alias("r"), (F.col("col") % tile).cast("int").alias("c"), F.col("value").cast("double"))

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((tile, tile, 4), np.uint8)
        grey = np.clip(g.value.to_numpy(), 0, 255)
        for k in range(3):
            canvas[g.r, g.c, k] = grey
        canvas[g.r, g.c, 3] = 255
        return pd.DataFrame({"tile_row": [g.tile_row.iloc[0]], "tile_col": [g.tile_col.iloc[0]], "picture": [png(canvas)]})

    return dealt.groupBy("tile_row", "tile_col").applyInPandas(draw, "tile_row int, tile_col int, picture binary")
