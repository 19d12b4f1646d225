"""Rasters in long form: one row a pixel or map cell, composed with joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.functions.geo import Area


def cropped(pixels: DataFrame, width: int, share: float) -> DataFrame:
    """Without `share` of the columns on each side; columns count from 0 again."""
    cut = int(width * share)
    return pixels.where(F.col("col").between(cut, width - cut - 1)).withColumn("col", F.col("col") - cut)


def to_bgr(mode: Column, channels: Column) -> Column:
    """Three channels, blue first, from a grey, RGB, RGBA, BGR or BGRA pixel; null for another mode."""
    at = lambda *k: F.array(*(F.element_at(channels, i) for i in k))
    return F.when(mode == "L", at(1, 1, 1)).when(mode.isin("RGB", "RGBA"), at(3, 2, 1)).when(mode.isin("BGR", "BGRA"), at(1, 2, 3))


def radius2(row: Column, col: Column, height: int, width: float) -> Column:
    """Squared distance from the centre; the middles of the sides are at 1."""
    return F.pow((col - width / 2) / (width / 2), F.lit(2.0)) + F.pow((row - height / 2) / (height / 2), F.lit(2.0))


def vignette(row: Column, col: Column, height: int, width: float, strength: float) -> Column:
    return F.lit(1.0) - strength * F.least(radius2(row, col, height, width), F.lit(1.96))


def undistorted(pixels: DataFrame, image: str, height: int, width: int, k1: float, k2: float) -> DataFrame:
    """Each pixel takes the nearest source pixel along the lens model's radius: a gather, as an equi-join."""
    f = 0.85 * max(width, height)
    x, y = (F.col("col") - width / 2) / f, (F.col("row") - height / 2) / f
    r2 = x * x + y * y
    scale = 1 + k1 * r2 + k2 * r2 * r2
    wanted = pixels.select(
        image, "row", "col",
        F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor(x * scale * f + width / 2 + 0.5))).cast("int").alias("_c"),
        F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(y * scale * f + height / 2 + 0.5))).cast("int").alias("_r"),
    )
    source = pixels.select(image, F.col("row").alias("_r"), F.col("col").alias("_c"), "value")
    return wanted.join(source, [image, "_r", "_c"]).select(image, "row", "col", "value")


def lens_taps(spark: SparkSession, height: int, width: int, crop: float, k1: float, k2: float) -> DataFrame:
    """row_to, col_to, row, col, share: the up to four pixels of a cropped frame that each corrected pixel is mixed of.

    The lens model is inverted by five fixed-point steps; places outside the frame take its border. One row a pixel and tap,
    so it is as large as one frame.
    """
    full = width / crop
    margin, f = (full - width) / 2, 0.85 * max(full, height)
    row_to, col_to = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    t = spark.range(height * width).select(row_to.alias("row_to"), col_to.alias("col_to"), ((col_to + margin - full / 2) / f).alias("x0"), ((row_to - height / 2) / f).alias("y0"))
    t = t.withColumns({"x": F.col("x0"), "y": F.col("y0")})
    for _ in range(5):
        r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
        t = t.withColumn("s", 1 + k1 * r2 + k2 * r2 * r2).withColumns({"x": F.col("x0") / F.col("s"), "y": F.col("y0") / F.col("s")})
    within = lambda x, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), x))
    t = t.withColumns({"c": within(F.col("x") * f + (full / 2 - margin), width), "r": within(F.col("y") * f + height / 2, height)})
    t = t.withColumns({"c0": F.floor("c").cast("int"), "r0": F.floor("r").cast("int")}).withColumns({"fc": F.col("c") - F.col("c0"), "fr": F.col("r") - F.col("r0")})
    tap = lambda dr, dc: F.struct((F.col("r0") + dr).alias("row"), (F.col("c0") + dc).alias("col"), ((F.col("fr") if dr else 1 - F.col("fr")) * (F.col("fc") if dc else 1 - F.col("fc"))).alias("share"))
    return t.select("row_to", "col_to", F.inline(F.array(*(tap(r, c) for r in (0, 1) for c in (0, 1))))).where("share > 0")


def read_frames(pixels: DataFrame, image: str, height: int, width: int, profile: str = "none", crop: float = 0.8, k1: float = -0.12, k2: float = 0.02, strength: float = 0.3) -> DataFrame:
    """image, row, col, value of frames of which `crop` of the width is left.

    Profile "none" passes them as they are, "synthetic" undoes the vignetting of the whole frame (to whole values), then its
    lens, bilinearly. Another profile or a crop outside (0, 1] is an error.
    """
    if profile not in ("none", "synthetic") or not 0 < crop <= 1:
        raise ValueError("unknown camera profile or crop")
    if profile == "none":
        return pixels.select(image, "row", "col", "value")
    full = width / crop
    gain = F.greatest(vignette(F.col("row"), F.col("col") + (full - width) / 2, height, full, strength), F.lit(0.1))
    even = pixels.withColumn("value", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value") / gain))))
    taps = lens_taps(pixels.sparkSession, height, width, crop, k1, k2)
    mixed = even.join(taps, ["row", "col"]).groupBy(image, "row_to", "col_to").agg(F.sum(F.col("share") * F.col("value")).alias("value"))
    return mixed.select(image, F.col("row_to").alias("row"), F.col("col_to").alias("col"), "value")


def uniform(*parts: Column | str) -> Column:
    """A seeded number in (0, 1), the same for the same parts wherever it is computed."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def noisy(pixels: DataFrame, image: str, seed: int, sigma: float) -> DataFrame:
    """Values with seeded normal noise, kept within 0..255."""
    u, v = (uniform(str(seed), k, F.col(image), F.col("row"), F.col("col")) for k in ("u", "v"))
    noise = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * 3.141592653589793) * v) * sigma
    return pixels.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value") + noise)))


def canvas(area: Area, cell: float, margin: float) -> tuple[float, float, int, int]:
    """(west, north) corner and (columns, rows) of the map of an area."""
    e, n = [x for x, _ in area.local], [y for _, y in area.local]
    columns, rows = (int(-(-(max(v) - min(v) + 2 * margin) // cell)) for v in (e, n))
    if columns * rows > 50_000_000:
        raise ValueError("the map has more than 50 million cells")
    return min(e) - margin, max(n) + margin, columns, rows


def footprint(frames: DataFrame, corner: tuple[float, float, int, int], cell: float, reach: Column) -> DataFrame:
    """frames with one row for each map cell whose centre is within `reach`: row, col, gap2 (squared, in reaches).

    Only cells of the footprint's box within the map are made.
    """
    west, north, columns, rows = corner
    c0 = F.greatest(F.lit(0), F.floor((F.col("east") - reach - west) / cell))
    c1 = F.least(F.lit(columns - 1), F.floor((F.col("east") + reach - west) / cell))
    r0 = F.greatest(F.lit(0), F.floor((north - F.col("north") - reach) / cell))
    r1 = F.least(F.lit(rows - 1), F.floor((north - F.col("north") + reach) / cell))
    some = frames.withColumn("_c0", c0).withColumn("_c1", c1).withColumn("_r0", r0).withColumn("_r1", r1).where("_c0 <= _c1 and _r0 <= _r1")
    cells = some.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    de = F.lit(west) + (F.col("col") + 0.5) * cell - F.col("east")
    dn = F.lit(north) - (F.col("row") + 0.5) * cell - F.col("north")
    gap2 = (de * de + dn * dn) / (reach * reach)
    return cells.withColumn("gap2", gap2).where("gap2 <= 1").drop("_c0", "_c1", "_r0", "_r1")


def best_view(cells: DataFrame, keys: list[str], source: str) -> DataFrame:
    """The source with the highest weight of each cell; of equals the earliest."""
    best = F.max(F.struct("weight", (-F.col(source)).alias("s"))).alias("b")
    return cells.groupBy(*keys).agg(best, F.count("*").alias("views")).select(*keys, (-F.col("b.s")).alias(source), F.col("b.weight").alias("weight"), "views")


def disagreeing(cells: DataFrame, keys: list[str], variance: float, views: int) -> DataFrame:
    """Cells that enough views see with too large a variance.

    The variance is compared as n times the sum of squares less the squared sum, which is exact for whole values: a cell whose
    variance is the limit itself is not too large, in whatever order its views are summed.
    """
    s = cells.groupBy(*keys).agg(F.count("value").alias("_n"), F.sum(F.col("value") * F.col("value")).alias("_q"), F.sum("value").alias("_s"), F.count("*").alias("views"))
    spread, whole = F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"), F.col("_n") * F.col("_n")
    return s.where((spread > variance * whole) & (F.col("views") >= views)).select(*keys, (spread / whole).alias("variance"), "views")


#: A map of so few places is one row of its group, and tasks stream such rows, FIELD places at a time.
PLACES, FIELD = 4_096, 1 << 20
AROUND = [(0, 1), (1, -1), (1, 0), (1, 1)]


def joined(many: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 to many - 1 is joined with by the links i, j."""
    low = np.arange(many)
    while len(i):
        np.minimum.at(low, np.maximum(low[i], low[j]), np.minimum(low[i], low[j]))
        while (low[low] != low).any():
            low = low[low]
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
    return low


def touching(maps: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Of each set place of many maps (map, row, col) the first place that it is connected with, as row * width + col."""
    many, height, width = maps.shape
    at = np.arange(maps.size).reshape(maps.shape)
    ends = []
    for r, c in steps:
        a = (slice(None), slice(0, height - r), slice(max(0, -c), width - max(0, c)))
        b = (slice(None), slice(r, height), slice(max(0, c), width - max(0, -c)))
        both = maps[a] & maps[b]
        ends.append((at[a][both], at[b][both]))
    i, j = (np.concatenate(e) for e in zip(*ends, strict=True))
    return joined(maps.size, i, j).reshape(maps.shape) % (height * width)


def map_regions(cells: DataFrame, group: str, height: int, width: int, changed: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """group, row, col, region of cells within a small map, on the maps of many groups at a time, after `changed` has changed
    these; region is its first place. A group's places become one row where they lie, if the cells were dealt by group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), max(1, FIELD // (height * width))):
                part = b.iloc[lo : lo + max(1, FIELD // (height * width))]
                maps = np.zeros((len(part), height * width), bool)
                maps[np.repeat(np.arange(len(part)), part["_at"].map(len)), np.concatenate(part["_at"].to_list())] = True
                maps = maps.reshape(-1, height, width)
                maps = changed(maps) if changed else maps
                g, r, c = np.nonzero(maps)
                yield pd.DataFrame({group: part[group].to_numpy()[g], "row": r, "col": c, "region": touching(maps, AROUND)[g, r, c]})

    place = (F.col("row") * width + F.col("col")).cast("int")
    held = cells.where(F.col(group).isNotNull()).groupBy(group).agg(F.collect_list(place).alias("_at"))
    return held.mapInPandas(run, f"`{group}` {dict(cells.dtypes)[group]}, row long, col long, region long")


def cell_regions(cells: DataFrame, group: str, width: int, height: int | None = None) -> DataFrame:
    """group, row, col, region: cells that touch at a side or corner share a region.

    On a map of so few places as PLACES (height is its last row and one) tasks stream groups, else regions are found by joins.
    """
    if height is not None and height * width <= PLACES:
        return map_regions(cells, group, height, width).withColumn("region", (F.col(group) * F.lit(1 << 32) + F.col("region")).cast("long"))
    from terraweft.operators.graph import connected_components

    node = (F.col(group) * F.lit(1 << 32) + F.col("row") * width + F.col("col")).cast("long")
    named = cells.select(group, "row", "col", node.alias("node"))
    around = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in AROUND))
    there = named.select(group, F.col("node").alias("src"), "row", "col", F.explode(around).alias("s"))
    there = there.select(group, "src", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    touching = there.join(named.withColumnRenamed("node", "dst"), [group, "row", "col"]).select("src", "dst")
    parts = connected_components(touching)
    return named.join(parts, "node", "left").select(group, "row", "col", F.coalesce("component", "node").alias("region"))


def run_hull_area(runs: Column) -> Column:
    """Area, in cells, of the hull of the cell centres of one footprint: array of struct(row, first, last), a row once, in order.

    The hull's width in a row is that between the least concave line over the last columns and the greatest convex one under
    the first; between two rows it is the mean of theirs. Twice the area is a whole number, so that it is exact.
    """

    def edge(r: Column, side: str) -> Column:
        """The furthest that a chord between a row up to r and one from r on reaches in row r."""
        sign = 1 if side == "last" else -1
        reach = lambda a, b: F.when(a["row"] == b["row"], (sign * a[side]).cast("double")).otherwise(sign * (a[side] * (b["row"] - r) + b[side] * (r - a["row"])) / (b["row"] - a["row"]))
        upto, onward = F.filter(runs, lambda a: a["row"] <= r), F.filter(runs, lambda b: b["row"] >= r)
        return F.array_max(F.transform(upto, lambda a: F.array_max(F.transform(onward, lambda b: reach(a, b)))))

    top, bottom = F.element_at(runs, 1)["row"], F.element_at(runs, -1)["row"]
    ends = lambda r: F.when((r == top) | (r == bottom), 1.0).otherwise(2.0)
    twice = F.aggregate(F.sequence(top, bottom), F.lit(0.0), lambda s, r: s + ends(r) * (edge(r, "last") + edge(r, "first")))
    return F.when(top == bottom, F.lit(0.0)).otherwise(F.rint(twice) / 2)


def gains(cells: DataFrame, group: str, source: str, keys: list[str]) -> DataFrame:
    """A gain for each source that brings its mean to that of what all sources show in its cells: one step of the
    least-squares exposure balance, from sums over cells."""
    mean = F.avg("value").over(Window.partitionBy(group, *keys))
    return cells.withColumn("_m", mean).groupBy(group, source).agg((F.sum("_m") / F.greatest(F.sum("value"), F.lit(1e-9))).alias("gain"))


def feathered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the views of each cell."""
    w = F.sum("weight")
    return cells.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("value")) / w).alias("value"), F.count("*").alias("views"))
