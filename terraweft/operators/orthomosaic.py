"""From images and their homographies to one map a group, and its report: warp, selection, exposure, seams, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.operators import compositing, raster, seams
from terraweft.session import settle

#: Weights below FAINT are left out, and a view must own this many cells to be a source.
FAINT, LEAST = 0.025, 4


def sources(pixels: DataFrame, views: DataFrame, height: int, width: int, rows: int, cols: int, tile: int = 32, least: int = LEAST) -> DataFrame:
    """group, view, row, col, value, weight of the views (group, view, image, h) that own enough cells of their group's map.

    Weights have nine places, so that which of two equal views owns a cell does not hang on rounding; then the smaller does.
    """
    warped = compositing.warped(pixels, views.select("view", "image", "h"), height, width, rows, cols, tile=tile)
    warped = warped.withColumn("weight", F.round("weight", 9)).where(F.col("weight") > FAINT)
    seen = settle(warped.join(views.select("group", "view"), "view").select("group", "view", "row", "col", "value", "weight"), "seen")
    enough = raster.best_view(seen, ["group", "row", "col"], "view").groupBy("group", "view").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return settle(seen.join(enough.select("view"), "view", "left_semi").select("group", "view", "row", "col", "value", "weight"), "sources")


def balanced(seen: DataFrame, block: int) -> DataFrame:
    """seen with values multiplied by their block's gain, within 0..255."""
    gains = settle(seams.block_gains(seen, "group", "view", block), "gains")
    placed = seen.withColumn("block_row", F.floor(F.col("row") / block)).withColumn("block_col", F.floor(F.col("col") / block))
    value = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value") * F.col("gain")))
    return placed.join(gains, ["group", "view", "block_row", "block_col"]).withColumn("value", value).select(*seen.columns)


def blended(seen: DataFrame, rows: int, cols: int, bands: int) -> DataFrame:
    """group, row, col, value: each view where it is the best one and a cell around it, blended in bands of frequency."""
    own = raster.best_view(seen, ["group", "row", "col"], "view").select("group", "view", "row", "col")
    mask = compositing.dilated(settle(own, "owners"), "view", rows, cols)
    held = seen.join(mask.hint("merge"), ["view", "row", "col"], "left_semi").withColumn("weight", F.lit(1.0))
    return compositing.multiband(held, "group", "view", bands)


def report(views: DataFrame, seen: DataFrame, rows: int, cols: int) -> DataFrame:
    """Of each group: views that there are, that are sources, and the share of the map that these cover."""
    every = views.groupBy("group").agg(F.countDistinct("view").alias("connected_frames"))
    used = seen.groupBy("group").agg(F.countDistinct("view").alias("texture_frames"))
    covered = seen.select("group", "row", "col").distinct().groupBy("group").agg(F.count("*").alias("cells"))
    share = F.round(F.coalesce("cells", F.lit(0)) / F.lit(float(rows * cols)), 9)
    out = every.join(used, "group", "left").join(covered, "group", "left")
    return out.select("group", "connected_frames", F.coalesce("texture_frames", F.lit(0)).alias("texture_frames"), share.alias("coverage_fraction"), F.lit(cols).alias("width"), F.lit(rows).alias("height"))


def rendered(pixels: DataFrame, views: DataFrame, height: int, width: int, rows: int, cols: int, tile: int = 32, block: int = 8, bands: int = 5, balance: bool = True) -> tuple[DataFrame, DataFrame]:
    """The map (group, row, col, value) and the report of each group."""
    seen = sources(pixels, views, height, width, rows, cols, tile)
    even = settle(balanced(seen, block), "even") if balance else seen
    return blended(even, rows, cols, bands), report(views, seen, rows, cols)
