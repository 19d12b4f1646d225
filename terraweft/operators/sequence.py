"""Operators over ordered rows of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def in_order(*keys: str, by: str = "seq") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def distance_trigger(df: DataFrame, key: str, order: str, east: str, north: str, interval: float) -> DataFrame:
    """Rows at least `interval` from the last kept row of their key; the first row is kept.

    The state depends on what was kept, so no window frame expresses it. Keys are dealt to partitions and sorted there; a
    task streams its rows and holds one kept position, so that a key of any length needs no memory of its own.
    """
    kinds = dict(df.dtypes)
    limit = interval * interval

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, e0, n0 = None, 0.0, 0.0
        for b in batches:
            keep = []
            for k, e, n in zip(b[key].tolist(), b[east].tolist(), b[north].tolist(), strict=True):
                far = k != last_key or (e - e0) * (e - e0) + (n - n0) * (n - n0) >= limit
                if far:
                    last_key, e0, n0 = k, e, n
                keep.append(far)
            yield b[keep]

    rows = df.select(key, order, east, north).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {east} double, {north} double")


def filled_forward(value: Column, order: WindowSpec, default: float = 0.0) -> Column:
    """The last known value up to a row."""
    return F.coalesce(F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(default))


def changed(flag: Column, order: WindowSpec, at_first: bool = False) -> Column:
    """True where a flag differs from the row before it."""
    return F.coalesce(F.lag(flag).over(order) != flag, F.lit(at_first) & flag)


def islands(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of equal flags: key, island, flag, first, last, rows."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_new", F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(key, "island", flag).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"))


def resampled(items: Column, count: int) -> Column:
    """Exactly `count` elements at evenly spaced positions, repeats allowed."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.element_at(items, 1 + F.floor(k * (F.size(items) - 1) / F.lit(float(count - 1))).cast("int")))
