"""The live map: a table of map cells that each batch of captures improves, and the backlog of matching work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.operators.raster import best_view


def merged(map_cells: DataFrame | None, seen: DataFrame, hysteresis: float = 1e-6) -> DataFrame:
    """row, col, frame_id, weight after a batch: a cell changes hands only if the new view is better by the hysteresis."""
    new = best_view(seen, ["row", "col"], "frame_id").select("row", "col", F.col("frame_id").alias("f2"), F.col("weight").alias("w2"))
    if map_cells is None:
        return new.select("row", "col", F.col("f2").alias("frame_id"), F.col("w2").alias("weight"))
    both = map_cells.join(new, ["row", "col"], "full_outer")
    better = F.col("weight").isNull() | (F.col("w2") > F.col("weight") + hysteresis)
    return both.select(
        "row", "col", F.when(better, F.coalesce("f2", "frame_id")).otherwise(F.col("frame_id")).alias("frame_id"), F.when(better, F.coalesce("w2", "weight")).otherwise(F.col("weight")).alias("weight"),
    )


class LiveMap:
    """A foreachBatch sink: the map as files of the shared folder, one folder a batch; the last two are kept.

    The folders are all of its state: a stream that begins again, on another driver too, goes on from the last whole batch,
    and a batch that is delivered again is left alone.
    """

    def __init__(self, folder: str, hysteresis: float = 1e-6) -> None:
        self.folder, self.hysteresis = folder.rstrip("/"), hysteresis

    def _files(self, spark: SparkSession, name: str = ""):  # noqa: ANN202
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}{name}")
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def batches(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches that are wholly written, in order."""
        files, path = self._files(spark)
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch-") and files.exists(self._files(spark, f"/{n}/_SUCCESS")[1]))

    def cells(self, spark: SparkSession) -> DataFrame | None:
        """The map after the last whole batch, null before the first."""
        done = self.batches(spark)
        return spark.read.parquet(f"{self.folder}/batch-{done[-1]}") if done else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = self.batches(spark)
        if done and number <= done[-1]:
            return
        merged(self.cells(spark), batch, self.hysteresis).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        for old in done[:-1]:
            files, path = self._files(spark, f"/batch-{old}")
            files.delete(path, True)


def backlog(jobs: DataFrame, done: DataFrame, at_most: int) -> DataFrame:
    """The next pairs to match: those of the newest capture first, the oldest others after; at most so many a batch."""
    waiting = jobs.join(done.select("i", "j"), ["i", "j"], "left_anti")
    newest = waiting.agg(F.max(F.greatest("i", "j")).alias("newest"))
    ranked = waiting.join(F.broadcast(newest)).withColumn("late", (F.greatest("i", "j") != F.col("newest")).cast("int"))
    return ranked.orderBy("late", "i", "j").limit(at_most).select("i", "j")
