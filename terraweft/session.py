"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a folder or a single Parquet file."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: spark.checkpoint.dir.

    Where the session names none, a temporary folder is set as checkpoint folder if master is local (tests); on a cluster,
    whose executors would not see it, that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terraweft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        if "/terraweft/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)
    release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of finished shuffles now: it does so once the plans that own them are collected."""
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes what settle() has left in the shared folder; results that still read from it are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/terraweft")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def split_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are both shuffled for it alone: adaptive execution then splits the partition of a hot key.

    small (one row a key) is written first; a side that an aggregate has partitioned already could not be split.
    """
    return big.join(settle(small, "side"), on, how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a task among which groups are dealt.
DEALT = 20_000


def dealt(df: DataFrame, key: str, rows: int = DEALT) -> DataFrame:
    """df dealt over tasks by key, a group whole, in so many tasks that each has about `rows` rows however large df is.

    What is exploded from such rows and grouped or joined by the key and more then stays where it is: only df itself is
    shuffled, once, and what a task holds does not grow with the table. The task of a hot key has all its rows, one by one.
    """
    return df.repartition(max(shuffle_width(df.sparkSession), -(-df.count() // rows)), key)


@contextmanager
def sent_whole(*modules: str) -> Iterator[None]:
    """What is handed to Spark within takes the code of these modules along.

    The processes that plan a stream, unlike tasks, don't see the files that were added to the session.
    """
    own = [sys.modules[m] for m in modules]
    for m in own:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in own:
            cloudpickle.unregister_pickle_by_value(m)
