"""Adapters from the given tables to captures, telemetry, descriptors and waypoints, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.functions.geo import Area
from terraweft.session import table

# The area that is mapped, the fence around it, and the circuit flown before.
AREA = Area([(37.4112, -121.9988), (37.4112, -121.9973), (37.4127, -121.9971), (37.4128, -121.9986)])
FENCE = Area([(37.4109, -121.9991), (37.4109, -121.9969), (37.4131, -121.9969), (37.4121, -121.9980), (37.4131, -121.9991)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, frame_id, ts, lat, lon, alt, heading (null where unknown), roll, pitch (degrees)."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("user_id").alias("session"), F.row_number().over(order).alias("seq"), i.alias("frame_id"), "ts",
        (F.lit(37.4110) + ((i * 7919) % 2000) / F.lit(1e6)).alias("lat"), (F.lit(-121.9990) + ((i * 104729) % 2000) / F.lit(1e6)).alias("lon"),
        (F.lit(40) + i % 10).cast("double").alias("alt"), F.when(i % 7 != 0, ((i * 37) % 360).cast("double")).alias("heading"),
        (i % 31 - 15).cast("double").alias("roll"), (i % 23 - 11).cast("double").alias("pitch"),
    )


FRAMES_SQL = """frames AS (
  SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id AS frame_id, ts,
    37.4110e0 + ((event_id * 7919) % 2000) / 1e6 AS lat, -121.9990e0 + ((event_id * 104729) % 2000) / 1e6 AS lon,
    CAST(40 + event_id % 10 AS DOUBLE) AS alt, CASE WHEN event_id % 7 <> 0 THEN CAST((event_id * 37) % 360 AS DOUBLE) END AS heading,
    CAST(event_id % 31 - 15 AS DOUBLE) AS roll, CAST(event_id % 23 - 11 AS DOUBLE) AS pitch
  FROM events)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message stream: positions, attitudes and heartbeats, in the units of the wire."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    position, attitude, beat = (F.col("event_type").isin(*x) for x in (("view", "click"), ("signup",), ("purchase", "error")))
    return e.select(
        F.col("user_id").alias("session"), i.alias("msg_id"), "ts",
        F.when(position, "GLOBAL_POSITION_INT").when(attitude, "ATTITUDE").otherwise("HEARTBEAT").alias("msg_type"),
        F.when(beat, (1 + i % 2).cast("int")).alias("src_component"),
        F.when(beat, F.when(F.col("event_type") == "purchase", 128 + i % 64).otherwise(i % 64).cast("int")).alias("base_mode"),
        F.when(position, (F.lit(374110000) + ((i * 7919) % 2000) * 10).cast("long")).alias("lat_e7"),
        F.when(position, (F.lit(-1219990000) + ((i * 104729) % 2000) * 10).cast("long")).alias("lon_e7"),
        F.when(position, (F.lit(500) + (i * 131) % 60000).cast("long")).alias("rel_alt_mm"),
        F.when(position, F.when(i % 11 == 0, 65535).otherwise((i * 37) % 36000).cast("int")).alias("hdg_cdeg"),
        F.when(attitude, (i % 31 - 15) / F.lit(100.0)).alias("roll"), F.when(attitude, (i % 23 - 11) / F.lit(100.0)).alias("pitch"),
    )


TELEMETRY_SQL = """telemetry AS (
  SELECT user_id AS session, event_id AS msg_id, ts,
    CASE WHEN event_type IN ('view', 'click') THEN 'GLOBAL_POSITION_INT' WHEN event_type = 'signup' THEN 'ATTITUDE' ELSE 'HEARTBEAT' END AS msg_type,
    CASE WHEN event_type IN ('purchase', 'error') THEN 1 + event_id % 2 END AS src_component,
    CASE WHEN event_type = 'purchase' THEN 128 + event_id % 64 WHEN event_type = 'error' THEN event_id % 64 END AS base_mode,
    CASE WHEN event_type IN ('view', 'click') THEN 374110000 + ((event_id * 7919) % 2000) * 10 END AS lat_e7,
    CASE WHEN event_type IN ('view', 'click') THEN -1219990000 + ((event_id * 104729) % 2000) * 10 END AS lon_e7,
    CASE WHEN event_type IN ('view', 'click') THEN 500 + (event_id * 131) % 60000 END AS rel_alt_mm,
    CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN event_id % 11 = 0 THEN 65535 ELSE (event_id * 37) % 36000 END END AS hdg_cdeg,
    CASE WHEN event_type = 'signup' THEN (event_id % 31 - 15) / 100.0e0 END AS roll, CASE WHEN event_type = 'signup' THEN (event_id % 23 - 11) / 100.0e0 END AS pitch
  FROM events)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, feat_id, desc: the embeddings as local descriptors."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    return e.select((F.col("vec_id") % 40).alias("image_id"), F.col("vec_id").alias("feat_id"), F.col("embedding").alias("desc"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, score: the graph of parts bought together with a supplier, of every row of lineitem."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).agg(F.sum("l_quantity").cast("long").alias("score"))


EDGES_SQL = "edges AS (SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2)"
