"""Queries: the live capture's stream, and the pipelines over captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.plans.catalog import query
from terraweft.plans.capture import ARMED_SQL, CLOSE_SQL, close_pairs
from terraweft.plans.geometry import LOCAL_SQL
from terraweft.plans.matching import REACH_SQL
from terraweft.plans.rasters import CELLS_SQL, COLUMNS, cells
from terraweft.plans.streams import DECISIONS_SQL
from terraweft.operators import graph, raster
from terraweft.session import settle
from terraweft.sources import sinks
from terraweft.sources.frames import AREA, telemetry
from terraweft.streaming.capture import Rules, captured


@query("T2_capture_decisions", DECISIONS_SQL + " SELECT * FROM decisions")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every session by the stateful rules, as a batch."""
    return captured(telemetry(spark, sf_dir), Rules(AREA))


@query("T3_session_ends", ARMED_SQL + ", c AS (SELECT session, msg_id, armed, coalesce(lag(armed) OVER (PARTITION BY session ORDER BY msg_id), false) AS was FROM beats) SELECT session, msg_id FROM c WHERE was AND NOT armed")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(telemetry(spark, sf_dir), Rules(AREA)).where("event = 'disarmed'").select("session", "msg_id")


@query("K6_map_tiles")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of the blended map of all sessions."""
    blended = raster.feathered(cells(spark, sf_dir), ["row", "col"])
    return sinks.map_tiles(blended).select("tile_row", "tile_col", F.length("picture").alias("bytes"))


@query("R17_match_session", f"""WITH RECURSIVE {CELLS_SQL}, {CLOSE_SQL.removeprefix(LOCAL_SQL + ", ")}, pair AS (SELECT DISTINCT session, least(i, j) AS i, greatest(i, j) AS j FROM near WHERE rank <= 25),
link AS (SELECT p.session, p.i, p.j FROM pair p JOIN cells a ON a.session = p.session AND a.frame_id = p.i JOIN cells c ON c.session = p.session AND c.frame_id = p.j AND c.row = a.row AND c.col = a.col GROUP BY 1, 2, 3 HAVING count(*) >= 12),
b AS (SELECT i AS a, j AS b FROM link UNION SELECT j, i FROM link), {REACH_SQL}, big AS (SELECT component, count(*) AS frames FROM reach GROUP BY 1 HAVING count(*) >= 6)
SELECT session, component, frames, count(*) AS links FROM link JOIN reach ON node = i JOIN big USING (component) GROUP BY 1, 2, 3""")
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, verified links and the connected part of each session: pairs in reach whose views overlap enough."""
    near = close_pairs(spark, sf_dir).select("session", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    # What a capture sees is one row: joined cell by cell, candidates would be copied for each cell.
    place = (F.col("row") * COLUMNS + F.col("col")).cast("int")
    seen = settle(cells(spark, sf_dir).select("session", "frame_id", place.alias("place")).groupBy("session", "frame_id").agg(F.collect_set("place").alias("places")).where(F.size("places") >= 12), "seen")
    a, b = (seen.select("session", F.col("frame_id").alias(n), F.col("places").alias(p)).hint("merge") for n, p in (("i", "p"), ("j", "q")))
    shared = near.distinct().join(a, ["session", "i"]).join(b, ["session", "j"]).select("session", "i", "j", F.size(F.array_intersect("p", "q")).alias("cells"))
    links = settle(shared.where("cells >= 12"), "links")
    parts = graph.connected_components(links.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    size = parts.groupBy("component").agg(F.count("*").alias("frames")).where("frames >= 6")
    return links.join(parts, F.col("i") == F.col("node")).join(size, "component").groupBy("session", "component", "frames").agg(F.count("*").alias("links"))
