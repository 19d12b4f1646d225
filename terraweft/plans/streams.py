"""Queries that run a stream: telemetry logs are written, drained over several runs from one checkpoint, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.plans.catalog import query
from terraweft.plans.geometry import CROSSINGS_SQL, EAST, NORTH, edges_values
from terraweft.session import settle, shared_folder, table
from terraweft.sources import log_stream
from terraweft.sources.frames import AREA, TELEMETRY_SQL, telemetry
from terraweft.streaming import live
from terraweft.streaming.capture import Rules

#: Runs of a query: each finds more of the log and goes on from the checkpoint that the one before left.
RUNS = 3


def stream_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/terraweft/{name}-{uuid.uuid4().hex}"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry that has a place in a session, with times in UTC."""
    t = telemetry(spark, sf_dir).where("session is not null and msg_id is not null and ts is not null")
    return settle(t.withColumn("ts", F.col("ts").cast("timestamp_ltz")), "messages")


def by_runs(rows: DataFrame, order: str, runs: int = RUNS) -> list[DataFrame]:
    """rows in as many slices by `order`, of like width."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return [rows]
    cut = [low + (high - low + 1) * k // runs for k in range(runs + 1)]
    return [rows.where((F.col(order) >= a) & (F.col(order) < b)) for a, b in zip(cut, cut[1:])]


@query("S1_log_stream", f"WITH {TELEMETRY_SQL} SELECT session, msg_type, count(*) AS messages, min(msg_id) AS first_msg, max(msg_id) AS last_msg FROM telemetry GROUP BY session, msg_type")
def s1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a stream reads them from growing logs, each once."""
    folder = stream_folder(spark, "scan")
    lines = live.log_lines(spark, f"{folder}/log", 1 << 20)
    read = live.messages_of(lines).select("session", "msg_id", "msg_type")
    found = None
    for part in by_runs(messages(spark, sf_dir), "msg_id"):
        live.write_log(part, f"{folder}/log", "msg_id")
        found = live.drained(read, folder)
    return found.groupBy("session", "msg_type").agg(F.count("*").alias("messages"), F.min("msg_id").alias("first_msg"), F.max("msg_id").alias("last_msg"))


DECISIONS_SQL = f"""WITH RECURSIVE {TELEMETRY_SQL}, {edges_values(AREA)},
located AS (SELECT *, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, rel_alt_mm / 1e3 AS alt, row_number() OVER (PARTITION BY session ORDER BY msg_id) AS n FROM telemetry),
local AS (SELECT *, {EAST} AS east, {NORTH} AS north FROM located), m AS (SELECT *, {CROSSINGS_SQL} % 2 = 1 AS inside FROM local),
fold AS (
  SELECT session, CAST(0 AS BIGINT) AS n, false AS armed, 0e0 AS fr, 0e0 AS fp, false AS was, 0e0 AS ke, 0e0 AS kn, false AS has, CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS before,
    CAST(NULL AS VARCHAR) AS beat, CAST(NULL AS VARCHAR) AS moved, false AS photo FROM m WHERE n = 1
  UNION ALL
  SELECT session, n, CASE WHEN heard THEN now ELSE armed END, CASE WHEN ended THEN 0 WHEN msg_type = 'ATTITUDE' THEN roll ELSE fr END, CASE WHEN ended THEN 0 WHEN msg_type = 'ATTITUDE' THEN pitch ELSE fp END,
    CASE WHEN ended THEN false WHEN here THEN inside ELSE was END, CASE WHEN ended THEN 0 WHEN shot THEN east ELSE ke END, CASE WHEN ended THEN 0 WHEN shot THEN north ELSE kn END, NOT ended AND (has OR shot),
    CASE WHEN ended THEN 0 WHEN shot THEN kept + 1 ELSE kept END, kept,
    CASE WHEN heard AND now AND NOT armed THEN 'armed' WHEN ended THEN 'disarmed' END, CASE WHEN here AND inside AND NOT was THEN 'enter' WHEN here AND was AND NOT inside THEN 'leave' END, shot
  FROM (
    SELECT *, heard AND armed AND NOT now AS ended, here AND inside AND (NOT has OR sqrt(pow(east - ke, 2) + pow(north - kn, 2)) >= 40) AND greatest(abs(fr), abs(fp)) <= radians(12) AS shot
    FROM (
      SELECT f.armed, f.fr, f.fp, f.was, f.ke, f.kn, f.has, f.kept, m.session, m.n, m.msg_type, m.roll, m.pitch, m.east, m.north, m.inside, coalesce((m.base_mode & 128) <> 0, false) AS now,
        m.msg_type = 'HEARTBEAT' AND coalesce(m.src_component = 1, false) AS heard, m.msg_type = 'GLOBAL_POSITION_INT' AND f.armed AND coalesce(m.alt >= 1, false) AS here
      FROM fold f JOIN m ON m.session = f.session AND m.n = f.n + 1
    )
  )
), decisions AS (
  SELECT m.session, m.msg_id, f.beat AS event, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS alt, CAST(NULL AS DOUBLE) AS heading, f.before AS kept FROM fold f JOIN m USING (session, n) WHERE f.beat IS NOT NULL
  UNION ALL SELECT m.session, m.msg_id, f.moved, m.lat, m.lon, m.alt, NULL, f.before FROM fold f JOIN m USING (session, n) WHERE f.moved IS NOT NULL
  UNION ALL SELECT m.session, m.msg_id, 'photo', m.lat, m.lon, m.alt, CASE WHEN m.hdg_cdeg = 65535 THEN 0 ELSE m.hdg_cdeg / 100e0 END, f.before + 1 FROM fold f JOIN m USING (session, n) WHERE f.photo
)"""


@query("T1_live_session", DECISIONS_SQL + """, heard AS (SELECT session, msg_id, epoch_us(ts) // 1000 AS at_ms, coalesce(lead(epoch_us(ts) // 1000) OVER (PARTITION BY session ORDER BY msg_id), (SELECT max(epoch_us(ts) // 1000) FROM telemetry)) AS until_ms FROM telemetry)
SELECT *, CAST(NULL AS BIGINT) AS due_ms FROM decisions
UNION ALL SELECT session, msg_id, event, NULL, NULL, NULL, NULL, NULL, at_ms + 1000 * s FROM heard, (VALUES (15, 'return'), (90, 'disarm')) AS l(s, event) WHERE at_ms + 1000 * s <= until_ms""")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture decisions and link timers of all sessions, by a stateful stream that is stopped and restarted twice."""
    folder = stream_folder(spark, "live")
    events = live.live(live.messages_of(live.log_lines(spark, f"{folder}/log", 1 << 20)), Rules(AREA))
    found = None
    for part in by_runs(messages(spark, sf_dir), "msg_id"):
        live.write_log(part, f"{folder}/log", "msg_id")
        found = live.drained(events, folder)
    return found


@query("S19_log_stream", """WITH e AS (SELECT user_id AS session, event_id, concat('{"ä":', event_id, ',"p":', coalesce(props, 'null'), '}') AS line FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)
SELECT concat('session=', session, '/log.jsonl') AS log, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", line FROM e""")
def s19_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each session that grows by thirds of its bytes, cut within lines and letters: each line is read once."""
    folder = stream_folder(spark, "tail")
    e = table(spark, sf_dir, "events").where("user_id is not null and event_id is not null")
    line = F.concat(F.lit('{"ä":'), F.col("event_id").cast("string"), F.lit(',"p":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    rows = settle(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), line.alias("line")), "lines")
    found = None
    for k in range(1, RUNS + 1):
        live.write_growing(rows, f"{folder}/log", k / RUNS)
        found = live.drained(live.log_lines(spark, f"{folder}/log", 4096), folder)
    return found
