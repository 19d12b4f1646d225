"""Queries: missions planned from suppliers' and customers' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.functions import geo
from terraweft.operators import mission
from terraweft.plans.catalog import query
from terraweft.plans.geometry import edges_values
from terraweft.session import dealt, table
from terraweft.sources.frames import AREA


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mission a customer; sizes, heights and laps follow from the key.

    A row makes a hundred: keys are dealt over tasks first, a mission's rows stay where they are made."""
    k = F.col("c_custkey")
    lap = F.array(*(mission.point(F.lit(a) + k % 3, F.lit(b) - k % 5) for a, b in ((10.0, 20.0), (60.0, 25.0), (70.0, 80.0), (15.0, 75.0))))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(
        k.alias("mission"), (F.lit(40.0) + k % 160).alias("width"), (F.lit(30.0) + k % 90).alias("height"), (F.lit(20.0) + k % 5 * 5).alias("altitude"), (F.lit(20.0) + k % 4 * 5).alias("lap_altitude"),
        (F.lit(3.0) + k % 3).alias("speed"), (F.lit(4.0) + k % 2).alias("lap_speed"), (F.lit(3.0) + k % 4).alias("transfer_speed"), (F.lit(7.0) + k % 11).alias("spacing"),
        (k % 4).cast("int").alias("laps"), (k % 3).cast("double").alias("delay"), (k % 2 * 10).cast("double").alias("lap_delay"), F.lit(37.4119).alias("lat"), F.lit(-121.998).alias("lon"), F.lit(12.5).alias("home_alt"), lap.alias("lap"),
    )


SETTINGS_SQL = """m AS (SELECT c_custkey AS mission, 40e0 + c_custkey % 160 AS width, 30e0 + c_custkey % 90 AS height, 20e0 + c_custkey % 5 * 5 AS altitude, 20e0 + c_custkey % 4 * 5 AS lap_altitude, 3e0 + c_custkey % 3 AS speed, 4e0 + c_custkey % 2 AS lap_speed,
  3e0 + c_custkey % 4 AS transfer_speed, 7e0 + c_custkey % 11 AS spacing, c_custkey % 4 AS laps, CAST(c_custkey % 3 AS DOUBLE) AS delay, CAST(c_custkey % 2 * 10 AS DOUBLE) AS lap_delay, 37.4119e0 AS lat, -121.998e0 AS lon FROM customer),
h AS (SELECT *, width / 2 - least(2, width / 4) AS he, height / 2 - least(2, height / 4) AS hn FROM m), n AS (SELECT *, CAST(greatest(2, ceil(2 * he / spacing) + 1) AS BIGINT) AS count FROM h),
lines AS (SELECT *, -he + i * (2 * he / (count - 1)) AS e, CASE WHEN i % 2 = 0 THEN -hn ELSE hn END AS n1, CASE WHEN i % 2 = 0 THEN hn ELSE -hn END AS n2 FROM (SELECT *, unnest(range(0, count)) AS i FROM n)),
corners(k, a, b) AS (VALUES (0, 10e0, 20e0), (1, 60e0, 25e0), (2, 70e0, 80e0), (3, 15e0, 75e0)), lap AS (SELECT mission, laps, k, a + mission % 3 AS e, b - mission % 5 AS n FROM m, corners)"""


@query("M1_rectangle_lines", f"WITH {SETTINGS_SQL} SELECT mission, i AS line, round(e, 6) AS e, round(n1, 6) AS n1, round(n2, 6) AS n2 FROM lines")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = mission.rectangle_lines(settings(spark, sf_dir)).select("mission", F.posexplode("lines").alias("line", "p"))
    return l.select("mission", F.col("line").cast("long").alias("line"), F.round(F.col("p")[0]["e"], 6).alias("e"), F.round(F.col("p")[0]["n"], 6).alias("n1"), F.round(F.col("p")[1]["n"], 6).alias("n2"))


_LO, _HI = min(x for x, _ in AREA.local), max(x for x, _ in AREA.local)
QUAD_SQL = f"""{SETTINGS_SQL}, {edges_values(AREA)}, q AS (SELECT mission, spacing, least(2, {(_HI - _LO) / 4!r}e0, spacing / 4) AS inset FROM m), qw AS (SELECT *, {_HI - _LO!r}e0 - 2 * inset AS w FROM q), qc AS (SELECT *, CAST(greatest(2, ceil(w / spacing) + 1) AS BIGINT) AS count FROM qw),
ql AS (SELECT *, {_LO!r}e0 + inset + i * w / (count - 1) AS x FROM (SELECT *, unnest(range(0, count)) AS i FROM qc)), qy AS (SELECT mission, i, any_value(spacing) AS spacing, any_value(x) AS x, min(y1 + (x - x1) * (y2 - y1) / (x2 - x1)) AS lo, max(y1 + (x - x1) * (y2 - y1) / (x2 - x1)) AS hi FROM ql JOIN edges ON x1 <> x2 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) GROUP BY mission, i),
qm AS (SELECT *, least(2, (hi - lo) / 4, spacing / 4) AS margin FROM qy), quad AS (SELECT mission, i, x, CASE WHEN i % 2 = 0 THEN lo + margin ELSE hi - margin END AS n1, CASE WHEN i % 2 = 0 THEN hi - margin ELSE lo + margin END AS n2 FROM qm)"""


@query("M2_quad_lines", f"WITH {QUAD_SQL} SELECT mission, i AS line, round(x, 6) AS e, round(n1, 6) AS n1, round(n2, 6) AS n2 FROM quad")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = mission.quad_lines(settings(spark, sf_dir), AREA)
    return l.select("mission", F.col("line").cast("long").alias("line"), *(F.round(c, 6).alias(c) for c in ("e", "n1", "n2")))


@query("M3_lap_route", f"""WITH {SETTINGS_SQL}, r AS (SELECT mission, 0 AS place, e, n FROM lap WHERE k = 0 AND laps > 0 UNION ALL SELECT mission, 1 + lapno * 4 + CASE WHEN k = 0 THEN 3 ELSE k - 1 END, e, n FROM (SELECT *, unnest(range(0, laps)) AS lapno FROM lap))
SELECT mission, CAST(place AS BIGINT) AS place, e, n FROM r""")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = settings(spark, sf_dir).select("mission", F.posexplode(mission.lap_route(F.col("lap"), F.col("laps"))).alias("place", "p"))
    return r.select("mission", F.col("place").cast("long").alias("place"), "p.e", "p.n")


@query("L9_nearest_entry", f"""WITH {SETTINGS_SQL}, ends AS (SELECT mission, min(e) FILTER (i = 0) AS e0, max(n1) FILTER (i = 0) AS a0, max(n2) FILTER (i = 0) AS b0, max(e) FILTER (i = count - 1) AS e1, max(n1) FILTER (i = count - 1) AS a1, max(n2) FILTER (i = count - 1) AS b1 FROM lines GROUP BY mission),
t AS (SELECT l.mission, l.e AS te, l.n AS tn FROM lap l WHERE k = 0), c AS (SELECT ends.mission, unnest([0, 1, 2, 3]) AS way, unnest([e0, e1, e0, e1]) AS e, unnest([a0, a1, b0, b1]) AS n, te, tn FROM ends JOIN t USING (mission)),
b AS (SELECT mission, arg_min(way, (sqrt(pow(e - te, 2) + pow(n - tn, 2)), way)) AS way FROM c GROUP BY mission) SELECT mission, round(e, 6) AS e, round(n, 6) AS n FROM c JOIN b USING (mission, way)""")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mission.nearest_entry(mission.rectangle_lines(settings(spark, sf_dir)), F.col("lap")[0])
    first = F.col("lines")[0][0]
    return m.select("mission", F.round(first["e"], 6).alias("e"), F.round(first["n"], 6).alias("n"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mission.rectangle_lines(settings(spark, sf_dir))


PROGRAM_SQL = f"""{SETTINGS_SQL}, seg AS (
  SELECT mission, 0 AS seg, k AS pt, e, n, lap_altitude AS alt, lap_speed AS sp, lap_delay AS dl FROM (SELECT mission, laps, 4 AS k, e, n FROM lap WHERE k = 0 UNION ALL SELECT mission, laps, k, e, n FROM lap) JOIN m USING (mission) WHERE m.laps > 0
  UNION ALL SELECT l.mission, 1, 0, e, n1, lap_altitude, transfer_speed, delay FROM lines l WHERE i = 0 AND laps > 0
  UNION ALL SELECT l.mission, 2, 0, e, n1, altitude, transfer_speed, delay FROM lines l WHERE i = 0 AND laps > 0 AND lap_altitude <> altitude
  UNION ALL SELECT l.mission, 3 + i, 0, e, n1, altitude, speed, delay FROM lines l WHERE NOT (i = 0 AND laps > 0)
  UNION ALL SELECT l.mission, 3 + i, 1, e, n2, altitude, speed, delay FROM lines l
  UNION ALL SELECT mission, 1000000, 0, 0, 0, altitude, speed, delay FROM m),
sp AS (SELECT mission, seg, sp, lag(sp) OVER (PARTITION BY mission ORDER BY seg) AS was FROM (SELECT DISTINCT mission, seg, sp FROM seg)),
items AS (
  SELECT mission, -1 AS seg, 0 AS pt, 22 AS command, 0e0 AS p1, 0e0 AS p2, lat, lon, CASE WHEN laps > 0 THEN lap_altitude ELSE altitude END AS alt FROM m
  UNION ALL SELECT mission, -1, 1, 178, 1, CASE WHEN laps > 0 THEN lap_speed ELSE speed END, 0, 0, 0 FROM m
  UNION ALL SELECT sp.mission, seg, -1, 178, 1, sp, 0, 0, 0 FROM sp JOIN m USING (mission) WHERE sp <> coalesce(was, CASE WHEN laps > 0 THEN lap_speed ELSE speed END)
  UNION ALL SELECT mission, seg, pt, 16, dl, 0, lat + n / 111320e0, lon + e / (111320e0 * cos(radians(lat))), seg.alt FROM seg JOIN m USING (mission)
  UNION ALL SELECT mission, 0, 100, 177, 4, laps - 1, 0, 0, 0 FROM m WHERE laps > 1
  UNION ALL SELECT mission, 2000000, 0, 21, 0, 0, lat, lon, 0 FROM m),
prog AS (SELECT *, row_number() OVER (PARTITION BY mission ORDER BY seg, pt) AS row FROM items)"""


@query("M4_waypoint_program", f"WITH {PROGRAM_SQL} SELECT mission, CAST(row AS INTEGER) AS row, command, p1, p2, round(lat, 9) AS lat, round(lon, 9) AS lon, alt FROM prog")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mission.program(planned(spark, sf_dir))
    return p.select("mission", "row", "command", "p1", "p2", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "alt")


@query("M5_jump_replay", f"""WITH {PROGRAM_SQL}, j AS (SELECT mission, row AS "at", p1 AS target, p2 AS again FROM prog WHERE command = 177), f AS (SELECT p.mission, p.row, p.command, unnest(CASE WHEN row BETWEEN target AND "at" THEN range(0, CAST(again AS BIGINT) + 1) WHEN row > "at" THEN [1000000] ELSE [0] END) AS pass FROM prog p LEFT JOIN j USING (mission) WHERE p.command <> 177)
SELECT mission, CAST(row_number() OVER (PARTITION BY mission ORDER BY pass, row) AS INTEGER) AS place, CAST(row AS INTEGER) AS row, command FROM f""")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mission.unrolled(mission.program(planned(spark, sf_dir))).select("mission", "place", "row", "command")


ROUTE_SQL = f"""{SETTINGS_SQL}, pts AS (SELECT mission, 0 AS ord, 0e0 AS e, 0e0 AS n, 'home' AS ph FROM m UNION ALL SELECT mission, 1, e, n, 'lap' FROM lap WHERE k = 0 AND laps > 0
  UNION ALL SELECT mission, 2 + lapno * 4 + CASE WHEN k = 0 THEN 3 ELSE k - 1 END, e, n, 'lap' FROM (SELECT *, unnest(range(0, laps)) AS lapno FROM lap)
  UNION ALL SELECT mission, 1000 + 2 * i, e, n1, 'survey' FROM lines UNION ALL SELECT mission, 1001 + 2 * i, e, n2, 'survey' FROM lines UNION ALL SELECT mission, 1000000, 0, 0, 'survey' FROM m),
legs AS (SELECT mission, ph, lag(ph) OVER w AS was, sqrt(pow(e - lag(e) OVER w, 2) + pow(n - lag(n) OVER w, 2)) AS d FROM pts WINDOW w AS (PARTITION BY mission ORDER BY ord)),
route AS (SELECT mission, d, CASE WHEN ph = 'lap' THEN 'lap' WHEN was = 'lap' THEN 'transfer' ELSE 'survey' END AS phase FROM legs WHERE d IS NOT NULL), sped AS (SELECT r.*, CASE phase WHEN 'lap' THEN lap_speed WHEN 'transfer' THEN transfer_speed ELSE speed END AS sp FROM route r JOIN m USING (mission))"""


@query("A12_route_rollup", f"WITH {ROUTE_SQL} SELECT mission, phase, count(*) AS legs, round(sum(d), 6) AS metres, round(sum(d / sp), 6) AS seconds FROM sped GROUP BY mission, phase")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mission.route(planned(spark, sf_dir)).groupBy("mission", "phase")
    return r.agg(F.count("*").alias("legs"), F.round(F.sum("metres"), 6).alias("metres"), F.round(F.sum(F.col("metres") / F.col("speed")), 6).alias("seconds"))


@query("M10_acceleration_time", f"WITH {ROUTE_SQL} SELECT mission, round(sum(CASE WHEN d < sp * sp / 2 THEN 2 * sqrt(d / 2) ELSE d / sp + sp / 2 END), 6) AS seconds FROM sped GROUP BY mission")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mission.leg_seconds(F.col("metres"), F.col("speed"), F.lit(2.0))
    return mission.route(planned(spark, sf_dir)).groupBy("mission").agg(F.round(F.sum(t), 6).alias("seconds"))


@query("A13_photo_estimate", f"WITH {SETTINGS_SQL} SELECT mission, CAST(sum(floor(2 * hn / 5e0) + 1) AS BIGINT) AS photos FROM lines GROUP BY mission")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = planned(spark, sf_dir).select("mission", F.explode("lines").alias("l"))
    return l.groupBy("mission").agg(F.sum(F.floor(F.abs(F.col("l")[0]["n"] - F.col("l")[1]["n"]) / 5.0) + 1).alias("photos"))


@query("M7_planning_report", f"""WITH {ROUTE_SQL}, {PROGRAM_SQL[len(SETTINGS_SQL) + 2:]}, a AS (SELECT mission, sum(d) AS metres, sum(d) FILTER (phase = 'transfer') AS tm, sum(d / sp) AS moving FROM sped GROUP BY mission), b AS (SELECT mission, sum(p1) AS delays, count(*) AS stops FROM prog WHERE command = 16 GROUP BY mission)
SELECT mission, stops, round(metres, 6) AS metres, round(coalesce(tm, 0), 6) AS transfer_metres, delays + CASE WHEN laps > 1 THEN (laps - 1) * 4 * lap_delay ELSE 0 END AS delay_seconds,
  round(moving + delays + CASE WHEN laps > 1 THEN (laps - 1) * 4 * lap_delay ELSE 0 END + CASE WHEN laps > 0 THEN lap_altitude + abs(lap_altitude - altitude) + altitude ELSE 2 * altitude END / 1.5, 6) AS seconds FROM m JOIN a USING (mission) JOIN b USING (mission)""")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mission.report(planned(spark, sf_dir), F.lit(5.0))
    return r.select("mission", "stops", F.round("metres", 6).alias("metres"), F.round("transfer_metres", 6).alias("transfer_metres"), "delay_seconds", F.round("seconds", 6).alias("seconds"))


@query("M9_whole_delays", "SELECT event_id, CASE WHEN ceil(value) BETWEEN 0 AND 65535 THEN CAST(ceil(value) AS BIGINT) END AS delay FROM events")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.ceil("value")
    return table(spark, sf_dir, "events").select("event_id", F.when(d.between(0, 65535), d).alias("delay"))


@query("K9_waypoint_lines", f"""WITH {PROGRAM_SQL} SELECT mission, CAST(row AS INTEGER) AS row, concat_ws(chr(9), row, 0, 3, command, printf('%.12g', p1), printf('%.12g', CASE WHEN command IN (177, 178) THEN p2 ELSE 0 END), CASE WHEN command = 178 THEN '-1' ELSE '0' END, '0', printf('%.12g', lat), printf('%.12g', lon), printf('%.12g', alt), '1') AS line FROM prog
UNION ALL SELECT mission, 0, concat_ws(chr(9), '0', '1', '0', '16', '0', '0', '0', '0', printf('%.12g', lat), printf('%.12g', lon), '12.5', '1') FROM m""")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = planned(spark, sf_dir)
    return mission.waypoint_text(mission.program(m), m)


@query("S21_waypoint_scan", f"WITH {PROGRAM_SQL} SELECT mission, CAST(row AS DOUBLE) AS seq, CAST(command AS DOUBLE) AS command, p1, CAST(printf('%.12g', lat) AS DOUBLE) AS lat, CAST(printf('%.12g', lon) AS DOUBLE) AS lon, alt FROM prog UNION ALL SELECT mission, 0, 16, 0, lat, lon, 12.5 FROM m")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = planned(spark, sf_dir)
    back = mission.parsed_waypoints(mission.waypoint_text(mission.program(m), m))
    return back.select("mission", "seq", "command", "p1", "lat", "lon", "alt")


@query("K10_fence_lines", "SELECT s_suppkey AS mission, CAST(k + 1 AS INTEGER) AS row, concat_ws(chr(9), k + 1, 0, 0, 5001, 4, 0, 0, 0, printf('%.12g', 37.411e0 + k * 0.001e0), printf('%.12g', -121.99e0 - (s_suppkey % 7) * 0.001e0 - k * 0.0005e0), 0, 1) AS line FROM (SELECT s_suppkey, unnest(range(0, 4)) AS k FROM supplier)")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion fences, one line a corner; the first parameter is the number of corners."""
    k = F.col("k")
    corners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mission"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    lat, lon = F.lit(37.411) + k * F.lit(0.001), F.lit(-121.99) - (F.col("mission") % 7) * F.lit(0.001) - k * F.lit(0.0005)
    line = F.concat_ws("\t", (k + 1).cast("string"), F.lit(f"0\t0\t{mission.FENCE_VERTEX}\t4\t0\t0\t0"), geo.general_number(lat), geo.general_number(lon), F.lit("0\t1"))
    return corners.select("mission", (k + 1).alias("row"), line.alias("line"))


@query("K11_plan_document", f"WITH {PROGRAM_SQL} SELECT mission, count(*) AS items, min(row) AS first_row, max(row) AS last_row FROM prog GROUP BY mission")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan as one JSON document a mission, written and parsed back."""
    items = mission.program(planned(spark, sf_dir))
    docs = items.groupBy("mission").agg(F.to_json(F.struct(F.lit("Plan").alias("fileType"), F.array_sort(F.collect_list(F.struct("row", "command", "p1", "p2", "lat", "lon", "alt"))).alias("items"))).alias("plan"))
    back = docs.select("mission", F.from_json("plan", "struct<fileType:string,items:array<struct<row:int,command:int,p1:double,lat:double,lon:double,alt:double>>>").alias("p"))
    rows = F.transform("p.items", lambda i: i["row"])
    return back.select("mission", F.size("p.items").cast("long").alias("items"), F.array_min(rows).cast("long").alias("first_row"), F.array_max(rows).cast("long").alias("last_row"))


@query("F16_convex_quads", """WITH q AS (SELECT s_suppkey AS k, [{'x': 0e0, 'y': 0e0}, {'x': 100e0 + s_suppkey % 9, 'y': 0e0}, {'x': 100e0 - s_suppkey % 120, 'y': 80e0 - s_suppkey % 95}, {'x': 0e0, 'y': 90e0}] AS p FROM supplier),
t AS (SELECT k, i, p[i + 1] AS a, p[(i + 1) % 4 + 1] AS b, p[(i + 2) % 4 + 1] AS c FROM (SELECT *, unnest(range(0, 4)) AS i FROM q)) SELECT k, bool_and((b.x - a.x) * (c.y - b.y) - (b.y - a.y) * (c.x - b.x) > 1e-6) AS convex FROM t GROUP BY k""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals that turn left at every corner."""
    k = F.col("s_suppkey")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = F.array(corner(F.lit(0), F.lit(0)), corner(F.lit(100) + k % 9, F.lit(0)), corner(F.lit(100) - k % 120, F.lit(80) - k % 95), corner(F.lit(0), F.lit(90)))

    def turn(i: Column) -> Column:
        a, b, c = (F.element_at("p", (i + d) % 4 + 1) for d in (0, 1, 2))
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 1e-6

    return table(spark, sf_dir, "supplier").withColumn("p", p).select(k.alias("k"), F.forall(F.sequence(F.lit(0), F.lit(3)), turn).alias("convex"))
