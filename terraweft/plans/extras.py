"""Queries: the smaller operators of sequences, routes, sets, grids and exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.functions import geo
from terraweft.operators import raster
from terraweft.plans.capture import CLOSE_SQL, close_pairs
from terraweft.plans.catalog import query
from terraweft.plans.geometry import LOCAL_SQL, num, placed
from terraweft.plans.rasters import CELL, CELLS_SQL, COLUMNS, NORTH, ROWS, WEST, cells
from terraweft.session import settle, table
from terraweft.sources.frames import FRAMES_SQL, TELEMETRY_SQL, frames, telemetry


@query("W6_neighbour_ranks", f"WITH {CLOSE_SQL} SELECT session, i, j, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 3")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(spark, sf_dir, k=3).select("session", "i", "j", "rank")


@query("W8_cyclic_edges", f"WITH {FRAMES_SQL}, n AS (SELECT session, list(frame_id ORDER BY frame_id) AS ids FROM frames GROUP BY session), k AS (SELECT *, unnest(range(0, len(ids))) AS k FROM n) SELECT session, ids[k + 1] AS a, ids[(k + 1) % len(ids) + 1] AS b, ids[(k + 2) % len(ids) + 1] AS c FROM k")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each corner with the next two around the ring."""
    w = Window.partitionBy("session").orderBy("frame_id")
    every = Window.partitionBy("session").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = frames(spark, sf_dir)
    first, second = F.first("frame_id").over(every), F.nth_value("frame_id", 2).over(every)
    b = F.coalesce(F.lead("frame_id").over(w), first)
    c = F.coalesce(F.lead("frame_id", 2).over(w), F.when(F.lead("frame_id").over(w).isNull(), F.coalesce(second, first)).otherwise(first))
    return f.select("session", F.col("frame_id").alias("a"), b.alias("b"), c.alias("c"))


@query("W9_alternating_order", f"WITH {FRAMES_SQL}, g AS (SELECT session, frame_id, (seq - 1) // 10 AS line, (seq - 1) % 10 AS k FROM frames) SELECT session, frame_id, row_number() OVER (PARTITION BY session ORDER BY line, CASE WHEN line % 2 = 0 THEN k ELSE -k END) AS place FROM g")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, k = F.floor((F.col("seq") - 1) / 10), (F.col("seq") - 1) % 10
    order = Window.partitionBy("session").orderBy(line, F.when(line % 2 == 0, k).otherwise(-k))
    return frames(spark, sf_dir).select("session", "frame_id", F.row_number().over(order).cast("long").alias("place"))


@query("W10_item_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS item FROM orders")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(order).cast("long").alias("item"))


@query("L2_sorted_pairs", f"WITH {CLOSE_SQL}, p AS (SELECT DISTINCT session, least(i, j) AS i, greatest(i, j) AS j FROM near WHERE rank <= 25) SELECT session, i, j, row_number() OVER (PARTITION BY session ORDER BY i, j) AS place FROM p")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraweft.operators.proximity import unordered

    p = unordered(close_pairs(spark, sf_dir), "session")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("i", "j")).cast("long"))


@query("U4_union_of_groups", "SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600)")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    large = l.groupBy("l_suppkey").count().where("count >= 600").select("l_suppkey")
    return l.join(large, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("node")).distinct()


@query("X1_scalar_maths", f"WITH {LOCAL_SQL} SELECT frame_id, round(sin(radians(alt)), 9) AS s, round(tan(radians(alt)), 9) AS t, round(acos(greatest(-1, least(1, east / 200))), 6) AS a, round(exp(-abs(north) / 100), 9) AS e, round(ln(alt), 9) AS l, CAST(ceil(east) AS BIGINT) AS c, round_even(alt / 4, 0) AS h FROM placed")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return placed(spark, sf_dir).select(
        "frame_id", F.round(F.sin(F.radians("alt")), 9).alias("s"), F.round(F.tan(F.radians("alt")), 9).alias("t"), F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("east") / 200))), 6).alias("a"),
        F.round(F.exp(-F.abs("north") / 100), 9).alias("e"), F.round(F.log("alt"), 9).alias("l"), F.ceil("east").alias("c"), F.bround(c("alt") / 4, 0).alias("h"),
    )


@query("X8_mode_bits", f"WITH {TELEMETRY_SQL} SELECT msg_id, base_mode & 128 AS armed_bit, (base_mode >> 3) & 1 AS stream_bit, base_mode | 1 AS custom FROM telemetry WHERE msg_type = 'HEARTBEAT'")
def x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("base_mode").cast("long")
    return telemetry(spark, sf_dir).where("msg_type = 'HEARTBEAT'").select("msg_id", m.bitwiseAND(128).alias("armed_bit"), F.shiftright(m, 3).bitwiseAND(1).alias("stream_bit"), m.bitwiseOR(1).alias("custom"))


@query("F17_supported_views", "WITH v AS (SELECT l_suppkey AS view, l_partkey % 50 AS other, sum(l_extendedprice) / sum(l_quantity * 1500) AS ratio, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT view, count(*) AS supports FROM v WHERE n >= 2 AND ratio > 0.65 AND ratio < 1.4 GROUP BY view HAVING count(*) >= 2")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with two supporting edges at least whose scales agree."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("view"), (F.col("l_partkey") % 50).alias("other")).agg((F.sum("l_extendedprice") / F.sum(F.col("l_quantity") * 1500)).alias("ratio"), F.count("*").alias("n"))
    return e.where("n >= 2 and ratio > 0.65 and ratio < 1.4").groupBy("view").agg(F.count("*").alias("supports")).where("supports >= 2")


@query("F9_canvas_limit", f"WITH {LOCAL_SQL}, b AS (SELECT session, ceil((max(east) - min(east) + 10) * 40) * ceil((max(north) - min(north) + 10) * 40) AS cells FROM placed GROUP BY session) SELECT session, CAST(cells AS BIGINT) AS cells, cells <= 50000000 AS fits FROM b")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map sizes at forty cells a metre, and whether they are within fifty million."""
    side = lambda c: F.ceil((F.max(c) - F.min(c) + 10) * 40)
    b = placed(spark, sf_dir).groupBy("session").agg((side("east") * side("north")).alias("cells"))
    return b.select("session", "cells", (F.col("cells") <= 50_000_000).alias("fits"))


@query("R9_canvas_box", f"WITH {LOCAL_SQL}, r AS (SELECT frame_id, greatest(0, floor((east - alt * 0.6e0 - {num(WEST)}) / 10)) AS c0, least({COLUMNS - 1}, floor((east + alt * 0.6e0 - {num(WEST)}) / 10)) AS c1, greatest(0, floor(({num(NORTH)} - north - alt * 0.6e0) / 10)) AS r0, least({ROWS - 1}, floor(({num(NORTH)} - north + alt * 0.6e0) / 10)) AS r1 FROM placed) SELECT frame_id, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1 FROM r WHERE c0 <= c1 AND r0 <= r1")
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of map cells of each footprint, cut to the map."""
    reach = F.col("alt") * 0.6

    e, n = F.col("east"), F.col("north")
    raw = {"c0": (e - reach - WEST, None), "c1": (e + reach - WEST, COLUMNS - 1), "r0": (NORTH - n - reach, None), "r1": (NORTH - n + reach, ROWS - 1)}

    box = placed(spark, sf_dir).select("frame_id", *((F.greatest(F.lit(0), F.floor(x / CELL)) if hi is None else F.least(F.lit(hi), F.floor(x / CELL))).alias(k) for k, (x, hi) in raw.items()))
    return box.where("c0 <= c1 and r0 <= r1")


@query("R5_footprint_scores", CELLS_SQL.join(("WITH ", f" SELECT session, frame_id, count(*) AS cells, round(sum(exp(-2 * (1 / weight - 1))), 5) AS score FROM cells GROUP BY session, frame_id")))
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the map each capture sees, weighed by how centrally."""
    score = F.exp(-2 * (1 / F.col("weight") - 1))
    return cells(spark, sf_dir).groupBy("session", "frame_id").agg(F.count("*").alias("cells"), F.round(F.sum(score), 5).alias("score"))


def seen_twice(c: DataFrame) -> DataFrame:
    """The cells (dealt by session) that another capture of the session sees too; a join would shuffle them again."""
    return c.withColumn("views", F.count("*").over(Window.partitionBy("session", "row", "col"))).where("views >= 2 and session is not null").drop("views")


@query("R7_supported_regions", f"WITH {CELLS_SQL}, s AS (SELECT a.session, a.frame_id, count(*) AS points, min(a.row) AS r0, max(a.row) AS r1, min(a.col) AS c0, max(a.col) AS c1 FROM cells a JOIN (SELECT session, row, col FROM cells GROUP BY session, row, col HAVING count(*) >= 2) b USING (session, row, col) GROUP BY a.session, a.frame_id) SELECT session, frame_id, points, (r1 - r0 + 1) * (c1 - c0 + 1) AS box FROM s WHERE points >= 12")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each capture the cells that another one sees too, twelve at least, and their box."""
    s = seen_twice(cells(spark, sf_dir).select("session", "frame_id", "row", "col")).groupBy("session", "frame_id").agg(F.count("*").alias("points"), *(f(k).alias(f"{k}_{n}") for k in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))))
    return s.where("points >= 12").select("session", "frame_id", "points", ((F.col("row_hi") - F.col("row_lo") + 1) * (F.col("col_hi") - F.col("col_lo") + 1)).alias("box"))


@query("R8_whole_views", f"""WITH {CELLS_SQL}, v AS (SELECT session, row, col FROM cells GROUP BY 1, 2, 3 HAVING count(*) >= 2), pt AS (SELECT session, frame_id, alt, (col + 0.5e0) * 10 AS x, (row + 0.5e0) * 10 AS y FROM cells JOIN v USING (session, row, col)), big AS (SELECT session, frame_id, max(alt) AS alt FROM pt GROUP BY 1, 2 HAVING count(*) >= 12),
o AS (SELECT a.session, a.frame_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) AS side, (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) AS beyond FROM big g JOIN pt a USING (session, frame_id) JOIN pt b ON b.session = a.session AND b.frame_id = a.frame_id AND (b.x <> a.x OR b.y <> a.y) JOIN pt p ON p.session = a.session AND p.frame_id = a.frame_id),
e AS (SELECT session, frame_id, ax, ay, bx, "by" FROM o GROUP BY ALL HAVING bool_and(side > 1e-6 OR (abs(side) <= 1e-6 AND beyond <= 1e-6))), h AS (SELECT session, frame_id, sum(ax * "by" - bx * ay) / 2 AS area FROM e GROUP BY 1, 2)
SELECT session, frame_id, round(area, 6) AS area FROM h JOIN big USING (session, frame_id) WHERE area > 0.1 AND area >= 0.3 * pow(alt * 1.2e0, 2)""")
def r8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose support is broad: the hull of the cell centres that another capture of the session sees too, twelve at
    least, is larger than 0.1 square metres and three tenths of the ground in the frame."""
    c = cells(spark, sf_dir).select("session", "frame_id", "alt", "row", "col")
    points = seen_twice(c)
    runs = points.groupBy("session", "frame_id", "row").agg(F.count("*").alias("points"), F.max("alt").alias("alt"), F.min("col").alias("first"), F.max("col").alias("last"))
    support = runs.groupBy("session", "frame_id").agg(F.sum("points").alias("points"), F.max("alt").alias("alt"), F.array_sort(F.collect_list(F.struct("row", "first", "last"))).alias("runs")).where("points >= 12")
    hulls = support.withColumn("area", raster.run_hull_area(F.col("runs")) * (CELL * CELL))
    frame = F.pow(F.col("alt") * 1.2, F.lit(2))
    return hulls.where((F.col("area") > 0.1) & (F.col("area") >= 0.3 * frame)).select("session", "frame_id", F.round("area", 6).alias("area"))


@query("R14_border_blend", f"WITH {CELLS_SQL}, b AS (SELECT session, row, col, arg_max(frame_id, (weight, -frame_id)) AS f FROM cells GROUP BY session, row, col), n AS (SELECT b.*, o.f AS g FROM b LEFT JOIN b o ON o.session = b.session AND abs(o.row - b.row) + abs(o.col - b.col) = 1) SELECT session, row, col, round(count(g) FILTER (g <> f) / 4e0 * 0.5e0, 6) AS alpha FROM n GROUP BY session, row, col")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each cell blends into its neighbours: half the share of its four sides that another capture owns."""
    own = settle(raster.best_view(cells(spark, sf_dir), ["session", "row", "col"], "frame_id").select("session", "row", "col", "frame_id"), "owners")
    sides = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    around = own.select("session", "row", "col", F.col("frame_id").alias("f"), sides.alias("s")).select("session", "row", "col", "f", (F.col("row") + F.col("s.dr")).alias("r2"), (F.col("col") + F.col("s.dc")).alias("c2"))
    other = own.select("session", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("frame_id").alias("g"))
    return around.join(other, ["session", "r2", "c2"], "left").groupBy("session", "row", "col").agg(F.round(F.count_if(F.col("g") != F.col("f")) / 4.0 * 0.5, 6).alias("alpha"))


@query("K13_exchange_round_trip", f"WITH {LOCAL_SQL} SELECT session, count(*) AS frames, round(sum(east), 4) AS east FROM placed GROUP BY session")
def k13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a solver takes is handed over as rows of Parquet in the shared folder."""
    held = settle(placed(spark, sf_dir).select("session", "seq", "east", "north"), "exchange")
    return held.groupBy("session").agg(F.count("*").alias("frames"), F.round(F.sum("east"), 4).alias("east"))


@query("K7_map_report", f"WITH {CELLS_SQL}, b AS (SELECT session, row, col, arg_max(frame_id, (weight, -frame_id)) AS f, max(weight) AS w FROM cells GROUP BY session, row, col) SELECT session, count(*) AS covered, count(DISTINCT f) AS textured, round(quantile_cont(w, 0.5), 9) AS median_weight, round(count(*) / {ROWS * COLUMNS}e0, 9) AS coverage FROM b GROUP BY session")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's report: covered cells, captures used, how central they look, and coverage."""
    own = raster.best_view(cells(spark, sf_dir), ["session", "row", "col"], "frame_id")
    return own.groupBy("session").agg(F.count("*").alias("covered"), F.countDistinct("frame_id").alias("textured"), F.round(F.percentile("weight", 0.5), 9).alias("median_weight"), F.round(F.count("*") / float(ROWS * COLUMNS), 9).alias("coverage"))


@query("K8_session_timing", "SELECT user_id AS session, min(ts) AS started, max(ts) AS ended, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events GROUP BY user_id")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = lambda c: F.unix_micros(c.cast("timestamp_ltz"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), (us(F.max("ts")) - us(F.min("ts"))).alias("duration_us"))


@query("K15_job_lines", f"WITH {FRAMES_SQL} SELECT frame_id, printf('IMG_%04d.jpg', frame_id) AS path, lat, lon, alt FROM frames")
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching jobs written as JSON lines in the shared folder and read back."""
    import uuid

    from terraweft.session import shared_folder
    from terraweft.sources import sinks

    f = frames(spark, sf_dir)
    path = f"{shared_folder(spark)}/terraweft/jobs-{uuid.uuid4().hex}"
    sinks.job_lines(f.select(F.format_string("IMG_%04d.jpg", "frame_id").alias("path"), "lat", "lon", "alt"), path)
    back = sinks.read_job_lines(spark.read.text(path))
    return back.select(F.regexp_extract("path", r"IMG_(\d+)", 1).cast("long").alias("frame_id"), "path", "lat", "lon", "alt")


@query("L7_backlog", f"WITH {CLOSE_SQL}, p AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM near WHERE rank <= 25), t AS (SELECT i, j FROM p WHERE (i + j) % 3 <> 0), o AS (SELECT *, CASE WHEN j = (SELECT max(j) FROM t) THEN 0 ELSE 1 END AS late FROM t) SELECT i, j FROM o ORDER BY late, i, j LIMIT 200")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next two hundred jobs of a backlog (the feature is the limit): those of the newest capture first."""
    from terraweft.operators.proximity import unordered
    from terraweft.streaming.live_map import backlog

    jobs = settle(unordered(close_pairs(spark, sf_dir), "session").select("i", "j").distinct(), "jobs")
    return backlog(jobs, jobs.where((F.col("i") + F.col("j")) % 3 == 0), 200)


@query("M8_profile_defaults", "SELECT c_custkey AS mission, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 12e0 END, 10e0) AS lap_speed, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 40e0 END, 30.48e0) AS altitude, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 0.7e0 END, 0.8e0) AS sidelap FROM customer")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's defaults hold where a mission does not say otherwise."""
    k = F.col("c_custkey")
    given = {"lap_speed": F.when(k % 2 == 0, 12.0), "altitude": F.when(k % 3 == 0, 40.0), "sidelap": F.when(k % 5 == 0, 0.7)}
    defaults = {"lap_speed": 10.0, "altitude": 100 * geo.METRES_PER_FOOT, "sidelap": 0.8}
    return table(spark, sf_dir, "customer").select(k.alias("mission"), *(F.coalesce(v, F.lit(round(defaults[n], 6))).alias(n) for n, v in given.items()))


@query("S1_telemetry_scan", f"WITH {TELEMETRY_SQL} SELECT session, msg_type, count(*) AS messages, min(msg_id) AS first_msg, max(msg_id) AS last_msg FROM telemetry GROUP BY session, msg_type")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).groupBy("session", "msg_type")
    return t.agg(F.count("*").alias("messages"), F.min("msg_id").alias("first_msg"), F.max("msg_id").alias("last_msg"))


@query("T5_map_in_batches", f"WITH {CELLS_SQL} SELECT row, col, arg_max(frame_id, (weight, -frame_id)) AS frame_id FROM cells GROUP BY row, col")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map merged from three batches of captures in order is the map of all of them (weights have nine places, the
    hysteresis is below them)."""
    from terraweft.streaming.live_map import merged

    last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    batch = sum((F.col("frame_id") > last * k // 3).cast("int") for k in (1, 2))
    # What a batch shows of a cell is its best view there: only that is kept, and no cell is written. Its weight and then its
    # capture are plain numbers, which Spark hashes; a structure of both would have every cell sorted.
    seen = cells(spark, sf_dir).select(batch.alias("batch"), "row", "col", "frame_id", "weight")
    top = settle(seen.groupBy("batch", "row", "col").agg(F.max("weight").alias("weight")), "weights")
    best = settle(seen.join(top, ["batch", "row", "col", "weight"]).groupBy("batch", "row", "col", "weight").agg(F.min("frame_id").alias("frame_id")), "batches")
    held = None
    for k in range(3):
        held = settle(merged(held, best.where(F.col("batch") == k), hysteresis=1e-12), "map")
    return held.select("row", "col", "frame_id")
