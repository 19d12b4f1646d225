"""Queries: projections, filters and scalar geometry over captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.functions import geo
from terraweft.plans.catalog import query
from terraweft.session import table
from terraweft.sources.frames import AREA, FENCE, FRAMES_SQL, TELEMETRY_SQL, frames, telemetry

LAT0, LON0 = AREA.lat, AREA.lon


def num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def local_sql(lat: str = "lat", lon: str = "lon", lat0: float = LAT0, lon0: float = LON0) -> tuple[str, str]:
    return f"(({lon} - {num(lon0)}) * 111320e0 * cos(radians({num(lat0)})))", f"(({lat} - {num(lat0)}) * 111320e0)"


EAST, NORTH = local_sql()
LOCAL_SQL = f"{FRAMES_SQL}, placed AS (SELECT *, {EAST} AS east, {NORTH} AS north FROM frames)"


def edges_values(area: geo.Area) -> str:
    return "edges(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({num(a[0])}, {num(a[1])}, {num(b[0])}, {num(b[1])})" for a, b in area.edges) + ")"


CROSSINGS_SQL = "(SELECT count(*) FROM edges WHERE y1 <> y2 AND (y1 > north) <> (y2 > north) AND east < x1 + (north - y1) * (x2 - x1) / (y2 - y1))"
ON_EDGE_SQL = "(SELECT count(*) FROM edges WHERE abs((x2 - x1) * (north - y1) - (y2 - y1) * (east - x1)) <= 1e-7 AND east BETWEEN least(x1, x2) - 1e-8 AND greatest(x1, x2) + 1e-8 AND north BETWEEN least(y1, y2) - 1e-8 AND greatest(y1, y2) + 1e-8)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures with east and north about the area."""
    f = frames(spark, sf_dir)
    east, north = AREA.east_north(F.col("lat"), F.col("lon"))
    return f.withColumn("east", east).withColumn("north", north)


@query("P1_area_projection", f"WITH {LOCAL_SQL} SELECT frame_id, round(east, 6) AS east, round(north, 6) AS north FROM placed")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("frame_id", F.round("east", 6).alias("east"), F.round("north", 6).alias("north"))


_E2, _N2 = local_sql(lat0=37.4109, lon0=-121.9991)


@query("P2_origin_projection", f"WITH {FRAMES_SQL} SELECT frame_id, round({_E2}, 6) AS east, round({_N2}, 6) AS north FROM frames")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.to_local(F.col("lat"), F.col("lon"), 37.4109, -121.9991)
    return frames(spark, sf_dir).select("frame_id", F.round(e, 6).alias("east"), F.round(n, 6).alias("north"))


@query("P3_metres_to_degrees", f"WITH {LOCAL_SQL} SELECT frame_id, round(north / 111320e0 * 1e6, 6) AS dlat_micro, round(east / (111320e0 * cos(radians({num(LAT0)}))) * 1e6, 6) AS dlon_micro FROM placed")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    dlat, dlon = geo.to_degrees(F.col("east"), F.col("north"), LAT0)
    return placed(spark, sf_dir).select("frame_id", F.round(dlat * 1e6, 6).alias("dlat_micro"), F.round(dlon * 1e6, 6).alias("dlon_micro"))


@query("P4_sphere_distance", f"""WITH {FRAMES_SQL} SELECT frame_id, round(sqrt(pow(radians({num(LON0)} - lon) * cos(radians((lat + {num(LAT0)}) / 2)) * 6371000e0, 2) + pow(radians({num(LAT0)} - lat) * 6371000e0, 2)), 6) AS metres FROM frames""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.sphere_distance(F.col("lat"), F.col("lon"), F.lit(LAT0), F.lit(LON0))
    return frames(spark, sf_dir).select("frame_id", F.round(d, 6).alias("metres"))


@query("P5_bounding_box", f"WITH {LOCAL_SQL} SELECT session, round(min(east), 6) AS min_east, round(min(north), 6) AS min_north, round(max(east), 6) AS max_east, round(max(north), 6) AS max_north FROM placed GROUP BY session")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).groupBy("session").agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("east", "north")))


@query("P6_wire_units", f"WITH {TELEMETRY_SQL} SELECT msg_id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, rel_alt_mm / 1e3 AS alt, CASE WHEN hdg_cdeg = 65535 THEN 0e0 ELSE hdg_cdeg / 100e0 END AS heading FROM telemetry WHERE msg_type = 'GLOBAL_POSITION_INT'")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).where("msg_type = 'GLOBAL_POSITION_INT'")
    heading = F.when(F.col("hdg_cdeg") == 65535, F.lit(0.0)).otherwise(F.col("hdg_cdeg") / F.lit(100.0))
    return t.select("msg_id", (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon"), (F.col("rel_alt_mm") / 1e3).alias("alt"), heading.alias("heading"))


_H = (1.02, 0.01, 3.0, -0.02, 0.98, -2.0, 1e-4, -2e-4, 1.0)
_W = f"({num(_H[6])} * east + {num(_H[7])} * north + {num(_H[8])})"


@query("P7_homography", f"WITH {LOCAL_SQL} SELECT frame_id, round(({num(_H[0])} * east + {num(_H[1])} * north + {num(_H[2])}) / {_W}, 6) AS x, round(({num(_H[3])} * east + {num(_H[4])} * north + {num(_H[5])}) / {_W}, 6) AS y FROM placed")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.apply_homography([F.lit(v) for v in _H], F.col("east"), F.col("north"))
    return placed(spark, sf_dir).select("frame_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("P8_pixel_normalisation", f"WITH {FRAMES_SQL} SELECT frame_id, round((frame_id % 1024) * 2 / 1024e0 - 1, 6) AS u, round((frame_id % 720) * 2 / 1024e0 - 720e0 / 1024, 6) AS v FROM frames")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = geo.normal_pixel((F.col("frame_id") % 1024).cast("double"), (F.col("frame_id") % 720).cast("double"), F.lit(1024.0), F.lit(720.0))
    return frames(spark, sf_dir).select("frame_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


HFOV = 114.6


@query("P9_footprint", f"""WITH {FRAMES_SQL}, w AS (SELECT frame_id, 2 * alt * tan(radians(114.6e0) / 2) AS width FROM frames), u AS (SELECT *, least(width * 0.8e0, width * 720 / 1280) AS usable FROM w)
SELECT frame_id, round(width, 6) AS width, round(usable, 6) AS usable, round(usable * (1 - 0.8e0), 6) AS spacing, round(least(5e0, usable * (1 - 0.9e0)), 6) AS capture_interval FROM u""")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width on the ground, the part usable both ways, and the spacing of lines and photographs at given overlaps."""
    w = geo.ground_width(F.col("alt"), HFOV)
    usable = F.least(w * 0.8, w * 720 / 1280)
    return frames(spark, sf_dir).select(
        "frame_id", F.round(w, 6).alias("width"), F.round(usable, 6).alias("usable"), F.round(usable * (1 - 0.8), 6).alias("spacing"), F.round(F.least(F.lit(5.0), usable * (1 - 0.9)), 6).alias("capture_interval"),
    )


@query("P10_equivalent_focal", f"WITH {FRAMES_SQL} SELECT frame_id, CAST(round_even(18e0 / tan(radians(60 + alt) / 2), 0) AS INTEGER) AS focal_35mm FROM frames")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", geo.equivalent_focal(60 + F.col("alt")).alias("focal_35mm"))


@query("P13_feet", f"WITH {FRAMES_SQL} SELECT frame_id, round(alt / 0.3048e0, 2) AS feet, round(round(alt / 0.3048e0, 2) * 0.3048e0, 6) AS metres FROM frames")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = F.round(F.col("alt") / geo.METRES_PER_FOOT, 2)
    return frames(spark, sf_dir).select("frame_id", feet.alias("feet"), F.round(feet * geo.METRES_PER_FOOT, 6).alias("metres"))


@query("F1_in_area", f"WITH {LOCAL_SQL}, {edges_values(AREA)} SELECT frame_id, {CROSSINGS_SQL} % 2 = 1 AS inside FROM placed")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("frame_id", AREA.contains(F.col("lat"), F.col("lon")).alias("inside"))


_FE, _FN = local_sql(lat0=FENCE.lat, lon0=FENCE.lon)
FENCED_SQL = f"{FRAMES_SQL}, placed AS (SELECT *, {_FE} AS east, {_FN} AS north FROM frames), {edges_values(FENCE)}"


@query("F2_in_fence", f"WITH {FENCED_SQL} SELECT frame_id, {ON_EDGE_SQL} > 0 OR {CROSSINGS_SQL} % 2 = 1 AS inside FROM placed")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    e, n = FENCE.east_north(F.col("lat"), F.col("lon"))
    return f.withColumn("east", e).withColumn("north", n).select("frame_id", geo.within_fence(F.col("east"), F.col("north"), FENCE.edges).alias("inside"))


@query("F3_on_segment", f"WITH {FRAMES_SQL} SELECT frame_id, abs(10e0 * (frame_id % 7) - 5e0 * (frame_id % 13)) <= 1e-7 AND (frame_id % 13) BETWEEN -1e-8 AND 10 + 1e-8 AND (frame_id % 7) BETWEEN -1e-8 AND 5 + 1e-8 AS touches FROM frames")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("frame_id") % 13).cast("double"), (F.col("frame_id") % 7).cast("double")
    return frames(spark, sf_dir).select("frame_id", geo.on_segment(x, y, (0.0, 0.0), (10.0, 5.0)).alias("touches"))


@query("F4_armed_height", f"WITH {FRAMES_SQL} SELECT frame_id FROM frames WHERE frame_id % 64 >= 8 AND alt >= 42")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where((F.col("frame_id") % 64 >= 8) & (F.col("alt") >= 42)).select("frame_id")


@query("F5_autopilot_armed", f"WITH {TELEMETRY_SQL} SELECT msg_id, (base_mode & 128) <> 0 AS armed FROM telemetry WHERE msg_type = 'HEARTBEAT' AND src_component = 1")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).where("msg_type = 'HEARTBEAT' and src_component = 1")
    return t.select("msg_id", (F.col("base_mode").bitwiseAND(128) != 0).alias("armed"))


@query("F6_tilt", f"WITH {FRAMES_SQL} SELECT frame_id FROM frames WHERE greatest(abs(roll), abs(pitch)) <= 12")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(F.greatest(F.abs("roll"), F.abs("pitch")) <= 12).select("frame_id")


@query("F7_ground_frames", f"WITH {TELEMETRY_SQL} SELECT msg_id FROM telemetry WHERE rel_alt_mm / 1e3 >= 1.0")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).where(F.col("rel_alt_mm") / 1e3 >= 1.0).select("msg_id")


@query("F8_input_guards", f"WITH {FRAMES_SQL} SELECT session, count(*) AS frames, count(*) >= 6 AND bool_and(isfinite(lat) AND isfinite(lon) AND isfinite(alt) AND alt > 0) AS usable FROM frames GROUP BY session")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.lit(True)
    for c in ("lat", "lon", "alt"):
        fine = fine & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return frames(spark, sf_dir).groupBy("session").agg(F.count("*").alias("frames"), ((F.count("*") >= 6) & F.bool_and(fine & (F.col("alt") > 0))).alias("usable"))


@query("K2_sexagesimal", f"WITH {FRAMES_SQL}, a AS (SELECT frame_id, abs(lon) AS d FROM frames), b AS (SELECT frame_id, d, floor(d) AS dd, floor((d - floor(d)) * 60) AS mm FROM a) SELECT frame_id, CAST(dd AS BIGINT) AS degrees, CAST(mm AS BIGINT) AS minutes, CAST(floor(((d - dd) * 60 - mm) * 60 * 100) AS BIGINT) AS centiseconds FROM b")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", geo.sexagesimal(F.col("lon")).alias("s")).select("frame_id", "s.*")


@query("S10_exif_degrees", f"WITH {FRAMES_SQL} SELECT frame_id, round(CASE WHEN frame_id % 2 = 0 THEN -1 ELSE 1 END * (frame_id % 90 + (frame_id % 60) / 60e0 + (frame_id % 5900) / 100e0 / 3600), 9) AS value, CASE WHEN frame_id % 3 = 1 THEN -alt ELSE alt END AS altitude FROM frames")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("frame_id")
    v = geo.from_sexagesimal((i % 90).cast("double"), (i % 60).cast("double"), (i % 5900) / F.lit(100.0), F.when(i % 2 == 0, "S").otherwise("N"))
    return frames(spark, sf_dir).select("frame_id", F.round(v, 9).alias("value"), F.when(i % 3 == 1, -F.col("alt")).otherwise(F.col("alt")).alias("altitude"))


@query("X3_general_format", f"WITH {LOCAL_SQL} SELECT frame_id, printf('%.12g', lat) AS lat, printf('%.12g', east) AS east, printf('%.6g', north * 1e5) AS north, printf('IMG_%04d', frame_id) AS image FROM placed")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed(spark, sf_dir)
    return p.select("frame_id", geo.general_number(F.col("lat")).alias("lat"), geo.general_number(F.col("east")).alias("east"), geo.general_number(F.col("north") * 1e5, 6).alias("north"), F.format_string("IMG_%04d", "frame_id").alias("image"))


@query("S5_url_rule", r"SELECT page_id, regexp_matches(replace(url, 'http', 'rtsp'), '^rtsp://[^/?#]+/[^?#]+') AS valid FROM pages")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera addresses need the scheme rtsp, a host and a path."""
    url = F.replace("url", F.lit("http"), F.lit("rtsp"))
    path = F.try_parse_url(url, F.lit("PATH"))
    fine = (F.try_parse_url(url, F.lit("PROTOCOL")) == "rtsp") & F.try_parse_url(url, F.lit("HOST")).isNotNull() & (F.length(path) > 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(fine, F.lit(False)).alias("valid"))


@query("S8_topic_names", "SELECT event_id, concat('/world/w', user_id % 5, '/model/', event_type, '/link/camera/image') AS topic FROM events")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.format_string("/world/w%d/model/%s/link/camera/image", F.col("user_id") % 5, "event_type").alias("topic"))


@query("S2_endpoint_rule", "WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.1' ELSE '127.0.0.1' END AS host, event_id * 17 % 80000 AS port FROM events) SELECT event_id, CASE WHEN host IN ('127.0.0.1', 'localhost') AND port BETWEEN 1 AND 65535 THEN concat('udpin:127.0.0.1:', port) END AS endpoint FROM e")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "10.0.0.1").otherwise("127.0.0.1").alias("host"), (F.col("event_id") * 17 % 80000).alias("port"))
    fine = F.col("host").isin("127.0.0.1", "localhost") & F.col("port").between(1, 65535)
    return e.select("event_id", F.when(fine, F.concat(F.lit("udpin:127.0.0.1:"), F.col("port").cast("string"))).alias("endpoint"))


@query("S3_serial_rule", "SELECT event_id, CASE WHEN trim(d) <> '' AND baud > 0 THEN concat(trim(d), '@', baud) END AS endpoint FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '  ' ELSE concat(' /dev/ttyUSB', event_id % 9, ' ') END AS d, event_id % 5 * 9600 AS baud FROM events)")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.trim(F.when(i % 4 == 0, "  ").otherwise(F.format_string(" /dev/ttyUSB%d ", i % 9))).alias("d"), (i % 5 * 9600).alias("baud"))
    return e.select("event_id", F.when((F.col("d") != "") & (F.col("baud") > 0), F.concat("d", F.lit("@"), F.col("baud").cast("string"))).alias("endpoint"))


@query("S20_precedence", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END, 5e0) AS setting FROM events")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command line before configuration before default."""
    i = F.col("event_id")
    given = F.when(i % 3 == 0, F.col("value"))
    configured = F.when(i % 2 == 0, F.get_json_object("props", "$.k").cast("double"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(given, configured, F.lit(5.0)).alias("setting"))


@query("S15_altitude_fallback", f"WITH {TELEMETRY_SQL} SELECT msg_id, coalesce(CASE WHEN msg_id % 2 = 0 THEN rel_alt_mm + 12000 END, rel_alt_mm) / 1e3 AS home_altitude FROM telemetry WHERE msg_type = 'GLOBAL_POSITION_INT'")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = F.when(F.col("msg_id") % 2 == 0, F.col("rel_alt_mm") + 12000)
    return telemetry(spark, sf_dir).where("msg_type = 'GLOBAL_POSITION_INT'").select("msg_id", (F.coalesce(home, "rel_alt_mm") / 1e3).alias("home_altitude"))


@query("X6_content_signature", "SELECT page_id, sha256(concat('[\"', url, '\",', octet_length(encode(coalesce(html, ''))), ',\"v1\"]')) AS signature FROM pages")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache key: the hash of a canonical list of what the result depends on."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat(F.lit('["'), "url", F.lit('",'), size.cast("string"), F.lit(',"v1"]')), 256).alias("signature"))


@query("X7_session_names", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M%S') AS session_name, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS gap_us FROM events")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraweft.operators.sequence import in_order

    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd_HHmmss").alias("session_name"), (us - F.lag(us).over(in_order("user_id", by="event_id"))).alias("gap_us"))
