"""Analytic truths, replays and invalid inputs."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraweft.functions import geo
from terraweft.operators import fit, graph, mission, projective, proximity, raster, sequence, spanning
from terraweft.sources import config, exif, frames, sinks
from terraweft.streaming import capture, live_map


def test_area_needs_three_corners():
    with pytest.raises(ValueError):
        geo.Area([(1.0, 2.0), (2.0, 3.0)])


@pytest.mark.parametrize("value", [0.0, 1.0, -2.5, 1e-5, -123456.789, 1e12, 123456789012345.0, 0.1 + 0.2, 37.4110005, 1e300, 2.2250738585072014e-308])
def test_general_number_is_printf(spark, value):
    got = spark.createDataFrame([(value,)], "x double").select(geo.general_number(F.col("x"))).first()[0]
    assert got == f"{value:.12g}"


def test_border_belongs_to_a_fence_only(spark):
    edges = geo.Area([(0.0, 0.0), (0.0, 1e-4), (1e-4, 1e-4), (1e-4, 0.0)]).edges
    (x1, y1), (x2, y2) = edges[0]
    point = spark.createDataFrame([((x1 + x2) / 2, (y1 + y2) / 2)], "x double, y double")
    assert point.select(geo.within_fence(F.col("x"), F.col("y"), edges)).first()[0]


def test_components_of_a_long_path(spark):
    n = 300
    pairs = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spanning_forest_is_kruskals(spark):
    rng = random.Random(3)
    edges = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(90)) if a < b})
    rows = [(a, b, rng.randrange(6)) for a, b in edges]
    parent = list(range(25))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, s))
    got = spanning.spanning_forest(spark.createDataFrame(rows, "src long, dst long, score long")).collect()
    assert {tuple(r) for r in got} == want


def test_depths_follow_the_tree(spark):
    tree = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4)], "src long, dst long")
    assert {r.node: (r.depth, r.parent) for r in spanning.depths(tree, 0).collect()} == {0: (0, None), 1: (1, 0), 2: (2, 1), 3: (3, 2), 4: (1, 0)}


def test_nearest_ties_go_to_the_smaller_node(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, -1.0, 0.0), (1, 4, 0.0, 0.0), (2, 5, 0.0, 0.0)], "g long, id long, e double, n double")
    got = {(r.i, r.j) for r in proximity.nearest_within(p, "g", "id", "e", "n", 10.0, 2).where("i = 1").collect()}
    assert got == {(1, 4), (1, 2)}


def test_trigger_keeps_by_the_last_kept_row(spark):
    p = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(10)], "s long, k long, e double, n double")
    assert [r.k for r in sequence.distance_trigger(p, "s", "k", "e", "n", 3.0).orderBy("k").collect()] == [0, 3, 6, 9]


def test_resample_repeats_where_rows_are_few(spark):
    got = spark.createDataFrame([([7, 8, 9],)], "a array<int>").select(sequence.resampled(F.col("a"), 40)).first()[0]
    assert len(got) == 40 and got == [[7, 8, 9][int(x)] for x in np.linspace(0, 2, 40)]


def _settings(spark, **change):
    row = dict(mission=1, width=147.0, height=262.0, altitude=45.0, lap_altitude=45.0, speed=3.0, lap_speed=3.0, transfer_speed=3.0, spacing=15.8, laps=0, delay=3.0, lap_delay=3.0, lat=47.3977, lon=8.5455, home_alt=500.0) | change
    df = spark.createDataFrame(pd.DataFrame([row])).withColumn("lap", F.array(*(mission.point(F.lit(a), F.lit(b)) for a, b in ((10.0, 20.0), (60.0, 25.0), (70.0, 80.0)))))
    return mission.rectangle_lines(df)


def test_eleven_lines(spark):
    assert len(_settings(spark).first().lines) == 11


@pytest.mark.parametrize("laps", [0, 1, 3])
def test_replayed_program_is_the_route(spark, laps):
    m = _settings(spark, laps=laps, lap_altitude=60.0, lap_speed=5.0, transfer_speed=4.0)
    flown = mission.unrolled(mission.program(m)).where(F.col("command") == mission.WAYPOINT).orderBy("place").collect()
    at = [((r.lon - 8.5455) * geo.METRES_PER_DEGREE * math.cos(math.radians(47.3977)), (r.lat - 47.3977) * geo.METRES_PER_DEGREE) for r in flown]
    walked = sum(math.dist(a, b) for a, b in zip([(0.0, 0.0), *at], at))
    assert walked == pytest.approx(mission.report(m, F.lit(5.0)).first().metres, abs=1e-5)


def test_short_legs_never_reach_their_speed(spark):
    t = spark.createDataFrame([(1.0,), (100.0,)], "d double").select(mission.leg_seconds(F.col("d"), F.lit(5.0), F.lit(2.0)).alias("t")).collect()
    assert [r.t for r in t] == pytest.approx([2 * math.sqrt(0.5), 100 / 5 + 5 / 2])


def test_similarity_recovers_its_truth(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=200), rng.normal(size=200)
    x, y = 2 * u - 0.5 * v + 3 + rng.normal(scale=0.01, size=200), 0.5 * u + 2 * v - 1 + rng.normal(scale=0.01, size=200)
    x[:40] += 50
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "k": range(200), "u": u, "v": v, "x": x, "y": y}))
    for f in (fit.robust_similarity(df, ["g"], 0.05, passes=12).first(), fit.anchored(df, "g", "k", 0.3, 6).first()):
        assert (f.p, f.q, f.tx, f.ty) == pytest.approx((2, 0.5, 3, -1), abs=0.15)
    clean = fit.affine(df.where("k >= 40"), ["g"]).first()
    assert (clean.a, clean.b, clean.c) == pytest.approx((2, -0.5, 3), abs=0.02)


def test_noise_is_seeded(spark):
    p = spark.createDataFrame([(1, r, c, 100.0) for r in range(8) for c in range(8)], "image long, row int, col int, value double")
    a, b, c = (sorted(map(tuple, raster.noisy(p, "image", s, 5.0).collect())) for s in (1, 1, 2))
    assert a == b != c and abs(np.mean([x[3] for x in a]) - 100) < 4


def test_comments_in_strings_stay(spark):
    text = '{"a": "http://x /* y */", // no\n"b": 1 /* " */ }'
    got = spark.createDataFrame([(text,)], "t string").select(config.without_comments(F.col("t"))).first()[0]
    assert json.loads(got) == {"a": "http://x /* y */", "b": 1}


@pytest.mark.parametrize(("text", "want"), [
    ("", ""), ("// all", " "), ("a//b\r\nc", "a \r\nc"), ("a/*b*//c", "a /c"), ("/*/ x */y", " y"), ("/***/1", " 1"), ("1 /* open // \n", "1 /* open // \n"),
    (r'"\\" // x', r'"\\"  '), (r'"\" // in" // x', r'"\" // in"  '), (r'"\n/*"/* " */', r'"\n/*" '), ("/ * x */ 1 / 2", "/ * x */ 1 / 2"), ("// a \\\n1", " \n1"), (r"/* \*/1", " 1"), (None, None),
])
def test_scanner_of_comments(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(config.without_comments(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ('{"lap_speed_m_s": 3}', None), ('{"lap_speed_m_s": 0}', "not positive"), ('{"lap_delay_s": 0}', None), ('{"lap_delay_s": -1}', "not positive"), ('{"lap_speed_m_s": null}', "not positive"),
    ('{"lap_speed": 3}', "unknown field"), ('{"lap_altitude_m": 1, "lap_altitude_ft": 3}', "both units"), ('[1]', "no object"), ('{"laps": 1, "laps": 2}', "repeated field"),
])
def test_settings_rules(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(config.problem(F.col("t"))).first()[0] == want


def test_geotags_round_trip(spark):
    f = spark.createDataFrame([(1, exif.tagged_jpeg(-36.5, 8.25, -3.5, 271.5)), (2, b"\xff\xd8\xff\xd9"), (3, b""), (4, None)], "k long, content binary")
    got = {r.k: r for r in exif.positions(f, "k").collect()}
    assert (got[1].lat, got[1].lon, got[1].alt, got[1].heading) == pytest.approx((-36.5, 8.25, -3.5, 271.5), abs=1e-5)
    assert all(got[k].lat is None and got[k].heading is None for k in (2, 3, 4))


def test_session_scan_orders_and_leaves_out_the_ground(spark, tmp_path):
    for name, alt in (("b.jpg", 30.0), ("a.jpg", 20.0), ("c.jpg", 0.5)):
        (tmp_path / name).write_bytes(exif.tagged_jpeg(1.0, 2.0, alt, 0.0))
    assert [(r.seq, r.alt) for r in exif.session_scan(spark, str(tmp_path)).orderBy("seq").collect()] == [(1, 20.0), (2, 30.0)]


def test_job_lines_round_trip(spark, tmp_path):
    sinks.job_lines(spark.createDataFrame([("x.jpg", 1.5, 2.5, 3.5)], "path string, lat double, lon double, alt double"), str(tmp_path / "j"))
    assert [tuple(r) for r in sinks.read_job_lines(spark.read.text(str(tmp_path / "j"))).collect()] == [("x.jpg", 1.5, 2.5, 3.5)]


def test_waypoint_files(spark, tmp_path):
    m = _settings(spark)
    sinks.waypoint_files(mission.waypoint_text(mission.program(m), m), str(tmp_path / "w"))
    text = next((tmp_path / "w" / "mission=1").glob("*.txt")).read_text().splitlines()
    assert text[0] == "QGC WPL 110" and all(len(x.split("\t")) == 12 for x in text[1:]) and text[1].split("\t")[3] == "16"


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    t = frames.telemetry(spark, "/root/testdata/sf0.001").orderBy("msg_id")
    rules = capture.Rules(frames.AREA)
    want = sorted(map(repr, capture.captured(t, rules).collect()))
    parts = [t.where(F.col("msg_id") < 400), t.where(F.col("msg_id") >= 400)]
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(capture.TELEMETRY_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = capture.captured_stream(stream, rules).writeStream.format("memory").queryName("captured").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(repr, spark.table("captured").collect())) == want


def test_live_map_keeps_the_better_view_and_goes_on_after_a_restart(spark, tmp_path):
    seen = lambda *rows: spark.createDataFrame(rows, "row int, col int, frame_id long, weight double")
    begun = lambda: live_map.LiveMap(str(tmp_path / "map"))
    assert begun().cells(spark) is None
    begun()(seen((0, 0, 1, 0.5), (0, 1, 1, 0.9)), 0)
    begun()(seen((0, 0, 2, 0.5 + 1e-8), (0, 1, 2, 0.95), (1, 1, 2, 0.1)), 1)
    begun()(seen((0, 0, 3, 1.0)), 1)
    assert {(r.row, r.col): r.frame_id for r in begun().cells(spark).collect()} == {(0, 0): 1, (0, 1): 2, (1, 1): 2}
    (tmp_path / "map" / "batch-2").mkdir()  # a batch whose writer was lost
    begun()(seen((1, 0, 4, 0.3)), 2)
    begun()(seen((1, 0, 5, 0.4)), 3)
    assert begun().batches(spark) == [2, 3]
    assert {(r.row, r.col): r.frame_id for r in begun().cells(spark).collect()} == {(0, 0): 1, (0, 1): 2, (1, 1): 2, (1, 0): 5}


def test_live_map_under_a_stream(spark, tmp_path):
    kinds = "row int, col int, frame_id long, weight double"
    for k in range(3):
        spark.createDataFrame([(0, k % 2, k, 0.1 * k), (1, 1, k, 0.9 - 0.1 * k)], kinds).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))
    m = live_map.LiveMap(str(tmp_path / "map"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    q = stream.writeStream.foreachBatch(m).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.row, r.col): r.frame_id for r in m.cells(spark).collect()} == {(0, 0): 2, (0, 1): 1, (1, 1): 0}


def test_backlog_serves_the_newest_first(spark):
    jobs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "i long, j long")
    done = spark.createDataFrame([(1, 2)], "i long, j long")
    assert [tuple(r) for r in live_map.backlog(jobs, done, 2).collect()] == [(1, 4), (1, 3)]


TRUE_H = np.array([[1.1, 0.05, 0.3], [-0.04, 0.95, -0.2], [0.02, -0.03, 1.0]])


def mapped(h, p):
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def test_consensus_homography_recovers_its_truth(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(-1, 1, (120, 2))
    q = mapped(TRUE_H, p)
    q[:40] += rng.uniform(1, 2, (40, 2))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "k": range(120), "u": p[:, 0], "v": p[:, 1], "x": q[:, 0], "y": q[:, 1]}))
    got = projective.consensus(df, "g", "k", 1e-6, samples=60).first()
    assert got.inliers == 80 and np.allclose(np.array(got.h).reshape(3, 3), TRUE_H, atol=1e-6)


def test_adjustment_brings_matches_together(spark):
    rng = np.random.default_rng(11)
    truth = {0: np.eye(3)} | {k: np.eye(3) + rng.normal(scale=0.03, size=(3, 3)) * np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0]]) for k in (1, 2, 3)}
    rows = []
    for i in range(4):
        for j in range(i):
            ground = rng.uniform(-1, 1, (25, 2))
            a, b = (mapped(np.linalg.inv(truth[k]), ground) for k in (i, j))
            rows += [(i, j, *map(float, (*x, *y))) for x, y in zip(a, b)]
    matches = spark.createDataFrame(rows, "i long, j long, u double, v double, x double, y double")
    start = spark.createDataFrame([(k, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for k in range(4)], "view long, h array<double>")
    gap = lambda poses: projective.residuals(matches, poses).agg(F.percentile(F.hypot("rx", "ry"), 0.5)).first()[0]
    after = projective.adjusted(matches, start, root=0, rounds=10, damping=0.7)
    assert gap(after) < 0.1 * gap(start)
    assert {r.view: list(r.h) for r in after.collect()}[0] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_settled_tables_are_shared_and_cleared(spark):
    from terraweft.session import clear, settle

    held = settle(spark.range(5).toDF("k"))
    assert held.count() == 5
    clear(spark)
    with pytest.raises(Exception):  # noqa: B017  its files are gone
        spark.read.parquet(held.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_polygons_of_a_table_agree_with_those_in_the_plan(spark):
    corners = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    points = [(x / 2, y / 2) for x in range(-2, 24) for y in range(-2, 24)] + [(5.0, 4.0), (2.5, 7.0)]
    held = F.array(*(F.struct(F.lit(a).alias("e"), F.lit(b).alias("n")) for a, b in corners))
    df = spark.createDataFrame(points, "x double, y double").withColumn("c", held)
    x, y, c = F.col("x"), F.col("y"), F.col("c")
    r = df.select((geo.in_polygon(x, y, c) == geo.crossings_odd(x, y, edges)).alias("a"), (geo.in_fence(x, y, c) == geo.within_fence(x, y, edges)).alias("b")).distinct().collect()
    assert [(q.a, q.b) for q in r] == [(True, True)]
    none = df.limit(1).select(geo.in_polygon(x, y, F.slice(c, 1, 0)).alias("p"), geo.in_fence(x, y, F.slice(c, 1, 0)).alias("f")).first()
    assert (none.p, none.f) == (False, False)


def test_log_is_read_by_whole_lines(spark):
    log = "a\n\nbé\nhalf é".encode()
    for size, offset, lines, at in ((0, 0, [], 0), (1, 0, [], 0), (2, 0, ["a"], 2), (len(log) - 1, 0, ["a", "", "bé"], 7), (len(log), 2, ["", "bé"], 7), (len(log), 7, [], 7)):
        df = spark.createDataFrame([(bytearray(log[:size]), offset)], "log binary, offset int")
        got = df.select(sinks.complete_lines(F.col("log"), F.col("offset")).alias("r")).first().r
        assert (got.lines, got.offset) == (lines, at)


def test_clean_pictures_come_before_degraded_ones(spark):
    rows = [("a", "images", "a/images/1", 9.0), ("a", "mosaic_images", "a/mosaic_images/2", 9.0), ("a", "mosaic_images", "a/mosaic_images/1", 0.5), ("b", "images", "b/images/2", 9.0), ("b", "images", "b/images/1", 9.0), ("c", "mosaic_images", "c/mosaic_images/1", 0.0), ("c", "images", "c/images/1", 9.0)]
    got = exif.in_capture_order(spark.createDataFrame(rows, "session string, kind string, path string, alt double"))
    assert sorted((r.session, r.path, r.seq) for r in got.collect()) == [("a", "a/mosaic_images/2", 1), ("b", "b/images/1", 1), ("b", "b/images/2", 2)]


def test_rules_across_settings(spark):
    square = "[[1,1],[1,2],[2,2],[2,1]]"
    cases = {
        f'{{"area_points":{square}}}': None, "[1]": "no object", "{}": "four corners", f'{{"area_points":{square},"laps":-1}}': "laps", f'{{"area_points":{square},"laps":true}}': "laps",
        f'{{"area_points":{square},"laps":1}}': "lap_points", f'{{"area_points":{square},"laps":1,"lap_points":[[1,1],[2,2]]}}': None, f'{{"area_points":{square},"laps":1,"lap_points":[[1,1],[2,2],[1,1]]}}': None,
        f'{{"search_boundary":true,"search_boundaries":{{"1":{square},"2":{square}}}}}': "search_boundary", f'{{"search_boundary":2,"search_boundaries":{{"2":{square},"1":{square}}}}}': None, f'{{"search_boundaries":{{"1":{square},"2":{square}}}}}': "search_boundary",
        '{"search_boundary":2}': "search_boundaries",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.p for r in df.select("t", config.layout_problem(F.col("t")).alias("p")).collect()} == cases
