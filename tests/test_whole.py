"""Queries over whole tables, by brute force on the smallest ones."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terraweft.operators import fit, projective, proximity, raster
from terraweft.plans import extras, matching, records
from terraweft.plans.capture import arrival_candidates

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return [tuple(r) for r in entry.queries()[name](spark, SF).collect()]


def joined(pairs):
    """The smallest node of each node's component, and the pairs that joined two."""
    parent, took = {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p in pairs:
        a, b = sorted((root(p[0]), root(p[1])))
        if a != b:
            parent[b] = a
            took.append(p)
    return {x: root(x) for x in list(parent)}, took


def test_graph_queries_see_every_row(spark):
    l = pd.read_parquet(f"{SF}/lineitem.parquet")
    score = {(2 * s, 2 * p + 1): int(q) for (s, p), q in l.groupby(["l_suppkey", "l_partkey"]).l_quantity.sum().items()}
    parts, forest = joined(sorted(score, key=lambda e: (-score[e], e)))
    assert dict(run(spark, "G1_connected_components")) == parts
    size = Counter(parts.values())
    best = min(size, key=lambda c: (-size[c], c))
    assert {n for (n,) in run(spark, "A8_largest_component")} == {n for n, c in parts.items() if c == best}
    assert {(a, b) for a, b, _ in run(spark, "G2_spanning_forest")} == set(forest)
    assert dict(run(spark, "G2_forest_parts")) == {c: n - 1 for c, n in size.items()}
    strong, _ = joined(e for e, s in score.items() if s >= 45)
    size = Counter(strong.values())
    assert set(run(spark, "G5_supported_groups")) == {(n, c) for n, c in strong.items() if size[c] >= 4}
    total = defaultdict(int)
    for (a, b), s in score.items():
        total[a] += s
        total[b] += s
    assert run(spark, "A11_root_by_score") == [min(total.items(), key=lambda t: (-t[1], t[0]))]
    found, _ = joined({(2 * p, 2 * o + 1) for o, p in zip(l.l_orderkey, l.l_partkey)})
    points = defaultdict(list)
    for n, c in found.items():
        if n % 2 == 0:
            points[c].append(n // 2)
    assert sorted(run(spark, "G4_tracks")) == sorted((min(p), len(p)) for p in points.values())


@pytest.mark.parametrize(("k", "steps"), [(25, (1, 2, 3, 5, 8, 15)), (12, (1, 2, 3, 5)), (2, (1, 4))])
def test_arrivals_queue_the_pairs_of_a_replay(spark, k, steps):
    rng = random.Random(4)
    rows, want = [], set()
    for session, n in ((1, 45), (2, 4), (3, 1)):
        at = [(rng.randrange(40) * 5.0, rng.randrange(20) * 5.0) for _ in range(n)]
        rows += [(session, i + 1, 100 * session + i, *p) for i, p in enumerate(at)]
        for i in range(n):
            d = [round(math.dist(at[i], at[j]), 6) for j in range(i)]
            found = {j for j in sorted(range(i), key=lambda j: (d[j], j))[:k] if d[j] < 120} | {i - s for s in steps if i >= s}
            for j in range(i):
                if d[j] < 120 and sum(round(math.dist(at[j], at[o]), 6) < d[j] for o in range(i) if o != j) < k:
                    found.add(j)
            want |= {(session, 100 * session + j, 100 * session + i) for j in found}
    p = spark.createDataFrame(rows, "session long, seq int, frame_id long, east double, north double")
    got = [tuple(r) for r in arrival_candidates(p, k, steps).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_arrivals_of_the_tables(spark):
    assert len(run(spark, "J6_arrival_candidates")) > len(run(spark, "J6_arrival_candidates_fast")) > len(run(spark, "J6_arrival_pairs"))


def matched(share, n=150, groups=4):
    """Groups of correspondences of which a share follows one homography, the others nothing."""
    rng, rows = np.random.default_rng(3), []
    h = np.array([[1.1, 0.05, 0.3], [-0.04, 0.95, -0.2], [0.02, -0.03, 1.0]])
    for g in range(groups):
        p = rng.uniform(-1, 1, (n, 2))
        q = np.column_stack([p, np.ones(n)]) @ h.T
        q = q[:, :2] / q[:, 2:] + rng.normal(scale=0.001, size=(n, 2))
        q[round(share * n) :] = rng.uniform(-3, 3, (n - round(share * n), 2))
        rows += [(g, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, q))]
    return rows, h


MATCHES = "g long, k long, u double, v double, x double, y double"


def test_consensus_at_the_acceptance_limit(spark):
    rows, h = matched(0.36)
    got = projective.consensus(spark.createDataFrame(rows, MATCHES), "g", "k", 0.006).collect()
    assert len(got) == 4
    for r in got:
        assert r.inliers >= 0.35 * 150 * 0.9 and np.allclose(np.array(r.h).reshape(3, 3), h, atol=0.005)


def test_best_map_is_refitted_to_its_inliers(spark):
    rows, h = matched(1.0, groups=2)
    for r in projective.consensus(spark.createDataFrame(rows, MATCHES), "g", "k", 0.01).collect():
        got = np.array(r.h).reshape(3, 3)
        a = np.array([x[2:] for x in rows if x[0] == r.g])
        error = lambda m: np.square((q := np.column_stack([a[:, :2], np.ones(len(a))]) @ m.T)[:, :2] / q[:, 2:] - a[:, 2:]).sum()
        assert r.inliers == 150 and error(got) <= error(h)


def test_anchor_meets_a_small_share(spark):
    rng, rows = np.random.default_rng(8), []
    for g in range(6):
        for k in range(200):
            u, v = rng.uniform(-50, 50, 2)
            # Six of the true points, in places that no short step joins.
            x, y = (2 * u - v + 3, u + 2 * v - 1) if k % 34 == 0 else rng.uniform(-9000, 9000, 2)
            rows.append((g, k, float(u), float(v), float(x), float(y)))
    got = fit.anchored(spark.createDataFrame(rows, MATCHES), "g", "k", 0.5, 6).collect()
    assert len(got) == 6 and all((f.p, f.q, f.tx, f.ty) == pytest.approx((2, 1, 3, -1), abs=1e-6) for f in got)


def test_samples_are_of_different_places(spark):
    s = [tuple(r) for r in fit.places(spark.createDataFrame([(1, 4), (2, 9), (3, 3)], "g long, _n long"), "g", 0, 50, 4).collect()]
    by = defaultdict(set)
    for g, k, _, at in s:
        by[g, k].add(at)
    assert len(by) == 100 and all(len(x) == 4 and x <= set(range(4 if g == 1 else 9)) for (g, _), x in by.items())


def test_every_descriptor_gets_its_nearest_word(spark):
    rng = np.random.default_rng(2)
    centres, d = rng.normal(size=(20, 8)), rng.normal(size=(500, 8))
    words = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "word long, centre array<double>")
    rows = spark.createDataFrame([(k % 7, k, x.tolist()) for k, x in enumerate(d)], "image_id long, feat_id long, desc array<double>")
    nearest = np.square(d[:, None] - centres).sum(2).argmin(1)
    held = matching.worded(rows, words).select("image_id", "feat_id", "word")
    assert {r.feat_id: r.word for r in held.collect()} == dict(enumerate(nearest.tolist()))
    n = Counter((k % 7, int(w)) for k, w in enumerate(nearest))
    having = Counter(w for _, w in n)
    raw = {(i, w): c * (math.log(8 / (1 + having[w])) + 1) for (i, w), c in n.items()}
    total = Counter()
    for (i, _), x in raw.items():
        total[i] += x
    want = {(i, w): math.sqrt(x / max(total[i], 1)) for (i, w), x in raw.items()}
    weights = matching.weighted(held.groupBy("image_id", "word").agg(F.count("*").alias("n")), 7)
    assert {(r.image_id, r.word): r.weight for r in weights.collect()} == pytest.approx(want)
    close = {(i, j): sum(x * want.get((j, w), 0) for (k, w), x in want.items() if k == i) for i in range(7) for j in range(7) if i != j}
    assert {(r.i, r.j): r.similarity for r in matching.similar_images(weights).collect()} == pytest.approx(close, abs=1e-6)


def test_vocabulary_counts_all_descriptors(spark, tmp_path):
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"vec_id": range(1000, 7000), "embedding": [x.astype(np.float32).tolist() for x in rng.normal(size=(6000, 4))]})
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = entry.queries()["G6_vocabulary"](spark, str(tmp_path)).collect()
    assert len(found) == 128 and sum(r.members for r in found) == 6000
    counts = entry.queries()["A5_whole_histogram"](spark, str(tmp_path)).collect()
    assert sum(r.n for r in counts) == 6000 and len({r.image_id for r in counts}) == 48


def test_long_settings_are_read_whole(spark, tmp_path):
    props = '{"pad": "' + "x" * 20_000 + '", "k": 7}'
    spark.createDataFrame([(1, props), (2, '{"k": 3}')], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.event_id: r.k for r in entry.queries()["S13_commented_json"](spark, str(tmp_path)).collect()} == {1: 7, 2: 3}


def test_hulls_of_batches_give_the_area_of_all(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0, 100, (30_000, 2))
    rows = pd.DataFrame({"g": np.where(np.arange(30_000) < 29_000, 1, 2), "x": p[:, 0], "y": p[:, 1]})
    df = spark.createDataFrame(pd.concat([rows, pd.DataFrame({"g": 3, "x": range(50), "y": range(50)})]), "g long, x double, y double")
    assert matching.extreme_points(df, ["g"], "x", "y").count() < 1000
    got = {r.g: r.area for r in matching.hull_areas(df, ["g"], "x", "y").collect()}
    assert got == pytest.approx({g: matching.hull_area(*rows[rows.g == g][["x", "y"]].to_numpy().T) for g in (1, 2)} | {3: 0.0})


@pytest.mark.parametrize("name", ["W7_resample", "K13_exchange_round_trip"])
def test_sessions_are_not_collected(spark, name, monkeypatch):
    seen = []
    monkeypatch.setattr(extras, "settle", lambda df, name: seen.append(df) or df)
    seen.append(entry.queries()[name](spark, SF))
    assert not any("collect_list" in df._jdf.queryExecution().toString() for df in seen)


@pytest.mark.parametrize(("crowd", "radius"), [(2000, 120.0), (20, 120.0), (20, 7.0), (3, 40.0)])
def test_nearest_of_crowded_and_sparse_places(spark, monkeypatch, crowd, radius):
    monkeypatch.setattr(proximity, "CROWD", crowd)
    rng = random.Random(6)
    rows = [(1, k, rng.gauss(0, 30), rng.gauss(0, 30)) for k in range(150)] + [(1, 150 + k, 500.0, 500.0) for k in range(30)] + [(1, 190, 900.0, -900.0), (1, 191, 1000.0, -900.0)]
    rows += [(2, k, float(k % 7), float(k % 5)) for k in range(60)] + [(3, 1, 0.0, 0.0)]
    want = set()
    for g, i, x, y in rows:
        d = sorted((round(math.dist((x, y), (e, n)), 6), j) for h, j, e, n in rows if h == g and j != i)
        want |= {(g, i, j, r + 1) for r, (near, j) in enumerate(d[:6]) if near < radius}
    df = spark.createDataFrame(rows, "g long, id long, e double, n double")
    got = [(r.g, r.i, r.j, r["rank"]) for r in proximity.nearest_within(df, "g", "id", "e", "n", radius, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert proximity.nearest_within(df.limit(0), "g", "id", "e", "n", radius, 6).collect() == []


def test_views_with_broad_support(spark):
    from terraweft.plans.rasters import CELL, cells

    seen = cells(spark, SF).select("session", "frame_id", "alt", "row", "col").toPandas()
    others = seen.groupby(["session", "row", "col"]).frame_id.transform("count")
    want = {}
    for (session, frame), g in seen[others >= 2].groupby(["session", "frame_id"]):
        area = matching.hull_area(g.col.to_numpy() * CELL, g.row.to_numpy() * CELL)
        if len(g) >= 12 and area > 0.1 and area >= 0.3 * (g.alt.iloc[0] * 1.2) ** 2:
            want[session, frame] = round(area, 6)
    got = {(s, f): a for s, f, a in run(spark, "R8_whole_views")}
    assert got == pytest.approx(want) and 0 < len(want) < seen.frame_id.nunique()


def test_spread_sample_by_force(spark):
    draw = random.Random(5)
    at = [(g, k, draw.randint(0, 40), draw.randint(0, 40)) for g, n in ((1, 300), (2, 220), (3, 1)) for k in range(n)]
    df = spark.createDataFrame([(g, k, float(e), float(n)) for g, k, e, n in at], "g long, k long, east double, north double")
    got = {tuple(r) for r in records.spread_sample(df, "g", "k", 220).collect()}
    assert {r for r in got if r[0] != 1} == {(g, k) for g, k, *_ in at if g != 1}
    p = [(e, n) for g, _, e, n in at if g == 1]
    chosen = [0]
    while len(chosen) < 220:
        gap = [-1 if i in chosen else min((e - p[c][0]) ** 2 + (n - p[c][1]) ** 2 for c in chosen) for i, (e, n) in enumerate(p)]
        chosen.append(gap.index(max(gap)))
    assert {k for g, k in got if g == 1} == set(chosen)


def test_frames_read_by_force(spark):
    high, wide, crop = 5, 6, 0.8
    draw = np.random.default_rng(3).integers(0, 256, (high, wide)).astype(float)
    df = spark.createDataFrame([(1, r, c, float(draw[r, c])) for r in range(high) for c in range(wide)], "image long, row int, col int, value double")
    got = {(r.row, r.col): r.value for r in raster.read_frames(df, "image", high, wide, "synthetic", crop).collect()}
    full = wide / crop
    margin, f = (full - wide) / 2, 0.85 * max(full, high)
    gain = lambda r, c: max(1 - 0.3 * min(((c + margin - full / 2) / (full / 2)) ** 2 + ((r - high / 2) / (high / 2)) ** 2, 1.96), 0.1)
    even = np.array([[math.floor(min(255, draw[r, c] / gain(r, c))) for c in range(wide)] for r in range(high)])
    assert len(got) == high * wide
    for (r, c), value in got.items():
        x0, y0 = (c + margin - full / 2) / f, (r - high / 2) / f
        x, y = x0, y0
        for _ in range(5):
            s = 1 - 0.12 * (x * x + y * y) + 0.02 * (x * x + y * y) ** 2
            x, y = x0 / s, y0 / s
        u, v = min(max(x * f + full / 2 - margin, 0), wide - 1), min(max(y * f + high / 2, 0), high - 1)
        i, j = int(v), int(u)
        i2, j2 = min(i + 1, high - 1), min(j + 1, wide - 1)
        a, b = even[i, j] + (even[i, j2] - even[i, j]) * (u - j), even[i2, j] + (even[i2, j2] - even[i2, j]) * (u - j)
        assert value == pytest.approx(a + (b - a) * (v - i))
    assert raster.read_frames(df, "image", high, wide).count() == high * wide
    for profile, share in (("other", 0.8), ("none", 0.0), ("none", 1.1)):
        with pytest.raises(ValueError):
            raster.read_frames(df, "image", high, wide, profile, share)


def test_poses_without_anchor_are_left_out(spark):
    draw = random.Random(2)
    rows = [(g, k, draw.uniform(0, 9), draw.uniform(0, 9)) for g, n in ((1, 40), (2, 5)) for k in range(n)]
    rows = [(g, k, u, v, 3 * u - 2 * v + 5 + 80 * (k % 8 == 0), 2 * u + 3 * v - 1 - 40 * (k % 8 == 0)) for g, k, u, v in rows]
    got = fit.georeferenced(spark.createDataFrame(rows, MATCHES), "g", "k", 5.0, 6).collect()
    assert {(r.g, r.k): r.inlier for r in got} == {(1, k): k % 8 != 0 for k in range(40)}
    assert all(abs(r.x2 - (3 * r.u - 2 * r.v + 5)) < 1e-9 and abs(r.y2 - (2 * r.u + 3 * r.v - 1)) < 1e-9 and r.median_error < 1e-9 for r in got)


def test_faults_of_fences(spark):
    from pyspark.sql import functions as F

    from terraweft.functions import geo

    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    cases = {
        "": square, "closed": [*square, (0, 0)], "count": [(0, 0), (1, 0), (0, 0)], "concave": [(0, 0), (10, 0), (4, 4), (0, 10)], "duplicate,crossing": [(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5)],
        "collinear": [(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)], "crossing": [(0, 0), (10, 10), (10, 0), (0, 10)], "extent": [(0, 0), (30_000, 0), (0, 100)], "touching": [(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)],
        "many": [(round(1000 * math.cos(k * 2 * math.pi / 71), 3), round(1000 * math.sin(k * 2 * math.pi / 71), 3)) for k in range(71)],
    }
    want = {"closed": "", "concave": "", "touching": "crossing", "many": "count", "count": "count,collinear"}
    frame = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in cases.items()] + [("none", [])], "k string, c array<struct<e:double,n:double>>")
    got = {r.k: r.f for r in frame.select("k", F.array_join(geo.fence_faults(F.col("c")), ",").alias("f")).collect()}
    assert got == {k: want.get(k, k) for k in cases} | {"none": "count"}
