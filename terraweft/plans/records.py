"""Queries: fits, samples, sets, documents and caches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.operators import fit, poses
from terraweft.plans.catalog import query
from terraweft.plans.geometry import LOCAL_SQL, placed
from terraweft.session import settle, table
from terraweft.sources import config
from terraweft.sources.frames import FRAMES_SQL, frames


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as matches: (u, v) as seen, (x, y) on the ground, turned, scaled and with some gross errors."""
    p = placed(spark, sf_dir)
    off = F.when(F.col("frame_id") % 9 == 0, F.lit(60.0)).otherwise((F.col("frame_id") % 5 - 2) * 0.1)
    return p.select("session", "seq", "frame_id", (F.col("east") / 50).alias("u"), (F.col("north") / 50).alias("v"), (F.col("east") * 0.8 - F.col("north") * 0.6 + 12 + off).alias("x"), (F.col("east") * 0.6 + F.col("north") * 0.8 - 7 - off).alias("y"))


VIEWS_SQL = f"{LOCAL_SQL}, o AS (SELECT *, CASE WHEN frame_id % 9 = 0 THEN 60e0 ELSE (frame_id % 5 - 2) * 0.1e0 END AS off FROM placed), views AS (SELECT session, frame_id, east / 50 AS u, north / 50 AS v, east * 0.8e0 - north * 0.6e0 + 12 + off AS x, east * 0.6e0 + north * 0.8e0 - 7 - off AS y FROM o)"


@query("A17_normal_equations", f"""WITH {VIEWS_SQL}, s AS (SELECT session, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u) AS su, sum(v) AS sv, count(*) * 1e0 AS n, sum(u * x) AS ux, sum(v * x) AS vx, sum(x) AS sx FROM views GROUP BY session),
d AS (SELECT *, uu * (vv * n - sv * sv) - uv * (uv * n - sv * su) + su * (uv * sv - vv * su) AS det FROM s)
SELECT session, round((ux * (vv * n - sv * sv) - uv * (vx * n - sv * sx) + su * (vx * sv - vv * sx)) / det, 4) AS a, round((uu * (vx * n - sv * sx) - ux * (uv * n - sv * su) + su * (uv * sx - vx * su)) / det, 4) AS b FROM d""")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.affine(views(spark, sf_dir), ["session"]).select("session", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def _pass(k: int) -> str:
    """One weighted fit and the weights that follow from it."""
    mean = ", ".join(f"sum(w * {c}) / nullif(sum(w), 0) AS m{c}" for c in "uvxy")
    return f"""m{k} AS (SELECT session, {mean} FROM w{k} GROUP BY session),
f{k} AS (SELECT session, mu, mv, mx, my, sum(w * ((u - mu) * (x - mx) + (v - mv) * (y - my))) AS a, sum(w * ((u - mu) * (y - my) - (v - mv) * (x - mx))) AS b, sum(w * ((u - mu) * (u - mu) + (v - mv) * (v - mv))) AS n FROM w{k} JOIN m{k} USING (session) GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT session, a / n AS p, b / n AS q, mx - a / n * mu + b / n * mv AS tx, my - b / n * mu - a / n * mv AS ty FROM f{k} WHERE n > 0),
w{k + 1} AS MATERIALIZED (SELECT session, u, v, x, y, least(1, 1 / greatest(sqrt(pow(p * u - q * v + tx - x, 2) + pow(q * u + p * v + ty - y, 2)), 1e-9)) AS w FROM w{k} JOIN s{k} USING (session))"""


@query("G10_robust_similarity", f"WITH {VIEWS_SQL}, w0 AS MATERIALIZED (SELECT session, u, v, x, y, 1e0 AS w FROM views), {', '.join(map(_pass, range(5)))} SELECT session, round(p, 4) AS p, round(q, 4) AS q, round(tx, 4) AS tx, round(ty, 4) AS ty FROM s4")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fit.robust_similarity(views(spark, sf_dir), ["session"], scale=1.0)
    return f.select("session", *(F.round(k, 4).alias(k) for k in ("p", "q", "tx", "ty")))


ANCHOR_SQL = f"""{VIEWS_SQL}, i AS (SELECT * FROM views WHERE frame_id % 9 <> 0 QUALIFY count(*) OVER (PARTITION BY session) >= 6), m AS (SELECT session, avg(u) AS mu, avg(v) AS mv, avg(x) AS mx, avg(y) AS my FROM i GROUP BY session),
s AS (SELECT session, mu, mv, mx, my, count(*) AS inliers, sum((u - mu) * (x - mx) + (v - mv) * (y - my)) / sum((u - mu) * (u - mu) + (v - mv) * (v - mv)) AS p, sum((u - mu) * (y - my) - (v - mv) * (x - mx)) / sum((u - mu) * (u - mu) + (v - mv) * (v - mv)) AS q FROM i JOIN m USING (session) GROUP BY ALL)"""


@query("G12_anchor", f"WITH {ANCHOR_SQL} SELECT session, inliers, round(p, 4) AS p, round(q, 4) AS q, round(mx - p * mu + q * mv, 4) AS tx, round(my - q * mu - p * mv, 4) AS ty FROM s")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fit.anchored(views(spark, sf_dir), "session", "seq", tolerance=5.0, least=6)
    return a.select("session", "inliers", *(F.round(k, 4).alias(k) for k in ("p", "q", "tx", "ty")))


@query("G14_anchored_poses", f"""WITH {ANCHOR_SQL}, g AS (SELECT session, frame_id, p * (u - mu) - q * (v - mv) + mx AS x2, q * (u - mu) + p * (v - mv) + my AS y2, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS error FROM views JOIN s USING (session))
SELECT session, frame_id, round(x2, 4) AS east, round(y2, 4) AS north, error <= 5 AS inlier, round(quantile_cont(error, 0.5) OVER (PARTITION BY session), 4) AS median_error FROM g""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view's place on the ground by its session's anchor; sessions without six agreeing views are left out."""
    g = fit.georeferenced(views(spark, sf_dir), "session", "seq", tolerance=5.0, least=6)
    return g.select("session", "frame_id", F.round("x2", 4).alias("east"), F.round("y2", 4).alias("north"), "inlier", F.round("median_error", 4).alias("median_error"))


def plane_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, frame_id, east, north, h: the homography of each capture from its session's first, with an arbitrary factor."""
    p = placed(spark, sf_dir).select("session", "seq", "frame_id", "east", "north", "alt", F.coalesce("heading", F.lit(0.0)).alias("heading"), "roll", "pitch")
    first = p.where("seq = 1").select("session", *(F.col(c).alias(f"r_{c}") for c in ("east", "north", "alt", "heading", "roll", "pitch")))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = poses.planted(b).reshape(-1, 9) * (1 + b.frame_id.to_numpy() % 3)[:, None] * np.where(b.frame_id % 2 == 0, 1.0, -1.0)[:, None]
            yield b[["session", "frame_id", "east", "north"]].assign(h=list(h))

    seen = p.join(first, "session").mapInPandas(made, "session long, frame_id long, east double, north double, h array<double>")
    return settle(poses.with_ways(seen), "views")


_TILT_SQL = "n AS (SELECT session, count(*) AS views, min_by(radians(roll), frame_id) AS r, min_by(radians(pitch), frame_id) AS p FROM placed GROUP BY session)"


@query("G13_plane_normals", f"WITH {LOCAL_SQL}, {_TILT_SQL} SELECT session, round(sin(p), 5) AS nx, round(-sin(r) * cos(p), 5) AS ny, round(cos(r) * cos(p), 5) AS nz FROM n WHERE views >= 6")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground's normal as each session's first camera saw it, by consensus over the homographies of all its captures."""
    held = plane_views(spark, sf_dir)
    enough = held.groupBy("session").agg(F.count("*").alias("n")).where("n >= 6").select("session")
    n = poses.plane_normals(held.join(enough, "session", "left_semi"), "session", "frame_id").where("consistent")
    return n.select("session", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")))


@query("G14_decomposed_poses", f"WITH {LOCAL_SQL}, n AS (SELECT session FROM placed GROUP BY session HAVING count(*) >= 6) SELECT session, frame_id, round(east, 3) AS east, round(north, 3) AS north FROM placed SEMI JOIN n USING (session)")
def g14_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera places from homographies alone, taken apart and anchored to the ground by the positions."""
    held = plane_views(spark, sf_dir)
    found = poses.camera_places(held, poses.plane_normals(held, "session", "frame_id"), "session", "frame_id")
    points = found.join(held.select("session", "frame_id", F.col("east").alias("x"), (-F.col("north")).alias("y")), ["session", "frame_id"])
    g = fit.georeferenced(settle(points, "points"), "session", "frame_id", tolerance=5.0, least=6)
    return g.select("session", "frame_id", F.round("x2", 3).alias("east"), F.round(-F.col("y2"), 3).alias("north"))


@query("G11_homographies")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraweft.operators import projective

    h = projective.consensus(views(spark, sf_dir), "session", "seq", tolerance=1.0)
    return h.select("session", "inliers", "points", *(F.round(F.col("h")[k], 3).alias(f"h{k}") for k in range(8)))


@query("G7_adjusted_poses")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a ring of ten adjusted to each other; the median residual before and after."""
    from terraweft.operators import projective
    from terraweft.session import settle

    at = F.col("frame_id") % 10
    p = placed(spark, sf_dir).select(at.alias("i"), ((at + 1) % 10).alias("j"), (F.col("east") / 100).alias("u"), (F.col("north") / 100).alias("v"), (F.col("east") / 100 + 0.02).alias("x"), (F.col("north") / 100 - 0.01).alias("y"))
    matches = settle(p, "matches")
    poses = matches.select(F.col("i").alias("view")).distinct().withColumn("h", F.array(*(F.lit(float(k in (0, 4, 8))) for k in range(9))))
    after = projective.adjusted(matches, poses, root=0, rounds=3)
    median = lambda h, name: projective.residuals(matches, h).groupBy("i").agg(F.percentile(F.hypot("rx", "ry"), 0.5).alias(name))
    both = median(poses, "before").join(median(after, "after"), "i")
    return both.select(F.col("i").alias("view"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("G8_jacobian", f"WITH {VIEWS_SQL}, w AS (SELECT *, 0.01e0 * u - 0.02e0 * v + 1 AS w FROM views), j AS (SELECT session, u / w AS j0, -((1.1e0 * u + 0.1e0 * v + 2) / w) * u / w AS j6 FROM w) SELECT session, round(sum(j0 * j0), 4) AS n00, round(sum(j0 * j6), 4) AS n06, round(sum(j6 * j6), 4) AS n66 FROM j GROUP BY session")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of a projective adjustment, position by position; three of them are shown."""
    h = [F.lit(x) for x in (1.1, 0.1, 2.0, -0.1, 0.9, 1.0, 0.01, -0.02)]
    jx, _ = fit.homography_jacobian(h, F.col("u"), F.col("v"))
    rows = views(spark, sf_dir).select("session", jx.alias("j"), F.lit(1.0).alias("t"), F.lit(1.0).alias("w"))
    n = fit.normal_equations(rows, ["session"], "j", "t", "w")
    at = lambda i, j: F.round(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("value"))), 4)
    return n.groupBy("session").agg(at(0, 0).alias("n00"), at(0, 6).alias("n06"), at(6, 6).alias("n66"))


def spread_sample(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Farthest-point sampling of each group: begins at its first row; each next one is farthest from those chosen.

    Each choice depends on all before it; a group is one flight's captures, of which `limit` are chosen in turn.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        if len(rows) <= limit:
            return rows[[group, order]]
        at = rows[["east", "north"]].to_numpy()
        chosen, gap = [0], np.full(len(rows), np.inf)
        for _ in range(limit - 1):
            gap = np.minimum(gap, ((at - at[chosen[-1]]) ** 2).sum(1))
            gap[chosen] = -1
            chosen.append(int(np.argmax(gap)))
        return rows.iloc[sorted(chosen)][[group, order]]

    kinds = dict(df.dtypes)
    return df.select(group, order, "east", "north").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}")


def _spread_sql(limit: int) -> str:
    """The recursive form of a farthest-point sample of at most `limit` captures of each session."""
    return f"""WITH RECURSIVE {LOCAL_SQL}, pick(session, k, ids, last_e, last_n, gaps) AS (
  SELECT session, 1, [min_by(frame_id, frame_id)], min_by(east, frame_id), min_by(north, frame_id), list({{'f': frame_id, 'e': east, 'n': north, 'g': 1e300::DOUBLE}} ORDER BY frame_id) FROM placed GROUP BY session
  UNION ALL SELECT session, k + 1, list_append(ids, b.f), b.e, b.n, g2 FROM (SELECT *, list_reduce(g2, lambda x, y: CASE WHEN y.g > x.g THEN y ELSE x END) AS b FROM (
    SELECT session, k, ids, list_transform(gaps, lambda z: {{'f': z.f, 'e': z.e, 'n': z.n, 'g': CASE WHEN list_contains(ids, z.f) THEN -1e0 ELSE least(z.g, (z.e - last_e) * (z.e - last_e) + (z.n - last_n) * (z.n - last_n)) END}}) AS g2 FROM pick WHERE k < least({limit}, len(gaps)))))
SELECT session, unnest(ids) AS frame_id FROM pick WHERE k = least({limit}, len(gaps))"""


@query("L4_spatial_frames", _spread_sql(12))
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_sample(placed(spark, sf_dir), "session", "frame_id", 12)


@query("L4_whole_frames", _spread_sql(220))
def l4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 220 captures of a session; a shorter one is kept whole."""
    return spread_sample(placed(spark, sf_dir), "session", "frame_id", 220)


@query("L3_corner_order", "WITH c(k, x, y) AS (VALUES (0, 0e0, 0e0), (1, 9e0, 7e0), (2, 10e0, 0e0), (3, 1e0, 8e0)), p AS (SELECT s_suppkey AS s, k, x + (s_suppkey % 3) AS x, y - (s_suppkey % 2) AS y FROM supplier, c), m AS (SELECT s, avg(x) AS mx, avg(y) AS my FROM p GROUP BY s) SELECT s, string_agg(CAST(k AS VARCHAR), ',' ORDER BY atan2(y - my, x - mx)) AS corners FROM p JOIN m USING (s) GROUP BY s")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners by their angle about the centre."""
    s = F.col("s_suppkey")
    corner = lambda k, x, y: F.struct(F.lit(k).alias("k"), (F.lit(x) + s % 3).alias("x"), (F.lit(y) - s % 2).alias("y"))
    p = F.array(corner(0, 0.0, 0.0), corner(1, 9.0, 7.0), corner(2, 10.0, 0.0), corner(3, 1.0, 8.0))
    mean = lambda f: F.aggregate("p", F.lit(0.0), lambda a, c: a + c[f]) / 4
    t = table(spark, sf_dir, "supplier").withColumn("p", p).withColumn("mx", mean("x")).withColumn("my", mean("y"))
    by = F.array_sort(F.transform("p", lambda c: F.struct(F.atan2(c["y"] - F.col("my"), c["x"] - F.col("mx")).alias("a"), c["k"].alias("k"))))
    return t.select(s.alias("s"), F.array_join(F.transform(by, lambda c: c["k"].cast("string")), ",").alias("corners"))


@query("A14_duplicates", "SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS kinds, count(*) <> count(DISTINCT o_orderpriority) AS repeats FROM orders GROUP BY o_custkey")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("kinds"))
    return g.withColumn("repeats", F.col("orders") != F.col("kinds"))


@query("A15_run_counters", "SELECT user_id AS session, count(*) FILTER (event_type = 'view') AS feature_hits, count(*) FILTER (event_type = 'click') AS pair_hits, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) AS completed FROM events GROUP BY user_id")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"feature_hits": "view", "pair_hits": "click", "accepted": "purchase"}
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(*(F.count_if(F.col("event_type") == v).alias(k) for k, v in named.items()), F.count("*").alias("completed"))


@query("A16_missing_headings", f"WITH {FRAMES_SQL} SELECT session, count(*) FILTER (heading IS NULL) AS missing FROM frames GROUP BY session")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("session").agg(F.count_if(F.col("heading").isNull()).alias("missing"))


@query("A19_centroid", f"WITH {FRAMES_SQL} SELECT session, sum(CAST(round(lat * 1e6) AS BIGINT)) / count(*) AS lat_micro, sum(CAST(round(lon * 1e6) AS BIGINT)) / count(*) AS lon_micro FROM frames GROUP BY session")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean position in millionths of a degree, from whole numbers, so that the order of rows doesn't show."""
    mean = lambda c: F.sum(F.round(F.col(c) * 1e6).cast("long")) / F.count("*")
    return frames(spark, sf_dir).groupBy("session").agg(mean("lat").alias("lat_micro"), mean("lon").alias("lon_micro"))


@query("A18_consensus", f"WITH {FRAMES_SQL}, c AS (SELECT session, alt, count(*) AS n FROM frames GROUP BY session, alt), s AS (SELECT a.session, a.alt, sum(b.n * abs(a.alt - b.alt)) AS cost FROM c a JOIN c b USING (session) GROUP BY a.session, a.alt) SELECT session, arg_min(alt, (cost, alt)) AS alt FROM s GROUP BY session")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate nearest to all: values are counted first, so that distinct ones meet, not rows."""
    c = frames(spark, sf_dir).groupBy("session", "alt").agg(F.count("*").alias("n"))
    other = c.select("session", F.col("alt").alias("b"), F.col("n").alias("m"))
    cost = c.join(other, "session").groupBy("session", "alt").agg(F.sum(F.col("m") * F.abs(F.col("alt") - F.col("b"))).alias("cost"))
    return cost.groupBy("session").agg(F.min(F.struct("cost", "alt"))["alt"].alias("alt"))


@query("U2_set_difference", "SELECT o_custkey, len(list_filter(list(DISTINCT o_orderstatus), lambda s: s NOT IN ('O', 'F'))) AS unknown FROM orders GROUP BY o_custkey")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.lit("O"), F.lit("F"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.size(F.array_except(F.collect_set("o_orderstatus"), known)).cast("long").alias("unknown"))


@query("U3_set_intersection", "SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_suppkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("node")).distinct().join(l.where("l_quantity > 49").select(F.col("l_partkey").alias("node")).distinct(), "node", "left_semi")


@query("U5_route_concatenation", f"WITH {FRAMES_SQL}, u AS (SELECT session, 0 AS part, seq, frame_id FROM frames WHERE seq <= 2 UNION ALL SELECT session, 1, seq, frame_id FROM frames WHERE seq > 2 UNION ALL SELECT session, 2, seq, frame_id FROM frames WHERE seq = 1) SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY part, seq) AS BIGINT) AS place, frame_id FROM u")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a route one after the other: a union that carries its sort key."""
    f = frames(spark, sf_dir).select("session", "seq", "frame_id")
    parts = (f.where("seq <= 2"), f.where("seq > 2"), f.where("seq = 1"))
    whole = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        whole = p if whole is None else whole.unionByName(p)
    place = F.row_number().over(Window.partitionBy("session").orderBy("part", "seq"))
    return whole.select("session", place.cast("long").alias("place"), "frame_id")


@query("X2_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) * embedding[5] + CAST(embedding[2] AS DOUBLE) * embedding[6] + CAST(embedding[3] AS DOUBLE) * embedding[7], 6) AS dot3, round(CAST(embedding[1] AS DOUBLE) * embedding[6] - CAST(embedding[2] AS DOUBLE) * embedding[5], 6) AS cross_z FROM embeddings")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terraweft.operators.proximity import dot

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = F.slice("e", 1, 3), F.slice("e", 5, 3)
    return e.select("vec_id", F.round(F.sqrt(dot(F.col("e"), F.col("e"))), 6).alias("norm"), F.round(dot(a, b), 6).alias("dot3"), F.round(a[0] * b[1] - a[1] * b[0], 6).alias("cross_z"))


@query("X4_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("X5_arrays", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, list_position(embedding, list_min(embedding)) - 1 AS argmin, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("argmax"), (F.array_position(e, F.array_min(e)) - 1).cast("int").alias("argmin"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@query("S12_polygon_scan", "SELECT s_suppkey AS s, 4 AS corners, round((37.411e0 + s_suppkey % 5 * 0.001e0) * 2 / 4 + (37.412e0 + s_suppkey % 5 * 0.001e0) * 2 / 4, 9) AS lat FROM supplier")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas as JSON lists of [lat, lon]."""
    k = F.col("s_suppkey") % 5
    pair = lambda a, b: F.array((F.lit(a) + k * F.lit(0.001)).cast("double"), F.lit(b))
    text = F.to_json(F.array(pair(37.411, -121.99), pair(37.411, -121.98), pair(37.412, -121.98), pair(37.412, -121.99)))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.from_json(text, "array<array<double>>").alias("p"))
    return p.select("s", F.size("p").alias("corners"), F.round(F.aggregate("p", F.lit(0.0), lambda a, c: a + c[0]) / F.size("p"), 9).alias("lat"))


@query("S13_commented_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '// kept' AS note FROM events")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with // and /* */ comments outside strings."""
    text = F.concat(F.lit('// head\n{"note": "// kept", /* "k": 0,\n */ '), F.col("props").substr(F.lit(2), F.length("props")), F.lit(" // tail"))
    parsed = F.from_json(config.without_comments(text), "note string, k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["note"].alias("note"))


@query("S14_settings_rules", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown field' WHEN event_id % 4 = 0 THEN 'both units' WHEN CAST(json_extract(props, '$.k') AS BIGINT) - 20 <= 0 THEN 'not positive' END AS problem FROM events")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed set of fields, units that exclude each other and ranges, as the first problem found or null."""
    k = F.get_json_object("props", "$.k").cast("long") - 20
    i = F.col("event_id")
    text = F.to_json(F.map_from_arrays(
        F.concat(F.array(F.lit("lap_speed_m_s")), F.when(i % 5 == 0, F.array(F.lit("lap_sped"))).otherwise(F.array().cast("array<string>")), F.when(i % 4 == 0, F.array(F.lit("lap_altitude_m"), F.lit("lap_altitude_ft"))).otherwise(F.array().cast("array<string>"))),
        F.concat(F.array(k.cast("double")), F.when(i % 5 == 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")), F.when(i % 4 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array().cast("array<double>"))),
    ))
    return table(spark, sf_dir, "events").select("event_id", config.problem(text).alias("problem"))


@query("J7_cache_lookup", "WITH c AS (SELECT event_id AS key, CASE WHEN event_id % 6 <> 0 THEN value END AS payload FROM events WHERE event_id % 3 = 0) SELECT e.event_id, CASE WHEN c.key IS NULL THEN 'computed' WHEN c.payload IS NULL THEN 'known reject' ELSE 'hit' END AS outcome, CASE WHEN c.key IS NULL THEN round(e.value * 2, 6) ELSE round(c.payload, 6) END AS payload FROM events e LEFT JOIN c ON c.key = e.event_id")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memoised join: rows without an entry are computed; an entry without a payload is a known non-match."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    cache = e.where("event_id % 3 = 0").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("payload"), F.lit(True).alias("known"))
    joined = e.join(cache, F.col("event_id") == F.col("key"), "left")
    outcome = F.when(F.col("known").isNull(), "computed").when(F.col("payload").isNull(), "known reject").otherwise("hit")
    return joined.select("event_id", outcome.alias("outcome"), F.round(F.when(F.col("known").isNull(), F.col("value") * 2).otherwise(F.col("payload")), 6).alias("payload"))


@query("K14_latest_wins", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS data FROM orders GROUP BY o_custkey")
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts into a table that is only appended to: the newest row of a key counts."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("data"))


@query("S16_signature_guard", "WITH s AS (SELECT user_id, sha256(string_agg(concat(event_id, ':', event_type), ',' ORDER BY event_id)) AS signature FROM events GROUP BY user_id) SELECT user_id AS session, signature, user_id % 2 = 0 AS valid FROM s")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache is read only where the signature of its inputs is unchanged."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda r: F.concat(r["event_id"].cast("string"), F.lit(":"), r["event_type"])), ",")
    now = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.sha2(listed, 256).alias("signature"))
    held = now.select("session", F.when(F.col("session") % 2 == 0, F.col("signature")).otherwise("stale").alias("held"))
    return now.join(held, "session").select("session", "signature", (F.col("signature") == F.col("held")).alias("valid"))


RUN = 1000


@query("S16_run_signatures", f"""WITH n AS (SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // {RUN} AS run FROM events), r AS (SELECT user_id, run, sha256(string_agg(concat(event_id, ':', event_type), ',' ORDER BY event_id)) AS h FROM n GROUP BY 1, 2),
s AS (SELECT user_id, sha256(string_agg(h, ',' ORDER BY run)) AS signature FROM r GROUP BY 1) SELECT user_id AS session, signature, user_id % 2 = 0 AS valid FROM s""")
def s16_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same guard for sessions of any length: runs of RUN rows are hashed, then their hashes in order."""
    joined = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda r: r[by[-1]]), ",")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type").alias("row"), F.floor((place - 1) / RUN).alias("run"))
    runs = rows.groupBy("user_id", "run").agg(F.sha2(joined("event_id", "row"), 256).alias("hash"))
    now = runs.groupBy(F.col("user_id").alias("session")).agg(F.sha2(joined("run", "hash"), 256).alias("signature"))
    held = F.when(F.col("session") % 2 == 0, F.col("signature")).otherwise("stale")
    return now.select("session", "signature", (F.col("signature") == held).alias("valid"))


@query("P12_parameters_to_row", "SELECT l_orderkey, l_linenumber, concat_ws(',', coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END, 0), 0, 0, coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, 0)) AS row FROM lineitem")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty parameters become zero, and the middle ones are not used."""
    held = F.array(F.when(F.col("l_quantity") > 10, F.col("l_quantity")), F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    filled = F.transform(held, lambda v, i: F.when(i.isin(1, 2), F.lit("0")).otherwise(F.when(v.isNull(), "0.0").otherwise(v.cast("string"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(filled, ",").alias("row"))


@query("K1_geotags")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and heading of each capture written as EXIF into a JPEG and read back."""
    from terraweft.sources import exif

    f = frames(spark, sf_dir).select("frame_id", "lat", "lon", "alt", F.coalesce("heading", F.lit(0.0)).alias("heading"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["frame_id"]].assign(content=[exif.tagged_jpeg(*r) for r in zip(b.lat, b.lon, b.alt, b.heading, strict=True)])

    return exif.positions(f.mapInPandas(run, "frame_id long, content binary"), "frame_id")


@query("F15_fence_shape", "SELECT s_suppkey AS s, s_suppkey % 4 = 1 AS crosses_itself FROM supplier")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences that cross themselves: an edge joined with the edges that are not its neighbours."""
    k = F.col("s_suppkey")
    crossed = k % 4 == 1
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = F.array(corner(F.lit(0), F.lit(0)), corner(F.when(crossed, 10).otherwise(10), F.when(crossed, 10).otherwise(0)), corner(F.lit(10), F.when(crossed, 0).otherwise(10)), corner(F.lit(0), F.lit(10)))
    e = table(spark, sf_dir, "supplier").withColumn("p", p).select(k.alias("s"), F.posexplode("p").alias("i", "a"), "p")
    e = e.select("s", "i", "a", F.element_at("p", (F.col("i") + 1) % 4 + 1).alias("b"))
    o = e.select("s", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    apart = e.join(o, "s").where("j > i + 1 and not (i = 0 and j = 3)")
    side = lambda p, q, r: F.signum((F.col(f"{q}.x") - F.col(f"{p}.x")) * (F.col(f"{r}.y") - F.col(f"{p}.y")) - (F.col(f"{q}.y") - F.col(f"{p}.y")) * (F.col(f"{r}.x") - F.col(f"{p}.x")))
    meets = (side("a", "b", "c") * side("a", "b", "d") <= 0) & (side("c", "d", "a") * side("c", "d", "b") <= 0)
    return apart.groupBy("s").agg(F.bool_or(meets).alias("crosses_itself"))
