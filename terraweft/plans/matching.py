"""Queries: retrieval, matching and graph operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.operators import graph, proximity, spanning
from terraweft.plans.catalog import query
from terraweft.plans.geometry import LOCAL_SQL
from terraweft.session import settle, split_join, table
from terraweft.sources.frames import EDGES_SQL, FRAMES_SQL, descriptors, edges, frames

WORDS = 16


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each descriptor's nearest word of the fixed vocabulary (the descriptors with feat_id below WORDS)."""
    d = descriptors(spark, sf_dir)
    words = d.where(F.col("feat_id") < WORDS).select(F.col("feat_id").alias("word"), F.col("desc").alias("centre"))
    gap = proximity.squared_gap(F.col("desc"), F.col("centre"))
    # The vocabulary has WORDS rows at most.
    return d.crossJoin(F.broadcast(words)).groupBy("image_id", "feat_id").agg(F.min(F.struct(F.round(gap, 9).alias("gap"), "word"))["word"].alias("word"))


WORDS_SQL = """d AS (SELECT vec_id % 40 AS image_id, vec_id AS feat_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT a.image_id, a.feat_id, w.feat_id AS word, round(list_sum(list_transform(list_zip(a.e, w.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS gap FROM d a, d w WHERE w.feat_id < 16),
assigned AS (SELECT image_id, feat_id, arg_min(word, (gap, word)) AS word FROM g GROUP BY 1, 2), hist AS (SELECT image_id, word, count(*) AS n FROM assigned GROUP BY 1, 2),
idf AS (SELECT word, ln((CAST(40 AS DOUBLE) + 1) / (1 + count(*))) + 1 AS idf FROM hist GROUP BY 1), w AS (SELECT image_id, word, n * idf AS w FROM hist JOIN idf USING (word)),
tfidf AS (SELECT image_id, word, sqrt(w / greatest(sum(w) OVER (PARTITION BY image_id), 1)) AS weight FROM w)"""


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("image_id", "word").agg(F.count("*").alias("n"))


@query("A5_word_histogram", f"WITH {WORDS_SQL} SELECT image_id, word, n FROM hist")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms(spark, sf_dir)


def weights(spark: SparkSession, sf_dir: str, images: int = 40) -> DataFrame:
    return weighted(histograms(spark, sf_dir), images)


def weighted(h: DataFrame, images: int) -> DataFrame:
    """Square roots of the share of each word's count times log((images + 1) / (1 + images with it)) + 1."""
    by_word, by_image = Window.partitionBy("word"), Window.partitionBy("image_id")
    idf = F.log((F.lit(float(images)) + 1) / (1 + F.count("*").over(by_word))) + 1
    w = h.withColumn("w", F.col("n") * idf)
    return w.select("image_id", "word", F.sqrt(F.col("w") / F.greatest(F.sum("w").over(by_image), F.lit(1.0))).alias("weight"))


@query("A4_tf_idf", f"WITH {WORDS_SQL} SELECT image_id, word, round(weight, 6) AS weight FROM tfidf")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query("J3_similar_images", f"WITH {WORDS_SQL}, s AS (SELECT a.image_id AS i, b.image_id AS j, round(sum(a.weight * b.weight), 6) AS s FROM tfidf a JOIN tfidf b USING (word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM s) SELECT i, j, s AS similarity FROM r WHERE rank <= 17 AND i <> j")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_images(weights(spark, sf_dir))


def similar_images(w: DataFrame) -> DataFrame:
    """The 17 most similar images of each, itself removed afterwards: dot products over shared words."""
    w = settle(w, "weights")
    a, b = w.select("word", F.col("image_id").alias("i"), F.col("weight").alias("x")), w.select("word", F.col("image_id").alias("j"), F.col("weight").alias("y"))
    s = a.join(b, "word").groupBy("i", "j").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "j"))
    return s.withColumn("rank", rank).where("rank <= 17 and i <> j").select("i", "j", "similarity")


@query("J4_ratio_matches", """WITH d AS (SELECT vec_id % 40 AS image_id, vec_id AS feat_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT a.image_id, a.feat_id, b.feat_id AS other, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS gap FROM d a JOIN d b ON b.image_id = (a.image_id + 1) % 40),
r AS (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY gap, other) AS rank FROM g)
SELECT a.image_id, a.feat_id, a.other FROM r a JOIN r b ON a.feat_id = b.feat_id AND a.rank = 1 AND b.rank = 2 WHERE a.gap < 0.95e0 * b.gap""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio_matches(descriptors(spark, sf_dir), 40)


def ratio_matches(d: DataFrame, images: int) -> DataFrame:
    """Matches between neighbouring images whose nearest is clearly nearer than the second nearest.

    Blocks of two images meet in tasks of bounded size, which leave what can be among the two nearest."""
    a = d.withColumn("to_image", (F.col("image_id") + 1) % images)
    b = d.select(F.col("image_id").alias("to_image"), F.col("feat_id").alias("other"), "desc")
    near = proximity.two_nearest(a, b, "to_image", ["image_id", "feat_id"], "other", "desc")
    ranked = near.select("image_id", "feat_id", "other", F.round(F.sqrt("gap2"), 9).alias("gap"))
    first_two = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("feat_id").orderBy("gap", "other"))).where("rank <= 2")
    pair = first_two.groupBy("image_id", "feat_id").agg(F.min(F.struct("gap", "other")).alias("a"), F.max("gap").alias("second"), F.count("*").alias("n"))
    return pair.where((F.col("n") == 2) & (F.col("a.gap") < 0.95 * F.col("second"))).select("image_id", "feat_id", F.col("a.other").alias("other"))


#: Most words of a vocabulary, most descriptors of an image that it is fitted to, and descriptors of an image at which images are added.
VOCABULARY, PER_IMAGE, FULL_IMAGE = 128, 50, 125


def image_count(d: DataFrame) -> int:
    """40 images, or more if those would be full: the images grow with the table."""
    return max(40, d.count() // FULL_IMAGE)


def image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors dealt over the images."""
    d = descriptors(spark, sf_dir)
    return d.withColumn("image_id", F.pmod("feat_id", F.lit(image_count(d))))


@query("J4_whole_matches", f"""WITH h AS (SELECT vec_id AS feat_id, CAST(embedding AS DOUBLE[]) AS e, greatest(40, count(*) OVER () // {FULL_IMAGE}) AS images FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), d AS (SELECT *, feat_id % images AS image_id FROM h),
g AS (SELECT a.image_id, a.feat_id, b.feat_id AS other, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS gap FROM d a JOIN d b ON b.image_id = (a.image_id + 1) % a.images),
r AS (SELECT *, row_number() OVER (PARTITION BY feat_id ORDER BY gap, other) AS rank FROM g)
SELECT a.image_id, a.feat_id, a.other FROM r a JOIN r b ON a.feat_id = b.feat_id AND a.rank = 1 AND b.rank = 2 WHERE a.gap < 0.95e0 * b.gap""")
def j4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with images of bounded size, so that the candidates grow with the table and not with its square."""
    d = descriptors(spark, sf_dir)
    images = image_count(d)
    return ratio_matches(d.withColumn("image_id", F.pmod("feat_id", F.lit(images))), images)


def vocabulary(d: DataFrame) -> DataFrame:
    """word, centre: k-means of at most PER_IMAGE seeded descriptors an image, written once."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = settle(seeded_sample(d), "sample").select(array_to_vector(F.col("desc").cast("array<double>")).alias("features"))
    n = sample.count()
    centres = KMeans(k=min(VOCABULARY, n), maxIter=30, tol=0.1, seed=0, initMode="k-means||").fit(sample).clusterCenters() if n > 1 else [r.features.toArray() for r in sample.collect()]
    return settle(d.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "word long, centre array<double>"), "centres")


def worded(d: DataFrame, words: DataFrame) -> DataFrame:
    """d with the nearest word of each descriptor, ties to the smaller one; words (VOCABULARY at most) become one row."""
    every = words.agg(F.collect_list(F.struct("word", "centre")).alias("_words"))
    gaps = F.transform("_words", lambda w: F.struct(F.round(proximity.squared_gap(F.col("desc"), w["centre"]), 9).alias("gap"), w["word"].alias("word")))
    return d.crossJoin(F.broadcast(every)).withColumn("word", F.array_min(gaps)["word"]).drop("_words")


@query("G6_vocabulary")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means words of a bounded sample, with all descriptors that are nearest to each."""
    d = image_descriptors(spark, sf_dir)
    words = vocabulary(d)
    found = worded(d, words).groupBy("word").agg(F.count("*").alias("members"), F.avg(F.col("desc")[0].cast("double")).alias("first_mean"))
    return words.join(found, "word", "left").select("word", F.coalesce("members", F.lit(0)).alias("members"), "first_mean", "centre")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms over the k-means vocabulary, of all descriptors."""
    d = image_descriptors(spark, sf_dir)
    return settle(worded(d, vocabulary(d)).groupBy("image_id", "word").agg(F.count("*").alias("n")), "counts")


@query("A5_whole_histogram")
def a5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(spark, sf_dir)


@query("A4_whole_tf_idf")
def a4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = word_counts(spark, sf_dir)
    return weighted(h, h.select("image_id").distinct().count()).withColumn("weight", F.round("weight", 6))


@query("J3_whole_similar_images")
def j3_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = word_counts(spark, sf_dir)
    return similar_images(weighted(h, h.select("image_id").distinct().count()))


def seeded_sample(d: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.sha2(F.concat_ws("|", F.col("feat_id").cast("string"), F.lit("0")), 256), "feat_id")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_IMAGE)


def sampled_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_sample(descriptors(spark, sf_dir))


@query("L8_seeded_sample", "SELECT image_id, feat_id FROM (SELECT vec_id % 40 AS image_id, vec_id AS feat_id, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY sha256(concat(vec_id, '|0')), vec_id) AS rank FROM embeddings) WHERE rank <= 50")
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_descriptors(spark, sf_dir).select("image_id", "feat_id")


# Smallest labels spread along the edges; a node that gets a smaller one passes it on in the next step.
REACH_SQL = """reach(node, component) USING KEY (node) AS (SELECT a, a FROM b GROUP BY a UNION
  SELECT b.b, min(r.component) FROM reach r JOIN b ON b.a = r.node JOIN recurring.reach o ON o.node = b.b WHERE r.component < o.component GROUP BY b.b)"""
COMPONENTS_SQL = f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), {REACH_SQL}, comp AS (SELECT node, component FROM reach)"""


@query("G1_connected_components", COMPONENTS_SQL + " SELECT node, component FROM comp")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(edges(spark, sf_dir))


@query("A8_largest_component", COMPONENTS_SQL + " SELECT node FROM comp WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning.largest_component(edges(spark, sf_dir))


@query("G5_supported_groups", COMPONENTS_SQL.replace("edges AS (", "every AS (").replace("b AS (SELECT src", "edges AS (SELECT * FROM every WHERE score >= 45), b AS (SELECT src") + " SELECT node, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY component HAVING count(*) >= 4)")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported_groups(edges(spark, sf_dir))


def supported_groups(e: DataFrame) -> DataFrame:
    """Components of the well supported edges, without islands of fewer than four."""
    parts = settle(graph.connected_components(e.where("score >= 45")), "supported")
    return parts.join(parts.groupBy("component").count().where("count >= 4").select("component"), "component", "left_semi").select("node", "component")


@query("A11_root_by_score", f"WITH {EDGES_SQL}, s AS (SELECT node, sum(score) AS total FROM (SELECT src AS node, score FROM edges UNION ALL SELECT dst, score FROM edges) GROUP BY node) SELECT node, CAST(total AS BIGINT) AS total FROM s ORDER BY total DESC, node LIMIT 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_by_score(edges(spark, sf_dir))


def root_by_score(e: DataFrame) -> DataFrame:
    total = e.select(F.col("src").alias("node"), "score").union(e.select("dst", "score")).groupBy("node").agg(F.sum("score").alias("total"))
    return total.orderBy(F.desc("total"), "node").limit(1)


@query("G2_spanning_forest")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning.spanning_forest(edges(spark, sf_dir))


@query("G2_forest_parts", COMPONENTS_SQL + " SELECT component, count(*) - 1 AS links FROM comp GROUP BY component")
def g2_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_parts(edges(spark, sf_dir))


def forest_parts(e: DataFrame) -> DataFrame:
    """A forest has one edge less than nodes in each component; the exact forest is tested against Kruskal's."""
    forest, parts = spanning.forest_and_parts(e)
    return forest.join(parts, F.col("src") == F.col("node")).groupBy("component").agg(F.count("*").alias("links"))


TRACKS_SQL = f"""WITH RECURSIVE b AS (SELECT l_partkey * 2 AS a, l_orderkey * 2 + 1 AS b FROM lineitem UNION SELECT l_orderkey * 2 + 1, l_partkey * 2 FROM lineitem), {REACH_SQL}
SELECT min(node) // 2 AS track, count(*) AS points FROM reach WHERE node % 2 = 0 GROUP BY component"""


@query("G4_tracks", TRACKS_SQL)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(table(spark, sf_dir, "lineitem"))


def tracks(l: DataFrame) -> DataFrame:
    """Union of observations that share a key: each point of a key is linked with the key's smallest one, without pairs
    within a group; keys are no nodes of their own. A track is named after its smallest point."""
    o = l.select("l_orderkey", F.col("l_partkey").alias("point")).where("l_orderkey is not null and point is not null")
    first = o.groupBy("l_orderkey").agg(F.min("point").alias("first"))
    links = settle(split_join(o, first, "l_orderkey").select("first", "point").distinct(), "links")
    parts = spanning.contracted_components(links.select(F.col("first").alias("src"), F.col("point").alias("dst")))
    points = links.select("point").distinct().join(parts, F.col("point") == F.col("node"), "left")
    return points.groupBy(F.coalesce("component", "point").alias("track")).agg(F.count("*").alias("points"))


@query("A10_track_filter", "SELECT l_partkey AS track, count(*) AS observations FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(*) = count(DISTINCT l_orderkey)")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks seen twice at least and never twice in one image."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    t = t.groupBy(F.col("l_partkey").alias("track")).agg(F.sum("n").alias("observations"), F.max("n").alias("most"))
    return t.where("observations >= 2 and most = 1").select("track", "observations")


@query("A9_observation_counts", "SELECT l_suppkey AS camera, count(*) AS observations, count(DISTINCT l_partkey) AS tracks FROM lineitem GROUP BY 1")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("camera")).agg(F.count("*").alias("observations"), F.countDistinct("l_partkey").alias("tracks"))


@query("A3_group_medians", "SELECT l_suppkey AS camera, round(quantile_cont(l_extendedprice, 0.5), 6) AS median FROM lineitem GROUP BY 1")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians, interpolated between the middle two."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("camera")).agg(F.round(F.percentile("l_extendedprice", 0.5), 6).alias("median"))


@query("F11_camera_quality", "SELECT l_suppkey AS camera FROM lineitem GROUP BY 1 HAVING count(*) >= 20 AND quantile_cont(CAST(round(l_discount * 1e6) AS BIGINT), 0.5) <= 50000 AND sum(CAST(round(l_tax * 1e6) AS BIGINT)) <= 40000 * count(l_tax)")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras with enough observations and small median and mean errors, in whole millionths: a mean that is the limit
    itself is small enough, in whatever order it is summed."""
    millionths = lambda c: F.round(F.col(c) * 1e6).cast("long")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("camera"))
    c = l.agg(F.count("*").alias("n"), F.percentile(millionths("l_discount"), 0.5).alias("error"), F.sum(millionths("l_tax")).alias("tilt"), F.count("l_tax").alias("tilts"))
    return c.where("n >= 20 and error <= 50000 and tilt <= 40000 * tilts").select("camera")


@query("F13_valid_observations", "WITH o AS (SELECT * FROM lineitem WHERE l_quantity > 1 AND l_extendedprice < 50000), k AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS left_over FROM o) SELECT l_orderkey, l_linenumber FROM k WHERE left_over >= 2")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in front of the camera and near enough whose track still has two."""
    o = table(spark, sf_dir, "lineitem").where("l_quantity > 1 and l_extendedprice < 50000")
    return o.withColumn("left_over", F.count("*").over(Window.partitionBy("l_partkey"))).where("left_over >= 2").select("l_orderkey", "l_linenumber")


@query("F10_match_quality", """WITH m AS (SELECT l_suppkey AS i, l_partkey % 20 AS j, count(*) AS matches, count(*) FILTER (l_discount <= 0.05) AS inliers, quantile_cont(l_tax, 0.5) AS back FROM lineitem GROUP BY 1, 2)
SELECT i, j, matches, inliers FROM m WHERE matches >= 20 AND inliers >= 18 AND inliers >= 0.35 * matches AND back <= 0.04""")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 20).alias("j"))
    m = l.agg(F.count("*").alias("matches"), F.count_if(F.col("l_discount") <= 0.05).alias("inliers"), F.percentile("l_tax", 0.5).alias("back"))
    return m.where("matches >= 20 and inliers >= 18 and inliers >= 0.35 * matches and back <= 0.04").select("i", "j", "matches", "inliers")


def hull(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull of points (monotone chain)."""
    p = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(p) < 3:
        return p

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return half(p)[:-1] + half(p[::-1])[:-1]


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of points (shoelace)."""
    a = np.array(hull(x, y))
    if len(a) < 3:
        return 0.0
    return float(abs(np.dot(a[:, 0], np.roll(a[:, 1], -1)) - np.dot(a[:, 1], np.roll(a[:, 0], -1))) / 2)


def extreme_points(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Of each group, the hull's corners of every batch of rows, taken where the rows are read."""
    rows = df.select(*group, x, y)

    def run(batches):
        for b in batches:
            kept = [(*(k if isinstance(k, tuple) else (k,)), *p) for k, g in b.groupby(group, dropna=False, sort=False) for p in hull(g[x].to_numpy(), g[y].to_numpy())]
            yield pd.DataFrame(kept, columns=[*group, x, y])

    return rows.mapInPandas(run, rows.schema)


def hull_areas(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Hull area of each group's points: the hull of the hulls of batches, so that only extreme points travel."""

    @F.pandas_udf("double")
    def area(px: pd.Series, py: pd.Series) -> float:
        return hull_area(px.to_numpy(), py.to_numpy())

    return extreme_points(df, group, x, y).groupBy(*group).agg(area(x, y).alias("area"))


@query("G3_hull_area", f"""WITH {LOCAL_SQL}, c AS (SELECT DISTINCT session, east AS x, north AS y FROM placed),
o AS (SELECT a.session, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) AS side, (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) AS beyond FROM c a JOIN c b ON a.session = b.session AND (a.x, a.y) <> (b.x, b.y) JOIN c p ON p.session = a.session),
e AS (SELECT session, ax, ay, bx, "by" FROM o GROUP BY ALL HAVING bool_and(side > 1e-6 OR (abs(side) <= 1e-6 AND beyond <= 1e-6))), s AS (SELECT DISTINCT session FROM c)
SELECT s.session, round(coalesce(sum(ax * "by" - bx * ay), 0) / 2, 4) AS area FROM s LEFT JOIN e USING (session) GROUP BY s.session""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the hull of each session's captures; its SQL keeps the pairs that have all others on their left."""
    from terraweft.plans.geometry import placed

    return hull_areas(placed(spark, sf_dir), ["session"], "east", "north").withColumn("area", F.round("area", 4))


@query("R8_wide_views", f"WITH {FRAMES_SQL}, b AS (SELECT session, (max(lat) - min(lat)) * (max(lon) - min(lon)) * 1e6 AS box FROM frames GROUP BY session) SELECT session FROM b WHERE box >= 0.3 * 4 * 0.5625e0 * 1.5")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views whose support covers three tenths of their frame."""
    b = frames(spark, sf_dir).groupBy("session").agg(((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon")) * 1e6).alias("box"))
    return b.where(F.col("box") >= 0.3 * 4 * 0.5625 * 1.5).select("session")
