"""Queries: pixels and map cells. Images are the embeddings, eight by eight; captures cover a map of ten-metre cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweft.operators import raster
from terraweft.plans.catalog import query
from terraweft.plans.geometry import LOCAL_SQL, num, placed
from terraweft.session import dealt, settle, table
from terraweft.sources.frames import AREA

SIDE, CELL = 8, 10.0
CORNER = raster.canvas(AREA, CELL, 10.0)
WEST, NORTH, COLUMNS, ROWS = CORNER


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "x"))
    return e.select("image", F.floor(F.col("p") / SIDE).cast("int").alias("row"), (F.col("p") % SIDE).cast("int").alias("col"), (F.floor(F.abs(F.col("x").cast("double")) * 1000) % 256).cast("double").alias("value"))


PIXELS_SQL = "pixels AS (SELECT vec_id AS image, (p - 1) // 8 AS row, (p - 1) % 8 AS col, CAST(floor(abs(CAST(embedding[p] AS DOUBLE)) * 1000) AS BIGINT) % 256 * 1e0 AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))"


@query("P11_side_crop", f"WITH {PIXELS_SQL} SELECT image, CAST(row AS INTEGER) AS row, CAST(col - 1 AS INTEGER) AS col, value FROM pixels WHERE col BETWEEN 1 AND 6")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cropped(pixels(spark, sf_dir), SIDE, 0.125)


@query("S7_pixel_formats", f"""WITH {PIXELS_SQL}, q AS (SELECT image, row, list(value ORDER BY col) AS v FROM pixels GROUP BY image, row), m AS (SELECT *, ['L', 'RGB', 'RGBA', 'BGR', 'BGRA', 'HSV'][image % 6 + 1] AS mode FROM q)
SELECT image, CAST(row AS INTEGER) AS row, CASE WHEN mode = 'L' THEN v[1] WHEN mode IN ('RGB', 'RGBA') THEN v[3] WHEN mode <> 'HSV' THEN v[1] END AS b, CASE WHEN mode = 'L' THEN v[1] WHEN mode <> 'HSV' THEN v[2] END AS g, CASE WHEN mode IN ('L', 'RGB', 'RGBA') THEN v[1] WHEN mode <> 'HSV' THEN v[3] END AS r FROM m""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pixel of each row, in six formats of which one is unknown."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"])
    rows = pixels(spark, sf_dir).groupBy("image", "row").agg(v.alias("v"))
    mode = F.element_at(F.array(*map(F.lit, ("L", "RGB", "RGBA", "BGR", "BGRA", "HSV"))), (F.col("image") % 6 + 1).cast("int"))
    rows = rows.withColumn("bgr", raster.to_bgr(mode, F.col("v")))
    return rows.select("image", "row", *(F.col("bgr")[i].alias(n) for i, n in enumerate("bgr")))


_R2 = "pow((col - 4e0) / 4, 2) + pow((row - 4e0) / 4, 2)"


@query("R1_lens_and_vignette", f"""WITH {PIXELS_SQL}, g AS (SELECT image, row, col, least(255, value / greatest(1 - 0.3e0 * least({_R2}, 1.96e0), 0.1e0)) AS value FROM pixels), x AS (SELECT *, (col - 4e0) / 6.8e0 AS x, (row - 4e0) / 6.8e0 AS y FROM g), s AS (SELECT *, 1 + -0.12e0 * (x * x + y * y) + 0.02e0 * (x * x + y * y) * (x * x + y * y) AS k FROM x),
w AS (SELECT image, row, col, CAST(greatest(0, least(7, floor(x * k * 6.8e0 + 4.5e0))) AS BIGINT) AS c, CAST(greatest(0, least(7, floor(y * k * 6.8e0 + 4.5e0))) AS BIGINT) AS r FROM s) SELECT w.image, CAST(w.row AS INTEGER) AS row, CAST(w.col AS INTEGER) AS col, round(g.value, 6) AS value FROM w JOIN g ON g.image = w.image AND g.row = w.r AND g.col = w.c""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vignetting undone, then the lens."""
    gain = F.greatest(raster.vignette(F.col("row"), F.col("col"), SIDE, SIDE, 0.3), F.lit(0.1))
    p = pixels(spark, sf_dir).withColumn("value", F.least(F.lit(255.0), F.col("value") / gain))
    return raster.undistorted(p, "image", SIDE, SIDE, -0.12, 0.02).withColumn("value", F.round("value", 6))


_STEPS = ", ".join(f"t{k + 1} AS (SELECT row_to, col_to, x0, y0, x0 / s AS x, y0 / s AS y FROM (SELECT *, 1 + -0.12e0 * r2 + 0.02e0 * r2 * r2 AS s FROM (SELECT *, x * x + y * y AS r2 FROM t{k})))" for k in range(5))
_TAP = "SELECT row_to, col_to, r0 + {r} AS row, c0 + {c} AS col, {fr} * {fc} AS share FROM u"
_TAPS = " UNION ALL ".join(_TAP.format(r=r, c=c, fr="fr" if r else "(1 - fr)", fc="fc" if c else "(1 - fc)") for r in (0, 1) for c in (0, 1))


@query("S11_frame_read", f"""WITH {PIXELS_SQL}, cut AS (SELECT image, row, col - 1 AS col, value FROM pixels WHERE col BETWEEN 1 AND 6),
e AS (SELECT image, row, col, floor(greatest(0, least(255, value / greatest(1 - 0.3e0 * least(pow((col + 1 - 4e0) / 4, 2) + pow((row - 4e0) / 4, 2), 1.96e0), 0.1e0)))) AS value FROM cut),
t0 AS (SELECT r AS row_to, c AS col_to, (c - 3e0) / 6.8e0 AS x0, (r - 4e0) / 6.8e0 AS y0, x0 AS x, y0 AS y FROM range(8) a(r), range(6) b(c)), {_STEPS},
u AS (SELECT row_to, col_to, floor(c) AS c0, floor(r) AS r0, c - floor(c) AS fc, r - floor(r) AS fr FROM (SELECT *, greatest(0e0, least(5e0, x * 6.8e0 + 3)) AS c, greatest(0e0, least(7e0, y * 6.8e0 + 4)) AS r FROM t5)),
taps AS (SELECT * FROM ({_TAPS}) WHERE share > 0)
SELECT 'none' AS profile, image, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, value FROM cut
UNION ALL SELECT 'synthetic', image, CAST(row_to AS INTEGER), CAST(col_to AS INTEGER), round(sum(share * value), 4) FROM e JOIN taps ON e.row = taps.row AND e.col = taps.col GROUP BY image, row_to, col_to""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of six of eight columns as they are, and corrected by the profile of their camera."""
    cut = raster.cropped(pixels(spark, sf_dir), SIDE, 0.125)
    read = lambda p: raster.read_frames(cut, "image", SIDE, 6, p, 0.75).withColumn("value", F.round("value", 4)).withColumn("profile", F.lit(p))
    return read("none").unionByName(read("synthetic"))


_U = "(CAST(('0x' || substr(sha256(concat_ws('|', '7', '{k}', image, row, col)), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0"


@query("R15_degraded_camera", f"""WITH {PIXELS_SQL}, v AS (SELECT image, row, col, value * (1 - 0.3e0 * least({_R2}, 1.96e0)) AS value FROM pixels), n AS (SELECT *, sqrt(-2 * ln({_U.format(k='u')})) * cos(2 * 3.141592653589793e0 * {_U.format(k='v')}) * 4e0 AS noise FROM v)
SELECT image, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(greatest(0, least(255, value + noise)), 5) AS value FROM n""")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vignetting and seeded sensor noise."""
    p = pixels(spark, sf_dir).withColumn("value", F.col("value") * raster.vignette(F.col("row"), F.col("col"), SIDE, SIDE, 0.3))
    return raster.noisy(p, "image", 7, 4.0).withColumn("value", F.round("value", 5))


@query("K3_dual_write", f"""WITH {PIXELS_SQL}, v AS (SELECT *, value * (1 - 0.3e0 * least({_R2}, 1.96e0)) + sqrt(-2 * ln({_U.format(k='u')})) * cos(2 * 3.141592653589793e0 * {_U.format(k='v')}) * 4e0 AS seen FROM pixels)
SELECT image, count(*) AS pixels, CAST(sum(value) AS BIGINT) AS clean, CAST(sum(floor(greatest(0, least(255, seen)))) AS BIGINT) AS degraded FROM v GROUP BY image""")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture written twice, as its camera would degrade it and clean, and both read back."""
    import uuid

    from terraweft.session import shared_folder
    from terraweft.sources import sinks

    clean = settle(pixels(spark, sf_dir), "frames")
    dark = clean.withColumn("value", F.col("value") * raster.vignette(F.col("row"), F.col("col"), SIDE, SIDE, 0.3))
    folder = f"{shared_folder(spark)}/terraweft/capture-{uuid.uuid4().hex}"
    sinks.dual_write(raster.noisy(dark, "image", 7, 4.0), clean, folder)
    whole = lambda kind, name: spark.read.parquet(f"{folder}/{kind}").groupBy("image").agg(F.count("*").alias(f"n_{name}"), F.sum(F.floor("value")).alias(name))
    both = whole("images", "degraded").join(whole("mosaic_images", "clean"), "image").where("n_degraded = n_clean")
    return both.select("image", F.col("n_clean").alias("pixels"), "clean", "degraded")


@query("R3_placement", f"""WITH {LOCAL_SQL}, s AS (SELECT frame_id, 2 * alt * tan(radians(114.6e0) / 2) / (1024 / 0.8e0) * 2 AS s, (east - {num(WEST)}) * 2 AS c, ({num(NORTH)} - north) * 2 AS r, radians(coalesce(heading, 0)) AS t FROM placed)
SELECT frame_id, round(s * cos(t), 6) AS a, round(-s * sin(t), 6) AS b, round(c - s * cos(t) * 512 + s * sin(t) * 360, 6) AS tx, round(s * sin(t), 6) AS d, round(s * cos(t), 6) AS e, round(r - s * sin(t) * 512 - s * cos(t) * 360, 6) AS ty FROM s""")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six coefficients that place an image of 1024 by 720 on a map of two cells a metre, turned by its heading."""
    from terraweft.functions.geo import ground_width

    s = ground_width(F.col("alt"), 114.6) / F.lit(1024 / 0.8) * 2
    t = F.radians(F.coalesce("heading", F.lit(0.0)))
    c, r = (F.col("east") - WEST) * 2, (NORTH - F.col("north")) * 2
    cos, sin = s * F.cos(t), s * F.sin(t)
    out = {"a": cos, "b": -sin, "tx": c - cos * 512 + sin * 360, "d": sin, "e": cos, "ty": r - sin * 512 - cos * 360}
    return placed(spark, sf_dir).select("frame_id", *(F.round(v, 6).alias(k) for k, v in out.items()))


CELLS_SQL = f"""{LOCAL_SQL}, cells AS (SELECT session, frame_id, alt, row, col, round(1 / (1 + (pow({num(WEST)} + (col + 0.5e0) * 10 - east, 2) + pow({num(NORTH)} - (row + 0.5e0) * 10 - north, 2)) / pow(alt * 0.6e0, 2)), 9) AS weight, CAST((frame_id * 31 + row * 7 + col * 3) % 256 AS DOUBLE) AS value
  FROM placed, (SELECT unnest(range(0, {ROWS})) AS row), (SELECT unnest(range(0, {COLUMNS})) AS col)
  WHERE (pow({num(WEST)} + (col + 0.5e0) * 10 - east, 2) + pow({num(NORTH)} - (row + 0.5e0) * 10 - north, 2)) / (alt * 0.6e0 * (alt * 0.6e0)) <= 1)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map cells that each capture sees, with a weight that falls from its centre and a brightness; dealt by session."""
    views = dealt(placed(spark, sf_dir).select("session", "frame_id", "alt", "east", "north"), "session")
    seen = raster.footprint(views, CORNER, CELL, F.col("alt") * 0.6)
    value = ((F.col("frame_id") * 31 + F.col("row") * 7 + F.col("col") * 3) % 256).cast("double")
    return seen.select("session", "frame_id", "alt", "row", "col", F.round(1 / (1 + F.col("gap2")), 9).alias("weight"), value.alias("value"))


@query("A1_best_view", f"WITH {CELLS_SQL} SELECT session, row, col, arg_max(frame_id, (weight, -frame_id)) AS frame_id, max(weight) AS weight, count(*) AS views FROM cells GROUP BY session, row, col")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.best_view(cells(spark, sf_dir), ["session", "row", "col"], "frame_id")


@query("A2_label_counts", f"WITH {CELLS_SQL}, b AS (SELECT session, row, col, arg_max(frame_id, (weight, -frame_id)) AS frame_id FROM cells GROUP BY session, row, col) SELECT frame_id, count(*) AS cells FROM b GROUP BY frame_id HAVING count(*) >= {max(4, min(400, ROWS * COLUMNS // 1000))}")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that own enough cells."""
    owned = raster.best_view(cells(spark, sf_dir), ["session", "row", "col"], "frame_id")
    return owned.groupBy("frame_id").agg(F.count("*").alias("cells")).where(F.col("cells") >= max(4, min(400, ROWS * COLUMNS // 1000)))


@query("A7_coverage", f"WITH {CELLS_SQL} SELECT session, round(count(DISTINCT row * 1000 + col) / {ROWS * COLUMNS}e0, 9) AS coverage FROM cells GROUP BY session")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = cells(spark, sf_dir).select("session", "row", "col").distinct()
    return seen.groupBy("session").agg(F.round(F.count("*") / float(ROWS * COLUMNS), 9).alias("coverage"))


@query("A6_disagreement", f"WITH {CELLS_SQL} SELECT session, row, col, count(*) AS views FROM cells GROUP BY session, row, col HAVING count(*) * sum(value * value) - sum(value) * sum(value) > 484e0 * count(*) * count(*) AND count(*) >= 3")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.disagreeing(cells(spark, sf_dir), ["session", "row", "col"], 22.0**2, 3).select("session", "row", "col", "views")


@query("R12_feathered_map", f"WITH {CELLS_SQL} SELECT session, row, col, round(sum(weight * value) / sum(weight), 6) AS value, count(*) AS views FROM cells GROUP BY session, row, col")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.feathered(cells(spark, sf_dir), ["session", "row", "col"]).withColumn("value", F.round("value", 6))


@query("R11_exposure_gains", f"WITH {CELLS_SQL}, m AS (SELECT *, avg(value) OVER (PARTITION BY session, row, col) AS m FROM cells) SELECT session, frame_id, round(sum(m) / greatest(sum(value), 1e-9), 6) AS gain FROM m GROUP BY session, frame_id")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.gains(cells(spark, sf_dir), "session", "frame_id", ["row", "col"]).withColumn("gain", F.round("gain", 6))


REGION_SQL = f"WITH RECURSIVE {CELLS_SQL}, d AS (SELECT session, row, col FROM cells GROUP BY session, row, col HAVING count(*) * sum(value * value) - sum(value) * sum(value) > 7000e0 * count(*) * count(*) AND count(*) >= 3), reach(session, row, col, r2, c2) AS (SELECT session, row, col, row, col FROM d UNION SELECT r.session, r.row, r.col, d.row, d.col FROM reach r JOIN d ON d.session = r.session AND abs(d.row - r.r2) <= 1 AND abs(d.col - r.c2) <= 1), reg AS (SELECT session, row, col, min(r2 * {COLUMNS} + c2) AS region FROM reach GROUP BY session, row, col)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = raster.disagreeing(cells(spark, sf_dir), ["session", "row", "col"], 7000.0, 3)
    return raster.cell_regions(strong, "session", COLUMNS, ROWS)


@query("R13_disagreeing_regions", REGION_SQL + " SELECT session, region, count(*) AS cells, min(row) AS top, max(row) AS bottom, min(col) AS west, max(col) AS east FROM reg GROUP BY session, region HAVING count(*) >= 2")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of strongly disagreeing cells, with their boxes."""
    r = regions(spark, sf_dir).withColumn("region", F.col("region") % (1 << 32))
    box = r.groupBy("session", "region").agg(F.count("*").alias("cells"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("west"), F.max("col").alias("east"))
    return box.where("cells >= 2")


@query("J13_region_owner", REGION_SQL + f""", n AS (SELECT session, region, count(*) AS n, avg(row) AS cr, avg(col) AS cc FROM reg GROUP BY session, region HAVING count(*) >= 2), o AS (SELECT reg.session, region, frame_id, count(*) AS seen FROM reg JOIN cells USING (session, row, col) GROUP BY reg.session, region, frame_id),
f AS (SELECT o.*, n, round(seen * 1e0 / n * exp(-2 * (pow({num(WEST)} + (cc + 0.5e0) * 10 - east, 2) + pow({num(NORTH)} - (cr + 0.5e0) * 10 - north, 2)) / pow(alt, 2)), 9) AS score FROM o JOIN n USING (session, region) JOIN placed USING (session, frame_id) WHERE seen >= 0.98e0 * n) SELECT session, region, arg_max(frame_id, (score, -frame_id)) AS frame_id FROM f GROUP BY session, region""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one capture that covers nearly all of a region and looks at it most centrally."""
    reg = settle(regions(spark, sf_dir), "regions")
    size = reg.groupBy("session", "region").agg(F.count("*").alias("n"), F.avg("row").alias("cr"), F.avg("col").alias("cc")).where("n >= 2")
    seen = reg.join(cells(spark, sf_dir), ["session", "row", "col"]).groupBy("session", "region", "frame_id").agg(F.count("*").alias("seen"))
    full = seen.join(size, ["session", "region"]).where("seen >= 0.98D * n").join(placed(spark, sf_dir).select("session", "frame_id", "east", "north", "alt"), ["session", "frame_id"])
    de, dn = WEST + (F.col("cc") + 0.5) * CELL - F.col("east"), NORTH - (F.col("cr") + 0.5) * CELL - F.col("north")
    score = F.round(F.col("seen") / F.col("n") * F.exp(-2 * (de * de + dn * dn) / (F.col("alt") * F.col("alt"))), 9)
    best = full.withColumn("score", score).groupBy("session", "region").agg(F.max(F.struct("score", (-F.col("frame_id")).alias("f"))).alias("b"))
    return best.select("session", (F.col("region") % (1 << 32)).alias("region"), (-F.col("b.f")).alias("frame_id"))


@query("R10_block_size", f"WITH {LOCAL_SQL}, n AS (SELECT session, count(*) AS n FROM placed GROUP BY session), b AS (SELECT session, n, 32 * (1 << k) AS size FROM n, (SELECT unnest(range(0, 12)) AS k) WHERE n * ceil(720e0 / (32 * (1 << k))) * ceil(1024e0 / (32 * (1 << k))) <= greatest(2048, n)) SELECT session, min(size) AS size FROM b GROUP BY session")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest block, doubling from 32, that keeps the exposure system within its budget."""
    sizes = F.array(*(F.lit(32 << k).cast("long") for k in range(12)))
    n = placed(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"))
    fits = F.filter(sizes, lambda s: F.col("n") * F.ceil(720 / s) * F.ceil(1024 / s) <= F.greatest(F.lit(2048), F.col("n")))
    return n.select("session", F.array_min(fits).alias("size"))


@query("F12_plausible_footprints", f"WITH {LOCAL_SQL}, q AS (SELECT frame_id, 1 + east * 1e-3 * (frame_id % 5 - 2) AS d1, 1 + north * 1e-3 * (frame_id % 7 - 3) AS d2, alt FROM placed) SELECT frame_id FROM q WHERE d1 * d2 > 0 AND least(abs(d1), abs(d2)) / greatest(abs(d1), abs(d2)) >= 0.25 AND abs(d1 * d2) BETWEEN 0.2 AND 2.5")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements whose perspective keeps its sign and does not stretch too far."""
    p = placed(spark, sf_dir)
    a, b = 1 + F.col("east") * 1e-3 * (F.col("frame_id") % 5 - 2), 1 + F.col("north") * 1e-3 * (F.col("frame_id") % 7 - 3)
    fine = (a * b > 0) & (F.least(F.abs(a), F.abs(b)) / F.greatest(F.abs(a), F.abs(b)) >= 0.25) & F.abs(a * b).between(0.2, 2.5)
    return p.where(fine).select("frame_id")
