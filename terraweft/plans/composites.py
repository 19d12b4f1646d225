"""Queries: views warped onto a map, support masks, regions with their holes closed, and blending by bands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.operators import compositing, orthomosaic, raster, seams
from terraweft.plans.catalog import query
from terraweft.plans.geometry import num
from terraweft.plans.rasters import CELLS_SQL, COLUMNS, PIXELS_SQL, ROWS, SIDE, cells, pixels
from terraweft.session import settle, table

#: Side of the map that the images are turned onto, and of the grid of the support polygons.
MAP, GRID = 32, 24


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view, image, h: each image twice its size about the map's middle, turned, and tilted a little."""
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(i.alias("view"), i.alias("image"), F.radians((i * 37 % 360).cast("double")).alias("t"), ((i % 5 - 2) * F.lit(0.004)).alias("g"), ((i % 7 - 3) * F.lit(0.004)).alias("k"))
    cos, sin, g, k, mid = 2 * F.cos("t"), 2 * F.sin("t"), F.col("g"), F.col("k"), MAP / 2
    last = 1 - 4 * g - 4 * k
    h = [cos + mid * g, -sin + mid * k, -4 * (cos - sin) + mid * last, sin + mid * g, cos + mid * k, -4 * (sin + cos) + mid * last, g, k, last]
    return e.select("view", "image", F.array(*h).alias("h"))


_IN = "r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7"
WARP_SQL = f"""{PIXELS_SQL}, p0 AS (SELECT vec_id AS view, radians(CAST(vec_id * 37 % 360 AS DOUBLE)) AS t, (vec_id % 5 - 2) * 0.004e0 AS g, (vec_id % 7 - 3) * 0.004e0 AS k FROM embeddings WHERE len(embedding) = 64),
h AS (SELECT view, 2 * cos(t) + 16 * g AS a, -2 * sin(t) + 16 * k AS b, -4 * (2 * cos(t) - 2 * sin(t)) + 16 * (1 - 4 * g - 4 * k) AS c, 2 * sin(t) + 16 * g AS d, 2 * cos(t) + 16 * k AS e, -4 * (2 * sin(t) + 2 * cos(t)) + 16 * (1 - 4 * g - 4 * k) AS f, g, k, 1 - 4 * g - 4 * k AS i FROM p0),
xy AS (SELECT view, y AS "row", x AS col, ((e * i - f * k) * x + (c * k - b * i) * y + (b * f - c * e)) / ((d * k - e * g) * x + (b * g - a * k) * y + (a * e - b * d)) AS sx, ((f * g - d * i) * x + (a * i - c * g) * y + (c * d - a * f)) / ((d * k - e * g) * x + (b * g - a * k) * y + (a * e - b * d)) AS sy
  FROM h, (SELECT unnest(range(0, {MAP})) AS x), (SELECT unnest(range(0, {MAP})) AS y)),
tap AS (SELECT view, "row", col, CAST(floor(sy) AS BIGINT) + dr AS r, CAST(floor(sx) AS BIGINT) + dc AS c, (CASE WHEN dr = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dc = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS share
  FROM xy, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS q(dr, dc) WHERE sx > -1 AND sx < 8 AND sy > -1 AND sy < 8),
warped AS (SELECT view, tap."row", tap.col, sum(share * value) AS value, sum(CASE WHEN r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6 THEN share / (1 + (pow(c - 4e0, 2) + pow(r - 4e0, 2)) / 16) ELSE 0 END) AS weight
  FROM tap JOIN pixels ON image = view AND pixels.row = least(7, greatest(0, r)) AND pixels.col = least(7, greatest(0, c)) GROUP BY 1, 2, 3 HAVING sum(CASE WHEN {_IN} THEN share ELSE 0 END) >= 0.999e0)"""


def on_map(spark: SparkSession, sf_dir: str, tile: int = 4) -> DataFrame:
    return compositing.warped(pixels(spark, sf_dir), tilted(spark, sf_dir), SIDE, SIDE, MAP, MAP, tile=tile)


@query("R4_projective_warp", f"WITH {WARP_SQL} SELECT view, CAST(\"row\" AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col, round(value, 6) AS value, round(weight, 6) AS weight FROM warped")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image on the map under its own homography, bilinearly, where the frame covers a cell."""
    return on_map(spark, sf_dir).select("view", "row", "col", F.round("value", 6).alias("value"), F.round("weight", 6).alias("weight"))


_CORNERS = [(math.cos(k * math.pi / 4), math.sin(k * math.pi / 4)) for k in range(8)]


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, xs, ys: a polygon of eight corners for each vector, as far out as its first components are large: mostly concave."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and size(embedding) >= 8")
    far = lambda k: 2 + 9 * F.least(F.lit(1.0), F.abs(F.col("embedding")[k].cast("double")) * 4)
    corner = lambda n: F.array(*(GRID / 2 + far(k) * F.lit(c[n]) for k, c in enumerate(_CORNERS)))
    return e.select(F.col("vec_id").alias("id"), corner(0).alias("xs"), corner(1).alias("ys"))


_FAR = "(2 + 9 * least(1e0, abs(CAST(embedding[{k}] AS DOUBLE)) * 4))"
_POINT = ", ".join(f"({k}, {GRID / 2}e0 + {_FAR.format(k=k + 1)} * {num(x)}, {GRID / 2}e0 + {_FAR.format(k=k + 1)} * {num(y)})" for k, (x, y) in enumerate(_CORNERS))
OUTLINE_SQL = f"""v AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 8), corner AS (SELECT id, p.k, p.x, p.y FROM v, LATERAL (SELECT * FROM (VALUES {_POINT}) AS c(k, x, y)) AS p),
edge AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON b.id = a.id AND b.k = (a.k + 1) % 8),
held AS (SELECT id, r, c FROM edge, (SELECT unnest(range(0, {GRID})) AS r), (SELECT unnest(range(0, {GRID})) AS c) WHERE (y1 > r) <> (y2 > r) AND c < x1 + (r - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, r, c HAVING count(*) % 2 = 1)"""


@query("R6_support_mask", f"WITH {OUTLINE_SQL} SELECT DISTINCT id, CAST(r + dr AS INTEGER) AS \"row\", CAST(c + dc AS INTEGER) AS col FROM held, (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc) WHERE r + dr BETWEEN 0 AND {GRID - 1} AND c + dc BETWEEN 0 AND {GRID - 1}")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each support polygon, grown by one cell on all sides, by scan lines."""
    runs = compositing.polygon_spans(outlines(spark, sf_dir), grow=1)
    return compositing.span_cells(runs, ["id", "row"], GRID, GRID)


@query("R6_supported_tiles", f"WITH {WARP_SQL}, {OUTLINE_SQL}, mask AS (SELECT DISTINCT id, r + dr + 4 AS \"row\", c + dc + 4 AS col FROM held, (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc)) SELECT view, count(*) AS cells, round(sum(value), 4) AS value FROM warped JOIN mask ON id = view AND mask.\"row\" = warped.\"row\" AND mask.col = warped.col WHERE weight > 0.025 GROUP BY view")
def r6_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compositing pass loads of each view: warped cells that weigh enough and that its support polygon holds."""
    runs = compositing.polygon_spans(outlines(spark, sf_dir), grow=1)
    runs = runs.select("id", (F.col("row") + 4).alias("row"), (F.col("first") + 4).alias("first"), (F.col("last") + 4).alias("last"))
    held = compositing.supported(on_map(spark, sf_dir).where("weight > 0.025"), runs, "view")
    return held.groupBy("view").agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("value"))


_ELLIPSE = ", ".join(map(str, compositing.ELLIPSE))
_DUE = " + ".join(f"CAST(row + {r} BETWEEN 0 AND {ROWS - 1} AND col + {c} BETWEEN 0 AND {COLUMNS - 1} AS INTEGER)" for r, c in compositing.ELLIPSE)
MORPH_SQL = f"""WITH RECURSIVE {CELLS_SQL}, d AS (SELECT session, row, col FROM cells GROUP BY session, row, col HAVING var_pop(value) > 7000 AND count(*) >= 3),
el(dr, dc) AS (VALUES {_ELLIPSE}), g AS (SELECT DISTINCT session, row + dr AS row, col + dc AS col FROM d, el WHERE row + dr BETWEEN 0 AND {ROWS - 1} AND col + dc BETWEEN 0 AND {COLUMNS - 1}),
e AS (SELECT session, row, col FROM (SELECT session, row + dr AS row, col + dc AS col, count(*) AS n FROM g, el GROUP BY 1, 2, 3) WHERE row BETWEEN 0 AND {ROWS - 1} AND col BETWEEN 0 AND {COLUMNS - 1} AND n = {_DUE}),
s AS (SELECT DISTINCT session FROM e), back AS (SELECT session, r AS row, c AS col FROM s, (SELECT unnest(range(-1, {ROWS + 1})) AS r), (SELECT unnest(range(-1, {COLUMNS + 1})) AS c) EXCEPT SELECT session, row, col FROM e),
outside(session, row, col) AS (SELECT session, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM s UNION SELECT b.session, b.row, b.col FROM outside o JOIN back b ON b.session = o.session AND abs(b.row - o.row) + abs(b.col - o.col) = 1),
full_ AS (SELECT session, r AS row, c AS col FROM s, (SELECT unnest(range(0, {ROWS})) AS r), (SELECT unnest(range(0, {COLUMNS})) AS c) EXCEPT SELECT session, row, col FROM outside),
w AS (SELECT DISTINCT session, row + dr AS row, col + dc AS col FROM full_, (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc) WHERE row + dr BETWEEN 0 AND {ROWS - 1} AND col + dc BETWEEN 0 AND {COLUMNS - 1}),
lab(session, row, col, region) USING KEY (session, row, col) AS (SELECT session, row, col, row * {COLUMNS} + col FROM w UNION SELECT l.session, l.row, l.col, min(o.region) FROM recurring.lab l JOIN lab o ON o.session = l.session AND abs(o.row - l.row) <= 1 AND abs(o.col - l.col) <= 1 WHERE o.region < l.region GROUP BY l.session, l.row, l.col)"""


@query("R13_closed_regions", MORPH_SQL + " SELECT session, region, count(*) AS cells, min(row) AS top, max(row) AS bottom, min(col) AS west, max(col) AS east FROM lab GROUP BY session, region HAVING count(*) >= 12")
def r13_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of disagreement of twelve cells and more: closed by an ellipse, their holes filled, grown by a cell."""
    strong = raster.disagreeing(cells(spark, sf_dir), ["session", "row", "col"], 7000.0, 3).select("session", "row", "col")
    r = compositing.closed_regions(strong, "session", ROWS, COLUMNS)
    box = r.groupBy("session", "region").agg(F.count("*").alias("cells"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("west"), F.max("col").alias("east"))
    return box.where("cells >= 12")


BANDS = 3
_KERNEL = ", ".join(f"({r}, {c}, {a * b}e0)" for r, a in compositing.KERNEL.items() for c, b in compositing.KERNEL.items())


def _bands_sql(bands: int) -> str:
    """The pyramid unrolled: l (levels), q (bands blended), z (the map from the coarsest level up)."""
    parts = [f"ker(dr, dc, k) AS (VALUES {_KERNEL})", "l0 AS (SELECT session, frame_id, row, col, value, weight FROM cells WHERE weight > 0)"]
    for n in range(bands):
        parts.append(f"l{n + 1} AS (SELECT session, frame_id, (row + dr) // 2 AS row, (col + dc) // 2 AS col, sum(k * value) / sum(k) AS value, sum(k * weight) / sum(k) AS weight FROM l{n}, ker WHERE (row + dr) % 2 = 0 AND (col + dc) % 2 = 0 GROUP BY 1, 2, 3, 4)")
        parts.append(f"x{n} AS (SELECT session, frame_id, row * 2 + dr AS row, col * 2 + dc AS col, sum(k * value) / sum(k) AS rough FROM l{n + 1}, ker GROUP BY 1, 2, 3, 4)")
        parts.append(f"q{n} AS (SELECT session, row, col, sum(weight * (value - rough)) / sum(weight) AS value FROM l{n} JOIN x{n} USING (session, frame_id, row, col) GROUP BY 1, 2, 3)")
    parts.append(f"z{bands} AS (SELECT session, row, col, sum(weight * value) / sum(weight) AS value FROM l{bands} GROUP BY 1, 2, 3)")
    for n in reversed(range(bands)):
        parts.append(f"y{n} AS (SELECT session, row * 2 + dr AS row, col * 2 + dc AS col, sum(k * value) / sum(k) AS rough FROM z{n + 1}, ker GROUP BY 1, 2, 3)")
        parts.append(f"z{n} AS (SELECT session, row, col, q{n}.value + rough AS value FROM q{n} JOIN y{n} USING (session, row, col))")
    return ", ".join(parts)


@query("R12_multiband_map", f"WITH {CELLS_SQL}, {_bands_sql(BANDS)} SELECT session, row, col, round(value, 5) AS value FROM z0")
def r12_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All views of a session blended in three bands of frequency and a rest."""
    seen = cells(spark, sf_dir).select("session", "frame_id", "row", "col", "value", "weight")
    return compositing.multiband(seen, "session", "frame_id", BANDS).withColumn("value", F.round("value", 5))


BLOCK = 4


@query("R11_block_gains")
def r11_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of all blocks of four by four cells of all views, balanced over their overlaps."""
    return seams.block_gains(cells(spark, sf_dir), "session", "frame_id", BLOCK).withColumn("gain", F.round("gain", 5))


@query("R12_seams", f"""WITH RECURSIVE {CELLS_SQL}, f AS (SELECT DISTINCT session, frame_id FROM cells), pair AS (SELECT * FROM (SELECT session, frame_id AS a, lead(frame_id) OVER (PARTITION BY session ORDER BY frame_id) AS b FROM f) WHERE b IS NOT NULL),
o AS (SELECT p.session, p.a, p.b, x.row, x.col, CAST(round(abs(x.value - y.value)) AS BIGINT) AS cost FROM pair p JOIN cells x ON x.session = p.session AND x.frame_id = p.a JOIN cells y ON y.session = p.session AND y.frame_id = p.b AND y.row = x.row AND y.col = x.col),
box AS (SELECT session, a, b, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM o GROUP BY 1, 2, 3), g AS (SELECT x.session, x.a, x.b, r0, r1, x.row, x.col, coalesce(cost, 1000000) AS cost FROM (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM box)) x LEFT JOIN o USING (session, a, b, row, col)),
d(session, a, b, r1, row, col, d, back) AS (SELECT session, a, b, r1, row, col, cost, col FROM g WHERE row = r0 UNION ALL SELECT g.session, g.a, g.b, g.r1, g.row, g.col, min(d.d) + any_value(g.cost), min({{'d': d.d, 'c': d.col}}).c FROM d JOIN g ON g.session = d.session AND g.a = d.a AND g.b = d.b AND g.row = d.row + 1 AND abs(g.col - d.col) <= 1 GROUP BY 1, 2, 3, 4, 5, 6),
fin AS (SELECT session, a, b, row, min({{'d': d, 'c': col}}) AS best FROM d WHERE row = r1 GROUP BY 1, 2, 3, 4), way(session, a, b, row, col, cost) AS (SELECT session, a, b, row, best.c, best.d FROM fin UNION ALL SELECT w.session, w.a, w.b, w.row - 1, d.back, w.cost FROM way w JOIN d ON d.session = w.session AND d.a = w.a AND d.b = w.b AND d.row = w.row AND d.col = w.col JOIN box ON box.session = w.session AND box.a = w.a AND box.b = w.b WHERE w.row > box.r0)
SELECT session, a, b, row, col, cost FROM way""")
def r12_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between each capture and its session's next one: the cut through their overlap along which they differ least."""
    seen = settle(cells(spark, sf_dir).select("session", "frame_id", "row", "col", "value"), "seen")
    following = F.lead("frame_id").over(Window.partitionBy("session").orderBy("frame_id"))
    pairs = seen.select("session", "frame_id").distinct().select("session", F.col("frame_id").alias("a"), following.alias("b")).where("b is not null")
    return seams.cuts(seen, pairs, "session", "frame_id")


def labelled_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of each label, as views of one map."""
    label = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("view"), F.col("label").cast("long").alias("group"))
    return settle(tilted(spark, sf_dir).join(label, "view").select("group", "view", "image", "h"), "views")


SOURCES_SQL = f"""{WARP_SQL}, every_ AS (SELECT label AS "group", view, "row", col, value, round(weight, 9) AS weight FROM warped JOIN embeddings ON vec_id = view WHERE label IS NOT NULL AND round(weight, 9) > 0.025),
first_ AS (SELECT "group", "row", col, arg_max(view, (weight, -view)) AS view FROM every_ GROUP BY 1, 2, 3), enough AS (SELECT view FROM first_ GROUP BY view HAVING count(*) >= 4), seen AS (SELECT e.* FROM every_ e SEMI JOIN enough USING (view))"""


@query("R16_map_report", f"""WITH {SOURCES_SQL}, c AS (SELECT "group", count(DISTINCT view) AS n, count(DISTINCT "row" * 1000 + col) AS cells FROM seen GROUP BY 1)
SELECT label AS "group", count(*) AS connected_frames, coalesce(any_value(n), 0) AS texture_frames, round(coalesce(any_value(cells), 0) / {MAP * MAP}e0, 9) AS coverage_fraction, {MAP} AS width, {MAP} AS height FROM embeddings LEFT JOIN c ON c."group" = label WHERE label IS NOT NULL GROUP BY label""")
def r16_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is reported of each label's map: its views, its sources and how much they cover."""
    views = labelled_views(spark, sf_dir)
    return orthomosaic.report(views, orthomosaic.sources(pixels(spark, sf_dir), views, SIDE, SIDE, MAP, MAP, tile=4), MAP, MAP)


@query("R16_blended_map", f"""WITH {SOURCES_SQL}, best AS (SELECT "group", "row", col, arg_max(view, (weight, -view)) AS view FROM seen GROUP BY 1, 2, 3),
mask AS (SELECT DISTINCT view, "row" + dr AS "row", col + dc AS col FROM best, (VALUES (-1), (0), (1)) AS a(dr), (VALUES (-1), (0), (1)) AS b(dc)),
cells AS (SELECT s."group" AS session, s.view AS frame_id, s."row" AS row, s.col, s.value, 1e0 AS weight FROM seen s SEMI JOIN mask m ON m.view = s.view AND m."row" = s."row" AND m.col = s.col), {_bands_sql(BANDS)}
SELECT session AS "group", CAST(row AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, round(value, 5) AS value FROM z0""")
def r16_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's map from its images: warped, chosen, cut at the borders of the best views and blended in bands."""
    done, _ = orthomosaic.rendered(pixels(spark, sf_dir), labelled_views(spark, sf_dir), SIDE, SIDE, MAP, MAP, tile=4, bands=BANDS, balance=False)
    return done.withColumn("value", F.round("value", 5))
