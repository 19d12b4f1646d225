"""Views onto a map: projective warp, support masks, morphology of regions and blending by frequency bands.

Everything is in long form, one row a cell. Pixels move in tiles, cells meet their neighbours by joins on shifted places, and
nothing gathers a whole map or a whole view's overlaps in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.operators import raster
from terraweft.operators.graph import connected_components
from terraweft.session import settle


def adjugate(h: Column) -> list[Column]:
    """The inverse of a 3 x 3 matrix (nine numbers by rows) but for a factor, which homogeneous places don't see."""
    a, b, c, d, e, f, g, k, i = (h[n] for n in range(9))
    return [e * i - f * k, c * k - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]


def _placed(m: list[Column], x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Place and denominator of a point."""
    den = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / den, (m[3] * x + m[4] * y + m[5]) / den, den


def _box(m: list[Column], xs: tuple, ys: tuple) -> tuple[Column, Column, Column, Column, Column]:
    """Least and largest place of four corners, and whether no horizon runs between them."""
    points = [_placed(m, x, y) for x in xs for y in ys]
    px, py, den = zip(*points, strict=True)
    one_side = (F.least(*den) > 0) | (F.greatest(*den) < 0)
    return F.least(*px), F.greatest(*px), F.least(*py), F.greatest(*py), one_side


def warped(pixels: DataFrame, views: DataFrame, height: int, width: int, rows: int, cols: int, full_width: float | None = None, tile: int = 32) -> DataFrame:
    """view, row, col, value, weight: the map cells that a view covers, bilinearly from its image.

    pixels: image, row, col, value (frames of height by width; a tile with missing pixels is left out); views: view, image, h
    (source to map, nine numbers by rows). A cell is kept where the frame makes up 0.999 of what it is mixed of; beyond the
    frame its border is repeated. Weight is 1 / (1 + r^2) about the frame's centre, zero on its border, mixed likewise.

    Each tile of the map in a view's box meets the tiles of the image that it can touch; what a cell takes from each of them
    is summed. A view whose corners lie on both sides of its horizon has no cells.
    """
    half = (full_width or width) / 2
    at = lambda r, c: F.when((r > 0) & (r < height - 1) & (c > 0) & (c < width - 1), 1 / (1 + ((c - width / 2) * (c - width / 2) + (r - height / 2) * (r - height / 2)) / (half * half))).otherwise(F.lit(0.0))
    low, high, top, bottom, fine = _box([F.col("h")[k] for k in range(9)], (F.lit(0.0), F.lit(float(width))), (F.lit(0.0), F.lit(float(height))))
    v = views.select("view", "image", "h", F.array(*adjugate(F.col("h"))).alias("i"), low.alias("lo"), high.alias("hi"), top.alias("up"), bottom.alias("dn"), fine.alias("fine")).where("fine")
    v = v.select(
        "view", "image", "i", F.greatest(F.lit(0), F.floor("lo") - 1).alias("x0"), F.least(F.lit(cols - 1), F.ceil("hi")).alias("x1"),
        F.greatest(F.lit(0), F.floor("up") - 1).alias("y0"), F.least(F.lit(rows - 1), F.ceil("dn")).alias("y1"),
    ).where("x0 <= x1 and y0 <= y1")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    t = v.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))
    t = t.select("view", "image", "i", F.greatest("x0", F.col("tx") * tile).alias("x0"), F.least("x1", F.col("tx") * tile + tile - 1).alias("x1"), F.greatest("y0", F.col("ty") * tile).alias("y0"), F.least("y1", F.col("ty") * tile + tile - 1).alias("y1"))
    # The part of the frame that a tile's corners enclose; all of it where a horizon crosses the tile.
    inverse = [F.col("i")[k] for k in range(9)]
    low, high, top, bottom, fine = _box(inverse, (F.col("x0").cast("double"), F.col("x1").cast("double")), (F.col("y0").cast("double"), F.col("y1").cast("double")))
    within = lambda x, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x)))
    t = t.withColumns({"lo": low, "hi": high, "up": top, "dn": bottom, "fine": fine}).where(f"not fine or (hi > -1 and lo < {width} and dn > -1 and up < {height})")
    for name, low, high, n in (("sc", "lo", "hi", width), ("sr", "up", "dn", height)):
        first, last = F.when(F.col("fine"), within(F.col(low) - 1e-6, n)).otherwise(0), F.when(F.col("fine"), within(F.col(high) + 1 + 1e-6, n)).otherwise(n - 1)
        t = t.withColumn(name, F.explode(F.sequence(F.floor(first / tile).cast("int"), F.floor(last / tile).cast("int"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda p: p["value"])
    tiles = pixels.groupBy("image", F.floor(F.col("row") / tile).cast("int").alias("sr"), F.floor(F.col("col") / tile).cast("int").alias("sc")).agg(ordered.alias("values"))
    wide, tall = F.least(F.lit(tile), width - F.col("sc") * tile), F.least(F.lit(tile), height - F.col("sr") * tile)
    tiles = tiles.withColumn("wide", wide).where(F.size("values") == F.col("wide") * tall)
    # Spark sizes t by the views, before they are dealt over tiles, and so would broadcast every view's tiles.
    met = t.hint("merge").join(tiles, ["image", "sr", "sc"])
    met = met.withColumn("col", F.explode(F.sequence("x0", "x1"))).withColumn("row", F.explode(F.sequence("y0", "y1")))
    x, y, _ = _placed(inverse, F.col("col").cast("double"), F.col("row").cast("double"))
    met = met.withColumns({"x": x, "y": y}).where(f"x > -1 and x < {width} and y > -1 and y < {height}")
    met = met.withColumns({"c0": F.floor("x"), "r0": F.floor("y")}).withColumns({"fc": F.col("x") - F.col("c0"), "fr": F.col("y") - F.col("r0")})
    tap = lambda dr, dc: F.struct((F.col("r0") + dr).alias("r"), (F.col("c0") + dc).alias("c"), ((F.col("fr") if dr else 1 - F.col("fr")) * (F.col("fc") if dc else 1 - F.col("fc"))).alias("share"))
    taps = F.filter(F.array(*(tap(r, c) for r in (0, 1) for c in (0, 1))), lambda p: p["share"] > 0)
    met = met.select("view", "row", "col", "sr", "sc", "wide", "values", F.explode(taps).alias("p")).select("*", F.col("p.r").alias("r"), F.col("p.c").alias("c"), F.col("p.share").alias("share"))
    met = met.withColumns({"cr": within(F.col("r"), height), "cc": within(F.col("c"), width)}).where((F.floor(F.col("cr") / tile) == F.col("sr")) & (F.floor(F.col("cc") / tile) == F.col("sc")))
    value = F.col("values")[((F.col("cr") - F.col("sr") * tile) * F.col("wide") + F.col("cc") - F.col("sc") * tile).cast("int")]
    inside = (F.col("r") == F.col("cr")) & (F.col("c") == F.col("cc"))
    out = met.groupBy("view", "row", "col").agg(
        F.sum(F.col("share") * value).alias("value"), F.sum(F.when(inside, F.col("share") * at(F.col("r"), F.col("c"))).otherwise(0.0)).alias("weight"),
        F.sum(F.when(inside, F.col("share")).otherwise(0.0)).alias("inside"),
    )
    return out.where("inside >= 0.999").select("view", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", "weight")


def polygon_spans(polygons: DataFrame, grow: int = 0) -> DataFrame:
    """id, row, first, last: the cells whose centres (whole numbers) a polygon holds, as runs of columns.

    polygons: id, xs, ys (corners in order; any simple polygon). The scan line of a row crosses edges by the half-open rule
    that points are tested with, and every second gap between its crossings is inside. With grow, a run reaches `grow` cells
    further on all sides (a square element), and runs that meet are one.
    """
    corner = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda k: F.struct(F.get("xs", k).alias("x1"), F.get("ys", k).alias("y1"), F.get("xs", (k + 1) % F.size("xs")).alias("x2"), F.get("ys", (k + 1) % F.size("ys")).alias("y2")))
    edges = polygons.where(F.size("xs") >= 3).select("id", F.inline(corner)).where("y1 <> y2")
    # Rows with min(y1, y2) <= row < max(y1, y2).
    edges = edges.withColumn("lo", F.ceil(F.least("y1", "y2")).cast("int")).withColumn("hi", (F.ceil(F.greatest("y1", "y2")) - 1).cast("int")).where("lo <= hi")
    crossed = edges.withColumn("row", F.explode(F.sequence("lo", "hi")))
    crossed = crossed.withColumn("x", F.col("x1") + (F.col("row") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    by = Window.partitionBy("id", "row").orderBy("x")
    runs = crossed.select("id", "row", "x", F.lead("x").over(by).alias("after"), F.row_number().over(by).alias("n")).where("n % 2 = 1")
    runs = runs.select("id", "row", F.ceil("x").cast("int").alias("first"), (F.ceil("after") - 1).cast("int").alias("last")).where("first <= last")
    if grow:
        runs = runs.select("id", F.explode(F.sequence(F.col("row") - grow, F.col("row") + grow)).alias("row"), (F.col("first") - grow).alias("first"), (F.col("last") + grow).alias("last"))
    return joined_runs(runs, ["id", "row"])


def joined_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (first, last) of which those that meet or overlap are one."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    upto = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") > upto + 1, 1).otherwise(F.when(upto.isNull(), 1).otherwise(0))
    marked = runs.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def span_cells(runs: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """The cells of runs, within the map."""
    some = runs.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("last") >= 0) & (F.col("first") < cols))
    return some.select(*keys, F.explode(F.sequence(F.greatest("first", F.lit(0)), F.least("last", F.lit(cols - 1)))).alias("col"))


def supported(cells: DataFrame, runs: DataFrame, view: str) -> DataFrame:
    """Cells (view, row, col) that a run of their view (id, row, first, last) holds: an equi-join with a range in it."""
    r = runs.select(F.col("id").alias(view), "row", "first", "last")
    return cells.join(r, [view, "row"]).where(F.col("col").between(F.col("first"), F.col("last"))).drop("first", "last")


#: Offsets (row, column) of an ellipse of five by five and of a square of three by three.
ELLIPSE = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if abs(r) < 2 or c == 0]
SQUARE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def _shifted(cells: DataFrame, group: str, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))).alias("s")
    return cells.select(group, "row", "col", steps).select(group, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))


def dilated(cells: DataFrame, group: str, rows: int, cols: int, offsets: list[tuple[int, int]] = SQUARE) -> DataFrame:
    """Cells within the map that the element, set on some cell, covers."""
    return _shifted(cells, group, offsets).where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).distinct()


def eroded(cells: DataFrame, group: str, rows: int, cols: int, offsets: list[tuple[int, int]] = SQUARE) -> DataFrame:
    """Cells at which the element lies wholly on cells; what is beyond the map counts as set. Elements are symmetric."""
    met = _shifted(cells, group, offsets).groupBy(group, "row", "col").agg(F.count("*").alias("n"))
    due = reduce(lambda a, b: a + b, ((F.col("row") + r).between(0, rows - 1).cast("int") * (F.col("col") + c).between(0, cols - 1).cast("int") for r, c in offsets))
    return met.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1) & (F.col("n") == due)).select(group, "row", "col")


def closed(cells: DataFrame, group: str, rows: int, cols: int, offsets: list[tuple[int, int]] = ELLIPSE) -> DataFrame:
    return eroded(dilated(cells, group, rows, cols, offsets), group, rows, cols, offsets)


def filled(cells: DataFrame, group: str, height: int) -> DataFrame:
    """Cells and the holes that they enclose (background that no way over sides leads out of).

    Of the background only the runs between two set cells of a row are looked at; those that meet a neighbouring row's run,
    or pass its first or last set cell, are connected with it or with the outside. The work grows with the cells alone.
    """
    by = Window.partitionBy(group, "row").orderBy("col")
    runs = cells.select(group, "row", (F.lag("col").over(by) + 1).alias("first"), (F.col("col") - 1).alias("last")).where("first <= last")
    runs = settle(runs.withColumn("node", F.xxhash64(group, "row", "first")), "runs")
    extent = settle(cells.groupBy(group, "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi")), "extent")
    out = None
    for step in (-1, 1):
        near = runs.withColumn("row", F.col("row") + step).join(extent, [group, "row"], "left")
        open_ = near.where(F.col("lo").isNull() | (F.col("first") < F.col("lo")) | (F.col("last") > F.col("hi"))).select("node")
        out = open_ if out is None else out.unionByName(open_)
    a, b = runs.select(group, (F.col("row") + 1).alias("row"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("node").alias("src")), runs.select(group, "row", "first", "last", F.col("node").alias("dst"))
    links = a.join(b, [group, "row"]).where("f <= last and first <= l").select("src", "dst")
    parts = settle(connected_components(links), "parts")
    named = runs.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = settle(named.select(group, "row", "first", "last", "node", "part"), "named")
    leaking = named.join(out.distinct(), "node", "left_semi").select("part").distinct()
    holes = named.join(leaking, "part", "left_anti").select(group, "row", F.explode(F.sequence("first", "last")).alias("col"))
    return cells.select(group, "row", "col").unionByName(holes)


def _over(maps: np.ndarray, offsets: list[tuple[int, int]], beyond: bool) -> Iterator[np.ndarray]:
    """Many maps (map, row, col) shifted by each of the offsets; what comes from beyond them is as told."""
    reach = max(max(map(abs, o)) for o in offsets)
    wide = np.pad(maps, ((0, 0), (reach, reach), (reach, reach)), constant_values=beyond)
    for r, c in offsets:
        yield wide[:, reach - r : reach - r + maps.shape[1], reach - c : reach - c + maps.shape[2]]


def _grown_whole(maps: np.ndarray) -> np.ndarray:
    """closed(), filled() and dilated(), on the maps of many groups at a time."""
    grown = lambda m, by: reduce(np.logical_or, _over(m, by, False))
    maps = reduce(np.logical_and, _over(grown(maps, ELLIPSE), ELLIPSE, True))
    back = ~np.pad(maps, ((0, 0), (1, 1), (1, 1)))
    outside = back & (raster.touching(back, [(0, 1), (1, 0)]) == 0)
    return grown(~outside[:, 1:-1, 1:-1], SQUARE)


def closed_regions(cells: DataFrame, group: str, rows: int, cols: int) -> DataFrame:
    """group, row, col, region (its first place) of a map's cells closed by an ellipse, with their holes, grown by a cell.

    Groups have nothing in common: those of a small map are streamed by tasks, the others' cells met by joins.
    """
    if rows * cols <= raster.PLACES:
        return raster.map_regions(cells, group, rows, cols, _grown_whole)
    whole = filled(settle(closed(cells, group, rows, cols), "closed"), group, rows)
    grown = settle(dilated(whole, group, rows, cols), "grown")
    return raster.cell_regions(grown, group, cols).withColumn("region", F.pmod("region", F.lit(1 << 32)))


#: The binomial kernel of five taps.
KERNEL = {-2: 1.0, -1: 4.0, 0: 6.0, 1: 4.0, 2: 1.0}


def reduced(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The next coarser level: kernel means (over the cells that there are) of each column at every second place."""
    pairs = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(a * b).alias("k")) for r, a in KERNEL.items() for c, b in KERNEL.items()))
    # A cell counts for the even places within two steps: (row + dr, col + dc), both even.
    fits = F.filter(pairs, lambda p: ((F.col("row") + p["dr"]) % 2 == 0) & ((F.col("col") + p["dc"]) % 2 == 0))
    met = cells.withColumn("_p", F.explode(fits))
    place = [((F.col(x) + F.col(f"_p.{d}")) / 2).cast("int").alias(x) for x, d in (("row", "dr"), ("col", "dc"))]
    return met.select(*keys, *place, F.col("_p.k").alias("_k"), *columns).groupBy(*keys, "row", "col").agg(*((F.sum(F.col("_k") * F.col(c)) / F.sum("_k")).alias(c) for c in columns))


def expanded(coarse: DataFrame, fine: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """fine's places with the kernel means of the coarser level's columns around them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(a * b).alias("k")) for r, a in KERNEL.items() for c, b in KERNEL.items())))
    met = coarse.withColumn("_p", pairs).select(*keys, (F.col("row") * 2 + F.col("_p.dr")).alias("row"), (F.col("col") * 2 + F.col("_p.dc")).alias("col"), F.col("_p.k").alias("_k"), *columns)
    met = met.join(fine.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")
    return met.groupBy(*keys, "row", "col").agg(*((F.sum(F.col("_k") * F.col(c)) / F.sum("_k")).alias(c) for c in columns))


#: A group of so few cells in so small a box is blended in one task, FIELD places at a time.
CELLS, BOX, FIELD = 200_000, 1 << 18, 1 << 20


def multiband(views: DataFrame, group: str, view: str, bands: int = 5) -> DataFrame:
    """group, row, col, value: views (group, view, row, col, value, weight) blended apart in each of `bands` frequency bands
    and a rest.

    A band is what a level of a view's pyramid has beyond the expanded next one; it is weighed by the view's weight at that
    level, so that fine detail changes over within a few cells of a seam and coarse brightness slowly. Cells where no view
    has weight are left out. A view that is alone comes back as it is.

    Groups have nothing in common: one within CELLS and BOX is blended in one task, where its cells lie if they were dealt by
    group; the others, and those with a null in them, by joins of levels.
    """
    level = views.select(group, view, "row", "col", F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
    open_ = reduce(lambda a, b: a | b, (F.isnull(c) for c in (view, "row", "col", "value")))
    side = lambda c: (F.max(c) - F.min(c) + 1).cast("long")
    sized = level.groupBy(group).agg(F.count("*").alias("n"), (side("row") * side("col")).alias("box"), F.count(F.when(open_, 1)).alias("open"))
    large = settle(sized.where((F.col("n") > CELLS) | (F.col("box") > BOX) | F.isnull("box") | (F.col("open") > 0) | F.isnull(group)).select(F.col(group).alias("_g")), "large")
    kind = dict(level.dtypes)
    schema = f"`{group}` {kind[group]}, row int, col int, value double"
    if not large.take(1):
        return level.groupBy(group).applyInPandas(_blended(group, view, bands), schema)
    same = level[group].eqNullSafe(F.col("_g"))
    few = level.join(large, same, "left_anti").groupBy(group).applyInPandas(_blended(group, view, bands), schema)
    return few.unionByName(_blended_by_joins(level.join(large, same, "left_semi"), group, view, bands))


def _blended(group: str, view: str, bands: int):
    """multiband of one group, on fields of one view each; as reduced() and expanded(), means are over the cells there are."""
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    def steps(low: int, high: int) -> list[np.ndarray]:
        """Of each level the kernel's shares of its rows (or columns) in those of the next, as far out as that reaches."""
        out = []
        for _ in range(bands):
            fine, coarse = np.arange(low, high + 1), np.arange(-(-(low - 2) // 2), (high + 2) // 2 + 1)
            gap = fine - 2 * coarse[:, None]
            out.append(sum(k * (gap == d) for d, k in KERNEL.items()))
            low, high = coarse[0], coarse[-1]
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        who = np.unique(rows[view].to_numpy(), return_inverse=True)[1]
        row, col = rows.row.to_numpy(np.int64), rows.col.to_numpy(np.int64)
        top, west, bottom, east = row.min(), col.min(), row.max(), col.max()
        down, along = steps(top, bottom), steps(west, east)
        reduce_ = lambda x, n: down[n] @ x @ along[n].T
        expand = lambda x, n: down[n].T @ x @ along[n]
        sums: list = [0.0] * (bands + 1)
        many, shape = who.max() + 1, (bottom - top + 1, east - west + 1)
        step = max(1, FIELD // (shape[0] * shape[1]))
        order = np.argsort(who, kind="stable")
        for lo in range(0, many, step):
            part = order[slice(*np.searchsorted(who[order], (lo, lo + step)))]
            at = (who[part] - lo, row[part] - top, col[part] - west)
            value, weight, there = (np.zeros((min(step, many - lo), *shape)) for _ in range(3))
            value[at], weight[at], there[at] = rows.value.to_numpy()[part], rows.weight.to_numpy()[part], 1.0
            for n in range(bands + 1):
                band = value
                if n < bands:
                    mass = reduce_(there, n)
                    coarse, heavy, held = over(reduce_(value, n), mass), over(reduce_(weight, n), mass), (mass > 0).astype(float)
                    band = (value - over(expand(coarse, n), expand(held, n))) * there
                sums[n] = sums[n] + np.stack([(weight * band).sum(0), weight.sum(0)])
                if n < bands:
                    value, weight, there = coarse, heavy, held
        out = over(*sums[bands])
        for n in reversed(range(bands)):
            rough = over(expand(out, n), expand((sums[n + 1][1] > 0).astype(float), n))
            out = (over(*sums[n]) + rough) * (sums[n][1] > 0)
        r, c = np.nonzero(sums[0][1] > 0)
        return pd.DataFrame({group: rows[group].iloc[0], "row": r + top, "col": c + west, "value": out[r, c]})

    return run


def _blended_by_joins(level: DataFrame, group: str, view: str, bands: int) -> DataFrame:
    at, own = [group, "row", "col"], [group, view]
    level = settle(level, "level0")
    blended = []
    mix = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias("value")
    for k in range(bands):
        coarse = settle(reduced(level, own, ["value", "weight"]), f"level{k + 1}")
        rough = expanded(coarse, level, own, ["value"]).withColumnRenamed("value", "rough")
        band = level.join(rough.hint("merge"), [*own, "row", "col"]).withColumn("band", F.col("value") - F.col("rough"))
        blended.append(settle(band.groupBy(*at).agg(mix("band")), f"band{k}"))
        level = coarse
    out = level.groupBy(*at).agg(mix("value"))
    for band in reversed(blended):
        out = settle(out, "blend")
        rough = expanded(out, band, [group], ["value"]).withColumnRenamed("value", "rough")
        out = band.join(rough, at).select(*at, (F.col("value") + F.col("rough")).alias("value"))
    return out
