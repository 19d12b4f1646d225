"""Exposure and seams between overlapping views: a sparse system by conjugate gradients, and least-cost cuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.session import discard, settle

# How much unequal brightness in an overlap and a gain away from one cost.
ALPHA, BETA = 0.01, 100.0
#: Pairs of cells at one place up to which a group is balanced in one task.
PAIRS = 2_000_000
#: What a place beside an overlap costs a seam.
OUTSIDE = 1_000_000


def exposure_system(cells: DataFrame, group: str, view: str, block: int) -> tuple[DataFrame, DataFrame]:
    """entries (i, j, a) and right sides (i, b) of the balance of all blocks' gains.

    cells: group, view, row, col, value. A block is `block` by `block` cells of one view. Each pair of blocks of different views
    that share n cells, with means m and m' there, adds 2 ALPHA n (g m - g' m')^2, and each block BETA n (1 - g)^2 for its own
    cells and for each overlap.
    """
    own = cells.select(group, view, "row", "col", F.col("value").cast("double").alias("value"))
    own = own.withColumn("block", F.struct(group, view, F.floor(F.col("row") / block).alias("r"), F.floor(F.col("col") / block).alias("c")))
    own = settle(own.withColumn("i", F.xxhash64("block")).select(group, view, "row", "col", "value", "i"), "blocks")
    other = own.select(group, "row", "col", F.col(view).alias("_v"), F.col("value").alias("w"), F.col("i").alias("j"))
    shared = own.join(other, [group, "row", "col"]).where(F.col(view) != F.col("_v"))
    met = settle(shared.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.avg("w").alias("k")), "overlaps")
    alone = own.groupBy("i").agg(F.count("*").alias("n"))
    diagonal = alone.select("i", F.col("i").alias("j"), (BETA * F.col("n")).alias("a")).unionByName(met.select("i", F.col("i").alias("j"), ((BETA + 2 * ALPHA * F.col("m") * F.col("m")) * F.col("n")).alias("a")))
    entries = diagonal.unionByName(met.select("i", "j", (-2 * ALPHA * F.col("m") * F.col("k") * F.col("n")).alias("a"))).groupBy("i", "j").agg(F.sum("a").alias("a"))
    right = alone.select("i", (BETA * F.col("n")).alias("b")).unionByName(met.select("i", (BETA * F.col("n")).alias("b"))).groupBy("i").agg(F.sum("b").alias("b"))
    return entries, right


def conjugate_gradients(entries: DataFrame, right: DataFrame, bound: float = 1e-8, rounds: int = 200) -> DataFrame:
    """i, x: the solution of a symmetric positive system in long form, to a residual of `bound` of the right side's norm.

    Preconditioned by the diagonal; starts from x = 1. A round is one product of the matrix with the direction (a join and a
    sum), written, and three sums over it, which are all that the driver sees.
    """
    a = settle(entries, "system")
    scale = a.where("i = j").select("i", (1 / F.col("a")).alias("s"))
    first = a.groupBy("i").agg(F.sum("a").alias("ax")).join(right, "i").join(scale, "i")
    state = first.select("i", F.lit(1.0).alias("x"), (F.col("b") - F.col("ax")).alias("r"), "s", "b").withColumn("p", F.col("s") * F.col("r"))
    state = settle(state, "state")
    z, norm = state.agg(F.sum(F.col("s") * F.col("r") * F.col("r")), F.sum(F.col("s") * F.col("b") * F.col("b"))).first()
    if z is None:
        return state.select("i", "x")
    held = state
    for _ in range(rounds):
        if z <= bound * bound * norm:
            break
        product = a.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        step = settle(state.join(product, "i"), "step")
        pq, rq, qq = step.agg(F.sum(F.col("p") * F.col("q")), F.sum(F.col("s") * F.col("r") * F.col("q")), F.sum(F.col("s") * F.col("q") * F.col("q"))).first()
        length = z / pq
        after = max(0.0, z - 2 * length * rq + length * length * qq)
        r = F.col("r") - length * F.col("q")
        state = step.select("i", (F.col("x") + length * F.col("p")).alias("x"), r.alias("r"), "s", "b", (F.col("s") * r + after / z * F.col("p")).alias("p"))
        z = after
        discard(held)
        held = step
    else:
        raise RuntimeError(f"no solution within {rounds} rounds")
    return state.select("i", "x")


def block_gains(cells: DataFrame, group: str, view: str, block: int) -> DataFrame:
    """group, view, block_row, block_col, gain.

    Groups have nothing in common: one that has PAIRS pairs of cells or fewer is balanced in one task, where its cells lie
    if they were dealt by group; the others, and what has a null in it, by rounds over one system.
    """
    cells = cells.select(group, view, "row", "col", F.col("value").cast("double").alias("value"))
    places = cells.groupBy(group, "row", "col").agg(F.count("*").alias("n"), F.count(F.when(F.isnull(view) | F.isnull("value"), 1)).alias("open"))
    bare = F.isnull("row") | F.isnull("col")
    sized = places.groupBy(group).agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("open").alias("open"), F.count(F.when(bare, 1)).alias("bare"))
    large = settle(sized.where((F.col("pairs") > PAIRS) | (F.col("open") > 0) | (F.col("bare") > 0) | F.isnull(group)).select(group), "large")
    kind = dict(cells.dtypes)
    schema = f"`{group}` {kind[group]}, `{view}` {kind[view]}, block_row long, block_col long, gain double"
    if not large.take(1):
        return cells.groupBy(group).applyInPandas(_balanced(group, view, block), schema)
    names = large.withColumnRenamed(group, "_g")
    few = cells.join(names, cells[group].eqNullSafe(F.col("_g")), "left_anti").groupBy(group).applyInPandas(_balanced(group, view, block), schema)
    many = settle(cells.join(names, cells[group].eqNullSafe(F.col("_g")), "left_semi"), "many")
    gains = conjugate_gradients(*exposure_system(many, group, view, block))
    named = many.select(group, view, F.floor(F.col("row") / block).alias("r"), F.floor(F.col("col") / block).alias("c")).distinct()
    named = named.withColumn("i", F.xxhash64(F.struct(group, view, "r", "c")))
    return few.unionByName(named.join(gains, "i").select(group, view, F.col("r").alias("block_row"), F.col("c").alias("block_col"), F.col("x").alias("gain")))


def _balanced(group: str, view: str, block: int):
    """The balance of one group's blocks: exposure_system and conjugate_gradients on arrays."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        who, row, col, value = rows[view].to_numpy(), rows.row.to_numpy(), rows.col.to_numpy(), rows.value.to_numpy()
        blocks, at = np.unique(np.stack([who, row // block, col // block]), axis=1, return_inverse=True)
        at, m = at.reshape(-1), blocks.shape[1]
        places = np.unique(np.stack([row, col]), axis=1, return_inverse=True)[1].reshape(-1)
        order = np.argsort(places, kind="stable")
        many = np.bincount(places)
        each = many[places[order]]
        first = np.repeat(order, each)
        begin = np.repeat((np.cumsum(many) - many)[places[order]], each)
        second = order[begin + np.arange(len(first)) - np.repeat(np.cumsum(each) - each, each)]
        apart = who[first] != who[second]
        first, second = first[apart], second[apart]
        met, pair = np.unique(at[first] * m + at[second], return_inverse=True)
        i, j, n = met // m, met % m, np.bincount(pair, minlength=len(met)).astype(float)
        own, other = (np.bincount(pair, value[x], len(met)) / n for x in (first, second))
        right = BETA * (np.bincount(at, minlength=m) + np.bincount(i, n, m))
        diagonal = right + np.bincount(i, 2 * ALPHA * own * own * n, m)
        a = -2 * ALPHA * own * other * n
        x, scale = np.ones(m), 1 / diagonal
        times = lambda p: diagonal * p + np.bincount(i, a * p[j], m)
        r = right - times(x)
        p = scale * r
        z, due = r @ p, 1e-16 * (right @ (scale * right))
        for _ in range(200):
            if z <= due:
                break
            q = times(p)
            length = z / (p @ q)
            x, r = x + length * p, r - length * q
            after = r @ (scale * r)
            p, z = scale * r + after / z * p, after
        else:
            raise RuntimeError("no solution within 200 rounds")
        return pd.DataFrame({group: rows[group].iloc[0], view: blocks[0], "block_row": blocks[1].astype(np.int64), "block_col": blocks[2].astype(np.int64), "gain": x})

    return run


def cuts(cells: DataFrame, pairs: DataFrame, group: str, view: str) -> DataFrame:
    """group, a, b, row, col, cost: through the overlap of each pair (group, a, b) the cheapest way from its first row to its last.

    A way takes one place a row, at most one column from the last. A place costs how much the two views differ there (whole
    numbers), and OUTSIDE where they don't both see it; the total cost is returned with each row. Of equal ways that with the
    smaller columns, from the last row up, is taken. A pair's overlap, no larger than a view, is folded row by row.
    """
    seen = cells.select(group, view, "row", "col", "value")
    a, b = (seen.select(group, F.col(view).alias(n), "row", "col", F.col("value").alias(f"v{n}")) for n in "ab")
    keys = [group, "a", "b"]
    both = settle(pairs.join(a, [group, "a"]).join(b, [group, "b", "row", "col"]).select(*keys, "row", "col", F.round(F.abs(F.col("va") - F.col("vb"))).cast("long").alias("cost")), "overlap")
    box = both.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    places = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    full = places.join(both, [*keys, "row", "col"], "left").withColumn("cost", F.coalesce("cost", F.lit(OUTSIDE).cast("long")))
    rows = full.groupBy(*keys, "r0", "c0", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "cost"))), lambda p: p["cost"]).alias("costs"))
    whole = rows.groupBy(*keys, "r0", "c0").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "costs"))), lambda p: p["costs"]).alias("rows"))
    # Of a row: the least cost of a way to each place, and the column of the row before that it comes from.
    start = F.struct(F.col("rows")[0].alias("d"), F.array().cast("array<array<int>>").alias("back"))

    def onward(acc, costs):
        come = F.transform(costs, lambda _, j: F.array_min(F.transform(F.sequence(F.greatest(F.lit(0), j - 1), F.least(F.size(costs) - 1, j + 1)), lambda k: F.struct(acc["d"][k].alias("d"), k.alias("k")))))
        return F.struct(F.zip_with(come, costs, lambda c, x: c["d"] + x).alias("d"), F.concat(acc["back"], F.array(F.transform(come, lambda c: c["k"]))).alias("back"))

    done = whole.withColumn("w", F.aggregate(F.slice("rows", 2, F.size("rows")), start, onward))
    end = F.array_min(F.transform(F.col("w.d"), lambda d, k: F.struct(d.alias("d"), k.alias("k"))))
    done = done.withColumn("end", end)
    # From the last row up; the way grows at its front.
    way = F.aggregate(F.reverse("w.back"), F.array(F.col("end.k")), lambda acc, back: F.concat(F.array(back[acc[0]]), acc))
    out = done.select(*keys, "r0", "c0", F.col("end.d").alias("cost"), F.posexplode(way).alias("n", "k"))
    return out.select(*keys, (F.col("r0") + F.col("n")).alias("row"), (F.col("c0") + F.col("k")).alias("col"), "cost")
