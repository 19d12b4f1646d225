"""Plane-to-plane maps: consensus from seeded samples, and their joint adjustment over a graph of views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from terraweft.functions.geo import apply_homography
from terraweft.operators.fit import homography_jacobian, normal_equations, places, rounds, uncertain
from terraweft.session import settle

#: Added to the diagonal of each view's system, largest step of an entry, and the residual beyond which weights fall.
RIDGE, STEP, ROBUST = 1e-5, 0.15, 0.006


@F.pandas_udf(ArrayType(DoubleType()))
def _through_four(samples: pd.Series) -> pd.Series:
    """Nine entries (the last is 1) of the map through four correspondences u, v, x, y; null where they are degenerate."""
    s = np.stack(samples.to_numpy()).reshape(-1, 4, 4) if len(samples) else np.empty((0, 4, 4))
    u, v, x, y = np.moveaxis(s, 2, 0)
    one, zero = np.ones_like(u), np.zeros_like(u)
    a = np.concatenate([
        np.stack([u, v, one, zero, zero, zero, -x * u, -x * v], -1),
        np.stack([zero, zero, zero, u, v, one, -y * u, -y * v], -1),
    ], 1)
    b = np.concatenate([x, y], 1)
    fine = np.abs(np.linalg.det(a)) > 1e-12
    h = np.zeros((len(s), 9))
    h[:, 8] = 1
    h[fine, :8] = np.linalg.solve(a[fine], b[fine][..., None])[..., 0]
    return pd.Series([r if f else None for r, f in zip(h, fine, strict=True)], dtype="object")


def entries(h: str) -> list[Column]:
    return [F.col(h)[i] for i in range(9)]


def consensus(points: DataFrame, group: str, order: str, tolerance: float, samples: int = 24, most: int = 4000) -> DataFrame:
    """group, h (nine entries), inliers and points: the map that most of a group's correspondences agree with.

    Seeded samples of four a group are solved, and each is judged by all of the group's points in one aggregate; rounds of
    further samples, up to `most`, follow for the groups that are not certain to 0.999. The best map is refitted to its
    inliers, which are counted before. Groups without a sample that is not degenerate are left out.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = settle(points.select(group, "u", "v", "x", "y", (F.row_number().over(w) - 1).cast("long").alias("_k")), "points")
    left = settle(rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n >= 4"), "sizes")
    sample = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("slot", F.array("u", "v", "x", "y").alias("p")))), lambda r: r["p"]))
    best = None
    for start, stop in rounds(samples, most):
        four = places(left, group, start, stop, 4).join(rows, [group, "_k"]).groupBy(group, "s").agg(sample.alias("p"))
        maps = settle(four.select(group, "s", _through_four("p").alias("h")).where("h is not null"), "maps")
        judged = rows.join(maps, group).withColumn("error", _error("h"))
        score = judged.groupBy(group, "s").agg(F.count_if(F.col("error") <= tolerance).alias("inliers"), F.count("*").alias("points"), F.sum(F.least("error", F.lit(tolerance))).alias("cost"))
        top = score.groupBy(group).agg(F.max(F.struct("inliers", (-F.col("cost")).alias("c"), (-F.col("s")).alias("s"), "points")).alias("b")).select(group, "b.*")
        top = top.withColumn("at", -F.col("s")).join(maps.withColumnRenamed("s", "at"), [group, "at"]).drop("at")
        top = top if best is None else top.unionByName(best)
        best = settle(top.groupBy(group).agg(F.max(F.struct("inliers", "c", "s", "points", "h")).alias("b")).select(group, "b.*"), "best")
        left = settle(uncertain(left, best, group, stop, 4), "left")
        if not left.take(1):
            break
    inside = settle(rows.join(best.select(group, F.col("h").alias("_h")), group).where(_error("_h") <= tolerance).drop("_h"), "inside")
    return best.select(group, "h", "inliers", "points").join(refitted(inside, best.select(group, "h"), group), group, "left").select(group, F.coalesce("fine", "h").alias("h"), "inliers", "points")


def _error(h: str) -> Column:
    px, py = apply_homography(entries(h), F.col("u"), F.col("v"))
    return F.hypot(px - F.col("x"), py - F.col("y"))


def refitted(points: DataFrame, maps: DataFrame, group: str, passes: int = 3) -> DataFrame:
    """group, fine: Gauss-Newton steps from each group's map (group, h) towards least squares over its points.

    A pass that makes the sum of squares larger is not taken."""
    cost = lambda h: F.sum(F.pow(_error(h), F.lit(2)))
    fine = maps.select(group, F.col("h").alias("fine"))
    for _ in range(passes):
        r = points.join(fine, group)
        px, py = apply_homography(entries("fine"), F.col("u"), F.col("v"))
        jx, jy = homography_jacobian(entries("fine"), F.col("u"), F.col("v"))
        pair = F.array(F.struct(jx.alias("jac"), (F.col("x") - px).alias("t")), F.struct(jy.alias("jac"), (F.col("y") - py).alias("t")))
        system = normal_equations(r.select(group, F.lit(1.0).alias("w"), F.explode(pair).alias("e")).select(group, "w", "e.jac", "e.t"), [group], "jac", "t", "w")
        step = system.groupBy(group).agg(_solved_input().alias("system")).select(group, _least_squares("system").alias("d"))
        moved = settle(fine.join(step, group).select(group, "fine", F.concat(F.zip_with(F.slice("fine", 1, 8), "d", lambda a, b: a + b), F.array(F.lit(1.0))).alias("new")), "moved")
        sums = points.join(moved, group).groupBy(group).agg(cost("fine").alias("before"), cost("new").alias("after"))
        fine = settle(moved.join(sums, group).select(group, F.when(F.col("after") < F.col("before"), F.col("new")).otherwise(F.col("fine")).alias("fine")), "fine")
    return fine


@F.pandas_udf(ArrayType(DoubleType()))
def _least_squares(systems: pd.Series) -> pd.Series:
    """Eight unknowns from the entries (i, j, value) of normal equations, scaled to a unit diagonal; the shortest solution."""
    out = []
    for entries_ in systems:
        a, b = np.zeros((8, 8)), np.zeros(8)
        for e in entries_:
            if e["j"] < 0:
                b[e["i"]] = e["value"]
            else:
                a[e["i"], e["j"]] = a[e["j"], e["i"]] = e["value"]
        scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
        out.append(scale * (np.linalg.pinv(a * np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (b * scale)))
    return pd.Series(out, dtype="object")


@F.pandas_udf(ArrayType(DoubleType()))
def _solved(systems: pd.Series) -> pd.Series:
    """Eight unknowns of each view from the entries (i, j, value) of its normal equations."""
    a, b = np.zeros((len(systems), 8, 8)), np.zeros((len(systems), 8))
    for k, entries_ in enumerate(systems):
        for e in entries_:
            i, j, value = e["i"], e["j"], e["value"]
            if j < 0:
                b[k, i] = value
            else:
                a[k, i, j] = a[k, j, i] = value
    a += np.eye(8) * RIDGE
    x = np.linalg.solve(a, b[..., None])[..., 0] if len(b) else b
    x *= np.minimum(1, STEP / np.maximum(np.abs(x).max(1, initial=0), 1e-12))[:, None]
    return pd.Series(list(x), dtype="object")


def residuals(matches: DataFrame, poses: DataFrame) -> DataFrame:
    """matches (i, j, u, v, x, y) with hi, hj and rx, ry: where view i puts (u, v), less where view j puts (x, y)."""
    pose = poses.select("view", "h")
    both = matches.join(pose.select(F.col("view").alias("i"), F.col("h").alias("hi")), "i").join(pose.select(F.col("view").alias("j"), F.col("h").alias("hj")), "j")
    ax, ay = apply_homography(entries("hi"), F.col("u"), F.col("v"))
    bx, by = apply_homography(entries("hj"), F.col("x"), F.col("y"))
    return both.withColumn("rx", ax - bx).withColumn("ry", ay - by)


def adjusted(matches: DataFrame, poses: DataFrame, root: int, rounds: int = 12, damping: float = 0.5) -> DataFrame:
    """Poses (view, h) that bring matched points together: reweighted Gauss-Newton, every view's eight unknowns at once.

    A round sums each view's 8 x 8 normal equations over its matches, with the other views held, and moves all views by a
    damped step (block Jacobi), so that no system larger than eight unknowns is ever formed. The root stays.
    """
    held = settle(poses.select("view", "h"), "poses")
    for _ in range(rounds):
        r = residuals(matches, held)
        r = r.withColumn("w", F.least(F.lit(1.0), F.lit(ROBUST) / F.greatest(F.hypot("rx", "ry"), F.lit(1e-8))))
        rows = None
        for view, h, u, v, sign in (("i", "hi", "u", "v", -1.0), ("j", "hj", "x", "y", 1.0)):
            jx, jy = homography_jacobian(entries(h), F.col(u), F.col(v))
            each = r.select(F.col(view).alias("view"), "w", F.explode(F.array(F.struct(jx.alias("jac"), (F.col("rx") * sign).alias("t")), F.struct(jy.alias("jac"), (F.col("ry") * sign).alias("t")))).alias("e"))
            each = each.select("view", "w", "e.jac", "e.t")
            rows = each if rows is None else rows.unionByName(each)
        system = normal_equations(rows.where(F.col("view") != root), ["view"], "jac", "t", "w")
        step = system.groupBy("view").agg(_solved_input().alias("system")).select("view", _solved("system").alias("d"))
        moved = held.join(step, "view", "left")
        new = F.when(F.col("d").isNull(), F.col("h")).otherwise(F.concat(F.zip_with(F.slice("h", 1, 8), "d", lambda a, b: a + damping * b), F.array(F.lit(1.0))))
        held = settle(moved.select("view", new.alias("h")), "poses")
    return held


def _solved_input() -> Column:
    return F.collect_list(F.struct("i", "j", "value"))
