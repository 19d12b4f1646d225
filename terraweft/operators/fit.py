"""Least squares as aggregates: normal equations are sums, small systems are solved in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.session import settle

#: Consensus goes on until the best map would have been met with this probability.
CONFIDENCE = 0.999


def places(sizes: DataFrame, group: str, start: int, stop: int, slots: int) -> DataFrame:
    """group, s, slot, _k: seeded samples start <= s < stop of `slots` different places below each group's _n.

    To be shuffled where it is joined: Spark sizes it before the samples are made, and so would broadcast all of them.
    """
    draw = F.array().cast("array<long>")
    for slot in range(slots):
        x = F.pmod(F.xxhash64(group, "s", F.lit(slot)), F.col("_n") - slot)
        free = F.aggregate(F.array_sort("_draw"), x, lambda at, taken: F.when(at >= taken, at + 1).otherwise(at)) if slot else x
        sizes = sizes if slot else sizes.where(F.col("_n") >= slots).withColumn("s", F.explode(F.sequence(F.lit(start), F.lit(stop - 1)))).withColumn("_draw", draw)
        sizes = sizes.withColumn("_draw", F.concat("_draw", F.array(free)))
    return sizes.select(group, "s", F.posexplode("_draw").alias("slot", "_k")).hint("merge")


def rounds(first: int, most: int) -> list[tuple[int, int]]:
    """Ranges of samples, each twice as long as the last one, up to `most`."""
    out, at, many = [], 0, first
    while at < most:
        out.append((at, min(most, at + many)))
        at, many = at + many, many * 2
    return out


def uncertain(sizes: DataFrame, best: DataFrame, group: str, drawn: int, slots: int) -> DataFrame:
    """The groups in which a map of more inliers than the best one's could still have been missed by all samples."""
    seen = sizes.join(best.select(group, "inliers"), group, "left")
    missed = F.pow(1 - F.pow(F.coalesce("inliers", F.lit(0)) / F.col("_n"), F.lit(slots)), F.lit(drawn))
    return seen.where((missed > 1 - CONFIDENCE) & (F.col("_n") > slots)).select(group, "_n")


def determinant3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def affine(points: DataFrame, group: list[str], weight: str | None = None) -> DataFrame:
    """The affine map (u, v) -> (x, y) of each group: a, b, c, d, e, f with x = a u + b v + c and y = d u + e v + f.

    points has u, v, x, y. The nine sums of A'WA and A'Wb are one aggregate; Cramer's rule solves the 3 x 3 system. A group
    whose points lie on a line has null coefficients.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    u, v = F.col("u"), F.col("v")
    sums = {"suu": u * u, "suv": u * v, "svv": v * v, "su": u, "sv": v, "s1": F.lit(1.0)}
    for k in ("x", "y"):
        sums |= {f"u{k}": u * F.col(k), f"v{k}": v * F.col(k), f"s{k}": F.col(k)}
    s = points.groupBy(*group).agg(*(F.sum(w * e).alias(n) for n, e in sums.items()))
    c = F.col
    matrix = [[c("suu"), c("suv"), c("su")], [c("suv"), c("svv"), c("sv")], [c("su"), c("sv"), c("s1")]]
    s = s.withColumn("det", determinant3(matrix))

    def solved(k: str, at: int) -> Column:
        right = [c(f"u{k}"), c(f"v{k}"), c(f"s{k}")]
        replaced = [[right[r] if j == at else matrix[r][j] for j in range(3)] for r in range(3)]
        return F.when(F.abs("det") > 1e-9, determinant3(replaced) / F.col("det"))

    return s.select(*group, *(solved(k, at).alias("abcdef"[3 * (k == "y") + at]) for k in ("x", "y") for at in range(3)))


def similarity(points: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """p, q, tx, ty of each group: x = p u - q v + tx, y = q u + p v + ty, weighted least squares in closed form."""
    held = points.withColumn("_w", weight)
    mean = held.groupBy(*group).agg(*((F.sum(F.col("_w") * F.col(k)) / F.nullif(F.sum("_w"), F.lit(0.0))).alias(f"m{k}") for k in "uvxy"))
    both = held.join(mean, group)
    du, dv, dx, dy = (F.col(k) - F.col(f"m{k}") for k in "uvxy")
    s = both.groupBy(*group, *(f"m{k}" for k in "uvxy")).agg(
        F.sum(F.col("_w") * (du * dx + dv * dy)).alias("a"), F.sum(F.col("_w") * (du * dy - dv * dx)).alias("b"), F.sum(F.col("_w") * (du * du + dv * dv)).alias("n"),
    )
    some = F.nullif("n", F.lit(0.0))
    p, q = F.col("a") / some, F.col("b") / some
    return s.where("n > 0").select(*group, p.alias("p"), q.alias("q"), (F.col("mx") - p * F.col("mu") + q * F.col("mv")).alias("tx"), (F.col("my") - q * F.col("mu") - p * F.col("mv")).alias("ty"))


def residual(points: DataFrame, fitted: DataFrame, group: list[str]) -> DataFrame:
    ex = F.col("p") * F.col("u") - F.col("q") * F.col("v") + F.col("tx") - F.col("x")
    ey = F.col("q") * F.col("u") + F.col("p") * F.col("v") + F.col("ty") - F.col("y")
    return points.join(fitted, group).withColumn("error", F.hypot(ex, ey))


def robust_similarity(points: DataFrame, group: list[str], scale: float, passes: int = 4) -> DataFrame:
    """The same with residuals beyond `scale` weighed down: iteratively reweighted, one aggregate and join a pass."""
    fitted = similarity(points, group, F.lit(1.0))
    for _ in range(passes):
        seen = residual(points, settle(fitted, "fit"), group).drop("p", "q", "tx", "ty")
        fitted = similarity(seen, group, F.least(F.lit(1.0), F.lit(scale) / F.greatest("error", F.lit(1e-9))))
    return fitted


def anchored(points: DataFrame, group: str, order: str, tolerance: float, least: int, samples: int = 84, most: int = 10_000) -> DataFrame:
    """The similarity that most points agree with: hypotheses from seeded pairs of points, judged by their inliers.

    Rounds of pairs follow, up to `most`, for the groups that are not certain to CONFIDENCE; each round is judged against
    all points of its groups in one aggregate. Groups with fewer than `least` inliers are left out. The result is refitted
    to the inliers.
    """
    w = Window.partitionBy(group).orderBy(order)
    rows = settle(points.withColumn("_k", (F.row_number().over(w) - 1).cast("long")), "points")
    left = settle(rows.groupBy(group).agg(F.count("*").alias("_n")).where("_n >= 2"), "sizes")
    ends = rows.select(group, "_k", *"uvxy")
    best = None
    for start, stop in rounds(samples, most):
        drawn = places(left, group, start, stop, 2).join(ends, [group, "_k"])
        first, second = (drawn.where(F.col("slot") == k - 1).select(group, "s", *(F.col(c).alias(f"{c}{k}") for c in "uvxy")) for k in (1, 2))
        du, dv, dx, dy = (F.col(f"{k}2") - F.col(f"{k}1") for k in "uvxy")
        n = F.nullif(du * du + dv * dv, F.lit(0.0))
        p, q = (du * dx + dv * dy) / n, (du * dy - dv * dx) / n
        hyp = first.join(second.hint("merge"), [group, "s"]).where(n.isNotNull()).select(group, "s", p.alias("p"), q.alias("q"), (F.col("x1") - p * F.col("u1") + q * F.col("v1")).alias("tx"), (F.col("y1") - q * F.col("u1") - p * F.col("v1")).alias("ty"))
        judged = residual(ends, hyp.hint("merge"), [group]).where(F.col("error") <= tolerance)
        score = judged.groupBy(group, "s", "p", "q", "tx", "ty").agg(F.count("*").alias("inliers"), F.sum("error").alias("total"))
        score = score.select(group, "inliers", (-F.col("total")).alias("t"), (-F.col("s")).alias("s"), "p", "q", "tx", "ty")
        score = score if best is None else score.unionByName(best)
        best = settle(score.groupBy(group).agg(F.max(F.struct("inliers", "t", "s", "p", "q", "tx", "ty")).alias("b")).select(group, "b.*"), "anchor")
        left = settle(uncertain(left, best, group, stop, 2), "left")
        if not left.take(1):
            break
    best = best.where(F.col("inliers") >= least).select(group, "inliers", "p", "q", "tx", "ty")
    inside = residual(rows, best, [group]).where(F.col("error") <= tolerance).drop("p", "q", "tx", "ty", "error", "inliers", "_k")
    return similarity(inside, [group], F.lit(1.0)).join(best.select(group, "inliers"), group)


def georeferenced(points: DataFrame, group: str, order: str, tolerance: float, least: int) -> DataFrame:
    """points with x2, y2 (their place by the group's anchor), error, inlier and the group's median_error.

    Groups that cannot be anchored by at least `least` points are left out.
    """
    anchor = settle(anchored(points, group, order, tolerance, least).drop("inliers"), "anchor")
    seen = residual(points, anchor, [group])
    seen = seen.withColumns({"x2": F.col("p") * F.col("u") - F.col("q") * F.col("v") + F.col("tx"), "y2": F.col("q") * F.col("u") + F.col("p") * F.col("v") + F.col("ty"), "inlier": F.col("error") <= tolerance})
    seen = settle(seen.drop("p", "q", "tx", "ty"), "placed")
    return seen.join(seen.groupBy(group).agg(F.percentile("error", 0.5).alias("median_error")), group)


def homography_jacobian(h: list[Column], u: Column, v: Column) -> tuple[Column, Column]:
    """Derivatives of the projected point by the first eight entries of a homography: two arrays of eight."""
    w = F.nullif(h[6] * u + h[7] * v + 1, F.lit(0.0))
    x, y = (h[0] * u + h[1] * v + h[2]) / w, (h[3] * u + h[4] * v + h[5]) / w
    zero = F.lit(0.0)
    return F.array(u / w, v / w, 1 / w, zero, zero, zero, -x * u / w, -x * v / w), F.array(zero, zero, zero, u / w, v / w, 1 / w, -y * u / w, -y * v / w)


def normal_equations(rows: DataFrame, group: list[str], jacobian: str, target: str, weight: str) -> DataFrame:
    """group, i, j, value of J'WJ (upper half, j <= 7) and of J'Wr (j = -1): a sparse system as one sum by position.

    A row is added to the 44 sums of its group as it is: as a row for each position it would be shuffled and hashed 44 times."""
    a = [F.get(F.col(jacobian), F.lit(k)) for k in range(8)]
    ends = [(i, j, F.col(weight) * a[i] * (F.col(target) if j < 0 else a[j])) for i in range(8) for j in (-1, *range(i, 8))]
    sums = rows.groupBy(*group).agg(*(F.sum(x).alias(f"_{n}") for n, (_, _, x) in enumerate(ends)))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{n}").alias("value")) for n, (i, j, _) in enumerate(ends)))
    return sums.select(*group, F.explode(at).alias("_e")).select(*group, "_e.i", "_e.j", "_e.value").where("value is not null")

