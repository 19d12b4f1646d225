"""Camera poses over one ground plane: homographies taken apart, and a normal that all views of a group agree on.

A view's homography takes the group's reference image to it, in calibrated coordinates: R + t n'/d but for a factor, with the
plane's normal n and distance d as the reference camera sees them. It comes apart in two ways that the view alone can't tell
from each other; the ways' normals vote, and the plane's is the one that is near some way of every view.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.session import dealt, settle

#: Candidates for a group's normal, views moved less than this (of the plane's distance) have no say, least z of a normal.
CANDIDATES, MOVED, FACING = 64, 0.03, 0.1
WAYS = "array<struct<nx:double,ny:double,nz:double,cx:double,cy:double,cz:double,moved:double>>"


def decompose(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """R (n, 2, 3, 3), t and normal (n, 2, 3) of homographies (n, 3, 3), and how far each has moved.

    Normals face away from the reference camera (z at least 0). The eigenvectors of H'H to its largest and smallest value
    span, with the middle one, the two planes whose directions H keeps in length.
    """
    h = h / np.maximum(np.linalg.svd(h, compute_uv=False)[:, 1, None, None], 1e-300)
    h = h * np.where(np.linalg.det(h) < 0, -1.0, 1.0)[:, None, None]
    values, vectors = np.linalg.eigh(np.swapaxes(h, 1, 2) @ h)
    small, large = np.minimum(values[:, 0], 1.0), np.maximum(values[:, 2], 1.0)
    first, middle, last = vectors[:, :, 2], vectors[:, :, 1], vectors[:, :, 0]
    gap = np.sqrt(np.maximum(large - small, 1e-300))
    a, b = (np.sqrt(1 - small) / gap)[:, None], (np.sqrt(large - 1) / gap)[:, None]
    rotations, moves, normals = [], [], []
    for u in (a * first + b * last, a * first - b * last):
        n = np.cross(middle, u)
        n = n * np.where(n[:, 2] < 0, -1.0, 1.0)[:, None]
        base = np.stack([middle, u, np.cross(middle, u)], 2)
        hm, hu = np.einsum("nij,nj->ni", h, middle), np.einsum("nij,nj->ni", h, u)
        r = np.stack([hm, hu, np.cross(hm, hu)], 2) @ np.swapaxes(base, 1, 2)
        rotations.append(r)
        moves.append(np.einsum("nij,nj->ni", h - r, n))
        normals.append(n)
    r, t, n = (np.stack(x, 1) for x in (rotations, moves, normals))
    return r, t, n, np.linalg.norm(t, axis=2).min(1)


def ways(h: pd.Series) -> pd.Series:
    """The normals and camera places (in plane distances, as the reference camera sees them) of each homography; none of what
    is no matrix of nine finite numbers."""
    good = [x is not None and len(x) == 9 and bool(np.isfinite(np.asarray(x, np.float64)).all()) for x in h]
    out: list[list[dict]] = [[] for _ in good]
    if any(good):
        r, t, n, moved = decompose(np.stack([np.asarray(x, np.float64) for x, g in zip(h, good, strict=True) if g]).reshape(-1, 3, 3))
        c = -np.einsum("nwji,nwj->nwi", r, t)
        names = ("nx", "ny", "nz", "cx", "cy", "cz")
        for k, at in enumerate(np.flatnonzero(good)):
            out[at] = [dict(zip(names, map(float, (*n[k, w], *c[k, w])))) | {"moved": float(moved[k])} for w in (0, 1)]
    return pd.Series(out, dtype=object)


def with_ways(views: DataFrame) -> DataFrame:
    """views (group columns, view, h: nine numbers by rows) with their ways."""
    return views.withColumn("ways", F.pandas_udf(ways, WAYS)("h"))


def _gap(a: str, b: str) -> Column:
    return 1 - (F.col(f"{a}.nx") * F.col(f"{b}.nx") + F.col(f"{a}.ny") * F.col(f"{b}.ny") + F.col(f"{a}.nz") * F.col(f"{b}.nz"))


def plane_normals(held: DataFrame, group: str, view: str, limit: float = 15.0) -> DataFrame:
    """group, nx, ny, nz, degrees, consistent: the plane's normal as most views have it, from with_ways().

    Candidates are the ways of the group's first CANDIDATES / 2 views in a seeded order. A candidate's score is the median,
    over the views, of its gap to their nearest way; the best one picks each view's way, and the normal is the median of
    those by component. degrees is the median angle between it and them; past `limit` the group is no plane.

    Views are dealt by group, and a group's candidates are one row: gaps are made and ranked where the views are.
    """
    some = held.select(group, view, F.filter("ways", lambda w: (w["moved"] >= MOVED) & (w["nz"] > FACING)).alias("ways")).where(F.size("ways") > 0)
    some = dealt(some, group)
    gap = lambda a, b: 1 - (a["nx"] * b["nx"] + a["ny"] * b["ny"] + a["nz"] * b["nz"])
    order = Window.partitionBy(group).orderBy(F.xxhash64(view), view)
    drawn = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= CANDIDATES // 2)
    drawn = drawn.select(group, (F.col("_n") * 2).alias("_n"), F.posexplode("ways").alias("_w", "candidate")).groupBy(group)
    drawn = settle(drawn.agg(F.array_sort(F.collect_list(F.struct((F.col("_n") + F.col("_w")).alias("c"), "candidate"))).alias("_drawn")), "normals")
    gaps = F.transform("_drawn", lambda d: F.struct(d["c"].alias("c"), F.array_min(F.transform("ways", lambda w: gap(d["candidate"], w))).alias("gap")))
    met = _beside(some, drawn, group).select(group, F.explode(gaps).alias("_m")).select(group, F.col("_m.c").alias("_c"), F.col("_m.gap").alias("gap"))
    scores = met.groupBy(group, "_c").agg(F.percentile("gap", F.lit(0.5)).alias("score"))
    best = scores.groupBy(group).agg(F.min(F.struct("score", "_c"))["_c"].alias("_c"))
    best = settle(best.join(drawn, group).select(group, F.filter("_drawn", lambda d: d["c"] == F.col("_c"))[0]["candidate"].alias("best")), "best")
    nearest = F.array_min(F.transform("ways", lambda w, i: F.struct(gap(F.col("best"), w).alias("gap"), i.alias("i"), w.alias("way"))))["way"]
    picked = _beside(some, best, group).select(group, nearest.alias("way"))
    middle = picked.groupBy(group).agg(*(F.percentile(f"way.{c}", F.lit(0.5)).alias(c) for c in ("nx", "ny", "nz")))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    normal = settle(middle.select(group, F.struct(*((F.col(c) / size).alias(c) for c in ("nx", "ny", "nz"))).alias("n")), "normal")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - _gap("n", "way")))
    error = _beside(picked, normal, group).groupBy(group, "n").agg(F.percentile(F.degrees(F.acos(cosine)), F.lit(0.5)).alias("degrees"))
    return error.select(group, "n.*", "degrees", (F.col("degrees") <= limit).alias("consistent"))


def _beside(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows dealt by group with what their group has, which is brought to them."""
    return rows.join(groups.hint("merge"), group)


def camera_places(held: DataFrame, normals: DataFrame, group: str, view: str) -> DataFrame:
    """group, view, u, v: the cameras' places over the plane, in its distances from the reference camera, by the way that
    agrees with the group's normal. Groups without a consistent one, and views without ways, are left out.

    The plane's axes are east = (0, 1, 0) x n and south = n x east.
    """
    n = normals.where("consistent").select(group, F.struct("nx", "ny", "nz").alias("n"))
    met = held.where(F.size("ways") > 0).join(n, group)
    near = F.array_min(F.transform("ways", lambda w: F.struct((1 - (F.col("n.nx") * w["nx"] + F.col("n.ny") * w["ny"] + F.col("n.nz") * w["nz"])).alias("gap"), w["cx"].alias("x"), w["cy"].alias("y"), w["cz"].alias("z"))))
    met = met.select(group, view, "n", near.alias("c"))
    across = F.sqrt(F.col("n.nz") * F.col("n.nz") + F.col("n.nx") * F.col("n.nx"))
    ex, ez = F.col("n.nz") / across, -F.col("n.nx") / across  # east has no y
    sx, sy, sz = F.col("n.ny") * ez, F.col("n.nz") * ex - F.col("n.nx") * ez, -F.col("n.ny") * ex
    u = ex * F.col("c.x") + ez * F.col("c.z")
    v = sx * F.col("c.x") + sy * F.col("c.y") + sz * F.col("c.z")
    return met.select(group, view, u.alias("u"), v.alias("v"))


def planted(e: pd.DataFrame) -> np.ndarray:
    """Homographies from a reference camera (columns r_*) to views, of cameras that look down turned by heading, pitch, roll."""

    def turned(prefix: str) -> np.ndarray:
        roll, pitch, heading = (np.radians(e[f"{prefix}{c}"].to_numpy(np.float64)) for c in ("roll", "pitch", "heading"))
        zero, one = np.zeros(len(e)), np.ones(len(e))
        matrix = lambda *rows: np.stack([np.stack(r, 1) for r in rows], 1)
        rx = matrix((one, zero, zero), (zero, np.cos(roll), -np.sin(roll)), (zero, np.sin(roll), np.cos(roll)))
        ry = matrix((np.cos(pitch), zero, np.sin(pitch)), (zero, one, zero), (-np.sin(pitch), zero, np.cos(pitch)))
        rz = matrix((np.cos(heading), -np.sin(heading), zero), (np.sin(heading), np.cos(heading), zero), (zero, zero, one))
        return rx @ ry @ rz @ np.diag([1.0, -1.0, -1.0])

    own, reference = turned(""), turned("r_")
    place = lambda prefix: e[[f"{prefix}east", f"{prefix}north", f"{prefix}alt"]].to_numpy(np.float64)
    normal = reference @ np.array([0.0, 0.0, -1.0])
    move = np.einsum("nij,nj->ni", own, place("r_") - place(""))
    return own @ np.swapaxes(reference, 1, 2) + move[:, :, None] * (normal / e["r_alt"].to_numpy(np.float64)[:, None])[:, None, :]
