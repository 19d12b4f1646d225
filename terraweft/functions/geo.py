"""Flat-earth geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The two earth models in use, and the foot.
METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6_371_000.0
METRES_PER_FOOT = 0.3048

Point = tuple[float, float]


class Area:
    """A polygon of (lat, lon) corners with the local metre frame of its corner mean."""

    def __init__(self, corners: Sequence[Point]) -> None:
        if len(corners) < 3:
            raise ValueError("an area has three corners at least")
        self.corners = [(float(a), float(b)) for a, b in corners]
        self.lat = sum(a for a, _ in self.corners) / len(self.corners)
        self.lon = sum(b for _, b in self.corners) / len(self.corners)
        scale = METRES_PER_DEGREE * math.cos(math.radians(self.lat))
        self.local = [((b - self.lon) * scale, (a - self.lat) * METRES_PER_DEGREE) for a, b in self.corners]
        self.edges = list(zip(self.local, [*self.local[1:], self.local[0]], strict=True))

    def east_north(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return to_local(lat, lon, self.lat, self.lon)

    def contains(self, lat: Column, lon: Column) -> Column:
        """Half-open even-odd test: an edge counts where it crosses the point's row to the right of the point."""
        return crossings_odd(*self.east_north(lat, lon), self.edges)


def to_local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """(east, north) in metres about an origin."""
    east = (lon - F.lit(lon0)) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    return east, (lat - F.lit(lat0)) * F.lit(METRES_PER_DEGREE)


def to_degrees(east: Column, north: Column, lat0: float) -> tuple[Column, Column]:
    """(dlat, dlon) of a metre offset."""
    return north / F.lit(METRES_PER_DEGREE), east / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(F.lit(lat0))))


def sphere_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance on the sphere's radius at the mean latitude."""
    east = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * EARTH_RADIUS
    return F.hypot(east, F.radians(lat2 - lat1) * EARTH_RADIUS)


def crossings_odd(x: Column, y: Column, edges: Sequence[tuple[Point, Point]]) -> Column:
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in edges:
        if y1 == y2:
            continue
        at = F.lit(x1) + (y - F.lit(y1)) * F.lit(x2 - x1) / F.lit(y2 - y1)
        inside = inside != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at))
    return inside


def on_segment(x: Column, y: Column, a: Point, b: Point) -> Column:
    """Within 1e-7 of the line and 1e-8 of the box of a segment."""
    off = F.abs(F.lit(b[0] - a[0]) * (y - F.lit(a[1])) - F.lit(b[1] - a[1]) * (x - F.lit(a[0])))
    return (
        (off <= 1e-7)
        & x.between(min(a[0], b[0]) - 1e-8, max(a[0], b[0]) + 1e-8)
        & y.between(min(a[1], b[1]) - 1e-8, max(a[1], b[1]) + 1e-8)
    )


def within_fence(x: Column, y: Column, edges: Sequence[tuple[Point, Point]]) -> Column:
    """Even-odd test to which the border itself belongs."""
    border = F.lit(False)
    for a, b in edges:
        border = border | on_segment(x, y, a, b)
    return border | crossings_odd(x, y, edges)


def sides(corners: Column) -> Column:
    """The edges of a polygon that is a column: struct(a, b) of neighbouring corners (struct(e, n)), the last with the first."""
    after = F.concat(F.slice(corners, 2, F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))
    return F.zip_with(corners, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """crossings_odd for polygons of a table."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = a["e"] + (y - a["n"]) * (b["e"] - a["e"]) / F.nullif(b["n"] - a["n"], F.lit(0.0))
        return ((a["n"] > y) != (b["n"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.aggregate(sides(corners), F.lit(False), lambda odd, s: odd != crossed(s))


def in_fence(x: Column, y: Column, corners: Column) -> Column:
    """within_fence for fences of a table: the border belongs to it."""

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        off = F.abs((b["e"] - a["e"]) * (y - a["n"]) - (b["n"] - a["n"]) * (x - a["e"]))
        box = x.between(F.least(a["e"], b["e"]) - 1e-8, F.greatest(a["e"], b["e"]) + 1e-8) & y.between(F.least(a["n"], b["n"]) - 1e-8, F.greatest(a["n"], b["n"]) + 1e-8)
        return (off <= 1e-7) & box

    return F.exists(sides(corners), on) | in_polygon(x, y, corners)


def ground_width(altitude: Column, view_degrees: float) -> Column:
    return altitude * (2 * math.tan(math.radians(view_degrees) / 2))


def equivalent_focal(view_degrees: Column) -> Column:
    """Focal length in mm on 36 mm wide film, rounded half to even."""
    return F.bround(F.lit(18.0) / F.tan(F.radians(view_degrees) / 2), 0).cast("int")


def sexagesimal(degrees: Column) -> Column:
    """(degrees, minutes, hundredths of seconds, truncated) of the absolute value."""
    d = F.abs(degrees)
    whole = F.floor(d)
    minutes = F.floor((d - whole) * 60)
    return F.struct(whole.alias("degrees"), minutes.alias("minutes"), F.floor(((d - whole) * 60 - minutes) * 60 * 100).alias("centiseconds"))


def from_sexagesimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60 + s / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def apply_homography(h: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    w = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))  # a point at infinity is null
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def normal_pixel(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Pixels with the width as two units and the centre as origin."""
    return x * 2 / width - 1, y * 2 / width - height / width


def bearing(east: Column, north: Column) -> Column:
    """Compass degrees of a direction."""
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def segment_cut(ax: Column, ay: Column, bx: Column, by: Column, c: Point, d: Point) -> Column:
    """Parameters along a-b at which it meets the segment c-d (an array; both ends of an overlap)."""
    rx, ry, sx, sy = bx - ax, by - ay, F.lit(d[0] - c[0]), F.lit(d[1] - c[1])
    det = rx * sy - ry * sx
    some = F.nullif(det, F.lit(0.0))
    t = ((F.lit(c[0]) - ax) * sy - (F.lit(c[1]) - ay) * sx) / some
    u = ((F.lit(c[0]) - ax) * ry - (F.lit(c[1]) - ay) * rx) / some
    tol = 1e-9
    crossing = F.when(t.between(-tol, 1 + tol) & u.between(-tol, 1 + tol), F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))))
    length = rx * rx + ry * ry
    ends = []
    for px, py in (c, d):
        along = ((F.lit(px) - ax) * rx + (F.lit(py) - ay) * ry) / F.nullif(length, F.lit(0.0))
        off = F.abs(rx * (F.lit(py) - ay) - ry * (F.lit(px) - ax))
        box = F.lit(px).between(F.least(ax, bx) - 1e-8, F.greatest(ax, bx) + 1e-8) & F.lit(py).between(F.least(ay, by) - 1e-8, F.greatest(ay, by) + 1e-8)
        ends.append(F.when((off <= 1e-7) & box, along))
    overlap = F.filter(F.array(*ends), lambda v: v.isNotNull())
    none = F.array().cast("array<double>")
    return F.when(F.abs(det) >= tol, F.coalesce(crossing, none)).when(length == 0, none).otherwise(overlap)


def general_number(x: Column, digits: int = 12) -> Column:
    """A double as printf's %.<digits>g writes it: significant digits, no trailing zeros, an exponent where it is long.

    A zero has no sign; null where there is no finite number."""

    @F.arrow_udf(StringType())
    def written(values: pa.Array) -> pa.Array:
        # Equal numbers of a batch are written once; adding 0.0 takes the sign from a zero.
        d = values.dictionary_encode()
        return pa.array([f"{v + 0.0:.{digits}g}" if math.isfinite(v) else None for v in d.dictionary.to_pylist()], pa.string()).take(d.indices)

    return written(x.cast("double"))


FAULTS = ("count", "duplicate", "extent", "collinear", "crossing")
#: Pairs of edges that are compared at once.
PAIRS = 1 << 20


def _faults_of(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each of FAULTS holds, (fences, 5), of fences of one size: coordinates (fences, corners), without a closing one."""
    m, k = e.shape
    if not k:
        return np.tile([True, False, False, False, False], (m, 1))
    i, j = np.triu_indices(k, 1)
    be, bn = np.roll(e, -1, 1), np.roll(n, -1, 1)
    ce, cn = np.roll(e, -2, 1), np.roll(n, -2, 1)
    twice = ((e[:, i] == e[:, j]) & (n[:, i] == n[:, j])).any(1)
    far = (np.hypot(e[:, i] - e[:, j], n[:, i] - n[:, j]) > 20_000).any(1)
    line = (np.abs((be - e) * (cn - n) - (bn - n) * (ce - e)) < 1e-7).any(1)
    apart = (j > i + 1) & ~((i == 0) & (j == k - 1))
    i, j = i[apart], j[apart]
    a, b, c, d = (e[:, i], n[:, i]), (be[:, i], bn[:, i]), (e[:, j], n[:, j]), (be[:, j], bn[:, j])
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    s1, s2, s3, s4 = cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)
    meet = (np.sign(s1) * np.sign(s2) < 0) & (np.sign(s3) * np.sign(s4) < 0)
    for s, p, q, r in ((s1, a, b, c), (s2, a, b, d), (s3, c, d, a), (s4, c, d, b)):
        at = np.nonzero(np.abs(s) <= 1e-7)
        near = np.ones(len(at[0]), bool)
        for x in (0, 1):
            u, v, w = p[x][at], q[x][at], r[x][at]
            near &= (np.minimum(u, v) - 1e-8 <= w) & (w <= np.maximum(u, v) + 1e-8)
        meet[at] |= near
    return np.stack([np.full(m, not 3 <= k <= 70), twice, far, line, meet.any(1)], 1)


@F.pandas_udf(ArrayType(StringType()))
def _faults(east: pd.Series, north: pd.Series) -> pd.Series:
    """Fences of a batch are judged together with those of like size."""
    out: list = [[]] * len(east)
    sized: dict[int, list[int]] = {}
    for at, e in enumerate(east):
        if e is not None:
            sized.setdefault(len(e), []).append(at)
    for k, every in sized.items():
        step = max(1, PAIRS // max(1, k * k))
        for start in range(0, len(every), step):
            some = every[start : start + step]
            e, n = (np.stack([s.iat[at] for at in some]).astype(np.float64).reshape(len(some), k) for s in (east, north))
            shut = (e[:, 0] == e[:, -1]) & (n[:, 0] == n[:, -1]) if k > 1 else np.zeros(len(some), bool)
            for closed in (False, True):
                own = np.flatnonzero(shut == closed)
                if len(own):
                    for at, bad in zip(own, _faults_of(e[own, : k - closed], n[own, : k - closed]), strict=True):
                        out[some[at]] = [f for f, b in zip(FAULTS, bad, strict=True) if b]
    return pd.Series(out, dtype="object")


def fence_faults(corners: Column) -> Column:
    """What is wrong with a fence (array of struct(e, n), metres; finite): an array of FAULTS.

    A last corner that repeats the first closes the fence and is left out. Three to seventy corners, none twice, none more than
    20 km apart, no three in a row on a line, and edges that are no neighbours neither cross nor touch.
    """
    return _faults(F.transform(corners, lambda p: p["e"].cast("double")), F.transform(corners, lambda p: p["n"].cast("double")))
