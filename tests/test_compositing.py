"""Warp, masks, morphology, blending, exposure and seams by brute force."""

import math
import random

import numpy as np
import pytest

from terraweft.operators import compositing


def dense(cells, rows, cols):
    out = np.full((rows, cols), np.nan)
    for r in cells:
        out[r.row, r.col] = r.value
    return out


def warp_by_force(image, h, rows, cols):
    height, width = image.shape
    out, inverse = {}, np.linalg.inv(np.array(h).reshape(3, 3))
    for r in range(rows):
        for c in range(cols):
            x, y, w = inverse @ (c, r, 1.0)
            x, y = x / w, y / w
            total = inside = 0.0
            for dr in (0, 1):
                for dc in (0, 1):
                    rr, cc = math.floor(y) + dr, math.floor(x) + dc
                    share = (y - math.floor(y) if dr else 1 - y + math.floor(y)) * (x - math.floor(x) if dc else 1 - x + math.floor(x))
                    total += share * image[min(height - 1, max(0, rr)), min(width - 1, max(0, cc))]
                    inside += share * (0 <= rr < height and 0 <= cc < width)
            if inside >= 0.999:
                out[r, c] = total
    return out


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_warp_by_force(spark, tile):
    rng = np.random.default_rng(tile)
    image = rng.integers(0, 256, (9, 13)).astype(float)
    views = {0: [1, 0, 0, 0, 1, 0, 0, 0, 1], 1: [1.5, -0.8, 6, 0.7, 1.4, -2, 0.01, -0.02, 1], 2: [-1, 0, 20, 0, -1.2, 15, 0, 0.03, 1.0], 3: [2, 0, -9, 0, 2, -5, 0, 0, 2], 4: [1, 0, 0, 0, 1, 0, 0.2, 0, -1.0], 5: [1, 0, 500, 0, 1, 0, 0, 0, 1]}
    pixels = spark.createDataFrame([(7, r, c, float(image[r, c])) for r in range(9) for c in range(13)] + [(8, 0, 0, 1.0)], "image long, row int, col int, value double")
    frame = spark.createDataFrame([(k, 7, [float(x) for x in h]) for k, h in views.items()] + [(9, 8, [float(x) for x in views[0]]), (10, 99, [float(x) for x in views[0]])], "view long, image long, h array<double>")
    got = compositing.warped(pixels, frame, 9, 13, 20, 24, tile=tile).collect()
    for k, h in views.items():
        want = {} if k == 4 else warp_by_force(image, h, 20, 24)  # 4: a horizon crosses the frame
        mine = {(r.row, r.col): r.value for r in got if r.view == k}
        assert mine.keys() == want.keys() and all(abs(mine[p] - want[p]) < 1e-9 for p in want)
    assert not [r for r in got if r.view > 5] and sum(r.view == 1 for r in got) > 50
    assert {(r.row, r.col): r.weight for r in got if r.view == 0}[0, 5] == 0.0


def test_scan_lines_by_force(spark):
    """Concave polygons with corners on rows and cells, a spiral, and one too small to hold a cell."""
    polygons = {
        1: [(2, 2), (14, 2), (14, 12), (8, 6), (2, 12)], 2: [(0.5, 0.5), (10.5, 3), (3, 4.2), (11, 9), (2.5, 7.7)], 3: [(1, 1), (12, 1), (12, 12), (3, 12), (3, 4), (9, 4), (9, 9), (6, 9), (6, 6), (7, 6), (7, 8), (8, 8), (8, 5), (4, 5), (4, 11), (11, 11), (11, 2), (1, 2)],
        4: [(5.1, 5.1), (5.4, 5.2), (5.3, 5.6)], 5: [(3, 3), (9, 3)], 6: [(-5, -5), (30, -4), (12, 40)],
    }
    frame = spark.createDataFrame([(k, [float(x) for x, _ in p], [float(y) for _, y in p]) for k, p in polygons.items()], "id long, xs array<double>, ys array<double>")
    for grow in (0, 2):
        got = {(r.id, r.row, r.col) for r in compositing.span_cells(compositing.polygon_spans(frame, grow), ["id", "row"], 16, 16).collect()}
        want = set()
        for k, p in polygons.items():
            if len(p) < 3:
                continue
            for r in range(-4, 20):
                for c in range(-4, 20):
                    odd = sum((y1 > r) != (y2 > r) and c < x1 + (r - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])) % 2
                    if odd:
                        want |= {(k, r + a, c + b) for a in range(-grow, grow + 1) for b in range(-grow, grow + 1) if 0 <= r + a < 16 and 0 <= c + b < 16}
        assert got == want


def test_morphology_by_force(spark):
    rng = random.Random(4)
    rows, cols = 17, 19
    sets = {g: {(rng.randrange(rows), rng.randrange(cols)) for _ in range(n)} for g, n in ((1, 60), (2, 130), (3, 220), (4, 1))}
    sets[5] = {(r, c) for r in range(3, 12) for c in range(3, 14)} - {(r, c) for r in range(5, 10) for c in range(5, 12)} | {(7, 8)}  # a ring around an island
    sets[6] = sets[5] - {(3, 8), (4, 8)}  # the ring is open
    frame = spark.createDataFrame([(g, r, c) for g, s in sets.items() for r, c in s], "g long, row int, col int")
    found = lambda df: {g: {(r.row, r.col) for r in rowset if r.g == g} for rowset in (df.collect(),) for g in sets}
    grow = lambda s, el: {(r + a, c + b) for r, c in s for a, b in el if 0 <= r + a < rows and 0 <= c + b < cols}
    every = {(r, c) for r in range(rows) for c in range(cols)}
    shrink = lambda s, el: {p for p in every if all((p[0] + a, p[1] + b) in s or (p[0] + a, p[1] + b) not in every for a, b in el)}
    assert found(compositing.dilated(frame, "g", rows, cols)) == {g: grow(s, compositing.SQUARE) for g, s in sets.items()}
    assert found(compositing.closed(frame, "g", rows, cols)) == {g: shrink(grow(s, compositing.ELLIPSE), compositing.ELLIPSE) for g, s in sets.items()}

    def fill(s):
        seen, todo = set(), [(-1, -1)]
        while todo:
            p = todo.pop()
            if p in seen or p in s or not (-1 <= p[0] <= rows and -1 <= p[1] <= cols):
                continue
            seen.add(p)
            todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        return every - seen

    got = found(compositing.filled(frame, "g", rows))
    assert got == {g: fill(s) for g, s in sets.items()} and len(got[5]) == 99 and got[6] == sets[6]


def _kernel_mean(values, weights, places, coarse):
    """Kernel means at places of the other level; dictionaries of (row, col)."""
    out = {}
    for r, c in places:
        total = mass = 0.0
        for (a, b), v in values.items():
            dr, dc = (a - 2 * r, b - 2 * c) if coarse else (r - 2 * a, c - 2 * b)
            k = compositing.KERNEL.get(dr, 0) * compositing.KERNEL.get(dc, 0)
            total, mass = total + k * v, mass + k
        if mass:
            out[r, c] = total / mass
    return out


def test_bands_by_force(spark):
    """Two overlapping views, one of them with a gap, against plain loops; a view alone comes back unchanged."""
    rng = random.Random(6)
    views = {1: {(r, c) for r in range(10) for c in range(8)} - {(4, 4), (4, 5)}, 2: {(r, c) for r in range(2, 12) for c in range(5, 14)}}
    data = {v: ({p: rng.uniform(0, 255) for p in sorted(s)}, {p: rng.uniform(0.1, 1) for p in sorted(s)}) for v, s in views.items()}
    rows = [(1, v, r, c, data[v][0][r, c], data[v][1][r, c]) for v, s in views.items() for r, c in s] + [(2, 5, r, c, data[1][0][r, c], 0.3) for r, c in views[1]] + [(3, 6, 0, 0, 9.0, 0.0)]
    frame = spark.createDataFrame(rows, "g long, v long, row int, col int, value double, weight double")
    got = {(r.g, r.row, r.col): r.value for r in compositing.multiband(frame, "g", "v", 3).collect()}
    assert all(abs(got[2, r, c] - data[1][0][r, c]) < 1e-9 for r, c in views[1])
    levels = {v: [d] for v, d in data.items()}
    for n in range(3):
        for v in views:
            value, weight = levels[v][n]
            places = [(r, c) for r in range(-2, 10) for c in range(-2, 10)]
            levels[v].append(tuple(_kernel_mean(x, None, places, True) for x in (value, weight)))
    mix = lambda parts: {p: sum(w[p] * b[p] for b, w in parts if p in b) / sum(w[p] for b, w in parts if p in b) for p in set().union(*(b for b, _ in parts))}
    out = mix([levels[v][3] for v in views])
    for n in (2, 1, 0):
        bands = []
        for v in views:
            value, weight = levels[v][n]
            rough = _kernel_mean(levels[v][n + 1][0], None, list(value), False)
            bands.append(({p: value[p] - rough[p] for p in value}, weight))
        band = mix(bands)
        rough = _kernel_mean(out, None, list(band), False)
        out = {p: band[p] + rough[p] for p in band}
    assert {(r, c) for g, r, c in got if g == 1} == set(out) and all(abs(got[1, *p] - x) < 1e-9 for p, x in out.items())
    assert not [k for k in got if k[0] == 3]


def test_gains_equal_a_dense_solve(spark):
    from terraweft.operators import seams

    rng = random.Random(9)
    rows = [(g, v, r, c, rng.uniform(20, 230)) for g in (1, 2) for v, (r0, c0) in enumerate(((0, 0), (2, 3), (4, 1), (40, 40))) for r in range(r0, r0 + 6) for c in range(c0, c0 + 7)]
    frame = spark.createDataFrame(rows, "g long, v long, row int, col int, value double")
    entries, right = seams.exposure_system(frame, "g", "v", 3)
    b = {r.i: r.b for r in right.collect()}
    order = {i: k for k, i in enumerate(sorted(b))}
    matrix = np.zeros((len(order), len(order)))
    for r in entries.collect():
        matrix[order[r.i], order[r.j]] = r.a
    assert np.allclose(matrix, matrix.T) and np.linalg.eigvalsh(matrix).min() > 0
    want = np.linalg.solve(matrix, [b[i] for i in sorted(b)])
    got = {r.i: r.x for r in seams.conjugate_gradients(entries, right).collect()}
    assert np.allclose([got[i] for i in sorted(b)], want, atol=1e-6) and want.std() > 0.05
    named = seams.block_gains(frame, "g", "v", 3).collect()
    assert sorted(round(r.gain, 6) for r in named) == sorted(np.round(want, 6)) and all(abs(r.gain - 1) < 1e-6 for r in named if r.v == 3)
    cells = {(v, r // 3, c // 3, r, c): x for g, v, r, c, x in rows if g == 1}
    a, k = [[(p[3], p[4]) for p in cells if p[:3] == block] for block in ((0, 1, 1), (1, 1, 1))]
    shared = [p for p in a if p in k]
    m, n = (np.mean([cells[*block, *p] for p in shared]) for block in ((0, 1, 1), (1, 1, 1)))
    i, j = (spark.createDataFrame([(1, *block)], "g long, v long, r long, c long").selectExpr("xxhash64(struct(g, v, r, c)) AS i").first().i for block in ((0, 1, 1), (1, 1, 1)))
    assert abs(matrix[order[i], order[j]] + 2 * seams.ALPHA * m * n * len(shared)) < 1e-6


def test_seams_equal_an_exhaustive_cut(spark):
    from itertools import product

    from terraweft.operators import seams

    rng = random.Random(3)
    shapes = {1: {(r, c) for r in range(5) for c in range(4)}, 2: {(r, c) for r in range(1, 6) for c in range(1, 6) if (r, c) != (2, 2)}, 3: {(4, 3), (5, 3), (5, 4)}, 4: {(20, 20)}}
    values = {(v, *p): float(rng.randrange(6)) for v, s in shapes.items() for p in s}
    frame = spark.createDataFrame([(7, *k, x) for k, x in values.items()], "g long, v long, row int, col int, value double")
    pairs = spark.createDataFrame([(7, 1, 2), (7, 2, 3), (7, 1, 3), (7, 1, 4)], "g long, a long, b long")
    got = seams.cuts(frame, pairs, "g", "v").collect()
    for a, b in ((1, 2), (2, 3), (1, 3), (1, 4)):
        shared = sorted(shapes[a] & shapes[b])
        mine = [(r.row, r.col) for r in sorted(got, key=lambda r: r.row) if (r.a, r.b) == (a, b)]
        if not shared:
            assert not mine
            continue
        rows, cols = range(shared[0][0], shared[-1][0] + 1), range(min(c for _, c in shared), max(c for _, c in shared) + 1)
        cost = lambda r, c: abs(values[a, r, c] - values[b, r, c]) if (r, c) in shared else seams.OUTSIDE
        ways = [w for w in product(cols, repeat=len(rows)) if all(abs(x - y) <= 1 for x, y in zip(w, w[1:]))]
        best = min((sum(cost(r, c) for r, c in zip(rows, w)), w[::-1]) for w in ways)
        assert [c for _, c in mine] == list(best[1][::-1]) and [r for r, _ in mine] == list(rows)
        assert {r.cost for r in got if (r.a, r.b) == (a, b)} == {best[0]}


def test_a_map_from_images(spark):
    """A view alone comes back as it was warped; of two that differ in brightness the balanced map's step is smaller."""
    from terraweft.operators import orthomosaic

    rng = np.random.default_rng(3)
    ground = rng.uniform(60, 120, (20, 30))
    rows = []
    for image, (left, factor) in {1: (0, 1.0), 2: (10, 1.5), 3: (0, 1.0)}.items():
        rows += [(image, r, c, float(factor * ground[r, left + c])) for r in range(20) for c in range(16)]
    pixels = spark.createDataFrame(rows, "image long, row int, col int, value double")
    shift = lambda x: [1.0, 0.0, float(x), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = spark.createDataFrame([(1, 1, 1, shift(0)), (1, 2, 2, shift(10)), (2, 3, 3, shift(0)), (3, 4, 1, shift(900))], "group long, view long, image long, h array<double>")
    maps = {}
    for balance in (False, True):
        done, said = orthomosaic.rendered(pixels, views, 20, 16, 20, 30, tile=8, block=10, bands=2, balance=balance)
        maps[balance] = {(r.group, r.row, r.col): r.value for r in done.collect()}
        told = {r.group: (r.connected_frames, r.texture_frames, r.coverage_fraction) for r in said.collect()}
    assert told == {1: (2, 2, round(18 * 24 / 600, 9)), 2: (1, 1, round(18 * 14 / 600, 9)), 3: (1, 0, 0.0)}
    alone = {(r, c): v for (g, r, c), v in maps[False].items() if g == 2}
    assert alone.keys() == {(r, c) for r in range(1, 19) for c in range(1, 15)} and all(abs(v - ground[p]) < 1e-9 for p, v in alone.items())
    assert maps[True].keys() == maps[False].keys()
    seen = orthomosaic.sources(pixels, views, 20, 16, 20, 30, tile=8)
    gap = lambda df: df.where("group = 1 and col between 11 and 14").groupBy("row", "col").pivot("view", [1, 2]).sum("value").selectExpr("avg(`2` - `1`) AS d").first().d
    assert 0 < gap(orthomosaic.balanced(seen, 10)) < 0.6 * gap(seen)
