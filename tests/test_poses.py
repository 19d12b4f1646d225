"""Homographies taken apart, and the normal that a group's views agree on."""

import numpy as np
import pandas as pd

from terraweft.operators import poses


def captures(seed, n, group, level=False):
    rng = np.random.default_rng(seed)
    e = pd.DataFrame({c: rng.uniform(-s, s, n) for c, s in (("east", 60), ("north", 60), ("roll", 0 if level else 14), ("pitch", 0 if level else 14), ("heading", 180))})
    e["alt"] = rng.uniform(30, 60, n)
    for c in ("east", "north", "alt", "heading", "roll", "pitch"):
        e[f"r_{c}"] = e[c].iloc[0]
    return e.assign(g=group, v=np.arange(n))


def test_one_way_is_the_planted_one():
    e = captures(1, 40, 1).iloc[1:]
    h = poses.planted(e)
    r, t, n, moved = poses.decompose(h * np.where(np.arange(len(e)) % 2, -3.0, 0.5)[:, None, None])
    roll, pitch = np.radians(e.r_roll.iloc[0]), np.radians(e.r_pitch.iloc[0])
    truth = np.array([np.sin(pitch), -np.sin(roll) * np.cos(pitch), np.cos(roll) * np.cos(pitch)])
    gap = np.abs(n - truth).max(2)
    assert (gap.min(1) < 1e-9).all() and (moved > 0.03).all()
    for k in range(len(e)):
        for w in (0, 1):
            again = r[k, w] + np.outer(t[k, w], n[k, w])
            assert np.allclose(r[k, w] @ r[k, w].T, np.eye(3), atol=1e-9) and np.allclose(again / np.linalg.svd(again)[1][1], h[k] / np.linalg.svd(h[k])[1][1], atol=1e-9)


def test_consensus_with_noise_gross_errors_and_no_plane(spark):
    rng = np.random.default_rng(5)
    frames, truth = [], {}
    for g in (1, 2, 3):
        e = captures(10 + g, 30, g)
        h = poses.planted(e).reshape(-1, 9)
        if g == 1:
            h = h + rng.normal(0, 1e-4, h.shape)
            wild = rng.permutation(np.arange(1, 30))[:6]
            h[wild] = rng.normal(0, 1, (6, 9))
        if g == 2:  # every view has a ground of its own
            for k in range(1, 30):
                one = captures(100 + k, 2, g)
                h[k] = poses.planted(one)[1].reshape(9)
                h[k] = poses.planted(one.assign(r_roll=rng.uniform(-60, 60), r_pitch=rng.uniform(-60, 60)))[1].reshape(9)
        e["h"] = list(h)
        frames.append(e)
        roll, pitch = np.radians(e.roll.iloc[0]), np.radians(e.pitch.iloc[0])
        truth[g] = np.array([np.sin(pitch), -np.sin(roll) * np.cos(pitch), np.cos(roll) * np.cos(pitch)])
    every = pd.concat(frames)
    rows = [(int(a), int(b), [float(x) for x in h]) for a, b, h in zip(every.g, every.v, every.h)]
    rows += [(3, 100, None), (3, 101, [1.0]), (3, 102, [float("nan")] * 9), (4, 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])]
    held = poses.with_ways(spark.createDataFrame(rows, "g long, v long, h array<double>"))
    found = {r.g: r for r in poses.plane_normals(held, "g", "v").collect()}
    assert set(found) == {1, 2, 3} and found[1].consistent and found[3].consistent and not found[2].consistent and found[2].degrees > 15
    for g, limit in ((1, 0.02), (3, 1e-8)):
        assert np.abs(np.array([found[g].nx, found[g].ny, found[g].nz]) - truth[g]).max() < limit
    places = poses.camera_places(held, poses.plane_normals(held, "g", "v"), "g", "v").select("g").distinct().collect()
    assert {r.g for r in places} == {1, 3}


def test_places_are_the_planted_ones_but_for_a_similarity(spark):
    e = captures(21, 25, 1)
    e["h"] = list(poses.planted(e).reshape(-1, 9))
    held = poses.with_ways(spark.createDataFrame([(1, int(b), [float(x) for x in h]) for b, h in zip(e.v, e.h)], "g long, view long, h array<double>"))
    got = poses.camera_places(held, poses.plane_normals(held, "g", "view"), "g", "view").orderBy("view").collect()
    u = np.array([complex(r.u, r.v) for r in got])
    x = (e.east - 1j * e.north).to_numpy()
    fit = np.polyfit(u, x, 1)
    assert np.abs(np.polyval(fit, u) - x).max() < 1e-6 and abs(abs(fit[0]) - e.alt.iloc[0]) < 1e-6
