"""Clusters, warping paths, merged segments and interval alignments, value by value, against plain Python written for this test."""

import functools
import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from glossarium.functions import distance as D
from glossarium.operators import intervals as I
from glossarium.plans import all_plans


def stored(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark):
    plans = {p.name: p for p in all_plans()}
    return lambda name: plans[name].run(spark, SMALL).toPandas()


def test_clusters_from_a_fixed_start(run):
    e = stored("embeddings")
    x = {int(k): np.asarray(v, float) for k, v in zip(e.vec_id, e.embedding)}
    start = sorted(x, key=lambda k: (hashlib.md5(f"{k}|1".encode()).hexdigest(), k))[:10]
    means = [x[k] for k in start]
    for _ in range(10):
        near = {k: min(range(10), key=lambda c: (round(float(np.sqrt(((v - means[c]) ** 2).sum())), 9), c)) for k, v in x.items()}
        new = [np.mean([x[k] for k in x if near[k] == c], axis=0) if c in near.values() else means[c] for c in range(10)]
        rest = max(np.abs(a - b).max() for a, b in zip(new, means)) < 1e-12
        means = new
        if rest:
            break
    got = run("kmeans_clusters")
    assert dict(zip(got.vec_id, got.cluster)) == near


def slopes(x, y):
    """Fritsch and Carlson's, in fractions."""
    h = [b - a for a, b in zip(x, x[1:])]
    d = [(b - a) / w for a, b, w in zip(y, y[1:], h)]
    if len(d) == 1:
        return [d[0], d[0]]
    inner = [Fraction(0) if a * b <= 0 else 3 * (u + v) / ((2 * v + u) / a + (v + 2 * u) / b) for a, b, u, v in zip(d, d[1:], h, h[1:])]

    def edge(a, b, u, v):
        s = ((2 * u + v) * a - u * b) / (u + v)
        return Fraction(0) if s * a <= 0 else 3 * a if a * b <= 0 and abs(s) > 3 * abs(a) else s

    return [edge(d[0], d[1], h[0], h[1]), *inner, edge(d[-1], d[-2], h[-1], h[-2])]


def curve(x, y, m, at):
    """One piece as a Bezier curve by repeated halving weights (de Casteljau)."""
    k = max(0, min(len(x) - 2, next((i - 1 for i, v in enumerate(x) if v > at), len(x) - 2)))
    h = x[k + 1] - x[k]
    points, t = [y[k], y[k] + m[k] * h / 3, y[k + 1] - m[k + 1] * h / 3, y[k + 1]], (at - x[k]) / h
    while len(points) > 1:
        points = [a + t * (b - a) for a, b in zip(points, points[1:])]
    return points[0]


def test_curves_by_fractions():
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 9):
        for _ in range(10):
            x = np.cumsum(rng.integers(1, 6, n)).tolist()
            y = rng.integers(-5, 6, n).tolist() if rng.random() < 0.5 else np.cumsum(rng.integers(0, 4, n)).tolist()
            fx, fy = [list(map(Fraction, v)) for v in (x, y)]
            m = slopes(fx, fy)
            at = [Fraction(int(k), 4) for k in range(4 * x[0], 4 * x[-1] + 1)]
            assert np.allclose(D.pchip(x, y, [float(a) for a in at]), [float(curve(fx, fy, m, a)) for a in at], atol=1e-9)


def test_paths_frame_by_frame(run):
    got = run("warp_path_pchip")
    events = stored("events").sort_values(["ts", "event_id"])
    for user, rows in list(got.groupby("user_id"))[:8]:
        p = events[events.user_id == user]
        totals, anchors = (np.cumsum(p.value) - p.value.iloc[0]) / 50, []
        for i, t in enumerate(map(float, totals)):
            if not anchors or not (abs(i - anchors[-1][0]) < 1e-6 and abs(t - anchors[-1][1]) < 1e-6):
                anchors.append((i, t if not anchors or t > anchors[-1][1] else anchors[-1][1] + 1e-4))
        s, t = [list(map(Fraction, v)) for v in zip(*anchors)]
        if len(s) < 2:
            continue
        m, values = slopes(t, s), p.value.to_numpy()
        rows = rows.sort_values("frame")
        assert len(rows) == int(t[-1]) + 1
        for frame in range(0, len(rows), max(1, len(rows) // 40)):
            place = min(max(float(curve(t, s, m, Fraction(frame))), float(min(s))), float(max(s)))
            low = min(int(place), len(values) - 1)
            value = values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])
            assert rows.source.iloc[frame] == pytest.approx(place, abs=1e-5) and rows.value.iloc[frame] == pytest.approx(value, abs=1e-2)


def joined(rows, pause, longest):
    """Segments by recursion: the first one takes in the next, or stays as it is."""
    if len(rows) < 2:
        return list(rows)
    (a, b), (c, d), *rest = rows
    return joined([(a, d), *rest], pause, longest) if c - b < pause and d - a <= longest else [(a, b), *joined(rows[1:], pause, longest)]


def merged(rows, pause, longest, least):
    kept = [s for s in joined(rows, pause, longest) if s[1] - s[0] > least]
    move = [max(0.0, min((c - b) / 2, pause / 4)) for (_, b), (c, _) in zip(kept, kept[1:])]
    return [(a - before, b + after) for (a, b), before, after in zip(kept, [0.0, *move], [*move, 0.0])]


def test_segments_by_recursion(run):
    rng = np.random.default_rng(8)
    for _ in range(200):
        edges = np.cumsum(rng.integers(0, 5, 2 * int(rng.integers(0, 9)))).astype(float)
        rows = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        args = float(rng.integers(1, 5)), float(rng.integers(3, 12)), float(rng.integers(0, 3))
        assert np.allclose(np.array(I.merge_segments(rows, *args)).ravel(), np.array(merged(rows, *args)).ravel(), atol=1e-9) if rows else I.merge_segments(rows, *args) == []
    got, events = run("segment_merge"), stored("events")
    begin = events.ts.astype("datetime64[us]").astype("int64") / 1e6
    want = [(u, a, b) for u, g in begin.groupby(events.user_id) for a, b in merged([(x, x + 60.0) for x in sorted(g)], 20000.0, 90000.0, 61.0)]
    assert len(got) == len(want) and np.allclose(np.array(sorted(got.itertuples(index=False, name=None))), np.array(sorted(want)), rtol=0, atol=1e-5)


def best_ways(a, b, gap=2.0):
    """(cost, {(errors, matched, total distance)}) of all least-cost alignments, by recursion from the ends."""

    @functools.cache
    def ways(i, j):
        if i == len(a) and j == len(b):
            return 0.0, {(0, 0, 0.0)}
        every = []
        if i < len(a):
            every.append((gap, 1, 0, 0.0, ways(i + 1, j)))
        if j < len(b):
            every.append((gap, 1, 0, 0.0, ways(i, j + 1)))
        if i < len(a) and j < len(b):
            d = abs(a[i][0] - b[j][0]) + abs(a[i][1] - b[j][1])
            differ = a[i][2] != b[j][2]
            every.append((d + gap * differ, int(differ), 1, d / 2, ways(i + 1, j + 1)))
        least = min(c + rest for c, *_, (rest, _) in every)
        return least, {(e + x, m + y, round(t + z, 9)) for c, e, m, t, (rest, found) in every if abs(c + rest - least) < 1e-9 for x, y, z in found}

    return ways(0, 0)


def test_alignments_are_among_the_least_ones():
    rng = np.random.default_rng(2)
    for _ in range(150):
        a, b = ([(float(k), k + float(rng.integers(1, 4)) / 2, "xyz"[int(rng.integers(3))]) for k in sorted(rng.choice(9, int(rng.integers(0, 7)), replace=False))] for _ in (0, 1))
        error, rate, matched = I.align_intervals(a, b)
        _, least = best_ways(a, b)
        assert any(m == matched and rate == pytest.approx(e / max(len(a), len(b), 1)) and error == pytest.approx(t / m if m else 0.0) for e, m, t in least)


def test_stored_alignments_are_among_the_least_ones(run):
    got, events = run("interval_alignment"), stored("events").sort_values(["user_id", "ts", "event_id"])
    us = events.ts.astype("datetime64[us]").astype("int64")
    events = events.assign(us=us, next=us.groupby(events.user_id).shift(-1), utterance=lambda d: d.groupby("user_id").cumcount() // 60).dropna(subset=["next"])
    groups = {k: g for k, g in events.assign(pair=events.user_id // 2).groupby(["pair", "utterance"])}
    assert set(groups) == set(zip(got.pair, got.utterance))
    for r in got.sort_values(["pair", "utterance"]).head(12).itertuples():
        g = groups[r.pair, r.utterance]
        a, b = ([(x.us / 1e6 / 3600, x.next / 1e6 / 3600, x.event_type) for x in g[g.user_id % 2 == s].sort_values("us").itertuples()] for s in (0, 1))
        if len(a) * len(b) > 400:
            continue
        _, least = best_ways(tuple(a), tuple(b))
        assert any(m == r.n_matched and r.error_rate == pytest.approx(e / max(len(a), len(b), 1)) and r.boundary_error == pytest.approx(t / m if m else 0.0, abs=1e-6) for e, m, t in least)


#: (source words, target words, words that both have, stretches of the target that the source doesn't have); times in seconds.
WARPS = {
    "silence in the source": ([("left", 0.1, 0.45), ("right", 0.85, 1.3)], [("left", 0.1, 0.4), ("right", 0.45, 0.9)], ["left", "right"], []),
    "silence in the target": ([("left", 0.1, 0.45), ("right", 0.45, 0.9)], [("left", 0.1, 0.4), ("right", 0.8, 1.3)], ["left", "right"], [(0.4, 0.8)]),
    "silence in both": ([("left", 0.1, 0.45), ("right", 0.5, 0.9)], [("left", 0.1, 0.4), ("right", 0.8, 1.3)], ["left", "right"], []),
    "a filler and silence in both": ([("uh", 0.0, 0.2), ("left", 0.3, 0.6), ("right", 0.7, 1.1)], [("left", 0.1, 0.4), ("right", 0.8, 1.2)], ["left", "right"], []),
    "a filler and silence in the target": ([("uh", 0.0, 0.2), ("left", 0.2, 0.6), ("right", 0.6, 1.1)], [("left", 0.1, 0.4), ("right", 0.8, 1.2)], ["left", "right"], [(0.4, 0.8)]),
    "words more and fewer": ([("so", 0.0, 0.2), ("go", 0.2, 0.5), ("on", 0.5, 0.8), ("now", 0.8, 1.2)], [("go", 0.1, 0.5), ("right", 0.5, 0.9), ("on", 0.9, 1.1), ("now", 1.1, 1.4)], ["go", "on", "now"], [(0.5, 0.9)]),
    "the same": ([("go", 0.0, 0.4), ("on", 0.4, 0.8)], [("go", 0.0, 0.4), ("on", 0.4, 0.8)], ["go", "on"], []),
}


@pytest.mark.parametrize("case", WARPS)
def test_warping_cases(spark, case):
    """Frames of a shared word come from within that word of the source; stretches that only the target has are told."""
    source, target, shared, new = WARPS[case]
    rate = 86.13
    pairs = I.lcs_pairs([w for w, _, _ in source], [w for w, _, _ in target])
    assert [source[i][0] for i, _ in pairs] == [target[j][0] for _, j in pairs] == shared
    anchors = [(s * rate, t * rate) for i, j in pairs for s, t in zip(source[i][1:], target[j][1:])]
    x, y = zip(*I.monotone_anchors(anchors))
    path = D.warp_path(x, y, round(target[-1][2] * rate))
    for i, j in pairs:
        frames = np.arange(int(np.ceil(target[j][1] * rate)), int(target[j][2] * rate))
        inside = path[frames[frames < len(path)]]
        assert (inside >= source[i][1] * rate - 1.5).all() and (inside <= source[i][2] * rate + 1.5).all()
    assert (np.diff(path[int(np.ceil(y[0])) : int(y[-1])]) >= -1e-9).all()
    rows = [(1, float(k), s / rate, t / rate) for k, (s, t) in enumerate(anchors)]
    found = I.inserted_silence(spark.createDataFrame(rows, "f long, place double, source double, target double"), ["f"], "place", "source", "target").collect()
    assert [(round(r.begin, 6), round(r.stop, 6)) for r in found] == new
