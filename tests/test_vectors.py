"""Density clusters, the inverted-list index and residual codebooks against plain numpy."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from glossarium.operators import cells as C
from glossarium.operators import clustering as K
from glossarium.operators import codebooks as B
from glossarium.operators import vector_index as I
from glossarium.operators.relational import hash_rank
from glossarium.operators.stages import Stages, connected
from glossarium.plans import all_plans

PLANS = {p.name: p for p in all_plans()}


def brute_dbscan(rows, radius, least):
    """{key: (n_near, core, cluster)} of distinct keys."""
    key, v = np.array([k for k, _ in rows]), np.array([x for _, x in rows], float)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), 9)
    near = d <= radius
    core, label = near.sum(1) >= least, {}
    for i in np.argsort(key):
        todo = [i] if core[i] and i not in label else []
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = int(key[i])
                todo += np.flatnonzero(near[j] & core).tolist()
    out = {}
    for i in range(len(key)):
        around = np.flatnonzero(near[i] & core)
        to = i if core[i] else min(around, key=lambda j: (d[i, j], key[j])) if len(around) else None
        out[int(key[i])] = (int(near[i].sum()), bool(core[i]), label[to] if to is not None else -1)
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 40)
    monkeypatch.setattr(C, "PER_PIVOT", 30)
    monkeypatch.setattr(C, "ROWS", 25)


@pytest.mark.parametrize("seed", [1, 2])
def test_density_clusters(spark, small_cells, seed):
    rng = np.random.default_rng(seed)
    blobs = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in (((0, 0, 0), 0.3, 80), ((2, 0, 0), 0.2, 60), ((0, 3, 0), 0.4, 70), ((1, 1, 1), 2.5, 40))])
    blobs[200:230] = blobs[0]  # one vector many times, and points at equal distances
    grid = np.array([[5 + x, 5 + y, 0] for x in range(6) for y in range(6)], float)
    v = np.concatenate([blobs, grid])
    rows = [(int(k), x.tolist()) for k, x in zip(rng.permutation(len(v)) + 7, v)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    for radius, least in ((0.35, 5), (1.0, 4)):
        got = {r.k: (r.n_near, r.core, r.cluster) for r in K.dbscan(df, "k", "v", radius, least).collect()}
        assert got == brute_dbscan(rows, radius, least)


def test_density_clusters_send_a_vector_once_to_a_group(spark, small_cells, monkeypatch):
    monkeypatch.setattr(C, "GROUPS", 3)
    v = np.random.default_rng(5).normal(size=(400, 12))
    rows = [(int(k), x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "key long, v array<double>").repartition(3)
    groups = C.Groups(df, C.pivots_of(df, len(v)), 3.2)
    sent = groups.visits(df).select("group", F.size("places").alias("n")).collect()
    assert len(sent) <= 3 * len(v) < 5 * len(v) < sum(r.n for r in sent)  # vectors without structure visit nearly all cells
    got = {r.key: (r.n_near, r.core, r.cluster) for r in K.dbscan(df, "key", "v", 3.2, 6).collect()}
    want = brute_dbscan(rows, 3.2, 6)
    assert got == want and len({c for _, _, c in want.values()}) > 1 and not all(core for _, core, _ in want.values())


def test_density_clusters_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 5), (1, [0.0, 0.0], 6), (2, None, 7), (None, [0.0, 0.0], 8), (3, [9.0, 9.0], 9)], "k long, v array<double>, cluster long")
    assert sorted((r.k, r.n_near, r.core, r.cluster) for r in K.dbscan(df, "k", "v", 1.0, 2).collect()) == [(1, 2, True, 1), (1, 2, True, 1), (3, 1, False, -1)]
    assert K.dbscan(df.limit(0), "k", "v", 1.0, 2).count() == 0


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long"), Stages(spark)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}


def test_index_finds_the_nearest(spark, small_cells):
    want = {(r.query, r.other) for r in PLANS["index_neighbours_all_lists"].run(spark, SMALL).collect()}
    got = PLANS["index_neighbours"].run(spark, SMALL).collect()
    assert len({(r.query, r.other) for r in got} & want) >= 0.9 * len(want)
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    index = I.InvertedLists(e, "vec_id", "embedding")
    assert index.rows.count() == e.count() and index.rows.select("cell").distinct().count() > 5


def test_index_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0])], "k long, v array<double>")
    index = I.InvertedLists(df, "k", "v", lists=2)
    got = [(r.query, r.rank, r.other, round(r.distance, 6)) for r in index.search(df.filter("k = 1"), "k", "v", 5, 2).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 0.0), (1, 2, 2, 1.0)]
    empty = I.InvertedLists(df.limit(0), "k", "v")
    assert empty.search(df, "k", "v", 5, 3).count() == 0 and empty.probes_for(5, 0.9) == 1


def plain_stage(v, batch_of, order, size, batches, passes, means, decay, dead, sample):
    """One stage over rows v in numpy."""
    close = lambda x, e: np.round((x * x).sum(1)[:, None] - 2 * x @ e.T + (e * e).sum(1)[None], 9).argmin(1)
    e, n = v[order(0)[:size]].copy(), np.zeros(size)
    first = v[batch_of == 0]
    for _ in range(means):
        at = close(first, e)
        n = np.bincount(at, minlength=size).astype(float)
        e = np.array([first[at == i].mean(0) if n[i] else e[i] for i in range(size)])
    sums, sizes = e * n[:, None], n
    for p in range(passes):
        for b in range(batches):
            x = v[batch_of == b]
            at = close(x, e)
            sizes = decay * sizes + (1 - decay) * np.bincount(at, minlength=size)
            sums = decay * sums + (1 - decay) * np.array([x[at == i].sum(0) for i in range(size)])
            e = sums / ((sizes + 1e-5) / (sizes.sum() + size * 1e-5) * sizes.sum())[:, None]
            gone = np.flatnonzero(sizes < dead)
            if len(gone) and not (p == passes - 1 and b == batches - 1):
                rows = [i for i in order(sample + p * batches + b) if batch_of[i] == b][: len(gone)]
                e[gone[: len(rows)]] = v[rows]
    return e, close(v, e)


def test_codebooks_follow_the_rule(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    kwargs = dict(size=16, stages=2, batches=3, passes=2, means=2, decay=0.7, dead=3.0)
    q = B.ResidualQuantiser(e.repartition(3), "vec_id", "embedding", seed=5, **kwargs)
    got = {r.key: (r.codes, r.errors) for r in q.encoded().collect()}
    seeds = [5, 6, *range(1005, 1012)]
    rows = e.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(3)).alias("b"), *[hash_rank("vec_id", s).alias(f"r{s}") for s in seeds]).collect()
    v, batch = np.array([r.embedding for r in rows], float), np.array([r.b for r in rows])
    codes, errors = [], []
    for stage in range(2):
        order = lambda s: sorted(range(len(rows)), key=lambda i: (rows[i][f"r{5 + stage if s == 0 else s}"], rows[i].vec_id))
        book, at = plain_stage(v, batch, order, 16, 3, 2, 2, 0.7, 3.0, 1005)
        assert np.allclose(book, q.books[stage], atol=1e-5)
        v = v - book[at]
        codes.append(at)
        errors.append((v * v).sum(1))
    assert all(got[r.vec_id][0] == [int(c[i]) for c in codes] and np.allclose(got[r.vec_id][1], [x[i] for x in errors], atol=1e-4) for i, r in enumerate(rows))
    assert errors[1].mean() < errors[0].mean()


def test_codebooks_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "k long, v array<double>")
    q = B.ResidualQuantiser(df, "k", "v", size=4, stages=2)
    assert [r.key for r in q.encoded().collect()] == [1, 1] and all(abs(x) < 1e-3 for r in q.encoded().collect() for x in r.errors)
    assert B.ResidualQuantiser(df.limit(0), "k", "v").encoded().count() == 0


def naive_ward(rows, threshold):
    """The nearest pair is merged again and again."""
    clusters = {k: (np.array(v, float), 1, [k]) for k, v in rows}
    while True:
        best = None
        for a in sorted(clusters):
            for b in sorted(clusters):
                if a < b:
                    (x, n, _), (y, m, _) = clusters[a], clusters[b]
                    d = round(float(np.sqrt(2 * n * m / (n + m) * ((x - y) ** 2).sum())), 9)
                    best = min(best or (d, a, b), (d, a, b))
        if best is None or best[0] > threshold:
            return {k: min(c[2]) for c in clusters.values() for k in c[2]}
        _, a, b = best
        (x, n, i), (y, m, j) = clusters.pop(a), clusters.pop(b)
        clusters[min(a, b)] = ((x * n + y * m) / (n + m), n + m, i + j)


def test_ward_clusters(spark, small_cells):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(c, 0.3, (18, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 3, 0))])
    v[50:] = v[0]
    rows = [(int(k), x.tolist()) for k, x in zip(rng.permutation(len(v)) + 3, v)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    for threshold in (0.4, 1.5):
        assert {r.k: r.cluster for r in K.agglomerative(df, "k", "v", threshold).collect()} == naive_ward(rows, threshold)


def test_ward_clusters_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 5), (1, [0.0, 0.0], 6), (2, None, 7), (None, [0.0, 0.0], 8), (3, [9.0, 9.0], 9)], "k long, v array<double>, cluster long")
    assert sorted((r.k, r.cluster) for r in K.agglomerative(df, "k", "v", 1.0).collect()) == [(1, 1), (1, 1), (3, 3)]
    assert K.agglomerative(df.limit(0), "k", "v", 1.0).count() == 0


def test_index_ranks_by_the_rounded_distance(spark):
    """Two rows whose distances differ in the eighth digit are equal at six: the smaller key is first."""
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (5, at(0.5)), (3, at(0.5 - 3e-8)), (4, at(0.2))], "k long, v array<double>")
    index = I.InvertedLists(df, "k", "v", lists=2)
    got = [(r.rank, r.other) for r in index.search(df.filter("k = 0"), "k", "v", 3, 2, digits=6).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 5), (3, 4)]


def test_neighbours_and_pairs_by_brute_force(spark):
    from glossarium.operators import statistics as S

    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 5)).astype(np.float32)
    v[40:50] = v[3]
    rows = [(i + 1, x.tolist(), int(i) % 3) for i, x in enumerate(v)] + [(500, None, 1), (None, v[0].tolist(), 1), (501, [0.0] * 5, None)]
    df = spark.createDataFrame(rows, "k long, v array<float>, label int").repartition(5)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 9)
    want = {(i + 1, rank, j + 1) for i in range(90) if (i + 1) % 4 == 0 for rank, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (abs(d[i, j]), j))[:7], 1)}
    assert {(r.query, r.rank, r.other) for r in S.neighbours(df.filter("k % 4 = 0"), df, "k", "v", 7).collect()} == want
    got = {(r.a, r.b): (r.same, r.score) for r in S.cosine_pairs(df.filter("k % 4 = 0"), df, "k", "v", "label").collect()}
    asked = [k for k in [*range(1, 91), 500] if k % 4 == 0]
    assert set(got) == {(a, b) for a in asked for b in [*range(1, 91), 500, 501] if a != b}
    assert all(got[a, b] == ((a - 1) % 3 == (b - 1) % 3, round(float(u[a - 1] @ u[b - 1]), 6)) for a in asked if a < 91 for b in range(1, 91) if a != b)
    assert got[4, 500][1] is None
    counts = S.cosine_pairs(df.filter("k % 4 = 0"), df, "k", "v", "label", counted=True).groupBy("score").agg(F.sum("s").alias("s"), F.sum("d").alias("d")).collect()
    assert {r.score: (r.s, r.d) for r in counts} == {x: tuple(sum(1 for same, y in got.values() if y == x and bool(same) is w) for w in (True, False)) for x in {y for _, y in got.values()}}
    assert got[4, 501] == (None, None)
    assert S.neighbours(df.limit(0), df, "k", "v", 3).count() == 0 and S.cosine_pairs(df.limit(0), df, "k", "v", "label").count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    from glossarium.operators import blocks as P

    monkeypatch.setattr(P, "MOST", 40)
    monkeypatch.setattr(P, "LEAST", 10)
    monkeypatch.setattr(P, "PAIRS", 300)


def odd_vectors(spark):
    """Rows with equal vectors, equal keys, no vector, no key, no length and no label, and each row as (key, label, vector or None)."""
    v = np.random.default_rng(6).normal(size=(130, 5)).astype(np.float32)
    v[40:50], v[60] = v[3], -v[3]
    rows = [(i + 1, x.tolist(), int(i) % 3 if i % 11 else None) for i, x in enumerate(v)] + [(7, v[80].tolist(), 2), (500, None, 1), (None, v[0].tolist(), 1), (501, [0.0] * 5, None)]
    return spark.createDataFrame(rows, "k long, v array<float>, label int").repartition(5), [(k, l, None if x is None or not any(x) else np.array(x) / np.linalg.norm(x)) for k, x, l in rows if k is not None]


def test_neighbours_of_all_by_brute_force(spark, small_blocks):
    from glossarium.operators import statistics as S

    df, rows = odd_vectors(spark)
    for k in (1, 6):
        want = {}
        for a, _, u in rows:
            if u is not None:
                want[a] = sorted(want.get(a, []) + [(round(float(1 - u @ w), 9) + 0.0, b) for b, _, w in rows if w is not None and a != b])[:k]
        got = S.neighbours_of_all(df, "k", "v", k).collect()
        assert {(r.query, r.rank, r.other) for r in got} == {(a, rank, b) for a, near in want.items() for rank, (_, b) in enumerate(near, 1)}
    assert S.neighbours_of_all(df.limit(0), "k", "v", 3).count() == 0


def test_fifth_neighbour_of_every_vector(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    u = np.array([r.embedding for r in e], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.sort(np.where(np.eye(len(u)), np.inf, 1 - u @ u.T), 1)[:, 4]
    got = {r.query: r.distance for r in PLANS["knn_kth_distance"].run(spark, SMALL).collect()}
    assert len(got) == len(e) and all(abs(got[r.vec_id] - d) < 6e-6 for r, d in zip(e, near))


def test_counts_of_all_pairs_by_brute_force(spark, small_blocks):
    from glossarium.operators import statistics as S

    df, rows = odd_vectors(spark)
    want = {}
    for a, x, u in rows:
        for b, y, w in rows:
            if a != b:
                n = want.setdefault(None if u is None or w is None else round(float(np.clip(u @ w, -1, 1)), 6) + 0.0, [0, 0])
                n[0 if x is not None and x == y else 1] += 1
    counts = S.cosine_pairs(df, df, "k", "v", "label", counted=True).groupBy("score").agg(F.sum("s").alias("s"), F.sum("d").alias("d")).collect()
    assert {r.score if r.score is None else r.score + 0.0: [r.s, r.d] for r in counts} == want


def test_equal_error_rate_of_all_pairs(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("embedding", "label").collect()
    u, label = np.array([r.embedding for r in e], float), np.array([r.label for r in e])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x, y = np.triu_indices(len(u), 1)
    score, same = np.round((u @ u.T)[x, y], 6), label[x] == label[y]
    at = np.unique(score)
    frr = np.searchsorted(np.sort(score[same]), at) / same.sum()
    far = 1 - np.searchsorted(np.sort(score[~same]), at) / (~same).sum()
    best = np.lexsort((at, np.round(np.abs(far - frr), 12)))[0]
    got = PLANS["equal_error_rate"].run(spark, SMALL).first()
    assert (got.threshold, got.rate) == (round(float(at[best]), 6), round(float(far[best] + frr[best]) / 2, 6))


def test_pairs_of_all_by_brute_force(spark, small_blocks):
    from glossarium.operators import statistics as S

    df, rows = odd_vectors(spark)
    score = lambda u, w: None if u is None or w is None else round(float(np.clip(u @ w, -1, 1)), 6) + 0.0
    want = sorted(((a, b, None if x is None or y is None else x == y, score(u, w)) for a, x, u in rows for b, y, w in rows if a != b), key=str)
    assert sorted(((r.a, r.b, r.same, r.score if r.score is None else r.score + 0.0) for r in S.cosine_pairs(df, df, "k", "v", "label").collect()), key=str) == want


def test_theta_pairs_are_all_pairs(spark):
    got = PLANS["theta_pairs_cosine"].run(spark, SMALL).select("a", "b").distinct()
    assert got.count() == 500 * 499 and got.filter("a = b").isEmpty()


def test_ward_clusters_in_rounds_of_blocks(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.concatenate([*(rng.normal(c, 0.3, (30, 3)) for c in ((0, 0, 0), (2, 0, 0), (0, 3, 0))), [[40 + x, y, 0] for x in range(3) for y in range(4)], np.full((9, 3), 7.0)])
    v[85:90] = v[0]
    rows = [(int(k), x.tolist()) for k, x in zip(rng.permutation(len(v)) + 3, v)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    for last, threshold in ((1, 1.0), (30, 1.5), (4096, 1.5)):
        monkeypatch.setattr(K, "LAST", last)
        assert {r.k: r.cluster for r in K.agglomerative(df, "k", "v", threshold).collect()} == naive_ward(rows, threshold)


def test_ward_rounds_leave_clusters_that_are_done(spark, small_blocks, monkeypatch):
    """No block of the later rounds holds a cluster with no other one up to the threshold."""
    monkeypatch.setattr(K, "LAST", 1)
    sizes, real = [], K.B.blocks
    monkeypatch.setattr(K.B, "blocks", lambda rows, n, stages: sizes.append(n) or real(rows, n, stages))
    rows = [(i, [10.0 * i]) for i in range(60)] + [(100, [1000.0]), (101, [1000.5]), (102, [1001.2]), (103, [1001.9])]
    got = {r.k: r.cluster for r in K.agglomerative(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3.0).collect()}
    assert got == {**{i: i for i in range(60)}, **{i: 100 for i in range(100, 104)}} and sizes[0] == 64 and max(sizes[1:]) <= 4
