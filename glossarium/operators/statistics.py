"""Statistics over corpus tables: histograms, confusion, agreement, error rates, centroids, neighbours, probabilities."""

from __future__ import annotations

import math
from functools import reduce
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..session import ship
from . import blocks as B
from . import cells as C
from .stages import Stages


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, population deviation, extremes and exact linear quartiles (A4). Quartiles are looked up by rank in ranges, so no task holds all values."""
    from .relational import numbered

    rows = df.select(value).filter(F.col(value).isNotNull())
    n, ranks = rows.count(), numbered(rows, [value], "_place")
    whole = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    places = {q: 1 + (n - 1) * q for q in (0.25, 0.5, 0.75)}
    at = sorted({int(p) + k for p in places.values() for k in (0, 1)})
    picked = ranks.filter(F.col("_place").isin(at)).agg(*[F.max(F.when(F.col("_place") == p, F.col(value))).alias(f"_{p}") for p in at])  # six rows at most
    out = whole.crossJoin(F.broadcast(picked))  # one row each
    quartile = lambda p: F.col(f"_{int(p)}") + (F.coalesce(F.col(f"_{int(p) + 1}"), F.col(f"_{int(p)}")) - F.col(f"_{int(p)}")) * (p % 1)
    return out.select("n", "mean", "std", "min", *[quartile(p).alias(f"p{int(100 * q)}") for q, p in places.items()], "max")


def in_blocks(df: DataFrame, key: str, most: int = 10_000) -> list[DataFrame]:
    """df in parts of about `most` rows by a hash of the key, which may be broadcast one after the other."""
    parts = -(-df.count() // most)
    return [df] if parts <= 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def histogram(df: DataFrame, value: str, width: float = 1.0) -> DataFrame:
    """Unit bins up to the ceiling of the largest value and one more, empty ones kept, with percent and its running sum (A15, W3). The bins are few: a function of the range."""
    bins = (F.ceil(F.max(value) / width) + 1).cast("long").alias("n_bins")
    top = df.agg(bins, F.count(value).alias("total"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = top.select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    out = edges.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))
    return out.withColumn("cumulative", F.sum("percent").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def confusion(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Counts of pairs."""
    return df.groupBy(reference, hypothesis).agg(F.count(F.lit(1)).alias("n"))


def majority(counts: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Each cluster's most frequent truth, the smallest of equals; negative truths don't count."""
    best = counts.filter(F.col(truth) >= 0).groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(truth).alias("t"))).alias("b"))
    return best.select(cluster, F.col("b.t").alias(truth), (-F.col("b.n")).alias("n"))


def agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Adjusted Rand, mutual information (normalised), homogeneity, completeness, V and Fowlkes-Mallows from the contingency table."""
    n2 = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = confusion(df, truth, cluster)
    a = cells.groupBy(truth).agg(F.sum("n").alias("a"))
    b = cells.groupBy(cluster).agg(F.sum("n").alias("b"))
    ent = lambda c: -F.sum(F.col(c) / F.col("total") * F.log(F.col(c) / F.col("total")))
    total = cells.agg(F.sum("n").cast("double").alias("total"))
    sa = a.crossJoin(total).agg(F.sum(n2("a")).alias("pa"), ent("a").alias("ha"))
    sb = b.crossJoin(total).agg(F.sum(n2("b")).alias("pb"), ent("b").alias("hb"))
    joint = cells.join(a, truth).join(b, cluster).crossJoin(total)
    mi = F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b"))))
    s = joint.agg(F.sum(n2("n")).alias("pc"), mi.alias("mi"), F.first("total").alias("total")).crossJoin(sa).crossJoin(sb)  # one row each
    pairs = F.col("total") * (F.col("total") - 1) / 2
    expected = F.col("pa") * F.col("pb") / pairs
    h, c = F.coalesce(F.try_divide("mi", "ha"), F.lit(1.0)), F.coalesce(F.try_divide("mi", "hb"), F.lit(1.0))
    return s.select(
        F.coalesce(F.try_divide(F.col("pc") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0)).alias("ari"),
        F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"),
        h.alias("homogeneity"), c.alias("completeness"), F.coalesce(F.try_divide(2 * h * c, h + c), F.lit(0.0)).alias("v_measure"),
        F.coalesce(F.try_divide(F.col("pc"), F.sqrt(F.col("pa") * F.col("pb"))), F.lit(0.0)).alias("fowlkes_mallows"),
    )


def adjusted_mutual_information(cells: Sequence[tuple[int, int, int]]) -> float:
    """From a contingency table that fits on the driver: (truth, cluster, count)."""
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    for t, c, n in cells:
        a[t] = a.get(t, 0) + n
        b[c] = b.get(c, 0) + n
    total = sum(a.values())
    h = lambda m: -sum(x / total * math.log(x / total) for x in m.values())
    mi = sum(n / total * math.log(total * n / (a[t] * b[c])) for t, c, n in cells if n)
    lg, expected = math.lgamma, 0.0
    for x in a.values():
        for y in b.values():
            for n in range(max(1, x + y - total), min(x, y) + 1):
                weight = lg(x + 1) + lg(y + 1) + lg(total - x + 1) + lg(total - y + 1) - lg(total + 1) - lg(n + 1) - lg(x - n + 1) - lg(y - n + 1) - lg(total - x - y + n + 1)
                expected += n / total * math.log(total * n / (x * y)) * math.exp(weight)
    bottom = (h(a) + h(b)) / 2 - expected
    return (mi - expected) / bottom if abs(bottom) > 1e-15 else 1.0


def weighted_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    cells = confusion(df, truth, predicted)
    support = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    called = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("called"))
    r = support.join(called, "label", "left").withColumn("p", F.coalesce(F.try_divide("hits", "called"), F.lit(0.0))).withColumn("r", F.col("hits") / F.col("support"))
    r = r.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return r.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(name) for c, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))])


def equal_error_rate(scores: DataFrame, score: str, same: str) -> DataFrame:
    """Where false acceptance and false rejection are nearest: (threshold, rate)."""
    one = F.when(F.col(same), 1).otherwise(0)
    return equal_error_rate_of_counts(scores.select(score, one.alias("s"), (1 - one).alias("d")), score)


def equal_error_rate_of_counts(counts: DataFrame, score: str) -> DataFrame:
    """equal_error_rate() of rows (score, s, d): s pairs that belong together and d that don't.

    Sums per distinct score come first; the running sums go over score ranges: their totals in one small window, the rest within each.
    """
    n = counts.groupBy(score).agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    stages = Stages(counts.sparkSession)
    n = stages.write(n, "score-counts")  # scores may be all pairs of a join: they are made once
    part = stages.write(n.repartitionByRange(score).withColumn("_p", F.spark_partition_id()), "score-ranges")
    sums = part.groupBy("_p").agg(F.sum("s").alias("ps"), F.sum("d").alias("pd"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_p", F.coalesce(F.sum("ps").over(w), F.lit(0)).alias("bs"), F.coalesce(F.sum("pd").over(w), F.lit(0)).alias("bd"))
    total = n.agg(F.sum("s").alias("ts"), F.sum("d").alias("td"))
    inside = Window.partitionBy("_p").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = part.withColumn("ls", F.coalesce(F.sum("s").over(inside), F.lit(0))).withColumn("ld", F.coalesce(F.sum("d").over(inside), F.lit(0)))
    r = r.join(F.broadcast(sums), "_p").crossJoin(F.broadcast(total))
    frr, far = (F.col("ls") + F.col("bs")) / F.col("ts"), 1 - (F.col("ld") + F.col("bd")) / F.col("td")
    best = r.select(F.min(F.struct(F.round(F.abs(far - frr), 12).alias("gap"), F.col(score).alias("threshold"), ((far + frr) / 2).alias("rate"))).alias("b"))
    return best.select("b.threshold", "b.rate")


def centroids(df: DataFrame, by: str, vector: str, normalise: bool = False) -> DataFrame:
    """Mean vector of each group (A16), to length 1 if so wished."""
    cells = df.select(by, F.posexplode(N.doubles(vector)).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    v = cells.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))
    return v.withColumn("centroid", N.unit("centroid")) if normalise else v


def centred(df: DataFrame, vector: str) -> DataFrame:
    """Vectors less the mean of all."""
    mean = centroids(df.withColumn("_all", F.lit(1)), "_all", vector).select("centroid")
    return df.crossJoin(F.broadcast(mean)).withColumn(vector, F.zip_with(N.doubles(vector), "centroid", lambda x, m: x - m)).drop("centroid")


def classified(df: DataFrame, centres: DataFrame, label: str, vector: str, threshold: float) -> DataFrame:
    """The label of the centre with the largest cosine, or UNKNOWN below a threshold (M8, F28). Centres are one row a class; their number is checked."""
    if centres.limit(100_001).count() > 100_000:
        raise ValueError("more than 100 000 classes")
    # all centres as one value, so that the best is found within the row and no vector is shuffled
    all_ = centres.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid").alias("c"))).alias("_centres"))
    scored = df.select("*", N.doubles(vector).alias("_v")).crossJoin(F.broadcast(all_))
    best = F.array_min(F.transform("_centres", lambda e: F.struct((-F.round(N.cosine("_v", e["c"]), 9)).alias("s"), e["label"].alias("label"))))
    scored = scored.withColumn("_b", best)
    score = -F.col("_b.s")
    return scored.select(*df.columns, score.alias("score"), F.when(score < threshold, F.lit("UNKNOWN")).otherwise(F.col("_b.label").cast("string")).alias("predicted"))


#: Pairs whose scores a task holds at once.
PAIRS = 500_000


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A list column as rows of doubles; lists that are null or shorter than others are rows of NaN."""
    n = np.array([-1 if x is None else x for x in pc.list_value_length(lists).to_pylist()])
    width = int(n.max(initial=0))
    out = np.full((len(lists), width), np.nan)
    if not width:
        return out
    out[n == width] = lists.filter(pa.array(n == width)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return out


def _queries(block: DataFrame, *columns: str):
    """A block of in_blocks() as arrays: keys, vectors and what else is named."""
    rows = block.select(*columns).toArrow().combine_chunks()
    return [_matrix(c.combine_chunks()) if pa.types.is_list(c.type) else c.combine_chunks() for c in rows.columns]


def cosine_pairs(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, digits: int = 6, counted: bool = False) -> DataFrame:
    """(a, b, same, score): each query with every row of another key, whether both have one label, and their cosine; null where a vector is null or has no length.

    Blocks of queries meet blocks of rows; where `queries` is `base`, two blocks meet once for both orders of their pairs. The rounded scores are those of sums from the first component
    to the last. With `counted`, tasks add up their pairs and give (score, s, d), how many with that score have one label and how many not, instead of the pairs; a score may come from
    several tasks.
    """
    spark, stages = base.sparkSession, Stages(base.sparkSession)

    def of(df: DataFrame) -> tuple[DataFrame, int]:
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), N.doubles(vector).alias("v")).filter("key IS NOT NULL")
        return B.blocks(rows, rows.count(), stages)

    (left, lefts), whole = of(queries), queries is base
    right, rights = (None, 0) if whole else of(base)
    top = 10**digits  # scores as whole numbers from 0; the last place is that of null

    def read(a: pa.Table, b: pa.Table) -> list[tuple]:
        """Of both: keys, numbers of labels (none for two nulls), vectors, their squared lengths, unit vectors (0 where there is none), whether there is one; rows of one label together."""
        names, out = pc.unique(pa.chunked_array([*a["label"].chunks, *b["label"].chunks], pa.string())).drop_null(), []
        vs = [_matrix(t["v"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64()))) for t in (a, b)]
        for t, v, none in zip((a, b), vs, (-1, -2)):
            at = pc.fill_null(pc.index_in(t["label"], names), none).to_numpy()
            order = np.argsort(at, kind="stable")
            v = v[order] if vs[0].shape[1] == vs[1].shape[1] else np.full((len(at), 1), np.nan)
            of_v = C.dots(v, v)
            with np.errstate(invalid="ignore", divide="ignore"):
                u = v / np.sqrt(of_v)[:, None]
            good = np.isfinite(u).all(1) & (of_v > 0)
            out.append((t["key"].to_numpy()[order], at[order], v, of_v, np.where(good[:, None], u, 0.0), good))
        return out

    def strips(a: tuple, b: tuple, most: int) -> Iterator[tuple]:
        """For some rows of a at a time: their first place and their scores with b as whole numbers, rounded halves away from zero."""
        step = max(1, most // max(1, len(b[0])))
        for s in range(0, len(a[0]), step):
            at = (a[4][s : s + step] * top) @ b[4].T
            near = np.rint(at)
            np.subtract(at, near, out=at)
            x, y = B.places(np.abs(at, out=at) >= 0.5 - 1e-13 * top)  # sums in another order may fall on the other side of a half
            exactly = np.clip(C.dots(a[2][s + x], b[2][y]) / np.sqrt(a[3][s + x] * b[3][y]), -1, 1) * top
            near[x, y] = np.copysign(np.floor(np.abs(exactly) + 0.5), exactly)
            yield s, near

    def pairs(one: pa.Table, two: pa.Table, itself: bool) -> Iterator[pa.RecordBatch]:
        a, b = read(one, two)
        for s, near in strips(a, b, B.PAIRS // 8):
            near[~a[5][s : s + len(near)]], near[:, ~b[5]] = np.nan, np.nan
            keys, x_label = a[0][s : s + len(near)], a[1][s : s + len(near)]
            x, y = B.places(keys[:, None] != b[0][None])
            score, unknown, same = near[x, y] / top, (x_label[x] < 0) | (b[1][y] < 0), x_label[x] == b[1][y]
            same, score = pa.array(same, mask=unknown), pa.array(score, mask=np.isnan(score))
            for p, q in ((keys[x], b[0][y]), (b[0][y], keys[x]))[: 2 if whole and not itself else 1]:
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), same, score], ["a", "b", "same", "score"])

    def count(one: pa.Table, two: pa.Table, itself: bool, state: dict) -> Iterator[pa.RecordBatch]:
        a, b = read(one, two)
        twice = 2 if whole and not itself else 1
        every, same = (state.setdefault(k, np.zeros(2 * top + 2, np.int64)) for k in ("every", "same"))

        def add(to: np.ndarray, places: np.ndarray, times: int) -> None:
            n = np.bincount(places)
            to[: len(n)] += n * times

        first, last = np.searchsorted(b[1], a[1], "left"), np.searchsorted(b[1], a[1], "right")
        x, y = B.equal_keys(a[0], b[0])  # pairs that are none
        for s, near in strips(a, b, B.PAIRS):
            near += top
            at = near.astype(np.int64)
            at[~a[5][s : s + len(at)]], at[:, ~b[5]] = 2 * top + 1, 2 * top + 1
            add(every, at.ravel(), twice)
            runs = np.flatnonzero(np.diff(a[1][s : s + len(at)], prepend=-3))
            alike = [at[r:e, first[s + r] : last[s + r]].ravel() for r, e in zip(runs, [*runs[1:], len(at)])]
            add(same, np.concatenate(alike), twice)
            here = (x >= s) & (x < s + len(at))
            add(every, at[x[here] - s, y[here]], -twice)
            here &= a[1][x] == b[1][y]
            add(same, at[x[here] - s, y[here]], -twice)
        return
        yield

    def counts(state: dict) -> Iterator[pa.RecordBatch]:
        if state:
            some = np.flatnonzero(state["every"])
            s = state["same"][some]
            yield pa.RecordBatch.from_arrays([pa.array((some - top) / top, mask=some == 2 * top + 1), pa.array(s), pa.array(state["every"][some] - s)], ["score", "s", "d"])

    if counted:
        return B.meet(left, lefts, right, rights, "score double, s long, d long", count, counts, 2 * spark.sparkContext.defaultParallelism)
    return B.meet(left, lefts, right, rights, "a long, b long, same boolean, score double", pairs)


def neighbours(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, digits: int = C.DIGITS) -> DataFrame:
    """(query, other, distance, rank): exact k nearest by cosine for a stated set of queries against all rows (F29, M7), by (distance, key).

    Tasks multiply their rows with a block of queries at a time and keep the k best of each query, which are then merged. Rows and queries without a key, with a null
    in the vector or with a vector of length zero are left out.
    """
    ship(base.sparkSession)

    def units(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("key"), N.doubles(vector).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
        return rows.filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull())).withColumn("v", N.unit("v"))

    def met(some: DataFrame) -> DataFrame:
        shared = base.sparkSession.sparkContext.broadcast(_queries(some, "key", "v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = shared.value[0].to_numpy(), shared.value[1]
            n, step = len(keys), max(k, PAIRS // max(1, len(keys)))
            who, other, d, bound = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.full(n, np.inf)
            for batch in batches:
                for i in range(0, batch.num_rows if n else 0, step):
                    part = batch.slice(i, step)
                    names, v = part.column(0).to_numpy(), _matrix(part.column(1))
                    near = 1 - q @ v.T
                    near[keys[:, None] == names[None]] = np.inf
                    if near.shape[1] >= k:
                        bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1])
                    x, y = np.nonzero((near <= bound[:, None] + 2 * 10.0**-digits + 1e-12) & np.isfinite(near))
                    exactly = 1 - C.dots(q[x], v[y])
                    who, other, d = np.concatenate([who, x]), np.concatenate([other, names[y]]), np.concatenate([d, np.round(exactly, digits)])
                    order = np.lexsort((other, d, who))
                    who, other, d = who[order], other[order], d[order]
                    start = np.searchsorted(who, np.arange(n))
                    place = np.arange(len(who)) - start[who]
                    full = place == k - 1
                    bound[who[full]] = np.minimum(bound[who[full]], d[full])
                    kept = place < k
                    who, other, d = who[kept], other[kept], d[kept]
            yield pa.RecordBatch.from_arrays([pa.array(keys[who]), pa.array(other), pa.array(d)], ["query", "other", "distance"])

        best = Window.partitionBy("query").orderBy("distance", "other")
        return units(base).mapInArrow(run, "query long, other long, distance double").withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [met(some) for some in in_blocks(units(queries), "key")])


def neighbours_of_all(df: DataFrame, key: str, vector: str, k: int, digits: int = C.DIGITS) -> DataFrame:
    """neighbours() of all rows among all rows: two blocks of rows meet once, and the k best that each row has in the other block are merged.

    Products in single precision say which rows may be among the k best; only these are looked at exactly.
    """
    stages = Stages(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), N.doubles(vector).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull())).withColumn("v", N.unit("v"))
    held, many = B.blocks(rows, rows.count(), stages)

    def pair(one: pa.Table, two: pa.Table, itself: bool) -> Iterator[pa.RecordBatch]:
        (a, va), (b, vb) = ((t["key"].to_numpy(), _matrix(t["v"].combine_chunks())) for t in (one, two))
        if va.shape[1] != vb.shape[1]:
            return
        (a, va), (b, vb) = ((keys[fine], v[fine]) for keys, v in ((a, va), (b, vb)) for fine in [np.isfinite(v).all(1)])
        slack = 2 * (B.SINGLE * va.shape[1] + 10.0**-digits)
        single, other = -va.astype(np.float32), np.ascontiguousarray(vb.T, np.float32)
        x_none, y_none = B.equal_keys(a, b)
        exactly = lambda x, y: B.in_parts(lambda x, y: np.round(1 - C.dots(va[x], vb[y]), digits), x, y)
        best, found = np.zeros((0, len(b)), np.float32), []
        step = max(1, B.PAIRS // max(1, len(b)))
        for s in range(0, len(a) if len(b) else 0, step):
            d = single[s : s + step] @ other  # less by one than the distance
            here = (x_none >= s) & (x_none < s + step)
            d[x_none[here] - s, y_none[here]] = np.inf
            bound = B.least(d, k, 1).max(1) if len(b) >= k else np.full(len(d), np.inf, np.float32)
            x, y = B.places(d <= (bound + np.float32(slack))[:, None])
            there = np.isfinite(d[x, y])
            x, y = x[there], y[there]
            who, far, near = B.kept(x, k, exactly(s + x, y), b[y])
            yield pa.RecordBatch.from_arrays([pa.array(a[s + who]), pa.array(near), pa.array(far)], ["query", "other", "distance"])
            if itself:
                continue
            best = np.sort(np.concatenate([best, B.least(d, k, 0)]), 0)[:k]
            bound = best.max(0) if len(best) >= k else np.full(len(b), np.inf, np.float32)
            x, y = B.places(d <= (bound + np.float32(slack))[None])
            there = np.isfinite(d[x, y])
            x, y = x[there], y[there]
            found = [np.concatenate(z) for z in zip(*filter(None, (found, (y, exactly(s + x, y), a[s + x]))))]
            found = B.kept(found[0], k, found[1], found[2])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(b[found[0]]), pa.array(found[2]), pa.array(found[1])], ["query", "other", "distance"])

    best = Window.partitionBy("query").orderBy("distance", "other")
    return B.meet(held, many, None, 0, "query long, other long, distance double", pair).withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def elbow(sorted_values: Sequence[float]) -> float:
    """The value farthest below the straight line from the first to the last of rising values (M7)."""
    n = len(sorted_values)
    if n < 3 or sorted_values[-1] == sorted_values[0]:
        return float(sorted_values[-1]) if n else 0.0
    gap = [i / (n - 1) - (v - sorted_values[0]) / (sorted_values[-1] - sorted_values[0]) for i, v in enumerate(sorted_values)]
    return float(sorted_values[max(range(n), key=lambda i: gap[i])])


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Lloyd's rounds from k rows by a rank; empty clusters keep their mean (M10, M6). Only the k means travel."""
    from .relational import hash_rank

    spark = df.sparkSession
    rows = df.select(key, N.doubles(vector).alias("v"))
    means = {i: list(r.v) for i, r in enumerate(rows.orderBy(hash_rank(key, seed), key).limit(k).collect())}
    if not means:
        return rows.select(key, F.lit(None).cast("long").alias("cluster"))
    near = None
    for _ in range(rounds):
        c = spark.createDataFrame([(i, m) for i, m in means.items()], "cluster long, m array<double>")
        c = c.agg(F.collect_list(F.struct("cluster", "m")).alias("means"))  # one row of k means: the nearest is found within each row
        near = rows.crossJoin(F.broadcast(c)).withColumn("b", F.array_min(F.transform("means", lambda e: F.struct(F.round(N.euclidean("v", e["m"]), 9).alias("d"), e["cluster"].alias("cluster")))))
        near = near.select(key, "v", F.col("b.cluster").alias("cluster"))
        new = {r.cluster: list(r.centroid) for r in centroids(near, "cluster", "v").collect()}
        if all(max(abs(x - y) for x, y in zip(means[i], m)) < 1e-12 for i, m in new.items()):
            break
        means |= new
    return near.select(key, "cluster")


def ngrams(df: DataFrame, by: Sequence[str], words: Column, n: int) -> DataFrame:
    """Counts of n words in a row with sentence marks at the ends (M3)."""
    marked = F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))
    rows = df.select(*by, marked.alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return rows.select(*by, F.explode(grams).alias("ngram")).groupBy(*by, "ngram").agg(F.count(F.lit(1)).alias("n"))


def pronunciation_probabilities(df: DataFrame, word: str, pronunciation: str, lexicon: DataFrame) -> DataFrame:
    """Add-one counts over the lexicon, divided by the word's largest, rounded into 0.01..0.99; the largest is 1 (M1)."""
    counts = df.groupBy(word, pronunciation).agg(F.count(F.lit(1)).alias("n"))
    c = lexicon.join(counts, [word, pronunciation], "left").withColumn("c", F.coalesce("n", F.lit(0)) + 1)
    top = c.groupBy(word).agg(F.max("c").alias("top"))
    return c.join(top, word).select(word, pronunciation, F.when(F.col("c") == F.col("top"), 1.0).otherwise(N.probability(F.col("c") / F.col("top"))).alias("probability"), (F.col("c") - 1).alias("n"))


def silence_probabilities(df: DataFrame, by: Sequence[str], after: Column, smooth: float = 2.0) -> DataFrame:
    """Share of silence after each key, drawn to the overall share with weight `smooth` (M1)."""
    total = df.agg(F.avg(after.cast("double")).alias("base"))
    g = df.groupBy(*by).agg(F.sum(after.cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    p = (F.col("s") + smooth * F.col("base")) / (F.col("n") + smooth)
    return g.select(*by, "n", N.probability(p).alias("silence_after"), N.correction(p / F.col("base"), True).alias("correction"))


def rule_probabilities(rules: DataFrame, bases: DataFrame, least: int = 1) -> DataFrame:
    """rules (rule, pattern, applied) over bases (form, count): how often each rule was applied where it could have been (M2). The rules are few."""
    hits = bases.filter(F.col("count") > least).join(F.broadcast(rules), F.expr("form rlike pattern"))
    g = hits.groupBy("rule").agg(F.sum("count").alias("base"))
    r = rules.join(g, "rule").filter("applied > 0")
    return r.select("rule", "applied", "base", N.probability(F.col("applied") / F.greatest("base", "applied")).alias("probability"))


def goodness(frames: DataFrame, by: Sequence[str], actual: str, likelihoods: str) -> DataFrame:
    """Mean over frames of the best likelihood less that of the actual label's place, 0 where it is best."""
    return frames.groupBy(*by).agg(F.avg(F.array_max(likelihoods) - F.element_at(likelihoods, F.col(actual) + 1)).alias("goodness"))


def bigram_scores(model: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (history, word) with the probability of the word: its bigram's, or the history's backoff times the word's own; 0 for unknown words (M4).

    model: (n, words, probability, backoff), as the ARPA reader gives it.
    """
    one = model.filter("n = 1")
    two = model.filter("n = 2").select("words", F.col("probability").alias("_bigram"))
    j = pairs.withColumn("words", F.concat_ws(" ", "history", "word")).join(two, "words", "left").drop("words")
    j = j.join(one.select(F.col("words").alias("history"), F.coalesce("backoff", F.lit(1.0)).alias("_backoff")), "history", "left")
    j = j.join(one.select(F.col("words").alias("word"), F.col("probability").alias("_own")), "word", "left")
    return j.select(*pairs.columns, F.coalesce("_bigram", F.coalesce("_backoff", F.lit(1.0)) * F.coalesce("_own", F.lit(0.0))).alias("probability"))


def elbow_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """elbow() of a column, ranked in ranges instead of on the driver: one row (place, value, gap), the first of equal gaps (M7)."""
    from .relational import numbered

    rows = numbered(df.select(key, value), [value, key], "place")
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max("place").alias("n"))
    line = F.try_divide(F.col("place") - 1, F.col("n") - 1) - F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low"))
    gaps = rows.crossJoin(F.broadcast(ends)).withColumn("gap", F.coalesce(F.round(line, 9), F.lit(0.0)))  # one row
    return gaps.agg(F.max_by(F.struct("place", value, "gap"), F.struct("gap", -F.col("place"))).alias("e")).select("e.*")


def counter(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key: tasks count their own, and the counts are merged by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
