"""Ordered and interval operators: islands, caps, merges, containment and overlap, rasters.

What a window can say is a window; what depends on the result for the previous row is a fold over one file's ordered rows in a grouped
function, whose state is as large as the file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .relational import numbered


def ordered(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows with equal flags."""
    w = ordered(by, order)
    df = df.withColumn("_flag", flag).withColumn("_was", F.lag("_flag").over(w))
    change = F.when(F.col("_was").isNull() | (F.col("_was") != F.col("_flag")), 1).otherwise(0)
    return df.withColumn(name, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_was")


def voiced_segments(frames: DataFrame, by: Sequence[str], index: str, voiced: str, shift: float) -> DataFrame:
    """Islands of voiced frames: from index * shift to (first unvoiced index - 1) * shift, or to length * shift if open."""
    n = frames.groupBy(*by).agg(F.max(index).alias("_last"))
    runs = islands(frames, by, [index], F.col(voiced).cast("boolean")).filter("_flag").groupBy(*by, "island").agg(F.min(index).alias("_a"), F.max(index).alias("_b"))
    return runs.join(n, list(by)).select(*by, (F.col("_a") * shift).alias("begin"), (F.when(F.col("_b") == F.col("_last"), F.col("_b") + 1).otherwise(F.col("_b")) * shift).alias("stop"))


def cap_runs(df: DataFrame, by: Sequence[str], order: str, token: str, silent, most: int, if_over: int) -> DataFrame:
    """Drops what exceeds `most` in each run of a token, in sequences that have more than `if_over` of it."""
    total = F.sum(F.when(F.col(token) == F.lit(silent), 1).otherwise(0)).over(Window.partitionBy(*by))
    runs = islands(df.withColumn("_total", total), by, [order], F.col(token) == F.lit(silent))
    place = F.row_number().over(Window.partitionBy(*by, "island").orderBy(order))
    return runs.withColumn("_place", place).filter(~(F.col("_flag") & (F.col("_total") > if_over) & (F.col("_place") > most))).drop("_flag", "_total", "_place", "island")


def merge_with_previous(df: DataFrame, by: Sequence[str], begin: str, stop: str, label: str, gap: float, seam: Callable[[Column, Column], Column], glue: str = "") -> DataFrame:
    """Joins an interval to the one before if their gap is small and the labels meet at a seam."""
    w = ordered(by, [begin, stop])
    joins = (F.col(begin) - F.lag(stop).over(w) < gap) & seam(F.lag(label).over(w), F.col(label))
    group = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    parts = df.withColumn("_group", group).groupBy(*by, "_group").agg(F.min(begin).alias(begin), F.max(stop).alias(stop), F.sort_array(F.collect_list(F.struct(begin, stop, label))).alias("_parts"))
    return parts.select(*by, begin, stop, F.array_join(F.transform("_parts", lambda p: p[label]), glue).alias(label))


def hysteresis(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, on: float, off: float) -> DataFrame:
    """Whether a row is inside a segment that starts above `on` and ends below `off`; before the first of both the first row decides."""
    w = ordered(by, order)
    state = F.last(F.when(F.col(value) > on, True).when(F.col(value) < off, False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("active", F.coalesce(state, F.first(F.col(value) > on).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def containing(points: DataFrame, intervals: DataFrame, by: Sequence[str], point: str, begin: str, stop: str, width: float, slack: float = 1e-6, how: str = "left") -> DataFrame:
    """Each point with the first interval of its group that holds it.

    Intervals are exploded to the buckets of `width` that they touch and met by equality, so a long group isn't compared pair by pair.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spans = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(begin) - slack), bucket(F.col(stop) + slack))))
    at = points.select(*by, point).distinct().withColumn("_bucket", bucket(F.col(point)))  # equal points have the same interval
    hit = at.join(spans, [*by, "_bucket"]).filter((F.col(point) >= F.col(begin) - slack) & (F.col(point) <= F.col(stop) + slack))
    extra = [c for c in intervals.columns if c not in by]
    first = hit.groupBy(*by, point).agg(F.min(F.struct(begin, stop, *[c for c in extra if c not in (begin, stop)])).alias("_first"))
    return points.join(first, [*by, point], how).select(*points.columns, *[F.col(f"_first.{c}").alias(c) for c in extra])


def without_overlaps(df: DataFrame, cuts: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Intervals (begin, stop) that touch none of the cuts (cut_begin, cut_stop) of their group."""
    bucket = lambda c: F.floor(c / width).cast("long")
    key = [*by, "begin", "stop"]  # equal intervals touch the same cuts
    spread = df.select(*key).distinct().withColumn("_bucket", F.explode(F.sequence(bucket(F.col("begin")), bucket(F.col("stop")))))
    spans = cuts.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("cut_begin")), bucket(F.col("cut_stop")))))
    hit = spread.join(spans, [*by, "_bucket"]).filter((F.col("stop") > F.col("cut_begin")) & (F.col("begin") < F.col("cut_stop"))).select(*key).distinct()
    return df.join(hit, key, "left_anti")


def replace_overlaps(df: DataFrame, cuts: DataFrame, by: Sequence[str], width: float, label: str = "oov") -> DataFrame:
    """The same, with one interval for each cut in place of what went."""
    return without_overlaps(df, cuts, by, width).select(*by, "begin", "stop", "label").unionByName(cuts.select(*by, F.col("cut_begin").alias("begin"), F.col("cut_stop").alias("stop"), F.lit(label).alias("label")))


def with_gaps(df: DataFrame, by: Sequence[str], silence: str, edges: DataFrame | None = None) -> DataFrame:
    """Adds an interval wherever the next one begins later, and up to the edges (first, last) of each group."""
    w = ordered(by, ["begin", "stop"])
    rows = df.select(*by, "begin", "stop", "label")
    inner = rows.withColumn("_from", F.lag("stop").over(w)).filter(F.col("_from") < F.col("begin")).select(*by, F.col("_from").alias("begin"), F.col("begin").alias("stop"), F.lit(silence).alias("label"))
    out = rows.unionByName(inner)
    if edges is not None:
        ends = rows.groupBy(*by).agg(F.min("begin").alias("_a"), F.max("stop").alias("_b")).join(edges, list(by))
        out = out.unionByName(ends.filter("first < _a").select(*by, F.col("first").alias("begin"), F.col("_a").alias("stop"), F.lit(silence).alias("label")))
        out = out.unionByName(ends.filter("last > _b").select(*by, F.col("_b").alias("begin"), F.col("last").alias("stop"), F.lit(silence).alias("label")))
    return out


def rasterised(df: DataFrame, by: Sequence[str], begin: str, stop: str, label: str, fps: float, lengths: DataFrame, blank) -> DataFrame:
    """One row per frame of each group (`frames` of lengths) with the label of the latest interval over it."""
    at = lambda c: F.bround(F.col(c) * fps).cast("long")
    spans = df.withColumn("_place", F.row_number().over(ordered(by, [begin, stop]))).withColumn("_a", at(begin)).withColumn("_b", at(stop)).filter("_b > _a")
    covered = spans.select(*by, "_place", label, F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("frame")).groupBy(*by, "frame").agg(F.max_by(label, "_place").alias(label))
    frames = lengths.filter("frames > 0").select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("frame"))
    return frames.join(covered, [*by, "frame"], "left").withColumn(label, F.coalesce(label, F.lit(blank)))


def inserted_silence(anchors: DataFrame, by: Sequence[str], order: str, source: str, target: str, small: float = 1e-4) -> DataFrame:
    """Stretches of the target in which the source stands still."""
    w = ordered(by, [order])
    nxt = anchors.withColumn("_s", F.lead(source).over(w)).withColumn("_t", F.lead(target).over(w))
    return nxt.filter((F.abs(F.col("_s") - F.col(source)) < small) & (F.col("_t") - F.col(target) > small)).select(*by, F.col(target).alias("begin"), F.col("_t").alias("stop"))


def positional(a: DataFrame, b: DataFrame, by: Sequence[str], order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The i-th rows of two sequences side by side, as long as both have one."""
    a = a.withColumn("_pos", F.row_number().over(ordered(by, order_a)))
    b = b.withColumn("_pos", F.row_number().over(ordered(by, order_b)))
    return a.join(b, [*by, "_pos"]).withColumnRenamed("_pos", "pos")


def interval_mse(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean squared differences of boundaries, centres and durations of (begin_a, stop_a) and (begin_b, stop_b)."""
    sq = lambda x: F.pow(x, F.lit(2.0))
    a, b, c, d = (F.col(x) for x in ("begin_a", "stop_a", "begin_b", "stop_b"))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((sq(a - c) + sq(b - d)) / 2).alias("mse_boundary"), F.avg(sq((a + b) / 2 - (c + d) / 2)).alias("mse_center"), F.avg(sq((b - a) - (d - c))).alias("mse_duration")
    )


def folded(df: DataFrame, by: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A fold over each group's rows: state depends on what came out before. A group is one file or utterance."""
    ship(df.sparkSession)
    return df.groupBy(*by).applyInPandas(function, schema)


def merge_segments(rows: Sequence[tuple[float, float]], min_pause: float, max_len: float, min_len: float, snap: bool = True) -> list[tuple[float, float]]:
    """Joins ordered segments over pauses below min_pause while the whole stays within max_len; keeps those longer than min_len. With
    snap, neighbours that stay apart are moved towards each other by half their gap, by a quarter of min_pause at most (W5)."""
    merged: list[list[float]] = []
    for a, b in rows:
        if merged and a - merged[-1][1] < min_pause and b - merged[-1][0] <= max_len:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    kept = [s for s in merged if s[1] - s[0] > min_len]
    if snap:
        for left, right in zip(kept, kept[1:]):
            half = min((right[0] - left[1]) / 2, min_pause / 4)
            if half > 0:
                left[1] += half
                right[0] -= half
    return [(a, b) for a, b in kept]


def monotone_anchors(pairs: Sequence[tuple[float, float]], same: float = 1e-6, bump: float = 1e-4) -> list[tuple[float, float]]:
    """Anchors (source, target) with strictly rising targets: repeats go, falls are bumped to just after the last."""
    out: list[tuple[float, float]] = []
    for s, t in pairs:
        if out and abs(s - out[-1][0]) < same and abs(t - out[-1][1]) < same:
            continue
        out.append((s, t if not out or t > out[-1][1] else out[-1][1] + bump))
    return out


def without_plateaus(pairs: Sequence[tuple[float, float]], step: float = 0.5) -> list[tuple[float, float]]:
    """Of each run whose sources move less than a step, the first and the last anchor."""
    n = len(pairs)
    still = [abs(pairs[i][0] - pairs[i + 1][0]) < step for i in range(n - 1)]
    return [p for i, p in enumerate(pairs) if not (0 < i < n - 1 and still[i - 1] and still[i])]


def find_subsequence(tokens: Sequence[str], part: Sequence[str], start: int = 0) -> int:
    """Where the part begins in tokens from `start` on, or -1."""
    part = list(part)
    return next((i for i in range(start, len(tokens) - len(part) + 1) if list(tokens[i : i + len(part)]) == part), -1) if part else -1


def utterance_durations(words: Sequence[tuple[str, float, float]], utterances: Sequence[Sequence[str]], total: float) -> list[float]:
    """A duration for each utterance from aligned words, found one after the other; what isn't found shares what remains, 0.05 s at least."""
    out, cursor, used = [], 0, 0.0
    tokens = [w for w, _, _ in words]
    for k, u in enumerate(utterances):
        at = find_subsequence(tokens, u, cursor)
        if at >= 0:
            d = words[at + len(u) - 1][2] - words[at][1]
            cursor = at + len(u)
        else:
            d = (total - used) / (len(utterances) - k)
        d = round(max(d, 0.05), 3)
        used += d
        out.append(d)
    return out


def remap_phones(rows: Sequence[tuple[str, float, float]], one: dict[str, Sequence[str]], many: dict[tuple[str, ...], str]) -> list[tuple[str, float, float]]:
    """Labels mapped one to one or one to several (its time is shared evenly), and runs of labels joined to one, longest first."""
    out, i = [], 0
    sizes = sorted({len(k) for k in many}, reverse=True)
    while i < len(rows):
        for n in sizes:
            key = tuple(r[0] for r in rows[i : i + n])
            if len(key) == n and key in many:
                out.append((many[key], rows[i][1], rows[i + n - 1][2]))
                i += n
                break
        else:
            label, a, b = rows[i]
            parts = list(one.get(label, [label]))
            step = (b - a) / len(parts)
            out += [(p, a + k * step, a + (k + 1) * step) for k, p in enumerate(parts)]
            i += 1
    return out


def remapped(df: DataFrame, by: Sequence[str], order: str, label: str, one: dict[str, Sequence[str]], many: dict[tuple[str, ...], str], size: int = 1000) -> DataFrame:
    """remap_phones() over the whole sequence of each group, whatever its length: (by..., label, start, stop), the row in place i at [i, i + 1).

    Where two neighbours stand next to each other in no joined run, none goes over their border, so what comes before doesn't matter behind it. Sequences are dealt in
    pieces of about `size` rows that begin at such borders; a task holds a piece, and more only where such neighbours follow each other without end.
    """
    named = [F.col(c).alias(f"_{c}") for c in by]
    same = lambda x, y: reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[f"_{c}"]) for c in by])
    rows = numbered(df.select(*by, F.col(order).alias("_o"), F.col(label).alias("_l")), [*by, "_o"], "_n")
    first = rows.groupBy(*named).agg(F.min("_n").alias("_first"))
    rows = rows.join(first, same(rows, first)).select(*by, "_l", (F.col("_n") - F.col("_first")).alias("_i"))
    before = rows.select(*named, (F.col("_i") + 1).alias("_next"), F.col("_l").alias("_prev"))
    met = sorted({pair for run in many for pair in zip(run, run[1:])})
    bound = reduce(lambda a, b: a | b, [(F.col("_prev") == a) & (F.col("_l") == b) for a, b in met], F.lit(False))
    border = F.when(F.coalesce(bound, F.lit(False)), None).otherwise(F.col("_i"))
    cut = rows.join(before, same(rows, before) & (F.col("_i") == F.col("_next")), "left").select(*by, "_l", "_i", F.expr(f"_i div {size}").alias("_piece"), border.alias("_border"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.groupBy(*by, "_piece").agg(F.max("_border").alias("_last"))  # one row a piece
    pieces = pieces.select(*named, F.col("_piece").alias("_own"), F.max("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_piece").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_last", F.max("_border").over(inside))
    dealt = cut.join(pieces, same(cut, pieces) & (F.col("_piece") == F.col("_own"))).select(*by, "_l", "_i", F.floor(F.coalesce("_last", "_carried") / size).alias("_home"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("_i")
        found = remap_phones([(s, float(i), i + 1.0) for s, i in zip(p["_l"].tolist(), p["_i"].tolist())], one, many)
        out = pd.DataFrame(found, columns=["label", "start", "stop"])
        for k, c in enumerate(by):
            out.insert(k, c, p[c].iloc[0])
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    return folded(dealt, [*by, "_home"], run, f"{kinds}, label string, start double, stop double")


def lcs_pairs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of labels, by their lowered and trimmed text; of equal ways back the one up is taken."""
    x, y = [s.strip().lower() for s in a], [s.strip().lower() for s in b]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, u in enumerate(x, 1):
        for j, v in enumerate(y, 1):
            best[i, j] = best[i - 1, j - 1] + 1 if u == v else max(best[i - 1, j], best[i, j - 1])
    out, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_intervals(gold: Sequence[tuple[float, float, str]], other: Sequence[tuple[float, float, str]], gap: float = 2.0) -> tuple[float, float, int]:
    """Mean boundary error of matched intervals, error rate, and matches, by a least-cost alignment (M14, M16; our own definition).

    Matching costs the distances of both boundaries and `gap` more if labels differ; leaving one out costs `gap`. The rate counts what was left
    out and matches of different labels against the longer side.
    """
    n, m = len(gold), len(other)
    cost = np.zeros((n + 1, m + 1))
    cost[:, 0], cost[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    match = lambda i, j: abs(gold[i][0] - other[j][0]) + abs(gold[i][1] - other[j][1]) + gap * (gold[i][2] != other[j][2])
    for i in range(n):
        for j in range(m):
            cost[i + 1, j + 1] = min(cost[i, j] + match(i, j), cost[i, j + 1] + gap, cost[i + 1, j] + gap)
    i, j, errors, total, matched = n, m, 0, 0.0, 0
    while i or j:
        if i and j and np.isclose(cost[i, j], cost[i - 1, j - 1] + match(i - 1, j - 1)):
            i, j = i - 1, j - 1
            matched += 1
            errors += gold[i][2] != other[j][2]
            total += (abs(gold[i][0] - other[j][0]) + abs(gold[i][1] - other[j][1])) / 2
        else:
            errors += 1
            i, j = (i - 1, j) if i and np.isclose(cost[i, j], cost[i - 1, j] + gap) else (i, j - 1)
    return total / matched if matched else 0.0, errors / max(n, m, 1), matched
