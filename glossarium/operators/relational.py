"""Relational operators over corpus tables: snapshots in place of updates, keyed choices, seeded samples and splits.

All are plans of built-in expressions. Where a choice must be the same in every run it follows a total order; randomness is a rank by
the MD5 of the key and a seed, so that a sample doesn't depend on partitions and any engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import Stages


def hash_rank(key: str | Column, seed: int) -> Column:
    """A column to order by in place of random()."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def ranked(df: DataFrame, by: Sequence[str | Column], order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in an order."""
    return ranked(df, by, order, "_first").filter("_first = 1").drop("_first")


def bulk_update(table: DataFrame, values: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A new snapshot in which rows whose key is in `values` have its columns, nulls included (K11). Keys of `values` are distinct."""
    new = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_touched"))
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_touched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table and those rows whose keys it doesn't have; of rows with equal keys the first in column order."""
    new = keep_first(rows, keys, [c for c in rows.columns if c not in keys] or list(keys))
    return table.unionByName(new.join(table.select(*keys).distinct(), list(keys), "left_anti"))


def flag_in(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """df with whether its key is among ids."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition isn't true; null counts as not true."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def next_keys(table: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with keys after the table's largest (A10, K21). Numbers are given by range: offsets of the ranges' sizes and a count within each."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    return numbered(rows, order, "_n").join(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("_n")).cast("long")).drop("_top", "_n")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with numbers from 1 in a total order, without one task that sorts everything.

    The ranges are written before they are counted: their bounds come from a sample, and two readings of df that need different columns, or that adaptive execution
    coalesces in another way, would draw other ranges for the counts than for the rows.
    """
    parts = Stages(df.sparkSession).write(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_inside", inside).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def pair_roles(df: DataFrame, key: str, role: str, value: str, roles: Sequence[str]) -> DataFrame:
    """One row per key that has all roles; the greatest value of a role stands for it."""
    wide = df.filter(F.col(role).isin(list(roles))).groupBy(key).agg(*[F.max(F.when(F.col(role) == r, F.col(value))).alias(r) for r in roles])
    return wide.filter(reduce(lambda a, b: a & b, [F.col(r).isNotNull() for r in roles]))


def stem_role(path: str | Column) -> tuple[Column, Column]:
    """Key and role of a file stem that ends in r1 or r2, after a - or _ or nothing; both empty or null for other stems."""
    p = F.col(path) if isinstance(path, str) else path
    role = F.lower(F.right(p, F.lit(2)))
    known = role.isin("r1", "r2")
    rest = F.left(p, F.length(p) - 2)
    parted = F.right(rest, F.lit(1)).isin("-", "_")
    return F.when(known & parted, F.left(rest, F.length(rest) - 1)).when(known, rest).otherwise(""), F.when(known, role)


def intersect_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that all frames have, once each."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), frames[1:], frames[0].select(key).distinct())


def lookup(df: DataFrame, index: DataFrame, key: str, missing: str) -> DataFrame:
    """df with the index's columns and a status that says where there were none."""
    return df.join(index.withColumn("_hit", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_hit"), "ok").otherwise(missing)).drop("_hit")


def preferred(df: DataFrame, candidates: DataFrame, on: Column, preference: Column, key: Sequence[str], choice: str) -> DataFrame:
    """Each row with its best candidate by (preference, choice); rows without any go (J8). Both sides carry distinct column names."""
    joined = df.join(candidates, on)
    return joined.groupBy(*key).agg(F.min(F.struct(preference.alias("preference"), F.col(choice).alias("choice"))).alias("_best")).select(*key, "_best.preference", "_best.choice")


def first_filled(*columns: str | Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit("")) for c in columns])


def float_or(default: float, *columns: str) -> Column:
    """The first that reads as a number."""
    return F.coalesce(*[F.expr(f"try_cast({c} as double)") for c in columns], F.lit(default))


def optional_filters(**values) -> Column:
    """Equality with all values that are given; lists are memberships."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in values.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def reject_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, else null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(checks):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def reject_tally(df: DataFrame, reason: str, example: str, examples: int = 3) -> DataFrame:
    """Rows of each reason and its first examples."""
    few = ranked(df.filter(F.col(reason).isNotNull()), [reason], [example], "_n").filter(F.col("_n") <= examples)
    return df.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(few.groupBy(reason).agg(F.sort_array(F.collect_list(example)).alias("examples")), reason)


def subset_shortest_then_random(df: DataFrame, key: str, duration: str, k: int, seed: int, manual: Column | None = None) -> DataFrame:
    """k rows by a rank among the 10 * k shortest, marked ones first (L4)."""
    short = df.orderBy(F.col(duration), F.col(key)).limit(10 * k)
    first = [manual.cast("int").desc()] if manual is not None else []
    return short.orderBy(*first, hash_rank(key, seed), F.col(key)).limit(k)


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by a rank."""
    return df.orderBy(hash_rank(key, seed), F.col(key)).limit(k)


def split_sizes(n: int, share: float) -> tuple[int, int]:
    """Rows for training, and for validation and test each."""
    if n == 0:
        return 0, 0
    train = max(1, min(int(n * share), n))
    other = (n - train) // 2
    if other == 0 and n >= 3:
        other = 1
    return n - 2 * other, other


def split(df: DataFrame, key: str, share: float, seed: int, name: str = "split") -> DataFrame:
    """Exact shares of train, val and test by a rank."""
    train, other = split_sizes(df.count(), share)
    place = numbered(df.withColumn("_hash", hash_rank(key, seed)), ["_hash", key], "_n").drop("_hash")
    return place.withColumn(name, F.when(F.col("_n") <= train, "train").when(F.col("_n") <= train + other, "val").otherwise("test")).drop("_n")


def round_robin(df: DataFrame, by: str, order: Sequence[str], n: int, name: str = "pool") -> DataFrame:
    """Rows dealt to n pools within each group."""
    place = numbered(df, [by, *order], "_n")  # in ranges over all groups, so that a large group is many tasks
    first = place.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
    return place.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, ((F.col("_n") - F.col("_first")) % n).cast("long")).drop("_n", "_by", "_first")


def greedy_loads(counts: Sequence[tuple[object, int]], jobs: int) -> dict[object, int]:
    """Key to job: largest counts first, each to the job with the least so far, ties by key and job (W15). Counts are an aggregate of few rows."""
    loads, out = [0] * jobs, {}
    for key, n in sorted(counts, key=lambda x: (-x[1], str(x[0]))):
        job = min(range(jobs), key=lambda j: (loads[j], j))
        loads[job] += n
        out[key] = job
    return out


def greedy_runs(runs: Sequence[tuple[int, int]], jobs: int) -> list[tuple[int, int, int, list[int]]]:
    """greedy_loads by runs of equal counts: (n, number of keys) to (n, first place, last place, jobs dealt in turn), places from 1 by falling counts."""
    loads, out, place = [0] * jobs, [], 1
    for n, left in sorted(runs, reverse=True):
        least = min(loads)
        level = [(x - least) // n for x in loads]  # a job takes part once the others have caught up with it
        for at, until in zip(steps := sorted(set(level)), [*steps[1:], None]):
            turn = sorted((j for j in range(jobs) if level[j] <= at), key=lambda j: ((loads[j] - least) % n, j))
            dealt = left if until is None else min(left, (until - at) * len(turn))
            if dealt:
                out.append((n, place, place + dealt - 1, turn))
            for k, j in enumerate(turn):
                loads[j] += n * (dealt // len(turn) + (k < dealt % len(turn)))
            place, left = place + dealt, left - dealt
    return out


def groups_first_seen(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values of each key in order, and the place where the key was first seen."""
    return df.groupBy(key).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), ",").alias("members"))


def catalogue(parts: Sequence[tuple[int, DataFrame]], key: str) -> DataFrame:
    """Union of catalogues with priorities: each key once, from the first that has it, with running numbers."""
    all_ = reduce(lambda a, b: a.unionByName(b), [df.select(key).withColumn("priority", F.lit(p)) for p, df in parts])
    first = all_.groupBy(key).agg(F.min("priority").cast("long").alias("priority"))
    return numbered(first, ["priority", key], "number")


def closure(start: DataFrame, step, keys: Sequence[str], rounds: int = 50) -> DataFrame:
    """start and everything that step makes from what is new, until nothing is (U5). Each round's new rows are written to the checkpoint folder."""
    found = new = start.dropDuplicates(list(keys)).checkpoint()
    for _ in range(rounds):
        new = step(new).dropDuplicates(list(keys)).join(found.select(*keys), list(keys), "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.unionByName(new).checkpoint()
    raise ValueError(f"not closed after {rounds} rounds")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without an output yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")
