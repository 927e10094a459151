"""Operators whose plans were made for large groups, against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from glossarium.operators import intervals as I
from glossarium.operators import relational as R
from glossarium.operators import statistics as S


def test_quartiles_by_rank(spark):
    for values in ([3.0], [1.0, 4.0], [5.0, 1.0, 1.0, 9.0, 2.5, None], []):
        row = S.describe(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
        kept = [v for v in values if v is not None]
        assert row.n == len(kept)
        if kept:
            assert np.allclose([row.p25, row.p50, row.p75], np.quantile(kept, [0.25, 0.5, 0.75]))
        else:
            assert row.p50 is None


def test_blocks_hold_every_row_once(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    blocks = S.in_blocks(df, "k", most=30)
    assert len(blocks) == 4 and sorted(r.k for b in blocks for r in b.collect()) == list(range(100)) and len(S.in_blocks(df.limit(0), "k")) == 1


def test_round_robin_with_a_null_group(spark):
    rows = [("a", i) for i in range(7)] + [(None, i) for i in range(3)]
    got = {(r.g, r.k): r.pool for r in R.round_robin(spark.createDataFrame(rows, "g string, k long"), "g", ["k"], 3).collect()}
    assert got == {(g, k): k % 3 for g, k in rows}


def test_points_and_cuts_with_repeated_rows(spark):
    points = spark.createDataFrame([("f", 1.0), ("f", 1.0), ("f", 9.0), ("g", 1.0)], "f string, at double")
    spans = spark.createDataFrame([("f", 0.5, 2.0, "x"), ("f", 0.9, 1.5, "y")], "f string, b double, e double, label string")
    assert sorted((r.f, r.at, r.label) for r in I.containing(points, spans, ["f"], "at", "b", "e", 1.0).collect() if r.label) == [("f", 1.0, "x"), ("f", 1.0, "x")]
    df = spark.createDataFrame([("f", 0.0, 1.0), ("f", 0.0, 1.0), ("f", 4.0, 5.0), ("g", 0.0, 1.0)], "f string, begin double, stop double")
    cuts = spark.createDataFrame([("f", 0.5, 0.6)], "f string, cut_begin double, cut_stop double")
    assert sorted((r.f, r.begin) for r in I.without_overlaps(df, cuts, ["f"], 2.0).collect()) == [("f", 4.0), ("g", 0.0)]


def test_nearest_centre_within_the_row(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, -1.0]), (3, [-1.0, -1.0])], "k long, v array<double>")
    centres = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.1, 1.0])], "label string, centroid array<double>")
    assert sorted((r.k, r.predicted) for r in S.classified(df, centres, "label", "v", 0.3).collect()) == [(1, "a"), (2, "b"), (3, "UNKNOWN"), (3, "UNKNOWN")]
    assert "Exchange hash" not in S.classified(df, centres.withColumn("x", F.lit(1)).drop("x"), "label", "v", 0.3)._jdf.queryExecution().toString()


def test_numbers_of_rows_that_are_more_than_the_ranges_sample(spark):
    df = spark.range(60_000, numPartitions=6).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("more"))
    joined = df.join(spark.range(60_000).withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"))
    got = sorted((r.n, r.k) for r in R.numbered(joined, ["k"], "n").select("n", "k", "more").collect())
    assert [n for n, _ in got] == list(range(1, 60_001)) and [k for _, k in got] == sorted(k for _, k in got)


def test_remapped_over_the_borders_of_pieces(spark):
    rng = np.random.default_rng(3)
    many = {("a", "b"): "ab", ("a", "b", "a"): "aba", ("c", "c"): "cc"}
    groups = {"x": list(rng.choice(list("abcd"), 300)), "y": ["c"] * 41, None: list("ab" * 20), "z": ["d"]}
    rows = [(g, k, s) for g, labels in groups.items() for k, s in enumerate(map(str, labels))]
    df = spark.createDataFrame(rows, "g string, k long, s string").repartition(3)
    want = sorted((str(g), *r) for g, labels in groups.items() for r in I.remap_phones([(str(s), float(i), i + 1.0) for i, s in enumerate(labels)], {"d": ["d0", "d1"]}, many))
    assert sorted((str(r.g), r.label, r.start, r.stop) for r in I.remapped(df, ["g"], "k", "s", {"d": ["d0", "d1"]}, many, size=4).collect()) == want


def test_phones_are_remapped_over_whole_sequences(spark, tmp_path):
    from glossarium import catalog

    segments = ["BUILDING", "MACHINERY", "HOUSEHOLD"]
    spark.range(900, 1100).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.when(F.col("id") == 999, segments[1]).when(F.col("id") == 1000, segments[2]).otherwise(segments[0]).alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.label, r.start, r.stop) for r in catalog.queries()["phones_remapped"](spark, str(tmp_path)).collect()}
    assert ("MH", 99.0, 101.0) in got and len(got) == 2 * 198 + 1 and max(stop for _, _, stop in got) == 200.0
