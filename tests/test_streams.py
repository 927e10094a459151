"""State that is carried from batch to batch: over restarts, and until it expires."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from glossarium.streaming import events as E

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(seed, n, users=3):
    rng = np.random.default_rng(seed)
    return [(seed * 1000 + i, START + dt.timedelta(minutes=seed * 100 + i), int(rng.integers(users)), float(rng.normal(50, 30))) for i in range(n)]


def state_of(values):
    belief = [1.0] + [0.0] * 7
    for v in values:
        moved = [0.7 * b for b in belief]
        for k in range(8):
            moved[min(k + 1, 7)] += 0.3 * belief[k]
        belief = [m * np.exp(-0.5 * ((k * 12.5 - v) / 25) ** 2) for k, m in enumerate(moved)]
        belief = [b / sum(belief) for b in belief]
    return int(np.argmax(belief))


def test_states_over_a_restart(spark, tmp_path):
    folder, done = str(tmp_path / "in"), []
    for seed in (1, 2):  # the second time the stream is a new one over the same checkpoint
        done += rows_of(seed, 40)
        spark.createDataFrame(done[-40:], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        out = E.run_available(E.aligned(stream), str(tmp_path / "run"), "update")
        got = {r.user_id: (r.m.steps, r.m.state, r.m.ended) for r in out.groupBy("user_id").agg(F.max(F.struct("steps", "state", "ended")).alias("m")).collect()}
        values = {u: [v for _, _, w, v in sorted(done, key=lambda r: (r[1], r[0])) if w == u] for u in {r[2] for r in done}}
        assert got == {u: (len(v), state_of(v), False) for u, v in values.items()}


def test_states_expire(spark, tmp_path):
    folder, hour = str(tmp_path / "in"), dt.timedelta(hours=1)
    parts = [[(1, START, 7, 10.0), (2, START + hour / 4, 7, 40.0)], [(3, START + 9 * hour, 8, 50.0)], [(4, START + 10 * hour, 8, 50.0)], [(5, START + 11 * hour, 7, 90.0)]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        out = E.run_available(E.aligned(stream, idle=3600.0, late="30 minutes"), str(tmp_path / "run"), "update")
    got = sorted((r.user_id, r.steps, r.state, r.ended) for r in out.collect())
    assert got == sorted([(7, 2, state_of([10.0, 40.0]), False), (7, 2, state_of([10.0, 40.0]), True), (8, 1, state_of([50.0]), False), (8, 2, state_of([50.0, 50.0]), False), (7, 1, state_of([90.0]), False)])
