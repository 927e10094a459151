"""Streams over event tables: windows with watermarks, sessions, and a state for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import ship


def source(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; its checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums of each window and type (T1). The same plan runs over a table."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user with pauses below a gap (T1, W5 without a longest length)."""
    g = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")


def run_available(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now: each batch's output as a table of a shared folder, of which the last is the result of a complete mode."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that is run again replaces what it wrote

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A stream written as Parquet, each row once."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def belief_step(belief: np.ndarray, likelihood: np.ndarray, move: float) -> np.ndarray:
    """One step of a left-to-right chain: stay or move on, the last state keeps; then weigh and normalise."""
    prior = belief * (1 - move)
    prior[1:] += belief[:-1] * move
    prior[-1] += belief[-1] * move
    out = prior * likelihood
    total = out.sum()
    return out / total if total > 0 else np.full(len(out), 1 / len(out))


class Beliefs(StatefulProcessor):
    """Of each user the belief over the states and the number of steps; with `idle`, a user without events for so many seconds of event time is ended."""

    def __init__(self, states: int, move: float, idle: float | None):
        self.states, self.move, self.idle = states, move, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("belief", "belief array<double>, n long")

    def row(self, key: tuple, ended: bool) -> pd.DataFrame:
        belief, n = self.kept.get()
        return pd.DataFrame({"user_id": [key[0]], "steps": [n], "state": [int(np.argmax(belief))], "ended": [ended]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        belief, n = self.kept.get() if self.kept.exists() else (np.eye(self.states)[0], 0)
        b = np.array(belief, float)
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one user's events of one batch, which may come in any order
        for value in batch.value:
            likelihood = np.exp(-0.5 * ((np.arange(self.states) * 100 / self.states - value) / 25) ** 2)
            b, n = belief_step(b, likelihood, self.move), n + 1
        self.kept.update((b.tolist(), n))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(batch.ts.max().timestamp() * 1000 + self.idle * 1000))
        yield self.row(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            yield self.row(key, True)
            self.kept.clear()

    def close(self) -> None:
        pass


def aligned(events: DataFrame, states: int = 8, move: float = 0.3, idle: float | None = None, late: str = "2 hours") -> DataFrame:
    """Each user's most likely state after all of its events so far: (user_id, steps, state, ended) whenever a batch has events of the user.

    The belief and the number of steps are kept from batch to batch and over restarts. With `idle`, a user's state goes when the watermark has passed its last event by so many
    seconds, with one more row whose `ended` is true; later events begin anew. The state is in the RocksDB store, which typed state needs.
    """
    ship(events.sparkSession)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = timed(events) if idle is None else timed(events).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Beliefs(states, move, idle), "user_id long, steps long, state long, ended boolean", "Update", "None" if idle is None else "EventTime")
