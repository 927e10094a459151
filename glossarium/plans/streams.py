"""The stream plans over the stored events: as a stream that reads all that is there, and as a table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, table
from ..streaming import events as E
from .base import plan


@plan("T1", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly windows by event time, computed as a stream with a watermark."""
    schema = table(spark, sf, "events").schema
    out = E.run_available(E.tumbling(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf))), new_folder(spark, "tumbling"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "event_type", "n", F.round("total", 4).alias("total"))


@plan("T1 W5", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf):
    """Sessions of each user, as a table plan; the same plan runs as a stream."""
    s = E.sessions(table(spark, sf, "events"), "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def _folder(spark: SparkSession, sf: str) -> str:
    """A folder that holds the events alone: a stream reads folders, and the stored table may be a single file."""
    path = new_folder(spark, "events")
    table(spark, sf, "events").write.parquet(path)
    return path


@plan("T6 M11")
def belief_states(spark, sf):
    """A state for each user that is carried from batch to batch, over all batches that are there."""
    schema = table(spark, sf, "events").schema
    out = E.run_available(E.aligned(spark.readStream.schema(schema).parquet(_folder(spark, sf))), new_folder(spark, "beliefs"), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("steps", "state")).alias("m")).select("user_id", "m.steps", "m.state")


@plan("T3 T5", "SELECT event_id, user_id, value FROM events")
def stream_resumed(spark, sf):
    """New files of a folder as a stream that is stopped and started again: its checkpoint keeps it from reading a file twice."""
    schema, folder = table(spark, sf, "events").schema, _folder(spark, sf)
    out, checkpoint = new_folder(spark, "stream-out"), new_folder(spark, "stream-checkpoint")
    for _ in range(2):
        E.to_folder(E.source(spark, folder, schema, 1), out, checkpoint).awaitTermination()
    return spark.read.schema(schema).parquet(out).select("event_id", "user_id", "value")
