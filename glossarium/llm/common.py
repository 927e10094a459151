"""What the operators of this package share: tables in the shared folder, Arrow batch sizes, hashes of words."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, ship

#: Rows and bytes of an Arrow batch: whole texts are long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps restart from these files."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables that one run writes to the shared folder, and takes away once what was made from them has been written.

    A task that is run again reads its direct inputs only, so a table whose readers are written isn't needed for recovery.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        """Like written()."""
        path = new_folder(self.spark, name)
        df.write.options(**(options or {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes those of the tables that this run wrote."""
        for out, path in [k for k in self.kept if any(k[0] is t for t in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.kept = [k for k in self.kept if not any(k[0] is t for t in tables)]


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Makes ready for Python operators: workers get this package, and Arrow batches are small."""
    ship(spark)
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def tidied(run: Callable) -> Callable:
    """run over batches; what is free when a task ends goes back to the system, since the worker lives on and the next stage needs its own memory."""

    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


WORD = re.compile(r"\w+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over unsigned 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    """A 64-bit hash of a word, the same in every process."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class HashCache(dict):
    """word -> hash; forgets everything when full, so that its memory is bounded."""

    def __init__(self, size: int = 400_000, make=word_hash):
        super().__init__()
        self.size, self.make = size, make

    def __missing__(self, word):
        if len(self) >= self.size:
            self.clear()
        value = self.make(word)
        if not isinstance(word, str) or len(word) <= 64:
            self[word] = value
        return value


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` word hashes; a shorter text has one window, an empty one none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
    return mix64(out)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `size`."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield _batch(block, schema)
            block = []
    if block:
        yield _batch(block, schema)


def _batch(block: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def components(edges: DataFrame, tables: Tables, name: str = "component") -> DataFrame:
    """(node, label) of the nodes of (a, b), written: the smallest node that each is connected with.

    Each round takes the least label of all neighbours and then follows labels once, so chains shorten by more than half;
    every round's labels are written, so that a lost executor costs one round at most.
    """
    both = tables.write(edges.selectExpr("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).filter("a <> b").distinct(), name + "-edges")
    labels = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        least = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("further"))  # a root leads nowhere
        step = least.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), (F.coalesce("further", "label") != F.col("was")).alias("moved"))
        step = tables.write(step, name)
        tables.drop(labels)
        if step.filter("moved").isEmpty():
            tables.drop(both)
            return step
        labels = step


def relabelled(labels: DataFrame | None, edges: DataFrame, tables: Tables, name: str = "component") -> DataFrame:
    """(node, label), written, after further edges between nodes; labels has those of nodes that are connected already (others are their own) and is dropped."""
    if labels is None:
        return components(edges, tables, name)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(c + "_label"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    found = components(named, tables, name)
    merged = found.select("node", F.col("label").alias("new"))
    inside = labels.join(merged.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    alone = merged.join(labels, "node", "left_anti").select("node", F.col("new").alias("label"))
    out = tables.write(inside.unionByName(alone), name)
    tables.drop(labels, found)
    return out
