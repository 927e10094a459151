"""An inverted-list index over unit vectors (F29): coarse centres, a list for each, and searches that read the lists nearest to a query.

The centres are learned from a sample; every row is in the list of its nearest centre. A search ranks the rows of its lists by their exact cosine distances. How many lists
it reads is found by measurement: for a sample of rows, the exact neighbours' lists are looked up among the sample's nearest centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..session import ship
from . import cells as C
from .relational import hash_rank
from .stages import Stages
from .statistics import neighbours

#: Rows that the centres are learned from at most, rounds, centres at most, and rows whose exact neighbours are looked up to choose how many lists are read.
SAMPLE, ROUNDS, LISTS, MEASURED = 20_000, 8, 4096, 100


def _numpy(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False)


def spherical_means(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres of unit vectors; the first k vectors are the start, and a centre without vectors stays."""
    centres = v[:k].copy()
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


class InvertedLists:
    """The index of a table's vectors by cosine distance. Rows without a key or vector and vectors of length zero aren't in it; equal keys are rows of their own."""

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 1):
        spark = df.sparkSession
        ship(spark)
        self.stages, self.seed = Stages(spark), seed
        self.rows_in = self._units(df, key, vector)
        n = self.rows_in.count()
        some = self.rows_in.orderBy(hash_rank("key", seed), "key").limit(sample).collect()  # `sample` rows at most
        k = min(len(some), LISTS, lists or math.ceil(math.sqrt(max(1, n))))
        self.centres = spherical_means(np.array([r.v for r in some], float).reshape(len(some), -1), k) if some else np.zeros((0, 1))
        dealt = self._dealt(self.rows_in, 1).select("cell", "key", "v")
        self.rows = self.stages.write(dealt.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(64))).sortWithinPartitions("cell", "key"), "index-lists")
        self.sizes = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))

    @staticmethod
    def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("key"), N.doubles(vector).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
        return rows.filter(F.exists("v", lambda x: x != 0)).withColumn("v", N.unit("v"))

    def _dealt(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows with each of the `probes` nearest lists and its rank."""
        centres = rows.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, C.ROWS):
                    some = batch.slice(i, C.ROWS)
                    order = np.argsort(-(C.vectors(some, "v") @ centres.value.T), axis=1, kind="stable")[:, :probes]
                    row = pa.array(np.repeat(np.arange(some.num_rows), order.shape[1]))
                    rank = np.tile(np.arange(1, order.shape[1] + 1), some.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(order.ravel(), pa.int32()), pa.array(rank, pa.int32()), *some.take(row).columns], ["cell", "list_rank", *some.schema.names])

        return rows.mapInArrow(run, "cell int, list_rank int, key long, v array<double>")

    def probes_for(self, k: int, recall: float, measured: int = MEASURED) -> int:
        """Lists to read for this share of the k nearest, measured on a sample of rows against all rows."""
        if not len(self.centres):
            return 1
        some = self.rows_in.orderBy(hash_rank("key", self.seed + 1), "key").limit(measured)
        near = neighbours(some, self.rows_in, "key", "v", k).select("query", "other")
        ranks = self._dealt(some, len(self.centres)).select(F.col("key").alias("query"), "cell", "list_rank")
        lists = self.rows.select(F.col("key").alias("other"), "cell").join(F.broadcast(near), "other")  # k for each of the sample
        counts = lists.join(F.broadcast(ranks), ["query", "cell"]).groupBy("list_rank").agg(F.count(F.lit(1)).alias("n")).collect()
        found, total = 0, sum(r.n for r in counts)
        for r in sorted(counts):
            found += r.n
            if found >= recall * total:
                return r.list_rank
        return 1

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int, digits: int = C.DIGITS) -> DataFrame:
        """(query, rank, other, distance): the k rows nearest to each query within its `probes` lists, by (distance, key); a row isn't its own neighbour. Distances are
        rounded to `digits` before they are compared."""
        asked = self._dealt(self._units(queries, key, vector), min(probes, max(1, len(self.centres)))).select("cell", F.lit(False).alias("home"), "key", "v")
        rows = self.rows.select("cell", F.lit(True).alias("home"), "key", "v")

        def begin(residents: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            return C.vectors(residents.combine_chunks().to_batches()[0], "v"), _numpy(residents, "key")

        def pass_by(state: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            (v, keys), who = state, _numpy(batch, "key")
            asked = C.vectors(batch, "v")
            d = C.rounded(1 - asked @ v.T, digits, lambda i, j: 1 - C.dots(asked[i], v[j]))
            d[who[:, None] == keys[None, :]] = np.inf
            order = np.lexsort((np.broadcast_to(keys, d.shape), d), axis=1)[:, :k]
            near = np.take_along_axis(d, order, 1)
            row, place = np.nonzero(np.isfinite(near))
            yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(keys[order[row, place]]), pa.array(near[row, place])], ["query", "other", "distance"])

        met = C.meet(self._sliced(rows, asked), "query long, other long, distance double", begin, pass_by, lambda state: ())
        best = Window.partitionBy("query").orderBy("distance", "other")
        return met.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select("query", "rank", "other", "distance")

    def _sliced(self, rows: DataFrame, asked: DataFrame) -> DataFrame:
        """Lists in slices, and each query once for each slice of its lists."""
        slices = F.broadcast(self.sizes.select("cell", F.ceil(F.col("n") / C.SLICE).cast("int").alias("slices")))  # one row a list
        live = rows.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")).withColumn("kind", F.lit(0))
        visit = asked.join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("kind", F.lit(1))
        return live.unionByName(visit).drop("slices", "home").repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind", "key")
