"""Residual vector quantisation with codebooks that follow the data by exponential means.

A stage's codebook is learned over batches of rows. A batch is assigned to its nearest entries, and counts and sums of the entries move towards the batch's; an entry is its
sum over its smoothed count. Entries whose count falls below a bound are replaced by vectors of the batch. The next stage learns what the stages before it leave over.
Only counts and sums of entries travel; sums are taken over whole numbers, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..session import ship
from .cells import ROWS, vectors
from .relational import hash_rank

#: A component counts in steps of this.
STEP = 2.0**-24


def nearest(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, the first of equals; distances are compared to nine digits."""
    d = (v * v).sum(1)[:, None] - 2 * (v @ book.T) + (book * book).sum(1)[None]
    return np.round(d, 9).argmin(1)


def quantised(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, what is left over) after all stages."""
    codes = np.zeros((len(v), len(books)), np.int64)
    for i, book in enumerate(books):
        codes[:, i] = nearest(v, book)
        v = v - book[codes[:, i]]
    return codes, v


@dataclass
class Codebook:
    """One stage while it learns."""

    entries: np.ndarray
    sums: np.ndarray
    sizes: np.ndarray
    decay: float = 0.8
    smooth: float = 1e-5

    def follow(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Moves towards a batch."""
        self.sizes = self.decay * self.sizes + (1 - self.decay) * counts
        self.sums = self.decay * self.sums + (1 - self.decay) * sums
        total = self.sizes.sum()
        smoothed = (self.sizes + self.smooth) / (total + len(self.sizes) * self.smooth) * total
        self.entries = self.sums / smoothed[:, None]


class ResidualQuantiser:
    """Codebooks of several stages, one after the other. Rows without a key or vector are left out; a table without rows gives no stages."""

    def __init__(self, df: DataFrame, key: str, vector: str, size: int = 64, stages: int = 3, batches: int = 4, passes: int = 2, means: int = 3, decay: float = 0.8, dead: float = 2.0, seed: int = 1):
        ship(df.sparkSession)
        self.rows = df.select(F.col(key).cast("long").alias("key"), N.doubles(vector).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
        self.books: list[np.ndarray] = []
        for stage in range(stages):
            start = self.sample(self.rows, size, seed + stage)
            if not len(start):
                break
            self.books.append(self.learned(start, batches, passes, means, decay, dead, seed))

    def sample(self, rows: DataFrame, n: int, seed: int) -> np.ndarray:
        """What the stages so far leave over of n rows by a rank."""
        some = rows.orderBy(hash_rank("key", seed), "key").limit(n).collect()
        return quantised(np.array([r.v for r in some], float), self.books)[1] if some else np.zeros((0, 1))

    def totals(self, rows: DataFrame, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts by nearest entry."""
        shared = rows.sparkSession.sparkContext.broadcast((self.books, book))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, own = shared.value
            sums, counts = np.zeros(own.shape, np.int64), np.zeros(len(own), np.int64)
            for part in parts:
                for i in range(0, part.num_rows, ROWS):
                    left = quantised(vectors(part.slice(i, ROWS), "v"), books)[1]
                    at = nearest(left, own)
                    np.add.at(sums, at, np.rint(left / STEP).astype(np.int64))
                    counts += np.bincount(at, minlength=len(own))
            used = np.flatnonzero(counts)
            flat = np.column_stack([sums[used], counts[used]])
            entry, place = np.divmod(np.arange(flat.size), flat.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(used[entry], pa.int32()), pa.array(place, pa.int32()), pa.array(flat.ravel(), pa.int64())], ["entry", "place", "total"])

        found = rows.select("v").mapInArrow(run, "entry int, place int, total long").groupBy("entry", "place").agg(F.sum("total").alias("total")).collect()  # the codebook's size
        out = np.zeros((len(book), book.shape[1] + 1))
        for r in found:
            out[r.entry, r.place] = r.total
        shared.unpersist()
        return out[:, :-1] * STEP, out[:, -1]

    def learned(self, start: np.ndarray, batches: int, passes: int, means: int, decay: float, dead: float, seed: int) -> np.ndarray:
        parts = [self.rows.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == b) for b in range(batches)]
        entries, counts = start, np.zeros(len(start))
        for _ in range(means):  # the start: means of the first batch
            sums, counts = self.totals(parts[0], entries)
            entries = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], entries)
        book = Codebook(entries, entries * counts[:, None], counts, decay)
        for p in range(passes):
            for b, part in enumerate(parts):
                sums, counts = self.totals(part, book.entries)
                if not counts.sum():
                    continue
                book.follow(sums, counts)
                gone = np.flatnonzero(book.sizes < dead)
                if len(gone) and not (p == passes - 1 and b == len(parts) - 1):  # the last batch's would stay unlearned
                    new = self.sample(part, len(gone), seed + 1000 + p * batches + b)
                    book.entries[gone[: len(new)]] = new
        return book.entries

    def encoded(self) -> DataFrame:
        """(key, codes, errors): each stage's entry, and the squared length of what it leaves over."""
        shared = self.rows.sparkSession.sparkContext.broadcast(self.books)

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for i in range(0, part.num_rows, ROWS):
                    some = part.slice(i, ROWS)
                    v, codes, errors = vectors(some, "v"), [], []
                    for book in shared.value:
                        at = nearest(v, book)
                        v = v - book[at]
                        codes.append(at)
                        errors.append(np.round((v * v).sum(1), 6))
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.column_stack(codes).tolist(), pa.list_(pa.int32())), pa.array(np.column_stack(errors).tolist(), pa.list_(pa.float64()))], ["key", "codes", "errors"])

        schema = "key long, codes array<int>, errors array<double>"
        return self.rows.mapInArrow(run, schema) if self.books else self.rows.select("key", F.array().cast("array<int>").alias("codes"), F.array().cast("array<double>").alias("errors"))
