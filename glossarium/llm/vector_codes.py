"""Vectors as short codes by product quantisation; codebooks are learned by filtering rounds over kd-trees.

Each task cuts its vectors into parts and builds one tree over each part of a block of vectors, whose nodes keep bounding box, sum and count. The trees are written once
and read in every round. From the root down, an entry that is farther than another one for the whole box of a node isn't looked at below it; when one
entry is left, the node's sum and count go to it without a look at its vectors. Only in leaves where several are left, vectors meet those entries one by one.
Tasks hand on one row for each entry and component, so what meets on the driver is the size of the codebooks.

Arithmetic is in whole numbers: a component x counts as floor(1024 x). Defined cases: rows whose vector is null or holds a null, a NaN or an infinity are left
out; vectors shorter than the longest are filled up with zeros, and so is a length that the parts don't divide; components beyond +-131072 count as that
bound, which keeps distances within 64 bits; rows with equal identifiers are coded one by one; null identifiers come last; null labels are one group; equal vectors have equal codes; fewer vectors than entries
make smaller codebooks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, small_batches, table, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BOUND = float(1 << 27)
#: Vectors of a block (one tree for each part), vectors of a leaf, nodes that are looked at together.
BLOCK, LEAF, NODES = 1 << 14, 32, 128
#: Labels that may be broadcast.
FEW = 100_000


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.asarray(values, np.float64) * SCALE, -BOUND, BOUND)).astype(np.int64)


def kept(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole."""
    x = F.col(vector)
    return df.filter(x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = whole_numbers(column.flatten().to_numpy(zero_copy_only=False))
    return out


class Tree:
    """A kd-tree over rows of whole numbers. order: the rows as the leaves have them; nodes: first row, row behind the last, left and right child (0: leaf)."""

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points), dtype=np.int32)
        nodes: list[list[int]] = [[0, len(points), 0, 0]]
        todo = [0]
        while todo:
            i = todo.pop()
            a, b = nodes[i][:2]
            if b - a <= LEAF:
                continue
            rows = points[order[a:b]]
            axis = int(np.argmax(rows.max(0) - rows.min(0)))
            if rows[:, axis].max() == rows[:, axis].min():
                continue  # all of its vectors are equal
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, axis], half)]
            nodes[i][2:] = [len(nodes), len(nodes) + 1]
            todo += nodes[i][2:]
            nodes += [[a, a + half, 0, 0], [a + half, b, 0, 0]]
        self.order, self.nodes, self.points = order, np.array(nodes, np.int32), points[order]
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, 0)])
        self.sums = sums[self.nodes[:, 1]] - sums[self.nodes[:, 0]]
        self.low = np.array([self.points[a:b].min(0) for a, b, *_ in nodes])
        self.high = np.array([self.points[a:b].max(0) for a, b, *_ in nodes])

    FIELDS = ("order", "nodes", "points", "sums", "low", "high")

    def packed(self) -> bytes:
        """As bytes, each array in the smallest type that holds it."""
        out = io.BytesIO()
        for f in self.FIELDS:
            x = getattr(self, f)
            np.save(out, x.astype(np.result_type(np.min_scalar_type(x.min()), np.min_scalar_type(x.max()), np.int16)), allow_pickle=False)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree, file = cls.__new__(cls), io.BytesIO(data)
        for f in cls.FIELDS:
            setattr(tree, f, np.load(file, allow_pickle=False).astype(np.int64))
        return tree


class Filter:
    """One codebook, ready to filter trees."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.norms = (book * book).sum(1)
        self.apart = np.abs(book[:, None, :] - book[None, :, :])

    def assign(self, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in the tree's order, sums, counts); entries of whole subtrees take the nodes' sums."""
        book, norms, k = self.book, self.norms, len(self.book)
        codes = np.zeros(len(tree.points), np.int64)
        single = np.zeros(len(tree.points), bool)
        sums, counts = np.zeros_like(book), np.zeros(k, np.int64)
        level = [(np.zeros(1, np.int64), np.ones((1, k), bool))]
        numbers = np.arange(k)
        while level:
            nodes, open_ = (np.concatenate(x) for x in zip(*level))
            level = []
            for i in range(0, len(nodes), NODES):
                n, left = nodes[i : i + NODES], open_[i : i + NODES]
                low, high = tree.low[n], tree.high[n]
                toward = (low + high) @ book.T
                best = np.where(left, norms[None] - toward, np.iinfo(np.int64).max).argmin(1)  # nearest to the middle, the lowest of equals
                at = np.arange(len(n))
                # an entry's squared distance less the best one's, where in the box that is least
                least = norms[None] - norms[best][:, None] - (toward - toward[at, best][:, None]) - np.einsum("nkd,nd->nk", self.apart[best], high - low)
                left = left & ~((least > 0) | ((least == 0) & (numbers[None] > best[:, None])))
                alone = left.sum(1) == 1
                np.add.at(sums, best[alone], tree.sums[n[alone]])
                np.add.at(counts, best[alone], tree.nodes[n[alone], 1] - tree.nodes[n[alone], 0])
                for node, entry in zip(n[alone].tolist(), best[alone].tolist()):
                    codes[tree.nodes[node, 0] : tree.nodes[node, 1]] = entry
                inner = ~alone & (tree.nodes[n, 2] > 0)
                for child in (2, 3):
                    if inner.any():
                        level.append((tree.nodes[n[inner], child], left[inner]))
                for j in np.flatnonzero(~alone & ~inner).tolist():
                    a, b = tree.nodes[n[j], :2]
                    some = np.flatnonzero(left[j])
                    codes[a:b] = some[(norms[some][None] - 2 * (tree.points[a:b] @ book[some].T)).argmin(1)]
                    single[a:b] = True
        np.add.at(sums, codes[single], tree.points[single])
        counts += np.bincount(codes[single], minlength=k)
        return codes, sums, counts


class Quantiser:
    """The trees of a table's vectors, and the codebooks."""

    def __init__(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = None, parts: int = PARTS, entries: int = ENTRIES):
        self.spark, self.parts = df.sparkSession, parts
        small_batches(self.spark, 1024)
        self.tables = Tables(self.spark)
        named = kept(df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), (F.col(label) if label else F.lit(None)).cast("long").alias("label")), "v")
        longest = named.agg(F.max(F.size("v"))).first()[0] or 1
        self.width = parts * -(-longest // parts)
        first = named.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        start = np.zeros((len(first), self.width), np.int64)
        for row, r in zip(start, first):
            row[: len(r.v)] = whole_numbers(r.v)
        self.books = [start[:, c].copy() for c in self.columns()]
        self.trees = self.tables.write(self.planted(named), "code-trees")

    def columns(self) -> list[slice]:
        d = self.width // self.parts
        return [slice(p * d, (p + 1) * d) for p in range(self.parts)]

    def planted(self, named: DataFrame) -> DataFrame:
        """(ids, labels, trees): one row a block."""
        width, columns = self.width, self.columns()
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("trees", pa.list_(pa.binary()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                x = matrix(t.column(1), width)
                row = {"ids": t.column(0).to_pylist(), "labels": t.column(2).to_pylist(), "trees": [Tree(x[:, c]).packed() for c in columns]}
                return pa.RecordBatch.from_pylist([row], schema=schema)

            held: list[pa.RecordBatch] = []
            for b in batches:
                held += [b] if b.num_rows else []
                if sum(h.num_rows for h in held) >= BLOCK:
                    yield block(held)
                    held = []
            if held:
                yield block(held)

        return named.mapInArrow(tidied(run), "ids array<long>, labels array<long>, trees array<binary>")

    def round(self) -> None:
        """Moves each entry to the mean of the parts nearest to it, rounded down."""
        books = self.spark.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = [Filter(b) for b in books.value]
            total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.value]
            for batch in batches:
                for trees in batch.column(0).to_pylist():
                    for f, t, data in zip(filters, total, trees):
                        _, sums, counts = f.assign(Tree.unpacked(data))
                        t[:, :-1] += sums
                        t[:, -1] += counts
            for p, t in enumerate(total):
                entry, place = np.nonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(t[entry, place], pa.int64())], ["part", "entry", "place", "total"])

        rows = self.trees.select("trees").mapInArrow(tidied(run), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()  # as many as the codebooks have numbers
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in self.books]
        for r in rows:
            total[r.part][r.entry, r.place] = r.total
        for b, t in zip(self.books, total):
            used = t[:, -1] > 0
            b[used] = t[used, :-1] // t[used, -1:]
        books.unpersist()

    def codes(self) -> DataFrame:
        """(vec_id, label, code, error) under the codebooks as they are."""
        books = self.spark.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = [Filter(b) for b in books.value]
            for batch in batches:
                for ids, labels, trees in zip(*(c.to_pylist() for c in batch.columns)):
                    found, error = np.zeros((len(ids), len(trees)), np.int64), np.zeros(len(ids), np.int64)
                    for p, (f, data) in enumerate(zip(filters, trees)):
                        tree = Tree.unpacked(data)
                        entries, _, _ = f.assign(tree)
                        found[tree.order, p] = entries
                        error[tree.order] += ((tree.points - f.book[entries]) ** 2).sum(1)
                    spelled = [bytes(row).hex() for row in found.astype(np.uint8)]
                    for i in range(0, len(ids), 4096):
                        s = slice(i, i + 4096)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64()), pa.array(labels[s], pa.int64()), pa.array(spelled[s], pa.string()), pa.array(error[s], pa.int64())], ["vec_id", "label", "code", "error"])

        return self.trees.mapInArrow(tidied(run), "vec_id long, label long, code string, error long")

    def digest(self) -> str:
        """SHA-256 of all numbers of the codebooks, in order."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def label_errors(found: DataFrame) -> DataFrame:
    """found with label_error, the sum of its label's errors."""
    by = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = by.limit(FEW + 1).count() <= FEW
    by = by.withColumnRenamed("label", "_label")
    same: Column = F.col("label").eqNullSafe(F.col("_label"))
    return found.join(F.broadcast(by) if few else by, same).drop("_label")


def compressed(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error and the codebooks' digest."""
    q = Quantiser(df, key, vector, label, parts, entries)
    if q.books[0].size:
        for _ in range(rounds):
            q.round()
    found = q.tables.write(q.codes(), "codes")
    q.tables.drop(q.trees)
    return label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(q.digest()).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings`."""
    return compressed(table(spark, sf_dir, "embeddings"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL; sums of squares stay below 2**53, so doubles are exact."""
    assign = lambda b: f"SELECT part, vec_id, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.part, p.vec_id, {b}.entry, list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, {b}.c) + list_inner_product({b}.c, {b}.c) AS d FROM p JOIN {b} USING (part)) GROUP BY part, vec_id"
    steps = "".join(
        f""",
a{i} AS MATERIALIZED ({assign(f"b{i}")}),
s{i} AS (SELECT a.part, a.entry, unnest(range(len(x))) AS j, unnest(x) AS v FROM a{i} a JOIN p USING (part, vec_id)),
m{i} AS (SELECT part, entry, j, floor(sum(v) / count(*)) AS v FROM s{i} GROUP BY part, entry, j),
n{i} AS (SELECT part, entry, list(v ORDER BY j) AS c FROM m{i} GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT b{i}.part, b{i}.entry, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (part, entry))"""
        for i in range(rounds)
    )
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS x FROM e, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {entries}){steps},
z AS ({assign(f"b{rounds}")}),
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id),
k AS (SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM (SELECT part, entry, array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN e USING (vec_id), k"""


ORACLE = {"op13_vector_codes": oracle()}
