"""Vectors dealt to cells around pivots, for searches within a radius that compare near vectors only and hold no cell in one task.

Each vector lives in the cell of its nearest pivot and visits every other cell that may hold one of its neighbours. If x lives with pivot p and y with q, and
x and y are at most r apart, then d(x, q) <= d(x, p) + 2r, and d(x, q) <= r + the radius of q's cell: vectors visit the cells for which both hold. A cell of
many residents is dealt in slices, each of which all visitors of the cell pass in a stream, so that a task holds one slice and one batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .relational import hash_rank

#: Vectors for each pivot and pivots at most (they are broadcast); residents of a slice; rows that meet the pivots together.
PER_PIVOT, PIVOTS, SLICE, ROWS = 500, 8192, 2048, 512
#: Groups of slices that vectors are sent to (each once, whatever the number of its slices that it visits), and residents of a group at most, above which there are more groups.
GROUPS, GROUP_ROWS = 64, 65_536
#: What rough() may be wrong by, as a share of the vectors' squared lengths.
ERROR = 1e-12
#: Digits to which distances are rounded before they are compared.
DIGITS = 9


def vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A list column as rows; all of its lists have one length."""
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to ERROR times the squared lengths."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a to those of b at the same place, summed by component, so that equal vectors are 0 apart."""
    return np.round(np.sqrt(((a - b) ** 2).sum(1)), DIGITS)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and those of b at the same place, added from the first component to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


def rounded(d: np.ndarray, digits: int, exactly: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A matrix rounded to digits, halves away from zero. Sums in another order may put a value on the other side of a half (or of 0), so values next to one
    are taken from exactly(rows, columns), where the order of the sum is fixed."""
    scale = 10.0**digits
    at = d * scale
    doubled = 2 * at
    i, j = np.nonzero(np.abs(doubled - np.rint(doubled)) <= 1e-13 * scale)
    at[i, j] = exactly(i, j) * scale
    return np.copysign(np.floor(np.abs(at) + 0.5), at) / scale


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether rows of a and b are at most `radius` apart; pairs that the product leaves in doubt are looked at once more."""
    bound, p, q = radius * radius, (a * a).sum(1), (b * b).sum(1)
    over = np.column_stack([-2 * a, p - bound, np.ones(len(a))]) @ np.column_stack([b, np.ones(len(b)), q]).T  # the square of the distance over that of the radius
    doubt = ERROR * (p.max(initial=0) + q.max(initial=0) + bound) + 4 * radius * 10.0**-DIGITS
    near = over <= -doubt
    i, j = np.nonzero(near ^ (over <= doubt))
    near[i, j] = exact(a[i], b[j]) <= radius
    return near


def pivots_of(points: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    """Vectors of some of the points, by a rank that doesn't depend on partitions."""
    m = max(1, min(PIVOTS, math.ceil(n / PER_PIVOT)))
    rows = points.select("key", "v").orderBy(hash_rank("key", seed), "key").limit(m).collect()  # PIVOTS at most
    return np.unique(np.array([r.v for r in rows], float), axis=0)


def meet(dealt: DataFrame, schema: str, begin: Callable, pass_by: Callable, end: Callable) -> DataFrame:
    """For each slice of dealt rows (cell, slice, kind 0 of residents and 1 of visitors, ...), sorted by these: state = begin(table of its residents), rows of pass_by(state, batch of visitors) for each batch, rows of end(state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, state = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            if group is not None:
                yield from end(state if state is not None else begin(pa.Table.from_batches(held)))

        for batch in batches:
            cell, part, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "slice", "kind"))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (cell[a], part[a]) != group:
                    yield from close()
                    group, held, state = (cell[a], part[a]), [], None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(rows)
                elif held:
                    if state is None:
                        state = begin(pa.Table.from_batches(held))
                    for i in range(0, rows.num_rows, ROWS):
                        yield from pass_by(state, rows.slice(i, ROWS))
        if held:
            yield from close()

    return dealt.mapInArrow(run, schema)


class Groups:
    """Slices of cells in groups. A vector goes once to each group with slices that it visits, with their numbers, so what is sent grows with the number of vectors and of groups, not with
    that of the cells; a task holds the residents of one group and one batch of visitors."""

    def __init__(self, points: DataFrame, pivots: np.ndarray, radius: float):
        spark = points.sparkSession
        ship(spark)
        self.radius, self.pivots = radius, spark.sparkContext.broadcast(pivots)
        self.slack = slack = 1e-5 * (1 + float(np.abs(pivots).max(initial=0)) + radius)  # roots of rough squares; a vector too many in a cell does no harm
        shared = self.pivots

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far, n = np.full(len(shared.value), -1.0), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    d = np.sqrt(np.maximum(rough(vectors(batch.slice(i, ROWS), "v"), shared.value), 0))
                    may = d <= d.min(1)[:, None] + slack  # of pivots as near another run may choose another one
                    far, n = np.maximum(far, np.where(may, d, -1.0).max(0)), n + np.bincount(d.argmin(1), minlength=len(n))
            some = np.flatnonzero(far >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(far[some]), pa.array(n[some])], ["cell", "radius", "n"])

        reach, n = np.full(len(pivots), -math.inf), np.zeros(len(pivots), np.int64)
        for r in points.select("v").mapInArrow(near, "cell int, radius double, n long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).collect():  # one row a pivot
            reach[r.cell], n[r.cell] = r.radius, r.n
        slices = np.maximum(1, -(-n // SLICE))
        cell = np.repeat(np.arange(len(pivots)), slices)
        groups = min(len(cell), max(GROUPS, -(-int(n.sum()) // GROUP_ROWS)))
        order = np.argsort(-(n / slices)[cell], kind="stable")
        group = np.empty(len(cell), np.int32)
        group[order] = np.arange(len(cell)) % groups  # the fullest slices go to different groups
        #: reach of each cell, its first slice and number of slices; cell and group of each slice
        self.plan = spark.sparkContext.broadcast((reach, np.cumsum(slices) - slices, slices, cell, group))

    def _mapped(self, points: DataFrame, kind: int, choose: Callable) -> DataFrame:
        """points as rows (group, kind, places, ...) where choose(distances to the pivots, keys) gives rows and slices, by row and by group."""
        shared, plan = self.pivots, self.plan

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, ROWS):
                    some = batch.slice(i, ROWS)
                    keys = some.column(some.schema.get_field_index("key")).to_numpy()
                    row, at = choose(np.sqrt(np.maximum(rough(vectors(some, "v"), shared.value), 0)), keys, plan.value)
                    group = plan.value[4][at]
                    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
                    places = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(at)], pa.int32()), pa.array(at, pa.int32()))
                    taken = some.take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.array(np.full(len(first), kind), pa.int32()), places, *taken.columns], ["group", "kind", "places", *some.schema.names])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        return points.mapInArrow(deal, f"group int, kind int, places array<int>, {kinds}")

    def homes(self, points: DataFrame) -> DataFrame:
        """points (key, v, ...) where they live: in one slice each."""

        def choose(d, keys, plan):
            _, first, slices, _, _ = plan
            home = d.argmin(1)
            mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            return np.arange(len(keys)), first[home] + (mixed % slices[home].astype(np.uint64)).astype(np.int64)

        return self._mapped(points, 0, choose)

    def visits(self, points: DataFrame) -> DataFrame:
        """points (key, v, ...) in every group with slices that may hold one of their neighbours."""
        radius, slack = self.radius, self.slack

        def choose(d, keys, plan):
            reach, _, _, cell, group = plan
            order = np.argsort(group, kind="stable")
            goes = (d <= d.min(1)[:, None] + 2 * radius + slack) & (d <= reach[None] + radius + slack)
            row, at = np.nonzero(goes[:, cell[order]])
            return row, order[at]

        return self._mapped(points, 1, choose)


def gather(homes: DataFrame, visits: DataFrame | None, schema: str, columns: Sequence[str], begin: Callable, pass_by: Callable | None, end: Callable) -> DataFrame:
    """For each slice of Groups: state = begin(residents, task), rows of pass_by(state, visitors) for each batch of its visitors, rows of end(state).

    Residents and visitors are arrays by column: `v` and those named. task is a dictionary that all slices of a task share.
    """
    dealt = (homes if visits is None else homes.unionByName(visits)).repartition("group").sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, states, task = None, [], None, {}

        def read(rows: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
            places = rows.column(rows.schema.get_field_index("places"))
            at = places.flatten().to_numpy()
            row = np.repeat(np.arange(rows.num_rows), np.diff(places.offsets.to_numpy()))
            every = {"v": vectors(rows, "v")} | {c: rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}
            order = np.argsort(at, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                yield int(at[some[0]]), {c: x[row[some]] for c, x in every.items()}

        def opened() -> dict:
            return {k: begin(x, task) for k, x in read(pa.Table.from_batches(held).combine_chunks().to_batches()[0])} if held else {}

        def close() -> Iterator[pa.RecordBatch]:
            for state in (opened() if states is None else states).values():
                yield from end(state)

        for batch in batches:
            g, kind = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("group", "kind"))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if g[a] != group:
                    yield from close()
                    group, held, states = g[a], [], None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(rows)
                    continue
                states = opened() if states is None else states
                for i in range(0, rows.num_rows, ROWS):
                    for place, visitors in read(rows.slice(i, ROWS)):
                        if place in states:
                            yield from pass_by(states[place], visitors)
        yield from close()

    return dealt.mapInArrow(run, schema)
