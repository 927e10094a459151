"""Tables in blocks of rows, any two of which meet in one task: for work on all pairs of rows, where no block of either side is sent through the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .stages import Stages

#: Rows of a block at most and, where there are few blocks, at least; pairs that are looked at together where they are counted, and where the nearest are looked for; pairs of blocks of a task at most.
MOST, LEAST, PAIRS, STRIP, CELLS = 8192, 1024, 1 << 22, 1 << 19, 64
#: What a product in single precision may be wrong by, as a share of the vectors' lengths (for 64 components 4e-6), for each component.
SINGLE = 2e-7


def blocks(rows: DataFrame, n: int, stages: Stages) -> tuple[DataFrame, int]:
    """n rows as written rows (block, rows), each an Arrow table, and the number of blocks."""
    ship(rows.sparkSession)
    many = max(1, math.ceil(n / MOST), min(64, rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return stages.write(rows.repartition(many).mapInArrow(pack, "block int, rows binary"), "blocks"), many


def meet(left: DataFrame, lefts: int, right: DataFrame | None, rights: int, schema: str, pair: Callable, end: Callable | None = None, tasks: int = 0) -> DataFrame:
    """Rows of pair(table, table, whether it is one block with itself) for each block of left with each of right, or with `right` None for each two blocks of left once and each with itself.

    With `end`, a task's pairs go to pair(..., state) with one dictionary, and rows of end(state) follow; there are `tasks` of these at least.
    """
    spread = lambda b, n, at, name: b.repartitionByRange(n, "block").select(F.col("block").alias(at), F.col("rows").alias(name))
    half = right is None
    a, b = spread(left, lefts, "i", "left"), spread(left if half else right, lefts if half else rights, "j", "right")
    over = F.pmod(F.col("j") - F.col("i"), F.lit(lefts)) * 2  # each block meets as many others
    both = a.hint("shuffle_replicate_nl").join(b, (over < lefts) | ((over == lefts) & (F.col("i") < F.col("j"))) if half else F.lit(True))
    if end:
        cells = lefts * (lefts if half else rights)
        both = both.coalesce(min(cells, max(tasks, math.ceil(cells / CELLS))))
    elif half and lefts <= left.sparkSession.sparkContext.defaultParallelism:
        both = both.coalesce(lefts)  # as many pairs for each task; small ones cost less than a task does

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for batch in batches:
            for i, x, j, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("i", "left", "j", "right"))):
                one, two = (pa.ipc.open_stream(z.as_buffer()).read_all().combine_chunks() for z in (x, y))
                yield from pair(one, two, half and i == j, *([state] if end else []))
        if end:
            yield from end(state)

    return both.mapInArrow(run, schema)


def equal_keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal keys."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    x = np.repeat(np.arange(len(a)), high - low)
    return x, order[np.arange(len(x)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]


def least(d: np.ndarray, k: int, axis: int) -> np.ndarray:
    """For each row (axis 1) or column (axis 0) of d, k values that are there, among them the least one: the least of each of k or more groups, of which the k least are taken."""
    n = d.shape[axis]
    groups = min(n, max(4 * k, 32)) if k > 1 else 1
    starts = np.arange(groups) * n // groups
    low = d.min(axis, keepdims=True) if groups == 1 else np.stack([d[:, s:e].min(1) if axis else d[s:e].min(0) for s, e in zip(starts, [*starts[1:], n])], axis)
    return low if groups <= k else np.partition(low, k - 1, axis)[(slice(None), slice(k)) if axis else slice(k)]


def kept(who: np.ndarray, k: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(who, *columns), of each `who` the k least rows by the columns."""
    order = np.lexsort((*reversed(columns), who))
    who, columns = who[order], [c[order] for c in columns]
    start = np.flatnonzero(np.diff(who, prepend=-1))
    place = np.arange(len(who)) - np.repeat(start, np.diff([*start.tolist(), len(who)]))
    return (who[place < k], *(c[place < k] for c in columns))


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where a matrix holds; as np.nonzero() gives them, but several times as fast where there are few."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def in_parts(measure: Callable, x: np.ndarray, y: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """measure(x, y), of some places at a time."""
    return np.concatenate([np.zeros(0), *(measure(x[i : i + part], y[i : i + part]) for i in range(0, len(x), part))])
