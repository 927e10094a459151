"""Bounded samples of labelled documents for models that the driver fits, and the threshold that their scores are set by."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most, in the order of a hash of their identifiers.
SAMPLE_ROWS = 8_000


def fold(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the identifier as text leaves `part`, divided by `parts`; false for a null identifier."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, text) of at most `rows` labelled identifiers that aren't held out, one row each: the larger of its labels and the least of its documents' texts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def threshold(margin: np.ndarray, label: np.ndarray, measure: str) -> float:
    """The margin from which on predicting 1 has the best F1 or accuracy, half way between two of the given ones."""
    if len(margin) == 0 or label.min() == label.max():
        return 0.0
    order = np.argsort(-margin, kind="stable")
    m, y = margin[order], label[order]
    hits, called = np.cumsum(y), np.arange(1, len(y) + 1)
    value = 2 * hits / (called + y.sum()) if measure == "f1" else (2 * hits - called).astype(float)
    value[:-1][m[:-1] == m[1:]] = -np.inf  # equal margins are called together
    best = np.flatnonzero(value >= value.max() - 1e-12)
    at = best[len(best) // 2]
    return float((m[at] + (m[at + 1] if at + 1 < len(m) else m[at] - 1)) / 2)


#: Scores from this on are predicted 1.
CUT = 0.3


def score(margin: np.ndarray, cut: float) -> np.ndarray:
    """Margins as scores in 0..1, with the margin `cut` at CUT."""
    return 1 / (1 + np.exp(-np.clip(margin - cut + np.log(CUT / (1 - CUT)), -30, 30)))
