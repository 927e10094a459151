"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text (lengths, shares of kinds of characters, repetition) is cut into bins. Cyclic boosting visits
the features in turn and adds a shallow tree over the bins of one feature at a small rate; the trees of a feature sum up
to one lookup table. Then pairs of features that explain most of what is left get tables of their own. A score is a sum of looked-up
numbers, so each feature's part in it can be read off.

Defined cases: a null text is empty, and an empty text is scored like any other (all its features are 0); very long texts are read whole; without
labels of both kinds every score is 0.5; repeated rows are scored each; a null identifier is scored and in no fold; an empty table gives an empty result;
other columns are ignored. Of a labelled identifier that several documents have, the least text is learnt from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied
from .labelled import CUT, SAMPLE_ROWS, fold, labelled_sample, score, threshold

FEATURES = (
    "characters", "words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols", "exclamations", "blank", "beyond_ascii",
    "distinct_words", "commonest_word", "short_words", "lines", "repeated_lines", "line_length", "sentence_length", "deflated", "symbol_ends",
)
BINS, COARSE, PAIRS = 32, 8, 6


def _kinds() -> np.ndarray:
    k = np.zeros((256, 7))
    for c in range(256):
        ch = chr(c)
        k[c] = (65 <= c <= 90, ch.isdigit() and c < 128, ch in ".,;:'\"()-?!", ch in "#$%&*|<>=+@^~_\\/{}[]`", ch == "!", ch in " \t\r\n", c >= 128)
    return k


KINDS = _kinds()
SYMBOLS = tuple("#$%&*!|")


def features(text: str) -> np.ndarray:
    """FEATURES of a whole text."""
    out = np.zeros(len(FEATURES))
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ KINDS / len(data)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    out[:4] = np.log1p(len(text)), np.log1p(n), sizes.mean(), sizes.std()
    out[4:11] = counts
    out[11:14] = len(seen) / n, max(seen.values()) / n, (sizes <= 3).mean()
    out[14:17] = np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines)))
    out[17] = np.log1p(n / (1 + text.count(".")))
    out[18] = len(zlib.compress(data, 1)) / len(data)
    out[19] = sum(c for w, c in seen.items() if w.endswith(SYMBOLS)) / n
    return out


@dataclass
class AdditiveModel:
    """margin = constant + sum of tables[j][bin_j] + sum of pairs[(i, j)][coarse_i, coarse_j]."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    constant: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), BINS)))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    cut: float = 0.0

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        out = self.constant + self.tables[np.arange(len(self.edges)), fine].sum(1)
        for (i, j), t in self.pairs.items():
            out = out + t[coarse[:, i], coarse[:, j]]
        return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, ridge: float = 2.0) -> np.ndarray:
    """Steps over a row of bins by the tree that splits where the gain is best; a leaf's step is -G / (H + ridge)."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if depth and b - a > 1:
            left, right = cg[:-1] ** 2 / (ch[:-1] + ridge), (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
            gain = left + right - cg[-1] ** 2 / (ch[-1] + ridge)
            at = int(np.argmax(gain))
            if gain[at] > 1e-6:
                grow(a, a + at + 1, depth - 1)
                grow(a + at + 1, b, depth - 1)
                return
        out[a:b] = -cg[-1] / (ch[-1] + ridge)

    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """The best gain of one cut on each axis of a table, and the steps of its four parts."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    part = lambda t: (t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1])
    gain = sum(a**2 / (np.maximum(b, 0) + ridge) for a, b in zip(part(G), part(H))) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g, float)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            out[a, b] = -g[a, b].sum() / (h[a, b].sum() + ridge)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1) -> AdditiveModel:
    cuts = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) for j in range(x.shape[1])]
    model = AdditiveModel(cuts(BINS), cuts(COARSE))
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.constant = float(np.log(share / (1 - share)))
    margin = np.full(len(y), model.constant)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(x.shape[1]):
            g, h = slopes()
            step = rate * _tree(np.bincount(fine[:, j], g, BINS), np.bincount(fine[:, j], h, BINS))
            model.tables[j] += step
            margin += step[fine[:, j]]
    g, h = slopes()
    cell = lambda i, j: coarse[:, i] * COARSE + coarse[:, j]
    square = lambda c, v: np.bincount(c, v, COARSE * COARSE).reshape(COARSE, COARSE)
    gains = [(_quadrants(square(c := cell(i, j), g), square(c, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)]
    model.pairs = {(i, j): np.zeros((COARSE, COARSE)) for _, i, j in sorted(gains, reverse=True)[:PAIRS]}
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(square(c := cell(i, j), g), square(c, h))[1]
            t += step
            margin += step[coarse[:, i], coarse[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits on labelled rows outside fold 0 of 5; a fifth of them set the threshold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [features(t or "").tolist() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", 5, 0), rows).mapInArrow(tidied(run), "label int, x array<double>").collect()  # `rows` at most
    sample.sort(key=lambda r: (zlib.crc32(repr(r.x).encode()), r.x, r.label))  # the same order in every run
    x, y = np.array([r.x for r in sample]).reshape(-1, len(FEATURES)), np.array([r.label for r in sample], float)
    if not len(y) or y.min() == y.max():
        none = [np.zeros(0)] * len(FEATURES)
        return AdditiveModel(none, none, cut=float(np.log(CUT / (1 - CUT))))
    test = np.array([zlib.crc32(repr(r.x).encode()) % 5 == 0 for r in sample])  # equal texts stay together
    cut = threshold(fit(x[~test], y[~test]).margin(x[test]), y[test], "accuracy") if test.any() and 0 < y[~test].mean() < 1 else 0.0
    model = fit(x, y)
    model.cut = cut
    return model


def with_scores(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) of whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = spark.sparkContext.broadcast(model)  # some tables of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for part in parts:
            x = np.array([features(t or "") for t in part.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(m.margin(x), m.cut), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
