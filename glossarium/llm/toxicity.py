"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and their first four and five letters, in lower case and hashed to a fixed number of slots; a
slot counts once however often it occurs, and a slot of its own says that several chunks of the text have the term (as with words made from
one stem). The machine has a weight and a short vector for each slot, so that two terms together may count for more (or less) than each alone. It is
fitted by AdaGrad on a bounded sample of labelled documents on the driver; slots get weights if their presence goes with the label beyond chance (a
likelihood-ratio test over distinct texts of the sample), or if that of a pair does so beyond both of its slots, as for two words that are harmless
one by one; so the many words of a long text don't drown the few that matter. All pairs are looked at of slots that leave the label open: what is left to be told of
their texts' labels must be more than what a pair has to tell. A pair counts if the label 1 is more frequent with both than with either, and if each
slot tells among the texts that have the other; so words that merely go together, as those of a language or of long texts do, aren't pairs. Scoring reads whole texts.

Defined cases: a null or empty text has the machine's constant as its score; very long texts are read whole; without labels of both kinds every score is
that of the constant 0 and nothing is predicted toxic, and neither is a text without any term that got a weight; repeated rows are scored each; a null identifier is scored and in no fold; an empty table gives
an empty result; other columns are ignored or, in `clean_rows`, passed through. Of a labelled identifier that several documents have, the least text
is learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, table, tidied
from .labelled import CUT, SAMPLE_ROWS, fold, labelled_sample, score, threshold

SLOTS = 1 << 18
VECTOR = 4
#: A slot's likelihood ratio in the sample from which on it gets a weight; what a pair's must have beyond those of its slots.
EVIDENCE, PAIR_EVIDENCE = 16.0, 40.0
#: How many times as often as with either slot the label 1 goes with both, and slots whose pairs are counted together.
BEYOND, TILE = 1.5, 1024
#: A pair counts if it tells this share of what the best pair of either slot does.
NEAREST = 0.95
#: Leads from a term's slot to that of the term in several chunks.
SEVERAL = 5_003
WORD = re.compile(r"[^\W_]+")


def terms_of(chunk: str) -> list[int]:
    """Slots of the words of a chunk of lower-case text."""
    out = []
    for w in WORD.findall(chunk):
        for term in {w, "4 " + w[:4], "5 " + w[:5]}:
            out.append(zlib.crc32(term.encode("utf-8", "surrogatepass")) % SLOTS)
    return out


def several(slots: np.ndarray) -> np.ndarray:
    """Slots that say that several chunks of a text have the term."""
    return ((slots.astype(np.int64) * SEVERAL + 1) % SLOTS).astype(np.int32)


class Terms:
    """Slots of texts; those of a chunk between blanks are kept while there is room."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.slots = keep, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Distinct slots of each text."""
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        numbered = lists.flatten().dictionary_encode()
        if len(self.slots) > self.keep:
            self.slots = {}
        known, parts = self.slots, []
        for chunk in numbered.dictionary.to_pylist():
            if (ids := known.get(chunk)) is None:
                ids = np.array(terms_of(chunk), np.int32)
                if len(chunk) < 64:
                    known[chunk] = ids
            parts.append(ids)
        sizes = np.array([len(p) for p in parts], np.int64)
        flat, starts = np.concatenate([*parts, np.zeros(0, np.int32)]), np.cumsum(sizes) - sizes
        codes, ends = numbered.indices.to_numpy(), lists.offsets.to_numpy()
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            mine = np.unique(codes[a:b])
            n = sizes[mine]
            at = np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            slots, times = np.unique(flat[at], return_counts=True)
            out.append(np.union1d(slots, several(slots[times > 1])))
        return out


@dataclass
class Machine:
    """margin(x) = constant + sum of weights + sum over pairs of the products of their vectors."""

    constant: float
    weights: np.ndarray
    vectors: np.ndarray
    cut: float = 0.0

    def margin(self, slots: np.ndarray) -> float:
        v = self.vectors[slots]
        total = v.sum(0)
        return self.constant + float(self.weights[slots].sum()) + 0.5 * float(total @ total - (v * v).sum())


def ratio(cells: list[list[np.ndarray]], n: list[int]) -> np.ndarray:
    """The G statistic of tables of two labels: cells[i][k] counts label k in cell i; n[k] of all texts have label k."""
    total, g = sum(n), 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for cell in cells:
            most = cell[0] + cell[1]
            for k in (0, 1):
                g = g + 2 * np.where(cell[k] > 0, cell[k] * np.log(cell[k] * (total / n[k]) / most), 0)
    return g


def left(cell: list[np.ndarray]) -> np.ndarray:
    """What is left to be told of the labels of texts of which cell[k] have label k, on the scale of ratio()."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return sum(2 * np.where(c > 0, c * np.log((cell[0] + cell[1]) / c), 0) for c in cell)


def distinct(rows: list[np.ndarray], least: float = 0.5, bands: int = 24, width: int = 4) -> list[int]:
    """Places of texts that aren't near copies of one before them: a text and its copies are one piece of evidence, whatever their number."""
    seen: list[dict[bytes, int]] = [{} for _ in range(bands)]
    factor = (np.random.default_rng(3).integers(1 << 62, size=bands * width, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    kept = []
    for i, r in enumerate(rows):
        if not len(r):
            keys = [b""] * bands
        else:
            with np.errstate(over="ignore"):
                low = np.concatenate([(factor[:, None] * (r[k : k + 4096].astype(np.uint64) + np.uint64(1))[None, :]).min(1)[:, None] for k in range(0, len(r), 4096)], 1).min(1)
            keys = [x.tobytes() for x in low.reshape(bands, width)]
        others = {band[key] for band, key in zip(seen, keys) if key in band}
        if not any((shared := len(np.intersect1d(r, rows[j], assume_unique=True))) >= least * (len(r) + len(rows[j]) - shared) for j in others):
            kept.append(i)
            for band, key in zip(seen, keys):
                band.setdefault(key, i)
    return kept


def telling(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose presence in distinct texts goes with the label, alone or in a pair, and those of them that do so in a pair."""
    kept = distinct(rows)
    rows, label = [rows[i] for i in kept], label[kept]
    there = [np.zeros(SLOTS), np.zeros(SLOTS)]
    for r, y in zip(rows, label):
        there[int(y)][r] += 1  # a text's slots are distinct
    n = [int((label == k).sum()) for k in (0, 1)]
    df = there[0] + there[1]
    g = ratio([there, [n[k] - there[k] for k in (0, 1)]], n)
    alone = np.flatnonzero((g > EVIDENCE) & (df > 3))
    open_ = left(there)
    often = np.flatnonzero((df > 3) & (open_ > PAIR_EVIDENCE))
    place = np.full(SLOTS, -1, np.int32)
    place[often] = np.arange(len(often))
    bits = []
    for k in (0, 1):
        has = np.zeros((len(often), n[k]), bool)  # which texts have a slot
        for i, r in enumerate(r for r, y in zip(rows, label) if y == k):
            at = place[r]
            has[at[at >= 0], i] = True
        bits.append(np.packbits(has, axis=1))
    tile = lambda k, at: np.unpackbits(bits[k][at : at + TILE], axis=1, count=n[k]).astype(np.float32)
    each, share, good = [t[often] for t in there], there[1][often] / df[often], np.zeros(len(often), bool)
    pairs, best = [], np.zeros(len(often))
    for i in range(0, len(often), TILE):
        mine = [tile(k, i) for k in (0, 1)]
        for j in range(i, len(often), TILE):
            both = [m @ (mine[k] if i == j else tile(k, j)).T for k, m in enumerate(mine)]
            one, two = share[i : i + TILE, None], share[None, j : j + TILE]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = both[1] / (both[0] + both[1])
            x, y = np.nonzero((both[1] > 3) & (p > BEYOND * np.maximum(one, two)))
            a, b, cell = x + i, y + j, [c[x, y].astype(float) for c in both]
            only = [[e[at] - c for e, c in zip(each, cell)] for at in (a, b)]
            gain = ratio([cell, *only, [n[k] - each[k][a] - each[k][b] + cell[k] for k in (0, 1)]], n) - g[often][a] - g[often][b]
            within = np.minimum(*(open_[often][at] - left(cell) - left(rest) for at, rest in zip((a, b), only)))
            found = (gain > PAIR_EVIDENCE) & (within > EVIDENCE) & (a != b)
            pairs.append((a[found], b[found], gain[found]))
            for at in pairs[-1][:2]:
                np.maximum.at(best, at, pairs[-1][2])
    for a, b, gain in pairs:  # of all pairs of a slot those that tell most; a common word goes along with many
        most = gain >= NEAREST * np.maximum(best[a], best[b])
        good[a[most]] = good[b[most]] = True
    paired = often[good]
    return np.union1d(alone, paired), paired


def fit(rows: list[np.ndarray], label: np.ndarray, epochs: int = 8, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Machine:
    """A machine by AdaGrad over mini-batches; the rarer label weighs up to four times as much."""
    rng = np.random.default_rng(seed)
    used, paired = telling(rows, label)
    place = np.full(SLOTS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    w, v = np.zeros(len(used), np.float32), rng.normal(0, 0.01, (len(used), VECTOR)).astype(np.float32)
    v[place[paired]] *= 30  # where products matter most they need a slope to start from
    gw, gv = np.full(len(used), 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32)
    share = label.mean()
    constant, weight = float(np.log(share / (1 - share))), np.where(label > 0, min(4.0, (1 - share) / share), 1.0).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 128):
            some = order[i : i + 128]
            ids, sizes = np.concatenate([rows[k] for k in some]), np.array([len(rows[k]) for k in some])
            if not len(ids):
                continue
            doc = np.repeat(np.arange(len(some)), sizes)
            vs = v[ids]
            sums = np.stack([np.bincount(doc, vs[:, f], len(some)) for f in range(VECTOR)], 1).astype(np.float32)
            margin = constant + np.bincount(doc, w[ids], len(some)) + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (vs**2).sum(1), len(some)))
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[some]) * weight[some]).astype(np.float32)
            constant -= 0.02 * float(slope.mean())
            touched, inverse = np.unique(ids, return_inverse=True)
            g = np.bincount(inverse, slope[doc], len(touched)).astype(np.float32) + decay * w[touched]
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            each = slope[doc][:, None] * (sums[doc] - vs)
            g = np.stack([np.bincount(inverse, each[:, f], len(touched)) for f in range(VECTOR)], 1).astype(np.float32) + decay * 10 * v[touched]
            gv[touched] += g * g
            v[touched] -= 0.3 * rate * g / np.sqrt(gv[touched])
    weights, vectors = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, VECTOR), np.float32)
    weights[used], vectors[used] = w, v
    return Machine(constant, weights, vectors)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on labelled rows outside fold 2 of 4; a fifth of them set the threshold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for part in parts:
            slots = terms.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.astype("<i4").tobytes() for s in slots], pa.binary())], ["label", "slots"])

    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", fold("doc_id", 4, 2), rows).mapInArrow(tidied(run), "label int, slots binary").toArrow()  # `rows` at most
    slots, label = [np.frombuffer(x.as_buffer(), "<i4") for x in sample.column("slots")], sample.column("label").to_numpy().astype(np.float32)
    order = sorted(range(len(slots)), key=lambda i: (zlib.crc32(slots[i]), len(slots[i]), slots[i].tobytes()[:64], label[i]))  # the same in every run
    slots, label = [slots[i] for i in order], label[order]
    if not len(label) or label.min() == label.max():
        return Machine(0.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, VECTOR), np.float32), 1.0)
    test = np.array([zlib.crc32(s.tobytes()) % 5 == 0 for s in slots])  # equal texts stay together
    if test.any() and 0 < label[~test].mean() < 1:
        trial = fit([s for s, t in zip(slots, test) if not t], label[~test])
        cut = threshold(np.array([trial.margin(s) for s, t in zip(slots, test) if t]), label[test], "f1")
    else:
        cut = 0.0
    machine = fit(slots, label)
    machine.cut = max(cut, machine.constant + 0.1)  # a text without any telling term isn't called toxic, however few labels there are
    return machine


def with_scores(docs: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """docs and their scores, with whole texts read."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = spark.sparkContext.broadcast(machine)  # SLOTS * (VECTOR + 1) numbers, whatever the input
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, m = Terms(), kept.value
        for part in parts:
            margins = np.array([m.margin(s) for s in terms.encode([t or "" for t in part.column(at).to_pylist()])], float)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(margins, m.cut), pa.float64())], [*part.schema.names, column])

    return docs.mapInArrow(tidied(run), schema)


def clean_rows(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns."""
    column = free_name(docs, "toxicity")
    return with_scores(docs, machine, column).filter(F.col(column) < CUT).drop(column)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
