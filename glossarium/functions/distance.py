"""Edit distances, error rates, rewriting rules, interpolation and resampling."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship

CODED = StructType([StructField(n, StringType()) for n in ("words_a", "words_b", "letters_a", "letters_b")])


def edit_distance(a: Sequence, b: Sequence, mode: str = "standard") -> int:
    """Unit costs. Mode "compat" has all cells of the first row and column 1 (0 for two empty sides) and counts modulo 256."""
    if mode == "standard":
        if len(a) < len(b):
            a, b = b, a
        number: dict = {}
        x, y = ([number.setdefault(v, len(number)) for v in s] for s in (a, b))
        y, place = np.array(y, np.int64), np.arange(len(y) + 1)
        row = place.copy()
        for i, u in enumerate(x, 1):
            new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != u))])
            row = np.minimum.accumulate(new - place) + place  # insertions: each costs one more than the cell before
        return int(row[-1])
    t = np.zeros((len(a) + 1, len(b) + 1), np.uint8)
    t[1:, 0], t[0, 1:] = 1, 1
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = min(int(t[i - 1, j]) + 1, int(t[i, j - 1]) + 1, int(t[i - 1, j - 1]) + (x != y)) & 0xFF
    return int(t[-1, -1])


def errors(gold: Sequence[str], hypothesis: Sequence[str], mode: str = "standard", drop_brackets: bool = True) -> tuple[int, int, int, int]:
    """Edits and length in words, and in characters (F21); bracketed words don't count if so wished."""
    if drop_brackets:
        gold, hypothesis = ([w for w in s if w[:1] not in ("[", "<", "{")] for s in (gold, hypothesis))
    g, h = "".join(gold), "".join(hypothesis)
    return edit_distance(gold, hypothesis, mode), len(gold), edit_distance(g, h, mode), len(g)


@F.pandas_udf(CODED)
def _coded(gold: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """The words of both sides, one character of the private planes for each distinct word (131 072 at most), and their letters; bracketed words apart."""
    rows = []
    for g, h in zip(gold, hypothesis):
        g, h = ([w for w in (s or "").split() if w[:1] not in ("[", "<", "{")] for s in (g, h))
        number: dict = {}
        a, b = ("".join(chr(0xF0000 + number.setdefault(w, len(number))) for w in s) for s in (g, h))
        rows.append((a, b, "".join(g), "".join(h)))
    return pd.DataFrame(rows, columns=CODED.names)


def counted_errors(df: DataFrame, gold: str, hypothesis: str, keep: Sequence[str] = ()) -> DataFrame:
    """errors() for two texts of each row (F21): words are recoded in Arrow batches, the distances are the engine's own."""
    ship(df.sparkSession)
    c = df.select(*keep, _coded(gold, hypothesis).alias("c")).select(*keep, "c.*")
    edits = lambda a, b: F.levenshtein(a, b).cast("long")
    return c.select(
        *keep, edits("words_a", "words_b").alias("word_edits"), F.length("words_a").cast("long").alias("word_length"), edits("letters_a", "letters_b").alias("char_edits"), F.length("letters_a").cast("long").alias("char_length")
    )


def label_error(golds: Sequence[Sequence[str]], hypotheses: Sequence[Sequence[str]], mode: str = "standard") -> tuple[int, int]:
    """Least edits over all pairs of alternatives, and that gold's length in tokens."""
    return min((edit_distance(g, h, mode), len(g)) for g in golds for h in hypotheses)


def least_errors(df: DataFrame, golds: str, hypothesis: str, key: str) -> DataFrame:
    """(key, edits, length): label_error() of rows (key, golds, hypothesis), where golds is an array of alternative texts (F22). Keys are distinct; the shorter gold of equal ones counts."""
    rows = df.select(key, F.explode(golds).alias("_gold"), F.col(hypothesis).alias("_said"))
    found = counted_errors(rows, "_gold", "_said", [key])
    return found.groupBy(key).agg(F.min(F.struct("word_edits", "word_length")).alias("e")).select(key, F.col("e.word_edits").alias("edits"), F.col("e.word_length").alias("length"))


def _rule(segment: str, preceding: str, following: str) -> str:
    """A pattern with what stands before a segment, the segment, and what stands behind it as groups."""

    def side(context: str, before: bool) -> str:
        initial, final = context.startswith("^"), context.endswith("$")
        inner = context.strip("^$").strip()
        body = r"\s+".join(re.escape(p) if re.fullmatch(r"\w+", p) else p for p in inner.split())
        if before:
            return ("(^" if initial else r"((?:^|(?<=\s))") + (body + r"\s+" if body else "") + ")"
        return "(" + (r"\s+" + body if body else "") + ("$" if final else r"(?=\s|$)") + ")"

    return side(preceding, True) + "(" + r"\s+".join(segment.split()) + ")" + side(following, False)


def rewriter(segment: str, preceding: str, following: str, replacement: str) -> Callable[[str], str]:
    """A phonological rule over blank-separated phones: the segment in its context is replaced; ^ and $ stand for the word's edges. Contexts have no groups of their own."""
    pattern = re.compile(_rule(segment, preceding, following))

    def apply(pronunciation: str) -> str:
        return " ".join(pattern.sub(lambda m: f"{m[1]}{replacement}{m[3]}", pronunciation).split())

    return apply


def rewritten(pronunciation: Column, segment: str, preceding: str, following: str, replacement: str) -> Column:
    """rewriter() of a column."""
    plain = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.trim(F.regexp_replace(F.regexp_replace(pronunciation, _rule(segment, preceding, following), f"$1{plain}$3"), r"\s+", " "))


def pchip(x: Sequence[float], y: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """Monotone cubic interpolation by Fritsch and Carlson's slopes."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    if len(x) == 1:
        return np.full(len(at), y[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        inner = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(inner, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
        for end, a, b, ha, hb in ((0, d[0], d[1], h[0], h[1]), (-1, d[-1], d[-2], h[-1], h[-2])):
            s = ((2 * ha + hb) * a - ha * b) / (ha + hb)
            m[end] = 0 if s * a <= 0 else 3 * a if a * b <= 0 and abs(s) > 3 * abs(a) else s
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k] + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1]


def warp_path(source: Sequence[float], target: Sequence[float], frames: int) -> np.ndarray:
    """Source places of the target's frames through anchors, within the source's range."""
    path = pchip(target, source, np.arange(frames, dtype=float))
    return np.clip(path, min(source), max(source))


def resample(values: np.ndarray, path: np.ndarray, silent: np.ndarray | None = None, fill: float = 0.0) -> np.ndarray:
    """Frames of values [time, channel] at fractional places, linearly; silent frames get the fill."""
    place = np.clip(path, 0, len(values) - 1)
    low = np.floor(place).astype(int)
    high = np.minimum(low + 1, len(values) - 1)
    part = (place - low)[:, None]
    out = values[low] * (1 - part) + values[high] * part
    if silent is not None:
        out[silent] = fill
    return out
