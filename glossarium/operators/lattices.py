"""Alignments over small lattices: letters with phones by expectation and maximisation (M5), decoded words with a text that interjections interrupt."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .stages import Stages

#: Symbols of a joint model that are broadcast at most. There are as many as pieces of the alphabets' letters and phones, whatever the number of words.
SYMBOLS = 1_000_000
#: What stands for nothing, between parts of a piece, and between both sides of a symbol.
SKIP, PART, SIDES = "_", "|", "}"


def rest_of_text(decoded: str, original: str, interjections: Sequence[str], cost: float = 4.0) -> Column:
    """The words of `original` behind those that `decoded` says, where one interjection may be put in before each word and behind the last.

    Both are columns of words. An interjection costs `cost`, a word of the text nothing; of the cheapest ways the one that takes most words counts. Null if
    `decoded` is no beginning of the text with such interjections. Costs are carried by the number of words taken, so the work is in proportion to the square of the decoded words.
    """
    none = F.lit(1e18)
    n = F.least(F.size(original), F.size(decoded))
    places = F.sequence(F.lit(0), n)
    said = F.array(*[F.lit(w) for w in interjections]) if interjections else F.array().cast("array<string>")

    def step(z: Column, word: Column) -> Column:
        taken = F.transform(places, lambda k: F.when((k > 0) & (F.get(original, k - 1) == word), F.least(F.get(z["word"], k - 1), F.get(z["put"], k - 1))).otherwise(none))
        put = F.transform(z["word"], lambda c: F.when(F.array_contains(said, word), c + cost).otherwise(none))
        return F.struct(taken.alias("word"), put.alias("put"))

    start = F.struct(F.transform(places, lambda k: F.when(k == 0, 0.0).otherwise(none)).alias("word"), F.transform(places, lambda k: none).alias("put"))
    costs = F.aggregate(decoded, start, step, lambda z: F.zip_with(z["word"], z["put"], lambda a, b: F.least(a, b)))
    best = F.array_min(F.zip_with(costs, places, lambda c, k: F.struct(c.alias("c"), (-k).alias("k"))))
    return F.when(best["c"] < 1e17, F.slice(original, 1 - best["k"], F.size(original) + best["k"]))


#: Places of a lattice, by kinds of pieces and pairs, that are held together.
TOGETHER = 1 << 21
#: Cost of what no symbol leads to, in units of 1e-9 of a logarithm.
NO_WAY = 1 << 61


def codes_of(lists: pa.Array, n: int) -> tuple[np.ndarray, list[str]]:
    """Lists of n strings each as rows of numbers, and the strings by number."""
    parts = lists.flatten().dictionary_encode()
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    return parts.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), n), parts.dictionary.to_pylist()


def spelled(codes: np.ndarray, parts: Sequence[str], n: int) -> tuple[np.ndarray, list[str]]:
    """Pieces of n parts from every place of the rows, as numbers (place, row), and the pieces by number."""
    if n == 0:
        return np.zeros((codes.shape[1] + 1, len(codes)), np.int64), [SKIP]
    width = max(codes.shape[1] + 1 - n, 0)
    at, names = codes[:, :width], list(parts)
    for k in range(1, n):
        found, at = np.unique(at * len(parts) + codes[:, k : k + width], return_inverse=True)
        at, names = at.reshape(len(codes), width), [names[x // len(parts)] + PART + parts[x % len(parts)] for x in found.tolist()]
    return at.T, names


class Lattice:
    """The lattices of pairs of as many letters and as many phones each, place by place for all pairs at once.

    A place (i, j) lies behind i letters and j phones; it has the number i * (phones + 1) + j. `symbols` has for each kind of piece (letters, phones), of whose sides one has a single
    part at most, the number of the symbol that begins at each place of each pair, and `none` where there is none.
    """

    def __init__(self, letters: pa.Array, phones: pa.Array, size: tuple[int, int], shape: tuple[int, int, bool], number: Callable[[str], int], none: int):
        self.size, self.end, self.none, self.pairs = size, (size[0] + 1) * (size[1] + 1) - 1, none, len(letters)
        self.symbols: dict[tuple[int, int], np.ndarray] = {}
        sides = [(codes_of(lists, n), most) for lists, n, most in zip((letters, phones), size, shape)]
        pieces = [[spelled(*coded, n) for n in range(most + 1)] for coded, most in sides]
        for a in range(0 if shape[2] else 1, shape[0] + 1):
            for b in range(0 if shape[2] else 1, shape[1] + 1):
                if (a or b) and min(a, b) <= 1 and not (a == 0 and b > 1) and not (b == 0 and a > 1) and a <= size[0] and b <= size[1]:
                    (left, names), (right, said) = pieces[0][a], pieces[1][b]
                    grid = np.full((size[0] + 1, size[1] + 1, len(letters)), none, np.int64)
                    grid[: len(left), : len(right)] = self._numbers(left[:, None] * len(said) + right[None], names, said, number)
                    self.symbols[a, b] = grid.reshape(self.end + 1, -1)

    @staticmethod
    def _numbers(keys: np.ndarray, names: Sequence[str], said: Sequence[str], number: Callable[[str], int]) -> np.ndarray:
        n = len(names) * len(said)
        if n > 4 * keys.size + 1024:
            some, at = np.unique(keys, return_inverse=True)
            return np.array([number(names[k // len(said)] + SIDES + said[k % len(said)]) for k in some.tolist()], np.int64)[at].reshape(keys.shape)
        used = np.zeros(n, bool)
        used[keys.ravel()] = True
        of, some = np.zeros(n, np.int64), np.flatnonzero(used)
        of[some] = [number(names[k // len(said)] + SIDES + said[k % len(said)]) for k in some.tolist()]
        return of[keys]

    def _steps(self) -> Iterator[tuple[tuple[int, int], slice, slice]]:
        """(kind, places, places that its pieces lead to), so that every place follows those before it: by letters and phones together."""
        for d in range(1, sum(self.size) + 1):
            for a, b in self.symbols:
                first, last = max(a, d - self.size[1]), min(self.size[0], d - b)
                if first <= last:
                    start, stop, back = first * self.size[1] + d, last * self.size[1] + d + 1, a * (self.size[1] + 1) + b
                    yield (a, b), slice(start - back, stop - back, max(self.size[1], 1)), slice(start, stop, max(self.size[1], 1))

    def expected(self, weights: np.ndarray, base: np.ndarray | float = 1.0) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """Likelihoods of the pairs, times base to the power of their letters and phones, and the expected counts of the symbols of each kind from each place, by sums over all ways
        forward and backward. With weights that are true or false: whether there is a way, and whether one takes that symbol."""
        w = {k: weights[s] if isinstance(base, float) else weights[s] * base ** sum(k) for k, s in self.symbols.items()}
        forward, backward = (np.zeros((self.end + 1, self.pairs), weights.dtype) for _ in range(2))
        forward[0] = backward[self.end] = 1
        steps = list(self._steps())
        for k, a, b in steps:
            forward[b] += forward[a] * w[k][a]
        for k, a, b in reversed(steps):
            backward[a] += backward[b] * w[k][a]
        total, counts = forward[self.end], {}
        share = total if weights.dtype == bool else np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
        grid = (self.size[0] + 1, self.size[1] + 1, self.pairs)
        for (a, b), x in w.items():
            counts[a, b] = np.zeros(grid, weights.dtype)
            some = (slice(0, grid[0] - a), slice(0, grid[1] - b))
            counts[a, b][some] = forward.reshape(grid)[some] * x.reshape(grid)[some] * (backward.reshape(grid)[a:, b:] * share)
        return total, {k: c.reshape(self.end + 1, -1) for k, c in counts.items()}

    def costs(self, costs: np.ndarray) -> np.ndarray:
        """The least sum of the symbols' costs from each place to the end; NO_WAY at least where there is no way."""
        rest = np.full((self.end + 1, self.pairs), NO_WAY)
        rest[self.end] = 0
        for k, a, b in reversed(list(self._steps())):
            rest[a] = np.minimum(rest[a], rest[b] + costs[self.symbols[k][a]])
        return rest

    def best(self, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, symbol) of the cheapest ways in their order, the first by the symbols' numbers of equally cheap ones, and the ways' costs."""
        rest, pair = self.costs(costs), np.arange(self.pairs)
        at, steps = np.where(rest[0] < NO_WAY, 0, self.end), []
        while (at < self.end).any():
            best, to, (i, j) = np.full(self.pairs, self.none), at.copy(), np.divmod(at, self.size[1] + 1)
            for (a, b), symbols in self.symbols.items():
                new = np.minimum(at + a * (self.size[1] + 1) + b, self.end)
                symbol = symbols[at, pair]
                good = (at < self.end) & (i + a <= self.size[0]) & (j + b <= self.size[1]) & (symbol < best) & (costs[symbol] + rest[new, pair] == rest[at, pair])
                best, to = np.where(good, symbol, best), np.where(good, new, to)
            steps.append(best)
            at = to
        steps = np.array(steps, np.int64).reshape(len(steps), self.pairs).T
        taken = steps != self.none
        return np.stack([np.nonzero(taken)[0], steps[taken]]), rest[0]


def nano(weights: np.ndarray) -> np.ndarray:
    """Costs of weights as whole numbers, so that sums don't depend on their order."""
    with np.errstate(divide="ignore"):
        return np.where(weights > 0, np.rint(-np.log(weights) * 1e9), NO_WAY).astype(np.int64)


def lattices(letters: pa.Array, phones: pa.Array, shape: tuple[int, int, bool], number: Callable[[str], int], none: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(rows, their lattice) of the pairs without a null side, those of one size together, up to TOGETHER places."""
    sizes = np.stack([pc.list_value_length(x).fill_null(-1).to_numpy(zero_copy_only=False) for x in (letters, phones)], axis=1).astype(np.int64)
    rows = np.flatnonzero((sizes >= 0).all(1))
    rows = rows[np.lexsort((sizes[rows, 1], sizes[rows, 0]))]
    for same in np.split(rows, np.flatnonzero((np.diff(sizes[rows], axis=0) != 0).any(1)) + 1):
        if len(same):
            size = (int(sizes[same[0], 0]), int(sizes[same[0], 1]))
            most = max(1, TOGETHER // ((size[0] + 1) * (size[1] + 1) * (shape[0] + shape[1] + 1)))
            for i in range(0, len(same), most):
                some = same[i : i + most]
                yield some, Lattice(letters.take(pa.array(some)), phones.take(pa.array(some)), size, shape, number, none)


def spread(df: DataFrame, letters: str, phones: str) -> DataFrame:
    """df over as many tasks as a shuffle has (what follows takes time for each row, however few bytes rows have): pairs of one size together, yet in up to a quarter of the tasks."""
    n, sizes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), (F.size(letters), F.size(phones))
    return df.repartition(n, *sizes, F.pmod(F.xxhash64(letters, phones), F.lit(max(1, n // 4)))).sortWithinPartitions(*sizes)


class JointModel:
    """Weights of symbols (pieces of letters with pieces of phones) that make pairs (letters, phones, n) likely; n is how often a pair counts.

    Every symbol on some pair's way begins with the same weight. A round takes the sum of the symbols' expected counts over all pairs, as a share of all. Rounds end
    when the log-likelihood rises by less than `gain` a pair, or after `rounds`. Pairs with a null side, or without a way, count for nothing.
    """

    def __init__(self, pairs: DataFrame, letters: str, phones: str, count: str | None = None, most_letters: int = 2, most_phones: int = 2, skips: bool = True, rounds: int = 20, gain: float = 1e-4):
        ship(pairs.sparkSession)
        self.shape = (most_letters, most_phones, skips)
        rows = pairs.select(F.col(letters).alias("letters"), F.col(phones).alias("phones"), (F.col(count) if count else F.lit(1)).cast("double").alias("n")).filter("letters IS NOT NULL AND phones IS NOT NULL")
        self.pairs = Stages(pairs.sparkSession).write(spread(rows, "letters", "phones"), "lattice-pairs")  # read again in each round
        self.weights, self.likelihoods = None, []
        for _ in range(rounds + 1):  # the first one finds the symbols
            rows = self._round().collect()
            if len(rows) > SYMBOLS:
                raise ValueError(f"more than {SYMBOLS} symbols")
            found = {r.symbol: r.n for r in rows if r.symbol}
            total = math.fsum(found.values())
            if self.weights is not None:
                self.likelihoods.append(next((r.n for r in rows if not r.symbol), 0.0))
            self.weights = {s: (n / total if self.weights is not None else 1 / len(found)) for s, n in found.items() if n > 1e-12 * total}
            if len(self.likelihoods) > 1 and self.likelihoods[-1] - self.likelihoods[-2] < gain * max(1.0, self.n_pairs):
                break

    def _round(self) -> DataFrame:
        """(symbol, n): expected counts; the empty symbol has the log-likelihood. Without weights yet, every symbol counts for one."""
        if self.weights is None:
            self.n_pairs = self.pairs.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
        shape, weights = self.shape, self.pairs.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = weights.value
            number = {s: i for i, s in enumerate(known or ())}
            w, total, log = np.array([*(known or {}).values(), 0.0]), np.zeros(len(number) + 1), 0.0
            costs, found = nano(w), set()
            for batch in batches:
                letters, phones, n = batch.columns
                if known is None:
                    names = {"": 0}
                    for _, x in lattices(letters, phones, shape, lambda s: names.setdefault(s, len(names)), 0):
                        on_a_way = np.zeros(len(names), bool)
                        for k, taken in x.expected(np.arange(len(names)) > 0)[1].items():
                            on_a_way[x.symbols[k][taken]] = True
                        every = list(names)
                        found.update(every[i] for i in np.flatnonzero(on_a_way).tolist())
                    continue
                for rows, x in lattices(letters, phones, shape, lambda s: number.get(s, len(number)), len(number)):
                    base, length = np.ones(len(rows)), sum(x.size)
                    likelihood, counts = x.expected(w)
                    if not (likelihood > 1e-250).all():  # long pairs leave the range of numbers: a base by their best ways brings them back
                        least = x.costs(costs)[0]
                        base = np.where((likelihood <= 1e-250) & (least < NO_WAY), np.exp(least / 1e9 / max(length, 1)), 1.0)
                        likelihood, counts = x.expected(w, base)
                    some = likelihood > 0
                    times = np.where(some, n.to_numpy(zero_copy_only=False)[rows], 0.0)
                    log += float((times[some] * (np.log(likelihood[some]) - length * np.log(base[some]))).sum())
                    for k, c in counts.items():
                        total += np.bincount(x.symbols[k].ravel(), (c * times).ravel(), len(total))
            if known is None:
                symbols, sums = sorted(found), np.ones(len(found))
            else:
                every, some = list(known), np.flatnonzero(total[:-1])
                symbols, sums = ["", *[every[i] for i in some.tolist()]], np.array([log, *total[some]])
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.string()), pa.array(sums, pa.float64())], ["symbol", "n"])

        return self.pairs.mapInArrow(run, "symbol string, n double").groupBy("symbol").agg(F.sum("n").alias("n"))

    def aligned(self, df: DataFrame, letters: str, phones: str) -> DataFrame:
        """df with `alignment`, the symbols of the likeliest way, and `likelihood`; null and 0 where there is none."""
        shape, weights = self.shape, df.sparkSession.sparkContext.broadcast(self.weights)
        at = [df.columns.index(c) for c in (letters, phones)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbols = sorted(weights.value)
            number, names = {s: i for i, s in enumerate(symbols)}, pa.array(symbols, pa.string())
            costs = nano(np.array([*[weights.value[s] for s in symbols], 0.0]))
            for batch in batches:
                way, likelihood = [pa.array([], pa.string())], np.zeros(batch.num_rows)
                order, there = [np.zeros(0, np.int64)], np.zeros(batch.num_rows, bool)
                for rows, x in lattices(*(batch.column(i) for i in at), shape, lambda s: number.get(s, len(number)), len(number)):
                    (pair, symbol), cost = x.best(costs)
                    ends = np.cumsum(np.bincount(pair, minlength=len(rows)))
                    lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), names.take(pa.array(symbol)))
                    way.append(pc.binary_join(lists, " "))
                    order.append(rows)
                    there[rows], likelihood[rows] = cost < NO_WAY, np.where(cost < NO_WAY, np.exp(-np.minimum(cost, NO_WAY) / 1e9), 0.0)
                place = np.full(batch.num_rows, -1)
                place[np.concatenate(order)] = np.arange(sum(map(len, order)))
                found = pa.concat_arrays(way).take(pa.array(place, mask=~there))
                yield pa.RecordBatch.from_arrays([*batch.columns, found, pa.array(likelihood)], [*batch.schema.names, "alignment", "likelihood"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return spread(df, letters, phones).mapInArrow(run, f"{kinds}, alignment string, likelihood double")


#: What an edit costs beside the microseconds of a word that is put in, so that of the alignments with fewest edits one with the least extra time counts.
EDIT = 1 << 40


def word_edits(reference: Sequence[str], words: Sequence[str], micros: Sequence[int]) -> tuple[int, int]:
    """Fewest edits from reference to words, and of such alignments the least time of words that are put in. Row by row, in memory of one side."""
    number: dict[str, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    put = np.concatenate([[0], np.cumsum(EDIT + np.asarray(micros, np.int64))])
    row = put.copy()
    for r in reference:
        new = row + EDIT
        new[1:] = np.minimum(new[1:], row[:-1] + np.where(w == number.get(r, -1), 0, EDIT))
        row = put + np.minimum.accumulate(new - put)
    return int(row[-1]) >> 40, int(row[-1]) & (EDIT - 1)


def transcript_errors(df: DataFrame, reference: str, words: str, keep: Sequence[str], silence: Sequence[str] = ("", "sil", "sp", "<eps>"), shortest: float = 0.03) -> DataFrame:
    """(keep, n_words, edits, word_error, extra_duration, transcript) of utterances from their aligned words.

    reference: an array of words; words: an array of (label, begin, stop). Silence and words up to `shortest` seconds don't count. The word error is edits by words
    of the reference, and extra duration the seconds of words that are put in; null without words in the reference. Utterances without aligned words, or with a null side, are left out.
    """
    ship(df.sparkSession)
    lasting = F.filter(words, lambda w: ~w["label"].isin(list(silence)) & (F.round(w["stop"] - w["begin"], 6) > shortest))
    rows = df.select(*keep, F.col(reference).alias("_r"), F.array_sort(F.transform(lasting, lambda w: F.struct(w["begin"].alias("begin"), w["stop"].alias("stop"), w["label"].alias("label")))).alias("_w")).filter("_r IS NOT NULL AND size(_w) > 0")
    rows = rows.select(*keep, "_r", F.col("_w.label").alias("_l"), F.transform("_w", lambda w: F.round((w["stop"] - w["begin"]) * 1e6).cast("long")).alias("_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, l, m = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_r", "_l", "_m"))
            found = [word_edits(*x) for x in zip(r, l, m)]
            own = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(map(len, r), pa.int64()), pa.array([e for e, _ in found], pa.int64()), pa.array([t / 1e6 for _, t in found], pa.float64()), pa.array([" ".join(x) for x in l], pa.string())], [*keep, "n_words", "edits", "extra_duration", "transcript"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    out = rows.mapInArrow(run, f"{kinds}, n_words long, edits long, extra_duration double, transcript string")
    return out.select(*keep, "n_words", "edits", F.try_divide("edits", "n_words").alias("word_error"), "extra_duration", "transcript")
