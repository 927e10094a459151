"""Benchmark decontamination by template windows and slot consistency.

Benchmark items and documents are turned into templates: numbers, names (capitalised words that begin no sentence) and units
become typed placeholders, all other words are lowered. Windows of five template words are hashed; the items' windows form
a hash table, and documents probe it with every window they have: a hash join whose smaller side is broadcast. Windows that a document shares
with an item at one distance form an alignment, and its slots are compared: each of the item's values must stand for one value of the
document throughout, and different values for different ones, as in a question asked again with other numbers. An item leaks if an alignment holds at least half of its distinct
windows (or a run of RUN of them) with consistent slots, or if several do together: those near each other, where words were put in or left out, or
all of the document. Among several, those that contradict themselves don't count.

The table is broadcast up to BLOCK windows; a larger benchmark is read in blocks of items, each against all documents.
Nothing about documents is gathered: they are only scanned.

Defined cases: a null or empty text or item matches nothing; an item shorter than a window is one window of its own width, which only a text of as many
template words has; windows with fewer than three distinct lowered words don't count, so an item made of placeholders alone is not looked for; equal
items are all reported, and so are items with equal or null identifiers; rows of documents with equal or null identifiers are reported each; very long
texts are read whole; an empty table on either side gives an empty result; other columns are ignored or, in `clean_rows`, passed through.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, mix64, small_batches, table, tidied, word_hash, written
from .tokens import LETTERS, MARKS_BEHIND, Table

WIDTH = 5
#: Least share of an item's distinct windows, or least run of its windows, and least share of consistent slots.
SHARE, RUN, CONSISTENT = 0.5, 20, 0.75
#: Windows of the items of one block: 16 bytes each in the broadcast table, beside the items' words.
BLOCK = 2_000_000
#: Texts with matches that may be broadcast.
FEW = 100_000

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?\n%$€£°]")
#: Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces gram grams kilogram kilograms ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years am pm mph kmh hz khz mhz ghz w kw mw v a j kj cal kcal pa bar c f k "
    "dollar dollars euro euros pound pounds cent cents percent usd eur gbp % $ € £ °".split()
)
WORD, NUMBER, MARK, TITLE, UNIT = range(5)
LOWER, CAPITALISED = f"^[{LETTERS}]+$", "^[A-Z][a-z]+$"
PLACE = {NUMBER: np.uint64(0x1111111111111111), TITLE: np.uint64(0x2222222222222222), UNIT: np.uint64(0x3333333333333333)}


def _token(token: str) -> tuple[int, int]:
    first = token[0]
    if first.isdigit():
        return 0, NUMBER
    if token in ".!?\n":
        return 0, MARK
    low = token.lower()
    kind = TITLE if len(token) > 1 and first.isupper() and token[1:].islower() else UNIT if low in UNITS else WORD
    return word_hash(low), kind


class Codes(dict):
    """token -> number, with the hash and kind of each; a token that isn't there is added."""

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = array("Q"), array("b")
        self.arrays = (np.zeros(0, np.uint64), np.zeros(0, np.int8))

    def __missing__(self, token: str) -> int:
        h, k = _token(token)
        self.hashes.append(h)
        self.kinds.append(k)
        code = self[token] = len(self.hashes) - 1
        return code

    def extend(self, words: list[str], kind: int | None) -> np.ndarray:
        """Adds lower-case words without looking whether they are there; kind: what all of them are, or words and units."""
        n = len(self.hashes)
        self.hashes.extend(map(word_hash, words))
        self.kinds.extend([UNIT if w in UNITS else WORD for w in words] if kind is None else [kind] * len(words))
        return np.arange(n, len(self.hashes), dtype=np.uint32)

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.arrays[0])
        if n < len(self.hashes):
            new = np.array(self.hashes[n:], np.uint64), np.array(self.kinds[n:], np.int8)
            self.arrays = np.concatenate([self.arrays[0], new[0]]), np.concatenate([self.arrays[1], new[1]])
        return self.arrays


class Templates:
    """Templates of texts; tokens' numbers are kept while there is room."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.at = keep, Codes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Hash and kind of each template word, all tokens, and the place of each template word among them."""
        tokens = TOKEN.findall(text)
        if len(self.at) > self.keep:
            self.at = Codes()
        codes = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        hashes, kinds = (c[codes] for c in self.at.columns())
        hashes, kinds, places = typed(hashes, kinds)
        return hashes, kinds, tokens, places


class Chunks:
    """Tokens of whole batches as numbers: Arrow cuts texts at blanks and numbers the distinct chunks, each new one is tokenised once."""

    def __init__(self, keep: int = 250_000):
        self.keep = keep
        self.clear()

    def clear(self) -> None:
        self.known, self.codes = Table(), Codes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' tokens, end to end, and where each text's end. A line's end is read as a full stop, which is the same kind of mark."""
        array = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " . ")
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(array, MARKS_BEHIND, r"\1 \2\3"))
        numbered = lists.flatten().dictionary_encode()
        if self.known.entries > self.keep or self.known.used > 16 * self.keep:
            self.clear()
        distinct, at = numbered.dictionary.to_pylist(), self.known.at
        self.learn([w for w in distinct if w not in at])
        which = np.fromiter(map(at.__getitem__, distinct), np.int64, len(distinct))
        codes, sizes = self.known.gather(which[numbered.indices.to_numpy()] if len(distinct) else which)
        return codes, np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()[1:]]


    def learn(self, new: list[str]) -> None:
        """Puts chunks into the table; lower-case and capitalised words of Latin letters, as most are, without looking at each."""
        array = pa.array(new, pa.large_string())
        low, title = (pc.match_substring_regex(array, p) for p in (LOWER, CAPITALISED))
        for kind, some in ((None, array.filter(low)), (TITLE, array.filter(title))):
            words = some.to_pylist()
            codes = self.codes.extend(words if kind is None else pc.ascii_lower(some).to_pylist(), kind)
            self.known.add(words, codes, np.arange(1, len(words) + 1))
        rest = array.filter(pc.invert(pc.or_(low, title))).to_pylist()
        parts = [TOKEN.findall(w) for w in rest]
        flat = [t for some in parts for t in some]
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.uint32, len(flat))
        self.known.add(rest, codes, np.cumsum([len(some) for some in parts], dtype=np.int64))


def typed(hashes: np.ndarray, kinds: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind and place of the template words among tokens; starts: where texts begin."""
    before = np.roll(kinds, 1)
    before[starts if starts is not None else slice(0, 1)] = MARK
    kinds = np.where((kinds == TITLE) & (before == MARK), WORD, kinds)  # a sentence's first word is no name
    kinds = np.where((kinds == UNIT) & (before != NUMBER), WORD, kinds)
    places = np.flatnonzero(kinds != MARK)
    hashes, kinds = hashes[places], kinds[places]
    for kind, h in PLACE.items():
        hashes[kinds == kind] = h
    return hashes, kinds, places


def windows(hashes: np.ndarray) -> np.ndarray:
    """Hash of each window."""
    n = len(hashes)
    width = min(WIDTH, n)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
    return mix64(out)


def telling(hashes: np.ndarray, kinds: np.ndarray, place: int) -> bool:
    """Whether the window at a place holds three distinct lowered words at least (all of them in a shorter text)."""
    width = min(WIDTH, len(hashes))
    h, k = hashes[place : place + width], kinds[place : place + width]
    return len(set(h[k == WORD].tolist())) >= min(3, width)


@dataclass
class Item:
    """A benchmark item: its template words, their values, and how many distinct windows it has."""

    item_id: int
    values: list[str]
    kinds: np.ndarray
    size: int


class Index:
    """Windows of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        make = Templates()
        self.items: list[Item] = []
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
        for item_id, text in items:
            hashes, kinds, tokens, places = make(text or "")
            w = windows(hashes)
            at = np.array([p for p in range(len(w)) if telling(hashes, kinds, p)], np.int32)
            if len(at):
                for c, x in zip(columns, (w[at], np.full(len(at), len(self.items), np.int32), at)):
                    c.append(x)
                self.items.append(Item(item_id, [tokens[p].lower() for p in places], kinds, len(np.unique(w[at]))))
        self.hash, self.item, self.place = map(np.concatenate, columns)
        order = np.lexsort((self.place, self.item, self.hash))
        self.hash, self.item, self.place = self.hash[order], self.item[order], self.place[order]
        bits = max(20, (8 * len(self.hash)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)  # by a hash's low bits; at most an eighth is set
        self.filter[self.hash & self.mask] = True

    def holders(self, texts: list[str], chunks: Chunks) -> np.ndarray:
        """Numbers of the texts that hold one of the windows, or are shorter than a window."""
        codes, ends = chunks(texts)
        hashes, kinds = (c[codes] for c in chunks.codes.columns())
        starts = np.concatenate([[0], ends[:-1]])
        hashes, _, places = typed(hashes, kinds, starts[starts < len(kinds)])
        ends = np.searchsorted(places, ends)
        sizes = np.diff(np.concatenate([[0], ends]))
        w = windows(hashes) if len(hashes) >= WIDTH else np.zeros(0, np.uint64)
        some = np.flatnonzero(self.filter[w & self.mask])
        some = some[np.searchsorted(self.hash, w[some], "left") < np.searchsorted(self.hash, w[some], "right")]
        text = np.searchsorted(ends, some, "right")
        return np.union1d(text[some + WIDTH <= ends[text]], np.flatnonzero((sizes > 0) & (sizes < WIDTH)))

    def matches(self, text: str, make: Templates) -> list[tuple[int | None, float, int, int, float]]:
        """(item, share of its windows, longest run, slots, share of consistent slots) for each item that the text holds."""
        if not len(self.hash):
            return []
        hashes, _, tokens, places = make(text)
        w = windows(hashes)
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        some = np.flatnonzero(self.filter[w & self.mask])
        low, high = (np.searchsorted(self.hash, w[some], side) for side in ("left", "right"))
        met = low < high
        for p, a, b in zip(some[met].tolist(), low[met].tolist(), high[met].tolist()):
            for k in range(a, b):
                found[int(self.item[k])].append((p - int(self.place[k]), int(self.place[k]), int(w[p])))
        out = []
        for k, hits in found.items():
            item = self.items[k]
            if _enough(*_extent(item, hits)) and (best := self._best(item, hits, tokens, places)):
                out.append((item.item_id, *best))
        return out

    @staticmethod
    def _best(item: Item, hits: list[tuple[int, int, int]], tokens: list[str], places: np.ndarray) -> tuple[float, int, int, float] | None:
        """Share, run, slots and consistent share of the best evidence that holds enough of the item and doesn't contradict itself."""
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for hit in hits:
            by[hit[0]].append(hit)
        slots = {shift: _slots(item, shift, some, tokens, places) for shift, some in by.items()}
        sound = sorted(shift for shift in by if _consistent([slots[shift]])[1] >= CONSISTENT)
        near: list[list[int]] = []
        for shift in sound:  # one copy's alignments differ by the words put in or left out
            if near and shift - near[-1][-1] <= len(item.values):
                near[-1].append(shift)
            else:
                near.append([shift])
        best = None
        for group in [*([shift] for shift in sound), *(g for g in near if len(g) > 1), *([sound] if len(near) > 1 else [])]:
            share, run = _extent(item, [hit for shift in group for hit in by[shift]])
            if _enough(share, run):
                n, even = _consistent([slots[shift] for shift in group])
                if even >= CONSISTENT and (best is None or (share, run, n, even) > best):
                    best = share, run, n, even
        return best


def _extent(item: Item, hits: list[tuple[int, int, int]]) -> tuple[float, int]:
    """Share of the item's distinct windows, and the longest run."""
    return len({h for _, _, h in hits}) / item.size, _longest_run(hits)


def _enough(share: float, run: int) -> bool:
    return share >= SHARE or run >= RUN


def _slots(item: Item, shift: int, hits: list[tuple[int, int, int]], tokens: list[str], places: np.ndarray) -> dict[tuple[int, str], Counter]:
    """The document's values for each of the item's (kind, value) in one alignment."""
    out: dict[tuple[int, str], Counter] = defaultdict(Counter)
    width = min(WIDTH, len(item.values))
    for p in {p + i for _, p, _ in hits for i in range(width)}:
        if item.kinds[p] != WORD:
            out[int(item.kinds[p]), item.values[p]][tokens[places[p + shift]].lower()] += 1
    return out


def _consistent(slots: list[dict[tuple[int, str], Counter]]) -> tuple[int, float]:
    """How many slots there are together, and the share that follows one value for each of the item's, or one of the item's for each value if that is less; 1 without slots."""
    there, back = defaultdict(Counter), defaultdict(Counter)
    for some in slots:
        for (kind, value), counts in some.items():
            for new, n in counts.items():
                there[kind, value][new] += n
                back[kind, new][value] += n
    n = sum(sum(c.values()) for c in there.values())
    return n, min(sum(max(c.values()) for c in way.values()) for way in (there, back)) / n if n else 1.0


def _longest_run(hits: list[tuple[int, int, int]]) -> int:
    most = run = 0
    last = None
    for d, p, _ in sorted(set(hits)):
        run = run + 1 if last == (d, p - 1) else 1
        most, last = max(most, run), (d, p)
    return most


def _blocks(benchmark: DataFrame, size: int) -> Iterator[Index]:
    """Indexes over blocks of items with about `size` windows each, read one after the other."""
    items, n = [], 0
    for r in benchmark.selectExpr("cast(item_id as long) item_id", "text").orderBy("item_id", "text").toLocalIterator():
        items.append((r.item_id, r.text))
        n += 1 + len(r.text or "") // 6
        if n >= size:
            yield Index(items)
            items, n = [], 0
    yield Index(items)


FIGURES = [("item_id", T.LongType()), ("share", T.DoubleType()), ("run", T.IntegerType()), ("slots", T.IntegerType()), ("consistent", T.DoubleType())]
FOUND = T.ArrayType(T.StructType([T.StructField(*f) for f in FIGURES]))


def _probed(docs: DataFrame, index: Broadcast, column: str) -> DataFrame:
    """docs with the items of one index that each row's whole text holds."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, chunks, names = Templates(), Chunks(), [n for n, _ in FIGURES]
        arrow = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64())))))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found: list[list[dict]] = [[] for _ in texts]
            for k in index.value.holders(texts, chunks):
                found[k] = [dict(zip(names, m)) for m in index.value.matches(texts[k], make)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, column])

    return docs.mapInArrow(tidied(run), T.StructType([*docs.schema.fields, T.StructField(column, FOUND)]))


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """docs with the items that each row's whole text holds, empty where none.

    One block is probed in the scan that gives the rows. Of several, each has a scan of its own that writes the texts with matches (by digest), and its table is let go before
    the next one is sent; so executors hold one block at a time.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)  # the more texts, the fewer times a chunk is looked up
    blocks = _blocks(benchmark, block)
    index, more = next(blocks), next(blocks, None)
    if more is None:
        return _probed(docs, spark.sparkContext.broadcast(index), column)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    parts = []
    for some in chain([index, more], blocks):
        sent = spark.sparkContext.broadcast(some)
        probed = _probed(docs.select(digest.alias("digest"), "text"), sent, "found").filter(F.size("found") > 0)
        parts.append(written(probed.groupBy("digest").agg(F.first("found").alias("found")), "leaks"))
        sent.unpersist()
    every = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found"))
    key = free_name(docs, "digest")
    few = every.limit(FEW + 1).count() <= FEW
    every = every.select(F.col("digest").alias(key), F.col("found").alias(column))
    out = docs.withColumn(key, digest).join(F.broadcast(every) if few else every, key, "left").drop(key)
    return out.withColumn(column, F.coalesce(column, F.array().cast(FOUND)))


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per contaminated row of docs: doc_id, its items, and the best match's figures."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, "found", block).filter(F.size("found") > 0)
    best = lambda f: F.array_max(F.transform("found", lambda m: m[f]))
    return found.select(
        "doc_id",
        F.array_sort(F.transform("found", lambda m: m["item_id"])).alias("item_ids"),
        best("share").alias("share"), best("run").alias("longest_run"), best("slots").alias("slots"), best("consistent").alias("consistent"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    column = free_name(docs, "found")
    return with_matches(docs, benchmark, column, block).filter(F.size(column) == 0).drop(column)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` against every item of `benchmark`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
