"""Repeated passages by a sparse suffix array.

A text is a sequence of lower-case words. Of its suffixes only those at minimiser positions are kept: where the hash of the next HEAD
words is the least of a span of such hashes, so that texts which share a passage of LEAST words keep a suffix at the same word of it.
Suffixes are ordered by their heads; each is compared with the first of those that begin alike (the neighbour that stays), and
suffixes of two documents at a constant distance form one run. A run is then extended word by word, left and right, over whole texts, which
also verifies it, and is reported if it has LEAST words. Where a suffix's run with its neighbour stays shorter, it may still share a passage with another
suffix that begins like it: all suffixes of that head are then ordered again by each of the windows of LEAST words around them. Of a
stretch that repeats itself (a line over and over) only the first and the last suffix of each head are kept, and so of its windows; the windows are
made around all places of the head.

Nothing is paired within a group: each suffix meets one neighbour, so a passage that a third of all documents share costs one
row for each of its suffixes, or for each of its windows.

Defined cases: null and empty texts and texts shorter than LEAST words have no passages; passages that repeat within one document alone don't
count; rows with equal identifiers and texts are one document; a null identifier counts as larger than others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashCache, Tables, batches, mix64, small_batches, table

LEAST, HEAD = 50, 24
FEW = 500_000
#: Partners of a text that one task compares with it.
SPLIT = 1024
WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Words:
    """Hashes of a text's words."""

    def __init__(self):
        self.hashes = HashCache()

    def __call__(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


def heads(words: np.ndarray, powers: Powers, head: int = HEAD) -> np.ndarray:
    """Hash of each `head` words in a row."""
    n = len(words) - head + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
        return mix64((sums[head:] - sums[:-head]) * down[:n])


def thinned(at: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """The positions without those inside a chain: of equal hashes less than `width` apart, one after another, the first and the last stay."""
    order = np.lexsort((at, h[at]))
    at = at[order]
    close = np.zeros(len(at) + 1, bool)
    close[1:-1] = (np.diff(h[at].view(np.int64)) == 0) & (np.diff(at) < width)
    return np.sort(at[~(close[:-1] & close[1:])])


def minimisers(h: np.ndarray, span: int = LEAST - HEAD + 1) -> np.ndarray:
    """Positions of the least hash of each span of positions, the leftmost if there are several; of a stretch that repeats itself, the first and the last."""
    if len(h) < span:
        return np.zeros(0, np.int64)
    return thinned(np.unique(sliding_window_view(h, span).argmin(1) + np.arange(len(h) - span + 1)), h, HEAD)


def around(words: np.ndarray, places: list[int], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of LEAST words, and positions of those that hold a head which begins at one of the places, wherever it occurs."""
    h, windows = heads(words, powers), heads(words, powers, LEAST)
    at = np.flatnonzero(np.isin(h, h[places]))  # also the places inside a chain
    held = np.zeros(len(h) + 1, np.int64)
    np.add.at(held, np.maximum(at - (LEAST - HEAD), 0), 1)
    np.add.at(held, at + 1, -1)
    return windows, thinned(np.flatnonzero(np.cumsum(held)[: len(windows)] > 0), windows, LEAST)


def tag_of():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("tag")


def suffixes(docs: DataFrame) -> DataFrame:
    """(head, rank, tag, at): the kept suffixes; rank orders documents, `at` counts words."""
    schema = pa.schema([("head", pa.int64()), ("rank", pa.int64()), ("tag", pa.int64()), ("at", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = Words(), Powers()
        for part in parts:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for rank, tag, text in zip(*(c.to_pylist() for c in part.columns)):
                h = heads(words(text or ""), powers)
                at = minimisers(h)
                for c, x in zip(columns, (h[at].view(np.int64), np.full(len(at), rank), np.full(len(at), tag), at.astype(np.int32))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank")
    return docs.select(rank, tag_of(), "text").mapInArrow(run, "head long, rank long, tag long, at int")


def runs(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Suffixes with the neighbour that stays (first_tag, first_at), and the runs of each pair of documents. rows are let go."""
    neighbour = rows.groupBy("head").agg(F.min(F.struct("rank", "tag", "at")).alias("first"), F.min("tag").alias("low"), F.max("tag").alias("high"))
    neighbour = neighbour.filter("low <> high").select("head", F.col("first.tag").alias("first_tag"), F.col("first.at").alias("first_at"))
    paired = tables.write(rows.join(neighbour, "head"), "suffix-paired")
    tables.drop(rows)
    by = paired.filter("tag <> first_tag").groupBy("tag", "first_tag", (F.col("at") - F.col("first_at")).alias("shift"))
    places = by.agg(F.sort_array(F.collect_set("at")).alias("places"))  # of one pair of documents: no more than a text's words
    return paired, tables.write(places, "suffix-runs")


def extend(pairs: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """Maximal common passages of LEAST words around the runs, written: tag, start, stop, first_tag, first_start, first_stop in words. pairs are let go.

    The text that stays goes once to each SPLIT of its partners, so that one which many texts share a passage with is dealt to many tasks.
    """
    used = tables.write(pairs.select(F.explode(F.array("tag", "first_tag")).alias("tag")).distinct(), "suffix-used")
    few = used.count() <= FEW
    texts = docs.select(tag_of(), F.coalesce("text", F.lit("")).alias("text"))
    texts = tables.write(texts.join(F.broadcast(used) if few else used, "tag").dropDuplicates(["tag"]), "suffix-texts")
    grouped = tables.write(pairs.groupBy("tag", "first_tag").agg(F.collect_list(F.struct("shift", "places")).alias("runs")), "suffix-grouped")
    parts = grouped.groupBy("first_tag").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts"))
    partners = grouped.join(parts, "first_tag").select("first_tag", F.pmod(F.xxhash64("tag"), "parts").alias("part"), F.lit(1).alias("kind"), "tag", "runs")
    firsts = parts.select("first_tag", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("first_tag").alias("tag"), F.lit(None).alias("runs"))
    rows = partners.unionByName(firsts).join(texts, "tag").select("first_tag", "part", "kind", "tag", "runs", "text")
    schema = pa.schema([(n, pa.int64()) for n in ("tag", "start", "stop", "first_tag", "first_start", "first_stop")])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def found() -> Iterator[tuple]:
            first = None
            for batch in batches_in:
                for first_tag, _, kind, tag, runs_, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if not kind:
                        first = words(text)
                        continue
                    mine = words(text)
                    for r in runs_:
                        for start, stop in passages(mine, first, r["shift"], r["places"]):
                            if stop - start >= LEAST:
                                yield tag, start, stop, first_tag, start - r["shift"], stop - r["shift"]

        yield from batches(found(), schema)

    ddl = ", ".join(f"{f.name} long" for f in schema)
    out = tables.write(rows.repartition("first_tag", "part").sortWithinPartitions("first_tag", "part", "kind", "tag").mapInArrow(run, ddl), "suffix-passages")
    tables.drop(used, texts, grouped, pairs)
    return out


def passages(mine: np.ndarray, other: np.ndarray, shift: int, places: list[int]) -> list[tuple[int, int]]:
    """Stretches of equal words at a distance that hold one of the places."""
    low, high = max(0, shift), min(len(mine), len(other) + shift)
    same = np.concatenate([[False], mine[low:high] == other[low - shift : high - shift], [False]])
    edges = np.flatnonzero(np.diff(same))
    starts, stops = edges[::2] + low, edges[1::2] + low
    hit = np.unique(np.searchsorted(starts, np.array(places), "right") - 1)
    return [(int(starts[k]), int(stops[k])) for k in hit if k >= 0]


class RepeatedPassages:
    """The tables of one run."""

    def __init__(self, docs: DataFrame):
        self.docs, self.tables = docs, Tables(docs.sparkSession)
        small_batches(docs.sparkSession)

    def found(self) -> DataFrame:
        """Common passages of LEAST words with the occurrence that stays, written."""
        paired, pairs = runs(self.tables.write(suffixes(self.docs), "suffixes"), self.tables)
        good = extend(pairs, self.docs, self.tables)
        left = self.tables.write(self.short(paired, good), "suffix-short")
        if left.isEmpty():
            self.tables.drop(paired, left)
            return good
        again = self.tables.write(self.windows(paired.join(left, "head", "left_semi")), "suffix-windows")
        self.tables.drop(paired, left)
        paired, pairs = runs(again, self.tables)
        more = extend(pairs, self.docs, self.tables)
        out = self.tables.write(good.unionByName(more).distinct(), "suffix-found")
        self.tables.drop(paired, good, more)
        return out

    @staticmethod
    def short(paired: DataFrame, good: DataFrame) -> DataFrame:
        """Heads of suffixes that lie in none of the passages found with their neighbours, if there are three or more places that begin so."""
        block = 64  # words: passages are looked up by the blocks that they touch
        blocks = F.sequence(F.floor(F.col("start") / block), F.floor(F.col("stop") / block))
        done = good.select("tag", "first_tag", "start", "stop", F.explode(blocks).alias("block")).alias("d")
        other = paired.filter("tag <> first_tag").withColumn("block", F.floor(F.col("at") / block)).alias("p")
        same = [F.col(f"p.{c}") == F.col(f"d.{c}") for c in ("tag", "first_tag", "block")]
        left = other.join(done, [*same, F.col("at") >= F.col("start"), F.col("at") < F.col("stop")], "left_anti").select("head").distinct()
        # besides the first place, which may be one of several in its document
        others = paired.filter("tag <> first_tag or at <> first_at").groupBy("head")
        several = others.agg(*(f(c).alias(f"{n}_{c}") for c in ("tag", "at") for n, f in (("low", F.min), ("high", F.max)))).filter("low_tag <> high_tag or low_at <> high_at")
        return left.join(several.select("head"), "head")

    def windows(self, members: DataFrame) -> DataFrame:
        """Like suffixes(): each window of LEAST words that holds the head of one of the members, at any of its places in the text."""
        places = self.tables.write(members.groupBy("tag").agg(F.min("rank").alias("rank"), F.collect_set("at").alias("places")), "suffix-members")
        few = places.limit(FEW + 1).count() <= FEW // 10
        texts = self.docs.select(tag_of(), F.coalesce("text", F.lit("")).alias("text"))
        both = texts.join(F.broadcast(places) if few else places, "tag").select("rank", "tag", "text", "places")
        schema = pa.schema([("head", pa.int64()), ("rank", pa.int64()), ("tag", pa.int64()), ("at", pa.int32())])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, powers = Words(), Powers()

            def rows() -> Iterator[tuple]:
                for part in parts:
                    for rank, tag, text, places in zip(*(c.to_pylist() for c in part.columns)):
                        h, at = around(words(text), places, powers)
                        yield from zip(h[at].view(np.int64).tolist(), [rank] * len(at), [tag] * len(at), at.tolist())

            yield from batches(rows(), schema)

        return both.mapInArrow(run, "head long, rank long, tag long, at int")

    def spans(self) -> DataFrame:
        """Per passage and document that has it: doc_id, start_word, stop_word, n_words, kept (the occurrence that stays) and first_doc_id."""
        found = self.found()
        copies = found.select("tag", "start", "stop", "first_tag", F.lit(False).alias("kept"))
        stays = found.select(F.col("first_tag").alias("tag"), F.col("first_start").alias("start"), F.col("first_stop").alias("stop"), "first_tag", F.lit(True).alias("kept")).distinct()
        names = self.docs.select(tag_of(), F.col("doc_id").cast("long").alias("doc_id")).distinct()
        all_ = copies.unionByName(stays)
        used = self.tables.write(all_.select("tag").distinct().join(names, "tag"), "suffix-names")
        out = all_.join(used, "tag").join(used.select(F.col("tag").alias("first_tag"), F.col("doc_id").alias("first_doc_id")), "first_tag")
        return out.select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), (F.col("stop") - F.col("start")).alias("n_words"), "kept", "first_doc_id")


def repeated_passages(docs: DataFrame) -> DataFrame:
    return RepeatedPassages(docs).spans()


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents' whole texts."""
    return repeated_passages(table(spark, sf_dir, "documents"))
