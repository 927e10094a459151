"""Phrases whose words stand together more often than their parts would, by growing frequent contiguous patterns from their prefixes.

An occurrence pointer is a word's place together with what follows it within its piece, four words in all; equal ones of a block of text
are counted before they travel. Pointers are dealt in the order of their words, so that those of one prefix lie next to each other, in one task or, where a prefix
is frequent, in several neighbouring ones. Each task grows patterns depth first: the pointers of a frequent prefix are cut into those of its
extensions, and only frequent extensions are followed. A pattern that reaches over the edge of a block has its counts added up afterwards.

A pointer ends before a pair of words that can't be frequent. Which pairs can is known from their hashes' exact counts, kept as a map of 2**26 bits: hashes that meet in
a bit only make pointers longer than needed, whatever the size of the corpus, and every count that is returned is of the words themselves.

Defined cases: a null text is empty; a null language is `und`; empty pieces hold no words; repeated rows count as often as they are there; a text of
any length is read in blocks; a language without frequent phrases isn't in the result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HashCache, Tables, mix64, small_batches, table, tidied, word_hash

#: Words of a phrase at most, occurrences of a candidate at least, share (in hundredths) of a phrase's occurrences in a longer one from which on it goes, phrases a language.
LONGEST, LEAST, INSIDE, TOP = 4, 30, 80, 2000
#: Bytes of text that are cut into words at once, and bits of the map of frequent hashes as a power of two.
BLOCK, MAP_BITS = 8 << 20, 26
#: Bits of the map that one task puts together, as a power of two, and parts by which each language's best are found first.
PART_BITS, PARTS = 18, 32

BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def blocks(text: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """text in parts of about `size` bytes, and how many words at a part's end only serve as followers, since the next part begins with them."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(bytes([b]), at, at + size) for b in BREAKS) + 1
        if end > at:
            yield text[at:end], 0
            at = end
            continue
        width, start = size, -1
        while start <= at and at + width < len(text):  # no break: cut behind a word and begin again with the last ones
            end = max(text.rfind(bytes([b]), at, at + width) for b in BLANKS)
            words = text[at:end].split() if end > at else []
            start = end
            for w in words[: -LONGEST : -1] if len(words) >= LONGEST else []:
                start = text.rfind(w, at, start)
            if len(words) < LONGEST:
                start = -1
            width *= 2
        if start <= at:
            break
        yield text[at:end], LONGEST - 1
        at = start
    yield text[at:], 0


class Words:
    """The words of one block: the distinct ones, each place's word, and whether the next place is in the same piece."""

    def __init__(self, text: bytes, tail: int):
        raw = np.frombuffer(text, np.uint8)
        kind = KIND[raw]
        inside = kind == 0
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[inside].tobytes())).dictionary_encode()
        self.distinct, self.at = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.together = np.concatenate([piece[1:] == piece[:-1], [False]]) if len(start) else np.zeros(0, bool)
        self.starts = np.arange(len(start)) < len(start) - tail


def read(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Words]]:
    """Blocks of each language's texts."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, Words]]:
        text = b"\n".join(held.pop(lang)).translate(LOWER)
        del sizes[lang]
        for block, tail in blocks(text, size):
            yield lang, Words(block, tail)

    for part in parts:
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text.encode())
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= size:
                    yield from cut(lang)
        if len(held) > 64:
            for lang in list(held):
                yield from cut(lang)
    for lang in list(held):
        yield from cut(lang)


class Hashes:
    """64-bit hashes of words and pairs of a language."""

    def __init__(self):
        self.known = HashCache()

    def words(self, lang: str, words: Words) -> np.ndarray:
        found = map(self.known.__getitem__, words.distinct.to_pylist())
        with np.errstate(over="ignore"):
            return mix64(np.fromiter(found, np.uint64, len(words.distinct)) + np.uint64(word_hash(lang)) * ONE)

    @staticmethod
    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(a * ONE + b * TWO)


def texts_by_language(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def frequent_map(texts: DataFrame, least: int, size: int = BLOCK) -> Broadcast:
    """Bits of the hashes of words and pairs that are there `least` times or more."""
    spark = texts.sparkSession

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for lang, words in read(parts, size):
            own = hashes.words(lang, words)
            times = np.bincount(words.at[words.starts], minlength=len(own))
            first = np.flatnonzero(words.together & words.starts)
            pairs, n = np.unique(words.at[first] * len(own) + words.at[first + 1], return_counts=True)
            keys = np.concatenate([own, Hashes.pairs(own[pairs // max(1, len(own))], own[pairs % max(1, len(own))])])
            counts = np.concatenate([times, n])
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)], pa.int64())], ["hash", "n"])

    often = texts.mapInArrow(tidied(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.col("hash").bitwiseAND((1 << MAP_BITS) - 1)
    often = often.select(bit.alias("bit"), F.shiftright(bit, PART_BITS).cast("int").alias("part"))

    def put(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for part in parts:
            at = part.column(0).to_numpy()
            for p in np.unique(at >> PART_BITS):
                some = at[at >> PART_BITS == p] & ((1 << PART_BITS) - 1)
                bits.setdefault(int(p), np.zeros(1 << PART_BITS, bool))[some] = True
        for p, b in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(b).tobytes()], pa.binary())], ["part", "bits"])

    whole = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    width = 1 << (PART_BITS - 3)
    for row in often.repartition("part").select("bit").mapInArrow(put, "part int, bits binary").collect():  # 8 MB in all, however many rows are frequent
        whole[row.part * width : (row.part + 1) * width] |= np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def pointers(texts: DataFrame, often: Broadcast, size: int = BLOCK) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): equal pointers of a block, counted; words behind a pointer's end are empty. A row of empty words counts all words of a block."""
    names = ["lang", *(f"w{i}" for i in range(1, LONGEST + 1)), "n"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), often.value
        for lang, words in read(parts, size):
            v = len(words.distinct)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.array([""])] * LONGEST, pa.array([int(words.starts.sum())], pa.int64())], names)
            if not v:
                continue
            own = hashes.words(lang, words)
            at, n = words.at, len(words.at)
            joined = words.together.copy()
            joined[:-1] &= has(bits, Hashes.pairs(own[at[:-1]], own[at[1:]]))
            code, reach = at + 1, joined
            first = np.flatnonzero(words.starts & has(bits, own)[at])
            columns = [code[first]]
            for k in range(1, LONGEST):
                reach = joined if k == 1 else reach & np.concatenate([joined[k - 1 :], np.zeros(k - 1, bool)])
                following = np.concatenate([code[k:], np.zeros(k, np.int64)])[:n]
                columns.append(np.where(reach, following, 0)[first])
            key = columns[0]
            for c in columns[1:]:
                if len(key) and int(key.max()) > (1 << 62) // (v + 1):
                    key = np.unique(key, return_inverse=True)[1]  # keys are only told apart here
                key = key * (v + 1) + c
            _, some, counts = np.unique(key, return_index=True, return_counts=True)
            spelled = pa.concat_arrays([pa.array([""], words.distinct.type), words.distinct])
            for i in range(0, len(some), 1 << 15):
                which = some[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(which)), *[spelled.take(pa.array(c[which])).cast(pa.string()) for c in columns], pa.array(counts[i : i + (1 << 15)], pa.int64())], names)

    return texts.mapInArrow(tidied(run), "lang string, " + ", ".join(f"{c} string" for c in names[1:-1]) + ", n long")


def grown(found: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, a): frequent patterns and their occurrences; size 0 has each language's number of words."""
    names = [f"w{i}" for i in range(1, LONGEST + 1)]
    order = ["lang", *names]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            if not n:
                continue
            change = [np.ones(n, bool)]
            for c in range(LONGEST + 1):
                column = part.column(c)
                new = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                change.append(np.concatenate([[True], new | change[-1][1:] if c else new]))
            words = [part.column(c) for c in range(LONGEST + 1)]
            empty = [pc.equal(w, "").to_numpy(zero_copy_only=False) for w in words]
            sums = np.concatenate([[0], np.cumsum(part.column(LONGEST + 1).to_numpy())])
            out: list[tuple[str, int, str, int]] = []

            def grow(low: int, high: int, size: int, prefix: str, lang: str) -> None:
                """Extensions of a pattern of `size` words, whose pointers are the rows from low to high."""
                edges = np.flatnonzero(change[size + 2][low:high]) + low
                starts = edges if len(edges) and edges[0] == low else np.concatenate([[low], edges])
                ends = np.append(starts[1:], high)
                totals = sums[ends] - sums[starts]
                follow = ((totals >= least) | (starts == 0) | (ends == n)) & ~empty[size + 1][starts]
                for a, b, total in zip(starts[follow].tolist(), ends[follow].tolist(), totals[follow].tolist()):
                    phrase = f"{prefix} {words[size + 1][a].as_py()}" if size else words[1][a].as_py()
                    out.append((lang, size + 1, phrase, total))
                    if size + 1 < LONGEST:
                        grow(a, b, size + 1, phrase, lang)

            starts = np.flatnonzero(change[1])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                lang = words[0][a].as_py()
                rest = a + int(np.argmin(empty[1][a:b])) if not empty[1][a:b].all() else b
                out.append((lang, 0, "", int(sums[rest] - sums[a])))
                grow(rest, b, 0, "", lang) if rest < b else None
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(columns[3], pa.int64())], ["lang", "size", "phrase", "a"])

    some = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(run), "lang string, size int, phrase string, a long")
    return some.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).filter((F.col("size") == 0) | (F.col("a") >= least))


def scored(patterns: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the patterns of two words or more, by their lowest-scoring cut."""
    p = patterns.filter("size >= 2").select("lang", "phrase", "size", "a")
    words = F.split("phrase", " ")
    cuts = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    known = patterns.filter("size >= 1")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, inside: int = INSIDE, top: int = TOP, size: int = BLOCK) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    small_batches(spark)
    tables, texts = Tables(spark), texts_by_language(docs, lang, text)
    found = tables.write(pointers(texts, frequent_map(texts, least, size), size), "phrase-pointers")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1 << 16)
    patterns = tables.write(grown(found, least), "phrase-patterns")
    tables.drop(found)
    long_ = patterns.filter("size >= 3").withColumn("words", F.split("phrase", " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    longer = long_.select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    kept = scored(patterns).join(longer, ["lang", "phrase"], "left").filter(100 * wide("longer") < inside * wide("a")).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for by in ([F.col("lang"), F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], [F.col("lang")]):  # no task ranks more of a language than PARTS tops
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    totals = patterns.filter("size = 0").select("lang", F.col("a").alias("n"))
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of all `documents`."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(len(w) - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' '))) AS phrase FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, unnest(range(1, size)) AS k FROM f WHERE size >= 2),
x AS (SELECT *, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rest FROM c),
y AS (SELECT x.lang, x.size, x.phrase, x.a, x.k, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a) // (l.a + r.a) AS score FROM x JOIN f l ON x.lang = l.lang AND x.one = l.phrase JOIN f r ON x.lang = r.lang AND x.rest = r.phrase),
s AS (SELECT lang, size, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM y GROUP BY lang, size, phrase, a),
h AS (SELECT s.lang, s.phrase FROM s JOIN s q ON s.lang = q.lang AND q.size > s.size AND contains(' ' || q.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * q.a >= {INSIDE} * s.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s ANTI JOIN h USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= {TOP}"""
}
