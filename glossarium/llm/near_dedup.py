"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five lower-case words; a shingle weighs its count times the mean inverse document frequency of its words.
Document frequencies are counted over all documents in a fixed number of hashed slots, so the table that is broadcast
doesn't grow. Consistent weighted sampling picks one shingle and level per hash function, such that two texts agree with
the probability of their weighted Jaccard similarity; four picks make a band, and texts that share a band are compared.

Texts with the same words are one node from the start. In a bucket nobody is compared with everybody. First each node meets one pivot, the one that
it shares most buckets with; then, in each bucket that holds several components, one member of each meets one of the largest. The members that are still
apart from their bucket's largest component meet others by an exact prefix filter: with shingles ordered from rare to common, two texts can only be
similar enough if they share one of the first shingles of both, at a place after which both have enough weight left. Every pair is verified by the
weighted Jaccard similarity of whole texts, and verified pairs are joined to classes by connected components. So no link between members of a bucket
that could join two classes is lost; texts that share no band aren't compared.

Defined cases: texts without words are alike only if equal; a text of fewer than five words is one shingle; a null text is empty;
rows with equal identifiers and texts stay or go together; a null identifier counts as larger than others; an empty table
gives an empty result; other columns are ignored or, in `kept_rows`, passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, HashCache, Tables, batches, free_name, mix64, relabelled, shingle_hashes, small_batches, table, tidied, word_hash, written

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 8, 4
SLOTS = 1 << 16
#: Slots in which shingles of texts that are still apart are counted, as a power of two.
COUNT_BITS = 18
#: Rows of (long, long) that may be broadcast.
FEW = 500_000
#: Partners of a hub that one task compares with it.
SPLIT = 1024
#: Tokens in front of a prefix's token that are looked at to see whether a pair has met.
BEFORE = 8


def _gamma2(size: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of `size` equal steps."""
    x = np.linspace(0, 40, 2_000_001)
    return np.interp((np.arange(size) + 0.5) / size, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


GAMMA = _gamma2(1 << 16)
LOG_GAMMA = np.log(GAMMA)
SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


class Shingler:
    """Weighted shingles of texts under slots' inverse document frequencies."""

    def __init__(self, idf: np.ndarray | None = None):
        self.hashes, self.idf = HashCache(), idf

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        return np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))

    def weighted(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order, and their weights."""
        shingles = shingle_hashes(words, WIDTH)
        if not len(shingles):
            return shingles, np.zeros(0, np.float32)
        width = min(WIDTH, len(words))
        total = np.concatenate([[0.0], np.cumsum(self.idf[words & np.uint64(SLOTS - 1)], dtype=np.float64)])
        rarity = np.round((total[width:] - total[:-width]) / width, 3)  # sums differ in their last digits from place to place
        out, first, counts = np.unique(shingles, return_index=True, return_counts=True)
        return out, (counts * rarity[first]).astype(np.float32)


def bands(shingles: np.ndarray, weights: np.ndarray) -> list[int]:
    """A 64-bit key for each band."""
    low = picked = None
    for i in range(0, len(shingles), 4096):
        h, log_w = shingles[i : i + 4096], np.log(weights[i : i + 4096])
        u = mix64(h[None, :] ^ SEEDS)
        r = GAMMA[u & np.uint64(0xFFFF)]
        beta = ((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        level = np.floor(log_w / r + beta)
        cost = LOG_GAMMA[(u >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (level - beta + 1)
        at = cost.argmin(1)
        rows = np.arange(len(at))
        mine, least = h[at] ^ (level[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), cost[rows, at]
        if low is None:
            low, picked = least, mine
        else:
            better = least < low
            low, picked = np.where(better, least, low), np.where(better, mine, picked)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in mix64(picked).reshape(BANDS, ROWS).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64).tolist()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total else 0.0


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of each slot, from the number of all documents that have one of its words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, n = Shingler(), np.zeros(SLOTS + 1, np.int64), 0
        for part in parts:
            for text in part.column(0).to_pylist():
                n += 1
                counts[np.unique(shingler.words(text or "") & np.uint64(SLOTS - 1)).astype(np.int64)] += 1
        counts[SLOTS] = n
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["slot", "n"])

    rows = docs.select("text").mapInArrow(tidied(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS + 1 rows at most
    counts = np.zeros(SLOTS + 1)
    counts[rows.slot.to_numpy(int)] = rows.n
    return (np.log((counts[SLOTS] + 1) / (counts[:SLOTS] + 1)) + 1).astype(np.float32)


def shingle_counts(texts: DataFrame, idf: Broadcast) -> Broadcast:
    """How many shingles fall in each of a fixed number of slots: an order from rare to common, whatever it is, keeps the prefix filter exact."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(idf.value), np.zeros(1 << COUNT_BITS, np.int64)
        for part in parts:
            for text in part.column(0).to_pylist():
                slots = shingler.weighted(shingler.words(text))[0] >> np.uint64(64 - COUNT_BITS)
                np.add.at(counts, slots, 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["slot", "n"])

    rows = texts.select("text").mapInArrow(tidied(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # 2**COUNT_BITS rows at most
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[rows.slot.to_numpy(int)] = rows.n
    return texts.sparkSession.sparkContext.broadcast(counts)


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """(doc_id, tag, same, bands) per row: `same` is equal for texts with the same words, tag tells rows of one identifier apart."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known = Shingler(idf.value), HashCache(20_000)

        def rows() -> Iterator[tuple]:
            for part in parts:
                for doc_id, tag, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = shingler.words(text or "")
                    same = xxhash.xxh3_128_digest(words.tobytes() if len(words) else b"\0" + (text or "").encode("utf-8", "surrogatepass"))
                    if same not in known:
                        if len(known) >= known.size:
                            known.clear()
                        known[same] = bands(*shingler.weighted(words)) if len(words) else []
                    yield doc_id, tag, same, known[same]

        yield from batches(rows(), schema, 2048)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(docs), "text").mapInArrow(tidied(run), "doc_id long, tag long, same binary, bands array<long>")


def tag_of(docs: DataFrame):
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("tag")


class NearDuplicates:
    """The tables of one run."""

    def __init__(self, docs: DataFrame, least: float = LEAST):
        self.docs, self.least, spark = docs, least, docs.sparkSession
        small_batches(spark)
        self.tables = Tables(spark)
        self.idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
        self.rows = self.tables.write(signatures(docs, self.idf), "near-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
        nodes = self.rows.groupBy("same").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
        self.nodes = self.tables.write(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "n", "first.doc_id", "first.tag", "bands"), "near-nodes")
        members = self.nodes.select("node", F.explode("bands").alias("bucket"))
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.shared = self.tables.write(members.join(sizes, "bucket").select("bucket", "node", "n"), "near-shared")

    def member_texts(self) -> DataFrame:
        """(node, text) of the nodes that share a bucket, written; a node of repeated rows may be there as often."""
        used = self.tables.write(self.shared.select("node").distinct().join(self.nodes.select("node", "tag"), "node"), "near-used")
        few = used.limit(FEW + 1).count() <= FEW
        texts = self.docs.select(tag_of(self.docs), F.coalesce("text", F.lit("")).alias("text"))
        out = self.tables.write(texts.join(F.broadcast(used) if few else used, "tag").select("node", "text"), "near-texts")
        self.tables.drop(used)
        return out

    def verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Those of (hub, node) whose whole texts are similar enough, as written (a, b).

        A hub's text goes once to each SPLIT of its partners, so a hub of many partners is dealt to many tasks, and each partner's text goes there once.
        """
        counts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts"))
        asked = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(1).alias("kind"), "node")
        hubs = counts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("node"))
        rows = asked.unionByName(hubs).join(texts, "node").select("hub", "part", "kind", "node", "text")
        idf, least = self.idf, self.least
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(idf.value)

            def rows() -> Iterator[tuple]:
                group = mine = last = None
                for part in parts:
                    for hub, number, kind, node, text in zip(*(c.to_pylist() for c in part.columns)):
                        if (hub, number) != group:
                            group, mine, last = (hub, number), shingler.weighted(shingler.words(text)), hub
                        if kind and node != last and similarity(mine, shingler.weighted(shingler.words(text))) >= least:
                            yield hub, node
                        last = node

            yield from batches(rows(), schema)

        rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "node")
        return self.tables.write(rows.mapInArrow(tidied(run), "a long, b long"), "near-edges")

    def labels(self) -> DataFrame:
        """(node, label) of every linked node."""
        texts, name = self.member_texts(), "near-labels"
        pairs = self.tables.write(self.central_pairs(), "near-pairs")
        edges = self.verified(pairs, texts)
        labels = relabelled(None, edges, self.tables, name)
        self.tables.drop(edges)
        open_ = self.open_rows(labels)
        more = self.tables.write(self.bucket_pairs(open_).join(pairs, ["hub", "node"], "left_anti"), "near-pairs")
        edges = self.verified(more, texts)
        self.tables.drop(pairs, more)
        if not edges.isEmpty():
            self.tables.drop(open_)
            labels = relabelled(labels, edges, self.tables, name)
            open_ = self.open_rows(labels)
        self.tables.drop(edges)
        pairs = self.remaining(open_.filter("n > 2"), texts)  # two members of a bucket have met
        self.tables.drop(open_, self.shared)
        if pairs is not None and not pairs.isEmpty():
            edges = self.verified(pairs, texts)
            if not edges.isEmpty():
                labels = relabelled(labels, edges, self.tables, name)
            self.tables.drop(edges)
        self.tables.drop(pairs, texts)
        return labels

    def central_pairs(self) -> DataFrame:
        """(hub, node): each node with one pivot of its buckets, the one that it shares most buckets with. A bucket's pivot is its member that meets most others."""
        met = self.shared.groupBy("node").agg(F.sum("n").alias("met"))
        pivots = self.shared.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", F.xxhash64("node"))).alias("hub"))
        shares = self.shared.join(pivots, "bucket").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
        return shares.groupBy("node").agg(F.max_by("hub", F.struct("times", "n", F.xxhash64("hub"))).alias("hub")).select("hub", "node")

    def open_rows(self, labels: DataFrame) -> DataFrame:
        """(bucket, n, node, label) with main, the label of most members, for the buckets whose members have several labels; written."""
        rows = self.shared.join(labels, "node", "left").select("bucket", "n", "node", F.coalesce("label", "node").alias("label"))
        rows = self.tables.write(rows, "near-labelled")
        sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("times"))
        mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("times", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
        out = self.tables.write(rows.join(mixed.select("bucket", "main"), "bucket"), "near-open")
        self.tables.drop(rows)
        return out

    def bucket_pairs(self, rows: DataFrame) -> DataFrame:
        """(hub, node): of each bucket's other labels one member, with a member of its main label; each bucket takes other members."""
        some = rows.groupBy("bucket", "label", "main").agg(F.min_by("node", F.xxhash64("bucket", "node")).alias("node"))
        hubs = some.filter("label = main").select("bucket", F.col("node").alias("hub"))
        return some.filter("label <> main").join(hubs, "bucket").select("hub", "node").distinct()

    def remaining(self, rows: DataFrame, texts: DataFrame) -> DataFrame | None:
        """(hub, node), written: nodes with different labels that may still be similar; of two such members of a bucket, one at least isn't of its main label."""
        open_ = self.tables.write(rows.groupBy("node").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("apart")), "near-apart")
        if open_.isEmpty():
            self.tables.drop(open_)
            return None
        texts = texts.join(open_.select("node"), "node", "left_semi")
        first = self.tables.write(self.prefixes(texts, shingle_counts(texts, self.idf)).join(open_, "node"), "near-prefixes")
        mine = first.filter("apart").select(*[F.col(c).alias(c + "_a") for c in ("node", "label", "total", "left", "before")], "token")
        other = first.select(*[F.col(c).alias(c + "_b") for c in ("node", "label", "total", "left", "before", "apart")], "token")
        needed = (F.col("total_a") + F.col("total_b")) * (self.least / (1 + self.least)) - 1e-3
        may = (F.col("label_a") != F.col("label_b")) & (F.least("left_a", "left_b") >= needed) & ~(F.col("apart_b") & (F.col("node_b") < F.col("node_a")))
        # a pair that shares one of the tokens just before has met there
        pairs = mine.join(other, (mine["token"] == other["token"]) & may & ~F.arrays_overlap("before_a", "before_b"))
        out = self.tables.write(pairs.select(F.col("node_a").alias("hub"), F.col("node_b").alias("node")).distinct(), "near-pairs")
        self.tables.drop(first, open_)
        return out

    def prefixes(self, texts: DataFrame, counts: Broadcast) -> DataFrame:
        """(node, total, token, left, before): the first shingles of each text, rare ones first, the weight from each of them on, and the BEFORE ones in front of it."""
        idf, least = self.idf, self.least
        schema = pa.schema([("node", pa.int64()), ("total", pa.float64()), ("token", pa.int64()), ("left", pa.float64()), ("before", pa.list_(pa.int64()))])

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(idf.value)
            for part in parts:
                columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for node, text in zip(*(c.to_pylist() for c in part.columns)):
                    shingles, weights = shingler.weighted(shingler.words(text))
                    order = np.lexsort((shingles, counts.value[shingles >> np.uint64(64 - COUNT_BITS)]))
                    w = weights[order].astype(np.float64)
                    left = w[::-1].cumsum()[::-1]
                    total = float(w.sum())
                    n = int((left >= least * total - 1e-3).sum())
                    tokens, at = shingles[order[:n]].view(np.int64), np.arange(n)
                    sizes = np.minimum(at, BEFORE)
                    inside = np.arange(int(sizes.sum())) + np.repeat(at - np.cumsum(sizes), sizes)
                    for c, x in zip(columns, (np.full(n, node, np.int64), np.full(n, total), tokens, left[:n], sizes, tokens[inside])):
                        c.append(x)
                node, total, token, left, sizes, inside = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
                before = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(inside, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(total, pa.float64()), pa.array(token, pa.int64()), pa.array(left, pa.float64()), before], schema=schema)

        return texts.select("node", "text").mapInArrow(tidied(run), "node long, total double, token long, left double, before array<long>")

    def classes(self) -> DataFrame:
        """Per row of docs: doc_id, tag, class_id (the smallest identifier of its class), class_tag and class_size."""
        labels = self.labels()
        named = self.nodes.join(labels, "node", "left").select("same", F.coalesce("label", "node").alias("label"), "n", "doc_id", "tag")
        named = self.tables.write(named, "near-named")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
        groups = named.groupBy("label").agg(first.alias("first"), F.sum("n").alias("class_size"))
        groups = groups.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.tag").alias("class_tag"), "class_size")
        found = self.tables.write(named.select("same", "label").join(groups, "label").drop("label"), "near-classes")
        self.tables.drop(named, labels, self.nodes)
        return self.rows.select("doc_id", "tag", "same").join(found, "same").drop("same")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row of docs: doc_id, class_id, class_size."""
    return NearDuplicates(docs, least).classes().select("doc_id", "class_id", "class_size")


def kept_rows(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that represent their classes, with all their columns."""
    gone = NearDuplicates(docs, least).classes().filter("tag <> class_tag").select(F.col("tag").alias("gone"))
    gone = written(gone.distinct(), "near-gone")
    name = free_name(docs, "tag")
    few = gone.limit(FEW + 1).count() <= FEW
    tagged = docs.withColumn(name, tag_of(docs))
    return tagged.join(F.broadcast(gone) if few else gone, F.col(name) == F.col("gone"), "left_anti").drop(name)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents over whole texts."""
    return near_classes(table(spark, sf_dir, "documents"))
