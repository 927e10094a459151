"""Exact deduplication by a log-structured merge index over digests, in DataFrame operations only.

Each task sorts its rows by digest and flushes them as one immutable run (level 0) with a Bloom filter on the digest.
Compaction merges the runs into level 1: one row per digest, with the identifier that stays and the group's size.
Rows that hit a digest seen elsewhere are compared byte by byte with the row that stays; rows that only share the digest
are grouped again by their text.

Defined cases: a null text is the empty text; all empty texts are one group; of equal texts the longest original stays,
then the smallest identifier (null last), then the row written first, so exactly one of repeated rows stays; very long texts are read and compared whole;
an empty table gives an empty result; columns beyond identifier and text are ignored or, in `kept_rows`, passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WHITE = r"[\x20\x09-\x0D]+"
#: Digests of groups that may be broadcast (16 bytes each in the hash table); more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Copies that are compared with the row that stays in one task.
SPLIT = 4096
#: Numbers of dropped rows that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    """Text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


class DigestIndex:
    """Runs of (digest, identifier, record) and their compacted level."""

    def __init__(self, spark: SparkSession, digest: Callable[[Column], Column] | None = None):
        self.spark, self.digest = spark, digest or (lambda sha: sha)
        self.runs: list[DataFrame] = []

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
        """Flushes docs as sorted runs, one a task. With payload the runs also keep the whole rows."""
        rows = docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("body"),
            *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")] if payload else []),
        )
        rows = rows.withColumn("sha", F.sha2(normalised(F.col("body")).cast("binary"), 256)).withColumn("size", F.char_length("body").cast("long"))
        rows = rows.withColumn("digest", self.digest(F.col("sha"))).withColumn("seq", F.monotonically_increasing_id() + F.lit(len(self.runs)) * F.lit(1 << 56))
        if payload:
            rows = rows.drop("body")
        run = written(
            rows.sortWithinPartitions("digest", "id"),
            "lsm-run",
            {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "100000"},
        )
        self.payload, self.text_col = payload, text_col
        self.runs.append(run)
        return run

    def level0(self) -> DataFrame:
        rows = self.runs[0]
        for run in self.runs[1:]:
            rows = rows.unionByName(run)
        return rows.withColumn("body", F.coalesce(F.col("record")[self.text_col], F.lit(""))) if self.payload else rows

    def probe(self, digests: list[str]) -> DataFrame:
        """Rows of the runs with one of a few digests; row groups without them are skipped by the filters."""
        return self.level0().filter(F.col("digest").isin(digests))

    def compact(self) -> DataFrame:
        """One row per digest: what stays (longest, then smallest identifier) and how many rows share it."""
        rank = F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("seq"))
        level1 = self.level0().groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
        return written(level1.select("digest", F.col("best.id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), "n"), "lsm-level1")

    def impostors(self, level1: DataFrame) -> DataFrame:
        """Rows whose digest is that of the row that stays, but not their bytes."""
        shared = level1.filter("n > 1").select("digest", "keep_seq", F.ceil(F.col("n") / SPLIT).alias("parts"))
        few = shared.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
        hits = self.level0().select("digest", "seq", "body").join(F.broadcast(shared) if few else shared, "digest")
        # the text that stays goes once to each SPLIT of its copies, so that a text which a third of all rows share is many tasks
        stays = hits.filter("seq = keep_seq").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), normalised(F.col("body")).alias("kept_bytes"))
        rest = hits.filter("seq <> keep_seq").select("digest", F.pmod(F.xxhash64("seq"), "parts").alias("part"), "seq", normalised(F.col("body")).alias("bytes"))
        return written(rest.join(stays, ["digest", "part"]).filter("bytes <> kept_bytes").select("digest", "seq", "bytes"), "lsm-impostors")

    def resolve(self) -> DataFrame:
        """Per row: seq, id, sha, keep_id, keep_seq, group_size."""
        level1 = self.compact()
        rows = self.level0().select("seq", "id", "sha", "size", "digest")
        wrong = self.impostors(level1)
        if wrong.isEmpty():
            return rows.join(level1, "digest").select("seq", "id", "sha", "keep_id", "keep_seq", F.col("n").alias("group_size"))
        moved = rows.join(wrong.select("seq", "bytes"), "seq")
        rank = F.struct((-F.col("size")).alias("size"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("seq"))
        again = moved.groupBy("digest", "bytes").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
        fixed = moved.join(again, ["digest", "bytes"]).select("seq", "id", "sha", F.col("best.id").alias("keep_id"), F.col("best.seq").alias("keep_seq"), F.col("n").alias("group_size"))
        lost = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        right = rows.join(wrong.select("seq"), "seq", "left_anti").join(level1.join(lost, "digest", "left"), "digest")
        right = right.select("seq", "id", "sha", "keep_id", "keep_seq", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"))
        return right.unionByName(fixed)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. See the module for the rules."""
    index = DigestIndex(docs.sparkSession, digest)
    index.insert(docs, id_col, text_col)
    return index.resolve().select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    index = DigestIndex(docs.sparkSession)
    index.insert(docs, id_col, text_col, payload=True)
    gone = written(index.resolve().filter("seq <> keep_seq").select("seq"), "lsm-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # so whole rows needn't be shuffled
    return index.runs[0].join(F.broadcast(gone) if few else gone, "seq", "left_anti").select("record.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of `documents`."""
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(body), doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN k USING (norm)"""
}
