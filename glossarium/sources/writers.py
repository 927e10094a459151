"""Writers of corpus files: annotations by file, reports, lexicons and manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def snapped(intervals: DataFrame, by: Sequence[str] = ("path", "speaker", "kind"), shift: float = 0.01) -> DataFrame:
    """The last interval of each tier ends with the file if it nearly does; an interval that begins before the one before ends begins there (K1)."""
    w = Window.partitionBy(*by).orderBy("begin", "end")
    last = F.lead("begin").over(w).isNull() & (F.col("duration") - F.col("end") <= 2 * shift)
    begin = F.greatest("begin", F.coalesce(F.lag("end").over(w), F.col("begin")))
    return intervals.withColumn("_begin", begin).withColumn("end", F.when(last, F.col("duration")).otherwise(F.col("end"))).withColumn("begin", F.col("_begin")).drop("_begin")


def textgrid(tiers: Sequence[tuple[str, Sequence[tuple[float, float, str]]]], duration: float, short: bool = False) -> str:
    """A TextGrid; gaps become empty intervals."""
    n = lambda x: repr(round(float(x), 6))
    q = lambda s: '"' + s.replace('"', '""') + '"'
    head = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n'
    out = head + (f"0\n{n(duration)}\n<exists>\n{len(tiers)}\n" if short else f"xmin = 0\nxmax = {n(duration)}\ntiers? <exists>\nsize = {len(tiers)}\nitem []:\n")
    for k, (name, rows) in enumerate(tiers, 1):
        full, at = [], 0.0
        for a, b, label in rows:
            if a - at > 1e-6:
                full.append((at, a, ""))
            full.append((a, b, label))
            at = b
        if duration - at > 1e-6:
            full.append((at, duration, ""))
        if short:
            out += f'"IntervalTier"\n{q(name)}\n0\n{n(duration)}\n{len(full)}\n' + "".join(f"{n(a)}\n{n(b)}\n{q(x)}\n" for a, b, x in full)
        else:
            out += f'    item [{k}]:\n        class = "IntervalTier"\n        name = {q(name)}\n        xmin = 0\n        xmax = {n(duration)}\n        intervals: size = {len(full)}\n'
            out += "".join(f"        intervals [{i}]:\n            xmin = {n(a)}\n            xmax = {n(b)}\n            text = {q(x)}\n" for i, (a, b, x) in enumerate(full, 1))
    return out


def textgrids(intervals: DataFrame, short: bool = False) -> DataFrame:
    """(path, body): one TextGrid for each file's intervals (K1, K2). A group is one file."""
    ship(intervals.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiers = [(f"{s} - {k}" if k != "utterances" else s, list(g.sort_values(["begin", "end"])[["begin", "end", "label"]].itertuples(index=False, name=None))) for (s, k), g in pdf.groupby(["speaker", "kind"], sort=True)]
        return pd.DataFrame({"path": [pdf.path.iloc[0]], "body": [textgrid(tiers, pdf.duration.max(), short)]})

    return snapped(intervals).select("path", "speaker", "kind", "begin", "end", "label", "duration").groupBy("path").applyInPandas(run, "path string, body string")


def saved(df: DataFrame, folder: str) -> int:
    """Writes each (name, body) as a file of a shared folder, in tasks, and counts them; a task that is run again writes the same files (K1, K2)."""

    def run(batches: Iterator) -> Iterator:
        import re

        import pyarrow as pa
        from pyarrow import fs

        local = re.match(r"^(?:file:/*)?(?=/)|^file:/+", folder)
        system, root = (fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", folder).lstrip("/")) if local else fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                system.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(body.encode() if isinstance(body, str) else body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return df.select("name", "body").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Rows of a report that one task writes.
ONE_FILE = 100_000


def report(df: DataFrame, path: str, order: Sequence[Column | str]) -> None:
    """A sorted csv (K3, K4, K5, K9): one file if its rows are few, else files of ranges in order."""
    rows = df.orderBy(*order)
    few = df.limit(ONE_FILE + 1).count() <= ONE_FILE
    (rows.coalesce(1) if few else rows).write.mode("overwrite").csv(path, header=True)


def alignment_report(df: DataFrame, path: str) -> None:
    """Worst deviations first, missing ones before all (K3)."""
    report(df, path, [F.col("duration_deviation").desc_nulls_first(), "file"])


def lexicon_lines(pronunciations: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Word, the given numbers and phones, tab-separated (K6)."""
    return pronunciations.select(F.concat_ws("\t", "word", *[F.format_number(c, 2) for c in columns], "pronunciation").alias("value"))


def oov_reports(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (utterance, word): words found, their counts, and each utterance's words (K7)."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    by = words.groupBy("utterance").agg(F.concat_ws(", ", F.sort_array(F.collect_set("word"))).alias("words"))
    line = lambda df, *c: df.select(F.concat_ws("\t", *c).alias("value"))
    return counts.orderBy(F.desc("n"), "word").select(F.col("word").alias("value")), line(counts.orderBy(F.desc("n"), "word"), "word", F.col("n").cast("string")), line(by.orderBy("utterance"), "utterance", "words")


def scp_lines(df: DataFrame, blank: str = "_SPACE_") -> DataFrame:
    """Key and values of each line, by key, with a sign for blanks inside them (K8)."""
    safe = lambda c: F.replace(c, F.lit(" "), F.lit(blank))
    return df.orderBy("key").select(F.concat_ws(" ", safe(F.col("key")), F.array_join(F.transform("values", safe), " ")).alias("value"))


def manifest(df: DataFrame, path: str, header: Sequence[str], done: DataFrame | None = None, key: str = "sample_key") -> None:
    """A csv with a fixed header; rows that have an output already are marked as skipped (K9, T5)."""
    if done is not None:
        df = df.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_done"), "skipped_existing").otherwise(F.col("status"))).drop("_done")
    df.select(*header).write.mode("overwrite").csv(path, header=True)


def jsonl(df: DataFrame, path: str) -> None:
    """Objects, one a line."""
    df.write.mode("overwrite").json(path)


def appended(df: DataFrame, path: str) -> None:
    """A bulk load."""
    df.write.mode("append").parquet(path)


def versioned(df: DataFrame, path: str, version: int, key: str) -> DataFrame:
    """Adds rows whose key this version of a cache doesn't have, and returns those."""
    from pyspark.errors import AnalysisException

    try:
        have = df.sparkSession.read.parquet(path).filter(F.col("version") == version).select(key)
        new = df.join(have.distinct(), key, "left_anti")
    except AnalysisException:
        new = df
    new.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(path)
    return new


def batches(rows: Iterator, size: int = 1000) -> Iterator[list]:
    """A local iterator in batches, as of a server-side cursor (T4)."""
    block = []
    for r in rows:
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
