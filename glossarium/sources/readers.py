"""Readers of speech-corpus files. Files are scanned by Spark itself, so any store that it reads will do; a file that must be parsed as a whole is parsed in its task."""

from __future__ import annotations

import ast
import io
import math
import re
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import numbers as N
from ..functions import text as X
from ..session import ship

#: Extensions of sound files besides wav.
SOUNDS = ("flac", "mp3", "ogg", "opus", "aiff", "au", "m4a", "sph", "wav")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, stem, extension, length) of all files below a folder, hidden ones apart."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(~F.col("name").startswith("."))
    return f.withColumn("stem", X.stem("path")).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder and stem with its sound, transcript and annotation; a .lab file goes before a .txt file."""
    f = files(spark, root).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    pick = lambda c: F.max(F.when(c, F.col("path")))
    e = F.col("extension")
    g = f.groupBy("folder", "stem").agg(
        pick(e == "wav").alias("wav"), pick(e.isin(*SOUNDS) & (e != "wav")).alias("other"), pick(e == "lab").alias("lab"), pick(e == "txt").alias("txt"), pick(e == "textgrid").alias("textgrid")
    )
    return g.select("folder", "stem", F.coalesce("wav", "other").alias("sound"), F.coalesce("lab", "txt").alias("text"), "textgrid").filter("sound IS NOT NULL OR text IS NOT NULL OR textgrid IS NOT NULL")


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, body) with a file in a row."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def transcripts(spark: SparkSession, path: str, durations: DataFrame | None = None) -> DataFrame:
    """One utterance a file from 0 to its duration, -1 without a sound (S3). durations: (stem, duration)."""
    t = whole_texts(spark, path, "*.{lab,txt}").select(X.stem("path").alias("stem"), F.btrim(X.nfkc("body"), F.lit(" \t\r\n")).alias("text"))
    if durations is None:
        return t.withColumn("begin", F.lit(0.0)).withColumn("end", F.lit(-1.0))
    return t.join(durations, "stem", "left").select("stem", "text", F.lit(0.0).alias("begin"), F.coalesce("duration", F.lit(-1.0)).alias("end"))


def parsed(df: DataFrame, parse: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that `parse(path, body)` makes of each file."""
    ship(df.sparkSession)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([row for p, b in zip(f.path, f.body) for row in parse(p, b)], columns=names)

    return df.mapInPandas(run, schema)


def textgrid_tiers(body: str) -> tuple[float, list[tuple[str, list[tuple[float, float, str]]]]]:
    """End time, and the interval tiers of a TextGrid, in the long or the short layout."""
    values = [q[1:-1].replace('""', '"') if q.startswith('"') else float(q) for q in re.findall(r'"(?:[^"]|"")*"|(?<![\w\[])-?\d+(?:\.\d+)?(?:[eE]-?\d+)?(?![\w\]])', body.lstrip("﻿"))]
    if not values or values[0] != "ooTextFile":
        raise ValueError("not a TextGrid")
    numbers, end, tiers = iter(values[2:]), 0.0, []
    next(numbers)
    end = next(numbers)
    for _ in range(int(next(numbers))):
        kind, name = next(numbers), next(numbers)
        next(numbers), next(numbers)
        rows = []
        for _ in range(int(next(numbers))):
            if kind == "IntervalTier":
                rows.append((next(numbers), next(numbers), next(numbers)))
            else:
                at, label = next(numbers), next(numbers)
                rows.append((at, at, label))
        if kind == "IntervalTier":
            tiers.append((name, rows))
    return end, tiers


def _tiers_or_error(body: str) -> tuple[float, list[tuple[str, list[tuple[float, float, str]]]], str | None]:
    """textgrid_tiers(), and what is wrong with a body that is none."""
    try:
        end, tiers = textgrid_tiers(body)
        for _, rows in tiers:
            for begin, stop, label in rows:
                if not (isinstance(begin, float) and isinstance(stop, float) and isinstance(label, str)):
                    return 0.0, [], f"no interval: {begin!r}, {stop!r}, {label!r}"
        return end, tiers, None
    except StopIteration:
        return 0.0, [], "it ends too early"
    except (ValueError, TypeError) as e:
        return 0.0, [], str(e)


def _textgrid(phones_only: bool = False) -> Callable[[str, str], Iterator[tuple]]:
    def parse(path: str, body: str) -> Iterator[tuple]:
        duration, tiers, _ = _tiers_or_error(body)
        for k, (name, rows) in enumerate(tiers):
            if name.strip().lower() == "notes" or phones_only and "phones" not in name:
                continue
            m = re.match(r"(.*?)(?: - (phones|words))?$", name.strip())
            for begin, end, label in rows:
                begin, end, label = round(begin, 4), round(min(end, duration), 4), label.strip()
                if label and begin < duration and not (phones_only and end - begin < 0.01):
                    yield path, m[1], m[2] or "utterances", k, begin, end, label, duration

    return parse


INTERVALS = "path string, speaker string, kind string, tier long, begin double, end double, label string, duration double"


def textgrids(spark: SparkSession, path: str, phones_only: bool = False) -> DataFrame:
    """One row per labelled interval (S4); reference phones drop those under 10 ms and other tiers (S5). Files that can't be read have none: malformed_textgrids() names them."""
    return parsed(whole_texts(spark, path, "*.TextGrid"), _textgrid(phones_only), INTERVALS)


def malformed_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that textgrids() leaves out; the engine's text reader doesn't see files without a byte."""

    def parse(path: str, body: str) -> Iterator[tuple]:
        *_, error = _tiers_or_error(body)
        if error is not None:
            yield path, error

    return parsed(whole_texts(spark, path, "*.TextGrid"), parse, "path string, error string")


def with_channels(intervals: DataFrame, channels: DataFrame) -> DataFrame:
    """Tiers in the second half of a file with two channels are on channel 1 (S4). channels: (path, channels)."""
    n = intervals.groupBy("path").agg((F.max("tier") + 1).alias("_n"))
    j = intervals.join(n, "path").join(channels, "path", "left")
    return j.withColumn("channel", F.when((F.coalesce("channels", F.lit(1)) > 1) & (F.col("tier") >= F.col("_n") / 2), 1).otherwise(0)).drop("_n", "channels")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files, blank lines apart."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line")).filter("line <> ''")


def ctm(spark: SparkSession, path: str) -> DataFrame:
    """utterance, channel, begin, duration, label and confidence of each line."""
    p = F.split("line", r"\s+")
    return lines(spark, path).select(p[0].alias("utterance"), p[1].alias("channel"), p[2].cast("double").alias("begin"), p[3].cast("double").alias("duration"), p[4].alias("label"), F.try_element_at(p, F.lit(6)).try_cast("double").alias("confidence"))


def scp(spark: SparkSession, path: str, blank: str = "_SPACE_") -> DataFrame:
    """Key and values of each line; brackets go, and the sign for a blank inside a value becomes one."""
    p = F.filter(F.split(F.regexp_replace("line", r"[\[\]]", " "), r"\s+"), lambda x: x != "")
    clean = F.transform(p, lambda x: F.replace(x, F.lit(blank), F.lit(" ")))
    return lines(spark, path).select(clean[0].alias("key"), F.slice(clean, F.lit(2), F.size(clean) - 1).alias("values"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, up to four leading numbers, phones, and what is wrong with a line."""
    number = r"(?:\d+\.\d+|1)"
    rest = F.regexp_replace("line", r"^\S+\s*", "")
    lead = F.regexp_extract(rest, rf"^((?:{number}\s+){{0,4}})", 1)
    numbers = F.filter(F.split(lead, r"\s+"), lambda x: x != "")
    phones = F.filter(F.split(F.substr(rest, F.length(lead) + 1), r"\s+"), lambda x: x != "")
    at = lambda i: F.try_element_at(numbers, F.lit(i)).cast("double")
    t = lines(spark, path).withColumn("line", X.nfkc("line"))
    return t.select(
        F.regexp_extract("line", r"^(\S+)", 1).alias("word"), at(1).alias("probability"), at(2).alias("silence_after"), at(3).alias("silence_before"), at(4).alias("non_silence_before"),
        phones.alias("phones"), F.when(F.size(phones) == 0, F.concat(F.lit("no phones: "), "line")).alias("error"),
    )


def lexicon_tables(entries: DataFrame, specials: Sequence[str] = ("<eps>", "[bracketed]", "<unk>")) -> tuple[DataFrame, DataFrame]:
    """Words (word_id, word, word_type) and pronunciations (pronunciation_id, word_id, pronunciation, probability), numbered in a total order."""
    from ..operators.relational import numbered

    good = entries.filter("error IS NULL")
    spark = entries.sparkSession
    special = spark.createDataFrame([(w, i) for i, w in enumerate(specials)], "word string, place long")
    words = good.select("word").distinct().join(special, "word", "left_anti").withColumn("place", F.lit(len(specials)).cast("long")).unionByName(special)
    words = numbered(words, ["place", "word"], "word_id").select((F.col("word_id") - 1).alias("word_id"), "word", F.when(F.col("place") < len(specials), "special").otherwise("speech").alias("word_type"))
    p = good.select("word", F.array_join("phones", " ").alias("pronunciation"), "probability").groupBy("word", "pronunciation").agg(F.max("probability").alias("probability"))
    p = numbered(p.join(words, "word"), ["word_id", "pronunciation"], "pronunciation_id")
    return words, p.select("pronunciation_id", "word_id", "pronunciation", "probability")


def arpa(spark: SparkSession, path: str) -> DataFrame:
    """n, words, probability and backoff (not as logarithms) of each n-gram."""

    def parse(_: str, body: str) -> Iterator[tuple]:
        n = 0
        for line in body.splitlines():
            if m := re.match(r"\\(\d+)-grams:", line):
                n = int(m[1])
            elif line.startswith("\\"):
                n = 0
            elif n and line.strip():
                parts = line.split()
                yield n, " ".join(parts[1 : n + 1]), 10 ** float(parts[0]), 10 ** float(parts[n + 1]) if len(parts) > n + 1 else None

    return parsed(whole_texts(spark, path), parse, "n long, words string, probability double, backoff double")


def backoff_probability(model: Mapping[str, tuple[float, float | None]], words: Sequence[str]) -> float:
    """Probability of the last word after the others, by shorter histories where an n-gram is missing (M4)."""
    words, weight = list(words), 1.0
    while words:
        if (hit := model.get(" ".join(words))) is not None:
            return weight * hit[0]
        if len(words) > 1 and (history := model.get(" ".join(words[:-1]))) is not None and history[1] is not None:
            weight *= history[1]
        words = words[1:]
    return 0.0


def yaml_rules(spark: SparkSession, document: Mapping, dialects: Sequence[str]) -> DataFrame:
    """Rules for all dialects and those of one, a row for each dialect and rule."""
    rows = [(d, r.get("segment", ""), r.get("preceding_context", ""), r.get("following_context", ""), r.get("replacement", "")) for d in dialects for r in [*document.get("rules", []), *document.get("dialects", {}).get(d, [])]]
    return spark.createDataFrame(rows, "dialect string, segment string, preceding_context string, following_context string, replacement string").distinct()


def phone_mapping(spark: SparkSession, document: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """(phone, mapped) with a row for each target."""
    return spark.createDataFrame([(k, x) for k, v in document.items() for x in ([v] if isinstance(v, str) else sorted(v))], "phone string, mapped string")


def manifest(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """A csv with a header, all text; a byte-order mark and blanks in the names go."""
    df = spark.read.csv(path, header=True, sep=separator, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def manifests(spark: SparkSession, paths: Sequence[str], needs: str | None = None) -> DataFrame:
    """Several manifests below each other, those without a needed column apart."""
    from functools import reduce

    frames = [m for m in (manifest(spark, p) for p in paths) if needs is None or needs in m.columns]
    if not frames:
        raise ValueError(f"no manifest has {needs}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def utterance_manifest(spark: SparkSession, splits: Mapping[str, str]) -> DataFrame:
    """Utterances of split files in the given order: cleaned text, key, seconds, and a running number over all files."""
    from functools import reduce

    from ..operators.relational import numbered

    def one(k: int, name: str, path: str) -> DataFrame:
        m = manifest(spark, path)
        seconds = N.seconds("EndTime") - N.seconds("StartTime")
        return m.select(
            F.lit(k).alias("place"), F.lit(name).alias("split"), F.col("Dialogue_ID").cast("long").alias("dialogue"), F.col("Utterance_ID").cast("long").alias("utterance"), F.trim(X.sanitised("Utterance")).alias("text"), F.col("Emotion").alias("emotion"),
            F.when(seconds > 0, F.array(F.round(seconds, 3))).alias("target_seconds"),
        )

    all_ = reduce(lambda a, b: a.unionByName(b), [one(k, n, p) for k, (n, p) in enumerate(splits.items())]).filter("text <> ''")
    all_ = all_.withColumn("sample_key", F.format_string("%s_dia%s_utt%s", "split", F.col("dialogue").cast("string"), F.col("utterance").cast("string")))
    return numbered(all_, ["place", "dialogue", "utterance", "text"], "global_idx").withColumn("global_idx", F.col("global_idx") - 1).drop("place")


@F.pandas_udf(ArrayType(StringType()))
def list_cell(cell: pd.Series) -> pd.Series:
    """A list as Python writes it; null for anything else (S15, strict)."""
    import ast as a

    def one(c):
        try:
            v = a.literal_eval(c)
            return [str(x) for x in v] if isinstance(v, (list, tuple)) else None
        except (ValueError, SyntaxError, TypeError):
            return None

    return cell.map(one)


def list_or_text(cell: str) -> list[str]:
    """The lenient reading: what is no list is one text."""
    try:
        v = ast.literal_eval(cell)
        return [str(x) for x in v] if isinstance(v, (list, tuple)) else [cell]
    except (ValueError, SyntaxError):
        return [cell]


def dialog_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Dialogs with lists in their cells; rows whose lists don't match go, durations are there for all utterances or none."""
    m = manifest(spark, path)
    d = m.select(F.col("Dialogue_ID").cast("long").alias("dialogue"), list_cell("Utterances").alias("utterances"), list_cell("Emotions").alias("emotions"), list_cell("Start_Time").alias("starts"), list_cell("End_Time").alias("ends"))
    d = d.filter("size(utterances) > 0 AND size(utterances) = size(emotions)")
    seconds = F.zip_with("starts", "ends", lambda a, b: F.round(N.seconds(b) - N.seconds(a), 3))
    ok = (F.size(seconds) == F.size("utterances")) & F.forall(seconds, lambda s: F.coalesce(s > 0, F.lit(False)))
    return d.select("dialogue", "utterances", "emotions", F.when(ok, seconds).alias("target_seconds"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one list of objects."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=True)


def tsv_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Speaker (the file's name), key and text of lines with two columns at least."""
    p = F.split("line", "\t")
    return lines(spark, path).filter(F.size(p) >= 2).select(X.stem("path").alias("speaker"), p[0].alias("key"), p[1].alias("text"))


def sound_header(data: bytes) -> tuple[str, int, float, int] | None:
    """Format, rate, seconds and channels of PCM sound."""
    import wave

    try:
        with wave.open(io.BytesIO(data)) as w:
            return "WAV", w.getframerate(), w.getnframes() / w.getframerate(), w.getnchannels()
    except (wave.Error, EOFError, struct.error, ZeroDivisionError):
        return None


def sounds(spark: SparkSession, root: str) -> DataFrame:
    """path, format, sample_rate, duration, channels; nulls where a file can't be read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root).select("path", "content")
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *(sound_header(c) or (None, None, math.nan, None))) for p, c in zip(f.path, f.content)], columns=["path", "format", "sample_rate", "duration", "channels"]).astype({"sample_rate": "Int64", "channels": "Int64"})

    return b.mapInPandas(run, "path string, format string, sample_rate long, duration double, channels long")


def candidates(df: DataFrame, checks: Sequence, example: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass an ordered list of checks, and the tally of the others, the most frequent reason first."""
    from ..operators.relational import reject_reason, reject_tally

    marked = df.withColumn("reason", reject_reason(checks))
    return marked.filter("reason IS NULL").drop("reason"), reject_tally(marked, "reason", example).orderBy(F.desc("n"), "reason")
