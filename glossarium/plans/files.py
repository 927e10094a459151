"""Files of every kind: written from the stored tables to the shared folder, read back, and held against the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import statistics as S
from ..session import new_folder, table
from ..sources import readers as R
from ..sources import writers as W
from .base import plan


def _bodies(spark: SparkSession, df: DataFrame, name: str) -> str:
    """The folder of the files (name, body)."""
    folder = new_folder(spark, name)
    W.saved(df, folder)
    return folder


def _lines(spark: SparkSession, df: DataFrame, name: str) -> str:
    folder = new_folder(spark, name)
    df.write.text(folder)
    return folder


#: A file for each nation and thousand of keys, so that no file grows with the table.
NATION_FILE = "concat('n', c_nationkey, 'b', c_custkey div 1000)"


def _grids(spark: SparkSession, sf: str) -> str:
    """A TextGrid for each nation's customers of a thousand keys: they are the intervals, a speaker for each segment, every tenth one 5 ms long."""
    c = table(spark, sf, "customer").withColumn("begin", F.col("c_custkey").cast("double")).withColumn("path", F.expr(NATION_FILE))
    ends = c.groupBy("path").agg((F.max("begin") + 1).alias("duration"))
    rows = c.join(ends, "path").select(
        "path", F.col("c_mktsegment").alias("speaker"), F.when(F.col("c_custkey") % 2 == 0, "words").otherwise("phones").alias("kind"), "begin",
        (F.col("begin") + F.when(F.col("c_custkey") % 5 == 0, 0.005).otherwise(0.5)).alias("end"), F.col("c_name").alias("label"), "duration",
    )
    return _bodies(spark, W.textgrids(rows).select(F.concat("path", F.lit(".TextGrid")).alias("name"), "body"), "textgrids")


GRIDS = """
SELECT 'n' || c_nationkey || 'b' || c_custkey // 1000 AS file, c_mktsegment AS speaker, CASE WHEN c_custkey % 2 = 0 THEN 'words' ELSE 'phones' END AS kind, CAST(c_custkey AS DOUBLE) AS start,
  CAST(c_custkey AS DOUBLE) + CASE WHEN c_custkey % 5 = 0 THEN 0.005 ELSE 0.5 END AS stop, c_name AS label, max(CAST(c_custkey AS DOUBLE)) OVER (PARTITION BY c_nationkey, c_custkey // 1000) + 1 AS duration
FROM customer"""


@plan("S4 K1", f"SELECT file, speaker, kind, start, round(stop, 4) AS stop, label, duration FROM ({GRIDS})")
def textgrid_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals written as annotation files, and read again."""
    g = R.textgrids(spark, _grids(spark, sf))
    return g.select(X.stem("path").alias("file"), "speaker", "kind", F.col("begin").alias("start"), F.col("end").alias("stop"), "label", "duration")


@plan("S5", f"SELECT file, speaker, start, stop, label FROM ({GRIDS}) WHERE kind = 'phones' AND stop - start > 0.01")
def textgrid_reference_phones(spark, sf):
    """Phone tiers only, and no phone below 10 ms."""
    g = R.textgrids(spark, _grids(spark, sf), phones_only=True)
    return g.select(X.stem("path").alias("file"), "speaker", F.col("begin").alias("start"), F.col("end").alias("stop"), "label")


@plan(
    "S1 S2",
    """
SELECT 's' || s_suppkey AS stem, CASE WHEN s_suppkey % 2 = 0 THEN 'lab' WHEN s_suppkey % 3 = 0 THEN 'txt' END AS text_kind, s_suppkey % 7 = 0 AS has_sound, s_suppkey % 5 = 0 AS has_grid
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 7 = 0""",
)
def corpus_files(spark, sf):
    """Files of a folder by stem: sound, transcript (.lab before .txt) and annotation; hidden files don't count."""
    kinds = [("s", ".lab", 2), ("s", ".txt", 3), ("s", ".TextGrid", 5), ("s", ".wav", 7), (".s", ".lab", 1)]
    names = F.array(*[F.when(F.col("s_suppkey") % n == 0, F.concat(F.lit(a), "s_suppkey", F.lit(b))) for a, b, n in kinds])
    rows = table(spark, sf, "supplier").select(F.explode(F.array_compact(names)).alias("name"), F.lit("x").alias("body"))
    c = R.corpus(spark, _bodies(spark, rows, "corpus"))
    return c.select("stem", F.regexp_extract("text", r"\.([a-z]+)$", 1).alias("text_kind"), F.col("sound").isNotNull().alias("has_sound"), F.col("textgrid").isNotNull().alias("has_grid"))


@plan("S3 K2", "SELECT 's' || s_suppkey AS stem, s_name || ' fine' AS text, CAST(0 AS DOUBLE) AS start, CASE WHEN s_suppkey % 3 = 0 THEN -1.0 ELSE s_acctbal END AS stop FROM supplier")
def transcripts_with_durations(spark, sf):
    """A transcript a file in normal form, from 0 to its sound's duration, -1 where there is none."""
    s = table(spark, sf, "supplier").withColumn("stem", F.concat(F.lit("s"), "s_suppkey"))
    folder = _bodies(spark, s.select(F.concat("stem", F.lit(".lab")).alias("name"), F.concat("s_name", F.lit(" ﬁne\n")).alias("body")), "transcripts")
    t = R.transcripts(spark, folder, s.filter("s_suppkey % 3 <> 0").select("stem", F.col("s_acctbal").alias("duration")))
    return t.select("stem", "text", F.col("begin").alias("start"), F.col("end").alias("stop"))


@plan(
    "S6",
    """
SELECT l_orderkey || '-' || l_linenumber AS utterance, '1' AS channel, l_quantity AS start, l_discount AS duration, l_returnflag AS label, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS confidence
FROM lineitem""",
)
def ctm_lines(spark, sf):
    """Time-marked labels, a line each, with and without a confidence."""
    some = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("string"))
    line = F.concat_ws(" ", F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("1"), "l_quantity", "l_discount", "l_returnflag", some)
    c = R.ctm(spark, _lines(spark, table(spark, sf, "lineitem").select(line), "ctm"))
    return c.select("utterance", "channel", F.col("begin").alias("start"), "duration", "label", "confidence")


@plan("S7 K8", "SELECT c_mktsegment || ' ' || c_custkey AS key, c_nationkey || '|the ' || c_name AS items FROM customer")
def scp_round_trip(spark, sf):
    """Keys and values with blanks inside, a line each."""
    c = table(spark, sf, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("key"), F.array(F.col("c_nationkey").cast("string"), F.concat(F.lit("the "), "c_name")).alias("values"))
    return R.scp(spark, _lines(spark, W.scp_lines(c), "scp")).select("key", F.array_join("values", "|").alias("items"))


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat(F.lit("w"), F.col("p_partkey") % 500).alias("word"), F.concat_ws(" ", F.lower("p_type"), "p_name").alias("pronunciation"), (F.col("p_size") / 100).alias("probability"))
    return R.lexicon(spark, _lines(spark, W.lexicon_lines(p, ["probability"]), "lexicon"))


LEXICON = "SELECT 'w' || (p_partkey % 500) AS word, lower(p_type) || ' ' || p_name AS pronunciation, CAST(printf('%.2f', p_size / 100.0) AS DOUBLE) AS probability FROM part"


@plan("S8 K6", LEXICON)
def lexicon_round_trip(spark, sf):
    """A pronunciation dictionary with probabilities."""
    return _lexicon(spark, sf).filter("error IS NULL").select("word", F.array_join("phones", " ").alias("pronunciation"), "probability")


@plan(
    "S9 K13",
    f"""
WITH l AS ({LEXICON}), w AS (SELECT DISTINCT word, 3 AS place FROM l UNION ALL VALUES ('<eps>', 0), ('[bracketed]', 1), ('<unk>', 2)),
n AS (SELECT word, row_number() OVER (ORDER BY place, word) - 1 AS word_id FROM w), p AS (SELECT word, pronunciation, max(probability) AS probability FROM l GROUP BY ALL)
SELECT row_number() OVER (ORDER BY word_id, pronunciation) AS pronunciation_id, word_id, word, pronunciation, probability FROM p JOIN n USING (word)""",
)
def lexicon_tables(spark, sf):
    """The dictionary as tables of words and pronunciations with running numbers."""
    words, pronunciations = R.lexicon_tables(_lexicon(spark, sf))
    return pronunciations.join(words.select("word_id", "word"), "word_id").select("pronunciation_id", "word_id", "word", "pronunciation", "probability")


def _arpa(spark: SparkSession, sf: str) -> DataFrame:
    """A model over nations: each after the one before it, for every second one."""
    names = [r.n_name for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]  # 25 rows at any size
    body = "\\data\\\n\n\\1-grams:\n" + "".join(f"-{(i + 1) / 8} {n} -{(i % 5) / 4}\n" for i, n in enumerate(names))
    body += "\n\\2-grams:\n" + "".join(f"-0.25 {a} {b}\n" for i, (a, b) in enumerate(zip(names, names[1:])) if i % 2 == 0) + "\n\\end\\\n"
    return R.arpa(spark, _bodies(spark, spark.createDataFrame([("model.arpa", body)], "name string, body string"), "arpa"))


ARPA = """
WITH u AS (SELECT n_nationkey AS k, n_name AS w, pow(10, -(n_nationkey + 1) / 8.0) AS p, pow(10, -(n_nationkey % 5) / 4.0) AS b FROM nation),
g AS (SELECT 1 AS n, w AS words, p AS probability, b AS backoff FROM u UNION ALL SELECT 2, x.w || ' ' || y.w, pow(10, -0.25), NULL FROM u x JOIN u y ON y.k = x.k + 1 WHERE x.k % 2 = 0)"""


@plan("S10", ARPA + "SELECT CAST(n AS BIGINT) AS n, words, round(probability, 9) AS probability, round(backoff, 9) AS backoff FROM g")
def arpa_ngrams(spark, sf):
    """A language model's n-grams."""
    return _arpa(spark, sf).select("n", "words", F.round("probability", 9).alias("probability"), F.round("backoff", 9).alias("backoff"))


@plan(
    "M4",
    ARPA + "SELECT x.w AS history, y.w AS word, round(coalesce(g.probability, x.b * y.p), 9) AS probability FROM u x CROSS JOIN u y LEFT JOIN g ON g.words = x.w || ' ' || y.w AND g.n = 2",
)
def arpa_bigram_scores(spark, sf):
    """Every pair of words by its bigram, or by the history's backoff and the word alone."""
    n = table(spark, sf, "nation")
    pairs = n.select(F.col("n_name").alias("history")).crossJoin(F.broadcast(n.select(F.col("n_name").alias("word"))))  # 25 rows each at any size
    return S.bigram_scores(_arpa(spark, sf), pairs).withColumn("probability", F.round("probability", 9))


def _names(spark: SparkSession, sf: str) -> list:
    """(region, nation), 25 rows at any size."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return sorted((x.r_name, x.n_name) for x in n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name").collect())


@plan(
    "S11",
    """
SELECT r_name AS dialect, 't' AS segment, '' AS preceding_context, '$' AS following_context, 'd' AS replacement FROM region
UNION SELECT r_name, n_name, '', '', lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def rules_by_dialect(spark, sf):
    """Rules for all dialects and for one each, from one document."""
    names = _names(spark, sf)
    dialects = sorted({r for r, _ in names} | {r.r_name for r in table(spark, sf, "region").collect()})
    own = {d: [{"segment": n, "replacement": n.lower()} for r, n in names if r == d] for d in dialects}
    return R.yaml_rules(spark, {"rules": [{"segment": "t", "following_context": "$", "replacement": "d"}], "dialects": own}, dialects)


@plan("S12", "SELECT r_name AS phone, n_name AS mapped FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, lower(n_name) FROM nation")
def phone_map_rows(spark, sf):
    """A mapping to one or several targets as rows."""
    names = _names(spark, sf)
    document = {r: [n for x, n in names if x == r] for r in {r for r, _ in names}} | {n: n.lower() for _, n in names}
    return R.phone_mapping(spark, document)


@plan(
    "S13 S21",
    """
SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier""",
)
def manifest_union(spark, sf):
    """Manifests below each other: one with a byte-order mark and blanks in its names, one with fewer columns, and one that lacks the column that is needed."""
    n = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("line"))
    body = n.agg(F.concat(F.lit("﻿key, name ,region\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("body"))  # 25 rows
    marked = _bodies(spark, body.select(F.lit("m.csv").alias("name"), "body"), "manifest")
    plain, other = new_folder(spark, "manifest"), new_folder(spark, "manifest")
    table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name").write.csv(plain, header=True)
    table(spark, sf, "region").write.csv(other, header=True)
    return R.manifests(spark, [marked, plain, other], "name").select("key", "name", "region")


@plan(
    "S14",
    """
WITH c AS (SELECT *, conv_id % 2 AS place, role || ' ' || turn AS t, turn % 50 AS s FROM conversations)
SELECT CASE place WHEN 0 THEN 'train' ELSE 'dev' END || '_dia' || conv_id || '_utt' || turn AS sample_key, t AS text, CASE WHEN turn % 4 <> 0 THEN CAST(0.75 AS DOUBLE) END AS seconds,
  row_number() OVER (ORDER BY place, conv_id, turn, t) - 1 AS global_idx FROM c""",
)
def utterance_manifest(spark, sf):
    """Utterances of two splits in a running order, with seconds where both times can be read."""
    c = table(spark, sf, "conversations").withColumn("s", F.col("turn") % 50)
    rows = c.select(
        (F.col("conv_id") % 2).alias("place"), F.concat_ws(" ", "role", "turn").alias("Utterance"), F.lit("joy").alias("Emotion"), F.col("conv_id").alias("Dialogue_ID"), F.col("turn").alias("Utterance_ID"),
        F.format_string("0:0:%d,500", "s").alias("StartTime"), F.when(F.col("turn") % 4 == 0, "x").otherwise(F.format_string("0:0:%d,250", F.col("s") + 1)).alias("EndTime"),
    )
    paths = {name: new_folder(spark, name) for name in ("train", "dev")}
    for k, path in enumerate(paths.values()):
        rows.filter(F.col("place") == k).drop("place").write.csv(path, header=True)
    return R.utterance_manifest(spark, paths).select("sample_key", "text", F.element_at("target_seconds", 1).alias("seconds"), "global_idx")


@plan(
    "S15",
    """
SELECT conv_id AS dialogue, count(*) AS n, string_agg(role || ' ' || turn, '|' ORDER BY turn, role) AS utterances, CASE WHEN conv_id % 3 <> 0 THEN count(*) * CAST(0.5 AS DOUBLE) END AS seconds
FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id""",
)
def dialog_manifest(spark, sf):
    """Dialogs with lists in their cells: those whose lists don't match go, and durations are there for all utterances or none."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("u"))  # a group is one dialog
    cell = lambda items: F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    each = lambda f: F.transform("u", f)
    more = F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("joy"))).otherwise(F.array().cast("array<string>"))
    ends = each(lambda x: F.when(F.col("conv_id") % 3 == 0, "0:0:1,0").otherwise("0:0:2,5"))
    rows = c.select(
        cell(each(lambda x: F.concat_ws(" ", x["role"], x["turn"]))).alias("Utterances"), cell(F.concat(each(lambda x: F.lit("joy")), more)).alias("Emotions"), F.col("conv_id").alias("Dialogue_ID"),
        cell(each(lambda x: F.lit("0:0:2,0"))).alias("Start_Time"), cell(ends).alias("End_Time"),
    )
    folder = new_folder(spark, "dialogs")
    rows.write.csv(folder, header=True)
    d = R.dialog_manifest(spark, folder)
    total = F.round(F.aggregate("target_seconds", F.lit(0.0), lambda a, x: a + x), 3)
    return d.select("dialogue", F.size("utterances").cast("long").alias("n"), F.array_join("utterances", "|").alias("utterances"), total.alias("seconds"))


@plan("S17 K10", "SELECT event_id, user_id, event_type, value, props FROM events")
def jsonl_round_trip(spark, sf):
    """Objects, one a line."""
    folder = new_folder(spark, "jsonl")
    W.jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), folder)
    return R.jsonl(spark, folder, "event_id long, user_id long, event_type string, value double, props string")


@plan("S18", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_file(spark, sf):
    """A file that is one list of objects."""
    n = table(spark, sf, "nation")
    body = n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("body"))  # 25 rows
    return R.json_array(spark, _bodies(spark, body.select(F.lit("n.json").alias("name"), "body"), "json"), "n_nationkey int, n_name string, n_regionkey int")


@plan("S19", "SELECT 'n' || c_nationkey || 'b' || c_custkey // 1000 AS speaker, c_name AS key, c_mktsegment AS text FROM customer")
def tsv_transcripts(spark, sf):
    """Transcripts of a speaker a file; lines without a second column don't count."""
    c = table(spark, sf, "customer").withColumn("line", F.concat_ws("\t", "c_name", "c_mktsegment"))
    g = c.groupBy(F.expr(NATION_FILE).alias("file")).agg(F.concat(F.lit("no text\n"), F.array_join(F.collect_list("line"), "\n")).alias("body"))  # a group is one file
    return R.tsv_transcripts(spark, _bodies(spark, g.select(F.concat("file", F.lit(".tsv")).alias("name"), "body"), "tsv"))


@plan(
    "S20",
    """
SELECT 's' || s_suppkey AS stem, CASE WHEN s_suppkey % 9 <> 0 THEN 'WAV' END AS format, CASE WHEN s_suppkey % 9 <> 0 THEN 8000 + s_suppkey % 4 * 1000 END AS sample_rate,
  CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 1000 * 10 AS DOUBLE) / (8000 + s_suppkey % 4 * 1000) END AS seconds, CASE WHEN s_suppkey % 9 <> 0 THEN 1 + s_suppkey % 2 END AS channels FROM supplier""",
)
def sound_headers(spark, sf):
    """Rates, seconds and channels of sound files, nulls for a file that is none."""

    def made(batches):
        import io
        import wave

        import pyarrow as pa

        for batch in batches:
            bodies = []
            for k in batch.column(0).to_pylist():
                out = io.BytesIO()
                with wave.open(out, "wb") as w:
                    w.setnchannels(1 + k % 2), w.setsampwidth(1), w.setframerate(8000 + k % 4 * 1000), w.writeframes(bytes(k % 1000 * 10 * (1 + k % 2)))
                bodies.append(b"x" if k % 9 == 0 else out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"s{k}.wav" for k in batch.column(0).to_pylist()]), pa.array(bodies, pa.binary())], ["name", "body"])

    s = R.sounds(spark, _bodies(spark, table(spark, sf, "supplier").select("s_suppkey").mapInArrow(made, "name string, body binary"), "sounds"))
    return s.select(X.stem("path").alias("stem"), "format", "sample_rate", F.nanvl("duration", F.lit(None).cast("double")).alias("seconds"), "channels")


@plan("S22 K19", "SELECT 1 AS version, c_custkey FROM customer UNION ALL SELECT 2, c_custkey FROM customer WHERE c_nationkey < 5")
def cache_by_version(spark, sf):
    """A cache that grows by the rows that a version of it doesn't have yet."""
    c, folder = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), new_folder(spark, "cache")
    for rows, version in ((c.filter("c_nationkey < 10"), 1), (c, 1), (c.filter("c_nationkey < 5"), 2), (c.filter("c_nationkey < 3"), 2)):
        W.versioned(rows, folder, version, "c_custkey")
    return spark.read.parquet(folder).select(F.col("version").cast("int").alias("version"), "c_custkey")


@plan("K3", "SELECT s_name AS file, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS duration_deviation FROM supplier")
def alignment_report_file(spark, sf):
    """The report of alignment quality as a sorted csv."""
    s, folder = table(spark, sf, "supplier"), new_folder(spark, "report")
    W.alignment_report(s.select(F.col("s_name").alias("file"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("duration_deviation")), folder)
    return R.manifest(spark, folder).select("file", F.col("duration_deviation").cast("double").alias("duration_deviation"))


@plan("K4", "SELECT l_returnflag AS reference, l_linestatus AS hypothesis, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion_report_file(spark, sf):
    """Confusion counts as a sorted csv."""
    folder = new_folder(spark, "report")
    W.report(S.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), folder, [F.desc("n"), "l_returnflag", "l_linestatus"])
    return R.manifest(spark, folder).select(F.col("l_returnflag").alias("reference"), F.col("l_linestatus").alias("hypothesis"), F.col("n").cast("long").alias("n"))


@plan(
    "K5 F21",
    """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS BIGINT) AS word_edits, 3 + len(string_split(trim(p_name), ' ')) AS word_length FROM part""",
)
def transcription_report_file(spark, sf):
    """Word errors of each utterance as a sorted csv: none, one word another, or one left out and one put in."""
    from ..functions import distance as D

    p, folder = table(spark, sf, "part"), new_folder(spark, "report")
    third = F.col("p_partkey") % 3
    said = F.when(third == 0, F.concat(F.lit("q1 q2 q3 "), "p_name")).when(third == 1, F.concat(F.lit("q1 zz q3 "), "p_name")).otherwise(F.concat(F.lit("q2 q3 "), "p_name", F.lit(" zz")))
    e = D.counted_errors(p.select("p_partkey", F.concat(F.lit("q1 q2 q3 "), "p_name").alias("gold"), said.alias("said")), "gold", "said", ["p_partkey"])
    W.report(e.select("p_partkey", "word_edits", "word_length"), folder, [F.desc("word_edits"), "p_partkey"])
    return R.manifest(spark, folder).select(*[F.col(c).cast("long").alias(c) for c in ("p_partkey", "word_edits", "word_length")])


@plan(
    "K7",
    """
SELECT 'words' AS kind, c_mktsegment AS line FROM customer GROUP BY ALL UNION ALL SELECT 'counts', c_mktsegment || chr(9) || count(*) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'utterances', c_nationkey || chr(9) || string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) FROM customer GROUP BY c_nationkey""",
)
def oov_files(spark, sf):
    """Words found, their counts, and each utterance's words, as three files."""
    reports = W.oov_reports(table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("utterance"), F.col("c_mktsegment").alias("word")))
    out = [R.lines(spark, _lines(spark, r, kind)).select(F.lit(kind).alias("kind"), "line") for kind, r in zip(("words", "counts", "utterances"), reports)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@plan("K9", "SELECT 's' || s_suppkey AS sample_key, s_name AS text, CASE WHEN s_suppkey % 3 = 0 THEN 'skipped_existing' ELSE 'pending' END AS status FROM supplier")
def manifest_file(spark, sf):
    """A manifest with a fixed header, in which rows that have an output are marked."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("sample_key"), F.col("s_name").alias("text"), F.lit("pending").alias("status"))
    folder = new_folder(spark, "manifest")
    W.manifest(s, folder, ["sample_key", "text", "status"], done=s.filter("s_suppkey % 3 = 0"))
    return R.manifest(spark, folder)


@plan("K12", "SELECT c_custkey, 2 AS n FROM customer")
def bulk_load_twice(spark, sf):
    """Rows appended to a table, two loads."""
    folder = new_folder(spark, "load")
    for _ in range(2):
        W.appended(table(spark, sf, "customer").select("c_custkey"), folder)
    return spark.read.parquet(folder).groupBy("c_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"))


@plan("K18", "SELECT n_nationkey AS epoch, n_regionkey * CAST(0.25 AS DOUBLE) AS loss, CASE WHEN n_nationkey % 2 = 0 THEN 'val' ELSE 'train' END AS phase FROM nation")
def training_log(spark, sf):
    """Metrics of each epoch, an object a line."""
    folder = new_folder(spark, "log")
    log = table(spark, sf, "nation").select(F.col("n_nationkey").alias("epoch"), (F.col("n_regionkey") * F.lit(0.25).cast("double")).alias("loss"), F.when(F.col("n_nationkey") % 2 == 0, "val").otherwise("train").alias("phase"))
    W.jsonl(log, folder)
    return R.jsonl(spark, folder, "epoch int, loss double, phase string")
