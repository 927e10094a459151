"""Language models and alignments of words, letters and phones over the stored texts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import language_models as L
from ..operators import lattices as A
from ..operators.stages import Stages
from ..session import new_folder, table
from .base import plan

WORDS = "list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), lambda x: x <> '')"


def _words() -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " "), lambda x: x != "")


@plan(
    "M3",
    f"""
WITH w AS (SELECT ['<s>'] || {WORDS} || ['</s>'] AS w FROM conversations),
b AS (SELECT h, x, count(*) AS c FROM (SELECT unnest(w[: len(w) - 1]) AS h, unnest(w[2 :]) AS x FROM w) GROUP BY h, x),
u AS (SELECT x, count(*) AS c FROM b GROUP BY x),
d1 AS (SELECT least(0.9::DOUBLE, greatest(0.01::DOUBLE, count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)))) AS d, sum(c) AS total, count(*) AS types FROM u),
d2 AS (SELECT least(0.9::DOUBLE, greatest(0.01::DOUBLE, count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)))) AS d FROM b),
p1 AS (SELECT x, (c - d) / total + d * types / total / (types + 1) AS p FROM u, d1),
h AS (SELECT h, sum(c) AS total, any_value(d) * count(*) / sum(c) AS kept FROM b, d2 GROUP BY h),
g AS (SELECT 1 AS n, x AS words, p AS probability FROM p1 UNION ALL SELECT 1, '<s>', 0 UNION ALL SELECT 1, '<unk>', d * types / total / (types + 1) FROM d1
UNION ALL SELECT 2, b.h || ' ' || b.x, (c - d) / total + kept * p FROM b JOIN h USING (h) JOIN p1 USING (x), d2)
SELECT CAST(n AS BIGINT) AS n, words, round(probability, 9) AS probability, round(CASE WHEN n = 1 THEN kept END, 9) AS backoff FROM g LEFT JOIN h ON h.h = g.words""",
)
def language_model_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """A back-off model of two words over all turns."""
    m = L.kneser_ney(table(spark, sf, "conversations"), _words(), 2)
    return m.select("n", "words", F.round("probability", 9).alias("probability"), F.round("backoff", 9).alias("backoff"))


@plan(
    "M3 S10",
    f"""
WITH w AS (SELECT ['<s>'] || {WORDS} || ['</s>'] AS w FROM conversations),
g AS (SELECT n, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(n)))
SELECT CAST(n AS BIGINT) AS n, count(DISTINCT words) + CASE WHEN n = 1 THEN 1 ELSE 0 END AS n_grams, count(DISTINCT words) FILTER (n < 3 AND words NOT LIKE '%</s>') AS n_histories FROM g GROUP BY n""",
)
def language_model_file(spark: SparkSession, sf: str) -> DataFrame:
    """A model of three words written as ARPA and read back: its n-grams and histories by order."""
    path = new_folder(spark, "arpa")
    L.arpa_lines(L.kneser_ney(table(spark, sf, "conversations"), _words(), 3)).write.text(path)
    return L.read_arpa(spark, path).groupBy("n").agg(F.count(F.lit(1)).alias("n_grams"), F.count("backoff").alias("n_histories"))


#: Interjections that the decoded words below have and the texts don't.
SAID = ["uhm", "yknow"]


@plan(
    "M17",
    f"""
WITH w AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), u AS (SELECT *, list_filter(w, lambda x: x NOT IN ('uhm', 'yknow')) AS v FROM w)
SELECT conv_id, turn, array_to_string(v[len(v) // 2 + 1 :], ' ') AS rest FROM u""",
)
def interjections_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each turn behind a decoded first half that has an interjection before every third word."""
    own = F.filter(_words(), lambda x: ~x.isin(SAID))
    t = table(spark, sf, "conversations").select("conv_id", "turn", own.alias("original"))
    half = F.slice("original", F.lit(1), F.floor(F.size("original") / 2).cast("int"))
    said = F.flatten(F.transform(half, lambda w, i: F.when(i % 3 == 0, F.array(F.when(i % 2 == 0, SAID[0]).otherwise(SAID[1]), w)).otherwise(F.array(w))))
    t = t.withColumn("decoded", said)
    return t.select("conv_id", "turn", F.array_join(A.rest_of_text("decoded", "original", SAID), " ").alias("rest"))


@plan("M5")
def joint_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each word of the conversations aligned with a made-up pronunciation (some pairs of letters are one phone, some letters two, final e is silent)."""
    words = table(spark, sf, "conversations").select(F.explode(_words()).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    said = F.col("word")
    for letters, phones in (("e$", ""), ("th", "T"), ("sh", "S"), ("ou", "U"), ("ng", "N"), ("x", "ks")):
        said = F.regexp_replace(said, letters, phones)
    pairs = words.select("word", "n", F.split("word", "").alias("letters"), F.split(said, "").alias("phones")).filter("size(phones) > 0 AND phones[0] <> ''")
    pairs = Stages(spark).write(pairs, "lattice-words")  # read twice: by the model and by what it aligns
    model = A.JointModel(pairs, "letters", "phones", "n", rounds=8)
    return model.aligned(pairs.select("word", "letters", "phones"), "letters", "phones").select("word", "alignment", F.round("likelihood", 9).alias("likelihood"))


@plan(
    "M16",
    f"""
WITH w AS (SELECT conv_id, turn, list_filter({WORDS}, lambda x: x NOT IN ('uhh', 'zz')) AS w FROM conversations),
n AS (SELECT conv_id, turn, len(w) AS n, CASE WHEN turn % 2 = 0 THEN (len(w) + 3) // 4 ELSE len(w) // 5 END AS edits FROM w)
SELECT conv_id, turn, n AS n_words, edits, round(edits / n, 6) AS word_error, CASE WHEN turn % 2 = 0 THEN round(edits * 0.25::DOUBLE, 6) ELSE 0 END AS extra_duration FROM n WHERE n > 0""",
)
def transcript_word_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against aligned words: even turns have a word of a quarter second put in behind every fourth, odd ones lack every fifth; silence and very short words don't count."""
    own = F.filter(_words(), lambda x: ~x.isin("uhh", "zz"))

    def said(w: Column, i: Column) -> Column:
        at = i * 1.0
        word = lambda label, begin, stop: F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), (at + begin).alias("begin"), (at + stop).alias("stop"))
        rest = [F.when(i % 4 == 0, F.when(F.col("turn") % 2 == 0, word("uhh", 0.5, 0.75))), F.when(i % 7 == 0, word("zz", 0.8, 0.82)), word("sil", 0.85, 1.0)]
        return F.array_compact(F.array(F.when((F.col("turn") % 2 == 0) | (i % 5 != 4), word(w, 0.0, 0.5)), *rest))

    t = table(spark, sf, "conversations").select("conv_id", "turn", own.alias("reference"))
    t = t.withColumn("words", F.flatten(F.transform("reference", said)))
    e = A.transcript_errors(t, "reference", "words", ["conv_id", "turn"])
    return e.select("conv_id", "turn", "n_words", "edits", F.round("word_error", 6).alias("word_error"), F.round("extra_duration", 6).alias("extra_duration"))
