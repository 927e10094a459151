"""Text, number and vector functions over the stored tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import numbers as N
from ..functions import text as X
from ..session import ship, table
from .base import plan

ASCII = "regexp_replace(translate(text, '‘’“”–—', '''''\"\"--'), '[^\\x00-\\x7F]', '', 'g')"


@plan("F1", f"SELECT doc_id, md5({ASCII}) AS clean FROM documents")
def ascii_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.ascii_only("text").cast("binary")).alias("clean"))


@plan("F1 F35")
def sanitise_composed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitised("text").alias("clean"))


@plan("F2", "SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))), '[^a-z0-9'']', '', 'g')) AS marks FROM documents")
def mark_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.mark_normalised(F.regexp_replace("text", r"[^\x00-\x7F]", "")).cast("binary")).alias("marks"))


@plan("F3", "SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '([A-Za-z0-9'']+)', 1), lambda w: lower(w)), ' ') AS words FROM conversations")
def token_normalise(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.tokens("text"), " ").alias("words"))


@plan("F4 P13", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\n\\t\\r\\f\\x0b]+'), lambda w: w <> '')) AS BIGINT) AS n_words FROM documents")
def word_counts_per_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count("text").cast("long").alias("n_words"))


@plan("A12 A5", "SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY lang, word")
def word_counts_by_dictionary(spark, sf):
    w = F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " ")).alias("word")
    return table(spark, sf, "documents").select("lang", w).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


@plan("A12", """WITH w AS (SELECT doc_id, lang, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS word FROM documents), k AS (SELECT DISTINCT word FROM w JOIN labels USING (doc_id))
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM w WHERE word <> '' AND word NOT IN (SELECT word FROM k) GROUP BY word HAVING count(*) > 1""")
def oov_counts(spark, sf):
    """Words of no labelled text, by an anti join."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " ")).alias("word")).filter("word <> ''")
    known = w.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("word").distinct()
    return w.join(known, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("n > 1")


@plan("F9", "SELECT event_id, regexp_replace('<cutoff> ' || event_type || ' x', '<cutoff>\\s+([^\\s<]+)', '<cutoff-\\1> \\1', 'g') AS named FROM events")
def cutoff_rewriting(spark, sf):
    return table(spark, sf, "events").select("event_id", X.cutoffs_named(F.concat(F.lit("<cutoff> "), "event_type", F.lit(" x"))).alias("named"))


@plan("F10 F11 F14")
def speech_texts(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", X.speech_text("text").alias("speech"), X.cjk_tokens("text").alias("tokens"), X.syllables("text").cast("long").alias("n_syllables"))


@plan("F13", "SELECT doc_id, length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) > 0.3 * length(text) AS chinese FROM documents")
def language_share(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.is_chinese("text").alias("chinese"))


@plan("F5 F6 F7 T9")
def tokenized(spark, sf):
    """Sanitised words, their characters, and unknown words, in Arrow batches."""
    from ..session import ship

    ship(spark)
    known = "the of and to in is it that was for on are as with be this from or an la le de que el los der die und das ein".split()
    t = X.tokenizer(X.Sanitizer(), X.Splitter(known, ["l'"], ["'s"]))
    return table(spark, sf, "conversations").select("conv_id", "turn", t("text").alias("t")).select("conv_id", "turn", "t.*")


@plan("F12")
def sentence_pieces(spark, sf):
    from ..session import ship

    ship(spark)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentence_packer(80)("text")).alias("piece", "body"))


@plan("F25 F26", "SELECT event_id, event_type AS label, 'B' AS position, regexp_replace(event_type, '[^a-m]', '', 'g') AS known FROM events")
def position_suffixes(spark, sf):
    e = table(spark, sf, "events").withColumn("phone", F.concat("event_type", F.lit("_B")))
    return e.select("event_id", X.without_position("phone").alias("label"), X.position("phone").alias("position"), X.known_graphemes("event_type", "abcdefghijklm")[0].alias("known"))


@plan("F36", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, length(url) AS n FROM pages")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"), F.length("url").cast("long").alias("n"))


@plan("F17 F18", """WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 5 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) || ':07,5' WHEN 1 THEN CAST(event_id % 50 AS VARCHAR) || ':01.25' ELSE 'bad' END AS s FROM events),
p AS (SELECT event_id, string_split(replace(s, ',', '.'), ':') AS p FROM t)
SELECT event_id, CASE WHEN len(p) = 3 THEN TRY_CAST(p[1] AS DOUBLE) * 3600 + TRY_CAST(p[2] AS DOUBLE) * 60 + TRY_CAST(p[3] AS DOUBLE) WHEN len(p) = 2 THEN TRY_CAST(p[1] AS DOUBLE) * 60 + TRY_CAST(p[2] AS DOUBLE) ELSE TRY_CAST(p[1] AS DOUBLE) END AS seconds FROM p""")
def time_parse(spark, sf):
    i = F.col("event_id")
    s = F.when(i % 3 == 0, F.concat((i % 5).cast("string"), F.lit(":"), (i % 60).cast("string"), F.lit(":07,5"))).when(i % 3 == 1, F.concat((i % 50).cast("string"), F.lit(":01.25"))).otherwise("bad")
    return table(spark, sf, "events").select("event_id", N.seconds(s).alias("seconds"))


@plan("F18", "SELECT event_id, greatest(1, CAST(trunc(value / 0.02::DOUBLE) AS BIGINT)) AS n_tokens FROM events")
def seconds_to_tokens(spark, sf):
    return table(spark, sf, "events").select("event_id", N.tokens_of_seconds("value").alias("n_tokens"))


@plan("F19", "SELECT event_id, least(greatest(round_even(value / 99.7::DOUBLE, 2), 0.01::DOUBLE), 0.99::DOUBLE) AS p FROM events")
def probability_rounding(spark, sf):
    return table(spark, sf, "events").select("event_id", N.probability(F.col("value") / 99.7).alias("p"))


@plan("F15", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS calm, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS happy FROM events")
def emotion_one_hot(spark, sf):
    label = N.canonical("event_type", {"view": "calm", "click": "calm", "purchase": "happy"}, "other")
    v = N.one_hot(label, ["calm", "happy"])
    return table(spark, sf, "events").select("event_id", v[0].alias("calm"), v[1].alias("happy"))


@plan("F27", "SELECT event_id, round(10 * log10(greatest(value, 2.220446049250313e-16)), 6) AS db FROM events")
def decibel(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(N.decibels("value"), 6).alias("db"))


@plan("F33", "SELECT user_id, CAST(count(*) AS BIGINT) AS length, CAST(max(count(*)) OVER (PARTITION BY user_id % 10) AS BIGINT) AS padded FROM events GROUP BY user_id")
def pad_batches(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).withColumn("batch", F.col("user_id") % 10)
    return N.padded(v, "v", "batch").select("user_id", "length", F.size("padded").cast("long").alias("padded"))


@plan("F32", """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT vec_id, avg(x) AS m, stddev_samp(x) AS s FROM e GROUP BY vec_id)
SELECT a.vec_id, round(avg(pow((a.x - b.x) / greatest(m.s, 1e-5), 2)), 5) AS mse FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i JOIN m ON m.vec_id = a.vec_id WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id""")
def standardised_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", N.doubles("embedding").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.filter("vec_id % 2 = 0").join(b, "vec_id").select("vec_id", F.round(N.standardised_mse("v", "w"), 5).alias("mse"))


@plan("F20 F21 A18")
def wer_cer(spark, sf):
    """Edits of neighbouring turns, and the rates of each role."""
    from ..session import ship

    ship(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").withColumn("other", F.lead("text").over(w)).filter("other IS NOT NULL")
    e = D.counted_errors(t, "text", "other", ["role"])
    return e.groupBy("role").agg(*[F.sum(c).alias(c) for c in ("word_edits", "word_length", "char_edits", "char_length")]).withColumn("wer", F.try_divide("word_edits", "word_length")).withColumn("cer", F.try_divide("char_edits", "char_length"))


@plan("F20 A18", "WITH t AS (SELECT role, left(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), 200) AS a, lead(left(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), 200)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT role, CAST(sum(levenshtein(a, b)) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS n FROM t WHERE b IS NOT NULL GROUP BY role".replace("left(", "concat(").replace(", 200)", ")"))
def character_errors(spark, sf):
    """Standard character edits of neighbouring turns by the built-in function, over whole texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = table(spark, sf, "conversations").withColumn("a", F.regexp_replace("text", r"[^\x00-\x7F]", "")).withColumn("b", F.lead("a").over(w)).filter("b IS NOT NULL")
    return a.groupBy("role").agg(F.sum(F.levenshtein("a", "b")).cast("long").alias("edits"), F.sum(F.length("a")).cast("long").alias("n"))


@plan("M2", "SELECT event_type, regexp_replace(event_type, '([aeiou])(c|k)', '\\1g', 'g') AS rewritten, count(*) AS n FROM events GROUP BY event_type")
def rule_rewrite(spark, sf):
    """A rule in its context as a built-in replacement."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.regexp_replace("event_type", "([aeiou])(c|k)", "$1g").alias("rewritten"), "n")


@plan("F30 F31 W9 W10")
def warp_path_pchip(spark, sf):
    """Warping paths through each user's anchors, and a resampled channel."""
    import numpy as np
    import pandas as pd

    from ..operators import intervals as I

    def warp(pdf):
        p = pdf.sort_values(["ts", "event_id"])
        anchors = I.monotone_anchors([(float(i), float(v)) for i, v in zip(range(len(p)), (np.cumsum(p.value) - p.value.iloc[0]) / 50)])  # from the first frame on
        s, t = zip(*anchors)
        frames = int(t[-1]) + 1
        path = D.warp_path(s, t, frames)
        out = D.resample(p[["value"]].to_numpy(float), path)
        return pd.DataFrame({"user_id": p.user_id.iloc[0], "frame": np.arange(frames), "source": path, "value": out[:, 0]})

    return I.folded(table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value"), ["user_id"], warp, "user_id long, frame long, source double, value double")


@plan(
    "F16",
    """
WITH e AS (SELECT event_id, abs(value) / 100.0 AS x FROM events), v AS (SELECT event_id, [x * 0.5, x * 0.25, 0.25] AS v, x * 0.5 + x * 0.25 + 0.25 AS s FROM e)
SELECT event_id, round(CASE WHEN s > 0.8 THEN v[1] * 0.8 / s ELSE v[1] END, 9) AS first, round(CASE WHEN s > 0.8 THEN v[3] * 0.8 / s ELSE v[3] END, 9) AS third FROM v""",
)
def emotion_biased(spark, sf):
    """A vector times a bias, scaled down where its sum is over the cap."""
    x = F.abs("value") / 100
    v = N.biased(F.array(x, x, F.lit(1.0)), [0.5, 0.25, 0.25])
    return table(spark, sf, "events").select("event_id", v.alias("v")).select("event_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[2], 9).alias("third"))


@plan(
    "F22",
    """
WITH p AS (SELECT p_type, p_partkey, p_name FROM part) SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS edits, len(string_split(p_name, ' ')) + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS length FROM p""",
)
def label_errors(spark, sf):
    """Least edits over all pairs of alternative pronunciations, with that gold's length."""
    name, even = F.col("p_name"), F.col("p_partkey") % 2 == 0
    golds = F.array(F.concat(F.lit("q1 q2 "), name), F.concat(F.lit("q1 "), name))
    p = table(spark, sf, "part").select("p_partkey", golds.alias("golds"), F.concat(F.when(even, "q1 q2 ").otherwise("q3 "), name).alias("said"))
    return D.least_errors(p, "golds", "said", "p_partkey")


@plan(
    "F24",
    r"""
SELECT p_partkey, regexp_replace(regexp_replace('s m ' || lower(p_type) || ' t', ' t$', ' d'), '^s m ', 'z m ') AS rewritten FROM part""",
)
def phonological_rules(spark, sf):
    """Rules that are data: a segment in its context, at the word's end and at its beginning."""
    phones = F.concat(F.lit("s m "), F.lower("p_type"), F.lit(" t"))
    for rule in (("t", "", "$", "d"), ("s", "^", "m", "z")):
        phones = D.rewritten(phones, *rule)
    return table(spark, sf, "part").select("p_partkey", phones.alias("rewritten"))
