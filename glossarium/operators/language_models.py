"""Back-off language models from counts (M3): Kneser-Ney with one discount an order, written as ARPA lines and read back in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import Stages

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
#: Discounts lie between these; an order without n-grams that are there once takes the middle one.
LEAST, MIDDLE, MOST = 0.01, 0.5, 0.9


def gram_counts(df: DataFrame, words: Column, order: int) -> DataFrame:
    """(n, history, word, c) of all n-grams up to an order, with marks at the ends, from one scan; history is the words before the last, or empty."""
    marked = F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END)))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(n), F.size("w")), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i - n + 1, n - 1), " ").alias("history"), F.get("w", i - 1).alias("word")))

    each = [F.when(F.size("w") >= n, grams(n)).otherwise(F.array().cast("array<struct<n:int,history:string,word:string>>")) for n in range(1, order + 1)]
    rows = df.select(marked.alias("w")).filter("w IS NOT NULL").select(F.explode(F.concat(*each)).alias("g"))
    return rows.groupBy("g.n", "g.history", "g.word").agg(F.count(F.lit(1)).alias("c"))


def _shorter(history: str) -> Column:
    """A history without its first word."""
    return F.regexp_replace(history, r"^[^ ]+ ?", "")


def kneser_ney(df: DataFrame, words: Column, order: int) -> DataFrame:
    """(n, words, probability, backoff): an interpolated Kneser-Ney model in back-off form, as the ARPA readers give it.

    The highest order counts occurrences, lower ones how many different words stand before an n-gram; n-grams at the beginning of a text have nothing before them and
    keep their occurrences. A history's discounts go to the next shorter one; at the end every word and `<unk>` get the same share. So the probabilities after each
    history sum to one. Texts that are null are left out; an empty table gives `<s>` and `<unk>` alone.
    """
    stages = Stages(df.sparkSession)
    raw = stages.write(gram_counts(df, words, order), "model-counts")
    model, below = None, None
    vocabulary = raw.filter((F.col("n") == 1) & (F.col("word") != BEGIN)).agg((F.count(F.lit(1)) + 1).alias("v"))
    for n in range(1, order + 1):
        counts = raw.filter((F.col("n") == n) & (F.col("word") != BEGIN)).select("history", "word", "c")
        if n < order:
            before = raw.filter(F.col("n") == n + 1).groupBy(_shorter("history").alias("history"), "word").agg(F.count(F.lit(1)).alias("c"))
            first = (F.col("history") == BEGIN) | F.col("history").startswith(BEGIN + " ")
            counts = before.unionByName(counts.filter(first))
        n1, n2 = F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))
        discount = counts.agg(F.when(n1 == 0, MIDDLE).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), n1 / (n1 + 2 * n2)))).alias("d"))
        by = counts.groupBy("history").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types")).crossJoin(F.broadcast(discount))  # one row
        by = by.select("history", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("left"))
        rows = counts.join(by, "history")
        if n == 1:
            rows = rows.crossJoin(F.broadcast(vocabulary)).withColumn("lower", 1 / F.col("v"))
            unknown = F.broadcast(vocabulary).join(by, F.lit(True), "left").select(F.lit("").alias("history"), F.lit(UNKNOWN).alias("word"), (F.coalesce("left", F.lit(1.0)) / F.col("v")).alias("p"))
            begin = vocabulary.select(F.lit("").alias("history"), F.lit(BEGIN).alias("word"), F.lit(0.0).alias("p"))
        else:
            rows = rows.withColumn("shorter", _shorter("history")).join(below.select(F.col("history").alias("shorter"), "word", F.col("p").alias("lower")), ["shorter", "word"])
        rows = rows.select("history", "word", ((F.col("c") - F.col("d")) / F.col("total") + F.col("left") * F.col("lower")).alias("p"))
        rows = stages.write(rows.unionByName(unknown).unionByName(begin) if n == 1 else rows, "model-order")
        if n > 1:
            model = _weighted(model, by.select(F.col("history").alias("words"), F.col("left").alias("backoff")), n - 1)
        part = rows.select(F.lit(n).cast("long").alias("n"), F.concat_ws(" ", F.nullif(F.col("history"), F.lit("")), "word").alias("words"), F.col("p").alias("probability"), F.lit(None).cast("double").alias("backoff"))
        model = part if model is None else model.unionByName(part)
        below = rows
    return model


def _weighted(model: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """model with the back-off weights of its n-grams of one order."""
    rest, own = model.filter(F.col("n") != n), model.filter(F.col("n") == n).drop("backoff")
    return rest.unionByName(own.join(weights, "words", "left").select("n", "words", "probability", "backoff"))


def arpa_lines(model: DataFrame) -> DataFrame:
    """A model's lines in order (column value): written as text, the parts one after the other are an ARPA file. Fields are parted by tabs."""
    log = lambda c: F.format_string("%.9f", F.when(F.col(c) > 0, F.log10(c)).otherwise(-99.0))
    grams = model.select("n", F.lit(1).alias("kind"), "words", F.concat_ws("\t", log("probability"), "words", F.when(F.col("backoff").isNotNull(), log("backoff"))).alias("value"))
    sizes = model.groupBy("n").agg(F.count(F.lit(1)).alias("size"))
    heads = sizes.select("n", F.lit(0).alias("kind"), F.lit("").alias("words"), F.format_string("\\%d-grams:", "n").alias("value"))
    tails = sizes.select("n", F.lit(2).alias("kind"), F.lit("").alias("words"), F.lit("").alias("value"))
    counts = sizes.select(F.lit(0).cast("long").alias("n"), (F.col("n") + 1).cast("int").alias("kind"), F.lit("").alias("words"), F.format_string("ngram %d=%d", "n", "size").alias("value"))
    spark = model.sparkSession
    marks = spark.createDataFrame([(0, 0, "", "\\data\\"), (0, 1 << 20, "", ""), (1 << 20, 0, "", "\\end\\")], "n long, kind int, words string, value string")
    return grams.unionByName(heads).unionByName(tails).unionByName(counts).unionByName(marks).orderBy("n", "kind", "words").select("value")


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """n, words, probability and backoff of a tab-parted ARPA file or folder. A line tells its order by its words, so files are read in splits."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f")).filter((F.size("f") >= 2) & F.expr("try_cast(f[0] AS double)").isNotNull())
    number = lambda i: F.pow(F.lit(10.0), F.get("f", F.lit(i)).cast("double"))
    return rows.select(F.size(F.split(F.get("f", F.lit(1)), " ")).cast("long").alias("n"), F.get("f", F.lit(1)).alias("words"), number(0).alias("probability"), number(2).alias("backoff"))
