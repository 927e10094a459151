"""Statistics and models over the stored tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import statistics as S
from ..session import table
from .base import plan


@plan("A4 A3", "SELECT count(l_quantity) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS max FROM lineitem")
def mse_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    d = S.describe(table(spark, sf, "lineitem"), "l_extendedprice")
    return d.select("n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")], "min", "max")


@plan("A15 W3", """WITH v AS (SELECT value / 10 AS x FROM events), b AS (SELECT CAST(ceil(max(x)) AS BIGINT) + 1 AS nb, count(x) AS total FROM v), c AS (SELECT CAST(floor(x) AS BIGINT) AS bin, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1),
e AS (SELECT unnest(generate_series(0, nb - 1)) AS bin, total FROM b), p AS (SELECT e.bin, coalesce(n, 0) AS n, 100.0::DOUBLE * coalesce(n, 0) / total AS percent FROM e LEFT JOIN c ON e.bin = c.bin)
SELECT bin, n, round(percent, 6) AS percent, round(sum(percent) OVER (ORDER BY bin), 6) AS cumulative FROM p""")
def mse_histogram_cumulative(spark, sf):
    h = S.histogram(table(spark, sf, "events").select((F.col("value") / 10).alias("x")), "x")
    return h.select("bin", "n", F.round("percent", 6).alias("percent"), F.round("cumulative", 6).alias("cumulative"))


def _clusters(spark, sf):
    """A made-up clustering: a label, but for every seventh vector the next one."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("truth"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("cluster"))


CLUSTERS = "k AS (SELECT vec_id, CAST(label AS BIGINT) AS truth, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS cluster FROM embeddings)"


@plan("A13", f"WITH {CLUSTERS} SELECT truth, cluster, count(*) AS n FROM k GROUP BY truth, cluster")
def confusion_counts(spark, sf):
    return S.confusion(_clusters(spark, sf), "truth", "cluster")


@plan("A14", f"WITH {CLUSTERS}, c AS (SELECT truth, cluster, count(*) AS n FROM k GROUP BY truth, cluster) SELECT cluster, arg_min(truth, (-n, truth)) AS truth, max(n) AS n FROM c GROUP BY cluster")
def argmax_map(spark, sf):
    return S.majority(S.confusion(_clusters(spark, sf), "truth", "cluster"), "cluster", "truth")


@plan("A19", f"""WITH {CLUSTERS}, c AS (SELECT truth, cluster, count(*)::DOUBLE AS n FROM k GROUP BY truth, cluster), a AS (SELECT truth, sum(n) AS a FROM c GROUP BY truth), b AS (SELECT cluster, sum(n) AS b FROM c GROUP BY cluster), t AS (SELECT sum(n) AS t FROM c),
j AS (SELECT sum(n * (n - 1) / 2) AS pc, sum(n / t * ln(n * t / (a * b))) AS mi, any_value(t) AS t FROM c JOIN a USING (truth) JOIN b USING (cluster), t),
x AS (SELECT sum(a * (a - 1) / 2) AS pa, -sum(a / t * ln(a / t)) AS ha FROM a, t), y AS (SELECT sum(b * (b - 1) / 2) AS pb, -sum(b / t * ln(b / t)) AS hb FROM b, t)
SELECT round((pc - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness,
round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(pc / sqrt(pa * pb), 6) AS fowlkes_mallows FROM j, x, y""")
def cluster_agreement(spark, sf):
    a = S.agreement(_clusters(spark, sf), "truth", "cluster")
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@plan("A20", f"""WITH {CLUSTERS}, s AS (SELECT truth AS l, count(*)::DOUBLE AS sup, sum(CASE WHEN truth = cluster THEN 1 ELSE 0 END)::DOUBLE AS hit FROM k GROUP BY truth), c AS (SELECT cluster AS l, count(*)::DOUBLE AS called FROM k GROUP BY cluster),
r AS (SELECT sup, hit / called AS p, hit / sup AS r FROM s JOIN c USING (l)) SELECT round(sum(p * sup) / sum(sup), 6) AS precision, round(sum(r * sup) / sum(sup), 6) AS recall, round(sum(2 * p * r / (p + r) * sup) / sum(sup), 6) AS f1 FROM r""")
def weighted_prf(spark, sf):
    w = S.weighted_scores(_clusters(spark, sf), "truth", "cluster")
    return w.select(*[F.round(c, 6).alias(c) for c in w.columns])


PAIRS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""
SOME_PAIRS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""


def _pairs(spark, sf, **more):
    """Every vector against all others."""
    e = table(spark, sf, "embeddings")
    return S.cosine_pairs(e, e, "vec_id", "embedding", "label", **more)


def _fifth(near, name):
    """The distance to the fifth neighbour."""
    return near.filter("rank = 5").select("query", N.half_up(1 - F.round(1 - F.col("distance"), 6), 5).alias(name))


@plan("J15 F28", f"WITH {PAIRS} SELECT a, b, same, score FROM p")
def theta_pairs_cosine(spark, sf):
    return _pairs(spark, sf)


@plan("A21", f"""WITH {PAIRS}, n AS (SELECT score, sum(CASE WHEN same THEN 1 ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN same THEN 0 ELSE 1 END)::DOUBLE AS d FROM p GROUP BY score), t AS (SELECT sum(s) AS ts, sum(d) AS td FROM n),
r AS (SELECT score, (sum(s) OVER (ORDER BY score) - s) / ts AS frr, 1 - (sum(d) OVER (ORDER BY score) - d) / td AS far FROM n, t)
SELECT round(arg_min(score, (round(abs(far - frr), 12), score)), 6) AS threshold, round(arg_min((far + frr) / 2, (round(abs(far - frr), 12), score)), 6) AS rate FROM r""")
def equal_error_rate(spark, sf):
    return S.equal_error_rate_of_counts(_pairs(spark, sf, counted=True), "score").select(F.round("threshold", 6).alias("threshold"), F.round("rate", 6).alias("rate"))


CENTRES = """x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label)"""


@plan("A16 F28", f"WITH {CENTRES}, n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT m.label, CAST(i AS BIGINT) AS i, round(x / n, 6) AS x FROM m JOIN n ON m.label = n.label")
def centroid_mean_normalised(spark, sf):
    c = S.centroids(table(spark, sf, "embeddings"), "label", "embedding", normalise=True)
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@plan("A17", "WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m FROM x GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 5) AS energy FROM x JOIN m USING (i) GROUP BY vec_id")
def global_mean_subtraction(spark, sf):
    c = S.centred(table(spark, sf, "embeddings"), "embedding")
    return c.select("vec_id", F.round(N.dot("embedding", "embedding"), 5).alias("energy"))


@plan("M8 F28", f"WITH {CENTRES}, s AS (SELECT e.vec_id, c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.c), 9) AS score FROM embeddings e, c) SELECT vec_id, CASE WHEN max(score) < 0.35 THEN 'UNKNOWN' ELSE CAST(arg_min(label, (-score, label)) AS VARCHAR) END AS predicted, round(max(score), 6) AS score FROM s GROUP BY vec_id")
def classify_with_reject(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return S.classified(e, S.centroids(table(spark, sf, "embeddings"), "label", "embedding"), "label", "embedding", 0.35).select("vec_id", "predicted", F.round("score", 6).alias("score"))


@plan("F29", f"WITH {PAIRS}, r AS (SELECT a, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM p) SELECT a AS query, round(1 - score, 5) AS distance FROM r WHERE k = 5")
def knn_kth_distance(spark, sf):
    """The distance of every vector to its fifth neighbour."""
    return _fifth(S.neighbours_of_all(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, digits=12), "distance")


@plan("M10")
def kmeans_clusters(spark, sf):
    return S.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@plan("M3", "WITH w AS (SELECT ['<s>'] || list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' '), lambda x: x <> '') || ['</s>'] AS w FROM conversations), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram FROM w) SELECT ngram, count(*) AS n FROM g GROUP BY ngram")
def ngram_counts(spark, sf):
    words = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " "), lambda x: x != "")
    return S.ngrams(table(spark, sf, "conversations"), [], words, 2)


@plan("M1", """WITH l AS (SELECT DISTINCT l_returnflag AS word, l_linestatus AS pron FROM lineitem), n AS (SELECT l_returnflag AS word, l_linestatus AS pron, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2),
c AS (SELECT l.word, l.pron, coalesce(n, 0) + 1 AS c FROM l LEFT JOIN n ON l.word = n.word AND l.pron = n.pron), t AS (SELECT word, max(c) AS top FROM c GROUP BY word)
SELECT c.word, pron, CASE WHEN c = top THEN 1.0::DOUBLE ELSE least(greatest(round_even(c / top, 2), 0.01::DOUBLE), 0.99::DOUBLE) END AS probability, c - 1 AS n FROM c JOIN t ON c.word = t.word""")
def pronunciation_probability(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("word"), F.col("l_linestatus").alias("pron"), "l_quantity")
    return S.pronunciation_probabilities(l.filter("l_quantity > 10"), "word", "pron", l.select("word", "pron").distinct())


@plan("M1 W2", """WITH s AS (SELECT event_type, CASE WHEN lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a FROM events), t AS (SELECT avg(a) AS base FROM s)
SELECT event_type, count(*) AS n, least(greatest(round_even((sum(a) + 2 * base) / (count(*) + 2), 2), 0.01::DOUBLE), 0.99::DOUBLE) AS silence_after FROM s, t GROUP BY event_type, base""")
def silence_probability(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_type", F.coalesce(F.lead("event_type").over(w) == "view", F.lit(False)).alias("a"))
    return S.silence_probabilities(e, ["event_type"], F.col("a")).drop("correction")


@plan("M2", """WITH b AS (SELECT p_type AS form, count(*) AS c FROM part GROUP BY p_type), r AS (SELECT * FROM (VALUES ('r1', 'A.*E', 3), ('r2', 'O', 5), ('r3', 'ZZ', 0)) v(rule, pattern, applied)),
g AS (SELECT rule, pattern, applied, sum(c) AS base FROM b JOIN r ON regexp_matches(form, pattern) WHERE c > 1 GROUP BY ALL)
SELECT rule, CAST(applied AS BIGINT) AS applied, CAST(base AS BIGINT) AS base, least(greatest(round_even(applied::DOUBLE / greatest(base, applied), 2), 0.01::DOUBLE), 0.99::DOUBLE) AS probability FROM g WHERE applied > 0""")
def rule_probability(spark, sf):
    rules = spark.createDataFrame([("r1", "A.*E", 3), ("r2", "O", 5), ("r3", "ZZ", 0)], "rule string, pattern string, applied long")
    return S.rule_probabilities(rules, table(spark, sf, "part").groupBy(F.col("p_type").alias("form")).agg(F.count("*").alias("count")))


@plan("M13", "WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT label, round(avg(list_max(v) - v[label + 1]), 6) AS goodness FROM x GROUP BY label")
def phone_goodness(spark, sf):
    e = table(spark, sf, "embeddings").select("label", N.doubles("embedding").alias("v"))
    return S.goodness(e, ["label"], "label", "v").select("label", F.round("goodness", 6).alias("goodness"))


@plan("M12 P17 A2", "SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'empty', count(*) FROM documents WHERE trim(text) = '' UNION ALL SELECT 'characters', CAST(sum(n_chars) AS BIGINT) FROM documents")
def validation_report(spark, sf):
    """Small counts over one scan each, in one frame."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id").distinct()
    one = d.agg(F.count("*").alias("documents"), F.count(F.when(F.trim("text") == "", 1)).alias("empty"), F.sum("n_chars").cast("long").alias("characters"))
    rows = one.unpivot([], ["documents", "empty", "characters"], "what", "n")
    rows = rows.unionByName(l.agg(F.count("*").alias("n")).withColumn("what", F.lit("labelled")))
    return rows.unionByName(d.select("doc_id").join(l, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("unlabelled")))


@plan("M16", "WITH w AS (SELECT conv_id, turn, length(text) - length(replace(text, ' ', '')) + 1 AS n FROM conversations), p AS (SELECT conv_id, turn, n, lead(n) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM w) SELECT conv_id, turn, abs(n - m) AS extra FROM p WHERE m IS NOT NULL")
def transcript_verification(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("n", F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).withColumn("m", F.lead("n").over(w))
    return c.filter("m IS NOT NULL").select("conv_id", "turn", F.abs(F.col("n") - F.col("m")).cast("long").alias("extra"))


@plan(
    "M7",
    f"""
WITH {SOME_PAIRS}, r AS (SELECT a, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM p), d AS (SELECT a, round(1 - score, 5) AS v FROM r WHERE k = 5),
n AS (SELECT row_number() OVER (ORDER BY v, a) AS place, v, min(v) OVER () AS low, max(v) OVER () AS high, count(*) OVER () AS n FROM d),
g AS (SELECT place, v, round((place - 1) / (n - 1) - (v - low) / (high - low), 9) AS gap FROM n) SELECT place, v AS threshold FROM g ORDER BY gap DESC, place LIMIT 1""",
)
def knn_elbow(spark, sf):
    """The distance at which sorted distances of every twentieth vector to its fifth neighbour bend."""
    e = table(spark, sf, "embeddings")
    near = S.neighbours(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5, digits=12)
    return S.elbow_of(_fifth(near, "v"), "query", "v").select("place", F.col("v").alias("threshold"))


@plan("T8", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def merged_counters(spark, sf):
    """Counts of each task, merged by key."""
    return S.counter(table(spark, sf, "events"), ["user_id", "event_type"])
