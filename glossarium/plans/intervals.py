"""Ordered and interval queries over `events`: a user's events are an utterance's phones, the gap to the next one a duration."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import table
from .base import plan


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `begin` and `stop` in seconds; a user's last event has no stop."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.withColumn("next_us", F.lead("us").over(w)).withColumn("begin", F.col("us") / 1e6).withColumn("stop", F.col("next_us") / 1e6)


GAPS = """e AS (SELECT *, epoch_us(ts) AS us FROM events),
g AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us FROM e)"""


@plan(
    "W8 A2 A3 J1 K3 L1",
    f"""WITH {GAPS},
d AS (SELECT user_id, event_type, value, (next_us - us) / 1e6 AS dur FROM g WHERE next_us IS NOT NULL),
s AS (SELECT event_type, avg(dur) AS m, stddev_samp(dur) AS sd FROM d GROUP BY event_type)
SELECT user_id, round(max(abs((dur - m) / sd)), 6) AS duration_deviation, round(avg(value), 6) AS mean_value, count(*) AS n_intervals
FROM d JOIN s USING (event_type) WHERE sd IS NOT NULL AND sd <> 0 GROUP BY user_id""",
)
def interval_duration_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest absolute z-score of a user's intervals against all intervals of the same label, and the mean value."""
    d = gaps(spark, sf_dir).filter("next_us IS NOT NULL").select("user_id", "event_type", "value", ((F.col("next_us") - F.col("us")) / 1e6).alias("dur"))
    s = d.groupBy("event_type").agg(F.avg("dur").alias("m"), F.stddev_samp("dur").alias("sd")).filter("sd IS NOT NULL AND sd <> 0")
    z = F.abs((F.col("dur") - F.col("m")) / F.col("sd"))
    return d.join(s, "event_type").groupBy("user_id").agg(F.round(F.max(z), 6).alias("duration_deviation"), F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n_intervals"))


@plan("A2", f"WITH {GAPS} SELECT user_id, round(min(us / 1e6), 6) AS begin, round(max(us / 1e6), 6) AS stop, count(*) AS n FROM g GROUP BY user_id")
def interval_boundary_refit(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("user_id").agg(F.round(F.min("begin"), 6).alias("begin"), F.round(F.max("begin"), 6).alias("stop"), F.count("*").alias("n"))


@plan("W2 A11", "WITH s AS (SELECT user_id, event_type, coalesce(lag(event_type) OVER w, '<s>') AS prev, coalesce(lead(event_type) OVER w, '</s>') AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT prev, event_type, nxt, count(*) AS n FROM s GROUP BY prev, event_type, nxt")
def silence_before_after_counts(spark, sf_dir):
    """Neighbours of each label with sentence marks at the ends, and their counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.coalesce(F.lag("event_type").over(w), F.lit("<s>")).alias("prev"), F.coalesce(F.lead("event_type").over(w), F.lit("</s>")).alias("nxt"))
    return e.groupBy("prev", "event_type", "nxt").agg(F.count("*").alias("n"))


ISLANDS = """f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 50 AS v, value FROM events),
c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY i) = v THEN 0 ELSE 1 END AS ch FROM f),
k AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS island FROM c)"""


def frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") > 50).alias("voiced"), "value", "event_type")


@plan("W4", f"WITH {ISLANDS} SELECT user_id, round(min(i) * 0.01::DOUBLE, 6) AS begin, round(CASE WHEN max(i) = max(last) THEN max(i) + 1 ELSE max(i) END * 0.01::DOUBLE, 6) AS stop FROM (SELECT k.*, max(i) OVER (PARTITION BY user_id) AS last FROM k) WHERE v GROUP BY user_id, island")
def voiced_islands(spark, sf_dir):
    out = I.voiced_segments(frames(spark, sf_dir), ["user_id"], "i", "voiced", 0.01)
    return out.select("user_id", F.round("begin", 6).alias("begin"), F.round("stop", 6).alias("stop"))


@plan("W6", """WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'view' AS v FROM events),
c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY user_id ORDER BY i) = v THEN 0 ELSE 1 END AS ch FROM f), k AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY i) AS island FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY i) AS place, sum(CASE WHEN v THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS total FROM k)
SELECT event_id FROM r WHERE NOT (v AND total > 10 AND place > 2)""")
def run_length_cap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(w).alias("i"))
    return I.cap_runs(e, ["user_id"], "i", "event_type", "view", 2, 10).select("event_id")


@plan("W7", f"""WITH {GAPS}, j AS (SELECT *, CASE WHEN us - lag(us) OVER w < 600000000000 AND lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM g WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
k AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY us, event_id) AS grp FROM j) SELECT user_id, round(min(us / 1e6), 6) AS begin, round(max(us / 1e6), 6) AS stop, string_agg(event_type, '+' ORDER BY us, event_id) AS label FROM k GROUP BY user_id, grp""")
def clitic_merge(spark, sf_dir):
    """Events joined to the one before if it is near and of the same type."""
    e = gaps(spark, sf_dir).select("user_id", F.col("begin"), F.col("begin").alias("stop"), "event_type")
    out = I.merge_with_previous(e, ["user_id"], "begin", "stop", "event_type", 600000.0, lambda a, b: a == b, "+")
    return out.select("user_id", F.round("begin", 6).alias("begin"), F.round("stop", 6).alias("stop"), F.col("event_type").alias("label"))


@plan("W18", """WITH s AS (SELECT event_id, user_id, ts, value, CASE WHEN value > 70 THEN true WHEN value < 30 THEN false END AS st FROM events)
SELECT event_id, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(value > 70) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS active FROM s""")
def hysteresis_segments(spark, sf_dir):
    return I.hysteresis(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 70.0, 30.0).select("event_id", "active")



@plan("J10", f"""WITH {GAPS}, p AS (SELECT event_id, user_id, (us % 1000000000000) / 1e6 AS mid FROM g), w AS (SELECT DISTINCT user_id, n * 90000.0 AS b, n * 90000.0 + 60000.0 AS e, n FROM events, generate_series(0, 11) t(n))
SELECT event_id, min(n) AS word FROM p LEFT JOIN w ON p.user_id = w.user_id AND mid >= b - 1e-6 AND mid <= e + 1e-6 GROUP BY event_id""")
def point_in_interval(spark, sf_dir):
    """Each event's word: an equality join on buckets, then the first that holds it."""
    p = gaps(spark, sf_dir).select("event_id", "user_id", ((F.col("us") % 1000000000000) / 1e6).alias("mid"))
    w = p.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("word")).select("user_id", (F.col("word") * 90000.0).alias("b"), (F.col("word") * 90000.0 + 60000.0).alias("e"), "word")
    return I.containing(p, w, ["user_id"], "mid", "b", "e", 90000.0).select("event_id", "word")


@plan("J12", f"""WITH {GAPS}, x AS (SELECT event_id, user_id, (us % 1000000000000) / 1e6 AS b, (us % 1000000000000) / 1e6 + 1000 AS e FROM g), w AS (SELECT DISTINCT user_id, n * 90000.0 AS cb, n * 90000.0 + 60000.0 AS ce FROM events, generate_series(0, 11) t(n))
SELECT event_id FROM x WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = x.user_id AND NOT (x.e <= w.cb OR x.b >= w.ce))""")
def overlap_anti(spark, sf_dir):
    x = gaps(spark, sf_dir).select("event_id", "user_id", ((F.col("us") % 1000000000000) / 1e6).alias("begin"))
    x = x.withColumn("stop", F.col("begin") + 1000)
    w = x.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("n")).select("user_id", (F.col("n") * 90000.0).alias("cut_begin"), (F.col("n") * 90000.0 + 60000.0).alias("cut_stop"))
    return I.without_overlaps(x, w, ["user_id"], 90000.0).select("event_id")


@plan("W11", """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type FROM events), s AS (SELECT user_id, i, event_type, CAST(round_even(i * 0.37::DOUBLE * 10, 0) AS BIGINT) AS a, CAST(round_even((i * 0.37::DOUBLE + 0.3::DOUBLE) * 10, 0) AS BIGINT) AS b FROM f),
fr AS (SELECT user_id, unnest(generate_series(0, n - 1)) AS frame FROM (SELECT user_id, count(*) * 4 AS n FROM f GROUP BY user_id)), c AS (SELECT fr.user_id, frame, arg_max(event_type, i) AS label FROM fr JOIN s ON fr.user_id = s.user_id AND frame >= a AND frame < b GROUP BY fr.user_id, frame)
SELECT fr.user_id, fr.frame, coalesce(label, 'sil') AS label FROM fr LEFT JOIN c USING (user_id, frame)""")
def frame_rasterise(spark, sf_dir):
    f = frames(spark, sf_dir)
    s = f.select("user_id", ((F.col("i") + 1) * 0.37).alias("begin"), ((F.col("i") + 1) * 0.37 + 0.3).alias("stop"), F.col("event_type").alias("label"))
    return I.rasterised(s, ["user_id"], "begin", "stop", "label", 10.0, f.groupBy("user_id").agg((F.count("*") * 4).alias("frames")), "sil")


@plan("W12", "WITH f AS (SELECT user_id, i, floor(i / 3) AS src, i * 0.5::DOUBLE AS tgt FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)), n AS (SELECT *, lead(src) OVER (PARTITION BY user_id ORDER BY i) AS s, lead(tgt) OVER (PARTITION BY user_id ORDER BY i) AS t FROM f) SELECT user_id, round(tgt, 6) AS begin, round(t, 6) AS stop FROM n WHERE abs(s - src) < 1e-4 AND t - tgt > 1e-4")
def silence_mask(spark, sf_dir):
    a = frames(spark, sf_dir).select("user_id", "i", F.floor(F.col("i") / 3).cast("double").alias("src"), (F.col("i") * 0.5).alias("tgt"))
    return I.inserted_silence(a, ["user_id"], "i", "src", "tgt").select("user_id", F.round("begin", 6).alias("begin"), F.round("stop", 6).alias("stop"))


@plan("F23 J17", f"""WITH {GAPS}, d AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, (us % 100000000000) / 1e6 AS b, (us % 100000000000) / 1e6 + value AS e FROM g)
SELECT x.pair, count(*) AS n, round(avg((pow(x.b - y.b, 2) + pow(x.e - y.e, 2)) / 2), 3) AS mse_boundary, round(avg(pow((x.b + x.e) / 2 - (y.b + y.e) / 2, 2)), 3) AS mse_center, round(avg(pow((x.e - x.b) - (y.e - y.b), 2)), 3) AS mse_duration
FROM d x JOIN d y ON x.pair = y.pair AND x.pos = y.pos AND x.side = 0 AND y.side = 1 GROUP BY x.pair""")
def interval_mse(spark, sf_dir):
    """Two users' i-th intervals side by side."""
    b = (F.col("us") % 100000000000) / 1e6
    d = gaps(spark, sf_dir).select(F.floor(F.col("user_id") / 2).cast("long").alias("pair"), (F.col("user_id") % 2).alias("side"), "us", "event_id", b.alias("b"), (b + F.col("value")).alias("e"))
    x = d.filter("side = 0").select("pair", "us", "event_id", F.col("b").alias("begin_a"), F.col("e").alias("stop_a"))
    y = d.filter("side = 1").select("pair", F.col("us").alias("us_b"), F.col("event_id").alias("event_b"), F.col("b").alias("begin_b"), F.col("e").alias("stop_b"))
    m = I.interval_mse(I.positional(x, y, ["pair"], ["us", "event_id"], ["us_b", "event_b"]), ["pair"])
    return m.select("pair", "n", *[F.round(c, 3).alias(c) for c in ("mse_boundary", "mse_center", "mse_duration")])


@plan("J11", """WITH f AS (SELECT user_id, i * 1.0::DOUBLE AS b, i * 1.0::DOUBLE + CASE WHEN i % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS e, event_type FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type FROM events)),
g AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY b) AS pe FROM f), t AS (SELECT user_id, min(b) AS a, max(e) AS z FROM f GROUP BY user_id)
SELECT user_id, b AS begin, e AS stop, event_type AS label FROM f UNION ALL SELECT user_id, pe, b, 'sil' FROM g WHERE pe < b UNION ALL SELECT user_id, 0.0::DOUBLE, a, 'sil' FROM t WHERE 0 < a""")
def reference_gaps(spark, sf_dir):
    """Intervals with the silences between and before them."""
    n = F.col("i") + 1
    f = frames(spark, sf_dir).select("user_id", n.cast("double").alias("begin"), (n + F.when(n % 3 == 0, 0.5).otherwise(1.0)).alias("stop"), F.col("event_type").alias("label"))
    edges = f.groupBy("user_id").agg(F.lit(0.0).alias("first"), F.max("stop").alias("last"))
    return I.with_gaps(f, ["user_id"], "sil", edges)


@plan("W5 T7")
def segment_merge(spark, sf_dir):
    """Users' events as short segments, merged over pauses within a longest length."""
    import pandas as pd

    def merge(pdf):
        p = pdf.sort_values("begin")
        return pd.DataFrame([(p.user_id.iloc[0], a, b) for a, b in I.merge_segments(list(zip(p.begin, p.begin + 60.0)), 20000.0, 90000.0, 61.0)], columns=["user_id", "begin", "stop"])

    return I.folded(gaps(spark, sf_dir).select("user_id", "begin"), ["user_id"], merge, "user_id long, begin double, stop double")


@plan("J18 W9 W10")
def lcs_alignment(spark, sf_dir):
    """Common words of neighbouring turns, as anchors with rising targets."""
    import pandas as pd

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("other", F.lead("text").over(w)).filter("other IS NOT NULL")

    def align(pdf):
        rows = []
        for r in pdf.itertuples():
            pairs = I.lcs_pairs((r.text or "").split(), r.other.split())
            anchors = I.without_plateaus(I.monotone_anchors([(float(a), float(b)) for a, b in pairs]))
            rows.append((r.conv_id, r.turn, len(pairs), len(anchors)))
        return pd.DataFrame(rows, columns=["conv_id", "turn", "n_common", "n_anchors"])

    return I.folded(t, ["conv_id"], align, "conv_id long, turn long, n_common long, n_anchors long")


@plan("P15", f"WITH {GAPS} SELECT event_id, event_type AS label FROM g WHERE event_type NOT IN ('', 'sp', 'sil', '<eps>', 'view') AND next_us > us")
def spoken_intervals(spark, sf_dir):
    """Intervals with a length whose label isn't silence (here `view` stands for one of the silent labels)."""
    return gaps(spark, sf_dir).filter(~F.col("event_type").isin("", "sp", "sil", "<eps>", "view") & (F.col("next_us") > F.col("us"))).select("event_id", F.col("event_type").alias("label"))


@plan("J13", "SELECT c.c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c.c_custkey) AS largest, (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F') AS finished FROM customer c")
def decorrelated_subqueries(spark, sf_dir):
    """What would be two queries a row, as one aggregate and one join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("largest"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "largest", F.coalesce("finished", F.lit(0)).alias("finished"))


@plan("F37", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, date_trunc('day', ts) AS day FROM events")
def json_and_dates(spark, sf_dir):
    """Beyond the inventory: JSON paths and calendar arithmetic in SQL."""
    e = table(spark, sf_dir, "events")
    e.createOrReplaceTempView("glossarium_events")
    return spark.sql("SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k, cast(date_trunc('day', ts) AS timestamp_ntz) AS day FROM glossarium_events")


@plan("M14 M16")
def interval_alignment(spark, sf_dir):
    """Each even user's intervals against the next user's, aligned by least cost in utterances of 60."""
    import pandas as pd

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    f = gaps(spark, sf_dir).filter("next_us IS NOT NULL").withColumn("utterance", F.floor((F.row_number().over(w) - 1) / 60).cast("long"))
    f = f.select(F.floor(F.col("user_id") / 2).cast("long").alias("pair"), (F.col("user_id") % 2).alias("side"), "utterance", "begin", "stop", "event_type")

    def align(pdf):
        p = pdf.sort_values("begin")
        a, b = ([(x.begin / 3600, x.stop / 3600, x.event_type) for x in p[p.side == s].itertuples()] for s in (0, 1))
        return pd.DataFrame([(p.pair.iloc[0], p.utterance.iloc[0], *I.align_intervals(a, b))], columns=["pair", "utterance", "boundary_error", "error_rate", "n_matched"])

    return I.folded(f, ["pair", "utterance"], align, "pair long, utterance long, boundary_error double, error_rate double, n_matched long")


@plan("W13", "SELECT conv_id, turn, CASE WHEN turn = max(turn) OVER w THEN count(*) OVER w - CAST(0.5 AS DOUBLE) * (count(*) OVER w - 1) ELSE CAST(0.5 AS DOUBLE) END AS seconds FROM conversations WINDOW w AS (PARTITION BY conv_id)")
def utterance_durations(spark, sf):
    """Durations of a conversation's turns from aligned words, found one after the other; the last one isn't among the words and has what is left."""
    import pandas as pd

    from ..operators import intervals as I

    def run(pdf):
        p = pdf.sort_values("turn")
        words = [(f"{r} {t}".split()[0], float(k), k + 0.5) for k, (r, t) in enumerate(zip(p.role, p.turn))]
        found = I.utterance_durations(words, [*([w] for w, _, _ in words[:-1]), ["missing"]], float(len(p)))
        return pd.DataFrame({"conv_id": p.conv_id, "turn": p.turn, "seconds": found})

    return I.folded(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], run, "conv_id long, turn long, seconds double")


@plan(
    "W14",
    """
WITH c AS (SELECT c_nationkey, c_custkey, c_mktsegment AS s, lead(c_mktsegment) OVER w AS next, lag(c_mktsegment) OVER w AS prev, row_number() OVER w - 1 AS i FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))
SELECT c_nationkey, 'MH' AS label, CAST(i AS DOUBLE) AS start, CAST(i + 2 AS DOUBLE) AS stop FROM c WHERE s = 'MACHINERY' AND next = 'HOUSEHOLD'
UNION ALL SELECT c_nationkey, 'B' || h, i + h * CAST(0.5 AS DOUBLE), i + h * CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) FROM c, (VALUES (0), (1)) AS t(h) WHERE s = 'BUILDING'
UNION ALL SELECT c_nationkey, s, CAST(i AS DOUBLE), CAST(i + 1 AS DOUBLE) FROM c
WHERE s <> 'BUILDING' AND NOT (s = 'MACHINERY' AND coalesce(next, '') = 'HOUSEHOLD') AND NOT (s = 'HOUSEHOLD' AND coalesce(prev, '') = 'MACHINERY')""",
)
def phones_remapped(spark, sf):
    """Labels of each nation's sequence: one becomes two that share its time, two in a row become one."""
    from ..operators import intervals as I

    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return I.remapped(c, ["c_nationkey"], "c_custkey", "c_mktsegment", {"BUILDING": ["B0", "B1"]}, {("MACHINERY", "HOUSEHOLD"): "MH"})


@plan(
    "J12",
    """
WITH a AS (SELECT c_nationkey AS k, CAST(c_custkey AS DOUBLE) AS start, c_custkey + CAST(0.75 AS DOUBLE) AS stop, c_name AS label FROM customer),
b AS (SELECT s_nationkey AS k, s_suppkey * CAST(7.5 AS DOUBLE) AS start, s_suppkey * CAST(7.5 AS DOUBLE) + 3 AS stop FROM supplier)
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND a.stop > b.start AND a.start < b.stop) UNION ALL SELECT k, start, stop, 'oov' FROM b""",
)
def overlaps_replaced(spark, sf):
    """Intervals that touch a cut give way to one interval for it."""
    from ..operators import intervals as I

    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    a = c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").cast("double").alias("begin"), (F.col("c_custkey") + F.lit(0.75).cast("double")).alias("stop"), F.col("c_name").alias("label"))
    at = F.col("s_suppkey") * F.lit(7.5).cast("double")
    b = s.select(F.col("s_nationkey").alias("k"), at.alias("cut_begin"), (at + 3).alias("cut_stop"))
    return I.replace_overlaps(a, b, ["k"], 8.0).withColumnRenamed("begin", "start")
