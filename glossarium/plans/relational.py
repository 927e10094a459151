"""Scans, predicates, joins, snapshots, samples and set operations over the stored tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import shared_folder, table
from .base import plan


@plan("S24 P1 P2 P3 P5", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_id FROM lineitem WHERE l_quantity > 45 AND (l_discount BETWEEN 0.05 AND 0.07 OR l_tax = 0)")
def scan_project_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Derived columns over range, disjunction and equality predicates that reach the scan."""
    t = table(spark, sf, "lineitem").filter("l_quantity > 45 AND (l_discount BETWEEN 0.05D AND 0.07D OR l_tax = 0)")
    return t.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"))


@plan("J2 A6 A1", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) = 0")
def speakers_with_zero_utterances(spark, sf):
    """Customers without orders: outer join, count of the right side, having."""
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")).filter("n = 0").select("c_custkey")


@plan("J2 A1", "SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def speaker_utterance_counts(spark, sf):
    """Counts with zeros kept; orders are aggregated before the join."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    j = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@plan("J3", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def files_without_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@plan("J3 J4", "SELECT doc_id FROM labels l WHERE doc_id IN (SELECT doc_id FROM documents) AND quality = 0")
def text_with_files(spark, sf):
    return table(spark, sf, "labels").filter("quality = 0").select("doc_id").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")


@plan("J6 U2", "SELECT doc_id AS key FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT item_id FROM benchmark")
def keyed_intersection_three_way(spark, sf):
    k = lambda t, c: table(spark, sf, t).select(F.col(c).alias("key"))
    return R.intersect_keys([k("documents", "doc_id"), k("labels", "doc_id"), k("benchmark", "item_id")], "key")


@plan("J5", "SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS \"user\", max(CASE WHEN role = 'assistant' THEN turn END) AS assistant FROM conversations GROUP BY conv_id HAVING count(CASE WHEN role = 'user' THEN turn END) > 0 AND count(CASE WHEN role = 'assistant' THEN turn END) > 0")
def pair_roles_r1_r2(spark, sf):
    """Pairs of the two roles of a conversation, the last turn of each."""
    return R.pair_roles(table(spark, sf, "conversations"), "conv_id", "role", "turn", ["user", "assistant"])


@plan("J8 W1 A22", """SELECT a.o_orderkey, min(CASE WHEN b.o_orderpriority = a.o_orderpriority THEN 0 ELSE 1 END) AS preference,
arg_min(b.o_orderkey, (CASE WHEN b.o_orderpriority = a.o_orderpriority THEN 0 ELSE 1 END, b.o_orderkey)) AS choice
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey <> a.o_orderkey AND (b.o_orderpriority = a.o_orderpriority OR b.o_orderpriority = '1-URGENT') GROUP BY a.o_orderkey""")
def prompt_choice_with_fallback(spark, sf):
    """Another order of the customer with the same priority, else an urgent one, the smallest key first."""
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_custkey", "o_orderpriority")
    b = o.select(F.col("o_orderkey").alias("other"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("prio"))
    same = F.col("prio") == F.col("o_orderpriority")
    on = (F.col("o_custkey") == F.col("cust")) & (F.col("other") != F.col("o_orderkey")) & (same | (F.col("prio") == "1-URGENT"))
    return R.preferred(a, b, on, F.when(same, 0).otherwise(1), ["o_orderkey"], "other")


@plan("K11", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders")
def bulk_update_snapshot(spark, sf):
    """An update from values, explicit nulls included, as a new snapshot."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    values = o.filter("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return R.bulk_update(o, values, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@plan("K14 A7 K13", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def insert_ignore_distinct(spark, sf):
    """Insert of distinct pairs where a part of them is there already."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    return R.insert_ignore(rows.filter("l_partkey % 2 = 0").distinct(), rows, ["l_suppkey", "l_partkey"])


@plan("K16 M9", "SELECT user_id, CASE WHEN n >= 60 THEN CAST(user_id AS VARCHAR) ELSE 'unknown-' || CAST(user_id % 10 AS VARCHAR) END AS speaker, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE NOT n < 5")
def delete_below_threshold_reassign(spark, sf):
    """Small clusters go, middling ones are handed to pools."""
    n = R.delete_where(table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")), F.col("n") < 5)
    return n.select("user_id", F.when(F.col("n") >= 60, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("unknown-"), F.col("user_id") % 10)).alias("speaker"), "n")


@plan("P7 K15", "SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS in_subset FROM orders")
def semi_in_subquery_flag(spark, sf):
    return R.flag_in(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_orderkey"), "in_subset")


@plan("P9 P14", r"SELECT doc_id FROM documents WHERE (regexp_matches(text, '(\s\S+){100}') OR source = 'src3') AND n_chars < 40000 AND (lang IS NULL OR lang <> 'de') AND NOT starts_with(source, 'src1')")
def regex_multiword_filter(spark, sf):
    """Many words or a marked source, and the other tests of a training subset. `{k}` finds what `{k,}` would, without recursing over a long text."""
    c = (F.col("text").rlike(r"(\s\S+){100}") | (F.col("source") == "src3")) & (F.col("n_chars") < 40000) & (F.col("lang").isNull() | (F.col("lang") != "de")) & ~F.col("source").startswith("src1")
    return table(spark, sf, "documents").filter(c).select("doc_id")


@plan("P8 P5 P6", "SELECT p_partkey FROM part WHERE (p_name LIKE 'a%' OR starts_with(p_type, 'S')) AND p_size NOT IN (1, 2, 3)")
def prefix_or_filter(spark, sf):
    return table(spark, sf, "part").filter((F.col("p_name").startswith("a") | F.col("p_type").startswith("S")) & ~F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@plan("P4 P17", "SELECT count(*) > 0 AS any_unlabelled, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def null_probe(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").filter("hit IS NULL")
    return j.agg((F.count("*") > 0).alias("any_unlabelled"), F.count("*").alias("n"))


@plan("P10 F4", "SELECT d.doc_id, NOT (len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), x -> x <> '')) < 80 OR coalesce(n_chars / 5000.0, 0) > 0.8) AS keep FROM documents d".replace("x -> x", "lambda x: x"))
def quality_gate_keep(spark, sf):
    """Few words or a bad rate: either one drops the row."""
    words = F.size(F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != ""))
    return table(spark, sf, "documents").select("doc_id", (~((words < 80) | (F.coalesce(F.col("n_chars") / 5000, F.lit(0.0)) > 0.8))).alias("keep"))


@plan("P11 P12 J4", "SELECT doc_id FROM documents WHERE text <> '' AND source <> '' AND doc_id IN (SELECT doc_id FROM labels WHERE quality >= 1)")
def threshold_semi_filter(spark, sf):
    good = table(spark, sf, "labels").filter("quality >= 1").select("doc_id")
    return table(spark, sf, "documents").filter("text <> '' AND source <> ''").select("doc_id").join(good, "doc_id", "left_semi")


@plan("S16 A22", """WITH r AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'too_short' WHEN n_chars > 6000 THEN 'too_long' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rn FROM r WHERE reason IS NOT NULL)
SELECT reason, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS examples FROM k GROUP BY reason""")
def reject_reason_tally(spark, sf):
    """The first failing check wins; counts and three examples."""
    d = table(spark, sf, "documents").select("doc_id", R.reject_reason([("too_short", F.col("n_chars") < 300), ("too_long", F.col("n_chars") > 6000), ("language", F.col("lang") != "en")]).alias("reason"))
    return R.reject_tally(d, "reason", "doc_id").select("reason", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@plan("L4 L2 P14", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 500) ORDER BY md5(CAST(doc_id AS VARCHAR) || '|1234'), doc_id LIMIT 50")
def subset_shortest_then_hash(spark, sf):
    return R.subset_shortest_then_random(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50, 1234).select("doc_id")


@plan("L5 L6", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 200")
def hash_sample(spark, sf):
    return R.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 200, 42)


@plan("L7", """WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT n, greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n)) AS t FROM n),
o AS (SELECT n, CASE WHEN (n - t) // 2 = 0 AND n >= 3 THEN 1 ELSE (n - t) // 2 END AS v FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|7'), doc_id) AS k FROM documents)
SELECT doc_id, CASE WHEN k <= n - 2 * v THEN 'train' WHEN k <= n - v THEN 'val' ELSE 'test' END AS split FROM r, o""")
def split_train_val_test(spark, sf):
    """Exact sizes by rank; the rank is numbered by ranges, not in one task."""
    return R.split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8, 7)


@plan("L8 L1", "SELECT doc_id, toxic, n_chars FROM documents JOIN labels USING (doc_id) WHERE n_chars > 100 ORDER BY toxic, n_chars, doc_id LIMIT 20")
def topk_composite(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").filter("n_chars > 100").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return j.orderBy("toxic", "n_chars", "doc_id").limit(20).select("doc_id", "toxic", "n_chars")


@plan("L9 L1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def longest_first(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@plan("L10", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_keep_first(spark, sf):
    return R.keep_first(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@plan("L11", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def distinct_on_first(spark, sf):
    """DISTINCT ON as an aggregate: no sort of whole groups."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


@plan("L3", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) AS k FROM orders) WHERE k > 1000 AND k <= 1250")
def paged_scan_lexical(spark, sf):
    """A page of an order by text keys: offset and limit."""
    return table(spark, sf, "orders").select("o_orderkey").orderBy(F.col("o_orderkey").cast("string")).offset(1000).limit(250)


@plan("A8", "SELECT CAST(sum(CASE WHEN n >= 30 THEN n ELSE 0 END) AS BIGINT) AS over_30, CAST(sum(CASE WHEN n >= 15 THEN n ELSE 0 END) AS BIGINT) AS over_15, CAST(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) AS BIGINT) AS over_5 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def two_level_cutoff_sum(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.agg(*[F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)).cast("long").alias(f"over_{k}") for k in (30, 15, 5)])


@plan("A5 A2", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(min(l_discount), 6) AS low, round(max(l_extendedprice), 2) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
def groupby_default_lexicon_avg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.min("l_discount"), 6).alias("low"), F.round(F.max("l_extendedprice"), 2).alias("high"))


@plan("A9 J16", "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS phones FROM events GROUP BY user_id")
def string_agg_ordered(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return g.select("user_id", F.array_join(F.transform("x", lambda e: e["event_type"]), " ").alias("phones"))


@plan("A10 K21", "SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey) AS p_partkey, s_suppkey FROM supplier")
def next_key_allocation(spark, sf):
    return R.next_keys(table(spark, sf, "part"), table(spark, sf, "supplier").select("s_suppkey"), "p_partkey", ["s_suppkey"])


@plan("A23", "SELECT round(sum(value), 6) AS inference, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) AS audio, CASE WHEN sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) = 0 THEN 0 ELSE round(sum(value) / sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) END AS rtf FROM events")
def timing_rollup(spark, sf):
    a = F.sum(F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0))
    return table(spark, sf, "events").agg(F.round(F.sum("value"), 6).alias("inference"), F.round(a, 6).alias("audio"), F.when(a == 0, 0.0).otherwise(F.round(F.try_divide(F.sum("value"), a), 6)).alias("rtf"))


@plan("A24", "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_distinct(spark, sf):
    """Beyond the inventory: grouping sets and distinct aggregates."""
    g = table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))
    return g.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "suppliers")


@plan("U1", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def union_all(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@plan("U2", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@plan("U3", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 25")
def set_except(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf, "lineitem").filter("l_quantity > 25").select("l_partkey"))


@plan("U4 J20", "SELECT k, priority, row_number() OVER (ORDER BY priority, k) AS number FROM (SELECT k, CAST(min(p) AS BIGINT) AS priority FROM (SELECT DISTINCT event_type AS k, 0 AS p FROM events UNION ALL SELECT DISTINCT lang, 1 FROM documents UNION ALL SELECT DISTINCT role, 2 FROM conversations) GROUP BY k)")
def catalogue_union(spark, sf):
    c = lambda t, k: table(spark, sf, t).select(F.col(k).alias("k")).distinct()
    return R.catalogue([(0, c("events", "event_type")), (1, c("documents", "lang")), (2, c("conversations", "role"))], "k")


@plan("U5", """WITH RECURSIVE r AS (SELECT DISTINCT user_id + 200 AS k FROM events UNION SELECT CASE WHEN k % 2 = 0 THEN k // 2 ELSE k - 1 END FROM r WHERE k > 1) SELECT k FROM r""")
def rule_closure(spark, sf):
    """Rewriting until nothing is new."""
    start = table(spark, sf, "events").select((F.col("user_id") + 200).alias("k")).distinct()
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    step = lambda d: d.filter("k > 1").select(F.when(F.col("k") % 2 == 0, (F.col("k") / 2).cast("long")).otherwise(F.col("k") - 1).alias("k"))
    return R.closure(start, step, ["k"])


@plan("W16", "SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 AS pool FROM documents")
def round_robin_pools(spark, sf):
    return R.round_robin(table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 4)


@plan(
    "W15",
    """
WITH RECURSIVE c AS (SELECT user_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS i FROM events GROUP BY user_id),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS user_id, CAST(-1 AS BIGINT) AS job, CAST([0, 0, 0, 0] AS BIGINT[]) AS l
  UNION ALL SELECT c.i, c.user_id, CAST(list_position(l, list_min(l)) - 1 AS BIGINT), [CASE WHEN k = list_position(l, list_min(l)) THEN l[k] + c.n ELSE l[k] END FOR k IN [1, 2, 3, 4]] FROM g JOIN c ON c.i = g.i + 1)
SELECT event_id, e.user_id, job FROM events e JOIN g ON e.user_id = g.user_id""",
)
def greedy_job_packing(spark, sf):
    """Users dealt to four jobs by event counts, the largest first, each to the job with the least so far. Users of equal counts are dealt in turns,
    so the driver sees the distinct counts only."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    counts = e.groupBy("user_id").agg(F.count("*").alias("n"))
    runs = [(r.n, r.users) for r in counts.groupBy("n").agg(F.count("*").alias("users")).collect()]
    turns = spark.createDataFrame(R.greedy_runs(runs, 4), "n long, start long, stop long, turn array<long>")
    order = counts.select("user_id", (-F.col("n")).alias("least"), F.coalesce(F.col("user_id").cast("string"), F.lit("None")).alias("key"))
    dealt = R.numbered(order, ["least", "key"], "place").join(F.broadcast(turns), (F.col("least") == -F.col("n")) & F.col("place").between(F.col("start"), F.col("stop")))
    return e.join(dealt.select("user_id", F.expr("turn[(place - start) % size(turn)]").alias("job")), "user_id")


@plan("W19", "SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS number FROM part")
def homophone_rank(spark, sf):
    return R.ranked(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"], ["p_partkey"], "number")


@plan("K20", """WITH w AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word)
SELECT word, n, n > 50 AND word IN (SELECT word FROM w JOIN labels USING (doc_id) WHERE quality = 0) AS included FROM c""")
def vocabulary_flag(spark, sf):
    """Words that are frequent and occur in a subset's texts."""
    words = F.explode(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " ")).alias("word")
    w = table(spark, sf, "documents").select("doc_id", words).filter("word <> ''")
    c = w.groupBy("word").agg(F.count("*").alias("n"))
    sub = w.join(table(spark, sf, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi").select("word")
    return R.flag_in(c, "word", sub, "used").select("word", "n", ((F.col("n") > 50) & F.col("used")).alias("included"))


@plan("A25", "SELECT role, min(conv_id * 1000 + turn) AS first_seen, count(*) AS n FROM conversations GROUP BY role")
def group_first_seen(spark, sf):
    c = table(spark, sf, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "turn")
    return R.groups_first_seen(c, "role", "at", "turn").select("role", "first_seen", "n")


@plan("J1 J6", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000")
def foreign_key_joins(spark, sf):
    """A chain of key joins; the two smallest tables have 25 and 5 rows."""
    o = table(spark, sf, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@plan("J7 J9", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_label' ELSE 'ok' END AS status, coalesce(l.quality, b.item_id % 2, -1) AS resolved FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def lookup_with_fallback(spark, sf):
    """Direct lookup, a second source, a default; what is missing is said, not dropped."""
    d = R.lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "missing_label")
    d = d.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), (F.col("item_id") % 2).alias("second")), "doc_id", "left")
    return d.select("doc_id", "status", F.coalesce(F.col("quality").cast("long"), "second", F.lit(-1)).alias("resolved"))


@plan("J14", "SELECT r_name, n AS repeat_idx, r_name || '_' || CAST(n AS VARCHAR) AS sample_key FROM region, generate_series(1, 3) t(n)")
def cross_repeats(spark, sf):
    """Samples times repeats as an explode."""
    return table(spark, sf, "region").select("r_name", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("repeat_idx")).withColumn("sample_key", F.concat_ws("_", "r_name", "repeat_idx"))


@plan("P16", "SELECT event_id, coalesce(nullif(trim(event_type), ''), 'none') AS kind, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), -1) AS k FROM events")
def first_nonempty(spark, sf):
    e = table(spark, sf, "events").withColumn("digits", F.regexp_extract("props", "([0-9]+)", 1))
    return e.select("event_id", F.coalesce(R.first_filled("event_type"), F.lit("none")).alias("kind"), R.float_or(-1.0, "digits").alias("k"))


@plan("P18", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def optional_parameter_lookup(spark, sf):
    return table(spark, sf, "orders").filter(R.optional_filters(o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)).select("o_orderkey")


@plan("P13", "SELECT conv_id, CAST(sum(len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> ''))) AS BIGINT) AS words FROM conversations GROUP BY conv_id HAVING sum(len(list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda x: x <> ''))) >= 40")
def min_total_words(spark, sf):
    words = F.size(F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != ""))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(words).cast("long").alias("words")).filter("words >= 40")


@plan("K17", "SELECT event_id FROM events WHERE false")
def truncate_intervals(spark, sf):
    return table(spark, sf, "events").select("event_id").limit(0)


@plan(
    "W17",
    """
SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense_place, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS in_a_month
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
def window_functions(spark, sf):
    """Ranks with ties, quarters, and frames by rows and by time within each customer."""
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    by = Window.partitionBy("o_custkey")
    rank, order = by.orderBy("o_orderpriority"), by.orderBy("o_orderdate", "o_orderkey")
    month = by.orderBy(F.unix_micros("o_orderdate")).rangeBetween(-30 * 86_400_000_000, 0)
    return o.select(
        "o_orderkey", F.rank().over(rank).cast("long").alias("place"), F.dense_rank().over(rank).cast("long").alias("dense_place"), F.ntile(4).over(order).cast("long").alias("quarter"),
        F.round(F.sum("o_totalprice").over(order.rowsBetween(-2, 0)), 2).alias("last_three"), F.count(F.lit(1)).over(month).alias("in_a_month"),
    )


SETS = """
SELECT 'union' AS kind, k FROM (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier) UNION ALL
SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier) UNION ALL
SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
SELECT 'except all', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL
SELECT 'intersect all', k FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT l_suppkey FROM lineitem)"""


@plan("U6", SETS)
def set_operations(spark, sf):
    """SQL's set operations, with and without repeats."""
    return spark.sql(SETS.replace("FROM orders", "FROM {orders}").replace("FROM supplier", "FROM {supplier}").replace("FROM customer", "FROM {customer}").replace("FROM lineitem", "FROM {lineitem}"), **{t: table(spark, sf, t) for t in ("orders", "supplier", "customer", "lineitem")})


@plan(
    "J19",
    """
SELECT strategy, o_orderpriority, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES ('merge'), ('shuffle_hash'), ('broadcast')) AS s(strategy) GROUP BY ALL
UNION ALL SELECT 'as of', o_orderpriority, event_type, count(*) FROM (
  SELECT o_orderpriority, (SELECT event_type FROM events WHERE user_id = o_custkey % 100 AND ts <= timestamp '2024-01-01' + to_minutes(o_orderkey % 50000) ORDER BY ts DESC, event_id DESC LIMIT 1) AS event_type
  FROM orders) GROUP BY ALL""",
)
def join_strategies(spark, sf):
    """One equality join by each named strategy, and an as-of join by time as a running last value over both sides' rows."""
    o, c, e = (table(spark, sf, t) for t in ("orders", "customer", "events"))
    few = c.limit(200_001).count() <= 200_000  # a side is broadcast only if it is small; the others need no bound
    out = []
    for name in ("merge", "shuffle_hash", "broadcast"):
        right = c.select("c_custkey", "c_mktsegment").hint(name if few or name != "broadcast" else "merge")
        out.append(o.join(right, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("strategy"), "o_orderpriority", "c_mktsegment", "n"))
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=(F.col("o_orderkey") % 50000).cast("int"))
    left = o.select((F.col("o_custkey") % 100).alias("user_id"), at.alias("ts"), F.lit(1).alias("side"), "o_orderkey", "o_orderpriority")
    R_ = e.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("side"), F.col("event_id").alias("o_orderkey"), "event_type")
    both = left.unionByName(R_, allowMissingColumns=True)
    last = F.last("event_type", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "side", "o_orderkey"))
    seen = both.withColumn("event_type", last).filter("side = 1").groupBy("o_orderpriority", F.col("event_type").alias("c_mktsegment")).agg(F.count(F.lit(1)).alias("n"))
    out.append(seen.select(F.lit("as of").alias("strategy"), "o_orderpriority", "c_mktsegment", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@plan("T10", "SELECT p_partkey, length(p_name) - length(replace(p_name, 'e', '')) AS es, unnest(string_split(p_name, ' ')) AS word FROM part")
def registered_functions(spark, sf):
    """A function of a column and one that makes rows, registered by name and called from SQL."""
    import pandas as pd

    @F.pandas_udf("long")
    def letter_count(s: pd.Series, letter: pd.Series) -> pd.Series:
        return pd.Series([(a or "").count(b) for a, b in zip(s, letter)])

    @F.udtf(returnType="word string")
    class NameWords:
        def eval(self, name: str):
            for w in (name or "").split(" "):
                yield (w,)

    spark.udf.register("letter_count", letter_count)
    spark.udtf.register("name_words", NameWords)
    return spark.sql("SELECT p_partkey, letter_count(p_name, 'e') AS es, w.word FROM {part}, LATERAL name_words(p_name) w", part=table(spark, sf, "part"))


@plan("F34", "SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN 0.5 ELSE CAST(n_nationkey AS DOUBLE) END AS rate, n_regionkey <> 1 AS flag, 'base' AS kind FROM nation")
def config_overrides(spark, sf):
    """A configuration for each nation on top of its region's, which is on top of a base; changes are given as text."""
    from ..functions import config as C

    rows = table(spark, sf, "nation").collect()  # 25 rows at any size
    files = {"base": {"model": {"kind": "base", "rate": 1.0}, "flag": True}}
    files |= {f"r{r}": {"extends": "base"} | ({"flag": False} if r == 1 else {}) for r in {x.n_regionkey for x in rows}}
    files |= {x.n_name: {"extends": [f"r{x.n_regionkey}"], "model": {"rate": float(x.n_nationkey)}} for x in rows}
    found = [(x.n_name, C.overridden(C.resolved(x.n_name, files.__getitem__), *(["model.rate=0.5"] if x.n_regionkey == 0 else []))) for x in rows]
    return spark.createDataFrame([(n, float(c["model"]["rate"]), c["flag"], c["model"]["kind"]) for n, c in found], "name string, rate double, flag boolean, kind string")
