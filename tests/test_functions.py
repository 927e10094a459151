import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarium.functions import config, distance, numbers, text
from glossarium.operators import intervals as I
from glossarium.operators import relational as R
from glossarium.operators import statistics as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.sanitised("t"), t="“A”​ – ﬁne… é") == '"A" - fine... '
    assert one(spark, text.mark_normalised("t"), t=" It's, OK! ") == "it'sok"
    assert one(spark, text.tokens("t"), t="It's 2 OK-s") == ["it's", "2", "ok", "s"]
    assert one(spark, text.cutoffs_named("t"), t="<cutoff> hello x") == "<cutoff-hello> hello x"
    assert one(spark, text.cutoffs_plain("t"), t="<cutoff-hello> hello") == "<cutoff> hello"
    assert one(spark, text.cjk_joined(text.cjk_tokens("t")), t="中文 ab字") == "中文AB字"
    assert one(spark, text.is_chinese("t"), t="中文ab") is True
    assert one(spark, text.without_position("t"), t="AH_B") == "AH" and one(spark, text.position("t"), t="AH_B") == "B"
    assert one(spark, text.stem("t"), t="/a/b.c/x.y.wav") == "x.y"
    assert text.Sanitizer()("Hello, [laughter] 'tis (an) end-") == ["hello", "[laughter]", "'tis", "(an)", "end"]
    assert text.Splitter({"aujourd", "hui", "chat"}, ["l'"])("l'chat") == ["l'", "chat"]
    assert text.packed_sentences("One two. Three four five six. Seven.", 4) == ["One two.", "Three four five six.", "Seven."]
    row = spark.createDataFrame([("the dog's bone",)], ["t"]).select(text.tokenizer(text.Sanitizer(), text.Splitter({"the", "dog", "'s"}, [], ["'s"]))("t").alias("x")).first().x
    assert row.normalized == "the dog 's bone" and row.oovs == ["bone"] and "g ' s" in row.characters


def test_numbers(spark):
    for t, s in (("1:02:03,5", 3723.5), ("2:03", 123.0), ("7", 7.0), ("x", None), ("1:2:3:4", None)):
        assert one(spark, numbers.seconds("t"), t=t) == s
    assert one(spark, numbers.tokens_of_seconds("s"), s=0.58) == 28
    assert one(spark, numbers.probability("p"), p=0.0) == 0.01
    assert one(spark, numbers.biased("v", [1.0, 2.0]), v=[0.5, 0.5]) == pytest.approx([0.8 / 3, 1.6 / 3])
    assert one(spark, numbers.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)


def test_distances():
    assert distance.edit_distance("kitten", "sitting") == 3
    assert distance.edit_distance("abcd", "d", "compat") <= distance.edit_distance("abcd", "d")
    assert distance.errors("a [x] b".split(), "a c".split()) == (1, 2, 1, 2)
    assert distance.label_error([["a", "b"], ["c"]], [["c"]]) == (0, 1)
    assert distance.rewriter("t", "", "$", "d")("k ae t") == "k ae d"
    assert distance.rewriter("t", "ae", "", "d")("t ae t") == "t ae d"
    x, y = [0, 1, 2, 3], [0, 1, 1, 5]
    p = distance.pchip(x, y, np.linspace(0, 3, 31))
    assert np.all(np.diff(p) >= -1e-12) and p[[0, 10, 20, 30]] == pytest.approx(y)
    assert distance.resample(np.array([[0.0], [2.0]]), np.array([0.5, 9.0]), np.array([False, True])).tolist() == [[1.0], [0.0]]


def test_config():
    files = {"a": {"x": {"y": 1, "z": [1]}}, "b": {"extends": "a", "x": {"z": [2]}}}
    assert config.resolved("b", files.__getitem__) == {"x": {"y": 1, "z": [2]}}
    assert config.overridden({"x": {"y": 1}}, "x.y=2.5", "n=null", "f=true") == {"x": {"y": 2.5}, "n": None, "f": True}


def test_folds():
    assert I.merge_segments([(0, 1), (1.1, 2), (5, 5.05), (6, 9)], 0.5, 10, 0.1, snap=False) == [(0, 2), (6, 9)]
    assert I.merge_segments([(0, 1), (1.2, 2)], 0.4, 1.5, 0.1) == [(0, 1.1), (1.1, 2)]
    assert I.monotone_anchors([(0, 0), (0, 0), (1, 0), (2, 1)]) == [(0, 0), (1, 1e-4), (2, 1)]
    assert I.without_plateaus([(0, 0), (0.1, 1), (0.2, 2), (5, 3)]) == [(0, 0), (0.2, 2), (5, 3)]
    assert I.find_subsequence("a b a b c".split(), ["b", "c"]) == 3
    assert I.utterance_durations([("a", 0, 1), ("b", 1, 3)], [["a"], ["x"]], 4.0) == [1, 3.0]
    assert I.remap_phones([("a", 0, 1), ("b", 1, 3), ("c", 3, 4)], {"c": ["d", "e"]}, {("a", "b"): "ab"}) == [("ab", 0, 3), ("d", 3, 3.5), ("e", 3.5, 4)]
    assert I.lcs_pairs("what are you doing".split(), "are you doing".split()) == [(1, 0), (2, 1), (3, 2)]
    assert R.split_sizes(2, 0.8) == (2, 0) and R.split_sizes(10, 0.8) == (8, 1) and R.split_sizes(3, 0.9) == (1, 1)
    assert R.greedy_loads([("a", 5), ("b", 3), ("c", 3)], 2) == {"a": 0, "b": 1, "c": 1}
    assert S.adjusted_mutual_information([(0, 0, 5), (1, 1, 5)]) == pytest.approx(1)


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    for n in (1, 7):
        out = R.numbered(df.repartition(n), ["k"], "n").orderBy("k").collect()
        assert [r.n for r in out] == list(range(1, 501))


def test_replace_and_gaps(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 2.0, 3.0, "b")], "u long, begin double, stop double, label string")
    cuts = spark.createDataFrame([(1, 2.5, 2.7)], "u long, cut_begin double, cut_stop double")
    assert sorted(tuple(r) for r in I.replace_overlaps(df, cuts, ["u"], 1.0).collect()) == [(1, 0.0, 1.0, "a"), (1, 2.5, 2.7, "oov")]
    edges = spark.createDataFrame([(1, 0.0, 4.0)], "u long, first double, last double")
    assert sorted(r.begin for r in I.with_gaps(df, ["u"], "sil", edges).collect()) == [0.0, 1.0, 2.0, 3.0]


def test_greedy_runs():
    rng = random.Random(5)
    for _ in range(300):
        counts, jobs = [(k, rng.choice((1, 2, 3, 7, 50, 51))) for k in range(rng.randrange(80))], rng.randrange(1, 6)
        order = [k for k, _ in sorted(counts, key=lambda x: (-x[1], str(x[0])))]
        runs = R.greedy_runs(list(collections.Counter(n for _, n in counts).items()), jobs)
        got = {order[p - 1]: turn[(p - start) % len(turn)] for _, start, stop, turn in runs for p in range(start, stop + 1)}
        assert got == R.greedy_loads(counts, jobs)


def test_greedy_job_packing_is_one_rule_at_every_size(spark, monkeypatch):
    from conftest import SMALL

    from glossarium.plans.relational import greedy_job_packing

    monkeypatch.setattr(R, "SMALL", 3, raising=False)
    rows = [tuple(r) for r in greedy_job_packing(spark, SMALL).select("user_id", "job").collect()]
    assert dict(rows) == R.greedy_loads(list(collections.Counter(u for u, _ in rows).items()), 4)


def test_rules_of_columns(spark):
    from glossarium.functions import distance as D

    words = ["s m a t", "t", "s m", "a s m t t", "", "t a t"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for rule in (("t", "", "$", "d"), ("s", "^", "m", "z"), ("t", "", "", "$1 x"), ("", "a", "", "q"), ("m a", "s", "t", "")):
        plain = D.rewriter(*rule)
        assert [r.x for r in df.select(D.rewritten(df.w, *rule).alias("x")).collect()] == [plain(w) for w in words]


def test_least_errors(spark):
    from glossarium.functions import distance as D

    rows = [(1, ["a b c", "a b"], "a b"), (2, ["a b c", "x y"], "a c"), (3, ["a"], ""), (4, ["a b", "a b c d"], "q r")]
    got = {r.k: (r.edits, r.length) for r in D.least_errors(spark.createDataFrame(rows, "k long, g array<string>, s string"), "g", "s", "k").collect()}
    assert got == {k: D.label_error([g.split() for g in golds], [s.split()]) for k, golds, s in rows}
