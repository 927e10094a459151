"""Language models and lattices against plain Python."""

import itertools
import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from glossarium.operators import language_models as L
from glossarium.operators import lattices as A
from glossarium.sources.readers import backoff_probability

TEXTS = ["a b a c", "a b", "", "c", "b a b a b d", "a c a c", None, "d d d d a", "a b a c"]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(spark, order, tmp_path):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    words = F.filter(F.split("text", " "), lambda x: x != "")
    model = L.kneser_ney(df, words, order)
    rows = {r.words: (r.probability, r.backoff) for r in model.collect()}
    vocabulary = [w for w in {*"abcd", "</s>", "<unk>"}]
    assert set(w for w in rows if " " not in w) == {*vocabulary, "<s>"} and rows["<s>"][0] == 0
    histories = [h for n in range(order) for h in itertools.product([*"abcd", "<s>"], repeat=n) if "<s>" not in h[1:]]
    for h in histories:
        assert math.isclose(sum(backoff_probability(rows, [*h, w]) for w in vocabulary), 1, rel_tol=1e-9), h
    path = str(tmp_path / "model")
    L.arpa_lines(model).write.text(path)
    back = {r.words: (r.n, r.probability, r.backoff) for r in L.read_arpa(spark, path).collect()}
    assert set(back) == set(rows)
    for w, (n, p, b) in back.items():
        assert n == len(w.split()) and math.isclose(p, rows[w][0], rel_tol=1e-6, abs_tol=1e-12) and (b is None) == (rows[w][1] is None) and (b is None or math.isclose(b, rows[w][1], rel_tol=1e-6))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert {"\\data\\", "\\end\\", "\\1-grams:", f"ngram {order}={sum(len(w.split()) == order for w in rows)}"} <= set(lines)


def test_model_of_nothing(spark):
    df = spark.createDataFrame([], "text string")
    assert {r.words: r.probability for r in L.kneser_ney(df, F.split("text", " "), 2).collect()} == {"<s>": 0.0, "<unk>": 1.0}


def brute_rest(decoded, original, said, cost=4.0):
    """Every way: which decoded words are interjections."""
    best = None
    for put in itertools.product([False, True], repeat=len(decoded)):
        taken, ok, last = 0, True, False
        for w, p in zip(decoded, put):
            if p:
                ok &= w in said and not last
            else:
                ok &= taken < len(original) and original[taken] == w
                taken += 1
            last = p
        if ok and (best is None or (sum(put) * cost, -taken) < best):
            best = (sum(put) * cost, -taken)
    return None if best is None else original[-best[1] :]


def test_interjections_by_every_way(spark):
    rows = [(list(d), list(o)) for n in range(5) for d in itertools.islice(itertools.product("abu", repeat=n), 0, None, 2) for o in ("", "a", "ab", "aub", "uab", "uuab", "abab")]
    df = spark.createDataFrame([(i, d, o) for i, (d, o) in enumerate(rows)] + [(-1, None, ["a"]), (-2, ["a"], None)], "k long, d array<string>, o array<string>")
    got = {r.k: r.rest for r in df.select("k", A.rest_of_text("d", "o", ["u", "um"]).alias("rest")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert got == {i: brute_rest(d, o, {"u", "um"}) for i, (d, o) in enumerate(rows)}


def ways(letters, phones, shape, i=0, j=0):
    """All ways through a lattice, without its code."""
    if (i, j) == (len(letters), len(phones)):
        yield []
    for a in range(shape[0] + 1):
        for b in range(shape[1] + 1):
            if {(a, b)} & ({(1, 1), (1, 2), (2, 1)} | ({(0, 1), (1, 0)} if shape[2] else set())) and i + a <= len(letters) and j + b <= len(phones):
                s = (A.PART.join(letters[i : i + a]) or A.SKIP) + A.SIDES + (A.PART.join(phones[j : j + b]) or A.SKIP)
                yield from ([s, *rest] for rest in ways(letters, phones, shape, i + a, j + b))


@pytest.mark.parametrize("skips", [True, False])
def test_joint_model_by_enumeration(spark, skips):
    pairs = [("the", "TE", 3), ("than", "Tan", 2), ("hat", "hat", 1), ("at", "at", 4), ("tax", "taks", 1), ("a", "a", 2), ("axe", "aks", 1)]
    df = spark.createDataFrame([(list(a), list(b), n) for a, b, n in pairs] + [(None, ["a"], 1), (["a"], None, 1)], "l array<string>, p array<string>, n long").repartition(3)
    shape = (2, 2, skips)
    model = A.JointModel(df, "l", "p", "n", *shape, rounds=4, gain=-1.0)
    every = [list(ways(list(a), list(b), shape)) for a, b, _ in pairs]
    symbols = {s for w in every for way in w for s in way}
    weights, likelihoods = dict.fromkeys(symbols, 1 / len(symbols)), []
    for _ in range(4):
        counts, log = dict.fromkeys(symbols, 0.0), 0.0
        for (_, _, n), w in zip(pairs, every):
            p = [math.prod(weights[s] for s in way) for way in w]
            if sum(p):
                log += n * math.log(sum(p))
                for way, x in zip(w, p):
                    for s in way:
                        counts[s] += n * x / sum(p)
        total = sum(counts.values())
        weights, likelihoods = {s: c / total for s, c in counts.items()}, [*likelihoods, log]
    assert likelihoods == pytest.approx(model.likelihoods) and all(b >= a - 1e-9 for a, b in itertools.pairwise(likelihoods))
    assert all(model.weights.get(s, 0.0) == pytest.approx(w, abs=1e-9) for s, w in weights.items())
    found = {("".join(r.l or "-"), "".join(r.p or "-")): r for r in model.aligned(df, "l", "p").collect()}
    for (a, b, _), w in zip(pairs, every):
        best = max((math.prod(model.weights.get(s, 0.0) for s in way) for way in w), default=0.0)
        r = found[a, b]
        assert r.likelihood == pytest.approx(best, rel=1e-6) and ((r.alignment is None) if not best else r.alignment.split(" ") in w and math.prod(model.weights[s] for s in r.alignment.split(" ")) == pytest.approx(best))


def test_alignment_of_conversations(spark):
    from glossarium.plans import all_plans

    rows = {p.name: p for p in all_plans()}["joint_alignment"].run(spark, SMALL).collect()
    th = [r.alignment for r in rows if "th" in r.word and r.alignment]
    assert rows and sum("t|h}T" in a for a in th) > 0.9 * len(th)


def test_joint_model_of_long_and_empty_pairs(spark):
    long = "".join("abc"[i * i % 7 % 3] for i in range(400))  # its ways' products are below the least number
    df = spark.createDataFrame([(list(long), list(long.upper()), 1), ([], [], 1), (["a"], [], 2), ([], ["A"], 2)], "l array<string>, p array<string>, n long")
    model = A.JointModel(df, "l", "p", "n", rounds=3, gain=-1.0)
    assert {"a}A", "b}B", "c}C"} <= set(model.weights) and model.likelihoods[-1] > model.likelihoods[0] and model.likelihoods[0] < -700
    got = {("".join(r.l), "".join(r.p)): r.alignment for r in model.aligned(df, "l", "p").collect()}
    assert got["", ""] == "" and got["a", ""] == "a}_" and got["", "A"] == "_}A" and "".join(x.split("}")[0].strip("_").replace("|", "") for x in got[long, long.upper()].split(" ")) == long


def test_word_edits_by_recursion():
    import functools
    import random

    rng = random.Random(3)
    for _ in range(150):
        r, w = [[rng.choice("abc") for _ in range(rng.randrange(7))] for _ in range(2)]
        m = [rng.randrange(1, 9) for _ in w]

        @functools.cache
        def least(i, j):
            if i == 0 and j == 0:
                return (0, 0)
            every = []
            if i:
                every.append((least(i - 1, j)[0] + 1, least(i - 1, j)[1]))
            if j:
                every.append((least(i, j - 1)[0] + 1, least(i, j - 1)[1] + m[j - 1]))
            if i and j:
                every.append((least(i - 1, j - 1)[0] + (r[i - 1] != w[j - 1]), least(i - 1, j - 1)[1]))
            return min(every)

        assert A.word_edits(r, w, m) == least(len(r), len(w))


def test_transcript_errors_of_odd_rows(spark):
    word = "array<struct<label:string,begin:double,stop:double>>"
    rows = [(1, ["a", "b"], [("b", 1.0, 1.5), ("a", 0.0, 0.5), ("sil", 0.5, 1.0)]), (2, [], [("x", 0.0, 0.25)]), (3, ["a"], [("a", 0.0, 0.03)]), (4, None, [("a", 0.0, 1.0)]), (5, ["a"], None), (6, ["a"], [])]
    got = {r.k: (r.edits, r.word_error, r.extra_duration, r.transcript) for r in A.transcript_errors(spark.createDataFrame(rows, f"k long, r array<string>, w {word}"), "r", "w", ["k"]).collect()}
    assert got == {1: (0, 0.0, 0.0, "a b"), 2: (1, None, 0.25, "x")}
