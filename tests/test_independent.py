"""Queries that SQL can't express, against plain Python written for this test."""

import collections
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL

from glossarium.operators import intervals as I
from glossarium.plans import all_plans


def stored(name):
    return pd.read_parquet(f"{SMALL}/{name}.parquet")


@pytest.fixture(scope="module")
def run(spark):
    plans = {p.name: p for p in all_plans()}
    return lambda name: plans[name].run(spark, SMALL).toPandas()


def table_of(a, b, same):
    """Least edits of two sequences and the length of their longest common subsequence."""
    edits, common = list(range(len(b) + 1)), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        left_e, left_c, edits[0] = edits[0], 0, i
        for j, y in enumerate(b, 1):
            up_e, up_c = edits[j], common[j]
            edits[j] = min(up_e + 1, edits[j - 1] + 1, left_e + (not same(x, y)))
            common[j] = left_c + 1 if same(x, y) else max(up_c, common[j - 1])
            left_e, left_c = up_e, up_c
    return edits[-1], common[-1]


def turns():
    t = stored("conversations").sort_values(["conv_id", "turn"])
    t["other"] = t.groupby("conv_id").text.shift(-1)
    return t[t.other.notna()]


def test_word_and_character_errors(run):
    want = collections.defaultdict(lambda: [0, 0])
    for r in turns().itertuples():
        a, b = ([w for w in (s or "").split() if w[:1] not in "[<{"] for s in (r.text, r.other))
        want[r.role][0] += table_of(a, b, str.__eq__)[0]
        want[r.role][1] += len(a)
    got = {r.role: [r.word_edits, r.word_length] for r in run("wer_cer").itertuples()}
    assert got == dict(want)


def test_common_words_of_turns(run):
    got = {(r.conv_id, r.turn): r.n_common for r in run("lcs_alignment").itertuples()}
    for r in turns().itertuples():
        low = lambda s: [w.strip().lower() for w in (s or "").split()]
        assert got[r.conv_id, r.turn] == table_of(low(r.text), low(r.other), str.__eq__)[1]


def test_states_by_a_loop(run):
    e = stored("events").sort_values(["ts", "event_id"])
    got = {r.user_id: (r.steps, r.state) for r in run("belief_states").itertuples()}
    for user, rows in e.groupby("user_id"):
        belief = [1.0] + [0.0] * 7
        for v in rows.value:
            moved = [0.7 * b for b in belief]
            for k in range(8):
                moved[min(k + 1, 7)] += 0.3 * belief[k]
            belief = [m * np.exp(-0.5 * ((k * 12.5 - v) / 25) ** 2) for k, m in enumerate(moved)]
            belief = [b / sum(belief) for b in belief]
        assert got[user] == (len(rows), int(np.argmax(belief)))


def test_texts_in_normal_form(run):
    got = {r.doc_id: r.clean for r in run("sanitise_composed").itertuples()}
    for r in stored("documents").itertuples():
        plain = unicodedata.normalize("NFKC", r.text or "")
        assert not set(got[r.doc_id]) - set(map(chr, range(128)))
        assert re.sub(r"[^a-z0-9]", "", got[r.doc_id].lower()) in re.sub(r"[^a-z0-9]", "", plain.lower()) or not plain.isascii()


def test_sentence_pieces_hold_the_text(run):
    got = collections.defaultdict(list)
    for r in run("sentence_pieces").sort_values(["doc_id", "piece"]).itertuples():
        got[r.doc_id].append(r.body)
    for r in stored("documents").itertuples():
        pieces = got[r.doc_id]
        assert "".join("".join(pieces).split()) == "".join((r.text or "").split())
        assert all(a and b for a, b in zip(pieces, pieces[1:]))


def test_clusters_are_at_rest_or_nearest(run):
    got = run("kmeans_clusters").set_index("vec_id").cluster
    v = stored("embeddings").set_index("vec_id")
    x = np.stack(v.embedding.map(np.asarray)).astype(float)
    own = got.loc[v.index].to_numpy()
    means = {k: x[own == k].mean(0) for k in set(own)}
    inside = np.mean([np.linalg.norm(a - means[k]) for a, k in zip(x, own)])
    rng = np.random.default_rng(1)
    apart = [rng.permutation(own) for _ in range(3)]
    other = np.mean([np.linalg.norm(a - x[p == k].mean(0)) for p in apart for a, k in zip(x, p)])
    near = np.mean([k == min(means, key=lambda c: np.linalg.norm(a - means[c])) for a, k in zip(x, own)])
    assert len(means) == 10 and inside < other and near > 0.9


def test_paths_rise_within_their_anchors(run):
    got = run("warp_path_pchip")
    for _, rows in got.groupby("user_id"):
        rows = rows.sort_values("frame")
        assert (np.diff(rows.source) >= -1e-9).all() and list(rows.frame) == list(range(len(rows)))


def test_merged_segments(run):
    got = run("segment_merge")
    for _, rows in got.groupby("user_id"):
        rows = rows.sort_values("begin")
        assert (rows.stop > rows.begin).all() and (rows.begin.to_numpy()[1:] >= rows.stop.to_numpy()[:-1] - 1e-9).all()
    assert I.merge_segments([(0.0, 1.0), (1.2, 2.0), (9.0, 9.5)], 0.5, 10.0, 0.1, snap=False) == [(0.0, 2.0), (9.0, 9.5)]


def test_alignments_by_all_ways():
    """Least costs of small alignments by trying every way."""
    rng = np.random.default_rng(2)

    def ways(a, b):
        if not a or not b:
            return 2.0 * (len(a) + len(b))
        cost = abs(a[0][0] - b[0][0]) + abs(a[0][1] - b[0][1]) + 2.0 * (a[0][2] != b[0][2])
        return min(cost + ways(a[1:], b[1:]), 2.0 + ways(a[1:], b), 2.0 + ways(a, b[1:]))

    for _ in range(40):
        a, b = ([(float(k), k + 0.5, "xy"[int(rng.integers(2))]) for k in sorted(rng.choice(8, int(rng.integers(0, 5)), replace=False))] for _ in (0, 1))
        error, rate, matched = I.align_intervals(a, b)
        assert 0 <= rate <= 2 and matched <= min(len(a), len(b))
        wrong = round(rate * max(len(a), len(b), 1))
        assert ways(a, b) <= 2.0 * (len(a) + len(b)) and (wrong or ways(a, b) == pytest.approx(2 * error * matched))


#: Words with their times in the source and the target, as in the alignment cases of the survey's fixtures.
CASES = {
    "a word fewer": ([("what", 0.0, 0.2), ("are", 0.2, 0.4), ("you", 0.4, 0.6), ("doing", 0.6, 1.0)], [("are", 0.1, 0.3), ("you", 0.3, 0.5), ("doing", 0.5, 0.9)], ["are", "you", "doing"]),
    "a filler": ([("um", 0.0, 0.3), ("hello", 0.3, 0.6), ("world", 0.6, 1.04)], [("hello", 0.0, 0.38), ("world", 0.76, 1.24)], ["hello", "world"]),
    "nothing shared": ([("a", 0.0, 0.5)], [("b", 0.0, 0.5)], []),
}


@pytest.mark.parametrize("case", CASES)
def test_alignment_cases(spark, case):
    source, target, shared = CASES[case]
    pairs = I.lcs_pairs([w for w, _, _ in source], [w for w, _, _ in target])
    assert [source[i][0] for i, _ in pairs] == [target[j][0] for _, j in pairs] == shared
    anchors = [(1, float(k), x, y) for k, (x, y) in enumerate((s, t) for i, j in pairs for s, t in zip(source[i][1:], target[j][1:]))]
    if anchors:
        df = spark.createDataFrame(anchors, "f long, place double, source double, target double")
        gaps = [(r.begin, r.stop) for r in I.inserted_silence(df, ["f"], "place", "source", "target").collect()]
        assert gaps == ([(0.38, 0.76)] if case == "a filler" else [])
