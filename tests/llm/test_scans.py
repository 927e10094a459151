"""License scans, collocations and vector codes against SQL, brute force and odd rows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from compare import assert_same
from conftest import SMALL
from pyspark.sql import functions as F

from glossarium.llm import collocations as C
from glossarium.llm import license_scan as L
from glossarium.llm import vector_codes as V
from glossarium.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_collocations", "op13_vector_codes"])
def test_same_as_sql(spark, name):
    assert_same(queries()[name](spark, SMALL), oracle_sql()[name], SMALL)


# licenses


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w, places = lowered(text), []
    for label, phrase in L.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x for _, x in places}))


NOTICE = dict((text, label) for label, text in L.NOTICES)


def changed(text):
    w = text.split()
    return " ".join([*w[: len(w) // 2], "just", "here", *w[len(w) // 2 :]])


LICENSED = [
    (1, None), (2, ""), (3, "x"), (4, "Under the MIT license"), (5, "under the mit\nLICENSE under-the-mit-license"), (6, "Apache License, Version 2.0. CC BY-NC CC BY NC"), (7, "cc by n c"),
    (8, "under the KMIT license"), (9, "İunder the mit license"), (10, "under the mit license" * 2), (11, "word " * 30_000 + "cc by-nc"), (11, "word " * 30_000 + "cc by-nc"), (None, "...under THE mit licenses"), (12, "Éunder the mit licenseé"),
]


def test_base_places(spark):
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in LICENSED], "doc_id long, text string, row string, words int").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.license_labels(df).collect())
    assert got == collections.Counter((i, *brute_base(t)) for i, t in LICENSED)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in L.license_labels(df).collect())
    assert L.license_labels(df.limit(0)).count() == 0 and L.license_spans(df.limit(0)).count() == 0


def test_notices_with_changed_words(spark):
    filler = "alpha beta gamma delta " * 40
    rows = [(i, filler + text + " " + filler) for i, text in enumerate(NOTICE)]
    rows += [(100 + i, filler + changed(text) + " " + filler) for i, text in enumerate(NOTICE)]
    rows += [(200 + i, filler + " ".join(text.split()[: len(text.split()) // 2]) + " " + filler) for i, text in enumerate(NOTICE) if len(text.split()) > 15]
    rows += [(300, filler), (301, f"{rows[0][1]} {rows[0][1]}")]
    got = {r.doc_id: r for r in L.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (text, label) in enumerate(NOTICE.items()):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert label in got[100 + i].labels.split(",") or len(lowered(text)) < 20  # a tenth of its words may be put in
        if 200 + i in got and label != "apache-2":  # half of that one holds the phrase
            assert label not in got[200 + i].labels.split(",")
    assert got[300].labels == "" and got[300].score == 0.0
    first = next(iter(NOTICE))
    places = sorted((r.first_word, r.last_word) for r in L.license_spans(spark.createDataFrame(rows, "doc_id long, text string").filter("doc_id = 301")).filter(F.col("label") == NOTICE[first]).filter("share = 1").collect())
    n, k, one = len(lowered(filler)), len(lowered(first)), len(lowered(rows[0][1]))
    assert places == [(n, n + k - 1), (one + n, one + n + k - 1)]


def test_scan_has_no_python(spark):
    plan = L.license_labels(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# phrases


def brute_phrases(rows, least, inside=80, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        found, candidates = [], {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_phrases_by_brute_force(spark, size):
    rng = np.random.default_rng(3)
    words = [*"abcdefg", "Ä", "ä", "日本", "x\x01y", "q r"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\t", "  ", " . ", ",", "\r\n", " "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(n))
    rows = [(rng.choice(["en", "de", ""]), text(int(rng.integers(0, 80)))) for _ in range(60)]
    rows += [(None, "a b c d " * 40), ("en", None), (None, ""), ("fr", " "), ("en", " ".join(words[:4] * 300)), ("de", "longword" * 40 + " a b " * 30)]
    df = spark.createDataFrame([(l if l is None else str(l), t, "n", 3) for l, t in rows], "lang string, text string, phrase string, n long").repartition(4)
    got = {tuple(r) for r in C.collocations(df, least=12, top=25, size=size).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_phrases(rows, 12, top=25)
    assert C.collocations(df.limit(0)).count() == 0


def test_blocks_lose_no_follower():
    for text, size in ((b"aa bb cc dd ee ff gg hh ii jj kk", 9), (b"a b. c d e f g h i j k l m n", 6), (b"x" * 50 + b" a b c d e", 8), (b"a b c", 2), (b"", 4), (b"ab" * 40, 8)):
        want = collections.Counter()
        for piece in re.split(rb"[.]", text):
            w = piece.split()
            want.update(tuple(w[i : i + 4]) for i in range(len(w)))
        got = collections.Counter()
        for block, tail in C.blocks(text, size):
            words = C.Words(block, tail)
            names = [words.distinct[i].as_py().encode() for i in words.at]
            for i in np.flatnonzero(words.starts):
                j = i
                while j - i < 3 and words.together[j]:
                    j += 1
                got[tuple(names[i : j + 1])] += 1
        assert got == want


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = parts * -(-max(len(r[1]) for r in kept) // parts)
    x = np.array([[int(np.floor(1024 * float(np.float32(y)))) for y in r[1]] + [0] * (width - len(r[1])) for r in kept], dtype=object)
    codes, errors, books = [], [0] * len(kept), []
    for p in range(parts):
        part = [list(map(int, row[p * width // parts : (p + 1) * width // parts])) for row in x]
        book = [list(e) for e in part[:entries]]
        near = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book)) for v in part]  # noqa: E731, B023
        for _ in range(rounds):
            at = [i for _, i in near()]
            for i in range(len(book)):
                mine = [v for v, j in zip(part, at) if j == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine)]
        found = near()
        codes.append([f"{i:02x}" for _, i in found])
        errors = [e + d for e, (d, _) in zip(errors, found)]
        books += [c for e in book for c in e]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    total = collections.Counter()
    for r, e in zip(kept, errors):
        total[r[2]] += e
    return collections.Counter((r[0], "".join(c), e, total[r[2]], digest) for r, c, e in zip(kept, zip(*codes), errors))


def test_codes_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.choice([-1.0, -0.5, 0.25, 0.75, 1.0], 8).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1], None) for i in range(40)] + [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 2), (2004, [3.5, -2.0], 1), (7, rows[3][1], 1), (None, [0.5] * 8, None)]
    schema = "vec_id long, embedding array<float>, label int, code string, error int"
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], schema).repartition(3)
    for leaf, entries in ((4, 16), (32, 256), (1, 5)):
        monkeypatch.setattr(V, "LEAF", leaf)
        got = collections.Counter(tuple(r) for r in V.compressed(df, entries=entries, rounds=3).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
        assert got == brute_codes(rows, 4, entries, 3)
    assert V.compressed(df.limit(0)).count() == 0 and V.compressed(df.filter("vec_id = 2000")).count() == 0


def test_boxes_leave_out_entries(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-20, 20, (400, 4)) + c for c in ([0, 0, 0, 0], [900, 0, 0, 0], [0, 900, 0, 0])]).astype(np.int64)
    tree, book = V.Tree.unpacked(V.Tree(points).packed()), points[[0, 400, 800, 1]]
    codes, sums, counts = V.Filter(book).assign(tree)
    want = (((tree.points[:, None] - book[None]) ** 2).sum(2)).argmin(1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=4)).all() and (sums == np.array([tree.points[want == i].sum(0) for i in range(4)])).all()
    assert (tree.points == points[tree.order]).all()
