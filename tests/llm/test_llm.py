"""The training-data operators against brute force, exact round trips and held-out labels, and on odd rows."""

import collections
import hashlib
import itertools
import os
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossarium.llm import decontamination as D
from glossarium.llm import exact_dedup as E
from glossarium.llm import html_extraction as H
from glossarium.llm import html_layouts, labelled
from glossarium.llm import near_dedup as N
from glossarium.llm import packing as P
from glossarium.llm import pseudonyms as S
from glossarium.llm import quality, suffix_dedup, token_counts, tokens, toxicity
from glossarium.llm.common import Tables, components, relabelled

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def prose(seed, n, words=WORDS):
    rng = np.random.default_rng(seed)
    return [words[i] for i in rng.integers(len(words), size=n)]


def odd_rows(spark):
    """Null and empty texts, a null identifier, repeated rows, a long text, and columns with clashing names."""
    long = " ".join(prose(1, 20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same  text\nhere "), (None, "same text here"), (6, long), (7, "x" * 50_000), (8, "☃ é 中文"), (9, "!!! ???")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "n", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, seq long, tag string, score long, toxicity long")
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# exact copies


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {(i, re.sub(r"[\x20\x09-\x0D]", "", t or "")): (min(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")])[3], len(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")])) for i, t in rows}


def test_exact_dedup(spark):
    df = odd_rows(spark)
    want = brute_exact([(r.doc_id, r.text) for r in df.collect()])
    got = E.exact_dedup(df).collect()
    assert len(got) == df.count()
    by = {(r.doc_id, r.text_sha256): r for r in got}
    for (i, norm), (keep, n) in want.items():
        r = by[i, hashlib.sha256(norm.encode()).hexdigest()]
        assert (r.keep_id, r.group_size) == (keep, n)
    assert sum(r.kept for r in got) == len({n for _, n in want})
    assert E.kept_rows(df).columns == df.columns and E.kept_rows(df).count() == len({n for _, n in want})
    assert E.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_verifies_bytes(spark, monkeypatch):
    """With digests of one character most hits are impostors; the result is the same, and copies of one text are dealt to several tasks."""
    monkeypatch.setattr(E, "SPLIT", 3)
    df = spark.createDataFrame([(i, f"text {i % 9} " + " " * (i % 3)) for i in range(60)], "doc_id long, text string")
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    weak = E.exact_dedup(df, digest=lambda sha: F.substr(sha, F.lit(1), F.lit(1)))
    assert sorted(map(tuple, weak.select(key).collect())) == sorted(map(tuple, E.exact_dedup(df).select(key).collect()))


def test_index_probe(spark):
    index = E.DigestIndex(spark)
    index.insert(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    index.insert(spark.createDataFrame([(3, "a ")], "doc_id long, text string"))
    assert sorted(r.id for r in index.probe([hashlib.sha256(b"a").hexdigest()]).collect()) == [1, 3]
    assert {(r.keep_id, r.n) for r in index.compact().collect()} == {(3, 2), (2, 1)}


# packing and tokens


def check_packing(pieces, texts):
    tokenizer = tokens.WordPieces(tokens.tokenizer_path("word_bpe_49k.json")).tokenizer
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    at, seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id].append((p.start, p.length))
        seq[p.sequence_id].append((p.offset, p.length))
    for i, spans in at.items():
        assert [s for s, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1]] and sum(n for _, n in spans) == len(ids[i])
    assert set(at) == set(ids)
    for spans in seq.values():
        spans = sorted(spans)
        total = sum(n for _, n in spans)
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and total <= 4096 and total & (total - 1) == 0


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 9000), (-4, "a <|endoftext|> ΣΑΣ é It's")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    check_packing(P.pack_sequences(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert P.pack_sequences(empty(spark)).count() == 0
    odd, tokenizer = odd_rows(spark), tokens.WordPieces(tokens.tokenizer_path("word_bpe_49k.json")).tokenizer
    want = sorted((r.doc_id or 0, 1 + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = P.pack_sequences(odd).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == want  # repeated and null identifiers too
    assert sum(r.length for r in got) == sum(n for _, n in want)


def test_tokens_with_small_tables():
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:80]
    w = tokens.WordPieces(tokens.tokenizer_path("word_bpe_49k.json"), keep=50)
    for i in range(0, 80, 8):
        for t, ids in zip(texts[i : i + 8], w.encode(texts[i : i + 8])):
            assert np.frombuffer(ids, "<u4").tolist() == w.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v, u = token_counts.zipf_vocabulary(tokens.tokenizer_path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(v, unk_id=u, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.PieceCounter(v, u)
    rng = np.random.default_rng(3)
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:40] + ["", " ", " a  b ", "☃☃<unk><unk> x", "▁x", "a" * 3000]
    texts += ["".join(rng.choice(list(" ab▁☃é\n中😀th")) for _ in range(30)) for _ in range(100)]
    assert [c.count(t) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd_rows(spark)).collect()}[1] == 0
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_ties_keep_the_first_start():
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁", -1.5), ("▁a", -2.5)]
    tok = Tokenizer(models.Unigram(v, unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.PieceCounter(v, 0)
    for t in map("".join, itertools.product("abc ", repeat=5)):
        assert c.count(t) == len(tok.encode(t).ids)


# near copies


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (60, 40)], "a long, b long")
    want, tables = {**{i: 0 for i in range(31)}, 50: 40, 40: 40, 60: 40}, Tables(spark)
    assert {r.node: r.label for r in components(edges, tables).collect()} == want
    labels = relabelled(None, edges.filter("a % 3 > 0"), tables)
    assert {r.node: r.label for r in relabelled(labels, edges.filter("a % 3 = 0"), tables).collect()} == want
    assert components(edges.limit(0), tables).count() == 0


def test_tables_are_taken_away(spark):
    tables = Tables(spark)
    a, b = tables.write(spark.range(3), "a"), tables.write(spark.range(4), "b")
    where = {p for _, p in tables.kept}
    tables.drop(a, None)
    assert b.count() == 4 and len(tables.kept) == 1 and sum(map(os.path.exists, where)) == 1


def near_texts():
    base = prose(5, 120)
    rows = []
    for k in range(60):  # copies with more and more changes, so that some are alike only through others
        t, rng = list(base), np.random.default_rng(k)
        for p in rng.choice(120, k % 12, replace=False):
            t[p] = f"new{k}x{p}"
        rows.append(" ".join(t))
    return rows + [" ".join(prose(100 + k, 80)) for k in range(20)] + [rows[3].upper(), rows[3]]


def test_near_dedup_finds_every_class(spark):
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = N.NearDuplicates(df)
    got = {r.doc_id: r.class_id for r in run.classes().collect()}
    sh = N.Shingler(run.idf.value)
    w = [sh.weighted(sh.words(t)) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if N.similarity(w[i], w[j]) >= N.LEAST and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert [got[i] for i, _ in rows] == label


def all_pair_links(run, texts):
    """Pairs of texts that are similar enough, by comparing all."""
    sh = N.Shingler(run.idf.value)
    w = [sh.weighted(sh.words(t)) for t in texts]
    return [(i, j) for i, j in itertools.combinations(range(len(w)), 2) if len(w[i][0]) and len(w[j][0]) and N.similarity(w[i], w[j]) >= N.LEAST]


def test_near_dedup_recall_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    run = N.NearDuplicates(docs)
    got, rows = {r.doc_id: r.class_id for r in run.classes().collect()}, docs.select("doc_id", "text").collect()
    links = [(rows[i].doc_id, rows[j].doc_id) for i, j in all_pair_links(run, [r.text or "" for r in rows])]
    assert links and sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    linked = {x for pair in links for x in pair}
    assert all(got[r.doc_id] == r.doc_id for r in rows if r.doc_id not in linked and N.WORD.search(r.text or ""))


def test_near_dedup_of_long_texts_and_hubs(spark, monkeypatch):
    """Texts of 20 000 words that differ a little, and one hub's partners dealt to several tasks."""
    monkeypatch.setattr(N, "SPLIT", 4)
    long, base = prose(70, 20_000), prose(71, 100)
    rows = [" ".join(long), " ".join([*long[:9000], "other", *long[9000:]]), " ".join(prose(72, 20_000))]
    rows += [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 90, 3)]
    got = {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [0, 0, 2, *[3] * 30]


def test_sampling_estimates_similarity():
    sh = N.Shingler(np.ones(N.SLOTS, np.float32))
    a, b = " ".join(prose(1, 300)), " ".join(prose(1, 250) + prose(2, 50))
    x, y = sh.weighted(sh.words(a)), sh.weighted(sh.words(b))
    hits = np.mean([p == q for p, q in zip(N.bands(*x), N.bands(*y))])
    assert N.bands(*x) == N.bands(*sh.weighted(sh.words(a))) and 0 <= hits <= 1 and 0.5 < N.similarity(x, y) < 0.9


def test_near_dedup_odd_rows(spark):
    df = odd_rows(spark)
    got = N.near_classes(df).collect()
    assert len(got) == df.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[4] == by[5] == by[None] == {4} and by[1] == by[2] == {1} and by[3] == {3} and by[9] == {9}
    kept = N.kept_rows(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 4, 6, 7, 8, 9]
    assert N.near_classes(empty(spark)).count() == 0


# repeated passages


def test_suffix_dedup(spark):
    shared, edge = prose(9, 70), prose(8, 55)
    rows = [(0, prose(20, 40) + shared + prose(21, 30)), (1, shared + prose(22, 60)), (2, prose(23, 90) + shared), (3, prose(24, 200)), (4, prose(25, 30) + edge), (5, edge + prose(26, 30)), (6, prose(27, 10) + shared[:30] + prose(28, 50)), (7, prose(29, 5) + shared[:40] + prose(31, 50)), (8, [])]
    rows += [(9, prose(30, 10) + shared[:45] + edge[:20] + prose(32, 9)), (10, shared[5:45] + edge[:20] + prose(33, 9))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(99, None)], "doc_id long, text string")
    got = suffix_dedup.repeated_passages(df).collect()
    grams = collections.defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    want = {i for s in grams.values() if len(s) > 1 for i in s}
    assert {r.doc_id for r in got} == want == {0, 1, 2, 4, 5, 9, 10}
    spans = {(r.doc_id, r.start_word, r.stop_word) for r in got}
    assert {(0, 40, 110), (1, 0, 70), (2, 90, 160), (4, 30, 85), (5, 0, 55)} <= spans
    assert suffix_dedup.repeated_passages(empty(spark)).count() == 0
    assert suffix_dedup.repeated_passages(odd_rows(spark)).filter("n_words < 50").count() == 0


def lost_pairs(spark, pairs):
    """Numbers of the pairs of texts of which a document isn't found."""
    rows = [(2 * i + k, " ".join(words)) for i, pair in enumerate(pairs) for k, words in enumerate(pair)]
    got = {r.doc_id for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [i for i in range(len(pairs)) if not {2 * i, 2 * i + 1} <= got]


def test_suffix_dedup_of_a_notice_twice_in_the_first_document(spark):
    """The second document has the notice with what follows its second place in the first one."""
    pairs = []
    for i in range(60):
        n, own = (45, 10) if i % 2 else (40, 15), [prose(10_000 + 10 * i + k, 60) for k in range(5)]
        notice, tail = prose(20_000 + i, n[0]), prose(30_000 + i, n[1])
        pairs.append(([*own[0], *notice, *own[1], *notice, *tail, *own[2]], [*own[3], *notice, *tail, *own[4]]))
    assert lost_pairs(spark, pairs) == []


def test_suffix_dedup_of_the_end_of_repeated_lines(spark):
    """Two documents repeat a line, one more often, and go on alike."""
    pairs = []
    for i in range(90):
        width, more, less, after = ((12, 6, 4, 10), (10, 8, 4, 15), (12, 3, 2, 26))[i % 3]
        line, tail, own = prose(40_000 + i, width), prose(50_000 + i, after), [prose(60_000 + 10 * i + k, 60) for k in range(4)]
        pair = [[*own[0], *line * more, *tail, *own[1]], [*own[2], *line * less, *tail, *own[3]]]
        pairs.append(tuple(pair[:: 1 - 2 * (i // 3 % 2)]))
    assert lost_pairs(spark, pairs) == []


def test_suffix_dedup_deals_a_text_of_many_partners(spark, monkeypatch):
    """All places of a passage that many documents share, by all windows of fifty words, whatever the size of a slice."""
    shared = prose(70_000, 64)
    rows = [(i, [*prose(70_001 + i, 20 + i % 7), *shared[: 50 + i % 15], *prose(71_000 + i, 15)]) for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = []
    for size in (4, 1024):
        monkeypatch.setattr(suffix_dedup, "SPLIT", size)
        got.append({(r.doc_id, r.start_word, r.stop_word, r.kept) for r in suffix_dedup.repeated_passages(df).collect()})
    assert got[0] == got[1]
    copies = {(i, a, b) for i, a, b, kept in got[0] if not kept}
    first = rows[0][1]
    for i, w in rows[1:]:
        best = max((next((k for k in range(min(len(first) - p, len(w) - q)) if first[p + k] != w[q + k]), min(len(first) - p, len(w) - q)), -q) for p in range(len(first)) for q in range(len(w)))
        assert (i, -best[1], -best[1] + best[0]) in copies or best[0] < 50


def test_suffix_dedup_of_one_word_over_and_over(spark):
    """Few windows are made of a stretch that repeats itself."""
    words, powers = suffix_dedup.Words(), suffix_dedup.Powers()
    h = words("x " * 5000 + " ".join(prose(1, 100)))
    at = suffix_dedup.minimisers(suffix_dedup.heads(h, powers))
    assert len(at) < 20 and {0} <= set(at.tolist())
    windows, starts = suffix_dedup.around(h, [0], powers)
    assert set(starts.tolist()) == {0, 4950, *range(4951, 4977)}


# decontamination


def test_decontamination(spark):
    q = "A farmer called Tom had 12 sheep and sold 5 of them to Mary before the winter came. How many sheep did Tom keep that year after Mary left?"
    items = spark.createDataFrame([(1, q), (2, " ".join(prose(40, 30))), (3, None), (4, "")], "item_id long, text string")
    texts = {
        1: "So. " + q, 2: "so. " + q.replace("Tom", "Jim").replace("Mary", "Ann").replace("12", "30").replace("5", "7"),
        3: q.replace("Tom had", "Jim had").replace("Mary left", "Kim left").replace("did Tom", "did Bob"), 4: " ".join(prose(41, 400)), 5: " ".join(prose(42, 50) + prose(40, 30)).upper(), 6: None, 7: "",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {1: [1], 2: [1], 5: [2]}
    assert {r.doc_id: r.item_ids for r in D.contaminated(df, items).collect()} == want
    assert {r.doc_id: r.item_ids for r in D.contaminated(df, items, block=10).collect()} == want
    assert sorted(r.doc_id for r in D.clean_rows(df, items).collect()) == [3, 4, 6, 7]
    odd = odd_rows(spark)
    assert D.clean_rows(odd, items).columns == odd.columns and D.clean_rows(odd, items).count() == odd.count()
    assert D.contaminated(empty(spark), items).count() == 0 and D.contaminated(df, items.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    b = {r.item_id: grams(words(r.text)) for r in items.collect()}
    want = {r.doc_id for r in docs.collect() if any(len(g & grams(words(r.text))) >= 0.5 * len(g) for g in b.values())}
    assert {r.doc_id for r in D.contaminated(docs, items).collect()} == want


VARIANT_WORDS = "the farmer sold some sheep and bought apples before winter came then counted what was left in baskets while children played near old river".split()
VARIANT_NAMES = "Tom Mary Jim Ann Bob Kim Lea Max Ivy Sam".split()


def typed_question(rng):
    """A question as words and slots: (kind, number) stands for a value."""
    body = [VARIANT_WORDS[i] for i in rng.integers(len(VARIANT_WORDS), size=30)]
    out = ["so"]
    for i, w in enumerate(body):
        out.append(w)
        if i % 4 == 1:
            kind = "name" if rng.random() < 0.5 else "number"
            out.append((kind, int(rng.integers(2))))
            if kind == "number" and rng.random() < 0.3:
                out.append("km")
    return out


def filled(question, rng, even=True):
    """Text of a question with values; without `even` every slot has a value of its own."""
    values = {}
    out = []
    for x in question:
        if isinstance(x, tuple):
            if x not in values or not even:
                used = set(values.values())
                new = [n for n in VARIANT_NAMES if n not in used] if x[0] == "name" else [str(n) for n in range(10, 99) if str(n) not in used]
                values[x if even else (x, len(values))] = new[int(rng.integers(len(new)))] if new else VARIANT_NAMES[int(rng.integers(10))]
                x = values[x] if even else list(values.values())[-1]
            else:
                x = values[x]
        out.append(x)
    return " ".join(out)


def brute_leaks(text, item):
    """The module's rule, over strings and all alignments, for texts of one sentence."""

    def template(t):
        words, kinds = t.split(), []
        for i, w in enumerate(words):
            kinds.append("N" if w.isdigit() else "T" if i and w[0].isupper() else "U" if w in D.UNITS and i and words[i - 1].isdigit() else "")
        return words, [k or w.lower() for k, w in zip(kinds, words)], kinds

    (dw, dt, _), (iw, it, ik) = template(text), template(item)
    telling = [p for p in range(len(it) - 4) if len({x for x, k in zip(it[p : p + 5], ik[p : p + 5]) if not k}) >= 3]
    size = len({tuple(it[p : p + 5]) for p in telling})
    by = collections.defaultdict(set)
    for p in telling:
        for q in range(len(dt) - 4):
            if dt[q : q + 5] == it[p : p + 5]:
                by[q - p].add(p)

    def even(shifts):
        ways = collections.defaultdict(list), collections.defaultdict(list)
        for s in shifts:
            for p in {p + i for p in by[s] for i in range(5)}:
                if ik[p]:
                    ways[0][ik[p], iw[p].lower()].append(dw[p + s].lower())
                    ways[1][ik[p], dw[p + s].lower()].append(iw[p].lower())
        n = sum(map(len, ways[0].values()))
        return not n or all(sum(max(map(v.count, v)) for v in pairs.values()) >= D.CONSISTENT * n for pairs in ways)

    sound = sorted(s for s in by if even([s]))
    near = [[s for s in sound if any(lo <= s <= hi for lo, hi in [g])] for g in _stretches(sound, len(iw))]
    for group in [*([s] for s in sound), *near, sound]:
        if group and even(group):
            share = len({tuple(it[p : p + 5]) for s in group for p in by[s]}) / size
            run = max(len(list(g)) for s in group for _, g in itertools.groupby(enumerate(sorted(by[s])), lambda x: x[1] - x[0]))
            if share >= D.SHARE or run >= D.RUN:
                return True
    return False


def _stretches(sound, gap):
    out = []
    for s in sound:
        if out and s - out[-1][1] <= gap:
            out[-1][1] = s
        else:
            out.append([s, s])
    return out


def test_decontamination_of_typed_templates_against_brute_force(spark):
    rng = np.random.default_rng(17)
    questions = [typed_question(rng) for _ in range(12)]
    items = [(i, filled(q, rng)) for i, q in enumerate(questions)]
    docs = []
    for i, q in enumerate(questions):
        own = lambda k: " ".join(prose(500 + 20 * i + k, 12))
        same, odd = filled(q, rng), filled(q, rng, even=False)
        tail = " ".join(items[i][1].split()[-7:])
        docs += [f"{own(0)} {same} {own(1)}", f"{own(2)} {odd} {own(3)}", f"{own(4)} {odd} {tail}", f"{odd} {own(5)} {same}"]
        half = items[i][1].split()
        docs += [" ".join([*half[:14], "indeed", *half[14:]]), " ".join(half[:12]), " ".join([*half[20:], own(6), *half[:20]])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, i) for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect() for i in r.item_ids}
    want = {(d, i) for d, t in enumerate(docs) for i, item in items if brute_leaks(t, item)}
    assert got == want and {(7 * i, i) for i in range(12)} | {(7 * i + 3, i) for i in range(12)} <= want
    assert len({(7 * i + 1, i) for i in range(12)} & want) <= 3 and len({(7 * i + 2, i) for i in range(12)} & want) <= 3


def test_decontamination_wants_different_values_for_different_ones(spark):
    q = "so when Anna had 3 boats and then Peter got 5 boats more the two of them Anna and Peter sold 3 or 5 boats that year"
    merged = q.replace("Peter", "Anna").replace("3", "9").replace("5", "9")
    rows = [(1, q.replace("Anna", "Lea").replace("Peter", "Max").replace("3", "8").replace("5", "6")), (2, merged), (3, q)]
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, q)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_decontamination_of_many_blocks(spark):
    """Blocks have scans of their own; what they found is joined, so the last plan holds none of their tables."""
    items = [(i, " ".join(prose(900 + i, 25))) for i in range(20)] + [(20, " ".join(prose(900, 25)))]
    rows = [(i, f"own words {text} more words") for i, text in items] + [(50, " ".join(prose(899, 60))), (51, None), (0, f"own words {items[0][1]} more words"), (60, f"{items[3][1]} . {items[17][1]}")]
    df, b = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((r.doc_id, tuple(r.item_ids), r.share, r.longest_run) for r in D.contaminated(df, b, block=size).collect()) for size in (10_000, 8))
    assert one == many and len(one) == 23 and (60, (3, 17), 1.0, 21) in one
    found = D.with_matches(df, b, "found", 8)
    assert "MapInArrow" not in found._jdf.queryExecution().toString() and found.columns == [*df.columns, "found"] and found.count() == len(rows)
    assert sorted(r.doc_id for r in D.clean_rows(df, b, 8).collect()) == [50, 51]


def test_decontamination_isnt_led_astray_by_a_stray_window(spark):
    q = "A farmer called Tom had 12 sheep and sold 5 of them to Mary before the winter came. How many sheep did Tom keep that year after Mary left?"
    odd = q.replace("Tom had", "Jim had").replace("Mary left", "Kim left").replace("did Tom", "did Bob")
    items = spark.createDataFrame([(1, q), (None, "one more " + " ".join(prose(43, 30))), (1, " ".join(prose(44, 30)))], "item_id long, text string")
    rows = [(1, odd), (2, odd + " and then the winter came how many sheep"), (3, odd + " " + q), (4, "x " + " ".join(prose(43, 30))), (5, " ".join(prose(44, 30))), (None, q), (None, q)]
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id or 0, r.item_ids) for r in got) == [(0, [1]), (0, [1]), (3, [1]), (4, [None]), (5, [1])]


# pseudonyms


def luhn(d):
    n = [int(c) for c in d[::-1]]
    return sum(n[::2] + [x * 2 - 9 * (x > 4) for x in n[1::2]]) % 10 == 0


def py_characters(v, key):
    a, b = v[: len(v) // 2], v[len(v) // 2 :]
    for r in range(1, S.ROUNDS + 1):
        h = hashlib.sha256("|".join([key, str(r), str(len(v)), b]).encode()).hexdigest()
        out = ""
        for i, c in enumerate(a):
            by = int(h[2 * (i % 32) : 2 * (i % 32) + 2], 16)
            for low, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(low) <= ord(c) < ord(low) + n:
                    c = chr(ord(low) + (ord(c) - ord(low) + by) % n)
                    break
            out += c
        a, b = b, out
    return a + b


def test_pseudonyms(spark):
    card, mail = "4111111111111111", "ann.b42@mail8.example.com"
    texts = [f"card {card}, {mail}!", f"{mail} 4111-1111-1111-1111 and {card}", "4111111111111112 and 300.1.1.1 and 1987-02-30", "born 1987-02-28, 28.02.1987; +1 (017) 555-7713 at 144.137.247.239", "DE89370400440532013000 078-05-1120 password=562cadd56fde", "", None]
    got = {r.doc_id: r for r in S.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").collect()}
    new = got[0].text.split()[1].strip(",")
    assert new != card and luhn(new) and new[:-1] == py_characters(card[:-1], "k1|card")
    assert got[1].text.split()[-1] == new and got[1].text.split()[1].replace("-", "") == new and got[1].text.split()[1][4] == "-"
    assert got[0].text.split()[2] == py_characters("ann.b42", "k1|mail") + "@mail8.example.com!"
    assert got[2].text == texts[2] and got[2].n_replaced == 0
    a, b = re.findall(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}", got[3].text)
    assert pd.Timestamp(a) == pd.to_datetime(b, format="%d.%m.%Y") != pd.Timestamp("1987-02-28")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} at ", got[3].text) and all(int(x) < 256 for x in got[3].text.split()[-1].split("."))
    iban = got[4].text.split()[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert got[5].text == got[6].text == ""
    assert S.pseudonymised(odd_rows(spark), "k1").count() == 11 and S.pseudonymised(empty(spark), "k1").count() == 0


def test_card_numbers_next_to_other_digits(spark):
    card, four, eight = "4845168114407329", "4111 1111 1111 1111", "41111111-11111111"
    texts = [f"{card} 170.106.47.218", f"{four} 12/27", f"order 12 {card}", f"{card} 1987-02-28", f"{card} 078-05-1120", f"{card} 12bob@mail.com", f"12 {four} 123", f"1234 56 7 {eight} 99 88 {eight}", f"{card} {card}", "1 " * 30_000]
    got = {r.doc_id: r for r in S.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").collect()}
    assert luhn(card)
    for i, t in enumerate(texts[:9]):
        assert not any(v in got[i].text for v in (card, four, eight, "170.106.47.218", "1987-02-28", "078-05-1120", "12bob")), t
        assert re.sub(r"[a-z0-9]", "", got[i].text) == re.sub(r"[a-z0-9]", "", t) or "." in t
    assert got[1].text.endswith(" 12/27") and got[2].text.startswith("order 12 ") and got[6].text.startswith("12 ") and got[6].text.endswith(" 123")
    assert [got[i].n_replaced for i in range(9)] == [2, 1, 1, 2, 2, 2, 1, 2, 2] and got[8].n_found == 2
    assert len(got[9].text) == 60_000
    last = next(d for d in "0123456789" if luhn("411111111111111211" + d))
    broken = [f"4111 1111 1111 1112 11{last}", f"1234 {four}", f"{four} {four}", "411111111111 1111", "1234-" + four.replace(" ", "-"), "4111111111111112 " + card]
    got = {r.doc_id: r for r in S.pseudonymised(spark.createDataFrame(list(enumerate(broken)), "doc_id long, text string"), "k1").collect()}
    assert [got[i].n_replaced for i in range(6)] == [1, 1, 2, 1, 1, 1]
    assert got[1].text.startswith("1234 ") and got[4].text.startswith("1234-") and got[5].text.startswith("4111111111111112 ")


def test_pseudonyms_are_permutations(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("1.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256, F.lit(" "), F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")).alias("text"))
    out = [r.text.split(" ") for r in S.pseudonymised(df, "k1").collect()]
    assert len({a for a, _ in out}) == len({b for _, b in out}) == 2000
    assert S.pseudonymised(df, "k1").filter("n_replaced < 1").count() == 0
    assert "Python" not in S.pseudonymised(df, "k1")._jdf.queryExecution().toString()


def test_pseudonyms_of_each_kind_are_permutations(spark):
    """Different values have different pseudonyms of the same format, equal ones equal pseudonyms, and checks still hold."""

    def account(i):
        body = f"DE00{i:018d}"
        return f"DE{98 - int(''.join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97:02d}{i:018d}"

    def card(i):
        return next(f"4{i:014d}{d}" for d in range(10) if luhn(f"4{i:014d}{d}"))

    n = 400
    kinds = {
        "card": [card(i) for i in range(n)], "iban": [account(i) for i in range(n)], "phone": [f"+1 555 123 {i:04d}" for i in range(n)], "local": [f"555-123-{i:04d}" for i in range(n)],
        "area": [f"(555) 123-{i:04d}" for i in range(n)], "social": [f"123-45-{i:04d}" for i in range(n)], "mail": [f"a{i:03d}@b.org" for i in range(n)],
        "secret": [f"password=abcd{i:04d}" for i in range(n)], "address": [f"10.1.{i // 200}.{i % 200}" for i in range(n)], "date": [str(pd.Timestamp("1990-01-01") + pd.Timedelta(days=i))[:10] for i in range(3652)],
    }
    rows = [(k, f"x {v} y") for k, values in kinds.items() for v in [*values, values[7]]]
    got = collections.defaultdict(list)
    made = S.pseudonymised(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), "k2").collect()
    for r in made:
        got[r.doc_id].append(r.text[2:-2])
    for kind, values in kinds.items():
        new = got[kind]
        assert len(new) == len(values) + 1 and len(set(new)) == len(values), kind
        shape = lambda v: re.sub(r"[a-z]", "a", re.sub(r"\d+" if kind == "address" else r"\d", "9", v))  # noqa: B023, E731
        assert set(map(shape, values)) == set(map(shape, new)), kind
    assert all(luhn(v) for v in got["card"]) and all(int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 for v in got["iban"])
    assert set(got["date"]) == set(kinds["date"])


def test_spaced_accounts_and_hidden_keys(spark):
    compact = "DE89370400440532013000"
    texts = ["DE89 3704 0044 0532 0130 00", compact, compact.lower(), "de89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 00 1234", "AB12 WORD WORD WORD", "call (555) 123-4567 or 555-123-4567", "born 12/25/1990"]
    df = S.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "hidden ' key")
    got = {r.doc_id: r.text for r in df.collect()}
    assert got[0].replace(" ", "") == got[1] != compact and [len(x) for x in got[0].split()] == [4, 4, 4, 4, 4, 2]
    assert got[2] != compact.lower() and got[2] == got[2].lower() and got[3].replace(" ", "") == got[2] + "." and got[4] == got[0] + " 1234" and got[5] == texts[5]
    area, plain = re.fullmatch(r"call (\(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4})", got[6]).groups()
    assert re.sub(r"\D", "", area) == re.sub(r"\D", "", plain) != "5551234567"
    assert got[7].endswith(tuple(str(y) for y in range(1990, 2000))) and got[7] != texts[7]
    assert "hidden ' key" not in df._jdf.queryExecution().toString()


def test_mail_of_any_letters(spark):
    """No letter of a local part stays where it is by rule, case and script stay, equal addresses are linked and different ones apart."""
    names = ["иван.петров", "ИВАН", "jürgen.groß", "Ærøskøbing", "μαρία", "ΜΑΡΙΑ", "łukasz_żak", "דוד", "محمد", "さくら", "カナ", "王小明", "김철수", "नमस्ते", "x́y"]
    names += [a + b for a in "абвгд" for b in "яюэьы"]
    df = spark.createDataFrame([(i, f"mail {n}@example.com or {n}@example.org.") for i, n in enumerate(names)], "doc_id long, text string")
    out = [S.pseudonymised(df, key).orderBy("doc_id").collect() for key in ("k1", "k1", "k2", "k3", "k4")]
    made = [[re.fullmatch(r"mail (\S+)@example\.com or (\S+)@example\.org\.", r.text).groups() for r in rows] for rows in out]
    assert all(a == b for rows in made for a, b in rows) and made[0] == made[1] and len({a for a, _ in made[0]}) == len(names)
    for i, name in enumerate(names):
        new = [rows[i][0] for rows in (made[0], *made[2:])]
        assert name not in new and len(set(new)) == 4
        if all(any(c in alphabet for alphabet in S.ALPHABETS) or c.isascii() for c in name):
            assert all(len(n) == len(name) and [c.isupper() for c in n] == [c.isupper() for c in name] for n in new)
            for at, c in enumerate(name):
                assert not c.isalpha() or {n[at] for n in new} != {c}
    assert all(r.n_found == r.n_replaced == 2 for r in out[0])


def test_further_formats(spark):
    texts = ["password=hunter2", "call +49 (0)30 1234567 now", "secret: then he said", "token: abcdefgh12"]
    got = {r.doc_id: r for r in S.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k1").collect()}
    assert got[0].text != texts[0] and re.fullmatch(r"password=[a-z]{6}\d", got[0].text)
    assert got[1].text != texts[1] and re.fullmatch(r"call \+49 \(\d\)\d\d \d{7} now", got[1].text)
    assert got[2].text == texts[2] and got[3].text != texts[3]


def test_no_key_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError):
        S.key_of(Session)
    assert S.key_of(spark) == S.EXAMPLE


# pages


def test_blocks():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><!-- c --><article><h1>A &amp; B</h1><p>one<br>two <b>th</b>ree<p>four<script>x='</p>'</script></article>"
    assert [b.text for b in H.blocks_of(page)] == ["Home", "A & B", "one two three", "four"]
    assert H.blocks_of("") == [] and [b.text for b in H.blocks_of("a < b &copy &#x41; <i unclosed")] == ["a < b © A"]


def test_blocks_of_deep_and_broken_pages():
    """Nesting, tags that never end and inline elements that never end cost time in proportion to the page."""
    for page, n in (("<div>a" * 60_000, 60_000), ("<b>" * 60_000 + "<div>x</div>" * 20_000, 20_000), ("<div><p>a</span>" * 30_000, 30_000), ("<div>" * 60_000 + "a" + "</section>" * 60_000, 1), ("<li><i>a" * 30_000, 30_000)):
        t = time.time()
        blocks = H.blocks_of(page)
        assert len(blocks) == n and H.vectors(blocks[-50:]).shape[0] == min(50, n) and time.time() - t < 10
    deep = H.blocks_of("<main class='post body'><div id=x><p>one <b>two")[0]
    assert deep.path == ["main", ".post", ".body", "div", ".x", "p", "b"]
    slots = {H.PATH_SLOT[n] for n in ["main", ".post", ".body", "div", ".x", "p", "last p"]}
    assert set(np.flatnonzero(H.vectors([deep])[0, : H.PATHS]).tolist()) == slots


def test_blocks_that_are_not_shown():
    page = "<p hidden>a</p><p style='color:red; display : none'>b<p class='hidden none'>c<div hidden=until-found>d</div><div data-x='hidden'>e</div><div hidden><div>f</div></div><p>g"
    assert [b.text for b in H.blocks_of(page)] == ["c", "d", "e", "g"]


def test_extraction_of_odd_rows(spark):
    long = "<article>" + "<p>word one two</p>" * 3000 + "</article>"
    rows = [(None, None, None, "x", 1), (1, "u", "", "x", 1), (1, "u", "", "x", 1), (2, "u", "plain", "x", 1), (3, "u", "<" * 5000, "x", 1), (4, "u", long, "x", 1), (5, "u", "<div>" * 5000 + "z", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(3)
    got = H.extract(df).collect()
    assert sorted(r.page_id or 0 for r in got) == [0, 1, 1, 2, 3, 4, 5] and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[4].count("word one two") == 3000
    assert H.extract(df.limit(0)).count() == 0


def test_html_extraction(spark):
    model = H.trained_labeller()
    wrong = total = 0
    for page, labels in html_layouts.layouts(120, seed=1234):
        blocks = H.blocks_of(page)
        assert len(blocks) == len(labels)
        z = model.logits([H.vectors(blocks)])[:, 0] > 0
        wrong, total = wrong + (z != np.array(labels)).sum(), total + len(labels)
    assert wrong < 0.03 * total
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<")], "page_id long, url string, html string"))
    got = {r.page_id: r for r in H.extract(pages).collect()}
    want = {r.page_id: "\n".join(b.text for b in H.blocks_of(r.html or "") if "article" in b.path) for r in pages.collect()}
    assert sum(got[k].text != t for k, t in want.items() if k >= 0) <= 0.02 * len(want) and got[-1].text == got[-2].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_gradients():
    rng = np.random.default_rng(0)
    m = H.Labeller(4)
    x, y = [rng.random((3, H.WIDTH)).astype(np.float32), rng.random((5, H.WIDTH)).astype(np.float32)], [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]

    def loss():
        z = m.logits(x).astype(float)
        return sum(-(t * np.log(p) + (1 - t) * np.log(1 - p)).sum() for t, p in ((t, 1 / (1 + np.exp(-z[: len(t), k]))) for k, t in enumerate(y))) / 8

    g = m.gradients(x, y)
    for k, p in m.p.items():
        at = tuple(int(rng.integers(s)) for s in p.shape)
        was = p[at]
        p[at] = was + 1e-2
        up = loss()
        p[at] = was - 1e-2
        down = loss()
        p[at] = was
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][at]), abs=1e-4)


# classifiers


def held_out(spark, query, label):
    rows = {r.doc_id: r for r in query(spark, "/root/testdata/sf0.1").filter("held_out").collect()}
    t = pd.read_parquet("/root/testdata/sf0.1/labels.parquet")
    pairs = [(int(getattr(r, label)), rows[r.doc_id].predicted, rows[r.doc_id].score) for r in t.itertuples() if r.doc_id in rows]
    assert all(0 <= s <= 1 and p == (s >= 0.3) for _, p, s in pairs)
    return pairs


def test_toxicity_on_held_out_labels(spark):
    pairs = held_out(spark, toxicity.op6_toxicity, "toxic")
    hit = sum(y and p for y, p, _ in pairs)
    assert hit >= 0.85 * sum(y for y, _, _ in pairs) and hit >= 0.9 * sum(p for _, p, _ in pairs)


def test_quality_on_held_out_labels(spark):
    pairs = held_out(spark, quality.op5_quality, "quality")
    assert sum(y == p for y, p, _ in pairs) >= 0.95 * len(pairs)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, module):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "bad awful words here" if i % 2 else "good fine things there !!!") for i in range(40)], "doc_id long, text string")
    model = module.train(docs, labels)
    odd = odd_rows(spark)
    scored = module.with_scores(odd, model, "s") if module is toxicity else module.with_scores(odd, model)
    assert scored.count() == odd.count()
    nothing = module.train(docs, labels.limit(0))
    out = module.with_scores(docs, nothing).collect()
    assert all((r.score < 0.3) if module is toxicity else (r.score > 0.3) for r in out)
    assert module.with_scores(empty(spark), model).count() == 0
    if module is toxicity:
        assert module.clean_rows(odd, nothing).columns == odd.columns


def test_machine_learns_what_only_pairs_tell():
    """Toxic is a text with an insult and a group, or with neither: each term alone says nothing."""
    rng, words = np.random.default_rng(0), prose(80, 400)
    texts, label = [], []
    for _ in range(2000):
        insult, group = map(int, rng.random(2) < 0.5)
        texts.append(" ".join([*(words[k] for k in rng.integers(400, size=20)), *["zinsult"] * insult, *["zgroup"] * group]))
        label.append(float(insult == group))
    slots, label = toxicity.Terms().encode(texts), np.array(label, np.float32)
    machine = toxicity.fit(slots[:1500], label[:1500])
    assert np.mean([(machine.margin(s) > 0) == (y > 0) for s, y in zip(slots[1500:], label[1500:])]) > 0.95


@pytest.mark.parametrize("n_words, share", [(200, 0.35), (3000, 0.35), (3000, 0.12)])
def test_machine_finds_pairs_among_many_words(n_words, share):
    """Toxic is a text with both terms, whatever the number of other words."""
    rng, words = np.random.default_rng(5), [f"w{i}x{i * 7 % 97}" for i in range(n_words)]
    texts, label = [], []
    for _ in range(4000):
        insult, group = map(int, rng.random(2) < share)
        texts.append(" ".join([*rng.choice(words, 20), *["zinsult"] * insult, *["zgroup"] * group]))
        label.append(float(insult and group))
    slots, label = toxicity.Terms().encode(texts), np.array(label, np.float32)
    machine = toxicity.fit(slots[:3000], label[:3000])
    margins, y = np.array([machine.margin(s) for s in slots[3000:]]), label[3000:] > 0
    assert (margins[y][:, None] > margins[~y][None, :]).mean() > 0.95


def test_margins_by_direct_sums():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=toxicity.SLOTS), rng.normal(size=(toxicity.SLOTS, toxicity.VECTOR)))
    slots = np.unique(rng.integers(toxicity.SLOTS, size=12))
    pairs = sum(sum(a * b for a, b in zip(m.vectors[i], m.vectors[j])) for i, j in itertools.combinations(slots, 2))
    assert m.margin(slots) == pytest.approx(0.3 + sum(m.weights[i] for i in slots) + pairs)
    x, y = rng.random((200, len(quality.FEATURES))), (rng.random(200) < 0.5).astype(float)
    x[:, 3] += y
    model = quality.fit(x, y, rounds=5, pair_rounds=3)
    for row, got in zip(x[:20], model.margin(x[:20])):
        want = model.constant + sum(model.tables[j][sum(v >= e for e in model.edges[j])] for j, v in enumerate(row))
        want += sum(t[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])] for (i, j), t in model.pairs.items())
        assert got == pytest.approx(want)


def test_terms_of_several_chunks():
    one, two = toxicity.Terms().encode(["achlichver x", "achlichver achlichein x"])
    stem = toxicity.several(np.array([zlib.crc32(b"5 achli") % toxicity.SLOTS], np.int32))[0]
    assert stem in two and stem not in one


def test_sample_of_repeated_identifiers(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    rows = labelled.labelled_sample(docs, labels, "toxic", F.lit(False)).collect()
    assert sorted((r.label, r.text or "") for r in rows) == [(1, ""), (1, "a")]


def test_threshold():
    assert labelled.threshold(np.array([3.0, 2.0, 1.0]), np.array([1, 1, 0]), "f1") == 1.5
    assert labelled.score(np.array([1.5]), 1.5)[0] == pytest.approx(0.3)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames, columns = [docs], docs.columns
    for _, stage in C.STAGES[:-1]:
        frames.append(C.written(stage(spark, frames[-1], SF), "pipeline-test"))
        assert frames[-1].columns == columns
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    rows = {r.doc_id: r.text for r in frames[1].collect()}
    keep = {v[0] for v in brute_exact(list(rows.items())).values()}
    assert ids[2] == keep
    classes = {r.doc_id: r.class_id for r in N.near_classes(frames[2]).collect()}
    assert ids[3] == set(classes.values())
    found = {r.doc_id for r in D.contaminated(frames[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - found
    check_packing(C.pack(spark, frames[4], SF).collect(), {r.doc_id: r.text for r in frames[4].collect()})


def test_pipeline_stages_on_odd_and_no_rows(spark):
    """Every stage takes null, empty, long and repeated rows and an empty table; all but the last keep the columns."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd_rows(spark).select("doc_id", "text", "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
    for rows, least in ((docs.limit(0), 0), (odd, 6)):
        for _, stage in C.STAGES[:-1]:
            rows = C.written(stage(spark, rows, SF), "pipeline-odd")
            assert rows.columns == docs.columns and rows.count() >= least
        assert C.pack(spark, rows, SF).select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
