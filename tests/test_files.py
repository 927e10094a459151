"""Readers and writers over small files."""

import wave

import pytest
from pyspark.sql import functions as F

from glossarium.sources import readers, writers


def put(folder, name, body):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(body, encoding="utf-8")
    return str(p)


def test_malformed_textgrids_are_set_apart(spark, tmp_path):
    good = writers.textgrid([("ann - words", [(0, 1, "a")])], 2.0)
    bodies = {"good": good, "blank": "\n", "other": "hello", "short": good[: len(good) // 2], "swapped": good.replace('"a"', "7")}
    for name, body in bodies.items():
        put(tmp_path, f"{name}.TextGrid", body)
    assert [r.label for r in readers.textgrids(spark, str(tmp_path)).collect()] == ["a"]
    bad = {r.path.rpartition("/")[2]: r.error for r in readers.malformed_textgrids(spark, str(tmp_path)).collect()}
    assert set(bad) == {f"{n}.TextGrid" for n in bodies if n != "good"} and all(bad.values())


@pytest.mark.parametrize("short", [False, True])
def test_textgrid_round_trip(spark, tmp_path, short):
    rows = [(0.1, 0.5, 'say "hi"'), (0.6, 1.5, "world")]
    put(tmp_path, "a.TextGrid", writers.textgrid([("ann - words", rows), ("notes", [(0, 1, "n")])], 2.0, short))
    got = readers.textgrids(spark, str(tmp_path)).orderBy("begin").collect()
    assert [(r.speaker, r.kind, r.begin, r.end, r.label, r.duration) for r in got] == [("ann", "words", *x, 2.0) for x in rows]
    body = writers.textgrids(readers.textgrids(spark, str(tmp_path)), short).first().body
    assert readers.textgrid_tiers(body)[1][0][1][1][2] == 'say "hi"'


def test_corpus_and_sounds(spark, tmp_path):
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100), w.writeframes(b"\0\0" * 250)
    put(tmp_path, "x.lab", "ﬁne words"), put(tmp_path, "x.txt", "no"), put(tmp_path, ".hidden.lab", "no"), (tmp_path / "bad.wav").write_bytes(b"x")
    got = {r.stem: r for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert set(got) == {"x", "bad"} and got["x"].text.endswith("x.lab")
    s = {r.path.split("/")[-1]: r for r in readers.sounds(spark, str(tmp_path)).collect()}
    assert (s["x.wav"].duration, s["x.wav"].sample_rate, s["x.wav"].channels) == (2.5, 100, 1) and s["bad.wav"].format is None
    t = readers.transcripts(spark, str(tmp_path)).filter("stem = 'x' AND text <> 'no'").first()
    assert (t.text, t.end) == ("fine words", -1.0)


def test_line_files(spark, tmp_path):
    c = readers.ctm(spark, put(tmp_path, "a/a.ctm", "u1 1 0.5 0.25 AH 0.9\nu1 1 0.75 0.1 T\n")).orderBy("begin").collect()
    assert [(r.utterance, r.begin, r.label, r.confidence) for r in c] == [("u1", 0.5, "AH", 0.9), ("u1", 0.75, "T", None)]
    s = readers.scp(spark, put(tmp_path, "b/a.scp", "k_SPACE_1 [ 1 2 ]\n")).first()
    assert (s.key, s["values"]) == ("k 1", ["1", "2"])
    assert writers.scp_lines(spark.createDataFrame([("k 1", ["1", "2"])], ["key", "values"])).first().value == "k_SPACE_1 1 2"
    lex = readers.lexicon(spark, put(tmp_path, "c/l.dict", "hello 0.9 0.1 HH AH\nhello HH\nbad\n"))
    rows = sorted((r.word, r.probability, r.silence_after, r.phones, r.error is None) for r in lex.collect() if r.probability)
    assert rows == [("hello", 0.9, 0.1, ["HH", "AH"], True)] and lex.filter("error IS NOT NULL").count() == 1
    words, prons = readers.lexicon_tables(lex)
    assert words.count() == 4 and {r.pronunciation for r in prons.collect()} == {"HH AH", "HH"}
    assert sorted(r.value for r in writers.lexicon_lines(prons.join(words, "word_id")).collect())[0].startswith("hello\t")
    a = readers.arpa(spark, put(tmp_path, "d/m.arpa", "\\data\\\nngram 1=2\n\n\\1-grams:\n-1.0 a -0.5\n-2.0 b\n\n\\2-grams:\n-0.3 a b\n\\end\\\n")).collect()
    model = {r.words: (r.probability, r.backoff) for r in a}
    assert model["a b"][0] == pytest.approx(10**-0.3) and readers.backoff_probability(model, ["a", "a"]) == pytest.approx(10**-1.5)


def test_manifests(spark, tmp_path):
    p = put(tmp_path, "m.csv", "﻿Utterance,Emotion,Dialogue_ID,Utterance_ID,StartTime,EndTime\n“Hi”,joy,0,0,\"0:0:1,0\",\"0:0:2,5\"\n,joy,0,1,x,y\n")
    r = readers.utterance_manifest(spark, {"dev": p}).collect()
    assert [(x.sample_key, x.text, x.target_seconds, x.global_idx) for x in r] == [("dev_dia0_utt0", '"Hi"', [1.5], 0)]
    d = put(tmp_path, "d.csv", "Utterances,Emotions,Dialogue_ID,Utterance_IDs,Start_Time,End_Time\n\"['a','b']\",\"['x','y']\",1,\"[0,1]\",\"['0:1','0:2']\",\"['0:2','0:4']\"\n\"['a']\",\"[]\",2,[0],[],[]\n")
    assert [(x.dialogue, x.target_seconds) for x in readers.dialog_manifest(spark, d).collect()] == [(1, [1.0, 2.0])]
    assert readers.list_or_text("[x") == ["[x"]
    out = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "b")], ["k", "v"])
    writers.versioned(df, out, 4, "k")
    writers.versioned(df, out, 4, "k")
    assert spark.read.parquet(out).count() == 2
    j = str(tmp_path / "j")
    writers.jsonl(df, j)
    assert readers.jsonl(spark, j, "k long, v string").count() == 2
    good, tally = readers.candidates(df, [("one", F.col("k") == 1)], "k")
    assert good.count() == 1 and tally.first().reason == "one"


def test_entry_without_the_training_package(tmp_path):
    """The contract module imports and has its queries where the package and the pipeline were taken out."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "glossarium", tmp_path / "glossarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'interval_duration_deviation' in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})
