"""Readers and sinks on small files."""

import wave

import pytest
from pyspark.sql import functions as F

from tidegrid.sources import media, store, textgrid

ROWS = [("words", 0.0, 0.5, ""), ("words", 0.5, 1.0, 'say "hi"'), ("phones", 0.0, 0.25, "HH"), ("phones", 0.25, 1.0, "sp")]
CHRONOLOGICAL = '''"Praat chronological TextGrid text file"
0 1   ! Time domain.
2   ! Number of tiers.
"IntervalTier" "words" 0 1
"IntervalTier" "phones" 0 1
2 0.25 1
"sp"
1 0 0.5
""
9 0 1
"unknown tier"
x y z
"not a time"
2 0 0.25
"HH"
1 0.5 1
"say ""hi"""
'''


def test_both_forms_agree():
    assert textgrid.parse(textgrid.format_long(ROWS)) == ROWS
    assert textgrid.parse(CHRONOLOGICAL) == ROWS


@pytest.mark.parametrize("at", [5, 6, 7, 8, 13])
def test_stray_lines_end_nothing(at):
    """A line that is neither times nor the text behind them is passed over by itself, wherever it lies."""
    lines = [x for x in CHRONOLOGICAL.splitlines() if x not in ("x y z", '"not a time"')]
    where = at if at % 2 else at + 1  # before times, never between times and text
    assert textgrid.parse("\n".join([*lines[:where], "stray", *lines[where:]])) == ROWS
    two = ['"Praat chronological TextGrid text file"', "0 1", "1", '"IntervalTier" "words" 0 1', "stray", "1 0 0.5", '"a"', "1 0.5 1", '"b"']
    assert textgrid.parse("\n".join(two)) == [("words", 0.0, 0.5, "a"), ("words", 0.5, 1.0, "b")]


def test_repair(spark, tmp_path):
    raw, fixed = tmp_path / "raw", tmp_path / "fixed"
    raw.mkdir()
    (raw / "good.TextGrid").write_text(textgrid.format_long(ROWS))
    (raw / "old.TextGrid").write_text("garbage")
    (raw / "old.TextGrid.bak").write_text(CHRONOLOGICAL)
    (raw / "bad.TextGrid").write_text("garbage")
    (raw / "past.TextGrid").write_text("garbage")
    originals = textgrid.files(spark, [str(raw)])
    done = spark.createDataFrame([("past",)], "story string")
    found = textgrid.repair(originals, done).cache()
    assert {r.story: r.status for r in found.collect()} == {"good": "valid", "old": "repaired", "bad": "failed", "past": "repaired"}
    assert tuple(textgrid.repair_summary(found, spark.createDataFrame([("absent",), ("old",)], "story string")).first()) == (1, 2, 1, 1, 5)
    textgrid.save_repaired(found, str(fixed))
    got = textgrid.parsed(textgrid.load_repaired(spark, str(fixed)))
    assert [(r.tier, r.t0, r.t1, r.text) for r in got.orderBy("ord").collect()] == ROWS and (raw / "old.TextGrid").read_text() == "garbage"
    assert [r.value for r in textgrid.raw_head(originals, "old", 2).collect()] == CHRONOLOGICAL.splitlines()[:2]


def test_diagnosis(spark):
    grids = textgrid.parsed(spark.createDataFrame([(s, textgrid.format_long(ROWS) if s != "d" else "garbage") for s in "abcde"], "story string, content string"))
    texts = spark.createDataFrame([("a", "x"), ("b", " "), ("c", "x"), ("e", "x")], "story string, text string")
    tokens = spark.createDataFrame([("a",), ("e",), ("e",)], "story string")
    found = textgrid.diagnosed(grids, texts, tokens, tokens.where("story = 'a'"))
    assert {r.story: r.stage for r in found.collect()} == {"a": None, "b": "text", "c": "annotate", "d": "read", "e": "extract"}
    assert tuple(textgrid.diagnosis(found).first()) == (5, 1, ["b", "c", "d", "e"])


def test_scan(spark, tmp_path):
    raw, fixed = tmp_path / "raw", tmp_path / "fixed"
    raw.mkdir()
    fixed.mkdir()
    (raw / "one.TextGrid").write_text(CHRONOLOGICAL)
    (raw / "two.TextGrid").write_text("garbage")
    (fixed / "one.TextGrid").write_text(textgrid.format_long(ROWS[:2]))
    got = textgrid.scan(spark, [str(fixed), str(raw)])
    assert {(r.tier, r.t0, r.t1, r.text) for r in got.where("story = 'one'").collect()} == set(ROWS[:2])
    assert got.where("story = 'two'").first().error
    assert [r.story for r in textgrid.discover(spark, [str(fixed), str(raw)]).collect()] == ["one", "two"]
    assert textgrid.tier(got, "WORD").count() == 2
    status = {r.story: (r.status, r.stage) for r in textgrid.diagnosed(got).collect()}
    assert status == {"one": ("failed", "tiers"), "two": ("failed", "read")}
    assert textgrid.parse(textgrid.repaired(got).first().content) == ROWS[:2]
    assert textgrid.head(spark, str(raw / "one.TextGrid"), 3).count() == 3


def test_audio_headers(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 12000)
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[-1]: r.seconds for r in media.durations(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": 1.5, "b.wav": 0.0}
    assert media.checked(spark, str(tmp_path), "*.wav") == (2, ["a.wav", "b.wav"])
    with pytest.raises(FileNotFoundError):
        media.checked(spark, str(tmp_path), "*.hf5")


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("s1", "GLOBAL", 1.0, "2024-01-01 00:00:00"), ("s2", "x", 2.0, "2024-01-01 00:00:00")], store.RUN_LOG)
    new = store.logged(old, store.log_row(spark, "s1", 9.0))
    assert {(r.script_name, r.execution_time_seconds) for r in new.collect()} == {("s1", 9.0), ("s2", 2.0)}
    assert store.load_table(spark, "no_such_table") is None
    store.save_table(old, "run_log_test")
    assert store.load_table(spark, "run_log_test").count() == 2
    assert store.query(spark, "SELECT count(*) AS n FROM run_log_test WHERE script_name = :s", {"s": "s1"}).first().n == 1
    store.save_parts(old, str(tmp_path / "p"), ["script_name"])
    store.save_parts(old.where("script_name = 's1'").withColumn("execution_time_seconds", F.lit(7.0)), str(tmp_path / "p"), ["script_name"])
    assert {(r.script_name, r.execution_time_seconds) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("s1", 7.0), ("s2", 2.0)}
    with store.timed(spark, "s1", "run_log_test"):
        pass
    assert {r.script_name: r.execution_time_seconds < 1.0 for r in store.load_table(spark, "run_log_test").collect()} == {"s1": True, "s2": False}
    store.save_csv(old, str(tmp_path / "c"))
    store.save_json(old, str(tmp_path / "j"))
    store.save_text(old, "script_name", str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == 2
