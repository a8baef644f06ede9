"""Folds, plans, leaks and aggregates: hand-derived tables, brute force on small inputs, and invariants."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import audio_plan, chunking, leaks, segments, summaries


def chunks(spark, text, target=2800):
    return spark.createDataFrame([(text,)], "x string").select(chunking.chunk_array(F.col("x"), target).alias("c")).first().c


@pytest.mark.parametrize("sizes, want", [([300, 300, 300], [602, 300]), ([10, 1700, 10], [10, 800, 800, 100, 10]), ([400, 398], [800]), ([], [])])
def test_chunks(spark, sizes, want):
    assert [len(c) for c in chunks(spark, "\n\n".join("x" * n for n in sizes), 100)] == want


def test_chunks_of_nothing(spark):
    assert chunks(spark, "  \n\n ") == [] and chunks(spark, None) == []


def segs(spark, text, target=80, most=120):
    rows = segments.explode_segments(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", target, most).orderBy("segment_index").collect()
    return [(r.segment_index, r.text, r.chars, r.pause_reason, r.pause_after_ms) for r in rows]


def test_segments_by_hand(spark):
    assert segs(spark, "Title\n\nThis is one sentence. This is another sentence.", 30, 60) == [
        (1, "Title", 5, "heading", 900), (2, "This is one sentence.", 21, "sentence", 450), (3, "This is another sentence.", 25, "paragraph", 800)]
    assert segs(spark, None) == [] and segs(spark, " \n ") == []
    with pytest.raises(Exception, match="positive"):
        segs(spark, "x", 0, 10)


def test_sentences(spark):
    row = spark.createDataFrame([("Wait... what? 3.14 ok",)], "x string").select(segments.sentences(F.col("x")).alias("s")).first()
    assert row.s == ["Wait.", "what?", "3.", "14 ok"]


def test_segment_invariants(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab ", "c, ", "d. ", "好，", "好。", "\n\n", "xyz", ": "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = segments.explode_segments(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", 20, 30).collect()
    for k, text in enumerate(texts):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: r.segment_index)
        assert [r.segment_index for r in mine] == list(range(1, len(mine) + 1))
        assert all(0 < r.chars <= 30 and r.chars == len(r.text) for r in mine)
        whole = re.sub(r"[\s.。]", "", text)
        assert re.sub(r"[\s.。]", "", "".join(r.text for r in mine)) == whole


def test_native_stages_hold_no_python(spark):
    plan = segments.explode_segments(spark.createDataFrame([(1, "a")], "k int, t string"), "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pause_plan(spark):
    rows = spark.createDataFrame([("d", 1, 450, "sentence", "a"), ("d", 2, 800, "paragraph", "b"), ("e", 1, 0, None, "c"), ("e", 2, None, None, "x"), ("e", 3, 1, None, "y")], "doc_id string, segment_index int, pause_after_ms int, pause_reason string, audio_path string")
    got = [(r.doc_id, r.pos, r.type, r["index"], r.duration_ms, r.reason) for r in audio_plan.pause_plan(rows).orderBy("doc_id", "pos").collect()]
    assert got == [
        ("d", 1, "audio", 1, None, None), ("d", 2, "silence", 1, 450, "sentence"), ("d", 3, "audio", 2, None, None),
        ("e", 1, "audio", 1, None, None), ("e", 2, "audio", 2, None, None), ("e", 3, "silence", 2, 450, "sentence"), ("e", 4, "audio", 3, None, None)]
    frames = spark.createDataFrame([(450,), (0,), (-5,)], "ms int").select(audio_plan.silence_frames(24_000, F.col("ms")).alias("f")).collect()
    assert [r.f for r in frames] == [10_800, 1, 1]


def test_merge(spark):
    base = spark.createDataFrame([("d", i, "x", "", 0, "") for i in (1, 2, 3)], "doc_id string, segment_index int, status string, audio_path string, retry_count int, error string")
    res = spark.createDataFrame([("d", 1, "failed", "", 9, "old", 0), ("d", 1, "completed", "/p1", 0, None, 1), ("d", 3, "failed", "/p3", 2, "err", 0)], "doc_id string, segment_index int, status string, audio_path string, retry_count int, error string, ordinal int")
    got = [tuple(r)[2:] for r in audio_plan.merge_results(base, res).orderBy("segment_index").collect()]
    assert got == [("completed", "/p1", 0, ""), ("pending", "", 0, ""), ("failed", "/p3", 2, "err")]


@pytest.mark.parametrize("phrase, want", [
    ("ABCDEFGHIJKLMNOPQRSTU", ["ABCDEFGH", "EFGHIJKL", "IJKLMNOP", "MNOPQRST", "NOPQRSTU"]), ("ABCDEFGHIJ", ["ABCDEFGHIJ", "ABCDEFGH", "CDEFGHIJ"]), ("ABCDEFGH", ["ABCDEFGH"]), ("ABCDEFG", []),
])
def test_markers(spark, phrase, want):
    assert spark.createDataFrame([(phrase,)], "x string").select(leaks.markers(F.col("x"), 8).alias("m")).first().m == want


def test_text_leak(spark):
    marks = leaks.marker_table(spark.createDataFrame([("ABCDEFGHIJ",)], "p string"), "p")
    texts = spark.createDataFrame([(1, "xx abcdefgh ij"), (2, "abcdefgh"), (3, None), (4, "")], "k int, t string")
    got = leaks.text_leaks(texts, marks, "k", "t").collect()
    assert [(r.k, r.matched_marker_count) for r in got] == [(1, 3)]


def test_text_leak_keeps_windows_out_of_broadcasts(spark):
    import __spark_entry__
    from tests.conftest import DATA

    plan = __spark_entry__.queries()["q21_text_leak"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("piece, bits", [(1_000, 1 << 23), (5, 1 << 23), (1, 64)])
def test_text_leak_is_containment(spark, monkeypatch, piece, bits):
    monkeypatch.setattr(leaks, "PIECE", piece)
    monkeypatch.setattr(leaks, "FILTER_BITS", bits)
    phrases = ["THIS SAMPLE", "A SAMPLE OF A VOICE THAT IS LONG", "CHAPTER 1234", "CHAPTER 1235", "ABCDEFGH", "SHORT", "", None]
    marks = leaks.marker_table(spark.createDataFrame([(x,) for x in phrases], "p string"), "p")
    texts = ["this sample", "THIS SAMPL", "xx a sample of a voice that is long and chapter 1234", "chapter 123", "abcdefgh" * 3, "abcdefg", "", None, "chapter 1235 chapter 1234"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    forms = {k: re.sub("[^0-9A-Z]", "", (t or "").upper()) for k, t in enumerate(texts)}
    held = {k: sorted(m.marker for m in marks.collect() if m.marker in t) for k, t in forms.items()}
    got = {r.k: (r.matched_marker_count, r.matched_markers) for r in leaks.text_leaks(rows, marks, "k", "t", min_hits=1, transcript=False).collect()}
    assert got == {k: (len(m), m[:8]) for k, m in held.items() if m}


def test_best_match_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s, t = rng.normal(size=rng.integers(5, 80)), rng.normal(size=rng.integers(1, 12))
        score, at = leaks.best_match(s, t)
        if len(t) > len(s) or np.linalg.norm(t - t.mean()) <= 1e-9:
            assert (score, at) == (0.0, 0)
            continue
        want = [float(np.dot(s[i : i + len(t)], t - t.mean()) / (np.linalg.norm(t - t.mean()) * np.sqrt(max(1e-12, ((s[i : i + len(t)] - s[i : i + len(t)].mean()) ** 2).sum())))) for i in range(len(s) - len(t) + 1)]
        assert abs(score - max(want)) < 1e-6 and abs(want[at] - max(want)) < 1e-6
    assert leaks.best_match(np.zeros(0), np.ones(3)) == (0.0, 0)


@pytest.mark.parametrize("pos, clamped, distances, place", [(5, (0, 20), (0, 80), "start"), (45, (40, 60), (40, 40), "middle"), (82, (77, 97), (77, 3), "end")])
def test_locate(spark, pos, clamped, distances, place):
    rows = spark.createDataFrame([(1, 100, 0.95, pos)], "k int, samples long, score double, signature_pos long")
    r = leaks.locate_leaks(rows, 20, 5, 10).first()
    assert ((r.clamped_start, r.clamped_end), (r.start_distance, r.end_distance), r.position) == (clamped, distances, place)


def test_active_bounds_and_profile():
    quiet = np.zeros(24_000, np.float32)
    assert leaks.active_bounds(quiet, 24_000) == (0, 24_000) and leaks.active_bounds(quiet[:0], 24_000) == (0, 0)
    loud = quiet.copy()
    loud[12_000:18_000] = 0.5
    a, b = leaks.active_bounds(loud, 24_000)
    assert a == 12_000 - 1_920 and b == 18_000 + 1_920
    assert leaks.voice_profile(quiet[:100], 24_000) is None and leaks.voice_profile(quiet, 24_000) is None
    profile = leaks.voice_profile(np.sin(np.arange(48_000)).astype(np.float32), 24_000)
    assert profile["reference_len"] == 48_000


def test_status_rules(spark):
    docs = spark.createDataFrame([(1, "T", ["raw_path"], True, 2, 1, 3, True, "skipped"), (2, "U", None, False, 0, 0, 0, False, "completed")], "doc_seq int, title string, missing_stage_files array<string>, segment_manifest_missing boolean, failed int, pending int, missing_audio int, audio_missing boolean, audio_status string")
    got = [(r.rule_no, r.message) for r in summaries.status_issues(docs, "package", True).orderBy("doc_seq", "rule_no").collect()]
    assert got == [(1, "missing stage file: raw_path"), (2, "segment manifest is missing"), (3, "2 failed TTS segments"), (4, "1 pending TTS segments"), (5, "3 completed segment audio files are missing"), (6, "audio file is missing"), (7, "audio status is skipped")]
    assert [r.rule_no for r in summaries.status_issues(docs, "segment").filter("doc_seq = 1").orderBy("rule_no").collect()] == [1, 2, 3, 5, 6]


def test_status_counts_and_summary(spark):
    s = spark.createDataFrame([("d", "completed", "a"), ("d", "completed", "b"), ("d", "skipped", ""), ("d", "failed", ""), ("d", None, ""), ("d", "odd", "")], "doc_id string, status string, audio_path string")
    files = spark.createDataFrame([("a",)], "path string")
    r = summaries.segment_status(s, "doc_id", files).first()
    assert (r.total, r.completed, r.skipped, r.failed, r.pending, r.missing_audio) == (6, 2, 1, 1, 2, 1)
    empty = spark.createDataFrame([], "audio_status string, tts_completed int, segment_count int")
    assert tuple(summaries.run_summary(empty).first()) == (0, 0, 0, 0)


def test_phase_max(spark):
    rows = spark.createDataFrame([("tts", "script"), ("extract", "script"), ("?", "source"), (None, "tts")], "a string, b string")
    assert [r.p for r in rows.select(summaries.phase_max(F.col("a"), F.col("b")).alias("p")).collect()] == ["tts", "script", "source", "tts"]
