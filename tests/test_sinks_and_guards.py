"""Exports are read back as they were; guards find planted samples and phrases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import guards, leaks, segments
from docspark.sources import documents as sources
from docspark.sources import sinks


def test_manifest_round_trip(spark, tmp_path):
    rows = segments.explode_segments(spark.createDataFrame([("d", "Title\n\nOne. Two, three.")], "doc_id string, t string"), "doc_id", "t")
    assert sinks.export_manifests(sinks.segment_manifest(rows), str(tmp_path)) == 1
    back = sources.read_segments(spark, str(tmp_path / "05_segments" / "d" / "segments.json"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select(back.columns).collect()))
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="JSON array"):
        sources.read_segments(spark, str(tmp_path / "bad.json")).collect()


def test_export_keeps_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "text/html"), ("b", None, None)], "slug string, raw_text string, media_type string")
    assert sorted(r.written for r in sinks.export_files(df, str(tmp_path), "raw_text").collect()) == [True, True]
    again = sinks.export_files(df.withColumn("raw_text", F.lit("new")), str(tmp_path), "raw_text").collect()
    assert not any(r.written for r in again)
    assert (tmp_path / "01_sources/raw/a.html").read_text() == "x" and (tmp_path / "01_sources/raw/b.md").read_text() == ""


def test_events_append(spark, tmp_path):
    e = spark.createDataFrame([(1, "trim")], "segment int, action string")
    for _ in range(2):
        sinks.append_events(e, str(tmp_path / "audit"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "audit")).collect()]
    assert len(lines) == 2 and lines[0]["action"] == "trim" and "time" in lines[0]


def test_audio_guard(spark):
    rate = 1_000
    rng = np.random.default_rng(9)
    sample = rng.normal(size=2_000).astype(np.float32)
    profile = leaks.voice_profile(sample, rate, rate, 1.5)
    clean = rng.normal(size=6_000)
    rows = [(1, np.concatenate([sample, clean]).tolist()), (2, np.concatenate([clean, sample]).tolist()), (3, np.concatenate([clean, sample, clean]).tolist()), (4, clean.tolist()), (5, None)]
    df = spark.createDataFrame(rows, "k int, audio array<double>")
    got = {r.k: (r.position, r.action, r.remaining_samples) for r in guards.audio_guard(df, "k", "audio", profile).collect()}
    assert got == {1: ("start", "trim", 6_000), 2: ("end", "trim", 6_000), 3: ("middle", "reject", 0)}
    assert guards.audio_guard(df, "k", "audio", profile, "off").count() == 0 and guards.audio_guard(df, "k", "audio", None).count() == 0
    joined = df.join(guards.audio_guard(df, "k", "audio", profile).filter("action = 'trim'"), "k").select("k", F.size(guards.trimmed(F.col("audio"), F.struct("position", "clamped_start", "clamped_end"))).alias("n"))
    assert {r.n for r in joined.collect()} == {6_000}


def test_text_guard(spark):
    df = spark.createDataFrame([(1, "a.wav"), (2, "b.wav")], "k int, path string")
    said = lambda p: "xx the quick brown fox jumps" if p == "a.wav" else "nothing"
    got = guards.text_guard(df, "k", "path", "The quick brown fox|other", said, "error").collect()
    assert [r.k for r in got] == [1]
    assert guards.text_guard(df, "k", "path", "The quick brown fox", None, "off").count() == 0
    with pytest.raises(ValueError):
        guards.text_guard(df, "k", "path", "The quick brown fox", None, "error")
