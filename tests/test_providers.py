"""Back-ends with fakes: extractors, a text service, models, samples, chunks that fail, audio put together."""

import io
import json
import os
import time
import wave

import pytest
from pyspark.sql import functions as F

from docspark.functions import clean, urls
from docspark.operators import leaks, packaging, summaries
from docspark.plans import models, pipeline, providers, settings
from docspark.sources import sinks


def test_reader_comes_first_and_falls_back(spark):
    def reader(raw):
        return ("Own title", "Own  text.\n\nMore.") if "own" in raw else None

    rows = spark.createDataFrame([(1, "", "<html><p>own</p>", "text/html"), (2, "Kept", "<html><h1>T</h1><p>other</p>", "text/html"), (3, None, None, "text/html"), (4, "", "own *text*", "text/plain")], "k int, title string, raw_text string, media_type string")
    got = {r.k: (r.title, r.clean_text) for r in providers.extract(rows, reader=reader).collect()}
    assert got == {1: ("Own title", "Own text.\n\nMore."), 2: ("Kept", "T other"), 3: ("Untitled", ""), 4: ("Untitled", "own text")}
    assert providers.reader_of("auto") is None
    with pytest.raises(RuntimeError):
        providers.reader_of("trafilatura")


def test_staged_columns_equal_the_expressions(spark):
    texts = ["# A &amp; B\n\n- *one*\n- two — three", "a\r\nb ½ ™", None, "", "```x```\n[l](http://u) http://v", "全角，文字！"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    one = {r.i: (r.a, r.b) for r in df.select("i", clean.clean_source_text(F.col("text")).alias("a"), clean.render_script(F.col("text"), "en").alias("b")).collect()}
    two = {r.i: (r.a, r.b) for r in clean.with_script(clean.with_clean_text(df, "text", "a"), "text", "b", "en").collect()}
    assert one == two
    plan = clean.with_script(df, "text", "b", "en")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") < 60


@pytest.mark.parametrize("title, want", [("  Hello,  World! ", "hello-world"), ("ÉCOLE_été -- ½", "école-été-12"), ("...", "other"), (None, "other"), ("ｆｕｌｌ．width", "full.width"), ("a__b - c", "a-b-c")])
def test_slugs(spark, title, want):
    df = spark.createDataFrame([(title, "other")], "t string, f string")
    assert df.select(clean.slugify(F.col("t"), F.col("f"))).first()[0] == want


def test_text_service():
    asked = []

    def opener(request, timeout):
        asked.append((json.loads(request.data), timeout))
        return io.BytesIO(json.dumps({"response": "ok"} if len(asked) == 1 else {"error": "busy"}).encode())

    ask = providers.http_model("http://h/api", "m", 7, opener)
    assert ask("p") == "ok" and asked == [({"model": "m", "prompt": "p", "stream": False}, 7)]
    with pytest.raises(RuntimeError):
        ask("p")


def test_models(tmp_path, monkeypatch):
    monkeypatch.delenv("DOCSPARK_MODEL_PATH", raising=False)
    assert models.model_path("a/b", hub=tmp_path) == "a/b" and not models.is_local("a/b") and models.is_local(str(tmp_path))
    for i, name in enumerate(("old", "new")):
        (tmp_path / "models--a--b" / "snapshots" / name).mkdir(parents=True)
        os.utime(tmp_path / "models--a--b" / "snapshots" / name, (i, i))
    assert models.model_path("a/b", hub=tmp_path).rstrip("/").endswith("new")
    monkeypatch.setenv("DOCSPARK_MODEL_PATH", "/x")
    assert models.model_path("a/b", hub=tmp_path) == "/x"
    looks = iter([True, True, False])
    models.wait_while(lambda: next(looks), sleep=lambda s: None)
    with pytest.raises(TimeoutError):
        models.wait_while(lambda: True, 0, sleep=time.sleep)
    sample = tmp_path / "s.mp3"
    with pytest.raises(FileNotFoundError):
        models.voice_sample(str(sample), tmp_path)
    sample.write_text("x")
    made = []
    for _ in range(2):
        path = models.voice_sample(str(sample), tmp_path, lambda a, b: (made.append(a), b.parent.mkdir(parents=True), b.write_text("w")))
    assert len(made) == 1 and path.endswith("voice_sample_24k.wav") and models.voice_sample(" ", tmp_path) == ""


def test_chunks_that_failed_are_asked_for_again(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n\n".join("word " * 150 + str(i) for i in range(3)))
    log = tmp_path / "log"

    def call(prompt):
        with open(log, "a") as f:
            f.write("x")
        if prompt.endswith("1") and not (tmp_path / "up").exists():
            raise OSError("down")
        return prompt[-1]

    s = settings.from_mapping({"project": {"output_dir": str(tmp_path / "out")}, "source": {"local_files": [{"path": str(tmp_path / "a.md")}]}, "translation": {"provider": "own", "chunk_chars": 800, "target_language": "en"}, "tts": {"enabled": False}})
    s.translation.retries = 0
    pipeline.run_pipeline(spark, s, to_phase="translate", call=call)
    tables = pipeline.StageTables(spark, (tmp_path / "out").as_uri())
    assert tables.read("translate").count() == 0 and tables.read("chunk").count() == 2
    (tmp_path / "up").touch()
    pipeline.run_pipeline(spark, s, to_phase="translate", call=call)
    assert [r.translated_text for r in tables.read("translate").collect()] == ["0\n\n1\n\n2"] and len(log.read_text()) == 4  # three, and the one again


def test_joined_audio(tmp_path):
    def tone(name, n, rate=8000):
        with wave.open(str(tmp_path / name), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(2)
            out.setframerate(rate)
            out.writeframes(b"\1\0" * n)
        return str(tmp_path / name)

    plan = [("audio", tone("a.wav", 800), 0), ("silence", "", 100), ("audio", tone("b.wav", 400), 0), ("silence", "", 0)]
    assert packaging.join_wavs(plan, tmp_path / "x" / "out.wav") == (0.25, 8000, 1)
    with wave.open(str(tmp_path / "x" / "out.wav")) as got:
        assert got.getnframes() == 800 + 800 + 400 + 1
    with pytest.raises(ValueError):
        packaging.join_wavs([*plan, ("audio", tone("c.wav", 5, 16000), 0)], tmp_path / "bad.wav")
    assert not list(tmp_path.glob("bad*"))


def test_metadata_and_paths(spark, tmp_path):
    df = spark.createDataFrame([("i", "T", None, 3, "u", "", "text/html", {"a": "é"}, "slug")], "doc_id string, title string, section string, doc_order int, source_url string, source_path string, media_type string, metadata map<string,string>, slug string")
    assert [r.written for r in sinks.export_metadata(df, str(tmp_path)).collect()] == [True] and [r.written for r in sinks.export_metadata(df, str(tmp_path)).collect()] == [False]
    got = json.loads((tmp_path / "01_sources/metadata/slug.json").read_text())
    assert got == {"id": "i", "title": "T", "section": None, "order": 3, "source_url": "u", "source_path": "", "media_type": "text/html", "metadata": {"a": "é"}}
    paths = spark.createDataFrame([(p,) for p in ("/a/b/c", "/a/./b//d/../e", "/a/bc", "/a/b", "x/y", None)], "p string")
    assert [r[0] for r in paths.select(urls.relative_path(F.col("p"), "/a/b")).collect()] == ["c", "e", "/a/bc", ".", "x/y", None]


def test_status_counters_of_nothing(spark):
    none = spark.createDataFrame([], "missing_stage_files array<string>, audio_status string, audio_missing boolean, failed long, pending long")
    assert list(summaries.status_summary(none).first()) == [0] * 7


def test_leaks_by_longer_markers(spark):
    marks = leaks.marker_table(spark.createDataFrame([("this sample of a voice",)], "p string"), "p")
    rows = spark.createDataFrame([(1, "Well: this sample of a voice!"), (2, "this sam"), (3, "short"), (4, None)], "k int, t string")
    got = {r.k: (r.matched_marker_count, r.transcript) for r in leaks.text_leaks(rows, marks, "k", "t").collect()}
    assert set(got) == {1} and got[1][1] == "Well: this sample of a voice!"
