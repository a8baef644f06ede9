"""Sources, configuration, runs and resume, status, command line, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.plans import cli, doctor, pipeline, providers, settings, status
from docspark.sources import documents as sources
from docspark.sources import web
from docspark.streaming import arrivals


def test_order_of_sources(spark):
    rows = spark.createDataFrame([("b", None, "t1", 1), ("b", 2, "t0", 2), ("a", 1_000_000, "x", 3), ("b", 999_999, "s", 4)], "section string, doc_order int, title string, seq long")
    docs = rows.withColumns({"source_url": F.col("title"), "source_path": F.lit(""), "doc_id": F.col("title")})
    assert [r.title for r in sources.union_sources([docs]).collect()] == ["x", "t0", "s", "t1"]


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "u", "", "i1", "A", "", None)], "seq long, source_url string, source_path string, doc_id string, title string, section string, doc_order int")
    b = spark.createDataFrame([(0, "u", "", "i2", "B", "", None), (1, "", "p", "i3", "C", "", None), (2, None, None, "i4", "D", None, None)], a.schema)
    assert [r.title for r in sources.union_sources([a, b]).collect()] == ["A", "C", "D"]


EDGES = {"a": ["/b", "/c", "/a#x", "http://other/z"], "b": ["/d", "/c"], "d": []}


@pytest.mark.parametrize("most, want", [(4, ["http://h/a", "http://h/b", "http://h/d"]), (2, ["http://h/a", "http://h/b"]), (0, [])])
def test_crawl(spark, most, want):
    pages = spark.createDataFrame([(f"http://h/{k}", "".join(f'<a href="{x}">.</a>' for x in v), "text/html") for k, v in EDGES.items()], "url string, html string, content_type string")
    assert [r.url for r in sources.crawl(pages, ["http://h/a"], most).orderBy("doc_order").collect()] == want


def test_url_items(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# no\n\n http://h/x \n")
    items = sources.url_items(spark, ["http://h/a", {"url": " http://h/b ", "title": "B", "order": "2", "_hidden": 1}], str(tmp_path / "urls.txt")).orderBy("seq").collect()
    assert [(r.url, r.title, r.doc_order) for r in items] == [("http://h/a", "", None), ("http://h/b", "B", 2), ("http://h/x", "", None)]
    with pytest.raises(ValueError):
        sources.url_items(spark, [{"url": " "}])


def test_sitemaps_count_through(spark):
    xml = '<u xmlns="x"><loc>{}</loc><loc>{}</loc></u>'
    maps = spark.createDataFrame([(0, xml.format("a", "b")), (1, "<bad"), (2, xml.format("c", "d"))], "seq long, xml string")
    assert [(r.doc_order, r.url) for r in sources.sitemap_items(maps).orderBy("doc_order").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_headers_and_renderers():
    assert web.request_headers("me") == {"User-Agent": "me"} and web.request_headers("me", {"user-agent": "x"}) == {"user-agent": "x"}
    static = lambda u: ("s", "t")

    def broken(u):
        raise OSError

    assert web.renderer("auto", static, broken)("u") == ("s", "t")
    with pytest.raises(OSError):
        web.renderer("browser", static, broken)("u")
    with pytest.raises(ValueError):
        web.renderer("odd", static)
    hosts = web._Reader({"urls": "http://a/1\nhttp://b/1\nhttp://a/2"}).partitions()
    assert [h.urls for h in hosts] == [["http://a/1", "http://a/2"], ["http://b/1"]]


def test_retries():
    calls, waits = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("x")
        return " done "

    assert providers.with_retries(flaky, 2, waits.append)("p") == ("done", "", 3) and waits == [2, 4]
    assert providers.with_retries(lambda p: "", 1, waits.append)("p")[0] is None


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"translation": {"retries": 0, "enabled": False}, "tts": {"cfg_scale": 0}, "source": {"urls": "http://h", "headers": {"A": 1}}}))
    s = settings.load_config(path)
    assert (s.translation.retries, s.translation.enabled, s.tts.cfg_scale, s.source.urls, s.source.headers) == (2, False, 1.5, ["http://h"], {"A": "1"})
    path.write_text("[]")
    with pytest.raises(ValueError):
        settings.load_config(path)


def test_extract_reference_cases(spark):
    rows = spark.createDataFrame([
        (1, "", "<html><head><title>Ignore me</title></head><body><h1>Hello</h1><script>x()</script><p>Readable text.</p></body></html>", "text/html"),
        (2, "Untitled", "<article><h1>Auto Title</h1><p>Body.</p></article>", None), (3, None, None, None), (4, "Kept", "# Head\n\ntext", "text/markdown")], "k int, title string, raw_text string, media_type string")
    got = {r.k: (r.title, r.clean_text) for r in providers.extract(rows, "auto").collect()}
    assert got == {1: ("Hello", "Hello Readable text."), 2: ("Auto Title", "Auto Title Body."), 3: ("Untitled", ""), 4: ("Kept", "Head\n\ntext")}
    with pytest.raises(ValueError):
        providers.extract(rows, "odd")


@pytest.fixture
def project(tmp_path):
    (tmp_path / "article.md").write_text("# Demo\n\nA short local article for testing.")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({
        "project": {"name": "demo", "output_dir": str(tmp_path / "out")}, "source": {"local_files": [{"path": "article.md", "title": "Demo", "section": "1", "order": 1}]},
        "translation": {"enabled": False}, "tts": {"enabled": False, "provider": "none"}}))
    return config


def test_run_resume_status(spark, project, capsys):
    s = settings.load_config(project)
    first = pipeline.run_pipeline(spark, s, to_phase="script")
    assert first["summary"] == {"documents": 1, "audio_completed": 0, "tts_completed_segments": 0, "segments": 0}
    out = s.project.output_dir
    assert status.inspect_run(spark, out)["ok"]
    tables = pipeline.StageTables(spark, pipeline.Path(out).resolve().as_uri())
    assert not tables.exists("segment")
    late = pipeline.run_pipeline(spark, s, from_phase="segment")
    assert late["resumed_from_manifest"] and late["summary"]["segments"] == 2
    before = tables.read("segment").count()
    pipeline.run_pipeline(spark, s, from_phase="extract")
    assert tables.read("segment").count() == before  # nothing is done twice
    assert cli.main(["status", "--output-dir", out]) == 0 and cli.main(["status", "--output-dir", out, "--expect-audio"]) == 1
    assert not status.inspect_run(spark, out + "/nowhere")["ok"]
    with pytest.raises(ValueError):
        pipeline.phase_window("tts", "source")
    capsys.readouterr()


def test_changed_input_leaves_no_stale_rows(spark, project):
    s = settings.load_config(project)
    pipeline.run_pipeline(spark, s, to_phase="tts")
    (project.parent / "article.md").write_text("# Demo\n\nAnother text. It has three sentences. They are short.")
    again = pipeline.run_pipeline(spark, s, to_phase="tts")
    tables = pipeline.StageTables(spark, pipeline.Path(s.project.output_dir).resolve().as_uri())
    stages = pipeline.current(tables, pipeline.stage_settings(s), "tts")
    texts = [r.text for r in stages["tts"].orderBy("segment_index").collect()]
    assert "".join(texts).count("Another") == 1 and "short local article" not in "".join(texts)
    assert again["summary"]["segments"] == len(texts) < tables.read("tts").count()  # the earlier rows are kept and not used
    s.tts.target_chars = s.tts.max_chars = 12
    finer = pipeline.run_pipeline(spark, s, from_phase="segment", to_phase="segment")
    assert finer["summary"]["segments"] > len(texts)
    forced = pipeline.run_pipeline(spark, s, force=True, to_phase="segment")
    assert forced["summary"]["segments"] == finer["summary"]["segments"] == tables.read("segment").count()


def test_packaged_audio(spark, project):
    import wave

    def speak(text, path):
        if "fails" in text:
            raise OSError("no voice")
        with wave.open(path, "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(2)
            out.setframerate(8000)
            out.writeframes(b"\1\0" * 80 * len(text))

    s = settings.load_config(project)
    s.tts.enabled, s.tts.provider, s.output.audio_format = True, "own", "wav"
    made = pipeline.run_pipeline(spark, s, speak=speak)
    entry = made["documents"][0]
    assert entry["audio_status"] == "completed" and made["summary"]["audio_completed"] == 1
    with wave.open(entry["audio_path"]) as got:
        segments = pipeline.StageTables(spark, pipeline.Path(s.project.output_dir).resolve().as_uri()).read("tts").orderBy("segment_index").collect()
        assert got.getnframes() == sum(80 * len(r.text) for r in segments) + sum(8 * r.pause_after_ms for r in segments[:-1])
    good = status.inspect_run(spark, s.project.output_dir, expect_audio=True)
    assert good["ok"] and good["summary"]["audio_completed"] == 1 and good["summary"]["documents"] == 1
    (project.parent / "article.md").write_text("# Demo\n\nThis one fails to be spoken.")
    pipeline.run_pipeline(spark, s, speak=speak)
    bad = status.inspect_run(spark, s.project.output_dir, expect_audio=True)
    assert not bad["ok"] and bad["summary"]["segment_failed"] == 1 and "1 failed TTS segments" in {i["message"] for i in bad["issues"]}


def test_init_config_and_doctor(tmp_path, capsys):
    path = tmp_path / "x" / "c.yaml"
    assert cli.main(["init-config", "--output", str(path), "--name", "My Site", "--url", "https://example.com/a"]) == 0
    assert "https://example.com/a" in path.read_text()
    with pytest.raises(SystemExit):
        cli.main(["init-config", "--output", str(path)])
    bad = tmp_path / "b.json"
    bad.write_text(json.dumps({"source": {"extractor": "trafilatura"}, "tts": {"voice_sample": str(tmp_path / "none.wav")}}))
    report = doctor.doctor_report(str(bad), strict=True)
    assert not report["ok"] and "trafilatura" in report["checks"] and "voice_sample" in {i["check"] for i in report["issues"]}
    capsys.readouterr()


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"Head {i}\n\nOne. Two, three.", None) for i in range(5)] + [("n", None, None)], "doc_id string, raw_text string, fetched_at timestamp")
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = arrivals.segment_stream(arrivals.document_stream(spark, str(tmp_path / "in"), docs.schema))
    arrivals.run_batches(stream, str(tmp_path / "ck"), lambda df, i: seen.extend(df.collect())).awaitTermination()
    assert len(seen) == arrivals.segment_stream(docs).count() == 10


def test_run_fetches_filters_and_keeps_failures(spark, tmp_path):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            here = f"http://127.0.0.1:{self.server.server_port}"
            pages = {"/map": f"<urlset><url><loc>{here}/b</loc></url></urlset>", "/c": f'<html><nav>MENU</nav><article><p>Page c.</p><a href="{here}/d">d</a><a href="{here}/gone">g</a></article></html>'}
            pages |= {f"/{x}": f"<html><nav>MENU</nav><article><p>Page {x}.</p></article></html>" for x in "abd"}
            self.send_response(200 if self.path in pages else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(pages.get(self.path, "").encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    s = settings.from_mapping({
        "project": {"output_dir": str(tmp_path / "out")}, "translation": {"enabled": False}, "tts": {"enabled": False},
        "source": {"urls": [f"{at}/a", f"{at}/missing"], "sitemap_urls": [f"{at}/map", f"{at}/nomap"], "content_selector": "article", "crawl": {"start_urls": [f"{at}/c"], "max_pages": 5}}})
    try:
        made = pipeline.run_pipeline(spark, s, to_phase="extract")
    finally:
        server.shutdown()
    errors = {d["source_url"].removeprefix(at): d["error"] for d in made["documents"]}
    assert {u for u, e in errors.items() if e is None} == {"/a", "/b", "/c", "/d"}
    assert {u for u, e in errors.items() if e and "404" in e} == {"/missing", "/nomap", "/gone"}
    texts = [r.clean_text for r in pipeline.StageTables(spark, (tmp_path / "out").as_uri()).read("extract").collect()]
    assert len(texts) == 4 and all("Page" in t and "MENU" not in t for t in texts)
    assert len(status.inspect_run(spark, s.project.output_dir)["issues"]) == 3
    some = spark.createDataFrame([(f"{at}/a", "<html><article><p>x</p></article></html>", "text/html")], "url string, raw_text string, content_type string")
    kept = {r.source_url.removeprefix(at): r.error for r in pipeline.collect_sources(spark, s, some).collect()}
    assert kept == {"/a": None, "/missing": "no page was given", "/nomap": "no page was given", "/map": "no page was given", "/c": "no page was given"}
