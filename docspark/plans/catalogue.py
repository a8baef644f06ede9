"""The catalogue of queries over the test tables, with the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import clean, html, pytext, urls
from docspark.operators import audio_plan, chunking, leaks, segments, summaries
from docspark.plans import oracles, providers
from docspark.sources import documents as sources

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key before heavy work on texts, where the table has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@query(oracles.PAGE_SEGMENTS)
def q00_page_segments_summary(spark, d):
    """Source, extraction, script and segments of every HTML record, in figures."""
    pages = table(spark, d, "source_document").filter(F.lower("media_type").contains("html")).select("seq", "title", "raw_text", "media_type")
    text = providers.extract(dealt(pages, "seq"))
    script = clean.with_script(text.select("seq", "clean_text"), "clean_text", "script", "en")
    rows = segments.explode_segments(script, "seq", "script")
    return rows.groupBy("seq").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("chars").alias("chars"), F.sum("pause_after_ms").alias("pause_ms"), F.max("chars").alias("longest"))


_ID = """substr(sha1(array_to_string(list_filter([coalesce(source_url, ''), coalesce(source_path, ''), t, CASE WHEN doc_order <> 0 THEN CAST(doc_order AS VARCHAR) ELSE '' END], lambda x: x <> ''), chr(10))), 1, 12)"""
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = lambda x: rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_TITLE = rf"""coalesce(nullif({_STRIP("coalesce(title, '')")}, ''), nullif(regexp_replace(regexp_extract(coalesce(source_path, ''), '([^/]*)$', 1), '([^.])\.[^.]*$', '\1'), ''), 'Untitled')"""


@query(f"WITH s AS (SELECT *, {_TITLE} AS t FROM source_document) SELECT seq, t AS title, {_ID} AS doc_id FROM s")
def q01_document_identity(spark, d):
    return sources.with_identity(table(spark, d, "source_document")).select("seq", "title", "doc_id")


@query("""
WITH s AS (SELECT *, CASE WHEN coalesce(source_path, '') <> '' THEN 3 ELSE 0 END AS source_rank FROM source_document),
r AS (SELECT seq, doc_id, row_number() OVER (PARTITION BY coalesce(nullif(source_url, ''), nullif(source_path, ''), doc_id) ORDER BY source_rank, seq) AS n FROM s)
SELECT seq, doc_id FROM r WHERE n = 1
""")
def q02_source_union_dedupe(spark, d):
    docs = table(spark, d, "source_document")
    local = F.coalesce("source_path", F.lit("")) != ""
    return sources.union_sources([docs.filter(~local), docs.filter(F.lit(False)), docs.filter(F.lit(False)), docs.filter(local)]).select("seq", "doc_id")


@query("""
SELECT seq, row_number() OVER (PARTITION BY coalesce(section, '') ORDER BY coalesce(doc_order, 999999), coalesce(title, ''), seq) AS place FROM source_document
""")
def q03_source_order(spark, d):
    """Place of each document in its section."""
    order = sources.source_order()
    return table(spark, d, "source_document").select("seq", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])).cast("long").alias("place"))


@query(r"""
SELECT seq, contains(lower(coalesce(media_type, '')), 'html') OR coalesce(regexp_matches(lower(substr(raw_text, 1, 500)), '<html|<body|</p>|<article'), false) AS is_page FROM source_document
""")
def q04_html_routing(spark, d):
    return table(spark, d, "source_document").select("seq", html.looks_like_html(F.col("media_type"), F.col("raw_text")).alias("is_page"))


@query(r"""
SELECT seq FROM source_document WHERE source_url <> '' AND regexp_matches(source_url, '/(p|a|story)/') AND NOT regexp_matches(source_url, 'utm_')
""")
def q05_url_filter(spark, d):
    docs = table(spark, d, "source_document").filter("source_url <> ''")
    return docs.filter(urls.url_allowed(F.col("source_url"), ["/(p|a|story)/"], ["utm_"])).select("seq")


@query(r"""
SELECT seq, nullif(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '') AS authority,
       coalesce(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) = 'dorsagolty-courier.test', false) AS same FROM source_document
""")
def q06_same_domain(spark, d):
    u = F.col("source_url")
    return table(spark, d, "source_document").select("seq", urls.authority(u).alias("authority"), urls.same_domain(u, ["https://dorsagolty-courier.test/"]).alias("same"))


@query(oracles.PAGE_LINKS)
def q07_page_links(spark, d):
    """Absolute links of every page, in order."""
    pages = table(spark, d, "source_document").filter(F.lower("media_type").contains("html") & (F.col("source_url") != "")).select("seq", "source_url", "raw_text")
    return dealt(pages, "seq").select("seq", F.posexplode(html.extract_links("source_url", "raw_text")).alias("pos", "link"))


@query(oracles.READABLE)
def q08_readable_text(spark, d):
    """Title and readable text of every record."""
    docs = table(spark, d, "source_document").select("seq", "title", "raw_text", "media_type")
    return providers.extract(dealt(docs, "seq")).select("seq", "title", "clean_text")


@query()
def q09_static_filter(spark, d):
    """Pages filtered by the selectors of their project."""
    config = table(spark, d, "project_config").select("project_id", "content_selector", "title_selector", "remove_selectors")
    docs = table(spark, d, "source_document").filter(F.lower("media_type").contains("html")).select("seq", "project_id", "media_type", "raw_text")
    joined = dealt(docs, "seq").join(config, "project_id", "left")
    return joined.select("seq", html.static_filter(F.col("raw_text"), F.col("media_type"), F.col("content_selector"), F.col("title_selector"), F.col("remove_selectors")).alias("markup"))


@query(oracles.CLEAN_TEXT)
def q10_clean_text(spark, d):
    return clean.with_clean_text(dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text").drop("text")


_NL = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"


@query(f"""
SELECT doc_id, replace(replace(replace({_NL}, chr(160), ' '), chr(8211), '-'), chr(8212), '--') AS text FROM documents
""")
def q11_normalized_newlines(spark, d):
    return table(spark, d, "documents").select("doc_id", clean.normalize_newlines(F.col("text")).alias("text"))


@query(oracles.SCRIPT_AUDIT)
def q12_script_audit(spark, d):
    docs = clean.with_script(dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text", "script", "en")
    return docs.select("doc_id", "script", clean.script_audit(F.col("text"), F.col("script"), "en").alias("a")).select("doc_id", "script", "a.*")


_HARD = lambda x, w: f"list_filter(list_transform(range(0, length({x}), {w}), lambda o: {_STRIP(f'substr({x}, CAST(o AS INT) + 1, {w})')}), lambda q: q <> '')"
_CHUNKS = f"""
WITH RECURSIVE p AS (
  SELECT clean_id, list_filter(list_transform(string_split(clean_text, chr(10) || chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS ps FROM clean_document WHERE clean_text IS NOT NULL
), f(clean_id, ps, i, out, cur) AS (
  SELECT clean_id, ps, 0, CAST([] AS VARCHAR[]), '' FROM p
  UNION ALL
  SELECT clean_id, ps, i + 1,
    CASE WHEN length(ps[i + 1]) > 2000 THEN list_concat(CASE WHEN cur <> '' THEN list_append(out, {_STRIP('cur')}) ELSE out END, {_HARD('ps[i + 1]', 2000)})
         WHEN cur <> '' AND length(cur) + 2 + length(ps[i + 1]) > 2000 THEN list_append(out, {_STRIP('cur')}) ELSE out END,
    CASE WHEN length(ps[i + 1]) > 2000 THEN '' WHEN cur = '' OR length(cur) + 2 + length(ps[i + 1]) > 2000 THEN ps[i + 1] ELSE cur || chr(10) || chr(10) || ps[i + 1] END
  FROM f WHERE i < len(ps)
), c AS (SELECT clean_id, CASE WHEN {_STRIP('cur')} <> '' THEN list_append(out, {_STRIP('cur')}) ELSE out END AS cs FROM f WHERE i = len(ps))
"""


@query(_CHUNKS + "SELECT clean_id, CAST(len(cs) AS INT) AS chunk_total, unnest(cs) AS chunk_text, CAST(generate_subscripts(cs, 1) AS INT) AS chunk_index FROM c")
def q13_translation_chunks(spark, d):
    docs = dealt(table(spark, d, "clean_document").select("clean_id", "clean_text"), "clean_id")
    return chunking.explode_chunks(docs, "clean_text", 2000)


@query(_CHUNKS + f"SELECT clean_id, {_STRIP('array_to_string(cs, chr(10) || chr(10))')} AS translated_text FROM c WHERE len(cs) > 0")
def q14_chunk_rejoin(spark, d):
    chunks = chunking.explode_chunks(table(spark, d, "clean_document").select("clean_id", "clean_text"), "clean_text", 2000)
    return chunking.join_chunks(chunks, ["clean_id"], "chunk_text")


@query(f"""
WITH s AS (SELECT clean_id, list_filter(list_transform(regexp_extract_all(clean_text, '[^。！？.!?；;]+[。！？.!?；;]?'), lambda x: {_STRIP('x')}), lambda x: x <> '') AS r, clean_text FROM clean_document WHERE clean_text <> '')
SELECT clean_id, unnest(CASE WHEN len(r) = 0 THEN [clean_text] ELSE r END) AS sentence, CAST(generate_subscripts(CASE WHEN len(r) = 0 THEN [clean_text] ELSE r END, 1) - 1 AS INT) AS pos FROM s
""")
def q15_sentences(spark, d):
    return table(spark, d, "clean_document").filter("clean_text <> ''").select("clean_id", F.posexplode(segments.sentences(F.col("clean_text"))).alias("pos", "sentence"))


@query(oracles.SEGMENTS)
def q16_segments(spark, d):
    """Segments of every clean document, with the sizes of its project."""
    config = table(spark, d, "project_config").select(
        "project_id", F.when(F.col("target_chars") > 0, F.col("target_chars")).alias("t"), F.when(F.col("max_chars") > 0, F.col("max_chars")).alias("m"))
    docs = dealt(table(spark, d, "clean_document").select("clean_id", "project_id", "clean_text"), "clean_id").join(config, "project_id", "left")
    sized = docs.select(F.struct("clean_id").alias("k"), "clean_text", F.coalesce("t", F.lit(segments.TARGET_CHARS)).alias("t"), F.coalesce("m", F.lit(segments.MAX_CHARS)).alias("m"))
    return segments.explode_segments(sized, "k", "clean_text", F.col("t"), F.col("m")).select("k.clean_id", "segment_index", "text", "chars", "pause_reason", "pause_after_ms")


@query("SELECT pause_reason, count(*) AS segments, CAST(sum(pause_after_ms) AS BIGINT) AS pause_ms FROM segment GROUP BY pause_reason")
def q17_pause_totals(spark, d):
    return table(spark, d, "segment").groupBy("pause_reason").agg(F.count(F.lit(1)).alias("segments"), F.sum("pause_after_ms").alias("pause_ms"))


_LATEST = """
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_index ORDER BY updated_at DESC, segment_id DESC) AS rn FROM segment) WHERE rn = 1)
"""


def _latest(spark, d) -> DataFrame:
    s = table(spark, d, "segment")
    order = Window.partitionBy("doc_id", "segment_index").orderBy(F.desc("updated_at"), F.desc("segment_id"))
    return s.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


@query(f"""
WITH {_LATEST}, n AS (SELECT doc_id, segment_index, audio_path, pause_reason, coalesce(pause_after_ms, 450) AS p, lead(segment_index) OVER (PARTITION BY doc_id ORDER BY segment_index) IS NULL AS last FROM l),
r AS (
  SELECT doc_id, segment_index AS index, 'audio' AS type, CAST(NULL AS INT) AS duration_ms, CAST(NULL AS VARCHAR) AS reason, audio_path AS path FROM n
  UNION ALL
  SELECT doc_id, segment_index, 'silence', p, coalesce(pause_reason, 'sentence'), format('pause_{{:04d}}_{{}}ms.wav', segment_index, p) FROM n WHERE NOT last AND p > 0
)
SELECT doc_id, index, type, coalesce(duration_ms, 0) AS duration_ms, coalesce(reason, '') AS reason, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY index, type) AS INT) AS pos FROM r
""")
def q18_pause_plan(spark, d):
    plan = audio_plan.pause_plan(_latest(spark, d))
    return plan.withColumns({"duration_ms": F.coalesce("duration_ms", F.lit(0)), "reason": F.coalesce("reason", F.lit(""))})


@query("""
SELECT CAST(coalesce(length(text), 0) AS INT) AS chars, count(*) AS segments, count(*) FILTER (WHERE length(text) <= 48 AND NOT regexp_matches(text, '[。！？.!?；;]$')) AS headings FROM segment GROUP BY 1
""")
def q19_heading_like(spark, d):
    t = F.col("text")
    return table(spark, d, "segment").groupBy(F.coalesce(F.length(t), F.lit(0)).alias("chars")).agg(F.count(F.lit(1)).alias("segments"), F.count_if(segments.heading_like(t)).alias("headings"))


_MARKERS = """
p AS (SELECT regexp_replace(upper(replace(title, 'ß', 'ss')), '[^0-9A-Z\\x{4E00}-\\x{9FFF}]+', '', 'g') AS n FROM clean_document WHERE title IS NOT NULL),
m AS (
  SELECT DISTINCT unnest(list_concat(CASE WHEN length(n) <= 16 THEN [n] ELSE [] END, list_transform(range(0, length(n) - 7, 4), lambda i: substr(n, CAST(i AS INT) + 1, 8)), [right(n, 8)])) AS marker FROM p WHERE length(n) >= 8
)
"""


@query(f"WITH {_MARKERS} SELECT marker FROM m")
def q20_leak_markers(spark, d):
    return leaks.marker_table(table(spark, d, "clean_document"), "title")


@query(f"""
WITH {_MARKERS}, t AS (SELECT segment_id, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9A-Z\\x{{4E00}}-\\x{{9FFF}}]+', '', 'g') AS n FROM segment WHERE text IS NOT NULL)
SELECT segment_id, count(*) AS matched_marker_count FROM t JOIN m ON contains(t.n, m.marker) GROUP BY segment_id HAVING count(*) >= 2
""")
def q21_text_leak(spark, d):
    marks = leaks.marker_table(table(spark, d, "clean_document"), "title")
    return leaks.text_leaks(table(spark, d, "segment"), marks, "segment_id", "text", transcript=False).select("segment_id", "matched_marker_count")


@query(oracles.SLUGS)
def q22_slug_filename(spark, d):
    docs = table(spark, d, "source_document")
    return docs.select("seq", clean.document_slug(F.col("title"), F.col("doc_order"), F.col("doc_id")).alias("slug"), clean.numbered_title(F.col("title"), F.col("doc_order")).alias("file_title"))


@query(f"""
WITH {_LATEST}, b AS (SELECT doc_id, segment_index, min(segment_id) AS segment_id FROM segment GROUP BY doc_id, segment_index)
SELECT b.segment_id, coalesce(l.status, 'pending') AS status, coalesce(l.audio_path, '') AS audio_path, coalesce(l.retry_count, 0) AS retry_count, coalesce(l.error, '') AS error
FROM b LEFT JOIN l ON b.doc_id = l.doc_id AND b.segment_index = l.segment_index
""")
def q23_worker_merge(spark, d):
    """Segments with the last result of each."""
    s = table(spark, d, "segment")
    base = s.groupBy("doc_id", "segment_index").agg(F.min("segment_id").alias("segment_id")).withColumns({c: F.lit(None).cast("string") for c in ("status", "audio_path", "retry_count", "error")})
    results = s.withColumn("ordinal", F.struct("updated_at", "segment_id"))
    return audio_plan.merge_results(base, results).select("segment_id", "status", "audio_path", "retry_count", "error")


_STATUS = """
SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE coalesce(status, 'pending') NOT IN ('completed', 'skipped', 'failed')) AS pending, 
  count(*) FILTER (WHERE status = 'completed' AND coalesce(audio_path, '') <> '' AND audio_path NOT IN (SELECT audio_path FROM segment WHERE retry_count = 0 AND audio_path IS NOT NULL)) AS missing_audio
FROM l GROUP BY doc_id
"""


def _status(spark, d) -> DataFrame:
    """The counts of each document's segments; the files that are there are those of a first attempt."""
    return summaries.segment_status(_latest(spark, d), "doc_id", table(spark, d, "segment").filter("retry_count = 0").select(F.col("audio_path").alias("path")))


@query(f"WITH {_LATEST} {_STATUS}")
def q24_segment_status(spark, d):
    return _status(spark, d)


_MANIFEST = f"""
{_LATEST}, s AS ({_STATUS}),
m AS (SELECT c.clean_id, c.doc_id, c.title, s.total AS segment_count, s.completed AS tts_completed, CASE WHEN s.total = s.completed THEN 'completed' ELSE 'skipped' END AS audio_status, s.failed, s.pending, s.missing_audio
      FROM clean_document c LEFT JOIN s ON c.doc_id = s.doc_id)
"""


def _manifest(spark, d) -> DataFrame:
    counts = _status(spark, d)
    docs = table(spark, d, "clean_document").select("clean_id", "doc_id", "title").join(counts, "doc_id", "left")
    return docs.withColumnsRenamed({"total": "segment_count", "completed": "tts_completed"}).withColumn(
        "audio_status", F.when(F.col("segment_count") == F.col("tts_completed"), "completed").otherwise("skipped"))


@query(f"WITH {_MANIFEST} SELECT count(*) AS documents, count(*) FILTER (WHERE audio_status = 'completed') AS audio_completed, CAST(coalesce(sum(tts_completed), 0) AS BIGINT) AS tts_completed, CAST(coalesce(sum(segment_count), 0) AS BIGINT) AS segment_count FROM m")
def q25_run_summary(spark, d):
    return summaries.run_summary(_manifest(spark, d))


_GONE = """
gone AS (
  SELECT clean_id AS doc_id, 'raw_path' AS field, 'raw/' || doc_id AS value FROM clean_document WHERE doc_id NOT IN (SELECT doc_id FROM source_document WHERE raw_text <> '')
  UNION ALL SELECT clean_id, 'clean_text_path', 'clean_text_path' FROM clean_document WHERE clean_text IS NULL
  UNION ALL SELECT clean_id, 'segment_manifest_path', 'segments/' || doc_id FROM clean_document WHERE doc_id NOT IN (SELECT doc_id FROM segment WHERE retry_count > 0 AND doc_id IS NOT NULL)
)
"""
_GONE_SQL = f"WITH {_GONE}"


def _gone(spark, d) -> DataFrame:
    docs = table(spark, d, "clean_document")
    manifest = docs.select(
        F.col("clean_id").alias("doc_id"), F.concat(F.lit("raw/"), "doc_id").alias("raw_path"), F.when(F.col("clean_text").isNotNull(), F.concat(F.lit("clean/"), "doc_id")).otherwise("").alias("clean_text_path"),
        F.concat(F.lit("clean/"), "doc_id").alias("translated_path"), F.concat(F.lit("clean/"), "doc_id").alias("script_path"), F.concat(F.lit("segments/"), "doc_id").alias("segment_manifest_path"))
    named = lambda df, folder: df.select(F.concat(F.lit(folder), "doc_id").alias("path"))
    files = named(table(spark, d, "source_document").filter("raw_text <> ''"), "raw/").unionByName(named(docs, "clean/")).unionByName(named(table(spark, d, "segment").filter("retry_count > 0"), "segments/"))
    return summaries.missing_stage_files(manifest, files, "segment")


@query(f"""
WITH {_MANIFEST}, {_GONE}, i AS (
  SELECT clean_id AS doc_seq, title AS document, 2 AS rule_no, 'segment manifest is missing' AS message FROM m WHERE segment_count IS NULL
  UNION ALL SELECT clean_id, title, 3, format('{{}} failed TTS segments', failed) FROM m WHERE failed > 0
  UNION ALL SELECT clean_id, title, 4, format('{{}} pending TTS segments', pending) FROM m WHERE pending > 0
  UNION ALL SELECT clean_id, title, 1, 'missing stage file: ' || value FROM m JOIN gone ON m.clean_id = gone.doc_id
  UNION ALL SELECT clean_id, title, 5, format('{{}} completed segment audio files are missing', missing_audio) FROM m WHERE missing_audio > 0
  UNION ALL SELECT clean_id, title, 6, 'audio file is missing' FROM m WHERE audio_status <> 'completed'
  UNION ALL SELECT clean_id, title, 7, 'audio status is ' || audio_status FROM m WHERE audio_status <> 'completed')
SELECT * FROM i
""")
def q26_status_issues(spark, d):
    return summaries.status_issues(_report(spark, d), "package", True)


def _report(spark, d) -> DataFrame:
    """The manifest's documents in the form of the status rules."""
    lost = _gone(spark, d).groupBy(F.col("doc_id").alias("clean_id")).agg(F.sort_array(F.collect_list("value")).alias("missing_stage_files"))
    return _manifest(spark, d).join(lost, "clean_id", "left").select(
        F.col("clean_id").alias("doc_seq"), "title", F.coalesce("missing_stage_files", F.array().cast("array<string>")).alias("missing_stage_files"), F.col("segment_count").isNull().alias("segment_manifest_missing"),
        "failed", "pending", "missing_audio", (F.col("audio_status") != "completed").alias("audio_missing"), "audio_status")


@query(f"""
WITH {_MANIFEST}, {_GONE}
SELECT count(*) AS documents, (SELECT count(*) FROM gone) AS stage_files_missing, count(*) FILTER (WHERE audio_status = 'completed') AS audio_completed, count(*) FILTER (WHERE audio_status = 'skipped') AS audio_skipped,
  count(*) FILTER (WHERE audio_status <> 'completed') AS audio_missing, CAST(coalesce(sum(failed), 0) AS BIGINT) AS segment_failed, CAST(coalesce(sum(pending), 0) AS BIGINT) AS segment_pending FROM m
""")
def q36_status_summary(spark, d):
    """The seven counters of a run's status."""
    return summaries.status_summary(_report(spark, d))


@query("SELECT doc_id, title FROM clean_document WHERE doc_id NOT IN (SELECT doc_id FROM segment WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING bool_and(coalesce(status, 'pending') = 'completed'))")
def q27_resume_pending(spark, d):
    """Documents of which some segment still has to be spoken."""
    done = table(spark, d, "segment").groupBy("doc_id").agg(F.every(F.coalesce("status", F.lit("pending")) == "completed").alias("all")).filter("all")
    return summaries.pending(table(spark, d, "clean_document").select("doc_id", "title"), done, ["doc_id"])


@query("""
WITH o AS (SELECT * FROM (VALUES ('source', 0), ('extract', 1), ('translate', 2), ('script', 3), ('segment', 4), ('tts', 5), ('package', 6)) t(p, i)),
s AS (SELECT segment_id, CASE status WHEN 'completed' THEN 'tts' WHEN 'failed' THEN 'segment' WHEN 'skipped' THEN 'package' ELSE '?' END AS l, CASE WHEN retry_count > 0 THEN 'tts' ELSE 'script' END AS r FROM segment)
SELECT segment_id, CASE WHEN a.i IS NULL THEN r WHEN a.i >= b.i THEN l ELSE r END AS phase FROM s LEFT JOIN o a ON s.l = a.p LEFT JOIN o b ON s.r = b.p
""")
def q28_phase_max(spark, d):
    status = F.col("status")
    left = F.when(status == "completed", "tts").when(status == "failed", "segment").when(status == "skipped", "package").otherwise("?")
    right = F.when(F.col("retry_count") > 0, "tts").otherwise("script")
    return table(spark, d, "segment").select("segment_id", summaries.phase_max(left, right).alias("phase"))


@query(_GONE_SQL + "SELECT * FROM gone")
def q29_missing_stage_files(spark, d):
    """Stage files that a manifest names, against an inventory: raw texts that are there, clean texts by their path, and segments."""
    return _gone(spark, d)


@query(oracles.BEST_MATCH)
def q30_best_match(spark, d):
    """Place and score of a fixed template in each embedding taken as a signal, and where the sample would lie."""
    signals = table(spark, d, "embeddings")
    found = leaks.match_signals(signals, "vec_id", "embedding", np.sin(np.arange(16)))
    return leaks.locate_leaks(found, 20, 2, 8, threshold=0.3, edge_seconds=1.5).select("vec_id", "score", "signature_pos", "position")


_EDGES = [("a", "b"), ("a", "c"), ("a", "x"), ("b", "d"), ("b", "c"), ("d", "e"), ("c", "e"), ("e", "a"), ("e", "f")]


@query("""
WITH RECURSIVE e(s, t) AS (VALUES ('a', 'b'), ('a', 'c'), ('a', 'x'), ('b', 'd'), ('b', 'c'), ('d', 'e'), ('c', 'e'), ('e', 'a'), ('e', 'f')),
w(n, lvl) AS (SELECT 'a', 0 UNION SELECT t, lvl + 1 FROM w JOIN e ON w.n = e.s WHERE lvl < 6 AND t <> 'x')
SELECT CAST(row_number() OVER (ORDER BY min(lvl), n) AS INT) AS doc_order, 'http://h/' || n AS url FROM w GROUP BY n ORDER BY 1 LIMIT 5
""")
def q31_crawl(spark, d):
    """Breadth-first crawl of a small graph of pages; one link leads nowhere."""
    nodes = sorted({n for e in _EDGES for n in e} - {"x"})
    pages = spark.createDataFrame([(f"http://h/{n}", "".join(f'<a href="/{t}#top">{t}</a>' for s, t in _EDGES if s == n), "text/html") for n in nodes], "url string, html string, content_type string")
    return sources.crawl(pages, ["http://h/a"], 5)


@query("""
SELECT m.clean_id AS seq, m.doc_id, CASE WHEN contains(lower(s.media_type), 'html') THEN 'text/html' ELSE 'text/markdown' END AS media_type, coalesce(nullif(m.title, ''), 'Untitled') AS title
FROM clean_document m LEFT JOIN (SELECT doc_id, min(seq) AS k, arg_min(media_type, seq) AS media_type FROM source_document WHERE raw_text <> '' GROUP BY doc_id) s ON m.doc_id = s.doc_id
WHERE s.k IS NOT NULL OR m.clean_text IS NOT NULL
""")
def q32_manifest_documents(spark, d):
    """Documents of an earlier run: the raw text where it is there, else the clean text."""
    ending = F.when(F.lower("media_type").contains("html"), ".html").otherwise(".md")
    raw = table(spark, d, "source_document").filter("raw_text <> ''").groupBy("doc_id").agg(F.min_by(F.struct("raw_text", "media_type"), "seq").alias("r")).select("doc_id", "r.*").withColumn("path", F.concat("doc_id", ending))
    docs = table(spark, d, "clean_document")
    manifest = docs.join(raw.select("doc_id", F.col("path").alias("raw_path")), "doc_id", "left").select(
        F.col("clean_id").alias("seq"), "doc_id", "title", F.lit("").alias("source_url"), F.lit("").alias("source_path"), F.lit("").alias("section"), F.lit(None).cast("int").alias("doc_order"),
        "raw_path", F.concat(F.lit("clean/"), "doc_id").alias("clean_text_path"))
    clean_rows = docs.filter("clean_text is not null").select(F.concat(F.lit("clean/"), "doc_id").alias("path"), F.col("clean_text").alias("text"))
    return sources.from_manifest(manifest, raw.select("path", F.col("raw_text").alias("text")), clean_rows).select("seq", "doc_id", "media_type", "title")


_PARTS = r"""list_transform(list_filter(list_transform(string_split(coalesce(section, ''), '/'), lambda p: trim(p)), lambda p: p <> ''), lambda p: regexp_replace(regexp_replace(p, '[\\:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"""
WITH s AS (SELECT seq, {_PARTS} AS parts, {oracles.file_name('title')} AS name, doc_order FROM source_document)
SELECT seq, array_to_string(list_concat(['06_podcast'], parts, [CASE WHEN doc_order IS NULL THEN name ELSE doc_order || '. ' || name END]), '/') || '.m4a' AS path FROM s
""")
def q33_audio_paths(spark, d):
    path = audio_plan.final_audio_path(F.col("section"), F.col("title"), F.col("doc_order"), F.col("doc_id"))
    return table(spark, d, "source_document").select("seq", path.alias("path"))


@query("SELECT segment_id, CAST(greatest(1, floor(24000 * greatest(pause_after_ms, 0) / 1000)) AS INT) AS frames FROM segment")
def q37_silence_frames(spark, d):
    return table(spark, d, "segment").select("segment_id", audio_plan.silence_frames(24_000, F.col("pause_after_ms")).alias("frames"))


@query("SELECT seq, CASE WHEN starts_with(source_path, 'inbox/') THEN substr(source_path, 7) ELSE source_path END AS below, '/data/' || source_path AS whole FROM source_document WHERE source_path <> ''")
def q38_relative_paths(spark, d):
    """Paths from a folder on where they lie under it; the others whole, without detours."""
    rows = table(spark, d, "source_document").filter("source_path <> ''")
    return rows.select("seq", urls.relative_path(F.col("source_path"), "./inbox/").alias("below"), urls.relative_path(F.concat(F.lit("/data/x/.././"), "source_path"), "/other").alias("whole"))


@query(oracles.PARAGRAPHS)
def q39_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(segments.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(oracles.COLLAPSED)
def q40_collapsed_text(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", pytext.collapse_text(x).alias("collapsed"), pytext.collapse_inline(x).alias("inline"))


@query("""
SELECT segment_id, format('index {} of 9', segment_index) AS label, nullif(CAST(chars AS VARCHAR), '') IS NOT NULL AS counted, CAST(coalesce(TRY_CAST(substr(text, 1, 2) AS INT), -1) AS INT) AS number,
  CASE WHEN text IS NULL THEN NULL ELSE 'Translate the text below into German. Keep paragraphs, names and figures; answer with the translation only.' || chr(10) || 'Title: ' || coalesce(status, 'null') || chr(10) || 'Part: ' || segment_index || ' of 9' || chr(10) || chr(10) || text END AS prompt
FROM segment
""")
def q41_prompts(spark, d):
    """Instructions for a translator, and numbers read from texts."""
    s = table(spark, d, "segment")
    return s.select(
        "segment_id", F.format_string("index %d of 9", "segment_index").alias("label"), pytext.optional_int(F.col("chars")).isNotNull().alias("counted"), pytext.int_or(F.substring("text", 1, 2), -1).alias("number"),
        F.when(F.col("text").isNotNull(), clean.translation_prompt(F.col("text"), F.col("status"), F.col("segment_index"), F.lit(9), "German")).alias("prompt"))


@query("SELECT strftime(fetched_at, '%Y-%m-%d') AS day, count(*) AS documents, CAST(sum(coalesce(length(raw_text), 0)) AS BIGINT) AS chars FROM source_document GROUP BY 1")
def q34_arrivals(spark, d):
    """Documents and characters per day of fetching: the batch form of the streaming aggregate."""
    return table(spark, d, "source_document").groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.length("raw_text"), F.lit(0))).alias("chars"))


@query("SELECT segment_id, CASE WHEN text IS NULL THEN [] ELSE list_filter(list_transform(regexp_split_to_array(text, '[|\\n]+'), lambda x: " + _STRIP("x") + "), lambda x: x <> '') END AS phrases FROM segment")
def q35_phrase_lists(spark, d):
    return table(spark, d, "segment").select("segment_id", clean.phrase_list(F.col("text")).alias("phrases"))
