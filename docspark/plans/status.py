"""Status of a run as relations over its stage tables: what is missing, the counts of every document, and the issues."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.summaries import PHASES, STAGE_FIELDS, missing_stage_files, segment_status, status_issues, status_summary
from docspark.plans.pipeline import LISTED, StageTables, current


def document_report(tables: StageTables, keys: dict[str, str], to_phase: str = "package", expect_audio: bool = False) -> DataFrame:
    """A row per document in the form of ``status_issues``, with ``error`` for a page that was not fetched.

    A document holds a stage if the stage has a row for it that follows from the sources as they are; a script without text has no
    segments to miss.
    """
    stages = current(tables, keys, to_phase)
    docs = stages["source"]
    docs = docs.withColumn("error", docs["error"] if "error" in docs.columns else F.lit(None).cast("string")).select("seq", "doc_id", "title", "error")
    there = [stages[p].select(F.concat(F.lit(f"{p}/"), "doc_id").alias("path")) for p, _ in STAGE_FIELDS if p in stages]
    if "script" in stages:
        there.append(stages["script"].filter("trim(script_text) = ''").select(F.concat(F.lit("segment/"), "doc_id").alias("path")))
    files = there[0]
    for more in there[1:]:
        files = files.unionByName(more)
    fetched = docs.filter("error is null")
    names = fetched.select("doc_id", *[F.concat(F.lit(f"{p}/"), "doc_id").alias(f) for p, f in STAGE_FIELDS])
    missing = missing_stage_files(names, files, to_phase).groupBy("doc_id").agg(F.sort_array(F.collect_list("value")).alias("missing_stage_files"))
    out = docs.join(missing, "doc_id", "left")
    segments = stages.get("tts", stages.get("segment"))
    if segments is not None:
        out = out.join(segment_status(segments, "doc_id").select("doc_id", "failed", "pending", "missing_audio"), "doc_id", "left")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("failed", "pending", "missing_audio")})
    if "package" in stages:
        out = out.join(stages["package"].select("doc_id", F.col("status").alias("audio_status"), F.col("audio_path").alias("__audio")), "doc_id", "left")
    else:
        out = out.withColumns({"audio_status": F.lit(None).cast("string"), "__audio": F.lit(None).cast("string")})
    status = F.coalesce("audio_status", F.lit("skipped"))
    lost = F.when(status == "completed", F.coalesce("__audio", F.lit("")) == "").otherwise(F.lit(bool(expect_audio)))
    gone = F.coalesce("missing_stage_files", F.array().cast("array<string>"))
    return out.select(
        F.col("seq").alias("doc_seq"), "doc_id", "title", "error", gone.alias("missing_stage_files"), F.exists(gone, lambda x: x.startswith("segment/")).alias("segment_manifest_missing"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("failed", "pending", "missing_audio")], lost.alias("audio_missing"), status.alias("audio_status"))


def issue_rows(report: DataFrame, to_phase: str, expect_audio: bool) -> DataFrame:
    """``doc_seq, document, rule_no, message``: pages that were not fetched (rule 0), and the issues of the others."""
    unread = report.filter("error is not null").select("doc_seq", F.col("title").alias("document"), F.lit(0).alias("rule_no"), F.concat(F.lit("page not fetched: "), "error").alias("message"))
    return unread.unionByName(status_issues(report.filter("error is null"), to_phase, expect_audio))


def inspect_run(spark: SparkSession, output_dir: str, expect_audio: bool = False) -> dict:
    """Whether all is well with a run: counters, the number of issues, and the first ``LISTED`` of them in the order of the documents."""
    root = Path(output_dir).expanduser()
    path = root / "manifest.json"
    wrong = lambda text: {"output_dir": str(root), "manifest_exists": path.exists(), "expect_audio": bool(expect_audio), "ok": False, "issue_count": 1, "issues": [{"level": "error", "message": text}], "summary": {}}
    if not path.exists():
        return wrong("manifest.json is missing")
    try:
        manifest = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        return wrong(f"manifest.json is invalid: {error}")
    if not isinstance(manifest, dict) or not isinstance(manifest.get("documents"), list):
        return wrong("manifest documents must be a list")
    reached = "package" if expect_audio else manifest.get("to_phase")
    reached = reached if reached in PHASES else "package"
    report = document_report(StageTables(spark, root.resolve().as_uri()), manifest.get("stage_settings", {}), reached, expect_audio)
    issues = issue_rows(report, reached, expect_audio)
    count = issues.count()
    shown = issues.orderBy("doc_seq", "rule_no", "message").limit(LISTED).collect()
    return {
        "output_dir": str(root), "manifest_exists": True, "expect_audio": bool(expect_audio), "expected_to_phase": reached, "ok": count == 0, "issue_count": count,
        "issues": [{"level": "error", "document": r.document, "message": r.message} for r in shown], "summary": status_summary(report).first().asDict()}
