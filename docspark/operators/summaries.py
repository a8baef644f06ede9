"""Aggregates over runs and segments, resume and status as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phases in order.
PHASES = ("source", "extract", "translate", "script", "segment", "tts", "package")
STAGE_FIELDS = (("source", "raw_path"), ("extract", "clean_text_path"), ("translate", "translated_path"), ("script", "script_path"), ("segment", "segment_manifest_path"))


def phase_ordinal(phase: Column) -> Column:
    """Place of a phase; an unknown one counts as the last."""
    table = F.create_map(*[x for i, p in enumerate(PHASES) for x in (F.lit(p), F.lit(i))])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(phase, F.lit(""))))), F.lit(len(PHASES) - 1))


def phase_max(left: Column, right: Column) -> Column:
    """The later phase; where the left one is unknown, the right one."""
    known = F.lower(F.trim(left)).isin(*PHASES)
    return F.when(~F.coalesce(known, F.lit(False)), right).when(phase_ordinal(left) >= phase_ordinal(right), left).otherwise(right)


def segment_status(segments: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """``key, total, completed, skipped, failed, pending, missing_audio``; any other status counts as pending."""
    rows = segments.withColumn("__s", F.coalesce(F.col("status"), F.lit("pending")))
    if files is not None:
        there = files.select(F.col("path").alias("audio_path"), F.lit(True).alias("__there")).distinct()
        rows = rows.join(there, "audio_path", "left")
    lost = F.lit(False) if files is None else (F.col("__s") == "completed") & (F.coalesce("audio_path", F.lit("")) != "") & F.col("__there").isNull()
    s = F.col("__s")
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"),
        F.count_if(~s.isin("completed", "skipped", "failed")).alias("pending"), F.count_if(lost).alias("missing_audio"))


def run_summary(manifest: DataFrame) -> DataFrame:
    """One row: ``documents, audio_completed, tts_completed, segment_count``."""
    return manifest.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("audio_status") == "completed").alias("audio_completed"),
        F.coalesce(F.sum("tts_completed"), F.lit(0)).alias("tts_completed"), F.coalesce(F.sum("segment_count"), F.lit(0)).alias("segment_count"))


def status_summary(documents: DataFrame) -> DataFrame:
    """One row of seven counters over per-document reports (see ``status_issues``)."""
    count = lambda when: F.count_if(F.coalesce(when, F.lit(False)))
    total = lambda col: F.coalesce(F.sum(col), F.lit(0)).cast("long")
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), total(F.size("missing_stage_files")).alias("stage_files_missing"),
        count(F.col("audio_status") == "completed").alias("audio_completed"), count(F.col("audio_status") == "skipped").alias("audio_skipped"),
        count(F.col("audio_missing")).alias("audio_missing"), total("failed").alias("segment_failed"), total("pending").alias("segment_pending"))


def missing_stage_files(manifest: DataFrame, files: DataFrame, to_phase: str = "package", key: str = "doc_id") -> DataFrame:
    """``key, field, value``: stage fields of the phases reached that are empty (value is the field) or name no file."""
    reached = [(p, f) for p, f in STAGE_FIELDS if PHASES.index(p) <= PHASES.index(to_phase)]
    long = manifest.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("value")) for _, f in reached])).alias("s")).select(key, "s.*")
    empty = long.filter("value = ''").select(key, "field", F.col("field").alias("value"))
    absent = long.filter("value <> ''").join(files.select(F.col("path").alias("value")).distinct(), "value", "left_anti").select(key, "field", "value")
    return empty.unionByName(absent)


def status_issues(documents: DataFrame, to_phase: str = "package", expect_audio: bool = False) -> DataFrame:
    """``doc_seq, document, rule_no, message`` of per-document reports, in the order of the rules.

    ``documents``: ``doc_seq, title, missing_stage_files array<string>, segment_manifest_missing, failed, pending, missing_audio,
    audio_missing, audio_status``.
    """
    reached = lambda p: PHASES.index(to_phase) >= PHASES.index(p)
    issue = lambda n, when, text: F.when(when, F.struct(F.lit(n).alias("rule_no"), text.alias("message")))
    rules = F.array(
        issue(2, F.lit(reached("segment")) & F.col("segment_manifest_missing"), F.lit("segment manifest is missing")),
        issue(3, F.col("failed") > 0, F.format_string("%d failed TTS segments", "failed")),
        issue(4, F.lit(reached("tts")) & (F.col("pending") > 0), F.format_string("%d pending TTS segments", "pending")),
        issue(5, F.col("missing_audio") > 0, F.format_string("%d completed segment audio files are missing", "missing_audio")),
        issue(6, F.col("audio_missing"), F.lit("audio file is missing")),
        issue(7, F.lit(reached("package") and expect_audio) & (F.col("audio_status") != "completed"), F.format_string("audio status is %s", "audio_status")))
    files = F.transform(F.coalesce("missing_stage_files", F.array().cast("array<string>")), lambda f: F.struct(F.lit(1).alias("rule_no"), F.concat(F.lit("missing stage file: "), f).alias("message")))
    return documents.select("doc_seq", F.col("title").alias("document"), F.explode(F.concat(files, F.filter(rules, lambda r: r.isNotNull()))).alias("i")).select("doc_seq", "document", "i.*")


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows that still have to be worked on: those whose key is not done, or all if forced."""
    return wanted if force else wanted.join(done.select(*keys).distinct(), keys, "left_anti")
