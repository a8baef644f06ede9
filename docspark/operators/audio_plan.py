"""Pause plan, merge of worker results, paths of the final audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.clean import numbered_title, safe_filename
from docspark.operators.segments import PAUSES


def pause_plan(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Audio and silence in turn, per document: ``key, pos, type, index, duration_ms, reason, path``.

    No silence follows the last segment, a missing pause is that of a sentence, and a pause of 0 or less gives no row.
    """
    order = Window.partitionBy(key).orderBy("segment_index")
    segments = segments.withColumn("__last", F.lead("segment_index").over(order).isNull())
    last = F.col("__last")
    pause = F.coalesce("pause_after_ms", F.lit(PAUSES["sentence"]))
    audio = F.struct(F.lit("audio").alias("type"), F.lit(None).cast("int").alias("duration_ms"), F.lit(None).cast("string").alias("reason"), F.col("audio_path").alias("path"))
    silence = F.when(~last & (pause > 0), F.struct(
        F.lit("silence").alias("type"), pause.alias("duration_ms"), F.coalesce("pause_reason", F.lit("sentence")).alias("reason"),
        F.format_string("pause_%04d_%dms.wav", "segment_index", pause).alias("path")))
    rows = segments.select(key, "segment_index", F.explode(F.filter(F.array(audio, silence), lambda x: x.isNotNull())).alias("p"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("segment_index", "p.type"))
    return rows.select(key, pos.alias("pos"), "p.type", F.col("segment_index").alias("index"), "p.duration_ms", "p.reason", "p.path")


def silence_frames(rate: Column | int, ms: Column) -> Column:
    rate = F.lit(rate) if isinstance(rate, int) else rate
    return F.greatest(F.lit(1), F.floor(rate * F.greatest(ms, F.lit(0)) / 1000)).cast("int")


def merge_results(segments: DataFrame, results: DataFrame, key: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    """Segments with the status of the worker's results (the last of a segment counts); without one they are pending."""
    last = results.groupBy(key, "segment_index").agg(F.max_by(F.struct("status", "audio_path", "retry_count", "error"), ordinal).alias("__r"))
    base = segments.drop("status", "audio_path", "retry_count", "error")
    return base.join(last, [key, "segment_index"], "left").select(
        *base.columns, F.coalesce("__r.status", F.lit("pending")).alias("status"), F.coalesce("__r.audio_path", F.lit("")).alias("audio_path"),
        F.coalesce("__r.retry_count", F.lit(0)).alias("retry_count"), F.coalesce("__r.error", F.lit("")).alias("error"))


def final_audio_path(section: Column, title: Column, order: Column, slug: Column, audio_format: str = "m4a", naming: str = "official-title") -> Column:
    """``06_podcast/<parts of the section>/<number and title>.m4a`` (``.wav`` for any other format)."""
    parts = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "/", -1), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"""[\\:*?"<>|]+""", " "), r"\s+", " "))
    name = numbered_title(title, order) if naming == "official-title" else safe_filename(slug)
    ending = ".m4a" if audio_format.lower() == "m4a" else ".wav"
    return F.concat(F.array_join(F.concat(F.array(F.lit("06_podcast")), parts, F.array(name)), "/"), F.lit(ending))
