"""Guards over synthesised segments: a sample heard in the audio, or its phrases in a transcript, as rows with an action."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.clean import phrase_list
from docspark.operators.leaks import leak_action, locate_leaks, marker_table, match_signals, text_leaks


def audio_guard(segments: DataFrame, key: str, samples_col: str, profile: dict | None, policy: str = "trim", threshold: float = 0.88, edge_seconds: float = 1.5) -> DataFrame:
    """Segments whose audio holds the sample: where, what to do, and how many samples remain. Off, or without a profile: none."""
    if policy == "off" or profile is None:
        return segments.select(key).filter("false").withColumns({"action": F.lit(""), "remaining_samples": F.lit(0).cast("long")})
    found = match_signals(segments, key, samples_col, np.asarray(profile["signature"]))
    rows = locate_leaks(found, profile["reference_len"], profile["signature_offset"], profile["sample_rate"], threshold, edge_seconds)
    rest = F.when(F.col("position") == "start", F.col("samples") - F.col("clamped_end")).when(F.col("position") == "end", F.col("clamped_start")).otherwise(0)
    return rows.withColumn("action", leak_action(policy, profile["sample_rate"])).withColumn("remaining_samples", rest)


def trimmed(samples: Column, row: Column) -> Column:
    """The samples that a ``trim`` leaves."""
    after = F.slice(samples, (row["clamped_end"] + 1).cast("int"), F.greatest(F.lit(0), F.size(samples) - row["clamped_end"].cast("int")))
    return F.when(row["position"] == "start", after).otherwise(F.slice(samples, F.lit(1), row["clamped_start"].cast("int")))


def text_guard(audio: DataFrame, key: str, path_col: str, phrases: str, transcribe: Callable[[str], str] | None, policy: str = "off", least: int = 8, min_hits: int = 2) -> DataFrame:
    """Audio whose transcript holds the sample's phrases. Off, or without phrases: none; otherwise a transcriber is needed."""
    spark = audio.sparkSession
    marks = marker_table(spark.createDataFrame([(phrases or "",)], "p string").select(F.explode(phrase_list(F.col("p"))).alias("p")), "p", least)
    if policy == "off" or not phrases:
        transcribe = None
        audio = audio.filter("false")
    elif transcribe is None:
        raise ValueError("a transcriber is needed")
    kind = audio.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "transcript": [transcribe(p) for p in f[path_col]]})

    heard = audio.select(key, path_col).mapInPandas(run, f"{key} {kind}, transcript string")
    return text_leaks(heard.withColumnRenamed("transcript", "heard"), marks, key, "heard", least, min_hits).withColumn("action", F.lit("reject"))
