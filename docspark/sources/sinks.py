"""Sinks: segment manifests, audit events, and the export of a run as files of the classic layout."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDERS = {"raw_text": "01_sources/raw", "clean_text": "02_clean_text", "translated_text": "03_translated", "script_text": "04_tts_script"}


def segment_manifest(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, manifest``: the JSON array of each document's segments, in order."""
    item = F.struct(F.col("segment_index").alias("index"), *[c for c in ("text", "chars", "pause_reason", "pause_after_ms", "status", "audio_path", "retry_count", "error")])
    return segments.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("manifest"))


def append_events(events: DataFrame, path: str) -> None:
    """Audit events, one JSON object a line, each with its time; earlier events stay."""
    stamped = events.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("time"), *events.columns)
    stamped.write.mode("append").json(path)


def export_files(df: DataFrame, root: str, text_col: str, name_col: str = "slug", force: bool = False) -> DataFrame:
    """Write a text per document under ``root`` (a folder that all executors share): ``name, path, written``.

    A file that is there is kept unless ``force``; raw pages end in ``.html``, everything else in ``.md``. Names should be unique.
    """
    folder = Path(root) / FOLDERS[text_col]
    page = F.lower("media_type").contains("html") if text_col == "raw_text" and "media_type" in df.columns else F.lit(False)
    rows = df.select(F.col(name_col).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(page, F.lit(False)).alias("page"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder.mkdir(parents=True, exist_ok=True)
        for f in frames:
            out = []
            for name, text, page in zip(f["name"], f["text"], f["page"]):
                path = folder / f"{name}{'.html' if page else '.md'}"
                fresh = force or not path.exists()
                if fresh:
                    path.write_text(text, encoding="utf-8")
                out.append((name, str(path), fresh))
            yield pd.DataFrame(out, columns=["name", "path", "written"])

    return rows.mapInPandas(run, "name string, path string, written boolean")


def export_metadata(df: DataFrame, root: str, name_col: str = "slug", force: bool = False) -> DataFrame:
    """Write what is known of each document as ``01_sources/metadata/<name>.json``: ``name, path, written``. A file that is there is kept unless ``force``."""
    folder = Path(root) / "01_sources/metadata"
    known = F.struct(F.col("doc_id").alias("id"), "title", "section", F.col("doc_order").alias("order"), "source_url", "source_path", "media_type", "metadata")
    rows = df.select(F.col(name_col).alias("name"), F.to_json(known, {"ignoreNullFields": "false"}).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder.mkdir(parents=True, exist_ok=True)
        for f in frames:
            out = []
            for name, text in zip(f["name"], f["text"]):
                path = folder / f"{name}.json"
                fresh = force or not path.exists()
                if fresh:
                    path.write_text(json.dumps(json.loads(text), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
                out.append((name, str(path), fresh))
            yield pd.DataFrame(out, columns=["name", "path", "written"])

    return rows.mapInPandas(run, "name string, path string, written boolean")


def export_manifests(manifests: DataFrame, root: str, key: str = "doc_id") -> int:
    """Write each document's segment manifest as ``05_segments/<key>/segments.json``; the number of files."""
    folder = Path(root) / "05_segments"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, text in zip(f[key], f["manifest"]):
                (folder / str(k)).mkdir(parents=True, exist_ok=True)
                (folder / str(k) / "segments.json").write_text(json.dumps(json.loads(text), ensure_ascii=False, indent=2), encoding="utf-8")
            yield pd.DataFrame({"n": [len(f)]})

    return manifests.select(key, "manifest").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
