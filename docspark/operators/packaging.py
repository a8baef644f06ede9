"""Final audio: a document's segments and silences put together as one file, each document by one task, block by block."""

from __future__ import annotations

import shutil
import subprocess
import wave
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKAGED = "doc_id string, stage_key string, status string, audio_path string, duration_seconds double, sample_rate int, channels int, codec string, error string"
#: Frames that are held at once.
AT_ONCE = 1 << 16


def join_wavs(plan: list[tuple[str, str, int]], target: Path) -> tuple[float, int, int]:
    """Write the files and silences ``(type, path, milliseconds)`` one after the other: seconds, rate and channels of the result.

    All files must be of one form. A silence has at least one frame.
    """
    form, frames = None, 0
    target.parent.mkdir(parents=True, exist_ok=True)
    aside = target.with_suffix(".part")
    try:
        with wave.open(str(aside), "wb") as out:
            first = next((p for kind, p, _ in plan if kind == "audio"), None)
            if first is None:
                raise ValueError("no audio to put together")
            with wave.open(first, "rb") as source:
                form = source.getparams()[:3]
            out.setnchannels(form[0])
            out.setsampwidth(form[1])
            out.setframerate(form[2])
            for kind, path, ms in plan:
                if kind == "silence":
                    n = max(1, form[2] * max(0, int(ms)) // 1000)
                    out.writeframes(bytes(n * form[0] * form[1]))
                    frames += n
                    continue
                with wave.open(path, "rb") as source:
                    if source.getparams()[:3] != form:
                        raise ValueError(f"another form of audio: {path}")
                    while block := source.readframes(AT_ONCE):
                        out.writeframes(block)
                    frames += source.getnframes()
        aside.replace(target)
    finally:
        aside.unlink(missing_ok=True)
    return round(frames / form[2], 3), form[2], form[0]


def _encode(wav: Path, target: Path, bitrate: str, keep: bool) -> None:
    if not shutil.which("ffmpeg"):
        raise RuntimeError("ffmpeg is needed for this audio format")
    subprocess.run(["ffmpeg", "-y", "-loglevel", "error", "-i", str(wav), "-c:a", "aac", "-b:a", bitrate, str(target)], check=True)
    if not keep:
        wav.unlink(missing_ok=True)


def package_audio(wanted: DataFrame, plan: DataFrame, root: str, bitrate: str = "128k", keep_wav: bool = False) -> DataFrame:
    """The final audio of each wanted document ``(doc_id, stage_key, path)`` under ``root``, from the rows of its pause plan.

    A document without any audio is ``skipped``; what cannot be put together is ``failed`` with its error; neither stops the others.
    """
    rows = wanted.join(plan.select("doc_id", "pos", "type", F.col("path").alias("part"), "duration_ms"), "doc_id", "left")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        doc, stage_key, path = key
        audio = part[part["type"].notna()].sort_values("pos")
        row = (doc, stage_key, "skipped", "", 0.0, 0, 0, "", "")
        if len(audio):
            target = Path(root) / path
            try:
                steps = list(zip(audio["type"], audio["part"], audio["duration_ms"].fillna(0)))
                wav = target.with_suffix(".wav")
                seconds, rate, channels = join_wavs(steps, wav)
                if target.suffix != ".wav":
                    _encode(wav, target, bitrate, keep_wav)
                row = (doc, stage_key, "completed", str(target), seconds, rate, channels, "pcm_s16le" if target.suffix == ".wav" else "aac", "")
            except Exception as error:
                row = (doc, stage_key, "failed", "", 0.0, 0, 0, "", f"{type(error).__name__}: {error}")
        return pd.DataFrame([row], columns=[c.split()[0] for c in PACKAGED.split(", ")])

    return rows.groupBy("doc_id", "stage_key", F.col("path")).applyInPandas(run, PACKAGED)
