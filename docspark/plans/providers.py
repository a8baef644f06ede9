"""Steps with effects outside: extractors, translation, speech. ``none`` is native; others are functions given by the user."""

from __future__ import annotations

import importlib.util
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.clean import translation_prompt, with_clean_text
from docspark.functions.html import html_basic, looks_like_html, resolve_title
from docspark.functions.pytext import collapse_text, strip

EXTRACTORS = ("basic", "auto", "trafilatura")
Reader = Callable[[str], "tuple[str, str] | None"]


def optional_reader(raw: str) -> tuple[str, str] | None:
    """``(title, text)`` of a page by the optional extractor; none where it finds nothing."""
    import trafilatura

    text = trafilatura.extract(raw, output_format="txt", include_comments=False, include_tables=True, favor_precision=False)
    if not text or not text.strip():
        return None
    try:
        title = getattr(trafilatura.extract_metadata(raw), "title", None)
    except Exception:  # a page whose metadata cannot be read has no title
        title = None
    return (title or "").strip(), text


def reader_of(extractor: str) -> Reader | None:
    """The reader of an extractor: none for ``basic``, and for ``auto`` where the optional one is not installed."""
    name = (extractor or "basic").strip().lower()
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor: {extractor}")
    if name == "basic":
        return None
    if importlib.util.find_spec("trafilatura") is None:
        if name == "auto":
            return None
        raise RuntimeError("this extractor is not installed")
    return optional_reader


def extract(df: DataFrame, extractor: str = "basic", reader: Reader | None = None) -> DataFrame:
    """``df`` with ``title`` resolved and ``clean_text``: pages through the HTML reader, other texts through the cleaner.

    With an extractor of its own (or a given ``reader``) a page goes through that first, and through the HTML reader only if
    nothing is found. Null texts give an empty text.
    """
    own = reader or reader_of(extractor)
    page = looks_like_html(F.col("media_type"), F.col("raw_text"))
    rows = df.withColumn("__page", page)
    if own is None:
        rows = rows.withColumn("__own", F.lit(None).cast("struct<title:string,text:string>"))
    else:
        by_reader = F.pandas_udf(lambda raw: pd.DataFrame([own(x) or (None, None) if isinstance(x, str) else (None, None) for x in raw], columns=["title", "text"]), "title string, text string")
        rows = rows.withColumn("__own", by_reader(F.when(F.col("__page"), F.col("raw_text"))))
    found = F.col("__own.text").isNotNull()
    rows = rows.withColumn("__r", html_basic(F.when(F.col("__page") & ~found, F.col("raw_text"))))
    read = F.when(found, collapse_text(F.col("__own.text"))).otherwise(F.coalesce("__r.text", F.lit("")))
    rows = with_clean_text(rows.withColumn("__own_text", F.when(~F.col("__page"), F.col("raw_text"))), "__own_text", "__cleaned")
    text = F.when(F.col("__page"), read).otherwise(F.col("__cleaned"))
    named = F.when(F.col("__page"), resolve_title(F.col("title"), F.when(found, F.col("__own.title")).otherwise(F.col("__r.title"))))
    title = named.otherwise(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
    return rows.withColumn("clean_text", text).withColumn("title", title).drop("__r", "__own", "__page", "__own_text", "__cleaned")


def http_model(url: str, model: str, timeout: int = 900, opener=urllib.request.urlopen) -> Callable[[str], str]:
    """A translator that posts each prompt to a text-generation service: JSON with ``model, prompt, stream``, answered by ``response`` or ``error``."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode("utf-8")
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
        with opener(request, timeout=timeout) as answer:
            said = json.loads(answer.read().decode("utf-8"))
        if said.get("error"):
            raise RuntimeError(str(said["error"]))
        return str(said.get("response") or "")

    return ask


def with_retries(call: Callable[[str], str], retries: int = 2, pause: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str | None, str, int]]:
    """``(result, error, attempts)``: up to ``retries + 1`` attempts, waiting 2, 4 ... at most 10 seconds between them."""

    def run(prompt: str) -> tuple[str | None, str, int]:
        most, error = max(1, retries + 1), ""
        for attempt in range(1, most + 1):
            try:
                answer = call(prompt)
                if not answer or not answer.strip():
                    raise ValueError("empty answer")
                return answer.strip(), "", attempt
            except Exception as failure:
                error = f"{type(failure).__name__}: {failure}"
                if attempt < most:
                    pause(min(2 * attempt, 10))
        return None, error, most

    return run


def translate_chunks(chunks: DataFrame, provider: str = "none", enabled: bool = True, language: str = "zh", call: Callable[[str], str] | None = None, retries: int = 2) -> DataFrame:
    """``chunks`` with ``translated_text`` and ``error``; ``none`` or disabled gives the text as it is."""
    if not enabled or provider == "none":
        return chunks.withColumn("translated_text", strip(F.col("chunk_text"))).withColumn("error", F.lit(""))
    if call is None:
        raise ValueError(f"no translation provider: {provider}")
    prompt: Column = translation_prompt(F.col("chunk_text"), F.col("title"), F.col("chunk_index"), F.col("chunk_total"), language)
    rows = chunks.withColumn("prompt", prompt)
    schema = T.StructType([*rows.schema.fields, T.StructField("translated_text", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(call, retries)
        for f in frames:
            answers = [ask(p) for p in f["prompt"]]
            yield f.assign(translated_text=[a[0] for a in answers], error=[a[1] for a in answers])

    return rows.mapInPandas(run, schema)


def synthesize(segments: DataFrame, provider: str = "none", enabled: bool = True, speak: Callable[[str, str], None] | None = None, retries: int = 2) -> DataFrame:
    """Segments with their status; ``none`` or disabled skips them all. Failures are rows with their error."""
    if not enabled or provider == "none":
        return segments.withColumns({"status": F.lit("skipped"), "audio_path": F.lit(""), "retry_count": F.lit(0), "error": F.lit("")})
    if speak is None:
        raise ValueError(f"no speech provider: {provider}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, path in zip(f["text"], f["audio_path"]):
                error, used = "", 0
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                for used in range(retries + 1):
                    try:
                        speak(text, path)
                        error = ""
                        break
                    except Exception as failure:
                        error = f"{type(failure).__name__}: {failure}"
                        Path(path).unlink(missing_ok=True)  # half a file is none
                out.append(("failed" if error else "completed", path, used, error))
            yield f.assign(status=[o[0] for o in out], audio_path=[o[1] for o in out], retry_count=[o[2] for o in out], error=[o[3] for o in out])

    return segments.mapInPandas(run, segments.schema)


def probe_info(json_col: Column, path: Column) -> Column:
    """Duration, rate, channels and codec of the first audio stream of a media probe's JSON."""
    schema = "streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,duration:string>>, format struct<duration:string>"
    p = F.from_json(json_col, schema)
    s = F.get(F.filter(p["streams"], lambda x: x["codec_type"] == "audio"), F.lit(0))
    seconds = F.round(F.coalesce(s["duration"].try_cast("double"), p["format"]["duration"].try_cast("double"), F.lit(0.0)), 3)
    return F.struct(
        F.lit("completed").alias("status"), path.alias("audio_path"), seconds.alias("duration_seconds"), F.coalesce(s["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"),
        F.coalesce(s["channels"], F.lit(0)).alias("channels"), F.coalesce(s["codec_name"], F.lit("")).alias("codec"))
