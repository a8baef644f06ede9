"""Cleaning of Markdown and text, the narration script, names and titles."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.pytext import WS, collapse_text, strip, text_or_empty


@F.pandas_udf(T.StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_unescape(x: pd.Series) -> pd.Series:
    return x.map(lambda s: html.unescape(unicodedata.normalize("NFKC", s)), na_action="ignore")


def unescape(x: Column) -> Column:
    """HTML entities decoded; only texts with an ampersand are sent to Python."""
    return F.coalesce(_unescape(F.when(x.contains("&"), x)), x)


def nfkc(x: Column) -> Column:
    """Compatibility form; only texts beyond ASCII are sent to Python."""
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def normalize_newlines(x: Column) -> Column:
    """LF line ends, plain spaces, ``-`` and ``--`` for the dashes."""
    x = F.regexp_replace(text_or_empty(x), r"\r\n?", "\n")
    return F.replace(F.replace(F.replace(x, F.lit(" "), F.lit(" ")), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("--"))


# The rules of the cleaner, whose order can be observed in the results.
_BEFORE_ENTITIES = (
    (r"(?s)```.*?```", "\n"), (r"(?md)^(?: {4}|\t).*$", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (rf"https?://[^{WS}]+", ""), (r"<[^>]+>", " "),
)
_AFTER_ENTITIES = (
    (rf"(?md)^[{WS}]{{0,3}}#{{1,6}}[{WS}]*", "\n"), (rf"(?md)^[{WS}]*[-*+][{WS}]+", ""), (rf"(?md)^[{WS}]*\p{{Nd}}+[.)][{WS}]+", ""),
    (rf"(?md)^[{WS}]*>[{WS}]?", ""), (r"`([^`]+)`", "$1"), (r"[*_~]{1,3}([^*_~]+)[*_~]{1,3}", "$1"),
)


def _chain(x: Column, rules: tuple) -> Column:
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return x


def clean_source_text(x: Column) -> Column:
    """Readable prose of Markdown or plain text; null gives an empty text."""
    return collapse_text(_chain(unescape(_chain(normalize_newlines(x), _BEFORE_ENTITIES)), _AFTER_ENTITIES))


def with_clean_text(df: DataFrame, source: str, target: str = "clean_text") -> DataFrame:
    """``df`` with ``clean_source_text`` of a column. Each stage is a column of its own, so that its chain of rules is evaluated once
    although the next stage names it several times."""
    staged = df.withColumn("__before", _chain(normalize_newlines(F.col(source)), _BEFORE_ENTITIES))
    staged = staged.withColumn("__plain", unescape(F.col("__before")))
    return staged.withColumn(target, collapse_text(_chain(F.col("__plain"), _AFTER_ENTITIES))).drop("__before", "__plain")


def with_script(df: DataFrame, source: str, target: str = "script", language: str = "zh") -> DataFrame:
    """``df`` with ``render_script`` of a column, in stages as in ``with_clean_text``."""
    staged = with_clean_text(df, source, "__clean")
    staged = staged.withColumn("__form", F.coalesce(_nfkc_unescape(F.when(F.col("__clean").rlike(r"[^\x00-\x7F]|&"), F.col("__clean"))), F.col("__clean")))
    return staged.withColumn(target, _spoken(F.col("__form"), language)).drop("__clean", "__form")


def render_script(x: Column, language: str = "zh") -> Column:
    """Text for narration: symbols that would be read aloud are removed or turned into pauses. The rules and their order are fixed values."""
    x = clean_source_text(x)
    x = F.coalesce(_nfkc_unescape(F.when(x.rlike(r"[^\x00-\x7F]|&"), x)), x)
    return _spoken(x, language)


def _spoken(x: Column, language: str) -> Column:
    return strip(_chain(x, (
        (r"\[\^?[^\]]+\]", ""), (rf"[{WS}]*--+[{WS}]*", "，" if language.startswith("zh") else ", "), (rf"[{WS}]*[-=]{{3,}}[{WS}]*", "\n\n"),
        (r"[/\\]", " "), (r"[_#>*`|{}\[\]()<]", " "), (rf"[{WS}]+([,.;:!?，。！？；：])", "$1"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
    )))


def script_audit(source: Column, script: Column, language: str = "zh") -> Column:
    source = text_or_empty(source)
    return F.struct(F.lit(language).alias("language"), (script != source).alias("changed"), F.length(source).alias("source_chars"), F.length(script).alias("script_chars"))


def slugify(value: Column, fallback: Column) -> Column:
    """Letters, digits and dots in small letters, parted by hyphens; the fallback where nothing is left."""
    kept = _chain(F.lower(strip(nfkc(text_or_empty(value)))), ((rf"[^\p{{L}}\p{{N}}_.\-{WS}]+", ""), (rf"[_{WS}-]+", "-"), (r"\A[.-]+|[.-]+\z", "")))
    return F.when(kept == "", text_or_empty(fallback)).otherwise(kept)


def document_slug(title: Column, order: Column, fallback: Column) -> Column:
    """``0003-hello-world``; without an order just the slug."""
    slug = slugify(title, fallback)
    return F.when(order.isNull(), slug).otherwise(F.format_string("%04d-%s", order, slug))


def safe_filename(value: Column, fallback: Column | str = "Untitled") -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    x = strip(nfkc(text_or_empty(value)))
    x = strip(F.regexp_replace(F.regexp_replace(x, r"""[/\\:*?"<>|]+""", " "), rf"[{WS}]+", " "))
    return F.when(x == "", fallback).otherwise(x)


def numbered_title(title: Column, order: Column) -> Column:
    name = safe_filename(title)
    return F.when(order.isNull(), name).otherwise(F.concat(order.cast("string"), F.lit(". "), name))


def leak_form(x: Column) -> Column:
    """Upper-case letters of ASCII, digits and common Chinese characters only."""
    return F.regexp_replace(F.upper(nfkc(text_or_empty(x))), r"[^0-9A-Z\x{4E00}-\x{9FFF}]+", "")


def phrase_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(x), r"[|\n]+", -1), strip), lambda s: s != "")


def translation_prompt(chunk: Column, title: Column, index: Column, total: Column, language: str) -> Column:
    """Instruction for a translator: the chunk with its place, and what to keep."""
    if language.lower().startswith("zh"):
        head = "请把下面的文字译成流畅自然的简体中文，保留段落、专名和数字，只输出译文。\n标题：%s\n部分：%d/%d\n\n%s"
        return F.format_string(head, title, index, total, chunk)
    head = f"Translate the text below into {language}. Keep paragraphs, names and figures; answer with the translation only.\nTitle: %s\nPart: %d of %d\n\n%s"
    return F.format_string(head, title, index, total, chunk)


def inferred_title(title: Column, path: Column) -> Column:
    """The stripped title, else the file's name without its ending, else ``Untitled``."""
    base = F.regexp_extract(text_or_empty(path), r"([^/]*?)/*\z", 1)
    stem = F.when(base.rlike(r"^\.+[^.]*$"), base).otherwise(F.regexp_replace(base, r"(?<=[^.])\.[^.]*\z", ""))
    return F.coalesce(F.nullif(strip(text_or_empty(title)), F.lit("")), F.nullif(stem, F.lit("")), F.lit("Untitled"))
