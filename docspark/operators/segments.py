"""Narration segments with pause metadata: sentence split, soft split and packing as native folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.pytext import WS, bound, hard_split, strip, text_or_empty

# Pauses in milliseconds by the reason for a segment's end; marks that end a sentence; marks of a soft split.
PAUSES = {"heading": 900, "paragraph": 800, "sentence": 450, "soft": 180}
ENDS = "。！？.!?；;"
SOFT = ",，、:："
HEADING_CHARS = 48
TARGET_CHARS, MAX_CHARS = 80, 120


def paragraphs(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(text_or_empty(text), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    parts = F.transform(F.split(strip(x), rf"\n[{WS}]*\n", -1), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Runs up to one end mark, stripped; further marks after it are lost. Without any run the paragraph itself."""
    runs = F.regexp_extract_all(paragraph, F.lit(f"[^{ENDS}]+[{ENDS}]?"), F.lit(0))
    runs = F.filter(F.transform(runs, strip), lambda s: s != "")
    return bound(runs, lambda r: F.when(F.size(r) == 0, F.array(paragraph)).otherwise(r))


def heading_like(paragraph: Column) -> Column:
    return (F.length(paragraph) <= HEADING_CHARS) & ~paragraph.rlike(f"[{ENDS}](?:\n)?\\z")


def soft_split(piece: Column, most: Column | int) -> Column:
    """``array<struct<text, reason>>``: a piece within ``most`` as it is, else buffers of whole tokens, cut hard where needed."""
    most = F.lit(most) if isinstance(most, int) else most
    tokens = F.filter(F.split(piece, f"(?<=[{SOFT}])|(?=[{SOFT}])", -1), lambda t: t != "")

    def step(s: Column, t: Column) -> Column:
        return F.when((s["buf"] != "") & (F.length(s["buf"]) + F.length(t) > most), F.struct(F.array_append(s["out"], s["buf"]).alias("out"), strip(t).alias("buf"))).otherwise(
            F.struct(s["out"].alias("out"), strip(F.concat(s["buf"], t)).alias("buf")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))
    buffers = F.aggregate(tokens, start, step, lambda s: F.when(s["buf"] != "", F.array_append(s["out"], s["buf"])).otherwise(s["out"]))
    cut = F.flatten(F.transform(buffers, lambda b: hard_split(b, most)))
    return F.when(F.length(piece) <= most, F.array(F.struct(piece.alias("text"), F.lit("sentence").alias("reason")))).otherwise(
        F.transform(cut, lambda c: F.struct(c.alias("text"), F.lit("soft").alias("reason"))))


def _pack(paragraph: Column, target: Column, most: Column) -> Column:
    heading = heading_like(paragraph)
    pieces = F.when(heading, F.array(paragraph)).otherwise(sentences(paragraph))
    parts = F.flatten(F.transform(pieces, lambda p: soft_split(p, most)))

    def step(s: Column, part: Column) -> Column:
        text, why = part["text"], part["reason"]
        joined = F.when(s["cur"] == "", strip(text)).when(text == "", strip(s["cur"])).otherwise(strip(F.concat(strip(s["cur"]), F.lit(" "), strip(text))))
        full = F.array_append(s["out"], F.struct(s["cur"].alias("text"), s["why"].alias("reason")))
        return bound(joined, lambda j: F.when((s["cur"] != "") & (F.length(j) > target), F.struct(full.alias("out"), text.alias("cur"), why.alias("why"))).otherwise(
            F.struct(s["out"].alias("out"), j.alias("cur"), why.alias("why"))))

    start = F.struct(F.array().cast("array<struct<text:string,reason:string>>").alias("out"), F.lit("").alias("cur"), F.lit("sentence").alias("why"))
    last = F.when(heading, F.lit("heading")).otherwise(F.lit("paragraph"))

    def finish(s: Column) -> Column:
        n = F.size(s["out"])
        relabelled = F.when(n > 0, F.array_append(F.slice(s["out"], 1, n - 1), F.struct(F.element_at(s["out"], -1)["text"].alias("text"), last.alias("reason")))).otherwise(s["out"])
        return F.when(s["cur"] != "", F.array_append(s["out"], F.struct(s["cur"].alias("text"), last.alias("reason")))).otherwise(relabelled)

    return F.aggregate(parts, start, step, finish)


def segment_array(text: Column, target: Column | int = TARGET_CHARS, most: Column | int = MAX_CHARS) -> Column:
    """``array<struct<text, reason>>`` of a script; sizes that are not positive raise an error."""
    most = F.lit(most) if isinstance(most, int) else most
    target = F.lit(target) if isinstance(target, int) else target
    wrong = (most <= 0) | (target <= 0)
    most = F.when(wrong, F.raise_error(F.lit("target and maximum size must be positive")).cast("int")).otherwise(most)
    return F.flatten(F.transform(paragraphs(text), lambda p: _pack(p, F.least(target, most), most)))


def pause_of(reason: Column, pauses: dict[str, int] | None = None) -> Column:
    """Pause of a reason, with overrides; an unknown reason has the sentence's pause."""
    merged = {**PAUSES, **(pauses or {})}
    table = F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])
    return F.coalesce(F.try_element_at(table, reason), F.lit(merged["sentence"]))


def explode_segments(df: DataFrame, key: str, text_col: str, target: Column | int = TARGET_CHARS, most: Column | int = MAX_CHARS, pauses: dict[str, int] | None = None) -> DataFrame:
    """One row per segment of each script, numbered from 1, in the form of the segment manifest."""
    rows = df.select(key, F.posexplode(segment_array(F.col(text_col), target, most)).alias("at", "s"))
    index = F.col("at") + 1
    return rows.select(
        key, index.alias("segment_index"), F.col("s.text").alias("text"), F.length("s.text").alias("chars"), F.col("s.reason").alias("pause_reason"),
        pause_of(F.col("s.reason"), pauses).alias("pause_after_ms"), F.lit("pending").alias("status"),
        F.format_string("segment_%04d.wav", index).alias("audio_path"), F.lit(0).alias("retry_count"), F.lit("").alias("error"))
