"""Problem 2: split oversized texts at natural boundaries, by lexical cohesion.

Every paragraph or sentence end of a text is a gap. The words of the sentences before and after a gap are compared (cosine of
their counts); where the likeness falls into a valley between two higher values, the topic changes. A piece ends, within its
window of allowed sizes, at the deepest valley among its paragraph ends, else among its sentence ends (of equally deep ones at
the one nearest to the aim), else at a word end, and only in a run without any of these between two characters (never inside a combined character). The next piece starts the
stated number of characters before that end.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The limits that hold where a project states none.
CHUNK_CHARS, CHUNK_LEAST, TARGET_CHARS, MAX_CHARS = 2800, 800, 80, 120

#: Sentences on either side of a gap whose words are compared.
BLOCK_SENTENCES = 3

_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)\s+|[。！？；…]+[”’」』）]*\s*|\n[ \t]*")
_GAP = re.compile(r"\s+")
_WORDS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Ends of paragraphs, sentences and words: positions at which a next piece may start."""
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text)]
    sentences = sorted({m.end() for m in _SENTENCE.finditer(text)} - set(paragraphs))
    words = sorted({m.end() for m in _GAP.finditer(text)})
    return paragraphs, sentences, words


def depths(text: str, gaps: list[int]) -> dict[int, float]:
    """Depth of the likeness valley at each gap (0 where there is none)."""
    edges = [0, *gaps, len(text)]
    bags = [Counter(_WORDS.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])]
    likeness = []
    for i in range(1, len(bags)):
        left, right = Counter(), Counter()
        for bag in bags[max(0, i - BLOCK_SENTENCES) : i]:
            left.update(bag)
        for bag in bags[i : i + BLOCK_SENTENCES]:
            right.update(bag)
        norm = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        likeness.append(sum(v * right[w] for w, v in left.items() if w in right) / norm if norm else 0.0)
    out = {}
    for i, gap in enumerate(gaps):
        top_left = top_right = likeness[i]
        for j in range(i - 1, -1, -1):
            if likeness[j] < top_left:
                break
            top_left = likeness[j]
        for j in range(i + 1, len(likeness)):
            if likeness[j] < top_right:
                break
            top_right = likeness[j]
        out[gap] = (top_left - likeness[i]) + (top_right - likeness[i])
    return out


def _whole(text: str, at: int, least: int) -> int:
    """The place at or before ``at`` (after ``least``) that does not part a combined character."""
    p = at
    while p > least and p < len(text) and (unicodedata.combining(text[p]) or text[p] in "‍︎️⃣" or text[p - 1] == "‍" or "\U0001f3fb" <= text[p] <= "\U0001f3ff" or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p if p > least else at


def pieces(text: str, limit: int, overlap: int = 0, aim: int | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of ordered pieces, each of at most ``limit`` characters, which cover the text.

    Consecutive pieces share ``overlap`` characters (at most ``limit - 1``, so that each piece brings something new). With
    ``aim`` the window is first a quarter of it to either side, so that the pieces come near that size, otherwise they are as long as the deepest valley in the upper half of the window
    lets them be. A text within the limit, and an empty one, is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    aim = min(limit, aim) if aim else None
    paragraphs, sentences, words = boundaries(text)
    deep = depths(text, sorted({*paragraphs, *sentences}))
    out, cut = [], 0
    while True:
        start = max(0, cut - overlap)
        top = min(n, start + limit)
        if top == n:
            out.append((start, n))
            return out
        new = top - cut
        low = cut + max(1, new // 2)
        goal = min(top, max(low, start + aim)) if aim else top
        around = [(max(low, goal - aim // 4), min(top, goal + aim // 4))] if aim else []
        end = 0
        for least, most in (*around, (low, top), (cut + 1, top)):
            for ends in (paragraphs, sentences):
                inside = ends[bisect_left(ends, least) : bisect_right(ends, most)]
                if inside:
                    end = max(inside, key=lambda p: (deep[p], -abs(p - goal), p))
                    break
            if not end and (least, most) not in around:
                inside = words[bisect_left(words, least) : bisect_right(words, top)]
                if inside:
                    end = min(inside, key=lambda p: (abs(p - goal), -p))
            if end:
                break
        if not end:
            end = _whole(text, goal, cut)
        out.append((start, end))
        cut = end


def _positive(col: str, default: int) -> Column:
    return F.when(F.col(col) > 0, F.col(col)).otherwise(F.lit(default))


def limits(config: DataFrame) -> DataFrame:
    """``project_id, chunk_limit, segment_limit, aim, overlap`` that hold for each project (the first row of a project counts)."""
    top = _positive("max_chars", MAX_CHARS)
    return config.filter(F.col("project_id").isNotNull()).select(
        "project_id", F.greatest(_positive("chunk_chars", CHUNK_CHARS), F.lit(CHUNK_LEAST)).alias("chunk_limit"), top.alias("segment_limit"),
        F.least(_positive("target_chars", TARGET_CHARS), top).alias("aim"), F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)).alias("overlap"),
    ).dropDuplicates(["project_id"])


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for kind, key, text, limit, overlap, aim in zip(*(frame[c] for c in ("item_kind", "item_id", "text", "limit", "overlap", "aim"))):
            found = pieces(text, int(limit), int(overlap), int(aim) if aim == aim and aim is not None else None)
            rows += [(kind, key, i, len(found), a, b, text[a:b]) for i, (a, b) in enumerate(found, 1)]
        yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "piece_count", "start", "end", "piece"])


def items(clean_document: DataFrame, segment: DataFrame, config: DataFrame) -> DataFrame:
    """``item_kind, item_id, text, limit, overlap, aim`` of all texts with the limits of their project (or the defaults)."""
    rules = limits(config)
    rule = lambda name, default: F.coalesce(F.col(name), F.lit(default)).cast("int")
    chunks = clean_document.select("clean_id", "project_id", "clean_text").join(rules, "project_id", "left").select(
        F.lit("chunk").alias("item_kind"), F.col("clean_id").alias("item_id"), F.col("clean_text").alias("text"),
        rule("chunk_limit", CHUNK_CHARS).alias("limit"), rule("overlap", 0).alias("overlap"), F.lit(None).cast("int").alias("aim"))
    parts = segment.select("segment_id", "project_id", "text").join(rules, "project_id", "left").select(
        F.lit("segment").alias("item_kind"), F.col("segment_id").alias("item_id"), "text",
        rule("segment_limit", MAX_CHARS).alias("limit"), rule("overlap", 0).alias("overlap"), rule("aim", TARGET_CHARS).alias("aim"))
    return chunks.unionByName(parts)


def split_items(these: DataFrame) -> DataFrame:
    """``item_kind, item_id, piece_no, piece_count, start, end, piece`` of the items; ``start`` and ``end`` count characters from 0.

    Texts within their limit are one piece and never leave the JVM. Null texts give no row, an empty text gives one empty
    piece, repeated rows are cut each for itself, an empty table gives no rows, and other columns are not read.
    """
    kind = these.schema["item_id"].dataType.simpleString()
    size = F.length("text")
    short = these.filter(size <= F.col("limit")).select(
        "item_kind", "item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("piece_count"), F.lit(0).alias("start"), size.alias("end"), F.col("text").alias("piece"))
    long = these.filter(size > F.col("limit")).select("item_kind", "item_id", "text", "limit", "overlap", "aim")
    cut = long.repartition("item_id").mapInPandas(_cut, f"item_kind string, item_id {kind}, piece_no int, piece_count int, start int, end int, piece string")
    return short.unionByName(cut)
