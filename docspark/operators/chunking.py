"""Translation chunks: greedy packing of paragraphs as a native fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.pytext import hard_split, strip, text_or_empty

LEAST_CHARS = 800


def chunk_array(text: Column, target: int = 2800) -> Column:
    """Chunks of at most ``max(800, target)`` characters; paragraphs (parted by a blank line) are packed, larger ones cut hard."""
    size = max(LEAST_CHARS, int(target))
    paragraphs = F.filter(F.transform(F.split(text_or_empty(text), "\n\n", -1), strip), lambda p: p != "")

    def step(state: Column, p: Column) -> Column:
        out, cur = state["out"], state["cur"]
        closed = F.when(cur != "", F.array_append(out, strip(cur))).otherwise(out)
        joined = F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        return F.when(F.length(p) > size, F.struct(F.concat(closed, hard_split(p, size)).alias("out"), F.lit("").alias("cur"))).when(
            (cur != "") & (F.length(joined) > size), F.struct(closed.alias("out"), p.alias("cur"))
        ).otherwise(F.struct(out.alias("out"), joined.alias("cur")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(paragraphs, start, step, lambda s: F.when(strip(s["cur"]) != "", F.array_append(s["out"], strip(s["cur"]))).otherwise(s["out"]))


def explode_chunks(df: DataFrame, text_col: str, target: int = 2800) -> DataFrame:
    """``df`` with a row per chunk: ``chunk_index`` from 1, ``chunk_total``, ``chunk_text``; texts without chunks give no row."""
    chunks = df.withColumn("__chunks", chunk_array(F.col(text_col), target))
    return chunks.select(*[c for c in df.columns if c != text_col], F.size("__chunks").alias("chunk_total"), F.posexplode("__chunks").alias("__at", "chunk_text")).withColumn(
        "chunk_index", F.col("__at") + 1).drop("__at")


def join_chunks(df: DataFrame, keys: list[str], text_col: str = "translated_text", index_col: str = "chunk_index") -> DataFrame:
    """The non-empty chunks of a document, in order, parted by a blank line."""
    kept = F.collect_list(F.when(text_or_empty(F.col(text_col)) != "", F.struct(index_col, text_col)))
    return df.groupBy(*keys).agg(strip(F.array_join(F.transform(F.array_sort(kept), lambda x: x[text_col]), "\n\n")).alias("translated_text"))
