"""Column helpers shared by the operators on source documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.stage import written


def site_of(url: Column) -> Column:
    """Host of a URL in lower case without user, port and a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def is_html(media_type: Column) -> Column:
    return F.coalesce(F.lower(media_type).contains("html"), F.lit(False))


def letters_only(line: Column) -> Column:
    """The form under which two lines are the same: lower case, letters only."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


#: A key with more rows than this is hot: a join deals its rows to so many parts, each the work of a task.
HOT_ROWS, HOT_PARTS = 10_000, 32


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row per key, where ``hot`` holds the hot keys (a row per ``HOT_ROWS`` rows of
    ``left`` at most, so it is small). Rows of ``left`` with a hot key are dealt by the column ``by``, and the key's row in
    ``right`` is repeated for each part; other keys are joined as they are.
    """
    if not hot.count():
        return left.join(right, keys, how)
    mark = written(hot.select(*keys, F.lit(True).alias("__hot")))
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(mark, keys, "left").withColumn("__part", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(HOT_PARTS)).cast("int")).otherwise(0)).drop("__hot")
    repeated = right.join(mark, keys, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return dealt.join(repeated, [*keys, "__part"], how).drop("__part")
