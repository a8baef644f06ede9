"""Native column helpers that follow CPython's text rules (white space, line ends, slices) inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() and re's \s take as white space, for a Java character class.
WS = r"\t-\r\x1C-\x20\x85\xA0  -     　"
EOL = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"


#: The same characters one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(x: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(x, F.lit(WS_CHARS))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def split_lines(x: Column) -> Column:
    """``str.splitlines()``: no empty last line after a line end."""
    parts = F.split(x, EOL, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)).otherwise(parts)


def collapse_inline(x: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(x), rf"[{WS}]+", " "))


def collapse_text(x: Column) -> Column:
    """Lines stripped and joined by a space within a paragraph; blank lines part paragraphs, which are joined by one blank line."""
    # an empty last line would be dropped by the trimming below, so the lines need not be bound for it
    lines = F.transform(F.split(text_or_empty(x), EOL, -1), lambda s: strip(F.regexp_replace(s, r"[ \t]+", " ")))
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"\A\n+|\n+\z", "")
    return F.regexp_replace(F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " "), r"\n{2,}", "\n\n")


def hard_split(x: Column, width: Column | int) -> Column:
    """Pieces of a fixed width, stripped, blanks dropped; a text within the width is one stripped piece, even if empty."""
    width = F.lit(width) if isinstance(width, int) else width
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), width), lambda i: strip(F.substr(x, i + 1, width)))
    return F.when(F.length(x) <= width, F.array(strip(x))).otherwise(F.filter(cut, lambda s: s != ""))


def optional_int(x: Column) -> Column:
    """Null and empty become null, anything else must be a whole number."""
    return F.nullif(x.cast("string"), F.lit("")).cast("int")


def int_or(x: Column, default: int) -> Column:
    return F.coalesce(x.cast("string").try_cast("int"), F.lit(default))


def stable_id(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the non-empty parts, a line each."""
    kept = F.filter(F.array(*[text_or_empty(p.cast("string")) for p in parts]), lambda s: s != "")
    return F.substring(F.sha1(F.array_join(kept, "\n").cast("binary")), 1, 12)
