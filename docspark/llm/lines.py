"""Problem 3: lines repeated across the documents of one site, found by suffix arrays over line identifiers.

A site's records are dealt to chunks of bounded size (a hot site has many). Each chunk concatenates the line identifiers of its
records, builds the suffix array and the array of common prefixes, and turns every interval of suffixes with a common prefix
into a block with the number of records it spans; the intervals with a prefix of one or more are the single lines. Those counts
are added over the chunks of a site, the blocks that span enough records are kept, and their lines deleted. As every line of a
block spans at least the records of the block, deleting the blocks of one line deletes those of several too, and blocks of
several lines are made of kept lines only. So for the latter records are cut down to their kept lines, those of a site that are
equal then are one row with a count, and the suffix array over these rows, in one piece for a site of any size, gives each
longer block with its exact number of records.

Lines are cut and hashed once, into a table; the sizes of the sites join it with the records of a hot site dealt to parts, and
the kept lines join it by (site, chunk), so no site is the work of one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import HOT_ROWS, is_html, join_hot, letters_only, site_of
from docspark.llm.stage import written

MIN_RECORDS = 5
MIN_SHARE = 0.1
#: Records of one site that a chunk holds, about.
CHUNK_RECORDS = 1_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the common prefix of each suffix with the one before it.

    The ranks by the first 1, 2, 4 ... identifiers are kept: the common prefix is read off them from the longest to the shortest.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order, ranks, k = np.argsort(rank, kind="stable"), [rank], 1
    while n > 1 and k < n and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-k] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        ranks.append(rank)
        k *= 2
    common = np.zeros(n, np.int64)
    here, before = order[1:].copy(), order[:-1].copy()
    for level in range(len(ranks) - 1, -1, -1):
        row = np.append(ranks[level], [-1, -2])  # past the end nothing is alike
        same = row[np.minimum(here, n)] == row[np.where(before < n, before, n + 1)]
        step = same.astype(np.int64) << level
        common[1:] += step
        here, before = here + step, before + step
    return order, common


def _intervals(common: np.ndarray) -> list[tuple[int, int, int]]:
    """``(length, first, last)`` of every maximal run of suffixes that share ``length`` identifiers (at least 2 suffixes)."""
    out, stack = [], [(0, 0)]
    for i, h in enumerate([*common[1:].tolist(), 0], start=1):
        start = i - 1
        while stack[-1][0] > h:
            length, start = stack.pop()
            out.append((length, start, i - 1))
        if stack[-1][0] < h:
            stack.append((h, start))
    return out


def _joined(records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records one after the other, a separator of its own after each: line keys, identifiers, record and place of each, separators."""
    sizes = np.array([len(r) + 1 for r in records])
    ends = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(len(records)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(ends + 1 - sizes, sizes)
    flat = np.zeros(len(owner), np.int64)
    real = np.ones(len(owner), bool)
    real[ends] = False
    flat[real] = np.concatenate(records)
    ids = np.empty(len(owner), np.int64)
    ids[real] = np.unique(flat[real], return_inverse=True)[1] + len(records)
    ids[ends] = np.arange(len(records))
    return flat, ids, owner, place, real


def single_blocks(records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(line, records, record, start)`` of the blocks of one line: the intervals of the suffix array with a common prefix."""
    if not sum(map(len, records)):
        return (np.zeros(0, np.int64),) * 4
    flat, ids, owner, place, real = _joined(records)
    order, common = suffix_array(ids)
    interval = np.cumsum(common == 0) - 1
    kept = real[order]
    at = order[kept]
    pairs, first = np.unique(np.stack([interval[kept], owner[at]]), axis=1, return_index=True)
    starts = np.flatnonzero(np.concatenate(([True], pairs[0][1:] != pairs[0][:-1])))
    one = at[first[starts]]
    return flat[one], np.diff(np.append(starts, len(pairs[0]))), owner[one], place[one]


def repeated_blocks(records: list[np.ndarray], of: np.ndarray | None = None, counts: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
    """``(hash, lines, records, record, start)`` of the blocks of two and more lines that stand in two records.

    With ``of`` and ``counts`` the records are pieces: piece i belongs to row ``of[i]``, which stands for ``counts[of[i]]`` records.
    """
    if not sum(map(len, records)):
        return []
    flat, ids, owner, place, _ = _joined(records)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(flat) + 1, _MIX | np.uint64(1), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * powers[: len(flat)], dtype=np.uint64)))
    out = []
    order, common = suffix_array(ids)
    owners = owner[order]
    inverse = _inverse(int(_MIX | np.uint64(1)))
    for length, a, b in _intervals(common):
        if length < 2:
            continue
        held = owners[a : b + 1] if of is None else of[owners[a : b + 1]]
        span = len(np.unique(held)) if counts is None else int(counts[np.unique(held)].sum())
        if span < 2:
            continue
        p = int(order[a])
        raw = (int(sums[p + length]) - int(sums[p])) & (2**64 - 1)
        h = raw * pow(inverse, p, 2**64) & (2**64 - 1)  # the same block has the same hash wherever it stands
        out.append((h - 2**64 if h >= 2**63 else h, length, span, int(owner[p]), int(place[p])))
    return out


def _inverse(x: int) -> int:
    return pow(x, -1, 2**64)


BLOCKS = "site string, block long, lines int, records long, id {id}, start int"


def _chunk_blocks(id_type: pa.DataType, min_records: int, min_share: float):
    names = ["site", "block", "lines", "records", "id", "start"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys = table.column("keys").combine_chunks()
        flat, cuts = keys.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *keys.value_lengths().to_pylist()])
        line, n, record, start = single_blocks([flat[a:b] for a, b in zip(cuts, cuts[1:])])
        if table.column("of")[0].as_py() == 1:  # the whole site: nothing is added to these counts
            good = (n >= min_records) & (n >= min_share * table.num_rows)
            line, n, record, start = line[good], n[good], record[good], start[good]
        return pa.Table.from_arrays(
            [
                pa.array([key[0].as_py()] * len(line), pa.string()), pa.array(line, pa.int64()), pa.array(np.ones(len(line), np.int32)), pa.array(n, pa.int64()),
                table.column("id").take(pa.array(record)).combine_chunks(), pa.array(start, pa.int32()),
            ],
            names=names,
        )

    return run


def _site_blocks(id_type: pa.DataType):
    """The blocks of several lines of one site, from its distinct rows of kept lines (null for a gap) with their counts."""
    names = ["site", "block", "lines", "records", "id", "start"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts, at = table.column("n").to_numpy(), table.column("at").to_pylist()
        pieces, of, first = [], [], []
        for i, marks in enumerate(table.column("marks").to_pylist()):
            seen, piece = 0, []
            for k in [*marks, None]:
                if k is not None:
                    piece.append(k)
                    continue
                if len(piece) > 1:  # twice, so that a row that stands for many records repeats also where it is the only one
                    pieces += [np.array(piece, dtype=np.int64)] * 2
                    of += [i, i]
                    first += [seen, seen]
                seen += len(piece)
                piece = []
        found = repeated_blocks(pieces, np.array(of), counts)
        cols = list(zip(*found)) if found else [[], [], [], [], []]
        return pa.Table.from_arrays(
            [
                pa.array([key[0].as_py()] * len(found), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                pa.array([at[of[i]]["id"] for i in cols[3]], id_type), pa.array([at[of[i]]["pos"][first[i] + j] for i, j in zip(cols[3], cols[4])], pa.int32()),
            ],
            names=names,
        )

    return run


def site_records(df: DataFrame, text: bool = False) -> DataFrame:
    """``seq, site, of, chunk, site_records, keys``: the plain records as a written table, with ``keys`` a hash for each line, null
    for a line without letters; ``of`` is the number of chunks of the site. With ``text`` also ``raw_text``, and the records
    without a site, whose keys and chunk are null.

    Left out: records with null or empty text, or in HTML, and without ``text`` those without a site.
    """
    site = site_of(F.col("source_url"))
    plain = df.filter((F.col("raw_text") != "") & ~is_html(F.col("media_type"))).select("seq", site.alias("site"), "raw_text")
    if not text:
        plain = plain.filter("site is not null")
    sizes = written(plain.filter("site is not null").groupBy("site").agg(F.count(F.lit(1)).alias("site_records")))
    letters = F.transform(F.split("raw_text", "\n", -1), letters_only)
    keys = F.when(F.col("site").isNotNull(), F.transform(letters, lambda x: F.when(x != "", F.xxhash64(x))))
    sized = join_hot(plain, sizes, ["site"], sizes.filter(F.col("site_records") > HOT_ROWS), "seq", "left")
    of = F.ceil(F.col("site_records") / CHUNK_RECORDS)
    return written(sized.select(
        "seq", "site", of.alias("of"), F.pmod(F.xxhash64("seq"), of).alias("chunk"), "site_records", keys.alias("keys"), *(["raw_text"] if text else [])))


def repeated(df: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``site, block, lines, records, site_records, id, start``: blocks that span enough records of their site.

    ``id`` and ``start`` name one place where the block stands (start counts the lines with letters from 0). All counts are
    exact. A longer block is given where its occurrences in the site do not all go on with the same kept line.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema["seq"].dataType
    recs = site_records(df)
    single = written(single_lines(recs, min_records, min_share))
    keyed = recs.select("seq", "site", "chunk", F.expr("filter(keys, k -> k is not null)").alias("keys"))
    marked = keyed.join(_kept(single), ["site", "chunk"]).select("site", "seq", F.expr("transform(keys, k -> if(array_contains(blocks, k), k, null))").alias("all"))
    cut = marked.select(
        "site", F.expr("filter(all, (x, i) -> x is not null or (i > 0 and get(all, i - 1) is not null))").alias("marks"),
        F.struct(F.col("seq").alias("id"), F.expr("filter(transform(all, (x, i) -> if(x is null, null, i)), i -> i is not null)").alias("pos")).alias("at"))
    alike = cut.filter("size(at.pos) > 1").groupBy("site", "marks").agg(F.count(F.lit(1)).alias("n"), F.min_by("at", "at.id").alias("at"))
    blocks = alike.groupBy("site").applyInArrow(_site_blocks(to_arrow_type(kind)), BLOCKS.format(id=kind.simpleString()))
    several = blocks.groupBy("site", "block", "lines").agg(F.max("records").alias("records"), F.min_by(F.struct("id", "start"), "id").alias("at"))
    sizes = single.select("site", "site_records").distinct()
    long = several.filter(F.col("records") >= min_records).join(sizes, "site").filter(
        F.col("records") >= min_share * F.col("site_records")).select("site", "block", "lines", "records", "site_records", "at.id", "at.start")
    return single.drop("of").unionByName(long)


def single_lines(recs: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``repeated`` with one line and the site's number of chunks ``of``, from ``site_records``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = recs.schema["seq"].dataType
    rows = recs.filter("site is not null").select("site", "chunk", F.col("seq").alias("id"), "of", F.expr("filter(keys, k -> k is not null)").alias("keys"))
    blocks = rows.groupBy("site", "chunk").applyInArrow(_chunk_blocks(to_arrow_type(kind), min_records, min_share), BLOCKS.format(id=kind.simpleString()))
    summed = blocks.groupBy("site", "block", "lines").agg(F.sum("records").alias("records"), F.min_by(F.struct("id", "start"), "id").alias("at"))
    sizes = recs.filter("site is not null").select("site", "site_records", "of").distinct()
    return summed.filter(F.col("records") >= min_records).join(sizes, "site").filter(
        F.col("records") >= min_share * F.col("site_records")
    ).select("site", "block", "lines", "records", "site_records", "of", "at.id", "at.start")


def _kept(single: DataFrame) -> DataFrame:
    """``site, chunk, blocks``: the kept lines of each site, once for each of its chunks.

    A kept line stands in a tenth of its site's records, so a site has at most ten times as many as a record has lines.
    """
    return single.groupBy("site", "of").agg(F.collect_set("block").alias("blocks")).select("site", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("chunk"))


def repeated_lines(df: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``seq, line_no`` of the lines to remove.

    ``df`` has ``seq, raw_text, source_url, media_type``; further columns are not read, null and empty texts and records
    without a host give no rows, a repeated row counts as a record of its own, an empty table gives no rows.
    """
    recs = site_records(df)
    found = written(single_lines(recs, min_records, min_share))
    numbered = F.transform("keys", lambda k, i: F.when(F.array_contains("blocks", k), (i + 1).cast("long")))
    rows = recs.join(_kept(found), ["site", "chunk"]).select("seq", F.explode(F.filter(numbered, lambda n: n.isNotNull())).alias("line_no"))
    return rows.select("seq", "line_no")


def cleaned_records(df: DataFrame, min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """``seq, clean_text``: the plain records with text, without the lines to remove. Records without a host stay as they are."""
    recs = site_records(df, text=True)
    found = written(single_lines(recs, min_records, min_share))
    kept = F.expr("array_join(filter(split(raw_text, '\\n', -1), (x, i) -> keys[i] is null or not array_contains(blocks, keys[i])), '\n')")
    return recs.join(_kept(found), ["site", "chunk"], "left").select("seq", F.when(F.col("blocks").isNull(), F.col("raw_text")).otherwise(kept).alias("clean_text"))


def without_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """``df`` with ``clean_text``: raw_text without the given ``(seq, line_no)``; null texts stay null."""
    gone = lines.groupBy("seq").agg(F.collect_set("line_no").alias("__gone"))
    kept = F.expr("array_join(filter(split(raw_text, '\\n', -1), (x, i) -> __gone is null or not array_contains(__gone, cast(i + 1 as bigint))), '\\n')")
    return df.join(gone, "seq", "left").withColumn("clean_text", kept).drop("__gone")
