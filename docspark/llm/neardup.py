"""Problem 1: near-duplicate records by DartMinHash signatures and banded joining.

A record's body is its set of word shingles. A dart is thrown into every unit of the (weight x rank) region of an element, from
a hash of the element alone, so two records throw the same darts into what they share; each dart falls on one coordinate of the
signature, and the earliest of a coordinate is kept. Two signatures agree on a coordinate with the probability of the
(weighted) Jaccard similarity. Four coordinates make a band; records that agree on two bands of 128 are candidates and are
compared exactly.

Skew: exact copies are collapsed before anything is joined, so a hot group of copies is one row; where its records are put back,
they are dealt to parts of about ``COPIES`` records, and a task pairs two parts. The band keys (16 bytes with the record) are
shuffled in lists, a list for each part of their range. A task holds the keys of a part; the members of its large buckets stream
through. A bucket of more than ``BUCKET`` different bodies is not joined with itself; its members are dealt to blocks, and each
pair of blocks is one small group that is compared exactly in place and gives out only the pairs that reach the threshold.
Nothing is capped.

Chance to miss a pair of similarity s: with ``p = (0.98 s)^4``, ``(1 - p)^128 (1 + 128 p / (1 - p))``: 0.4 % at 0.5, 0.02 % at 0.56.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import lines, mainbody
from docspark.llm.common import HOT_PARTS, HOT_ROWS, join_hot
from docspark.llm.stage import slices, written

SLOTS, ROWS = 512, 4
BANDS_AGREE = 2
BUCKET, BLOCK = 64, 128
#: Records of a group of copies that a part holds, about.
COPIES = 1_000

_HAN = "㐀-䶿一-鿿豈-﫿𠀀-𲎯々〇"
_WORD = re.compile(f"[{_HAN}]|[^\\W_{_HAN}]+")
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum()}
#: Signs of a text, apart from letters and digits, that are replaced one by one; with more of them it is read by the expression.
_SIGNS = 48

#: Band keys are shuffled as lists, a list for each part of the keys' range; a task deals out so many keys at once.
PARTS, DEALT = 1 << 13, 1 << 19
#: Band keys that are sorted together, at least; of more, the keys of large buckets are given out and no longer held.
SORTED, HELD = 1 << 16, 1 << 22

#: Darts thrown for each coordinate, on average.
DARTS = 4
#: Records that are signed at once, and the bits of a cell beside the record's number.
AT_ONCE, CELL_BITS = 64, 58


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_hashes: dict[str, int] = {}


def words_of(body: str) -> list[str]:
    """Words in lower case: runs of letters and digits, a Chinese character being one."""
    low = body.lower()
    if low.isascii():
        return low.translate(_PLAIN).split()
    chars = set(low)
    signs = [c for c in chars if not c.isalnum()]
    if max(chars) >= "々" or len(signs) > _SIGNS:  # the first of _HAN
        return _WORD.findall(low)
    for c in signs:
        low = low.replace(c, " ")
    return low.split()


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_hashes) > 1_000_000:
        _hashes.clear()
    fresh = set(words).difference(_hashes)
    if fresh:
        import xxhash

        _hashes.update((w, xxhash.xxh64_intdigest(w)) for w in fresh)
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_runs(lists: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``size`` words of several texts, one after the other, and the number of runs of each."""
    each = word_hashes([w for words in lists for w in words])
    counts = np.array([len(x) for x in lists])
    runs = np.maximum(counts - size + 1, 0)
    if not runs.sum():
        return np.zeros(0, np.uint64), runs
    n = len(each) - size + 1
    with np.errstate(over="ignore"):
        run = each[:n].copy()
        for i in range(1, size):
            run = _mix(run * np.uint64(0x9E3779B97F4A7C15) + each[i : n + i])
    starts = np.cumsum(counts) - counts
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts, runs)
    return run[at], runs


def shingles(words: list[str], size: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` words of one text."""
    return np.unique(shingle_runs([words], size)[0])


def shingle_sets(lists: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``shingle_runs`` of each text, cut to ``CELL_BITS`` bits, one text after the other, and their number for each."""
    cells, runs = shingle_runs(lists, size)
    if not len(cells):
        return cells, runs
    marked = (cells >> np.uint64(64 - CELL_BITS)) | (np.repeat(np.arange(len(runs), dtype=np.uint64), runs) << np.uint64(CELL_BITS))
    marked.sort()
    marked = marked[np.concatenate(([True], marked[1:] != marked[:-1]))]
    return marked & np.uint64(2**CELL_BITS - 1), np.bincount((marked >> np.uint64(CELL_BITS)).astype(np.int64), minlength=len(runs))


def signatures(cells: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None, slots: int = SLOTS) -> np.ndarray:
    """DartMinHash of several (weighted) sets, given one after the other with their sizes: for each coordinate the earliest
    dart that falls into the set's region. The elements of a set are distinct: a repeated one would lower the set's depth.

    The region of an element is cut into units of weight and rank, each with one dart at a place that its hash gives; of a unit
    that the weight covers in part the dart counts if it lies in that part. The depth in ranks follows from the set's weight, so
    that ``DARTS`` darts fall on each coordinate on average. A coordinate that no dart hits (about 2 %) gets a value of its own,
    so it agrees with no other set.
    """
    none = np.uint64(2**64 - 1)
    out = np.full((len(sizes), slots), none, np.uint64)
    ends = np.cumsum(sizes)
    for i, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
        own, share, area = cells[end - n : end], None, float(n)
        if weights is not None and n:
            times = np.ceil(weights[end - n : end]).astype(np.int64)
            which = np.repeat(np.arange(n), times)
            column = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            with np.errstate(over="ignore"):
                own = own[which] + column.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            share = np.minimum(weights[end - n : end][which] - column, 1.0)
            area = share.sum()
        if not len(own):
            continue
        # a row of darts for each level, all of a set at once
        level = np.arange(int(np.ceil(slots * DARTS / max(area, 1e-9))), dtype=np.uint64)[:, None]
        with np.errstate(over="ignore"):
            dart = _mix(own[None, :] + level * np.uint64(0xA24BAED4963EE407))
        rank, where = (level << np.uint64(44)) | (dart >> np.uint64(20)), dart & np.uint64(0xFFFFF)
        where = (where & np.uint64(slots - 1) if slots & (slots - 1) == 0 else where % np.uint64(slots)).astype(np.int64)
        if share is not None:
            inside = (_mix(~dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share[None, :]
            rank, where = rank[inside], where[inside]
        np.minimum.at(out[i], where.reshape(-1), rank.reshape(-1))
    out = out.reshape(-1)
    empty = np.flatnonzero(out == none)
    if len(empty):
        own = np.array([int(cells[e - n : e].sum()) if n else i for i, (e, n) in enumerate(zip(ends, sizes))], dtype=np.uint64)
        out[empty] = _mix(own[empty // slots] + empty.astype(np.uint64)) | np.uint64(1 << 63)
    return out.reshape(len(sizes), slots)


def band_keys(sigs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per signature and band."""
    parts = sigs.reshape(len(sigs), -1, rows)
    key = _mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64))[None, :]
    for i in range(rows):
        key = _mix(key ^ _mix(parts[:, :, i] + np.uint64(i)))
    return key.view(np.int64)


def _hashed(id_type: pa.DataType, size: int, least: int):
    """Ids, two hashes of the words, and the words parted by spaces, of the records that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            keys, low, high, kept = [], [], [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body) if body else []
                if len(words) >= max(least, size):
                    kept.append(" ".join(words))
                    whole = xxhash.xxh3_128_intdigest(kept[-1])
                    keys.append(key)
                    high.append((whole >> 64) - 2**63)
                    low.append((whole & (2**64 - 1)) - 2**63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, id_type), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "h1", "h2", "body"])

    return run


def _grams(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x.split(" "), size).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "grams"])

    return run


def _banded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                keys = band_keys(signatures(*shingle_sets([x.split(" ") for x in part.column(1).to_pylist()], size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), part.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1])))], names=["key", "rep"])

    return run


def _dealt(size: int):
    """The rows of ``_banded`` as lists: the keys of a part of their range, and the records they belong to."""

    def lists(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        keys = table.column("key").to_numpy()
        part = _part(keys)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        cuts, reps = pa.array(np.append(starts, len(part)), pa.int32()), table.column("rep").combine_chunks().take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts].astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array(keys[order])), pa.ListArray.from_arrays(cuts, reps)], names=["part", "keys", "reps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in _banded(size)(batches):
            rows.append(batch)
            n += batch.num_rows
            if n >= DEALT:
                yield lists(rows)
                rows, n = [], 0
        if n:
            yield lists(rows)

    return run


def _part(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.uint16)


def _runs(id_type: pa.DataType):
    """From lists sorted by their part: the pairs of each bucket, or its members with a null partner where it is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit, large, last = [], 0, HELD, np.zeros(0, np.int64), None

        def given(end: bool) -> pa.RecordBatch:
            """What is held in order: the members of large buckets, and at the end of a part the pairs of the others, which are held on otherwise."""
            nonlocal held, n, limit, large
            keys, reps = np.concatenate([k for k, _ in held]), pa.chunked_array([r for _, r in held], id_type).combine_chunks()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            full = (sizes > BUCKET) | np.isin(keys[starts], large)
            out = np.repeat(full, sizes)
            names, first, second = [keys[out]], [reps.take(pa.array(order[out]))], [pa.nulls(int(out.sum()), id_type)]
            if end:
                some = ~full & (sizes > 1)
                inside = np.repeat(some, sizes)
                members, at, pairs = reps.take(pa.array(order[inside])).to_pylist(), 0, []
                for key, size in zip(keys[starts[some]].tolist(), sizes[some].tolist()):
                    bucket = sorted(members[at : at + size])
                    at += size
                    pairs += [(key, a, b) for i, a in enumerate(bucket) for b in bucket[i + 1 :]]
                cols = list(zip(*pairs)) if pairs else [[], [], []]
                names.append(np.array(cols[0], dtype=np.int64))
                first.append(pa.array(cols[1], id_type))
                second.append(pa.array(cols[2], id_type))
                held, n, limit, large = [], 0, HELD, np.zeros(0, np.int64)
            else:
                large = np.union1d(large, keys[starts[full]])
                held = [(keys[~out], reps.take(pa.array(order[~out])))]
                n = len(held[0][0])
                limit = max(HELD, 2 * n)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.concat_arrays(first), pa.concat_arrays(second)], names=["key", "a", "b"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            if not len(parts):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                if parts[a] != last and n >= SORTED:
                    yield given(True)
                last = parts[a]
                held.append((batch.column(1).slice(a, b - a).flatten().to_numpy(), batch.column(2).slice(a, b - a).flatten()))
                n += len(held[-1][0])
                if n > limit:
                    yield given(False)
        if n:
            yield given(True)

    return run


def _block_pairs(id_type: pa.DataType, threshold: float):
    names = ["a", "b"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        ids, block = table.column("rep").to_pylist(), np.array(table.column("block").to_pylist())
        grams = [np.array(x, dtype=np.int64) for x in table.column("grams").to_pylist()]
        sizes = np.array([len(x) for x in grams], dtype=np.float64)
        kinds, code = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.repeat(np.arange(len(grams)), sizes.astype(np.int64))
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        shared = np.zeros((len(grams), len(grams)), np.float32)
        for at in range(0, len(kinds), 8192):  # slices of the shingles, as a dense product each
            lo, hi = np.searchsorted(code, [at, at + 8192])
            part = np.zeros((len(grams), 8192), np.float32)
            part[owner[lo:hi], code[lo:hi] - at] = 1
            shared += part @ part.T
        alike = shared / np.maximum(1, sizes[:, None] + sizes[None, :] - shared) >= threshold
        i, j = np.nonzero(np.triu(alike, 1))
        if left != right:
            other = block[i] != block[j]
            i, j = i[other], j[other]
        pairs = [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(i.tolist(), j.tolist())]
        return pa.Table.from_arrays([pa.array([p[0] for p in pairs], id_type), pa.array([p[1] for p in pairs], id_type)], names=names)

    return run


def similar(bodies: DataFrame, id_col: str = "seq", body_col: str = "body", size: int = 5, threshold: float = 0.8, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)`` of the records with at least ``least`` words.

    ``members``: ``id, rep, n``; records with the same words have the same ``rep``, the least id of them, and there are ``n`` of
    them. ``pairs``: ``a < b`` representatives whose sets have a Jaccard similarity of at least ``threshold``. Null and empty
    bodies and bodies under ``least`` words give no row; ids should be unique (a repeated row repeats its member); an empty table
    gives empty results; other columns are not read.
    """
    kernel, schema = hashing(bodies.schema[id_col].dataType, size, least)
    return similar_sets(bodies.select(F.col(id_col), F.col(body_col)).mapInArrow(kernel, schema), size, threshold)


def hashing(kind, size: int, least: int):
    """The kernel that gives ``id, h1, h2, body`` of records ``(id, body)``, and its schema."""
    from pyspark.sql.pandas.types import to_arrow_type

    return _hashed(to_arrow_type(kind), size, least), f"id {kind.simpleString()}, h1 long, h2 long, body string"


def similar_sets(sets: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``similar`` from the rows of ``hashing``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = sets.schema["id"].dataType
    name, arrow = kind.simpleString(), to_arrow_type(kind)
    sets = written(sets)
    several = written(sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = written(join_hot(sets.select("id", "h1", "h2"), several, ["h1", "h2"], several.filter(F.col("n") > HOT_ROWS), "id", "left").select(
        "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1).cast("long")).alias("n")))
    texts = sets.select(F.col("id").alias("rep"), "body").join(members.filter("id <> rep").select(F.col("id").alias("rep")), "rep", "left_anti")
    banded = texts.mapInArrow(_dealt(size), f"part int, keys array<long>, reps array<{name}>")
    # one shuffle of 16 bytes a band; the members of a large bucket stream through their task and are not held
    found = written(banded.repartition("part").sortWithinPartitions("part").mapInArrow(_runs(arrow), f"key long, a {name}, b {name}"))
    near = written(found.filter("b is not null").groupBy("a", "b").count().filter(F.col("count") >= BANDS_AGREE).select("a", "b"))
    heavy = found.filter("b is null").select("key", F.col("a").alias("rep"))
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(heavy.select("rep")).distinct())
    grams = written(texts.join(wanted, "rep", "left_semi").mapInArrow(_grams(size), f"rep {name}, grams array<long>"))
    both = near.join(grams.withColumnsRenamed({"rep": "a", "grams": "ga"}), "a").join(grams.withColumnsRenamed({"rep": "b", "grams": "gb"}), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    exact = both.select("a", "b", common.alias("c"), (F.size("ga") + F.size("gb")).alias("s")).filter(
        F.col("c") >= threshold * (F.col("s") - F.col("c"))).select("a", "b")
    if heavy.isEmpty():
        return members, exact
    sizes = written(heavy.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    dealt = join_hot(heavy, sizes, ["key"], sizes.filter(F.col("n") > HOT_ROWS), "rep").withColumn("of", F.ceil(F.col("n") / BLOCK))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("of")))
    pairs = dealt.select("key", "rep", "block", F.explode(F.expr("sequence(0, of - 1)")).alias("o")).select(
        "key", "rep", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    inside = pairs.join(grams, "rep").groupBy("key", "i", "j").applyInArrow(_block_pairs(arrow, threshold), f"a {name}, b {name}")
    return members, exact.unionByName(inside).distinct()


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of records ``seq_a < seq_b``, copies included. Groups of copies are paired part by part."""
    of = F.ceil(F.col("n") / COPIES)
    large = members.filter((F.col("n") > COPIES) & (F.col("id") == F.col("rep"))).select("rep", of.alias("of"))
    left, right = members.withColumnsRenamed({"id": "x", "rep": "a"}), members.withColumnsRenamed({"id": "y", "rep": "b"})
    if large.isEmpty():
        between = pairs.join(left, "a").join(right, "b").select("x", "y")
        copies = left.filter("n > 1").join(right.filter("n > 1"), F.col("a") == F.col("b")).filter("x < y").select("x", "y")
        return between.unionByName(copies).select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
    large = written(large)
    part = F.pmod(F.xxhash64("id"), of)
    parts = members.select("id", "rep", "n", of.alias("of"), part.alias("part"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1).cast("long")) - 1))
    sized = pairs.join(large.withColumnsRenamed({"rep": "a", "of": "of_a"}), "a", "left").join(large.withColumnsRenamed({"rep": "b", "of": "of_b"}), "b", "left")
    sized = sized.select("a", "b", "of_b", every(F.col("of_a")).alias("i")).select("a", "b", "i", every(F.col("of_b")).alias("j"))
    between = sized.join(parts.select(F.col("id").alias("x"), F.col("rep").alias("a"), F.col("part").alias("i")), ["a", "i"]).join(
        parts.select(F.col("id").alias("y"), F.col("rep").alias("b"), F.col("part").alias("j")), ["b", "j"]).select("x", "y")
    alike = parts.filter("n > 1")
    left = alike.select(F.col("id").alias("x"), "rep", F.col("part").alias("i"), F.explode(F.expr("sequence(part, of - 1)")).alias("j"))
    right = alike.select(F.col("id").alias("y"), "rep", F.col("part").alias("j"), F.explode(F.expr("sequence(0, part)")).alias("i"))
    copies = left.join(right, ["rep", "i", "j"]).filter("i < j or x < y").select("x", "y")
    return between.unionByName(copies).select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: ``id, class_id`` (least id that is reached by links) and ``links`` (records it is linked to).

    Labels pass along the links, and in each round every label is also replaced by its own label, so the rounds grow with the
    logarithm of the longest chain. Each round is a table written to the shared folder.
    """
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = members.select(F.col("rep").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        heard = both.join(label, both["b"] == label["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.alias("s").join(step.select(F.col("node").alias("n2"), F.col("label").alias("l2")), F.col("s.label") == F.col("n2"))
        fresh = written(jump.select("node", "old", F.least("label", "l2").alias("label")))
        moved = fresh.filter("label <> old").limit(1).count()
        label = fresh.select("node", "label")
        if not moved:
            break
    hot = F.col("n") > HOT_ROWS
    sizes = members.filter("id = rep").select("rep", "n").distinct()
    links = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    per = sizes.join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep").select(
        "rep", F.col("label").alias("class_id"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"),
        F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    dealt = members.withColumn("part", F.when(hot, F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS)).cast("int")).otherwise(0)).drop("n")
    return dealt.join(per, ["rep", "part"]).select("id", "class_id", "links")


def record_bodies(df: DataFrame, config: DataFrame, wanted: tuple[str, ...] = ("body",)) -> DataFrame:
    """``seq`` and the wanted ones of ``body, heads, prose``: source records without markup and without the lines of problems 3 and 4.

    ``heads`` are the headings, ``prose`` is the body without headings and code.
    """
    pages = mainbody.main_bodies(df, config, wanted)
    body = plain_bodies(df)
    prose = F.regexp_replace("body", r"(?s)```.*?(?:```|\z)", "")
    prose = F.regexp_replace(prose, r"(?m)^(?: {4}|\t| {0,3}#{1,6}\s).*$", "")
    heads = F.array_join(F.regexp_extract_all("body", F.lit(r"(?m)^ {0,3}#{1,6}\s+(.*)$"), F.lit(1)), "\n")
    parts = {"body": F.col("body"), "heads": heads.alias("heads"), "prose": prose.alias("prose")}
    return pages.unionByName(body.select("seq", *[parts[c] for c in wanted]))


def plain_bodies(df: DataFrame) -> DataFrame:
    """``seq, body`` of the records that are not pages: without the lines of problem 3, links as their text."""
    return lines.cleaned_records(df).select("seq", F.regexp_replace("clean_text", r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1").alias("body"))


def similar_records(df: DataFrame, config: DataFrame, size: int, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """``similar`` of the bodies of source records; those of pages are hashed where they are decided."""
    kernel, schema = hashing(df.schema["seq"].dataType, size, least)
    pages = mainbody.main_bodies(df, config, ("body",), (kernel, schema))
    return similar_sets(pages.unionByName(plain_bodies(df).mapInArrow(kernel, schema)), size, threshold)
