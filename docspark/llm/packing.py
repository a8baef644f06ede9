"""Problem 8: fill containers of fixed capacity by sum-of-squares packing.

The packer keeps, for each fill level, how many open containers stand at it, and puts an item where the sum of the squared
counts of the partly filled levels becomes smallest. It is an online rule: items are taken as they come, here in the order of a
hash, and none is looked at before its turn. As it is sequential it runs on shards: items are dealt to shards by a hash, a shard
is packed by one task, and only the containers that are still well under capacity at its end give their items back. Those few go
into the next round over fewer shards, until one shard is left, or until a round closed so few that another deal gains nothing
(items of which no two fit together stay alone however they are dealt). Items larger than the capacity are divided into full
pieces and a rest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.stage import written

#: Items a shard holds at most, about; the shards follow from the number of items.
SHARD_ITEMS = 40_000
#: A container filled to this share counts as closed at the end of a round that is not the last.
CLOSED = 0.995
#: The next round is the last if more than this share of a round's items came back from it.
STALLED = 0.95


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes 1..capacity, in the order given), by the sum-of-squares rule.

    Of all levels with a container, and of a new container, the one wins that changes the sum of the squared counts the least;
    full containers leave the sum. Ties go to the fuller level.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        room = capacity - size
        here = counts[: room + 1]
        cost = 2 * (counts[size:] - here) + 2
        cost[room] = 1 - 2 * here[room]
        cost[here == 0] = 1 << 40
        cost[0] = 2 * counts[size] + 1
        level = room - int(np.argmin(cost[::-1]))
        if level:
            stack = stacks[level]
            box = stack.pop()
            counts[level] -= 1
        else:
            box = made
            made += 1
        out[i] = box
        after = level + size
        if after < capacity:
            counts[after] += 1
            stacks.setdefault(after, []).append(box)
    return out


PLACED = "spec_id bigint, capacity_tokens bigint, item_id bigint, part int, size bigint, shard int, box bigint, round int, done boolean"


def _turns(item: np.ndarray, part: np.ndarray, size: np.ndarray, round_no: int) -> np.ndarray:
    """The order in which items come: by a hash of each."""
    with np.errstate(over="ignore"):
        x = (item.astype(np.uint64) + np.uint64(round_no + 1)) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return np.lexsort((size, part, item, x ^ (x >> np.uint64(29))))


def _pack(round_no: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = _turns(table.column("item_id").fill_null(-1).to_numpy(), table.column("part").to_numpy(), table.column("size").to_numpy(), round_no)
        table = table.take(pa.array(order))
        capacity = table.column("capacity_tokens")[0].as_py()
        sizes = table.column("size").to_numpy()
        box = sum_of_squares(sizes, capacity)
        fill = np.bincount(box, weights=sizes)
        done = np.ones(len(box), bool) if last else (fill >= CLOSED * capacity)[box]
        cols = [table.column(c) for c in ("spec_id", "capacity_tokens", "item_id", "part", "size", "shard")]
        cols += [pa.array(box), pa.array(np.full(len(box), round_no, np.int32)), pa.array(done)]
        return pa.table(cols, names=["spec_id", "capacity_tokens", "item_id", "part", "size", "shard", "box", "round", "done"])

    return run


def pack_items(items: DataFrame, specs: DataFrame, id_col: str = "doc_id", size_col: str = "size") -> DataFrame:
    """Pack every item into containers of every spec.

    ``items``: ids and sizes (null or non-positive sizes take no room and are left out; repeated ids are items of their own).
    ``specs``: ``spec_id, capacity_tokens`` (null or non-positive capacities are left out). Result, one row per piece:
    ``spec_id, container (string), item_id, part, size, capacity_tokens``; an item has several parts only if it exceeds the
    capacity. Empty tables give an empty result. The number of rounds follows the number of items and is logarithmic.
    """
    base = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(size_col).cast("long").alias("size")).filter("size > 0").withColumn("row", F.monotonically_increasing_id())  # fixed once the table is written
    base = written(base)
    kinds = specs.select("spec_id", F.col("capacity_tokens").cast("long")).filter("capacity_tokens > 0").collect()  # a handful of rows by definition
    each = base.withColumn("spec", F.explode(F.lit([]).cast("array<struct<spec_id:bigint,capacity_tokens:bigint>>") if not kinds else F.array(
        *[F.struct(F.lit(k.spec_id).cast("long").alias("spec_id"), F.lit(k.capacity_tokens).cast("long").alias("capacity_tokens")) for k in kinds]
    )))
    open_items = each.select(
        "spec.spec_id", "spec.capacity_tokens", "item_id", "row",
        F.explode(F.expr("transform(sequence(0, cast((size - 1) div spec.capacity_tokens as int)), i -> struct(cast(i as int) as part, cast(least(spec.capacity_tokens, size - i * spec.capacity_tokens) as bigint) as size))")).alias("p"),
    ).select("spec_id", "capacity_tokens", "item_id", "row", "p.part", "p.size")
    full = open_items.filter("size = capacity_tokens")
    open_items = open_items.filter("size < capacity_tokens").drop("row")
    left, round_no, stalled = base.count(), 0, False
    out = [full.select("spec_id", F.concat_ws("-", F.lit("full"), "row", "part").alias("container"), "item_id", "part", "size", "capacity_tokens")]
    while True:
        shards = max(1, -(-left // SHARD_ITEMS))
        last = shards == 1 or stalled
        dealt = open_items.withColumn("shard", F.pmod(F.xxhash64("item_id", "part", "size", F.lit(round_no)), F.lit(shards)).cast("int"))
        placed = dealt.groupBy("spec_id", "shard").applyInArrow(_pack(round_no, last), PLACED)
        placed = written(placed)
        out.append(placed.filter("done").select(
            "spec_id", F.concat_ws("-", "round", "shard", "box").alias("container"), "item_id", "part", "size", "capacity_tokens"))
        if last:
            break
        open_items = placed.filter("not done").select("spec_id", "capacity_tokens", "item_id", "part", "size")
        before, left = left, open_items.groupBy("spec_id").count().agg(F.max("count")).first()[0] or 0
        stalled = left > STALLED * before
        round_no += 1
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def with_empty(packed: DataFrame, empty: DataFrame, specs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``packed`` with a row of size 0 for each row of ``empty`` and each spec, in one of the spec's containers (one of its own if it has none)."""
    some = {r.spec_id: r.container for r in packed.groupBy("spec_id").agg(F.min("container").alias("container")).collect()}  # a row per spec
    kinds = specs.select(F.col("spec_id").cast("long"), F.col("capacity_tokens").cast("long")).filter("capacity_tokens > 0").collect()
    boxes = [F.struct(F.lit(k.spec_id).cast("long").alias("spec_id"), F.lit(some.get(k.spec_id, "empty")).alias("container"), F.lit(k.capacity_tokens).cast("long").alias("capacity_tokens")) for k in kinds]
    if not boxes:
        return packed
    rows = empty.select(F.col(id_col).cast("long").alias("item_id"), F.explode(F.array(*boxes)).alias("k"))
    return packed.unionByName(rows.select("k.spec_id", "k.container", "item_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), "k.capacity_tokens"))
