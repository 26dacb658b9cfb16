"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries,
range partitioning, subdivision of overfull ranges.  DataFrame operations only.

Rows are keyed by a hash of their group (equal keys stay together), drawn with a
probability proportional to their size, and the quantiles of the drawn keys bound
many more ranges than there are shards.  The exact size of every range is counted;
ranges above twice their share are subdivided by hash; and a prefix sum over the
ranges places every group on the line of bytes that is cut into shards.

Groups larger than 1/LARGE of a shard (there are at most LARGE times the number of shards)
are placed one by one before, the largest first, each whole in the shard with the most
room; the line is cut into what room the shards have left.  A group that no shard has room
for can't lie in one shard if sizes are to be near equal: its rows are keyed one by one
and go on the line.  All other groups lie whole in one shard, that of their middle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise

LARGE = 64
#: Keys drawn per range.
DRAWN = 24
#: Rows in a range, about; ranges at least and at most (beyond, ranges are subdivided).
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 20_000, 64, 4096
RESULTS = ("size", "shard", "slot")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds <= key, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(b[0]) for b in blocks))
    at = F.size(F.filter(heads, lambda h: h <= key))
    block = F.array(*(F.array(*(F.lit(x) for x in b)) for b in blocks))
    inside = F.size(F.filter(F.element_at(block, F.greatest(at, F.lit(1))), lambda h: h <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + inside)


def place(groups: Iterable[tuple[int, int]], total: int, n_shards: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Large groups (id, size): the shard of each that is placed whole, those that must
    be split, and the room left in each shard."""
    room = [total * (i + 1) // n_shards - total * i // n_shards for i in range(n_shards)]
    placed, split = {}, []
    for group, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        shard = max(range(n_shards), key=lambda i: (room[i], -i))
        if size <= room[shard]:
            placed[group] = shard
            room[shard] -= size
        else:
            split.append(group)
    return placed, split, room


def shard(docs: DataFrame, size: Column, group: Column, tie: list[Column], n_shards: int = 16) -> DataFrame:
    """Columns of docs and size (bigint), shard (0..n_shards-1), slot (gapless from 0).

    size: bytes of a row, null counts as 0.  group: a bigint; rows of one group share
    a shard unless the group is larger than the room of every shard.  tie: what orders
    rows of a group; rows that are equal in it too are interchangeable.  An empty table
    gives an empty table.  The rows are written to the shared folder once.  Columns size,
    shard and slot of docs are replaced, all others stay, whatever their names.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS), F.lit(0).alias("shard_own")).alias("doc"),
        F.coalesce(group, F.lit(0)).alias("group"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*tie).alias("tie"),
    )
    out = _shard(materialise(rows, "shard"), n_shards)
    return out.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c not in RESULTS), *RESULTS)


def _shard(rows: DataFrame, n_shards: int) -> DataFrame:
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    by_group = rows.groupBy("group").agg(F.sum("size").alias("b"))
    large = by_group.where(F.col("b") * (LARGE * n_shards) > F.lit(total)).collect()  # at most LARGE * n_shards rows
    placed, split, room = place([(r[0], r[1]) for r in large], total, n_shards)
    spread = F.when(F.col("group").isin(split), F.col("tie")).otherwise(F.lit(0)) if split else F.lit(0)
    rows = rows.withColumn("key", F.xxhash64("group", spread))
    own = F.lit(None).cast("int")
    if placed:
        own = F.create_map(*(F.lit(x) for kv in placed.items() for x in kv))[F.col("group")].cast("int")
    rows = rows.withColumn("own", own)
    line = F.when(F.col("own").isNull(), F.col("size")).otherwise(F.lit(0))  # bytes on the line
    rows = rows.withColumn("line", line)
    on_line = sum(room)

    n_ranges = max(LEAST_RANGES, 4 * n_shards, min(-(-count // RANGE_ROWS), MOST_RANGES))
    unit = (F.xxhash64("tie", "group", F.lit(17)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    drawn = rows.where(unit * F.lit(float(max(on_line, 1))) < F.col("line") * F.lit(float(n_ranges * DRAWN))).select("key").orderBy("key")
    keys = [r[0] for r in drawn.collect()]  # n_ranges * DRAWN of them on average
    bounds = sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds))

    sizes = rows.groupBy("range").agg(F.sum("line").alias("b"), F.count("*").alias("n")).collect()  # one row a range
    # twice its share of bytes or of rows is overfull
    over = {r[0]: max(r[1] * n_ranges // max(2 * on_line, 1), r[2] // (2 * RANGE_ROWS)) + 1 for r in sizes}
    over = {k: v for k, v in over.items() if v > 1}
    sub = F.lit(0)
    if over:
        parts = F.create_map(*(F.lit(x) for kv in over.items() for x in kv))
        # a group that is placed whole, and may be hot, is divided by row: no place on the line is at stake
        by = F.when(F.col("own").isNull(), F.col("key")).otherwise(F.col("tie"))
        sub = F.pmod(F.xxhash64(by, F.lit(5)), F.coalesce(parts[F.col("range")], F.lit(1)).cast("long")).cast("int")
    rows = rows.withColumn("sub", sub)

    cell = rows.groupBy("range", "sub").agg(F.sum("line").alias("b"))
    begins = cell.select("range", "sub", (F.sum("b").over(Window.orderBy("range", "sub")) - F.col("b")).alias("before"))
    in_cell = Window.partitionBy("range", "sub").orderBy("key")
    end = F.sum("line").over(in_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(begins, ["range", "sub"])  # one row a range or part of one
    whole = F.sum("line").over(Window.partitionBy("range", "sub", "key"))
    middle = F.col("before") + end - F.floor((whole + 1) / 2)
    ends = [sum(room[: i + 1]) for i in range(n_shards - 1)]  # where the line leaves each shard but the last
    cut = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= middle)) if ends else F.lit(0)
    rows = rows.withColumn("shard", F.coalesce("own", cut))

    mine = rows.groupBy("range", "sub", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "sub")) - F.col("n")
    starts = mine.select("range", "sub", "shard", before.alias("start"))
    number = F.row_number().over(Window.partitionBy("range", "sub", "shard").orderBy("key", "tie"))
    rows = rows.withColumn("number", number).join(starts, ["range", "sub", "shard"])
    return rows.withColumn("slot", (F.col("start") + F.col("number") - 1).cast("long"))
