"""Mixing sources to target weights.

The words of each source are laid end to end (documents in a pseudorandom order) and packed
into blocks of BLOCK words; only the last block of a source is shorter.  A source's target,
in blocks, is its number of slots.  Slots go to the output shards by a multinomial draw: the
counts of a shard are those of a draw over the sources by their shares, given that all shards
together meet the targets.  The slots of a source run through a pseudorandom permutation of
its block indices, a new one for each pass over the source, and a join on (source, index)
brings the blocks to their slots.

Sources are rows of a table throughout, however many there are; the driver holds three sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise
from folioframe.llm.text import _P1, mix

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block.
BLOCK = 128
BUCKET_ROWS = 5_000
#: Sources numbered by one task; slots made by one task from one row.
SOURCE_ROWS, SLOT_ROWS = 200_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ("size", "source_size", "target", "taken", "pieces")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 (Feistel rounds, walked until inside)."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = index.astype(np.uint64), np.empty(len(index), np.uint64)
    n, key, todo = n.astype(np.uint64), key.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = x >> half, x & mask
        for r in range(4):
            left, right = right, left ^ (mix(right * _P1 + key + np.uint64(r)) & mask)
        x = (left << half) | right
        out[todo] = x
        on = x >= n
        todo, x, half, mask, key, n = todo[on], x[on], half[on], mask[on], key[on], n[on]
    return out.astype(np.int64)


def block_index(slot: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Blocks for slots of sources of n blocks: slot n begins the second pass, and so on."""
    passes = mix(key.view(np.uint64) + (slot // n).astype(np.uint64) * _P1)
    return permuted(slot % n, n, passes)


def draw(slots: int, source: int, n_shards: int, seed: int) -> np.ndarray:
    """How many of a source's slots each shard gets."""
    rng = np.random.Generator(np.random.PCG64([seed, source]))
    return rng.multinomial(slots, np.full(n_shards, 1 / n_shards))


def _block_index(slot: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
    return pa.array(block_index(*(a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (slot, n, key))))


def _drawn(n_shards: int, seed: int):
    def run(slots: pa.Array, source: pa.Array) -> pa.Array:
        return pa.array([draw(n, s, n_shards, seed).tolist() for n, s in zip(slots.to_pylist(), source.to_pylist())], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (one row a source, column src) and at: their number by code point, null last."""
    parts = -(-sources.count() // SOURCE_ROWS) or 1
    spread = sources.repartitionByRange(parts, F.asc_nulls_last("src")).withColumn("p", F.spark_partition_id())
    spread = materialise(spread, "mix-sources")
    per = spread.groupBy("p").agg(F.count("*").alias("c"))
    per = per.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("p").orderBy(F.asc_nulls_last("src"))) - 1
    return spread.withColumn("in", inside).join(per, "p").withColumn("at", F.col("before") + F.col("in")).drop("p", "in", "before")


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (at, n words) and target: its share of all words by repeated weights.

    No target exceeds cap times its source; the excess is shared again by weight until none
    is above.  A source without words has target 0.
    """
    w = F.get(F.array(*(F.lit(x) for x in weights)), (F.col("at") % len(weights)).cast("int"))
    sources = sources.withColumn("w", w)
    some = sources.where("n > 0")
    total, share = some.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("w")).first()
    unit, full = (total / share if share else 0.0), 0
    while total:
        over = F.lit(unit) * F.col("w") > F.lit(cap) * F.col("n")
        now, capped, share = some.agg(F.count_if(over), F.sum(F.when(over, F.lit(cap) * F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        if now == full:
            break
        unit, full = (total - capped) / share, now
    most = F.lit(cap) * F.col("n")
    return sources.withColumn("target", F.when(F.col("n") > 0, F.least(F.lit(unit) * F.col("w"), most.cast("double"))).otherwise(F.lit(0.0))).drop("w")


def mix_sources(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    key: tuple[str, ...] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    n_shards: int = 16,
    seed: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """Columns of docs, size, source_size, target, taken and pieces.

    Sources stand by code point, null last, and take the weights in turn.  pieces:
    array of (pass, start, len, shard), the words start..start+len-1 of the document that
    the mix takes; taken: their number.  Null sizes are 0; documents of size 0 are never
    taken.  The same rows give the same mix on every run; rows alike in key, source and
    size are interchangeable.  An empty table gives an empty table.  Columns of docs named
    like the results are replaced, all others stay, whatever their names.
    The taken words of a source differ from its target by a block or so.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS), F.lit(0).alias("mix_own")).alias("doc"),
        F.col(source).cast("string").alias("src"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*key, F.lit(seed)).alias("h"),
        F.xxhash64(*key).alias("tie"),
    )
    rows = materialise(rows, "mix-rows")
    sources = rows.groupBy("src").agg(F.sum("size").alias("n"), F.count("*").alias("c"))
    sources = with_targets(materialise(numbered(sources), "mix-numbered"), weights, cap)
    k = F.ceil(F.col("n") / block)
    slots = F.when(F.col("n") > 0, F.least(F.floor(F.lit(cap) * k), F.round(F.col("target") * k / F.col("n")))).otherwise(F.lit(0)).cast("long")
    sources = materialise(sources.withColumns({"k": k.cast("long"), "slots": slots}), "mix-targets")

    n_buckets = -(-rows.count() // BUCKET_ROWS) or 1
    about = sources.select(F.col("src").alias("name"), "at", F.col("n").alias("source_size"), "target")
    rows = rows.join(about, F.col("src").eqNullSafe(F.col("name"))).drop("name", "src")
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.lit(n_buckets)))
    cell = rows.groupBy("at", "bucket").agg(F.sum("size").alias("b"))
    before = F.sum("b").over(Window.partitionBy("at").orderBy("bucket")) - F.col("b")
    inside = F.sum("size").over(Window.partitionBy("at", "bucket").orderBy("h", "size", "tie").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("in", F.coalesce(inside, F.lit(0))).join(cell.select("at", "bucket", before.alias("before")), ["at", "bucket"])
    rows = rows.withColumn("off", F.col("before") + F.col("in")).drop("before", "in", "bucket", "h", "tie")

    first, last = F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block)
    parts = rows.where("size > 0").select("at", "off", "size", F.explode(F.sequence(first, last)).alias("index"))
    start = F.greatest(F.col("index") * block - F.col("off"), F.lit(0))
    end = F.least((F.col("index") + 1) * block - F.col("off"), F.col("size"))
    parts = parts.select("at", "index", "off", start.alias("start"), (end - start).alias("len"))

    dealt = sources.where("slots > 0").withColumn("dealt", _drawn(n_shards, seed)("slots", "at"))
    dealt = dealt.select("at", "k", "dealt", F.posexplode("dealt").alias("shard", "c")).where("c > 0")
    dealt = dealt.withColumn("f", F.aggregate(F.slice("dealt", F.lit(1), F.col("shard")), F.lit(0).cast("long"), lambda a, x: a + x)).drop("dealt")
    # slots exploded in two steps, so that no row explodes into a whole source
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / SLOT_ROWS))
    dealt = dealt.withColumn("chunk", F.explode(chunks)).repartition("at", "shard", "chunk")
    low, high = F.col("f") + F.col("chunk") * SLOT_ROWS, F.col("f") + F.least(F.col("c"), (F.col("chunk") + 1) * SLOT_ROWS) - 1
    slot = dealt.select("at", "shard", "k", F.explode(F.sequence(low, high)).alias("slot"))
    index = F.arrow_udf(_block_index, "long")("slot", "k", source_key(F.col("at"), seed)).alias("index")
    slot = slot.select("at", "shard", F.floor(F.col("slot") / F.col("k")).cast("int").alias("pass"), index)

    # the planner sees the size of the few source rows in the slots made of them, and would broadcast these
    taken = parts.join(slot.hint("merge"), ["at", "index"]).groupBy("at", "off").agg(
        F.sum("len").alias("taken"), F.array_sort(F.collect_list(F.struct("pass", "start", "len", "shard"))).alias("pieces")
    )
    none = {"taken": F.lit(0).cast("long"), "pieces": F.array().cast(taken.schema["pieces"].dataType)}
    # a document of no words has the offset of its successor
    full = rows.where("size > 0").join(taken, ["at", "off"], "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()})
    out = full.unionByName(rows.where("size = 0").withColumns(none))
    return out.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c not in RESULTS), *RESULTS)


def source_key(at: Column, seed: int) -> Column:
    """Names the permutations of a source."""
    return F.shiftrightunsigned(F.xxhash64(at, F.lit(seed)), 1)


def taken_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document and pass, its text the words taken in that pass.

    A document taken whole keeps its text as it is; pieces are joined by one space.
    Column pass is added.
    """
    passes = F.array_distinct(F.transform("pieces", lambda p: p["pass"]))
    rows = mixed.where("taken > 0").withColumn("pass", F.explode(passes))
    own = F.filter("pieces", lambda p: p["pass"] == F.col("pass"))
    n = F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p["len"])
    cut = lambda w: F.array_join(F.flatten(F.transform(own, lambda p: F.slice(w, (p["start"] + 1).cast("int"), p["len"].cast("int")))), " ")
    # the words are bound once: Catalyst would copy them into the lambda, to be split for each piece
    bound = F.get(F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), cut), 0)
    return rows.withColumn(text, F.when(n == F.col("size"), F.col(text)).otherwise(bound))
