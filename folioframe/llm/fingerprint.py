"""One-permutation MinHash fingerprints.  DataFrame functions only.

Each five-word shingle is hashed once; the top bits of the hash name its bin and the
least hash of a bin stays.  An empty bin borrows from the first
filled one of its own random sequence of bins, which is the same in all documents
(optimal densification); should the first PROBES of them be empty, it picks the filled
bin that hashes least with it, which is as uniform.  Of every bin's minimum, hashed with
the bin, the low BITS bits are packed, sixteen bins to a bigint.  Two bins agree by chance once in 2**BITS, which the
likeness takes off again.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise

SHINGLE = 5
BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
PROBES = 48
SPACE = r"[\x20\x09-\x0D]+"
_SHIFT = 63 - BIN_BITS
_PER_LONG = 64 // BITS


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT)


def _pick(empty: Column, filled: Column) -> Column:
    """A 56-bit hash of (empty bin, filled bin)."""
    return F.shiftrightunsigned(F.xxhash64(empty, filled), 8)


def _probes() -> Column:
    """For each bin a random sequence of bins, as a constant."""
    rng = random.Random(BINS)
    return F.array(*(F.array(*(F.lit(rng.randrange(BINS)) for _ in range(PROBES))) for _ in range(BINS)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and out, the packed bins of text: array<bigint>, empty for a text without words.

    Every step is a column of its own that the next names at least twice, as the
    optimizer would otherwise copy it into the next one's lambda, to run for each element.
    """
    w, h, low = (F.col(f"_{x}_{out}") for x in "whl")
    mask = F.lit((1 << BITS) - 1)
    five = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE)))
    many = F.slice(F.transform(w, lambda x, i: F.shiftrightunsigned(five(x, i), 1)), 1, F.size(w) - (SHINGLE - 1))
    hashes = F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, F.array(F.shiftrightunsigned(F.xxhash64(w), 1)))
    d = F.col(f"_d_{out}")

    def bits(b: Column, x: Column) -> Column:  # of a hash with the bin, so that copies of one minimum don't all agree by one chance
        return F.xxhash64(x, b).bitwiseAND(mask)

    def picked(b: Column) -> Column:
        # the pick stands above the number of what it picks, so the least pick brings that along
        least = F.array_min(F.transform(d, lambda x, i: F.when(x.isNotNull(), F.shiftleft(_pick(b, i), BIN_BITS).bitwiseOR(i.cast("long")))))
        return F.get(d, least.bitwiseAND(F.lit(BINS - 1)).cast("int"))

    def borrowed(b: Column) -> Column:
        found = F.aggregate(F.get(_probes(), b), F.lit(None).cast("long"), lambda a, p: F.coalesce(a, F.get(d, p)))
        return F.coalesce(found, picked(b))

    # each bin gets a last value of its own, so that every bin is there once sorted
    last = (1 << _SHIFT) - 1
    ends = F.array(*(F.lit((b << _SHIFT) | last) for b in range(BINS)))
    first = F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1))))
    dense = F.transform(d, lambda x: F.when(x.bitwiseAND(F.lit(last)) != last, x))
    lows = F.when(F.size(d) > 0, F.transform(d, lambda x, b: bits(b, F.coalesce(x, borrowed(b)))))
    longs = F.transform(
        F.sequence(F.lit(1), F.lit(BINS), F.lit(_PER_LONG)),
        lambda i: F.aggregate(F.slice(low, i, _PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x)),
    )
    steps = [
        (f"_w_{out}", F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")),
        (f"_h_{out}", hashes),
        (f"_h_{out}", F.when(h.isNotNull(), F.sort_array(F.concat(h, ends)))),
        (f"_d_{out}", F.when(h.isNotNull(), first)),
        (f"_d_{out}", F.when(d.isNotNull(), dense)),
        (f"_l_{out}", lows),
        (out, F.when(low.isNull(), F.array().cast("array<bigint>")).otherwise(longs)),
    ]
    for name, step in steps:
        df = df.withColumn(name, step)
    return df.drop(*(n for n, _ in steps[:-1]))


def as_hex(packed_bins: Column) -> Column:
    """The packed bins as hexadecimal digits; '' for a text without words."""
    return F.array_join(F.transform(packed_bins, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles, 0 to 1.

    Two texts without words are alike (1), one of them and any other not (0).
    """
    ones = int("1" * _PER_LONG, 16)
    differ = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(differ(x.bitwiseXOR(y)).bitwiseAND(F.lit(ones)))), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    same = (1 - unlike / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(same, F.lit(0.0))).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


#: Documents put in order by one task, about.
ORDER_ROWS = 50_000


def successors(rows: DataFrame, order_rows: int = ORDER_ROWS) -> DataFrame:
    """rows (id, tie, times, ...), one for each id and tie, and next: the struct of the row that
    follows in descending id (null last) and ascending tie, the first after the last.

    Ranges of ids, as many as the rows need, are put in order by themselves; the first row of
    the next range follows the last of each.
    """
    by = [F.desc_nulls_last("id"), F.asc("tie")]
    parts = -(-rows.count() // order_rows) or 1
    placed = materialise(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("part").orderBy(*by)
    own = F.struct(*rows.columns)
    placed = placed.withColumns({"after": F.lead(own).over(inside), "k": F.row_number().over(inside)})
    line = Window.orderBy("part")  # one row a range
    heads = placed.where("k = 1").select("part", own.alias("head"))
    first = F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(line), first).alias("head"))
    return placed.join(heads, "part").withColumn("next", F.coalesce("after", "head")).drop("part", "after", "head", "k")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order_rows: int = ORDER_ROWS) -> DataFrame:
    """id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by as much of the beginning
    of the next document (descending id, null last; rows of one id stand in the order of a
    hash of the text, and repeated rows follow each other).  A single document is its own
    next.  Null texts count as empty.  An empty table gives an empty table; other columns
    of docs aren't read.

    Order is found among ids and fingerprints alone; a text then meets as much of the next
    one as it takes over.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t", F.col("id").isNull()))
    own = with_fingerprint(rows, "t", "f").select("id", "tie", F.char_length("t").alias("n"), "f")
    own = materialise(own, "fingerprints").groupBy("id", "tie").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("f").alias("f"))
    pairs = successors(own, order_rows)
    key = lambda i: F.coalesce(i, F.lit(0))  # noqa: E731  # tie tells a null id from 0
    pairs = pairs.select(
        "id", key(F.col("id")).alias("k"), "tie", "times", "n", F.floor(F.col("n") / 2).cast("int").alias("half"), "f", likeness(F.col("f"), F.col("next.f")).alias("near_next"),
        key(F.col("next.id")).alias("next_k"), F.col("next.tie").alias("next_tie"),
    )
    pairs = materialise(pairs, "fingerprint-pairs")
    texts = rows.select(key(F.col("id")).alias("k"), "tie", "t").groupBy("k", "tie").agg(F.first("t").alias("t"))
    wanted = pairs.select(F.col("next_k").alias("k"), F.col("next_tie").alias("tie"), F.col("k").alias("own_k"), F.col("tie").alias("own_tie"), "half")
    heads = texts.join(wanted, ["k", "tie"]).select(F.col("own_k").alias("k"), F.col("own_tie").alias("tie"), F.substring("t", F.lit(1), F.col("half")).alias("head"))
    both = pairs.join(texts, ["k", "tie"]).join(heads, ["k", "tie"])
    # of rows that repeat, all but the last are followed by their like
    like = F.when(F.col("times") > 1, F.struct(F.substring("t", F.lit(1), F.col("half")).alias("head"), F.lit(1.0).alias("near_next"), (F.col("times") - 1).alias("times")))
    ways = F.array_compact(F.array(F.struct("head", "near_next", F.lit(1).cast("long").alias("times")), like))
    both = both.select("id", "n", "half", "t", "f", F.explode(ways).alias("way"))
    edited = F.concat(F.substring("t", F.lit(1), F.col("n") - F.col("half")), F.col("way.head"))
    both = with_fingerprint(both.select("id", "n", "f", "way.times", "way.near_next", edited.alias("edited_text")), "edited_text", "e")
    return both.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_text",
        as_hex(F.col("f")).alias("fingerprint"),
        as_hex(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        "near_next",
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
