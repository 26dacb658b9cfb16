"""Near-duplicate classes by ProbMinHash, banding and verification.

Every distinct five-word shingle of a text arrives at the points of a Poisson process
whose rate is the shingle's weight (by its count, but mildly: as plain sets decide in the end,
shingles that repeat must not hide what the sets have in common); each point falls on one of the
registers, and a register keeps its earliest arrival.  Once all registers are filled, an
element stops at its first arrival later than the latest of them.  Registers of two texts
agree with the probability Jaccard similarity of their weighted shingles.

Bands of registers name buckets.  Copies of a text count once.  In every bucket each text
is first held against one centre, by the Jaccard similarity of the shingle sets themselves.
Where that leaves a bucket with several classes, texts outside the centre's class become
centres too, four times as many in each round, until all of them have been one; texts that
are in one class by then are never compared.  So a bucket of n texts, of which m are unlike
the others, costs at most n + n * m comparisons, n if all are alike, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise
from folioframe.llm.text import _P1, NON_SPACE, Words, mix, shingle_hashes, slices, texts_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Weight that the logarithm of a shingle's count adds to 1.
REPEAT = 0.125
#: Pairs of one text that are compared by one task.
SALT_PAIRS = 2_000


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text number, hash, count.  Texts of fewer words are one shingle."""
    h = w.hashes()
    s = shingle_hashes(h, k)
    doc = w.doc_of_word()
    if len(s):
        inside = doc[: len(s)] == doc[k - 1 :]
        s, d = s[inside], doc[: len(inside)][inside]
    else:
        d = np.empty(0, np.int64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        own = np.empty(len(few), np.uint64)
        for j, i in enumerate(few):
            v = w.counts[i : i + 1].astype(np.uint64)
            for x in range(w.first[i], w.first[i + 1]):
                v = mix(v * _P1 + h[x : x + 1])
            own[j] = v[0]
        s, d = np.concatenate((s, own)), np.concatenate((d, few))
    _, first, count = np.unique(mix(s + d.astype(np.uint64) * _P1), return_index=True, return_counts=True)
    return d[first], s[first], count


def registers(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The element that each register of each text keeps: [text, register]."""
    arrival = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, np.uint64)
    time = np.zeros(len(doc))
    latest = np.full(n_docs, np.inf)
    point = np.zeros(1, np.uint64)
    while len(doc):
        point = point + np.uint64(1)
        r = mix(element ^ (point * _P1))
        time = time - np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight
        early = time < latest[doc]
        if not early.all():
            doc, element, weight, time = doc[early], element[early], weight[early], time[early]
        at = doc * m + (mix(element + point) % np.uint64(m)).astype(np.int64)
        np.minimum.at(arrival, at, time)
        won = arrival[at] == time
        kept[at[won]] = element[won]
        if len(doc) == 0:
            break
        live = np.unique(doc) if len(doc) < n_docs else np.arange(n_docs)
        latest[live] = arrival.reshape(n_docs, m)[live].max(axis=1)
        on = time < latest[doc]
        if not on.all():
            doc, element, weight, time = doc[on], element[on], weight[on], time[on]
    return kept.reshape(n_docs, m)


def signatures(texts: list[bytes | None], m: int = REGISTERS) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each text, and its number of distinct shingles."""
    d, s, count = shingles(Words(texts, NON_SPACE, lower=True))
    return registers(d, s, 1 + REPEAT * np.log(count), len(texts), m), np.bincount(d, minlength=len(texts))


def band_keys(kept: np.ndarray) -> np.ndarray:
    by = kept.reshape(len(kept), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), by.shape[:2])
    for r in range(ROWS):
        h = mix(h * _P1 + by[:, :, r])
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 4_000_000):
            kept, n = signatures(texts_of(b, "text"))
            keys = band_keys(kept).view(np.int64)
            some = n > 0
            offsets = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("a"), b.column("b"), bands], ["id", "a", "b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text", 4_000_000):
            d, s, _ = shingles(Words(texts_of(b, "text"), NON_SPACE, lower=True))
            s = (s >> np.uint64(32)).astype(np.uint32)  # within two texts, 32 bits tell shingles apart
            s = s[np.argsort(d, kind="stable")]
            ends = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=b.num_rows))))
            out = [np.unique(s[x:y]).tobytes() for x, y in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "set"])


def jaccard(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return 0.0  # below SIMILAR by their sizes alone
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([jaccard(x, y) >= SIMILAR for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _with_set(pairs: DataFrame, counted: DataFrame, sets: DataFrame, key: str, other: str, out: str) -> DataFrame:
    """pairs and the set of key, as out; counted: the pairs alone.

    A centre is in the pairs of its whole bucket: keys of more than SALT_PAIRS pairs are
    salted, one salt for so many pairs, and their sets copied once a salt.
    """
    heavy = counted.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > SALT_PAIRS)
    heavy = materialise(heavy.select("k", F.ceil(F.col("n") / SALT_PAIRS).alias("salts")), "heavy")
    if heavy.isEmpty():
        return pairs.join(sets.toDF(key, out), key)
    salts = F.coalesce("salts", F.lit(1))
    salted = pairs.join(heavy.withColumnRenamed("k", key), key, "left").withColumn("salt", F.pmod(F.xxhash64(other), salts)).drop("salts")
    copies = sets.toDF("k", out).join(heavy, "k", "left").select(F.col("k").alias(key), out, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return salted.join(copies, [key, "salt"]).drop("salt")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, alike) for pairs of ids by their shingle sets."""
    pairs = materialise(pairs, "candidates")
    with_x = _with_set(pairs, pairs, sets, "x", "y", "s")
    return _with_set(with_x, pairs, sets, "y", "x", "t").select("x", "y", F.arrow_udf(_alike, "boolean")("s", "t").alias("alike"))


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label) of the nodes of links (x, y): the least id of their component.

    labels: those of earlier links.  Least labels pass along links, and labels of labels
    are followed, until nothing changes; each round is written to the shared folder.
    """
    both = links.union(links.select("y", "x")).toDF("id", "other")
    if labels is not None:
        both = both.union(labels.select("id", "label")).union(labels.select("label", "id")).where("id <> other")
    both = materialise(both.distinct(), "links")
    now = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("label")), "labels")
    while True:
        near = both.join(now.toDF("other", "l"), "other").groupBy("id").agg(F.min("l").alias("l"))
        step = now.join(near, "id").select("id", F.least("label", "l").alias("new"), "label")
        jump = step.join(now.toDF("new", "far"), "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("new"), "label")
        after = materialise(jump, "labels")
        if after.where("new < label").isEmpty():
            return after.select("id", "label")
        now = after.select("id", F.col("new").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, class_id) per row of docs; class_id is the least id of its class.

    Texts with a shingle-set similarity of 0.8 or more are linked, classes are what links
    connect.  Words are lower-cased (A-Z) and end at white space.  Equal texts are one
    class, those without words too, else these are alone; a null text is alone; rows of
    one id are one document; a null id has a null class and takes no part.
    """
    own = F.col(text).isNull()
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(own, F.xxhash64(F.lit("null"), F.col(id_col))).otherwise(F.xxhash64(text)).alias("a"),
        F.when(own, F.xxhash64(F.lit("none"), F.col(id_col))).otherwise(F.xxhash64(F.lit(1), F.col(text))).alias("b"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    signed = materialise(rows.mapInArrow(_sign, "id long, a long, b long, bands array<long>"), "signed")
    texts = signed.where("id IS NOT NULL").groupBy("a", "b").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    banded = materialise(texts.select("rep", F.explode("bands").alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("bucket")
    crowded = materialise(banded.join(shared, "bucket"), "buckets")
    sets = rows.select("id", "text").join(crowded.select(F.col("rep").alias("id")).distinct(), "id").mapInArrow(_sets, "id long, set binary")
    sets = materialise(sets, "sets")

    labels: DataFrame | None = None
    held: DataFrame | None = None
    wanted = 0  # centres of each bucket
    while True:
        if labels is None:
            now = crowded.withColumn("class", F.col("rep"))
        else:
            now = crowded.join(labels.toDF("rep", "class"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
        order = F.xxhash64("rep", "bucket")
        centre = now.groupBy("bucket").agg(
            F.min_by("rep", order).alias("c"), F.min_by("class", order).alias("c_class"), F.min("class").alias("lo"), F.max("class").alias("hi")
        )
        mixed = now.join(centre.where("lo < hi").drop("lo", "hi"), "bucket")
        if wanted == 0:
            pairs = mixed.where("class <> c_class")
            rest = 0
        else:
            mixed = materialise(mixed, "mixed")
            others = mixed.where("class <> c_class")
            per = others.groupBy("bucket").agg(F.count("*").alias("n"))
            rest = per.agg(F.max("n")).first()[0] or 0
            unit = F.shiftrightunsigned(F.xxhash64("bucket", "rep"), 11) / F.lit(float(1 << 53))
            centres = others.join(per, "bucket").where(unit * F.col("n") < F.lit(float(wanted))) if rest > wanted else others
            centres = centres.select("bucket", F.col("rep").alias("c"), F.col("class").alias("c_class"))
            pairs = mixed.drop("c", "c_class").join(centres, "bucket").where("class <> c_class")
        pairs = pairs.select(F.least("rep", "c").alias("x"), F.greatest("rep", "c").alias("y")).distinct()
        if held is not None:
            pairs = pairs.join(held, ["x", "y"], "left_anti")
        seen = materialise(verify(pairs, sets), "pairs")
        links = seen.where("alike").select("x", "y")
        if not links.isEmpty():
            labels = components(links, labels)
        if wanted and rest <= wanted:
            break
        held = seen.select("x", "y") if held is None else held.union(seen.select("x", "y"))
        wanted = max(4, 4 * wanted)
    reps = texts.select("a", "b", "rep")
    if labels is not None:
        reps = reps.join(labels.toDF("rep", "class"), "rep", "left")
    else:
        reps = reps.withColumn("class", F.lit(None).cast("long"))
    reps = reps.select("a", "b", F.coalesce("class", "rep").alias("class_id"))
    found = signed.select("id", "a", "b").join(reps, ["a", "b"], "left")
    return found.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the document of least id of every class (one row of it).

    Rows of null id stay.
    """
    kept = near_duplicates(docs, id_col, text).where(F.col("class_id") == F.col(id_col)).select(id_col).distinct()
    some = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi")
    return some.dropDuplicates([id_col]).select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
