"""Substring deduplication on a compacted de Bruijn graph of word k-mers.

Edges are the windows of k (50) consecutive words.  They are compacted in two steps.

Neighbouring windows of a document that share their minimiser (the least of the 16-word
k-mers inside) are compacted where they stand into one path; equal windows always share a
minimiser, so every edge of the graph lies in paths of one anchor only, and only (1 in 18)
paths are shuffled, never all windows.  Joins on the anchor tell what repeats: an anchor that
all documents enter and leave by the same path doesn't branch, and its path stays whole, with
the least document that has it; where paths of an anchor differ, they are opened again into
their windows.

Joins on the paths then tell what follows what: a path has as many exits as different paths
come after it anywhere, and as many entries as come before it.  Where the one exit of a path
is a path of one entry, the two are glued, so every nonbranching chain of the graph becomes a
single path, as long as the repeat itself, with the same places in all documents.

Source coordinates (document, first word) fetch the words of one occurrence of every
repeated path: a 128-bit digest of those words is held against each span before it is removed.
Windows of branching paths are compared with each other by two more hashes of those words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.shared import materialise
from folioframe.llm.text import _P1, NON_SPACE, Words, mix, slices, texts_of

WINDOW = 50
ANCHOR = 16
_B = 0xD6E8FEB86659FD93
_LOW = np.uint64((1 << 28) - 1)
_LAST = (1 << 63) - 1
_ADDED = ("_kept", "_words", "_removed")


def _doubling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, by powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else mix(out[:n] * _P1 + part)
            done += size
        if 2 * size > k:
            return out
        power = mix(power[:-size] * _P1 + power[size:])
        size *= 2


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of h[i] * B**i, and the powers of 1/B."""
    n = len(h) + 1
    powers = np.full(n, np.uint64(_B))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n, np.uint64(pow(_B, -1, 1 << 64)))
    inverse[0] = 1
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[:-1], dtype=np.uint64))), np.multiply.accumulate(inverse)


def paths(w: Words, k: int = WINDOW, anchor: int = ANCHOR):
    """Per path: document's index, first window's word number in it, number of
    windows, hash of the anchor, hash of the path."""
    h = w.hashes()
    none = np.empty(0, np.int64)
    if len(h) < k:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = _doubling(h, anchor)
    at = np.arange(len(a), dtype=np.uint64)
    least = (_sliding_min((a & ~_LOW) | at, k - anchor + 1) & _LOW).astype(np.int64)
    doc = w.doc_of_word()
    window = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    if len(window) == 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    by, d = least[window], doc[window]
    new = np.flatnonzero(np.concatenate(([True], (by[1:] != by[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.append(new, len(window)))
    start = window[new]
    sums, inverse = _prefix(h)
    whole = (sums[start + count + k - 1] - sums[start]) * inverse[start]
    whole = mix(whole ^ mix((by[new] - start).astype(np.uint64) * _P1 + count.astype(np.uint64)))
    return d[new], start - w.first[d[new]], count, a[by[new]], whole


def _emit_paths(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                d, start, count, anchor, path = paths(Words(texts_of(b, "text"), NON_SPACE), k)
                at = pa.array(d)
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array(anchor.view(np.int64)),
                        "path": pa.array(path.view(np.int64)),
                        "row": b.column("row").take(at),
                        "id": b.column("id").take(at),
                        "start": pa.array(start.astype(np.int32)),
                        "n": pa.array(count.astype(np.int32)),
                    }
                )

    return run


def _span(w: Words, i: int, start: int, end: int) -> bytes:
    a = int(w.first[i])
    s = w.starts[a + start : a + end]
    e = s + w.lens[a + start : a + end]
    return b" ".join(w.raw[x:y] for x, y in zip(s.tolist(), e.tolist()))


def _digest(w: Words, i: int, start: int, n: int, k: int) -> bytes:
    return hashlib.blake2b(_span(w, i, start, start + n + k - 1), digest_size=16).digest()


def _read_sources(k: int):
    """Digest of each path at its source, and two hashes of the windows of branching ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                w = Words(texts_of(b, "text"), NON_SPACE)
                spans = b.column("spans").to_pylist()
                win = [np.empty(0, np.int64)] * 2
                if any(s["branching"] for own in spans for s in own):
                    win = [_doubling(w.hashes(seed=i), k).view(np.int64) for i in (1, 2)]
                out: dict[str, list] = {x: [] for x in ("anchor", "path", "least", "digest", "windows", "more")}
                for i, own in enumerate(spans):
                    for s in own:
                        at = int(w.first[i]) + s["start"]
                        out["anchor"].append(s["anchor"])
                        out["path"].append(s["path"])
                        out["least"].append(s["least"])
                        out["digest"].append(_digest(w, i, s["start"], s["n"], k))
                        for name, v in zip(("windows", "more"), win):
                            out[name].append(v[at : at + s["n"]] if s["branching"] else None)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({x: pa.array(v, t) for (x, v), t in zip(out.items(), types)})

    return run


def _cut(k: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4_000_000):
                w = Words(texts_of(b, "text"), NON_SPACE)
                gone = np.zeros(len(w.starts) + 1, np.int32)
                ids = b.column("id").to_pylist()
                for i, spans in enumerate(b.column("spans").to_pylist()):
                    for s in spans or ():
                        if _digest(w, i, s["start"], s["n"], k) != s["digest"]:
                            continue
                        a = int(w.first[i]) + s["start"]
                        if s["mins"] is None:
                            gone[a] += 1
                            gone[a + s["n"] + k - 1] -= 1
                            continue
                        for j, m in enumerate(s["mins"]):
                            if m < ids[i]:
                                gone[a + j] += 1
                                gone[a + j + k] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept, removed = kept_texts(w, gone)
                cols = {"doc": b.column("doc")} | ({"text": b.column("text")} if keep_text else {})
                cols["_words"] = pa.array(w.counts.astype(np.int64))
                cols["_removed"] = pa.array(removed)
                cols["_kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def kept_texts(w: Words, gone: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Texts of the words that aren't gone, joined by one space; number of the gone."""
    buf = np.frombuffer(w.raw, np.uint8).copy()
    ends = w.starts + w.lens
    edge = np.zeros(len(buf) + 1, np.int8)
    stay = ~gone
    edge[w.starts[stay]] += 1
    edge[ends[stay] + 1] -= 1  # the byte after each word becomes its space
    buf[ends] = 0x20
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out = buf[mask].tobytes()
    size = np.concatenate(([0], np.cumsum(np.where(stay, w.lens + 1, 0))))
    at = size[w.first].tolist()
    count = np.concatenate(([0], np.cumsum(gone)))
    return [out[a : max(a, b - 1)] for a, b in zip(at, at[1:])], np.diff(count[w.first]).astype(np.int64)


def repeated_paths(found: DataFrame) -> DataFrame:
    """Occurrences (anchor, path, row, id, start, n) of the paths whose anchor lies in several
    documents, with least (the path's least document), first (the anchor's) and branching."""
    by_path = found.groupBy("anchor", "path").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    by_anchor = by_path.groupBy("anchor").agg(F.count("*").alias("paths"), F.min("least").alias("first"), F.max("most").alias("last")).where("first < last")
    repeated = by_path.join(by_anchor, "anchor").select("anchor", "path", "least", "first", (F.col("paths") > 1).alias("branching"))
    spans = found.join(repeated, ["anchor", "path"])
    return spans.groupBy("anchor", "path", "row", "start").agg(*(F.first(c).alias(c) for c in ("id", "n", "least", "first", "branching")))


def glue(spans: DataFrame) -> DataFrame:
    """spans with nonbranching chains of paths made one.

    A path that doesn't branch is glued to its successor where that is its only exit (after
    every occurrence comes that path, and it doesn't branch either) and has no other entry.
    The head of a chain gives it its anchor and path; chains have the same occurrences as
    their heads.  Rows of branching paths stay as they are.
    """
    lines = spans.where("NOT branching")
    row = Window.partitionBy("row").orderBy("start")
    after, before = (f(F.struct("start", "n", "anchor", "path")).over(row) for f in (F.lead, F.lag))
    near = lines.select("anchor", "path", "start", "n", after.alias("a"), before.alias("b"))
    name = lambda x: F.xxhash64(x["anchor"], x["path"])
    exits = F.when(F.col("a.start") == F.col("start") + F.col("n"), name(F.col("a")))
    entries = F.when(F.col("start") == F.col("b.start") + F.col("b.n"), name(F.col("b")))
    near = near.select("anchor", "path", exits.alias("exit"), entries.alias("entry"))
    one = lambda c: F.coalesce((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.lit(False))
    degree = near.groupBy("anchor", "path").agg(one("exit").alias("one_exit"), one("entry").alias("one_entry"))
    lines = lines.join(degree, ["anchor", "path"])
    last = F.lag(F.struct("start", "n", "one_exit")).over(row)
    glued = F.col("one_entry") & F.col("p.one_exit") & (F.col("start") == F.col("p.start") + F.col("p.n"))
    lines = lines.withColumn("p", last).withColumn("head", ~F.coalesce(glued, F.lit(False)))
    lines = lines.withColumn("chain", F.sum(F.col("head").cast("int")).over(row))
    lines = lines.groupBy("row", "chain").agg(
        F.min_by(F.struct("anchor", "path", "id", "least", "first"), "start").alias("h"), F.min("start").alias("start"), F.sum("n").cast("int").alias("n")
    )
    lines = lines.select("h.anchor", "h.path", "row", "start", "h.id", "n", "h.least", "h.first", F.lit(False).alias("branching"))
    return lines.unionByName(spans.where("branching"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """Columns of docs (without the text unless keep_text), _kept (the words left, joined by one space), _words, _removed.

    A word goes if a window over it also starts in a document of smaller id; windows
    are judged on the input.  Null and empty texts have no words; texts of fewer words
    than a window keep all.  A null id is smaller than none.  Rows that share their
    id never remove each other's words; repeated rows are treated alike.  Repeats inside
    one document stay.  Columns named like the results are replaced, all others stay,
    whatever their names.
    """
    rest = [c for c in docs.columns if c not in _ADDED and c != text]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest), F.lit(0).alias("debruijn_own")).alias("doc"),
        F.col(text).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("row"),
    )
    keys = rows.select("row", "id", "text")
    found = keys.mapInArrow(_emit_paths(window), "anchor long, path long, row long, id long, start int, n int")
    spans = materialise(repeated_paths(materialise(found, "paths")), "spans")
    spans = materialise(glue(spans), "glued")

    # all but the first document of an anchor may lose words; the least of a path is its source
    wanted = spans.where("id > least OR (branching AND id > first)")
    sources = spans.where("id = least").groupBy("anchor", "path").agg(
        F.min_by(F.struct("row", "start", "n", "least", "branching"), F.struct("row", "start")).alias("s")
    )
    per_row = sources.groupBy(F.col("s.row").alias("row")).agg(
        F.collect_list(F.struct("anchor", "path", "s.start", "s.n", "s.least", "s.branching")).alias("spans")
    )
    read = keys.select("row", "text").join(per_row, "row").mapInArrow(
        _read_sources(window), "anchor long, path long, least long, digest binary, windows array<long>, more array<long>"
    )
    read = materialise(read.dropDuplicates(["anchor", "path"]), "sources")

    opened = read.where("windows IS NOT NULL").select("anchor", "path", "least", F.posexplode(F.arrays_zip("windows", "more")).alias("j", "window"))
    least = opened.groupBy("anchor", "window").agg(F.min("least").alias("m"))
    mins = (
        opened.join(least, ["anchor", "window"])
        .groupBy("anchor", "path")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("mins"))
    )
    verified = read.select("anchor", "path", "digest").join(mins, ["anchor", "path"], "left")
    removals = (
        wanted.join(verified, ["anchor", "path"])
        .where(F.col("mins").isNull() | F.exists("mins", lambda m: m < F.col("id")))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "n", "digest", "mins")).alias("spans"))
    )
    added = T.StructType.fromDDL("_words long, _removed long, _kept string")
    kinds = T.StructType(rows.select("doc", *(["text"] if keep_text else [])).schema.fields + added.fields)
    done = rows.join(removals, "row", "left").mapInArrow(_cut(window, keep_text), kinds)
    return done.select(*(F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns if c in rest or (c == text and keep_text)), *_ADDED)
