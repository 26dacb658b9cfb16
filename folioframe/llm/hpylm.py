"""A hierarchical Pitman-Yor language model, trained and applied over a whole corpus.

Restaurants: one per context, which is the previous word, known by 64 bits of its hash,
and their common parent, which serves words without context.  Tables of the children are
the parent's customers; the parent's base law is diffuse, so its mass is that of a word
never seen.  Seating is sampled by Gibbs sweeps: given all else as the last sweep left it,
the number of tables at which a context seats a word is drawn from its conditional law, by
generalised Stirling numbers, whatever the number of customers.  Predictive probabilities are
averaged over the sweeps after the first.

One pass over the texts sends every (word, context, document) count to the partition of its
word; partitions keep their counts in files of the shared folder.  A sweep reads the (word,
context) counts and the seats of each partition and exchanges the tables of its contexts:
ranges of context hashes are buckets, a bucket adds up what all partitions have of its
contexts and returns the sums to those that have them, in their order, so hashes travel
once.  Seats are drawn from seeded generators, so a lost task repeats itself exactly.  At
the end each partition scores its words, and sums go back by document.

Words of which a sample shows more than a quarter of a partition's share are spread over
all partitions by context; that moves rows, and changes no count.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import arrow_rows, materialise, new_file, new_folder, read_file, shared_dir
from folioframe.llm.text import _P1, NON_SPACE, Words, mix, slices, texts_of

#: Contexts, counted once for each partition that has them, of one bucket.
CONTEXTS = 1 << 20
#: Text bytes that are counted at a time, and whose counts make one partition.
BATCH_BYTES, PARTITION_BYTES = 6_000_000, 10_000_000
#: Texts that go to a worker at a time.
BATCH_ROWS = 1000
SWEEPS, BURN_IN = 3, 1
#: Partitions whose sums one task adds up, and bytes of sums that it holds.
GROUP, HELD_BYTES = 4, 64_000_000
STRENGTH = 1.0
#: Customers up to which Stirling numbers are tabulated by their recurrence, terms of the series
#: that gives those beyond, and weights that are held at a time.
STIRLING, TERMS, HELD_WEIGHTS = 64, 60, 400_000
HOT_WORDS, HOT_SAMPLE = 256, 4000
END, START = np.uint64(0x5EED0E0D), np.uint64(0x57A27)
_DOC_BITS = 20
_CONTEXT_BITS = 32


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned numbers, byte planes one after another, compressed."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a, dtype=np.uint64)
        top = int(a.max()) if len(a) else 0
        wide = max(1, (top.bit_length() + 7) // 8)
        out.append(struct.pack("<QB", len(a), wide))
        out.append(a.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        size, wide = struct.unpack_from("<QB", data, at)
        at += 9
        planes = np.frombuffer(data, np.uint8, size * wide, at).reshape(wide, size)
        a = np.zeros((size, 8), np.uint8)
        a[:, :wide] = planes.T
        out.append(a.view(np.uint64).ravel())
        at += size * wide
    return out


def pack_floats(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, np.float64).tobytes())


def unpack_floats(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.float64)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, hashes of contexts, text numbers."""
    n = w.counts + 1
    ends = np.cumsum(n) - 1
    tok = np.full(int(n.sum()), END, np.uint64)
    word = np.ones(len(tok), bool)
    word[ends] = False
    tok[word] = w.hashes()
    before = np.concatenate(([START], tok[:-1]))
    before[ends[:-1] + 1] = START
    return tok, mix(before + _P1), np.repeat(np.arange(w.n), n)


def _emit(n_parts: int, hot: np.ndarray):
    """(part, batch, blob) rows: counts by partition of their word, and the batch's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                batch = (task << 28) | number
                number += 1
                w = Words(texts_of(b, "text"), NON_SPACE, lower=True)
                tok, ctx, doc = tokens(w)
                train = b.column("train").to_numpy(zero_copy_only=False).astype(np.uint64)
                doc = (doc.astype(np.uint64) << np.uint64(1)) | train[doc]
                part = mix(tok + np.uint64(1)) % np.uint64(n_parts)
                if len(hot):
                    is_hot = np.isin(tok, hot)
                    part[is_hot] = mix(tok[is_hot] + mix(ctx[is_hot] + np.uint64(2))) % np.uint64(n_parts)
                _, first, inverse = np.unique(mix(tok + part * _P1), return_index=True, return_inverse=True)
                word, home = tok[first], part[first]
                contexts, u = np.unique(ctx, return_inverse=True)
                order = np.lexsort((word, home))
                rank = np.empty(len(order), np.uint64)
                rank[order] = np.arange(len(order), dtype=np.uint64)
                doc_bits = np.uint64((2 * w.n).bit_length())  # a slice of one text of any length needs few
                shift = np.uint64(len(contexts).bit_length()) + doc_bits
                rows, count = np.unique((rank[inverse] << shift) | (u.astype(np.uint64) << doc_bits) | doc, return_counts=True)
                r = rows >> shift
                word, home = word[order], home[order]
                words_at = np.searchsorted(home, np.arange(n_parts + 1, dtype=np.uint64))
                rows_at = np.searchsorted(r, words_at.astype(np.uint64))
                per_word = np.bincount(r.astype(np.int64), minlength=len(word))
                parts, blobs = [], []
                for p in np.flatnonzero(np.diff(words_at)):
                    x, y = rows_at[p], rows_at[p + 1]
                    mine = rows[x:y]
                    own, u = np.unique((mine & ((np.uint64(1) << shift) - np.uint64(1))) >> doc_bits, return_inverse=True)
                    d = mine & ((np.uint64(1) << doc_bits) - np.uint64(1))
                    parts.append(int(p))
                    blobs.append(pack([word[words_at[p] : words_at[p + 1]], per_word[words_at[p] : words_at[p + 1]], contexts[own.astype(np.int64)], u, d, count[x:y]]))
                ids = b.column("id")
                there = ids.is_valid().to_numpy(zero_copy_only=False)
                value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                parts.append(n_parts + batch % n_parts)
                blobs.append(pack([value, there, train, w.counts + 1]))
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(parts, pa.int64()), "batch": pa.array([batch] * len(parts), pa.int64()), "blob": pa.array(blobs, pa.binary())}
                )

    return run


@dataclass
class Pairs:
    """The (word, context) pairs of one partition, in order, and their training counts;
    contexts are numbered in the order of their hashes."""

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray

    @staticmethod
    def load(path: str) -> Pairs:
        words, word, context, count = unpack(read_file(path))
        return Pairs(words, word.astype(np.int64), context.astype(np.int64), count.astype(np.int64))


@dataclass
class State:
    """What partitions need to know of each other after a sweep; tables and customers are
    those of a partition's contexts, and empty on the driver."""

    tables: np.ndarray
    hot_tables: dict[int, int]
    total: int
    kinds: int
    discount: float
    parent_discount: float
    customers: np.ndarray = field(repr=False)
    hot_counts: dict[int, int] = field(default_factory=dict)
    tokens: int = 0
    contexts: int = 0


def _merge(folder: str, n_parts: int, hot: np.ndarray):
    """Merges a partition's blobs, writes its files, returns its sums."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= n_parts:
            return pa.table({"kind": ["doc"] * table.num_rows, "key": table.column("batch"), "part": table.column("part"), "blob": table.column("blob")}, schema=_OUT)
        table = table.sort_by("batch")
        # blobs are unpacked twice, one at a time, so that they aren't all held as arrays
        seen_words, seen_contexts = [], []
        for x in table.column("blob"):
            own, _, seen, *_ = unpack(x.as_py())
            seen_words.append(own)
            seen_contexts.append(seen)
        words, contexts = np.unique(np.concatenate(seen_words)), np.unique(np.concatenate(seen_contexts))
        del seen_words, seen_contexts
        pair, doc, count = [], [], []
        for k, x in enumerate(table.column("blob")):
            own, per, seen, u, d, c = unpack(x.as_py())
            at = np.searchsorted(words, own).astype(np.uint64)
            to = np.searchsorted(contexts, seen).astype(np.uint64)
            pair.append((np.repeat(at, per.astype(np.int64)) << np.uint64(_CONTEXT_BITS)) | to[u.astype(np.int64)])
            doc.append(d | np.uint64(k << _DOC_BITS))
            count.append(c.astype(np.uint32))
        del own, per, seen, u, d, c, at, to
        pair = np.concatenate(pair)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        doc = np.concatenate(doc)[order]
        count = np.concatenate(count)[order]
        del order
        start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        trained = np.add.reduceat(count * (doc & np.uint64(1)).astype(np.uint32), start)
        key = pair[start]
        p = Pairs(words, (key >> np.uint64(_CONTEXT_BITS)).astype(np.int64), (key & np.uint64((1 << _CONTEXT_BITS) - 1)).astype(np.int64), trained.astype(np.int64))
        with new_file(f"{folder}/{part}.contexts") as f:
            f.write(pack([contexts]))
        with new_file(f"{folder}/{part}.pairs") as f:
            f.write(pack([p.words, p.word, p.context, p.count]))
        with new_file(f"{folder}/{part}.rows") as f:
            batches = table.column("batch").to_numpy().astype(np.int64).view(np.uint64)
            f.write(pack([batches, np.diff(np.append(start, len(pair))), doc, count]))
        return _sums(part, p, (p.count > 0).astype(np.int64), hot, len(contexts))

    return run


_OUT = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("part", pa.int64()), ("blob", pa.binary())])
_OUT_DDL = "kind string, key long, part long, blob binary"


def _sums(part: int, p: Pairs, t: np.ndarray, hot: np.ndarray, n_contexts: int = 0) -> pa.Table:
    kinds, keys, blobs = [], [], []
    tables = np.bincount(p.word, weights=t, minlength=len(p.words)).astype(np.int64)
    count = np.bincount(p.word, weights=p.count, minlength=len(p.words)).astype(np.int64)
    spread = np.isin(p.words, hot)
    for i in np.flatnonzero(spread):
        kinds.append("hot")
        keys.append(int(p.words[i : i + 1].view(np.int64)[0]))
        blobs.append(pack([np.array([tables[i], count[i]])]))
    rest = tables[~spread]
    kinds.append("sum")
    keys.append(0)
    numbers = [p.count.sum(), (p.count == 1).sum(), (p.count == 2).sum(), (rest > 0).sum(), (rest == 1).sum(), (rest == 2).sum(), t.sum(), n_contexts]
    blobs.append(pack([np.array(numbers)]))
    return pa.table({"kind": kinds, "key": keys, "part": [part] * len(keys), "blob": blobs}, schema=_OUT)


def _add(table: pa.Table) -> pa.Table:
    total: list[np.ndarray] | None = None
    for x in table.column("blob"):
        a = unpack(x.as_py())
        total = a if total is None else [i + j for i, j in zip(total, a)]
    row = {k: [table.column(k)[0].as_py()] for k in ("kind", "key", "part")}
    return pa.table(row | {"blob": [pack(total)]}, schema=_OUT)


def _gather(sums: DataFrame, before: State | None) -> State:
    """The state on the driver: a few numbers, and two for each hot word."""
    some = sums.where("kind IN ('hot', 'sum')").withColumn("part", F.col("part") % 64)
    some = some.groupBy("kind", "key", "part").applyInArrow(_add, _OUT_DDL)
    rows = some.groupBy("kind", "key").applyInArrow(_add, _OUT_DDL).collect()
    hot: dict[int, int] = {}
    hot_counts: dict[int, int] = {}
    n = [0] * 8
    for r in rows:
        a = unpack(bytes(r["blob"]))
        if r["kind"] == "hot":
            hot[r["key"]], hot_counts[r["key"]] = int(a[0][0]), int(a[0][1])
        else:
            n = [int(x) for x in a[0]]
    count, ones, twos, kinds, m1, m2, total, contexts = n
    kinds += sum(x > 0 for x in hot.values())
    discount = lambda x, y: min(0.95, max(0.05, x / (x + 2 * y))) if x + y else 0.5
    return State(
        np.zeros(0, np.int64), hot, total, kinds, discount(ones, twos) if before is None else before.discount, discount(m1, m2),
        np.zeros(0, np.int64), hot_counts, count, contexts,
    )


def stirling(d: float, n: int = STIRLING) -> np.ndarray:
    """ln of the generalised Stirling numbers [customers, tables]."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(n + 1)
    for c in range(1, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)) + s[c], -np.inf)
        s[c + 1, 1:] = np.logaddexp(stay[1:], s[c, :-1])
    return s


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series above 8."""
    small = x < 8
    low = np.where(small, x, 1.0)
    shift = np.where(small, np.log(np.prod([low + i for i in range(8)], axis=0)), 0.0)
    y = np.where(small, x + 8, x)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _saddle(d: float, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """ln of the coefficient of x**count in (1 - (1 - x)**d)**tables, but for terms of the order
    of 1 / tables, from the saddle point; tables < count."""
    low, high = np.full(len(count), -30.0), np.full(len(count), 60.0)  # ln of x / (1 - x)
    for _ in range(70):
        mid = (low + high) / 2
        x, q = 1 / (1 + np.exp(-mid)), 1 / (1 + np.exp(mid))
        under = x * d * q ** (d - 1) * tables < count * -np.expm1(d * np.log(q))
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    g, slope, bend = -np.expm1(d * np.log(q)), d * q ** (d - 1), d * (1 - d) * q ** (d - 2)
    spread = tables * x * (slope / g + x * bend / g - x * (slope / g) ** 2)
    return tables * np.log(g) - count * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


def log_stirling(d: float, count: np.ndarray, tables: int) -> np.ndarray:
    """ln of the generalised Stirling numbers [customers count, 1..tables], for counts above STIRLING.

    S(c, t) = c! / (t! d**t) times the coefficient of x**c in (1 - (1 - x)**d)**t, which the
    binomial theorem makes an alternating sum of gamma functions.  Where t is several times
    c**d that sum cancels out, and the saddle point, fitted to its end, gives the coefficient.
    """
    k = np.arange(1, TERMS + 1)
    t = np.arange(1, tables + 1)
    c = count.astype(np.float64)[:, None]
    turn = np.sin(np.pi * d * k)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        # terms without t, times tables**k, and t (t - 1) ... (t - k + 1) / tables**k
        size = np.log(np.abs(turn) / np.pi) + log_gamma(d * k + 1) - log_gamma(k + 1.0) + log_gamma(c - d * k) - log_gamma(c + 1) + k * np.log(tables)
        left = np.exp(np.minimum(size, 690.0)) * np.where(k % 2 == 1, 1.0, -1.0) * np.sign(turn)
        right = np.cumprod(np.maximum(t[:, None] - np.arange(TERMS), 0) / tables, axis=1)
        total, whole, last = left @ right.T, np.abs(left) @ right.T, np.abs(left[:, -3:]) @ right[:, -3:].T
        sound = np.logical_and.accumulate((total > 1e-9 * whole) & (last < 1e-6 * total) & (t < c), axis=1)
        out = np.log(np.where(sound, total, 1.0))
        end = np.maximum(sound.sum(axis=1), 1)  # t of the last that is sound; the first always is
        row, at = np.nonzero(~sound & (t < c))
        if len(row):
            rows = np.unique(row)
            gap = np.zeros(len(count))
            gap[rows] = out[rows, end[rows] - 1] - _saddle(d, count[rows].astype(np.float64), end[rows].astype(np.float64))
            out[row, at] = _saddle(d, count[row].astype(np.float64), t[at].astype(np.float64)) + gap[row]
        out = log_gamma(c + 1) - log_gamma(t + 1.0) - t * np.log(d) + out
    return np.where(t < c, out, np.where(t == c, 0.0, -np.inf))


def draw_tables(count: np.ndarray, rate: np.ndarray, d: float, rng: np.random.Generator, table: np.ndarray) -> np.ndarray:
    """Tables of pairs of so many customers; rate: weight of a new table, (strength + d * other
    tables) * probability of the word above.

    t tables have the weight S(count, t) * rate**t.  Given many customers, t - 1 is no more than
    a Poisson number of mean rate / d, so few t need a look.
    """
    t = (count > 0).astype(np.int64)
    mean = rate / d
    far = np.minimum(count, np.ceil(mean + 12 * np.sqrt(mean)) + 24).astype(np.int64)
    wide = np.where(count <= STIRLING, count, 1 << np.ceil(np.log2(far + 1)).astype(np.int64))  # as many t for a whole group
    many = np.flatnonzero(count > 1)
    many = many[np.lexsort((count[many], wide[many], count[many] > STIRLING))]
    group = np.stack((count[many] > STIRLING, wide[many]))
    start = np.flatnonzero(np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(axis=0)))) if len(many) else []
    for x, y in zip(start, np.append(start[1:], len(many))):
        n = int(wide[many[x]])
        k = np.arange(1, n + 1)
        step = max(1, HELD_WEIGHTS // n)
        for z in range(x, y, step):
            own = many[z : min(y, z + step)]
            if group[0, x]:
                sizes, at = np.unique(count[own], return_inverse=True)
                law = log_stirling(d, sizes, n)[at]
            else:
                law = table[n, 1 : n + 1]
            w = law + k * np.log(np.maximum(rate[own], 1e-300))[:, None]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[own] = 1 + (w < rng.random(len(own))[:, None] * w[:, -1:]).sum(axis=1)
    return t


def _parent(p: Pairs, t: np.ndarray, s: State) -> np.ndarray:
    """Probabilities of the words in the restaurant without context."""
    tables = np.bincount(p.word, weights=t, minlength=len(p.words))
    for w, n in s.hot_tables.items():
        i = int(np.searchsorted(p.words, np.array([w], np.int64).view(np.uint64)[0]))
        if i < len(p.words) and p.words[i : i + 1].view(np.int64)[0] == w:
            tables[i] = n
    known = (tables - s.parent_discount) / (STRENGTH + s.total)
    unknown = (STRENGTH + s.parent_discount * s.kinds) / (STRENGTH + s.total)
    return np.where(tables > 0, known, unknown)


def _slices(contexts: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of which a partition has contexts, and where its own of each begin and the last end."""
    buckets, at = np.unique(((contexts >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32), return_index=True)
    return buckets.astype(np.int64), np.append(at, len(contexts))


def _sent(part: int, columns: list[np.ndarray], buckets: np.ndarray, at: np.ndarray) -> pa.Table:
    """Columns by context, cut by bucket."""
    n = len(buckets)
    blobs = [pack([c[x:y] for c in columns]) for x, y in zip(at, at[1:])]
    return pa.table({"kind": ["ctx"] * n, "key": buckets, "part": [part] * n, "blob": blobs}, schema=_OUT)


def _keys(folder: str, n_buckets: int):
    """Contexts of each partition, their tables (one a pair) and customers, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("id").to_pylist():
                p, (contexts,) = Pairs.load(f"{folder}/{part}.pairs"), unpack(read_file(f"{folder}/{part}.contexts"))
                tables = np.bincount(p.context, weights=p.count > 0, minlength=len(contexts))
                customers = np.bincount(p.context, weights=p.count, minlength=len(contexts))
                yield from _sent(part, [contexts, tables, customers], *_slices(contexts, n_buckets)).to_batches()

    return run


def _bucket(folder: str, first: bool):
    """Sums of a bucket's contexts over all partitions, back to each partition that has them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        bucket, blobs = table.column("key")[0].as_py(), [unpack(x.as_py()) for x in table.column("blob")]
        at = np.cumsum([0] + [len(x[0]) for x in blobs])
        columns = [np.concatenate(c) for c in zip(*blobs)]
        if first:
            _, to = np.unique(columns.pop(0), return_inverse=True)
            with new_file(f"{folder}/{bucket}.bucket") as f:
                f.write(pack([to]))
        else:
            to = unpack(read_file(f"{folder}/{bucket}.bucket"))[0].astype(np.int64)
        columns = [np.bincount(to, weights=c)[to] for c in columns]
        back = [pack([c[x:y] for c in columns]) for x, y in zip(at, at[1:])]
        return pa.table({"kind": table.column("kind"), "key": table.column("key"), "part": table.column("part"), "blob": pa.array(back, pa.binary())}, schema=_OUT)

    return run


def _receive(folder: str, sweep: int):
    """Writes the sums of a partition's contexts, in order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        columns = [np.concatenate(c) for c in zip(*(unpack(x.as_py()) for x in table.column("blob")))]
        with new_file(f"{folder}/{table.column('part')[0].as_py()}.sums{sweep}") as f:
            f.write(pack(columns))
        return pa.table({"n": pa.array([len(columns[0])], pa.int64())})

    return run


def _exchange(sent: DataFrame, folder: str, sweep: int) -> None:
    back = sent.where("kind = 'ctx'").groupBy("key").applyInArrow(_bucket(folder, sweep == 0), _OUT_DDL)
    back.groupBy("part").applyInArrow(_receive(folder, sweep), "n long").agg(F.sum("n")).collect()


def _seats(folder: str, part: int, p: Pairs, s: int) -> np.ndarray:
    """Tables of the pairs after sweep s; after sweep 0 one each."""
    return unpack(read_file(f"{folder}/{part}.seats{s}"))[0].astype(np.int64) if s else (p.count > 0).astype(np.int64)


def _local(folder: str, part: int, s: int, state: State) -> State:
    """The state with the sums of a partition's contexts after sweep s."""
    tables, customers = unpack(read_file(f"{folder}/{part}.sums0"))
    if s:
        (tables,) = unpack(read_file(f"{folder}/{part}.sums{s}"))
    return replace(state, tables=tables.astype(np.int64), customers=customers.astype(np.int64))


def _sweep(folder: str, shared, hot: np.ndarray, s: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value[0].discount
        law = stirling(d)
        for b in batches:
            for part in b.column("id").to_pylist():
                p = Pairs.load(f"{folder}/{part}.pairs")
                t, last = _seats(folder, part, p, s - 1), _local(folder, part, s - 1, shared.value[s - 1])
                rate = (STRENGTH + d * np.maximum(last.tables[p.context] - t, 0)) * _parent(p, t, last)[p.word]
                t = draw_tables(p.count, rate, d, np.random.Generator(np.random.PCG64([11, part, s])), law)
                with new_file(f"{folder}/{part}.seats{s}") as f:
                    f.write(pack([t]))
                (contexts,) = unpack(read_file(f"{folder}/{part}.contexts"))
                tables = np.bincount(p.context, weights=t, minlength=len(contexts))
                yield from _sums(part, p, t, hot).to_batches()
                yield from _sent(part, [tables], *_slices(contexts, n_buckets)).to_batches()

    return run


def _score(folder: str, shared, burn_in: int):
    """Sums by document over groups of partitions, added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b.column("ids").to_pylist():
                held: dict[int, np.ndarray] = {}
                for part in parts:
                    for batch, sums in _part_sums(folder, part, shared.value, burn_in):
                        held[batch] = _padded_sum(held[batch], sums) if batch in held else sums
                    if sum(x.nbytes for x in held.values()) > HELD_BYTES:
                        yield _held(part, held)
                        held = {}
                if held:
                    yield _held(parts[-1], held)

    return run


def _held(part: int, held: dict[int, np.ndarray]) -> pa.RecordBatch:
    n = len(held)
    blobs = pa.array([pack_floats(x) for x in held.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(["score"] * n), pa.array(list(held), pa.int64()), pa.array([part] * n, pa.int64()), blobs], schema=_OUT)


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    a = a.copy()
    a[:, : b.shape[1]] += b
    return a


def _part_sums(folder: str, part: int, states: list[State], burn_in: int) -> Iterator[tuple[int, np.ndarray]]:
    """(batch, [score, base score, known words] by text) of the words of one partition."""
    p = Pairs.load(f"{folder}/{part}.pairs")
    d = states[0].discount
    mean = np.zeros(len(p.count))
    for s in range(burn_in + 1, len(states)):
        t, state = _seats(folder, part, p, s), _local(folder, part, s, states[s])
        above = _parent(p, t, state)[p.word]
        own = np.maximum(p.count - d * t, 0)
        mean += (own + (STRENGTH + d * state.tables[p.context]) * above) / (STRENGTH + state.customers[p.context])
    mean = np.log10(mean / (len(states) - 1 - burn_in))
    count = np.bincount(p.word, weights=p.count, minlength=len(p.words))
    for w, n in states[0].hot_counts.items():
        i = int(np.searchsorted(p.words, np.array([w], np.int64).view(np.uint64)[0]))
        if i < len(p.words) and p.words[i : i + 1].view(np.int64)[0] == w:
            count[i] = n
    base = np.log10((count + 0.1) / (states[0].tokens + 0.1 * (states[0].kinds + 1)))
    batch, per, doc, n = unpack(read_file(f"{folder}/{part}.rows"))
    per = per.astype(np.int64)
    pair = np.repeat(np.arange(len(per)), per)
    home = (doc >> np.uint64(_DOC_BITS)).astype(np.int64)
    text = ((doc & np.uint64((1 << _DOC_BITS) - 1)) >> np.uint64(1)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(len(batch) + 1))
    for k in range(len(batch)):
        own = order[edges[k] : edges[k + 1]]
        i, times, at = pair[own], n[own].astype(np.float64), text[own]
        w = p.word[i]
        yield int(batch[k : k + 1].view(np.int64)[0]), np.stack([np.bincount(at, weights=times * v) for v in (mean[i], base[w], (count > 0)[w])])


def _assemble(table: pa.Table) -> pa.Table:
    """One row per document of a batch."""
    sums = None
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        if kind == "doc":
            value, there, train, n = unpack(blob)
    sums = np.zeros((3, len(n)))
    parts = sorted((p, b) for k, p, b in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "blob"))) if k == "score")
    for _, blob in parts:
        a = unpack_floats(blob).reshape(3, -1)
        sums[:, : a.shape[1]] += a
    return pa.table(
        {
            "id": pa.array(value.view(np.int64), pa.int64(), mask=there == 0),
            "held_out": pa.array(train == 0),
            "n_tokens": pa.array(n.astype(np.int64)),
            "n_known": pa.array(np.rint(sums[2]).astype(np.int64)),
            "base_score": pa.array(sums[1]),
            "score": pa.array(sums[0]),
        }
    )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent words of each slice of texts, and the number of its words."""
    for whole in batches:
        for b in slices(whole, "text"):
            word, count = np.unique(Words(texts_of(b, "text"), NON_SPACE, lower=True).hashes(), return_counts=True)
            word, count = np.append(word, END), np.append(count, b.num_rows)
            top = np.argsort(-count)[:HOT_WORDS]
            rows = {"word": word[top].view(np.int64), "n": count[top], "all": np.where(np.arange(len(top)) == 0, count.sum(), 0)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})


def _hot_words(rows: DataFrame, n: int, n_parts: int) -> np.ndarray:
    """Hashes of the words that fill more than a quarter of a partition, in a sample of whole
    texts of any length; which they are decides where rows go, and no count."""
    if n_parts == 1:
        return np.empty(0, np.uint64)
    some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n // HOT_SAMPLE))) == 0)
    seen = materialise(some.select("text").mapInArrow(_count_words, "word long, n long, all long"), "hpylm-words")
    total = seen.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    hot = seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * (4 * n_parts) > F.lit(total))
    found = [r[0] for r in hot.orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def score_texts(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs.

    Words are lower-cased (A-Z) and end at white space; each text has one end more.  The
    model learns from the rows of may_learn and scores all (log10 probability, of a known
    word or of the event that a word is unknown).  base_score is that of the unigram model
    with 0.1 added to each count.  Null and empty texts are an end alone; null may_learn is
    false; ids may be null or repeat, and repeated rows score alike.  With nothing to learn
    all scores are 0.  An empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(may_learn, F.lit(False)).alias("train")
    )
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_parts = max(1, -(-size // PARTITION_BYTES))
    hot = _hot_words(rows, n, n_parts)
    folder = shared_dir(spark, "hpylm")
    new_folder(folder)
    counts = rows.mapInArrow(_emit(n_parts, hot), "part long, batch long, blob binary")
    with arrow_rows(spark, BATCH_ROWS):
        sums = materialise(counts.groupBy("part").applyInArrow(_merge(folder, n_parts, hot), _OUT_DDL), "hpylm-sums")
    states = [_gather(sums, None)]
    ids = sorted(r[0] for r in sums.where("kind = 'sum'").select("part").collect())
    parts = spark.createDataFrame([(i,) for i in ids], "id long").repartition(max(1, len(ids)))
    n_buckets = max(1, -(-states[0].contexts // CONTEXTS))
    _exchange(parts.mapInArrow(_keys(folder, n_buckets), _OUT_DDL), folder, 0)
    for s in range(1, sweeps + 1):
        shared = spark.sparkContext.broadcast(states)  # two numbers a hot word and sweep
        swept = materialise(parts.mapInArrow(_sweep(folder, shared, hot, s, n_buckets), _OUT_DDL), "hpylm-sweep")
        states.append(_gather(swept, states[0]))
        _exchange(swept, folder, s)
    shared = spark.sparkContext.broadcast(states)
    groups = [(ids[i : i + GROUP],) for i in range(0, len(ids), GROUP)]
    scored = spark.createDataFrame(groups, "ids array<long>").repartition(max(1, len(groups))).mapInArrow(_score(folder, shared, burn_in), _OUT_DDL)
    done = sums.where("kind = 'doc'").unionByName(scored).groupBy("key").applyInArrow(
        _assemble, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return done.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(states[0].tokens).cast("long"))
