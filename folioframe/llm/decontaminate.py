"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the normalised words of all items of one block of the
benchmark.  A document streams through it word by word; the length of the longest
match that ends at each word is tracked, and wherever it reaches a window (ten
words, or a whole item of fewer) the words of the window are hit.  Words between
which no item has that pair of neighbours can't lie inside a window, so only runs
of known neighbours are streamed; that changes no result.

A benchmark larger than BLOCK_BYTES of text is cut into blocks of items, each with
its own automaton; documents then pass through one after another.  What one pass finds
is written to the shared folder before the next automaton is built, so the driver and
the executors hold one at a time, whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import materialise
from folioframe.llm.text import _P1, ALNUM, Words, mix, slices, texts_of

#: Bytes of item text in one automaton, whose broadcast is at most some 100 times that.
BLOCK_BYTES = 1_000_000
WINDOW = 10


class SuffixAutomaton:
    """Words of several items; ``items[v]`` are those in which state v occurs.  An item may have no name (None)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.ids: dict[bytes, int] = {}
        whole: list[tuple[str, list[int]]] = []
        pairs: set[tuple[int, int]] = set()
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            t = [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(zip(t, t[1:]))
            self.shortest = min(self.shortest, len(t))
            last = 0
            for c in t:
                last = self._extend(last, c)
                self.items[last].add(name)
            if len(t) < window:
                whole.append((name, t))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.items[self.link[v]] |= self.items[v] if self.link[v] > 0 else set()
        #: Whole items shorter than a window, by the state of their words.
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, t in whole:
            v = 0
            for c in t:
                v = self.next[v][c]
            self.short.setdefault(v, {}).setdefault(len(t), set()).add(name)
        keys = Words([w for w in self.ids], np.ones(256, bool) & ALNUM).hashes()
        self.word_keys = np.unique(keys)
        p = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pair_keys = np.unique(pair_hash(keys[p[:, 0]], keys[p[:, 1]]))
        self.has_pair, self.has_word = KeySet(self.pair_keys), KeySet(self.word_keys)

    def _state(self, length: int, link: int, edges: dict[int, int], items: set[str]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.items.append(items)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest words of p followed by c, cut from q."""
        made = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), set())
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, 0, {}, set()), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges (start, end) of a run of words, and the items that hit."""
        v = long = 0
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, w in enumerate(words):
            c = self.ids.get(w)
            if c is None:
                v = long = 0
                continue
            while v and c not in self.next[v]:
                v = self.link[v]
                long = self.length[v]
            v = self.next[v].get(c, 0)
            long = long + 1 if v else 0
            if not v:
                continue
            u, best = v, 0
            while u > 0:  # the states of all suffixes of the match
                if best == 0 and self.length[self.link[u]] < self.window <= min(long, self.length[u]):
                    best = self.window
                    found |= self.items[u]
                for n, names in self.short.get(u, {}).items():
                    if n <= long:
                        best = max(best, n)
                        found |= names
                if self.length[self.link[u]] < self.shortest:
                    break
                u = self.link[u]
            if best:
                hits.append((i + 1 - best, i + 1))
        return hits, found


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _P1 + b)


class KeySet:
    """Sorted 64-bit keys; membership is looked up in a table of their leading bits first, which
    is made where it is wanted and doesn't travel."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - min(24, max(8, 4 + len(keys).bit_length())))
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def holds(self, values: np.ndarray) -> np.ndarray:
        if len(self.keys) == 0:
            return np.zeros(len(values), bool)
        if self.table is None:
            self.table = np.zeros(1 << (64 - int(self.shift)), bool)
            self.table[self.keys >> self.shift] = True
        out = self.table[values >> self.shift]
        at = np.flatnonzero(out)
        got = np.searchsorted(self.keys, values[at])
        out[at] = self.keys[np.minimum(got, len(self.keys) - 1)] == values[at]
        return out


def candidate_runs(w: Words, sam: SuffixAutomaton) -> Iterator[tuple[int, int]]:
    """Ranges of words of one document, in which each neighbouring pair is one of an item's."""
    h, n = w.hashes(), len(w.starts)
    if n == 0:
        return
    joined = np.zeros(n + 1, bool)  # joined[i]: words i-1 and i belong to one run
    joined[1:n] = sam.has_pair.holds(pair_hash(h[:-1], h[1:]))
    joined[w.first[(w.first > 0) & (w.first < n)]] = False
    start = np.flatnonzero(~joined[:n])
    end = np.append(start[1:], n)
    keep = end - start >= sam.shortest
    if sam.shortest == 1:
        keep &= (end - start > 1) | sam.has_word.holds(h[start])
    yield from zip(start[keep].tolist(), end[keep].tolist())


def scan(texts: list[bytes | None], sam: SuffixAutomaton) -> list[tuple[int, list[tuple[int, int]], set[str | None]]]:
    """Per text: number of words, hit ranges of words (disjoint, in order), items."""
    w = Words(texts, ALNUM, lower=True)
    found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(int(c), [], set()) for c in w.counts]
    for start, end in candidate_runs(w, sam):
        hits, items = sam.stream([w.word(i) for i in range(start, end)])
        if hits:
            doc = int(np.searchsorted(w.first, start, "right")) - 1
            base = start - int(w.first[doc])
            found[doc][1].extend((base + a, base + b) for a, b in hits)
            found[doc][2].update(items)
    return [(n, merge(hits), items) for n, hits, items in found]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of items; the driver holds one block at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).distinct()
    for name, t in rows.toLocalIterator():
        w = Words([t.encode()], ALNUM, lower=True)
        held.append((name, [w.word(i) for i in range(len(w.starts))]))
        size += len(t.encode())
        if size >= BLOCK_BYTES:
            yield SuffixAutomaton(held, window)
            held, size = [], 0
    if held:
        yield SuffixAutomaton(held, window)


_HITS = "array<struct<start:int,end:int>>"


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, drop_text: bool = False
) -> DataFrame:
    """Columns of docs (without the text if drop_text) and _words (bigint), _hits (ranges of word numbers), _items.

    Null and empty texts have no words and no hits; items without words have no
    window; several items of one id count as that id; those of null id as one item of
    no name (null, last in _items).  Columns of docs named like the results are replaced.
    """
    finish = (lambda b: b.drop_columns([text])) if drop_text else None
    return _scan_blocks(docs, blocks_of(benchmark, item, item_text, window), text, window, finish, [text] if drop_text else [])


def _scan_blocks(docs: DataFrame, blocks: Iterator[SuffixAutomaton], text: str, window: int, finish, gone: list[str]) -> DataFrame:
    """docs through the automata one after another; finish(batch) follows the last.

    All but the last pass are written to the shared folder, and their automata freed.
    """
    out = docs.drop("_words", "_hits", "_items").withColumns(
        {"_words": F.lit(0).cast("long"), "_hits": F.array().cast(_HITS), "_items": F.array().cast("array<string>")}
    )
    sam = next(blocks, SuffixAutomaton([], window))
    while sam is not None:
        after = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(sam)
        last = after is None
        out = out.mapInArrow(_scanner(shared, text, finish if last else None), out.drop(*gone).schema if last else out.schema)
        if not last:
            out = materialise(out, "scanned")
            shared.destroy()
        sam = after
    return out


def _scanner(shared, text: str, finish):
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = shared.value
        for whole in batches:
            for b in slices(whole, text):
                hits, items, words = [], [], []
                before = zip(b.column("_hits").to_pylist(), b.column("_items").to_pylist())
                for (n, h, i), (h0, i0) in zip(scan(texts_of(b, text), sam), before):
                    words.append(n)
                    all_hits = merge(h + [(x["start"], x["end"]) for x in h0]) if h0 else h
                    hits.append([{"start": a, "end": e} for a, e in all_hits])
                    items.append(sorted(i | set(i0), key=lambda x: (x is None, x)))
                cols = dict(zip(b.schema.names, b.columns))
                cols["_words"] = pa.array(words, pa.int64())
                cols["_hits"] = pa.array(hits, b.schema.field("_hits").type)
                cols["_items"] = pa.array(items, b.schema.field("_items").type)
                done = pa.RecordBatch.from_pydict(cols)
                yield finish(done) if finish else done

    return scan_batches


def n_hit() -> Column:
    """Number of hit words."""
    return F.aggregate("_hits", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]).cast("long"))


def cut_spans(text: bytes, hits: list[tuple[int, int]]) -> str:
    """The text without the hit words and what stands between them."""
    w = Words([text], ALNUM, lower=True)
    out, at = [], 0
    for a, b in hits:
        out.append(text[at : int(w.starts[a]) - 1])  # the buffer begins with a separator
        at = int(w.starts[b - 1] + w.lens[b - 1]) - 1
    out.append(text[at:])
    return b"".join(out).decode("utf-8")


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_span: int = WINDOW, max_coverage: float = 0.2, **names
) -> DataFrame:
    """Documents without their benchmark passages.

    Spans of max_span words or more that match an item are cut out (an item of
    fewer words counts as a whole).  A document of which more than max_coverage
    of the words are hit is dropped.  Clean documents come back unchanged.
    """

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        hits = [[(x["start"], x["end"]) for x in h] for h in b.column("_hits").to_pylist()]
        keep = [sum(e - a for a, e in h) <= n * max_coverage for h, n in zip(hits, b.column("_words").to_pylist())]
        if any(hits):
            cut = [cut_spans(t, h) if h else None if t is None else t.decode() for t, h in zip(texts_of(b, text), hits)]
            b = b.set_column(b.schema.get_field_index(text), text, pa.array(cut, b.schema.field(text).type))
        return b.filter(pa.array(keep, pa.bool_()))

    blocks = blocks_of(benchmark, names.get("item", "item_id"), names.get("item_text", "text"), max_span)
    return _scan_blocks(docs, blocks, text, max_span, finish, []).select(docs.columns)
