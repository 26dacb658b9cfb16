"""Vectorised word primitives shared by the operators that run in Python workers.

Texts of an Arrow batch are laid end to end in one byte buffer, a separator
between them, and words, their hashes and their documents are found with array
operations.  Both word classes used here are decided byte by byte (every byte of
a multi-byte UTF-8 character is a word byte), so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ALL = np.arange(256)
#: Bytes of ``[^\x20\x09-\x0D]``.
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)

_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xBF58476D1CE4E5B9)
_P3 = np.uint64(0x94D049BB133111EB)
_LONG_WORD = 4096
_PAD = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _P2
    h ^= h >> np.uint64(27)
    h *= _P3
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``max_bytes`` (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lens.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a list of texts (bytes or None): ``starts``, ``lens`` and, for
    text i, the range ``first[i]:first[i + 1]`` of its words."""

    def __init__(self, texts: list[bytes | None], word_bytes: np.ndarray, lower: bool = False):
        raw = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n" + bytes(_PAD)
        buf = np.frombuffer(raw, dtype=np.uint8)
        if lower:
            buf = LOWER[buf]
            raw = buf.tobytes()
        self.raw, self.n = raw, len(texts)
        used = len(raw) - _PAD
        mask = word_bytes[buf[:used]]
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        self.starts = edge[0::2]
        self.lens = edge[1::2] - self.starts
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        begin = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, begin)
        self.counts = np.diff(self.first)

    def word(self, i: int) -> bytes:
        s = int(self.starts[i])
        return self.raw[s : s + int(self.lens[i])]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words, eight bytes of all words at a time."""
        n = len(self.starts)
        h = mix(self.lens.astype(np.uint64) * _P1 + np.uint64(seed))
        if n == 0:
            return h
        lanes = np.ndarray((len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        usual = self.lens <= _LONG_WORD
        idx = None if usual.all() else np.flatnonzero(usual)
        at, left = (self.starts, self.lens) if idx is None else (self.starts[idx], self.lens[idx])
        cur = h if idx is None else h[idx]
        live = idx
        while len(at):
            lane = lanes[at] & _MASK[np.minimum(left, 8)]
            cur = mix((cur ^ lane) * _P1 + _P3)
            if live is None:
                h = cur
            else:
                h[live] = cur
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left, cur = at[more] + 8, left[more] - 8, cur[more]
        for i in np.flatnonzero(~usual):
            h[i] = xxhash.xxh3_64_intdigest(self.word(i), seed)
        return h


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return batch.column(column).cast(kind).to_pylist()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; the caller drops those across documents."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * _P1 + h[i : i + n])
    return out
