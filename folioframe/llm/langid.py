"""Language identification by interpolated Kneser-Ney character models.

One model per language, over the letters of words (lower case, a space before and
after; all else is space).  The n-grams of all languages stand in one sorted array of
hashes per order, with a column of log probabilities per language, and so do their
contexts with the back-off weights.  A text goes to the language of least cross-entropy
per character (of languages that tie, the first by name); it is rejected where that exceeds
what labelled texts of that language, which the model didn't learn from, show.

As contexts end at the word's beginning, a word has the same probability wherever it
stands, and each distinct word of a batch is scored once.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.text import _P1, mix

ORDER = 5
#: The bounded sample a model is fitted on: documents and characters per language (texts
#: of more characters are not drawn), half of them again for calibration.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 3_000_000
#: Rejected above that QUANTILE of the cross-entropies of the language's calibration texts times
#: SLACK, so that a few mislabelled texts don't set the limit, and SHORT nats more for a text of
#: one character, falling with the root of its length: a short text's cross-entropy says little.
QUANTILE, SLACK, SHORT = 0.98, 1.6, 6.0
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point to lower-case letter or mark, or 0; bit 31 marks letters."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
            if kind == "L":
                table[c] |= np.uint32(1 << 31)
    return table


_LOW = np.uint32((1 << 31) - 1)


class Chars:
    """Words of texts as runs of symbols in one array, a 0 before each and after the last."""

    def __init__(self, texts: list[str | None], table: np.ndarray):
        raw = np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        sym = table[raw]
        letters = np.concatenate(([0], np.cumsum(sym >> np.uint32(31), dtype=np.int64)))
        self.letters = letters[begin[1:]] - letters[begin[:-1]]
        sym = sym & _LOW
        keep = sym != 0
        keep[1:] |= sym[:-1] != 0
        keep[0] = True
        self.sym = sym[keep].astype(np.uint64)
        zero = np.flatnonzero(self.sym == 0)
        self.starts, self.lens = zero[:-1], np.diff(zero)  # a word's space, and letters with it
        place = np.cumsum(keep)[begin[:-1]] - 1  # the last symbol kept up to the text's separator
        self.first = np.append(np.searchsorted(self.starts, place), len(self.starts))

    def keys(self) -> np.ndarray:
        """Hashes of the words, wherever they stand."""
        weight = mix(self.sym + np.uint64(7))
        ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weight * _powers(len(weight)), dtype=np.uint64)))
        return (ends[self.starts + self.lens] - ends[self.starts]) * _powers(len(weight) + 1, True)[self.starts] * _P1 + self.lens.astype(np.uint64)


def _grams(sym: np.ndarray, starts: np.ndarray, lens: np.ndarray):
    """Symbols to predict (letters and closing spaces), their distance from the word's
    opening space, and hashes of the n symbols up to each: a list by n, from 0."""
    at = np.repeat(starts, lens) + _ranges(lens) + 1
    depth = _ranges(lens) + 1
    out = [np.zeros(len(at), np.uint64)]
    for n in range(1, ORDER + 1):
        back = np.maximum(at - (n - 1), 0)
        out.append(mix(out[-1] * _P1 + sym[back] + np.uint64(1)))
    return at, depth, out


def _ranges(lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens)


class HashArray:
    """Sorted 64-bit keys with an index of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        edges[-1] = 2.0**64 - 2048
        self.at = np.searchsorted(keys, edges.astype(np.uint64)).astype(np.int32)
        self.at[-1] = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where absent."""
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.at[bucket], self.at[bucket + 1]
        out = np.full(len(h), -1, np.int64)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            same = self.keys[at] == h
            out[todo[same]] = at[same]
            on = ~same & (at + 1 < end)
            todo, at, end, h = todo[on], at[on] + 1, end[on], h[on]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: list[HashArray]  # by order, from 1
    logp: list[np.ndarray]  # [gram, language]
    contexts: list[HashArray]
    backoff: list[np.ndarray]
    unseen: np.ndarray | float  # ln probability of a symbol that no language has
    limit: np.ndarray  # by language, in nats a character
    table: np.ndarray

    def word_scores(self, c: Chars, words: np.ndarray) -> np.ndarray:
        """Natural-log probabilities [word, language]."""
        starts, lens = c.starts[words], c.lens[words]
        at, depth, h = _grams(c.sym, starts, lens)
        # hashes run from the symbol backwards; a context is the same run without the symbol itself
        total = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            ready = depth[todo] >= n - 1
            idx = todo[ready]
            found = self.grams[n].find(h[n][idx])
            hit = found >= 0
            total[idx[hit]] += self.logp[n][found[hit]]
            miss = idx[~hit]
            if n > 1:
                ctx = self.contexts[n].find(_context(c.sym, at[miss], n))
                known = ctx >= 0
                total[miss[known]] += self.backoff[n][ctx[known]]
            todo = np.concatenate((todo[~ready], miss))
        total[todo] += self.unseen
        ends = np.cumsum(lens)
        return np.add.reduceat(total.astype(np.float64), ends - lens, axis=0) if len(lens) else np.zeros((0, len(self.languages)))

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character [text, language], characters, letters."""
        c = Chars(texts, self.table)
        _, first, inverse = np.unique(c.keys(), return_index=True, return_inverse=True)
        scores = self.word_scores(c, first)
        n_chars = np.concatenate(([0], np.cumsum(c.lens)))
        chars = n_chars[c.first[1:]] - n_chars[c.first[:-1]]
        sums = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            line = np.concatenate(([0.0], np.cumsum(scores[inverse, k])))
            sums[:, k] = line[c.first[1:]] - line[c.first[:-1]]
        return -sums / np.maximum(chars, 1)[:, None], chars, c.letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected.

        score: the probability of the language among all, were each text 50 characters at most.
        A model that learned no language rejects only texts without a letter.
        """
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), Chars(texts, self.table).letters == 0
        h, chars, letters = self.cross_entropy(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        score = 1 / np.exp(-(h - low[:, None]) * np.minimum(chars, 50)[:, None]).sum(axis=1)
        none = letters == 0
        names = [UNDETERMINED if x else self.languages[b] for x, b in zip(none, best)]
        return names, np.where(none, 0.0, score), none | (low > self.limit[best] + SHORT / np.sqrt(np.maximum(chars, 1)))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0xD6E8FEB86659FD93
    p = np.full(n, np.uint64(pow(base, -1, 1 << 64) if inverse else base))
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def _context(sym: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n - 1 symbols before each place."""
    h = np.zeros(len(at), np.uint64)
    for k in range(1, n):
        h = mix(h * _P1 + sym[np.maximum(at - k, 0)] + np.uint64(1))
    return h


def _distinct_words(texts: list[str], table: np.ndarray, at_once: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the distinct words of texts, one after another and a 0 at the end; where each
    begins, its length, and how often it comes.  Few texts are held as symbols at a time."""
    runs, sizes, keys, counts = [], [], [], []
    for i in range(0, len(texts), at_once):
        c = Chars(texts[i : i + at_once], table)
        key, first, times = np.unique(c.keys(), return_index=True, return_counts=True)
        starts, lens = c.starts[first], c.lens[first]
        runs.append(c.sym[np.repeat(starts, lens) + _ranges(lens)])
        sizes.append(lens)
        keys.append(key)
        counts.append(times)
    none = np.empty(0, np.int64)
    key, lens, times = np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *sizes]), np.concatenate([none, *counts])
    starts = np.cumsum(lens) - lens
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    sym = np.concatenate([*runs, np.zeros(1, np.uint64)])
    return sym, starts[first], lens[first], np.bincount(inverse, weights=times, minlength=len(first)).astype(np.int64)


def fit(samples: dict[str, list[str]], table: np.ndarray) -> Model:
    """Models of all languages from their texts."""
    languages = sorted(samples)
    if not languages:
        return Model([], [], [], [], [], 0.0, np.zeros(0), table)
    seen: list[dict[int, tuple]] = []
    for name in languages:
        sym, starts, lens, times = _distinct_words(samples[name], table)
        at, depth, h = _grams(sym, starts, lens)
        times = np.repeat(times, lens)
        by = {}
        for n in range(ORDER, 0, -1):
            ok = depth >= n - 1
            keys, one, inv = np.unique(h[n][ok], return_index=True, return_inverse=True)
            place = at[ok][one]
            raw = np.bincount(inv, weights=times[ok])
            if n < ORDER:  # how many letters precede; a word's beginning is never preceded
                longer = by[n + 1]
                cont = np.zeros(len(keys))
                np.add.at(cont, np.searchsorted(keys, longer[4]), 1)
                opens = depth[ok][one] == n - 1
                raw = np.where(opens, raw, np.maximum(cont, 1))
            by[n] = (keys, raw, _context(sym, place, n), place, _suffix(sym, place, n - 1))
        seen.append(by)
    grams, logp, contexts, backoff = [None], [None], [None], [None]
    symbols = len(np.unique(np.concatenate([b[1][0] for b in seen])))
    unseen = float(np.log(1 / (symbols + 1)))
    lower_keys, lower_p = None, None
    for n in range(1, ORDER + 1):
        keys, where = np.unique(np.concatenate([b[n][0] for b in seen]), return_index=True)
        ctx_of = np.concatenate([b[n][2] for b in seen])[where]
        suffix = np.concatenate([b[n][4] for b in seen])[where]
        ctx = np.unique(ctx_of)
        p, back = np.zeros((len(keys), len(languages))), np.zeros((len(ctx), len(languages)))
        below = np.exp(unseen) * np.ones((len(keys), len(languages))) if n == 1 else lower_p[np.searchsorted(lower_keys, suffix)]
        for k, b in enumerate(seen):
            own, count, own_ctx = b[n][0], b[n][1], b[n][2]
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            group = np.searchsorted(ctx, own_ctx)
            whole = np.bincount(group, weights=count, minlength=len(ctx))
            kinds = np.bincount(group, minlength=len(ctx))
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(whole > 0, d * kinds / whole, 1.0)
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, own)] = np.maximum(count - d, 0)
            g = np.searchsorted(ctx, ctx_of)
            p[:, k] = np.where(whole[g] > 0, c / np.maximum(whole[g], 1), 0) + w[g] * below[:, k]
            back[:, k] = np.log(w)
        grams.append(HashArray(keys))
        logp.append(np.log(p).astype(np.float32))
        contexts.append(HashArray(ctx))
        backoff.append(back.astype(np.float32))
        if n == 1:  # an unseen symbol backs off from the empty context
            first_back = back[0]
        lower_keys, lower_p = keys, p
    return Model(languages, grams, logp, contexts, backoff, (unseen + first_back).astype(np.float32), np.full(len(languages), np.inf), table)


def _suffix(sym: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n symbols up to each place."""
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * _P1 + sym[np.maximum(at - k, 0)] + np.uint64(1))
    return h


def train(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages that the rows of may_learn are labelled with.

    At most SAMPLE_DOCS whole texts and SAMPLE_CHARS characters per language are drawn
    for the model and half as many for calibration, by a hash of the text, each text once
    however many copies it has; the driver holds no more.  Rows without text or label teach
    nothing.  A language with too few texts to hold any back is calibrated on what it learned.
    """
    n = F.char_length(text)
    rows = docs.where(may_learn).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), n.alias("n"))
    counts = docs.where(may_learn & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count().collect()
    samples: dict[str, list[str]] = {}
    held_back: dict[str, list[str]] = {}
    if counts:
        share = F.create_map(*(F.lit(x) for r in counts for x in (r["l"], 2.0 * SAMPLE_DOCS / r["count"])))
        unit = F.shiftrightunsigned(F.xxhash64("t", F.lit(9)), 11) / F.lit(float(1 << 53))
        drawn = rows.where((F.col("n") <= SAMPLE_CHARS // 8) & (unit < share[F.col("l")])).select("l", "t", F.xxhash64("t").alias("h")).distinct()
        size: dict[str, list[int]] = {}
        for r in drawn.orderBy("h").toLocalIterator():
            used = size.setdefault(r["l"], [0, 0, 0, 0])
            to_fit = used[0] <= 2 * used[2]
            into, k = (samples, 0) if to_fit else (held_back, 2)
            part = 1 if to_fit else 2
            if used[k] < SAMPLE_DOCS // part and used[k + 1] + len(r["t"]) <= SAMPLE_CHARS // part:
                into.setdefault(r["l"], []).append(r["t"])
                used[k] += 1
                used[k + 1] += len(r["t"])
    model = fit(samples, symbol_table())
    for k, name in enumerate(model.languages):
        lows = [np.zeros(0)]
        checked = held_back.get(name) or samples[name]
        for i in range(0, len(checked), 50):
            h, chars, letters = model.cross_entropy(checked[i : i + 50])
            lows.append(h.min(axis=1)[(letters > 0) & (chars >= 20)])
        found = np.concatenate(lows)
        if len(found):
            model.limit[k] = np.quantile(found, QUANTILE) * SLACK
    return model


def predict_language(docs: DataFrame, model: Model, text: str = "text", once: bool = False) -> Column:
    """Struct column (lang, score, rejected) of a text.

    Null texts and texts without a letter are "und", score 0, rejected.  Texts of any
    length are read whole.  Only the text is read, no other column.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            names, scores, rejected = [], [], []
            sizes = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 3_000_000, "right")))
                x, y, z = shared.value.predict(a.slice(at, to - at).to_pylist())
                names += x
                scores += y.tolist()
                rejected += z.tolist()
                at = to
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return (run.asNondeterministic() if once else run)(F.col(text))  # so that no filter takes it along


def with_language(docs: DataFrame, model: Model, out: str, text: str = "text") -> DataFrame:
    """docs and the struct column out (in place of one of that name), computed once however
    often it is named after."""
    return docs.withColumn(out, predict_language(docs, model, text, once=True))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
