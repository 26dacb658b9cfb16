"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is decoded, split and encoded alone; those that
are one pre-token and come back as their own single id are *proven*.  A text is
split into pre-tokens; proven ones count one, and only the rest is merged (by the
tokenizer library, each distinct pre-token once while it stays in a bounded memo).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of byte-level BPE vocabularies with the GPT-2 pre-tokenizer. Python's
#: \s also takes U+001C-U+001F; the library's doesn't, so the class is spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Distinct pre-tokens that a worker remembers; beyond it the memo starts anew.
MEMO = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_as_expected(path: str) -> bool:
    """Whether the file is a BPE without normalizer whose pre-tokenizer is the byte-level one,
    splitting by PATTERN and adding no space: then a text's tokens are those of its pre-tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    return bool(plain and spec.get("normalizer") is None and (spec.get("model") or {}).get("type", "BPE") == "BPE")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes
    for the code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and one token alone."""
    tok, split, byte = _tokenizer(path), regex.compile(PATTERN), _byte_of_char()
    special = {str(t.content) for t in tok.get_added_tokens_decoder().values()}
    strings = []
    for entry, number in tok.get_vocab(with_added_tokens=False).items():
        try:
            s = bytes(byte[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if s not in special and split.findall(s) == [s]:
            strings.append((s, number))
    alone = tok.encode_batch([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, number), e in zip(strings, alone) if e.ids == [number])


def count_batch(texts: list[str | None], path: str, memo: dict[str, int], proven: frozenset[str]) -> list[int]:
    tok, split = _tokenizer(path), regex.compile(PATTERN)
    special = [str(t.content) for t in tok.get_added_tokens_decoder().values()]
    out = []
    for t in texts:
        if not t:
            out.append(0)
        elif any(s in t for s in special):  # special strings are cut out before the split
            out.append(len(tok.encode(t, add_special_tokens=False).ids))
        else:
            n = 0
            for at in _pieces(t, split):
                if len(memo) > MEMO:
                    memo.clear()
                    memo.update(dict.fromkeys(proven, 1))
                rest = [p for p in set(at) if p not in memo]
                if rest:
                    for p, e in zip(rest, tok.encode_batch(rest, add_special_tokens=False)):
                        memo[p] = len(e.ids)
                n += sum(map(memo.__getitem__, at))
            out.append(n)
    return out


def _pieces(text: str, split, size: int = 200_000) -> Iterator[list[str]]:
    """Pre-tokens of a text in lists of bounded length."""
    if len(text) <= 4 * size:
        yield split.findall(text)
        return
    held = []
    for m in split.finditer(text):
        held.append(m.group())
        if len(held) == size:
            yield held
            held = []
    yield held


def token_count(spark: SparkSession, text: Column, path: str) -> Column:
    """Number of tokens of a text, as a bigint column.

    path: a tokenizers .json file of a byte-level BPE, readable by the driver and
    all executors; a file that splits text otherwise is an error.  Null and empty texts have
    0.  Special strings inside a text count as the library's default does (one token each);
    no text is truncated.  Equal texts have equal counts; only the text is read.
    """
    if not splits_as_expected(path):
        raise ValueError(f"{path} isn't a byte-level BPE that splits as this operator does")
    proven = spark.sparkContext.broadcast(prove_whole_tokens(path))  # at most the vocabulary

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = dict.fromkeys(proven.value, 1)
        for a in batches:
            yield pa.array(count_batch(a.to_pylist(), path, memo, proven.value), pa.int64())

    return count(text)
