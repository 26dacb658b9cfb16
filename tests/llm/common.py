"""Small documents with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, target string, class_id long, _row string, spans int"
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    t = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", t.translate(_LOW) if lower else t)


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def texts(seed=1, n=40, vocab=None):
    """Random texts, exact copies, near copies, shared passages, empty and long ones."""
    rng = random.Random(seed)
    v = vocab or vocabulary(seed)
    passage = " ".join(rng.choice(v) for _ in range(70))
    out: list[str | None] = []
    for i in range(n):
        body = [rng.choice(v) for _ in range(rng.choice([3, 20, 90, 150]))]
        if i % 7 == 3:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        out.append(" ".join(body))
    out += [out[5], out[5], out[8]]
    near = out[2 if len(words(out[2])) > 80 else max(range(n), key=lambda i: len(out[i]))].split()
    near[1] = "changed"
    out.append(" ".join(near))
    out += [None, None, "", "", "   \t\n", "x", "Ünï ß 中文字 один", " ".join(rng.choice(v) for _ in range(6000)), "w" * 9000, "a\x00b c\x1fd", "a a a a " * 60]
    return out


def documents(spark, seed=1, n=40):
    rows = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "", "s1"][i % 5], len(t or ""), i, "x", "y", 0, "z", 1) for i, t in enumerate(texts(seed, n))]
    rows += [(None, "no id here", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[4], rows[4]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
