"""Fidelity of Markdown against a gold text: tokens, order, structure."""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_TOKENS = 12_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _f1(gold: pa.Array, candidate: pa.Array) -> pa.Array:
    words = lambda t: re.findall("[a-z0-9]+", (t.as_py() or "").lower())
    return pa.array([_bag_f1(words(a), words(b)) for a, b in zip(gold, candidate)], pa.float64())


def token_f1(pairs: DataFrame, key: str, gold: str, candidate: str) -> DataFrame:
    """(key, f1) of each row: F1 of the bags of tokens; two empty sides are alike.

    A bag lies in its row, so no row meets another.
    """
    return pairs.select(key, F.arrow_udf(_f1, "double")(gold, candidate).alias("f1"))


def normalise(text: str) -> str:
    """NFKC, lower case, without comments, tags, emphasis and link targets."""
    t = unicodedata.normalize("NFKC", text)
    t = re.sub(r"(?s)<!--.*?-->", " ", t)
    t = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"<[^>]+>", " ", t)
    t = re.sub(r"[*_`~]+", "", t)
    for a, b in (("[‘’‚]", "'"), ("[“”„]", '"'), ("[–—−]", "-")):
        t = re.sub(a, b, t)
    return t.lower()


def skeleton(md: str) -> dict:
    """Headings, list items, tables and text of Markdown."""
    out = {"headings": [], "lists": [], "tables": [], "code": 0}
    text, fence, grid = [], "", []
    for line in [*md.split("\n"), ""]:
        m = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            fence = "" if m and m[1].startswith(fence) else fence
            continue
        if m:
            fence, out["code"] = m[1], out["code"] + 1
        row = re.fullmatch(r"\s*\|(.*)\|\s*", line)
        if row:
            cells = [c.strip() for c in re.split(r"(?<!\\)\|", row[1])]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                grid.append(cells)
        elif grid:
            out["tables"].append(grid)
            grid = []
        if h := re.match(r"\s{0,3}(#{1,6})\s+(.*)", line):
            out["headings"].append(normalise(h[2]).strip())
        elif item := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            out["lists"].append(normalise(item[1]).strip())
        text.append(line)
    out["tokens"] = re.findall(r"[a-z0-9]+", normalise("\n".join(text)))
    return out


def _bag_f1(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def _recall(gold: list[str], found: list[str]) -> float:
    """Share of gold that is found, more than 0.9 alike; what is found as it is needs no comparing."""
    if not gold:
        return 1.0
    same, others = set(found), sorted(set(found), key=len)
    sizes = [len(f) for f in others]
    hit = 0
    for g in gold:
        # 2 * common / (a + b) > 0.9 needs lengths within 11 : 9
        near = () if g in same else others[bisect.bisect_left(sizes, len(g) * 9 / 11) : bisect.bisect_right(sizes, len(g) * 11 / 9)]
        hit += g in same or any(_alike(g, f) for f in near)
    return hit / len(gold)


def _alike(a: str, b: str) -> bool:
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() > 0.9 and m.quick_ratio() > 0.9 and m.ratio() > 0.9


def pair_truth(sources: DataFrame, truths: DataFrame, path: str = "path") -> DataFrame:
    """sources with truth, the path of the gold text: name.ext.md beside it, else stem.md."""
    exact, stem = F.concat(F.col(path), F.lit(".md")), F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".md"))
    gold = truths.select(F.col(path).alias("_t")).distinct()
    out = sources.join(gold.withColumnRenamed("_t", "_a"), exact == F.col("_a"), "left").join(gold.withColumnRenamed("_t", "_b"), stem == F.col("_b"), "left")
    return out.withColumn("truth", F.coalesce("_a", "_b")).drop("_a", "_b")


def score(gold: str, candidate: str) -> dict[str, float]:
    a, b = skeleton(gold), skeleton(candidate)
    x, y = a["tokens"][:ORDER_TOKENS], b["tokens"][:ORDER_TOKENS]
    cells = lambda t: [normalise(c) for r in t for c in r]
    tables = [max((_bag_f1(cells(t), cells(u)) for u in b["tables"]), default=0.0) for t in a["tables"]]
    return {
        "content": _bag_f1(a["tokens"], b["tokens"]),
        "order": difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 1.0,
        "tables": sum(tables) / len(tables) if tables else 1.0,
        "headings": _recall(a["headings"], b["headings"]),
        "lists": _recall(a["lists"], b["lists"]),
    }


METRICS = ("content", "order", "tables", "headings", "lists")


def _scores(gold: pa.Array, candidate: pa.Array) -> pa.Array:
    rows = [score(g.as_py() or "", c.as_py() or "") for g, c in zip(gold, candidate)]  # one pair of texts at a time
    return pa.array(rows, pa.struct([(m, pa.float64()) for m in METRICS]))


def with_scores(pairs: DataFrame, gold: str = "gold", candidate: str = "candidate") -> DataFrame:
    s = F.arrow_udf(_scores, "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">")(gold, candidate)
    return pairs.withColumn("_s", s).withColumns({m: F.col(f"_s.{m}") for m in METRICS}).drop("_s")


def report(scored: DataFrame, by: str = "format") -> DataFrame:
    """Means by format and over all; declined rows don't count."""
    rows = scored.where("status <> 'declined'") if "status" in scored.columns else scored
    return rows.rollup(by).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in METRICS))


def worst(scored: DataFrame, n: int = 25, tie: tuple[str, ...] = ()) -> DataFrame:
    """The report of the n worst by content and order; tie: what orders rows that are as bad."""
    return scored.orderBy((F.col("content") + F.col("order")) / 2, *tie).limit(n)
