"""Links: out of pages, and rewritten in Markdown to the files of a mirror."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import urls as U
from folioframe.operators.convert import SLICE_ROWS, sliced, spread
from folioframe.operators.formats import html


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        urls, ords, found = [], [], []
        for u, body in zip(b.column("url").to_pylist(), b.column("body").to_pylist()):
            text = html.decode(body) if isinstance(body, bytes) else body or ""
            links = html.links_of(html.parse(text), u or "")
            urls += [u] * len(links)
            ords += range(len(links))
            found += links
        yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "ord": pa.array(ords, pa.int32()), "raw": pa.array(found, pa.string())})


def page_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(url, ord, link) of every page's anchors, resolved, normalised, each once a page."""
    rows = spread(pages.select(F.col(url).alias("url"), F.col(body).alias("body"))).mapInArrow(_links, "url string, ord int, raw string")
    rows = rows.withColumn("link", U.normalise(F.col("raw"))).where("link IS NOT NULL")
    return rows.groupBy("url", "link").agg(F.min("ord").alias("ord"))


_DEFINITION = re.compile(r"^( {0,3}\[[^\]]+\]:[ \t]*)(<[^>\n]*>|\S+)(.*)$")


def rewrite(md: str, target: Callable[[str], str | None]) -> str:
    """Markdown whose link targets are replaced where target() has another.

    Fenced and indented code, code spans and escapes stay; anything unclear stays as it is.
    """
    out, fence, blank = [], "", True
    for line in md.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
            out.append(line)
        elif m:
            fence = m[1]
            out.append(line)
        elif re.match(r"(?: {4}|\t)", line) and blank:
            out.append(line)
            continue
        elif d := _DEFINITION.match(line):
            raw = d[2].strip("<>")
            new = target(raw)
            out.append(line if new is None else f"{d[1]}{new}{d[3]}")
        else:
            out.append(_inline(line, target))
        blank = not line.strip()
    return "\n".join(out)


def _inline(line: str, target: Callable[[str], str | None]) -> str:
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            out.append(line[i : i + 2])
            i += 2
        elif c == "`":
            run = re.match("`+", line[i:])[0]
            end = re.compile(rf"(?<!`){run}(?!`)").search(line, i + len(run))
            stop = end.end() if end else i + len(run)
            out.append(line[i:stop])
            i = stop
        elif c == "[":
            close = _bracket(line, i)
            m = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)").match(line, close + 1) if close > 0 else None
            if m and m[1]:
                inner = _inline(line[i + 1 : close], target)
                new = target(m[1].strip("<>"))
                out.append(f"[{inner}]{m[0] if new is None else f'({new}{m[2] or chr(0)})'.replace(chr(0), '')}")
                i = m.end()
            else:
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _bracket(line: str, at: int) -> int:
    depth, i = 0, at
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 1
        elif c == "`":
            run = re.match("`+", line[i:])[0]
            end = line.find(run, i + len(run))
            i = end + len(run) - 1 if end >= 0 else i
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def lookup_keys(url: str) -> list[tuple[str, str]]:
    """(key, fragment to keep) of a target, the best first: without fragment, with its
    trailing slash toggled, scheme and host in lower case, whole."""
    try:
        p = urlsplit(url)
    except ValueError:
        return []
    base, _, frag = url.partition("#")
    frag = f"#{frag}" if frag else ""
    toggled = base[:-1] if base.endswith("/") else f"{base}/"
    low = p._replace(scheme=p.scheme.lower(), netloc=p.netloc.lower(), fragment="").geturl()
    best: dict[str, str] = {}
    for key, kept in ((base, frag), (toggled, frag), (low, frag), (url, "")):
        best.setdefault(key, kept)
    return [*best.items()]


def rewrite_links(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs (url, path, markdown) with links into the mapping (url, path) made relative.

    Links are pulled out, joined with the mapping by each of their keys, and only the
    matches of a document come back to it; the mapping is never collected, nor broadcast: its
    file's size says little of its rows.  A URL mapped more than once leads to the least of its
    paths, so that repeated rows of both sides are not multiplied.
    """
    from folioframe.functions.urls import relative_to

    def targets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (md,) in sliced(((b,) for b in batches), SLICE_ROWS):
            out = []
            for m in md.to_pylist():
                seen: dict[str, None] = {}
                rewrite(m or "", lambda t: seen.setdefault(t))  # noqa: B023
                out.append([{"t": t, "k": k, "f": f, "p": i} for t in seen for i, (k, f) in enumerate(lookup_keys(t))])
            yield pa.array(out, pa.list_(pa.struct([("t", pa.string()), ("k", pa.string()), ("f", pa.string()), ("p", pa.int32())])))

    keyed = docs.select("path", F.explode(F.arrow_udf(targets, "array<struct<t:string,k:string,f:string,p:int>>")("markdown")).alias("x"))
    once = mapping.groupBy(F.col("url").alias("k")).agg(F.min("path").alias("to"))
    keyed = keyed.select("path", "x.*").hint("merge").join(once, "k")
    best = keyed.groupBy("path", "t").agg(F.min_by(F.struct("to", "f"), "p").alias("b"))
    rel = best.select("path", "t", F.concat(relative_to(F.col("b.to"), F.col("path")), F.col("b.f")).alias("new"))
    maps = rel.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("t", "new"))).alias("_m"))

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for md, m in sliced(batches, SLICE_ROWS):
            yield pa.array([None if a is None else rewrite(a, dict(b or ()).get) for a, b in zip(md.to_pylist(), m.to_pylist())], pa.string())

    return docs.join(maps.hint("merge"), "path", "left").withColumn("markdown", F.arrow_udf(apply, "string")("markdown", "_m")).drop("_m").select(docs.columns)
