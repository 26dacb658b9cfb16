"""What can be read from HTML without building its tree, as Column expressions.

Comments, scripts and styles go first; only short strings (titles, targets) that hold an
entity are sent to Python to be unescaped.
"""

from __future__ import annotations

import html as _html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)"
_ANCHOR = r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·"}


def strip_noise(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), _NOISE, "")


def _unescape(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _html.unescape(x) for x in s.to_pylist()], pa.string())


def unescape_common(s: Column) -> Column:
    """The named entities that most pages use, &amp; last."""
    for k in ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "amp"):
        s = F.replace(s, F.lit(f"&{k};"), F.lit(_NAMED[k]))
    return s


def unescape(s: Column) -> Column:
    """All entities."""
    return F.arrow_udf(_unescape, "string")(s)


def raw_title(html: Column) -> Column:
    """What stands in the title element, as it is written."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)(?:</title|\z)", 1)


def sql_title(html: Column) -> Column:
    """The title element as page_title's SQL has it: closed, else empty; five entities, &amp; last."""
    s = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    for k in ("lt", "gt", "copy", "middot", "amp"):
        s = F.replace(s, F.lit(f"&{k};"), F.lit(_NAMED[k]))
    return s


def raw_h1(html: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(strip_noise(html), r"(?is)<h1[^>]*>(.*?)(?:</h1|\z)", 1), r"(?s)<[^>]*>", "")


def raw_hrefs(html: Column) -> Column:
    """Targets of anchors in order, quotes taken off."""
    return F.transform(F.regexp_extract_all(strip_noise(html), F.lit(_ANCHOR), F.lit(1)), lambda h: F.trim(F.regexp_replace(h, r"^[\"']|[\"']$", "")))


def visible_text(html: Column) -> Column:
    """Text without tags and head, white space collapsed; entities as they are."""
    body = F.regexp_replace(strip_noise(html), r"(?is)<head\b.*?</head\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
