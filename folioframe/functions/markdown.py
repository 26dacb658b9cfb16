"""Markdown emitters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str
_TRIM = r"(?U)^\s+|\s+$"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(s: ColumnOrName) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_c(s), _TRIM, "")


def collapse(s: ColumnOrName) -> Column:
    return trim(F.regexp_replace(_c(s), r"(?U)\s+", " "))


def sql_collapse(s: ColumnOrName) -> Column:
    """As SQL's own functions do it: tabs, line ends, form feeds and spaces to one space, then all space separators off the ends."""
    return F.regexp_replace(F.regexp_replace(_c(s), r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def escape_cell(s: ColumnOrName) -> Column:
    """One table cell: line ends to spaces, bars escaped, trimmed; null is empty."""
    s = F.coalesce(_c(s), F.lit(""))
    return trim(F.replace(F.replace(F.replace(s, F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")))


def heading_marks(level: ColumnOrName) -> Column:
    return F.repeat(F.lit("#"), F.least(F.greatest(_c(level), F.lit(1)), F.lit(6)).cast("int"))


def heading(level: ColumnOrName, text: ColumnOrName) -> Column:
    t = trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(F.concat(heading_marks(level), F.lit(" "), t))


def code_block(language: ColumnOrName, body: ColumnOrName) -> Column:
    """A fence longer than any run of backticks inside."""
    b = _c(body)
    runs = F.transform(F.regexp_extract_all(b, F.lit("`+"), F.lit(0)), F.length)
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    fence = F.repeat(F.lit("`"), F.when(longest >= 3, longest + 1).otherwise(3).cast("int"))
    return F.concat(fence, _c(language), F.lit("\n"), F.regexp_replace(b, r"\n+\z", ""), F.lit("\n"), fence)


def emphasise(text: ColumnOrName, mark: str) -> Column:
    t = _c(text)
    return F.when(F.trim(t, F.lit(" \t\n")) == "", t).otherwise(F.regexp_replace(t, r"(?s)^([ \t\n]*)(.*?)([ \t\n]*)$", f"$1{mark}$2{mark}$3"))


def link_url(url: ColumnOrName) -> Column:
    u = F.translate(_c(url), "\r\n", "")
    for a, b in ((" ", "%20"), ("(", "%28"), (")", "%29")):
        u = F.replace(u, F.lit(a), F.lit(b))
    return u


def link_text(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"([\\\[\]])", r"\\$1")


def image(alt: ColumnOrName, target: ColumnOrName) -> Column:
    return F.concat(F.lit("!["), trim(F.translate(_c(alt), "[]\r\n", "    ")), F.lit("]("), _c(target), F.lit(")"))


def row(cells: Column, width: ColumnOrName) -> Column:
    """A table line of so many cells, padded or cut."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), _c(width))), F.lit(1), _c(width))
    return F.concat(F.lit("| "), F.array_join(F.transform(padded, escape_cell), " | "), F.lit(" |"))


def table(header: Column, rows: Column) -> Column:
    """A pipe table of an array of strings and an array of those."""
    width = F.size(header)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(row(header, width), rule), F.transform(rows, lambda r: row(r, width)))
    return F.when(width > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def join_blocks(blocks: Column) -> Column:
    """Blocks trimmed at their ends, empty ones dropped, a blank line between, one line end."""
    kept = F.filter(F.transform(blocks, lambda b: F.regexp_replace(b, r"[ \t\n]+\z", "")), lambda b: F.length(b) > 0)
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n\n"), F.lit("\n"))).otherwise(F.lit(""))


def with_title(body: ColumnOrName, title: ColumnOrName) -> Column:
    """The title as a heading before a body that doesn't open with one."""
    b, t = _c(body), F.coalesce(_c(title), F.lit(""))
    return F.when((t == "") | b.startswith("# "), b).otherwise(F.concat(F.lit("# "), t, F.lit("\n\n"), b))


def drop_data_uris(md: ColumnOrName) -> Column:
    return F.regexp_replace(_c(md), r"\(data:[^)\s]*\)", "()")
