"""Dates and numbers of document formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_GAP_US = 11_644_473_600_000_000


def filetime(ft: Column) -> Column:
    """100 ns since 1601 as a timestamp; null outside the years 1 to 9999."""
    t = F.timestamp_micros(F.floor(ft / 10).cast("long") - F.lit(_EPOCH_GAP_US))
    return F.when((ft >= 0) & (F.year(t) <= 9999), t)


def filetime_text(ft: Column) -> Column:
    return F.date_format(filetime(ft), "yyyy-MM-dd HH:mm:ss 'UTC'")


def cell_row(ref: Column) -> Column:
    """Row of an A1 reference, from 0; null for what is none."""
    return F.when(_is_ref(ref), F.regexp_extract(ref, r"(\d+)$", 1).cast("int") - 1)


def cell_column(ref: Column) -> Column:
    """Column of an A1 reference, from 0: letters are digits in base 26."""
    letters = F.split(F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})", 1)), "")
    n = F.aggregate(letters, F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(_is_ref(ref), n - 1)


def _is_ref(ref: Column) -> Column:
    return ref.rlike(r"^\$?[A-Za-z]{1,3}\$?\d+$")


def span(raw: Column, most: int) -> Column:
    """A table span: absent or bad is 1, nought or more than most is most."""
    n = F.when(F.trim(raw).rlike(r"^[+-]?\d{1,9}$"), F.trim(raw)).cast("int")
    return F.coalesce(F.when((n == 0) | (n > most), F.lit(most)).when(n > 0, n), F.lit(1))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as a signed decimal with six places."""
    v = d + m / 60 + s / 3600
    return F.format_string("%.6f", F.when(ref.isin("S", "W"), -v).otherwise(v))


def backoff_ms(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Milliseconds before a request is tried again: what the server asks for (seconds, 30 at
    most), else 200 ms doubled at each attempt from the first, 8 s at most, and up to half of
    that more by jitter (0 to 1)."""
    wait = F.least(F.lit(200.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(8000.0))
    asked = F.least(retry_after, F.lit(30)) * 1000.0
    return F.when(retry_after > 0, asked).otherwise(F.floor(wait + wait / 2 * jitter)).cast("long")


def human_bytes(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves one digit or more before the point."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTP", 1):
        out = F.when(n >= 1 << (10 * k), F.format_string(f"%.1f {unit}iB", n / float(1 << (10 * k)))).otherwise(out)
    return out
