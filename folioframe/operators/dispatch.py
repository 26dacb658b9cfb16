"""Which format a document has: ordered predicates over content and hints.

Input rows have content (binary), mime, ext, file_name; cheap predicates are Column
expressions over the head of the content, and Python looks only into rows whose magic
says that they are archives, compound files or may be JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.hints import norm_ext, norm_mime

_OFFICE = "application/vnd.openxmlformats-officedocument."
_CFB = "D0CF11E0A1B11AE1"


def head_hex(n: int) -> Column:
    return F.hex(F.substring("content", 1, n))


def head_text(n: int) -> Column:
    """The first bytes, each as one character."""
    return F.decode(F.substring("content", 1, n), "ISO-8859-1")


def _ext(*names: str) -> Column:
    return F.col("_ext").isin(*names)


def _mime(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col("_mime").startswith(n)
    return out


def _holds(part: str) -> Column:
    return F.array_contains(F.col("_names"), part)


def _json_start() -> Column:
    return F.regexp_replace(head_text(4096), r"^\s+", "").rlike(r"^[{\[]")


def is_zip() -> Column:
    return head_hex(4).isin("504B0304", "504B0506", "504B0708")


def is_cfb() -> Column:
    return head_hex(8) == _CFB


def audio_magic() -> Column:
    h = head_hex(12)
    return (
        h.startswith("494433") | h.rlike("^FFF[2-7A-F]|^FFE[2-7]") | (h.startswith("52494646") & h.endswith("57415645"))
        | (F.substring(h, 9, 8) == "66747970") | h.startswith("4F676753") | h.startswith("664C6143")
    )


def image_magic() -> Column:
    h = head_hex(12)
    return (
        h.startswith("FFD8FF") | h.startswith("89504E470D0A1A0A") | h.rlike("^47494638(37|39)61") | (h.startswith("52494646") & h.endswith("57454250"))
    )


def _plain() -> Column:
    head = F.substring("content", 1, 4096)
    whole = F.is_valid_utf8(head.cast("string")) | F.exists(
        F.sequence(F.lit(1), F.lit(3)), lambda k: F.is_valid_utf8(F.substring(head, F.lit(1), F.greatest(F.length(head) - k, F.lit(0))).cast("string")) & (F.length("content") > 4096)
    )
    return _mime("text/") | _ext(".txt", ".text", ".md", ".markdown", ".log") | (~head_text(4096).contains("\x00") & whole)


@dataclass(frozen=True)
class Format:
    """A format: lower priority first, then order of registration."""

    name: str
    priority: int
    accepts: Callable[[], Column]


def builtins(transcriber: bool = False) -> list[Format]:
    other = (".docx", ".pptx", ".epub", ".zip", ".xls", ".msg")
    return [
        Format("audio", 0, lambda: F.lit(transcriber) & (audio_magic() | _mime("audio/") | _ext(".mp3", ".wav", ".m4a", ".mp4", ".ogg", ".oga", ".flac", ".aac", ".opus", ".webm", ".wma", ".aiff"))),
        Format("csv", 0, lambda: _ext(".csv", ".tsv", ".tab") | _mime("text/csv", "application/csv", "text/tab-separated-values", "text/x-csv")),
        Format("docx", 0, lambda: _ext(".docx") | _mime(f"{_OFFICE}wordprocessingml") | _holds("word/document.xml")),
        Format("epub", 0, lambda: _ext(".epub") | _mime("application/epub") | (is_zip() & head_text(128).contains("mimetypeapplication/epub+zip"))),
        Format("image", 0, lambda: image_magic() | _mime("image/") | _ext(".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tif", ".tiff")),
        Format("ipynb", 0, lambda: F.regexp_replace(head_text(4096), r"^\s+", "").startswith("{") & head_text(1 << 20).contains('"nbformat"') & (F.col("_json") | (_ext(".ipynb") & (F.length("content") > 1 << 20)))),
        Format("msg", 0, lambda: is_cfb() & (_ext(".msg") | F.col("_mapi"))),
        Format("pdf", 0, lambda: head_hex(5).startswith("255044462D") | _mime("application/pdf") | _ext(".pdf")),
        Format("pptx", 0, lambda: _ext(".pptx") | _mime(f"{_OFFICE}presentationml") | _holds("ppt/presentation.xml")),
        Format("rss", 0, lambda: (_ext(".rss", ".atom", ".xml", ".rdf") | _mime("application/rss", "application/atom", "application/rdf", "application/xml", "text/xml")) & F.lower(head_text(4096)).rlike("<rss|<feed|<rdf:rdf")),
        Format("xls", 0, lambda: ~_ext(".docx", ".pptx", ".xlsx", ".msg", ".doc", ".ppt") & (_ext(".xls", ".xlt") | _mime("application/vnd.ms-excel", "application/msexcel", "application/x-msexcel", "application/x-excel", "application/excel") | F.col("_book"))),
        Format("xlsx", 0, lambda: _ext(".xlsx", ".xlsm", ".xltx", ".xltm") | _mime(f"{_OFFICE}spreadsheetml", "application/vnd.ms-excel.sheet.macroenabled", "application/vnd.ms-excel.template.macroenabled") | (~_ext(*other) & _holds("xl/workbook.xml"))),
        Format("json", 1, lambda: ~_ext(".ipynb") & _json_start() & (F.col("_json") | ((_ext(".json") | _mime("application/json")) & (F.length("content") > 1 << 20)))),
        Format("html", 10, lambda: ~_ext(".xml") & (_ext(".html", ".htm", ".xhtml", ".shtml") | _mime("text/html", "application/xhtml") | F.lower(head_text(1024)).rlike(r"<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>]"))),
        Format("zip", 10, lambda: is_zip() & (F.size("_names") > 0) | (is_zip() & (_ext(".zip") | _mime("application/zip", "application/x-zip")))),
        Format("plaintext", 100, _plain),
    ]


class Registry:
    """Formats in the order in which they are asked."""

    def __init__(self, formats: list[Format] | None = None):
        self.formats = list(formats) if formats is not None else builtins()

    def register(self, name: str, priority: int, accepts: Callable[[], Column]) -> Registry:
        return Registry([*self.formats, Format(name, priority, accepts)])

    def ordered(self) -> list[Format]:
        return sorted(self.formats, key=lambda f: f.priority)


def _look(kind: pa.Array, content: pa.Array) -> pa.Array:
    """Names in archives, streams of compound files, whether JSON is valid."""
    from folioframe.operators.formats.binary import Compound
    from folioframe.operators.formats.emit import ConvertError
    from folioframe.operators.formats.packages import zip_names
    from folioframe.operators.formats.plain import is_json

    out = []
    for k, c in zip(kind.to_pylist(), content):
        c = c.as_py()  # one document at a time
        row = {"names": [], "json": False, "mapi": False, "book": False}
        if c is None:
            pass
        elif k == "zip":
            row["names"] = zip_names(c)
        elif k == "json":
            row["json"] = is_json(c)
        elif k == "cfb":
            try:
                paths = Compound(c).paths
                row["mapi"] = any(p.startswith("__substg1.0_") for p in paths)
                row["book"] = not row["mapi"] and ("Workbook" in paths or "Book" in paths)
            except (ConvertError, ValueError, IndexError, ArithmeticError, LookupError):
                pass
            except Exception:  # a malformed container is no container
                pass
        out.append(row)
    return pa.array(out, pa.struct([("names", pa.list_(pa.string())), ("json", pa.bool_()), ("mapi", pa.bool_()), ("book", pa.bool_())]))


_LOOKED = "struct<names:array<string>,json:boolean,mapi:boolean,book:boolean>"


def dispatch(docs: DataFrame, registry: Registry | None = None) -> DataFrame:
    """docs and format, the first that accepts a row; null if none does.

    docs needs content, mime and ext.  Null content counts as empty.
    """
    registry = registry or Registry()
    base = docs.withColumns({"content": F.coalesce("content", F.lit(b"")), "_ext": norm_ext(F.col("ext")), "_mime": norm_mime(F.col("mime"))})
    kind = F.when(is_zip(), "zip").when(is_cfb(), "cfb").when(_json_start(), "json").otherwise("")
    base = base.withColumn("_kind", kind)
    # rows that need no look are sent without their content, in the same pass over the table
    look = F.arrow_udf(_look, _LOOKED)("_kind", F.when(F.col("_kind") != "", F.col("content")))
    rows = base.withColumn("_look", look).select("*", *(F.col(f"_look.{x}").alias(f"_{x}") for x in ("names", "json", "mapi", "book")))
    found: Column | None = None
    for f in registry.ordered():
        found = F.when(f.accepts(), f.name) if found is None else found.when(f.accepts(), f.name)
    return rows.withColumn("format", found).drop("_ext", "_mime", "_kind", "_look", "_names", "_json", "_mapi", "_book")
