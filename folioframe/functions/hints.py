"""Hints about a document (MIME type, extension, name) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIME_OF = {
    ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".xhtml": "application/xhtml+xml", ".csv": "text/csv",
    ".tsv": "text/tab-separated-values", ".json": "application/json", ".xml": "application/xml", ".rss": "application/rss+xml", ".atom": "application/atom+xml",
    ".pdf": "application/pdf", ".zip": "application/zip", ".epub": "application/epub+zip", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".gif": "image/gif", ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/wav", ".msg": "application/vnd.ms-outlook", ".xls": "application/vnd.ms-excel",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".ipynb": "application/x-ipynb+json",
}


def norm_mime(m: Column) -> Column:
    """Without parameters, lower case, trimmed; null is empty."""
    return F.lower(F.trim(F.element_at(F.split(F.coalesce(m, F.lit("")), ";"), 1)))


def norm_ext(e: Column) -> Column:
    """Lower case with its dot; null is empty."""
    e = F.lower(F.trim(F.coalesce(e, F.lit(""))))
    return F.when((e == "") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def ext_of(path: Column) -> Column:
    """From the last dot of the name on; '' without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def mime_of_ext(ext: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIME_OF.items() for x in kv))
    return F.coalesce(known[ext], F.lit(""))


def overlay(base: Column, over: Column) -> Column:
    """over where it says anything, else base."""
    return F.coalesce(F.nullif(over, F.lit("")), base)


def is_html(content_type: Column) -> Column:
    """Whether a Content-Type is one whose links are looked for."""
    return norm_mime(content_type).isin("text/html", "application/xhtml+xml")


def sniff(content: Column) -> Column:
    """MIME type by the first 512 bytes."""
    h = F.hex(F.substring(content, 1, 512))
    head = F.upper(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    magic = [
        ("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"),
        ("1F8B08", "application/x-gzip"), ("494433", "audio/mpeg"), ("4F67675300", "application/ogg"), ("EFBBBF", "text/plain"), ("FEFF", "text/plain"), ("FFFE", "text/plain"),
    ]
    out = F.when(F.ltrim(head).rlike(r"^<(!DOCTYPE HTML|HTML|HEAD|BODY|SCRIPT|TITLE|TABLE|DIV|H1|P|A|B|BR)[ >]|^<!--"), F.lit("text/html")).when(
        F.ltrim(head).startswith("<?XML"), F.lit("text/xml")
    )
    for m, name in magic:
        out = out.when(h.startswith(m), F.lit(name))
    out = out.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), F.lit("image/webp"))
    out = out.when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), F.lit("audio/wave"))
    binary = F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]")
    return out.when(binary, F.lit("application/octet-stream")).otherwise(F.lit("text/plain"))
