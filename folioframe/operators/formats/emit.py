"""Markdown emitters for parsers that run in Python workers.

``functions.markdown`` has the same rules as Column expressions; tests hold the two
against each other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Sequence
from collections.abc import Callable
from dataclasses import dataclass, field


class ConvertError(Exception):
    """A document that was accepted and could not be converted; code names why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Options:
    """What a conversion may do; 0 stands for the default of each limit."""

    max_depth: int = 8
    drop_images: bool = False
    max_image_bytes: int = 2 << 20
    max_image_total: int = 16 << 20
    least_image_bytes: int = 128
    charset: str = ""
    depth: int = 0


@dataclass
class Info:
    """Hints about a document; any may be empty."""

    mime: str = ""
    ext: str = ""
    charset: str = ""
    file_name: str = ""
    url: str = ""


@dataclass
class Result:
    markdown: str
    title: str = ""


def escape_cell(text: str) -> str:
    return text.replace("\r\n", " ").replace("\n", " ").replace("|", "\\|").strip()


def collapse(text: str) -> str:
    return " ".join(text.split())


def heading(level: int, text: str) -> str:
    text = text.strip()
    return f"{'#' * max(1, min(6, level))} {text}" if text else ""


def code_block(language: str, body: str) -> str:
    fence = "```"
    while fence in body:
        fence += "`"
    return f"{fence}{language}\n{body.rstrip(chr(10))}\n{fence}"


def table(header: Sequence[str] | None, rows: Sequence[Sequence[str]]) -> str:
    """A pipe table; without a header the first row becomes it. Rows are padded or cut."""
    rows = list(rows)
    if not header:
        if not rows:
            return ""
        header, rows = rows[0], rows[1:]
    width = len(header)
    if width == 0:
        return ""
    line = lambda cells: "| " + " | ".join(escape_cell(c) for c in [*cells, *[""] * width][:width]) + " |"
    return "\n".join([line(header), "| " + " | ".join(["---"] * width) + " |", *map(line, rows)])


def join_blocks(blocks: Iterable[str]) -> str:
    kept = [b for b in (x.rstrip(" \t\n") for x in blocks) if b]
    return "\n\n".join(kept) + "\n" if kept else ""


def emphasise(text: str, mark: str) -> str:
    """Markers around the text, its outer white space left outside."""
    inner = text.strip(" \t\n")
    if not inner:
        return text
    at = text.index(inner)
    return f"{text[:at]}{mark}{inner}{mark}{text[at + len(inner):]}"


def link_url(url: str) -> str:
    return url.replace(" ", "%20").replace("(", "%28").replace(")", "%29").replace("\r", "").replace("\n", "")


def link_text(text: str) -> str:
    return re.sub(r"([\\\[\]])", r"\\\1", text)


def image(alt: str, target: str) -> str:
    return f"![{re.sub(r'[\[\]\n\r]', ' ', alt).strip()}]({target})"


def decode_text(data: bytes, declared: str = "") -> str:
    """Text of bytes: declared charset, byte order mark, UTF-8, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark) and not declared:
            return data[len(mark):].decode(name, "replace")
    for name in filter(None, (declared, "utf-8")):
        try:
            return data.decode(name).removeprefix("﻿")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace")


class Captions:
    """A describer's texts for the pictures of one document: big ones only, each asked about once
    however often it stands there, and so many at most.  A failing describer costs the caption."""

    def __init__(self, describe: Callable[[bytes, str], str] | None = None, most: int = 50, least: int = 4096):
        self.describe, self.most, self.least = describe, most, least
        self.known: dict[bytes, str] = {}

    def of(self, data: bytes, mime: str) -> str:
        if self.describe is None or len(data) < self.least:
            return ""
        key = hashlib.sha256(data).digest()
        if key not in self.known:
            if len(self.known) >= self.most:
                return ""
            try:
                self.known[key] = (self.describe(data, mime) or "").strip()
            except Exception:
                self.known[key] = ""
        return self.known[key]


@dataclass
class ImageBudget:
    """Bytes of images that one document may still inline; repeats are free."""

    options: Options
    left: int = 0
    seen: dict = field(default_factory=dict)

    def __post_init__(self):
        self.left = self.options.max_image_total

    def uri(self, mime: str, data: bytes) -> str:
        o = self.options
        if o.drop_images or not mime.startswith("image/") or len(data) < o.least_image_bytes:
            return ""
        key = (len(data), data[:64], data[-64:])
        if key not in self.seen:
            if len(data) > o.max_image_bytes or len(data) > self.left:
                return ""
            self.left -= len(data)
            self.seen[key] = f"data:{mime};base64,{base64.b64encode(data).decode()}"
        return self.seen[key]
