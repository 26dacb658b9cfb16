"""Feeds, archives, e-books: documents that hold other documents."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from functools import lru_cache
from urllib.parse import unquote, urldefrag
from xml.etree import ElementTree as ET

from folioframe.operators.formats import html
from folioframe.operators.formats.emit import ConvertError, Info, Options, Result, collapse, heading, join_blocks, link_text, link_url

MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 10_000, 64 << 20, 512 << 20
#: Bytes of a part of styles or relationships that is kept parsed: documents of one template share it.
SHARED_PART = 16 << 10


@lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def child(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        if e is not None and (c := e.find(n)) is not None:
            return c
    return None


def children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return e.findall(name) if e is not None else []


def descend(e: ET.Element, name: str) -> list[ET.Element]:
    return [*e.iter(name)]


def text_of(e: ET.Element | None) -> str:
    return "".join(e.itertext()) if e is not None else ""


def attr(e: ET.Element | None, name: str, default: str = "") -> str:
    """An attribute by its local name."""
    if e is not None:
        for k, v in e.items():
            if k == name or (k.endswith(name) and local(k) == name):
                return v
    return default


def xml(data: bytes) -> ET.Element:
    """The tree with local names for tags, so that child(), children() and descend() need no look at each."""
    if b"<!ENTITY" in data[:65536]:
        raise ConvertError("convert_failed", "xml: entity declarations are refused")
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError, LookupError) as e:
        raise ConvertError("convert_failed", f"xml: {e}") from e
    for e in root.iter():
        if e.tag[0] == "{":
            e.tag = local(e.tag)
    return root


class Archive:
    """Members of a zip file, each read under a cap and all under a budget."""

    def __init__(self, data: bytes):
        self.data = data
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            raise ConvertError("convert_failed", f"zip: {e}") from e
        self.members = self.zip.infolist()
        self.used = 0
        self.by_name: dict[str, zipfile.ZipInfo] = {}
        for m in self.members:
            self.by_name.setdefault(clean_name(m.filename), m)

    def read(self, m: zipfile.ZipInfo | str, cap: int = MAX_ENTRY) -> bytes:
        if isinstance(m, str):
            m = self.by_name.get(clean_name(m))
            if m is None:
                raise ConvertError("part_missing", "zip: no such part")
        try:
            data = self._plain(m, cap)
            if data is None:
                with self.zip.open(m) as f:
                    data = f.read(cap + 1)
        except (zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError, EOFError, ValueError) as e:
            raise ConvertError("convert_failed", f"zip member: {e}") from e
        if len(data) > cap:
            raise ConvertError("convert_failed", "zip member: too large")
        self.used += len(data)
        if self.used > MAX_TOTAL:
            raise ConvertError("budget", "zip: too much in all")
        return data

    def _plain(self, m: zipfile.ZipInfo, cap: int) -> bytes | None:
        """An ordinary member without a file object around it; None for whatever zipfile must judge."""
        at, most = m.header_offset, getattr(m, "_end_offset", None)
        if at < 0 or most is None or m.compress_type not in (0, 8) or m.flag_bits & 0x61 or m.file_size > cap or self.data[at : at + 4] != b"PK\3\4":
            return None
        size, more = int.from_bytes(self.data[at + 26 : at + 28], "little"), int.from_bytes(self.data[at + 28 : at + 30], "little")
        name = self.data[at + 30 : at + 30 + size]
        start = at + 30 + size + more
        end = start + m.compress_size
        try:
            if name.decode("utf-8" if self.data[at + 7] & 8 else self.zip.metadata_encoding or "cp437") != m.orig_filename or end > most:
                return None
            raw = self.data[start:end]
            if m.compress_type == 0:
                data, whole = raw, len(raw) == m.file_size
            else:
                z = zlib.decompressobj(-15)
                data = z.decompress(raw, m.file_size + 1)
                whole = z.eof and len(data) == m.file_size
        except (UnicodeDecodeError, zlib.error, IndexError):
            return None
        return data if whole and zlib.crc32(data) == m.CRC else None

    def get(self, name: str) -> bytes | None:
        return self.read(name) if clean_name(name) in self.by_name else None


def clean_name(name: str) -> str:
    return posixpath.normpath("/" + name.replace("\\", "/")).lstrip("/")


def unsafe(name: str) -> bool:
    n = name.replace("\\", "/")
    return n.startswith("/") or ".." in n.split("/") or bool(re.match(r"[A-Za-z]:", n)) or any(ord(c) < 32 for c in n)


def zip_names(data: bytes) -> list[str]:
    try:
        return zipfile.ZipFile(io.BytesIO(data)).namelist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return []


def convert_zip(data: bytes, info: Info, options: Options, convert) -> Result:
    """A section per member in stored order; convert(data, info, options) does a member."""
    a = Archive(data)
    if len(a.members) > MAX_ENTRIES:
        raise ConvertError("convert_failed", "zip: too many entries")
    blocks = []
    for m in a.members:
        if m.is_dir() or m.file_size == 0:
            continue
        title = heading(2, collapse(m.filename))
        if unsafe(m.filename):
            blocks += [title, "*[could not convert: unsafe entry path]*"]
            continue
        try:
            own = Info(ext=posixpath.splitext(m.filename)[1].lower(), file_name=posixpath.basename(m.filename))
            blocks += [title, convert(a.read(m), own, options).markdown]
        except ConvertError as e:
            if e.code == "budget":
                raise ConvertError("convert_failed", str(e)) from e
            blocks += [title, f"*[could not convert: {e}]*"]
    return Result(join_blocks(blocks), info.file_name)


def convert_epub(data: bytes, info: Info, options: Options) -> Result:
    a = Archive(data)
    box = xml(a.read("META-INF/container.xml", 16 << 20))
    root = next((attr(r, "full-path") for r in descend(box, "rootfile") if attr(r, "full-path")), "")
    opf = xml(a.read(root, 16 << 20))
    folder = posixpath.dirname(root)
    meta = child(opf, "metadata")
    field = lambda n: [collapse(text_of(e)) for e in children(meta, n) if collapse(text_of(e))]
    title = (field("title") or [""])[0]
    facts = [(k, ", ".join(field(n)) if k == "Author" else (field(n) or [""])[0]) for k, n in (("Author", "creator"), ("Language", "language"), ("Date", "date"))]
    blocks = [heading(1, title), "\n".join(f"- {k}: {v}" for k, v in facts if v)]
    items = {attr(i, "id"): i for i in reversed(children(child(opf, "manifest"), "item"))}
    for ref in children(child(opf, "spine"), "itemref"):
        item = items.get(attr(ref, "idref"))
        if item is None:
            continue
        href = unquote(attr(item, "href").split("#")[0].split("?")[0])
        kind = attr(item, "media-type")
        if not (kind in ("application/xhtml+xml", "text/html") or href.lower().endswith((".xhtml", ".html", ".htm"))):
            continue
        name = posixpath.normpath(posixpath.join(folder, href))
        if name.startswith("..") or href.startswith("/"):
            continue
        part = a.get(name)
        if part is not None:
            blocks.append(html.to_markdown(html.decode(_as_html(part)), drop_images=options.drop_images))
    return Result(join_blocks(blocks), title)


def _as_html(data: bytes) -> bytes:
    """Without the XML declaration, whose encoding becomes a meta element's."""
    m = re.match(rb"\s*(?:\xef\xbb\xbf)?<\?xml[^>]*?(?:encoding=[\"']([\w.-]+)[\"'])?[^>]*\?>", data)
    if not m:
        return data
    own = b'<meta charset="' + m[1] + b'">' if m[1] and m[1].lower() != b"utf-8" else b""
    return own + data[m.end():]


def feed_date(raw: list[str]) -> str:
    """The first date that can be read, as RFC 3339 in UTC; else the first there is."""
    raw = [x.strip() for x in raw if x and x.strip()]
    for x in raw:
        try:
            d = datetime.fromisoformat(x)
        except ValueError:
            try:
                d = parsedate_to_datetime(x)
            except (ValueError, TypeError, IndexError):
                continue
        d = d if d.tzinfo else d.replace(tzinfo=timezone.utc)
        return d.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return raw[0] if raw else ""


def convert_rss(data: bytes, info: Info, options: Options) -> Result:
    root = xml(data)
    atom = root.tag == "feed"
    top = root if atom else child(root, "channel")
    top = root if top is None else top
    items = children(root, "entry") if atom else children(top, "item") or children(root, "item")
    title = collapse(text_of(child(top, "title")))
    about = collapse(re.sub(r"<[^>]*>", " ", text_of(child(top, "subtitle" if atom else "description"))))
    blocks = [heading(1, title), about]
    for i in items:
        link = ""
        for x in children(i, "link"):
            if attr(x, "href") and attr(x, "rel", "alternate") == "alternate":
                link = link or attr(x, "href")
            elif text_of(x).strip():
                link = link or text_of(x).strip()
        name = collapse(text_of(child(i, "title")))
        date = feed_date([text_of(child(i, n)) for n in (("published", "updated") if atom else ("pubDate", "date", "published", "updated"))])
        by = child(i, "author", "creator")
        who = collapse(text_of(child(by, "name")) or ("" if child(by, "name") is not None else text_of(by))) if by is not None else ""
        line = " — ".join(x for x in (date, f"by {who}" if who else "") if x)
        body = text_of(child(i, "encoded", "content")) or text_of(child(i, "summary" if atom else "description"))
        blocks += [heading(2, name), f"*{line}*" if line else "", f"[{link_text(name or link)}]({link})" if link else ""]
        blocks.append(html.to_markdown(body, link, options.drop_images) if body.strip() else "")
    return Result(join_blocks(blocks), title)


def rels_of(a: Archive, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id to (type's last word, part name); the first of an id stays."""
    folder, base = posixpath.split(part)
    data = a.get(f"{folder}/_rels/{base}.rels")
    return (_shared_relations if len(data) <= SHARED_PART else relations)(data, folder) if data else {}


def relations(data: bytes, folder: str) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for r in children(xml(data), "Relationship"):
        target, kind = attr(r, "Target"), attr(r, "Type").rpartition("/")[2]
        if attr(r, "TargetMode") == "External":
            out.setdefault(attr(r, "Id"), (f"external:{kind}", target))
            continue
        if re.match(r"(?i)[a-z][a-z0-9+.-]*:", target):
            continue
        name = posixpath.normpath(posixpath.join("/" + folder, urldefrag(target)[0])).lstrip("/")
        out.setdefault(attr(r, "Id"), (kind, name))
    return out


_shared_relations = lru_cache(64)(relations)


def core_title(a: Archive) -> str:
    data = a.get("docProps/core.xml")
    try:
        return collapse(text_of(next(iter(descend(xml(data), "title")), None))) if data else ""
    except ConvertError:
        return ""


MEDIA = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}


def chart_grid(data: bytes) -> tuple[str, str, list[str], list[list[str]]]:
    """Title, kind ('bar', 'line', ...), names of the series and rows (a category each) of the
    values a chart part caches."""
    root = xml(data)
    title = next(iter(descend(root, "title")), None)
    name = collapse(" ".join(text_of(t) for t in descend(title, "t"))) if title is not None else ""
    kind = next((c.tag for p in descend(root, "plotArea") for c in p if c.tag.endswith("Chart")), "")
    kind = kind.removesuffix("Chart").removesuffix("3D")
    points = lambda e: {int(attr(p, "idx", "0")): text_of(child(p, "v")) for p in descend(e, "pt")} if e is not None else {}
    cats: dict[int, str] = {}
    series = []
    for k, s in enumerate(descend(root, "ser")):
        tx = child(s, "tx")
        series.append((collapse(" ".join(text_of(v) for v in descend(tx, "v"))) if tx is not None else f"Series {k + 1}", points(child(s, "val", "yVal"))))
        for i, v in points(child(s, "cat", "xVal")).items():
            cats.setdefault(i, v)
    n = max([-1, *cats, *(i for _, p in series for i in p)]) + 1
    rows = [[cats.get(i, ""), *(p.get(i, "") for _, p in series)] for i in range(min(n, 100_000))]
    return name, kind, [s for s, _ in series], rows


