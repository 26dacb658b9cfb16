"""Small documents of every binary format, made from rows, for queries and tests."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CFB_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
NS = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:mc="http://mc" xmlns:p="http://p" xmlns:c="http://c"'


def zipped(parts: dict) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return b.getvalue()


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with 512-byte sectors; every stream in the mini stream."""
    mini, fat_mini, entries = b"", [], []
    for name, body in streams.items():
        first = len(mini) // 64
        n = max(1, -(-len(body) // 64))
        mini += body.ljust(64 * n, b"\0")
        fat_mini += [*range(first + 1, first + n), 0xFFFFFFFE]
        entries.append((name, first, len(body)))
    mini_sectors = -(-len(mini) // 512)
    n_dir = -(-(len(entries) + 1) // 4)
    fat_mini_sectors = -(-4 * len(fat_mini) // 512)

    def entry(name, kind, right, down, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, down) + b"\0" * 36 + struct.pack("<IQ", start, size)

    at_dir, at_mf, at_mini = 1, 1 + n_dir, 1 + n_dir + fat_mini_sectors
    dirs = entry("Root Entry", 5, 0xFFFFFFFF, 1, at_mini, len(mini))
    for k, (name, first, size) in enumerate(entries):
        dirs += entry(name, 2, k + 2 if k + 1 < len(entries) else 0xFFFFFFFF, 0xFFFFFFFF, first, size)
    chain = lambda a, n: [*range(a + 1, a + n), 0xFFFFFFFE]
    fat = [0xFFFFFFFD, *chain(at_dir, n_dir), *chain(at_mf, fat_mini_sectors), *chain(at_mini, mini_sectors)]
    head = CFB_MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIII", 0, 1, at_dir, 0)
    head += struct.pack("<IIIII", 4096, at_mf, fat_mini_sectors, 0xFFFFFFFE, 0) + struct.pack("<I", 0) + b"\xff" * 432
    ints = lambda v: struct.pack(f"<{len(v)}I", *v).ljust(-(-4 * len(v) // 512) * 512, b"\xff")
    return head + ints(fat) + dirs.ljust(512 * n_dir, b"\0") + ints(fat_mini) + mini.ljust(512 * mini_sectors, b"\0")


def make_pdf(pages: list, extra: bytes = b"", compress: bool = False, drawn: bytes = b"", widths: bool = True, pictures: list[tuple[bytes, bytes]] = ()) -> bytes:
    """A PDF of pages of (size, x, y, text); drawn: operators before the text of each page;
    pictures: (dictionary entries, body) of the image objects /P0, /P1, ...; without widths the
    font is a standard one."""
    objs = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica " + (b"/FirstChar 32 /LastChar 126 /Widths [" + b"500 " * 95 + b"] " if widths else b"") + b"/Encoding /WinAnsiEncoding >>",
    ]
    first = 4 + 2 * len(pages)
    named = b"/XObject << " + b" ".join(b"/P%d %d 0 R" % (i, first + i) for i in range(len(pictures))) + b" >>" if pictures else b""
    for i, p in enumerate(pages):
        s = "".join(f"BT /F1 {z} Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET\n" for z, x, y, t in p).encode("cp1252")
        s = drawn + s
        s = zlib.compress(s) if compress else s
        objs += [
            b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> %s >> >>" % (5 + 2 * i, named),
            b"<< /Length %d %s>>\nstream\n" % (len(s), b"/Filter /FlateDecode " if compress else b"") + s + b"\nendstream",
        ]
    for entries, body in pictures:
        objs.append(b"<< /Type /XObject /Subtype /Image %s /Length %d >>\nstream\n" % (entries, len(body)) + body + b"\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objs):
        at.append(len(out))
        out += b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n"
    x = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objs) + 1) + b"".join(b"%010d 00000 n \n" % o for o in at)
    return out + b"trailer\n<< /Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objs) + 1, extra, x)


def docx(title: str, rows: list) -> bytes:
    par = lambda t, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    items = "".join(par(n, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>') for _, n in rows)
    cells = lambda *v: "<w:tr>" + "".join(f"<w:tc>{par(x)}</w:tc>" for x in v) + "</w:tr>"
    table = "<w:tbl>" + cells("key", "name") + "".join(cells(k, n) for k, n in rows) + "</w:tbl>"
    body = par(title, '<w:pStyle w:val="Heading1"/>') + items + table
    return zipped({"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "docProps/core.xml": f'<cp xmlns:dc="d"><dc:title>{title}</dc:title></cp>'})


def pptx(title: str, rows: list) -> bytes:
    par = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = lambda kind, body: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    slide = f"<p:sld {NS}><p:cSld><p:spTree>{shape('title', par(title))}{shape('body', ''.join(par(n) for _, n in rows))}</p:spTree></p:cSld></p:sld>"
    return zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide})


def xlsx(title: str, rows: list) -> bytes:
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    body = f"<row>{text('A1', 'key')}{text('B1', 'name')}</row>" + "".join(f'<row><c r="A{i}"><v>{k}</v></c>{text(f"B{i}", n)}</row>' for i, (k, n) in enumerate(rows, 2))
    return zipped({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="{title}" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Type="t/worksheet" Target="worksheets/s.xml"/></R>',
        "xl/worksheets/s.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>",
    })


def xls(title: str, rows: list) -> bytes:
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = ["key", "name", *(n for _, n in rows)]
    sst = struct.pack("<II", len(strings), len(strings)) + b"".join(struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings)
    name = struct.pack("<BB", len(title), 0) + title.encode("latin-1")
    top = lambda at: rec(0x809, b"\0" * 16) + rec(0x85, struct.pack("<IBB", at, 0, 0) + name) + rec(0xE0, b"\0" * 20) + rec(0xFC, sst) + rec(0x0A, b"")
    label = lambda r, c, i: rec(0xFD, struct.pack("<HHHI", r, c, 0, i))
    sheet = rec(0x809, b"\0" * 16) + label(0, 0, 0) + label(0, 1, 1)
    for i, (k, _) in enumerate(rows, 1):
        sheet += rec(0x203, struct.pack("<HHHd", i, 0, 0, float(k))) + label(i, 1, i + 1)
    return compound({"Workbook": top(len(top(0))) + sheet + rec(0x0A, b"")})


def epub(title: str, rows: list) -> bytes:
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'}
    items = "".join(f'<item id="i{k}" href="{k}.xhtml" media-type="application/xhtml+xml"/>' for k, _ in reversed(rows))
    spine = "".join(f'<itemref idref="i{k}"/>' for k, _ in rows)
    parts["O/p.opf"] = f'<package xmlns:dc="d"><metadata><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    return zipped(parts | {f"O/{k}.xhtml": f"<html><body><h2>{n}</h2></body></html>" for k, n in rows})


def archive(title: str, rows: list) -> bytes:
    return zipped({f"{k}.txt": f"{n}\r\n" for k, n in rows} | {"none.txt": ""})


def ipynb(title: str, rows: list) -> bytes:
    cells = [{"cell_type": "markdown", "source": [f"# {title}"]}]
    cells += [{"cell_type": "code", "source": f"name({k})", "outputs": [{"output_type": "stream", "text": n}]} for k, n in rows]
    return json.dumps({"nbformat": 4, "metadata": {"title": title}, "cells": cells}).encode()


def rss(title: str, rows: list) -> bytes:
    items = "".join(f"<item><title>{n}</title><link>http://h/{k}</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description>&lt;b&gt;{n}&lt;/b&gt;</description></item>" for k, n in rows)
    return f"<rss><channel><title>{title}</title>{items}</channel></rss>".encode()


def msg(title: str, rows: list) -> bytes:
    props = b"\0" * 32 + struct.pack("<IIQ", 0x00390040, 0, 133485408000000000)
    text = "".join(f"<p>{n}</p>" for _, n in rows)
    return compound({"__substg1.0_0037001F": title.encode("utf-16-le"), "__substg1.0_0E04001F": "All".encode("utf-16-le"), "__substg1.0_10130102": text.encode(), "__properties_version1.0": props})


def pdf(title: str, rows: list) -> bytes:
    lines = [(24, 72, 720, title), (12, 72, 660, "key"), (12, 200, 660, "name")]
    for i, (k, n) in enumerate(rows, 1):
        lines += [(12, 72, 660 - 14 * i, k), (12, 200, 660 - 14 * i, n)]
    return make_pdf([lines], compress=True)


def png(title: str, rows: list) -> bytes:
    return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", len(rows), int(title.split()[-1]) + 1) + b"\0" * 200


BUILDERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "xls": xls, "epub": epub, "zip": archive, "ipynb": ipynb, "rss": rss, "msg": msg, "pdf": pdf, "png": png}


def build(kind: str, title: Column, rows: Column) -> Column:
    """A document of a kind, from a title and an array of (key, name) strings."""

    def run(titles: pa.Array, lists: pa.Array) -> pa.Array:
        made = [BUILDERS[kind](t, [(r["k"], r["n"]) for r in rs]) for t, rs in zip(titles.to_pylist(), lists.to_pylist())]
        return pa.array(made, pa.binary())

    return F.arrow_udf(run, "binary")(title, rows)
