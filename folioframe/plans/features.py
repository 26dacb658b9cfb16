"""Documents with the less common parts of each format, one for every row of part, and the
Markdown that they must become, as templates of key {k}, name {n} and size {s}.

The templates are the oracles' side: SQL fills them in from the same table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct

from folioframe.plans.builders import NS, compound, make_pdf, zipped

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 4, 3) + b"\0" * 200
_PNG_URI = "data:image/png;base64," + base64.b64encode(PNG).decode()
_CHART = (
    '<c:chartSpace {ns}><c:chart>{title}<c:plotArea><c:{kind}><c:ser><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>Sold</c:v></c:pt></c:strCache></c:strRef></c:tx>'
    '<c:cat><c:strRef><c:strCache><c:pt idx="0"><c:v>a</c:v></c:pt><c:pt idx="1"><c:v>b</c:v></c:pt></c:strCache></c:strRef></c:cat>'
    '<c:val><c:numRef><c:numCache><c:pt idx="1"><c:v>{s}</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:{kind}></c:plotArea></c:chart></c:chartSpace>'
)


def _chart(s: int, title: str = "", kind: str = "barChart") -> str:
    head = f"<c:title><c:tx><c:rich><a:p><a:r><a:t>{title}</a:t></a:r></a:p></c:rich></c:tx></c:title>" if title else ""
    return _CHART.format(ns=NS, title=head, kind=kind, s=s)


def docx(k: int, n: str, s: int) -> bytes:
    run = lambda t, props="": f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{t}</w:t></w:r>'
    par = lambda body, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"
    styled = lambda name, t: par(run(t), f'<w:pStyle w:val="{name}"/>')
    item = lambda t, level, number=1: par(run(t), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')
    cell = lambda t, props="": f"<w:tc>{f'<w:tcPr>{props}</w:tcPr>' if props else ''}{par(run(t))}</w:tc>"
    row = lambda *cells: f"<w:tr>{''.join(cells)}</w:tr>"
    body = [
        styled("Title", f"Part {k}"), styled("Subtitle", n), styled("Heading9", "deep"),
        par(run("size ", "<w:b/>") + run(str(s), "<w:b/>") + run(" is ") + run("both ", "<w:b/><w:i/>") + run("off", '<w:b w:val="0"/>')),
        par(run("tab") + "<w:r><w:tab/><w:t>ged</w:t><w:br/><w:t>next line</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins>" + run(" kept") + "</w:ins>"),
        par(f'<w:hyperlink r:id="h">{run("a link")}</w:hyperlink>{run(" and ")}<w:hyperlink w:anchor="x">{run("an anchor")}</w:hyperlink>'),
        item("first", 0), item("under", 1), item("under too", 1), item("second", 0), item("no number", 0, 2),
        par(run("between")), item("again from one", 0), styled("ListBullet2", "by style"), styled("ListNumber", "numbered by style"),
        "<w:tbl>" + row(cell("wide", '<w:gridSpan w:val="2"/>'), cell("c")) + row(cell("tall", '<w:vMerge w:val="restart"/>'), cell(str(s)), cell("x|y")) + row(cell("hidden", "<w:vMerge/>"), cell(n)) + "</w:tbl>",
        "<w:tbl>" + row(cell("boxed")) + "</w:tbl>",
        par(run("shapes") + f'<w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent>{par(run("in a box"))}</w:txbxContent></w:drawing></mc:Choice><mc:Fallback>{run("never")}</mc:Fallback></mc:AlternateContent></w:r>'
            '<w:r><w:drawing><c:chart r:id="c"/></w:drawing></w:r>'),
        par('<w:r><w:drawing><wp:docPr xmlns:wp="http://wp" name="Picture 7"/><a:blip r:embed="i"/></w:drawing></w:r>'),
        par('<w:r><w:drawing><wp:docPr xmlns:wp="http://wp" name="Picture 8" descr="a [small]&#10;picture"/><a:blip r:embed="gone"/></w:drawing></w:r>'),
    ]
    rel = lambda i, kind, target, more="": f'<Relationship Id="{i}" Type="t/{kind}" Target="{target}"{more}/>'
    rels = rel("h", "hyperlink", "http://x/a b(c)", ' TargetMode="External"') + rel("c", "chart", "charts/c.xml") + rel("c", "chart", "charts/second.xml") + rel("i", "image", "media/i.png") + rel("gone", "image", "media/none.png")
    level = lambda i, kind: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{kind}"/></w:lvl>'
    numbering = f'<w:abstractNum w:abstractNumId="5">{level(0, "lowerRoman")}{level(1, "bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="6">{level(0, "none")}</w:abstractNum>'
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="6"/></w:num>'
    return zipped({
        "word/document.xml": f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>", "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>",
        "word/numbering.xml": f"<w:numbering {NS}>{numbering}</w:numbering>", "word/charts/c.xml": _chart(s, f"Sales of {n}"), "word/media/i.png": PNG,
        "docProps/core.xml": f'<cp xmlns:dc="d"><dc:title> Core  {k} </dc:title></cp>',
    })


DOCX = (
    "# Part {k}\n\n## {n}\n\n###### deep\n\n**size {s}** is ***both*** off\n\ntab ged\nnext line kept\n\n[a link](http://x/a%20b%28c%29) and an anchor\n\n"
    "1. first\n  - under\n  - under too\n2. second\n- no number\n\nbetween\n\n1. again from one\n  - by style\n2. numbered by style\n\n"
    "| wide |  | c |\n| --- | --- | --- |\n| tall | {s} | x\\|y |\n|  | {n} |  |\n\nboxed\n\nshapes\n\nin a box\n\nSales of {n}\n\n"
    "|  | Sold |\n| --- | --- |\n| a |  |\n| b | {s} |\n\n![](" + _PNG_URI + ")\n\n![a small picture]()\n"
)


def pptx(k: int, n: str, s: int) -> bytes:
    par = lambda t, level=0: f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    shape = lambda kind, *ps: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(ps)}</p:txBody></p:sp>'
    slide = lambda *shapes: f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    cell = lambda t, more="": f"<a:tc{more}>{par(t)}</a:tc>"
    grid = f"<a:tr>{cell('both')}{cell('gone', ' hMerge="1"')}</a:tr><a:tr>{cell(str(s))}{cell(n)}</a:tr>"
    first = slide(
        shape("ctrTitle", par(f"Part {k}")), shape("subTitle", par(n)), shape("body", par("top"), par("deep", 2), par("deepest", 9)),
        f"<p:grpSp>{shape('body', par('grouped'))}</p:grpSp>", shape("ftr", par("footer")), f"<p:graphicFrame><a:tbl>{grid}</a:tbl></p:graphicFrame>",
        '<p:pic><p:nvPicPr><p:cNvPr name="Picture 4" descr="seen"/></p:nvPicPr><p:blipFill><a:blip r:embed="i"/></p:blipFill></p:pic>',
        '<p:graphicFrame><c:chart r:id="c"/></p:graphicFrame>',
    )
    rels = '<R><Relationship Id="n" Type="t/notesSlide" Target="../notesSlides/own.xml"/><Relationship Id="i" Type="t/image" Target="../media/i.png"/><Relationship Id="c" Type="t/chart" Target="../charts/c.xml"/></R>'
    return zipped({
        "ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide(shape("body", par("last"))), "ppt/slides/slide9.xml": first, "ppt/slides/_rels/slide9.xml.rels": rels,
        "ppt/notesSlides/own.xml": slide(shape("sldImg", par("no")), shape("sldNum", par("7")), shape("body", par("say this"), par("and that"))),
        "ppt/notesSlides/notesSlide2.xml": slide(shape("body", par("not asked for"))), "ppt/notesSlides/notesSlide10.xml": slide(shape("body", par(f"note {k}"))),
        "ppt/media/i.png": PNG, "ppt/charts/c.xml": _chart(s, kind="bar3DChart"),
    })


PPTX = (
    "## Slide 1\n\n### Part {k}\n\n{n}\n\n- top\n        - deep\n                                - deepest\n\n- grouped\n\n| both |  |\n| --- | --- |\n| {s} | {n} |\n\n![seen](" + _PNG_URI + ")\n\n"
    "### Chart\n\n| Category | Sold |\n| --- | --- |\n| a |  |\n| b | {s} |\n\n> **Notes:** say this\n>\n> and that\n\n## Slide 2\n\n- last\n\n> **Notes:** note {k}\n"
)


def xlsx(k: int, n: str, s: int) -> bytes:
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = [
        text("A1", "Section"), text("A2", "name") + text("B2", "size"), f'<c r="A3" t="s"><v>0</v></c><c r="B3"><v>{s}</v></c>', '<c r="A4" s="1"><v>45292.5</v></c><c r="B4" s="2"><v>0.125</v></c>',
        "", f'{text("D6", "apart")}<c r="E6" t="b"><v>1</v></c>', f'<c r="D7" t="str"><v>made {k}</v></c><c r="E7" t="e"><v>#N/A</v></c>', "", "", "", "", text("A12", "both") , text("B13", "corner"),
    ]
    sheet = "<worksheet><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + '</sheetData><mergeCells><mergeCell ref="A1:B1"/><mergeCell ref="A12:B12"/></mergeCells><drawing r:id="d" xmlns:r="http://r"/></worksheet>'
    legacy = lambda ref, who, t: f'<comment ref="{ref}" authorId="{who}"><text><r><t>{t}</t></r></text></comment>'
    threaded = lambda ref, who, time, t: f'<threadedComment ref="{ref}" personId="{who}" dT="{time}"><text>{t}</text></threadedComment>'
    return zipped({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Hidden" state="veryHidden" r:id="a"/><sheet name="Part {k}" r:id="a"/><sheet name="Empty" r:id="e"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Type="t/worksheet" Target="worksheets/s.xml"/><Relationship Id="e" Type="t/worksheet" Target="/xl/worksheets/e.xml"/></R>',
        "xl/worksheets/s.xml": sheet, "xl/worksheets/e.xml": "<worksheet><sheetData/></worksheet>", "xl/sharedStrings.xml": f"<sst><si><r><t>{n.split()[0]} </t></r><r><t>{n.split()[-1]}</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/_rels/s.xml.rels": '<R><Relationship Id="c" Type="t/comments" Target="../c.xml"/><Relationship Id="t" Type="t/threadedComment" Target="../t.xml"/><Relationship Id="d" Type="t/drawing" Target="../drawings/d.xml"/></R>',
        "xl/c.xml": f"<comments><authors><author>Ann</author></authors><commentList>{legacy('B3', 0, 'kept')}{legacy('A3', 0, 'replaced')}{legacy('D6', 9, 'by none')}</commentList></comments>",
        "xl/t.xml": f"<T>{threaded('A3', 'p1', '2024-05-06T07:08:09.1234', 'first')}{threaded('A3', 'p2', 'never', f'last {k}')}{threaded('E7', 'p1', '2024-05-06T07:08:09.5', 'timed')}</T>",
        "xl/persons/p.xml": '<personList><person id="p1" displayName="Bob"/></personList>',
        "xl/drawings/d.xml": f"<xdr {NS}><anchor><from><row>8</row></from><c:chart r:id='c'/></anchor></xdr>", "xl/drawings/_rels/d.xml.rels": '<R><Relationship Id="c" Type="t/chart" Target="../charts/c.xml"/></R>',
        "xl/charts/c.xml": _chart(s, "Growth"),
    })


XLSX = (
    "## Part {k}\n\n**Section**\n\n| name | size |\n| --- | --- |\n| {n} | {s} |\n| 2024-01-01 12:00:00 | 12.5% |\n\n| apart | TRUE |\n| --- | --- |\n| made {k} | #N/A |\n\n"
    "Growth\n\nBar chart\n\n|  | Sold |\n| --- | --- |\n| a |  |\n| b | {s} |\n\n| both | both |\n| --- | --- |\n|  | corner |\n\n"
    "[author: Unknown]: last {k}\n\n[author: Ann]: kept\n\nby none\n\n[author: Bob, time: 2024-05-06T07:08:09.500]: timed\n"
)


def html(k: int, n: str, s: int) -> bytes:
    page = f"""<!DOCTYPE html><html><head><meta charset="iso-8859-1"><title>Part &#{8470}; {k}</title><style>no</style></head><body><!-- not shown --><script>if (a < b) "</p>"</script>
<h1>{n} <em>big</em></h1><h2>  spaced
out </h2><p>caf\xe9 &amp; <strong> bold </strong>text<br>new line <code>a`b</code> <s>old</s></p><ul><li>one<ol start="3"><li>three<li>four</ol><li><p>two</p></ul>
<blockquote><p>said<p>twice</blockquote><pre><code class="language-sql">select {k};

  from t</code></pre><hr><table><caption>Sizes</caption><thead><tr><th>a|b<th colspan="2">{s}</thead><tr><td rowspan="2">x<td>1<td><b>2</b><tr><td>3<tr><td><td><td></table>
<table role="presentation"><tr><td>laid<td>out</table><figure><img src="/i.png" alt="left out"><figcaption>A figure</figcaption></figure><img alt="kept" src="data:image/png;base64,AA==">
<a href="../up?q=1#f">up</a><noscript>nor this</noscript></body></html>"""
    return page.encode("latin-1")


HTML = (
    "# {n} *big*\n\n## spaced out\n\ncafé & **bold** text  \nnew line ``a`b`` ~~old~~\n\n- one\n  3. three\n  4. four\n- two\n\n> said\n>\n> twice\n\n```sql\nselect {k};\n\n  from t\n```\n\n---\n\nSizes\n\n"
    "| a\\|b | {s} | {s} |\n| --- | --- | --- |\n| x | 1 | **2** |\n| x | 3 |  |\n\nlaid\n\nout\n\n![](http://h/i.png)\n\nA figure\n\n![kept](data:image/png;base64,AA==) [up](http://h/up?q=1#f)\n"
)


def ipynb(k: int, n: str, s: int) -> bytes:
    out = lambda kind, **data: {"output_type": kind, **data}
    cells = [
        {"cell_type": "markdown", "source": [f"# Part {k}\n", "text"]}, {"cell_type": "raw", "source": "raw as it is"},
        {"cell_type": "code", "source": ["a\n", "```\n"], "outputs": [
            out("stream", text=[f"{n}\n", "more\n"]), out("execute_result", data={"text/plain": str(s), "image/png": base64.b64encode(PNG).decode()}),
            out("display_data", data={"text/plain": "left out"}), out("error", ename="E", traceback=["left out"])]},
        {"cell_type": "code", "source": "", "outputs": []},
    ]
    return json.dumps({"nbformat": 4, "metadata": {"title": n, "kernelspec": {"language": "r"}}, "cells": cells}).encode()


IPYNB = "# Part {k}\ntext\n\nraw as it is\n\n````r\na\n```\n````\n\n```\n{n}\nmore\n```\n\n![output](" + _PNG_URI + ")\n\n```\n{s}\n```\n"


def csv(k: int, n: str, s: int) -> bytes:
    return f'﻿key;"the, name";size\r\n\r\n{k};"{n}";{s};more\r\n1;"two\nlines, ""said"""\r\n'.encode()


CSV = '| key | the, name | size |  |\n| --- | --- | --- | --- |\n| {k} | {n} | {s} | more |\n| 1 | two lines, "said" |  |  |\n'


def records(k: int, n: str, s: int) -> bytes:
    return f'[{{"z": {s}.50, "a": null}}, {{"a": "{n}", "b": true}}, {{"b": 1, "b": {k}, "c": "x|y"}}]'.encode()


RECORDS = "| z | a | b | c |\n| --- | --- | --- | --- |\n| {s}.50 |  |  |  |\n|  | {n} | true |  |\n|  |  | {k} | x\\|y |\n"


def atom(k: int, n: str, s: int) -> bytes:
    return (
        f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed {k}</title><subtitle> about \n this </subtitle><entry><title>{n} [new]</title>'
        '<link rel="edit" href="http://h/edit"/><link href="http://h/a b"/><updated>2024-03-04T05:06:07+02:00</updated><author><name>Ann</name></author>'
        f'<summary>unused</summary><content type="html">&lt;p&gt;size {s} &lt;a href="/up"&gt;up&lt;/a&gt;&lt;/p&gt;</content></entry>'
        "<entry><title></title><link href='http://h/bare'/><published>some day</published><summary>plain</summary></entry></feed>"
    ).encode()


ATOM = "# Feed {k}\n\nabout this\n\n## {n} [new]\n\n*2024-03-04T03:06:07Z — by Ann*\n\n[{n} \\[new\\]](http://h/a b)\n\nsize {s} [up](http://h/up)\n\n*some day*\n\n[http://h/bare](http://h/bare)\n\nplain\n"


def epub(k: int, n: str, s: int) -> bytes:
    item = lambda i, href, kind="application/xhtml+xml": f'<item id="{i}" href="{href}" media-type="{kind}"/>'
    opf = (
        f'<package xmlns:dc="d"><metadata><dc:title>Book {k}</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bob</dc:creator><dc:language>en</dc:language><dc:date>2024</dc:date></metadata><manifest>'
        + item("one", "text/one%20a.xhtml#top") + item("two", "../two.xhtml") + item("css", "s.css", "text/css") + item("out", "../../out.xhtml") + item("lost", "lost.xhtml")
        + '</manifest><spine><itemref idref="two"/><itemref idref="none"/><itemref idref="css"/><itemref idref="one"/><itemref idref="out"/><itemref idref="lost"/></spine></package>'
    )
    box = '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    one = f'<?xml version="1.0" encoding="utf-8"?><html><head><title>no</title></head><body><h2>One</h2><p>{n}</p></body></html>'
    return zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": box, "O/p.opf": opf, "O/text/one a.xhtml": one, "two.xhtml": f"<p>size {s}</p>", "O/s.css": "p {}", "out.xhtml": "<p>out</p>"})


EPUB = "# Book {k}\n\n- Author: Ann, Bob\n- Language: en\n- Date: 2024\n\nsize {s}\n\n## One\n\n{n}\n"


def archive(k: int, n: str, s: int) -> bytes:
    inner = zipped({"rows.csv": f"a,b\n{k},{s}\n"})
    return zipped({"b.txt": f"{n}\r\n", "none.txt": "", "folder/": "", "in/deep.zip": inner, "../up.txt": "no", "p.html": f"<h1>{n}</h1>", "bad.json": "{", "data.bin": "\0\1"})


def mail(k: int, n: str, s: int) -> bytes:
    u = lambda t: t.encode("utf-16-le")
    props = b"\0" * 32 + struct.pack("<IIQ", 0x00390040, 0, 133485408000000000 + s * 10_000_000)
    return compound({
        "__substg1.0_0037001F": u(f"Part {k}"), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_0C1F001F": u("a@b"), "__substg1.0_0E04001E": "Bö".encode("latin-1"), "__substg1.0_0E03001F": u("Cy|d"),
        "__substg1.0_1000001F": u(f"{n}\r\nplain\r\n"), "__properties_version1.0": props,
    })


MAIL = "# Part {k}\n\n| Field | Value |\n| --- | --- |\n| From | Ann <a@b> |\n| To | Bö |\n| Cc | Cy\\|d |\n| Date | 2024-01-01 00:00:{ss} UTC |\n\n{n}\nplain\n"


def photo(k: int, n: str, s: int) -> bytes:
    """A JPEG with camera tags and a place."""
    rational = lambda *v: b"".join(struct.pack("<II", a, b) for a, b in v)
    make = n.encode() + b"\0"
    place = [(1, 2, 2, b"S\0\0\0"), (2, 5, 3, rational((10, 1), (30, 1), (36, 1))), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, rational((s, 1), (0, 1), (0, 1)))]
    main = [(0x010F, 2, len(make), make), (0x8825, 4, 1, None), (0x829A, 5, 1, rational((2, 250))), (0x829D, 5, 1, rational((28, 10))), (0x920A, 5, 1, rational((s * 2, 2)))]

    def table(tags: list, at: int, gps: int) -> bytes:
        head, pool, base = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
        for tag, kind, count, raw in tags:
            raw = struct.pack("<I", gps) if raw is None else raw
            inline = len(raw) <= 4
            head += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if inline else struct.pack("<I", base + len(pool)))
            pool += b"" if inline else raw
        return head + b"\0" * 4 + pool

    first = table(main, 8, 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + table(main, 8, 8 + len(first)) + table(place, 8 + len(first), 0)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", s, 6) + b"\0" * 100


PHOTO = (
    "![photo.jpg]()\n\na picture of 6 by {s}\n\n- Dimensions: 6 × {s}\n- Format: jpeg\n\n| Tag | Value |\n| --- | --- |\n| Make | {n} |\n| FNumber | f/2.8 |\n| ExposureTime | 1/125 s |\n| FocalLength | {s} mm |\n"
    "| GPS Latitude | -10.510000 |\n| GPS Longitude | {s}.000000 |\n"
)


def sound(k: int, n: str, s: int) -> bytes:
    return b"RIFF\0\0\0\0WAVE" + n.encode()


SOUND = "# Transcript\n\n- Source: speech.wav\n\nheard {n} as audio/wav\n"


def pdf(k: int, n: str, s: int) -> bytes:
    head = (9, 72, 770, "Running head 1")
    one = [
        head, (24, 72, 700, f"Part {k}"), (12, 72, 660, f"The {n} is made of well-known parts, some of"), (12, 72, 646, "which are heavy and some of which are a com-"), (12, 72, 632, "bination of a well-"), (12, 72, 618, "known kind."),
        (17, 72, 580, "1.2 Numbered"), (12, 72, 550, "- first item"), (12, 72, 536, "- second item"), (12, 72, 522, "goes on"),
        (12, 72, 480, "name"), (12, 250, 480, "size"), (12, 72, 466, n), (12, 250, 466, str(s)), (12, 72, 452, "other"), (12, 250, 452, "7"),
    ]
    two = [(9, 72, 770, "Running head 2"), (12, 72, 700, "name"), (12, 250, 700, "size"), (12, 72, 686, "third"), (12, 250, 686, "8"), (12, 72, 672, "fourth"), (12, 250, 672, "9")]
    three = [(9, 72, 770, "Running head 3"), (12, 72, 700, "The last page has a line"), (12, 72, 686, "of text.")]
    return make_pdf([one, two, three], compress=k % 2 == 0)


PDF = (
    "Running head 1\n\n# Part {k}\n\nThe {n} is made of well-known parts, some of which are heavy and some of which are a combination of a well-known kind.\n\n### 1.2 Numbered\n\n"
    "- first item\n- second item goes on\n\n| name | size |\n| --- | --- |\n| {n} | {s} |\n| other | 7 |\n| third | 8 |\n| fourth | 9 |\n\n---\n\nThe last page has a line of text.\n"
)

ZIP = (
    "## b.txt\n\n{n}\n\n## in/deep.zip\n\n## rows.csv\n\n| a | b |\n| --- | --- |\n| {k} | {s} |\n\n## ../up.txt\n\n*[could not convert: unsafe entry path]*\n\n## p.html\n\n# {n}\n\n"
    "## bad.json\n\n{\n\n## data.bin\n\n*[could not convert: no format accepts the document]*\n"
)

GREYS = b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(150))


def layout(k: int, n: str, s: int) -> bytes:
    """Two columns under a heading, a picture, a ruled table with gaps, bold and numbered headings, an outline."""
    column = lambda x, name: [(10, x, 640 - 14 * i, f"{name} column line {i} says {n}") for i in range(6)]
    page = [(20, 60, 720, f"Layout of part {k}")] + column(60, "left") + column(330, "right")
    page += [(10, 60, 460, "2.1 Known to the outline"), (10, 60, 420, "Above the picture."), (10, 60, 300, "Below the picture.")]
    page += [(10, x, y, t) for x, y, t in ((60, 250, "a"), (180, 250, "b"), (300, 250, "c"), (60, 236, "1"), (300, 236, str(s)), (180, 222, "2"), (60, 222, "y"), (60, 208, "z"), (420, 208, "far"), (60, 194, "q"), (500, 194, "r"))]
    rules = b"60 246 400 1 re f 60 232 400 1 re f 60 218 400 1 re f q 120 0 0 90 60 315 cm /P0 Do Q\n"
    grey = bytes((x + k) & 255 for x in GREYS)
    data = make_pdf([page], drawn=rules, pictures=[(b"/Width 80 /Height 60 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /ASCIIHexDecode", grey.hex().encode() + b">")])
    # an outline of two levels, as a second version of the catalogue at the end of the file
    at = len(data)
    entries = (
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 90 0 R >>", b"<< /First 91 0 R >>", b"<< /Title (Nothing here) /First 92 0 R >>", b"<< /Title (2.1 Known to the outline.) >>",
    )
    places, body = [], b""
    for number, entry in zip((1, 90, 91, 92), entries):
        places.append(b"%d 1\n%010d 00000 n \n" % (number, at + len(body)))
        body += b"%d 0 obj\n" % number + entry + b"\nendobj\n"
    before = int(re.findall(rb"startxref\n(\d+)", data)[-1])
    xref = at + len(body)
    return data + body + b"xref\n" + b"".join(places) + b"trailer\n<< /Size 93 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (before, xref)


LAYOUT = (
    "# Layout of part {k}\n\n" + " ".join(f"left column line {i} says {{n}}" for i in range(6)) + "\n\n" + " ".join(f"right column line {i} says {{n}}" for i in range(6))
    + "\n\n## 2.1 Known to the outline\n\nAbove the picture.\n\n![a picture of 4800 greys from {k}]()\n\nBelow the picture.\n\n"
    "| a | b | c |  |  |\n| --- | --- | --- | --- | --- |\n| 1 |  | {s} |  |  |\n| y | 2 |  |  |  |\n| z |  |  | far |  |\n| q |  |  |  | r |\n"
)


def pictured(k: int, n: str, s: int) -> bytes:
    """Pictures for a budget: one, the same again, another, one too small to matter."""
    par = lambda i: f'<w:p><w:r><w:drawing><wp:docPr xmlns:wp="http://wp" name="n" descr="{i}"/><a:blip r:embed="{i}"/></w:drawing></w:r></w:p>'
    names = ("one", "again", "other", "dot", "small")
    rels = "".join(f'<Relationship Id="{i}" Type="t/image" Target="media/{i}.png"/>' for i in names)
    other, small = PNG[:-1] + b"\1", PNG[:150]
    media = {"one": PNG, "again": PNG, "other": other, "dot": PNG[:60], "small": small}
    return zipped({"word/document.xml": f"<w:document {NS}><w:body>{''.join(map(par, names))}</w:body></w:document>", "word/_rels/document.xml.rels": f"<Relationships>{rels}</Relationships>"} | {f"word/media/{i}.png": b for i, b in media.items()})


PICTURED = "![one](" + _PNG_URI + ")\n\n![again](" + _PNG_URI + ")\n\n![other]()\n\n![dot]()\n\n![small](data:image/png;base64," + base64.b64encode(PNG[:150]).decode() + ")\n"


#: Builder, expected Markdown and hints (extension, MIME type, file name, URL).
FEATURES = {
    "docx": (docx, DOCX, {}), "pptx": (pptx, PPTX, {}), "xlsx": (xlsx, XLSX, {}), "html": (html, HTML, {"url": "http://h/d/"}), "ipynb": (ipynb, IPYNB, {}), "csv": (csv, CSV, {"mime": "Text/CSV; charset=x"}),
    "records": (records, RECORDS, {"ext": ".json"}), "atom": (atom, ATOM, {"ext": ".xml"}), "epub": (epub, EPUB, {}), "zip": (archive, ZIP, {}), "msg": (mail, MAIL, {}),
    "photo": (photo, PHOTO, {"file_name": "photo.jpg"}), "sound": (sound, SOUND, {"file_name": "speech.wav", "ext": ".wav"}), "pdf": (pdf, PDF, {}),
    "layout": (layout, LAYOUT, {}), "pictured": (pictured, PICTURED, {}),
}


def fill(template: str, k: int, n: str, s: int) -> str:
    return re.sub(r"\{(k|n|s|ss)\}", lambda m: {"k": str(k), "n": n, "s": str(s), "ss": f"{s:02d}"}[m[1]], template)


def as_sql(template: str) -> str:
    """The template as a SQL expression over part."""
    values = {"k": "CAST(p_partkey AS VARCHAR)", "n": "p_name", "s": "CAST(p_size AS VARCHAR)", "ss": "lpad(CAST(p_size AS VARCHAR), 2, '0')"}
    parts = re.split(r"\{(k|n|s|ss)\}", template)
    return " || ".join(values[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))
