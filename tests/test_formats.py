"""Parsers against hand-made documents."""

import base64
import json
import struct

import pytest

from folioframe.operators.convert import convert_one, recognise
from folioframe.operators.formats import binary, emit, html, office, packages, pdf, plain
from folioframe.operators.formats.emit import ConvertError, Info, Options
from folioframe.plans import builders
from folioframe.plans.builders import compound, make_pdf


def md(f, data, **info):
    options = info.pop("options", Options())
    return f(data.encode() if isinstance(data, str) else data, Info(**info), options).markdown


def zipped(parts):
    return builders.zipped(parts)


def test_csv():
    assert md(plain.convert_csv, "a,b,c\n1\n1,2,3,4\n", ext=".csv") == "| a | b | c |  |\n| --- | --- | --- | --- |\n| 1 |  |  |  |\n| 1 | 2 | 3 | 4 |\n"
    assert md(plain.convert_csv, b"\xef\xbb\xbfa\tb,c\r\n1\t2\r\n", ext=".tsv").splitlines()[0] == "| a | b,c |"
    assert md(plain.convert_csv, 'a;b\n"x\ny";2\n', mime="text/csv").splitlines()[2] == "| x y | 2 |"
    assert md(plain.convert_csv, "", ext=".csv") == ""


def test_json():
    t = '[{"b": 9.50, "a": null}, {"a": "x|y", "c": true}, {"c": 1, "c": 2}]'
    assert md(plain.convert_json, t) == "| b | a | c |\n| --- | --- | --- |\n| 9.50 |  |  |\n|  | x\\|y | true |\n|  |  | 2 |\n"
    assert md(plain.convert_json, '{"z":[1,{}],"a":"é"}') == '```json\n{\n  "z": [\n    1,\n    {}\n  ],\n  "a": "é"\n}\n```\n'
    for bad in ('{"a":1} x', "[NaN]", "{"):
        assert not plain.is_json(bad.encode())
        with pytest.raises(ConvertError):
            md(plain.convert_json, bad)


def test_notebook():
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"0" * 200).decode()
    nb = {"nbformat": 4, "metadata": {"title": "T", "kernelspec": {"language": "julia"}}, "cells": [
        {"cell_type": "markdown", "source": ["# h\n", "x"]},
        {"cell_type": "code", "source": "1+1", "outputs": [
            {"output_type": "stream", "text": ["out\n"]}, {"output_type": "execute_result", "data": {"text/plain": "2"}},
            {"output_type": "display_data", "data": {"image/png": png, "text/plain": "no"}}, {"output_type": "display_data", "data": {"image/png": "!!"}}]}]}
    got = md(plain.convert_ipynb, json.dumps(nb))
    assert got.startswith("# h\nx\n\n```julia\n1+1\n```\n\n```\nout\n```\n\n```\n2\n```\n\n![output](data:image/png;base64,") and "no" not in got.split("base64")[0]
    with pytest.raises(ConvertError):
        md(plain.convert_ipynb, "{}")


def test_html_blocks():
    page = (
        "<title>T &amp; x</title><style>no</style><script>var a='</p>'</script><!-- no --><h1>Hi <b>you</b></h1><p>one<p>two <i>x </i>y<br>z"
        "<ul><li>a<ul><li>b</ul><li>c</ul><ol start=3><li>x</ol><blockquote><p>q</blockquote><pre><code class=language-py>a\n b</code></pre><hr>"
        "<table><caption>cap</caption><tr><th>a|b<th colspan=2>c</tr><tr><td rowspan=2>1<td>2<td>3<tr><td>4</table>"
        "<p><del>gone</del> <a href='/p q'>link</a> <img src=i.png alt='x]y'></p><noscript>no</noscript>"
    )
    r = html.convert(page.encode(), Info(url="http://h/d/"), Options())
    assert r.title == "T & x"
    assert r.markdown == (
        "# Hi **you**\n\none\n\ntwo *x* y  \nz\n\n- a\n  - b\n- c\n\n3. x\n\n> q\n\n```py\na\n b\n```\n\n---\n\ncap\n\n"
        "| a\\|b | c | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 1 | 4 |  |\n\n~~gone~~ [link](http://h/p%20q) ![x y](http://h/d/i.png)\n"
    )
    assert md(html.convert, "<table role=presentation><tr><td>a<td>b</table>") == "a\n\nb\n"
    assert md(html.convert, "<figure><img src=a alt=z><figcaption>C</figcaption></figure>") == "![](a)\n\nC\n"
    assert md(html.convert, "<figure><img src=a alt=z></figure>") == "![z](a)\n"
    assert md(html.convert, "<table><tr><td>a<table><tr><td>in</table></table><table></table>") == "| ain |\n| --- |\n"
    assert html.decode(b'<meta charset="iso-8859-1">\xe9') .endswith("é") and html.decode("é".encode("utf-16")) == "é"
    assert html.decode(b'<meta charset="utf-8">\xe9', "iso-8859-1").endswith("é")


def test_html_markup():
    got = lambda t: html.convert(t.encode(), Info(), Options())
    assert got("<title>a &amp; <b>c</title><p>x").title == "a & <b>c"
    for page, want in (
        ("a < b <!-- > --> c<!--> d <?php > e <!x> f", "a < b c d e f"), ("<p a='>' b=\">\">x", "x"), ("<script>'</p><p>'</SCRIPT >x<style>", "x"), ("<a href=u title=\"un>t</a> z", "[t](u) z"),
        ("<A HREF='u&amp;v' href=w>t</a >", "[t](u&v)"), ("<br/>a<br>b<img src=s alt='&lt;'/>", "a  \nb![<](s)"), ("&lt;p&gt; &copy;", "<p> ©"), ("<p <b>x", "x"), ("x<", "x<"),
    ):
        assert got(page).markdown == want + "\n", page
    assert len(got("<p " + "a='" * 200_000).markdown) > 0  # no slow match


def test_html_links():
    root = html.parse('<base href="/b/"><a href="x#f">1</a><a href="x">2</a><a href="#t"></a><a href="mailto:a@b"></a><a href="//o/p">3</a>')
    assert html.links_of(root, "http://h/d/") == ["http://h/b/x", "http://o/p"]


def test_feeds():
    rss = """<?xml version="1.0"?><rss version="2.0"><channel><title>F</title><description>D  d</description><item><title>A[1]</title><link>http://h/a b</link>
    <pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate><author>me</author><description>&lt;p&gt;x &lt;a href="/r"&gt;r&lt;/a&gt;&lt;/p&gt;</description></item></channel></rss>"""
    assert md(packages.convert_rss, rss) == "# F\n\nD d\n\n## A[1]\n\n*2024-01-02T02:04:05Z — by me*\n\n[A\\[1\\]](http://h/a b)\n\nx [r](http://h/r)\n"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link href="http://h/e"/><updated>when</updated><content type="html">hey</content></entry></feed>'
    assert md(packages.convert_rss, atom) == "# F\n\n## E\n\n*when*\n\n[E](http://h/e)\n\nhey\n"


def test_zip_and_depth():
    inner = zipped({"a.csv": "x,y\n1,2\n"})
    data = zipped({"b.txt": "hello\r\n", "empty.txt": "", "../up.txt": "no", "in.zip": inner, "bad.docx": "junk"})
    got = convert_one(data, "zip", Info(file_name="z.zip"), Options())
    assert got.title == "z.zip"
    assert "## b.txt\n\nhello" in got.markdown and "empty" not in got.markdown and "unsafe entry path" in got.markdown
    assert "## in.zip\n\n## a.csv\n\n| x | y |" in got.markdown and "## bad.docx\n\n*[could not convert:" in got.markdown
    assert "nest too deeply" in convert_one(data, "zip", Info(), Options(max_depth=1)).markdown
    with pytest.raises(ConvertError):
        convert_one(b"PK\x03\x04broken", "zip", Info(), Options())


def test_archives_have_a_budget(monkeypatch):
    monkeypatch.setattr(packages, "MAX_TOTAL", 1000)
    assert convert_one(zipped({"a.txt": "x" * 400, "b.txt": "y" * 400}), "zip", Info(), Options()).markdown.count("## ") == 2
    with pytest.raises(ConvertError) as e:
        convert_one(zipped({"a.txt": "x" * 400, "b.txt": "y" * 700}), "zip", Info(), Options())
    assert e.value.code == "convert_failed"


def test_epub():
    data = zipped({
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>en</dc:language></metadata><manifest>'
        '<item id="2" href="two%20x.xhtml" media-type="application/xhtml+xml"/><item id="1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="3" href="../../e.xhtml" media-type="text/html"/></manifest>'
        '<spine><itemref idref="1"/><itemref idref="9"/><itemref idref="2"/><itemref idref="3"/></spine></package>',
        "O/one.xhtml": '<?xml version="1.0" encoding="iso-8859-1"?><html><body><h1>One é</h1></body></html>'.encode("latin-1"), "O/two x.xhtml": "<p>Two</p>"})
    assert md(packages.convert_epub, data) == "# Book\n\n- Author: A, B\n- Language: en\n\n# One é\n\nTwo\n"
    assert recognise(data, Info()) == "epub"


W = 'xmlns:w="http://w" xmlns:r="http://r" xmlns:a="http://a" xmlns:mc="http://mc" xmlns:p="http://p" xmlns:c="http://c"'


def test_docx():
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bo</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">ld </w:t></w:r><w:r><w:t>plain</w:t><w:tab/><w:t>x</w:t></w:r>'
        '<w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:hyperlink r:id="h"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>sub</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>alone</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    parts = {
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="h" Type="t/hyperlink" Target="http://x/(y)" TargetMode="External"/></Relationships>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "docProps/core.xml": '<cp xmlns:dc="d"><dc:title>Core</dc:title></cp>',
    }
    r = office.convert_docx(zipped(parts), Info(), Options())
    assert r.title == "Core"
    assert r.markdown == "# Head\n\n**bold** plain x[link](http://x/%28y%29)\n\n1. one\n  - sub\n2. two\n\n| a |  |\n| --- | --- |\n| b | c |\n\nalone\n"


def test_pptx():
    sp = lambda kind, *ps: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{"".join(ps)}</p:txBody></p:sp>'
    par = lambda t, lvl=0: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    slide = lambda *x: f'<p:sld {W}><p:cSld><p:spTree>{"".join(x)}</p:spTree></p:cSld></p:sld>'
    tbl = f'<p:graphicFrame><a:tbl><a:tr><a:tc>{par("h")}</a:tc><a:tc>{par("i")}</a:tc></a:tr><a:tr><a:tc>{par("1")}</a:tc><a:tc>{par("2")}</a:tc></a:tr></a:tbl></p:graphicFrame>'
    parts = {
        "ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide(sp("body", par("ten"))), "ppt/slides/slide2.xml": slide(sp("title", par("Two")), sp("body", par("x"), par("y", 1)), tbl),
        "ppt/slides/_rels/slide2.xml.rels": '<R><Relationship Id="n" Type="t/notesSlide" Target="../notesSlides/n.xml"/></R>',
        "ppt/notesSlides/n.xml": slide(sp("sldNum", par("9")), sp("body", par("note"))),
    }
    assert md(office.convert_pptx, zipped(parts)) == "## Slide 1\n\n### Two\n\n- x\n    - y\n\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\n> **Notes:** note\n\n## Slide 2\n\n- ten\n"


def test_xlsx():
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" s="1"><v>45292</v></c><c r="B2"><v>2.5</v></c></row><row><c r="D5" t="b"><v>1</v></c></row>'
    parts = {
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" sheetId="1" r:id="a"/><sheet name="H" state="hidden" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Type="t/worksheet" Target="worksheets/s.xml"/><Relationship Id="b" Type="t/worksheet" Target="worksheets/s.xml"/></R>',
        "xl/worksheets/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
        "xl/sharedStrings.xml": "<sst><si><r><t>da</t></r><r><t>te</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/_rels/s.xml.rels": '<R><Relationship Id="c" Type="t/comments" Target="../comments.xml"/></R>',
        "xl/comments.xml": '<comments><authors><author>Me</author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>why</t></r></text></comment></commentList></comments>',
    }
    assert md(office.convert_xlsx, zipped(parts)) == "## S\n\n| date | n |\n| --- | --- |\n| 2024-01-01 | 2.5 |\n\n| TRUE |\n| --- |\n\n[author: Me]: why\n"
    s = office.Sheet()
    s.cells = {(0, 0): "Label", (1, 0): "a", (1, 1): "b", (2, 0): "1", (2, 1): "2"}
    s.merged = [(0, 0, 0, 1)]
    assert s.tables() == [(1, ["**Label**", "| a | b |\n| --- | --- |\n| 1 | 2 |"])]
    assert office.shown("0.256", "0.0%") == "25.6%" and office.shown("1234.5", "#,##0.00") == "1,234.50" and office.cell_ref("AB12") == (11, 27)


def test_mail():
    u = lambda s: s.encode("utf-16-le")
    props = b"\0" * 32 + struct.pack("<IIQ", 0x00390040, 0, 133485408000000000)
    data = compound({"__substg1.0_0037001F": u("Subject"), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_0C1F001F": u("a@b"), "__substg1.0_0E04001E": "Bö".encode("latin-1"),
                     "__substg1.0_10130102": b"<p>Hi <b>there</b></p>", "__properties_version1.0": props})
    assert recognise(data, Info()) == "msg"
    assert md(binary.convert_msg, data) == "# Subject\n\n| Field | Value |\n| --- | --- |\n| From | Ann <a@b> |\n| To | Bö |\n| Date | 2024-01-01 00:00:00 UTC |\n\nHi **there**\n"
    bad = data[:44] + struct.pack("<I", 0x7FFFFFFF) + data[48:]
    with pytest.raises(ConvertError):
        md(binary.convert_msg, bad)


def test_old_workbook():
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 0) + b"hi" + struct.pack("<HB", 1, 1) + "é".encode("utf-16-le")
    name = struct.pack("<BB", 1, 0) + b"S"
    top = lambda at: rec(0x809, b"\0" * 16) + rec(0x85, struct.pack("<IBB", at, 0, 0) + name) + rec(0xE0, struct.pack("<HH", 0, 0) + b"\0" * 16) + rec(0xFC, sst) + rec(0x0A, b"")
    sheet = rec(0x809, b"\0" * 16) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += rec(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2)) + rec(0x0A, b"")
    data = compound({"Workbook": top(len(top(0))) + sheet})
    assert recognise(data, Info()) == "xls"
    assert md(binary.convert_xls, data) == "## S\n\n| hi | é |\n| --- | --- |\n| 2.5 | 7 |\n"
    with pytest.raises(ConvertError) as e:
        binary._Biff(rec(0, b"") * 5000, 0.0).globals()
    assert e.value.code == "parse_timeout"


def test_images_and_audio():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 5) + b"\0" * 200
    got = md(binary.convert_image, png, file_name="p.png")
    assert got.startswith("![p.png](data:image/png;base64,") and got.endswith("- Dimensions: 3 × 5\n- Format: png\n")
    assert md(binary.convert_image, png, file_name="p.png", options=Options(drop_images=True)).startswith("![p.png]()")
    tags = [(0x010F, 2, 5, b"Acme\0"), (0x829D, 5, 1, struct.pack("<II", 28, 10)), (0x829A, 5, 1, struct.pack("<II", 1, 60))]
    at, table, pool = 8 + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, n, raw in tags:
        table += struct.pack("<HHII", tag, kind, n, at + len(pool))
        pool += raw
    tiff = b"II*\0" + struct.pack("<IH", 8, len(tags)) + table + b"\0" * 4 + pool
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xc0\0\x11\x08" + struct.pack(">HH", 4, 6) + b"\0" * 100
    assert binary.dimensions(jpeg) == (6, 4)
    assert binary.exif_table(jpeg) == "| Tag | Value |\n| --- | --- |\n| Make | Acme |\n| FNumber | f/2.8 |\n| ExposureTime | 1/60 s |"
    with pytest.raises(ConvertError):
        binary.convert_audio(b"ID3", Info(), Options())
    assert binary.convert_audio(b"ID3", Info(file_name="a.mp3"), Options(), lambda d, m: " hi ").markdown == "# Transcript\n\n- Source: a.mp3\n\nhi\n"
    b = emit.ImageBudget(Options(max_image_total=300))
    assert b.uri("image/png", b"a" * 200) and b.uri("image/png", b"a" * 200) and not b.uri("image/png", b"b" * 200)


def test_pdf():
    page1 = [(24, 72, 700, "Big Title"), (12, 72, 660, "First line of a para-"), (12, 72, 646, "graph that goes on."), (12, 72, 600, "Name"), (12, 200, 600, "Qty"),
             (12, 72, 586, "Apple"), (12, 200, 586, "3"), (12, 72, 572, "Pear"), (12, 200, 572, "4")]
    want = "# Big Title\n\nFirst line of a paragraph that goes on.\n\n| Name | Qty |\n| --- | --- |\n| Apple | 3 |\n| Pear | 4 |\n\n---\n\n- one\n- two\n"
    for compress in (False, True):
        assert md(pdf.convert_pdf, make_pdf([page1, [(12, 72, 700, "- one"), (12, 72, 686, "- two")]], compress=compress)) == want
    broken = make_pdf([[(12, 72, 700, "still read")]]).replace(b"startxref\n", b"startxref\n9")
    assert md(pdf.convert_pdf, broken) == "still read\n"
    for data, code in ((make_pdf([[]]), "no_text_layer"), (make_pdf([[(12, 7, 7, "x")]], b"/Encrypt 1 0 R "), "encrypted"), (b"%PDF-1.4 cut", "convert_failed"), (b"%PDF-2.0\n%%EOF", "convert_failed")):
        with pytest.raises(ConvertError) as e:
            md(pdf.convert_pdf, data)
        assert e.value.code == code


def test_pdf_furniture_and_columns():
    pages = [[(9, 72, 780, f"Running head {k}"), (12, 72, 700, f"Body of page {k} is here.")] for k in range(4)]
    got = md(pdf.convert_pdf, make_pdf(pages))
    assert got.count("Running head") == 1 and got.count("Body of page") == 4
    left = [(10, 50, 700 - 14 * i, f"left words number {i} go") for i in range(14)]
    right = [(10, 350, 700 - 14 * i, f"right words number {i} go") for i in range(14)]
    got = md(pdf.convert_pdf, make_pdf([left + right]))
    assert got.index("left words number 13") < got.index("right words number 0")


def test_pdf_pictures_stand_where_they_are_drawn():
    import zlib

    rgb = bytes(range(48)) * 40
    pictures = [
        (b"/Width 20 /Height 32 /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(rgb)), (b"/Width 9 /Height 9 /Filter /DCTDecode", b"\xff\xd8\xff" + b"j" * 200),
        (b"/Width 40 /Height 30 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter [/ASCIIHexDecode]", bytes(i * i % 251 for i in range(1200)).hex().encode() + b">"), (b"/Width 9 /Height 9 /ColorSpace /DeviceCMYK /BitsPerComponent 8", b"c" * 324),
    ]
    drawn = b"q 100 0 0 80 72 560 cm /P0 Do Q q 50 0 0 40 72 660 cm /P1 Do Q q 10 0 0 10 72 100 cm /P2 Do /P3 Do Q\n"
    data = make_pdf([[(12, 72, 720, "Above both."), (12, 72, 650, "Between them."), (12, 72, 540, "Below both.")]], drawn=drawn, pictures=pictures)
    got = md(pdf.convert_pdf, data)
    blocks = got.strip().split("\n\n")
    assert [b[:26] for b in blocks] == ["Above both.", "![](data:image/jpeg;base64", "Between them.", "![](data:image/png;base64,", "Below both.", "![](data:image/png;base64,"]
    png = base64.b64decode(blocks[3].partition("base64,")[2].rstrip(")"))
    assert binary.dimensions(png) == (20, 32) and b"".join(zlib.decompress(png[png.index(b"IDAT") + 4 :])[i * 61 + 1 : (i + 1) * 61] for i in range(32)) == rgb
    assert md(pdf.convert_pdf, data, options=Options(drop_images=True)) == "Above both.\n\nBetween them.\n\nBelow both.\n"
    said = pdf.convert_pdf(data, Info(), Options(drop_images=True), lambda d, m: f"{m} of {len(d) > 300}").markdown
    assert "![" not in said  # too small to ask about
    big = make_pdf([[(12, 72, 720, "x")]], drawn=b"q 9 0 0 9 72 560 cm /P0 Do Q /P0 Do\n", pictures=[(b"/Width 9 /Height 9 /Filter /DCTDecode", b"\xff\xd8\xff" + b"j" * 5000)])
    asked = []
    said = pdf.convert_pdf(big, Info(), Options(drop_images=True), lambda d, m: asked.append(len(d)) or f"{m}\nseen").markdown
    assert said == "x\n\n![image/jpeg seen]()\n\n![image/jpeg seen]()\n" and asked == [5003]


def test_pdf_reading_order():
    column = lambda x, name, n=10, y=640: [(10, x, y - 14 * i, f"{name} line {i} of the text") for i in range(n)]
    page = [(20, 60, 740, "A heading over all of the columns of this page")] + column(40, "left") + column(230, "middle") + column(420, "right") + [(10, 40, 440, "A closing line below them all, as wide as the whole page is and more")]
    got = md(pdf.convert_pdf, make_pdf([page]))
    places = [got.index(x) for x in ("A heading", "left line 0", "left line 9", "middle line 0", "middle line 9", "right line 0", "right line 9", "A closing line")]
    assert places == sorted(places)
    rows = [(10, x, 700 - 14 * i, t) for i in range(8) for x, t in ((40, f"k{i}"), (230, f"v{i}"), (420, f"w{i}"))]
    assert md(pdf.convert_pdf, make_pdf([rows])).count("\n| k") == 7  # a table, not three columns
    two = [(10, 40, 740, "One band of plain words that goes across")] + column(40, "a", 6, 700) + column(320, "b", 6, 700) + column(40, "c", 6, 560) + column(320, "d", 6, 560)
    got = md(pdf.convert_pdf, make_pdf([two]))
    places = [got.index(x) for x in ("a line 5", "b line 0", "b line 5", "c line 0", "c line 5", "d line 0")]
    assert places == sorted(places)


def test_pdf_rules_and_standard_widths():
    rows = [(12, 72, 700, "a"), (12, 200, 700, "b"), (12, 330, 700, "c"), (12, 72, 686, "1"), (12, 330, 686, "x"), (12, 200, 672, "2"), (12, 72, 672, "y"), (12, 72, 658, "z"), (12, 460, 658, "far"), (12, 72, 644, "q"), (12, 530, 644, "r")]
    rules = b"72 695 400 1 re f 72 681 400 1 re f 72 667 400 1 re f\n"
    assert "|" not in md(pdf.convert_pdf, make_pdf([rows]))
    assert md(pdf.convert_pdf, make_pdf([rows], drawn=rules)) == "| a | b | c |  |  |\n| --- | --- | --- | --- | --- |\n| 1 |  | x |  |  |\n| y | 2 |  |  |  |\n| z |  |  | far |  |\n| q |  |  |  | r |\n"
    w = pdf.standard_widths("ABCDEF+Helvetica")
    assert (w[ord("i")], w[ord("W")], w[ord(" ")]) == (222, 944, 278) and pdf.standard_widths("Times-Bold")[ord("m")] == 833 and pdf.standard_widths("Courier-Oblique")[65] == 600
    assert pdf.standard_widths("Unheard") == {}
    # letters set one by one at their true places are words only if widths are known
    x, line = 72.0, []
    for c in "will it fill":
        line.append((12, round(x, 3), 700, c))
        x += w[ord(c)] * 12 / 1000
    assert md(pdf.convert_pdf, make_pdf([line], widths=False)) == "will it fill\n"


def test_pdf_says_what_it_could_not_read():
    data = make_pdf([[(12, 72, 700, "first page")], [(12, 72, 700, "second page")]])
    cut = data.rindex(b"stream\nBT")
    head = data[: cut].rindex(b"<< /Length")
    broken = data[:head] + data[head:cut].replace(b"<< ", b"<< /Filter /LZW ", 1) + data[cut:]
    assert md(pdf.convert_pdf, broken) == "first page\n\n---\n\n*[page 2 could not be read]*\n"


def test_captions_of_office_pictures():
    rng_bytes = bytes(i * i % 251 for i in range(6000))
    draw = lambda alt, i: f'<w:p><w:r><w:drawing><wp:docPr xmlns:wp="http://wp" name="Picture 1" descr="{alt}"/><a:blip r:embed="{i}"/></w:drawing></w:r></w:p>'
    rel = '<R><Relationship Id="i" Type="t/image" Target="media/i.png"/><Relationship Id="j" Type="t/image" Target="media/j.png"/><Relationship Id="s" Type="t/image" Target="media/s.png"/></R>'
    body = draw("one", "i") + draw("", "j") + draw("", "s") + draw("", "none") + f"<w:tbl><w:tr><w:tc>{draw('cell', 'i')}</w:tc><w:tc>{draw('', 'i')}</w:tc></w:tr></w:tbl>"
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rel, "word/media/i.png": rng_bytes, "word/media/j.png": rng_bytes, "word/media/s.png": b"s" * 99}
    asked = []
    got = office.convert_docx(zipped(parts), Info(), Options(drop_images=True), lambda d, m: asked.append((len(d), m)) or " said ").markdown
    assert got == "![one]()\n\nsaid\n\n![]()\n\nsaid\n\n| ![cell]() |  |\n| --- | --- |\n" and asked == [(6000, "image/png")]

    def fails(data, mime):
        raise OSError

    assert "said" not in office.convert_docx(zipped(parts), Info(), Options(drop_images=True), fails).markdown
    pic = '<p:pic><p:nvPicPr><p:cNvPr name="Logo"/></p:nvPicPr><p:blipFill><a:blip r:embed="i"/></p:blipFill></p:pic>'
    slide = {f"ppt/slides/slide{k}.xml": f"<p:sld {W}><p:cSld><p:spTree>{pic}</p:spTree></p:cSld></p:sld>" for k in (1, 2)}
    rels = {f"ppt/slides/_rels/slide{k}.xml.rels": '<R><Relationship Id="i" Type="t/image" Target="../media/i.png"/></R>' for k in (1, 2)}
    asked.clear()
    got = office.convert_pptx(zipped({"ppt/presentation.xml": "<p/>", "ppt/media/i.png": rng_bytes} | slide | rels), Info(), Options(drop_images=True), lambda d, m: asked.append(m) or "said").markdown
    assert got == "## Slide 1\n\n![Logo]()\n\nsaid\n\n## Slide 2\n\n![Logo]()\n\nsaid\n" and len(asked) == 1


def test_random_bytes_give_a_row():
    import random

    rng = random.Random(1)
    heads = [b"", b"PK\x03\x04", binary.CFB_MAGIC, b"%PDF-1.4\n", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"{", b"<html>", b"<rss>"]
    for k in range(300):
        data = rng.choice(heads) + rng.randbytes(rng.randint(0, 3000)) + (b"%%EOF" if k % 3 else b"")
        fmt = recognise(data, Info(ext=rng.choice(["", ".pdf", ".xls", ".msg", ".docx", ".rss", ".html"])))
        try:
            convert_one(data, fmt, Info(), Options())
        except ConvertError as e:
            assert e.code


def test_ciphers():
    from folioframe.operators.formats import pdfcrypt as C

    assert C.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, block = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("69c4e0d86a7b0430d8cdb78070b4c55a")
    assert C._block(C._round_keys(key), block).hex() == "00112233445566778899aabbccddeeff"


def test_pdf_with_empty_password():
    import hashlib

    from folioframe.operators.formats import pdfcrypt as C

    fid, owner, rights = b"0123456789abcdef", b"o" * 32, -4
    key = hashlib.md5(C.PAD + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + fid).digest()
    for _ in range(50):
        key = hashlib.md5(key[:16]).digest()
    u = hashlib.md5(C.PAD + fid).digest()
    for i in range(20):
        u = C.rc4(bytes(b ^ i for b in key), u)
    enc = b"/ID [<%s> <%s>] /Encrypt << /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >> " % tuple(x.hex().encode() for x in (fid, fid, owner, u + b"\0" * 16))
    plain = make_pdf([[(12, 72, 700, "secret words")]], enc)
    start = plain.index(b"stream\n") + 7
    end = plain.index(b"\nendstream")
    data = plain[:start] + C.Security(key, False).decrypt(plain[start:end], 5, 0) + plain[end:]
    assert md(pdf.convert_pdf, data) == "secret words\n"
    with pytest.raises(ConvertError) as e:
        md(pdf.convert_pdf, data.replace(b"/P -4", b"/P -8"))
    assert e.value.code == "encrypted"


def test_ordinary_members_are_read_at_once_and_odd_ones_judged(monkeypatch):
    """Plain members need no file object, tags no look at their namespace; whatever is odd is left to zipfile."""
    import zipfile

    from folioframe.plans import features as X

    data = X.docx(7, "green part", 3)
    assert packages.xml(b'<a:b xmlns:a="x"><c xmlns="y"/></a:b>')[0].tag == "c"
    with monkeypatch.context() as m:
        m.setattr(zipfile.ZipFile, "open", lambda *a: 1 / 0)
        assert office.convert_docx(data, Info(), Options()).markdown == X.DOCX.replace("{k}", "7").replace("{n}", "green part").replace("{s}", "3")
    good = zipped({"a.txt": "x" * 500, "b.txt": "y"})
    at, crc = good.index(b"PK\1\2"), packages.Archive(good).members[0].CRC.to_bytes(4, "little")
    for bad, why in (
        (good.replace(crc, b"\0\1\2\3"), "Bad CRC"), (good.replace(b"a.txt", b"c.txt", 1), "differ"), (good[:at + 8] + b"\1" + good[at + 9 :], "encrypted"), (good[:at + 10] + b"\x63" + good[at + 11 :], "compression"),
    ):
        a = packages.Archive(bad)
        with pytest.raises(ConvertError, match=why):
            a.read(a.members[0])
    a = packages.Archive(good)
    assert a.read("a.txt", 500) == b"x" * 500 and a.read("b.txt") == b"y" and a.used == 501
    with pytest.raises(ConvertError, match="too large"):
        a.read("a.txt", 499)
