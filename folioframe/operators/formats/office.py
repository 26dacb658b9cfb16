"""Word processing, presentation and spreadsheet packages."""

from __future__ import annotations

import posixpath
import re
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree import ElementTree as ET

from folioframe.operators.formats.emit import Captions, ConvertError, ImageBudget, Info, Options, Result, collapse, emphasise, heading, image, join_blocks, link_url, table
from folioframe.operators.formats.packages import MEDIA, SHARED_PART, Archive, attr, chart_grid, child, children, core_title, descend, local, rels_of, text_of, xml

MAX_CELLS, MAX_MERGES = 1_000_000, 65_536
_HEADING, _LIST, _BLANKS = re.compile("heading([1-9])"), re.compile("list(bullet|number)([1-9]?)"), re.compile(r"[ \t]+")


def _on(e: ET.Element | None) -> bool:
    return e is not None and attr(e, "val", "1").lower() not in ("0", "false", "off", "none")


def numbering(data: bytes) -> dict[tuple[str, int], str]:
    """(number, level) to its format."""
    root = xml(data)
    by_abstract = {attr(x, "abstractNumId"): {int(attr(v, "ilvl", "0") or 0): attr(child(v, "numFmt"), "val") for v in children(x, "lvl")} for x in children(root, "abstractNum")}
    return {(attr(n, "numId"), k): f for n in children(root, "num") for k, f in by_abstract.get(attr(child(n, "abstractNumId"), "val"), {}).items()}


_shared_numbering = lru_cache(64)(numbering)


class Docx:
    def __init__(self, a: Archive, options: Options, describe=None):
        self.a, self.budget, self.captions, self.in_table = a, ImageBudget(options), Captions(describe), False
        self.rels = rels_of(a, "word/document.xml")
        self.formats = self._formats()
        self.counters: list[int] = []

    def _formats(self) -> dict[tuple[str, int], str]:
        data = self.a.get("word/numbering.xml")
        return (_shared_numbering if len(data) <= SHARED_PART else numbering)(data) if data else {}

    def blocks(self, body: ET.Element) -> list[str]:
        out: list[str] = []
        items: list[str] = []

        def flush():
            if items:
                out.append("\n".join(items))
                items.clear()
            self.counters.clear()

        for e in body:
            t = e.tag
            if t in ("sdt", "sdtContent", "smartTag", "customXml"):
                flush()
                inner = child(e, "sdtContent")
                out += self.blocks(inner if inner is not None else e)
            elif t == "AlternateContent":
                c = child(e, "Choice")
                out += self.blocks(c) if c is not None else []
            elif t == "tbl":
                flush()
                out += self.table(e)
            elif t == "p":
                text, after, level, listed = self.paragraph(e)
                if listed is not None and text:
                    items.append(self.item(text, *listed))
                else:
                    if text or after:
                        flush()
                    if text:
                        out.append(heading(level, text.replace("\n", " ")) if level else text)
                if after:
                    flush()
                    out += after
        flush()
        return out

    def item(self, text: str, depth: int, ordered: bool) -> str:
        del self.counters[depth + 1:]
        self.counters += [0] * (depth + 1 - len(self.counters))
        self.counters[depth] += 1
        return f"{'  ' * depth}{f'{self.counters[depth]}.' if ordered else '-'} {text.replace(chr(10), ' ')}"

    def paragraph(self, p: ET.Element):
        props, style, listed, num = child(p, "pPr"), "", None, None
        if props is not None:
            style, num = attr(child(props, "pStyle"), "val").replace(" ", "").lower(), child(props, "numPr")
        level = 1 if style == "title" else 2 if style == "subtitle" else int(m[1]) if style and (m := _HEADING.fullmatch(style)) else 0
        if num is not None and (key := attr(child(num, "numId"), "val")) not in ("", "0"):
            depth = int(attr(child(num, "ilvl"), "val", "0") or 0)
            kind = self.formats.get((key, depth), self.formats.get((key, 0), "bullet"))
            listed = (min(depth, 8), kind not in ("bullet", "none", ""))
        elif style and (m := _LIST.fullmatch(style)):
            listed = (int(m[2] or 1) - 1, m[1] == "number")
        after: list[str] = []
        segs = self.runs(p, after)
        if len(segs) > 1:
            merged: list[list] = []
            for text, mark in segs:
                if merged and merged[-1][1] == mark:
                    merged[-1][0] += text
                else:
                    merged.append([text, mark])
            segs = merged
        text = "".join(emphasise(t, m) if m and not level else t for t, m in segs) if segs else ""
        if "\n" not in text and "\t" not in text and "  " not in text:
            return text.strip(), after, level, None if level else listed
        return "\n".join((_BLANKS.sub(" ", x) if "  " in x or "\t" in x else x).strip() for x in text.split("\n")).strip(), after, level, None if level else listed

    def runs(self, e: ET.Element, after: list[str]) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for c in e:
            t = c.tag
            if t == "r":
                out += self.run(c, after)
            elif t == "hyperlink":
                inner = "".join(x for x, _ in self.runs(c, after)).strip()
                kind, target = self.rels.get(attr(c, "id"), ("", ""))
                if inner and target and kind.startswith("external"):
                    out.append((f"[{inner}]({link_url(target)})", ""))
                elif inner:
                    out.append((inner, ""))
            elif t in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "customXml", "moveTo"):
                out += self.runs(c, after)
            elif t == "AlternateContent":
                choice = child(c, "Choice")
                out += self.runs(choice, after) if choice is not None else []
        return out

    def run(self, r: ET.Element, after: list[str]) -> list[tuple[str, str]]:
        props, mark = child(r, "rPr"), ""
        if props is not None:
            bold, italic = _on(child(props, "b")), _on(child(props, "i"))
            mark = "***" if bold and italic else "**" if bold else "*" if italic else ""
            if _on(child(props, "strike")):
                mark = "~~" + mark if not mark else mark
        out = []
        for c in r:
            t = c.tag
            if t == "t":
                out.append((c.text or "", mark))
            elif t == "tab":
                out.append((" ", mark))
            elif t in ("br", "cr"):
                out.append(("\n", ""))
            elif t in ("noBreakHyphen",):
                out.append(("-", mark))
            elif t in ("drawing", "pict", "object"):
                pic = self.drawing(c, after)
                if pic:
                    out.append((pic, ""))
            elif t == "AlternateContent":
                choice = child(c, "Choice")
                if choice is not None:
                    out += self.run(choice, after)
        return out

    def drawing(self, d: ET.Element, after: list[str]) -> str:
        for box in descend(d, "txbxContent"):
            after += self.blocks(box)
        for ch in descend(d, "chart"):
            kind, part = self.rels.get(attr(ch, "id"), ("", ""))
            data = self.a.get(part) if kind == "chart" else None
            if data:
                title, kind, series, rows = chart_grid(data)
                after += [title or (f"{kind[:1].upper()}{kind[1:]} chart" if kind else ""), table(["", *series], rows) if rows else ""]
        ids = [attr(b, "embed") for b in descend(d, "blip")] + [attr(b, "id") for b in descend(d, "imagedata")]
        name = next((x for x in (*descend(d, "docPr"), *descend(d, "cNvPr"))), None)
        alt = alt_text(name)
        for i in ids:
            kind, part = self.rels.get(i, ("", ""))
            mime = MEDIA.get(posixpath.splitext(part)[1].lower(), "")
            data = self.a.get(part) if kind == "image" and mime else None
            uri = self.budget.uri(mime, data) if data else ""
            caption = self.captions.of(data, mime) if data and not self.in_table else ""
            after += [caption] if caption else []
            return image(alt, uri) if alt or uri or caption else ""
        return ""

    def table(self, t: ET.Element) -> list[str]:
        outer, self.in_table = self.in_table, True
        try:
            return self._table(t)
        finally:
            self.in_table = outer

    def _table(self, t: ET.Element) -> list[str]:
        rows = []
        for r in children(t, "tr"):
            cells: list[str] = []
            for c in children(r, "tc"):
                props = child(c, "tcPr")
                merge = child(props, "vMerge")
                text = "" if merge is not None and attr(merge, "val") != "restart" else collapse(" ".join(self.blocks(c)))
                span = attr(child(props, "gridSpan"), "val", "1")
                wide = int(span) if span.isdigit() and 2 <= int(span) <= 1000 else 1
                cells += [text, *[""] * (wide - 1)]
            rows.append(cells)
        if len(rows) == 1 and len(children(children(t, "tr")[0], "tc")) == 1:
            return self.blocks(children(children(t, "tr")[0], "tc")[0])
        width = max((len(r) for r in rows), default=0)
        return [table(None, [r + [""] * (width - len(r)) for r in rows])] if width else []


def alt_text(e: ET.Element | None) -> str:
    """The description, else a name that no program made up."""
    name = attr(e, "name")
    return collapse(re.sub(r"[\[\]\n\r]", " ", attr(e, "descr") or ("" if re.search(r"[ \t]\d+$", name) else name)))


def convert_docx(data: bytes, info: Info, options: Options, describe=None) -> Result:
    a = Archive(data)
    root = xml(a.read("word/document.xml"))
    d = Docx(a, options, describe)
    body = child(root, "body")
    return Result(join_blocks(d.blocks(body) if body is not None else []), core_title(a))


def convert_pptx(data: bytes, info: Info, options: Options, describe=None) -> Result:
    a = Archive(data)
    a.read("ppt/presentation.xml")
    slides = [(int(m[1]), n) for n in a.by_name if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
    budget, captions, blocks, title = ImageBudget(options), Captions(describe), [], core_title(a)
    for number, (_, name) in enumerate(sorted(slides), 1):
        blocks.append(heading(2, f"Slide {number}"))
        rels = rels_of(a, name)
        tree = next(iter(descend(xml(a.read(name)), "spTree")), None)
        blocks += _shapes(a, tree, rels, budget, captions) if tree is not None else []
        own = next((p for k, p in rels.values() if k == "notesSlide" and p in a.by_name), f"ppt/notesSlides/notesSlide{name[16:-4]}.xml")
        data = a.get(own)
        if data:
            lines = [t for s in descend(xml(data), "sp") if attr(next(iter(descend(s, "ph")), None), "type") not in ("sldImg", "sldNum") for t in map(_para, descend(s, "p")) if t]
            blocks.append("\n>\n".join(f"> {'' if i else '**Notes:** '}{x}" for i, x in enumerate(lines)))
    return Result(join_blocks(blocks), title)


def _para(p: ET.Element) -> str:
    out = []
    for c in p:
        if c.tag in ("r", "fld"):
            out.append(text_of(child(c, "t")))
        elif c.tag == "br":
            out.append(" ")
    return collapse("".join(out))


def _shapes(a: Archive, tree: ET.Element, rels, budget: ImageBudget, captions: Captions) -> list[str]:
    out = []
    for e in tree:
        t = e.tag
        if t == "grpSp":
            out += _shapes(a, e, rels, budget, captions)
        elif t == "AlternateContent":
            c = child(e, "Choice")
            out += _shapes(a, c, rels, budget, captions) if c is not None else []
        elif t == "sp":
            kind = attr(next(iter(descend(child(e, "nvSpPr"), "ph")), None), "type") if child(e, "nvSpPr") is not None else ""
            paras = [(int(attr(child(p, "pPr"), "lvl", "0") or 0), _para(p)) for p in descend(e, "p")]
            paras = [(k, x) for k, x in paras if x]
            if kind in ("title", "ctrTitle"):
                out.append(heading(3, " ".join(x for _, x in paras)))
            elif kind == "subTitle":
                out += [x for _, x in paras]
            elif kind not in ("sldNum", "dt", "ftr"):
                out.append("\n".join(f"{'    ' * min(k, 8)}- {x}" for k, x in paras))
        elif t == "pic":
            kind, part = rels.get(attr(next(iter(descend(e, "blip")), None), "embed"), ("", ""))
            mime = MEDIA.get(posixpath.splitext(part)[1].lower(), "")
            data = a.get(part) if mime else None
            alt, uri = alt_text(next(iter(descend(e, "cNvPr")), None)), budget.uri(mime, data) if data else ""
            caption = captions.of(data, mime) if data else ""
            out += [image(alt, uri) if alt or uri or caption else "", caption]
        elif t == "graphicFrame":
            for tbl in descend(e, "tbl"):
                rows = [[("" if attr(c, "hMerge") == "1" or attr(c, "vMerge") == "1" else collapse(" ".join(map(_para, descend(c, "p"))))) for c in children(r, "tc")] for r in children(tbl, "tr")]
                out.append(table(None, rows))
            for ch in descend(e, "chart"):
                kind, part = rels.get(attr(ch, "id"), ("", ""))
                data = a.get(part) if kind == "chart" else None
                if data:
                    title, _, series, rows = chart_grid(data)
                    out += [heading(3, f"Chart: {title}" if title else "Chart"), table(["Category", *series], rows) if rows else ""]
    return out


# Spreadsheets


def cell_ref(ref: str) -> tuple[int, int] | None:
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", ref)
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


_DATES = {14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
_NUMBERS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00"}


def shown(raw: str, code: str, base_1904: bool = False) -> str:
    """A number as its format shows it; unknown formats leave it as it is."""
    try:
        v = float(raw)
    except ValueError:
        return raw
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.', "", code.split(";")[0]).lower()
    if code and code.lower() != "general" and re.search(r"[ymdhs]", plain):
        try:
            d = datetime(1904, 1, 1) + timedelta(days=v) if base_1904 else datetime(1899, 12, 30) + timedelta(days=v)
        except OverflowError:
            return raw
        d = (d + timedelta(microseconds=500)).replace(microsecond=0)
        day, time = bool(re.search(r"[yd]", plain)), bool(re.search(r"[hs]", plain))
        return d.strftime("%Y-%m-%d %H:%M:%S" if day and time else "%H:%M:%S" if time else "%Y-%m-%d")
    m = re.fullmatch(r"[$€£]?(#,##)?0(?:\.(0+))?(%?)", re.sub(r'[\\"]|_.', "", code.split(";")[0]))
    if m:
        x = v * 100 if m[3] else v
        return f"{x:{',' if m[1] else ''}.{len(m[2] or '')}f}{m[3]}"
    return f"{v:.0f}" if v == int(v) and abs(v) < 1e15 else repr(v)


class Sheet:
    """Shown cells of one sheet, its merged ranges and what stands between."""

    def __init__(self):
        self.cells: dict[tuple[int, int], str] = {}
        self.merged: list[tuple[int, int, int, int]] = []

    def filled(self) -> dict[tuple[int, int], str]:
        out = dict(self.cells)
        for r0, c0, r1, c1 in self.merged:
            v = self.cells.get((r0, c0), "")
            if v and (r1 - r0 + 1) * (c1 - c0 + 1) <= MAX_MERGES:
                for r in range(r0, r1 + 1):
                    for c in range(c0, c1 + 1):
                        out[r, c] = v
        return {k: v for k, v in out.items() if v}

    def regions(self) -> list[tuple[int, int, int, int]]:
        """Bounding boxes of the 4-connected groups of cells, in reading order."""
        left = self.filled()
        out = []
        for start in sorted(left):
            if start not in left:
                continue
            stack, box = [start], [start[0], start[1], start[0], start[1]]
            del left[start]
            while stack:
                r, c = stack.pop()
                box = [min(box[0], r), min(box[1], c), max(box[2], r), max(box[3], c)]
                for n in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if n in left:
                        del left[n]
                        stack.append(n)
            out.append(tuple(box))
        return out

    def tables(self) -> list[tuple[int, list[str]]]:
        """(row, blocks) of each region."""
        cells, out = self.filled(), []
        for r0, c0, r1, c1 in self.regions():
            blocks = []
            whole = next((m for m in self.merged if m[0] == m[2] == r0 and m[1] <= c0 and m[3] >= c1), None)
            if whole and r1 > r0 and c1 > c0 and sum((r0 + 1, c) in cells for c in range(c0, c1 + 1)) >= 2:
                blocks.append(f"**{collapse(cells[r0, c0])}**")
                r0 += 1
            grid = [[cells.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)]
            out.append((r0, [*blocks, table(None, grid)]))
        return out


def convert_xlsx(data: bytes, info: Info, options: Options) -> Result:
    a = Archive(data)
    book = xml(a.read("xl/workbook.xml"))
    rels = rels_of(a, "xl/workbook.xml")
    shared = [_rich(s) for s in children(xml(x), "si")] if (x := a.get("xl/sharedStrings.xml")) else []
    codes: list[str] = []
    if styles := a.get("xl/styles.xml"):
        root = xml(styles)
        own = {attr(f, "numFmtId"): attr(f, "formatCode") for f in descend(root, "numFmt")}
        for x in children(child(root, "cellXfs"), "xf"):
            k = attr(x, "numFmtId", "0")
            codes.append(own.get(k) or _DATES.get(int(k or 0)) or _NUMBERS.get(int(k or 0), ""))
    base_1904 = _on(next((p for p in descend(book, "workbookPr") if attr(p, "date1904")), None)) and any(attr(p, "date1904") in ("1", "true") for p in descend(book, "workbookPr"))
    blocks, n = [], 0
    for s in children(child(book, "sheets"), "sheet"):
        if attr(s, "state") in ("hidden", "veryHidden"):
            continue
        rid = next((v for k, v in s.attrib.items() if local(k) == "id" and "}" in k), "")
        part = rels.get(rid, ("", ""))[1]
        data = a.get(part)
        if data is None:
            continue
        sheet, root = Sheet(), xml(data)
        for row in descend(root, "row"):
            for c in children(row, "c"):
                at = cell_ref(attr(c, "r"))
                if at is None:
                    continue
                n += 1
                if n > MAX_CELLS:
                    raise ConvertError("convert_failed", "xlsx: too many cells")
                v = text_of(child(c, "v"))
                kind = attr(c, "t")
                if kind == "s":
                    v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
                elif kind == "inlineStr":
                    v = _rich(child(c, "is"))
                elif kind == "b":
                    v = {"1": "TRUE", "0": "FALSE"}.get(v, v)
                elif kind in ("", "n") and v:
                    style = attr(c, "s", "0")
                    v = shown(v, codes[int(style)] if style.isdigit() and int(style) < len(codes) else "", base_1904)
                if v.strip():
                    sheet.cells[at] = v
        for m in descend(root, "mergeCell"):
            ends = [cell_ref(x) for x in attr(m, "ref").split(":")]
            if len(ends) == 2 and all(ends):
                sheet.merged.append((*ends[0], *ends[1]))
        parts = sheet.tables()
        own = rels_of(a, part)
        parts += _sheet_charts(a, root, own)
        body = [b for _, bs in sorted(parts, key=lambda p: p[0]) for b in bs] + _comments(a, own)
        if body:
            blocks += [heading(2, attr(s, "name")), *body]
    return Result(join_blocks(blocks), core_title(a))


def _rich(e: ET.Element | None) -> str:
    if e is None:
        return ""
    return "".join(text_of(t) for c in e for t in ([c] if c.tag == "t" else children(c, "t") if c.tag == "r" else []))


#: What a reader calls the charts of a sheet.
_CHARTS = {"bar": "Bar chart", "line": "Line chart", "pie": "Pie chart", "doughnut": "Pie chart", "scatter": "Scatter chart"}


def _sheet_charts(a: Archive, sheet: ET.Element, rels) -> list[tuple[int, list[str]]]:
    out = []
    for d in descend(sheet, "drawing"):
        part = rels.get(attr(d, "id"), ("", ""))[1]
        data = a.get(part) if part else None
        if not data:
            continue
        own = rels_of(a, part)
        for anchor in xml(data):
            row = text_of(next(iter(descend(anchor, "row")), None))
            for ch in descend(anchor, "chart"):
                kind, chart = own.get(attr(ch, "id"), ("", ""))
                body = a.get(chart) if kind == "chart" else None
                if body:
                    title, shape, series, rows = chart_grid(body)
                    blocks = [title, _CHARTS.get(shape, ""), table(["", *series], rows) if rows else ""]
                    out.append((int(row) if row.isdigit() else 0, blocks))
    return out


def comment_time(raw: str) -> str:
    """A time cut to milliseconds; '' if it is none."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?Z?", raw.strip())
    return f"{m[1]}.{(m[2] or '')[:3]:0<3}" if m else ""


def _comments(a: Archive, rels) -> list[str]:
    found: dict[tuple[int, int], str] = {}
    people: dict[str, str] = {}
    for name in a.by_name:
        if name.startswith("xl/persons/"):
            people |= {attr(p, "id"): attr(p, "displayName") for p in descend(xml(a.read(name)), "person")}
    for kind, part in rels.values():
        if kind == "comments" and (data := a.get(part)):
            root = xml(data)
            names = [text_of(x) for x in descend(root, "author")]
            for c in descend(root, "comment"):
                at, who = cell_ref(attr(c, "ref")), attr(c, "authorId")
                author = names[int(who)] if who.isdigit() and int(who) < len(names) else ""
                if at:
                    found[at] = f"[author: {author}]: {collapse(_rich(child(c, 'text')))}" if author else collapse(_rich(child(c, "text")))
    for kind, part in rels.values():
        if kind == "threadedComment" and (data := a.get(part)):
            for c in descend(xml(data), "threadedComment"):
                at = cell_ref(attr(c, "ref"))
                time = comment_time(attr(c, "dT"))
                if at:
                    found[at] = f"[author: {people.get(attr(c, 'personId')) or 'Unknown'}{f', time: {time}' if time else ''}]: {collapse(text_of(child(c, 'text')))}"
    return [v for _, v in sorted(found.items())][:4096]
