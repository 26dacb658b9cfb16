"""HTML to Markdown blocks: a tolerant tree, then a renderer."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from urllib.parse import urljoin

from folioframe.operators.formats.emit import ConvertError, Info, Options, Result, collapse, decode_text, heading, image, join_blocks, table

MAX_BYTES = 256 << 20
MAX_COLS, MAX_ROWS, MAX_CELLS = 512, 4096, 65_536
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html"}
_SCOPES = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_PEERS = {"td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


#: A tag, a comment or another declaration.  Nothing inside is given back once matched, so that no
#: input makes the match slow.
_MARKUP = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose content is text up to their own end tag; in the first kind references count.
_TEXT_ONLY = {"title": True, "textarea": True, "script": False, "style": False, "xmp": False, "iframe": False, "noembed": False, "noframes": False}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in _TEXT_ONLY}


class Node:
    """An element; attributes are parsed once they are asked for."""

    __slots__ = ("tag", "raw", "known", "children", "parent", "block")

    def __init__(self, tag: str, raw: str = "", parent: Node | None = None):
        self.tag, self.raw, self.parent, self.block = tag, raw, parent, None
        self.known: dict[str, str] | None = None
        self.children: list[Node | str] = []

    @property
    def attrs(self) -> dict[str, str]:
        if self.known is None:
            self.known = {}
            for m in _ATTRIBUTE.finditer(self.raw):
                value = m[2] or m[3] or m[4] or ""
                self.known.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        return self.known

    def walk(self):
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            yield n
            if isinstance(n, Node):
                stack.extend(reversed(n.children))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if isinstance(n, Node) and n.tag in tags), None)

    def text(self) -> str:
        return "".join(n for n in self.walk() if isinstance(n, str))


def _closed(at: Node, tag: str, stop: frozenset | set = frozenset()) -> Node:
    """Where the tree goes on once the nearest open tag is closed; as before if there is none."""
    n = at
    while n.parent is not None:
        if n.tag == tag:
            return n.parent
        if n.tag in stop:
            return at
        n = n.parent
    return at


_P_SCOPE = frozenset(("td", "th", "table", "button"))


def parse(text: str) -> Node:
    root = at = Node("#root")
    search, pos, end = _MARKUP.search, 0, len(text)
    while pos < end:
        m = search(text, pos)
        stop = m.start() if m else end
        if stop > pos:
            data = text[pos:stop]
            at.children.append(unescape(data) if "&" in data else data)
        if not m:
            break
        pos = m.end()
        slash, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if slash:
            at = _closed(at, tag)
            continue
        if tag in _CLOSES_P:
            at = _closed(at, "p", _P_SCOPE)
        if tag in _SCOPES:
            for peer in _PEERS.get(tag, (tag,)):
                at = _closed(at, peer, _SCOPES[tag])
        node = Node(tag, raw, at)
        at.children.append(node)
        if tag in _VOID or raw.endswith("/"):
            continue
        if tag in _TEXT_ONLY:
            close = _ENDS[tag].search(text, pos)
            data = text[pos : close.start()]
            if data:
                node.children.append(unescape(data) if _TEXT_ONLY[tag] and "&" in data else data)
            pos = close.start()
        at = node
    return root


_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decode(data: bytes, declared: str = "") -> str:
    """Declared charset, byte order mark, charset of a meta element, UTF-8, Windows-1252."""
    if not declared and not data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        found = _META.search(data[:8192])
        if found:
            label = found[1].decode("ascii").lower()
            declared = "cp1252" if label in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii") else label
    elif declared.lower() in ("iso-8859-1", "latin1", "us-ascii"):
        declared = "cp1252"
    return decode_text(data, declared)


def title_of(root: Node) -> str:
    for tags in (("title",), ("h1",)):
        n = root.find(*tags)
        if n is not None and collapse(n.text()):
            return collapse(n.text())
    return ""


def links_of(root: Node, url: str) -> list[str]:
    """Targets of anchors, resolved, without fragment, each once, in order."""
    base = url
    node = root.find("base")
    if node is not None and node.attrs.get("href"):
        joined = urljoin(url, node.attrs["href"].strip())
        if re.match(r"(?i)https?://[^/]", joined):
            base = joined
    out: dict[str, None] = {}
    for n in root.walk():
        if isinstance(n, Node) and n.tag == "a":
            href = n.attrs.get("href", "").strip()
            if href and not href.startswith("#") and not re.match(r"(?i)(mailto|javascript|tel|data):", href):
                try:
                    out.setdefault(urljoin(base, href).partition("#")[0])
                except ValueError:
                    continue
    return list(out)


class Renderer:
    """Blocks of Markdown of a tree."""

    def __init__(self, base: str = "", drop_images: bool = False):
        self.base, self.drop_images = base, drop_images

    def document(self, root: Node) -> list[str]:
        return self.blocks(root)

    def blocks(self, node: Node) -> list[str]:
        out: list[str] = []
        inline: list[Node | str] = []

        def flush():
            if not inline:
                return
            text = self._tidy(self.inline(inline))
            if text:
                out.append(text)
            inline.clear()

        for c in node.children:
            if isinstance(c, str):
                if inline or not c.isspace():
                    inline.append(c)
            elif not self._is_block(c):
                if c.tag not in _SKIP and c.tag != "head":
                    inline.append(c)
            else:
                flush()
                out += self.block(c)
        flush()
        return out

    def _is_block(self, n: Node) -> bool:
        """Whether it is a block or holds one; worked out once for each node."""
        if n.block is None:
            n.block = n.tag in _BLOCK or (n.tag not in _SKIP and any(isinstance(c, Node) and self._is_block(c) for c in n.children))
        return n.block

    def block(self, n: Node) -> list[str]:
        t = n.tag
        if t == "head" or t in _SKIP:
            return []
        if t[0] == "h" and len(t) == 2 and t[1].isdigit():
            return [heading(int(t[1]), collapse(self.inline(n.children)))]
        if t == "hr":
            return ["---"]
        if t == "pre":
            code = n.find("code") or n
            lang = re.search(r"lang(?:uage)?-([\w+#-]+)", code.attrs.get("class", "") + " " + n.attrs.get("class", ""))
            body = n.text().strip("\n")
            fence = "```"
            while fence in body:
                fence += "`"
            return [f"{fence}{lang[1] if lang else ''}\n{body}\n{fence}"]
        if t in ("ul", "ol"):
            return [x for x in [self.list(n)] if x]
        if t == "blockquote":
            inner = join_blocks(self.blocks(n)).rstrip("\n")
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        if t == "table":
            if n.attrs.get("role", "").lower() in ("presentation", "none"):
                return [b for row in self._rows(n) for cell in self._cells(row) for b in self.blocks(cell)]
            return self.table(n)
        if t == "figure":
            return self.figure(n)
        if t == "dt":
            inner = collapse(self.inline(n.children))
            return [f"**{inner}**"] if inner else []
        return self.blocks(n)

    def figure(self, n: Node) -> list[str]:
        if n.find("figcaption") is None:
            return self.blocks(n)
        out = []
        for x in n.walk():
            if isinstance(x, Node) and x.tag == "img":
                out.append(self._image(x, ""))
        cap = n.find("figcaption")
        rest = Node("div")
        rest.children = [c for c in n.children if not (isinstance(c, Node) and (c.tag == "figcaption" or c.find("img")))]
        return [x for x in out if x] + self.blocks(rest) + self.blocks(cap)

    def list(self, n: Node, depth: int = 0) -> str:
        ordered = n.tag == "ol"
        try:
            number = int(n.attrs.get("start", "1"))
        except ValueError:
            number = 1
        items = []
        for c in n.children:
            if not isinstance(c, Node) or c.tag in _SKIP:
                continue
            if c.tag in ("ul", "ol"):
                body = [self.list(c)]
            else:
                body = self.blocks(c)
            mark = f"{number}. " if ordered else "- "
            number += 1
            if not body:
                continue
            tight = all(b.lstrip()[:2] in ("- ",) or re.match(r"\s*\d+\. ", b) for b in body[1:])
            text = ("\n" if tight else "\n\n").join(body)
            pad = " " * len(mark)
            items.append(mark + text.replace("\n", "\n" + pad).replace("\n" + pad + "\n", "\n\n"))
        return "\n".join(items)

    def _rows(self, n: Node) -> list[Node]:
        out = []
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "tr":
                    out.append(c)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    out += [r for r in c.children if isinstance(r, Node) and r.tag == "tr"]
        return out

    def _cells(self, row: Node) -> list[Node]:
        return [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]

    def table(self, n: Node) -> list[str]:
        grid: dict[tuple[int, int], str] = {}
        rows = self._rows(n)[:MAX_ROWS]
        width = 0
        for r, row in enumerate(rows):
            at = 0
            for cell in self._cells(row):
                while (r, at) in grid:
                    at += 1
                across, down = _span(cell.attrs.get("colspan"), MAX_COLS), _span(cell.attrs.get("rowspan"), MAX_ROWS)
                text = self._cell(cell)
                for y in range(r, min(r + down, len(rows))):
                    for x in range(at, min(at + across, MAX_COLS)):
                        if len(grid) < MAX_CELLS:
                            grid.setdefault((y, x), text)
                at += across
            width = max([width, *(x + 1 for y, x in grid if y == r)])
        lines = [[grid.get((y, x), "") for x in range(width)] for y in range(len(rows))]
        lines = [x for x in lines if any(x)]
        cap = next((c for c in n.children if isinstance(c, Node) and c.tag == "caption"), None)
        caption = collapse(self.inline(cap.children)) if cap is not None else ""
        return [x for x in (caption, table(None, lines)) if x]

    def _cell(self, cell: Node) -> str:
        if cell.find("table") is not None:
            return collapse(cell.text())
        blocks = [re.sub(r"^#{1,6} ", "", b) for b in self.blocks(cell)]
        return collapse(" ".join(blocks))

    def _image(self, n: Node, alt: str | None = None) -> str:
        src = n.attrs.get("src", "").strip()
        if not src:
            return ""
        if src.startswith("data:"):
            src = "" if self.drop_images else src
        elif self.base:
            src = _join(self.base, src)
        return image(collapse(n.attrs.get("alt", "")) if alt is None else alt, src.replace(" ", "%20"))

    def inline(self, nodes: list[Node | str]) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(_escape(n))
                continue
            t = n.tag
            if t in _SKIP or t in ("head", "title"):
                continue
            if t == "br":
                out.append("\x01")
            elif t == "img":
                out.append(self._image(n))
            elif t in ("code", "kbd", "samp", "tt"):
                body = collapse(n.text())
                ticks = "`" * (max((len(x) for x in re.findall("`+", body)), default=0) + 1)
                pad = " " if body.startswith("`") or body.endswith("`") else ""
                out.append(f"{ticks}{pad}{body}{pad}{ticks}" if body else "")
            else:
                inner = self.inline(n.children)
                if t in ("b", "strong"):
                    inner = _mark(inner, "**")
                elif t in ("i", "em"):
                    inner = _mark(inner, "*")
                elif t in ("s", "del", "strike"):
                    inner = _mark(inner, "~~")
                elif t == "a":
                    inner = self._link(n, inner)
                out.append(inner)
        return "".join(out)

    def _link(self, n: Node, inner: str) -> str:
        href = n.attrs.get("href", "").strip()
        text = collapse(inner.replace("\x01", " "))
        if not href or not text:
            return inner
        if self.base and not href.startswith("#"):
            href = _join(self.base, href)
        return f"[{text}]({href.replace(' ', '%20').replace('(', '%28').replace(')', '%29')})"

    def _tidy(self, text: str) -> str:
        if "\x01" not in text:
            return " ".join(text.split())
        lines = [" ".join(x.split()) for x in text.split("\x01")]
        return "  \n".join(x for x in lines if x)


_MAYBE = re.compile(r"[\\*`\[\]_]")
_SPECIAL = re.compile(r"([\\*`\[\]]|(?<!\w)_|_(?!\w))")  # an underscore inside a word marks nothing


def _escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text) if _MAYBE.search(text) else text


def _mark(text: str, mark: str) -> str:
    inner = text.strip(" \t\n\r\x01")
    if not inner:
        return text
    at = text.index(inner)
    return f"{text[:at]}{mark}{inner}{mark}{text[at + len(inner):]}"


@lru_cache(maxsize=8192)
def _join(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def _span(raw: str | None, most: int) -> int:
    """Absent or bad is 1; nought or too much is the most there may be."""
    try:
        n = int((raw or "1").strip())
    except ValueError:
        return 1
    return 1 if n < 0 else most if n == 0 or n > most else n


def to_markdown(text: str, base: str = "", drop_images: bool = False) -> str:
    return join_blocks(Renderer(base, drop_images).document(parse(text)))


def convert(data: bytes, info: Info, options: Options) -> Result:
    if len(data) > MAX_BYTES:
        raise ConvertError("convert_failed", "html: too large")
    root = parse(decode(data, options.charset or info.charset))
    return Result(join_blocks(Renderer(info.url, options.drop_images).document(root)), title_of(root))
