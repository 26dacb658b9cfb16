"""Images, audio, and compound files (mail and old workbooks)."""

from __future__ import annotations

import struct
import time
from datetime import datetime, timedelta

from folioframe.operators.formats import html
from folioframe.operators.formats.emit import ConvertError, ImageBudget, Info, Options, Result, collapse, heading, image, join_blocks, table
from folioframe.operators.formats.office import Sheet, shown

CFB_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_FREE = 0xFFFFFFFA
MAX_CFB, MAX_STREAM, MAX_DIRS = 128 << 20, 32 << 20, 65_536


# Images


def image_kind(b: bytes) -> str:
    if b.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if b.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    return "webp" if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else ""


def dimensions(b: bytes) -> tuple[int, int] | None:
    kind = image_kind(b)
    try:
        if kind == "png":
            return struct.unpack(">II", b[16:24])
        if kind == "gif":
            return struct.unpack("<HH", b[6:10])
        if kind == "jpeg":
            at = 2
            while at + 9 < len(b):
                if b[at] != 0xFF:
                    at += 1
                    continue
                mark = b[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h
                if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9:
                    at += 1 if mark == 0xFF else 2
                else:
                    at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_GPS = 0x10000
#: Rows of the table in their order: label, tags that may fill it (the first with a value does), how it is written.
_EXIF = [
    ("DateTimeOriginal", (0x9003, 0x0132), ""), ("Make", (0x010F,), ""), ("Model", (0x0110,), ""), ("LensModel", (0xA434,), ""), ("FNumber", (0x829D,), "aperture"),
    ("ExposureTime", (0x829A,), "exposure"), ("ISO", (0x8827, 0x8833), ""), ("FocalLength", (0x920A,), "length"), ("GPS Latitude", (_GPS + 2, _GPS + 1), "S"),
    ("GPS Longitude", (_GPS + 4, _GPS + 3), "W"), ("ImageDescription", (0x010E,), ""), ("Artist", (0x013B,), ""), ("Copyright", (0x8298,), ""),
]


def _trim(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".")


def exif(b: bytes) -> dict[int, object]:
    """Tags of the main, Exif and GPS directories (GPS ones above 0x10000)."""
    at = b.find(b"Exif\0\0")
    if at < 0 or at > 1 << 16:
        return {}
    t = b[at + 6 :]
    end = {b"II": "<", b"MM": ">"}.get(t[:2])
    if end is None:
        return {}
    out: dict[int, object] = {}

    def directory(offset: int, shift: int, depth: int = 0):
        if depth > 3 or offset + 2 > len(t):
            return
        (n,) = struct.unpack_from(end + "H", t, offset)
        for k in range(min(n, 512)):
            entry = offset + 2 + 12 * k
            if entry + 12 > len(t):
                return
            tag, kind, count = struct.unpack_from(end + "HHI", t, entry)
            size = _SIZES.get(kind, 0) * count
            if not size or size > 1 << 16:
                continue
            pos = entry + 8 if size <= 4 else struct.unpack_from(end + "I", t, entry + 8)[0]
            raw = t[pos : pos + size]
            if len(raw) < size:
                continue
            if kind == 2:
                v: object = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
            elif kind in (5, 10):
                v = [struct.unpack_from(end + ("II" if kind == 5 else "ii"), raw, 8 * i) for i in range(count)]
            elif kind == 7:
                v = raw
            else:
                v = list(struct.unpack(end + {1: "B", 3: "H", 4: "I", 9: "i"}[kind] * count, raw))
            out.setdefault(tag + shift, v)
            if tag in (0x8769, 0x8825) and isinstance(v, list):
                directory(v[0], _GPS if tag == 0x8825 else 0, depth + 1)

    directory(struct.unpack_from(end + "I", t, 4)[0], 0)
    return out


def _shown(v: object, how: str) -> str:
    """A tag's value as a photographer would write it."""
    if isinstance(v, list) and v and isinstance(v[0], tuple):
        n, d = v[0]
        if not d:
            return ""
        if how == "exposure":
            return f"1/{_trim(d / n)} s" if 0 < n < d else f"{_trim(n / d)} s"
        return f"f/{_trim(n / d)}" if how == "aperture" else f"{_trim(n / d)} mm" if how == "length" else f"{n}/{d}"
    return collapse(str(v[0]) if isinstance(v, list) and v else str(v).strip("\0"))


def exif_table(b: bytes) -> str:
    tags, rows = exif(b), []
    for label, names, how in _EXIF:
        if how in ("S", "W"):
            v = tags.get(names[0])
            if not (isinstance(v, list) and len(v) == 3 and all(isinstance(x, tuple) and x[1] for x in v)):
                continue
            degrees = sum(n / d / 60**k for k, (n, d) in enumerate(v))
            text = f"{-degrees if tags.get(names[1]) == how else degrees:.6f}"
        else:
            text = next((t for n in names if n in tags and (t := _shown(tags[n], how))), "")
        if text:
            rows.append([label, text])
    return table(["Tag", "Value"], rows) if rows else ""


def convert_image(data: bytes, info: Info, options: Options, describe=None) -> Result:
    kind = image_kind(data) or info.ext.lstrip(".")
    mime = f"image/{'jpeg' if kind in ('jpg', 'jpeg') else kind or 'unknown'}"
    blocks = [image(info.file_name or "image", ImageBudget(options).uri(mime, data))]
    if describe is not None:
        try:
            blocks.append(describe(data, mime))
        except Exception:  # a failing describer costs the caption only
            pass
    size = dimensions(data)
    facts = f"- Dimensions: {size[0]} × {size[1]}\n- Format: {kind}" if size else ""
    return Result(join_blocks([*blocks, facts, exif_table(data)]), "")


AUDIO_MIME = {
    ".mp3": "audio/mpeg", ".wav": "audio/wav", ".m4a": "audio/mp4", ".mp4": "audio/mp4", ".ogg": "audio/ogg", ".oga": "audio/ogg", ".flac": "audio/flac",
    ".aac": "audio/aac", ".opus": "audio/opus", ".webm": "audio/webm", ".wma": "audio/x-ms-wma", ".aiff": "audio/aiff",
}


def audio_magic(b: bytes) -> bool:
    return b[:3] == b"ID3" or (len(b) > 1 and b[0] == 0xFF and b[1] & 0xE6 in (0xE2, 0xE4, 0xE6)) or (b[:4] == b"RIFF" and b[8:12] == b"WAVE") or b[4:8] == b"ftyp" or b[:4] in (b"OggS", b"fLaC")


def audio_mime(data: bytes, info: Info) -> str:
    """By the hint, else the first bytes, else the extension."""
    hint = info.mime.partition(";")[0].strip().lower()
    if hint.startswith(("audio/", "video/")):
        return hint
    for at, mark, mime in ((0, b"ID3", "audio/mpeg"), (0, b"OggS", "audio/ogg"), (0, b"fLaC", "audio/flac"), (4, b"ftyp", "audio/mp4"), (8, b"WAVE", "audio/wav")):
        if data[at : at + len(mark)] == mark:
            return mime
    return "audio/mpeg" if audio_magic(data) else AUDIO_MIME.get(info.ext, "audio/mpeg")


def convert_audio(data: bytes, info: Info, options: Options, transcribe=None) -> Result:
    if transcribe is None:
        raise ConvertError("unsupported", "audio: no transcriber")
    try:
        text = transcribe(data, audio_mime(data, info))
    except Exception as e:
        raise ConvertError("convert_failed", f"audio: {e}") from e
    if not text.strip():
        raise ConvertError("convert_failed", "audio: empty transcript")
    return Result(join_blocks([heading(1, "Transcript"), f"- Source: {info.file_name}" if info.file_name else "", text.strip()]), "Transcript")


# Compound files


class Compound:
    """Streams of an OLE2 compound file, by path."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(CFB_MAGIC):
            raise ConvertError("convert_failed", "compound file: no header")
        if len(data) > MAX_CFB:
            raise ConvertError("convert_failed", "compound file: too large")
        self.data = data
        shift, mini = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini != 6:
            raise ConvertError("convert_failed", "compound file: odd sector sizes")
        self.size = 1 << shift
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
        most = len(data) // self.size + 1
        if n_fat > most or n_mini > most or n_difat > most:
            raise ConvertError("convert_failed", "compound file: impossible sector counts")
        difat = list(struct.unpack_from("<109I", data, 76))
        at = first_difat
        for _ in range(n_difat):
            if at >= _FREE:
                break
            part = self._ints(at)
            difat += part[:-1]
            at = part[-1]
        self.fat: list[int] = []
        for s in difat[: n_fat + 109]:
            if s < _FREE and len(self.fat) < (n_fat + 1) * self.size // 4:
                self.fat += self._ints(s)
        self.mini_fat = [x for s in self._chain(first_mini, self.fat, most) for x in self._ints(s)] if first_mini < _FREE else []
        raw = b"".join(self._sector(s) for s in self._chain(first_dir, self.fat, most))
        self.entries = []
        for k in range(min(len(raw) // 128, MAX_DIRS)):
            e = raw[128 * k : 128 * k + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            left, right, down = struct.unpack_from("<III", e, 68)
            start, size = struct.unpack_from("<IQ", e, 116)
            self.entries.append((e[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), e[66], left, right, down, start, size & 0xFFFFFFFF))
        if not self.entries:
            raise ConvertError("convert_failed", "compound file: no root")
        self.mini = self._read(self.entries[0][5], self.entries[0][6], self.fat, False) if self.entries[0][5] < _FREE else b""
        self.paths: dict[str, int] = {}
        stack, seen = [("", self.entries[0][4])], set()
        while stack:
            prefix, k = stack.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, down, _, _ = self.entries[k]
            stack += [(prefix, left), (prefix, right)]
            if kind == 1:
                stack.append((f"{prefix}{name}/", down))
            elif kind == 2:
                self.paths[prefix + name] = k

    def _sector(self, s: int) -> bytes:
        return self.data[(s + 1) * self.size : (s + 2) * self.size]

    def _ints(self, s: int) -> list[int]:
        b = self._sector(s)
        return list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])) or [0xFFFFFFFF]

    def _chain(self, at: int, fat: list[int], most: int) -> list[int]:
        out = []
        while at < _FREE and at < len(fat) and len(out) <= most:
            out.append(at)
            at = fat[at]
        return out

    def _read(self, start: int, size: int, fat: list[int], small: bool) -> bytes:
        if small:
            return b"".join(self.mini[64 * s : 64 * s + 64] for s in self._chain(start, fat, len(self.mini) // 64 + 1))[:size]
        return b"".join(self._sector(s) for s in self._chain(start, fat, len(self.data) // self.size + 1))[:size]

    def stream(self, path: str, cap: int = MAX_STREAM) -> bytes | None:
        k = self.paths.get(path)
        if k is None:
            return None
        start, size = self.entries[k][5], min(self.entries[k][6], cap)
        small = self.entries[k][6] < self.cutoff
        return self._read(start, size, self.mini_fat if small else self.fat, small)


def filetime(raw: int) -> str:
    """100 ns since 1601 as yyyy-MM-dd HH:mm:ss UTC; '' outside the years 1 to 9999."""
    try:
        return (datetime(1601, 1, 1) + timedelta(microseconds=raw // 10)).strftime("%Y-%m-%d %H:%M:%S UTC")
    except OverflowError:
        return ""


def _mapi(c: Compound, tag: str) -> str:
    wide = c.stream(f"__substg1.0_{tag}001F")
    if wide is not None:
        return wide.decode("utf-16-le", "replace").rstrip("\0")
    narrow = c.stream(f"__substg1.0_{tag}001E")
    if narrow is None:
        return ""
    try:
        return narrow.decode("utf-8").rstrip("\0")
    except UnicodeDecodeError:
        return narrow.decode("latin-1").rstrip("\0")


def convert_msg(data: bytes, info: Info, options: Options) -> Result:
    c = Compound(data)
    subject = collapse(_mapi(c, "0037"))
    name, mail = collapse(_mapi(c, "0C1A")), collapse(_mapi(c, "5D01") or _mapi(c, "0C1F"))
    sender = f"{name} <{mail}>" if name and mail and name != mail else name or mail
    date, props = "", c.stream("__properties_version1.0") or b""
    found = {}
    for at in range(32, len(props) - 15, 16):
        tag, _, value = struct.unpack_from("<IIQ", props, at)
        found.setdefault(tag, value)
    for tag in (0x00390040, 0x0E060040):
        if not date and tag in found:
            date = filetime(found[tag])
    rows = [[k, v] for k, v in (("From", sender), ("To", collapse(_mapi(c, "0E04"))), ("Cc", collapse(_mapi(c, "0E03"))), ("Date", date)) if v]
    raw = c.stream("__substg1.0_10130102")
    markup = html.decode(raw) if raw else _mapi(c, "1013")
    body = html.to_markdown(markup, drop_images=options.drop_images).rstrip("\n") if markup.strip() else ""
    return Result(join_blocks([heading(1, subject), table(["Field", "Value"], rows) if rows else "", body or _mapi(c, "1000").replace("\r\n", "\n")]), subject)


class _Biff:
    """Cells of a BIFF8 workbook stream."""

    def __init__(self, data: bytes, deadline: float):
        self.data, self.deadline = data, deadline
        self.shared: list[str] = []
        self.formats: dict[int, str] = {}
        self.styles: list[int] = []
        self.sheets: list[tuple[int, int, str]] = []

    def records(self, at: int = 0):
        n = 0
        while at + 4 <= len(self.data):
            kind, size = struct.unpack_from("<HH", self.data, at)
            yield kind, self.data[at + 4 : at + 4 + size]
            at += 4 + size
            n += 1
            if n % 4096 == 0 and time.monotonic() > self.deadline:
                raise ConvertError("parse_timeout", "xls: parsing took too long")

    def globals(self):
        held: list[bytes] = []
        inside = False
        for kind, b in self.records():
            if kind == 0xFC:
                held, inside = [b], True
                continue
            if kind == 0x3C and inside:
                held.append(b)
                continue
            inside = False
            if kind == 0x85 and len(b) > 8:
                at, hidden, n, wide = struct.unpack_from("<IBxBB", b)
                name = b[8 : 8 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
                self.sheets.append((at, hidden & 3, name))
            elif kind == 0x41E and len(b) > 5:
                n, wide = struct.unpack_from("<HB", b, 2)
                self.formats[struct.unpack_from("<H", b)[0]] = b[5 : 5 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == 0xE0 and len(b) >= 4:
                self.styles.append(struct.unpack_from("<H", b, 2)[0])
            elif kind == 0x0A:
                break
        if held:
            self._strings(held)

    def _strings(self, parts: list[bytes]):
        _, n = struct.unpack_from("<II", parts[0])
        k, at = 0, 8
        for _ in range(min(n, 1_000_000)):
            if at >= len(parts[k]):
                k, at = k + 1, 0
                if k >= len(parts):
                    return
            try:
                size, flags = struct.unpack_from("<HB", parts[k], at)
            except struct.error:
                return
            at += 3
            runs = ext = 0
            if flags & 8:
                (runs,) = struct.unpack_from("<H", parts[k], at)
                at += 2
            if flags & 4:
                (ext,) = struct.unpack_from("<I", parts[k], at)
                at += 4
            out = []
            while size:
                wide = 2 if flags & 1 else 1
                take = min(size, (len(parts[k]) - at) // wide)
                out.append(parts[k][at : at + take * wide].decode("utf-16-le" if wide == 2 else "latin-1", "replace"))
                at += take * wide
                size -= take
                if size:
                    k += 1
                    if k >= len(parts):
                        return
                    flags, at = parts[k][0], 1
            self.shared.append("".join(out))
            skip = 4 * runs + ext
            while skip and k < len(parts):
                step = min(skip, len(parts[k]) - at)
                at, skip = at + step, skip - step
                if skip:
                    k, at = k + 1, 0

    def number(self, v: float, style: int) -> str:
        fmt = self.styles[style] if style < len(self.styles) else 0
        from folioframe.operators.formats.office import _DATES, _NUMBERS

        return shown(repr(v), self.formats.get(fmt) or _DATES.get(fmt) or _NUMBERS.get(fmt, ""))

    def cells(self, at: int) -> Sheet:
        s = Sheet()
        last = None
        for kind, b in self.records(at):
            if kind == 0x0A:
                break
            if len(b) < 6 and kind not in (0x207,):
                continue
            if kind == 0xFD:
                r, c, _, i = struct.unpack_from("<HHHI", b)
                s.cells[r, c] = self.shared[i] if i < len(self.shared) else ""
            elif kind == 0x203:
                r, c, x, v = struct.unpack_from("<HHHd", b)
                s.cells[r, c] = self.number(v, x)
            elif kind == 0x27E:
                r, c, x, v = struct.unpack_from("<HHHI", b)
                s.cells[r, c] = self.number(_rk(v), x)
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", b)
                for i in range((len(b) - 6) // 6):
                    x, v = struct.unpack_from("<HI", b, 4 + 6 * i)
                    s.cells[r, c + i] = self.number(_rk(v), x)
            elif kind == 0x205 and len(b) >= 8:
                r, c, _, v, bad = struct.unpack_from("<HHHBB", b)
                s.cells[r, c] = "" if bad else "TRUE" if v else "FALSE"
            elif kind == 0x204 and len(b) > 9:
                r, c, _, n, wide = struct.unpack_from("<HHHHB", b)
                s.cells[r, c] = b[9 : 9 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == 0x06 and len(b) >= 14:
                r, c, x = struct.unpack_from("<HHH", b)
                last = (r, c)
                if b[12:14] != b"\xff\xff":
                    s.cells[last] = self.number(struct.unpack_from("<d", b, 6)[0], x)
                elif b[6] == 1:
                    s.cells[last] = "TRUE" if b[8] else "FALSE"
            elif kind == 0x207 and last and len(b) > 3:
                n, wide = struct.unpack_from("<HB", b)
                s.cells[last] = b[3 : 3 + n * (2 if wide & 1 else 1)].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
        s.cells = {k: v for k, v in s.cells.items() if v.strip()}
        return s


def _rk(v: int) -> float:
    x = float((v >> 2) - (1 << 30 if v & 0x80000000 else 0)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def convert_xls(data: bytes, info: Info, options: Options, seconds: float = 10.0) -> Result:
    c = Compound(data)
    book = c.stream("Workbook", MAX_CFB) or c.stream("Book", MAX_CFB)
    if not book:
        raise ConvertError("convert_failed", "xls: no workbook")
    b = _Biff(book, time.monotonic() + seconds)
    try:
        b.globals()
        blocks = []
        for at, hidden, name in b.sheets[:4096]:
            parts = b.cells(at).tables() if not hidden else []
            if parts:
                blocks += [heading(2, name), *(x for _, bs in parts for x in bs)]
    except (struct.error, IndexError) as e:
        raise ConvertError("convert_failed", f"xls: {e}") from e
    return Result(join_blocks(blocks))
