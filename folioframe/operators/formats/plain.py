"""Plain text, delimited text, JSON and notebooks."""

from __future__ import annotations

import base64
import binascii
import csv
import io
import json
import re
from itertools import islice

from folioframe.operators.formats.emit import ConvertError, ImageBudget, Info, Options, Result, code_block, decode_text, image, join_blocks, table

MAX_CELLS = 1_000_000
csv.field_size_limit(1 << 28)


def convert_text(data: bytes, info: Info, options: Options) -> Result:
    text = decode_text(data, options.charset or info.charset)
    return Result(text.replace("\r\n", "\n").rstrip("\n") + "\n")


def delimiter_of(ext: str, head: str) -> str:
    """By extension, else the most even of comma, tab, semicolon and bar over five records."""
    if ext in (".tsv", ".tab"):
        return "\t"
    if ext == ".csv":
        return ","
    best, score = ",", 0.0
    for d in ",\t;|":
        rows = islice((r for r in csv.reader(io.StringIO(head, newline=""), delimiter=d) if r), 5)
        counts = [len(r) - 1 for r in rows]
        even = min(counts, default=0) * (1.0 if len(set(counts)) == 1 else 0.5)
        if even > score:
            best, score = d, even
    return best


def convert_csv(data: bytes, info: Info, options: Options) -> Result:
    text = decode_text(data, options.charset or info.charset).replace("\r\n", "\n")
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter_of(info.ext, text[:65536])) if r]
    width = max((len(r) for r in rows), default=0)
    if width * len(rows) > MAX_CELLS:
        raise ConvertError("convert_failed", "csv: too many cells")
    if not rows:
        return Result("")
    return Result(join_blocks([table([*rows[0], *[""] * (width - len(rows[0]))], rows[1:])]))


class Number(str):
    """A number as it is written."""


class Pairs(list):
    """Members of an object, in order, repeated keys and all."""


def _bad_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_json(text: str):
    """Strict JSON; numbers keep their writing, objects their order."""
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_bad_constant, object_pairs_hook=Pairs)


def dump_json(v, pad: str = "") -> str:
    deep = pad + "  "
    if isinstance(v, Pairs):
        return "{\n" + ",\n".join(f"{deep}{json.dumps(k, ensure_ascii=False)}: {dump_json(x, deep)}" for k, x in v) + f"\n{pad}}}" if v else "{}"
    if isinstance(v, list):
        return "[\n" + ",\n".join(deep + dump_json(x, deep) for x in v) + f"\n{pad}]" if v else "[]"
    return str(v) if isinstance(v, Number) else json.dumps(v, ensure_ascii=False)


def json_cell(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def records_table(v) -> str | None:
    """A table of an array of flat objects, keys in the order first seen; else None."""
    if not isinstance(v, list) or isinstance(v, Pairs) or not v or not all(isinstance(x, Pairs) for x in v):
        return None
    if any(isinstance(y, list) for x in v for _, y in x):
        return None
    keys = list(dict.fromkeys(k for x in v for k, _ in x))
    if not keys or len(keys) * len(v) > MAX_CELLS:
        return None
    return table(keys, [[json_cell(dict(x).get(k)) for k in keys] for x in v])


def convert_json(data: bytes, info: Info, options: Options) -> Result:
    try:
        v = parse_json(decode_text(data))
    except (ValueError, RecursionError) as e:
        raise ConvertError("convert_failed", f"json: {e}") from e
    return Result(join_blocks([records_table(v) or code_block("json", dump_json(v))]))


def is_json(data: bytes) -> bool:
    try:
        parse_json(data.decode("utf-8"))
        return True
    except (ValueError, RecursionError):
        return False


def _source(v) -> str:
    return "".join(x for x in v if isinstance(x, str)) if isinstance(v, list) else v if isinstance(v, str) else ""


def convert_ipynb(data: bytes, info: Info, options: Options) -> Result:
    try:
        nb = json.loads(decode_text(data))
    except (ValueError, RecursionError) as e:
        raise ConvertError("convert_failed", f"ipynb: {e}") from e
    if not isinstance(nb, dict) or "nbformat" not in nb:
        raise ConvertError("convert_failed", "ipynb: no nbformat")
    meta = nb.get("metadata") or {}
    lang = (meta.get("kernelspec") or {}).get("language") or (meta.get("language_info") or {}).get("name") or "python"
    budget, blocks = ImageBudget(options), []
    for cell in nb.get("cells") or []:
        text = _source(cell.get("source"))
        if cell.get("cell_type") in ("markdown", "raw"):
            blocks.append(text)
        elif cell.get("cell_type") == "code":
            if text.strip():
                blocks.append(code_block(lang, text))
            for o in cell.get("outputs") or []:
                blocks += _output(o, budget)
    return Result(join_blocks(blocks), meta.get("title") or "")


def _output(o: dict, budget: ImageBudget) -> list[str]:
    out, bundle = [], o.get("data") or {}
    for mime in ("image/png", "image/jpeg", "image/gif", "image/webp"):
        raw = _source(bundle.get(mime))
        if raw:
            try:
                uri = budget.uri(mime, base64.b64decode(re.sub(r"\s", "", raw), validate=True))
            except (binascii.Error, ValueError):
                continue
            if uri:
                out.append(image("output", uri))
            break
    text = _source(o.get("text")) if o.get("output_type") == "stream" else _source(bundle.get("text/plain")) if o.get("output_type") == "execute_result" else ""
    return [*out, code_block("", text)] if text.strip() else out
