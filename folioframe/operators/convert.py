"""Documents to Markdown: dispatch, parse in Arrow batches, one result row per document.

A bad document is a row with a status, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.operators import dispatch as D
from folioframe.operators.formats import binary, html, office, packages, pdf, plain
from folioframe.operators.formats.emit import ConvertError, Info, Options, Result

VERSION = "1"
CONVERTERS: dict[str, Callable] = {
    "csv": plain.convert_csv, "docx": office.convert_docx, "epub": packages.convert_epub, "image": binary.convert_image, "ipynb": plain.convert_ipynb,
    "msg": binary.convert_msg, "pdf": pdf.convert_pdf, "pptx": office.convert_pptx, "rss": packages.convert_rss, "xls": binary.convert_xls,
    "xlsx": office.convert_xlsx, "json": plain.convert_json, "html": html.convert, "plaintext": plain.convert_text, "audio": binary.convert_audio,
}


BUILT_IN = dict(CONVERTERS)


def recognise(data: bytes, info: Info) -> str | None:
    """The format of a member of an archive: the rules of dispatch.py for one document."""
    e, names = info.ext, packages.zip_names(data) if data[:2] == b"PK" else []
    head = data[:4096].decode("latin-1")
    if e in (".csv", ".tsv", ".tab"):
        return "csv"
    for ext, part, name in ((".docx", "word/document.xml", "docx"), (".pptx", "ppt/presentation.xml", "pptx"), (".xlsx", "xl/workbook.xml", "xlsx")):
        if e == ext or part in names:
            return name
    if e == ".epub" or "mimetypeapplication/epub+zip" in head[:128]:
        return "epub"
    if binary.image_kind(data) or e in (".png", ".jpg", ".jpeg", ".gif", ".webp"):
        return "image"
    if data.startswith(binary.CFB_MAGIC):
        try:
            paths = binary.Compound(data).paths
        except Exception:
            paths = {}
        if e == ".msg" or any(p.startswith("__substg1.0_") for p in paths):
            return "msg"
        if "Workbook" in paths or "Book" in paths:
            return "xls"
    if data.startswith(b"%PDF-") or e == ".pdf":
        return "pdf"
    if e in (".rss", ".atom", ".xml", ".rdf") and any(x in head.lower() for x in ("<rss", "<feed", "<rdf:rdf")):
        return "rss"
    if e == ".xls":
        return "xls"
    if head.lstrip()[:1] in ("{", "[") and plain.is_json(data):
        return "ipynb" if b'"nbformat"' in data and head.lstrip()[0] == "{" else "json"
    low = head[:1024].lower()
    if e != ".xml" and (e in (".html", ".htm", ".xhtml") or any(x in low for x in ("<!doctype html", "<html", "<head>", "<body"))):
        return "html"
    if names:
        return "zip"
    if b"\0" not in data[:4096]:
        try:
            data[:4096].decode("utf-8")
            return "plaintext"
        except UnicodeDecodeError as x:
            if x.start >= len(data[:4096]) - 3 and len(data) > 4096:
                return "plaintext"
    return None


def convert_one(data: bytes, fmt: str | None, info: Info, options: Options) -> Result:
    if fmt is None:
        raise ConvertError("unsupported", "no format accepts the document")
    if options.max_depth >= 0 and options.depth > options.max_depth:
        raise ConvertError("max_depth", "archives nest too deeply")
    if fmt == "zip":
        deeper = replace(options, depth=options.depth + 1)
        return packages.convert_zip(data, info, deeper, lambda d, i, o: convert_one(d, recognise(d, i), i, o))
    if fmt not in CONVERTERS:
        raise ConvertError("unsupported", f"no parser for {fmt}")
    try:
        return CONVERTERS[fmt](data, info, options)
    except ConvertError:
        raise
    except Exception as e:  # a parser's failure belongs to its document
        raise ConvertError("convert_failed", f"{fmt}: {type(e).__name__}: {e}") from e


#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 256


def sliced(batches: Iterator[tuple[pa.Array, ...]], n: int) -> Iterator[tuple[pa.Array, ...]]:
    """Batches cut to at most n rows: a worker holds its batch once, and of n rows the objects and results."""
    for columns in batches:
        for at in range(0, len(columns[0]), n):
            yield tuple(c.slice(at, n) for c in columns)


def _convert(options: Options, extra: dict[str, Callable]):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from folioframe.operators import convert as own  # the worker's module; this function's globals are a copy

        own.CONVERTERS.update(own.BUILT_IN | extra)
        for batch in sliced(batches, SLICE_ROWS):
            rows = []
            for c, f, e, m, cs, n, u in zip(*(x.to_pylist() for x in batch)):
                try:
                    r = convert_one(c or b"", f, Info(m or "", (e or "").lower(), cs or "", n or "", u or ""), options)
                    rows.append({"markdown": r.markdown, "title": r.title, "status": "ok", "error_code": None, "error_msg": None})
                except ConvertError as x:
                    rows.append({"markdown": None, "title": None, "status": "error", "error_code": x.code, "error_msg": str(x)[:500]})
            yield pa.array(rows, pa.struct([(k, pa.string()) for k in ("markdown", "title", "status", "error_code", "error_msg")]))

    return run


_RESULT = "struct<markdown:string,title:string,status:string,error_code:string,error_msg:string>"


def _batched(options: Options, extra: dict[str, Callable]):
    run = _convert(options, extra)

    @F.arrow_udf(_RESULT)
    def convert(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from run(batches)

    # else a filter on results is pushed below joins and exchanges, where all documents are converted once more
    return convert.asNondeterministic()


def with_hints(docs: DataFrame) -> DataFrame:
    """docs with all hint columns, '' where they were missing or null."""
    have = set(docs.columns)
    return docs.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("") for c in ("mime", "ext", "charset", "file_name", "url")})


#: Inputs of fewer bytes are spread over all cores first: one small file is one task else.
SPREAD_BYTES = 256 << 20


#: Rows of a task where each row becomes a document, and where some rows together do.
TASK_ROWS, TASK_PARTS = 4_000, 20_000


def spread_rows(rows: DataFrame, key: str, per: int = TASK_ROWS) -> DataFrame:
    """Rows of a stored table by a key, a task for so many of them and for each core, before documents are
    built from them: a few MB of keys and names are one task else, that builds and converts them all."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per))
    return rows.repartition(n, key)


def spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as there are cores, if they are small; else as they are."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else docs


def convert(
    docs: DataFrame,
    options: Options | None = None,
    registry: D.Registry | None = None,
    extra: dict[str, Callable] | None = None,
    describe: Callable[[bytes, str], str] | None = None,
    transcribe: Callable[[bytes, str], str] | None = None,
    spread_out: bool = True,
) -> DataFrame:
    """docs (content and any hints) with format, markdown, title, status, error_code, error_msg.

    extra: parsers of formats that the registry was given, f(data, info, options) -> Result.
    describe, transcribe: f(data, mime) -> text for images (those in PDF, word processing and slides too) and audio, called on the executors.
    A describer's failure costs a caption, a transcriber's the document; without a
    transcriber nothing is audio.  spread_out: whether small inputs are spread over all cores;
    False where their rows were before the documents were built.
    """
    own = dict(extra or {})
    if describe is not None:
        own.setdefault("image", partial(binary.convert_image, describe=describe))
        for name, parser in (("pdf", pdf.convert_pdf), ("docx", office.convert_docx), ("pptx", office.convert_pptx)):
            own.setdefault(name, partial(parser, describe=describe))
    if transcribe is not None:
        own.setdefault("audio", partial(binary.convert_audio, transcribe=transcribe))
    if registry is None and transcribe is not None:
        registry = D.Registry(D.builtins(transcriber=True))
    rows = D.dispatch(with_hints(spread(docs) if spread_out else docs), registry)
    udf = _batched(options or Options(), own)
    out = rows.withColumn("_r", udf("content", "format", "ext", "mime", "charset", "file_name", "url"))
    return out.withColumns({k: F.col(f"_r.{k}") for k in ("markdown", "title", "status", "error_code", "error_msg")}).drop("_r")


def summary(converted: DataFrame) -> DataFrame:
    """Documents by format and status."""
    return converted.groupBy("format", "status").agg(F.count("*").alias("n"))
