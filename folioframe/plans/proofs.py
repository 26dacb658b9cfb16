"""Queries over whole tables whose expected results are written out by hand, as templates or as
rules in SQL that share nothing with the operators: documents of every format with their less
common parts, and the smaller operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import hints as H
from folioframe.functions import markdown as M
from folioframe.functions import numbers as N
from folioframe.functions import robots as R
from folioframe.functions import urls as U
from folioframe.operators import cache, scoring
from folioframe.operators.convert import SLICE_ROWS, convert, sliced, spread_rows, with_hints
from folioframe.operators.crawl import CrawlOptions, crawl, schedule
from folioframe.operators.dispatch import Registry
from folioframe.operators.formats.emit import Options, Result
from folioframe.operators.links import page_links, rewrite_links
from folioframe.plans import features as X
from folioframe.plans.builders import make_pdf
from folioframe.plans.registry import query, table
from folioframe.sources import files
from folioframe.sources.shared import folder_for
from folioframe.streaming import intake


def _documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One document of a kind for each row of part, with its hints."""
    make, _, hints = X.FEATURES[kind]

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in sliced(batches, SLICE_ROWS):
            yield pa.array([make(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.binary())

    part = spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = part.select("p_partkey", F.arrow_udf(run, "binary")("p_partkey", "p_name", "p_size").alias("content"))
    return rows.withColumns({c: F.lit(v) for c, v in hints.items()})


def _expected(kind: str, more: str = "") -> str:
    return f"SELECT p_partkey, {X.as_sql(X.FEATURES[kind][1])} AS markdown{more} FROM part"


def _features(spark: SparkSession, sf_dir: str, kind: str, **how) -> DataFrame:
    return convert(_documents(spark, sf_dir, kind), spread_out=False, **how).select("p_partkey", "markdown")


@query(_expected("docx", ", 'Core ' || p_partkey AS title"))
def docx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 + S11 + J03 + J04 + A04 + A20 + W08 + P20 + X05 + X06 + X08-X12 + X17 + B03 + T13 + Y04-Y07: styles, runs, deleted
    and inserted text, links, numbered lists by level, spans, boxes, charts, pictures, the core title."""
    return convert(_documents(spark, sf_dir, "docx"), spread_out=False).select("p_partkey", "markdown", "title")


@query(_expected("pptx"))
def pptx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 + O02 + W10 + P14 + J19 + X09 + T13 + Y08 + Y09: slides by number, levels, groups, merged cells, pictures, charts,
    notes by relationship and by name."""
    return _features(spark, sf_dir, "pptx")


@query(_expected("xlsx"))
def xlsx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 + T02 + T05 + T06 + P12 + J05-J07 + J17 + N03 + N04 + W09 + O04 + O05 + U02: regions, merged ranges, section labels,
    formats, hidden sheets, charts by their anchors, comments and what replaces them."""
    return _features(spark, sf_dir, "xlsx")


@query(_expected("html", ", 'Part № ' || p_partkey AS title"))
def html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C05 + T04 + P11 + X03-X06 + X08 + B01 + L03 + Y11: charset, nesting, spans, captions, figures, relative targets."""
    return convert(_documents(spark, sf_dir, "html"), spread_out=False).select("p_partkey", "markdown", "title")


@query(_expected("ipynb"))
def ipynb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04 + F06 + X03 + B03: outputs in order, pictures first, fences longer than what they hold."""
    return _features(spark, sf_dir, "ipynb")


@query(_expected("csv"))
def csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C02 + F02 + T07 + P01 + A02 + A04 + X01: byte order mark, quotes, ragged rows, line ends in cells."""
    return _features(spark, sf_dir, "csv")


@query(_expected("records"))
def json_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C03 + F07 + A03 + U02: keys in order of first sight, numbers as they are, the last of a repeated key."""
    return _features(spark, sf_dir, "records")


@query(_expected("atom"))
def feed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C06 + F11 + N01 + X07 + P02: Atom links, dates, authors, bodies with the entry's link as their base."""
    return _features(spark, sf_dir, "atom")


@query(_expected("epub"))
def epub_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C07 + S10 + F04 + J01 + J02 + P13 + Y10: the spine's order, names by folder, what isn't a document left out."""
    return _features(spark, sf_dir, "epub")


@query(_expected("zip"))
def zip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C08 + S09 + F15 + X18 + Y14: archives in archives, unsafe and unknown members."""
    return _features(spark, sf_dir, "zip")


@query(_expected("msg"))
def mail_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 + S13 + F08 + N02 + B02 + Y13: all fields, a plain body, 8-bit strings."""
    return _features(spark, sf_dir, "msg")


@query(_expected("photo"))
def photo_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C09 + F05 + E02 + B07 + J18 + N05 + N06 + Y12: a describer's caption, size, camera tags, place; no inline picture."""

    def describe(data: bytes, mime: str) -> str:
        at = data.index(b"\xff\xc0")
        return f"a picture of {data[at + 8]} by {data[at + 6]}"

    return _features(spark, sf_dir, "photo", options=Options(drop_images=True), describe=describe)


@query(_expected("sound", ", 'Transcript' AS title"))
def sound_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 + F01 + E03 + B08: a transcriber's text; with none, nothing is audio."""
    out = convert(_documents(spark, sf_dir, "sound"), transcribe=lambda data, mime: f" heard {data[12:].decode()} as {mime}\n", spread_out=False)
    return out.select("p_partkey", "markdown", "title")


@query(_expected("pdf"))
def pdf_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 + S15 + F09 + T09-T11 + A07-A12 + W01-W05 + X14-X16 + U06 + O03 + J16 + Y17: running heads once, headings by size and number,
    hyphens by witnesses, lists, a table over two pages."""
    return _features(spark, sf_dir, "pdf")


@query(_expected("layout"))
def pdf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 + T08 + T09 + T11 + T12 + O06 + W04 + W06 + A13-A15 + S16 + B06 + J11 + J12 + J13 + X13 + Y15 + Y16: columns under a heading, a
    heading that the outline knows, a picture where it is drawn, a ruled table with gaps."""

    def describe(data: bytes, mime: str) -> str:
        lines = zlib.decompress(data[data.index(b"IDAT") + 4 :])
        grey = b"".join(lines[i * 81 + 1 : (i + 1) * 81] for i in range(60))
        key = (grey[0] - X.GREYS[0]) & 255
        same = all(x == (y + key) & 255 for x, y in zip(grey, X.GREYS))
        return f"a picture of {len(grey)} greys from {key if same else 'nowhere'}"

    out = convert(_documents(spark, sf_dir, "layout"), options=Options(drop_images=True), describe=describe, spread_out=False)
    # greys repeat after 256 keys: the caption's key stands for all of its class
    right = F.regexp_replace("markdown", r"greys from \d+\]", F.concat(F.lit("greys from "), F.col("p_partkey").cast("string"), F.lit("]")))
    said = F.regexp_extract("markdown", r"greys from (\d+)\]", 1)
    return out.select("p_partkey", F.when(said == (F.col("p_partkey") % 256).cast("string"), right).otherwise(F.col("markdown")).alias("markdown"))


@query(_expected("pictured"))
def image_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 + A19 + B03 + Y06 + Y20: pictures inline while the budget lasts, repeats free, what is too big or too small left out."""
    return _features(spark, sf_dir, "pictured", options=Options(max_image_total=len(X.PNG) + 160))


@query("SELECT p_partkey, p_name || ' by mine' AS markdown, 'mine' AS format FROM part")
def custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E01 + O01 + S02 + Y03: a format of one's own goes before the built-in ones."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").cast("binary").alias("content"), F.lit(".txt").alias("ext"))
    mine = Registry().register("late", 200, lambda: F.lit(True)).register("mine", -1, lambda: F.col("_ext") == ".txt")
    out = convert(rows, registry=mine, extra={"mine": lambda data, info, options: Result(f"{data.decode()} by mine")})
    return out.select("p_partkey", "markdown", "format")


@query("SELECT CASE p_partkey % 4 WHEN 0 THEN 'ok' ELSE 'error' END AS status, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unsupported' ELSE 'convert_failed' END AS code, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18 + P16 + F12 + F16: documents that fail are rows with a status and a code."""
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, F.col("p_name").cast("binary")).when(k == 1, F.unhex(F.lit("0001FF"))).when(k == 2, F.lit("%PDF-1.4 cut").cast("binary")).otherwise(F.unhex(F.lit("504B030400")))
    rows = table(spark, sf_dir, "part").select(body.alias("content"), F.when(k == 3, F.lit(".zip")).otherwise(F.lit("")).alias("ext"))
    return convert(rows).groupBy("status", F.col("error_code").alias("code")).agg(F.count("*").alias("n"))


# Hints, predicates, emitters


@query(r"""
SELECT p_partkey, 'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.tar.Gz' WHEN 2 THEN '' ELSE '.html' END AS name,
    CASE p_partkey % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.gz' WHEN 2 THEN '' ELSE '.html' END AS ext,
    CASE p_partkey % 4 WHEN 0 THEN 'text/plain' WHEN 3 THEN 'text/html' ELSE '' END AS mime,
    CASE WHEN p_partkey % 3 = 0 THEN 'application/json' WHEN p_partkey % 4 = 0 THEN 'text/plain' WHEN p_partkey % 4 = 3 THEN 'text/html' ELSE '' END AS hinted,
    p_partkey % 3 = 1 AS page
FROM part
""")
def path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01 + S04 + P01-P04 + P08: extension, name and MIME type of a path, and a hint laid over it."""
    k = F.col("p_partkey")
    ends = F.get(F.array(F.lit(".TXT"), F.lit(".tar.Gz"), F.lit(""), F.lit(".html")), (k % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a.b/"), F.lit("f"), k.cast("string"), ends).alias("path"))
    over = F.when(k % 3 == 0, H.norm_mime(F.lit(" Application/JSON ; charset=x"))).otherwise(F.lit(""))
    content_type = F.when(k % 3 == 1, F.lit("TEXT/html; q=1")).otherwise(F.lit("text/htmlx"))
    out = files.with_path_hints(rows)
    return out.select("p_partkey", F.col("file_name").alias("name"), "ext", "mime", H.overlay(F.col("mime"), over).alias("hinted"), H.is_html(content_type).alias("page"))


@query(r"""
SELECT p_partkey, p_partkey % 3 <> 1 AS same, p_partkey % 5 IN (0, 1, 2) AS skipped, p_partkey % 4 = 0 AS web,
    'http://h/' || CASE p_partkey % 3 WHEN 0 THEN 'a/x' || p_partkey WHEN 1 THEN 'y?q=' || p_partkey ELSE 'a/b/' || p_partkey END AS resolved FROM part
""")
def url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07 + P09 + P10 + L03: hosts and ports, targets that are no pages, references against a base."""
    k = F.col("p_partkey")
    pick = lambda n, *v: F.get(F.array(*(F.lit(x) for x in v)), (k % n).cast("int"))
    other = pick(3, "HTTP://Ex.com:80/b", "http://ex.com:8080/", "https://ex.com/")
    href = pick(5, "#top", "MailTo:a@b", "data:text/plain,x", "/data:x", "page#top")
    absolute = pick(4, "https://h/x", "//h/x", "ftp://h/x", "http:x")
    ref = F.concat(pick(3, "../x", "/y?q=", ""), k.cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", U.same_host(F.lit("http://ex.com/a"), other).alias("same"), U.skip_href(href).alias("skipped"),
        F.coalesce(U.is_absolute(absolute), F.lit(False)).alias("web"), U.resolve(F.lit("http://h/a/b/c"), ref).alias("resolved"),
    )


@query("SELECT p_partkey, ' **' || p_name || '**' || chr(10) AS strong, 'http://h/' || replace(p_name, ' ', '%20') || '%28' || p_size || '%29' AS url, '\\[' || p_name || '\\]' AS text,"
       " '![' || p_name || ' x](u)' AS image, CASE WHEN p_partkey % 2 = 0 THEN '# ' || p_name || chr(10) || chr(10) || 'body' ELSE '# own' END AS titled, '![a]() [b](data.html)' AS bare FROM part")  # fmt: skip
def emitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X05-X08 + K05 + P15: emphasis, link targets and texts, pictures, a title before a body, inline data dropped."""
    k, n = F.col("p_partkey"), F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.emphasise(F.concat(F.lit(" "), n, F.lit("\n")), "**").alias("strong"), M.link_url(F.concat(F.lit("http://h/"), n, F.lit("("), F.col("p_size").cast("string"), F.lit(")\r\n"))).alias("url"),
        M.link_text(F.concat(F.lit("["), n, F.lit("]"))).alias("text"), M.image(F.concat(F.lit("["), n, F.lit("]x")), F.lit("u")).alias("image"),
        M.with_title(F.when(k % 2 == 0, F.lit("body")).otherwise(F.lit("# own")), n).alias("titled"), M.drop_data_uris(F.lit("![a](data:image/png;base64,AA==) [b](data.html)")).alias("bare"),
    )


@query("""
WITH p AS (SELECT p_partkey, CAST(p_partkey % 3 AS VARCHAR) AS a, CAST(p_partkey % 2 AS VARCHAR) AS b FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '../../top%20page.md' WHEN a = b THEN 't' || p_partkey || '.md' ELSE '../' || a || '/t' || p_partkey || '.md' END AS path FROM p
""")
def relative_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one file of a mirror to another."""
    k = F.col("p_partkey")
    target = F.when(k % 5 == 0, F.lit("top page.md")).otherwise(F.concat(F.lit("h/"), (k % 3).cast("string"), F.lit("/t"), k.cast("string"), F.lit(".md")))
    return table(spark, sf_dir, "part").select("p_partkey", U.relative_to(target, F.concat(F.lit("h/"), (k % 2).cast("string"), F.lit("/s.md"))).alias("path"))


_LINKED = (
    "[a](http://h/x{k}#top) [b](<http://h/x{k}> \"t\") `[c](http://h/x{k})` \\[d](http://h/x{k}) [e](HTTP://H/x{k}) [j](http://h/x{k}/) [f](http://n/x{k})\n\n"
    "```\n[g](http://h/x{k})\n```\n\n    [h](http://h/x{k})\n\n[i]: http://h/x{k}\n[![{n}](http://h/x{k})](http://h/x{k})\n"
)
_RELINKED = (
    "[a](../x/{k}.md#top) [b](<../x/{k}.md> \"t\") `[c](http://h/x{k})` \\[d](http://h/x{k}) [e](../x/{k}.md) [j](../x/{k}.md) [f](http://n/x{k})\n\n"
    "```\n[g](http://h/x{k})\n```\n\n    [h](http://h/x{k})\n\n[i]: ../x/{k}.md\n[![{n}](../x/{k}.md)](../x/{k}.md)\n"
)


def _filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), F.col("p_name"))


@query(f"SELECT p_partkey, {X.as_sql(_RELINKED.replace('<../x/{k}.md>', '../x/{k}.md'))} AS markdown FROM part")
def relinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K03 + J08 + L05 + L06: links that lead into the mirror, and those that must stay."""
    part, key = spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey"), F.col("p_partkey").cast("string")
    docs = part.select("p_partkey", F.concat(F.lit("http://h/d"), key).alias("url"), F.concat(F.lit("h/d/"), key, F.lit(".md")).alias("path"), _filled(_LINKED).alias("markdown"))
    mapping = part.select(F.concat(F.lit("http://h/x"), key).alias("url"), F.concat(F.lit("h/x/"), key, F.lit(".md")).alias("path"))
    return rewrite_links(docs, mapping).select("p_partkey", "markdown")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN least(p_size, 30) * 1000 ELSE CAST(floor(least(200 * power(2, p_size % 9), 8000) * (1 + (p_partkey % 2) / 2)) AS BIGINT) END AS wait,
    CASE p_partkey % 4 WHEN 0 THEN p_size || ' B' WHEN 1 THEN p_size || '.5 KiB' WHEN 2 THEN p_size || '.0 GiB' ELSE p_size || '.2 PiB' END AS size, p_partkey % 5 < 3 AS here FROM part
""")
def retry_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N08 + N09 + P21: waits before another attempt, sizes for people, addresses of this machine."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    size = F.when(k % 4 == 0, s).when(k % 4 == 1, s * 1024 + 512).when(k % 4 == 2, s * (1 << 30)).otherwise(F.floor(s * float(1 << 50) + 0.2 * (1 << 50)).cast("long"))
    url = F.get(F.array(*(F.lit(x) for x in ("http://localhost:8080/v1", "https://u:p@127.0.0.1", "http://[::1]:9/x", "http://localhost.example/", "//localhost"))), (k % 5).cast("int"))
    asked = F.when(k % 3 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.backoff_ms(F.col("p_size") % 9 + 1, asked, (k % 2).cast("double")).alias("wait"), N.human_bytes(size).alias("size"), U.is_local(url).alias("here"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'garbled_text' END AS code, CASE WHEN p_size % 3 = 1 THEN 'Readable ' || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*[the text of page 2 is unreadable]*' || chr(10)"
       " WHEN p_size % 3 = 2 THEN 'Readable ' || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || repeat('plain words ', 5) || '\x02\x02' || chr(10) END AS markdown FROM part")  # fmt: skip
def pdf_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages mostly of glyphs that say nothing aren't shown, pages with a few are; a document of nothing else fails."""
    def build(names: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for n, s in zip(names.to_pylist(), sizes.to_pylist()):
            bad = "ab" * 12 + "\\002" * 30
            second = bad if s % 3 < 2 else "plain words " * 5 + "\\002\\002"
            out.append(make_pdf([[(12, 72, 700, bad if s % 3 == 0 else f"Readable {n}")], [(12, 72, 700, second)]]))
        return pa.array(out, pa.binary())

    part = spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    rows = part.select("p_partkey", F.arrow_udf(build, "binary")("p_name", "p_size").alias("content"))
    return convert(rows, spread_out=False).select("p_partkey", F.col("error_code").alias("code"), "markdown")


@query("SELECT r_regionkey AS region, CAST(50000 AS BIGINT) AS urls FROM region")
def sitemap_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50,000 URLs of a sitemap are read."""
    k = F.col("r_regionkey").cast("string")
    urls = F.transform(F.sequence(F.lit(1), F.lit(50_100)), lambda i: F.concat(F.lit("<url><loc>http://h"), k, F.lit("/"), i.cast("string"), F.lit("</loc></url>")))
    body = F.concat(F.lit("<urlset>"), F.array_join(urls, ""), F.lit("</urlset>")).cast("binary")
    maps = table(spark, sf_dir, "region").select(k.alias("url"), body.alias("body"))
    found = files.sitemap_entries(maps, maps.select("url"))
    return found.groupBy(F.regexp_extract("loc", r"h(\d+)/", 1).cast("int").alias("region")).agg(F.count("*").alias("urls"))


# Names, robots, crawl


@query("""
WITH s AS (SELECT o_orderkey, 'r' || (o_custkey % 40) || CASE WHEN o_orderkey % 7 = 0 THEN '-' || (o_orderkey % 5 + 1) ELSE '' END AS stem FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY stem) AS c FROM s),
t AS (SELECT list(DISTINCT stem) AS stems FROM s)
SELECT o_orderkey, stem || CASE WHEN k = 0 THEN '' ELSE '-' || list_filter(range(1, c + 9), lambda x: NOT list_contains(stems, stem || '-' || x))[k] END || '.md' AS name FROM k, t
""")
def planned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat are numbered past the names of other inputs."""
    k = F.col("o_orderkey")
    number = F.when(k % 7 == 0, F.concat(F.lit("-"), (k % 5 + 1).cast("string"))).otherwise(F.lit(""))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string"), number, F.lit(".txt")).alias("file_name"))
    return files.plan_outputs(docs, "o_orderkey").select("o_orderkey", F.col("out_name").alias("name"))


@query("""
WITH s AS (SELECT DISTINCT 'http://h/' || o_custkey AS url, 'p/' || (o_custkey % 50) || CASE WHEN o_custkey % 11 = 0 THEN '-2' ELSE '' END AS stem FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY url) - 1 AS k, count(*) OVER (PARTITION BY stem) AS c FROM s),
t AS (SELECT list(DISTINCT stem) AS stems FROM s)
SELECT url, stem || CASE WHEN k = 0 THEN '' ELSE '-' || list_filter(range(2, c + 9), lambda x: NOT list_contains(stems, stem || '-' || x))[k] END || '.md' AS path, true AS inside FROM k, t
""")
def mirror_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a mirror that share a path, and whether all stay inside."""
    c = F.col("o_custkey")
    path = F.concat(F.lit("p/"), (c % 50).cast("string"), F.when(c % 11 == 0, F.lit("-2")).otherwise(F.lit("")), F.lit(".md"))
    docs = table(spark, sf_dir, "orders").select(F.concat(F.lit("http://h/"), c.cast("string")).alias("url"), path.alias("path"))
    return files.unique_paths(docs).distinct().select("url", "path", files.contained(F.col("path")).alias("inside"))


@query("SELECT 'http://h' || p_partkey AS origin, 'http://h/' || p_name || '/' || i || '.xml' AS loc FROM part, range(2) AS t(i)")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps that robots files name, whatever the group."""
    n, k = F.col("p_name"), F.col("p_partkey").cast("string")
    body = F.concat(F.lit("User-agent: *\nSITEMAP : http://h/"), n, F.lit("/0.xml\r\nDisallow: /x # Sitemap: no\nsitemap:http://h/"), n, F.lit("/1.xml"))
    return R.sitemaps(table(spark, sf_dir, "part").select(F.concat(F.lit("http://h"), k).alias("origin"), body.alias("body"))).select("origin", "loc")


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE true END AS allowed FROM part
""")
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18 + W07 + L07 + P06: agents that share a group, the longest rule, ends and stars in patterns; a tie allows."""
    k = F.col("p_partkey")
    body = "User-agent: other\nDisallow: /\n\nUser-agent: x\nUser-agent: Folio # both\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nAllow: /tie\nDisallow: /tie\n"
    tails = ("/a/b/", "/a/c/", "/a/b/x.pdf?", "/z/y.pdf", "/tie/", "/z/")
    stem, end = F.split(F.get(F.array(*(F.lit(t) for t in tails)), (k % 6).cast("int")), "y[.]pdf"), F.when(k % 6 == 3, F.lit(".pdf")).otherwise(F.lit(""))
    target = F.concat(F.element_at(stem, 1), k.cast("string"), end)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("http://h").alias("origin"), target.alias("target"))
    rules = R.parse(spark.createDataFrame([("http://h", body)], "origin string, body string"), "folio/2.0")
    return R.allow(rows, rules).select("p_partkey", "allowed")


@query("""
WITH t AS (SELECT p_partkey, CAST(floor(log2(p_partkey + 1) + 1e-9) AS INT) AS depth FROM part)
SELECT 'http://h/' || p_partkey AS url, depth, CASE WHEN depth = 0 THEN 'seed' ELSE 'link' END AS source FROM t WHERE depth <= 5
""")
def crawl_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21 + T03 + J09 + U01 + U03 + U05 + E05 + Y19: a crawl of pages that link to two others each and to themselves, six levels deep;
    each page is parsed when its level is reached."""
    part, link = table(spark, sf_dir, "part"), "<a href='{}#x'>l</a>"
    k = lambda x: x.cast("string")
    body = F.concat(*(x for at in (2 * F.col("p_partkey") + 1, 2 * F.col("p_partkey") + 2, F.col("p_partkey"), 2 * F.col("p_partkey") + 1) for x in (F.lit(link.split("{}")[0]), k(at), F.lit(link.split("{}")[1]))))
    pages = part.select(F.concat(F.lit("http://h/"), k(F.col("p_partkey"))).alias("url"), body.alias("html"))
    seeds = spark.createDataFrame([("HTTP://H:80/0",)], "url string")
    return crawl(seeds, page_links, pages, CrawlOptions(max_depth=5, max_pages=None)).pages.select("url", "depth", "source")


@query("""
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 ELSE p_size END AS bytes FROM part),
r AS (SELECT *, sum(bytes) OVER (ORDER BY 'http://h/' || p_partkey) - bytes AS before, sum(bytes) OVER () AS total FROM b)
SELECT 'http://h/' || p_partkey AS url FROM r WHERE before < total // 3
""")
def crawl_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl that ends where its bytes do."""
    size = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 100).otherwise(F.col("p_size")).cast("long")
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string")).alias("url"), size.alias("bytes"))
    total = pages.agg(F.sum("bytes")).first()[0] or 0
    links = spark.createDataFrame([], "url string, ord int, link string")
    return crawl(pages.select("url"), links, pages, CrawlOptions(max_pages=None, max_bytes=total // 3)).pages.select("url")


# Scoring


_GOLD = "# Title of {n}\n\nsome *plain* text about [{n}](http://h/{k})\n\n- first item\n- second item\n\n| a | b |\n| --- | --- |\n| {k} | 2 |\n"


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 0.0 ELSE 1.0 END AS content, CASE p_partkey % 3 WHEN 1 THEN 0.0 ELSE 1.0 END AS "order",
    CASE p_partkey % 3 WHEN 1 THEN 0.0 ELSE 1.0 END AS tables, CASE p_partkey % 3 WHEN 0 THEN 1.0 ELSE 0.0 END AS headings, CASE p_partkey % 3 WHEN 1 THEN 0.0 ELSE 1.0 END AS lists
FROM part
""")
def fidelity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19 + X21 + X22 + T14 + J14: what equals the gold text but for marks scores 1, nothing scores 0, a heading that is
    none any more costs the headings alone."""
    k = F.col("p_partkey") % 3
    same = F.replace(F.replace(_filled(_GOLD), F.lit("*plain*"), F.lit("<b>PLAIN</b>")), F.lit("\n- "), F.lit("\n* "))
    part = spread_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = part.select("p_partkey", _filled(_GOLD).alias("gold"), F.when(k == 0, same).when(k == 1, F.lit("")).otherwise(F.replace(_filled(_GOLD), F.lit("# "), F.lit(""))).alias("candidate"))
    return scoring.with_scores(rows).select("p_partkey", *scoring.METRICS)


@query("""
WITH s AS (SELECT p_partkey, p_size / 50.0 AS content, (p_partkey % 7) / 7.0 AS o FROM part)
SELECT p_partkey FROM s ORDER BY (content + o) / 2, p_partkey LIMIT 25
""")
def worst_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 worst by content and order (a report of that many rows)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("content"), ((F.col("p_partkey") % 7) / 7.0).alias("order"))
    return scoring.worst(rows, tie=("p_partkey",)).select("p_partkey")


@query("SELECT 'd/' || p_partkey || '.docx' AS path, CASE p_partkey % 3 WHEN 0 THEN 'd/' || p_partkey || '.docx.md' WHEN 1 THEN 'd/' || p_partkey || '.md' END AS truth FROM part")
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts by the whole name first, else by its stem."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("d/"), k.cast("string"))
    part = table(spark, sf_dir, "part")
    exact = part.where(k % 3 == 0).select(F.concat(name, F.lit(".docx.md")).alias("path"))
    stems = part.where(k % 3 < 2).select(F.concat(name, F.lit(".md")).alias("path"))
    return scoring.pair_truth(part.select(F.concat(name, F.lit(".docx")).alias("path")), exact.unionByName(stems)).select("path", "truth")


# Cache


@query("""
WITH d AS (SELECT text AS t FROM documents UNION ALL SELECT text FROM benchmark), c AS (SELECT DISTINCT text AS t FROM documents)
SELECT CAST(count(*) AS BIGINT) AS asked, CAST(count(*) FILTER (t IN (SELECT t FROM c)) AS BIGINT) AS hits, round(count(*) FILTER (t IN (SELECT t FROM c)) / count(*), 9) AS rate,
    CAST(count(DISTINCT t) FILTER (t NOT IN (SELECT t FROM c)) AS BIGINT) AS stored FROM d
""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H01 + H02 + H03 + A17 + E04 + Y01: a second run finds what the first stored, and nothing that was tampered with."""
    as_docs = lambda t: with_hints(table(spark, sf_dir, t).select(F.col("text").cast("binary").alias("content"), F.lit(".txt").alias("ext")))
    _, stored = cache.convert_cached(as_docs("documents"), spark.createDataFrame([], cache.SCHEMA))
    odd = cache.convert_cached(as_docs("benchmark"), spark.createDataFrame([], cache.SCHEMA))[1]
    held = cache.in_memory(stored.unionByName(odd.withColumn("markdown", F.concat("markdown", F.lit("tampered")))))
    asked = as_docs("documents").unionByName(as_docs("benchmark"))
    rate = cache.hit_rate(asked, held)
    fresh = cache.convert_cached(asked, held)[1].agg(F.count("*").alias("stored"))
    both = rate.withColumn("one", F.lit(1)).join(fresh.withColumn("one", F.lit(1)), "one")  # a row each
    return both.select("asked", "hits", F.round("rate", 9).alias("rate"), "stored")


@query("""
WITH d AS (SELECT DISTINCT text AS t FROM documents)
SELECT CAST(count(*) AS BIGINT) AS entries, CAST(sum(strlen(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\\n+\\z', '')) + 1) AS BIGINT) AS bytes, true AS swept, true AS emptied, true AS guarded FROM d
""")
def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K06 + H04 + H05 + Y02 + A17 + O07: a cache in files: stored by shard, read, swept to a budget, emptied; other folders refused."""
    docs = with_hints(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content"), F.lit(".txt").alias("ext")))
    folder = folder_for(spark, "cache")
    cache.append_to(cache.convert_cached(docs, spark.createDataFrame([], cache.SCHEMA))[1], folder)
    entries, size, _ = cache.stats(cache.verified(cache.read_cache(spark, folder))).first()
    kept = cache.stats(cache.sweep(spark, folder, size // 2)).first()
    emptied = cache.clean(folder) > 0 and cache.clean(folder) == 0
    try:
        cache.clean(sf_dir if "://" in sf_dir else f"file://{sf_dir}")
        guarded = False
    except ValueError:
        guarded = True
    row = (entries, size, kept["bytes"] <= 0.8 * (size // 2), emptied, guarded)
    return spark.createDataFrame([row], "entries long, bytes long, swept boolean, emptied boolean, guarded boolean")


@query("SELECT 'http://h/' || p_partkey || '/' || i AS loc, CAST(NULL AS TIMESTAMP) AS lastmod FROM part, range(3) AS t(i) UNION ALL SELECT 'http://h/' || p_partkey || '/dated', TIMESTAMP '2024-01-02 02:04:05' FROM part")
def packed_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17 + B05: gzipped sitemaps with and without namespaces, dates with offsets, broken ones without rows."""

    def pack(keys: pa.Array) -> pa.Array:
        import gzip

        out = []
        for k in keys.to_pylist():
            ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"' if k % 2 else ""
            urls = "".join(f"<url><loc> http://h/{k}/{i} </loc></url>" for i in range(3))
            body = f"<urlset{ns}>{urls}<url><loc>http://h/{k}/dated</loc><lastmod>2024-01-02T03:04:05+01:00</lastmod></url></urlset>".encode()
            out.append(gzip.compress(body, mtime=0) if k % 3 else body)
        return pa.array(out, pa.binary())

    part = spread_rows(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    name = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    maps = part.select(name.alias("url"), F.arrow_udf(pack, "binary")("p_partkey").alias("body"))
    broken = part.select(F.concat(F.lit("b"), name).alias("url"), F.lit("<urlset><url><loc>http://h/no</loc>").cast("binary").alias("body"))
    found = files.sitemap_entries(maps.unionByName(broken), maps.select("url").unionByName(broken.select("url")))
    return found.select("loc", F.col("lastmod").cast("timestamp_ntz").alias("lastmod"))


@query("""
SELECT 'http://h' || (p_partkey % 7) || '/' || p_partkey AS url,
    (row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) - 1) * CASE WHEN p_partkey % 7 = 3 THEN 2.5 WHEN p_partkey % 7 = 4 THEN 0.5 ELSE 0.5 END AS at FROM part
""")
def politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13 + Z02 + Y19: requests to a host spaced by one's own delay, or by a longer one that its robots file asks for."""
    k = F.col("p_partkey")
    urls = table(spark, sf_dir, "part").select(F.concat(F.lit("http://h"), (k % 7).cast("string"), F.lit("/"), k.cast("string")).alias("url"), k.alias("ord"))
    bodies = [("http://h3", "User-agent: other\nCrawl-delay: 99\n\nUser-agent: *\nCrawl-delay: 2.5"), ("http://h4", "User-agent: *\nCrawl-delay: 0.1\nCrawl-delay: 7"), ("http://h5", "User-agent: *\nCrawl-delay: soon")]
    asked = R.delays(spark.createDataFrame(bodies, "origin string, body string"), "folio")
    return schedule(urls, 0.5, asked).select("url", "at")


@query("SELECT n_nationkey AS nation, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) AS markdown FROM nation")
def streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z01 + S03 + S05 + K01: files converted as a stream finds them, in two runs from one checkpoint."""
    inbox, outbox, checkpoint = (folder_for(spark, x) for x in ("inbox", "outbox", "intake"))
    nation = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("key,name\n"), F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_name"))
    for part in (nation.where("n_regionkey < 2"), nation.where("n_regionkey >= 2")):
        rows = part.select(F.concat(F.lit("nested/n"), F.col("n_nationkey").cast("string"), F.lit(".csv")).alias("out_name"), body.alias("markdown"))
        files.write_markdown(rows, inbox)
        stream = intake.watch(spark, f"{inbox}/nested", "*.csv")
        intake.run(stream, checkpoint, lambda df, n: df.select("path", "markdown").write.mode("append").parquet(outbox)).awaitTermination()
    out = spark.read.parquet(outbox)
    return out.select(F.regexp_extract("path", r"n(\d+)\.csv$", 1).cast("int").alias("nation"), "markdown")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts of the events as a stream, under a watermark."""
    outbox, checkpoint = folder_for(spark, "windows"), folder_for(spark, "windows-state")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    timed = intake.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    sink = timed.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(outbox))
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(outbox)
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))
