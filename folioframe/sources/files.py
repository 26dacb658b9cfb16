"""Documents from files, folders and byte columns; sitemaps."""

from __future__ import annotations

import zlib
from datetime import datetime, timezone
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.functions import hints as H
from folioframe.sources.shared import write_and_read

SITEMAP_BYTES, SITEMAP_URLS = 32 << 20, 50_000


def with_path_hints(files: DataFrame, path: str = "path") -> DataFrame:
    """Extension, file name and MIME type by the path."""
    p = F.col(path)
    return files.withColumns({"file_name": H.file_name(p), "ext": H.ext_of(p)}).withColumn("mime", H.mime_of_ext(F.col("ext")))


def read_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """path, content, length and hints of files; folders are walked."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return with_path_hints(reader.load(list(paths)).select("path", "content", "length"))


def read_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """Any table with a binary (or text) column as documents."""
    return df.withColumn("content", F.col(content).cast("binary"))


def type_hint(docs: DataFrame, ext: str) -> DataFrame:
    """All documents taken for one type."""
    e = H.norm_ext(F.lit(ext))
    return docs.withColumns({"ext": e, "mime": H.mime_of_ext(e)})


def plan_outputs(docs: DataFrame, order: str, name: str = "file_name", ext: str = ".md") -> DataFrame:
    """docs with out_name: the name of each input with another extension, no two alike.

    Names that repeat get -1, -2, ... in order; numbers that would give the name of another
    input are left out.  An input without a name is a document.
    """
    stem = F.regexp_replace(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "-")
    rows = docs.withColumn("_stem", F.when(F.coalesce(stem, F.lit("")) == "", F.lit("document")).otherwise(stem))
    return _numbered(rows, "_stem", F.col(order), 1).withColumn("out_name", F.concat("_stem", "_number", F.lit(ext))).drop("_stem", "_number")


def unique_paths(docs: DataFrame, path: str = "path", owner: str = "url", ext: str = ".md") -> DataFrame:
    """docs with path made unique: owners that share one get -2, -3, ... before the extension,
    by the order of owners; all rows of an owner keep one path."""
    owners = docs.select(F.col(path).alias("_path"), F.col(owner).alias("_owner")).distinct()
    stem = F.when(F.endswith("_path", F.lit(ext)), F.expr(f"substring(_path, 1, length(_path) - {len(ext)})")).otherwise(F.col("_path"))
    named = _numbered(owners.withColumn("_stem", stem), "_stem", F.col("_owner"), 2)
    named = named.select("_path", "_owner", F.concat("_stem", "_number", F.lit(ext)).alias("_new"))
    out = docs.join(named, (F.col(path) == F.col("_path")) & F.col(owner).eqNullSafe(F.col("_owner")))
    return out.withColumn(path, F.col("_new")).drop("_path", "_owner", "_new")


def _numbered(rows: DataFrame, stem: str, order: Column, first: int) -> DataFrame:
    """rows with _number: '' for the first of a stem, '-n' for the others, n from first on but
    for the numbers with which the stem is that of other rows."""
    stems = rows.select(F.col(stem).alias("_s")).distinct()
    base, n = F.regexp_extract("_s", r"^(.*)-[1-9][0-9]{0,17}$", 1), F.regexp_extract("_s", r"-([1-9][0-9]{0,17})$", 1)
    taken = stems.where(n != "").groupBy(base.alias("_s")).agg(F.array_sort(F.collect_list(n.cast("long"))).alias("_taken"))
    taken = taken.withColumn("_taken", F.filter("_taken", lambda x: x >= first))
    k = F.row_number().over(Window.partitionBy(stem).orderBy(order)).cast("long") - 1
    rows = rows.withColumn("_k", k).join(taken.withColumnRenamed("_s", stem), stem, "left")
    # a taken number stands before the k-th free one if fewer than k free ones stand before it
    before = F.size(F.filter(F.transform(F.col("_taken"), lambda x, i: x - first - i), lambda free: free < F.col("_k")))
    number = F.col("_k") + (first - 1) + F.greatest(F.coalesce(before, F.lit(0)), F.lit(0))
    return rows.withColumn("_number", F.when(F.col("_k") == 0, F.lit("")).otherwise(F.concat(F.lit("-"), number.cast("string")))).drop("_k", "_taken")


def contained(path: Column) -> Column:
    """Whether a relative path stays below the folder that it is joined to."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: _step(a, p))
    return F.coalesce((path != "") & ~path.rlike(r"^[/\\]|^[A-Za-z]:") & (depth["least"] >= 0) & (depth["at"] > 0), F.lit(False))


def _step(a: Column, part: Column) -> Column:
    at = a["at"] + F.when(part == "..", F.lit(-1)).otherwise(F.lit(1))
    return F.struct(at.alias("at"), F.least(a["least"], at).alias("least"))


def in_order(docs: DataFrame, order: str, text: str = "markdown"):
    """Markdown of all documents in the order of the input, one after another, for a single
    stream; the driver holds one partition at a time."""
    for r in docs.where(F.col(text).isNotNull()).orderBy(order).select(text).toLocalIterator():
        yield r[0]


def write_markdown(docs: DataFrame, folder: str) -> int:
    """One file per row (out_name, markdown) below a folder, from the executors."""
    import pyarrow.fs as pafs

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        n = 0
        for b in batches:
            for name, text in zip(b.column("out_name").to_pylist(), b.column("markdown").to_pylist()):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} leaves the folder")
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return docs.select("out_name", "markdown").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_LAYOUTS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%Y-%m", "%Y")


def lastmod(raw: str) -> datetime | None:
    for layout in _LAYOUTS:
        try:
            d = datetime.strptime(raw.strip(), layout)
            return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)
        except ValueError:
            continue
    return None


def parse_sitemap(body: bytes) -> tuple[list[dict], list[str]]:
    """(entries, child sitemaps); a document that is no sitemap has neither."""
    if body[:2] == b"\x1f\x8b":
        try:
            body = zlib.decompressobj(31).decompress(body, SITEMAP_BYTES + 1)
        except zlib.error:
            return [], []
    if len(body) > SITEMAP_BYTES or b"<!ENTITY" in body[:4096]:
        return [], []
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return [], []
    local = lambda e: e.tag.rpartition("}")[2]
    if local(root) not in ("urlset", "sitemapindex"):
        return [], []
    entries = []
    for e in root:
        f = {local(c): (c.text or "").strip() for c in e}
        if f.get("loc"):
            raw = f.get("lastmod", "")
            entries.append({"loc": f["loc"], "lastmod": lastmod(raw) if raw else None, "lastmod_raw": raw})
    return ([], [e["loc"] for e in entries]) if local(root) == "sitemapindex" else (entries[:SITEMAP_URLS], [])


_ENTRY = pa.struct([("loc", pa.string()), ("lastmod", pa.timestamp("us")), ("lastmod_raw", pa.string())])


def _sitemaps(body: pa.Array) -> pa.Array:
    rows = [dict(zip(("entries", "children"), parse_sitemap(b or b""))) for b in body.to_pylist()]
    return pa.array(rows, pa.struct([("entries", pa.list_(_ENTRY)), ("children", pa.list_(pa.string()))]))


def sitemap_entries(documents: DataFrame, roots: DataFrame, max_nesting: int = 3) -> DataFrame:
    """(loc, lastmod, lastmod_raw) of the sitemaps that roots (url) lead to.

    documents: (url, body), what can be fetched; nesting beyond the limit is left.
    Each is parsed once, for its entries and the sitemaps that it names.
    """
    parsed = documents.select(
        "url", F.arrow_udf(_sitemaps, "struct<entries:array<struct<loc:string,lastmod:timestamp_ntz,lastmod_raw:string>>,children:array<string>>")("body").alias("s")
    )
    parsed = write_and_read(parsed, "sitemaps")
    out: DataFrame | None = None
    level = roots.select("url").distinct()
    seen = level
    for _ in range(max_nesting + 1):
        now = parsed.join(level, "url", "left_semi")
        rows = now.select(F.inline("s.entries"))
        out = rows if out is None else out.unionByName(rows)
        level = now.select(F.explode("s.children").alias("url")).distinct().join(seen, "url", "left_anti")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return out.groupBy("loc").agg(F.max("lastmod").alias("lastmod"), F.max("lastmod_raw").alias("lastmod_raw"))
