"""Breadth-first crawl over a table of pages, level by level.

The pages are looked up by a join, so the crawl needs no network; frontier and seen set
are tables, and each level is written so that its plan stays short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import robots as R
from folioframe.functions import urls as U
from folioframe.sources.shared import write_and_read


@dataclass
class CrawlOptions:
    max_depth: int = 1
    max_pages: int | None = 200  # None: no cap
    max_bytes: int | None = None  # of the pages' column bytes
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    same_host: bool = True
    sitemap_only: bool = False


@dataclass
class CrawlResult:
    pages: DataFrame
    skipped: int
    truncated: bool


def crawl(
    seeds: DataFrame,
    links: DataFrame | Callable[[DataFrame], DataFrame],
    pages: DataFrame,
    options: CrawlOptions | None = None,
    rules: DataFrame | None = None,
    sitemap: DataFrame | None = None,
    visit: Callable[[DataFrame, int], None] | None = None,
) -> CrawlResult:
    """pages reached: url, depth, source ('seed', 'sitemap' or 'link'), ord.

    seeds, sitemap: (url).  links: (url, ord, link), normalised, or what gives those of some
    pages, which is then asked for the pages of each level alone, so that each is parsed once.
    pages: (url, ...), what can be fetched.  rules: robots rules by origin.  Order is by depth,
    then by discovery.  A cap on pages sets truncated, so does one on bytes (pages are taken
    in order while those before are below it), and so do links beyond max_depth.
    """
    o = options or CrawlOptions()
    spark = seeds.sparkSession
    first = seeds.select(U.normalise(F.col("url")).alias("url"), F.lit(0).alias("src"))
    if sitemap is not None:
        first = first.unionByName(sitemap.select(U.normalise(F.col("url")).alias("url"), F.lit(1).alias("src")))
    first = first.where("url IS NOT NULL").groupBy("url").agg(F.min("src").alias("src"))
    frontier = write_and_read(first.withColumn("ord", F.struct(F.lit("").alias("parent"), F.lit(0).alias("n"))), "frontier")
    hosts = write_and_read(seeds.select(U.canonical_host(U.normalise(F.col("url"))).alias("host")).where("host IS NOT NULL").distinct(), "hosts")
    seen = frontier.select("url")
    done: DataFrame | None = None
    n, size, skipped, truncated, depth = 0, 0, 0, False, 0
    fetched = ["url"] if o.max_bytes is None else ["url", "bytes"]
    while not frontier.isEmpty():
        now = frontier
        if rules is not None:
            target = F.regexp_extract("url", r"^[a-z]+://[^/]*(.*)$", 1)
            checked = R.allow(now.withColumns({"origin": U.origin(F.col("url")), "target": target}), rules)
            now = checked.where("allowed").select("url", "src", "ord")
        found = now.join(pages.select(*fetched).dropDuplicates(["url"]), "url")
        left = None if o.max_pages is None else o.max_pages - n
        capped = found if left is None else found.orderBy("src", "ord", "url").limit(left)
        if o.max_bytes is not None:
            capped = _below(write_and_read(capped, "fetched"), o.max_bytes - size)
        level = write_and_read(capped.withColumn("depth", F.lit(depth)), "level")
        took = level.count()
        if o.max_bytes is not None:
            size += level.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
            truncated = truncated or (size >= o.max_bytes and found.count() > took)
            level = level.drop("bytes")
        truncated = truncated or (left is not None and took == left and found.count() > left)
        n += took
        done = level if done is None else done.unionByName(level)
        if visit is not None:
            visit(level, depth)
        if o.sitemap_only or (o.max_pages is not None and n >= o.max_pages) or (o.max_bytes is not None and size >= o.max_bytes):
            break
        here = level.select("url")
        own = links(pages.join(here, "url", "left_semi")) if callable(links) else links.join(here, "url", "left_semi")
        out = own.select("link", F.struct(F.col("url").alias("parent"), F.col("ord").cast("int").alias("n")).alias("ord"))
        new = out.groupBy(F.col("link").alias("url")).agg(F.min("ord").alias("ord")).join(seen, "url", "left_anti")
        new = write_and_read(new, "new")
        kept = new.where(U.allowed(F.col("url"), o.include, o.exclude))
        if o.same_host:
            kept = kept.withColumn("host", U.canonical_host(F.col("url"))).join(hosts, "host", "left_semi").drop("host")
        if depth >= o.max_depth:
            truncated = truncated or not kept.isEmpty()
            break
        frontier = write_and_read(kept.select("url", F.lit(2).alias("src"), "ord"), "frontier")
        skipped += new.count() - frontier.count()
        seen = write_and_read(seen.unionByName(new.select("url")), "seen")
        depth += 1
    empty = spark.createDataFrame([], "url string, src int, ord struct<parent:string,n:int>, depth int")
    names = F.element_at(F.array(F.lit("seed"), F.lit("sitemap"), F.lit("link")), F.col("src") + 1)
    return CrawlResult((done if done is not None else empty).withColumn("source", names).drop("src"), skipped, truncated)


def schedule(urls: DataFrame, delay: float, asked: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """urls (url, ...) with at: seconds after the start at which each may be fetched, so that
    requests to one host are at least delay apart, or what its robots file asks for (origin,
    delay) if that is longer."""
    rows = urls.withColumns({"_host": U.canonical_host(F.col("url")), "_origin": U.origin(F.col("url"))})
    k = F.row_number().over(Window.partitionBy("_host").orderBy(order)) - 1
    rows = rows.withColumn("_k", k)
    if asked is None:
        gap = F.lit(float(delay))
    else:
        rows = rows.join(asked.select(F.col("origin").alias("_origin"), F.col("delay").alias("_asked")), "_origin", "left")
        gap = F.greatest(F.lit(float(delay)), F.coalesce("_asked", F.lit(0.0)))
    return rows.withColumn("at", F.col("_k") * gap).drop("_host", "_origin", "_k", "_asked")


def _below(rows: DataFrame, budget: int) -> DataFrame:
    """Rows in order as long as the bytes before them are below a budget.

    Ranges of the order are summed first, so that no window holds more than one of them.
    """
    by = ["src", "ord", "url"]
    parts = -(-rows.count() // 100_000) or 1
    placed = write_and_read(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    per = placed.groupBy("_part").agg(F.sum("bytes").alias("_b"))
    per = per.select("_part", (F.sum("_b").over(Window.orderBy("_part")) - F.col("_b")).alias("_before"))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_in", inside).join(per, "_part").where(F.col("_before") + F.col("_in") < F.lit(budget)).select(rows.columns)


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) within so many steps of a seed; edges (src, dst), seeds (node)."""
    seen = write_and_read(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier = seen
    for d in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = write_and_read(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
