"""A conversion cache: results by a digest of content, hints and options."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.operators.convert import VERSION, convert, with_hints
from folioframe.operators.formats.emit import Options
from folioframe.sources.shared import write_and_read

SCHEMA = "key string, schema int, version string, markdown string, title string, status string, error_code string, error_msg string, size long, seal string, shard string"
RESULT = ("markdown", "title", "status", "error_code", "error_msg")
CACHEABLE = ("unsupported", "no_text_layer", "garbled_text")


def field(tag: str, value: Column) -> Column:
    """A tagged value with its length before it, so that no two lists of fields are alike."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit(f"{tag}:"), F.length(v).cast("string"), F.lit(":"), v)


def cache_key(options: Options | None = None, version: str = VERSION) -> Column:
    """SHA-256 over content, hints, options that matter, what depth is left, and version."""
    o = options or Options()
    parts = [field("content", F.sha2(F.col("content"), 256)), *(field(c, F.col(c)) for c in ("mime", "ext", "charset", "file_name", "url"))]
    parts += [field(k, F.lit(str(v))) for k, v in (("depth", o.max_depth - o.depth), ("images", o.drop_images), ("per", o.max_image_bytes), ("all", o.max_image_total), ("cs", o.charset))]
    return F.sha2(F.concat(*parts, field("version", F.lit(version))), 256)


def seal() -> Column:
    """A digest of an entry's key and payload: an entry that was moved or changed has another."""
    return F.sha2(F.concat(*(field(c, F.col(c)) for c in ("key", *RESULT))), 256)


def verified(cache: DataFrame) -> DataFrame:
    """Entries of this layout whose key is one and whose seal is theirs; all others are misses."""
    sound = (F.col("schema") == 1) & F.col("key").rlike("^[0-9a-f]{8,}$") & (F.col("shard") == F.substring("key", 1, 2)) & (F.col("seal") == seal())
    return cache.where(F.coalesce(sound, F.lit(False)))


def in_memory(cache: DataFrame) -> DataFrame:
    """The cache held by the executors as far as memory goes, least recently used parts first out."""
    return cache.persist(StorageLevel.MEMORY_AND_DISK)


def hit_rate(docs: DataFrame, cache: DataFrame, options: Options | None = None) -> DataFrame:
    """asked, hits and rate of documents against a cache."""
    keyed = with_hints(docs).select(cache_key(options).alias("key"))
    known = verified(cache).select("key", F.lit(1).alias("hit")).dropDuplicates(["key"])
    asked, hits = F.count("*"), F.count("hit")
    return keyed.join(known, "key", "left").agg(asked.alias("asked"), hits.alias("hits"), F.when(asked > 0, hits / asked).otherwise(F.lit(0.0)).alias("rate"))


def convert_cached(docs: DataFrame, cache: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rows to append to the cache): only what the cache lacks is converted.

    Equal documents are converted once.  Failures that may pass by are not kept.
    """
    keyed = with_hints(docs).withColumn("key", cache_key(options))
    valid = verified(cache).dropDuplicates(["key"])
    miss = keyed.dropDuplicates(["key"]).join(valid.select("key"), "key", "left_anti")
    made = convert(miss, options)
    result = list(RESULT)
    fresh = made.select("key", *result)
    keep = (F.col("status") == "ok") | F.col("error_code").isin(*CACHEABLE)
    append = fresh.where(keep).select(
        "key", F.lit(1).alias("schema"), F.lit(VERSION).alias("version"), *result,
        F.coalesce(F.octet_length("markdown"), F.lit(0)).cast("long").alias("size"), seal().alias("seal"), F.substring("key", 1, 2).alias("shard"),
    )
    return keyed.join(valid.select("key", *result).unionByName(fresh), "key", "left"), append


def append_to(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("shard").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _guarded(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a cache's folder, if it is one: not near the root, and with
    nothing in it but shards and what Spark puts beside them."""
    fs, at = pafs.FileSystem.from_uri(path)
    if len([x for x in at.split("/") if x]) < 2:
        raise ValueError(f"{path!r} is no folder of a cache")
    for entry in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if not re.fullmatch(r"shard=[0-9a-f]{2}|_SUCCESS|\._SUCCESS\.crc|_temporary", entry.base_name):
            raise ValueError(f"{path!r} holds {entry.base_name!r}, which no cache has")
    return fs, at


def clean(path: str) -> int:
    """Removes all entries of a cache's folder; the number of its shards."""
    fs, at = _guarded(path)
    found = [e.path for e in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if e.base_name.startswith("shard=")]
    for shard in found:
        fs.delete_dir(shard)
    return len(found)


def sweep(spark: SparkSession, path: str, budget: int) -> DataFrame:
    """Keeps what fits the budget by age of file: see survivors.  The kept entries are
    written beside the folder and take its place by renaming."""
    fs, at = _guarded(path)
    aged = spark.read.schema(SCHEMA).parquet(path).withColumn("used", F.col("_metadata.file_modification_time"))
    beside = f"{path.rstrip('/')}.swept"
    append_to(survivors(aged, budget).drop("used"), beside)
    fs.delete_dir(at)
    fs.move(pafs.FileSystem.from_uri(beside)[1], at)
    return read_cache(spark, path)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("status") == "error").alias("errors"))


def survivors(entries: DataFrame, budget: int, used: str = "used", size: str = "size") -> DataFrame:
    """What a sweep keeps: once over the budget, the newest entries up to 80% of it.

    Sizes are summed by hour, then in the hour in which the budget runs out by time, then by
    the head of the key, and so on: no window holds more than such sums, and entries
    stay where they are.
    """
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if total <= budget:
        return entries
    time, key = -F.coalesce(F.unix_micros(F.col(used).cast("timestamp")), F.lit(-(1 << 62))), F.coalesce(F.col("key"), F.lit(""))
    part = write_and_read(entries.select(time.alias("_t"), key.alias("_k"), F.col(size).alias("_b")), "ages")
    keep, inside, spent = F.lit(False), F.lit(True), 0
    for level in (lambda t, k: F.floor(t / 3_600_000_000), lambda t, k: t, lambda t, k: F.substring(k, 1, 2), lambda t, k: F.substring(k, 1, 4), lambda t, k: k):
        at = level(F.col("_t"), F.col("_k"))
        sums = part.groupBy(at.alias("_g")).agg(F.sum("_b").alias("_b"))
        run = F.lit(spent) + F.sum("_b").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0))
        # the first group that does not fit whole
        last = sums.withColumn("_run", run).where(F.col("_run") > F.lit(0.8 * budget)).orderBy("_g").first()
        keep, inside = keep | (inside & (level(time, key) < F.lit(last["_g"]))), inside & (level(time, key) == F.lit(last["_g"]))
        part, spent = part.where(at == F.lit(last["_g"])), last["_run"] - last["_b"]
    return entries.where(keep)
