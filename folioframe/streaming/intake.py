"""Documents converted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioframe.operators.convert import convert, with_hints
from folioframe.operators.cache import cache_key
from folioframe.operators.formats.emit import Options
from folioframe.sources.files import with_path_hints

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear in a folder, with hints."""
    rows = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(folder)
    return with_path_hints(rows.withColumnRenamed("modificationTime", "arrived"))


def deduplicated(stream: DataFrame, options: Options | None = None, within: str = "1 hour") -> DataFrame:
    """Documents whose cache key came before within so long are dropped."""
    keyed = with_hints(stream).withColumn("key", cache_key(options))
    return keyed.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["key"])


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], options: Options | None = None) -> StreamingQuery:
    """Convert each batch and hand it to the sink; starts from the checkpoint again."""
    return (
        stream.writeStream.foreachBatch(lambda df, n: sink(convert(df, options), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind, late ones within the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
