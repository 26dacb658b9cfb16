"""Places that all executors share, and session settings the operators read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI below spark.checkpoint.dir.

    Where that is unset and the master is local (tests), a temporary folder becomes the
    checkpoint directory; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="folioframe-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it: cuts the lineage and
    survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of so many rows for what runs inside, so that long texts make no huge ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def new_file(path: str):
    """A file of the shared folder, written aside and put in place by one rename, so
    that a task which runs twice leaves one whole file."""
    fs, at = pafs.FileSystem.from_uri(path)
    aside = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as f:
        yield f
    fs.move(aside, at)


def read_file(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def new_folder(path: str) -> None:
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at, recursive=True)
