"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_for(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI below spark.checkpoint.dir.

    Where that is unset and the master is local, as in tests, a temporary folder takes its
    place; on a cluster an unset folder is an error.
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


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read again."""
    path = folder_for(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
