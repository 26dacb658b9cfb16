"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and returns documents with the same columns; the last adds the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontaminate, langid, mixing, neardup, sharding
from folioframe.llm.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """Columns of documents, n_chars that of the text as it is now."""
    n: Column = F.char_length("text").cast("long")
    return df.withColumn("n_chars", n).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rejected language go; a missing label is filled in."""
    model = langid.train(docs, ~langid.held_out())
    found = langid.with_language(docs, model, "_p").where(~F.col("_p.rejected"))
    return _documents(found.withColumn("lang", F.coalesce("lang", "_p.lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least id stays."""
    return neardup.keep_one(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontaminate.remove_contamination(docs, benchmark))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source as its weight wants: one row for each document and pass."""
    sized = docs.select(*COLUMNS)
    mixed = mixing.mix_sources(sized, mixing.word_count(F.col("text")))
    return _documents(mixing.taken_texts(mixed))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards of near equal bytes; equal texts lie together."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return sharding.shard(docs.select(*COLUMNS), size, F.xxhash64("text"), [F.col("doc_id")], 16)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix_sources", mix_to_weights),
    ("shard", shard_documents),
]

#: SQL can't express the models, signatures and permutations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
