"""A training corpus from raw documents: each stage works on all that the one before it has kept.

Stages are written as Parquet and read again, so a lost executor never costs more than the stage it was lost in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docjobs.llm import decontam, exact_dedup, near_copies, packing, toxicity
from docjobs.llm.common import drop_written, n_written, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated toxicity of 0.5 or more go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similarity 0.8 or more, the document with the smallest id stays."""
    return near_copies.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage's model can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), n_written()
    for name, stage in STAGES[:-1]:
        docs, folder = stored(stage(spark, docs, sf_dir), name)
        drop_written(spark, first, but=folder)  # the stage before, and what this one has written on its way
    return STAGES[-1][1](spark, docs, sf_dir)
