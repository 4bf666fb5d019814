"""The corpus pipeline: documents through five operators, each stage's result written and read by the next.

A stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept. All stages but the
last return the columns of documents; the last adds mix_copies, how often the mix takes the row. An empty table stays
empty through all stages; null texts count as empty ones; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indexspark.llm import common, decontaminate, exact_dedup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject."""
    return toxicity.keep_clean(docs, common.read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, k=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.drop_documents(docs, common.read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with mix_copies."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The first stage is a trained machine, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = common.scratch_mark()
        out = stage(spark, docs, sf_dir)
        path = f"{common.shared_dir(spark)}/{name}-{common.new_id()}"
        out.write.parquet(path)
        common.release(spark, before)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
