"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, stages

STAGES = [
    ("language_id", stages.language_id),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("secret_scans", stages.secret_scans),
    ("bpe_encoding", stages.bpe_encoding),
]

#: Compressed sizes under trained dictionaries and merges of a vocabulary aren't SQL; tests hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs, folder = common.table(spark, sf_dir, "documents"), common.scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
