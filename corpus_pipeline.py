"""A training-data pipeline over ``documents``: five stages, each written and reread before the next.

Defined results: an empty table gives an empty result of the last stage's columns; a null text counts as empty, and is
rejected by the first stage as too short; rows with a null id and rows that share one are kept or dropped each on its own
account, but of copies with one id near-dedup keeps all rows of the smallest id; further columns, whatever their names,
go through all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import bpe, decontaminate, near_dedup, quality_rules, secret_scan
from annalist.llm.common import shared_folder
from annalist.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id."""
    return near_dedup.keep(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets replaced in their texts."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts, encoded and decoded."""
    return bpe.encode_digests(docs, vocabulary())


STAGES = [("quality rules", quality), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("secret scans", secrets), ("byte-level BPE", tokens)]

#: The learnt and hashed decisions of the stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is a Parquet table that the next stage reads."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
