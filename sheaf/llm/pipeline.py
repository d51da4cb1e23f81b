"""Stages of the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import bpe, decontaminate, lines, minhash, toxicity
from sheaf.llm.tables import table
from sheaf.session import shared_dir, ship_package


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model of ``labels``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat another."""
    ship_package(spark)
    return lines.dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship_package(spark)
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    ship_package(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.token_report(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", lines_once),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared folder and read again, so
    a lost executor costs one stage's tasks and no stage is worked out twice."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        where = shared_dir(spark, "pipeline")
        out.write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
