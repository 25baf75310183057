"""A corpus pipeline over the table documents; each stage reads what its predecessor wrote."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from votescore.fixtures import table
from votescore.llm.common import ship
from votescore.llm.line_dedup import remove_repeated_lines
from votescore.llm.packing import pack
from votescore.llm.quality_rules import quality_filter
from votescore.llm.simhash import drop_near_duplicates
from votescore.llm.substring_dedup import remove_repeated_passages
from votescore.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive rules."""
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier in the corpus."""
    ship(spark)
    return remove_repeated_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by the links of the SimHash operator, and by similar sets of shingles."""
    ship(spark)
    return drop_near_duplicates(docs, fingerprints=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start earlier in the corpus."""
    ship(spark)
    return remove_repeated_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages that tokenize and pack.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
