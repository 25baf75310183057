"""One named query per corpus operator, over its whole tables, and the SQL of those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votescore.fixtures import table
from votescore.llm import bpe, classifier, oracles, simhash
from votescore.llm.common import ship
from votescore.llm.decontaminate import contaminated_documents
from votescore.llm.fingerprints import compared
from votescore.llm.lexical_search import ranked
from votescore.llm.licenses import known_digests, license_scan
from votescore.llm.line_dedup import repeated_lines
from votescore.llm.packing import pack
from votescore.llm.quality_rules import quality_verdicts
from votescore.llm.runs import periodic_runs
from votescore.llm.sharding import sharded
from votescore.llm.substring_dedup import repeated_passages

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir), known_digests(spark))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), PACKING_TOKENIZER)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), BPE_RANKS, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(_documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return classifier.scored(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_documents(spark, sf_dir), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.LICENSE_SCAN,
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op11_lexical_search": oracles.LEXICAL_SEARCH,
    "op12_decontamination": oracles.DECONTAMINATION,
}
