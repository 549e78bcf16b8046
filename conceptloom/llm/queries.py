"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, hard_negatives, jaccard_join, language, odd_sketches, packing, perplexity, quality_model, sharding, substring_dedup, surrogates, token_files
from .common import read_table
from .oracles import ORACLE_SQL


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.score_documents(docs, quality_model.train(docs, read_table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal_data(read_table(spark, sf_dir, "documents"))


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op11_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on; every hundredth row is an anchor."""
    label = F.col("label").cast("long")
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_substring": op4_substring,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard": op7_jaccard,
    "op8_surrogates": op8_surrogates,
    "op9_perplexity": op9_perplexity,
    "op10_language": op10_language,
    "op11_near_duplicates": op11_near_duplicates,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
