"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, exact_search, language_id, licenses, near_duplicates, oracles, pii, quality, resampling, sharding, token_counts, vector_codes
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"))


def op3_language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_small_world_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_with_label_errors(table(spark, sf_dir, "embeddings"))


def op13_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.exact_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_weighted_minhash,
        op3_language_field,
        op4_string_tiling,
        op5_patience_licenses,
        op6_importance_resampling,
        op7_feistel_shards,
        op8_personal_data,
        op9_bpe_round_trip,
        op10_small_world_neighbours,
        op11_target_resampling,
        op12_filtering_lloyd_codes,
        op13_histogram_top_k,
    )
}

#: DuckDB runs these; models that are fitted by iteration, alignments and the libraries' tokenizers can't be written so,
#: and tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_weighted_minhash": oracles.WEIGHTED_MINHASH,
    "op6_importance_resampling": oracles.IMPORTANCE_RESAMPLING,
    "op7_feistel_shards": oracles.FEISTEL_SHARDS,
    "op10_small_world_neighbours": oracles.SMALL_WORLD_NEIGHBOURS,
    "op11_target_resampling": oracles.TARGET_RESAMPLING,
    "op12_filtering_lloyd_codes": oracles.FILTERING_LLOYD_CODES,
    "op13_histogram_top_k": oracles.HISTOGRAM_TOP_K,
}
