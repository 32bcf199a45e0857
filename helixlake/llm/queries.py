"""Driver queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm import ctw, dartminhash, fingerprint, langid, line_dedup, mixing, packing, pii, suffix_dedup, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op8_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_report(table(spark, sf_dir, "documents"))


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.class_report(table(spark, sf_dir, "documents"))


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_personal_data": op3_personal_data,
        "op4_product_quantisation": op4_product_quantisation,
        "op5_language_id": op5_language_id,
        "op6_source_mixing": op6_source_mixing,
        "op7_sparse_suffix_dedup": op7_sparse_suffix_dedup,
        "op8_context_tree_weighting": op8_context_tree_weighting,
        "op9_dart_minhash": op9_dart_minhash,
        "op10_multiset_fingerprints": op10_multiset_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op6_source_mixing": mixing.ORACLE,
            "op4_product_quantisation": vector_dedup.ORACLE}
