"""Registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedlake.llm import bpe, decontaminate, divergence, licenses, maxent, merkle, order_minhash, quality_model, quality_rules, secrets, simhash, suffix_dedup, toxicity
from feedlake.llm.common import table
from feedlake.llm.registry import query


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rules = quality_rules.rule_table(table(spark, folder, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op2_suffix_dedup", suffix_dedup.ORACLE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op3_maxent_scores")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score_table(table(spark, folder, "documents"))


@query("op4_quality_model")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_secret_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_table(table(spark, folder, "documents"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.token_digests(table(spark, folder, "documents"), tokenizer)


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


@query("op8_decontaminate")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlap_table(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_license_scan", licenses.ORACLE_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.file_licenses(licenses.document_paths(table(spark, folder, "documents")))


@query("op11_order_minhash")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.edited_table(table(spark, folder, "documents"))


@query("op12_source_divergence", divergence.ORACLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence_table(table(spark, folder, "documents"))


@query("op13_merkle_manifest", merkle.ORACLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_report(table(spark, folder, "documents"))
