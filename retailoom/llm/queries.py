"""Registered queries of the text operators, each over its whole table, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from retailoom.llm import (
    alignment, decontaminate, html_text, langid, line_templates, lm, mixing, quality, simhash, spelling, substrings, token_counts, tokens,
)
from retailoom.llm.common import read


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.query(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.query(read(spark, folder, "documents"))


def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.query(read(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.query(read(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.query(read(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.query(read(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.query(read(spark, folder, "documents"))


def op8_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.query(read(spark, folder, "documents"))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.query(read(spark, folder, "pages"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_templates.query(read(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.query(read(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.query(read(spark, folder, "documents"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.query(read(spark, folder, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_benchmark_decontamination, op2_substring_dedup, op3_token_output, op4_lm_scoring, op5_quality_rules,
        op6_language_id, op7_simhash, op8_source_mixing, op9_html_extraction, op10_line_dedup, op11_spelling_variants,
        op12_token_alignment, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express: not hashes, coded blocks, learned models or pages."""
    return {
        "op1_benchmark_decontamination": decontaminate.ORACLE,
        "op2_substring_dedup": substrings.ORACLE,
        "op4_lm_scoring": lm.ORACLE,
        "op5_quality_rules": quality.ORACLE,
        "op10_line_dedup": line_templates.ORACLE,
    }
