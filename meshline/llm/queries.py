"""Queries and SQL of the text and source problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshline.llm import leakage, lookalike, source_kind, syntax, tokenizer
from meshline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return source_kind.not_hand_written(table(spark, d, "files"))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return source_kind.judged(table(spark, d, "files"))


def p3_families(spark: SparkSession, d: str) -> DataFrame:
    return source_kind.family_report(table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken(table(spark, d, "files"), table(spark, d, "diagnostics"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "files"), table(spark, d, "diagnostics"))


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return syntax.repairs(table(spark, d, "files"), table(spark, d, "diagnostics"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_table(table(spark, d, "documents"))


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_counts(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.exact_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.agreeing_pairs(table(spark, d, "documents"))


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_files, p3_families, p5_found, p5_rates, p5_repairs, p6_ids, p6_token_counts, p7_found, p7_paraphrases, p7_report, p8_found, p8_canonical)}
ORACLES: dict[str, str] = {}
