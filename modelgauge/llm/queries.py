"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelgauge.llm import decontamination, host_rules, license_rules, line_dedup, packing, pii_crf, secret_ledger, simhash_forest, substring_dedup, toxicity
from modelgauge.llm import textcore as tc


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic once deobfuscated."""
    return toxicity.toxic(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data with its place."""
    return pii_crf.personal_data(tc.documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that other documents have as well."""
    return substring_dedup.repeated_spans(tc.documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(tc.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that go, each with the one that stays for it."""
    return line_dedup.duplicate_lines(tc.documents(spark, sf_dir))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections with their place."""
    return license_rules.licenses(tc.documents(spark, sf_dir))


def op7_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.near_duplicates(tc.documents(spark, sf_dir))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its host's verdict."""
    return host_rules.judged(tc.documents(spark, sf_dir))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at every path, by a ledger that starts empty and is scanned by half the rules, then by all."""
    docs = tc.documents(spark, sf_dir)
    return secret_ledger.by_path(docs, secret_ledger.scanned_twice(docs))


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.packed(tc.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_pii_crf,
        op3_suffix_dedup,
        op4_decontamination,
        op5_line_dedup,
        op6_license_rules,
        op7_simhash_forest,
        op8_host_rules,
        op9_secret_ledger,
        op10_vector_packing,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_host_rules": host_rules.SQL, "op9_secret_ledger": secret_ledger.SQL}
