"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, filter_audit, jaccard_join, license_scan, line_templates, mixing, near_vectors, outliers, pii, quality_cnn, secret_scan, spelling, substring_index
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.dedup_substrings(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).drop("th")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality_classifier, op3_decontamination, op4_pii, op5_quality_rules, op6_substring_dedup, op7_mixing, op8_jaccard_join, op9_line_dedup, op10_license_scan, op11_filter_audit, op12_spelling_variants, op13_near_vectors)}
#: Where SQL can say the same; the others are tested against plain Python or held-out labels in tests/llm.
ORACLE_SQL = {
    "op3_decontamination": decontamination.SQL,
    "op6_substring_dedup": substring_index.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_line_dedup": line_templates.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_near_vectors": near_vectors.SQL,
}
