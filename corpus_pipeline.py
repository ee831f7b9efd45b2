"""From raw documents to a training mix: each stage takes what the one before kept, as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexframe.llm import decontamination, jaccard_join, line_templates, mixing, outliers
from lexframe.llm.common import shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return outliers.keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for those of the first document that has them, so that a group of copies
    is not emptied before the next stage keeps one; n_chars is that of what is left."""
    return line_templates.dropped(docs, keep_first=True)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix: block, slot, place."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: SQL cannot express the robust estimates of the first stage; tests compare each stage with plain Python.
ORACLE_SQL = None
