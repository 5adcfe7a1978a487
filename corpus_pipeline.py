"""The corpus pipeline: five stages, each a DataFrame over all that its predecessor kept.

Quality classifier, line dedup, near-dedup, benchmark decontamination, mixing. Every stage's result is
written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitlark.llm import decontam, line_dedup, mixing, near_dup, quality
from bitlark.llm.common import discard, scratch, work_path, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but the last that holds them."""
    return line_dedup.stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows go."""
    return decontam.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each copy sent, in its order."""
    return mixing.stage(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The classifier and the near-duplicate classes have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work tables of a stage, and its input, go when its result is written; those of the last stage stay for its lazy result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
