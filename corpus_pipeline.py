"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules
from quillon.plans.shared import discard, settled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return quality_rules.quality_filter(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; so do documents of which nothing is left."""
    return line_dedup.dedup_lines(docs, runs_col=None).filter(f"text rlike '{line_dedup.HAS_WORD}'")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard_join.distinct_documents(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to equal weights, in random order."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark), ("mixing to target weights", mixture)]

#: the first stage's model and the tiling have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # one stage's output replaces its input and what was staged on the way
        done = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
