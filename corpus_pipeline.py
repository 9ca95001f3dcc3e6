"""The corpus pipeline: five stages from raw documents to a mixed, deduplicated, decontaminated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, exact_dedup, mixing, quality, simhash
from rasterloom.llm.shared import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labels outside its held-out fold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal normalised texts, the one with the largest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate component."""
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontaminate.drop_contaminated(docs, decontaminate.load_blocks(table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with its block's place in the source schedule."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_representatives),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
]
# learned scores and Python template matching have no SQL form; tests/llm/test_pipeline.py holds run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
