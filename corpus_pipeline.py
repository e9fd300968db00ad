"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.llm import decontaminate, linededup, mixing, quality, simhash
from reachlake.llm.common import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules fail or that are probably junk go; null and empty texts are among them. Repeated rows are judged alike. Columns stay."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters that 5 or more documents hold go from all but the largest doc_id. No document goes; null texts, and rows without a doc_id, stay as they are."""
    return linededup.drop_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id (null only where there is no other). Null, empty and blank texts are copies of each other; repeated rows are one."""
    return simhash.keep_first_of_each(docs, near=simhash.near_copies)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, items without an id included; null texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document; a null source is one of its own, a null text takes 0 words. An empty table gives no rows."""
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col("source").alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_weights", mixing_to_weights),
]

#: The quality stage's expectation maximisation and the mixture's seeded choice are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
