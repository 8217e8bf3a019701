"""From documents to a training mixture: quality rules, line deduplication, near-duplicates, decontamination, mixture.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``; the last adds domain, n_tokens and epoch.  Nulls, empty tables,
repeated rows and further columns are treated as each operator states; a document left without text by a stage stays
until a later stage decides on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import common, decontaminate, line_dedup, near_dups, q_mixing, quality
from panelweave.sources.io import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality.keep(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat elsewhere."""
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of half of the tokens left."""
    return q_mixing.mixture(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("near_dedup", near_duplicates),
    ("decontamination", decontamination), ("mixing", mixture)]

#: Near-duplicates by banding have no SQL form; the whole run is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
