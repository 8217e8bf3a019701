"""Query of the importance resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import read_table
from . import resampling
from .catalog import query


@query("op13_resampling")
def op13_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, score and place of every document in a draw towards the benchmark."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    scored = resampling.score(docs, read_table(spark, sf, "benchmark").select("text"))
    return resampling.draw(scored.drop("text")).select("doc_id", "n_features", "weight", "score", "rank")
