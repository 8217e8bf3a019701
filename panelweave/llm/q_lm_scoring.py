"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import lm_scoring
from .catalog import query


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by the model of those that are not held out."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_scoring.score(docs, ~held_out)
