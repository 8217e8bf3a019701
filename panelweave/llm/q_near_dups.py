"""Query of the near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import read_table
from . import near_dups
from .catalog import query


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every document."""
    return near_dups.classes(read_table(spark, sf, "documents").select("doc_id", "text"))
