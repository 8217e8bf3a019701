"""Query of the text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import read_table
from . import html_text
from .catalog import query


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
