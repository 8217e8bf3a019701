"""Query of the quotation links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import chat_threads
from .catalog import query


@query("op6_chat_threads")
def op6_chat_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Every message without its quotes, with the message it replies to and its place among the replies."""
    out = chat_threads.link(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "role", "own_text", "n_quotes", "n_linked", "reply_to",
                      F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "depth")
