"""Query of the token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import read_table
from . import token_counts
from .catalog import query


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, default_model()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
