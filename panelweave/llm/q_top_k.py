"""Query of the exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import top_k
from .catalog import query

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("op12_top_k", SQL)
def op12_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    vectors = read_table(spark, sf, "embeddings").filter(top_k.usable(F.col("embedding"))).select(
        "vec_id", top_k.quantised(F.col("embedding")).alias("embedding"))
    return top_k.search(vectors, vectors.filter("vec_id % 100 = 0"))
