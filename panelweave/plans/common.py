"""Small views and helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from .ctes import define


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


define("classes", "", """
SELECT p_brand AS symbol, arg_max(p_type, row(n, p_type)) AS industry
FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1""")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """Industry of a symbol: its most frequent part type."""
    counts = read_table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("p_brand").alias("symbol")).agg(
        F.max_by("p_type", F.struct("n", "p_type")).alias("industry"))
