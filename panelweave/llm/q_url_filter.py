"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import url_filter
from .catalog import query

#: Fixed rules of the contract.
RULES = [url_filter.parse_rule(verdict, text) for verdict, text in (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))]


def labelled_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs whose path ends in the number of a labelled document, bad when that document is of low quality."""
    number = F.regexp_extract("url", "://[^?#]*?/([0-9]{1,18})(?:[/.?#]|$)", 1)
    pages = read_table(spark, sf, "pages").select("url", number.try_cast("long").alias("doc_id"))
    labels = read_table(spark, sf, "labels").filter("quality IN (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return pages.filter("doc_id IS NOT NULL").join(labels, "doc_id").select("url", "bad")


@query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Host, path, rule and verdict for the URL of every page."""
    model = url_filter.fit(labelled_urls(spark, sf))
    out = url_filter.judge(read_table(spark, sf, "pages").select("page_id", "url"), RULES, model)
    return out.select("page_id", "host", "path", "rule", "verdict", "bad_probability")
