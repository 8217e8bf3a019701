"""Query of the decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import decontaminate
from .catalog import query
from .common import LOWER, UPPER

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH b AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
patterns AS (
  SELECT DISTINCT item_id, len(ws) AS n, array_to_string(ws, ' ') AS g FROM b WHERE len(ws) BETWEEN 1 AND 9
  UNION
  SELECT DISTINCT item_id, 10, array_to_string(ws[i : i + 9], ' ') FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM b WHERE len(ws) >= 10)),
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
grams AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (
    SELECT t.doc_id, t.i, s.n, d.ws FROM tokens t JOIN d USING (doc_id) JOIN (
      SELECT DISTINCT n, split_part(g, ' ', 1) AS w FROM patterns) s ON s.w = t.w WHERE t.i + s.n - 1 <= len(d.ws))),
found AS (SELECT g.doc_id, g.i, g.n, p.item_id FROM grams g JOIN patterns p USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS i FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words hit and items found in every document."""
    out = decontaminate.scan(read_table(spark, sf, "documents").select("doc_id", "text"), read_table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
