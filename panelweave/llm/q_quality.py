"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import read_table
from . import quality
from .catalog import query

SPACES = "[\\x20\\x09-\\x0D]"

#: Words of documents that lie in five-word windows found twice or more, as a common table.
REPEATS = """
tokens AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS ws FROM documents))
  WHERE w <> ''),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
    SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS g,
           lead(w, 4) OVER d AS last FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WHERE last IS NOT NULL),
covered AS (
  SELECT t.doc_id, t.i, count(w.i) AS hits FROM tokens t
  LEFT JOIN (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS i FROM windows WHERE n > 1) w ON w.doc_id = t.doc_id AND w.i = t.i
  GROUP BY 1, 2),
repeats AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (hits > 0) AS n_repeat_words FROM covered GROUP BY 1)"""

SQL = f"""
WITH {REPEATS},
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
  WHERE length(regexp_replace(line, '{SPACES}', '', 'g')) > 0 GROUP BY 1),
counts AS (
  SELECT d.doc_id, coalesce(r.n_words, 0) AS n_words, length(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
         coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
         length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals
  FROM documents d LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * n_symbols > 8 * word_chars OR (100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 3)
         OR (100 * n_capitals > 60 * n_letters AND 2 * n_letters > word_chars)
         OR word_chars < 2 * n_words OR word_chars > 60 * n_words AS method_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT method_failed AS kept FROM judged"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict for every document."""
    out = quality.judge(read_table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
