"""Query of the mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import mixing
from .catalog import query

#: Domains are four groups of sources; the tables have no column for them.
DOMAINS = 4
#: Targets of the mixture: whole numbers by path, 1 where none is given.
WEIGHTS: dict[tuple[str, ...], int] = {
    ("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1,
    ("d0", "en"): 4, ("d0", "de"): 2, ("d0", "fr"): 2, ("d0", "es"): 2,
    ("d1", "en"): 1, ("d1", "de"): 3, ("d1", "fr"): 3, ("d1", "es"): 3,
}
SEED, MAX_EPOCHS = 11, 4


def levels() -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    return {"domain": F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 4), 16, 10).cast("int") % DOMAINS).cast("string")),
            "lang": F.col("lang"), "source": F.col("source")}


def _weights(paths: list[str]) -> str:
    cases = [" AND ".join(f"{c} = '{v}'" for c, v in zip(paths, path, strict=True)) + f" THEN {w}"
             for path, w in WEIGHTS.items() if len(path) == len(paths)]
    return "CASE " + " ".join(f"WHEN {c}" for c in cases) + " ELSE 1 END" if cases else "1"


def _level(names: list[str], above: str) -> str:
    """Shares of the nodes of one level: the level of filling at which the siblings that are not full share the rest."""
    keys, parent = ", ".join(names), ", ".join(names[:-1]) or "1"
    link = " AND ".join(["true", *[f"n.{c} = p.{c}" for c in names[:-1]]])
    return f"""
n_{names[-1]} AS (SELECT {keys}, sum({MAX_EPOCHS} * tokens)::BIGINT AS cap, {_weights(names)} AS w FROM leaves GROUP BY {keys}),
o_{names[-1]} AS (
  SELECT n.*, p.share AS b, row_number() OVER s AS place,
         p.share - coalesce(sum(cap) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(w) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others
  FROM n_{names[-1]} n JOIN {above} p ON {link}
  WINDOW s AS (PARTITION BY {", ".join(f"n.{c}" for c in names[:-1]) or "1"} ORDER BY cap / w, n.{names[-1]})),
f_{names[-1]} AS (
  SELECT *, min(CASE WHEN cap * others > room * w THEN place END) OVER (PARTITION BY {parent}) AS stop FROM o_{names[-1]}),
s_{names[-1]} AS (
  SELECT {keys}, (CASE WHEN stop IS NULL OR place < stop THEN cap
         ELSE (max(CASE WHEN place = stop THEN room END) OVER (PARTITION BY {parent}) * w)
              // max(CASE WHEN place = stop THEN others END) OVER (PARTITION BY {parent}) END)::BIGINT AS share FROM f_{names[-1]})"""


def sql(documents: str = "documents") -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH counted AS (
  SELECT doc_id, 'd' || (('0x' || substr(md5(coalesce(source, '')), 1, 4))::INT % {DOMAINS}) AS domain, coalesce(lang, '(none)') AS lang,
         coalesce(source, '(none)') AS source, CASE WHEN trim(coalesce(text, ''), {space}) = '' THEN 0
         ELSE len(regexp_split_to_array(trim(text, {space}), '[\\x20\\x09-\\x0D]+')) END AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM counted WHERE n_tokens > 0 GROUP BY ALL),
root AS (SELECT least(sum(tokens) // 2, sum(tokens) * {MAX_EPOCHS})::BIGINT AS share FROM leaves),
{_level(["domain"], "root")},
{_level(["domain", "lang"], "s_domain")},
{_level(["domain", "lang", "source"], "s_lang")},
plan AS (SELECT domain, lang, source, share // tokens AS passes, share % tokens AS rest FROM s_source JOIN leaves USING (domain, lang, source)),
placed AS (
  SELECT c.*, p.passes, p.rest, md5(concat_ws(':', '{SEED}', p.passes::VARCHAR, coalesce(c.doc_id::VARCHAR, ''))) AS key
  FROM counted c JOIN plan p USING (domain, lang, source) WHERE n_tokens > 0),
taken AS (
  SELECT *, passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(n::BIGINT)) AS epoch FROM taken"""


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.select(docs, levels(), WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED)


@query("op8_mixing", sql())
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of a mixture of half of all tokens, one row per pass."""
    return mixture(read_table(spark, sf, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
