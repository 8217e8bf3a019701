"""Query of the periodic runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.io import read_table
from . import periodic_runs
from .catalog import query


def repeated(text: bytes | None, g: int | None) -> bytes | None:
    """The words, from one on replaced by those of one period."""
    words = text.split() if text else []
    if not words:
        return text
    n = len(words)
    a = int(g) % n
    p = 1 + (n - a) // (3 + int(g) % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or where the id's checksum says so its words with everything from one on in a period."""
    @F.pandas_udf("binary")
    def plant(texts: pd.Series, gs: pd.Series) -> pd.Series:
        return pd.Series([repeated(t, g) for t, g in zip(texts, gs, strict=True)], dtype=object)

    h = F.crc32(doc_id.cast("string").cast("binary"))
    here = h % 10 == 0
    return F.coalesce(plant(F.when(here, text.cast("binary")), F.when(here, F.floor(h / 10))), text.cast("binary"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every document and its text without their repetitions."""
    docs = read_table(spark, sf, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic_runs.find(docs)
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = F.col("strongest")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                      best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
