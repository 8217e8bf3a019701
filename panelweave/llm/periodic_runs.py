"""Periodic runs of words by an online sparse diagonal dynamic programme.

A run of period q is a stretch of words in which words q apart are equal, of at least ``times`` periods and ``shortest``
words, that no neighbouring word extends.  Words are read one after the other.  A diagonal is a lag q on which the words
so far equal those q before; its matched length grows by one with each word that has an equal earlier occurrence at that
lag.  A diagonal that a word does not lengthen ends there, and emits its run at once if it is long enough.

The programme is sparse: of a word's earlier occurrences only those count that can belong to a run.  A run of period q
holds (times - 1) * q equal words on its diagonal, so lags are taken in bands [low, high) with an occurrence wanted of the
whole gram of (times - 1) * low words that ends in the word.  Two occurrences of such a gram in one band would give it a
shorter period, hence only its nearest earlier occurrence is of use, and a lag that is a multiple of a run's smallest
period never opens a diagonal.  Grams are numbered by doubling.  A text of n words costs O(n log^2 n) however
frequent its words are, and a text without repeated grams ends after the first band.

Every text is independent of the others: one pass over the table, no shuffle.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; very long texts are taken whole
(memory grows with one text); repeated rows get equal results; an empty table gives an empty result; input columns named
as an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TIMES, SHORTEST = 4, 6
_RUN = "struct<start:long,length:long,period:long>"
_FOUND = f"n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed binary"

Run = tuple[int, int, int]


def _numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def _nearest(grams: np.ndarray) -> np.ndarray:
    """Distance to the nearest earlier equal gram, 0 for none."""
    order = np.argsort(grams, kind="stable")
    lags = np.zeros(len(grams), dtype=np.int64)
    again = grams[order[1:]] == grams[order[:-1]]
    lags[order[1:][again]] = (order[1:] - order[:-1])[again]
    return lags


def occurrences(words: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(last words, lags, length) of the grams whose nearest earlier occurrence lies in the band of lags of that length."""
    n, low, doubled, span = len(words), 1, words, 1
    while n >= times * low:
        length, high = (times - 1) * low, (times - 1) * low // 2 + 1
        while span * 2 <= length:
            doubled, span = _numbered(doubled[:-span], doubled[span:]), span * 2
        rest = length - span
        grams = doubled if not rest else doubled[:-rest] * (int(doubled.max()) + 1) + doubled[rest:]
        lags = _nearest(grams)
        if not lags.any():  # longer grams repeat still less
            return
        at = np.flatnonzero((lags >= low) & (lags < high))
        yield at + length - 1, lags[at], length
        low = high


def runs(words: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> list[Run]:
    """(start, length, period) of all runs of numbered words, by start and period."""
    if times < 4:
        raise ValueError("runs of fewer than four periods need another choice of occurrences")
    found: list[Run] = []
    bands = list(occurrences(words, times))
    if not bands:
        return found
    ends = np.concatenate([b[0] for b in bands])
    order = np.argsort(ends, kind="stable")
    lags = np.concatenate([b[1] for b in bands])[order].tolist()
    seeds = np.repeat([b[2] for b in bands], [len(b[0]) for b in bands])[order].tolist()
    active: dict[int, int] = {}
    at = -1

    def end(lag: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(shortest, times * lag):
            found.append((at - length + 1, length, lag))

    for word, hits in groupby(zip(ends[order].tolist(), lags, seeds, strict=True), itemgetter(0)):
        seen = {lag: seed for _, lag, seed in hits}
        for lag in [q for q in active if word != at + 1 or q not in seen]:
            end(lag)
        at = word
        for lag, seed in seen.items():
            active[lag] = active.get(lag, seed - 1) + 1
    for lag in list(active):
        end(lag)
    return sorted(found, key=itemgetter(0, 2))


def _scan(text: bytes | None, times: int, shortest: int) -> tuple:
    words = text.split() if text else []
    numbers: dict[bytes, int] = {}
    coded = [numbers.setdefault(w, len(numbers)) for w in words]
    found = runs(np.array(coded, dtype=np.int64), times, shortest) if len(words) - len(numbers) >= times - 1 else []
    if not found:
        return len(words), [], None, b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        kept[start + period:start + length] = False
    rows = [dict(zip(("start", "length", "period"), run, strict=True)) for run in found]
    best = min(rows, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]))
    return len(words), rows, best, b" ".join([words[i] for i in np.flatnonzero(kept)])


def find(docs: DataFrame, text: str | Column = "text", times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with n_words, runs (word numbers from 0), strongest and collapsed.

    ``strongest`` is the run with the greatest exact length / period (ties: smallest start, then period; null without runs).
    ``collapsed`` is the words joined by one space without those that a run holds after its first period.
    """
    column = F.col(text) if isinstance(text, str) else text
    names = ["n_words", "runs", "strongest", "collapsed"]

    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_scan(t, times, shortest) for t in texts], columns=names)

    found = docs.withColumn("_pw_found", scan(column.cast("binary")))
    return found.select(*[F.col(c) for c in docs.columns if c not in names], *[F.col(f"_pw_found.{c}") for c in names[:-1]],
                        F.col("_pw_found.collapsed").cast("string").alias("collapsed"))
