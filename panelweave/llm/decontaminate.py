"""Benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised to words: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters.  Every
``width`` consecutive words of a benchmark item are a pattern (a shorter item is one pattern, an item without words
none).  One automaton over the words of all patterns reads each document once; the words of a found pattern are hit, and
hits are mapped to character spans of the original text.

The items are sent to every worker, which is fine as long as they are few: their size is summed first, and beyond
``ITEM_BYTES`` they are dealt by hash into groups of that size, each with its own automaton and its own pass.

Defined cases: null and empty texts have no words and no hits; null items have none either; an item
without an id hits words, too, and is a null among the items named; equal items are all named;
overlapping hits count each word once; repeated rows get equal results; input columns named as an output column are
replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F


#: Bound of the normalised item texts behind one automaton, a tenth of a gigabyte in each worker at most.
ITEM_BYTES = 500_000
WIDTH = 10

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_NORMAL = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SCAN = "n_words long, n_hit long, items array<string>, hits array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"
_ready: dict[str, tuple] = {}


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _automaton(key: str, items: Broadcast, width: int) -> tuple:
    """(automaton, word numbers), built once in each worker."""
    import ahocorasick

    if key not in _ready:
        numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items.value:
            ids = [numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text)]
            for at in range(max(len(ids) - width + 1, 1) if ids else 0):
                owners.setdefault(tuple(ids[at:at + width]), set()).add(item)
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, names in owners.items():
            machine.add_word(pattern, (len(pattern), tuple(names)))
        machine.make_automaton()
        if len(_ready) >= 4:
            _ready.clear()
        _ready[key] = machine if owners else None, numbers
    return _ready[key]


def _spans(text: bytes, hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Character spans of word ranges."""
    found, at, chars, places = [], 0, 0, list(_WORD.finditer(text))
    for first, last in hits:
        ends = []
        for byte in (places[first].start(), places[last].end()):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(chars)
        found.append({"start": ends[0], "end": ends[1]})
    return found


def _scan_text(text: bytes | None, machine, numbers: dict[bytes, int]) -> tuple:
    found = normal_words(text) if text else []
    if not found or machine is None:
        return len(found), 0, [], [], []
    names: set[str | None] = set()
    hits: list[tuple[int, int]] = []
    for end, (length, owners) in machine.iter(tuple(map(numbers.get, found, repeat(0)))):
        first = end - length + 1
        names.update(owners)
        while hits and hits[-1][1] >= first - 1:  # a longer match that ends later may begin earlier
            first = min(first, hits.pop()[0])
        hits.append((first, end))
    if not hits:
        return len(found), 0, [], [], []
    ranges = [{"first": a, "last": b} for a, b in hits]
    return len(found), sum(b - a + 1 for a, b in hits), sorted(names, key=lambda n: (n is None, n)), ranges, _spans(text, hits)


def _scanner(items: Broadcast, width: int):
    key = uuid.uuid4().hex

    @F.pandas_udf(_SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, numbers = _automaton(key, items, width)
        for texts in batches:
            yield pd.DataFrame([_scan_text(t, machine, numbers) for t in texts],
                               columns=["n_words", "n_hit", "items", "hits", "spans"])

    return scan


def item_groups(items: DataFrame, item_bytes: int = ITEM_BYTES) -> list[Broadcast]:
    """The items (item_id, text) as broadcasts of a bounded size; one of none for an empty table."""
    spark = items.sparkSession
    own = items.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // item_bytes))
    part = F.pmod(F.xxhash64("item"), F.lit(groups))
    return [spark.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in own.filter(part == g).collect()]) for g in range(groups)]


def _merged(hits: Column) -> Column:
    """Number of words in ranges that may overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last"))
    return F.aggregate(F.array_sort(hits), start, lambda a, h: F.struct(
        (a["n"] + F.greatest(F.lit(0), h["last"] - F.greatest(h["first"] - 1, a["last"]))).alias("n"),
        F.greatest(a["last"], h["last"]).alias("last")))["n"]


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings), spans (character ranges hit) and contaminated."""
    out = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    text = F.col("text").cast("binary")
    kept, groups = out.columns, item_groups(items, item_bytes)
    for i, group in enumerate(groups):
        out = out.withColumn(f"_pw_{i}", _scanner(group, width)(text))
    if len(groups) == 1:
        n_hit, names, spans = F.col("_pw_0.n_hit"), F.col("_pw_0.items"), F.col("_pw_0.spans")
    else:
        parts = [F.col(f"_pw_{i}") for i in range(len(groups))]
        n_hit = _merged(F.concat(*[p["hits"] for p in parts])).cast("long")
        names = F.array_sort(F.array_distinct(F.concat(*[p["items"] for p in parts])))
        spans = F.array_sort(F.concat(*[p["spans"] for p in parts]))
    return out.select(*kept, F.col("_pw_0.n_words").alias("n_words"), n_hit.alias("n_hit"), names.alias("items"), spans.alias("spans"),
                      (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit."""
    out, text = docs, F.col("text").cast("binary")
    for group in item_groups(items, item_bytes):
        out = out.filter(_scanner(group, width)(text)["n_hit"] == 0)
    return out
