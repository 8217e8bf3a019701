"""Importance resampling towards a target distribution over hashed word n-grams.

A text is normalised to words (A-Z lower-cased; runs of ASCII letters, digits and non-ASCII characters) joined by one space.
Its features are all runs of 1 to ``longest`` consecutive words, and a feature's bucket is its CRC-32 modulo ``buckets``.

The normalised text is scanned once, and the running CRC is stored where each word begins and ends.  The CRC of any n-gram
follows from the two prefixes that end at its borders: the CRC of the earlier prefix, shifted by the n-gram's length in
zero bytes, cancels from the later one.  The shift is linear over GF(2); it is four table look-ups for lengths below 256, and
the binary digits of the rest go through the shifts by 256, 512, ... bytes.  No n-gram is ever built as a string.

Counts of buckets are summed in each task before they are shuffled (``buckets`` rows a task at most).  A bucket's gain is the
scaled log ratio of its share in the target to its share in the documents; a document's weight is the sum of the gains of its
features.  With a Gumbel noise drawn from the id's SHA-256 the highest scores are a sample without replacement by weight.
The places of the highest scores come from range partitions, sorted and written once, and one row of counts for each.

Defined cases: null and empty texts have no features and weight 0; a null id has no noise, hence no score and no place;
ties of score go to the smaller id; repeated rows keep a place each; without any target or documents all counts are 0 and
gains follow the same formula; an empty table gives an empty result; texts of any length are taken whole (memory grows
with one text); input columns named as an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import small_join, stage

LONGEST, BUCKETS, SCALE, SEED = 3, 10_000, 1000, 42
#: Words of the texts that are worked on at a time, and bytes of a shift that one table covers.
WORDS, DIRECT = 200_000, 256

_NORMAL = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map given by its values on the four bytes of a register."""
    return (tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255]
            ^ tables[2][(crc >> np.uint32(16)) & 255] ^ tables[3][crc >> np.uint32(24)])


class Shift:
    """The map of a CRC to that of the same text followed by zero bytes, without the bytes' own part."""

    def __init__(self) -> None:
        one = _crc_table()
        table = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        steps = []
        for _ in range(DIRECT):
            steps.append(table)
            table = one[table & 255] ^ (table >> np.uint32(8))
        self.short = np.array(steps)
        self.powers = [table]  # by 256 bytes, 512, 1024, ...

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        low, rest = length % DIRECT, length // DIRECT
        out = (self.short[low, 0, crc & 255] ^ self.short[low, 1, (crc >> np.uint32(8)) & 255]
               ^ self.short[low, 2, (crc >> np.uint32(16)) & 255] ^ self.short[low, 3, crc >> np.uint32(24)])
        power = 0
        while rest.any():
            if power == len(self.powers):
                self.powers.append(np.array([_apply(self.powers[-1], t) for t in self.powers[-1]]))
            odd = np.flatnonzero(rest & 1)
            out[odd] = _apply(self.powers[power], out[odd])
            rest, power = rest >> 1, power + 1
        return out


_shift: list[Shift] = []


def shift() -> Shift:
    if not _shift:
        _shift.append(Shift())
    return _shift[0]


class Prefixes:
    """Running CRCs and byte offsets at the borders of the words of several texts, one after the other."""

    def __init__(self, texts: Iterable[bytes | None]) -> None:
        starts: list[int] = []
        ends: list[int] = []
        sizes: list[int] = []
        counts: list[int] = []
        for text in texts:
            words = text.translate(_NORMAL).split() if text else []
            counts.append(len(words))
            if not words:
                continue
            done = list(accumulate(words[1:], lambda c, w: crc32(w, crc32(b" ", c)), initial=crc32(words[0])))
            ends += done
            starts.append(0)
            starts += [crc32(b" ", c) for c in done[:-1]]
            sizes += map(len, words)
        self.counts = np.array(counts, dtype=np.int64)
        self.start, self.end = np.array(starts, dtype=np.uint32), np.array(ends, dtype=np.uint32)
        self.end_at = np.cumsum(np.array(sizes, dtype=np.int64) + 1) - 1
        self.start_at = self.end_at - np.array(sizes, dtype=np.int64)
        self.last = np.repeat(np.cumsum(self.counts), self.counts)  # one past the last word of a word's text

    def buckets(self, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, buckets) of the n-grams, some at a time."""
        for low in range(0, len(self.start), WORDS):
            first = np.arange(low, min(low + WORDS, len(self.start)))
            first = first[first + n <= self.last[first]]
            final = first + n - 1
            crc = self.end[final] ^ shift()(self.start[first], self.end_at[final] - self.start_at[first])
            yield first, (crc % np.uint32(buckets)).astype(np.int64)


def _batches(texts: Iterable[bytes | None], most: int = WORDS * 8) -> Iterator[list[bytes | None]]:
    """Texts in groups of some bytes (one text at least)."""
    group: list[bytes | None] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text or b"")
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def bucket_counts(docs: DataFrame, text: str | Column = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of a table; buckets without any are left out."""
    column = F.col(text) if isinstance(text, str) else text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for texts in _batches(t.as_py() for t in batch.column(0)):
                found = Prefixes(texts)
                for n in range(1, longest + 1):
                    for _, places in found.buckets(n, buckets):
                        total += np.bincount(places, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(column.cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """(bucket, gain) of every bucket: the scaled log of its share in the target over that in the documents, smoothed by one."""
    spark = raw.sparkSession
    both = (spark.range(buckets).withColumnRenamed("id", "bucket")
            .join(raw.withColumnRenamed("n", "_pw_s"), "bucket", "left").join(target.withColumnRenamed("n", "_pw_t"), "bucket", "left")
            .select("bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_pw_s", "_pw_t")]))
    s, t = F.col("_pw_s").cast("double"), F.col("_pw_t").cast("double")
    all_s, all_t = both.agg(F.sum(s)).scalar(), both.agg(F.sum(t)).scalar()
    ratio = ((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(scale * F.ln(ratio)).cast("long").alias("gain"))


def _weights(spark: SparkSession, gains: DataFrame, longest: int, buckets: int):
    """A column function: words, features and weight of a text.  The gains are one number a bucket."""
    rows = gains.collect()
    by_bucket = np.zeros(buckets, dtype=np.int64)
    by_bucket[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    sent = spark.sparkContext.broadcast(by_bucket)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for texts in _batches(batch):
                found = Prefixes(texts)
                of_word = np.zeros(len(found.start) + 1, dtype=np.int64)
                for n in range(1, longest + 1):
                    for first, places in found.buckets(n, buckets):
                        of_word[first] += sent.value[places]
                so_far = np.concatenate([[0], np.cumsum(of_word)])
                last = np.cumsum(found.counts)
                features = sum(np.maximum(found.counts - n + 1, 0) for n in range(1, longest + 1))
                parts.append(pd.DataFrame({"n_words": found.counts, "n_features": features, "weight": so_far[last] - so_far[last - found.counts]}))
            yield pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("n_words", "n_features", "weight")})

    return weigh


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST,
          buckets: int = BUCKETS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score; the texts of ``target`` say what is wanted."""
    names = ["n_words", "n_features", "weight"]
    raw, wanted = (stage(bucket_counts(t, text, longest, buckets)) for t in (docs, target))  # a row a bucket, read more than once
    weigh = _weights(docs.sparkSession, bucket_gains(raw, wanted, buckets, scale), longest, buckets)
    found = docs.withColumn("_pw_found", weigh(F.col(text).cast("binary")))
    return found.select(*[F.col(c) for c in docs.columns if c not in [*names, "score"]], *[F.col(f"_pw_found.{c}") for c in names],
                        (F.col("_pw_found.weight") + noise(F.col(doc_id), seed, scale)).alias("score"))


def draw(scored: DataFrame, doc_id: str = "doc_id", percent: int = 5, min_words: int = 20) -> DataFrame:
    """``scored`` with rank: 1, 2, 3... for the highest scores among rows of ``min_words``, ``percent`` of them, null for others.

    Every column goes through one shuffle by score: give it ids and numbers, and join texts to the rows drawn.
    """
    rows = stage(scored.drop("rank")).withColumn("_pw_in", F.col("n_words") >= min_words)  # range partitioning reads it twice
    rows = rows.withColumn("_pw_spread", F.when(~F.col("_pw_in") | F.col("score").isNull(), F.monotonically_increasing_id()))  # order of no use
    order = [F.desc("_pw_in"), F.desc_nulls_last("score"), F.asc(doc_id), F.asc("n_features"), F.asc("_pw_spread")]
    ranged = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pw_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_pw_at", 33), F.col("_pw_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_pw_part")).agg(F.count(F.when(F.col("_pw_in"), 1)).alias("_pw_n"))  # one row a range
    earlier = Window.orderBy("_pw_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = stage(counts.select("_pw_part", F.coalesce(F.sum("_pw_n").over(earlier), F.lit(0)).alias("_pw_before"),
                                  F.sum("_pw_n").over(whole).alias("_pw_all")))
    place = F.col("_pw_before") + inside + 1
    drawn = F.col("_pw_in") & F.col("score").isNotNull() & (place <= F.floor(F.col("_pw_all") * percent / 100))
    out = small_join(ranged.withColumn("_pw_part", part), offsets, ["_pw_part"])
    return out.select(*[F.col(c) for c in scored.columns if c != "rank"], F.when(drawn, place).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 5, min_words: int = 20,
             seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` drawn towards ``target``, with their rank."""
    ranked = draw(score(docs.select(doc_id, text), target, doc_id, text, seed=seed).select(
        doc_id, "n_words", "n_features", "score"), doc_id, percent, min_words)
    ids = ranked.filter("rank is not null").groupBy(doc_id).agg(F.min("rank").alias("rank"))
    return docs.drop("rank").join(ids, doc_id)
