"""Exact running order statistics: rank and quantiles of a series in its own past.

No row ever holds its history.  A key's values are numbered by size, and the numbers are read as ``LEVELS`` digits of base
``BASE``, the highest first: a range of values, a range inside it, and so on.  At each level one window by (key, leading
digits) counts, along time, how many values have had each next digit.  A rank adds up the counts below its own digits; a
quantile walks down, at each level into the digit that holds the place it looks for.  Rows pass ``LEVELS`` shuffles whatever
the length of the series, and a window task holds ``BASE`` counters.

Keys of more than ``BASE ** LEVELS`` values raise an error; pass more ``levels`` for them.  Where a key is too long for one
task, ``block`` (a column that grows with time) cuts it: rows meet inside (key, digits, block), and the counts a block starts
from come from one pre-aggregated row for each earlier block; every level is then written to the shared folder once.

Nulls count nowhere and have no rank; the order must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.io import written

BASE, LEVELS = 32, 3


def _codes(rows: DataFrame, key: str, x: str, levels: int, wide: bool) -> DataFrame:
    """``rows`` (without nulls of x) with ``_code``, the number of smaller values of the key, equal for equal values."""
    if wide:  # numbered by (key, value) in range partitions, equal values at their first place
        sizes = rows.groupBy(key, x).agg(F.count("*").alias("_n"))
        ranged = sizes.repartitionByRange(key, x).withColumn("_range", F.spark_partition_id())
        totals = ranged.groupBy(key, "_range").agg(F.sum("_n").alias("_t"))
        before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(key, "_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
        inside = Window.partitionBy(key, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        placed = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [key, "_range"])
        coded = rows.join(placed.select(key, x, (F.col("_before") + F.col("_in")).alias("_code")), [key, x])
    else:
        coded = rows.withColumn("_code", (F.rank().over(Window.partitionBy(key).orderBy(x)) - 1).cast("long"))
    most = F.lit(BASE ** levels)
    too_many = F.raise_error(F.lit(f"a key has more than {BASE}**{levels} values: pass more levels"))
    return coded.withColumn("_code", F.when(F.col("_code") < most, F.col("_code")).otherwise(too_many.cast("long")))


def _counted(rows: DataFrame, by: list[str], order: list[str], block: str | None) -> DataFrame:
    """``rows`` with ``_upto``: for each digit d but the last, how many values so far have had a digit of d or less."""
    at_most = [F.when(F.col("_digit") <= d, 1) for d in range(BASE - 1)]
    keys = [*by, block] if block else by
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if block:  # read twice below
        rows = written(rows)
    out = rows.withColumns({f"_c{d}": F.count(hit).over(so_far) for d, hit in enumerate(at_most)})
    names = [f"_c{d}" for d in range(BASE - 1)]
    if block:
        closing = rows.groupBy(*keys).agg(*[F.count(hit).alias(f"_c{d}") for d, hit in enumerate(at_most)])
        earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        opening = closing.select(*keys, F.array(*[F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names]).alias("_open"))
        return out.join(opening, keys).withColumn("_upto", F.zip_with(F.array(*names), "_open", lambda a, b: a + b)).drop(*names, "_open")
    return out.withColumn("_upto", F.array(*names)).drop(*names)


def _digit(level: int, levels: int) -> Column:
    return F.expr(f"_code div {BASE ** (levels - 1 - level)} % {BASE}").cast("int")


def expanding_rank(rows: DataFrame, key: str, order: str, x: str, out: str, least: int = 1, levels: int = LEVELS,
                   block: str | None = None) -> DataFrame:
    """``rows`` with the percentile of the current value in its history so far, itself included, ties at their average rank.

    Null where x is, and before ``least`` values are there.
    """
    own = [block] if block else []
    coded = _codes(rows.filter(F.col(x).isNotNull()).select(key, order, x, *own), key, x, levels, bool(block))
    coded = coded.withColumn("_below", F.lit(0).cast("long"))
    for level in range(levels):
        coded = coded.withColumns({"_prefix": F.expr(f"_code div {BASE ** (levels - level)}"), "_digit": _digit(level, levels)})
        coded = _counted(coded, [key, "_prefix"], [order], block)
        coded = coded.withColumn("_below", F.col("_below") + F.when(F.col("_digit") > 0, F.col("_upto")[F.col("_digit") - 1]).otherwise(0)).drop("_upto")
        if level == 0:  # all values so far, and those equal to the current one
            coded = _so_far(_so_far(coded, [key], order, "_n", block), [key, "_code"], order, "_equal", block)
    rank = F.when(F.col("_n") >= least, (F.col("_below") + (F.col("_equal") + 1) / 2) / F.col("_n"))
    return rows.join(coded.select(key, order, rank.alias(out)), [key, order], "left")


def _so_far(rows: DataFrame, by: list[str], order: str, out: str, block: str | None) -> DataFrame:
    """Number of rows so far, the current one included."""
    keys = [*by, block] if block else by
    counted = rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    if not block:
        return counted
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    opening = rows.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_open"))
    return counted.join(opening, keys).withColumn(out, F.col(out) + F.col("_open")).drop("_open")


def expanding_quantiles(rows: DataFrame, key: str, order: str, x: str, quantiles: dict[str, float], least: int = 1,
                        levels: int = LEVELS, block: str | None = None) -> DataFrame:
    """``rows`` with the quantiles (name: probability) of x over the rows strictly before, interpolated between neighbours.

    Null before ``least`` values are there.
    """
    own = [block] if block else []
    slim = rows.select(key, order, x, *own)
    points = _codes(slim.filter(F.col(x).isNotNull()), key, x, levels, bool(block))
    values = points.groupBy(key, "_code").agg(F.first(x).alias("_value"))
    before = Window.partitionBy(key, *own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = slim.withColumn("_n", F.count(x).over(before))
    if block:
        earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        opening = slim.groupBy(key, block).agg(F.count(x).alias("_t")).select(key, block, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_open"))
        known = known.join(opening, [key, block]).withColumn("_n", F.col("_n") + F.col("_open")).drop("_open")
    asked = known.filter(F.col("_n") >= max(least, 1))
    places = F.array(*[F.struct(F.lit(i).alias("_which"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at")) for i, p in enumerate(quantiles.values())])
    asked = asked.select(key, order, *own, F.inline(places))
    ends = F.array(F.struct(F.lit(0).alias("_end"), F.floor("_at").alias("_k")), F.struct(F.lit(1).alias("_end"), F.ceil("_at").alias("_k")))
    asked = asked.select("*", F.inline(ends)).filter("_end = 0 OR _k > floor(_at)").withColumn("_prefix", F.lit(0).cast("long"))
    for level in range(levels):
        marks = points.select(key, order, *own, F.expr(f"_code div {BASE ** (levels - level)}").alias("_prefix"), _digit(level, levels).alias("_digit"),
                              F.lit(1).alias("_kind"))
        probes = asked.withColumns({"_kind": F.lit(0), "_digit": F.lit(None).cast("int")})
        met = _counted(marks.unionByName(probes, allowMissingColumns=True), [key, "_prefix"], [order, "_kind"], block).filter("_kind = 0")
        passed = F.filter("_upto", lambda c: c <= F.col("_k"))  # counts grow with the digit
        met = met.withColumn("_passed", F.size(passed)).withColumn("_under", F.when(F.col("_passed") > 0, F.col("_upto")[F.col("_passed") - 1]).otherwise(0))
        asked = met.select(key, order, *own, "_which", "_at", "_end", (F.col("_k") - F.col("_under")).alias("_k"),
                           (F.col("_prefix") * BASE + F.col("_passed")).alias("_prefix"))
    found = asked.join(values.withColumnRenamed("_code", "_prefix"), [key, "_prefix"]).select(key, order, "_which", "_at", "_end", "_value")
    low, high = F.max(F.when(F.col("_end") == 0, F.col("_value"))), F.max(F.when(F.col("_end") == 1, F.col("_value")))
    share = F.max(F.col("_at") - F.floor("_at"))
    one = found.groupBy(key, order, "_which").agg((low + F.coalesce(high - low, F.lit(0.0)) * share).alias("_q"))
    wide = one.groupBy(key, order).agg(*[F.max(F.when(F.col("_which") == i, F.col("_q"))).alias(name) for i, name in enumerate(quantiles)])
    return rows.join(wide, [key, order], "left")
