"""Windows on the session grid.

A window of ``n`` sessions at session t covers (t - n, t] of the dense grid,
whatever bars are missing; it is null during the first ``n - 1`` sessions of the
calendar and when fewer than ``min_count`` values are present.  All expressions
share one partitioning (key) and one order (session index), so any number of
them costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def session_index(days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Distinct sessions with a 1-based index (one row per day: bounded by the calendar)."""
    return days.select(day).filter(F.col(day).isNotNull()).distinct().withColumn(
        "idx", F.row_number().over(Window.orderBy(day)).cast("long"))


def dense_grid(bars: DataFrame, calendar: DataFrame, key: str, day: str) -> DataFrame:
    """Every session of each key from its first bar on, joined to its bars."""
    firsts = bars.groupBy(key).agg(F.min(day).alias(day)).join(calendar, day).select(key, F.col("idx").alias("_first"))
    last = calendar.agg(F.max("idx")).scalar()
    grid = firsts.select(key, F.explode(F.sequence(F.col("_first"), last)).alias("idx")).join(calendar, "idx")
    return grid.join(bars.withColumn("has_bar", F.lit(True)), [key, day], "left").withColumn(
        "has_bar", F.coalesce("has_bar", F.lit(False)))


def series(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, key: str = "symbol", order: str = "idx"):
    return series(key, order).rowsBetween(-(n - 1), Window.currentRow)


def so_far(key: str = "symbol", order: str = "idx"):
    return series(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(n: int | None, key: str = "symbol", order: str = "idx"):
    return series(key, order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def full(value: Column, x: Column, n: int, min_count: int, key: str = "symbol", order: str = "idx") -> Column:
    enough = F.count(x).over(last_n(n, key, order)) >= min_count
    return F.when((F.col(order) >= n) & enough, value)


def count_n(x: Column, n: int, key: str = "symbol", order: str = "idx") -> Column:
    return F.when(F.col(order) >= n, F.count(x).over(last_n(n, key, order)))


def sum_n(x: Column, n: int, min_count: int, key: str = "symbol", order: str = "idx") -> Column:
    return full(F.sum(x).over(last_n(n, key, order)), x, n, min_count, key, order)


def mean_n(x: Column, n: int, min_count: int, key: str = "symbol", order: str = "idx") -> Column:
    return full(F.avg(x).over(last_n(n, key, order)), x, n, min_count, key, order)


def std_n(x: Column, n: int, min_count: int, key: str = "symbol", order: str = "idx") -> Column:
    return full(F.stddev_samp(x).over(last_n(n, key, order)), x, n, max(min_count, 2), key, order)


def max_n(x: Column, n: int, min_count: int, key: str = "symbol", order: str = "idx") -> Column:
    return full(F.max(x).over(last_n(n, key, order)), x, n, min_count, key, order)


def pair_stats(x: Column, y: Column, n: int, min_count: int, key: str = "symbol",
               order: str = "idx") -> dict[str, Column]:
    """cov, corr, var_x and var_y over the pairs with both values (at least three)."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    w = last_n(n, key, order)
    need = max(min_count, 3)
    var_x = full(F.var_samp(px).over(w), px, n, need, key, order)
    var_y = full(F.var_samp(py).over(w), px, n, need, key, order)
    return {"cov": full(F.covar_samp(px, py).over(w), px, n, need, key, order), "var_x": var_x, "var_y": var_y,
            "corr": F.when((var_x > 0) & (var_y > 0), F.corr(px, py).over(w))}


def lag_n(x: str | Column, n: int, key: str = "symbol", order: str = "idx") -> Column:
    return F.lag(x, n).over(series(key, order))


def lead_n(x: str | Column, n: int, key: str = "symbol", order: str = "idx") -> Column:
    return F.lead(x, n).over(series(key, order))


def forward_fill(df: DataFrame, key: str, order: str, columns: dict[str, str]) -> DataFrame:
    """Last known value on or before each row, as new columns ``{new: source}``."""
    return df.withColumns({new: F.last(old, ignorenulls=True).over(so_far(key, order)) for new, old in columns.items()})


def bar_returns(panel: DataFrame) -> DataFrame:
    """Adjusted bar-to-bar return (spanning gaps) and the previous close in today's price terms."""
    previous = lag_n("adj_last", 1)
    return panel.withColumns({"ret": F.try_divide(F.col("adj_close"), previous) - 1,
                              "ref_close": F.when(F.col("has_bar"), F.try_divide(previous, F.col("hfq")))})


def islands(df: DataFrame, key: list[str], order: str, label: str, out: str = "run") -> DataFrame:
    """Number the runs of equal ``label`` along ``order`` within a key."""
    w = Window.partitionBy(*key).orderBy(order)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return df.withColumn("_changed", changed).withColumn(
        out, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def ranked(rows: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Place of each row in its group, where a few groups hold all rows.

    Rows are range-partitioned by group and order, numbered inside their range, and moved on by the number of the
    group's rows in earlier ranges: one small row per range and group.
    """
    ranged = rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id())
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    numbered = ranged.withColumn("_in", inside).join(offsets, [group, "_range"])
    return numbered.withColumn(out, F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")
