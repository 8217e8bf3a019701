"""Factor evaluation: forward returns, information coefficients, quantiles, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .options import normal_cdf
from .windows import lead_n, series
from .xsection import pct_rank


def month_ends(calendar: DataFrame) -> DataFrame:
    """The last session of each month that has a later session, with its number."""
    w = Window.orderBy("idx")  # one row per session
    later = F.lead("trade_date").over(w)
    return (calendar.withColumn("_next", later)
            .filter(F.month("_next") != F.month("trade_date")).drop("_next")
            .withColumn("row", F.row_number().over(w)))


def forward_returns(panel: DataFrame, schedule: DataFrame, horizons: tuple[int, ...], locked: Column | None = None,
                    key: str = "symbol") -> DataFrame:
    """Per rebalance row and name: enter at the next open, leave at the open after the h-th next row.

    A name without a bar at the exit leaves at its last price; a name without a
    bar, or locked, at the entry is not investable.
    """
    open_ = F.when(F.col("has_bar"), F.col("open") * F.col("hfq"))
    rows = panel.withColumns({"_open": open_, "_exit": F.coalesce(open_, F.col("adj_last")),
                              "_locked": F.coalesce(locked, F.lit(False)) if locked is not None else F.lit(False)})
    rows = rows.withColumns({"_open": lead_n("_open", 1), "_exit": lead_n("_exit", 1), "_locked": lead_n("_locked", 1),
                             "_exit_idx": lead_n("idx", 1)})
    rows = rows.join(schedule.select("idx", "row"), "idx")
    investable = F.col("_open").isNotNull() & ~F.col("_locked")
    w = series(key, "row")
    out = {f"fwd_{h}": F.when(investable, F.lead("_exit", h).over(w) / F.col("_open") - 1) for h in horizons}
    return rows.withColumns({"investable": investable, **out, "known_at": F.lead("_exit_idx", horizons[0]).over(w)}
                            ).select(key, "idx", "row", "investable", *out, "known_at")


def safe_corr(x: str, y: str, least: int) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    found = F.corr(px, py)
    # Rounding noise around an exact zero would otherwise decide its sign.
    clean = F.when(F.abs(found) < 1e-12, 0.0).otherwise(found)
    return F.when((F.count(px) >= least) & (F.var_pop(px) > 0) & (F.var_pop(py) > 0), clean)


def information_coefficients(values: DataFrame, horizon: int, min_names: int = 30) -> DataFrame:
    """IC and rank IC per (factor, row); ``values``: factor, idx, symbol, z, fwd_<h>, investable."""
    fwd = f"fwd_{horizon}"
    by = ["factor", "idx"]
    both = F.col("investable") & F.col(fwd).isNotNull()
    rows = values.withColumns({"_z": F.when(both, F.col("z")), "_f": F.when(both, F.col(fwd))})
    rows = rows.withColumns({"_zr": pct_rank("_z", by), "_fr": pct_rank("_f", by)})
    return rows.groupBy(*by).agg(F.count("_z").alias("n"), F.count_if("investable").alias("investable"),
                                 safe_corr("_z", "_f", max(min_names, 3)).alias("ic"),
                                 safe_corr("_zr", "_fr", max(min_names, 3)).alias("rank_ic"))


def quantile_buckets(values: DataFrame, horizon: int, q: int, min_names: int, key: str = "symbol") -> DataFrame:
    """Bucket of each evaluated name, ascending in z with ties by key; short buckets come last."""
    fwd = f"fwd_{horizon}"
    rows = values.filter(F.col("investable") & F.col("z").isNotNull() & F.col(fwd).isNotNull())
    w = Window.partitionBy("factor", "idx")
    rows = rows.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= max(min_names, 2 * q))
    return rows.withColumn("bucket", F.ntile(q).over(w.orderBy("z", key))).select(
        "factor", "idx", key, "bucket", F.col(fwd).alias("fwd"))


def quantile_returns(buckets: DataFrame, q: int) -> DataFrame:
    means = [F.avg(F.when(F.col("bucket") == i, F.col("fwd"))).alias(f"q{i}") for i in range(1, q + 1)]
    table = buckets.groupBy("factor", "idx").agg(*means, F.avg("fwd").alias("universe_mean"))
    return table.withColumns({"top_minus_bottom": F.col(f"q{q}") - F.col("q1"),
                              "top_minus_universe": F.col(f"q{q}") - F.col("universe_mean")})


def top_turnover(buckets: DataFrame, q: int, key: str = "symbol") -> DataFrame:
    """Share of the top bucket that was not in it at the factor's previous row."""
    top = buckets.filter(F.col("bucket") == q).select("factor", "idx", key)
    rows = buckets.select("factor", "idx").distinct()
    w = Window.partitionBy("factor").orderBy("idx")  # one row per rebalance date
    chain = rows.withColumn("before", F.lag("idx").over(w))
    now = top.join(chain, ["factor", "idx"])
    kept = now.join(top.withColumnRenamed("idx", "before").withColumn("_kept", F.lit(1)),
                    ["factor", "before", key], "left")
    return kept.groupBy("factor", "idx").agg(
        F.when(F.first("before").isNotNull(), 1 - F.count("_kept") / F.count("*")).alias("top_turnover"))


def t_stat(x: str) -> Column:
    return F.when((F.count(x) > 1) & (F.stddev_samp(x) > 0), F.avg(x) / F.stddev_samp(x) * F.sqrt(F.count(x)))


def summary(ic: DataFrame, quantiles: DataFrame, turnover: DataFrame, periods_per_year: float) -> DataFrame:
    stats = ic.groupBy("factor").agg(
        F.count("ic").alias("periods"), F.avg("ic").alias("ic_mean"),
        F.when(F.stddev_samp("ic") > 0, F.avg("ic") / F.stddev_samp("ic")).alias("ic_ir"),
        F.avg("rank_ic").alias("rank_ic_mean"), t_stat("rank_ic").alias("rank_ic_t"),
        F.avg((F.col("rank_ic") > 0).cast("int")).alias("rank_ic_hit"),
        F.avg(F.col("n") / F.nullif(F.col("investable"), F.lit(0))).alias("coverage"))
    spreads = quantiles.groupBy("factor").agg(
        (F.avg("top_minus_universe") * periods_per_year).alias("top_minus_universe_ann"),
        t_stat("top_minus_universe").alias("top_minus_universe_t"),
        (F.avg("top_minus_bottom") * periods_per_year).alias("top_minus_bottom_ann"))
    moves = turnover.groupBy("factor").agg(F.avg("top_turnover").alias("top_turnover"))
    return stats.join(spreads, "factor", "left").join(moves, "factor", "left")


def normal_p(t: str) -> Column:
    """Two-sided p-value of a normal statistic."""
    return F.when(F.col(t).isNotNull(), 2 * normal_cdf(-F.abs(F.col(t))))


def benjamini_hochberg(df: DataFrame, p: str, out: str) -> DataFrame:
    """False-discovery-rate q over all rows (one row per factor)."""
    up = Window.orderBy(F.asc_nulls_last(p), "factor")
    ranked = df.withColumns({"_rank": F.row_number().over(up), "_m": F.count(p).over(Window.partitionBy())})
    back = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(back), F.lit(1.0))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("_rank", "_m")


def factor_correlation(values: DataFrame, min_names: int = 30, key: str = "symbol") -> DataFrame:
    """Mean cross-sectional rank correlation of every pair of factors.

    Factors of one (row, name) are gathered once into an array; pairs are taken
    inside it, so the join grows with the number of factors, not of names.
    """
    ranked = values.withColumn("r", pct_rank("z", ["factor", "idx"]))
    sets = ranked.groupBy("idx", key).agg(F.array_sort(F.collect_list(F.struct("factor", "r"))).alias("v"))
    left = sets.select("idx", F.posexplode("v").alias("i", "a"), "v")
    pairs = left.select("idx", F.col("a.factor").alias("f1"), F.col("a.r").alias("x"),
                        F.explode(F.slice("v", F.col("i") + 1, F.size("v"))).alias("b"))
    rows = pairs.select("idx", "f1", F.col("b.factor").alias("f2"), "x", F.col("b.r").alias("y"))
    per_row = rows.groupBy("idx", "f1", "f2").agg(safe_corr("x", "y", min_names).alias("c"))
    return per_row.groupBy("f1", "f2").agg(F.avg("c").alias("correlation"), F.count("c").alias("rows"))


def correlated_pairs(correlation: DataFrame, least: float = 0.6) -> DataFrame:
    return correlation.filter((F.col("f1") != F.col("f2")) & (F.abs("correlation") >= least))


def sweep_summary(runs: DataFrame, value: str = "sharpe") -> DataFrame:
    """Best, median and spread over the variants, and the best expected from chance alone."""
    agg = runs.agg(F.count(value).alias("runs"), F.max(value).alias("best"),
                   F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("spread"))
    return agg.withColumn("expected_max", F.col("spread") * F.sqrt(2 * F.log("runs")))
