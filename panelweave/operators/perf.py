"""Value curves: benchmarks, performance, drawdown, relative and calendar returns.

Curves are long tables (series, trade_date, value); every function works on all
series at once.  A series has one row per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PERIODS = 244  # fixed value: sessions per year
NOISE = 1e-12  # weights this close are equal


def along(key: str = "series"):
    return Window.partitionBy(key).orderBy("trade_date")


def holding_periods(calendar: DataFrame, schedule: DataFrame) -> DataFrame:
    """Each session with the last rebalance session before it (``period``)."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # one row per session
    marked = calendar.join(schedule.select("idx", F.col("idx").alias("_mark")), "idx", "left")
    return marked.withColumn("period", F.last("_mark", ignorenulls=True).over(w)).drop("_mark")


def equal_weight_curve(panel: DataFrame, members: DataFrame, calendar: DataFrame, schedule: DataFrame) -> DataFrame:
    """Reset to equal weights over ``members`` (idx, symbol) at each rebalance close, drift in between.

    Prices meet their period's base on (symbol, period): one join, then one
    average per session; periods are chained by a running product.
    """
    base = members.join(panel.select("idx", "symbol", F.col("adj_last").alias("base")), ["idx", "symbol"]).select(
        F.col("idx").alias("period"), "symbol", "base")
    periods = holding_periods(calendar, schedule).filter("period is not null")
    prices = panel.select("symbol", "idx", "adj_last").join(periods, "idx")
    drift = prices.join(base, ["symbol", "period"]).groupBy("period", "idx", "trade_date").agg(
        F.avg(F.col("adj_last") / F.col("base")).alias("rel"))
    closing = drift.groupBy("period").agg(F.max_by("rel", "idx").alias("last_rel"))
    earlier = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # one row per rebalance
    chain = closing.select("period", F.coalesce(F.exp(F.sum(F.log("last_rel")).over(earlier)), F.lit(1.0)).alias("base"))
    return drift.join(chain, "period").select("idx", "trade_date", (F.col("base") * F.col("rel")).alias("value"))


def rebase(curve: DataFrame, value: str = "close", key: str = "series") -> DataFrame:
    """Forward-filled and divided by its first value."""
    w = along(key).rowsBetween(Window.unboundedPreceding, 0)
    filled = curve.withColumn("_v", F.last(value, ignorenulls=True).over(w))
    first = F.first(value, ignorenulls=True).over(w)
    return filled.withColumn("value", F.col("_v") / first).drop("_v")


def curve_returns(curve: DataFrame, key: str = "series") -> DataFrame:
    return curve.withColumn("ret", F.col("value") / F.lag("value").over(along(key)) - 1)


def drawdowns(curve: DataFrame, key: str = "series") -> DataFrame:
    """Deepest drawdown with its peak, trough and recovery session."""
    w = along(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_high", F.max("value").over(w)).withColumn("_dd", F.col("value") / F.col("_high") - 1)
    worst = rows.groupBy(key).agg(
        F.min("_dd").alias("max_drawdown"),
        F.min_by(F.struct("trade_date", "_high"), F.struct("_dd", "trade_date")).alias("_t"))
    rows = rows.join(worst, key)
    return rows.groupBy(key, "max_drawdown", F.col("_t.trade_date").alias("trough")).agg(
        F.min(F.when(F.col("value") == F.col("_t._high"), F.col("trade_date"))).alias("peak"),
        F.min(F.when((F.col("trade_date") >= F.col("_t.trade_date")) & (F.col("value") >= F.col("_t._high")),
                     F.col("trade_date"))).alias("recovery"))


def performance(curve: DataFrame, per_year: int = PERIODS, risk_free: float = 0.0, key: str = "series") -> DataFrame:
    daily_rf = risk_free / per_year
    rows = curve_returns(curve, key)
    down = F.when(F.col("ret") < daily_rf, F.col("ret") - daily_rf)
    stats = rows.groupBy(key).agg(
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("*").alias("sessions"),
        F.count("ret").alias("_n"), (F.max_by("value", "trade_date") / F.min_by("value", "trade_date") - 1).alias("total_return"),
        F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"), F.sum(down * down).alias("_down"))
    month = F.trunc("trade_date", "month")
    monthly = curve.groupBy(key, month.alias("_m")).agg(F.max_by("value", "trade_date").alias("_v"))
    wm = Window.partitionBy(key).orderBy("_m")
    wins = monthly.withColumn("_r", F.col("_v") / F.lag("_v").over(wm) - 1).groupBy(key).agg(
        F.avg((F.col("_r") > 0).cast("int")).alias("monthly_win_rate"))
    years = F.col("_n") / per_year
    root = F.sqrt(F.lit(float(per_year)))
    downside = F.sqrt(F.coalesce("_down", F.lit(0.0)) / F.col("_n")) * root
    excess = F.col("_mean") - daily_rf
    out = stats.join(drawdowns(curve, key), key).join(wins, key).withColumn(
        "cagr", F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1))
    return out.select(
        key, "start", "end", "sessions", "total_return", "cagr", (F.col("_sd") * root).alias("volatility"),
        F.when(F.col("_sd") > 0, excess / F.col("_sd") * root).alias("sharpe"),
        F.when(downside > 0, excess * per_year / downside).alias("sortino"),
        "max_drawdown", "peak", "trough", "recovery",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown")).alias("calmar"), "monthly_win_rate")


def relative(curve: DataFrame, benchmark: DataFrame, per_year: int = PERIODS, key: str = "series") -> DataFrame:
    """Excess growth, tracking error and information ratio on the common sessions."""
    both = curve.select(key, "trade_date", "value").join(
        benchmark.select("trade_date", F.col("value").alias("bench")), "trade_date")
    w = along(key)
    rows = both.withColumn("_a", F.col("value") / F.lag("value").over(w) - F.col("bench") / F.lag("bench").over(w))
    g = rows.groupBy(key).agg(
        F.count("_a").alias("_n"), F.avg("_a").alias("_mean"), F.stddev_samp("_a").alias("_sd"),
        (F.max_by("value", "trade_date") / F.min_by("value", "trade_date")).alias("_g"),
        (F.max_by("bench", "trade_date") / F.min_by("bench", "trade_date")).alias("_b"))
    power = per_year / F.col("_n")
    tracking = F.col("_sd") * F.sqrt(F.lit(float(per_year)))
    return g.select(key, (F.pow("_g", power) - F.pow("_b", power)).alias("excess_cagr"), tracking.alias("tracking_error"),
                    F.when(tracking > 0, F.col("_mean") * per_year / tracking).alias("information_ratio"))


def yearly_returns(curve: DataFrame, key: str = "series") -> DataFrame:
    years = curve.groupBy(key, F.year("trade_date").alias("year")).agg(
        F.max_by("value", "trade_date").alias("_last"), F.min_by("value", "trade_date").alias("_first"))
    w = Window.partitionBy(key).orderBy("year")
    return years.select(key, "year", (F.col("_last") / F.coalesce(F.lag("_last").over(w), F.col("_first")) - 1).alias("ret"))


def book_returns(panel: DataFrame, flags: dict[str, str], key: str = "symbol") -> DataFrame:
    """Per session, the mean next-session return of the names each flag held the session before."""
    w = Window.partitionBy(key).orderBy("idx")
    rows = panel.withColumn("_r", F.coalesce(F.col("adj_last") / F.lag("adj_last").over(w) - 1, F.lit(0.0)))
    rows = rows.withColumns({f"_h_{n}": F.coalesce(F.lag(c).over(w), F.lit(False)) for n, c in flags.items()})
    aggs = []
    for n in flags:
        held = F.col(f"_h_{n}")
        aggs += [F.coalesce(F.avg(F.when(held, F.col("_r"))), F.lit(0.0)).alias(n), F.count_if(held).alias(f"{n}_names")]
    return rows.groupBy("idx", "trade_date").agg(*aggs)


def rebalance_log(targets: DataFrame, key: str = "symbol", row: str = "row") -> DataFrame:
    """Per rebalance against the one before: kept, new, exited, cut and raised names, and turnover."""
    now = targets.select(row, key, F.col("weight").alias("w1"))
    before = targets.select((F.col(row) + 1).alias(row), key, F.col("weight").alias("w0"))
    last = targets.agg(F.max(row)).scalar()
    both = now.join(before.filter(F.col(row) <= last), [row, key], "full")
    has0, has1 = F.col("w0").isNotNull(), F.col("w1").isNotNull()
    return both.groupBy(row).agg(
        F.count_if(has0).alias("held"), F.count_if(has0 & has1).alias("kept"), F.count_if(has0 & ~has1).alias("exited"),
        F.count_if(~has0 & has1).alias("new"), F.count_if(F.col("w1") < F.col("w0") - NOISE).alias("trimmed"),
        F.count_if(F.col("w1") > F.col("w0") + NOISE).alias("raised"),
        (F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))) / 2).alias("drift"))


def holding_spells(targets: DataFrame, key: str = "symbol", row: str = "row") -> DataFrame:
    """Lengths of the unbroken runs of rebalances a name stays in the target."""
    w = Window.partitionBy(key).orderBy(row)
    runs = targets.withColumn("_run", F.col(row) - F.row_number().over(w))
    return runs.groupBy(key, "_run").agg(F.min(row).alias("first_row"), F.count("*").alias("length")).drop("_run")


def overlay(monthly: DataFrame, rules: dict[str, object], key: str = "rule") -> DataFrame:
    """Monthly returns under exposure rules: growth, worst month, month-end drawdown, mean exposure.

    ``rules`` maps a rule's name to the exposure column known at the start of the month.
    """
    wide = monthly.select("month", "ret", *[F.coalesce(c, F.lit(1.0)).alias(n) for n, c in rules.items()])
    long = wide.unpivot(["month", "ret"], list(rules), key, "exposure").withColumn("r", F.col("ret") * F.col("exposure"))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    curve = long.withColumn("_v", F.exp(F.sum(F.log1p("r")).over(w)))
    curve = curve.withColumn("_dd", F.col("_v") / F.greatest(F.max("_v").over(w), F.lit(1.0)) - 1)
    return curve.groupBy(key).agg(
        (F.pow(F.max_by("_v", "month"), F.lit(12.0) / F.count("*")) - 1).alias("annual"),
        F.min("_dd").alias("max_drawdown"), F.min("r").alias("worst_month"), F.avg("exposure").alias("mean_exposure"),
        F.count_if(F.col("exposure") < 1).alias("reduced_months"))
