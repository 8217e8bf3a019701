"""Market tables derived from the given star schema.

Trades are line items (symbol = part brand, session = ship day).  Every view
aggregates trades to one row per (symbol, session) first, with partial
aggregation before the shuffle, so a symbol holding a large share of the trades
still becomes at most one row per session; windows per symbol are bounded by
the length of the calendar.
"""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators import asof, factors, pit, windows
from ..sources.io import read_table


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(build):
    """Keep a derived view in memory and on disk for the session.

    The views below are one row per (symbol, session) or smaller.  Their
    consumers prune different columns, so without this every reference to one
    would scan and aggregate all trades again.  Lost blocks are recomputed from
    the given tables.
    """
    @functools.wraps(build)
    def view(spark: SparkSession, sf: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, f"{build.__name__}{args}")
        if key not in _KEPT:
            _KEPT[key] = build(spark, sf, *args).persist(StorageLevel.MEMORY_AND_DISK)
        return _KEPT[key]

    return view


def forget(spark: SparkSession) -> None:
    """Drop every kept view of the session."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        _KEPT.pop(key).unpersist()


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """One row per trade: price and amount in integer cents, half-up."""
    items = read_table(spark, sf, "lineitem")
    parts = read_table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"),
        F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).alias("price"),
        F.col("l_quantity").cast("long").alias("volume"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("amount"),
        F.col("l_returnflag").alias("side"))


def trade_order() -> Column:
    """The four keys of a trade as one number.

    A number fits the mutable buffers of a hash aggregation; ordering by a struct
    would make Spark sort all trades of a partition before it combines them.
    """
    key = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    line = (F.col("k1") * 16 + F.col("k2")).cast("decimal(15,0)")
    return ((line * F.lit(10**12).cast("decimal(13,0)") + key("k3", 12)) * F.lit(10**11).cast("decimal(12,0)") + key("k4", 11)).cast("decimal(38,0)")


@kept
def bars(spark: SparkSession, sf: str) -> DataFrame:
    sequence = trade_order()
    return ticks(spark, sf).groupBy("symbol", "trade_date").agg(
        F.min_by("price", sequence).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", sequence).alias("close"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"), F.count("*").alias("trades"))


@kept
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = read_table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("trade_date"))
    return windows.session_index(days)


def adjustment_factors(daily: DataFrame) -> DataFrame:
    """A factor step on the first bar of every second year of a symbol."""
    year = F.year("trade_date")
    return (daily.groupBy("symbol", year.alias("year")).agg(F.min("trade_date").alias("effective_date"))
            .filter((F.col("year") + F.length("symbol")) % 2 == 0)
            .select("symbol", "effective_date", (1 + 0.25 * (F.col("year") - 1995)).cast("double").alias("hfq")))


def adjusted(spark: SparkSession, sf: str) -> DataFrame:
    daily = bars(spark, sf)
    joined = asof.asof_join(daily, adjustment_factors(daily), by=["symbol"], left_on="trade_date",
                            right_on="effective_date", values=["hfq"])
    return joined.withColumn("hfq_close", F.col("close") * F.col("hfq"))


@kept
def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Dense session grid per symbol from its first bar on; missing bars are null rows."""
    daily = bars(spark, sf)
    grid = windows.dense_grid(daily, calendar(spark, sf), key="symbol", day="trade_date")
    dense = asof.asof_join(grid, adjustment_factors(daily), by=["symbol"], left_on="trade_date",
                           right_on="effective_date", values=["hfq"])
    dense = dense.withColumn("adj_close", F.col("close") * F.col("hfq"))
    dense = windows.forward_fill(dense, "symbol", "idx", {"adj_last": "adj_close", "close_last": "close"})
    return dense.select("symbol", "idx", "trade_date", "open", "high", "low", "close", "volume", "amount",
                        "has_bar", "hfq", "adj_close", "adj_last", "close_last")


def returns(spark: SparkSession, sf: str) -> DataFrame:
    return windows.bar_returns(panel(spark, sf))


# -- reference data derived from the same trades ---------------------------------

def share_events(daily: DataFrame) -> DataFrame:
    quarter = F.date_trunc("quarter", "trade_date")
    grouped = daily.groupBy("symbol", quarter.alias("_q")).agg(
        F.min("trade_date").alias("change_date"), F.sum("volume").alias("_v"))
    lag_days = (F.length("symbol") * F.quarter("_q") * 3) % 40
    return grouped.select("symbol", "change_date", F.date_add("change_date", lag_days.cast("int")).alias("notice_date"),
                          F.concat_ws("|", "symbol", F.col("change_date").cast("string")).alias("record_key"),
                          (F.lit(1000000) + 500 * F.col("_v")).alias("total_shares"),
                          (F.lit(900000) + 300 * F.col("_v")).alias("float_shares"))


def dividends(daily: DataFrame) -> DataFrame:
    year = F.year("trade_date")
    return (daily.filter(F.month("trade_date") == 6).groupBy("symbol", year.alias("_y"))
            .agg(F.min("trade_date").alias("ex_date"), F.sum("volume").alias("_v"))
            .select("symbol", "ex_date", (F.col("_v") % 7).cast("double").alias("cash_per_10"),
                    F.lit(1000000).cast("long").alias("plan_shares")))


def holder_counts(daily: DataFrame) -> DataFrame:
    end = F.last_day(F.add_months(F.date_trunc("quarter", "trade_date"), 2))
    return (daily.groupBy("symbol", end.alias("end_date")).agg(F.sum("volume").alias("holders"))
            .withColumn("notice_date", F.date_add("end_date", (20 + F.length("symbol") * F.quarter("end_date")
                                                              ).cast("int"))))


@kept
def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly statements with restatements: income, balance and cash-flow rows per (symbol, quarter)."""
    trades = ticks(spark, sf)
    end = F.last_day(F.add_months(F.date_trunc("quarter", "trade_date"), 2))
    first = F.col("volume") <= 45
    when = lambda side, extra=None: F.sum(F.when((F.col("side") == side) & (
        F.lit(True) if extra is None else extra), F.col("amount")).otherwise(0))
    total = lambda extra=None: F.sum(F.when(F.lit(True) if extra is None else extra,
                                            F.col("amount")).otherwise(0))
    quarters = trades.groupBy("symbol", end.alias("report_date")).agg(
        total(first).alias("rev1"), when("R", first).alias("cost1"), when("A", first).alias("gain1"),
        total().alias("rev2"), when("R").alias("cost2"), when("A").alias("gain2"), when("N").alias("cash1"))
    to_date = Window.partitionBy("symbol", F.year("report_date")).orderBy("report_date").rowsBetween(
        Window.unboundedPreceding, 0)
    ever = Window.partitionBy("symbol").orderBy("report_date").rowsBetween(Window.unboundedPreceding, 0)
    ytd = quarters.withColumns({c: F.sum(c).over(to_date) for c in
                                ("rev1", "cost1", "gain1", "rev2", "cost2", "gain2", "cash1")}
                               | {"assets": F.lit(5000000) + F.sum("rev1").over(ever),
                                  "debts": F.sum("cost1").over(ever)})
    q = F.quarter("report_date")
    wait = (25 + (F.length("symbol") * 7 + q * 11) % 60).cast("int")
    base = ytd.withColumn("notice_date", F.date_add("report_date", wait))
    c = F.col
    names = ("revenue", "operate_cost", "parent_net_profit", "deducted_parent_net_profit", "parent_equity", "other_equity_instruments",
             "preferred_shares", "perpetual_bonds", "total_assets", "total_liabilities", "operating_cash_flow")

    def row(statement: str, version: int, notice: Column, update: Column, fields: dict[str, Column]) -> Column:
        values = [fields.get(n, F.lit(None)).cast("long").alias(n) for n in names]
        return F.struct(F.lit(statement).alias("statement"), F.lit(version).alias("version"), notice.alias("notice_date"),
                        update.cast("date").alias("update_date"), *values)

    def income(v: int) -> dict[str, Column]:
        profit = c(f"gain{v}") - c(f"cost{v}")
        return {"revenue": c(f"rev{v}"), "operate_cost": c(f"cost{v}"), "parent_net_profit": profit,
                "deducted_parent_net_profit": profit - 1000}

    balance = {"total_assets": c("assets"), "total_liabilities": c("debts"), "parent_equity": c("assets") - c("debts"),
               "other_equity_instruments": F.when(q % 2 == 0, 1000), "preferred_shares": F.lit(500)}
    notice, none = c("notice_date"), F.lit(None)
    restated = (F.year("report_date") + q) % 3 == 0
    rows = F.array(row("income", 1, notice, none, income(1)),
                   F.when(restated, row("income", 2, notice, F.date_add(notice, 120), income(2))),
                   row("balance", 1, notice, none, balance),
                   row("cashflow", 1, F.date_add(notice, 3), none, {"operating_cash_flow": c("cash1")}))
    # One pass over the trades: the statements of a quarter are exploded from one row.
    return base.select("symbol", "report_date", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select(
        "symbol", "report_date", "r.*", F.lit("G").alias("company_type"))


@kept
def factor_inputs(spark: SparkSession, sf: str, fundamentals: bool = False) -> DataFrame:
    """The return panel with point-in-time shares, market values, turnover rate and, on request, statements."""
    daily, days = bars(spark, sf), calendar(spark, sf)
    shares = pit.step_events(share_events(daily), days)
    rows = asof.asof_join(returns(spark, sf), shares, ["symbol"], "idx", "eff", ["total_shares", "float_shares"],
                          tie=["change_date", "record_key"])
    rows = factors.market_return(rows).withColumns({
        "turnover_rate": F.when(F.col("float_shares") > 0, F.col("volume") / F.col("float_shares")),
        "float_mcap": F.col("close_last") * F.col("float_shares"),
        "total_mcap": F.col("close_last") * F.col("total_shares")})
    if not fundamentals:
        return rows
    steps = pit.statement_metrics(pit.effective(pit.prefer_specific(statements(spark, sf)), days))
    rows = pit.statements_asof(rows, steps)
    rows = pit.trailing_cash(rows, dividends(daily), days)
    holders = pit.holder_changes(holder_counts(daily), days)
    rows = asof.asof_join(rows, holders, ["symbol"], "idx", "eff", ["holders_change", "period"])
    fresh = F.datediff("trade_date", "period") <= pit.HOLDER_MAX_AGE_DAYS
    return rows.withColumn("holders_change", F.when(fresh, F.col("holders_change"))).drop("period")
