"""Breadth, resampling and other relational market queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import market, windows
from . import views
from .common import classes, r6
from .ctes import oracle
from .registry import query

WINDOWS = (20, 60, 120, 250)
SHORT = (5, 10, 20, 60)


def flags_sql(wins, extreme, min_history, extra=""):
    means = ", ".join(f"CAST(hfq_close > avg(hfq_close) OVER (w ROWS {n - 1} PRECEDING) AS INTEGER) AS a{n}"
                      for n in wins)
    return f"""
SELECT * FROM (SELECT symbol, trade_date, {extra} {means},
  CAST(hfq_close >= max(hfq_close) OVER (w ROWS {extreme - 1} PRECEDING) AS INTEGER) AS high,
  CAST(hfq_close <= min(hfq_close) OVER (w ROWS {extreme - 1} PRECEDING) AS INTEGER) AS low,
  CAST(hfq_close > lag(hfq_close) OVER w AS INTEGER) AS up, CAST(hfq_close < lag(hfq_close) OVER w AS INTEGER) AS down,
  count(*) OVER (w ROWS {extreme - 1} PRECEDING) AS n
 FROM adjusted WHERE hfq_close > 0 WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) WHERE n >= {min_history}"""


def breadth_sql(wins, by="trade_date", source="flags"):
    above = ", ".join(f"avg(a{n}) AS above{n}" for n in wins)
    return f"""SELECT {by}, count(*) AS stocks, {above}, CAST(sum(high) AS BIGINT) AS highs,
 CAST(sum(low) AS BIGINT) AS lows, CAST(sum(up) AS BIGINT) AS ups, CAST(sum(down) AS BIGINT) AS downs
 FROM {source} GROUP BY ALL"""


def rounded(wins):
    return {f"above{n}": r6(f"above{n}") for n in wins}


def breadth_rounded_sql(wins, extreme, history):
    return oracle("adjusted", f"WITH flags AS ({flags_sql(wins, extreme, history)}), m AS ({breadth_sql(wins)}) "
                  f"SELECT * REPLACE ({', '.join(f'round(above{n}, 6) AS above{n}' for n in wins)}) FROM m")


@query("market_breadth", "B1 B2 S1", breadth_rounded_sql(WINDOWS, 250, 250))
def market_breadth(spark, sf):
    return market.breadth(market.breadth_flags(views.adjusted(spark, sf), "hfq_close")).withColumns(rounded(WINDOWS))


@query("market_breadth_short", "B1 B2", breadth_rounded_sql(SHORT, 60, 60))
def market_breadth_short(spark, sf):
    flags = market.breadth_flags(views.adjusted(spark, sf), "hfq_close", SHORT, 60, 60)
    return market.breadth(flags, SHORT).withColumns(rounded(SHORT))


@query("breadth_latest", "B2", oracle("adjusted", f"""
WITH flags AS ({flags_sql(SHORT, 60, 60)}), m AS ({breadth_sql(SHORT)}),
c AS (SELECT *, {', '.join(f'above{n} - lag(above{n}, 5) OVER (ORDER BY trade_date) AS above{n}_5d' for n in SHORT)} FROM m),
l AS (SELECT * FROM c ORDER BY trade_date DESC LIMIT 1)
SELECT l.* REPLACE ({', '.join(f'round(l.above{n}, 6) AS above{n}, round(l.above{n}_5d, 6) AS above{n}_5d' for n in SHORT)}),
 {', '.join(f'(SELECT round(avg(CAST(m.above{n} <= l.above{n} AS INTEGER)), 6) FROM m) AS above{n}_rank' for n in SHORT)} FROM l"""))
def breadth_latest(spark, sf):
    flags = market.breadth_flags(views.adjusted(spark, sf), "hfq_close", SHORT, 60, 60)
    out = market.breadth_latest(market.breadth(flags, SHORT), SHORT)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("above")})


@query("industry_breadth_change", "B2", oracle("adjusted classes", f"""
WITH flags AS ({flags_sql(SHORT, 60, 60)}),
d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS age FROM (SELECT DISTINCT trade_date FROM flags)),
r AS ({breadth_sql(SHORT, 'age, industry', 'flags JOIN d USING (trade_date) JOIN classes USING (symbol)')})
SELECT n.industry, n.stocks, n.highs, n.lows, {', '.join(f'round(n.above{w}, 6) AS above{w}, round(n.above{w} - b.above{w}, 6) AS above{w}_change' for w in SHORT)}
FROM (SELECT * FROM r WHERE age = 1) n LEFT JOIN (SELECT * FROM r WHERE age = 21) b USING (industry)"""))
def industry_breadth_change(spark, sf):
    flags = market.breadth_flags(views.adjusted(spark, sf), "hfq_close", SHORT, 60, 60)
    out = market.industry_breadth_change(flags, classes(spark, sf), SHORT)
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith("above")})


@query("bars_last_n", "M1", oracle("bars", """
SELECT * EXCLUDE (trades) FROM bars WHERE symbol = 'Brand#7' AND trade_date BETWEEN '1996-01-01' AND '2000-06-30'
ORDER BY trade_date DESC LIMIT 120"""))
def bars_last_n(spark, sf):
    return market.last_bars(views.bars(spark, sf), "Brand#7", "1996-01-01", "2000-06-30", 120).drop("trades")


def resample_sql(period):
    return oracle("adjusted", f"""
WITH g AS (SELECT symbol, CAST(date_trunc('{period}', trade_date) AS DATE) AS period, max(trade_date) AS trade_date,
 arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, trade_date) AS close,
 CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(amount) AS BIGINT) AS amount, arg_max(hfq_close, trade_date) AS hfq_close
 FROM adjusted GROUP BY ALL)
SELECT * , round(hfq_close / lag(hfq_close) OVER w - 1, 6) AS pct, round((high - low) / lag(close) OVER w, 6) AS amplitude
FROM g WINDOW w AS (PARTITION BY symbol ORDER BY period)""")


@query("bars_weekly", "M2", resample_sql("week"))
def bars_weekly(spark, sf):
    return market.resample(views.adjusted(spark, sf), "week").withColumns({"pct": r6("pct"), "amplitude": r6("amplitude")})


@query("bars_monthly", "M2", resample_sql("month"))
def bars_monthly(spark, sf):
    return market.resample(views.adjusted(spark, sf), "month").withColumns({"pct": r6("pct"), "amplitude": r6("amplitude")})


@query("latest_close", "J12", oracle("bars", """
SELECT symbol, trade_date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1"""))
def latest_close(spark, sf):
    return market.latest_per_key(views.bars(spark, sf), ["symbol"], ["trade_date"], ["trade_date", "close"])


#: What is searched for: the start of a code or a part of a name.
SEARCHED = "12"


@query("symbol_search", "M3", f"""
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '{SEARCHED}%' OR contains(c_name, '{SEARCHED}')""")
def symbol_search(spark, sf):
    from ..sources.io import read_table
    customers = read_table(spark, sf, "customer").withColumn("code", F.col("c_custkey").cast("string"))
    return market.search(customers, SEARCHED, "code", "c_name", F.col("c_acctbal") < 0).select("c_custkey", "c_name", "c_mktsegment")


@query("index_directory", "M4", oracle("bars", """
SELECT symbol, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS sessions FROM bars GROUP BY 1"""))
def index_directory(spark, sf):
    return views.bars(spark, sf).groupBy("symbol").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("sessions"))


@query("day_overview", "M5", oracle("bars calendar", """
SELECT n.trade_date, count(*) FILTER (n.close > p.close) AS advances, count(*) FILTER (n.close < p.close) AS declines,
 count(*) FILTER (n.close = p.close) AS flat,
 count(*) FILTER (n.close >= floor(p.close * (1 + 0.1::DOUBLE) + 0.5)) AS limit_up,
 count(*) FILTER (n.close <= floor(p.close * (1 - 0.1::DOUBLE) + 0.5)) AS limit_down, CAST(sum(n.amount) AS BIGINT) AS amount
FROM bars n LEFT JOIN bars p ON p.symbol = n.symbol
 AND p.trade_date = (SELECT max(trade_date) FROM calendar WHERE trade_date < DATE '1999-03-15')
WHERE n.trade_date = DATE '1999-03-15' GROUP BY 1"""))
def day_overview(spark, sf):
    return market.day_overview(views.bars(spark, sf), views.calendar(spark, sf), "1999-03-15", 0.1)


@query("sector_changes", "M5", oracle("bars classes", """
WITH c AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS chg FROM bars),
m AS (SELECT industry, avg(chg) AS change, count(chg) AS stocks FROM c JOIN classes USING (symbol)
 WHERE trade_date = DATE '1999-03-15' GROUP BY 1)
SELECT industry, round(change, 6) AS change, stocks, row_number() OVER (ORDER BY change DESC NULLS LAST, industry) AS place FROM m"""))
def sector_changes(spark, sf):
    return market.sector_changes(views.bars(spark, sf), classes(spark, sf), "1999-03-15").withColumn("change", r6("change"))


@query("session_neighbours", "M14 J17", oracle("calendar", """
SELECT trade_date, idx, lag(trade_date) OVER (ORDER BY idx) AS previous, lead(trade_date) OVER (ORDER BY idx) AS next,
 month(trade_date) <> month(lead(trade_date) OVER (ORDER BY idx)) AS month_end, idx % 5 = 0 AS every_fifth,
 date_diff('day', lag(trade_date) OVER (ORDER BY idx), trade_date) AS days_since FROM calendar"""))
def session_neighbours(spark, sf):
    w = Window.orderBy("idx")  # one row per session
    return views.calendar(spark, sf).withColumns({
        "previous": F.lag("trade_date").over(w), "next": F.lead("trade_date").over(w),
        "month_end": F.month("trade_date") != F.month(F.lead("trade_date").over(w)),
        "every_fifth": F.col("idx") % 5 == 0,
        "days_since": F.datediff("trade_date", F.lag("trade_date").over(w))})


@query("sql_over_views", "M15", oracle("bars", """
SELECT year(trade_date) AS year, count(DISTINCT symbol) AS symbols, CAST(sum(amount) AS BIGINT) AS amount
FROM bars WHERE volume > 20 GROUP BY 1"""))
def sql_over_views(spark, sf):
    return spark.sql("SELECT year(trade_date) AS year, count(DISTINCT symbol) AS symbols, sum(amount) AS amount "
                     "FROM {bars} WHERE volume > 20 GROUP BY 1", bars=views.bars(spark, sf))
