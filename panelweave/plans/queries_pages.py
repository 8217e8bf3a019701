"""Market pages over whole tables: every session's overview with the rules in force, and all marks of a chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import trading_rules as rules
from ..operators import asof, intervals, market
from . import queries_accounts, queries_audit, views  # noqa: F401  (its SQL views are used below)
from .common import classes, r6
from .ctes import define, oracle
from .queries_portfolio import ruled
from .registry import query

define("moves", "ruled panel", """
SELECT r.*, p.amount, CASE WHEN coalesce(lag(r.has_bar) OVER (PARTITION BY r.symbol ORDER BY r.idx), false) AND close_before * coalesce(hfq_before / r.hfq, 1) > 0
 THEN r.close / (close_before * coalesce(hfq_before / r.hfq, 1.0::DOUBLE)) - 1 END AS change FROM ruled r JOIN panel p ON p.symbol = r.symbol AND p.idx = r.idx QUALIFY r.has_bar""")


@views.kept
def moves(spark, sf):
    rows = ruled(spark, sf)
    up, down = rules.limit_prices(F.col("reference"), F.col("limit_ppm"))
    return market.daily_moves(rows.withColumns({"up": up, "down": down})).select("symbol", "idx", "trade_date", "list_date", "close", "up", "down", "amount", "change")


@query("market_overview", "M5 R1", oracle("moves", """
SELECT idx, count(*) FILTER (change > 0) AS advances, count(*) FILTER (change < 0) AS declines, count(*) FILTER (change = 0) AS flat,
 count(*) FILTER (change IS NOT NULL AND trade_date - list_date >= 10 AND close >= up) AS limit_up, count(*) FILTER (change IS NOT NULL AND trade_date - list_date >= 10 AND close <= down) AS limit_down,
 CAST(sum(amount) AS BIGINT) AS amount FROM moves GROUP BY 1"""))
def market_overview(spark, sf):
    return market.overview(moves(spark, sf))


@query("sector_overview", "M5", oracle("moves classes", """
WITH m AS (SELECT idx, industry, avg(change) AS change, count(*) AS stocks FROM moves JOIN classes USING (symbol) WHERE change IS NOT NULL GROUP BY 1, 2)
SELECT idx, industry, round(change, 6) AS change, stocks, row_number() OVER (PARTITION BY idx ORDER BY m.change DESC, industry) AS place FROM m"""))
def sector_overview(spark, sf):
    return market.sectors(moves(spark, sf), classes(spark, sf)).withColumn("change", r6("change"))


@query("chart_mark_spans", "M6 J3", oracle("facts dividend_cash risk_intervals symbol_halts bars calendar", """
WITH r AS (SELECT e.*, (SELECT min(trade_date) FROM bars b WHERE b.symbol = e.symbol AND b.trade_date > e.start_date) AS resume_date FROM symbol_halts e)
SELECT symbol, 'report' AS kind, CAST(report_date AS VARCHAR) AS label, min(notice_date) AS day, NULL::DATE AS until FROM facts WHERE statement = 'income' GROUP BY symbol, report_date
UNION ALL SELECT symbol, 'dividend', '', trade_date, NULL FROM dividend_cash UNION ALL SELECT symbol, 'risk', status, start_date, end_date FROM risk_intervals
UNION ALL SELECT symbol, 'suspension', CASE WHEN end_date IS NULL AND resume_date IS NOT NULL THEN 'inferred' ELSE '' END, start_date, CASE WHEN end_date IS NOT NULL THEN end_date WHEN resume_date IS NULL THEN NULL
 ELSE greatest(start_date, (SELECT max(c.trade_date) FROM calendar c WHERE c.trade_date < r.resume_date)) END FROM r"""))
def chart_mark_spans(spark, sf):
    """Reports at their first notice, dividends at their session, risk intervals and suspensions with their ends."""
    days = views.calendar(spark, sf)
    none = F.lit(None).cast("date")
    reports = views.statements(spark, sf).filter("statement = 'income'").groupBy("symbol", "report_date").agg(F.min("notice_date").alias("day"))
    paid = asof.next_session(views.dividends(views.bars(spark, sf)).filter("cash_per_10 > 0"), days, "ex_date", inclusive=True, out="idx").join(days, "idx")
    halted = intervals.suspension_spans(queries_audit.symbol_halts(spark, sf), views.bars(spark, sf), days)
    risky = queries_audit.risk_spans(spark, sf)
    parts = [
        reports.select("symbol", F.lit("report").alias("kind"), F.col("report_date").cast("string").alias("label"), "day", none.alias("until")),
        paid.select("symbol", F.lit("dividend").alias("kind"), F.lit("").alias("label"), F.col("trade_date").alias("day"), none.alias("until")),
        risky.select("symbol", F.lit("risk").alias("kind"), F.col("status").alias("label"), F.col("start_date").alias("day"), F.col("end_date").alias("until")),
        halted.select("symbol", F.lit("suspension").alias("kind"), F.when(F.col("end_inferred"), "inferred").otherwise("").alias("label"),
                      F.col("start_date").alias("day"), F.col("end_date").alias("until"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
