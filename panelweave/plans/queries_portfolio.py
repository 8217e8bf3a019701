"""Benchmarks, performance, attribution, risk model and trading rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import trading_rules as rules
from ..operators import evaluate, perf, risk, windows, xsection
from . import views
from .common import classes, r6
from .ctes import define, oracle
from .queries_evaluation import TOP, composite_scores, forwards, inputs, rounded, targets, universe_at, z_scores
from .queries_factors import win
from .registry import query


def schedule(spark, sf):
    return evaluate.month_ends(views.calendar(spark, sf))


@views.kept
def members(spark, sf):
    return universe_at(inputs(spark, sf), schedule(spark, sf)).filter("in_universe").select("idx", "symbol").join(
        classes(spark, sf), "symbol")


@views.kept
def equal_weight(spark, sf):
    return perf.equal_weight_curve(views.panel(spark, sf), members(spark, sf), views.calendar(spark, sf), schedule(spark, sf))


@views.kept
def curves(spark, sf):
    """Adjusted price of every symbol and the equal-weight benchmark, in long form."""
    prices = views.panel(spark, sf).filter("adj_last is not null").select(
        F.col("symbol").alias("series"), "trade_date", F.col("adj_last").cast("double").alias("value"))
    return prices.unionByName(equal_weight(spark, sf).select(F.lit("equal_weight").alias("series"), "trade_date", "value"))


define("periods", "calendar schedule", """
SELECT c.idx, c.trade_date, (SELECT max(s.idx) FROM schedule s WHERE s.idx < c.idx) AS period FROM calendar c""")
define("equal_weight", "panel members periods", """
WITH d AS (SELECT p.period, p.idx, p.trade_date, avg(x.adj_last / b.adj_last) AS rel FROM periods p JOIN members m ON m.idx = p.period AND m.in_universe
 JOIN panel b ON b.symbol = m.symbol AND b.idx = p.period JOIN panel x ON x.symbol = m.symbol AND x.idx = p.idx GROUP BY ALL),
c AS (SELECT period, arg_max(rel, idx) AS last_rel FROM d GROUP BY 1),
k AS (SELECT period, coalesce(exp(sum(ln(last_rel)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS base FROM c)
SELECT idx, trade_date, base * rel AS value FROM d JOIN k USING (period)""")
define("curves", "equal_weight panel", """
SELECT symbol AS series, trade_date, adj_last::DOUBLE AS value FROM panel WHERE adj_last IS NOT NULL
UNION ALL SELECT 'equal_weight', trade_date, value FROM equal_weight""")
define("worst", "curves", """
WITH d AS (SELECT *, max(value) OVER w AS high, value / max(value) OVER w - 1 AS dd FROM curves WINDOW w AS (PARTITION BY series ORDER BY trade_date ROWS UNBOUNDED PRECEDING)),
t AS (SELECT series, min(dd) AS max_drawdown, arg_min(trade_date, row(dd, trade_date)) AS trough, arg_min(high, row(dd, trade_date)) AS high FROM d GROUP BY 1)
SELECT t.series, max_drawdown, trough, min(c.trade_date) FILTER (c.value = t.high) AS peak,
 min(c.trade_date) FILTER (c.trade_date >= trough AND c.value >= t.high) AS recovery FROM t JOIN curves c USING (series) GROUP BY ALL""")


@query("equal_weight_benchmark", "P1", oracle("equal_weight", "SELECT idx, trade_date, round(ln(value), 6) + 0.0::DOUBLE AS log_value FROM equal_weight"))
def equal_weight_benchmark(spark, sf):
    # Random test prices compound to astronomic values, so the logarithm is compared.
    return equal_weight(spark, sf).select("idx", "trade_date", r6(F.log("value")).alias("log_value"))


@query("index_benchmark", "P2", oracle("panel", """
SELECT symbol AS series, trade_date, round(close_last / first_value(close) OVER (PARTITION BY symbol ORDER BY idx)::DOUBLE, 6) AS value,
 CASE WHEN symbol LIKE 'H%' THEN 'total_return' ELSE 'price' END AS kind FROM panel"""))
def index_benchmark(spark, sf):
    levels = views.panel(spark, sf).select(F.col("symbol").alias("series"), "trade_date", "close")
    kind = F.when(F.upper("series").startswith("H"), "total_return").otherwise("price")
    return rounded(perf.rebase(levels).drop("close").withColumn("kind", kind), "value")


PERF = ("log_growth", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "monthly_win_rate")


@query("performance", "P3 P4 W15", oracle("curves worst", """
WITH r AS (SELECT *, value / lag(value) OVER (PARTITION BY series ORDER BY trade_date) - 1 AS ret FROM curves),
m AS (SELECT series, date_trunc('month', trade_date) AS m, arg_max(value, trade_date) AS v FROM curves GROUP BY 1, 2),
w AS (SELECT series, avg(CAST(r > 0 AS INTEGER)) AS monthly_win_rate FROM (SELECT series, v / lag(v) OVER (PARTITION BY series ORDER BY m) - 1 AS r FROM m) GROUP BY 1),
s AS (SELECT series, min(trade_date) AS start, max(trade_date) AS "end", count(*) AS sessions, count(ret) AS n, arg_max(value, trade_date) / arg_min(value, trade_date) - 1 AS total_return,
 avg(ret) AS mean, stddev_samp(ret) AS sd, sum(ret * ret) FILTER (ret < 0) AS down FROM r GROUP BY 1),
c AS (SELECT *, pow(1 + total_return, 1 / (n / 244::DOUBLE)) - 1 AS cagr FROM s)
SELECT series, start, "end", sessions, round(ln(1 + total_return), 6) AS log_growth, round(cagr, 6) AS cagr, round(sd * sqrt(244), 6) AS volatility,
 round(mean / sd * sqrt(244), 6) AS sharpe, round(mean * 244 / (sqrt(coalesce(down, 0) / n) * sqrt(244)), 6) AS sortino,
 round(max_drawdown, 6) AS max_drawdown, peak, trough, recovery, round(cagr / -max_drawdown, 6) AS calmar, round(monthly_win_rate, 6) AS monthly_win_rate
FROM c JOIN worst USING (series) JOIN w USING (series)"""))
def performance(spark, sf):
    table = perf.performance(curves(spark, sf)).withColumn("log_growth", F.log1p("total_return")).drop("total_return")
    return rounded(table, *PERF)


@query("max_drawdown", "P4", oracle("worst", "SELECT series, round(max_drawdown, 6) AS max_drawdown, trough, peak, recovery FROM worst"))
def max_drawdown(spark, sf):
    return rounded(perf.drawdowns(curves(spark, sf)), "max_drawdown")


@query("relative_performance", "P5", oracle("curves", """
WITH b AS (SELECT s.series, s.trade_date, s.value, e.value AS bench FROM curves s JOIN curves e ON e.series = 'equal_weight' AND e.trade_date = s.trade_date WHERE s.series <> 'equal_weight'),
r AS (SELECT *, value / lag(value) OVER w - bench / lag(bench) OVER w AS a FROM b WINDOW w AS (PARTITION BY series ORDER BY trade_date)),
g AS (SELECT series, count(a) AS n, avg(a) AS m, stddev_samp(a) AS sd, arg_max(value, trade_date) / arg_min(value, trade_date) AS g, arg_max(bench, trade_date) / arg_min(bench, trade_date) AS b FROM r GROUP BY 1)
SELECT series, round(pow(g, 244.0::DOUBLE / n) - pow(b, 244.0::DOUBLE / n), 6) AS excess_cagr, round(sd * sqrt(244), 6) AS tracking_error,
 round(m * 244 / (sd * sqrt(244)), 6) AS information_ratio FROM g"""))
def relative_performance(spark, sf):
    every = curves(spark, sf)
    bench = equal_weight(spark, sf)
    return rounded(perf.relative(every.filter("series <> 'equal_weight'"), bench), "excess_cagr", "tracking_error",
                   "information_ratio")


@query("yearly_returns", "P6", oracle("curves", """
WITH y AS (SELECT series, year(trade_date) AS year, arg_max(value, trade_date) AS l, arg_min(value, trade_date) AS f FROM curves GROUP BY 1, 2)
SELECT series, year, round(ln(l / coalesce(lag(l) OVER (PARTITION BY series ORDER BY year), f)), 6) + 0.0::DOUBLE AS log_ret FROM y"""))
def yearly_returns(spark, sf):
    return perf.yearly_returns(curves(spark, sf)).select("series", "year", r6(F.log1p("ret")).alias("log_ret"))


define("orders_log", "ticks", """
SELECT symbol, trade_date + INTERVAL 25 YEAR AS d, CASE WHEN side = 'R' THEN 'sell' ELSE 'buy' END AS side, price, volume,
 price * volume AS notional, CASE length(symbol) % 3 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZSE' ELSE 'BSE' END AS exchange FROM ticks""")


def orders_log(spark, sf):
    """Trades as fills; dates moved 25 years on so that the effective-dated rules change within them."""
    exchange = F.when(F.length("symbol") % 3 == 0, "SSE").when(F.length("symbol") % 3 == 1, "SZSE").otherwise("BSE")
    return views.ticks(spark, sf).select(
        "symbol", F.add_months("trade_date", 300).alias("trade_date"),
        F.when(F.col("side") == "R", "sell").otherwise("buy").alias("side"), "price", "volume",
        (F.col("price") * F.col("volume")).alias("notional"), exchange.alias("exchange"))


FEES_SQL = """
SELECT *, CASE WHEN d >= DATE '2023-08-28' THEN 500 ELSE 1000 END * CAST(side = 'sell' AS INTEGER) AS stamp_ppm,
 CASE WHEN d >= DATE '2022-04-29' THEN 10 WHEN exchange = 'BSE' THEN 25 ELSE 20 END AS transfer_ppm FROM orders_log"""
HALF = "CAST((CAST({a} AS HUGEINT) * ({p}) * 2 + 1000000) // 2000000 AS BIGINT)"


define("fees", "orders_log", f"""
SELECT *, greatest({HALF.format(a='notional', p='250')}, 500) AS commission, {HALF.format(a='notional', p='stamp_ppm')} AS stamp_duty,
 {HALF.format(a='notional', p='transfer_ppm')} AS transfer_fee FROM ({FEES_SQL})""")


@query("order_fees", "R8 R1", oracle("fees", """
SELECT symbol, side, exchange, count(*) AS fills, CAST(sum(commission) AS BIGINT) AS commission, CAST(sum(stamp_duty) AS BIGINT) AS stamp_duty,
 CAST(sum(transfer_fee) AS BIGINT) AS transfer_fee FROM fees GROUP BY ALL"""))
def order_fees(spark, sf):
    return rules.fees(orders_log(spark, sf), 250, 500).groupBy("symbol", "side", "exchange").agg(
        F.count("*").alias("fills"), *[F.sum(c).alias(c) for c in ("commission", "stamp_duty", "transfer_fee")])


@query("trading_stats", "P7", oracle("fees equal_weight", """
WITH n AS (SELECT avg(value) * 1e9 AS nav, greatest(count(*) - 1, 1) / 244.0::DOUBLE AS years FROM equal_weight)
SELECT round(sum(notional) / (SELECT nav FROM n) / (SELECT years FROM n) / 2, 4) AS annual_turnover,
 round(sum(commission + stamp_duty + transfer_fee) / (SELECT nav FROM n) / (SELECT years FROM n), 4) AS annual_cost_drag,
 CAST(sum(notional) AS BIGINT) AS traded, CAST(sum(commission + stamp_duty + transfer_fee) AS BIGINT) AS fees FROM fees"""))
def trading_stats(spark, sf):
    nav = equal_weight(spark, sf).agg((F.avg("value") * 1e9).alias("nav"),
                                      (F.greatest(F.count("*") - 1, F.lit(1)) / 244).alias("years"))
    total = rules.fees(orders_log(spark, sf), 250, 500).agg(
        F.sum("notional").alias("traded"), F.sum(F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee")).alias("fees"))
    both = total.join(nav)  # two single rows
    return both.select(F.round(F.col("traded") / F.col("nav") / F.col("years") / 2, 4).alias("annual_turnover"),
                       F.round(F.col("fees") / F.col("nav") / F.col("years"), 4).alias("annual_cost_drag"), "traded", "fees")


@query("stage_book_returns", "P8", oracle("panel", """
WITH f AS (SELECT symbol, idx, trade_date, adj_last, adj_last > avg(adj_last) OVER w AS above FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING)),
g AS (SELECT *, avg(adj_last) OVER (PARTITION BY idx) > 0 AND above AND idx % 2 = 0 AS gated FROM f),
r AS (SELECT *, coalesce(adj_last / lag(adj_last) OVER w - 1, 0) AS r, coalesce(lag(above) OVER w, false) AS h1, coalesce(lag(gated) OVER w, false) AS h2 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT idx, trade_date, round(coalesce(avg(r) FILTER (h1), 0), 6) AS above, count(*) FILTER (h1) AS above_names,
 round(coalesce(avg(r) FILTER (h2), 0), 6) AS gated, count(*) FILTER (h2) AS gated_names FROM r GROUP BY 1, 2"""))
def stage_book_returns(spark, sf):
    rows = views.panel(spark, sf).withColumn("f_above", F.col("adj_last") > F.avg("adj_last").over(windows.last_n(60)))
    rows = rows.withColumn("f_gated", F.col("f_above") & (F.col("idx") % 2 == 0))
    return rounded(perf.book_returns(rows, {"above": "f_above", "gated": "f_gated"}), "above", "gated")


# -- attribution -------------------------------------------------------------------

@query("style_exposure", "P12", oracle("processed targets", """
SELECT z.idx, z.factor, round(sum(t.weight * z.z) / sum(t.weight) - avg(z.z), 6) AS exposure
FROM processed z LEFT JOIN targets t USING (idx, symbol) GROUP BY 1, 2"""))
def style_exposure(spark, sf):
    return rounded(risk.style_exposures(targets(spark, sf), z_scores(spark, sf)), "exposure")


@query("industry_active_weights", "P12 M13", oracle("members classes targets", """
WITH u AS (SELECT m.idx, m.symbol, c.industry, 1.0::DOUBLE / count(*) OVER (PARTITION BY m.idx) AS b, t.weight FROM members m JOIN classes c USING (symbol)
 LEFT JOIN targets t USING (idx, symbol) WHERE m.in_universe)
SELECT idx, industry, round(coalesce(sum(weight), 0), 6) AS portfolio, round(sum(b), 6) AS benchmark,
 round(coalesce(sum(weight), 0) - sum(b), 6) AS active FROM u GROUP BY 1, 2"""))
def industry_active_weights(spark, sf):
    return rounded(risk.industry_active(targets(spark, sf), members(spark, sf)), "portfolio", "benchmark", "active")


@query("concentration", "P12 M13", oracle("targets panel", """
SELECT idx, count(*) AS names, round(sum(weight), 6) AS invested, round(sum(weight) FILTER (place <= 10), 6) AS top10, round(1 / sum(weight * weight), 6) AS effective_n,
 round(coalesce(sum(weight) FILTER (coalesce(close, 0) < 10000), 0) / sum(weight), 6) AS low_price_weight FROM targets JOIN panel USING (idx, symbol) GROUP BY 1"""))
def concentration(spark, sf):
    prices = views.panel(spark, sf).select("idx", "symbol", "close")
    return rounded(risk.concentration(targets(spark, sf).select("idx", "symbol", "weight"), prices, 10000),
                   "invested", "top10", "effective_n", "low_price_weight")


@query("brinson_attribution", "P13", oracle("members classes targets fwd", """
WITH r AS (SELECT m.idx, c.industry, coalesce(t.weight, 0) AS w, 1.0::DOUBLE AS b, f.fwd_1 AS r FROM members m JOIN classes c USING (symbol)
 LEFT JOIN targets t USING (idx, symbol) JOIN fwd f USING (idx, symbol) WHERE m.in_universe AND f.fwd_1 IS NOT NULL),
p AS (SELECT idx, industry, sum(w) AS w, sum(b) AS b, sum(w * r) AS wr, sum(b * r) AS br FROM r GROUP BY 1, 2),
q AS (SELECT *, sum(w) OVER g AS ww, sum(b) OVER g AS bb, sum(br) OVER g / sum(b) OVER g AS tb FROM p WINDOW g AS (PARTITION BY idx)),
s AS (SELECT *, br / b AS rb, CASE WHEN w > 0 THEN wr / w ELSE br / b END AS rp FROM q WHERE ww > 0)
SELECT idx, round(sum(wr / ww), 6) + 0.0::DOUBLE AS portfolio, round(any_value(tb), 6) + 0.0::DOUBLE AS benchmark, round(sum((w / ww - b / bb) * (rb - tb)), 6) + 0.0::DOUBLE AS allocation,
 round(sum(w / ww * (rp - rb)), 6) + 0.0::DOUBLE AS selection FROM s GROUP BY 1"""))
def brinson_attribution(spark, sf):
    book = members(spark, sf).join(targets(spark, sf).select("idx", "symbol", "weight"), ["idx", "symbol"], "left")
    rows = book.withColumn("member", F.lit(True)).join(
        forwards(spark, sf).select("idx", "symbol", F.col("fwd_1").alias("fwd")), ["idx", "symbol"])
    return rounded(risk.brinson(rows), "portfolio", "benchmark", "allocation", "selection")


# -- risk model ----------------------------------------------------------------------

#: The normal equations have a column per industry; a classification has tens of them.
MOST_INDUSTRIES = 200


def industries(spark, sf) -> list[str]:
    found = sorted(r["industry"] for r in classes(spark, sf).select("industry").distinct().limit(MOST_INDUSTRIES + 1).collect())
    if len(found) > MOST_INDUSTRIES:
        raise ValueError(f"more than {MOST_INDUSTRIES} industries")
    return found


def exposures(spark, sf) -> list[str]:
    return [f"ind_{i.lower()}" for i in industries(spark, sf)] + ["size", "volatility"]


@views.kept
def exposure_rows(spark, sf):
    """Daily returns with the exposures and weights known at the month end before."""
    z = z_scores(spark, sf).filter("factor in ('ln_float_mcap', 'vol_60')").groupBy("idx", "symbol").agg(
        F.max(F.when(F.col("factor") == "ln_float_mcap", F.col("z"))).alias("size"),
        F.max(F.when(F.col("factor") == "vol_60", F.col("z"))).alias("volatility"))
    held = members(spark, sf).join(z, ["idx", "symbol"], "left").select(
        F.col("idx").alias("period"), "symbol", *[(F.col("industry") == i).cast("double").alias(f"ind_{i.lower()}")
                                                  for i in industries(spark, sf)],
        F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("volatility", F.lit(0.0)).alias("volatility"))
    periods = perf.holding_periods(views.calendar(spark, sf), schedule(spark, sf)).select("idx", "period")
    cap = F.lag("float_mcap").over(windows.series("symbol", "idx"))
    rows = inputs(spark, sf).select("symbol", "idx", "ret", F.sqrt(F.when(cap > 0, cap).otherwise(1.0)).alias("w"))
    return rows.join(periods, "idx").join(held, ["symbol", "period"])


@views.kept
def factor_return_series(spark, sf):
    return risk.factor_returns(exposure_rows(spark, sf), exposures(spark, sf), extra=2)


@query("risk_factor_returns", "P14")
def risk_factor_returns(spark, sf):
    return rounded(factor_return_series(spark, sf), *exposures(spark, sf))


@query("risk_factor_covariance", "P15")
def risk_factor_covariance(spark, sf):
    return rounded(risk.ewma_covariance(factor_return_series(spark, sf), exposures(spark, sf), 90), "cov")


@query("specific_variance", "P16")
def specific_variance(spark, sf):
    errors = risk.residuals(exposure_rows(spark, sf), factor_return_series(spark, sf), exposures(spark, sf))
    at = inputs(spark, sf).agg(F.max("idx")).first()[0] or 0
    caps = inputs(spark, sf).filter(F.col("idx") == at).select("symbol", F.col("float_mcap").alias("cap"))
    return rounded(risk.specific_variance(errors, caps, at, 90, 60, 60), "variance")


@query("market_beta", "P17 W3", oracle("inputs", f"""
WITH p AS (SELECT symbol, idx, CASE WHEN market_ret IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN market_ret END AS y FROM inputs)
SELECT symbol, idx, CASE WHEN idx >= 250 AND count(x) OVER w >= 120 THEN round(covar_samp(x, y) OVER w / (var_samp(y) OVER w), 6) END AS beta
FROM p WINDOW w AS {win(250)}"""))
def market_beta(spark, sf):
    s = windows.pair_stats(F.col("ret"), F.col("market_ret"), 250, 120)
    return rounded(inputs(spark, sf).select("symbol", "idx", (s["cov"] / s["var_y"]).alias("beta")), "beta")


# -- targets over time -----------------------------------------------------------------

def target_log(spark, sf):
    # Inverse-place weights, so that kept names are also cut and raised.
    ranked = targets(spark, sf).join(schedule(spark, sf).select("idx", F.col("row").cast("long").alias("row")), "idx")
    raw = 1.0 / (F.col("place") + 1)
    return ranked.select("row", "symbol", (raw / F.sum(raw).over(Window.partitionBy("row"))).alias("weight"))


define("target_log", "targets schedule", """
SELECT s.row, t.symbol, 1.0::DOUBLE / (t.place + 1) / sum(1.0::DOUBLE / (t.place + 1)) OVER (PARTITION BY s.row) AS weight FROM targets t JOIN schedule s USING (idx)""")


@query("rebalance_log", "P20 P21", oracle("target_log", """
WITH b AS (SELECT row + 1 AS row, symbol, weight FROM target_log WHERE row < (SELECT max(row) FROM target_log))
SELECT row, count(*) FILTER (w0 IS NOT NULL) AS held, count(*) FILTER (w0 IS NOT NULL AND w1 IS NOT NULL) AS kept, count(*) FILTER (w0 IS NOT NULL AND w1 IS NULL) AS exited,
 count(*) FILTER (w0 IS NULL AND w1 IS NOT NULL) AS new, count(*) FILTER (w1 < w0 - 1e-12) AS trimmed, count(*) FILTER (w1 > w0 + 1e-12) AS raised,
 round(sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) / 2, 6) + 0.0::DOUBLE AS drift
FROM (SELECT coalesce(n.row, b.row) AS row, n.weight AS w1, b.weight AS w0 FROM target_log n FULL JOIN b ON b.row = n.row AND b.symbol = n.symbol) GROUP BY 1"""))
def rebalance_log(spark, sf):
    return rounded(perf.rebalance_log(target_log(spark, sf)), "drift")


@query("holding_spells", "P21", oracle("target_log", """
SELECT symbol, min(row) AS first_row, count(*) AS length FROM (SELECT *, row - row_number() OVER (PARTITION BY symbol ORDER BY row) AS g FROM target_log) GROUP BY symbol, g"""))
def holding_spells(spark, sf):
    return perf.holding_spells(target_log(spark, sf))


define("monthly", "equal_weight", """
SELECT month, ret, coalesce(lag(ret) OVER (ORDER BY month), 0) AS before FROM (SELECT month, v / lag(v) OVER (ORDER BY month) - 1 AS ret FROM
(SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(value, trade_date) AS v FROM equal_weight GROUP BY 1)) WHERE ret IS NOT NULL""")


def monthly(spark, sf):
    months = equal_weight(spark, sf).groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.max_by("value", "trade_date").alias("v"))
    w = Window.orderBy("month")  # one row per month
    rows = months.select("month", (F.col("v") / F.lag("v").over(w) - 1).alias("ret")).filter("ret is not null")
    return rows.withColumn("before", F.coalesce(F.lag("ret").over(w), F.lit(0.0)))


@query("exposure_overlays", "P23", oracle("monthly", """
WITH l AS (UNPIVOT (SELECT month, ret, 1.0::DOUBLE AS always, CASE WHEN before < 0 THEN 0.5::DOUBLE ELSE 1 END AS half_after_loss FROM monthly) ON always, half_after_loss INTO NAME rule VALUE exposure),
v AS (SELECT *, ret * exposure AS r, exp(sum(ln(1 + ret * exposure)) OVER (PARTITION BY rule ORDER BY month)) AS v FROM l),
d AS (SELECT *, v / greatest(max(v) OVER (PARTITION BY rule ORDER BY month), 1) - 1 AS dd FROM v)
SELECT rule, round(pow(arg_max(v, month), 12.0::DOUBLE / count(*)) - 1, 6) AS annual, round(min(dd), 6) AS max_drawdown, round(min(r), 6) AS worst_month,
 round(avg(exposure), 6) AS mean_exposure, count(*) FILTER (exposure < 1) AS reduced_months FROM d GROUP BY 1"""))
def exposure_overlays(spark, sf):
    table = perf.overlay(monthly(spark, sf), {"always": F.lit(1.0), "half_after_loss": F.when(F.col("before") < 0, 0.5).otherwise(1.0)})
    return rounded(table, "annual", "max_drawdown", "worst_month", "mean_exposure")


@query("returns_by_phase", "P23 V7", oracle("monthly", """
SELECT CASE WHEN before < 0 THEN 'after_loss' ELSE 'after_gain' END AS phase, count(*) AS months, round(avg(ret), 6) AS mean,
 round(avg(CAST(ret > 0 AS INTEGER)), 6) AS win_rate FROM monthly GROUP BY 1"""))
def returns_by_phase(spark, sf):
    phase = F.when(F.col("before") < 0, "after_loss").otherwise("after_gain").alias("phase")
    return monthly(spark, sf).groupBy(phase).agg(F.count("*").alias("months"), r6(F.avg("ret")).alias("mean"),
                                                 r6(F.avg((F.col("ret") > 0).cast("int"))).alias("win_rate"))


# -- trading rules ------------------------------------------------------------------------

BOARD_SQL = """CASE CAST(substr(symbol, 7) AS INTEGER) % 5 WHEN 0 THEN 'SSE_MAIN' WHEN 1 THEN 'SZSE_MAIN' WHEN 2 THEN 'CHINEXT' WHEN 3 THEN 'STAR' ELSE 'BSE' END"""
PPM_SQL = """CASE WHEN board IN ('SSE_MAIN', 'SZSE_MAIN') THEN CASE WHEN risk = 'risk_warning' AND trade_date < DATE '2026-07-06' THEN 50000 ELSE 100000 END
 WHEN board = 'CHINEXT' THEN CASE WHEN trade_date >= DATE '2020-08-24' THEN 200000 WHEN risk = 'risk_warning' THEN 50000 ELSE 100000 END
 WHEN board = 'STAR' THEN 200000 ELSE 300000 END"""
define("ruled", "panel", f"""
WITH r AS (SELECT symbol, idx, CAST(trade_date + INTERVAL 25 YEAR AS DATE) AS trade_date, open, high, low, close, has_bar, hfq, {BOARD_SQL} AS board,
  CASE month(trade_date) % 3 WHEN 0 THEN 'risk_warning' WHEN 1 THEN 'normal' ELSE 'delisting_period' END AS risk,
  lag(close_last) OVER w AS close_before, lag(CASE WHEN has_bar THEN hfq END) OVER w AS x, lag(hfq_bar) OVER w AS hfq_before, idx - min(idx) OVER (PARTITION BY symbol) AS age
 FROM (SELECT *, last_value(CASE WHEN has_bar THEN hfq END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx) AS hfq_bar FROM panel) WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
s AS (SELECT *, {PPM_SQL} AS limit_ppm, CASE WHEN close_before IS NULL THEN NULL WHEN hfq_before IS NOT NULL AND hfq > 0 THEN
  greatest(1, CAST(floor(close_before * hfq_before / hfq + 0.5) AS BIGINT)) ELSE close_before END AS reference,
  min(trade_date) OVER (PARTITION BY symbol) AS list_date FROM r),
u AS (SELECT *, age < 1 OR (age < 5 AND ((board = 'STAR' AND list_date >= DATE '2019-07-22') OR (board = 'CHINEXT' AND list_date >= DATE '2020-08-24')
   OR (board IN ('SSE_MAIN', 'SZSE_MAIN') AND list_date >= DATE '2023-04-10'))) AS unlimited FROM s)
SELECT *, CASE WHEN has_bar AND reference IS NOT NULL THEN greatest({HALF.format(a='reference', p='limit_ppm + 1000000')}, reference + 1) END AS up,
 CASE WHEN has_bar AND reference IS NOT NULL THEN greatest(least({HALF.format(a='reference', p='1000000 - limit_ppm')}, reference - 1), 1) END AS down FROM u""")


def ruled(spark, sf):
    number = F.substring("symbol", 7, 9).cast("int") % 5
    board = (F.when(number == 0, "SSE_MAIN").when(number == 1, "SZSE_MAIN").when(number == 2, "CHINEXT")
             .when(number == 3, "STAR").otherwise("BSE"))
    month = F.month("trade_date") % 3
    state = F.when(month == 0, "risk_warning").when(month == 1, "normal").otherwise("delisting_period")
    w = windows.series("symbol", "idx")
    rows = views.panel(spark, sf).withColumns({
        "board": board, "risk": state, "_bar_hfq": F.last(F.when(F.col("has_bar"), F.col("hfq")), True).over(windows.so_far())})
    rows = rows.withColumns({"close_before": F.lag("close_last").over(w), "hfq_before": F.lag("_bar_hfq").over(w),
                             "age": F.col("idx") - F.min("idx").over(Window.partitionBy("symbol")),
                             "trade_date": F.add_months("trade_date", 300)})
    rows = rules.limit_ratio(rows).withColumns({
        "reference": rules.reference_price(F.col("close_before"), F.col("hfq_before"), F.col("hfq")),
        "list_date": F.min("trade_date").over(Window.partitionBy("symbol"))})
    return rows.withColumn("unlimited", rules.no_limit(F.col("board"), F.col("list_date"), F.col("age")))


@query("limit_prices", "R1 R3 R4 R5", oracle("ruled", """
SELECT symbol, idx, board, risk, limit_ppm, reference, unlimited, up, down FROM ruled"""))
def limit_prices(spark, sf):
    return rules.open_state(ruled(spark, sf)).select("symbol", "idx", "board", "risk", "limit_ppm", "reference", "unlimited", "up", "down")


define("opened", "ruled", """
SELECT *, CASE WHEN band AND open >= up THEN 'LIMIT_UP_AT_OPEN' WHEN free AND one AND close / reference - 1 >= 0.045 THEN 'ONE_PRICE_LIMIT_UP' END AS lock_buy,
 CASE WHEN band AND open < up AND open <= down THEN 'LIMIT_DOWN_AT_OPEN' WHEN free AND one AND close / reference - 1 <= -0.045 THEN 'ONE_PRICE_LIMIT_DOWN' END AS lock_sell,
 CASE WHEN has_bar AND reference IS NULL THEN 'NO_REFERENCE_PRICE' WHEN banded AND unlimited THEN 'NO_LIMIT_SESSION' WHEN free AND NOT band THEN 'LIMIT_BAND_NOT_IN_FORCE' END AS flag FROM
(SELECT *, has_bar AND reference IS NOT NULL AS banded, has_bar AND reference IS NOT NULL AND NOT unlimited AS free,
 coalesce(has_bar AND reference IS NOT NULL AND NOT unlimited AND low >= down - 1 AND high <= up + 1, false) AS band, open = high AND open = low AND open = close AS one FROM ruled)""")


@query("open_tradability", "R6", oracle("opened", """
SELECT symbol, idx, band AS band_in_force, lock_buy, lock_sell, flag FROM opened"""))
def open_tradability(spark, sf):
    return rules.open_state(ruled(spark, sf)).select("symbol", "idx", "band_in_force", "lock_buy", "lock_sell", "flag")


@query("fill_prices", "R7", oracle("opened", f"""
SELECT symbol, idx, greatest(CASE WHEN band THEN least({HALF.format(a='open', p='1002000')}, up) ELSE {HALF.format(a='open', p='1002000')} END, 1) AS buy_price,
 greatest(CASE WHEN band THEN greatest({HALF.format(a='open', p='998000')}, down) ELSE {HALF.format(a='open', p='998000')} END, 1) AS sell_price FROM opened WHERE has_bar"""))
def fill_prices(spark, sf):
    rows = rules.open_state(ruled(spark, sf)).filter("has_bar")
    price = lambda side: rules.fill_price(F.lit(side), F.col("open"), 2000, F.col("band_in_force"), F.col("up"), F.col("down"))
    return rows.select("symbol", "idx", price("buy").alias("buy_price"), price("sell").alias("sell_price"))


LOT_SQL = "SELECT *, CASE WHEN board = 'STAR' THEN 200 ELSE 100 END AS lo, CASE WHEN board IN ('STAR', 'BSE') THEN 1 ELSE 100 END AS step FROM ruled WHERE has_bar"
@query("lot_rounding", "R9", oracle("ruled bars calendar", f"""
WITH x AS (SELECT l.*, b.volume * 37 AS want, b.volume * 29 + b.trades AS holding FROM ({LOT_SQL}) l JOIN calendar c USING (idx) JOIN bars b ON b.symbol = l.symbol AND b.trade_date = c.trade_date),
y AS (SELECT *, least(want // 2, holding) AS asked FROM x)
SELECT symbol, idx, CASE WHEN want < lo THEN 0 ELSE lo + (want - lo) // step * step END AS buy,
 CASE WHEN asked <= 0 THEN 0 WHEN asked = holding THEN holding WHEN holding < lo THEN 0 WHEN asked < lo THEN 0 ELSE lo + (asked - lo) // step * step END AS sell FROM y"""))
def lot_rounding(spark, sf):
    lots = F.broadcast(rules.lot_table(spark))
    base = ruled(spark, sf).filter("has_bar").join(lots, "board")
    rows = base.withColumns({"want": F.col("volume") * 37})
    trades = views.bars(spark, sf).join(views.calendar(spark, sf), "trade_date").select("symbol", "idx", "trades")
    rows = rows.join(trades, ["symbol", "idx"]).withColumn("holding", F.col("volume") * 29 + F.col("trades"))
    return rows.select("symbol", "idx", rules.round_buy(F.col("want")).alias("buy"),
                       rules.round_sell(F.floor(F.col("want") / 2), F.col("holding")).alias("sell"))


@query("share_adjustments", "R10", oracle("panel", """
SELECT symbol, idx, old_quantity, CAST(floor(exact + 1e-9) AS BIGINT) AS new_quantity, CAST(floor((exact - floor(exact + 1e-9)) * close_last + 0.5) AS BIGINT) AS cash_in_lieu FROM
(SELECT symbol, idx, close_last, 1000 + idx % 777 AS old_quantity, hfq, lag(hfq) OVER w AS before, (1000 + idx % 777) * (hfq / lag(hfq) OVER w) AS exact FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx))
WHERE abs(hfq / before - 1) >= 1e-9"""))
def share_adjustments(spark, sf):
    rows = views.panel(spark, sf).withColumns({"before": windows.lag_n("hfq", 1), "old_quantity": F.lit(1000) + F.col("idx") % 777})
    moved = rows.filter(F.abs(F.col("hfq") / F.col("before") - 1) >= 1e-9)
    out = rules.share_adjustment(F.col("old_quantity"), F.col("before"), F.col("hfq"), F.col("close_last"))
    return moved.select("symbol", "idx", "old_quantity", *[c.alias(n) for n, c in out.items()])


@query("next_session_bands", "R11", oracle("ruled panel", f"""
SELECT symbol, idx, greatest({HALF.format(a='close', p='limit_ppm + 1000000')}, close + 1) AS next_up, greatest(least({HALF.format(a='close', p='1000000 - limit_ppm')}, close - 1), 1) AS next_down,
 CASE WHEN unlimited OR reference IS NULL THEN NULL WHEN close >= up THEN 'up' WHEN close <= down THEN 'down' END AS closed_at_limit,
 round(avg(v) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING), 6) AS mean_volume_20
FROM (SELECT r.*, p.volume AS v FROM ruled r JOIN (SELECT symbol, idx, volume FROM panel) p USING (symbol, idx)) QUALIFY has_bar"""))
def next_session_bands(spark, sf):
    rows = rules.open_state(ruled(spark, sf)).withColumn("mean_volume_20", F.avg("volume").over(windows.last_n(20)))
    up, down = rules.limit_prices(F.col("close"), F.col("limit_ppm"))
    at = F.when(F.col("unlimited") | F.col("reference").isNull(), None).when(F.col("close") >= F.col("up"), "up").when(
        F.col("close") <= F.col("down"), "down")
    return rounded(rows.filter("has_bar").select("symbol", "idx", up.alias("next_up"), down.alias("next_down"),
                                                 at.alias("closed_at_limit"), "mean_volume_20"), "mean_volume_20")
