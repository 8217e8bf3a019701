"""Rolling windows, point-in-time facts and the factor library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors, pit, windows
from . import views
from .common import r6
from .ctes import define, oracle
from .registry import query

LIMITS = factors.Limits(coverage=0.5, relax=0.5)


def rounded(df, names):
    return df.withColumns({n: r6(n) for n in names})


def win(n, extra=""):
    return f"(PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("bar_returns", "W5 W6 W7", oracle("returns", """
SELECT symbol, idx, adj_last, round(ret, 6) AS ret, round(ref_close, 6) AS ref_close FROM returns"""))
def bar_returns(spark, sf):
    return rounded(views.returns(spark, sf).select("symbol", "idx", "adj_last", "ret", "ref_close"), ["ret", "ref_close"])


@query("window_stats", "W1 W2 W4 W8", oracle("returns", f"""
SELECT symbol, idx, CASE WHEN idx >= 20 THEN count(ret) OVER w20 END AS n20,
 CASE WHEN idx >= 20 AND count(volume) OVER w20 >= 8 THEN CAST(sum(volume) OVER w20 AS BIGINT) END AS volume_20,
 CASE WHEN idx >= 20 AND count(ret) OVER w20 >= 8 THEN round(avg(ret) OVER w20, 6) END AS mean_20,
 CASE WHEN idx >= 60 AND count(ret) OVER w60 >= 20 THEN round(stddev_samp(ret) OVER w60, 6) END AS std_60,
 CASE WHEN idx >= 60 AND count(adj_close) OVER w60 >= 20 THEN max(adj_close) OVER w60 END AS max_60,
 CASE WHEN idx >= 60 THEN round((count(*) FILTER (has_bar) OVER w60) / 60.0::DOUBLE, 6) END AS coverage_60
FROM returns WINDOW w20 AS {win(20)}, w60 AS {win(60)}"""))
def window_stats(spark, sf):
    ret, volume = F.col("ret"), F.col("volume")
    return views.returns(spark, sf).select(
        "symbol", "idx", windows.count_n(ret, 20).alias("n20"), windows.sum_n(volume, 20, 8).alias("volume_20"),
        r6(windows.mean_n(ret, 20, 8)).alias("mean_20"), r6(windows.std_n(ret, 60, 20)).alias("std_60"),
        windows.max_n(F.col("adj_close"), 60, 20).alias("max_60"), r6(factors.bar_coverage(60)).alias("coverage_60"))


PAIR = "CASE WHEN ret IS NOT NULL AND market_ret IS NOT NULL THEN {} END"


@query("window_pair_stats", "W3 W9", oracle("inputs", f"""
WITH p AS (SELECT symbol, idx, {PAIR.format('ret')} AS x, {PAIR.format('market_ret')} AS y FROM inputs)
SELECT symbol, idx, round(cov, 6) AS cov, round(corr, 6) AS corr, round(var_x, 6) AS var_x, round(var_y, 6) AS var_y
FROM (SELECT symbol, idx, CASE WHEN ok THEN c END AS cov, CASE WHEN ok AND vx > 0 AND vy > 0 THEN r END AS corr,
 CASE WHEN ok THEN vx END AS var_x, CASE WHEN ok THEN vy END AS var_y FROM
 (SELECT symbol, idx, idx >= 60 AND count(x) OVER w >= 20 AS ok, covar_samp(x, y) OVER w AS c, corr(x, y) OVER w AS r,
  var_samp(x) OVER w AS vx, var_samp(y) OVER w AS vy FROM p WINDOW w AS {win(60)}))"""))
def window_pair_stats(spark, sf):
    s = windows.pair_stats(F.col("ret"), F.col("market_ret"), 60, 20)
    return views.factor_inputs(spark, sf).select("symbol", "idx", *[r6(v).alias(k) for k, v in s.items()])


@query("market_values", "W10 J7 J8", oracle("inputs", """
SELECT symbol, idx, total_shares, float_shares, float_mcap, total_mcap, round(turnover_rate, 6) AS turnover_rate FROM inputs"""))
def market_values(spark, sf):
    return views.factor_inputs(spark, sf).select("symbol", "idx", "total_shares", "float_shares", "float_mcap",
                                                 "total_mcap", r6("turnover_rate").alias("turnover_rate"))


@query("window_lagged_block", "W11 W12", oracle("panel", """
SELECT symbol, idx, count(*) FILTER (has_bar) OVER a AS bars_60_20, round(avg(amount) OVER a, 6) AS mean_amount_60_20,
 round(avg((high - low) / close) OVER b, 6) AS mean_range_20,
 CAST(ceil(round(abs(close - close_last_60) / nullif(avg(high - low) OVER b, 0), 6)) AS BIGINT) AS distance_days
FROM (SELECT *, lag(close_last, 60) OVER (PARTITION BY symbol ORDER BY idx) AS close_last_60 FROM panel)
WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 20 PRECEDING),
 b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""))
def window_lagged_block(spark, sf):
    a, b = windows.series("symbol", "idx").rowsBetween(-60, -20), windows.last_n(20)
    reach = F.avg(F.col("high") - F.col("low")).over(b)
    gap = F.abs(F.col("close") - windows.lag_n("close_last", 60))
    return views.panel(spark, sf).select(
        "symbol", "idx", F.count(F.when(F.col("has_bar"), 1)).over(a).alias("bars_60_20"),
        r6(F.avg("amount").over(a)).alias("mean_amount_60_20"),
        r6(F.avg((F.col("high") - F.col("low")) / F.col("close")).over(b)).alias("mean_range_20"),
        F.ceil(F.round(F.try_divide(gap, reach), 6)).alias("distance_days"))


@query("cumulative_measures", "W15", oracle("returns", """
SELECT symbol, idx, CAST(sum(coalesce(amount, 0)) OVER w AS BIGINT) AS amount_cum, max(adj_last) OVER w AS high_water,
 round(exp(sum(ln(1 + coalesce(ret, 0))) OVER w), 6) AS growth
FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)"""))
def cumulative_measures(spark, sf):
    w = windows.so_far()
    return views.returns(spark, sf).select(
        "symbol", "idx", F.sum(F.coalesce("amount", F.lit(0))).over(w).alias("amount_cum"),
        F.max("adj_last").over(w).alias("high_water"),
        r6(F.exp(F.sum(F.log(1 + F.coalesce("ret", F.lit(0)))).over(w))).alias("growth"))


# -- factors ---------------------------------------------------------------------

COVER = {n: f"(count(*) FILTER (has_bar) OVER (PARTITION BY symbol ORDER BY idx ROWS {n - 1} PRECEDING)) / {n}::DOUBLE"
         for n in (21, 121, 241)}


def lagged(n):
    return f"lag(adj_last, {n}) OVER (PARTITION BY symbol ORDER BY idx)" if n else "adj_last"


def change(new, old):
    return f"CASE WHEN idx >= {old + 1} AND {COVER[old + 1]} >= 0.5 THEN {lagged(new)} / {lagged(old)} - 1 END"


def mean(x, n, least):
    return f"CASE WHEN idx >= {n} AND count({x}) OVER {win(n)} >= {least} THEN avg({x}) OVER {win(n)} END"


def stat(f, x, n, least):
    return f"CASE WHEN idx >= {n} AND count({x}) OVER {win(n)} >= {least} THEN {f}({x}) OVER {win(n)} END"


PRICE_FACTORS = {
    "mom_12_1": change(20, 240), "mom_6_1": change(20, 120), "rev_1m": change(0, 20),
    "high_52w": f"adj_last / {stat('max', 'adj_close', 244, 90)}",
    "vol_60": stat("stddev_samp", "ret", 60, 20),
    "max_20": stat("max", "ret", 20, 7), "turn_20": mean("turnover_rate", 20, 7),
    "abn_turn": f"({mean('turnover_rate', 20, 7)}) / ({mean('turnover_rate', 250, 75)})",
    "amihud_20": mean("(abs(ret) / amount * 1e8)", 20, 7),
    "ln_float_mcap": "CASE WHEN float_mcap > 0 THEN ln(float_mcap) END",
    "amplitude_20": mean("((high - low) / ref_close)", 20, 7),
    "turn_vol_20": stat("stddev_samp", "turnover_rate", 20, 7),
}
P60 = "CASE WHEN idx >= 60 AND count(CASE WHEN market_ret IS NOT NULL THEN ret END) OVER w60 >= 20 THEN {} END"
P20 = ("CASE WHEN idx >= 20 AND count(adj_close) OVER w20 >= 7 AND var_samp(adj_close) OVER w20 > 0 "
       "AND var_samp(volume) OVER w20 > 0 THEN corr(adj_close, volume::DOUBLE) OVER w20 END")
MASKED = "(CASE WHEN ret IS NOT NULL THEN market_ret END)"
IVOL = P60.format(f"sqrt(greatest(var_samp(ret) OVER w60 - covar_samp(ret, {MASKED}) OVER w60 * "
                  f"(covar_samp(ret, {MASKED}) OVER w60) / (var_samp({MASKED}) OVER w60), 0))")

define("price_factors", "inputs", f"SELECT symbol, idx, trade_date, "
       + ", ".join(f"{sql} AS {n}" for n, sql in PRICE_FACTORS.items())
       + f", {IVOL} AS ivol_60, {P20} AS pv_corr_20 FROM inputs WINDOW w60 AS {win(60)}, w20 AS {win(20)}")


def family_sql(names):
    return oracle("price_factors", f"SELECT symbol, idx, {', '.join(f'round({n}, 6) AS {n}' for n in names)} FROM price_factors")


def family(spark, sf, names):
    return rounded(factors.compute(views.factor_inputs(spark, sf), names, LIMITS), names)


MOMENTUM = ["mom_12_1", "mom_6_1", "rev_1m", "high_52w"]
VOLATILITY = ["vol_60", "ivol_60", "max_20"]
LIQUIDITY = ["turn_20", "abn_turn", "amihud_20", "ln_float_mcap"]
TECHNICAL = ["amplitude_20", "pv_corr_20", "turn_vol_20"]


@query("momentum_factors", "F1 F2 F3 F4", family_sql(MOMENTUM))
def momentum_factors(spark, sf):
    return family(spark, sf, MOMENTUM)


@query("volatility_factors", "F5 F6 F7", family_sql(VOLATILITY))
def volatility_factors(spark, sf):
    return family(spark, sf, VOLATILITY)


@query("liquidity_size_factors", "F8 F9 F10 F11", family_sql(LIQUIDITY))
def liquidity_size_factors(spark, sf):
    return family(spark, sf, LIQUIDITY)


@query("technical_factors", "F12 F13 F14", family_sql(TECHNICAL))
def technical_factors(spark, sf):
    return family(spark, sf, TECHNICAL)


STEP_METRICS = [m for s in pit.METRICS for m in pit.METRICS[s]]
STEP_SQL = "SELECT * REPLACE (" + ", ".join(f"round({m}, 6) AS {m}" for m in STEP_METRICS) + ") FROM steps"


@query("statement_replay", "H1 H2 J8 J14 J21", oracle("steps", STEP_SQL))
def statement_replay(spark, sf):
    facts = pit.effective(pit.prefer_specific(views.statements(spark, sf)), views.calendar(spark, sf))
    return rounded(pit.statement_metrics(facts), STEP_METRICS)


@query("statement_availability", "H4 J8", oracle("facts", """
SELECT symbol, statement, report_date, version, available, eff + 5 AS eff FROM facts WHERE eff IS NOT NULL"""))
def statement_availability(spark, sf):
    facts = pit.effective(views.statements(spark, sf), views.calendar(spark, sf), extra_lag=5)
    return facts.select("symbol", "statement", "report_date", F.col("version").cast("int").alias("version"),
                        "available", "eff")


define("funds", "inputs steps", """
SELECT i.symbol, i.idx, i.trade_date, i.total_mcap, i.total_shares, """ + ", ".join(
    f"CASE WHEN date_diff('day', s.{st}_period, i.trade_date) <= 365 THEN s.{m} END AS {m}"
    for st in pit.METRICS for m in pit.METRICS[st]) + """
FROM inputs i ASOF LEFT JOIN steps s ON i.symbol = s.symbol AND i.idx >= s.eff""")

define("dividend_cash", "bars inputs calendar", """
SELECT p.symbol, p.idx, p.cash_per_10 / 10 * coalesce(i.total_shares, 1000000) AS cash, c.trade_date FROM
 (SELECT symbol, (SELECT min(idx) FROM calendar c WHERE c.trade_date >= ex_date) AS idx, (v % 7)::DOUBLE AS cash_per_10
  FROM (SELECT symbol, min(trade_date) AS ex_date, sum(volume) AS v FROM bars WHERE month(trade_date) = 6
        GROUP BY symbol, year(trade_date))) p
JOIN inputs i ON i.symbol = p.symbol AND i.idx = p.idx JOIN calendar c ON c.idx = p.idx WHERE p.cash_per_10 > 0""")

define("holder_steps", "bars calendar", """
WITH h AS (SELECT symbol, last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + INTERVAL 2 MONTH) AS end_date,
   sum(volume)::DOUBLE AS holders FROM bars GROUP BY ALL),
e AS (SELECT *, (SELECT min(idx) FROM calendar c WHERE c.trade_date > end_date + CAST(20 + length(symbol) * quarter(end_date) AS INTEGER)) AS eff FROM h)
SELECT n.symbol, n.eff, n.end_date AS period, n.holders / p.holders - 1 AS holders_change FROM e n
LEFT JOIN e p ON p.symbol = n.symbol AND p.end_date = last_day(n.end_date - INTERVAL 3 MONTH) AND p.eff <= n.eff
WHERE n.eff IS NOT NULL
QUALIFY n.end_date = max(n.end_date) OVER (PARTITION BY n.symbol ORDER BY n.eff, n.end_date)
 AND row_number() OVER (PARTITION BY n.symbol, n.eff ORDER BY n.end_date DESC) = 1""")


@query("trailing_dividends", "J10", oracle("inputs dividend_cash", """
SELECT i.symbol, i.idx, round(coalesce((SELECT sum(d.cash) FROM dividend_cash d WHERE d.symbol = i.symbol
  AND d.trade_date <= i.trade_date AND d.trade_date > i.trade_date - 365), 0), 4) AS dividend_ttm FROM inputs i"""))
def trailing_dividends(spark, sf):
    daily = views.bars(spark, sf)
    rows = pit.trailing_cash(views.factor_inputs(spark, sf), views.dividends(daily), views.calendar(spark, sf))
    return rows.select("symbol", "idx", F.round("dividend_ttm", 4).alias("dividend_ttm"))


@query("holder_changes", "H3 J21", oracle("holder_steps", """
SELECT symbol, eff, period, round(holders_change, 6) AS holders_change FROM holder_steps"""))
def holder_changes(spark, sf):
    steps = pit.holder_changes(views.holder_counts(views.bars(spark, sf)), views.calendar(spark, sf))
    return rounded(steps.select("symbol", "eff", "period", "holders_change"), ["holders_change"])


VALUE = {"ep_ttm": "ni_ttm", "bp": "book", "sp_ttm": "revenue_ttm", "cfp_ttm": "ocf_ttm"}
QUALITY = {"roe_ttm": "ni_ttm / CASE WHEN avg_book > 0 THEN avg_book END",
           "roa_ttm": "ni_ttm / CASE WHEN avg_assets > 0 THEN avg_assets END",
           "gross_margin_ttm": "gross_profit_ttm / CASE WHEN revenue_ttm > 0 THEN revenue_ttm END",
           "accruals": "(ni_ttm - ocf_ttm) / CASE WHEN avg_assets > 0 THEN avg_assets END",
           "leverage": "total_liabilities / CASE WHEN total_assets > 0 THEN total_assets END"}
GROWTH = {"ni_yoy": "ni_sq_yoy", "rev_yoy": "rev_sq_yoy", "dni_yoy": "dni_sq_yoy"}


@query("value_factors", "F15 F16 F17 F18 F19 J9", oracle("funds dividend_cash", f"""
SELECT symbol, idx, {', '.join(f'round({m} / CASE WHEN total_mcap > 0 THEN total_mcap END, 10) AS {n}' for n, m in VALUE.items())},
 round(coalesce((SELECT sum(d.cash) FROM dividend_cash d WHERE d.symbol = f.symbol AND d.trade_date <= f.trade_date
  AND d.trade_date > f.trade_date - 365), 0) / CASE WHEN total_mcap > 0 THEN total_mcap END, 8) AS dy_ttm FROM funds f"""))
def value_factors(spark, sf):
    wide = factors.compute(views.factor_inputs(spark, sf, True), [*VALUE, "dy_ttm"], LIMITS)
    return wide.withColumns({**{n: F.round(n, 10) for n in VALUE}, "dy_ttm": F.round("dy_ttm", 8)})


@query("quality_factors", "F20 F21 F22 F23 F24 J9", oracle("funds", f"""
SELECT symbol, idx, {', '.join(f'round({sql}, 6) AS {n}' for n, sql in QUALITY.items())} FROM funds"""))
def quality_factors(spark, sf):
    return rounded(factors.compute(views.factor_inputs(spark, sf, True), list(QUALITY), LIMITS), list(QUALITY))


@query("growth_factors", "F25 F26 F27 J9", oracle("funds", f"""
SELECT symbol, idx, {', '.join(f'round({sql}, 6) AS {n}' for n, sql in GROWTH.items())} FROM funds"""))
def growth_factors(spark, sf):
    return rounded(factors.compute(views.factor_inputs(spark, sf, True), list(GROWTH), LIMITS), list(GROWTH))


@query("holder_factor", "F28 J9", oracle("inputs holder_steps", """
SELECT i.symbol, i.idx, CASE WHEN date_diff('day', h.period, i.trade_date) <= 240 THEN round(h.holders_change, 6) END AS holders_qoq
FROM inputs i ASOF LEFT JOIN holder_steps h ON i.symbol = h.symbol AND i.idx >= h.eff"""))
def holder_factor(spark, sf):
    return rounded(factors.compute(views.factor_inputs(spark, sf, True), ["holders_qoq"], LIMITS), ["holders_qoq"])
