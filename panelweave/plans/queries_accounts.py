"""Construction, orders, account logs, checks and the market pages built on them."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import trading_rules as rules
from ..operators import accounts, asof, market, perf, windows
from ..sources.io import read_table, written
from . import queries_datasets, queries_factors, queries_structure, views  # noqa: F401  (their SQL views are used below)
from .common import classes, r6
from .ctes import define, oracle
from .queries_evaluation import composite_scores, inputs, rounded, targets
from .queries_portfolio import members, ruled, schedule
from .registry import query


# Name after name, as the rule reads: held ones first, then industries that are short, then the rest.
define("selection", "composite members targets schedule panel classes", f"""
WITH RECURSIVE c AS MATERIALIZED (
 SELECT s.idx, s.symbol, s.score, k.industry, h.symbol IS NOT NULL AS held, coalesce(p.close_last, 0) < 400000 AS able, row_number() OVER (PARTITION BY s.idx ORDER BY s.score DESC, s.symbol) AS place
 FROM composite s JOIN members m ON m.idx = s.idx AND m.symbol = s.symbol AND m.in_universe JOIN classes k ON k.symbol = s.symbol JOIN panel p ON p.idx = s.idx AND p.symbol = s.symbol
 LEFT JOIN (SELECT x.nxt AS idx, t.symbol FROM targets t JOIN (SELECT idx, lead(idx) OVER (ORDER BY idx) AS nxt FROM schedule) x ON x.idx = t.idx) h ON h.idx = s.idx AND h.symbol = s.symbol),
k AS (SELECT idx, industry, count(*) / sum(count(*)) OVER (PARTITION BY idx)::DOUBLE AS share FROM c GROUP BY 1, 2),
d AS (SELECT idx, w, sum(greatest(0, ceil((share - w) * 6 - 1e-9))) AS total FROM k, (SELECT unnest({accounts._widths(0.05)}) AS w) GROUP BY 1, 2),
b AS (SELECT idx, min(w) AS w FROM d WHERE total <= 6 OR w >= 1 GROUP BY 1),
i AS (SELECT idx, industry, greatest(0, ceil((share - w) * 6 - 1e-9)) AS least, greatest(greatest(0, ceil((share - w) * 6 - 1e-9)), floor((share + w) * 6 + 1e-9)) AS most FROM k JOIN b USING (idx)),
r AS (SELECT *, 1 AS round FROM c WHERE able AND held AND place <= 9 UNION ALL SELECT *, 2 FROM c WHERE able UNION ALL SELECT *, 3 FROM c WHERE able),
a AS MATERIALIZED (SELECT r.idx, r.symbol, r.industry, r.round, i.least, i.most, row_number() OVER (PARTITION BY r.idx ORDER BY r.round, CASE r.round WHEN 2 THEN r.industry ELSE '' END, r.place) AS n FROM r JOIN i USING (idx, industry)),
f AS (SELECT DISTINCT idx, 0::BIGINT AS n, []::VARCHAR[] AS chosen, []::VARCHAR[] AS from_industry FROM a
 UNION ALL SELECT idx, n, CASE WHEN take THEN list_append(chosen, symbol) ELSE chosen END, CASE WHEN take THEN list_append(from_industry, industry) ELSE from_industry END
 FROM (SELECT *, NOT list_contains(chosen, symbol) AND taken < most AND CASE round WHEN 1 THEN true WHEN 2 THEN taken < least AND len(chosen) < 6 ELSE len(chosen) < 6 END AS take
  FROM (SELECT a.*, f.chosen, f.from_industry, len(list_filter(f.from_industry, lambda x: x = a.industry)) AS taken FROM f JOIN a ON a.idx = f.idx AND a.n = f.n + 1))),
l AS (SELECT idx, unnest(chosen) AS symbol FROM f QUALIFY n = max(n) OVER (PARTITION BY idx))
SELECT c.idx, c.symbol, round(c.score, 6) + 0.0::DOUBLE AS score, c.industry, c.place FROM l JOIN c USING (idx, symbol)""")


@query("constrained_selection", "P9", oracle("selection", "SELECT * FROM selection", once=True))
def constrained_selection(spark, sf):
    scores = composite_scores(spark, sf).join(members(spark, sf), ["idx", "symbol"])
    held = targets(spark, sf).join(schedule(spark, sf).select("idx", F.lead("idx").over(Window.orderBy("idx")).alias("next")), "idx").select(
        F.col("next").alias("idx"), "symbol", F.lit(True).alias("held"))
    price = views.panel(spark, sf).select("idx", "symbol", (F.coalesce("close_last", F.lit(0)) < 400000).alias("affordable"))
    rows = scores.join(held, ["idx", "symbol"], "left").join(price, ["idx", "symbol"]).select(
        "idx", "symbol", "score", "industry", F.coalesce("held", F.lit(False)).alias("held"), "affordable")
    return rounded(accounts.select_names(rows, 6, 0.05), "score")


@query("capped_weights", "P10", oracle("targets inputs", """
WITH t AS (SELECT t.idx, t.symbol, greatest(1 + 0.5 * CASE WHEN stddev_pop(score) OVER (PARTITION BY t.idx) > 0 THEN (score - avg(score) OVER (PARTITION BY t.idx)) / stddev_pop(score) OVER (PARTITION BY t.idx) ELSE 0 END, 0.2) AS raw,
  least(0.2, CASE WHEN i.amount > 0 THEN 0.1 * i.amount * 3 / 2e7 ELSE 0 END) AS cap FROM targets t JOIN inputs i USING (idx, symbol)),
l AS (SELECT *, (0.95 - coalesce(sum(cap) OVER b, 0)) / (sum(raw) OVER (PARTITION BY idx) - coalesce(sum(raw) OVER b, 0)) AS lv, row_number() OVER (PARTITION BY idx ORDER BY cap / raw, symbol) AS n FROM t WINDOW b AS (PARTITION BY idx ORDER BY cap / raw, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT idx, arg_min(lv, n) AS lv FROM l WHERE lv * raw <= cap * (1 + 1e-12) GROUP BY 1)
SELECT l.idx, l.symbol, round(l.cap, 6) AS cap, round(CASE WHEN c.lv IS NULL THEN l.cap ELSE least(l.cap, c.lv * l.raw) END, 6) AS weight FROM l LEFT JOIN c USING (idx)"""))
def capped_weights(spark, sf):
    rows = targets(spark, sf).select("idx", "symbol", "score").join(inputs(spark, sf).select("idx", "symbol", "amount"), ["idx", "symbol"])
    rows = rows.withColumns({"raw": accounts.tilt("score", "idx", 0.5), "cap": accounts.liquidity_cap(F.col("amount"), F.lit(2e7), 0.1, 3, 0.2)})
    return rounded(accounts.capped_weights(rows, "idx", "raw", "cap", 0.95).select("idx", "symbol", "cap", "weight"), "cap", "weight")


define("order_inputs", "target_log panel schedule", """
SELECT coalesce(n.row, b.row) AS row, coalesce(n.symbol, b.symbol) AS symbol, coalesce(n.weight, 0) AS weight, CAST(coalesce(floor(b.weight * 90000), 0) AS BIGINT) AS held FROM target_log n FULL JOIN (SELECT row + 1 AS row, symbol, weight FROM target_log) b ON b.row = n.row AND b.symbol = n.symbol""")


@query("order_sizing", "P11", oracle("order_inputs panel schedule", """
WITH p AS (SELECT s.row, p.symbol, p.close_last AS price FROM panel p JOIN schedule s USING (idx)),
r AS (SELECT o.*, p.price, CAST(floor(o.weight * 3e8 * (1 - 0.02) / p.price) AS BIGINT) - o.held AS gap, o.weight * 3e8 * (1 - 0.02) AS value FROM order_inputs o LEFT JOIN p USING (row, symbol)),
q AS (SELECT *, CASE WHEN gap < 100 THEN 0 ELSE gap // 100 * 100 END AS buy, CASE WHEN -gap <= 0 THEN 0 WHEN least(-gap, held) = held THEN held WHEN held < 100 THEN 0 WHEN least(-gap, held) < 100 THEN 0 ELSE least(-gap, held) // 100 * 100 END AS sell FROM r),
s AS (SELECT *, CASE WHEN weight <= 0 AND held > 0 THEN 'exit' WHEN weight <= 0 THEN 'none' WHEN price IS NULL THEN 'no_price' WHEN held > 0 AND abs(held * price - value) <= 0.1 * value THEN 'within_band'
  WHEN gap > 0 THEN CASE WHEN buy > 0 THEN 'buy' WHEN held = 0 THEN 'lot_too_large' ELSE 'none' END WHEN gap < 0 AND sell > 0 THEN 'sell' ELSE 'none' END AS state FROM q)
SELECT row, symbol, state, CASE state WHEN 'exit' THEN held WHEN 'buy' THEN buy WHEN 'sell' THEN sell END AS quantity FROM s WHERE state <> 'none'""", once=True))
def order_sizing(spark, sf):
    from .queries_portfolio import target_log
    log = target_log(spark, sf)
    held = log.select((F.col("row") + 1).alias("row"), "symbol", F.floor(F.col("weight") * 90000).alias("held"))
    weights = log.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("weight"), "symbol")))
    days = schedule(spark, sf).select("idx", F.col("row").cast("long").alias("row"))
    prices = views.panel(spark, sf).join(days, "idx").select("row", "symbol", F.col("close_last").alias("price"), F.lit(3e8).alias("nav"),
                                                             F.lit(100).alias("buy_min"), F.lit(100).alias("buy_step"), F.lit(100).alias("odd_lot_below"))
    return accounts.size_orders(weights, held, prices, ["row"], "nav", 0.1, 0.02).select("row", "symbol", "state", "quantity")


# -- accounts -----------------------------------------------------------------------------

def account_events(spark, sf):
    """Line items of an order are fills of its customer's account."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    t = views.ticks(spark, sf).join(o, F.col("k1") == F.col("o_orderkey"))
    event = F.concat_ws("-", F.lpad(F.col("k1").cast("string"), 12, "0"), F.col("k2").cast("string"), F.col("k3").cast("string"), F.col("k4").cast("string"))
    return t.select("account", "symbol", F.col("trade_date").alias("day"), event.alias("event_id"),
                    F.when(F.col("side") == "R", "sell").otherwise("buy").alias("side"), F.col("volume").alias("shares"),
                    (F.col("volume") * F.col("price")).alias("amount"))


define("account_events", "ticks", """
SELECT o.o_custkey AS account, t.symbol, t.trade_date AS day, lpad(CAST(k1 AS VARCHAR), 12, '0') || '-' || k2 || '-' || k3 || '-' || k4 AS event_id,
 t.side = 'R' AS sell, t.volume AS shares, t.volume * t.price AS amount FROM ticks t JOIN orders o ON o.o_orderkey = t.k1""")
# one event after the other: what is held at the start of a day can be sold on it, a sale of more is refused, a repeated id ignored
define("folded", "account_events", """
WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY day, event_id) AS n FROM account_events),
f AS (
 SELECT DISTINCT account, symbol, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS DATE) AS day, '' AS verdict, 0::BIGINT AS quantity, 0::BIGINT AS sellable, 0::BIGINT AS cost, 0::BIGINT AS cash_change, 0::BIGINT AS n FROM e
 UNION ALL
 SELECT account, symbol, event_id, day, verdict, CASE WHEN verdict <> 'ok' THEN q WHEN sell THEN q - shares ELSE q + shares END, CASE WHEN verdict = 'ok' AND sell THEN s - shares ELSE s END,
  CASE WHEN verdict <> 'ok' THEN c WHEN sell THEN c * (q - shares) // q ELSE c + amount END, CASE WHEN verdict <> 'ok' THEN 0 WHEN sell THEN amount ELSE -amount END, n
 FROM (SELECT *, CASE WHEN event_id = before THEN 'duplicate' WHEN sell AND shares > s THEN 'rejected' ELSE 'ok' END AS verdict
  FROM (SELECT e.*, f.quantity AS q, f.cost AS c, f.event_id AS before, CASE WHEN e.day IS DISTINCT FROM f.day THEN f.quantity ELSE f.sellable END AS s
   FROM f JOIN e ON e.account = f.account AND e.symbol = f.symbol AND e.n = f.n + 1)))
SELECT account, symbol, event_id, day, verdict, quantity, sellable, cost, cash_change FROM f WHERE n > 0""")
OPENING = 10_000_000


def folded(spark, sf):
    return accounts.fold_positions(account_events(spark, sf))


@query("account_positions", "P18", oracle("folded", "SELECT * FROM folded"))
def account_positions(spark, sf):
    return folded(spark, sf)


@query("account_cash", "P18 W15", oracle("folded", f"""
SELECT account, symbol, event_id, day, CAST(sum(cash_change) OVER (PARTITION BY account ORDER BY day, event_id, symbol) + {OPENING} AS BIGINT) AS cash FROM folded"""))
def account_cash(spark, sf):
    return accounts.cash_after(folded(spark, sf), OPENING)


@query("marked_accounts", "P19 J12", oracle("folded bars", f"""
WITH l AS (SELECT account, symbol, arg_max(quantity, row(day, event_id)) AS quantity FROM folded GROUP BY 1, 2), p AS (SELECT symbol, arg_max(close, trade_date) AS price FROM bars GROUP BY 1),
c AS (SELECT account, sum(cash_change) + {OPENING} AS cash FROM folded GROUP BY 1), h AS (SELECT l.*, p.price, l.quantity * p.price AS value FROM l LEFT JOIN p USING (symbol) WHERE quantity > 0),
n AS (SELECT account, CAST(any_value(cash) + coalesce(sum(value), 0) AS BIGINT) AS nav FROM c LEFT JOIN h USING (account) GROUP BY 1)
SELECT account, symbol, quantity, price, value, nav, round(value / nav::DOUBLE, 6) AS weight FROM h JOIN n USING (account)"""))
def marked_accounts(spark, sf):
    # in a task the rows of a key are in order, so that a number of the row tells the last one; written, as it is read for cash, value and weight
    both = written(folded(spark, sf).withColumn("n", F.monotonically_increasing_id()).groupBy("account", "symbol").agg(
        F.max_by("quantity", "n").alias("quantity"), F.sum("cash_change").alias("spent")), "marked")
    cash = both.groupBy("account").agg((F.sum("spent") + OPENING).alias("cash"))
    prices = market.latest_per_key(views.bars(spark, sf), ["symbol"], ["trade_date"], ["close"]).withColumnRenamed("close", "price")
    return rounded(accounts.mark(both.drop("spent"), prices, cash, ["account"]), "weight")


@query("pending_actions", "P22", oracle("folded bars", """
WITH p AS (SELECT symbol, min(trade_date) AS ex_date, CAST(sum(volume) % 7 AS DOUBLE) AS cash_per_10 FROM bars WHERE month(trade_date) = 6 GROUP BY symbol, year(trade_date) HAVING sum(volume) % 7 > 0),
h AS (SELECT account, symbol, day, arg_max(quantity, event_id) AS quantity FROM folded GROUP BY 1, 2, 3),
o AS (SELECT DISTINCT account, symbol FROM folded),
x AS (SELECT o.account, p.symbol, p.ex_date, p.cash_per_10 FROM o JOIN p USING (symbol))
SELECT x.account, x.symbol, x.ex_date, x.cash_per_10, h.quantity, CAST(floor(h.quantity * x.cash_per_10 / 10 + 0.5::DOUBLE) AS BIGINT) AS cash
FROM x ASOF JOIN h ON h.account = x.account AND h.symbol = x.symbol AND h.day < x.ex_date WHERE h.quantity > 0"""))
def pending_actions(spark, sf):
    held = folded(spark, sf).select("account", "symbol", "event_id", "day", "quantity")
    plans = views.dividends(views.bars(spark, sf)).filter("cash_per_10 > 0").select("symbol", "ex_date", "cash_per_10")
    return accounts.pending_actions(plans, held)


# -- checks -------------------------------------------------------------------------------

define("intents", "ticks bars", """
SELECT t.trade_date AS day, t.symbol, t.k1, t.k2, t.k3, t.k4, CASE WHEN t.side = 'R' THEN 'sell' ELSE 'buy' END AS side, t.volume AS quantity, t.price, t.k3 % 40 AS held, 3000000 AS nav, b.volume * 0.6::DOUBLE AS volume_cap,
 CASE WHEN b.close = b.high AND b.trades > 1 THEN 'up' WHEN b.close = b.low AND b.trades > 1 THEN 'down' END AS closed_at, t.k4 % 11 > 0 AS has_bar, t.k4 % 13 = 0 AS halted_next, t.k1 % 17 = 0 AS ex_next, t.k1 % 19 = 0 AS risky,
 t.volume * t.price AS notional, t.k1 % 100 AS fees, 100000 AS cash FROM ticks t JOIN bars b USING (symbol, trade_date)""")


def intents(spark, sf):
    b = views.bars(spark, sf)
    state = F.when((F.col("close") == F.col("high")) & (F.col("trades") > 1), "up").when((F.col("close") == F.col("low")) & (F.col("trades") > 1), "down")
    t = views.ticks(spark, sf).join(b.select("symbol", "trade_date", (F.col("volume") * 0.6).alias("volume_cap"), state.alias("closed_at")), ["symbol", "trade_date"])
    return t.select(F.col("trade_date").alias("day"), "symbol", "k1", "k2", "k3", "k4", F.when(F.col("side") == "R", "sell").otherwise("buy").alias("side"), F.col("volume").alias("quantity"),
                    "price", (F.col("k3") % 40).alias("held"), F.lit(3000000).alias("nav"), "volume_cap", "closed_at", (F.col("k4") % 11 > 0).alias("has_bar"), (F.col("k4") % 13 == 0).alias("halted_next"),
                    (F.col("k1") % 17 == 0).alias("ex_next"), (F.col("k1") % 19 == 0).alias("risky"), (F.col("volume") * F.col("price")).alias("notional"), (F.col("k1") % 100).alias("fees"), F.lit(100000).alias("cash"))


@query("pre_trade_checks", "C1", oracle("intents", """
WITH g AS (SELECT *, sum(CASE WHEN side = 'buy' THEN notional + fees ELSE 0 END) OVER (PARTITION BY day, symbol) AS buys, sum(CASE WHEN side = 'sell' THEN notional - fees ELSE 0 END) OVER (PARTITION BY day, symbol) AS sells, (held + quantity) * price / nav::DOUBLE AS after FROM intents),
r AS (SELECT *, CASE WHEN (side = 'buy' AND closed_at = 'up') OR (side = 'sell' AND closed_at = 'down') THEN 1 END AS R1, CASE WHEN NOT has_bar OR halted_next THEN CASE WHEN side = 'buy' THEN 2 ELSE 1 END END AS R2, CASE WHEN ex_next THEN 1 END AS R3,
 CASE WHEN quantity > volume_cap THEN 1 END AS R4, CASE WHEN side = 'buy' AND after > 0.03 * 1.5::DOUBLE THEN 2 WHEN side = 'buy' AND after > 0.03 * 1.05::DOUBLE THEN 1 END AS R5, CASE WHEN side = 'buy' AND buys > cash + sells THEN 2 END AS R6, CASE WHEN side = 'buy' AND risky THEN 2 END AS R7 FROM g)
SELECT day, symbol, k1, k2, k3, k4, R1, R2, R3, R4, R5, R6, R7, ['pass', 'warn', 'reject'][greatest(coalesce(R1, 0), coalesce(R2, 0), coalesce(R3, 0), coalesce(R4, 0), coalesce(R5, 0), coalesce(R6, 0), coalesce(R7, 0)) + 1] AS severity FROM r"""))
def pre_trade_checks(spark, sf):
    out = accounts.check_intents(intents(spark, sf), ["day", "symbol"], 0.03)
    return out.select("day", "symbol", "k1", "k2", "k3", "k4", *[f"R{i}" for i in range(1, 8)], "severity")


@query("industry_limit_checks", "C2", oracle("targets classes members", """
WITH w AS (SELECT idx, industry, sum(weight) AS weight FROM targets JOIN classes USING (symbol) GROUP BY 1, 2), b AS (SELECT idx, industry, sum(b) AS benchmark FROM (SELECT m.idx, c.industry, 1.0::DOUBLE / count(*) OVER (PARTITION BY m.idx) AS b FROM members m JOIN classes c USING (symbol) WHERE m.in_universe) GROUP BY 1, 2),
a AS (SELECT idx, industry, coalesce(weight, 0) - coalesce(benchmark, 0) AS active FROM w FULL JOIN b USING (idx, industry))
SELECT idx, industry, round(active, 6) AS active, CASE WHEN active > 0.2 THEN 'reject' WHEN active > 0.1 THEN 'warn' WHEN -active > 0.1 THEN 'under' ELSE 'pass' END AS verdict FROM a"""))
def industry_limit_checks(spark, sf):
    weights = targets(spark, sf).join(classes(spark, sf), "symbol")
    size = F.count("*").over(Window.partitionBy("idx"))
    bench = members(spark, sf).withColumn("b", 1.0 / size).groupBy("idx", "industry").agg(F.sum("b").alias("benchmark"))
    return rounded(accounts.industry_limits(weights, bench, ["idx"], 0.1).select("idx", "industry", "active", "verdict"), "active")


define("alert_rows", "ruled", """
SELECT symbol, idx, trade_date AS day, risk, lag(risk) OVER w AS risk_before, CASE WHEN lead(risk) OVER w = 'risk_warning' AND risk <> 'risk_warning' THEN 'risk_warning' END AS risk_next, has_bar, NOT coalesce(lead(has_bar) OVER w, true) AS halted_next,
 coalesce(lead(hfq) OVER w <> hfq, false) AS ex_next, CASE WHEN close <= down THEN 'down' WHEN close >= up THEN 'up' END AS closed_at, close / reference - 1 AS change, day(trade_date) = 15 AS report FROM ruled WINDOW w AS (PARTITION BY symbol ORDER BY idx)""")


@query("holding_alerts", "C3", oracle("alert_rows", """
WITH a AS (SELECT symbol, idx, [CASE WHEN risk IS DISTINCT FROM risk_before THEN 'M1' END, CASE WHEN risk_next IS NOT NULL THEN 'M2' END, CASE WHEN NOT has_bar THEN 'M3' END, CASE WHEN halted_next THEN 'M4' END, CASE WHEN ex_next THEN 'M5' END,
 CASE WHEN has_bar AND closed_at = 'down' THEN 'M6' END, CASE WHEN has_bar AND NOT coalesce(closed_at = 'down', false) AND change <= -0.07 THEN 'M7' END, CASE WHEN risk = 'delisting_period' THEN 'M8' END, CASE WHEN report THEN 'M10' END] AS l FROM alert_rows),
x AS (SELECT symbol, idx, unnest(list_filter(l, lambda v: v IS NOT NULL)) AS rule FROM a)
SELECT rule, CASE WHEN rule IN ('M3', 'M5', 'M10') THEN 'info' WHEN rule = 'M8' THEN 'critical' ELSE 'warning' END AS level, symbol, count(*) AS alerts, CAST(sum(idx) AS BIGINT) AS check_sum FROM x GROUP BY 1, 2, 3"""))
def holding_alerts(spark, sf):
    w = windows.series("symbol", "idx")
    rows = rules.open_state(ruled(spark, sf)).withColumns({
        "day": F.col("trade_date"), "risk_before": F.lag("risk").over(w),
        "risk_next": F.when((F.lead("risk").over(w) == "risk_warning") & (F.col("risk") != "risk_warning"), "risk_warning"),
        "halted_next": ~F.coalesce(F.lead("has_bar").over(w), F.lit(True)), "ex_next": F.coalesce(F.lead("hfq").over(w) != F.col("hfq"), F.lit(False)),
        "closed_at": F.when(F.col("close") <= F.col("down"), "down").when(F.col("close") >= F.col("up"), "up"),
        "change": F.col("close") / F.col("reference") - 1, "report": F.day("trade_date") == 15, "delist_date": F.lit(None).cast("date")})
    out = accounts.holding_alerts(rows, ["symbol", "idx"])
    return out.groupBy("rule", "level", "symbol").agg(F.count("*").alias("alerts"), F.sum("idx").alias("check_sum"))


@query("drift_alerts", "C3 P20", oracle("target_log", """
WITH b AS (SELECT row + 1 AS row, symbol, weight FROM target_log), d AS (SELECT coalesce(n.row, b.row) AS row, sum(abs(coalesce(n.weight, 0) - coalesce(b.weight, 0))) / 2 AS drift FROM target_log n FULL JOIN b ON b.row = n.row AND b.symbol = n.symbol WHERE coalesce(n.row, b.row) <= (SELECT max(row) FROM target_log) GROUP BY 1)
SELECT row, 'M9' AS rule, 'info' AS level FROM d WHERE drift > 0.6"""))
def drift_alerts(spark, sf):
    from .queries_portfolio import target_log
    return accounts.drift_alerts(perf.rebalance_log(target_log(spark, sf)), ["row"], 0.6)


ITEM = """SELECT o_orderkey AS symbol, o_orderkey % 10 = 0 AS archived, CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0 END::DOUBLE AS weight, CASE WHEN o_orderkey % 3 = 0 THEN 'waiting' ELSE 'void' END AS buyback, o_orderkey % 2 = 0 AS sold, CASE WHEN o_orderkey % 7 = 0 THEN 'exhausted' ELSE 'active' END AS phase,
 CASE o_orderkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'base' WHEN 2 THEN 'right' ELSE 'top' END AS label, CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS priority, o_totalprice / 2e6 AS distance, o_orderkey % 3 AS star, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice / 5000 END AS quality, (o_orderkey % 21 - 10) / 100.0::DOUBLE AS completion_change FROM orders"""


def items(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    label = F.when(k % 4 == 0, "left").when(k % 4 == 1, "base").when(k % 4 == 2, "right").otherwise("top")
    return o.select(k.alias("symbol"), (k % 10 == 0).alias("archived"), F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.0).alias("weight"), F.when(k % 3 == 0, "waiting").otherwise("void").alias("buyback"),
                    (k % 2 == 0).alias("sold"), F.when(k % 7 == 0, "exhausted").otherwise("active").alias("phase"), label.alias("label"), F.when(k % 50 == 0, (k % 5).cast("int")).alias("priority"),
                    (F.col("o_totalprice") / 2e6).alias("distance"), (k % 3).alias("star"), F.when(k % 6 > 0, F.col("o_totalprice") / 5000).alias("quality"), ((k % 21 - 10) / 100.0).alias("completion_change"))


@query("item_pools", "C4", f"""
SELECT symbol, CASE WHEN archived THEN 'archived' WHEN weight > 0 THEN 'hold' WHEN buyback = 'waiting' AND (sold OR phase = 'exhausted') THEN 'buyback' WHEN phase <> 'exhausted' AND label IN ('right', 'base') THEN 'ready' ELSE 'watch' END AS pool FROM ({ITEM})""")
def item_pools(spark, sf):
    rows = items(spark, sf)
    return rows.select("symbol", accounts.pools(rows).alias("pool"))


@query("report_tiers", "C4", f"""
WITH t AS (SELECT *, CASE WHEN priority IS NOT NULL THEN 1 WHEN distance <= 0.03 THEN 2 WHEN distance <= 0.08 THEN 3 WHEN abs(completion_change) >= 0.05 THEN 4 ELSE 5 END AS tier FROM ({ITEM}))
SELECT symbol, tier, row_number() OVER (PARTITION BY tier ORDER BY coalesce(priority, 9), star DESC, coalesce(quality, -1) DESC, coalesce(distance, 9), symbol) AS place FROM t""")
def report_tiers(spark, sf):
    return accounts.report_tiers(items(spark, sf)).select("symbol", "tier", "place")


@query("watched_reminders", "C6 B8 G9", oracle("crowding listings", """
WITH m AS (SELECT code, idx, c, lag(c) OVER (PARTITION BY code ORDER BY idx) AS p FROM crowding), e AS (SELECT code, idx FROM m WHERE c > 1.4 AND NOT coalesce(p > 1.4, false))
SELECT code, idx FROM e WHERE code IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))"""))
def watched_reminders(spark, sf):
    from ..operators import flows
    from .queries_structure import crowding
    watched = read_table(spark, sf, "nation").filter("n_regionkey in (1, 2)").select(F.col("n_name").alias("code"))
    events = flows.crossings(crowding(spark, sf), high=1.4, low=1.1).filter("event = 'crowded'")
    return events.join(watched, "code", "left_semi").select("code", "idx")


@query("quality_grades", "H5", oracle("funds", """
WITH l AS (SELECT symbol, idx, total_mcap / nullif(ni_ttm, 0) AS pe, ni_sq_yoy AS g, rev_sq_yoy AS r, ni_ttm / nullif(avg_book, 0) AS roe, gross_profit_ttm / nullif(revenue_ttm, 0) * 100 AS m, lag(gross_profit_ttm / nullif(revenue_ttm, 0) * 100, 244) OVER (PARTITION BY symbol ORDER BY idx) AS m0 FROM funds),
s AS (SELECT symbol, idx, CASE WHEN pe IS NULL OR g IS NULL THEN NULL WHEN NOT (pe > 0 AND g > 0) THEN 15 WHEN pe / (g * 100) < 0.5 THEN 100 WHEN pe / (g * 100) < 1 THEN 80 WHEN pe / (g * 100) < 1.5 THEN 60 WHEN pe / (g * 100) < 2.5 THEN 40 ELSE 15 END AS a,
 CASE WHEN r IS NULL THEN NULL WHEN r >= 0.3 THEN 100 WHEN r >= 0.15 THEN 80 WHEN r >= 0.05 THEN 60 WHEN r >= 0 THEN 45 WHEN r >= -0.2 THEN 25 ELSE 10 END AS b, CASE WHEN g IS NULL THEN NULL WHEN g >= 0.3 THEN 100 WHEN g >= 0.15 THEN 80 WHEN g >= 0.05 THEN 60 WHEN g >= 0 THEN 45 WHEN g >= -0.2 THEN 25 ELSE 10 END AS c,
 CASE WHEN roe IS NULL THEN NULL WHEN roe >= 0.2 THEN 100 WHEN roe >= 0.15 THEN 85 WHEN roe >= 0.1 THEN 70 WHEN roe >= 0.05 THEN 50 WHEN roe >= 0 THEN 30 ELSE 10 END AS d, CASE WHEN m - m0 IS NULL THEN NULL WHEN m - m0 >= 3 THEN 100 WHEN m - m0 >= 1 THEN 80 WHEN m - m0 >= -1 THEN 60 WHEN m - m0 >= -3 THEN 40 ELSE 20 END AS e,
 ['预增', '扭亏', '略增', '续盈', '减亏', '不确定', '略减', '预减', '首亏', '续亏', '增亏', 'x'][idx % 12 + 1] AS w FROM l),
f AS (SELECT symbol, idx, list_filter([a, b, c, d, e, CASE w WHEN '预增' THEN 100 WHEN '扭亏' THEN 100 WHEN '略增' THEN 75 WHEN '续盈' THEN 75 WHEN '减亏' THEN 60 WHEN '不确定' THEN 50 WHEN '略减' THEN 30 WHEN 'x' THEN NULL ELSE 10 END], lambda v: v IS NOT NULL) AS v FROM s),
g AS (SELECT symbol, idx, CASE WHEN len(v) >= 3 THEN list_sum(v) / len(v)::DOUBLE END AS score FROM f)
SELECT symbol, idx, round(score, 4) AS score, CASE WHEN score IS NULL THEN NULL WHEN score >= 75 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM g"""))
def quality_grades(spark, sf):
    f = views.factor_inputs(spark, sf, True)
    margin = F.col("gross_profit_ttm") / F.nullif(F.col("revenue_ttm"), F.lit(0.0)) * 100
    words = F.array(*[F.lit(w) for w in [*accounts.FORECAST_SCORES, "x"]])
    rows = f.withColumn("margin", margin).select(
        "symbol", "idx", (F.col("total_mcap") / F.nullif(F.col("ni_ttm"), F.lit(0.0))).alias("pe"), F.col("ni_sq_yoy").alias("profit_growth"), F.col("rev_sq_yoy").alias("revenue_growth"),
        (F.col("ni_ttm") / F.nullif(F.col("avg_book"), F.lit(0.0))).alias("roe"), (F.col("margin") - windows.lag_n("margin", 244)).alias("margin_change"),
        F.element_at(words, (F.col("idx") % 12 + 1).cast("int")).alias("forecast"))
    return accounts.quality_grade(rows).select("symbol", "idx", F.round("score", 4).alias("score"), "grade")


# -- market pages -----------------------------------------------------------------------------

@query("chart_marks", "M6", oracle("facts dividend_cash", """
SELECT symbol, 'report' AS kind, min(notice_date) AS day FROM facts WHERE statement = 'income' GROUP BY symbol, report_date UNION ALL SELECT symbol, 'dividend', trade_date FROM dividend_cash"""))
def chart_marks(spark, sf):
    reports = views.statements(spark, sf).filter("statement = 'income'").groupBy("symbol", "report_date").agg(F.min("notice_date").alias("day"))
    days = views.calendar(spark, sf)
    paid = asof.next_session(views.dividends(views.bars(spark, sf)).filter("cash_per_10 > 0"), days, "ex_date", inclusive=True, out="idx").join(days, "idx")
    return reports.select("symbol", F.lit("report").alias("kind"), "day").unionByName(paid.select("symbol", F.lit("dividend").alias("kind"), F.col("trade_date").alias("day")))


HOLDER_SERIES = """SELECT symbol, last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + INTERVAL 2 MONTH) AS end_date, CASE WHEN sum(volume) % 4 > 0 THEN sum(volume)::DOUBLE END AS holders FROM bars GROUP BY 1, 2"""


@query("holder_count_series", "M7", oracle("bars", f"""
WITH h AS ({HOLDER_SERIES}) SELECT symbol, end_date, holders, round(holders / last_value(holders IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 6) + 0.0::DOUBLE AS change FROM h"""))
def holder_count_series(spark, sf):
    rows = views.holder_counts(views.bars(spark, sf)).select("symbol", "end_date", F.when(F.col("holders") % 4 > 0, F.col("holders").cast("double")).alias("holders"))
    before = F.last("holders", True).over(windows.before(None, "symbol", "end_date"))
    return rounded(rows.withColumn("change", F.col("holders") / before - 1), "change")


@query("dividend_plans", "M8", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS ex_date, round(sum(o_totalprice), 2) AS cash, min(o_orderpriority) AS note FROM orders GROUP BY 1, 2""")
def dividend_plans(spark, sf):
    return read_table(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("ex_date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("cash"), F.min("o_orderpriority").alias("note"))


def actions(spark, sf):
    """Orders as announced plans of a symbol, with the latest capitalisation."""
    o = read_table(spark, sf, "orders")
    last = inputs(spark, sf).groupBy("symbol").agg(F.max_by("total_mcap", F.when(F.col("total_mcap").isNotNull(), F.col("idx"))).alias("cap"),
                                                   F.max_by("close_last", "idx").alias("close"))
    rows = o.select("o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("day"),
                    F.when(F.col("o_orderstatus") == "F", "buyback").when(F.col("o_orderstatus") == "O", "increase").otherwise("reduce").alias("direction"),
                    F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("amount"), (F.col("o_orderkey") % 1000 + 1).alias("shares"))
    return rows.join(last, "symbol").join(classes(spark, sf), "symbol").withColumns({
        "amount": F.coalesce("amount", F.col("shares") * F.col("close")), "avg_paid": F.when(F.col("o_orderkey") % 5 > 0, F.col("amount") / F.col("shares"))})


define("actions", "inputs classes", """
WITH l AS (SELECT symbol, arg_max(total_mcap, idx) FILTER (total_mcap IS NOT NULL) AS cap, arg_max(close_last, idx) AS close FROM inputs GROUP BY 1),
o AS (SELECT o_orderkey, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'buyback' WHEN 'O' THEN 'increase' ELSE 'reduce' END AS direction, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS a, o_orderkey % 1000 + 1 AS shares FROM orders)
SELECT o_orderkey, symbol, day, direction, coalesce(a, shares * close) AS amount, shares, cap, close, industry, CASE WHEN o_orderkey % 5 > 0 THEN a / shares END AS avg_paid FROM o JOIN l USING (symbol) JOIN classes USING (symbol)""")


@query("corporate_actions_enriched", "M9", oracle("actions", """
SELECT o_orderkey, symbol, direction, round(amount, 2) AS amount, round(amount / cap * 1e6, 6) AS ppm_of_cap, round(close / avg_paid - 1, 6) AS close_vs_paid FROM actions"""))
def corporate_actions_enriched(spark, sf):
    return actions(spark, sf).select("o_orderkey", "symbol", "direction", F.round("amount", 2).alias("amount"), r6(F.col("amount") / F.col("cap") * 1e6).alias("ppm_of_cap"),
                                     r6(F.col("close") / F.col("avg_paid") - 1).alias("close_vs_paid"))


@query("corporate_action_list", "M10", oracle("actions", """
SELECT o_orderkey, symbol, day, direction FROM actions WHERE day BETWEEN DATE '2001-03-01' AND DATE '2001-06-30' AND direction <> 'reduce' AND industry = 'LARGE' AND amount / cap >= 1e-7 ORDER BY day DESC, o_orderkey"""))
def corporate_action_list(spark, sf):
    a = actions(spark, sf)
    days = F.col("day").between(F.to_date(F.lit("2001-03-01")), F.to_date(F.lit("2001-06-30")))
    return a.filter(days & (F.col("direction") != "reduce") & (F.col("industry") == "LARGE") & (F.col("amount") / F.col("cap") >= 1e-7)).orderBy(
        F.desc("day"), "o_orderkey").select("o_orderkey", "symbol", "day", "direction")


@query("action_industry_summary", "M11", oracle("actions", """
SELECT industry, """ + ", ".join(f"count(DISTINCT symbol) FILTER (direction = '{d}') AS {d}_names, round(sum(amount) FILTER (direction = '{d}'), 2) AS {d}_amount" for d in ("buyback", "increase", "reduce")) + " FROM actions GROUP BY 1"))
def action_industry_summary(spark, sf):
    aggs = []
    for d in ("buyback", "increase", "reduce"):
        hit = F.col("direction") == d
        aggs += [F.countDistinct(F.when(hit, F.col("symbol"))).alias(f"{d}_names"), F.round(F.sum(F.when(hit, F.col("amount"))), 2).alias(f"{d}_amount")]
    return actions(spark, sf).groupBy("industry").agg(*aggs)


@query("action_tags", "M12", oracle("actions", """
SELECT symbol, bool_or(direction IN ('buyback', 'increase')) AS buying, bool_or(direction = 'reduce') AS reducing FROM actions WHERE day > (SELECT max(day) - 90 FROM actions) GROUP BY 1"""))
def action_tags(spark, sf):
    a = actions(spark, sf)
    recent = a.filter(F.col("day") > a.agg(F.date_sub(F.max("day"), 90)).scalar())
    return recent.groupBy("symbol").agg(F.bool_or(F.col("direction").isin("buyback", "increase")).alias("buying"), F.bool_or(F.col("direction") == "reduce").alias("reducing"))


@query("signal_history", "M16", oracle("targets composite", """
SELECT symbol, idx, place, round(weight, 6) AS weight, round(score, 6) + 0.0::DOUBLE AS score, n FROM (SELECT t.*, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS n FROM targets t) WHERE n <= 24"""))
def signal_history(spark, sf):
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("idx")))
    return rounded(targets(spark, sf).withColumn("n", n).filter("n <= 24").select("symbol", "idx", "place", "weight", "score", "n"), "weight", "score")


@query("monitor_readback", "M17", """
SELECT event_type AS group_id, max(ts) AS last_ts, round(arg_max(value, ts), 2) AS last_value, count(*) FILTER (value > 100) AS alerts FROM events GROUP BY 1""")
def monitor_readback(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("group_id")).agg(
        F.max("ts").alias("last_ts"), F.round(F.max_by("value", "ts"), 2).alias("last_value"), F.count_if(F.col("value") > 100).alias("alerts"))
