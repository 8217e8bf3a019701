"""The account ledger in batch and as a stream, and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import accounts, asof, ledger, market
from ..sources.io import read_table
from ..streaming import jobs, state
from . import views
from .ctes import define, oracle
from .registry import query

# Events that the orders and line items stand for: every order pays in three fifths of its price, its lines are fills at the
# line's price with fees; urgent and other orders bring corporate actions, corrections, withdrawals and delistings.
define("ledger_events", "ticks", """
WITH o AS (SELECT o_orderkey, o_custkey AS account, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, o_totalprice AS price, o_orderpriority[1:1] AS priority FROM orders),
l AS (SELECT o.*, t.symbol, t.trade_date, t.k1, t.k2, t.side, t.volume, t.price AS unit, t.volume * t.price AS notional FROM ticks t JOIN o ON o.o_orderkey = t.k1),
e AS (
 SELECT account, 'D' || o_orderkey AS event_id, day, 'deposit' AS kind, '' AS symbol, 0 AS shares, CAST(floor(price * 60) AS BIGINT) AS amount, 0 AS fees, 0 AS step_milli, -1 AS expected FROM o
 UNION ALL SELECT account, 'T' || k1 || '-' || k2, trade_date, CASE WHEN side = 'R' THEN 'sell' ELSE 'buy' END, symbol, volume, notional,
  greatest(500, (notional * 250 + 500000) // 1000000) + CASE WHEN side = 'R' THEN (notional * 500 + 500000) // 1000000 ELSE 0 END, 0, -1 FROM l
 UNION ALL SELECT account, 'A' || k1 || '-' || k2, trade_date + 60, 'adjust', symbol, 0, unit, 0, 1100 + 50 * volume, -1 FROM l WHERE priority = '5'
 UNION ALL SELECT account, 'X' || k1 || '-' || k2, trade_date + 120, 'delist', symbol, 0, unit, 0, 0, -1 FROM l WHERE status = 'P' AND k2 = 1
 UNION ALL SELECT account, 'C' || k1 || '-' || k2, trade_date + 30, 'correct', symbol, 100, 100 * unit, 0, 0, CASE WHEN side = 'N' THEN -1 ELSE volume END FROM l WHERE priority = '4' AND k2 = 2
 UNION ALL SELECT account, 'W' || o_orderkey, day + 10, 'cash', '', 0, -CAST(floor(price * 30) AS BIGINT), 0, 0, -1 FROM o WHERE priority = '3')
SELECT account, event_id, day, CAST(list_position(['deposit', 'adjust', 'buy', 'sell', 'correct', 'cash', 'delist'], kind) AS BIGINT) AS seq, kind, symbol,
 CAST(shares AS BIGINT) AS shares, CAST(amount AS BIGINT) AS amount, CAST(fees AS BIGINT) AS fees, CAST(step_milli AS BIGINT) AS step_milli, CAST(expected AS BIGINT) AS expected FROM e""")

define("ledger", "ledger_events", """
WITH RECURSIVE e AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY account ORDER BY day, seq, event_id, symbol, shares, amount) AS n,
  row_number() OVER (PARTITION BY account, event_id ORDER BY day, seq, symbol, shares, amount) > 1 AS again FROM ledger_events),
f AS (
 SELECT DISTINCT account, 0::BIGINT AS n, 0::BIGINT AS cash, MAP([]::VARCHAR[], []::STRUCT(q BIGINT, s BIGINT, c BIGINT, d DATE)[]) AS held,
  '' AS event_id, NULL::DATE AS day, '' AS kind, '' AS symbol, '' AS verdict, 0::BIGINT AS quantity, 0::BIGINT AS sellable, 0::BIGINT AS cost FROM e
 UNION ALL
 SELECT account, n, CASE WHEN verdict = 'ok' THEN new.m ELSE cash END,
  CASE WHEN verdict = 'ok' AND symbol <> '' THEN map_concat(held, MAP([symbol], [struct_pack(q := new.q, s := new.s, c := new.c, d := day)])) ELSE held END,
  event_id, day, kind, symbol, verdict, CASE WHEN verdict = 'ok' THEN new.q ELSE q END, CASE WHEN verdict = 'ok' THEN new.s ELSE s END, CASE WHEN verdict = 'ok' THEN new.c ELSE c END
 FROM (SELECT *, CASE kind
   WHEN 'buy' THEN struct_pack(m := cash - amount - fees, q := q + shares, s := s, c := c + amount + fees)
   WHEN 'sell' THEN struct_pack(m := cash + amount - fees, q := q - shares, s := s - shares, c := CASE WHEN q > 0 THEN c * (q - shares) // q ELSE 0 END)
   WHEN 'adjust' THEN struct_pack(m := cash + (q * step_milli % 1000) * amount // 1000, q := q * step_milli // 1000,
    s := CASE WHEN s = q THEN q * step_milli // 1000 ELSE least(q * step_milli // 1000, s * step_milli // 1000) END, c := CASE WHEN q * step_milli // 1000 > 0 THEN c ELSE 0 END)
   WHEN 'delist' THEN struct_pack(m := cash + q * amount, q := 0::BIGINT, s := 0::BIGINT, c := 0::BIGINT)
   WHEN 'correct' THEN struct_pack(m := cash, q := shares, s := shares, c := CASE WHEN shares > 0 THEN amount ELSE 0 END)
   ELSE struct_pack(m := cash + amount, q := q, s := s, c := c) END AS new
  FROM (SELECT *, CASE WHEN again THEN 'duplicate'
    WHEN kind IN ('adjust', 'delist') AND q = 0 THEN 'mismatch' WHEN kind IN ('adjust', 'delist', 'correct') AND expected >= 0 AND expected <> q THEN 'mismatch'
    WHEN kind IN ('buy', 'sell') AND (shares <= 0 OR amount <= 0 OR fees < 0) THEN 'invalid' WHEN kind = 'buy' AND cash < amount + fees THEN 'no_cash'
    WHEN kind = 'sell' AND shares > s THEN 'not_sellable' WHEN kind = 'deposit' AND amount <= 0 THEN 'invalid' WHEN kind = 'cash' AND cash + amount < 0 THEN 'no_cash' ELSE 'ok' END AS verdict
   FROM (SELECT e.*, f.cash, f.held, coalesce(f.held[e.symbol].q, 0) AS q, coalesce(f.held[e.symbol].c, 0) AS c,
     CASE WHEN f.held[e.symbol].d = e.day THEN f.held[e.symbol].s ELSE coalesce(f.held[e.symbol].q, 0) END AS s
    FROM f JOIN e ON e.account = f.account AND e.n = f.n + 1))))
SELECT account, event_id, day, kind, symbol, verdict, cash, quantity, sellable, cost, n FROM f WHERE n > 0""")


def events_from(items: DataFrame, orders: DataFrame, parts: DataFrame) -> DataFrame:
    """Ledger events of line items and of the orders, which may be a stream together with static tables."""
    zero, any_holding = F.lit(0).cast("long"), F.lit(-1).cast("long")
    o = orders.select("o_orderkey", F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("o_day"), F.col("o_orderstatus").alias("status"),
                      F.col("o_totalprice").alias("total"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    unit = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("long")
    lines = (items.join(parts.select("p_partkey", F.col("p_brand").alias("symbol")), F.col("l_partkey") == F.col("p_partkey"))
             .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
             .withColumns({"unit": unit, "volume": F.col("l_quantity").cast("long"), "t_day": F.to_date("l_shipdate"),
                           "no": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))}))
    sells, notional = F.col("l_returnflag") == "R", F.col("volume") * F.col("unit")
    ppm = lambda rate: F.expr(f"(volume * unit * {rate} + 500000) div 1000000")
    fees = F.greatest(F.lit(500).cast("long"), ppm(250)) + F.when(sells, ppm(500)).otherwise(zero)

    def event(kind: Column | str, letter: str, when: Column, shares: Column = zero, amount: Column = zero, fee: Column = zero, step: Column = zero,
              expected: Column = any_holding) -> Column:
        return F.struct(F.concat(F.lit(letter), F.col("no")).alias("event_id"), when.alias("day"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
                        shares.alias("shares"), amount.alias("amount"), fee.alias("fees"), step.alias("step_milli"), expected.alias("expected"))

    later = lambda n: F.date_add("t_day", n)
    some = lambda cond, e: F.when(cond, e)
    from_lines = F.array(
        event(F.when(sells, "sell").otherwise("buy"), "T", F.col("t_day"), F.col("volume"), notional, fees),
        some(F.col("priority") == "5", event("adjust", "A", later(60), amount=F.col("unit"), step=1100 + 50 * F.col("volume"))),
        some((F.col("status") == "P") & (F.col("l_linenumber") == 1), event("delist", "X", later(120), amount=F.col("unit"))),
        some((F.col("priority") == "4") & (F.col("l_linenumber") == 2), event(
            "correct", "C", later(30), F.lit(100).cast("long"), 100 * F.col("unit"),
            expected=F.when(F.col("l_returnflag") == "N", any_holding).otherwise(F.col("volume")))))
    found = lines.select("account", "symbol", F.explode(from_lines).alias("e")).filter("e IS NOT NULL").select("account", "symbol", "e.*")
    return _placed(found)


def order_events(orders: DataFrame) -> DataFrame:
    """Deposits and withdrawals of the orders."""
    zero, total = F.lit(0).cast("long"), F.col("o_totalprice")
    row = lambda letter, kind, day, amount: F.struct(
        F.concat(F.lit(letter), F.col("o_orderkey").cast("string")).alias("event_id"), day.alias("day"), F.lit(kind).alias("kind"), amount.cast("long").alias("amount"))
    both = F.array(row("D", "deposit", F.to_date("o_orderdate"), F.floor(total * 60)),
                   F.when(F.substring("o_orderpriority", 1, 1) == "3", row("W", "cash", F.date_add(F.to_date("o_orderdate"), 10), -F.floor(total * 30))))
    found = orders.select(F.col("o_custkey").alias("account"), F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("account", "e.*")
    return _placed(found.withColumns({"symbol": F.lit(""), "shares": zero, "fees": zero, "step_milli": zero, "expected": F.lit(-1).cast("long")}))


def _placed(rows: DataFrame) -> DataFrame:
    seq = F.array_position(F.array(*[F.lit(k) for k in ledger.KINDS]), F.col("kind"))
    return rows.withColumn("seq", seq).select(*ledger.COLUMNS)


def ledger_events(spark, sf):
    orders = read_table(spark, sf, "orders")
    return events_from(read_table(spark, sf, "lineitem"), orders, read_table(spark, sf, "part")).unionByName(order_events(orders))


def folded(spark, sf):
    return ledger.fold(ledger_events(spark, sf))


LEDGER = "account, event_id, day, kind, symbol, verdict, cash, quantity, sellable, cost"


@query("account_ledger", "P18", oracle("ledger", f"SELECT {LEDGER} FROM ledger"))
def account_ledger(spark, sf):
    """Deposits, fills with fees, share adjustments, delistings, corrections and withdrawals, refused without cash."""
    return folded(spark, sf)


@query("ledger_verdicts", "P18", oracle("ledger", "SELECT kind, verdict, count(*) AS events FROM ledger GROUP BY 1, 2"))
def ledger_verdicts(spark, sf):
    return folded(spark, sf).groupBy("kind", "verdict").agg(F.count("*").alias("events"))


@query("ledger_nav", "P19 J12", oracle("ledger bars", """
WITH c AS (SELECT account, arg_max(cash, n) AS cash FROM ledger GROUP BY 1),
h AS (SELECT account, symbol, arg_max(quantity, n) AS quantity, arg_max(cost, n) AS cost FROM ledger WHERE symbol <> '' GROUP BY 1, 2),
p AS (SELECT symbol, arg_max(close, trade_date) AS price FROM bars GROUP BY 1),
v AS (SELECT account, CAST(sum(quantity * price) AS BIGINT) AS value, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS names FROM h JOIN p USING (symbol) WHERE quantity > 0 GROUP BY 1)
SELECT account, cash, coalesce(value, 0) AS value, coalesce(cost, 0) AS cost, coalesce(names, 0) AS names, cash + coalesce(value, 0) AS nav FROM c LEFT JOIN v USING (account)"""))
def ledger_nav(spark, sf):
    cash, held = ledger.closing(ledger.numbered(folded(spark, sf)))
    prices = market.latest_per_key(views.bars(spark, sf), ["symbol"], ["trade_date"], ["close"]).withColumnRenamed("close", "price")
    value = held.join(asof.sent_if_few(prices), "symbol").groupBy("account").agg(
        F.sum(F.col("quantity") * F.col("price")).alias("value"), F.sum("cost").alias("cost"), F.count("*").alias("names"))
    rows = cash.join(value, "account", "left").fillna(0, ["value", "cost", "names"])
    return rows.withColumn("nav", F.col("cash") + F.col("value"))


@query("ledger_pending_actions", "P22", oracle("ledger bars", """
WITH p AS (SELECT symbol, min(trade_date) AS ex_date, CAST(sum(volume) % 7 AS DOUBLE) AS cash_per_10 FROM bars WHERE month(trade_date) = 6 GROUP BY symbol, year(trade_date) HAVING sum(volume) % 7 > 0),
h AS (SELECT account, symbol, day, arg_max(quantity, n) AS quantity FROM ledger WHERE symbol <> '' GROUP BY 1, 2, 3),
x AS (SELECT o.account, p.symbol, p.ex_date, p.cash_per_10 FROM (SELECT DISTINCT account, symbol FROM h) o JOIN p USING (symbol))
SELECT x.account, x.symbol, x.ex_date, x.cash_per_10, h.quantity, CAST(floor(h.quantity * x.cash_per_10 / 10 + 0.5::DOUBLE) AS BIGINT) AS cash
FROM x ASOF JOIN h ON h.account = x.account AND h.symbol = x.symbol AND h.day < x.ex_date WHERE h.quantity > 0"""))
def ledger_pending_actions(spark, sf):
    held = ledger.numbered(folded(spark, sf)).filter("symbol <> '' AND verdict = 'ok'").select(
        "account", "symbol", "day", "quantity", F.col("n").alias("event_id"))
    plans = views.dividends(views.bars(spark, sf)).filter("cash_per_10 > 0").select("symbol", "ex_date", "cash_per_10")
    return accounts.pending_actions(plans, held)


@query("ledger_stream", "ST7 P18", oracle("ledger", f"SELECT {LEDGER} FROM ledger"))
def ledger_stream(spark, sf, files=None):
    """The ledger over event files in any order, each read once; open days are kept in state until the watermark closes them."""
    events = ledger_events(spark, sf)
    folder = jobs.event_files(events, "ledger-events", files)
    days, rows = spark.read.schema(events.schema).parquet(folder).agg(F.datediff(F.max("day"), F.min("day")), F.count("*")).first()
    stream = jobs.files_read(spark, folder, events.schema, files)
    return state.fold_stream(stream, ["account"], ledger.ORDER, ledger.COLUMNS, ledger.SCHEMA, ledger.step, (days or 0) + 1, "ledger", "event_id", rows)
