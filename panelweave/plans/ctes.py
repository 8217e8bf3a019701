"""SQL twins of :mod:`panelweave.plans.views`, used only to check results.

``oracle("bars calendar", body)`` prefixes ``body`` with the named common table
expressions and whatever they depend on.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}


def define(name: str, needs: str, body: str) -> None:
    CTES[name] = (needs, body)


def oracle(needs: str, body: str, once: bool = False) -> str:
    """``body`` behind its definitions; with ``once`` each of them is worked out one time, however often it is read."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in CTES[name][0].split():
            visit(dependency)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    kept = "MATERIALIZED " if once else ""
    parts = ",\n".join(f"{name} AS {kept}({CTES[name][1].strip()})" for name in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


define("ticks", "", """
SELECT p.p_brand AS symbol, CAST(l.l_shipdate AS DATE) AS trade_date,
       l.l_orderkey AS k1, l.l_linenumber AS k2, l.l_partkey AS k3, l.l_suppkey AS k4,
       CAST(floor(l.l_extendedprice * 100 / l.l_quantity + 0.5) AS BIGINT) AS price,
       CAST(l.l_quantity AS BIGINT) AS volume,
       CAST(floor(l.l_extendedprice * 100 + 0.5) AS BIGINT) AS amount,
       l.l_returnflag AS side
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")

define("bars", "ticks", """
SELECT symbol, trade_date,
       arg_min(price, row(k1, k2, k3, k4, price)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, row(k1, k2, k3, k4, price)) AS close,
       CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(amount) AS BIGINT) AS amount,
       count(*) AS trades
FROM ticks GROUP BY symbol, trade_date""")

define("calendar", "", """
SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS idx
FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)""")

define("factors", "bars", """
SELECT symbol, min(trade_date) AS effective_date, 1 + 0.25 * (year(trade_date) - 1995)::DOUBLE AS hfq
FROM bars GROUP BY symbol, year(trade_date)
HAVING (year(trade_date) + length(symbol)) % 2 = 0""")

define("adjusted", "bars factors", """
SELECT b.*, f.hfq, b.close * f.hfq AS hfq_close
FROM bars b ASOF LEFT JOIN factors f ON b.symbol = f.symbol AND b.trade_date >= f.effective_date""")

define("panel", "bars calendar factors", """
SELECT g.symbol, c.idx, c.trade_date, b.open, b.high, b.low, b.close, b.volume, b.amount,
       b.symbol IS NOT NULL AS has_bar, f.hfq,
       b.close * f.hfq AS adj_close,
       last_value(b.close * f.hfq IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY c.idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj_last,
       last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY c.idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_last
FROM (SELECT symbol, min(trade_date) AS first_bar FROM bars GROUP BY symbol) g
JOIN calendar c ON c.trade_date >= g.first_bar
LEFT JOIN bars b ON b.symbol = g.symbol AND b.trade_date = c.trade_date
ASOF LEFT JOIN factors f ON g.symbol = f.symbol AND c.trade_date >= f.effective_date""")

define("returns", "panel", """
SELECT *, adj_close / lag(adj_last) OVER (PARTITION BY symbol ORDER BY idx) - 1 AS ret,
       CASE WHEN has_bar THEN lag(adj_last) OVER (PARTITION BY symbol ORDER BY idx) / hfq END AS ref_close
FROM panel""")

define("share_steps", "bars calendar", """
SELECT symbol, greatest((SELECT min(idx) FROM calendar c WHERE c.trade_date >= e.change_date),
   (SELECT min(idx) FROM calendar c WHERE c.trade_date > e.notice_date)) AS eff, change_date, notice_date, total_shares, float_shares,
   (SELECT min(idx) FROM calendar c WHERE c.trade_date > e.notice_date) AS after_notice
FROM (SELECT symbol, change_date, change_date + CAST((length(symbol) * quarter(q) * 3) % 40 AS INTEGER) AS notice_date,
             1000000 + 500 * v AS total_shares, 900000 + 300 * v AS float_shares
      FROM (SELECT symbol, date_trunc('quarter', trade_date) AS q, min(trade_date) AS change_date,
                   CAST(sum(volume) AS BIGINT) AS v FROM bars GROUP BY 1, 2)) e""")

define("share_last", "share_steps", """
SELECT symbol, eff, arg_max(total_shares, change_date) AS total_shares, arg_max(float_shares, change_date) AS float_shares
FROM share_steps WHERE after_notice IS NOT NULL GROUP BY 1, 2""")

define("inputs", "returns share_last", """
SELECT r.*, s.total_shares, s.float_shares, avg(r.ret) OVER (PARTITION BY r.idx) AS market_ret,
   CASE WHEN s.float_shares > 0 THEN r.volume / s.float_shares END AS turnover_rate,
   r.close_last * s.float_shares AS float_mcap, r.close_last * s.total_shares AS total_mcap
FROM returns r ASOF LEFT JOIN share_last s ON r.symbol = s.symbol AND r.idx >= s.eff""")

define("statements", "ticks", """
WITH q AS (SELECT symbol, last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + INTERVAL 2 MONTH) AS report_date,
  sum(amount) FILTER (volume <= 45) AS rev1, sum(amount) FILTER (volume <= 45 AND side = 'R') AS cost1,
  sum(amount) FILTER (volume <= 45 AND side = 'A') AS gain1, sum(amount) AS rev2, sum(amount) FILTER (side = 'R') AS cost2,
  sum(amount) FILTER (side = 'A') AS gain2, sum(amount) FILTER (side = 'N') AS cash1 FROM ticks GROUP BY ALL),
z AS (SELECT symbol, report_date, coalesce(rev1, 0) AS rev1, coalesce(cost1, 0) AS cost1, coalesce(gain1, 0) AS gain1,
  rev2, coalesce(cost2, 0) AS cost2, coalesce(gain2, 0) AS gain2, coalesce(cash1, 0) AS cash1 FROM q),
y AS (SELECT symbol, report_date, report_date + CAST(25 + (length(symbol) * 7 + quarter(report_date) * 11) % 60 AS INTEGER) AS notice_date,
  sum(rev1) OVER w AS rev1, sum(cost1) OVER w AS cost1, sum(gain1) OVER w AS gain1, sum(rev2) OVER w AS rev2,
  sum(cost2) OVER w AS cost2, sum(gain2) OVER w AS gain2, sum(cash1) OVER w AS cash1,
  5000000 + sum(rev1) OVER e AS assets, sum(cost1) OVER e AS debts
  FROM z WINDOW w AS (PARTITION BY symbol, year(report_date) ORDER BY report_date), e AS (PARTITION BY symbol ORDER BY report_date))
SELECT symbol, 'income' AS statement, report_date, 1 AS version, notice_date, NULL::DATE AS update_date,
  rev1::DOUBLE AS revenue, cost1::DOUBLE AS cost, (gain1 - cost1)::DOUBLE AS ni, (gain1 - cost1 - 1000)::DOUBLE AS dni,
  NULL::DOUBLE AS equity, NULL::DOUBLE AS other, NULL::DOUBLE AS pref, NULL::DOUBLE AS assets, NULL::DOUBLE AS debts, NULL::DOUBLE AS ocf FROM y
UNION ALL BY NAME SELECT symbol, 'income' AS statement, report_date, 2 AS version, notice_date, notice_date + 120 AS update_date,
  rev2::DOUBLE AS revenue, cost2::DOUBLE AS cost, (gain2 - cost2)::DOUBLE AS ni, (gain2 - cost2 - 1000)::DOUBLE AS dni FROM y
  WHERE (year(report_date) + quarter(report_date)) % 3 = 0
UNION ALL BY NAME SELECT symbol, 'balance' AS statement, report_date, 1 AS version, notice_date, (assets - debts)::DOUBLE AS equity,
  CASE WHEN quarter(report_date) % 2 = 0 THEN 1000::DOUBLE END AS other, 500::DOUBLE AS pref, assets::DOUBLE AS assets, debts::DOUBLE AS debts FROM y
UNION ALL BY NAME SELECT symbol, 'cashflow' AS statement, report_date, 1 AS version, notice_date + 3 AS notice_date, cash1::DOUBLE AS ocf FROM y""")

define("facts", "statements calendar", """
SELECT *, (SELECT min(idx) FROM calendar c WHERE c.trade_date > a.available) AS eff,
  year(report_date) * 4 + quarter(report_date) - 1 AS q
FROM (SELECT *, CASE WHEN version >= 2 THEN greatest(notice_date, coalesce(update_date, notice_date)) ELSE notice_date END AS available
      FROM statements) a""")

# State after each batch: for every (symbol, eff) the last version of each (statement, quarter).
define("known_facts", "facts", """
SELECT * FROM (SELECT e.symbol, e.eff, f.statement, f.q, f.revenue, f.cost, f.ni, f.dni, f.ocf, f.assets, f.debts,
   f.equity - coalesce(f.other, coalesce(f.pref, 0)) AS book,
   row_number() OVER (PARTITION BY e.symbol, e.eff, f.statement, f.q ORDER BY f.eff DESC, f.version DESC) AS rn
 FROM (SELECT DISTINCT symbol, eff FROM facts WHERE eff IS NOT NULL) e
 JOIN facts f ON f.symbol = e.symbol AND f.eff <= e.eff) WHERE rn = 1""")

define("steps", "known_facts", """
WITH i AS (SELECT * FROM known_facts WHERE statement = 'income'), b AS (SELECT * FROM known_facts WHERE statement = 'balance'),
 f AS (SELECT * FROM known_facts WHERE statement = 'cashflow'),
it AS (SELECT a.symbol, a.eff, a.q,
   CASE WHEN a.q % 4 = 3 THEN a.ni ELSE a.ni + y.ni - p.ni END AS ni_ttm,
   CASE WHEN a.q % 4 = 3 THEN a.dni ELSE a.dni + y.dni - p.dni END AS dni_ttm,
   CASE WHEN a.q % 4 = 3 THEN a.revenue ELSE a.revenue + y.revenue - p.revenue END AS revenue_ttm,
   CASE WHEN a.q % 4 = 3 THEN a.revenue - a.cost ELSE a.revenue + y.revenue - p.revenue - (a.cost + y.cost - p.cost) END AS gross_profit_ttm,
   CASE WHEN a.q % 4 = 0 THEN a.ni ELSE a.ni - l.ni END AS sq_ni, CASE WHEN a.q % 4 = 0 THEN p.ni ELSE p.ni - pl.ni END AS sq_ni0,
   CASE WHEN a.q % 4 = 0 THEN a.revenue ELSE a.revenue - l.revenue END AS sq_rev, CASE WHEN a.q % 4 = 0 THEN p.revenue ELSE p.revenue - pl.revenue END AS sq_rev0,
   CASE WHEN a.q % 4 = 0 THEN a.dni ELSE a.dni - l.dni END AS sq_dni, CASE WHEN a.q % 4 = 0 THEN p.dni ELSE p.dni - pl.dni END AS sq_dni0,
   row_number() OVER (PARTITION BY a.symbol, a.eff ORDER BY a.q DESC) AS age
 FROM i a LEFT JOIN i y ON y.symbol = a.symbol AND y.eff = a.eff AND y.q = a.q - a.q % 4 - 1
 LEFT JOIN i p ON p.symbol = a.symbol AND p.eff = a.eff AND p.q = a.q - 4
 LEFT JOIN i l ON l.symbol = a.symbol AND l.eff = a.eff AND l.q = a.q - 1
 LEFT JOIN i pl ON pl.symbol = a.symbol AND pl.eff = a.eff AND pl.q = a.q - 5),
i1 AS (SELECT symbol, eff, arg_max(q, q) AS q, arg_max(ni_ttm, q) AS ni_ttm, arg_max(dni_ttm, q) AS dni_ttm, arg_max(revenue_ttm, q) AS revenue_ttm,
   arg_max(gross_profit_ttm, q) AS gross_profit_ttm FROM it WHERE age <= 4 AND ni_ttm IS NOT NULL GROUP BY 1, 2),
i2 AS (SELECT * FROM it WHERE age = 1),
b1 AS (SELECT a.symbol, a.eff, a.q, a.book, a.assets, a.debts, coalesce((a.book + p.book) / 2, a.book) AS avg_book,
   coalesce((a.assets + p.assets) / 2, a.assets) AS avg_assets FROM b a LEFT JOIN b p ON p.symbol = a.symbol AND p.eff = a.eff AND p.q = a.q - 4
   QUALIFY row_number() OVER (PARTITION BY a.symbol, a.eff ORDER BY a.q DESC) = 1),
ft AS (SELECT a.symbol, a.eff, a.q, CASE WHEN a.q % 4 = 3 THEN a.ocf ELSE a.ocf + y.ocf - p.ocf END AS ocf_ttm,
   row_number() OVER (PARTITION BY a.symbol, a.eff ORDER BY a.q DESC) AS age
 FROM f a LEFT JOIN f y ON y.symbol = a.symbol AND y.eff = a.eff AND y.q = a.q - a.q % 4 - 1
 LEFT JOIN f p ON p.symbol = a.symbol AND p.eff = a.eff AND p.q = a.q - 4),
f1 AS (SELECT symbol, eff, max(q) AS q, arg_max(ocf_ttm, q) AS ocf_ttm FROM ft WHERE age <= 4 AND ocf_ttm IS NOT NULL GROUP BY 1, 2),
s AS (SELECT e.symbol, e.eff, i1.ni_ttm, i1.dni_ttm, i1.revenue_ttm, i1.gross_profit_ttm, f1.ocf_ttm, b1.book, b1.assets AS total_assets,
  b1.debts AS total_liabilities, b1.avg_book, b1.avg_assets,
  CASE WHEN abs(i2.sq_ni0) > coalesce(1e-4 * b1.assets, 0) THEN (i2.sq_ni - i2.sq_ni0) / abs(i2.sq_ni0) END AS ni_sq_yoy,
  CASE WHEN abs(i2.sq_rev0) > coalesce(1e-4 * b1.assets, 0) THEN (i2.sq_rev - i2.sq_rev0) / abs(i2.sq_rev0) END AS rev_sq_yoy,
  CASE WHEN abs(i2.sq_dni0) > coalesce(1e-4 * b1.assets, 0) THEN (i2.sq_dni - i2.sq_dni0) / abs(i2.sq_dni0) END AS dni_sq_yoy,
  coalesce(i1.q, i2.q) AS income_q, b1.q AS balance_q, f1.q AS cashflow_q
 FROM (SELECT DISTINCT symbol, eff FROM known_facts) e LEFT JOIN i1 USING (symbol, eff) LEFT JOIN i2 USING (symbol, eff)
 LEFT JOIN b1 USING (symbol, eff) LEFT JOIN f1 USING (symbol, eff)),
c AS (SELECT s.*, hash(ni_ttm, dni_ttm, revenue_ttm, gross_profit_ttm, ocf_ttm, book, total_assets, total_liabilities, avg_book, avg_assets,
   ni_sq_yoy, rev_sq_yoy, dni_sq_yoy, income_q, balance_q, cashflow_q) AS h FROM s)
SELECT * EXCLUDE (h, income_q, balance_q, cashflow_q, prev),
  last_day(make_date(income_q // 4, (income_q % 4) * 3 + 3, 1)) AS income_period,
  last_day(make_date(balance_q // 4, (balance_q % 4) * 3 + 3, 1)) AS balance_period,
  last_day(make_date(cashflow_q // 4, (cashflow_q % 4) * 3 + 3, 1)) AS cashflow_period
FROM (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY eff) AS prev FROM c) WHERE prev IS NULL OR prev <> h""")
