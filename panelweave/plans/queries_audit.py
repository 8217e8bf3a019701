"""As-of and interval joins, gaps, audits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import trading_rules as rules
from ..operators import asof, intervals, quality, windows
from ..sources.io import read_table
from . import views
from .common import classes, r6
from .ctes import define, oracle
from .queries_datasets import halts, master
from .queries_evaluation import rounded
from .queries_portfolio import ruled, targets, schedule
from .registry import query


# -- as-of ---------------------------------------------------------------------------

@query("asof_purchase_signup", "J1", """
SELECT p.event_id, p.user_id, s.ts AS signup_ts, round(s.value, 2) AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_purchase_signup(spark, sf):
    e = read_table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.round("value", 2).alias("signup_value"), "event_id")
    # Events of one user are split by day: a hot user spreads over as many tasks as there are days.
    out = asof.asof_join(left, right.withColumnRenamed("event_id", "sid"), ["user_id"], "ts", "signup_ts", ["signup_value"], tie=["sid"],
                         keep_time=True, bucket="day")
    return out.select("event_id", "user_id", "signup_ts", "signup_value")


@query("running_total_by_user", "W15 J1", """
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events""")
def running_total_by_user(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = asof.running_sum(e, ["user_id"], ["ts", "event_id"], {"total": "value"}, "day", "ts")
    return out.select("event_id", "user_id", F.round("total", 4).alias("total"))


@query("adjusted_bars_view", "J2", oracle("adjusted factors", """
WITH l AS (SELECT symbol, arg_max(hfq, effective_date) AS latest, max(effective_date) + 700 AS as_of FROM factors GROUP BY 1)
SELECT a.symbol, a.trade_date, a.hfq, a.hfq_close, round(a.close * a.hfq / l.latest, 6) AS qfq_close, round(a.open * a.hfq / l.latest, 6) AS qfq_open,
 CASE WHEN a.hfq IS NULL THEN 'missing' WHEN l.as_of IS NULL OR l.as_of < a.trade_date THEN 'stale' ELSE 'ok' END AS factor_status FROM adjusted a LEFT JOIN l USING (symbol)"""))
def adjusted_bars_view(spark, sf):
    daily = views.bars(spark, sf)
    latest = views.adjustment_factors(daily).groupBy("symbol").agg(
        F.max_by("hfq", "effective_date").alias("latest"), F.date_add(F.max("effective_date"), 700).alias("as_of"))
    rows = views.adjusted(spark, sf).join(latest, "symbol", "left")
    ratio = F.col("hfq") / F.col("latest")
    status = F.when(F.col("hfq").isNull(), "missing").when(F.col("as_of").isNull() | (F.col("as_of") < F.col("trade_date")), "stale").otherwise("ok")
    return rows.select("symbol", "trade_date", "hfq", "hfq_close", r6(F.col("close") * F.col("hfq") / F.col("latest")).alias("qfq_close"),
                       r6(F.col("open") * F.col("hfq") / F.col("latest")).alias("qfq_open"), status.alias("factor_status"))


def symbol_halts(spark, sf):
    h = halts(spark, sf)
    return h.withColumn("symbol", F.concat(F.lit("Brand#"), (F.col("symbol") % 25 + 1).cast("string")))


define("symbol_halts", "halts", "SELECT * REPLACE ('Brand#' || CAST(symbol % 25 + 1 AS VARCHAR) AS symbol) FROM halts")


@query("suspension_spans", "J3", oracle("symbol_halts bars calendar", """
WITH r AS (SELECT e.*, (SELECT min(trade_date) FROM bars b WHERE b.symbol = e.symbol AND b.trade_date > e.start_date) AS resume_date FROM symbol_halts e)
SELECT k, symbol, start_date, resume_date, CASE WHEN end_date IS NOT NULL THEN end_date WHEN resume_date IS NULL THEN NULL
  ELSE greatest(start_date, (SELECT max(c.trade_date) FROM calendar c WHERE c.trade_date < r.resume_date)) END AS end_date,
 end_date IS NULL AND resume_date IS NOT NULL AS end_inferred FROM r"""))
def suspension_spans(spark, sf):
    out = intervals.suspension_spans(symbol_halts(spark, sf), views.bars(spark, sf), views.calendar(spark, sf))
    return out.select("k", "symbol", "start_date", "resume_date", "end_date", "end_inferred")


define("changes", "", """
SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'ST' WHEN 'O' THEN '*ST' END AS status,
 CASE arg_max(o_orderpriority[1], o_orderkey) WHEN '1' THEN 'ST' END AS old_status FROM orders GROUP BY 1, 2""")


def changes(spark, sf):
    o = read_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    return o.select("symbol", "day", F.when(F.col("s") == "F", "ST").when(F.col("s") == "O", "*ST").alias("status"),
                    F.when(F.col("p").startswith("1"), "ST").alias("old_status"))


define("status_intervals", "changes", """
WITH s AS (SELECT symbol, NULL::DATE AS day, arg_min(row(old_status), day)[1] AS status, DATE '0001-01-01' AS o FROM changes GROUP BY 1 UNION ALL SELECT symbol, day, status, day FROM changes),
c AS (SELECT *, status IS DISTINCT FROM lag(status) OVER w OR lag(o) OVER w IS NULL AS n FROM s WINDOW w AS (PARTITION BY symbol ORDER BY o)),
r AS (SELECT *, sum(CAST(n AS INTEGER)) OVER (PARTITION BY symbol ORDER BY o) AS run FROM c),
m AS (SELECT symbol, run, status, arg_min(row(day), o)[1] AS start_date, min(o) AS o FROM r GROUP BY 1, 2, 3),
e AS (SELECT *, lead(o) OVER (PARTITION BY symbol ORDER BY o) AS end_date FROM m)
SELECT symbol, status, start_date, end_date FROM e WHERE status IS NOT NULL""")


@query("status_intervals", "J4", oracle("status_intervals", "SELECT * FROM status_intervals"))
def status_intervals(spark, sf):
    ch = changes(spark, sf)
    return intervals.status_intervals(ch.withColumn("old_status", F.col("old_status")))


define("probe_days", "", "SELECT DISTINCT o_custkey AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS day FROM orders")


def probe_days(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("symbol"), F.date_add(F.trunc("o_orderdate", "month"), 14).alias("day")).distinct()


@query("interval_at_session", "J5 J6 J13", oracle("status_intervals probe_days", """
SELECT p.symbol, p.day, i.status FROM probe_days p LEFT JOIN status_intervals i ON i.symbol = p.symbol AND coalesce(i.start_date, DATE '1990-01-01') <= p.day AND p.day < coalesce(i.end_date, DATE '9999-01-01')"""))
def interval_at_session(spark, sf):
    spans = intervals.status_intervals(changes(spark, sf)).withColumn("start_date", F.coalesce("start_date", F.to_date(F.lit("1990-01-01"))))
    return asof.interval_join(probe_days(spark, sf), spans, ["symbol"], "day", "start_date", "end_date", ["status"])


@query("interval_overlap_last_wins", "J5", oracle("halts probe_days", """
SELECT p.symbol, p.day, arg_max(h.k, row(h.k)) AS k FROM probe_days p JOIN halts h ON h.symbol = p.symbol AND h.end_date IS NOT NULL AND h.start_date <= p.day AND p.day < h.end_date GROUP BY 1, 2"""))
def interval_overlap_last_wins(spark, sf):
    h = halts(spark, sf).filter("end_date is not null")
    return asof.interval_join(probe_days(spark, sf), h, ["symbol"], "day", "start_date", "end_date", ["k"], order=["k"], how="inner",
                              bucket="month", overlapping=True)


@query("valid_on_day", "J13", oracle("status_intervals", """
SELECT symbol, status FROM status_intervals WHERE start_date <= DATE '1999-06-30' AND (end_date IS NULL OR end_date >= DATE '1999-06-30')
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY start_date DESC) = 1"""))
def valid_on_day(spark, sf):
    return intervals.valid_on(intervals.status_intervals(changes(spark, sf)), F.to_date(F.lit("1999-06-30")), ["symbol"], ["status"])


@query("specific_over_general", "J14", """
SELECT o_orderkey, o_custkey, o_orderstatus AS company_type FROM orders WHERE o_orderstatus <> 'O' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def specific_over_general(spark, sf):
    from ..operators.pit import prefer_specific
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("symbol"), "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "O", "G").when(F.col("o_orderstatus") == "P", "B").otherwise("X")
    out = prefer_specific(o.withColumn("company_type", kind))
    return out.select("o_orderkey", F.col("symbol").alias("o_custkey"), F.col("o_orderstatus").alias("company_type"))


@query("period_end_valuation", "J15", oracle("bars", """
WITH h AS (SELECT o_custkey, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, last_day(CAST(o_orderdate AS DATE)) AS period, count(*) AS shares FROM orders GROUP BY ALL)
SELECT h.o_custkey, h.symbol, h.period, b.close, h.shares * b.close AS value FROM h ASOF LEFT JOIN bars b ON h.symbol = b.symbol AND h.period >= b.trade_date"""))
def period_end_valuation(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("symbol", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")))
    held = o.groupBy("o_custkey", "symbol", F.last_day("o_orderdate").alias("period")).agg(F.count("*").alias("shares"))
    # Many accounts hold one symbol: split by year.
    out = asof.asof_join(held, views.bars(spark, sf), ["symbol"], "period", "trade_date", ["close"], bucket="year")
    return out.select("o_custkey", "symbol", "period", "close", (F.col("shares") * F.col("close")).alias("value"))


@query("next_session_pairing", "J16 J8", oracle("calendar", """
WITH u AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS v FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1),
p AS (SELECT u.*, (SELECT min(idx) FROM calendar c WHERE c.trade_date > u.day) AS idx FROM u)
SELECT idx, day, v FROM p WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY day DESC) = 1"""))
def next_session_pairing(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")).filter(F.weekday("day") < 5)
    abroad = o.groupBy("day").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    paired = asof.next_session(abroad, views.calendar(spark, sf), "day", inclusive=False, out="idx").filter("idx is not null")
    return paired.groupBy("idx").agg(F.max_by(F.struct("day", "v"), "day").alias("r")).select("idx", "r.*")


@query("forecast_as_of", "J18", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) <= DATE '1999-12-31' AND CAST(o_orderdate AS DATE) >= DATE '1999-12-31' - 183
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def forecast_as_of(spark, sf):
    day = F.to_date(F.lit("1999-12-31"))
    o = read_table(spark, sf, "orders").filter((F.col("o_orderstatus") == "P") & F.to_date("o_orderdate").between(F.date_sub(day, 183), day))
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


@query("day_events", "J19", oracle("facts dividend_cash calendar", """
WITH d AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY idx) AS prev FROM calendar)
SELECT 'report' AS kind, f.symbol, d.trade_date FROM facts f JOIN d ON f.notice_date > d.prev AND f.notice_date <= d.trade_date WHERE f.version = 1 AND f.statement = 'income'
UNION ALL SELECT 'ex_date', symbol, trade_date FROM dividend_cash"""))
def day_events(spark, sf):
    days = views.calendar(spark, sf)
    notices = views.statements(spark, sf).filter("version = 1 and statement = 'income'").select("symbol", "notice_date")
    reports = asof.next_session(notices, days, "notice_date", inclusive=True, out="idx").join(days, "idx").filter("idx > 1").select(
        F.lit("report").alias("kind"), "symbol", "trade_date")
    paid = views.dividends(views.bars(spark, sf)).filter("cash_per_10 > 0")
    ex = asof.next_session(paid, days, "ex_date", inclusive=True, out="idx").join(days, "idx").select(F.lit("ex_date").alias("kind"), "symbol", "trade_date")
    return reports.unionByName(ex)


@query("quote_fill", "J20", """
WITH m AS (SELECT event_type AS c, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)
SELECT q.c, q.d, coalesce(q.v, m.n) AS volume FROM (SELECT event_type AS c, CAST(ts AS DATE) AS d, CASE WHEN day(min(ts)) % 2 = 0 THEN CAST(count(DISTINCT user_id) AS BIGINT) END AS v FROM events GROUP BY 1, 2) q LEFT JOIN m USING (c, d)""")
def quote_fill(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("c"), F.to_date("ts").alias("d"), "user_id")
    totals = e.groupBy("c", "d").agg(F.count("*").alias("n"))
    quotes = e.groupBy("c", "d").agg(F.when(F.day("d") % 2 == 0, F.countDistinct("user_id")).alias("v"))
    return quotes.join(totals, ["c", "d"], "left").select("c", "d", F.coalesce("v", "n").alias("volume"))


# -- gaps ------------------------------------------------------------------------------

define("bounds", "bars calendar", """
SELECT symbol, CASE WHEN length(symbol) = 7 THEN min(trade_date) ELSE (SELECT min(trade_date) FROM calendar) END AS win_start, CASE WHEN length(symbol) = 7 THEN max(trade_date) ELSE (SELECT max(trade_date) FROM calendar) END AS win_end FROM bars GROUP BY 1""")
define("gaps", "bounds calendar bars", """
WITH e AS (SELECT b.*, c.trade_date, c.idx FROM bounds b JOIN calendar c ON c.trade_date BETWEEN b.win_start AND b.win_end),
m AS (SELECT * FROM e ANTI JOIN bars x ON x.symbol = e.symbol AND x.trade_date = e.trade_date),
f AS (SELECT symbol, min(trade_date) AS s0, max(trade_date) AS s1 FROM e GROUP BY 1),
r AS (SELECT *, idx - row_number() OVER (PARTITION BY symbol ORDER BY idx) AS g FROM m)
SELECT symbol, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS sessions,
 CASE WHEN min(trade_date) = any_value(s0) THEN 'head' WHEN max(trade_date) = any_value(s1) THEN 'tail' ELSE 'internal' END AS position FROM r JOIN f USING (symbol) GROUP BY symbol, g""")


@views.kept
def gap_rows(spark, sf):
    daily = views.bars(spark, sf)
    # some securities are watched from their first to their last bar, the others over the whole calendar
    short = F.length("symbol") == 7
    calendar = views.calendar(spark, sf)
    first, last = calendar.agg(F.min("trade_date")).scalar(), calendar.agg(F.max("trade_date")).scalar()
    bounds = daily.groupBy("symbol").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(
        "symbol", F.when(short, F.col("a")).otherwise(first).alias("win_start"),
        F.when(short, F.col("b")).otherwise(last).alias("win_end"))
    return intervals.gaps(daily, views.calendar(spark, sf), bounds)


EXPLAINED = """SELECT g.*, (SELECT string_agg(DISTINCT h.source, ',' ORDER BY h.source) FROM symbol_halts h WHERE h.end_date IS NOT NULL AND h.symbol = g.symbol AND h.start_date <= g.gap_end AND h.end_date >= g.gap_start) AS explained_by FROM gaps g"""


@query("calendar_gaps", "Q9", oracle("gaps symbol_halts", EXPLAINED))
def calendar_gaps(spark, sf):
    last_day = views.calendar(spark, sf).agg(F.max("trade_date")).scalar()
    return intervals.explained_by(gap_rows(spark, sf), symbol_halts(spark, sf).filter("end_date is not null"), last_day)


@query("gap_histogram", "Q10", oracle("gaps", """
SELECT CASE WHEN sessions <= 1 THEN '1' WHEN sessions <= 5 THEN '2-5' WHEN sessions <= 20 THEN '6-20' WHEN sessions <= 60 THEN '21-60' WHEN sessions <= 250 THEN '61-250' ELSE '>250' END AS length,
 year(gap_start) AS year, count(*) AS gaps, CAST(sum(sessions) AS BIGINT) AS sessions FROM gaps GROUP BY 1, 2"""))
def gap_histogram(spark, sf):
    return gap_rows(spark, sf).groupBy(quality.gap_class(F.col("sessions")).alias("length"), F.year("gap_start").cast("long").alias("year")).agg(
        F.count("*").alias("gaps"), F.sum("sessions").alias("sessions"))


# -- rules -------------------------------------------------------------------------------

BROKEN = """SELECT * REPLACE (CASE WHEN trades = 4 THEN low - 1 ELSE high END AS high, CASE WHEN volume % 97 = 0 THEN -volume ELSE volume END AS volume, CASE WHEN amount % 101 = 0 THEN NULL ELSE open END AS open, CASE WHEN amount % 103 = 0 THEN 0 ELSE close END AS close) FROM bars"""


def broken(spark, sf):
    return views.bars(spark, sf).withColumns({
        "high": F.when(F.col("trades") == 4, F.col("low") - 1).otherwise(F.col("high")),
        "open": F.when(F.col("amount") % 101 != 0, F.col("open")), "close": F.when(F.col("amount") % 103 == 0, 0).otherwise(F.col("close")),
        "volume": F.when(F.col("volume") % 97 == 0, -F.col("volume")).otherwise(F.col("volume"))})


ISSUES = f"""
WITH b AS (SELECT * FROM ({BROKEN}) UNION ALL SELECT * FROM ({BROKEN}) WHERE trades = 5),
c AS (SELECT symbol, count(*) FILTER (symbol IS NULL OR trade_date IS NULL) AS key_not_null, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS positive_prices,
 count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high)) AS valid_ohlc, count(*) FILTER (volume < 0) AS non_negative_volume,
 count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS price_not_null, count(*) - count(DISTINCT trade_date) AS unique_symbol_date FROM b GROUP BY 1)
SELECT symbol, rule, affected_rows, 'blocking' AS severity FROM (UNPIVOT c ON COLUMNS(* EXCLUDE (symbol)) INTO NAME rule VALUE affected_rows) WHERE affected_rows > 0"""


def bar_issues(spark, sf):
    b = broken(spark, sf)
    return quality.validate_bars(b.unionByName(b.filter("trades = 5")), ["symbol"])


@query("bar_rules", "Q1", oracle("bars", ISSUES))
def bar_rules(spark, sf):
    return bar_issues(spark, sf)


@query("severity_summary", "Q7 Q20", oracle("bars", f"SELECT severity, count(*) AS issues, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM ({ISSUES}) GROUP BY 1"))
def severity_summary(spark, sf):
    return quality.severity_summary(bar_issues(spark, sf))


@query("quarantine_split", "S13 Q20", oracle("bars", f"""
SELECT symbol, symbol NOT IN (SELECT symbol FROM ({ISSUES}) WHERE rule = 'valid_ohlc') AS published, count(*) AS rows FROM bars GROUP BY 1, 2"""))
def quarantine_split(spark, sf):
    from ..sources.io import quarantine
    bad = bar_issues(spark, sf).filter("rule = 'valid_ohlc'")
    good, aside = quarantine(views.bars(spark, sf), bad, ["symbol"])
    both = good.withColumn("published", F.lit(True)).unionByName(aside.withColumn("published", F.lit(False)))
    return both.groupBy("symbol", "published").agg(F.count("*").alias("rows"))


@query("volume_unit_outliers", "Q2", oracle("bars", """
SELECT symbol, year(trade_date) AS run, round(quantile_cont(amount / (volume * CASE WHEN length(symbol) = 8 THEN 100 ELSE 1 END * close), 0.5), 6) AS ratio, count(*) AS rows FROM bars
WHERE volume > 0 GROUP BY ALL HAVING quantile_cont(amount / (volume * CASE WHEN length(symbol) = 8 THEN 100 ELSE 1 END * close), 0.5) NOT BETWEEN 0.5 AND 2"""))
def volume_unit_outliers(spark, sf):
    raw = views.bars(spark, sf).withColumns({"volume": F.col("volume") * F.when(F.length("symbol") == 8, 100).otherwise(1), "run": F.year("trade_date").cast("long")})
    return rounded(quality.volume_unit_outliers(raw, ["symbol", "run"]), "ratio")


@query("master_rules", "Q3", oracle("master", """
SELECT (SELECT count(*) FROM master WHERE symbol LIKE '%13') AS unknown_exchange, (SELECT count(*) FROM master WHERE status <> 'delisted') AS live,
 (SELECT count(*) FROM master WHERE status <> 'delisted' AND substr(symbol, 4) >= '700') AS vanished FROM (SELECT 1)"""))
def master_rules(spark, sf):
    """Faults are put in: codes that end in 13 lose their exchange, codes from 700 on vanish from the new list."""
    m = master(spark, sf)
    faulty = m.withColumn("exchange", F.when(F.col("symbol").endswith("13"), "UNKNOWN").otherwise(F.col("exchange")))
    unknown = faulty.agg(F.count_if(F.col("exchange") == "UNKNOWN").alias("unknown_exchange"))
    return unknown.join(quality.vanished_share(m, m.filter(F.substring("symbol", 4, 3) < "700"), "symbol", "status"))


@query("calendar_rules", "Q4", oracle("calendar", """
SELECT count(*) FILTER (year(trade_date) = 1998) AS duplicates, max(trade_date) AS last_day, max(trade_date) >= DATE '2001-11-01' AS covers FROM calendar"""))
def calendar_rules(spark, sf):
    """A fault is put in: the sessions of one year come twice."""
    c = views.calendar(spark, sf).select("trade_date")
    c = c.unionAll(c.filter(F.year("trade_date") == 1998))
    return c.agg((F.count("*") - F.countDistinct("trade_date")).alias("duplicates"), F.max("trade_date").alias("last_day"),
                 (F.max("trade_date") >= F.to_date(F.lit("2001-11-01"))).alias("covers"))


@query("factor_history_rules", "Q5", oracle("factors", """
SELECT symbol, count(*) FILTER (year(effective_date) = 1998) AS changed, count(*) FILTER (year(effective_date) = 2000) AS removed FROM factors GROUP BY 1
HAVING count(*) FILTER (year(effective_date) IN (1998, 2000)) > 0"""))
def factor_history_rules(spark, sf):
    old = views.adjustment_factors(views.bars(spark, sf))
    year = F.year("effective_date")
    new = old.filter(year != 2000).withColumn("hfq", F.when(year == 1998, F.col("hfq") * 1.001).otherwise(F.col("hfq")))
    return quality.factor_history(new, old)


@query("index_regression", "Q6", oracle("bars", """
SELECT symbol, max(trade_date) FILTER (length(symbol) = 8 OR year(trade_date) < 2001) AS new_last, max(trade_date) AS old_last FROM bars GROUP BY 1
HAVING max(trade_date) FILTER (length(symbol) = 8 OR year(trade_date) < 2001) < max(trade_date)"""))
def index_regression(spark, sf):
    daily = views.bars(spark, sf)
    return quality.regressed(daily.filter((F.length("symbol") == 8) | (F.year("trade_date") < 2001)), daily, "symbol", "trade_date")


COVERAGE = """SELECT a.symbol, l.last_bar, coalesce(l.has_bar, false) AS has_bar, s.symbol IS NOT NULL AS suspended FROM (SELECT DISTINCT p_brand AS symbol FROM part) a
LEFT JOIN (SELECT symbol, max(trade_date) AS last_bar, bool_or(trade_date = DATE '2001-03-15') AS has_bar FROM bars GROUP BY 1) l USING (symbol)
LEFT JOIN (SELECT DISTINCT symbol FROM symbol_halts WHERE end_date IS NOT NULL AND start_date <= DATE '2001-03-15' AND end_date >= DATE '2001-03-15') s USING (symbol)"""


def coverage_rows(spark, sf):
    day = F.to_date(F.lit("2001-03-15"))
    halted = symbol_halts(spark, sf).filter((F.col("start_date") <= day) & (F.col("end_date") >= day))
    active = read_table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return quality.latest_coverage(active, views.bars(spark, sf), halted, day)


@query("latest_coverage", "Q8", oracle("bars symbol_halts", COVERAGE))
def latest_coverage(spark, sf):
    return coverage_rows(spark, sf)


@query("coverage_summary", "Q8", oracle("bars symbol_halts", f"""
SELECT count(*) AS active, count(*) FILTER (has_bar) AS with_bar, count(*) FILTER (NOT has_bar AND suspended) AS suspended, count(*) FILTER (NOT has_bar AND NOT suspended) AS unexplained,
 round(count(*) FILTER (has_bar) / greatest(count(*) - count(*) FILTER (NOT has_bar AND suspended), 1)::DOUBLE, 6) AS coverage FROM ({COVERAGE})"""))
def coverage_summary(spark, sf):
    return rounded(quality.coverage_summary(coverage_rows(spark, sf)), "coverage")


@query("limit_breaches", "Q11", oracle("bars calendar factors", """
WITH x AS (SELECT symbol, trade_date, close, lag(close) OVER w AS prev_close, lag(trade_date) OVER w AS prev_date, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_session FROM calendar)
SELECT x.symbol, x.trade_date, x.prev_close, x.close, round((x.close / x.prev_close - 1) * 100, 2) AS pct FROM x JOIN c USING (trade_date) WHERE rn > 5 AND prev_date = prev_session
 AND (close > floor(prev_close * (1 + 0.3::DOUBLE) + 0.5) OR close < floor(prev_close * (1 - 0.3::DOUBLE) + 0.5)) AND NOT EXISTS (SELECT 1 FROM factors f WHERE f.symbol = x.symbol AND f.effective_date = x.trade_date)"""))
def limit_breaches(spark, sf):
    daily = views.bars(spark, sf)
    return quality.limit_breaches(daily, views.calendar(spark, sf), F.lit(0.3), views.adjustment_factors(daily))


@query("factor_freshness", "Q12", oracle("bars factors", """
WITH k AS (SELECT symbol, max(effective_date) FILTER (length(symbol) = 8) + 800 AS factor_as_of FROM factors GROUP BY 1)
SELECT b.symbol, b.last_bar, k.factor_as_of, CASE WHEN k.factor_as_of IS NULL THEN 'missing' WHEN k.factor_as_of < b.last_bar THEN 'stale' ELSE 'ok' END AS state
FROM (SELECT symbol, max(trade_date) AS last_bar FROM bars GROUP BY 1) b LEFT JOIN k USING (symbol)"""))
def factor_freshness(spark, sf):
    daily = views.bars(spark, sf)
    known = views.adjustment_factors(daily).withColumn("factor_as_of", F.when(F.length("symbol") == 8, F.date_add("effective_date", 800)))
    return quality.factor_freshness(daily, known)


@query("calendar_index_difference", "Q13", oracle("calendar", """
WITH i AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders)
SELECT trade_date, 'calendar_only' AS side FROM calendar ANTI JOIN i USING (trade_date) UNION ALL SELECT trade_date, 'index_only' FROM i ANTI JOIN calendar USING (trade_date)"""))
def calendar_index_difference(spark, sf):
    index = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date"))
    return quality.symmetric_difference(views.calendar(spark, sf), index, "trade_date", "calendar_only", "index_only")


@query("risk_names_mismatch", "Q14", oracle("status_intervals", """
WITH n AS (SELECT c_custkey AS symbol, CASE WHEN c_custkey % 10 IN (0, 2) THEN '*ST' WHEN c_custkey % 10 IN (1, 4) THEN 'ST' END AS named FROM customer),
m AS (SELECT symbol, status FROM status_intervals WHERE coalesce(start_date, DATE '1900-01-01') <= DATE '1999-06-30' AND (end_date IS NULL OR end_date > DATE '1999-06-30'))
SELECT n.symbol, n.named, m.status AS modeled FROM n LEFT JOIN m USING (symbol) WHERE n.named IS DISTINCT FROM m.status"""))
def risk_names_mismatch(spark, sf):
    day = F.to_date(F.lit("1999-06-30"))
    key = F.col("c_custkey") % 10
    named = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"), F.when(key.isin(0, 2), "*ST").when(key.isin(1, 4), "ST").alias("named"))
    spans = intervals.status_intervals(changes(spark, sf))
    known = spans.filter((F.coalesce("start_date", F.to_date(F.lit("1900-01-01"))) <= day) & (F.col("end_date").isNull() | (F.col("end_date") > day)))
    rows = named.join(known.select("symbol", F.col("status").alias("modeled")), "symbol", "left")
    return rows.filter(~F.col("named").eqNullSafe(F.col("modeled")))


@query("reference_coverage", "Q15", oracle("bars share_steps", """
SELECT DISTINCT symbol FROM bars WHERE trade_date = DATE '1995-01-20' AND symbol NOT IN (SELECT symbol FROM share_steps WHERE notice_date <= DATE '1995-01-20')"""))
def reference_coverage(spark, sf):
    daily, day = views.bars(spark, sf), F.to_date(F.lit("1995-01-20"))
    traded = daily.filter(F.col("trade_date") == day).select("symbol").distinct()
    return traded.join(views.share_events(daily).filter(F.col("notice_date") <= day), "symbol", "left_anti")


@query("trades_vs_bars", "Q16", oracle("ticks bars", """
WITH t AS (SELECT symbol, trade_date, CAST(sum(amount) FILTER (price % 97 > 0) AS BIGINT) AS trade_amount, arg_max(price, row(k1, k2, k3, k4, price)) AS trade_last FROM ticks GROUP BY 1, 2)
SELECT symbol, trade_date, t.trade_amount, t.trade_last, b.amount AS bar_amount, b.close AS bar_last, CASE WHEN b.amount IS NULL THEN 'no_bars' WHEN t.trade_amount IS NULL THEN 'no_trades'
 WHEN b.amount <= 0 OR abs(t.trade_amount / b.amount - 1) > 0.02 THEN 'amount' WHEN abs(t.trade_last - b.close) > 0.0015 THEN 'last_price' ELSE 'ok' END AS verdict FROM bars b FULL JOIN t USING (symbol, trade_date)"""))
def trades_vs_bars(spark, sf):
    trades = views.ticks(spark, sf).withColumn("amount", F.when(F.col("price") % 97 > 0, F.col("amount"))).withColumn("seq", F.struct("k1", "k2", "k3", "k4", "price"))
    daily = views.bars(spark, sf).withColumn("time", F.lit(1))
    return quality.reconcile_trades(trades, daily, ["symbol", "trade_date"])


define("evidence", "ruled", """
WITH r AS (SELECT symbol, idx, high, low, close, reference, has_bar, lag(CASE WHEN has_bar THEN idx END) OVER (PARTITION BY symbol ORDER BY idx) AS p FROM ruled),
u AS (SELECT *, CAST((CAST(reference AS HUGEINT) * 1500000 * 2 + 1000000) // 2000000 AS BIGINT) AS hi, CAST((CAST(reference AS HUGEINT) * 500000 * 2 + 1000000) // 2000000 AS BIGINT) AS lo FROM r WHERE has_bar AND idx - p = 1 AND reference IS NOT NULL)
SELECT symbol, idx, high > hi OR low < lo AS beyond, (close = hi OR close = lo) AND high <= hi AND low >= lo AS agrees FROM u""")


def evidence(spark, sf):
    rows = ruled(spark, sf).withColumn("prev_idx", windows.lag_n(F.when(F.col("has_bar"), F.col("idx")), 1)).filter("has_bar")
    return quality.band_evidence(rows, F.lit(500000))


@query("price_band_evidence", "Q17", oracle("evidence", "SELECT symbol, idx, beyond, agrees FROM evidence"))
def price_band_evidence(spark, sf):
    return evidence(spark, sf).select("symbol", "idx", "beyond", "agrees")


define("trial_intervals", "bars", """
SELECT symbol, min(trade_date) AS start_date, CASE WHEN date_trunc('month', trade_date) < DATE '2001-10-01' THEN max(trade_date) END AS end_date FROM bars GROUP BY symbol, date_trunc('month', trade_date)""")


@query("reconcile_intervals", "Q18", oracle("trial_intervals evidence calendar", """
WITH v AS (SELECT e.symbol, c.trade_date, e.beyond, NOT e.beyond AND e.idx % 3 = 0 AS agrees FROM evidence e JOIN calendar c USING (idx)),
h AS (SELECT i.symbol, i.start_date, count(*) FILTER (beyond) AS contrary, min(trade_date) FILTER (agrees) AS fo, max(trade_date) FILTER (agrees) AS lo, min(trade_date) FILTER (beyond) AS fb, max(trade_date) FILTER (beyond) AS lb
 FROM trial_intervals i JOIN v ON v.symbol = i.symbol AND v.trade_date >= i.start_date AND (i.end_date IS NULL OR v.trade_date < i.end_date) GROUP BY 1, 2),
a AS (SELECT i.*, CASE WHEN coalesce(contrary, 0) = 0 THEN 'keep' WHEN fo IS NULL THEN 'drop' WHEN lb < fo THEN 'trim_start' WHEN fb > lo THEN 'trim_end' WHEN contrary >= 2 THEN 'split' ELSE 'keep' END AS action, fb, lb
 FROM trial_intervals i LEFT JOIN h USING (symbol, start_date))
SELECT symbol, start_date, end_date, action, CASE action WHEN 'trim_start' THEN lb + 1 WHEN 'drop' THEN NULL ELSE start_date END AS new_start, CASE action WHEN 'trim_end' THEN fb WHEN 'split' THEN fb WHEN 'drop' THEN NULL ELSE end_date END AS new_end FROM a
UNION ALL SELECT symbol, start_date, end_date, action, lb + 1, end_date FROM a WHERE action = 'split'"""))
def reconcile_intervals(spark, sf):
    month = F.trunc("trade_date", "month")
    spans = views.bars(spark, sf).groupBy("symbol", month.alias("m")).agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("e")).select(
        "symbol", "start_date", F.when(F.col("m") < F.to_date(F.lit("2001-10-01")), F.col("e")).alias("end_date"))
    seen = evidence(spark, sf).select("symbol", "idx", "beyond").join(views.calendar(spark, sf), "idx")
    seen = seen.withColumn("agrees", ~F.col("beyond") & (F.col("idx") % 3 == 0)).drop("idx")
    return intervals.reconcile(spans, seen, 2)


define("risk_intervals", "bars", """
SELECT symbol, CASE month(start_date) % 4 WHEN 0 THEN 'DELISTING' WHEN 1 THEN '*ST' ELSE 'ST' END AS status, start_date, end_date, CASE WHEN month(start_date) % 3 = 0 THEN start_date - 75 END AS low
FROM (SELECT symbol, date_trunc('quarter', trade_date) AS q, min(trade_date) + 20 AS start_date, CASE WHEN year(min(trade_date)) < 2001 THEN max(trade_date) + 10 END AS end_date FROM bars GROUP BY 1, 2)""")


@query("settle_risk_intervals", "Q18", oracle("risk_intervals evidence calendar", """
WITH i AS (SELECT * FROM risk_intervals WHERE status <> 'DELISTING'),
v AS (SELECT e.symbol, c.trade_date AS d, e.beyond AND e.idx % 23 = 0 AS beyond, NOT (e.beyond AND e.idx % 23 = 0) AND (e.agrees OR NOT e.beyond AND e.idx % 5 = 0) AS support FROM evidence e JOIN calendar c USING (idx)),
s AS (SELECT min(trade_date) AS first_day, max(trade_date) AS final FROM calendar),
w AS (SELECT i.symbol, i.start_date, max(d) FILTER (beyond) AS lb FROM i JOIN v ON v.symbol = i.symbol AND v.d > i.low AND v.d < i.start_date GROUP BY 1, 2),
n AS (SELECT i.*, CASE WHEN w.lb IS NOT NULL THEN coalesce((SELECT min(trade_date) FROM calendar c WHERE c.trade_date > w.lb), final)
  ELSE greatest(coalesce((SELECT min(trade_date) FROM calendar c WHERE c.trade_date > i.low), final), DATE '1995-06-01') END AS back FROM i LEFT JOIN w USING (symbol, start_date), s WHERE low IS NOT NULL),
x AS (SELECT n.symbol, n.start_date, any_value(back) AS back FROM n JOIN v ON v.symbol = n.symbol AND v.d >= n.back AND v.d > n.low AND v.d < n.start_date AND support WHERE back < start_date GROUP BY 1, 2),
r AS (SELECT i.*, coalesce(x.back, i.start_date) AS st, x.back IS NOT NULL AS extended FROM i LEFT JOIN x USING (symbol, start_date)),
f AS (SELECT r.symbol, r.start_date, min(d) AS fb, max(d) AS la FROM r JOIN v ON v.symbol = r.symbol AND v.d >= r.st AND (r.end_date IS NULL OR v.d < r.end_date) AND beyond GROUP BY 1, 2),
c AS (SELECT r.symbol, r.start_date, count(d) FILTER (support AND d < fb) AS sb, count(d) FILTER (support AND d > la) AS sa FROM r JOIN f USING (symbol, start_date) LEFT JOIN v ON v.symbol = r.symbol AND v.d >= r.st AND (r.end_date IS NULL OR v.d < r.end_date) GROUP BY 1, 2),
z AS (SELECT r.*, fb, coalesce((SELECT min(trade_date) FROM calendar k WHERE k.trade_date > la), final) AS al, CASE WHEN fb IS NULL THEN NULL WHEN sb >= 3 AND sa >= 3 THEN 'split' WHEN sa >= 3 OR (sb < 3 AND sa > sb) THEN 'start_moved' WHEN sb >= 3 OR sb > sa THEN 'end_moved' ELSE 'dropped' END AS dec
 FROM r LEFT JOIN f USING (symbol, start_date) LEFT JOIN c USING (symbol, start_date), s),
y AS (SELECT *, nullif(concat_ws(',', CASE WHEN extended THEN 'start_extended' END, dec), '') AS action FROM z)
SELECT symbol, status, start_date, end_date, action, CASE dec WHEN 'start_moved' THEN al WHEN 'dropped' THEN NULL ELSE st END AS new_start, CASE WHEN dec IN ('end_moved', 'split') THEN fb WHEN dec = 'dropped' THEN NULL ELSE end_date END AS new_end FROM y
UNION ALL SELECT symbol, status, start_date, end_date, action, al, end_date FROM y WHERE dec = 'split'
UNION ALL SELECT symbol, status, start_date, end_date, NULL, start_date, end_date FROM risk_intervals WHERE status = 'DELISTING'"""))
def settle_risk_intervals(spark, sf):
    """Intervals trimmed, split, dropped and extended by price evidence."""
    # these trades break the band every other day and hardly ever close on it: some breaks count, and some quiet days support
    breaks, quiet = F.col("beyond") & (F.col("idx") % 23 == 0), ~F.col("beyond") & (F.col("idx") % 5 == 0)
    seen = evidence(spark, sf).select("symbol", "idx", breaks.alias("beyond"), (F.col("agrees") | quiet).alias("at_limit")).join(views.calendar(spark, sf), "idx")
    out = intervals.settle(risk_spans(spark, sf), seen, views.calendar(spark, sf), F.to_date(F.lit("1995-06-01")))
    return out.drop("support_before", "support_after")


def risk_spans(spark, sf):
    """Risk intervals, some with an uncertain start."""
    spans = views.bars(spark, sf).groupBy("symbol", F.trunc("trade_date", "quarter").alias("q")).agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    start = F.date_add("a", 20)
    spans = spans.select("symbol", start.alias("start_date"), F.when(F.year("a") < 2001, F.date_add("b", 10)).alias("end_date"))
    month = F.month("start_date")
    status = F.when(month % 4 == 0, "DELISTING").when(month % 4 == 1, "*ST").otherwise("ST")
    return spans.select("symbol", status.alias("status"), "start_date", "end_date", F.when(month % 3 == 0, F.date_sub("start_date", 75)).alias("low"))


@query("evidence_mismatches", "Q19", oracle("evidence", """
WITH a AS (SELECT symbol, idx, CASE WHEN beyond THEN 'ST' ELSE 'none' END AS status FROM evidence WHERE idx % 2 = 0), b AS (SELECT symbol, idx, CASE WHEN beyond THEN 'ST' ELSE 'none' END AS status FROM evidence WHERE idx % 2 = 1)
SELECT symbol, idx, status FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = a.symbol AND b.status = a.status AND b.idx BETWEEN a.idx - 2 AND a.idx + 2)"""))
def evidence_mismatches(spark, sf):
    rows = evidence(spark, sf).select("symbol", "idx", F.when(F.col("beyond"), "ST").otherwise("none").alias("status"))
    return quality.near_sessions(rows.filter("idx % 2 = 0"), rows.filter("idx % 2 = 1"), "symbol")


@query("signal_count_gate", "Q20", oracle("targets composite", """
WITH c AS (SELECT idx, count(*) AS n FROM composite GROUP BY 1), t AS (SELECT idx, n, quantile_cont(n, 0.5) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS typical FROM c)
SELECT idx, n, typical, abs(n / typical - 1) <= 0.2 AS passes FROM t"""))
def signal_count_gate(spark, sf):
    from .queries_evaluation import composite_scores
    counts = composite_scores(spark, sf).groupBy("idx").agg(F.count("*").alias("n"))
    return quality.signal_gate(counts, "idx", "n")


# Runs by month of orders: what stands in for the ingest, the account and the target of each run.
define("decision_runs", "", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS session, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 4 THEN 'partial' ELSE 'complete' END AS ingest_status,
 CAST(date_trunc('month', o_orderdate) AS DATE) + CASE WHEN count(*) % 5 = 0 THEN 1 ELSE 0 END AS expected_latest, 'v' || (count(*) % 3) AS ingest_version, CASE count(*) % 7 WHEN 0 THEN '' WHEN 1 THEN 'v9' ELSE 'v' || (count(*) % 3) END AS market_version,
 count(DISTINCT o_custkey) AS universe, count(*) FILTER (o_totalprice > 250000) AS scored, CASE WHEN count(*) % 2 = 0 THEN 'manual' ELSE 'paper' END AS mode, max(CAST(o_orderdate AS DATE)) FILTER (o_orderpriority[1] = '1' AND o_totalprice > 450000) AS confirmed,
 count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority[1] = '5') AS unfilled, round(count(*) FILTER (o_orderstatus <> 'P') / count(*)::DOUBLE, 6) AS weight_sum, count(*) FILTER (o_orderstatus = 'F') AS names, count(*) FILTER (o_orderstatus = 'F' OR o_totalprice > 400000) AS wanted
FROM orders GROUP BY date_trunc('month', o_orderdate)""")


def decision_runs(spark, sf):
    month, n = F.to_date(F.trunc("o_orderdate", "month")), F.col("n")
    status, first, total = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_totalprice")
    runs = read_table(spark, sf, "orders").groupBy(month.alias("session")).agg(
        F.count("*").alias("n"), F.count_if(status == "P").alias("p"), F.countDistinct("o_custkey").alias("universe"), F.count_if(total > 250000).alias("scored"),
        F.max(F.when((first == "1") & (total > 450000), F.to_date("o_orderdate"))).alias("confirmed"), F.count_if((status == "P") & (first == "5")).alias("unfilled"),
        F.round(F.count_if(status != "P") / F.count("*"), 6).alias("weight_sum"), F.count_if(status == "F").alias("names"), F.count_if((status == "F") | (total > 400000)).alias("wanted"))
    version = F.concat(F.lit("v"), (n % 3).cast("string"))
    return runs.withColumns({
        "ingest_status": F.when(F.col("p") > 4, "partial").otherwise("complete"), "expected_latest": F.date_add("session", F.when(n % 5 == 0, 1).otherwise(0)),
        "ingest_version": version, "market_version": F.when(n % 7 == 0, "").when(n % 7 == 1, "v9").otherwise(version), "mode": F.when(n % 2 == 0, "manual").otherwise("paper")})


@query("run_gates", "Q20", oracle("decision_runs", """
WITH m AS (SELECT *, count(*) OVER w AS h, quantile_cont(universe, 0.5) OVER w AS mu, quantile_cont(scored, 0.5) OVER w AS ms FROM decision_runs WINDOW w AS (ORDER BY session ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
g AS (SELECT session, ingest_status = 'complete' AND expected_latest = session AS g1, market_version <> '' AND market_version = ingest_version AS g2,
 h < 3 OR ((mu <= 0 OR abs(universe - mu) / mu <= 0.2::DOUBLE) AND (ms <= 0 OR abs(scored - ms) / ms <= 0.2::DOUBLE)) AS g3, mode <> 'manual' OR (confirmed IS NOT NULL AND unfilled = 0) AS g4,
 weight_sum BETWEEN 0.9::DOUBLE AND 1.000000001::DOUBLE AND (wanted = 0 OR abs(names - wanted) / wanted::DOUBLE <= 0.1::DOUBLE) AS g5 FROM m)
SELECT *, concat_ws(',', CASE WHEN NOT g1 THEN 'g1' END, CASE WHEN NOT g2 THEN 'g2' END, CASE WHEN NOT g3 THEN 'g3' END, CASE WHEN NOT g4 THEN 'g4' END, CASE WHEN NOT g5 THEN 'g5' END) AS failed FROM g"""))
def run_gates(spark, sf):
    """All five gates of every run."""
    return quality.run_gates(decision_runs(spark, sf)).select("session", "g1", "g2", "g3", "g4", "g5", "failed")
