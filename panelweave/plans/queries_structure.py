"""Crowding, fund flows, options and volatility."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import asof, flows, options, windows
from ..sources.io import read_table
from . import views
from .common import r6
from .ctes import define, oracle
from .queries_evaluation import rounded
from .registry import query

# -- crowding ---------------------------------------------------------------------------

define("industry_bars", "", """
SELECT n.n_name AS code, CAST(l_shipdate AS DATE) AS trade_date, CAST(sum(floor(l_extendedprice * 100 + 0.5)) AS BIGINT) AS amount,
 max(CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT)) AS close FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON n_nationkey = s_nationkey GROUP BY 1, 2""")


def industry_bars(spark, sf):
    s = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    l = read_table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return l.groupBy(F.col("n_name").alias("code"), F.to_date("l_shipdate").alias("trade_date")).agg(
        F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("amount"),
        F.max(F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5)).alias("close"))


define("crowding", "industry_bars calendar", """
WITH g AS (SELECT f.code, c.idx, c.trade_date, b.amount, b.close FROM (SELECT code, min(trade_date) AS d FROM industry_bars GROUP BY 1) f JOIN calendar c ON c.trade_date >= f.d LEFT JOIN industry_bars b ON b.code = f.code AND b.trade_date = c.trade_date),
s AS (SELECT *, amount / sum(amount) OVER (PARTITION BY idx) AS share FROM g),
c AS (SELECT *, CASE WHEN count(share) OVER a >= 6 THEN avg(share) OVER a END / CASE WHEN count(share) OVER b >= 100 THEN avg(share) OVER b END AS c, count(share) OVER b AS base FROM s
 WINDOW a AS (PARTITION BY code ORDER BY idx ROWS 19 PRECEDING), b AS (PARTITION BY code ORDER BY idx ROWS 749 PRECEDING))
SELECT *, c - lag(c, 60) OVER w AS dc60, close / lag(close, 60) OVER w - 1 AS r3, close / lag(close, 250) OVER w - 1 AS r12 FROM c WINDOW w AS (PARTITION BY code ORDER BY idx)""")
ZONE = """CASE WHEN c IS NULL OR r12 IS NULL THEN NULL WHEN c > 1.8 THEN 'crowded' WHEN c BETWEEN 0.8 AND 1.4 AND r12 >= 0.3 THEN 'fight' WHEN c >= 0.6 AND c < 0.8 AND r12 BETWEEN 0.15 AND 0.5 THEN 'starting'
 WHEN c < 0.8 AND r12 < 0.15 THEN 'waiting' ELSE 'other' END"""
CELL = """CASE WHEN c IS NOT NULL AND r12 IS NOT NULL THEN CASE WHEN c <= 0.8 THEN 'C<0.8' WHEN c <= 1.4 THEN 'C 0.8–1.4' WHEN c <= 1.8 THEN 'C 1.4–1.8' ELSE 'C>1.8' END || '|' ||
 CASE WHEN r12 <= 0.15 THEN '<15%' WHEN r12 <= 0.3 THEN '15–30%' WHEN r12 <= 0.5 THEN '30–50%' ELSE '>50%' END END"""


@views.kept
def crowding(spark, sf):
    grid = windows.dense_grid(industry_bars(spark, sf), views.calendar(spark, sf), "code", "trade_date")
    return flows.crowding(grid, "code", 6, 100)


@query("crowding_daily", "B3 B4", oracle("crowding", f"""
SELECT code, idx, round(share, 6) AS share, round(c, 6) AS c, base, round(dc60, 6) + 0.0::DOUBLE AS dc60, round(r3, 6) AS r3, round(r12, 6) AS r12, {ZONE} AS zone, {CELL} AS cell FROM crowding"""))
def crowding_daily(spark, sf):
    c, r = F.col("c"), F.col("r12")
    rows = crowding(spark, sf).withColumns({"zone": flows.zone(c, r), "cell": flows.cell(c, r)})
    return rounded(rows.select("code", "idx", "share", "c", "base", "dc60", "r3", "r12", "zone", "cell"), "share", "c", "dc60", "r3", "r12")


define("weeks", "calendar", """
SELECT *, row_number() OVER (ORDER BY idx) - 1 AS week_no FROM (SELECT max(idx) AS idx, max(trade_date) AS trade_date FROM calendar GROUP BY date_trunc('week', trade_date + 2))""")
define("bench", "bars calendar", "SELECT c.idx, sum(b.amount) / sum(b.volume)::DOUBLE AS bench FROM bars b JOIN calendar c USING (trade_date) GROUP BY 1")
define("weekly", "crowding weeks bench", f"""
WITH r AS (SELECT k.code, k.idx, w.week_no, k.c, k.r12, k.close, b.bench, k.base FROM crowding k JOIN weeks w ON w.idx = k.idx JOIN bench b ON b.idx = k.idx),
f AS (SELECT *, lead(close, 13) OVER w / close - 1 AS f13, lead(close, 26) OVER w / close - 1 AS f26, lead(bench, 13) OVER w / bench - 1 AS b13, lead(bench, 26) OVER w / bench - 1 AS b26 FROM r WINDOW w AS (PARTITION BY code ORDER BY week_no)),
x AS (SELECT *, f13 - avg(f13) OVER (PARTITION BY week_no) AS x13, f13 - b13 AS h13, f26 - avg(f26) OVER (PARTITION BY week_no) AS x26, f26 - b26 AS h26 FROM f)
SELECT *, {ZONE} AS zone, {CELL} AS cell FROM x WHERE c IS NOT NULL""")


def bench(spark, sf):
    return views.bars(spark, sf).join(views.calendar(spark, sf), "trade_date").groupBy("idx").agg((F.sum("amount") / F.sum("volume")).alias("bench"))


@views.kept
def weekly(spark, sf):
    return flows.weekly_table(crowding(spark, sf), flows.week_ends(views.calendar(spark, sf)), bench(spark, sf))


@query("crowding_weekly", "B5", oracle("weekly", """
SELECT code, week_no, round(c, 6) AS c, round(x13, 6) AS x13, round(h13, 6) AS h13, round(x26, 6) AS x26, round(h26, 6) AS h26, zone, cell FROM weekly"""))
def crowding_weekly(spark, sf):
    return rounded(weekly(spark, sf).select("code", "week_no", "c", "x13", "h13", "x26", "h26", "zone", "cell"), "c", "x13", "h13", "x26", "h26")


ENTRIES = "SELECT code, week_no, c FROM (SELECT *, lag(week_no) OVER (PARTITION BY code ORDER BY week_no) AS b FROM weekly WHERE c > 1.3) WHERE b IS NULL OR week_no - b > 13"


@query("crowding_entries", "B6 G21", oracle("weekly", f"SELECT code, week_no, round(c, 6) AS c FROM ({ENTRIES})"))
def crowding_entries(spark, sf):
    return rounded(flows.entries(weekly(spark, sf), level=1.3).select("code", "week_no", "c"), "c")


@query("crowding_pit_statistics", "B7", oracle("weekly weeks", """
WITH k AS (SELECT zone, week_no + 13 AS known, x13 AS x FROM weekly WHERE x13 IS NOT NULL AND zone IS NOT NULL),
g AS (SELECT z.zone, w.week_no FROM (SELECT DISTINCT zone FROM k) z, weeks w)
SELECT g.zone, g.week_no, count(k.x) AS n, round(avg(k.x), 6) + 0.0::DOUBLE AS mean, round(avg(CAST(k.x < 0 AS INTEGER)), 6) AS losses FROM g LEFT JOIN k ON k.zone = g.zone AND k.known <= g.week_no GROUP BY 1, 2"""))
def crowding_pit_statistics(spark, sf):
    return rounded(flows.pit_statistics(weekly(spark, sf), "zone", flows.week_ends(views.calendar(spark, sf)), 13), "mean", "losses")


@query("crowding_crossings", "B8 C6", oracle("crowding", """
WITH m AS (SELECT code, idx, c, CASE WHEN c > 1.4 AND NOT coalesce(p > 1.4, false) THEN 'crowded' WHEN c < 1.1 AND NOT coalesce(p < 1.1, false) THEN 'relief' END AS event
 FROM (SELECT *, lag(c) OVER (PARTITION BY code ORDER BY idx) AS p FROM crowding)),
e AS (SELECT *, lag(event) OVER (PARTITION BY code ORDER BY idx) AS pe FROM m WHERE event IS NOT NULL)
SELECT code, idx, event, round(c, 6) AS c FROM e WHERE event = 'crowded' OR pe = 'crowded'"""))
def crowding_crossings(spark, sf):
    return rounded(flows.crossings(crowding(spark, sf), high=1.4, low=1.1), "c")


@query("crowding_spells", "V13", oracle("weekly", f"""
SELECT e.code, e.week_no, (SELECT min(w.week_no) FROM weekly w WHERE w.code = e.code AND w.week_no > e.week_no AND w.c < 0.9) - e.week_no AS weeks FROM ({ENTRIES}) e"""))
def crowding_spells(spark, sf):
    w = weekly(spark, sf)
    return flows.spell_lengths(flows.entries(w, level=1.3), w, 0.9)


@query("crowding_measures", "V19", oracle("crowding", """
SELECT code, round(avg(abs(c - c60)), 6) AS gap_60, round(avg(abs(c - rel)), 6) AS gap_rel, count(*) AS n FROM
(SELECT code, c, avg(share) OVER (PARTITION BY code ORDER BY idx ROWS 59 PRECEDING) / avg(share) OVER (PARTITION BY code ORDER BY idx ROWS 749 PRECEDING) AS c60, share * count(share) OVER (PARTITION BY idx) AS rel FROM crowding)
WHERE c IS NOT NULL AND c60 IS NOT NULL AND rel IS NOT NULL GROUP BY 1"""))
def crowding_measures(spark, sf):
    s = F.col("share")
    rows = crowding(spark, sf).withColumns({
        "c60": F.avg(s).over(windows.last_n(60, "code")) / F.avg(s).over(windows.last_n(750, "code")),
        "rel": s * F.count(s).over(Window.partitionBy("idx"))}).dropna(subset=["c", "c60", "rel"])
    return rows.groupBy("code").agg(r6(F.avg(F.abs(F.col("c") - F.col("c60")))).alias("gap_60"),
                                    r6(F.avg(F.abs(F.col("c") - F.col("rel")))).alias("gap_rel"), F.count("*").alias("n"))


@query("relative_strength", "B9", oracle("crowding bench", """
SELECT k.code, k.idx, round(k.close / first_value(k.close IGNORE NULLS) OVER (PARTITION BY k.code ORDER BY k.idx) / (b.bench / first_value(b.bench) OVER (PARTITION BY k.code ORDER BY k.idx)), 6) AS rs FROM crowding k JOIN bench b USING (idx)"""))
def relative_strength(spark, sf):
    rows = crowding(spark, sf).join(bench(spark, sf), "idx")
    w = windows.so_far("code")
    rs = F.col("close") / F.first("close", True).over(w) / (F.col("bench") / F.first("bench").over(w))
    return rows.select("code", "idx", r6(rs).alias("rs"))


# -- fund flows ---------------------------------------------------------------------------

define("fund_shares", "bars", "SELECT symbol, trade_date, (1000000 + volume * 3000) * CASE WHEN year(trade_date) >= 1998 THEN 2 ELSE 1 END::DOUBLE AS shares FROM bars")
define("fund_flows", "fund_shares bars calendar", """
WITH f AS (SELECT s.symbol, s.trade_date, c.idx, s.shares, b.close::DOUBLE AS close FROM fund_shares s JOIN calendar c USING (trade_date) LEFT JOIN bars b USING (symbol, trade_date)),
p AS (SELECT *, lag(shares) OVER w AS ps, lag(idx) OVER w AS pi, close / lag(close) OVER w AS pr FROM f WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
q AS (SELECT *, shares / ps AS ratio, lag(pr) OVER w AS pr1, lead(pr) OVER w AS pr2 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
e AS (SELECT *, CASE WHEN ps IS NULL THEN 'new' WHEN idx - pi > 5 THEN 'gap' WHEN abs(ln(ratio)) >= ln(1.4) AND (coalesce(abs(ln(pr * ratio)) <= ln(1.25), false) OR coalesce(abs(ln(pr1 * ratio)) <= ln(1.25), false) OR coalesce(abs(ln(pr2 * ratio)) <= ln(1.25), false)) THEN 'split'
  WHEN abs(ln(ratio)) >= ln(1.4) AND pr IS NULL AND pr1 IS NULL AND pr2 IS NULL THEN 'jump' END AS event FROM q)
SELECT symbol, trade_date, idx, shares, close, shares * close AS aum, shares - ps AS share_change, CASE WHEN event IS NULL THEN (shares - ps) * close END AS flow, event FROM e""")


@views.kept
def fund_flows(spark, sf):
    daily = views.bars(spark, sf)
    shares = daily.select("symbol", "trade_date", ((F.lit(1000000) + F.col("volume") * 3000) * F.when(
        F.year("trade_date") >= 1998, 2).otherwise(1)).cast("double").alias("shares"))
    return flows.fund_flows(shares, daily.select("symbol", "trade_date", F.col("close").cast("double").alias("close")), views.calendar(spark, sf))


@query("fund_flows", "B10", oracle("fund_flows", "SELECT symbol, trade_date, aum, share_change, flow, event FROM fund_flows"))
def fund_flows_query(spark, sf):
    return fund_flows(spark, sf).select("symbol", "trade_date", "aum", "share_change", "flow", "event")


define("group_flows", "fund_flows classes", """
WITH d AS (SELECT industry AS group_id, trade_date, sum(aum) AS aum, sum(flow) AS flow, count(DISTINCT symbol) AS funds, count(aum) AS priced_funds, count(event) AS events FROM fund_flows JOIN classes USING (symbol) GROUP BY 1, 2),
p AS (SELECT *, flow / lag(aum) OVER w AS flow_pct, lag(aum) OVER w AS pa, count(flow) OVER b AS n, quantile_cont(flow, 0.5) OVER b AS m, quantile_cont(flow, 0.75) OVER b AS q3, quantile_cont(flow, 0.25) OVER b AS q1
 FROM d WINDOW w AS (PARTITION BY group_id ORDER BY trade_date), b AS (PARTITION BY group_id ORDER BY trade_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN n >= 60 AND greatest((q3 - q1) / 1.349, 0.0001 * pa) > 0 THEN (flow - m) / greatest((q3 - q1) / 1.349, 0.0001 * pa) END AS zz FROM p)
SELECT *, round_even(zz, 2) AS z FROM z""")
ABNORMAL = "CASE WHEN z >= 4 AND flow_pct >= 0.005 THEN 'in' WHEN z <= -4 AND flow_pct <= -0.005 THEN 'out' END"


@views.kept
def group_flows(spark, sf):
    from .common import classes
    return flows.group_flows(fund_flows(spark, sf).join(classes(spark, sf).withColumnRenamed("industry", "group_id"), "symbol"))


@query("group_flows", "B11 W14", oracle("group_flows", f"""
SELECT group_id, trade_date, aum, flow, round(flow_pct, 6) AS flow_pct, funds, priced_funds, events, round(z, 2) + 0.0::DOUBLE AS z, {ABNORMAL} AS abnormal, ({ABNORMAL}) IS NOT NULL AND abs(z) >= 8 AND abs(flow_pct) >= 0.02 AS strong FROM group_flows"""))
def group_flows_query(spark, sf):
    return group_flows(spark, sf).select("group_id", "trade_date", "aum", "flow", r6("flow_pct").alias("flow_pct"), "funds", "priced_funds", "events",
                                         F.round("z", 2).alias("z"), "abnormal", "strong")


@query("trailing_flow_sums", "B12", oracle("group_flows", """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY trade_date DESC) AS age FROM group_flows)
SELECT group_id, """ + ", ".join(f"coalesce(sum(flow) FILTER (age <= {n}), 0) AS flow_{n}d" for n in (1, 5, 20, 60, 250)) + " FROM a GROUP BY 1"))
def trailing_flow_sums(spark, sf):
    return flows.trailing_flows(group_flows(spark, sf), (1, 5, 20, 60, 250))


define("waves", "group_flows bench calendar", """
WITH d AS (SELECT g.group_id, g.trade_date, g.flow, g.aum, b.bench AS ic, row_number() OVER (PARTITION BY group_id ORDER BY g.trade_date) AS n FROM group_flows g JOIN calendar c USING (trade_date) JOIN bench b USING (idx)),
f AS (SELECT *, CASE WHEN n >= 10 THEN sum(coalesce(flow, 0)) OVER (PARTITION BY group_id ORDER BY n ROWS 9 PRECEDING) END AS wave_flow, lag(aum, 10) OVER (PARTITION BY group_id ORDER BY n) AS a10 FROM d),
p AS (SELECT *, wave_flow / a10 AS wave_pct FROM f),
q AS (SELECT *, CASE WHEN count(wave_pct) OVER b >= 250 THEN quantile_cont(wave_pct, 0.02) OVER b END AS low, CASE WHEN count(wave_pct) OVER b >= 250 THEN quantile_cont(wave_pct, 0.98) OVER b END AS high,
  ic / lag(ic, 10) OVER w - 1 AS index_window, lead(ic, 5) OVER w / ic - 1 AS after_5, lead(ic, 20) OVER w / ic - 1 AS after_20, lead(ic, 60) OVER w / ic - 1 AS after_60, sign(coalesce(flow, 0)) AS s
 FROM p WINDOW w AS (PARTITION BY group_id ORDER BY n), b AS (PARTITION BY group_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, last_value(CASE WHEN wave_pct > high THEN n END IGNORE NULLS) OVER b AS lc, last_value(CASE WHEN wave_pct < low THEN n END IGNORE NULLS) OVER b AS lr,
  n - row_number() OVER (PARTITION BY group_id, s ORDER BY n) AS g FROM q WINDOW b AS (PARTITION BY group_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, CASE WHEN wave_pct < low AND (lr IS NULL OR n - lr > 20) THEN 'redemption' WHEN wave_pct > high AND (lc IS NULL OR n - lc > 20) THEN 'creation' END AS wave,
 CAST(s * row_number() OVER (PARTITION BY group_id, s, g ORDER BY n) AS INTEGER) AS streak FROM h""")


@views.kept
def waves(spark, sf):
    index = bench(spark, sf).join(views.calendar(spark, sf), "idx").select("trade_date", F.col("bench").alias("index_close"))
    return flows.flow_waves(group_flows(spark, sf).select("group_id", "trade_date", "flow", "aum").join(index, "trade_date"))


@query("flow_waves", "B13 W13 G20", oracle("waves", """
SELECT group_id, trade_date, round(wave_pct, 6) + 0.0::DOUBLE AS wave_pct, round(low, 6) AS low, round(high, 6) AS high, round(index_window, 6) AS index_window, round(after_20, 6) AS after_20, streak, wave,
 coalesce((wave = 'redemption' AND coalesce(index_window > 0, false)) OR (wave = 'creation' AND NOT coalesce(index_window > 0, false) AND index_window IS NOT NULL), false) AS counter FROM waves"""))
def flow_waves(spark, sf):
    return rounded(waves(spark, sf).select("group_id", "trade_date", "wave_pct", "low", "high", "index_window", "after_20", "streak", "wave", "counter"),
                   "wave_pct", "low", "high", "index_window", "after_20")


@query("expanding_percentile_rank", "W13", oracle("waves", """
SELECT a.group_id, a.trade_date, CASE WHEN count(b.wave_pct) >= 250 THEN round((count(*) FILTER (b.wave_pct < a.wave_pct) + (count(*) FILTER (b.wave_pct = a.wave_pct) + 1) / 2.0::DOUBLE) / count(b.wave_pct), 6) END AS rank
FROM waves a LEFT JOIN waves b ON a.group_id = b.group_id AND b.n <= a.n AND b.wave_pct IS NOT NULL WHERE a.wave_pct IS NOT NULL GROUP BY 1, 2"""))
def expanding_percentile_rank(spark, sf):
    return rounded(waves(spark, sf).filter("wave_pct is not null").select("group_id", "trade_date", "rank"), "rank")


@query("wave_base_rates", "B13", oracle("waves", """
SELECT horizon, round(avg(ret), 6) AS mean, round(avg(CAST(ret > 0 AS INTEGER)), 6) AS up, count(*) AS n FROM (UNPIVOT (SELECT after_5, after_20, after_60 FROM waves) ON after_5, after_20, after_60 INTO NAME horizon VALUE ret) GROUP BY 1"""))
def wave_base_rates(spark, sf):
    return rounded(flows.wave_base(waves(spark, sf)), "mean", "up")


@query("completeness_cut", "B14", """
SELECT l_returnflag, count(*) AS rows FROM lineitem WHERE CAST(l_shipdate AS DATE) <= (SELECT min(m) FROM (SELECT max(CAST(l_shipdate AS DATE)) AS m FROM lineitem GROUP BY l_suppkey)) GROUP BY 1""")
def completeness_cut(spark, sf):
    l = read_table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", F.to_date("l_shipdate").alias("trade_date"))
    return flows.complete_until(l, "l_suppkey").groupBy("l_returnflag").agg(F.count("*").alias("rows"))


PATTERNS = [("ring", "ring$"), ("red", "^red|bolt"), ("small", "small|widget")]


@query("group_membership", "B15", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'override' WHEN regexp_matches(p_name, 'ring$') THEN 'ring' WHEN regexp_matches(p_name, '^red|bolt') THEN 'red' WHEN regexp_matches(p_name, 'small|widget') THEN 'small' ELSE 'other' END AS group_id
FROM part WHERE NOT regexp_matches(p_type, 'PROMO')""")
def group_membership(spark, sf):
    p = read_table(spark, sf, "part").filter(~F.col("p_type").rlike("PROMO"))
    group = F.coalesce(F.when(F.col("p_brand") == "Brand#5", "override"), flows.first_class(F.col("p_name"), PATTERNS))
    return p.select("p_partkey", group.alias("group_id"))


@query("class_holdings", "B16 J15", oracle("bars", """
WITH h AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, last_day(CAST(o_orderdate AS DATE)) AS period, o_orderstatus AS cls, count(*) AS shares FROM orders GROUP BY ALL),
v AS (SELECT h.period, h.cls, h.shares * b.close AS value FROM h ASOF LEFT JOIN bars b ON h.symbol = b.symbol AND h.period >= b.trade_date)
SELECT period, CAST(sum(value) FILTER (cls = 'F') AS BIGINT) AS final, CAST(sum(value) FILTER (cls = 'O') AS BIGINT) AS open, CAST(sum(value) FILTER (cls = 'P') AS BIGINT) AS pending FROM v GROUP BY 1"""))
def class_holdings(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("symbol", F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")))
    held = o.groupBy("symbol", F.last_day("o_orderdate").alias("period"), F.col("o_orderstatus").alias("cls")).agg(F.count("*").alias("shares"))
    valued = asof.asof_join(held, views.bars(spark, sf), ["symbol"], "period", "trade_date", ["close"])
    pick = lambda c: F.sum(F.when(F.col("cls") == c, F.col("shares") * F.col("close")))
    return valued.groupBy("period").agg(pick("F").alias("final"), pick("O").alias("open"), pick("P").alias("pending"))


@query("fund_table_on_day", "B17", oracle("fund_flows", """
SELECT symbol, trade_date, aum, coalesce(sum(flow) OVER (PARTITION BY symbol ORDER BY idx ROWS 4 PRECEDING), 0) AS flow_5d, coalesce(sum(flow) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING), 0) AS flow_20d
FROM fund_flows QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1"""))
def fund_table_on_day(spark, sf):
    zero = F.lit(0.0)
    rows = fund_flows(spark, sf).withColumns({f"flow_{n}d": F.coalesce(F.sum("flow").over(windows.last_n(n)), zero) for n in (5, 20)})
    rows = rows.groupBy("symbol").agg(F.max_by(F.struct("trade_date", "aum", "flow_5d", "flow_20d"), "idx").alias("r"))
    return rows.select("symbol", "r.*")


# -- options ---------------------------------------------------------------------------------

define("quotes", "", """
SELECT l_returnflag AS underlying, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, CAST(l_suppkey % 3 + 1 AS INTEGER) AS term, (30 * (l_suppkey % 3 + 1)) / 365.0::DOUBLE AS t, CAST(l_quantity AS BIGINT) * 100 AS strike,
 CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'put' END AS kind, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_partkey % 500 + 1 END AS bid, l_partkey % 500 + 1 + l_orderkey % 20 AS ask FROM lineitem""")


def quotes(spark, sf):
    return quotes_from(read_table(spark, sf, "lineitem"))


def quotes_from(l):
    p = F.col("l_partkey") % 500 + 1
    term = F.col("l_suppkey") % 3 + 1
    return l.select(F.col("l_returnflag").alias("underlying"), F.to_date(F.trunc("l_shipdate", "month")).alias("day"), term.cast("int").alias("term"),
                    (30 * term / 365.0).alias("t"), (F.col("l_quantity").cast("long") * 100).alias("strike"),
                    F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("put").alias("kind"),
                    F.when(F.col("l_partkey") % 4 == 0, 0).otherwise(p).alias("bid"), (p + F.col("l_orderkey") % 20).alias("ask"))


define("terms", "quotes", """
WITH m AS (SELECT underlying, day, term, t, strike, avg((bid + ask) / 2.0::DOUBLE) FILTER (kind = 'call' AND bid > 0) AS call, avg((bid + ask) / 2.0::DOUBLE) FILTER (kind = 'put' AND bid > 0) AS put FROM quotes GROUP BY ALL),
k AS (SELECT underlying, day, term, arg_min(row(strike, call, put), row(abs(call - put), strike)) AS k FROM m WHERE call IS NOT NULL AND put IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT m.*, k.k[1] + exp(0.015 * t) * (k.k[2] - k.k[3]) AS forward FROM m JOIN k USING (underlying, day, term)),
z AS (SELECT *, max(strike) FILTER (strike <= forward) OVER (PARTITION BY underlying, day, term) AS k0 FROM f),
s AS (SELECT *, CASE WHEN strike < k0 THEN put WHEN strike > k0 THEN call ELSE coalesce((call + put) / 2, call, put) END AS q, sign(strike - k0) AS side FROM z WHERE k0 IS NOT NULL),
a AS (SELECT *, q IS NULL AND coalesce(lag(q IS NULL) OVER (PARTITION BY underlying, day, term, side ORDER BY abs(strike - k0)), false) AS twice, max(CASE WHEN side = 0 AND q IS NOT NULL THEN 1 END) OVER (PARTITION BY underlying, day, term) AS ok FROM s),
b AS (SELECT *, bool_or(twice) OVER (PARTITION BY underlying, day, term, side ORDER BY abs(strike - k0)) AS stop FROM a),
u AS (SELECT *, lag(strike) OVER w AS lo, lead(strike) OVER w AS hi FROM b WHERE ok = 1 AND NOT stop AND q IS NOT NULL WINDOW w AS (PARTITION BY underlying, day, term ORDER BY strike)),
g AS (SELECT underlying, day, term, t, forward, k0, count(*) AS strikes, sum(CASE WHEN lo IS NULL THEN hi - strike WHEN hi IS NULL THEN strike - lo ELSE (hi - lo) / 2.0::DOUBLE END / (strike * strike) * q) AS s FROM u GROUP BY ALL HAVING count(*) >= 3)
SELECT underlying, day, term, t, forward, strikes, 2 / t * exp(0.015 * t) * s - (forward / k0 - 1) * (forward / k0 - 1) / t AS variance FROM g""")


@views.kept
def terms(spark, sf):
    return options.term_variance(quotes(spark, sf), ["underlying", "day", "term"], 0.015)


@query("term_variance", "O4", oracle("terms", "SELECT underlying, day, term, round(forward, 6) AS forward, strikes, round(variance, 6) AS variance FROM terms"))
def term_variance(spark, sf):
    return rounded(terms(spark, sf).drop("t"), "forward", "variance")


define("vol_index", "terms", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY underlying, day ORDER BY term) AS p FROM terms WHERE t * 365 >= 7),
g AS (SELECT underlying, day, max(t) FILTER (p = 1) AS t1, max(variance) FILTER (p = 1) AS v1, max(t) FILTER (p = 2) AS t2, max(variance) FILTER (p = 2) AS v2, CAST(sum(strikes) AS BIGINT) AS strikes FROM p WHERE p <= 2 GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN t2 IS NULL THEN v1 ELSE (t1 * v1 * ((t2 - 30.0::DOUBLE / 365) / (t2 - t1)) + t2 * v2 * (1 - (t2 - 30.0::DOUBLE / 365) / (t2 - t1))) / (30.0::DOUBLE / 365) END AS x FROM g)
SELECT underlying, day, CASE WHEN x > 0 THEN 100 * sqrt(x) END AS value, CASE WHEN v1 > 0 THEN 100 * sqrt(v1) END AS near_vol, CASE WHEN v2 > 0 THEN 100 * sqrt(v2) END AS next_vol, strikes FROM v""")


def vol_index(spark, sf):
    return options.thirty_day(terms(spark, sf), ["underlying", "day"], "term")


@query("volatility_index", "O5 O6", oracle("vol_index", "SELECT underlying, day, round(value, 6) AS value, round(near_vol, 6) AS near_vol, round(next_vol, 6) AS next_vol, strikes FROM vol_index"))
def volatility_index(spark, sf):
    return rounded(vol_index(spark, sf), "value", "near_vol", "next_vol")


@query("volatility_alerts", "O8", oracle("vol_index", """
SELECT a.underlying, a.day, round(a.value / a.p - 1, 6) + 0.0::DOUBLE AS rise, round(a.pct, 6) AS percentile, coalesce(a.value / a.p - 1 >= 0.05 AND a.pct >= 0.5, false) AS alert FROM
(SELECT v.*, lag(value) OVER (PARTITION BY underlying ORDER BY day) AS p, CASE WHEN value IS NOT NULL AND len(seen) > 0 THEN len(list_filter(seen, lambda x: x <= value)) / len(seen)::DOUBLE END AS pct FROM (SELECT *, list(value) FILTER (value IS NOT NULL) OVER (PARTITION BY underlying ORDER BY day ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seen FROM vol_index) v) a"""))
def volatility_alerts(spark, sf):
    rows = options.alerts(vol_index(spark, sf), ["underlying"], "day", "value", 0.05, 0.5, 24)
    return rounded(rows.select("underlying", "day", "rise", "percentile", "alert"), "rise", "percentile")


@query("thin_minutes", "O8", oracle("terms", """
SELECT underlying, day, term, strikes, coalesce(count(*) OVER w >= 5 AND strikes < 0.9::DOUBLE * quantile_cont(strikes, 0.5) OVER w, false) AS thin FROM terms WINDOW w AS (PARTITION BY underlying, term ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def thin_minutes(spark, sf):
    return options.thin(terms(spark, sf).select("underlying", "day", "term", "strikes"), ["underlying", "term"], "day", "strikes", 0.9)


@query("minute_quote_replay", "O7", """
WITH g AS (SELECT event_type AS c, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS m, round(arg_max(value, ts), 2) AS v FROM events GROUP BY 1, 2),
a AS (SELECT c, unnest(generate_series(min(m), max(m), INTERVAL 1 HOUR)) AS m FROM g GROUP BY 1)
SELECT a.c, strftime(a.m, '%Y-%m-%d %H:%M') AS minute, last_value(g.v IGNORE NULLS) OVER (PARTITION BY a.c ORDER BY a.m) AS quote FROM a LEFT JOIN g USING (c, m)""")
def minute_quote_replay(spark, sf):
    e = read_table(spark, sf, "events")
    hours = e.groupBy(F.col("event_type").alias("c"), F.date_trunc("hour", "ts").alias("m")).agg(F.round(F.max_by("value", "ts"), 2).alias("quote"))
    grid = hours.groupBy("c").agg(F.min("m").alias("a"), F.max("m").alias("b")).select("c", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("m"))
    filled = options.carry_quotes(grid.join(hours, ["c", "m"], "left"), ["c"], "m", ["quote"])
    return filled.select("c", F.date_format("m", "yyyy-MM-dd HH:mm").alias("minute"), "quote")


define("option_bars", "quotes", """
SELECT *, lag(close) OVER (PARTITION BY underlying, term, strike, kind ORDER BY day) AS prev_close FROM (SELECT underlying, term, strike, kind, day, avg(bid + ask) / 2.0::DOUBLE AS close FROM quotes GROUP BY ALL)""")
define("spots", "quotes", "SELECT underlying, term, day, round(avg(strike), 2) AS spot FROM quotes GROUP BY ALL")


def option_bars(spark, sf):
    q = quotes(spark, sf)
    daily = q.groupBy("underlying", "term", "strike", "kind", "day").agg((F.avg(F.col("bid") + F.col("ask")) / 2).alias("close"))
    return daily.withColumn("prev_close", F.lag("close").over(Window.partitionBy("underlying", "term", "strike", "kind").orderBy("day")))


def spots(spark, sf):
    return quotes(spark, sf).groupBy("underlying", "term", "day").agg(F.round(F.avg("strike"), 2).alias("spot"))


@query("option_directory", "O1", oracle("option_bars", """
SELECT underlying, min(day) AS first_day, max(day) AS last_day, count(DISTINCT (term, strike, kind)) AS contracts, count(DISTINCT (term, strike, kind)) FILTER (day >= DATE '2001-06-01') AS live FROM option_bars GROUP BY 1"""))
def option_directory(spark, sf):
    c = F.struct("term", "strike", "kind")
    return option_bars(spark, sf).groupBy("underlying").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.countDistinct(c).alias("contracts"),
                                                            F.countDistinct(F.when(F.col("day") >= F.to_date(F.lit("2001-06-01")), c)).alias("live"))


@query("option_chain", "O2", oracle("option_bars spots", """
WITH r AS (SELECT b.*, s.spot, greatest(CASE WHEN kind = 'call' THEN spot - strike ELSE strike - spot END, 0) AS iv FROM option_bars b JOIN spots s USING (underlying, term, day)),
t AS (SELECT underlying, term, day, strike, any_value(spot) AS spot, """ + ", ".join(
    f"max({e}) FILTER (kind = '{k}') AS {k}_{n}" for k in ("call", "put") for n, e in (("close", "close"), ("change", "close - prev_close"), ("intrinsic", "iv"), ("time_value", "close - iv"))) + """ FROM r GROUP BY 1, 2, 3, 4)
SELECT underlying, term, day, strike, spot, """ + ", ".join(f"round({k}_{n}, 4) + 0.0::DOUBLE AS {k}_{n}" for k in ("call", "put") for n in ("close", "change", "intrinsic", "time_value")) + """,
 strike = first_value(strike) OVER (PARTITION BY underlying, term, day ORDER BY abs(strike - spot), strike) AS atm FROM t"""))
def option_chain(spark, sf):
    table = options.chain(option_bars(spark, sf), spots(spark, sf), ["underlying", "term", "day"])
    return table.withColumns({c: F.round(c, 4) for c in table.columns if c.startswith(("call_", "put_"))})


@query("contract_history", "O3", oracle("option_bars spots", """
SELECT underlying, term, strike, kind, day, round(close, 4) AS close, spot, round(greatest(CASE WHEN kind = 'call' THEN spot - strike ELSE strike - spot END, 0), 4) AS intrinsic,
 round(close - greatest(CASE WHEN kind = 'call' THEN spot - strike ELSE strike - spot END, 0), 4) + 0.0::DOUBLE AS time_value FROM option_bars LEFT JOIN spots USING (underlying, term, day)"""))
def contract_history(spark, sf):
    rows = option_bars(spark, sf).join(spots(spark, sf), ["underlying", "term", "day"], "left")
    value = options.intrinsic(F.col("kind"), F.col("spot"), F.col("strike"))
    return rows.select("underlying", "term", "strike", "kind", "day", F.round("close", 4).alias("close"), "spot", F.round(value, 4).alias("intrinsic"),
                       F.round(F.col("close") - value, 4).alias("time_value"))


@query("put_selection_returns", "O9", oracle("option_bars spots", """
WITH c AS (SELECT underlying, term, day, strike, close, lead(close, 2) OVER (PARTITION BY underlying, term, strike, kind ORDER BY day) AS later, strike / spot AS m FROM option_bars JOIN spots USING (underlying, term, day) WHERE kind = 'put')
SELECT underlying, term, day, strike, round(later / nullif(close, 0) - 1, 6) + 0.0::DOUBLE AS ret FROM c QUALIFY row_number() OVER (PARTITION BY underlying, term, day ORDER BY abs(m - 0.9), strike) = 1"""))
def put_selection_returns(spark, sf):
    puts = option_bars(spark, sf).filter("kind = 'put'")
    puts = puts.withColumn("later", F.lead("close", 2).over(Window.partitionBy("underlying", "term", "strike").orderBy("day")))
    rows = puts.join(spots(spark, sf), ["underlying", "term", "day"]).withColumn("m", F.col("strike") / F.col("spot"))
    picked = options.pick_by_target(rows, ["underlying", "term", "day"], "m", 0.9, "strike")
    return picked.select("underlying", "term", "day", "strike", r6(F.try_divide("later", "close") - 1).alias("ret"))


@query("put_exit_rule", "O9", oracle("option_bars", """
WITH p AS (SELECT *, first_value(close) OVER (PARTITION BY underlying, term, strike ORDER BY day) AS entry FROM option_bars WHERE kind = 'put')
SELECT underlying, term, strike, min(day) FILTER (close >= 2 * entry) AS exit_day, round(coalesce(arg_min(close, day) FILTER (close >= 2 * entry), arg_max(close, day)), 4) AS exit_value FROM p GROUP BY 1, 2, 3"""))
def put_exit_rule(spark, sf):
    by = ["underlying", "term", "strike"]
    puts = option_bars(spark, sf).filter("kind = 'put'").withColumn("entry", F.first("close").over(Window.partitionBy(*by).orderBy("day")))
    out = options.first_hit(puts, by, "day", F.col("close") >= 2 * F.col("entry"), "close")
    return out.withColumn("exit_value", F.round("exit_value", 4))


def _hart(x: str) -> str:
    """The normal distribution function in SQL."""
    def polynomial(a, terms):
        out = str(terms[0])
        for c in terms[1:]:
            out = f"({out} * {a} + {c})"
        return out

    a = f"abs({x})"
    far = f"({a} + 0.65)"
    for c in (4, 3, 2, 1):
        far = f"({a} + {c}.0::DOUBLE / {far})"
    tail = (f"(CASE WHEN {a} > {options.HART_END} THEN 0 ELSE exp(-{a} * {a} / 2) * CASE WHEN {a} < {options.HART_CUT} THEN "
            f"{polynomial(a, options.HART_TOP)}::DOUBLE / {polynomial(a, options.HART_BOTTOM)} ELSE 1 / ({far} * {options.ROOT_TWO_PI}) END END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


RATE = 0.015
_VALUE = f"CASE WHEN kind = 'call' THEN spot * {_hart('d')} - paid * {_hart('e')} ELSE paid * {_hart('(-e)')} - spot * {_hart('(-d)')} END"
_AT = lambda vol: (f"SELECT *, {_VALUE} AS p FROM (SELECT *, d - {vol} * sqrt(t) AS e FROM (SELECT *, (ln(spot / strike) + ({RATE}::DOUBLE + {vol} * {vol} / 2) * t) / ({vol} * sqrt(t)) AS d FROM {{}}))")
# the volatility by plain bisection, sixty halvings
define("option_risk", "option_bars spots", f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT underlying, term, day, strike::DOUBLE AS strike, kind, close, spot, 30.0::DOUBLE * term / 365 AS t, strike * exp(-{RATE}::DOUBLE * (30.0::DOUBLE * term / 365)) AS paid FROM option_bars JOIN spots USING (underlying, term, day)),
lowest AS ({_AT(str(options.VOL_LOW) + '::DOUBLE').format('b')}), highest AS ({_AT(str(options.VOL_HIGH) + '::DOUBLE').format('b')}),
u AS (SELECT b.* FROM b JOIN lowest l USING (underlying, term, day, strike, kind) JOIN highest h USING (underlying, term, day, strike, kind)
 WHERE b.spot > 0 AND b.close >= greatest(CASE WHEN b.kind = 'call' THEN b.spot - b.paid ELSE b.paid - b.spot END, 0) + {options.TIME_VALUE}::DOUBLE * b.spot AND b.close > l.p AND b.close < h.p),
r AS (SELECT *, 0 AS k, {options.VOL_LOW}::DOUBLE AS low, {options.VOL_HIGH}::DOUBLE AS high FROM u
 UNION ALL SELECT underlying, term, day, strike, kind, close, spot, t, paid, k + 1, CASE WHEN p > close THEN low ELSE (low + high) / 2 END, CASE WHEN p > close THEN (low + high) / 2 ELSE high END
 FROM ({_AT('((low + high) / 2)').format('r')}) WHERE k < 60),
v AS (SELECT *, (low + high) / 2 AS iv FROM r WHERE k = 60)
SELECT b.underlying, b.term, b.day, b.strike::BIGINT AS strike, b.kind, b.close, b.spot, v.iv, v.delta FROM b LEFT JOIN (
 SELECT underlying, term, day, strike, kind, iv, CASE WHEN kind = 'call' THEN {_hart('d')} ELSE {_hart('d')} - 1 END AS delta FROM (SELECT *, (ln(spot / strike) + ({RATE}::DOUBLE + iv * iv / 2) * t) / (iv * sqrt(t)) AS d FROM v)) v USING (underlying, term, day, strike, kind)""")


@views.kept
def option_risk(spark, sf):
    rows = option_bars(spark, sf).join(spots(spark, sf), ["underlying", "term", "day"]).withColumn("t", 30 * F.col("term") / 365.0)
    return options.with_risk(rows, RATE).drop("t", "prev_close")


@query("option_risk", "O2", oracle("option_risk", """
SELECT underlying, term, day, strike, kind, round(iv, 6) AS iv, round(delta, 6) + 0.0::DOUBLE AS delta FROM option_risk"""))
def implied_risk(spark, sf):
    """Implied volatility and delta of every contract and day."""
    return rounded(option_risk(spark, sf).select("underlying", "term", "day", "strike", "kind", "iv", "delta"), "iv", "delta")


@query("option_chain_risk", "O2", oracle("option_risk", """
SELECT underlying, term, day, strike, round(max(iv) FILTER (kind = 'call'), 6) AS call_iv, round(max(delta) FILTER (kind = 'call'), 6) + 0.0::DOUBLE AS call_delta,
 round(max(iv) FILTER (kind = 'put'), 6) AS put_iv, round(max(delta) FILTER (kind = 'put'), 6) + 0.0::DOUBLE AS put_delta FROM option_risk GROUP BY 1, 2, 3, 4"""))
def option_chain_risk(spark, sf):
    side = [r6(F.max(F.when(F.col("kind") == k, F.col(c)))).alias(f"{k}_{c}") for k in ("call", "put") for c in ("iv", "delta")]
    return option_risk(spark, sf).groupBy("underlying", "term", "day", "strike").agg(*side)


GAINS = {"gain_50": 0.5, "gain_100": 1.0}


@query("put_delta_returns", "O9", oracle("option_risk", """
WITH p AS (SELECT *, dense_rank() OVER (PARTITION BY underlying ORDER BY day) AS i FROM option_risk WHERE kind = 'put'),
b AS (SELECT * FROM p WHERE 30 * term BETWEEN 45 AND 120), n AS (SELECT * FROM b QUALIFY term = min(term) OVER (PARTITION BY underlying, i)),
c AS (SELECT underlying, i, term, strike, delta FROM n WHERE abs(delta + 0.3) <= 0.15 QUALIFY row_number() OVER (PARTITION BY underlying, i ORDER BY abs(delta + 0.3), strike) = 1),
e AS (SELECT c.*, p.close AS entry FROM c JOIN p USING (underlying, term, strike) WHERE p.i = c.i + 1 AND p.close > 0),
x AS (SELECT e.*, p.i - e.i - 1 AS age, p.close FROM e JOIN p USING (underlying, term, strike) WHERE p.i BETWEEN e.i + 1 AND e.i + 1 + e.term),
s AS (SELECT underlying, term, strike, i, delta, entry, max(close) FILTER (age = term) AS z, max(close) FILTER (age = least(2, term)) AS h,
 arg_min(close, age) FILTER (age > 0 AND close >= 1.5 * entry) AS a, arg_min(close, age) FILTER (age > 0 AND close >= 2 * entry) AS b FROM x GROUP BY ALL)
SELECT underlying, term, strike, i, round(delta, 6) AS delta, round(entry, 6) AS entry, round(z / entry - 1, 6) + 0.0::DOUBLE AS at_end, round(h / entry - 1, 6) + 0.0::DOUBLE AS held,
 round(coalesce(a, z) / entry - 1, 6) + 0.0::DOUBLE AS gain_50, round(coalesce(b, z) / entry - 1, 6) + 0.0::DOUBLE AS gain_100 FROM s"""))
def put_delta_returns(spark, sf):
    """Puts of a delta and an expiry band, bought the session after: held, to the end, or until a gain."""
    session = F.dense_rank().over(Window.partitionBy("underlying").orderBy("day")).cast("long")
    puts = option_risk(spark, sf).filter("kind = 'put'").withColumn("i", session)
    chosen = options.pick_by_delta(puts, ["underlying", "i"], "term", 30 * F.col("term"), 45, 120, -0.3, 0.15)
    contract = ["underlying", "term", "strike"]
    out = options.exits(chosen, puts, contract, "i", F.col("term"), 2, GAINS)
    out = out.join(chosen.select(*contract, "i", "delta"), [*contract, "i"])
    return rounded(out, "delta", "entry", "at_end", "held", *GAINS)


@query("hindsight_best_price", "O10", oracle("option_bars spots", """
WITH c AS (SELECT underlying, kind, day, strike / spot AS m, close, max(close) OVER (PARTITION BY underlying, term, strike, kind ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS best FROM option_bars JOIN spots USING (underlying, term, day))
SELECT underlying, kind, CASE WHEN m < 0.8 THEN 'low' WHEN m <= 1.2 THEN 'near' ELSE 'high' END AS bucket, round(max(best / close), 6) AS top, round(avg(best / close), 6) AS mean, count(*) AS n FROM c WHERE close > 0 GROUP BY 1, 2, 3"""))
def hindsight_best_price(spark, sf):
    w = Window.partitionBy("underlying", "term", "strike", "kind").orderBy("day").rowsBetween(0, 6)
    rows = option_bars(spark, sf).join(spots(spark, sf), ["underlying", "term", "day"]).withColumn("best", F.max("close").over(w)).filter("close > 0")
    m, gain = F.col("strike") / F.col("spot"), F.col("best") / F.col("close")
    bucket = F.when(m < 0.8, "low").when(m <= 1.2, "near").otherwise("high")
    return rows.groupBy("underlying", "kind", bucket.alias("bucket")).agg(r6(F.max(gain)).alias("top"), r6(F.avg(gain)).alias("mean"), F.count("*").alias("n"))
