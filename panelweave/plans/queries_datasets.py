"""Sources, normalisers, merges and versions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import codes
from ..operators import normalize, upsert
from ..sources import io
from ..sources.io import read_table
from . import views
from .common import r6
from .ctes import define, oracle
from .queries_evaluation import rounded
from .registry import query

PREFIXES = ("600", "688", "689", "300", "000", "920", "830", "900", "700", "002")
MARKS = ("*ST", "ST", "S*ST", "XD", "XDST", "退市", "N", "ＳＴ", "", "　C")


def listings(spark, sf):
    """Customers as a security list: code, short name, dates."""
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (k % 10 + 1).cast("int")), F.lpad((k % 1000).cast("string"), 3, "0")).alias("code"),
        F.concat(F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.floor(k / 10) % 10 + 1).cast("int")), F.lit(" "), F.col("c_mktsegment")).alias("name"),
        F.date_add(F.to_date(F.lit("1991-01-01")), (k % 3000).cast("int")).alias("list_date"),
        F.when(F.col("c_acctbal") < 0, F.date_add(F.to_date(F.lit("2005-01-01")), (k % 900).cast("int"))).alias("delist_date"), "c_custkey", "c_acctbal")


define("listings", "", "SELECT [" + ", ".join(f"'{p}'" for p in PREFIXES) + "][c_custkey % 10 + 1] || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code, "
       "[" + ", ".join(f"'{m}'" for m in MARKS) + "][(c_custkey // 10) % 10 + 1] || ' ' || c_mktsegment AS name, "
       "DATE '1991-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS list_date, "
       "CASE WHEN c_acctbal < 0 THEN DATE '2005-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS delist_date, c_custkey, c_acctbal FROM customer")
EXCHANGE = "CASE WHEN regexp_matches(code, '^(900|5|6)') THEN 'SSE' WHEN regexp_matches(code, '^[0-3]') THEN 'SZSE' WHEN regexp_matches(code, '^[489]') THEN 'BSE' ELSE 'UNKNOWN' END"
BOARD = ("CASE WHEN regexp_matches(code, '^(688|689)') THEN 'STAR' WHEN regexp_matches(code, '^(600|601|603|605)') THEN 'SSE_MAIN' WHEN regexp_matches(code, '^(300|301|302)') THEN 'CHINEXT' "
         "WHEN regexp_matches(code, '^(000|001|002|003)') THEN 'SZSE_MAIN' WHEN regexp_matches(code, '^(920|43|83|87|88)') THEN 'BSE' ELSE 'UNKNOWN' END")
CLEAN = "replace(replace(replace(replace(replace({n}, 'Ｓ', 'S'), 'Ｔ', 'T'), '　', ' '), '＊', '*'), ' ', '')"
RISK = ("CASE WHEN {n} LIKE '%退' OR {n} LIKE '退市%' THEN 'DELISTING' WHEN regexp_matches({n}, '^S?\\*ST') THEN '*ST' WHEN regexp_matches({n}, '^S?ST') THEN 'ST' "
        "WHEN regexp_matches(regexp_replace({n}, '^(XD|XR|DR|N|C)', ''), '^S?\\*ST') THEN '*ST' WHEN regexp_matches(regexp_replace({n}, '^(XD|XR|DR|N|C)', ''), '^S?ST') THEN 'ST' END")


@query("security_codes", "N4", oracle("listings", f"""
SELECT c_custkey, code, {EXCHANGE} AS exchange, {BOARD} AS board, {BOARD} <> 'UNKNOWN' AS a_share, CASE WHEN code LIKE '689%' THEN 'CDR' ELSE 'A_SHARE' END AS type,
 'CN.' || {EXCHANGE} || '.' || code AS instrument, CASE {EXCHANGE} WHEN 'SSE' THEN 'sh' WHEN 'BSE' THEN 'bj' ELSE 'sz' END || code AS market_code FROM listings"""))
def security_codes(spark, sf):
    c = F.col("code")
    return listings(spark, sf).select("c_custkey", "code", codes.exchange(c).alias("exchange"), codes.board(c).alias("board"),
                                      codes.is_a_share(c).alias("a_share"), codes.security_type(c).alias("type"),
                                      codes.instrument_id(c).alias("instrument"), codes.market_code(c).alias("market_code"))


@query("risk_names", "N5 N6", oracle("listings", f"""
SELECT c_custkey, n AS clean, {RISK.format(n='n')} AS status FROM (SELECT c_custkey, upper({CLEAN.format(n='name')}) AS n FROM listings)"""))
def risk_names(spark, sf):
    return listings(spark, sf).select("c_custkey", F.upper(codes.clean_name(F.col("name"))).alias("clean"),
                                      codes.risk_status(F.col("name")).alias("status"))


define("master", "listings", f"""
WITH r AS (SELECT code AS symbol, {CLEAN.format(n='name')} AS name, list_date, delist_date, c_acctbal FROM listings WHERE {BOARD} <> 'UNKNOWN'),
l AS (SELECT symbol, name, list_date, NULL::DATE AS delist_date, CASE WHEN name LIKE '退市%' OR name LIKE '%退' THEN 'delisting_period' ELSE 'listed' END AS status FROM r
 WHERE delist_date IS NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY list_date IS NULL DESC, name DESC, list_date DESC) = 1),
d AS (SELECT symbol, name, list_date, delist_date, 'delisted' AS status FROM r WHERE delist_date IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY list_date, name DESC) = 1)
SELECT * FROM l UNION ALL SELECT * FROM d WHERE symbol NOT IN (SELECT symbol FROM l)""")


def master(spark, sf):
    rows = listings(spark, sf)
    return normalize.security_master(rows.filter("delist_date is null"), rows.filter("delist_date is not null"))


@query("security_master", "N7", oracle("master", f"""
SELECT symbol, name, delist_date, status, {BOARD.replace('code', 'symbol')} AS board, {EXCHANGE.replace('code', 'symbol')} AS exchange FROM master"""))
def security_master(spark, sf):
    return master(spark, sf).select("symbol", "name", "delist_date", "status", "board", "exchange")


@query("instruments_view", "S10", oracle("master", "SELECT symbol, name, status FROM master WHERE status <> 'delisted'"))
def instruments_view(spark, sf):
    return master(spark, sf).filter("status <> 'delisted'").select("symbol", "name", "status")


@query("open_dates", "N8", oracle("calendar", """
SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM calendar WHERE trade_date BETWEEN '1996-01-01' AND '2000-12-31'"""))
def open_dates(spark, sf):
    from ..operators.windows import session_index
    days = views.calendar(spark, sf).filter(F.col("trade_date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return session_index(days.select("trade_date")).withColumnRenamed("idx", "n")


@query("safe_parsing", "N1 N2", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number,
 TRY_CAST(CASE WHEN event_id % 3 = 0 THEN '2024-13-45' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE event_type END AS DATE) AS day, event_type AS label FROM events""")
def safe_parsing(spark, sf):
    e = read_table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 0, "2024-13-45").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.col("event_type"))
    return e.select("event_id", normalize.safe_number(F.get_json_object("props", "$.k")).alias("number"),
                    normalize.safe_date(text).alias("day"), normalize.first_present(e, ["kind", "event_type"]).alias("label"))


@query("daily_bars_normalized", "N9 N3 N10 N11", oracle("bars", """
SELECT symbol, trade_date, open, high, low, close, volume * CASE WHEN length(symbol) = 8 THEN 100 ELSE 1 END AS volume, CASE WHEN length(symbol) = 8 THEN 100 ELSE 1 END AS volume_scale,
 'vendor_' || length(symbol) AS source, 'r1' AS run_id, 1 AS schema_version FROM bars WHERE close > 0 AND trade_date BETWEEN '1996-01-01' AND '2000-12-31'"""))
def daily_bars_normalized(spark, sf):
    raw = views.bars(spark, sf).withColumn("source", F.concat(F.lit("vendor_"), F.length("symbol").cast("string")))
    rows = normalize.daily_bars(raw, {"vendor_8": 100}).filter(normalize.valid_prices(raw)).filter(
        F.col("trade_date").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    return rows.withColumns({"run_id": F.lit("r1"), "schema_version": F.lit(1)}).drop("amount", "trades")


@query("derived_changes", "N12", oracle("bars", """
SELECT symbol, trade_date, close - p AS change, round((close - p) / p * 100, 6) AS pct_change, round((high - low) / p * 100, 6) AS amplitude_pct
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM bars)"""))
def derived_changes(spark, sf):
    rows = normalize.derived_changes(views.bars(spark, sf)).select("symbol", "trade_date", "change", "pct_change", "amplitude_pct")
    return rounded(rows, "pct_change", "amplitude_pct")


@query("index_bars_filled", "N13", oracle("bars", """
SELECT symbol, trade_date, coalesce(CASE WHEN trades > 1 THEN open END, close) AS open, coalesce(CASE WHEN trades > 1 THEN high END, close) AS high,
 coalesce(CASE WHEN trades > 1 THEN low END, close) AS low, close FROM bars"""))
def index_bars_filled(spark, sf):
    raw = views.bars(spark, sf).withColumns({c: F.when(F.col("trades") > 1, F.col(c)) for c in ("open", "high", "low")})
    return normalize.index_bars(raw).select("symbol", "trade_date", "open", "high", "low", "close")


@query("adjustment_factors_normalized", "N14", oracle("factors", """
SELECT symbol, effective_date, hfq, round(hfq / arg_max(hfq, effective_date) OVER (PARTITION BY symbol), 6) AS qfq FROM
(SELECT symbol, effective_date, hfq + 0.5 AS hfq FROM factors)"""))
def adjustment_factors_normalized(spark, sf):
    steps = views.adjustment_factors(views.bars(spark, sf))
    raw = steps.withColumn("seq", F.lit(1)).unionByName(steps.withColumns({"seq": F.lit(2), "hfq": F.col("hfq") + 0.5}))
    return rounded(normalize.adjustment_factors(raw), "qfq")


@query("market_snapshot", "N15", oracle("bars listings", f"""
SELECT c.code AS symbol, s.s_acctbal * 10000 AS amount, {RISK.format(n="upper(" + CLEAN.format(n="c.name") + ")")} IN ('ST', '*ST') AS is_st FROM listings c JOIN supplier s ON s.s_suppkey = c.c_custkey"""))
def market_snapshot(spark, sf):
    s = read_table(spark, sf, "supplier")
    rows = listings(spark, sf).join(s, F.col("s_suppkey") == F.col("c_custkey"))
    return rows.select(F.col("code").alias("symbol"), (F.col("s_acctbal") * 10000).alias("amount"),
                       codes.risk_status(F.col("name")).isin("ST", "*ST").alias("is_st"))


SNAPSHOT_COLUMNS = "symbol, name, last, volume_shares, turnover_cny, pct_change, market_cap_cny, exchange, is_st"


@query("market_snapshots", "N15", oracle("listings", f"""
WITH a AS (SELECT code AS symbol, trim(name) AS name, round(c_acctbal, 2) AS last, CAST(round(c_custkey * 100.0::DOUBLE) AS BIGINT) AS volume_shares, c_acctbal AS turnover_cny, NULL::DOUBLE AS pct_change, c_acctbal * 2 AS market_cap_cny, code, name AS n, c_custkey FROM listings WHERE c_custkey % 2 = 0),
b AS (SELECT code AS symbol, trim(name) AS name, CASE WHEN c_custkey % 3 > 0 THEN round(c_acctbal, 2) END, CAST(round((c_custkey + 0.25::DOUBLE) * 100) AS BIGINT), c_acctbal * 10000, c_acctbal / 100, c_acctbal * 100000000, code, name, c_custkey FROM listings WHERE c_custkey % 2 = 1),
u AS (SELECT *, 'a' AS layout FROM a UNION ALL SELECT *, 'b' FROM b),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY layout, symbol ORDER BY c_custkey DESC) = 1)
SELECT layout, symbol, name, last, volume_shares, round(turnover_cny, 2) AS turnover_cny, round(pct_change, 6) AS pct_change, round(market_cap_cny, 0) AS market_cap_cny, {EXCHANGE.replace('code', 'symbol')} AS exchange, coalesce({RISK.format(n="upper(" + CLEAN.format(n="name") + ")")} IN ('ST', '*ST'), false) AS is_st FROM l"""))
def market_snapshots(spark, sf):
    """Snapshots of both layouts in the same columns and units."""
    c = listings(spark, sf)
    k, money = F.col("c_custkey"), F.col("c_acctbal")
    first = c.filter(k % 2 == 0).select(F.col("code").alias("代码"), F.col("name").alias("名称"), F.round(money, 2).cast("string").alias("最新价"), k.alias("成交量"), money.alias("成交额"), (money * 2).alias("总市值"), "c_custkey")
    second = c.filter(k % 2 == 1).select(F.concat(F.lit("sh"), "code").alias("code"), "name", F.when(k % 3 > 0, F.round(money, 2).cast("string")).otherwise("-").alias("zxj"), (k + 0.25).alias("volume"),
                                         money.alias("turnover"), (money / 100).alias("zdf"), money.alias("zsz"), "c_custkey")
    day = F.to_date(F.lit("2002-01-31"))
    parts = [normalize.market_snapshot(t, day, "c_custkey").withColumn("layout", F.lit(name)) for name, t in (("a", first), ("b", second))]
    out = parts[0].unionByName(parts[1]).withColumns({"turnover_cny": F.round("turnover_cny", 2), "pct_change": F.round("pct_change", 6), "market_cap_cny": F.round("market_cap_cny", 0)})
    return out.select("layout", *SNAPSHOT_COLUMNS.split(", "))


define("halts", "", """
SELECT o_orderkey AS k, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) END AS end_date,
 ['停牌一天', '连续停牌', '停牌半天', '盘中停牌', 'x'][o_orderkey % 5 + 1] AS term, CASE WHEN o_orderkey % 7 = 0 THEN '临时停牌核查' ELSE o_orderpriority END AS reason, o_orderstatus AS source FROM orders""")


def halts(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    terms = F.array(*[F.lit(t) for t in ("停牌一天", "连续停牌", "停牌半天", "盘中停牌", "x")])
    return o.select(k.alias("k"), F.col("o_custkey").alias("symbol"), day.alias("start_date"),
                    F.when(k % 4 == 0, F.date_add(day, (k % 30).cast("int"))).alias("end_date"),
                    F.element_at(terms, (k % 5 + 1).cast("int")).alias("term"),
                    F.when(k % 7 == 0, "临时停牌核查").otherwise(F.col("o_orderpriority")).alias("reason"), F.col("o_orderstatus").alias("source"))


@query("suspension_types", "N16", oracle("halts", """
SELECT k, CASE term WHEN '停牌一天' THEN 'full_day' WHEN '连续停牌' THEN 'continuous' WHEN '停牌半天' THEN 'half_day' WHEN '盘中停牌' THEN 'intraday' ELSE 'unknown' END AS type,
 CASE WHEN coalesce(start_date = end_date, false) OR regexp_matches(reason, '盘中|临时停牌') THEN 'intraday' ELSE 'unknown' END AS halt FROM halts"""))
def suspension_types(spark, sf):
    h = halts(spark, sf)
    return h.select("k", normalize.suspension_type(F.col("term")).alias("type"),
                    normalize.intraday_halt(F.col("start_date"), F.col("end_date"), F.col("reason")).alias("halt"))


@query("record_keys", "N17 N18", """
SELECT CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderstatus AS record_key, count(*) AS rows,
 round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1""")
def record_keys(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.groupBy(normalize.record_key("o_custkey", "day", "o_orderstatus").alias("record_key")).agg(
        F.count("*").alias("rows"), F.round(F.max("o_totalprice"), 2).alias("top"))


def class_history(spark, sf):
    """Orders as a dated classification history: six-digit class codes before and after a switch."""
    o = read_table(spark, sf, "orders")
    code = F.concat(F.lpad(((F.col("o_custkey") * 7 + F.col("o_orderkey") % 3) % 40 + 10).cast("string"), 2, "0"),
                    F.lpad((F.col("o_orderkey") % 4).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 2).cast("string"), 2, "0"))
    return o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("start_date"), code.alias("code"),
                    F.col("o_orderkey").alias("update_time"))


define("class_history", "", """
SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS start_date, lpad(CAST((o_custkey * 7 + o_orderkey % 3) % 40 + 10 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 4 AS VARCHAR), 2, '0')
 || lpad(CAST(o_orderkey % 2 AS VARCHAR), 2, '0') AS code, o_orderkey AS update_time FROM orders""")
define("class_rows", "class_history", """
SELECT *, lead(start_date) OVER (PARTITION BY symbol ORDER BY start_date) AS end_date FROM
(SELECT * FROM class_history QUALIFY row_number() OVER (PARTITION BY symbol, start_date ORDER BY update_time DESC, code DESC) = 1)""")
SWITCH = "1998-07-30"
define("class_table", "class_history", f"""
SELECT DISTINCT code, 'L1 ' || substr(code, 1, 2) AS l1_name FROM class_history WHERE start_date >= DATE '{SWITCH}' AND substr(code, 1, 2) < '40' AND substr(code, 3, 2) <> '03'""")


def class_table(spark, sf):
    h = class_history(spark, sf).filter((F.col("start_date") >= F.to_date(F.lit(SWITCH))) & (F.substring("code", 1, 2) < "40")
                                        & (F.substring("code", 3, 2) != "03"))
    return h.select("code", F.concat(F.lit("L1 "), F.substring("code", 1, 2)).alias("l1_name")).distinct()


define("class_pairs", "class_rows class_table", f"""
WITH b AS (SELECT symbol, arg_max(code, start_date) AS old_code FROM class_rows WHERE start_date < DATE '{SWITCH}' GROUP BY 1),
a AS (SELECT symbol, arg_min(code, start_date) AS new_code FROM class_rows WHERE start_date >= DATE '{SWITCH}' AND code IN (SELECT code FROM class_table) GROUP BY 1)
SELECT old_code, substr(new_code, 1, 2) || '0000' AS l1_code FROM b JOIN a USING (symbol)""")


def class_mapping(spark, sf):
    rows = normalize.keep_one(class_history(spark, sf), ["symbol", "start_date"], [F.col("update_time"), F.col("code")])
    table = class_table(spark, sf)
    switch = F.to_date(F.lit(SWITCH))
    old = rows.filter(F.col("start_date") < switch)
    before = old.groupBy("symbol").agg(F.max_by("code", "start_date").alias("old_code"))
    after = rows.filter(F.col("start_date") >= switch).join(table.select("code"), "code", "left_semi").groupBy("symbol").agg(
        F.min_by("code", "start_date").alias("new_code"))
    pairs = before.join(after, "symbol").select("old_code", F.concat(F.substring("new_code", 1, 2), F.lit("0000")).alias("l1_code"))
    return normalize.majority_mapping(pairs, old.select(F.col("code").alias("old_code")), table)


def majority_sql(n, method):
    return f"""SELECT k, arg_max(l1_code, row(n, -CAST(l1_code AS INTEGER))) AS l1_code, '{method}' AS method, max(n) AS names, max(n) / sum(n)::DOUBLE AS share
 FROM (SELECT substr(old_code, 1, {n}) AS k, l1_code, count(*) AS n FROM class_pairs GROUP BY 1, 2) GROUP BY 1"""


define("class_mapping", "class_pairs class_rows class_table", f"""
WITH m6 AS ({majority_sql(6, 'transition')}), m4 AS ({majority_sql(4, 'level2_majority')}), m2 AS ({majority_sql(2, 'level1_majority')}),
o AS (SELECT DISTINCT code AS old_code FROM class_rows WHERE start_date < DATE '{SWITCH}')
SELECT o.old_code, CASE WHEN t.code IS NOT NULL THEN substr(o.old_code, 1, 2) || '0000' ELSE coalesce(m6.l1_code, m4.l1_code, m2.l1_code, '000000') END AS l1_code,
 CASE WHEN t.code IS NOT NULL THEN 'same_code' ELSE coalesce(m6.method, m4.method, m2.method, 'unmapped') END AS method,
 CASE WHEN t.code IS NOT NULL THEN 0 ELSE coalesce(m6.names, m4.names, m2.names, 0) END AS names,
 CASE WHEN t.code IS NOT NULL THEN 1 ELSE coalesce(m6.share, m4.share, m2.share, 0) END AS share
FROM o LEFT JOIN (SELECT DISTINCT code FROM class_table) t ON t.code = o.old_code LEFT JOIN m6 ON m6.k = o.old_code LEFT JOIN m4 ON m4.k = substr(o.old_code, 1, 4) LEFT JOIN m2 ON m2.k = substr(o.old_code, 1, 2)""")


@query("class_code_table", "N19", oracle("class_rows", """
SELECT symbol, start_date, code FROM class_rows"""))
def class_code_table(spark, sf):
    return normalize.keep_one(class_history(spark, sf), ["symbol", "start_date"], [F.col("update_time"), F.col("code")]).drop("update_time")


@query("class_majority_mapping", "N21", oracle("class_mapping", "SELECT old_code, l1_code, method, names, round(share, 6) AS share FROM class_mapping"))
def class_majority_mapping(spark, sf):
    return rounded(class_mapping(spark, sf), "share")


@query("class_intervals", "N20", oracle("class_rows class_table class_mapping", f"""
SELECT r.symbol, r.start_date, r.end_date, r.code, CASE WHEN r.start_date >= DATE '{SWITCH}' AND t.code IS NULL THEN 'native_code_not_in_table' WHEN r.start_date >= DATE '{SWITCH}' THEN 'native'
  WHEN t.code IS NOT NULL THEN 'same_code' ELSE 'mapped' END AS mapping, x.l1_code, n.l1_name
FROM class_rows r LEFT JOIN class_table t USING (code) LEFT JOIN class_mapping m ON m.old_code = r.code,
LATERAL (SELECT CASE WHEN r.start_date >= DATE '{SWITCH}' OR t.code IS NOT NULL THEN substr(r.code, 1, 2) || '0000' ELSE coalesce(m.l1_code, '000000') END AS l1_code) x
LEFT JOIN (SELECT DISTINCT substr(code, 1, 2) || '0000' AS l1_code, l1_name FROM class_table) n ON n.l1_code = x.l1_code"""))
def class_intervals(spark, sf):
    mapping = class_mapping(spark, sf).select(F.col("old_code").alias("code"), "l1_code")
    return normalize.industry_intervals(class_history(spark, sf), class_table(spark, sf), mapping, SWITCH)


# -- statements and versions ---------------------------------------------------------

@query("statement_fields", "N22", """
SELECT o_custkey, last_day(CAST(o_orderdate AS DATE)) AS report_date, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, o_totalprice / 2) AS value,
 last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AND month(o_orderdate) % 3 = 0 AS quarter_end FROM orders""")
def statement_fields(spark, sf):
    o = read_table(spark, sf, "orders").withColumns({"final": F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")),
                                                     "draft": F.col("o_totalprice") / 2})
    day = F.to_date("o_orderdate")
    return o.select("o_custkey", F.last_day(day).alias("report_date"), normalize.first_value(o, ["final", "draft"]).alias("value"),
                    normalize.quarter_end(day).alias("quarter_end"))


FACT_KEYS = ["o_custkey", "period"]


def fact_rows(spark, sf, first):
    o = read_table(spark, sf, "orders").filter(F.col("o_orderstatus").isin(*(("F", "P") if first else ("O", "P"))))
    return o.groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("period")).agg(
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))


define("facts_old", "", """
SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS value FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1, 2""")
define("facts_new", "", """
SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS value FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1, 2""")


@query("version_append", "U5 N22", oracle("facts_old facts_new", """
SELECT n.o_custkey, n.period, n.value, CASE WHEN o.value IS NULL THEN 1 ELSE 2 END AS version FROM facts_new n LEFT JOIN facts_old o USING (o_custkey, period)
WHERE o.value IS NULL OR o.value <> n.value"""))
def version_append(spark, sf):
    tag = lambda df: df.withColumn("content_hash", normalize.content_hash(["value"]))
    old = tag(fact_rows(spark, sf, True)).withColumn("version", F.lit(1))
    return upsert.append_versions(old, tag(fact_rows(spark, sf, False)), FACT_KEYS).drop("content_hash")


@query("version_latest", "J11", oracle("facts_old facts_new", """
SELECT o_custkey, period, value, version FROM (SELECT o_custkey, period, value, 1 AS version FROM facts_old UNION ALL SELECT *, 2 FROM facts_new)
QUALIFY row_number() OVER (PARTITION BY o_custkey, period ORDER BY version DESC) = 1"""))
def version_latest(spark, sf):
    from ..operators.pit import latest_version
    rows = fact_rows(spark, sf, True).withColumn("version", F.lit(1)).unionByName(fact_rows(spark, sf, False).withColumn("version", F.lit(2)))
    return latest_version(rows, FACT_KEYS, ["value", "version"], ["version"])


@query("holder_change_keys", "N23", """
SELECT l_orderkey, l_linenumber, l_partkey, sha1(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || l_returnflag || '|' || strftime(l_shipdate, '%Y-%m-%d'))[1:20] AS change_key,
 CASE WHEN l_quantity > 10 AND l_extendedprice > 10000 THEN round(l_extendedprice / l_quantity, 8) END AS avg_price FROM lineitem""")
def holder_change_keys(spark, sf):
    l = read_table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    key = F.substring(F.sha1(normalize.record_key("l_orderkey", "l_partkey", "l_returnflag", "day")), 1, 20)
    big = F.when((F.col("l_quantity") > 10) & (F.col("l_extendedprice") > 10000), F.col("l_extendedprice"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("change_key"),
                    F.round(normalize.average_price(big, F.col("l_quantity")), 8).alias("avg_price"))


@query("buyback_kinds", "N23", """
SELECT o_orderkey, CASE WHEN regexp_matches(p, '注销|减少注册资本') THEN 'cancel' WHEN regexp_matches(p, '股权激励|员工持股') THEN 'incentive' ELSE 'other' END AS kind FROM
(SELECT o_orderkey, ['用于股权激励', '注销并减少注册资本', '员工持股计划或注销', o_orderpriority][o_orderkey % 4 + 1] AS p FROM orders)""")
def buyback_kinds(spark, sf):
    o = read_table(spark, sf, "orders")
    words = F.array(F.lit("用于股权激励"), F.lit("注销并减少注册资本"), F.lit("员工持股计划或注销"), F.col("o_orderpriority"))
    purpose = F.element_at(words, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", normalize.buyback_kind(purpose).alias("kind"))


FUND_SQL = """SELECT CAST(l_shipdate AS DATE) AS trade_date, l_returnflag AS exchange, CASE WHEN l_suppkey % 9 = 0 THEN 'bad' ELSE lpad(CAST(l_suppkey AS VARCHAR), 6, '0') END AS symbol,
 CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS shares, l_orderkey * 10 + l_linenumber AS seq, l_partkey FROM lineitem"""


def fund_rows(spark, sf):
    l = read_table(spark, sf, "lineitem")
    return l.select(F.to_date("l_shipdate").alias("trade_date"), F.col("l_returnflag").alias("exchange"),
                    F.when(F.col("l_suppkey") % 9 == 0, "bad").otherwise(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("symbol"),
                    F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_quantity")).alias("shares"),
                    F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_partkey").alias("seq"))


@query("fund_share_counts", "N24", f"""
WITH r AS ({FUND_SQL}), d AS (SELECT * FROM r WHERE trade_date = DATE '1998-06-15'), g AS (SELECT * FROM d WHERE symbol <> 'bad' AND shares > 0)
SELECT (SELECT count(*) FROM r) - (SELECT count(*) FROM d) AS dropped_other_date, (SELECT count(*) FROM d) - (SELECT count(*) FROM g) AS dropped_invalid,
 (SELECT count(*) - count(DISTINCT (exchange, symbol)) FROM g) AS dropped_duplicate""")
def fund_share_counts(spark, sf):
    return normalize.fund_shares(fund_rows(spark, sf), F.to_date(F.lit("1998-06-15")), 10000)[1]


@query("fund_shares", "N24", f"""
SELECT trade_date, exchange, symbol, shares * 10000 AS shares FROM ({FUND_SQL}) WHERE trade_date = DATE '1998-06-15' AND symbol <> 'bad' AND shares > 0
QUALIFY row_number() OVER (PARTITION BY exchange, symbol ORDER BY seq DESC, l_partkey DESC) = 1""")
def fund_shares(spark, sf):
    return normalize.fund_shares(fund_rows(spark, sf), F.to_date(F.lit("1998-06-15")), 10000)[0].drop("seq")


@query("option_contracts", "N25", oracle("calendar", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '510050' || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END || '00' || strftime(o_orderdate, '%m') || 'M' || lpad(CAST(o_orderkey % 9000 AS VARCHAR), 5, '0')
  WHEN o_orderkey % 3 = 1 THEN 'IO00' || strftime(o_orderdate, '%m') || '-' || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END || '-' || CAST(o_orderkey AS VARCHAR) ELSE 'XX' END AS code, month(o_orderdate) AS m, o_orderkey % 3 = 0 AS sse FROM orders),
p AS (SELECT *, make_date(2000, m, 1) AS d0 FROM c WHERE code <> 'XX'),
d AS (SELECT *, CASE WHEN sse THEN d0 + CAST((3 - isodow(d0) + 7) % 7 + 21 AS INTEGER) ELSE d0 + CAST((5 - isodow(d0) + 7) % 7 + 14 AS INTEGER) END AS due FROM p)
SELECT o_orderkey, code, CASE WHEN sse THEN 'SSE' ELSE 'CFFEX' END AS exchange, CASE WHEN sse THEN '510050' ELSE 'IO' END AS underlying, CASE WHEN o_orderkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind,
 CASE WHEN sse THEN (o_orderkey % 9000) / 1000.0::DOUBLE ELSE o_orderkey::DOUBLE END AS strike, coalesce((SELECT min(trade_date) FROM calendar WHERE trade_date >= due AND trade_date < due + 10), due) AS expiry_date FROM d"""))
def option_contracts(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    month, side = F.date_format("o_orderdate", "MM"), F.when(k % 2 == 0, "C").otherwise("P")
    code = F.when(k % 3 == 0, F.concat(F.lit("510050"), side, F.lit("00"), month, F.lit("M"), F.lpad((k % 9000).cast("string"), 5, "0"))).when(
        k % 3 == 1, F.concat(F.lit("IO00"), month, F.lit("-"), side, F.lit("-"), k.cast("string"))).otherwise("XX")
    rows = normalize.option_contracts(o.select("o_orderkey", code.alias("code")), views.calendar(spark, sf))
    return rows.select("o_orderkey", "code", "exchange", "underlying", "kind", "strike", "expiry_date")


@query("zero_prices_to_null", "N26", """
SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS price FROM supplier""")
def zero_prices_to_null(spark, sf):
    s = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("price"))
    return normalize.zero_to_null(s, ["price"])


@query("intraday_normalized", "N27", """
SELECT event_id, event_type AS symbol, CAST(ts AS DATE) AS trade_date, strftime(ts, '%H:%M') AS time, round(value * 100, 2) AS volume,
 CASE event_type WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'S' ELSE 'N' END AS side FROM events WHERE CAST(ts AS DATE) <= (SELECT max(CAST(ts AS DATE)) FROM events WHERE strftime(ts, '%H:%M') >= '15:00')""")
def intraday_normalized(spark, sf):
    e = read_table(spark, sf, "events")
    e = e.filter(F.to_date("ts") <= normalize.last_final_session(e, "ts"))
    side = F.when(F.col("event_type") == "purchase", "B").when(F.col("event_type") == "error", "S").otherwise("N")
    return e.select("event_id", F.col("event_type").alias("symbol"), F.to_date("ts").alias("trade_date"), F.date_format("ts", "HH:mm").alias("time"),
                    F.round(F.col("value") * 100, 2).alias("volume"), side.alias("side"))


@query("snapshot_sessions", "N28", """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE isodow(ts) <= 5)
SELECT event_id, CASE WHEN kind = 'intraday' THEN NULL ELSE (SELECT max(day) FROM d WHERE day <= cut) END AS session, kind FROM
(SELECT event_id, CASE WHEN strftime(ts, '%H:%M:%S') < '16:00:00' THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS cut,
 CASE WHEN isodow(ts) <= 5 AND strftime(ts, '%H:%M:%S') >= '09:30:00' AND strftime(ts, '%H:%M:%S') < '16:00:00' THEN 'intraday' ELSE 'post_close' END AS kind FROM events)""")
def snapshot_sessions(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    days = e.filter(F.weekday("ts") < 5).select(F.to_date("ts").alias("trade_date")).distinct()
    return normalize.snapshot_session(e, days, "ts").select("event_id", "session", "kind")


# -- merges -----------------------------------------------------------------------------

LINES = ["l_orderkey", "l_linenumber"]


def lines(spark, sf, *flags):
    return read_table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin(*flags)).select(
        *LINES, "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


def newest():
    return [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")]


@query("upsert_newest", "U1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag = 'R' DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1""")
def upsert_newest(spark, sf):
    return upsert.upsert(lines(spark, sf, "A", "N"), lines(spark, sf, "R"), LINES, newest())


@query("insert_first_wins", "U2 U4", """
WITH e AS (SELECT * FROM lineitem WHERE l_returnflag = 'A'), i AS (SELECT * FROM lineitem WHERE l_returnflag <> 'A')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM e UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (SELECT * FROM i ANTI JOIN e USING (l_orderkey, l_linenumber)
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1)""")
def insert_first_wins(spark, sf):
    return upsert.insert_only(lines(spark, sf, "A"), lines(spark, sf, "N", "R"), LINES, newest())


@query("latest_plan_state", "U3", """
SELECT o_custkey, o_orderkey, updated, o_totalprice FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS updated, CAST(o_orderstatus = 'F' AS INTEGER) AS n FROM orders)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY updated DESC NULLS LAST, n DESC, o_orderkey DESC) = 1""")
def latest_plan_state(spark, sf):
    o = read_table(spark, sf, "orders")
    rows = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.to_date("o_orderdate")).alias("updated"), "o_totalprice", "o_orderstatus")
    old, new = rows.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), rows.filter("o_orderstatus = 'F'").drop("o_orderstatus")
    return upsert.latest_state(old, new, ["o_custkey"], "updated", "o_orderkey")


@query("merge_keep_known", "U6", """
SELECT c_custkey, coalesce(n.b, o.b) AS balance, n.m AS segment FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS b, upper(c_mktsegment) AS m FROM customer WHERE c_custkey % 2 = 0) n
LEFT JOIN (SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_custkey % 5 > 0) o USING (c_custkey)
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 2 = 1""")
def merge_keep_known(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    old = c.filter(k % 5 > 0).select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = c.filter(k % 2 == 0).select("c_custkey", F.when(k % 3 == 0, F.col("c_acctbal")).alias("balance"), F.upper("c_mktsegment").alias("segment"))
    return upsert.keep_known(old, new, "c_custkey", "balance")


@query("latest_notice_tables", "U7", """
WITH n AS (SELECT l_partkey, year(l_shipdate) AS period, arg_max(l_orderkey, row(l_shipdate, l_orderkey)) AS a FROM lineitem GROUP BY 1, 2)
SELECT l.l_partkey, n.period, l.l_orderkey, l.l_linenumber, l.l_suppkey FROM lineitem l JOIN n ON n.l_partkey = l.l_partkey AND n.period = year(l.l_shipdate) AND n.a = l.l_orderkey""")
def latest_notice_tables(spark, sf):
    l = read_table(spark, sf, "lineitem").withColumn("period", F.year("l_shipdate").cast("long"))
    return upsert.table_of_latest_notice(l, ["l_partkey", "period"], "l_shipdate", "l_orderkey").select(
        "l_partkey", "period", "l_orderkey", "l_linenumber", "l_suppkey")


@query("replace_partition_keys", "U8", """
WITH i AS (SELECT * FROM lineitem WHERE l_shipdate >= DATE '2000-01-01')
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < DATE '2000-01-01' AND l_orderkey NOT IN (SELECT l_orderkey FROM i)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM i""")
def replace_partition_keys(spark, sf):
    l = read_table(spark, sf, "lineitem")
    cut = F.to_date(F.lit("2000-01-01"))
    cols = [*LINES, "l_partkey", "l_suppkey"]
    return upsert.replace_symbols(l.filter(F.col("l_shipdate") < cut).select(*cols),
                                  l.filter(F.col("l_shipdate") >= cut).select(*cols), ["l_orderkey"])


@query("carry_forward_vanished", "U9", oracle("master", """
WITH n AS (SELECT symbol, status, delist_date, 'list' AS source FROM master WHERE substr(symbol, 4) < '700')
SELECT * FROM n UNION ALL SELECT symbol, 'delisted', CASE WHEN status = 'delisted' THEN delist_date END, CASE WHEN status = 'delisted' THEN 'list' ELSE 'inferred.missing_from_listing' END FROM master WHERE substr(symbol, 4) >= '700'"""))
def carry_forward_vanished(spark, sf):
    old = master(spark, sf).select("symbol", "status", "delist_date", F.lit("list").alias("source"))
    return upsert.carry_forward(old, old.filter(F.substring("symbol", 4, 3) < "700"), "symbol", "status")


@query("frame_equality", "U10", """
WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'A'),
c AS (SELECT 'flags' AS compared, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM r)) AS only_left, (SELECT count(*) FROM (FROM r EXCEPT ALL FROM a)) AS only_right
 UNION ALL SELECT 'halves', (SELECT count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM r EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem)),
 (SELECT count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem EXCEPT ALL (SELECT * FROM a UNION ALL SELECT * FROM r))))
SELECT compared, only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM c""")
def frame_equality(spark, sf):
    """Lines of one flag against all others (they differ), and both together against the whole table (equal)."""
    pair = lambda df: df.select("l_partkey", "l_suppkey")
    a, rest = pair(lines(spark, sf, "A")), pair(lines(spark, sf, "N", "R"))
    out = upsert.frames_equal(a, rest).withColumn("compared", F.lit("flags"))
    both = upsert.frames_equal(a.unionAll(rest), pair(read_table(spark, sf, "lineitem"))).withColumn("compared", F.lit("halves"))
    return out.unionByName(both)


@query("minute_to_daily_totals", "U11", """
SELECT event_type AS contract, CAST(ts AS DATE) AS trade_date, round(sum(value), 4) AS volume, arg_max(user_id, ts) AS open_interest, count(*) AS minutes FROM events GROUP BY 1, 2""")
def minute_to_daily_totals(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("contract"), F.to_date("ts").alias("trade_date"), F.col("ts").alias("time"),
                                               F.col("value").alias("volume"), F.col("user_id").alias("open_interest"))
    return upsert.minute_totals(e, ["contract", "trade_date"]).withColumn("volume", F.round("volume", 4))


# -- sources ---------------------------------------------------------------------------

@query("dataset_inventory", "S6 S7 S8", """
SELECT 'orders' AS dataset, CAST(count(*) AS BIGINT) AS rows, CAST(min(o_orderdate) AS DATE) AS min_date, CAST(max(o_orderdate) AS DATE) AS max_date FROM orders
UNION ALL SELECT 'lineitem', count(*), CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL SELECT 'events', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def dataset_inventory(spark, sf):
    return io.inventory({n: read_table(spark, sf, n) for n in ("orders", "lineitem", "events")},
                        {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}).drop("version")


@query("raw_latest_runs", "S11", """
SELECT o_custkey, o_orderkey, run FROM (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y%m') AS run FROM orders)
QUALIFY run = max(run) OVER (PARTITION BY o_custkey)""")
def raw_latest_runs(spark, sf):
    raw = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("run"))
    return upsert.latest_runs(raw, ["o_custkey"], "run")


@query("raw_replay_order", "S11", """
SELECT o_custkey, run, count(*) AS rows, row_number() OVER (PARTITION BY o_custkey ORDER BY run) AS step FROM (SELECT o_custkey, strftime(o_orderdate, '%Y%m') AS run FROM orders) GROUP BY 1, 2""")
def raw_replay_order(spark, sf):
    raw = read_table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("run"))
    return upsert.run_order(raw, ["o_custkey"], "run")


@query("dataset_diff", "S12", oracle("facts_old facts_new", """
SELECT count(*) FILTER (n.o_custkey IS NULL) AS only_left, count(*) FILTER (o.o_custkey IS NULL) AS only_right, count(*) FILTER (n.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL) AS matched,
 count(*) FILTER (n.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL AND o.value IS DISTINCT FROM n.value) AS changed_value,
 count(*) FILTER (n.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL AND o.value IS DISTINCT FROM n.value) AS changed_keys
FROM facts_old o FULL JOIN facts_new n ON n.o_custkey = o.o_custkey AND n.period = o.period"""))
def dataset_diff(spark, sf):
    return upsert.diff(fact_rows(spark, sf, True), fact_rows(spark, sf, False), FACT_KEYS, ["value"])


@query("missing_windows", "S14", oracle("calendar bars", """
SELECT s.symbol, c.trade_date FROM (SELECT symbol, min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY 1) s JOIN calendar c ON c.trade_date BETWEEN s.a AND s.b
ANTI JOIN bars x ON x.symbol = s.symbol AND x.trade_date = c.trade_date"""))
def missing_windows(spark, sf):
    """Sessions between a symbol's first and last bar that were never fetched."""
    done, calendar = views.bars(spark, sf).select("symbol", "trade_date"), views.calendar(spark, sf).select("trade_date", "idx")
    spans = done.join(calendar, "trade_date").groupBy("symbol").agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    wanted = spans.select("symbol", F.explode(F.sequence("a", "b")).alias("idx")).join(calendar, "idx")
    return upsert.missing_windows(wanted.select("symbol", "trade_date"), done, ["symbol", "trade_date"])


@query("fixture_extract", "S15", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey FROM lineitem l SEMI JOIN (SELECT * FROM supplier WHERE s_acctbal < 0) s ON s.s_suppkey = l.l_suppkey""")
def fixture_extract(spark, sf):
    chosen = read_table(spark, sf, "supplier").filter("s_acctbal < 0")
    l = read_table(spark, sf, "lineitem").select(*LINES, "l_partkey", "l_suppkey")
    return l.join(chosen, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
