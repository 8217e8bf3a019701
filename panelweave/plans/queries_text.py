"""Titles, notices and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from ..sources.io import read_table
from . import queries_datasets, queries_factors, views  # noqa: F401  (their SQL views are used below)
from .ctes import define, oracle
from .registry import query

# Titles by template; the SQL twin states what each template means.
TITLES = ["公司关于股票实施退市风险警示的公告", "公司关于撤销退市风险警示的公告", "公司关于撤销其他风险警示的公告", "公司关于撤销退市风险警示并实施其他风险警示的公告",
          "公司关于股票可能被实施退市风险警示的公告", "*ST甲乙关于股票继续实施退市风险警示的公告", "公司关于实施其他风险警示暨股票停牌的公告", "ST丙丁关于日常经营的公告",
          "公司关于股票复牌并撤销风险警示的公告", "公司2001年年度报告", "公司2000 年中期报告", "公司2000年年度报告摘要"]
STARS = ["set", "revoke", None, "revoke", None, "assert", None, None, "revoke", None, None, None]
STS = [None, "revoke_implied", "revoke", "set", None, None, "set", None, "revoke", None, None, None]


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


define("bulletins", "", f"""
SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS pub_date, o_orderkey AS bid, {sql_list(TITLES)}[o_orderkey % 12 + 1] AS title,
 {sql_list(STARS)}[o_orderkey % 12 + 1] AS star, {sql_list(STS)}[o_orderkey % 12 + 1] AS st FROM orders""")


def bulletins(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (k % 12 + 1).cast("int"))
    return o.select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("pub_date"),
                    k.alias("bid"), title.alias("title"))


def classified(spark, sf):
    return bulletins(spark, sf).withColumn("_c", text.classify_title(F.col("title"), F.lit("SSE"))).select("symbol", "pub_date", "bid", "title", "_c.*")


@query("title_classes", "T1", oracle("bulletins", """
SELECT bid, star, st, CASE WHEN star IS NULL AND st IS NULL THEN 'ignore' WHEN star IN ('set', 'revoke') OR st IN ('set', 'revoke', 'revoke_implied') THEN 'change' ELSE 'assert' END AS kind FROM bulletins"""))
def title_classes(spark, sf):
    return classified(spark, sf).select("bid", "star", "st", "kind")


define("effective", "bulletins bars calendar", """
WITH e AS (SELECT *, (SELECT min(idx) FROM calendar c WHERE c.trade_date >= pub_date) AS i0 FROM bulletins WHERE star IS NOT NULL OR st IS NOT NULL),
d AS (SELECT e.*, a.trade_date AS d0, b.trade_date AS d1 FROM e JOIN calendar a ON a.idx = e.i0 LEFT JOIN calendar b ON b.idx = e.i0 + 1),
s AS (SELECT symbol, min(trade_date) AS a, max(trade_date) AS z FROM bars GROUP BY 1)
SELECT d.symbol, d.bid, d.star, d.st, d.title, CASE WHEN d.d0 BETWEEN s.a AND s.z AND x.symbol IS NULL THEN (SELECT min(n.trade_date) FROM bars n WHERE n.symbol = d.symbol AND n.trade_date > d.d0) WHEN contains(title, '复牌') THEN d0 ELSE d1 END AS eff_date,
 CASE WHEN d.d0 BETWEEN s.a AND s.z AND x.symbol IS NULL THEN 'first_bar_after_halt' WHEN contains(title, '复牌') THEN 'resumption_day' ELSE 'next_session' END AS method
FROM d LEFT JOIN s USING (symbol) LEFT JOIN bars x ON x.symbol = d.symbol AND x.trade_date = d.d0""")


def effective(spark, sf):
    notices = classified(spark, sf).filter("kind <> 'ignore'")
    return text.effective_days(notices, views.bars(spark, sf), views.calendar(spark, sf))


@query("notice_effective_days", "T2 J8", oracle("effective", "SELECT symbol, bid, eff_date, method FROM effective"))
def notice_effective_days(spark, sf):
    return effective(spark, sf).select("symbol", "bid", "eff_date", "method")


@query("status_from_notices", "T2", oracle("effective", """
WITH g AS (SELECT *, eff_date - lag(eff_date) OVER (PARTITION BY symbol, star, st ORDER BY eff_date, bid) AS gap FROM effective),
f AS (SELECT symbol, eff_date, bid, last_value(CASE WHEN star IN ('set', 'assert') THEN 1 WHEN star IN ('revoke', 'revoke_implied') THEN 0 END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN st IN ('set', 'assert') THEN 1 WHEN st IN ('revoke', 'revoke_implied') THEN 0 END IGNORE NULLS) OVER w AS b
 FROM g WHERE gap IS NULL OR gap > 60 WINDOW w AS (PARTITION BY symbol ORDER BY eff_date, bid ROWS UNBOUNDED PRECEDING)),
l AS (SELECT symbol, eff_date, arg_max(row(CASE WHEN a = 1 THEN '*ST' WHEN b = 1 THEN 'ST' END), bid)[1] AS status FROM f GROUP BY 1, 2),
c AS (SELECT *, lag(status) OVER (PARTITION BY symbol ORDER BY eff_date) AS p FROM l),
t AS (SELECT symbol, status, eff_date FROM c WHERE status IS DISTINCT FROM p)
SELECT symbol, status, start_date, end_date FROM (SELECT symbol, status, eff_date AS start_date, lead(eff_date) OVER (PARTITION BY symbol ORDER BY eff_date) AS end_date FROM t) WHERE status IS NOT NULL"""))
def status_from_notices(spark, sf):
    return text.transitions_to_intervals(text.status_transitions(effective(spark, sf).filter("eff_date is not null"), 60))


@query("name_evidence", "T3", oracle("bulletins", """
SELECT b.symbol, b.pub_date, CASE WHEN title LIKE '*ST%' THEN '*ST甲乙' ELSE 'ST丙丁' END AS name, CASE WHEN title LIKE '*ST%' THEN '*ST' ELSE 'ST' END AS status FROM bulletins b
WHERE (title LIKE '*ST%' OR title LIKE 'ST%') AND NOT EXISTS (SELECT 1 FROM bulletins c WHERE c.symbol = b.symbol AND c.pub_date = b.pub_date AND (c.star IN ('set', 'revoke') OR c.st IN ('set', 'revoke', 'revoke_implied')))"""))
def name_evidence(spark, sf):
    rows = classified(spark, sf)
    return text.name_evidence(rows, rows.filter("kind = 'change'"))


@query("report_periods", "T5", oracle("bulletins", """
SELECT bid, CASE bid % 12 WHEN 9 THEN DATE '2001-12-31' WHEN 10 THEN DATE '2000-06-30' END AS report_date, CASE bid % 12 WHEN 9 THEN 'annual' WHEN 10 THEN 'interim' END AS report_type FROM bulletins"""))
def report_periods(spark, sf):
    return bulletins(spark, sf).select("bid", text.report_period(F.col("title")).alias("p")).select("bid", "p.report_date", "p.report_type")


@query("holder_tables", "T4", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, CAST(r AS INTEGER) AS rank, CASE WHEN r % 3 = 0 THEN '持有人' || CAST(o_orderkey AS VARCHAR) || '投资管理有限公司' ELSE '持有人' || CAST(o_orderkey AS VARCHAR) || '公司' END AS holder, o_totalprice AS shares, round((o_orderkey % 900 + 1) / 100.0::DOUBLE, 2) AS pct FROM o WHERE r <= 10""")
def holder_tables(spark, sf):
    """Reports are written from the orders of a customer, every third name wrapped over two lines, and read back."""
    from pyspark.sql import Window
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    o = read_table(spark, sf, "orders").withColumn("r", r).filter("r <= 10")
    shares, pct = F.format_number("o_totalprice", 2), F.format_string("%.2f%%", (F.col("o_orderkey") % 900 + 1) / 100.0)
    name = F.concat(F.lit("持有人"), F.col("o_orderkey").cast("string"))
    line = F.when(F.col("r") % 3 == 0, F.concat(F.lit("  "), F.col("r").cast("string"), F.lit("   "), name, F.lit("投资管理   "), shares, F.lit("   "), pct, F.lit("\n        有限公司"))).otherwise(
        F.concat(F.lit("  "), F.col("r").cast("string"), F.lit("   "), name, F.lit("公司   "), shares, F.lit("   "), pct))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n")
    reports = o.groupBy("o_custkey").agg(F.concat(F.lit("目录 期末上市基金前十名持有人 8\n正文\n9.2 期末上市基金前十名持有人\n序号  持有人名称  持有份额\n"), body, F.lit("\n第 3 页\n9.3 其他事项\n 1 不是持有人 5.00 1.00%")).alias("text"))
    return text.holder_table(reports, "o_custkey")
