"""Event studies, regimes, constituent profiles and other research statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import studies, windows
from ..sources.io import read_table
from . import views
from .common import classes, r6
from .ctes import define, oracle
from .queries_evaluation import inputs, rounded
from .queries_structure import bench, fund_flows, group_flows
from .registry import query

define("ahead", "panel", """
WITH e AS (SELECT *, lead(CASE WHEN has_bar THEN open * hfq END) OVER w AS en, lead(adj_last, 5) OVER w AS p5, lead(adj_last, 20) OVER w AS p20 FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
r AS (SELECT *, p5 / en - 1 AS ret_5, p20 / en - 1 AS ret_20 FROM e)
SELECT *, ret_5 - avg(ret_5) OVER (PARTITION BY idx) AS excess_5, ret_20 - avg(ret_20) OVER (PARTITION BY idx) AS excess_20 FROM r""")


@views.kept
def ahead(spark, sf):
    return studies.outcomes(views.panel(spark, sf), (5, 20))


define("surge_events", "returns", "SELECT symbol, idx, CASE WHEN ret > 0.5 THEN 'up' ELSE 'down' END AS kind FROM returns WHERE abs(ret) > 0.5")


def surge_events(spark, sf):
    r = views.returns(spark, sf).filter(F.abs("ret") > 0.5)
    return r.select("symbol", "idx", F.when(F.col("ret") > 0.5, "up").otherwise("down").alias("kind"))


@query("event_study", "V1", oracle("ahead surge_events", """
SELECT kind, count(*) AS events, round(avg(ret_5), 6) AS ret_5, round(avg(excess_5), 6) AS excess_5, round(avg(CAST(excess_5 > 0 AS INTEGER)), 6) AS win_5, round(avg(ret_20), 6) AS ret_20,
 round(avg(excess_20), 6) AS excess_20, round(avg(CAST(excess_20 > 0 AS INTEGER)), 6) AS win_20 FROM surge_events JOIN ahead USING (symbol, idx) GROUP BY 1"""))
def event_study(spark, sf):
    out = studies.event_study(surge_events(spark, sf), ahead(spark, sf), (5, 20), ["kind"])
    return rounded(out, *[c for c in out.columns if c not in ("kind", "events")])


@query("known_at_event", "V2", oracle("surge_events share_last", """
SELECT e.symbol, e.idx, s.total_shares FROM surge_events e ASOF LEFT JOIN share_last s ON s.symbol = e.symbol AND e.idx >= s.eff"""))
def known_at_event(spark, sf):
    from ..operators import asof, pit
    shares = pit.step_events(views.share_events(views.bars(spark, sf)), views.calendar(spark, sf))
    out = asof.asof_join(surge_events(spark, sf), shares, ["symbol"], "idx", "eff", ["total_shares"], tie=["change_date", "record_key"])
    return out.select("symbol", "idx", "total_shares")


@query("quintile_sort", "V3", oracle("ahead inputs", """
WITH b AS (SELECT ntile(5) OVER (PARTITION BY i.idx ORDER BY i.ret, i.symbol) AS bucket, i.ret AS x, a.excess_5 AS y FROM inputs i JOIN ahead a USING (symbol, idx) WHERE i.ret IS NOT NULL AND a.excess_5 IS NOT NULL)
SELECT bucket, round(avg(y), 6) AS mean, count(*) AS n, round(corr(x, y), 6) AS corr FROM b GROUP BY 1"""))
def quintile_sort(spark, sf):
    rows = inputs(spark, sf).select("symbol", "idx", "ret").join(ahead(spark, sf).select("symbol", "idx", "excess_5"), ["symbol", "idx"])
    return rounded(studies.quantile_sort(rows, "ret", "excess_5", 5, ["idx"]), "mean", "corr")


@query("double_sort", "V3", oracle("ahead inputs", """
WITH a AS (SELECT i.idx, i.symbol, i.volume, a.excess_5 AS y, ntile(3) OVER (PARTITION BY i.idx ORDER BY i.ret, i.symbol) AS qa FROM inputs i JOIN ahead a USING (symbol, idx) WHERE i.ret IS NOT NULL AND i.volume IS NOT NULL AND a.excess_5 IS NOT NULL),
b AS (SELECT *, ntile(3) OVER (PARTITION BY idx, qa ORDER BY volume, symbol) AS qb FROM a)
SELECT qa, qb, round(avg(y), 6) AS mean, count(*) AS n FROM b GROUP BY 1, 2"""))
def double_sort(spark, sf):
    rows = inputs(spark, sf).select("symbol", "idx", "ret", "volume").join(ahead(spark, sf).select("symbol", "idx", "excess_5"), ["symbol", "idx"])
    return rounded(studies.double_sort(rows, "ret", "volume", "excess_5", 3, ["idx"]), "mean")


@query("volume_price_events", "V4", oracle("ahead", """
WITH v AS (SELECT symbol, idx, volume / avg(volume) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS x, excess_5 FROM ahead)
SELECT x >= 2 AS surge, count(excess_5) AS n, round(avg(excess_5), 6) AS mean FROM v WHERE x IS NOT NULL GROUP BY 1"""))
def volume_price_events(spark, sf):
    x = F.col("volume") / F.avg("volume").over(windows.before(20))
    rows = ahead(spark, sf).withColumn("x", x).filter("x is not null")
    return rows.groupBy((F.col("x") >= 2).alias("surge")).agg(F.count("excess_5").alias("n"), r6(F.avg("excess_5")).alias("mean"))


@query("top_turnover_holding", "V5", oracle("ahead", """
SELECT idx, count(excess_5) AS n, round(avg(excess_5), 6) AS excess FROM (SELECT * FROM ahead WHERE amount IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY amount DESC, symbol) <= 5) GROUP BY 1"""))
def top_turnover_holding(spark, sf):
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("amount"), "symbol"))
    top = ahead(spark, sf).filter("amount is not null").withColumn("p", place).filter("p <= 5")
    return top.groupBy("idx").agg(F.count("excess_5").alias("n"), r6(F.avg("excess_5")).alias("excess"))


@query("regime_labels", "V6 W13", oracle("panel", """
WITH r AS (SELECT symbol AS series, idx, adj_last AS close, ln(adj_last / lag(adj_last) OVER (PARTITION BY symbol ORDER BY idx)) AS r FROM panel),
v AS (SELECT *, CASE WHEN count(close) OVER a >= 200 THEN avg(close) OVER a END AS m, CASE WHEN count(r) OVER b >= 60 THEN stddev_samp(r) OVER b END AS v, close / lag(close, 250) OVER (PARTITION BY series ORDER BY idx) - 1 AS y FROM r
 WINDOW a AS (PARTITION BY series ORDER BY idx ROWS 199 PRECEDING), b AS (PARTITION BY series ORDER BY idx ROWS 59 PRECEDING)),
q AS (SELECT *, CASE WHEN count(v) OVER p >= 250 THEN quantile_cont(v, 0.5) OVER p END AS vm FROM v WINDOW p AS (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series, idx, CASE WHEN close > m THEN 'above' WHEN m IS NOT NULL THEN 'below' END AS ma_side, CASE WHEN y > 0 THEN 'up' WHEN y IS NOT NULL THEN 'down' END AS year, CASE WHEN v > vm * (1 + 1e-12) THEN 'high' WHEN v IS NOT NULL AND vm IS NOT NULL THEN 'low' END AS vol FROM q"""))
def regime_labels(spark, sf):
    prices = views.panel(spark, sf).select(F.col("symbol").alias("series"), "idx", F.col("adj_last").alias("close"))
    return studies.regimes(prices).drop("close")


@query("walk_forward_means", "V7", oracle("ahead", """
WITH s AS (SELECT symbol, idx, idx + 20 AS known, ret_20 AS x FROM ahead WHERE ret_20 IS NOT NULL AND idx % 20 = 0)
SELECT a.symbol, a.idx, round(avg(b.x), 6) AS known_mean, count(b.x) AS known_n FROM s a LEFT JOIN s b ON b.symbol = a.symbol AND b.known <= a.idx GROUP BY 1, 2"""))
def walk_forward_means(spark, sf):
    # Every 20th session is the sampling rule: windows of 20 sessions must not overlap.
    s = ahead(spark, sf).filter("ret_20 is not null and idx % 20 = 0").select("symbol", "idx", (F.col("idx") + 20).alias("known"), F.col("ret_20").alias("x"))
    return rounded(studies.known_means(s, ["symbol"], "idx", "known", "x"), "known_mean")


@query("lead_lag_correlation", "V9", oracle("bench group_flows calendar", """
WITH g AS (SELECT c.idx, b.bench AS x, count(*) OVER () AS n, sum(f.flow) AS y FROM bench b JOIN calendar c USING (idx) LEFT JOIN group_flows f ON f.trade_date = c.trade_date GROUP BY 1, 2),
l AS (SELECT x, lag(y, 5) OVER (ORDER BY idx) AS a, y AS b, lead(y, 5) OVER (ORDER BY idx) AS c FROM g)
SELECT -5 AS lag, round(corr(x, a), 6) AS corr, count(a) AS n FROM l UNION ALL SELECT 0, round(corr(x, b), 6), count(b) FROM l UNION ALL SELECT 5, round(corr(x, c), 6), count(c) FROM l"""))
def lead_lag_correlation(spark, sf):
    total = group_flows(spark, sf).groupBy("trade_date").agg(F.sum("flow").alias("y"))
    rows = bench(spark, sf).join(views.calendar(spark, sf), "idx").join(total, "trade_date", "left").withColumnRenamed("bench", "x")
    return rounded(studies.lead_lag(rows, "x", "y", (-5, 0, 5), "idx"), "corr")


@query("entry_rule_comparison", "V10", oracle("panel surge_events", """
WITH p AS (SELECT symbol, idx, list(adj_last) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS path FROM panel),
e AS (SELECT path FROM p JOIN surge_events USING (symbol, idx) WHERE len(path) = 40),
r AS (SELECT 'all_at_once' AS rule, path[40] / path[1] - 1 AS ret, list_min(path) / path[1] - 1 AS worst FROM e
 UNION ALL SELECT 'two_batches', path[40] / ((path[1] + path[11]) / 2) - 1, list_min(path[11:]) / ((path[1] + path[11]) / 2) - 1 FROM e
 UNION ALL SELECT 'stop_10', coalesce(list_filter(path, lambda x: x <= 0.9::DOUBLE * path[1])[1], path[40]) / path[1] - 1, list_min(path) / path[1] - 1 FROM e)
SELECT rule, count(*) AS events, round(avg(ret), 6) AS ret, round(avg(worst), 6) AS worst, round(avg(CAST(ret > 0 AS INTEGER)), 6) AS win FROM r GROUP BY 1"""))
def entry_rule_comparison(spark, sf):
    out = studies.entry_rules(views.panel(spark, sf), surge_events(spark, sf), 40, {"all_at_once": (1, 0.0), "two_batches": (2, 0.0), "stop_10": (1, 0.1)})
    return rounded(out, "ret", "worst", "win")


ENTRY_VALUES = {
    "at_once": "c[k] / o[1]", "thirds": "1 - (1 + CAST(k > 20 AS INTEGER) + CAST(k > 40 AS INTEGER)) / 3.0::DOUBLE + (1 / o[1] + CASE WHEN k > 20 THEN 1 / o[21] ELSE 0 END + CASE WHEN k > 40 THEN 1 / o[41] ELSE 0 END) / 3 * c[k]"}
ENTRY_VALUES |= {f"{n}_stop": v.replace("k", "least(k, hit)") for n, v in ENTRY_VALUES.items()}
ENTRY_VALUES["above_mean"] = "CASE WHEN up IS NOT NULL AND k > up THEN c[k] / o[up + 1] ELSE 1 END"
define("entry_paths", "panel surge_events", """
WITH p AS (SELECT symbol, idx, list(coalesce(open * hfq, adj_last)) OVER f AS o, list(adj_last) OVER f AS c, min(adj_last) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS low, list(m) OVER f AS m
 FROM (SELECT *, CASE WHEN count(adj_last) OVER w >= 60 THEN avg(adj_last) OVER w END AS m FROM panel WHERE adj_last IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING)) WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 120 FOLLOWING)),
e AS (SELECT p.*, coalesce(list_position(list_transform(c, lambda x: x < low), true), 120) AS hit, list_position(list_transform(range(1, 119), lambda i: coalesce(c[i] > m[i], false)), true) AS up
 FROM p JOIN surge_events USING (symbol, idx) WHERE len(c) = 120),
""" + ",\n".join(f"v_{n} AS (SELECT symbol, idx, '{n}' AS rule, list_transform(range(1, 121), lambda k: {v}) AS v FROM e)" for n, v in ENTRY_VALUES.items()) + """,
u AS (""" + " UNION ALL ".join(f"SELECT * FROM v_{n}" for n in ENTRY_VALUES) + """),
x AS (SELECT symbol, idx, rule, v[120] - 1 AS ret, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM u),
z AS (SELECT *, y / greatest(max(y) OVER (PARTITION BY symbol, idx, rule ORDER BY k), 1) - 1 AS d FROM x)
SELECT symbol, idx, rule, any_value(ret) AS ret, least(min(d), 0) AS worst FROM z GROUP BY 1, 2, 3""")


@views.kept
def entry_paths(spark, sf):
    panel = views.panel(spark, sf).filter("adj_last is not null").select(
        "symbol", "idx", F.coalesce(F.col("open") * F.col("hfq"), F.col("adj_last")).alias("open"), F.col("adj_last").alias("close"))
    return studies.entry_paths(panel, surge_events(spark, sf))


@query("entry_paths", "V10", oracle("entry_paths", "SELECT symbol, idx, rule, round(ret, 6) + 0.0::DOUBLE AS ret, round(worst, 6) + 0.0::DOUBLE AS worst FROM entry_paths"))
def entry_path_results(spark, sf):
    """Return and deepest fall of five ways into every surge."""
    return rounded(entry_paths(spark, sf), "ret", "worst")


@query("entry_summary", "V10", oracle("entry_paths", """
SELECT rule, count(*) AS events, round(avg(ret), 6) AS mean, round(quantile_cont(ret, 0.5), 6) AS median, round(avg(CAST(ret > 0 AS INTEGER)), 6) AS win, round(quantile_cont(ret, 0.1), 6) AS low_tenth,
 round(min(ret), 6) AS lowest, round(quantile_cont(worst, 0.5), 6) AS fall_median, round(quantile_cont(worst, 0.1), 6) AS fall_tenth FROM entry_paths GROUP BY 1"""))
def entry_summary(spark, sf):
    out = studies.entry_summary(entry_paths(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("rule", "events")])


@query("rally_bottoms", "V11", oracle("panel", """
WITH w AS (SELECT symbol, idx, adj_last, max(adj_last) OVER a AS h, min(adj_last) OVER a AS l, min(adj_last) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS f FROM panel WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING))
SELECT symbol, idx, f >= adj_last AS held, round(f / adj_last - 1, 6) AS worst FROM w WHERE h / l - 1 >= 0.5 AND adj_last <= h * (1 - 0.6::DOUBLE) AND f IS NOT NULL"""))
def rally_bottoms(spark, sf):
    return rounded(studies.rally_bottoms(views.panel(spark, sf), 60, 60, 0.5, 0.6), "worst")


@query("minute_features", "V12", """
WITH m AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS m, arg_max(value, ts) AS price, sum(value) AS amount FROM events GROUP BY ALL),
s AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol, day ORDER BY m)) AS s, quantile_cont(amount, 0.5) OVER (PARTITION BY symbol, day) AS med FROM m),
f AS (SELECT *, last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY m) AS d FROM s)
SELECT symbol, day, round(sum(coalesce(d, 0) * amount), 4) + 0.0::DOUBLE AS signed_amount, count(*) FILTER (amount >= 2 * med) AS surge_minutes, count(*) AS minutes FROM f GROUP BY 1, 2""")
def minute_features(spark, sf):
    e = read_table(spark, sf, "events")
    m = e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), F.date_trunc("hour", "ts").alias("m")).agg(
        F.max_by("value", "ts").alias("price"), F.sum("value").alias("amount"))
    out = studies.minute_features(m, ["symbol", "day"], "m", "price", "amount", 2.0)
    return out.withColumn("signed_amount", F.round("signed_amount", 4))


@query("threshold_grid", "V14", oracle("ahead returns", """
SELECT t.threshold, count(a.excess_5) AS events, round(avg(a.excess_5), 6) AS mean, round(avg(CAST(a.excess_5 > 0 AS INTEGER)), 6) AS win
FROM returns r JOIN ahead a USING (symbol, idx) JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5), (1.0)) t(threshold) ON r.ret >= t.threshold GROUP BY 1"""))
def threshold_grid(spark, sf):
    rows = views.returns(spark, sf).select("symbol", "idx", "ret").join(ahead(spark, sf).select("symbol", "idx", "excess_5"), ["symbol", "idx"])
    return rounded(studies.threshold_grid(rows, "ret", (0.1, 0.3, 0.5, 1.0), "excess_5"), "mean", "win")


@query("holders_vs_stake", "V15", oracle("bars", """
WITH q AS (SELECT symbol, date_trunc('quarter', trade_date) AS q, sum(volume) AS holders, max(amount) / sum(amount)::DOUBLE AS stake FROM bars GROUP BY 1, 2),
c AS (SELECT CASE WHEN holders > lag(holders) OVER w THEN 'more' WHEN holders < lag(holders) OVER w THEN 'fewer' ELSE 'same' END AS h, CASE WHEN stake > lag(stake) OVER w THEN 'up' ELSE 'down' END AS s, lag(q) OVER w AS p FROM q WINDOW w AS (PARTITION BY symbol ORDER BY q))
SELECT h, s, count(*) AS quarters FROM c WHERE p IS NOT NULL GROUP BY 1, 2"""))
def holders_vs_stake(spark, sf):
    q = views.bars(spark, sf).groupBy("symbol", F.trunc("trade_date", "quarter").alias("q")).agg(
        F.sum("volume").alias("holders"), (F.max("amount") / F.sum("amount")).alias("stake"))
    w = windows.series("symbol", "q")
    rows = q.withColumns({"ph": F.lag("holders").over(w), "ps": F.lag("stake").over(w)}).filter("ph is not null")
    h = F.when(F.col("holders") > F.col("ph"), "more").when(F.col("holders") < F.col("ph"), "fewer").otherwise("same")
    return rows.groupBy(h.alias("h"), F.when(F.col("stake") > F.col("ps"), "up").otherwise("down").alias("s")).agg(F.count("*").alias("quarters"))


@query("constituent_profile", "V16", oracle("inputs classes funds", """
WITH l AS (SELECT symbol, arg_max(total_mcap, idx) AS cap FROM inputs WHERE total_mcap IS NOT NULL GROUP BY 1), n AS (SELECT symbol, arg_max(ni_ttm, idx) AS ni FROM funds WHERE ni_ttm IS NOT NULL GROUP BY 1)
SELECT industry, count(*) AS names, round(sum(cap) / (SELECT sum(cap) FROM l), 6) AS weight, round(sum(cap) / sum(ni), 2) AS pe FROM l JOIN classes USING (symbol) JOIN n USING (symbol) GROUP BY 1"""))
def constituent_profile(spark, sf):
    f = views.factor_inputs(spark, sf, True)
    caps = f.groupBy("symbol").agg(F.max_by("total_mcap", F.when(F.col("total_mcap").isNotNull(), F.col("idx"))).alias("cap"),
                                   F.max_by("ni_ttm", F.when(F.col("ni_ttm").isNotNull(), F.col("idx"))).alias("ni"))
    rows = caps.join(classes(spark, sf), "symbol").withColumn("total", F.sum("cap").over(Window.partitionBy()))  # one row per name
    return rows.groupBy("industry").agg(F.count("*").alias("names"), r6(F.sum("cap") / F.first("total")).alias("weight"),
                                        F.round(F.sum("cap") / F.sum("ni"), 2).alias("pe"))


@query("creation_vs_index", "V17", oracle("group_flows bench calendar", """
WITH r AS (SELECT g.group_id, g.flow_pct AS x, b.bench / lag(b.bench) OVER w - 1 AS same, lead(b.bench) OVER w / b.bench - 1 AS next FROM group_flows g JOIN calendar c USING (trade_date) JOIN bench b USING (idx) WINDOW w AS (PARTITION BY g.group_id ORDER BY g.trade_date))
SELECT group_id, round(corr(x, same), 6) AS same_day, round(corr(x, next), 6) AS next_day, count(x) AS n FROM r GROUP BY 1"""))
def creation_vs_index(spark, sf):
    w = Window.partitionBy("group_id").orderBy("trade_date")
    rows = group_flows(spark, sf).join(views.calendar(spark, sf), "trade_date").join(bench(spark, sf), "idx").withColumns({
        "same": F.col("bench") / F.lag("bench").over(w) - 1, "next": F.lead("bench").over(w) / F.col("bench") - 1})
    return rows.groupBy("group_id").agg(r6(F.corr("flow_pct", "same")).alias("same_day"), r6(F.corr("flow_pct", "next")).alias("next_day"), F.count("flow_pct").alias("n"))


@query("publication_timing", "V18", """
SELECT event_type AS source, user_id, min(ts) FILTER (value >= 5) AS first_seen, round(arg_min(value, ts) FILTER (value >= 5), 2) AS first_value, round(arg_max(value, ts) FILTER (value >= 5), 2) AS last_value, count(*) AS probes,
 arg_min(value, ts) FILTER (value >= 5) IS DISTINCT FROM arg_max(value, ts) FILTER (value >= 5) AS changed FROM events GROUP BY 1, 2""")
def publication_timing(spark, sf):
    e = read_table(spark, sf, "events").withColumnRenamed("event_type", "source")
    out = studies.publication_timing(e, ["source", "user_id"], "ts", F.col("value") >= 5, "value")
    return out.withColumns({"first_value": F.round("first_value", 2), "last_value": F.round("last_value", 2)})


@query("market_context", "V20", oracle("panel", """
WITH d AS (SELECT idx, adj_last / max(adj_last) OVER (PARTITION BY symbol ORDER BY idx ROWS 249 PRECEDING) - 1 AS dd, adj_last > lag(adj_last) OVER (PARTITION BY symbol ORDER BY idx) AS up FROM panel)
SELECT idx, round(quantile_cont(dd, 0.5), 6) + 0.0::DOUBLE AS median_drawdown, round(avg(CAST(up AS INTEGER)), 6) AS up_share, count(*) FILTER (dd = 0) AS new_highs FROM d GROUP BY 1"""))
def market_context(spark, sf):
    return rounded(studies.drawdown_context(views.panel(spark, sf)), "median_drawdown", "up_share")


@query("walk_forward_classifier", "V8")
def walk_forward_classifier(spark, sf):
    """Logistic regression per calendar year on everything known before it, scored on that year."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    x = ["ret", "turn", "dist"]
    rows = inputs(spark, sf).withColumns({
        "turn": F.avg("turnover_rate").over(windows.last_n(20)), "dist": F.col("adj_last") / F.max("adj_last").over(windows.last_n(60)),
        "known": F.lead("trade_date", 5).over(windows.series("symbol", "idx")),
        "label": (F.lead("adj_last", 5).over(windows.series("symbol", "idx")) > F.col("adj_last")).cast("double")})
    data = VectorAssembler(inputCols=x, outputCol="features").transform(rows.dropna(subset=[*x, "label", "known"])).select(
        "symbol", "idx", "trade_date", "known", "label", "features").persist()
    # one fit for each year that has outcomes known before it; years are few, as sessions are days
    known = data.groupBy(F.year("known").alias("y")).agg(F.countDistinct("label").alias("labels"))
    first = known.agg(F.min("y")).first()[0]
    years = [r["y"] for r in data.select(F.year("trade_date").alias("y")).distinct().orderBy("y").collect() if first is not None and r["y"] > first]
    out = spark.createDataFrame([], "year long, n long, accuracy double")
    for year in years:
        start = F.to_date(F.lit(f"{year}-01-01"))
        model = LogisticRegression(maxIter=20, regParam=0.01).fit(data.filter(F.col("known") < start))
        part = model.transform(data.filter(F.year("trade_date") == year)).groupBy(F.year("trade_date").cast("long").alias("year")).agg(
            F.count("*").alias("n"), r6(F.avg((F.col("prediction") == F.col("label")).cast("int"))).alias("accuracy"))
        out = out.unionByName(part)
    return out


# -- choice by regime and monthly models -------------------------------------------------------

define("family_periods", "quantiles", """
WITH f AS (SELECT CASE factor WHEN 'rev_1m' THEN 'momentum' WHEN 'vol_60' THEN 'risk' WHEN 'turn_20' THEN 'liquidity' WHEN 'ln_float_mcap' THEN 'size' ELSE 'technical' END AS family, idx, avg(top_minus_bottom) AS value FROM quantiles GROUP BY 1, 2)
SELECT family, idx, dense_rank() OVER (ORDER BY idx) AS k, value FROM f""")
define("family_regimes", "family_periods bench calendar", """
WITH r AS (SELECT idx, bench AS close, ln(bench / lag(bench) OVER (ORDER BY idx)) AS r FROM bench),
v AS (SELECT *, CASE WHEN count(close) OVER a >= 100 THEN avg(close) OVER a END AS m, close / lag(close, 60) OVER (ORDER BY idx) - 1 AS y FROM r WINDOW a AS (ORDER BY idx ROWS 99 PRECEDING))
SELECT DISTINCT k, CASE WHEN close > m THEN 'above' WHEN m IS NOT NULL THEN 'below' END AS ma_side, CASE WHEN y > 0 THEN 'up' WHEN y IS NOT NULL THEN 'down' END AS year FROM family_periods LEFT JOIN v USING (idx)""")


def family_periods(spark, sf):
    """Spread of each factor family by evaluation period, numbered in order."""
    from .queries_evaluation import QUANTILES, bucketed
    from ..operators import evaluate
    name = F.when(F.col("factor") == "rev_1m", "momentum").when(F.col("factor") == "vol_60", "risk").when(F.col("factor") == "turn_20", "liquidity").when(
        F.col("factor") == "ln_float_mcap", "size").otherwise("technical")
    rows = evaluate.quantile_returns(bucketed(spark, sf), QUANTILES).groupBy(name.alias("family"), "idx").agg(F.avg("top_minus_bottom").alias("value"))
    numbers = rows.select("idx").distinct().withColumn("k", F.row_number().over(Window.orderBy("idx")).cast("long"))  # one row a period
    return rows.join(numbers, "idx")


@query("family_selection", "V7", oracle("family_periods family_regimes", """
WITH p AS (SELECT k, family, value, ma_side, year FROM family_periods JOIN family_regimes USING (k)),
b AS (SELECT p.*, (SELECT count(DISTINCT q.k) FROM p q WHERE q.k <= p.k - 2) AS known,
  (SELECT avg(q.value) FROM p q WHERE q.family = p.family AND q.k <= p.k - 2) AS e, (SELECT avg(q.value) FROM p q WHERE q.family = p.family AND q.k BETWEEN p.k - 5 AND p.k - 2) AS t,
  (SELECT count(DISTINCT q.k) FROM p q WHERE q.ma_side = p.ma_side AND q.k <= p.k - 2) AS n1, (SELECT avg(q.value) FROM p q WHERE q.family = p.family AND q.ma_side = p.ma_side AND q.k <= p.k - 2) AS s1,
  (SELECT count(DISTINCT q.k) FROM p q WHERE q.year = p.year AND q.k <= p.k - 2) AS n2, (SELECT avg(q.value) FROM p q WHERE q.family = p.family AND q.year = p.year AND q.k <= p.k - 2) AS s2 FROM p),
r AS (SELECT k, value, known, 'all' AS rule, NULL::DOUBLE AS m FROM b UNION ALL SELECT k, value, known, 'expanding', e FROM b UNION ALL SELECT k, value, known, 'trailing', t FROM b
 UNION ALL SELECT k, value, known, 'by_ma_side', CASE WHEN n1 >= 3 THEN s1 ELSE e END FROM b UNION ALL SELECT k, value, known, 'by_year', CASE WHEN n2 >= 3 THEN s2 ELSE e END FROM b)
SELECT k, rule, round(coalesce(avg(value) FILTER (known >= 3 AND m > 0), avg(value)), 6) AS value, count(*) FILTER (known >= 3 AND m > 0) AS chosen FROM r WHERE value IS NOT NULL GROUP BY 1, 2"""))
def family_selection(spark, sf):
    """Families chosen by their past in today's regime, by their last periods, or by all of it; few periods pass the universe here."""
    periods = family_periods(spark, sf)
    market = bench(spark, sf).select(F.lit("market").alias("series"), "idx", F.col("bench").alias("close"))
    labels = studies.regimes(market, ma=100, look=60).select("idx", "ma_side", "year")
    of_period = periods.select("k", "idx").distinct().join(labels, "idx", "left").drop("idx")
    return rounded(studies.select_families(periods.select("k", "family", "value"), of_period, ("ma_side", "year"), least=3, trailing=4), "value")


def monthly_samples(spark, sf):
    """One sample a symbol and month: three inputs at the month's last session, and whether the next 20 sessions rose."""
    w = windows.series("symbol", "idx")
    number = (F.year("trade_date") * 12 + F.month("trade_date")).cast("long")
    rows = inputs(spark, sf).withColumns({
        "m": number, "turn": F.avg("turnover_rate").over(windows.last_n(20)), "dist": F.col("adj_last") / F.max("adj_last").over(windows.last_n(60)),
        "move": F.col("adj_last") / F.lag("adj_last", 20).over(w) - 1, "later": F.lead("adj_last", 20).over(w), "m_later": F.lead(number, 20).over(w)})
    rows = rows.withColumn("final", F.max("idx").over(Window.partitionBy("symbol", "m"))).filter("idx = final")
    return rows.select("symbol", F.col("m").alias("month"), "turn", "dist", "move", (F.col("m_later") + 1).alias("known"),
                       F.when(F.col("later").isNotNull(), (F.col("later") > F.col("adj_last")).cast("double")).alias("label"))


@query("monthly_classifier", "V8")
def monthly_classifier(spark, sf):
    """Out-of-sample probabilities of a logistic model fitted anew for each month, and how often they were right."""
    scored = studies.expanding_logistic(monthly_samples(spark, sf), ["move", "turn", "dist"], "label", "month", "known")
    hit = (F.col("probability") > 0.5).cast("double") == F.col("label")
    return scored.filter("label is not null").groupBy("month").agg(
        F.count("*").alias("n"), r6(F.avg(hit.cast("int"))).alias("hits"), r6(F.avg("label")).alias("rose"), r6(F.avg("probability")).alias("probability"))


@query("market_context_flows", "V20", oracle("group_flows calendar", """
WITH d AS (SELECT trade_date, sum(flow) AS flow, sum(aum) AS aum, count(*) FILTER (flow > 0) AS groups FROM group_flows GROUP BY 1),
c AS (SELECT idx, flow, aum, groups FROM calendar LEFT JOIN d USING (trade_date))
SELECT idx, round(sum(flow) OVER w, 2) + 0.0::DOUBLE AS recent_flow, round(sum(flow) OVER w / last_value(aum IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 8) + 0.0::DOUBLE AS recent_share, CAST(coalesce(sum(groups) OVER w, 0) AS BIGINT) AS group_days
FROM c WINDOW w AS (ORDER BY idx ROWS 4 PRECEDING)"""))
def market_context_flows(spark, sf):
    """The day's context: recent creations of funds."""
    out = studies.recent_creations(group_flows(spark, sf), views.calendar(spark, sf))
    return out.withColumns({"recent_flow": F.round("recent_flow", 2), "recent_share": F.round("recent_share", 8)})


@query("constituent_volatility", "V16", oracle("inputs classes", """
WITH v AS (SELECT symbol, idx, float_mcap::DOUBLE AS cap, CASE WHEN idx >= 60 AND count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS vol, ret FROM inputs WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING))
SELECT industry, idx, count(*) AS names, round(max(cap) / sum(cap), 6) AS largest, round(sum(cap) * sum(cap) / sum(cap * cap), 6) AS effective_names, round(sum(cap * vol) / sum(cap) FILTER (vol IS NOT NULL), 6) AS vol FROM v JOIN classes USING (symbol) WHERE cap > 0 GROUP BY 1, 2"""))
def constituent_volatility(spark, sf):
    """Cap-weighted volatility and concentration of every industry and session."""
    rows = inputs(spark, sf).withColumn("vol", windows.std_n(F.col("ret"), 60, 20)).select("symbol", "idx", F.col("float_mcap").alias("cap"), "vol").join(classes(spark, sf), "symbol")
    return rounded(studies.cap_weighted(rows, ["industry", "idx"], "cap", ["vol"]), "largest", "effective_names", "vol")
