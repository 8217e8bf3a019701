"""Streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import accounts, normalize, options, series
from ..sources.io import read_table
from ..streaming import jobs, monitors, state
from . import queries_accounts, queries_structure  # noqa: F401  (its SQL views are used below)
from .ctes import define, oracle
from .queries_evaluation import rounded
from .registry import query

BIG = 60.0
define("trades", "", """
SELECT event_id AS seq, ts, CAST(ts AS DATE) AS day, 'g' || CAST(user_id % 5 AS VARCHAR) AS group_id, CAST(user_id AS VARCHAR) AS symbol, value AS amount, CASE WHEN event_type IN ('purchase', 'click') THEN 'B' WHEN event_type = 'error' THEN 'S' ELSE 'N' END AS side FROM events""")
define("minutes", "trades", f"""
WITH l AS (SELECT *, strftime(ts + INTERVAL 1 MINUTE, '%H:%M') AS x, strftime(ts, '%H:%M') >= '15:00' AS late FROM trades),
m AS (SELECT *, CASE WHEN late THEN '15:00' WHEN x < '09:31' THEN '09:31' WHEN x > '11:30' AND x <= '13:00' THEN '11:30' ELSE least(x, '15:00') END AS minute FROM l)
SELECT group_id, day, minute, CASE WHEN minute <= '11:30' THEN CAST(minute[1:2] AS INTEGER) * 60 + CAST(minute[4:5] AS INTEGER) - 570 ELSE CAST(minute[1:2] AS INTEGER) * 60 + CAST(minute[4:5] AS INTEGER) - 660 END AS n, sum(amount) AS amount,
 coalesce(sum(amount) FILTER (side = 'B'), 0) - coalesce(sum(amount) FILTER (side = 'S'), 0) AS active_net, coalesce(sum(amount) FILTER (side = 'B' AND amount >= {BIG}), 0) AS big_buy, coalesce(sum(amount) FILTER (side = 'S' AND amount >= {BIG}), 0) AS big_sell,
 coalesce(sum(amount) FILTER (amount >= {BIG}), 0) AS big_amount FROM m GROUP BY ALL""")
define("cumulated", "minutes", """
SELECT group_id, day, minute, sum(amount) OVER w AS amount, sum(active_net) OVER w AS active_net, sum(big_buy) OVER w AS big_buy, sum(big_sell) OVER w AS big_sell, sum(big_amount) OVER w AS big_amount,
 sum(big_buy - big_sell) OVER (PARTITION BY group_id, day ORDER BY n RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS big_net_recent FROM minutes WINDOW w AS (PARTITION BY group_id, day ORDER BY n)""")
MEASURES = ("amount", "active_net", "big_buy", "big_sell", "big_amount")


def trades(spark, sf):
    return jobs.trades_stream(read_table(spark, sf, "events"))


def trades_from_files(spark, sf, files):
    """The event files as a stream; they are in no order, so nothing in the table's whole span may count as late."""
    late = jobs.span(read_table(spark, sf, "events"), "ts")
    return jobs.trades_stream(jobs.file_stream(spark, sf, "events", files), late=late)


def sums(names):
    return ", ".join(f"round({n}, 4) + 0.0::DOUBLE AS {n}" for n in names)


def r4(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


@query("session_minutes", "ST1 ST2", oracle("minutes", f"SELECT group_id, day, minute, {sums(MEASURES)} FROM minutes"))
def session_minutes(spark, sf):
    return r4(monitors.minute_table(trades(spark, sf), BIG), *MEASURES)


@query("session_minutes_stream", "ST1 ST2 ST3 ST10", oracle("minutes", f"SELECT group_id, day, minute, {sums(MEASURES)} FROM minutes"))
def session_minutes_stream(spark, sf, files=None):
    """The same table from the stream: duplicates dropped within the watermark, totals in state."""
    stream = trades_from_files(spark, sf, files)
    written = jobs.run_available(jobs.cumulative_stream(stream, BIG), "update", "minutes")
    return r4(jobs.newest(written, ["group_id", "day", "minute"]), *MEASURES)


@query("session_replay", "ST3 ST6", oracle("cumulated", f"SELECT group_id, day, minute, {sums((*MEASURES, 'big_net_recent'))} FROM cumulated"))
def session_replay(spark, sf):
    return r4(monitors.cumulate(monitors.minute_table(trades(spark, sf), BIG)), *MEASURES, "big_net_recent")


@query("sliding_half_hours_stream", "ST3", oracle("trades", f"""
SELECT group_id, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k AS start, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k + INTERVAL 30 MINUTE AS "end",
 round(coalesce(sum(amount) FILTER (side = 'B' AND amount >= {BIG}), 0) - coalesce(sum(amount) FILTER (side = 'S' AND amount >= {BIG}), 0), 4) + 0.0::DOUBLE AS big_net, count(*) AS trades
FROM trades, range(3) t(k) GROUP BY ALL"""))
def sliding_half_hours_stream(spark, sf, files=None):
    stream = trades_from_files(spark, sf, files)
    written = jobs.run_available(jobs.sliding_stream(stream, BIG), "update", "sliding")
    return r4(jobs.newest(written, ["group_id", "start", "end"]), "big_net")


define("profile", "minutes", """
SELECT minute, avg(s) AS share, count(*) AS sessions FROM (SELECT minute, sum(amount) OVER (PARTITION BY group_id, day ORDER BY n) / sum(amount) OVER (PARTITION BY group_id, day) AS s FROM minutes) GROUP BY 1""")
define("typical", "minutes", """
SELECT group_id, quantile_cont(amount, 0.5) AS typical FROM (SELECT group_id, day, sum(amount) AS amount FROM minutes GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY day DESC) <= 20) GROUP BY 1""")
define("snapshots", "cumulated profile typical", """
SELECT c.*, typical, typical * share AS baseline, amount / nullif(typical * share, 0) AS ratio, big_buy - big_sell AS big_net, big_amount / nullif(amount, 0) AS big_share FROM cumulated c LEFT JOIN profile USING (minute) LEFT JOIN typical USING (group_id)""")


@query("turnover_profile", "ST9", oracle("profile", "SELECT minute, round(share, 6) AS share, sessions FROM profile"))
def turnover_profile(spark, sf):
    return rounded(monitors.profile(monitors.minute_table(trades(spark, sf), BIG)), "share")


@query("typical_turnover", "ST9", oracle("typical", "SELECT group_id, round(typical, 4) AS typical FROM typical"))
def typical_turnover(spark, sf):
    return r4(monitors.typical_turnover(monitors.minute_table(trades(spark, sf), BIG), 20), "typical")


@query("covering_members", "ST9", oracle("trades", """
WITH m AS (SELECT group_id, symbol, round(sum(amount), 2) AS turnover FROM trades GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(turnover) OVER (PARTITION BY group_id ORDER BY turnover DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(turnover) OVER (PARTITION BY group_id) AS b FROM m)
SELECT group_id, symbol, turnover, round(b, 6) AS covered_before FROM c WHERE b < 0.8"""))
def covering_members(spark, sf):
    m = trades(spark, sf).groupBy("group_id", "symbol").agg(F.round(F.sum("amount"), 2).alias("turnover"))
    return rounded(monitors.covering(m, 0.8), "covered_before")


def snapshots(spark, sf):
    minutes = monitors.minute_table(trades(spark, sf), BIG)
    return monitors.against_baseline(monitors.cumulate(minutes), monitors.profile(minutes), monitors.typical_turnover(minutes, 20))


@query("group_snapshots", "ST4", oracle("snapshots", """
SELECT group_id, day, minute, round(ratio, 6) AS ratio, round(big_net, 4) + 0.0::DOUBLE AS big_net, round(big_share, 6) AS big_share FROM snapshots"""))
def group_snapshots(spark, sf):
    return rounded(snapshots(spark, sf).select("group_id", "day", "minute", "ratio", F.round("big_net", 4).alias("big_net"), "big_share"), "ratio", "big_share")


@query("session_alerts", "ST5 ST6", oracle("snapshots", """
WITH d AS (SELECT *, CASE WHEN minute >= '09:45' AND ratio >= 0.5 AND big_share >= 0.1 THEN CASE WHEN big_net >= greatest(50, 0.02 * typical) THEN 'buy' WHEN big_net <= -greatest(50, 0.02 * typical) THEN 'sell' END END AS direction FROM snapshots)
SELECT group_id, day, direction, min(minute) AS minute FROM d WHERE direction IS NOT NULL GROUP BY 1, 2, 3"""))
def session_alerts(spark, sf):
    return monitors.first_alerts(snapshots(spark, sf).withColumn("direction", monitors.direction(0.5, 0.1, 50.0, 0.02, "09:45")))


@query("alert_once_stream", "ST5", oracle("trades", """
SELECT group_id, side, day FROM trades WHERE amount >= 150 AND side <> 'N' GROUP BY 1, 2, 3"""))
def alert_once_stream(spark, sf, files=None):
    stream = trades_from_files(spark, sf, files).drop("seq")
    alerts = jobs.alert_stream(stream, 150.0)
    return jobs.run_available(alerts, "append", "alerts").select("group_id", "side", "day")


@query("late_sources", "ST10", """
WITH f AS (SELECT max(CAST(ts AS DATE)) AS final FROM events WHERE strftime(ts, '%H:%M') >= '15:00')
SELECT event_type AS source, count(*) FILTER (CAST(ts AS DATE) = final) AS current_rows, count(*) FILTER (CAST(ts AS DATE) < final) AS stale_rows FROM events, f WHERE CAST(ts AS DATE) <= final GROUP BY 1""")
def late_sources(spark, sf):
    events = read_table(spark, sf, "events")
    day, cut = F.to_date("ts"), normalize.last_final_session(events, "ts")
    return events.filter(day <= cut).groupBy(F.col("event_type").alias("source")).agg(
        F.count_if(day == cut).alias("current_rows"), F.count_if(day < cut).alias("stale_rows"))


@query("stale_sources", "ST10", oracle("trades", """
WITH t AS (SELECT symbol, day, strftime(ts, '%H') AS hour, sum(amount) AS amount FROM trades GROUP BY 1, 2, 3),
q AS (SELECT symbol, day, strftime(ts, '%H') AS hour, sum(amount) AS amount FROM trades WHERE side <> 'S' GROUP BY 1, 2, 3),
c AS (SELECT symbol, day, hour, sum(amount) OVER (PARTITION BY symbol, day ORDER BY hour) AS total FROM t),
d AS (SELECT symbol, day, hour, sum(amount) OVER (PARTITION BY symbol, day ORDER BY hour) AS quoted FROM q)
SELECT c.symbol, c.day, c.hour, round(c.total, 4) AS total, round(d.quoted, 4) AS quoted, CASE WHEN d.quoted IS NULL THEN 'no_quote' WHEN c.total > d.quoted * 1.5::DOUBLE + 20 THEN 'stale' ELSE 'fresh' END AS source
FROM c ASOF LEFT JOIN d ON c.symbol = d.symbol AND c.day = d.day AND c.hour >= d.hour"""))
def stale_sources(spark, sf):
    """Sources whose trades run far above what the newest quote says: they still serve another session."""
    t = trades(spark, sf).withColumn("hour", F.date_format("ts", "HH"))
    keys = ["symbol", "day", "hour"]
    quotes = t.filter("side <> 'S'").groupBy(*keys).agg(F.sum("amount").alias("amount"))
    quoted = quotes.select(*keys, F.sum("amount").over(Window.partitionBy("symbol", "day").orderBy("hour")).alias("quoted"))
    return r4(monitors.freshness(t.groupBy(*keys).agg(F.sum("amount").alias("amount")), quoted, "symbol", "hour", 1.5, 20.0), "total", "quoted")


define("vol_monitor", "vol_index", """
WITH RECURSIVE e AS MATERIALIZED (SELECT *, strftime(day, '%Y-%m') AS session, row_number() OVER (PARTITION BY underlying ORDER BY day) AS n FROM vol_index),
f AS (
 SELECT DISTINCT underlying, 0::BIGINT AS n, '' AS session, []::BIGINT[] AS seen, NULL::DOUBLE AS last, NULL::DOUBLE AS previous, []::DOUBLE[] AS reference, false AS alerted,
  NULL::DATE AS day, NULL::DOUBLE AS value, false AS kept, NULL::DOUBLE AS rise, NULL::DOUBLE AS pct, false AS alert FROM e
 UNION ALL
 SELECT underlying, n, session, CASE WHEN kept THEN list_append(s0, strikes) ELSE s0 END, CASE WHEN kept THEN value ELSE l0 END, p0, r0, a0 OR alert, day, value, kept, rise, pct, alert
 FROM (SELECT *, coalesce(kept AND NOT a0 AND rise >= 0.02 AND pct >= 0.5, false) AS alert
  FROM (SELECT *, CASE WHEN kept AND p0 IS NOT NULL THEN value / p0 - 1 END AS rise, CASE WHEN kept AND len(r0) > 0 THEN len(list_filter(r0, lambda x: x <= value)) / len(r0)::DOUBLE END AS pct
   FROM (SELECT *, value IS NOT NULL AND near_vol IS NOT NULL AND NOT (len(s0) >= 5 AND strikes < 0.9::DOUBLE * list_aggregate(s0, 'median')) AS kept
    FROM (SELECT e.*, CASE WHEN f.session <> e.session THEN [] ELSE f.seen END AS s0, CASE WHEN f.session <> e.session THEN NULL ELSE f.last END AS l0,
      CASE WHEN f.session <> e.session AND f.last IS NOT NULL THEN f.last ELSE f.previous END AS p0,
      CASE WHEN f.session <> e.session AND f.last IS NOT NULL THEN list_append(f.reference, f.last)[-50:] ELSE f.reference END AS r0, f.alerted AND f.session = e.session AS a0
     FROM f JOIN e ON e.underlying = f.underlying AND e.n = f.n + 1)))))
SELECT underlying, day, round(value, 6) AS value, kept, round(rise, 6) + 0.0::DOUBLE AS rise, round(pct, 6) AS percentile, alert FROM f WHERE n > 0""")
VOL_SCHEMA = "underlying string, day date, value double, kept boolean, rise double, percentile double, alert boolean"
VOL_COLUMNS = ["underlying", "day", "session", "value", "near_vol", "strikes"]


def volatility_minutes(spark, sf):
    """Index values in order; a month stands for a session and a day for a minute."""
    rows = queries_structure.vol_index(spark, sf)
    return rows.select("underlying", F.col("day").cast("date").alias("day"), F.date_format("day", "yyyy-MM").alias("session"), "value", "near_vol",
                       F.col("strikes").cast("long").alias("strikes"))


@query("volatility_monitor", "ST8 O8", oracle("vol_monitor", "SELECT * FROM vol_monitor"))
def volatility_monitor(spark, sf):
    """Which index values are kept, and the one alert of a session that rises far enough."""
    found = series.ordered_fold(volatility_minutes(spark, sf), ["underlying"], ["day"], VOL_SCHEMA, monitors.volatility_step, VOL_COLUMNS)
    return rounded(found, "value", "rise", "percentile")


@query("volatility_monitor_stream", "ST8 ST5", oracle("vol_monitor", "SELECT * FROM vol_monitor"))
def volatility_monitor_stream(spark, sf, files=None):
    """The same state kept over files in any order."""
    rows = volatility_minutes(spark, sf).withColumn("id", F.concat_ws("|", "underlying", F.col("day").cast("string")))
    days = int(jobs.span(rows, "day").split()[0])
    folder = jobs.event_files(rows, "volatility-minutes", files or 1)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = state.fold_stream(stream, ["underlying"], ["day"], VOL_COLUMNS, VOL_SCHEMA, monitors.volatility_step, days, "volatility-monitor")
    return rounded(found, "value", "rise", "percentile")


@query("account_stream", "ST7 P18", oracle("folded", "SELECT * FROM folded"))
def account_stream(spark, sf, files=None):
    """The account fold over line-item files in any order: accounts that a batch touches are folded again by day."""
    items = jobs.file_stream(spark, sf, "lineitem", files)
    parts = read_table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5)
    event = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    events = rows.select("account", "symbol", F.to_date("l_shipdate").alias("day"), event.alias("event_id"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
                         F.col("l_quantity").cast("long").alias("shares"), (F.col("l_quantity").cast("long") * price).alias("amount"))
    return jobs.run_touched(events, ["account", "symbol"], "positions", accounts.fold_positions)


@query("volatility_stream", "ST8 O4", oracle("terms", "SELECT underlying, day, term, strikes, round(variance, 6) AS variance FROM terms"))
def volatility_stream(spark, sf, files=None):
    """Quotes in any number of batches: a term is priced again from all its quotes when a batch brings new ones."""
    from .queries_structure import quotes_from
    keys = ["underlying", "day", "term"]
    stream = quotes_from(jobs.file_stream(spark, sf, "lineitem", files))
    written = jobs.run_touched(stream, keys, "volatility", lambda quotes: options.term_variance(quotes, keys, 0.015))
    return rounded(written.select("underlying", "day", "term", "strikes", "variance"), "variance")
