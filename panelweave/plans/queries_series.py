"""State machines, structures, turns and candles along a series."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import chart_lines, series, windows
from ..sources.io import read_table
from . import views
from .common import r6
from .ctes import define, oracle
from .queries_evaluation import inputs, rounded
from .registry import query


@views.kept
def staged(spark, sf):
    return series.stages(views.panel(spark, sf).select("symbol", "idx", "adj_last"), ma=60, slope=20, flat=0.02, confirm=5)


# From the definition: a flat mean is a top after a rise and a base after a fall, a steep one an advance or a decline unless the price
# lies far on the other side of it; a change needs five sessions in a row that ask for it, the first one none.
define("stage_walk", "panel", """
WITH RECURSIVE m AS (
 SELECT symbol, idx, adj_last, CASE WHEN count(adj_last) OVER a >= 60 THEN avg(adj_last) OVER a END AS ma, CASE WHEN count(adj_last) OVER c >= 20 THEN min(adj_last) OVER c END AS low FROM panel
 WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING), c AS (PARTITION BY symbol ORDER BY idx ROWS 249 PRECEDING)),
s AS MATERIALIZED (SELECT *, ma / lag(ma, 20) OVER w - 1 AS slope, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
f AS (
 SELECT DISTINCT symbol, 0::BIGINT AS n, 0 AS stage, 0 AS waiting, 0 AS days FROM s
 UNION ALL
 SELECT symbol, n, CASE WHEN goal <> stage AND (run >= 5 OR stage = 0) THEN goal ELSE stage END, goal, run
 FROM (SELECT symbol, n, stage, goal, CASE WHEN goal = waiting THEN days + 1 ELSE 1 END AS run
  FROM (SELECT s.symbol, s.n, f.stage, f.waiting, f.days, CASE WHEN s.slope IS NULL OR s.adj_last IS NULL OR s.ma IS NULL THEN f.stage
    WHEN abs(s.slope) <= 0.02 THEN CASE WHEN f.stage IN (2, 3) THEN 3 WHEN f.stage IN (1, 4) THEN 1 WHEN s.adj_last / s.low - 1 > 0.5 THEN 3 ELSE 1 END
    WHEN s.slope > 0 THEN CASE WHEN s.adj_last >= s.ma * (1 - 0.03) THEN 2 WHEN f.stage IN (2, 3) THEN 3 ELSE f.stage END
    ELSE CASE WHEN s.adj_last <= s.ma * (1 + 0.03) THEN 4 WHEN f.stage IN (1, 4) THEN 1 ELSE f.stage END END AS goal
   FROM f JOIN s ON s.symbol = f.symbol AND s.n = f.n + 1)))
SELECT s.symbol, s.idx, s.adj_last, s.ma, s.slope, f.stage FROM f JOIN s USING (symbol, n)""")


@query("stage_classification", "G1", oracle("stage_walk", """
SELECT symbol, idx, adj_last, round(ma, 6) AS ma, round(slope, 6) + 0.0::DOUBLE AS slope, stage FROM stage_walk"""))
def stage_classification(spark, sf):
    return rounded(staged(spark, sf), "ma", "slope")


@query("latest_stage", "G3", oracle("stage_walk", """
WITH r AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM (SELECT *, CAST(stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY symbol ORDER BY idx) AS INTEGER) AS c FROM stage_walk)),
s AS (SELECT symbol, run, stage, min(idx) AS since, count(*) AS days, arg_max(ma, idx) AS ma, arg_max(slope, idx) AS slope, arg_max(adj_last, idx) AS p FROM r GROUP BY 1, 2, 3),
p AS (SELECT *, lag(stage) OVER (PARTITION BY symbol ORDER BY run) AS previous FROM s QUALIFY run = max(run) OVER (PARTITION BY symbol))
SELECT symbol, stage, previous, since, days, round(ma, 6) AS ma, round(slope, 6) + 0.0::DOUBLE AS slope, round(p / ma - 1, 6) + 0.0::DOUBLE AS gap FROM p"""))
def latest_stage(spark, sf):
    return rounded(series.latest_stage(staged(spark, sf)), "ma", "slope", "gap")


@query("stage_statistics", "G4", oracle("stage_walk", """
WITH f AS (SELECT *, coalesce(lag(stage) OVER w, 0) AS previous, lead(adj_last, 20) OVER w / adj_last - 1 AS f1, lead(adj_last, 60) OVER w / adj_last - 1 AS f2, lead(adj_last, 120) OVER w / adj_last - 1 AS f3
 FROM stage_walk WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
x AS (SELECT *, f1 - avg(f1) OVER d AS x1, f2 - avg(f2) OVER d AS x2, f3 - avg(f3) OVER d AS x3 FROM f WINDOW d AS (PARTITION BY idx))
SELECT previous, stage, count(*) AS count, round(avg(x1), 6) + 0.0::DOUBLE AS excess_20, round(avg(x2), 6) + 0.0::DOUBLE AS excess_60, round(avg(x3), 6) + 0.0::DOUBLE AS excess_120,
 round(avg(CAST(x1 > 0 AS INTEGER)), 6) AS beat FROM x WHERE stage > 0 GROUP BY 1, 2"""))
def stage_statistics(spark, sf):
    return rounded(series.stage_statistics(staged(spark, sf)), "excess_20", "excess_60", "excess_120", "beat")


SURGE = """coalesce(CASE WHEN count(volume) OVER r >= 4 THEN avg(volume) OVER r END / CASE WHEN count(volume) OVER b >= 5 THEN avg(volume) OVER b END < 0.9 AND volume >= 1.2 * CASE WHEN count(volume) OVER r >= 4 THEN avg(volume) OVER r END AND close > open, false)"""
SURGE_W = """WINDOW r AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 16 PRECEDING AND 7 PRECEDING)"""


@query("volume_surges", "G2", oracle("panel", f"SELECT * FROM (SELECT symbol, idx, {SURGE} AS surge FROM panel {SURGE_W}) WHERE surge"))
def volume_surges(spark, sf):
    p = views.panel(spark, sf)
    return p.select("symbol", "idx", series.volume_surge(p, 6, 10, 0.9, 1.2).alias("surge")).filter("surge")


@query("base_retests", "G2", oracle("stage_walk", """
WITH r AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM (SELECT *, CAST(stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY symbol ORDER BY idx) AS INTEGER) AS c FROM stage_walk WHERE adj_last IS NOT NULL)),
l AS (SELECT symbol, idx, adj_last, row_number() OVER w AS n, list(adj_last) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM r WHERE stage = 1 WINDOW w AS (PARTITION BY symbol, run ORDER BY idx)),
k AS (SELECT *, list_min(x) AS low, x[list_position(x, list_min(x)) + 1:] AS later FROM l WHERE n >= 5)
SELECT symbol, idx, adj_last, low AS base_low FROM k WHERE len(later) > 0 AND list_max(later) >= low * 1.05::DOUBLE AND adj_last >= low AND adj_last <= low * (1 + 0.05::DOUBLE / 2)"""))
def base_retests(spark, sf):
    return series.retests(staged(spark, sf))


@query("stage_years", "G4", oracle("stage_walk calendar", """
WITH b AS (SELECT p.idx, avg(p.adj_last) AS x FROM stage_walk p GROUP BY 1),
g AS (SELECT b.idx, year(c.trade_date) AS year, coalesce(b.x > avg(b.x) OVER (ORDER BY b.idx ROWS 99 PRECEDING), false) AS open FROM b JOIN calendar c ON c.idx = b.idx),
f AS (SELECT *, lead(adj_last, 20) OVER w / adj_last - 1 AS f1, lead(adj_last, 60) OVER w / adj_last - 1 AS f2, lead(adj_last, 120) OVER w / adj_last - 1 AS f3 FROM stage_walk WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
x AS (SELECT f.symbol, f.idx, f.stage, f1 - avg(f1) OVER d AS x1, f2 - avg(f2) OVER d AS x2, f3 - avg(f3) OVER d AS x3 FROM f WINDOW d AS (PARTITION BY f.idx)),
s AS (SELECT year, open, stage, count(*) AS sessions, avg(x1) AS a, avg(x2) AS b, avg(x3) AS c FROM x JOIN g USING (idx) GROUP BY ALL)
SELECT CAST(year AS INTEGER) AS year, open, stage, sessions, round(a, 6) + 0.0::DOUBLE AS excess_20, round(b, 6) + 0.0::DOUBLE AS excess_60, round(c, 6) + 0.0::DOUBLE AS excess_120, round(sessions / sum(sessions) OVER (PARTITION BY year)::DOUBLE, 6) AS share FROM s"""))
def stage_years(spark, sf):
    """Stages by year, in and out of a rising market."""
    rows = staged(spark, sf)
    index = rows.groupBy("idx").agg(F.avg("adj_last").alias("x")).join(views.calendar(spark, sf), "idx")
    rising = F.col("x") > F.avg("x").over(Window.orderBy("idx").rowsBetween(-99, 0))  # one row a session
    gate = index.select("idx", F.year("trade_date").alias("year"), F.coalesce(rising, F.lit(False)).alias("open"))
    return rounded(series.stage_years(rows, gate), "excess_20", "excess_60", "excess_120", "share")


# -- structures -------------------------------------------------------------------------------

define("structured", "panel", """
WITH n AS (SELECT symbol, max(adj_last) AS neckline FROM (SELECT symbol, adj_last, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k FROM panel) WHERE k <= 20 GROUP BY 1)
SELECT p.symbol, p.idx, p.adj_last AS close, n.neckline * 1.01 AS neckline, n.neckline * 1.4 AS target FROM panel p JOIN n USING (symbol)""")
define("phases", "structured", """
WITH a AS (SELECT *, min(CASE WHEN close > neckline THEN idx END) OVER w AS on_ FROM structured WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max(CASE WHEN idx >= on_ THEN close END) OVER w AS peak FROM a WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, min(CASE WHEN (peak - neckline) / (target - neckline) >= 1 AND idx > on_ THEN idx END) OVER w AS re FROM b WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, min(CASE WHEN idx > re AND close <= peak * 0.7 THEN idx END) OVER w AS ex FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT *, CASE WHEN ex IS NOT NULL THEN 'exhausted' WHEN re IS NOT NULL THEN 'realized' WHEN on_ IS NOT NULL THEN 'active' ELSE 'pending' END AS phase, (close - neckline) / (target - neckline) AS completion FROM d""")


#: A symbol's neckline is the highest price of its own first sessions.
NECK_SESSIONS = 20


def structured(spark, sf):
    p = views.panel(spark, sf)
    opening = p.withColumn("k", F.row_number().over(windows.series("symbol", "idx"))).filter(F.col("k") <= NECK_SESSIONS)
    necks = opening.groupBy("symbol").agg(F.max("adj_last").alias("m"))
    return p.join(necks, "symbol").select("symbol", "idx", F.col("adj_last").alias("close"), (F.col("m") * 1.01).alias("neckline"), (F.col("m") * 1.4).alias("target"))


def phases(spark, sf):
    return series.structure_phases(structured(spark, sf), exhausted=0.3)


@query("structure_phases", "G6", oracle("phases", "SELECT symbol, idx, phase, round(completion, 6) + 0.0::DOUBLE AS completion, peak FROM phases"))
def structure_phases(spark, sf):
    return rounded(phases(spark, sf).select("symbol", "idx", "phase", "completion", "peak"), "completion")


LABELS = "['left', 'base', 'right', 'right', 'top'][(CAST(floor(idx / 50) AS INTEGER) + length(symbol)) % 5 + 1]"


def label():
    names = F.array(*[F.lit(x) for x in ("left", "base", "right", "right", "top")])
    return F.element_at(names, ((F.floor(F.col("idx") / 50) + F.length("symbol")) % 5 + 1).cast("int"))


@query("base_prompts", "G7", oracle("panel", f"""
WITH s AS (SELECT symbol, idx, {LABELS} = 'base' AS inside, {SURGE} AS surge FROM panel {SURGE_W}),
r AS (SELECT *, sum(CAST(c AS INTEGER)) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM (SELECT *, inside IS DISTINCT FROM lag(inside) OVER (PARTITION BY symbol ORDER BY idx) AS c FROM s))
SELECT symbol, min(idx) AS idx FROM r WHERE inside AND surge GROUP BY symbol, run"""))
def base_prompts(spark, sf):
    p = views.panel(spark, sf)
    rows = p.select("symbol", "idx", (label() == "base").alias("inside"), series.volume_surge(p, 6, 10, 0.9, 1.2).alias("surge"))
    return series.once_per_period(rows, "symbol", "idx", "inside", "surge")


@query("sentinel_crossings", "G8", oracle("phases", f"""
SELECT symbol, min(idx) FILTER ({LABELS} = 'left' AND close <= neckline * 0.9) AS base_zone, min(idx) FILTER (close >= target) AS sentinel FROM phases GROUP BY 1"""))
def sentinel_crossings(spark, sf):
    rows = phases(spark, sf).withColumn("label", label())
    zone = series.first_crossing(rows, "symbol", "idx", (F.col("label") == "left") & (F.col("close") <= F.col("neckline") * 0.9)).withColumnRenamed("idx", "base_zone")
    up = series.first_crossing(rows, "symbol", "idx", F.col("close") >= F.col("target")).withColumnRenamed("idx", "sentinel")
    return rows.select("symbol").distinct().join(zone, "symbol", "left").join(up, "symbol", "left")


@query("path_suggestions", "G8", oracle("phases", """
SELECT symbol, CASE WHEN close >= peak * 0.95 THEN 'C' WHEN CASE WHEN peak > neckline THEN (peak - close) / (peak - neckline) ELSE 1 END <= 0.5 THEN 'A' ELSE 'B' END AS path
FROM (SELECT symbol, arg_max(close, idx) AS close, arg_max(peak, idx) AS peak, any_value(neckline) AS neckline FROM phases WHERE phase = 'exhausted' GROUP BY 1)"""))
def path_suggestions(spark, sf):
    last = phases(spark, sf).filter("phase = 'exhausted'").groupBy("symbol").agg(
        F.max_by("close", "idx").alias("close"), F.max_by("peak", "idx").alias("peak"), F.first("neckline").alias("neckline"))
    return last.select("symbol", series.suggest_path(F.col("close"), F.col("peak"), F.col("neckline")).alias("path"))


@query("holder_surges", "G9 C6", oracle("holder_steps bars calendar panel", """
WITH n AS (SELECT h.symbol, h.eff - 1 AS idx, h.period, h.holders_change FROM holder_steps h WHERE h.holders_change >= 0.02)
SELECT n.symbol, n.idx, n.period, round(n.holders_change, 6) AS holders_change, round(p.close_last / p.old - 1, 6) AS gain FROM n
JOIN (SELECT symbol, idx, close_last, lag(close_last, 120) OVER (PARTITION BY symbol ORDER BY idx) AS old FROM panel) p ON p.symbol = n.symbol AND p.idx = n.idx WHERE p.close_last / p.old - 1 >= 0.05"""))
def holder_surges(spark, sf):
    from ..operators import pit
    steps = pit.holder_changes(views.holder_counts(views.bars(spark, sf)), views.calendar(spark, sf)).filter("holders_change >= 0.02")
    past = views.panel(spark, sf).select("symbol", "idx", "close_last", windows.lag_n("close_last", 120).alias("old"))
    rows = steps.withColumn("idx", F.col("eff") - 1).join(past, ["symbol", "idx"]).withColumn("gain", F.col("close_last") / F.col("old") - 1)
    return rounded(rows.filter("gain >= 0.05").select("symbol", "idx", "period", "holders_change", "gain"), "holders_change", "gain")


@query("label_in_force", "G10", """
SELECT e.event_id, l.label FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN (SELECT user_id, ts, event_type || '_' || event_id % 3 AS label FROM events WHERE event_type <> 'view') l ON l.user_id = e.user_id AND e.ts >= l.ts""")
def label_in_force(spark, sf):
    from ..operators.asof import asof_join
    e = read_table(spark, sf, "events")
    labels = e.filter("event_type <> 'view'").select("user_id", F.col("ts").alias("since"), F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string")).alias("label"))
    return asof_join(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), labels, ["user_id"], "ts", "since", ["label"], bucket="day").select("event_id", "label")


# -- ranges and turns ------------------------------------------------------------------------------

@query("average_true_range", "G11", oracle("bars", """
WITH t AS (SELECT symbol, trade_date, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS p FROM bars))
SELECT symbol, trade_date, round(greatest(avg(tr) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING), 1e-9), 6) AS atr FROM t"""))
def average_true_range(spark, sf):
    return rounded(series.with_atr(views.bars(spark, sf)).select("symbol", "trade_date", "atr"), "atr")


define("ranged", "bars", """
WITH t AS (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), close) AS p FROM bars))
SELECT symbol, trade_date, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close,
 greatest(avg(tr) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING), 1e-9) AS atr FROM t WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)""")
# Bar by bar: what is looked for (a high, a low, or either at the start), the best so far, and the highs and lows since then.
define("pivots", "ranged", """
WITH RECURSIVE s AS MATERIALIZED (SELECT symbol, pos, high, low, 3 * atr AS reach FROM ranged WHERE n >= 3),
f AS (
 SELECT symbol, pos, '' AS seek, pos AS hp, high AS hx, pos AS lp, low AS lx, [high] AS hs, [low] AS ls, NULL::VARCHAR AS kind, NULL::BIGINT AS turn_at, NULL::DOUBLE AS price FROM s WHERE pos = 0
 UNION ALL
 SELECT symbol, pos, CASE kind WHEN 'H' THEN 'L' WHEN 'L' THEN 'H' ELSE seek END,
  CASE WHEN kind = 'L' AND seek = 'L' THEN lp + list_position(h1, list_max(h1)) ELSE hp1 END, CASE WHEN kind = 'L' AND seek = 'L' THEN list_max(h1) ELSE hx1 END,
  CASE WHEN kind = 'H' AND seek = 'H' THEN hp + list_position(l1, list_min(l1)) ELSE lp1 END, CASE WHEN kind = 'H' AND seek = 'H' THEN list_min(l1) ELSE lx1 END,
  CASE WHEN seek = '' THEN CASE kind WHEN 'L' THEN h1[hp1 + 2:] WHEN 'H' THEN h1[lp1 + 2:] ELSE h1 END
   WHEN seek = 'H' THEN CASE WHEN hp1 = pos THEN [] WHEN kind = 'H' THEN h1[list_position(l1, list_min(l1)) + 1:] ELSE h1 END
   ELSE CASE WHEN lp1 = pos THEN [] WHEN kind = 'L' THEN h1[list_position(h1, list_max(h1)) + 1:] ELSE h1 END END,
  CASE WHEN seek = '' THEN CASE kind WHEN 'L' THEN l1[hp1 + 2:] WHEN 'H' THEN l1[lp1 + 2:] ELSE l1 END
   WHEN seek = 'H' THEN CASE WHEN hp1 = pos THEN [] WHEN kind = 'H' THEN l1[list_position(l1, list_min(l1)) + 1:] ELSE l1 END
   ELSE CASE WHEN lp1 = pos THEN [] WHEN kind = 'L' THEN l1[list_position(h1, list_max(h1)) + 1:] ELSE l1 END END,
  kind, CASE kind WHEN 'H' THEN hp1 WHEN 'L' THEN lp1 END, CASE kind WHEN 'H' THEN hx1 WHEN 'L' THEN lx1 END
 FROM (SELECT *, CASE WHEN seek = '' AND hx1 - lx1 >= reach THEN CASE WHEN hp1 > lp1 THEN 'L' ELSE 'H' END
   WHEN seek = 'H' AND hp1 < pos AND hx - low >= reach THEN 'H' WHEN seek = 'L' AND lp1 < pos AND high - lx >= reach THEN 'L' END AS kind
  FROM (SELECT s.*, f.seek, f.hp, f.hx, f.lp, f.lx, list_append(f.hs, s.high) AS h1, list_append(f.ls, s.low) AS l1,
    CASE WHEN f.seek <> 'L' AND s.high > f.hx THEN s.pos ELSE f.hp END AS hp1, CASE WHEN f.seek <> 'L' AND s.high > f.hx THEN s.high ELSE f.hx END AS hx1,
    CASE WHEN f.seek <> 'H' AND s.low < f.lx THEN s.pos ELSE f.lp END AS lp1, CASE WHEN f.seek <> 'H' AND s.low < f.lx THEN s.low ELSE f.lx END AS lx1
   FROM f JOIN s ON s.symbol = f.symbol AND s.pos = f.pos + 1))),
g AS MATERIALIZED (SELECT * FROM f),
l AS (SELECT * FROM g QUALIFY pos = max(pos) OVER (PARTITION BY symbol)),
p AS (SELECT symbol, turn_at AS pos, price, kind, true AS confirmed FROM g WHERE kind IS NOT NULL
 UNION ALL SELECT symbol, CASE seek WHEN 'H' THEN hp ELSE lp END, CASE seek WHEN 'H' THEN hx ELSE lx END, seek, false FROM l WHERE seek <> '')
SELECT p.symbol, r.trade_date, CAST(p.pos AS INTEGER) AS pos, p.price, p.kind, p.confirmed FROM p JOIN ranged r USING (symbol, pos)""")


@views.kept
def pivots(spark, sf):
    return series.zigzag(views.bars(spark, sf))


@query("zigzag_pivots", "G12", oracle("pivots", "SELECT * FROM pivots"))
def zigzag_pivots(spark, sf):
    return pivots(spark, sf)


define("zones", "pivots ranged", """
WITH RECURSIVE z AS (SELECT symbol, any_value(n) AS n, arg_max(close, pos) AS last_close, greatest(0.8::DOUBLE * arg_max(atr, pos), 0.005::DOUBLE * arg_max(close, pos)) AS tol, max(high) AS top, min(low) AS bottom FROM ranged GROUP BY 1),
p AS MATERIALIZED (SELECT p.symbol, p.pos, p.price, p.kind, z.n, z.tol, z.last_close, row_number() OVER (PARTITION BY p.symbol ORDER BY p.price, p.pos) AS r FROM pivots p JOIN z USING (symbol) WHERE confirmed),
c AS (SELECT symbol, r, price AS first, 0 AS cluster FROM p WHERE r = 1
 UNION ALL SELECT p.symbol, p.r, CASE WHEN p.price - c.first > 2 * p.tol THEN p.price ELSE c.first END, CASE WHEN p.price - c.first > 2 * p.tol THEN c.cluster + 1 ELSE c.cluster END FROM c JOIN p ON p.symbol = c.symbol AND p.r = c.r + 1),
g AS (SELECT p.symbol, cluster, any_value(tol) AS tol, any_value(last_close) AS last_close, count(*) AS touches, avg(price) AS price, min(price) AS lo, max(price) AS hi,
 sum(0.5 + 0.5 * exp(-(n - 1 - pos) / greatest(n / 3.0::DOUBLE, 1))) AS weight, count(DISTINCT kind) = 2 AS flipped FROM p JOIN c USING (symbol, r) GROUP BY 1, 2 HAVING count(*) >= 2),
o AS (SELECT symbol, CASE WHEN price > last_close THEN 'resistance' ELSE 'support' END AS side, lo - greatest(0, (tol * 0.5 - (hi - lo)) / 2) AS low, hi + greatest(0, (tol * 0.5 - (hi - lo)) / 2) AS high, price, touches,
 round(weight + CASE WHEN flipped THEN 0.5 ELSE 0 END, 3) AS score, flipped FROM g),
e AS (SELECT symbol, tol, 'resistance' AS side, top AS price FROM z UNION ALL SELECT symbol, tol, 'support', bottom FROM z),
u AS (SELECT * FROM o UNION ALL SELECT symbol, side, price - tol * 0.25, price + tol * 0.25, price, 1, 0.9, false FROM e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.symbol = e.symbol AND e.price >= o.low - e.tol AND e.price <= o.high + e.tol))
SELECT symbol, side, round(low, 6) AS low, round(high, 6) AS high, round(price, 6) AS price, touches, score, flipped FROM u QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY score DESC, u.price) <= 3""")


@query("price_zones", "G13", oracle("zones", "SELECT * FROM zones"))
def price_zones(spark, sf):
    return rounded(series.price_zones(pivots(spark, sf), views.bars(spark, sf)), "low", "high", "price")


@query("fibonacci_levels", "G15", oracle("pivots", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) AS r FROM pivots),
e AS (SELECT symbol, max(price) FILTER (r = 2) AS from_price, max(price) FILTER (r = 1) AS to_price FROM l WHERE r <= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT symbol, from_price, to_price, ratio, round(to_price - (to_price - from_price) * ratio, 6) AS level FROM e, (SELECT unnest([0, 0.236, 0.382, 0.5, 0.618, 0.786, 1])::DOUBLE AS ratio)"""))
def fibonacci_levels(spark, sf):
    return rounded(series.fibonacci(pivots(spark, sf)), "level")


@query("trend_lines", "G14", oracle("pivots ranged", """
WITH z AS (SELECT symbol, any_value(n) AS n, 0.5 * arg_max(atr, pos) AS tol FROM ranged GROUP BY 1 HAVING any_value(n) >= 10),
a AS (SELECT p.*, n, tol, CASE kind WHEN 'L' THEN 1 ELSE -1 END AS s FROM pivots p JOIN z USING (symbol) WHERE confirmed QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY pos DESC) <= 8),
c AS (SELECT a.symbol, a.kind, a.s, a.n, a.tol, a.pos AS i1, a.price AS p1, b.pos AS i2, b.price AS p2 FROM a JOIN a b ON a.symbol = b.symbol AND a.kind = b.kind AND b.pos - a.pos >= 3
 WHERE a.s * (b.price - a.price) > 0 AND abs(b.price - a.price) / (b.pos - a.pos) <= 0.03::DOUBLE * a.price),
v AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM ranged r WHERE r.symbol = c.symbol AND r.pos BETWEEN c.i1 AND c.i2
  AND c.s * (CASE WHEN c.kind = 'L' THEN r.low ELSE r.high END - (c.p1 + (c.p2 - c.p1) * (r.pos - c.i1) / (c.i2 - c.i1))) < -c.tol)),
k AS (SELECT v.symbol, v.kind, v.i1, v.i2, min(r.pos) AS b FROM v JOIN ranged r ON r.symbol = v.symbol AND r.pos > v.i2 AND v.s * (r.close - (v.p1 + (v.p2 - v.p1) * (r.pos - v.i1) / (v.i2 - v.i1))) < -v.tol GROUP BY ALL),
e AS (SELECT v.*, k.b IS NOT NULL AS broken, coalesce(k.b, v.n - 1) AS end_pos FROM v LEFT JOIN k USING (symbol, kind, i1, i2)),
t AS (SELECT e.symbol, e.kind, e.i1, e.i2, count(*) AS touches FROM e JOIN pivots p ON p.symbol = e.symbol AND p.kind = e.kind AND p.confirmed AND p.pos BETWEEN e.i1 AND e.end_pos
 AND abs(p.price - (e.p1 + (e.p2 - e.p1) * (p.pos - e.i1) / (e.i2 - e.i1))) <= e.tol GROUP BY ALL),
q AS (SELECT e.*, touches, round(touches * 2 + (i2 - i1) / n::DOUBLE + CASE WHEN broken THEN 0 ELSE 2 END + CASE WHEN broken THEN 1 - (n - 1 - end_pos) / n::DOUBLE ELSE 1 END, 3) AS score FROM e JOIN t USING (symbol, kind, i1, i2)),
w AS (SELECT * FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY score DESC, i1, i2) = 1) WHERE NOT broken OR n - 1 - end_pos <= 20),
o AS (SELECT w.symbol, w.kind, max(w.s * (CASE WHEN w.kind = 'L' THEN r.high ELSE r.low END - (w.p1 + (w.p2 - w.p1) * (r.pos - w.i1) / (w.i2 - w.i1)))) AS off FROM w JOIN ranged r ON r.symbol = w.symbol AND r.pos BETWEEN w.i1 AND w.end_pos GROUP BY ALL)
SELECT symbol, CASE kind WHEN 'L' THEN 'up' ELSE 'down' END AS kind, i1, p1, i2, p2, touches, broken, CAST(end_pos AS INTEGER) AS end_pos, score, round(CASE WHEN off > tol THEN s * off END, 6) AS channel_offset FROM w JOIN o USING (symbol, kind)"""))
def trend_lines(spark, sf):
    """The best rising and the best falling line of each series with its channel."""
    return rounded(chart_lines.trend_lines(views.bars(spark, sf), pivots(spark, sf)), "channel_offset")


# Session by session: the highest and lowest price since the last turn, and whether the price has left one of them by a fifth.
define("turns", "panel", """
WITH RECURSIVE s AS MATERIALIZED (SELECT symbol, idx, adj_last::DOUBLE AS x, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS n FROM panel WHERE adj_last IS NOT NULL),
f AS (
 SELECT symbol, n, idx, x AS hi, idx AS hi_at, x AS lo, idx AS lo_at, '' AS mood, CAST(NULL AS VARCHAR) AS kind, x AS turn_price, idx AS turn FROM s WHERE n = 1
 UNION ALL
 SELECT symbol, n, idx, CASE WHEN kind = 'trough' THEN x ELSE h END, CASE WHEN kind = 'trough' THEN idx ELSE h_at END, CASE WHEN kind = 'peak' THEN x ELSE l END, CASE WHEN kind = 'peak' THEN idx ELSE l_at END,
  CASE kind WHEN 'peak' THEN 'bear' WHEN 'trough' THEN 'bull' ELSE mood END, kind, CASE kind WHEN 'peak' THEN h ELSE l END, CASE kind WHEN 'peak' THEN h_at ELSE l_at END
 FROM (SELECT *, CASE WHEN mood <> 'bear' AND x <= h * 0.8::DOUBLE THEN 'peak' WHEN mood <> 'bull' AND x >= l * 1.2::DOUBLE THEN 'trough' END AS kind
  FROM (SELECT s.symbol, s.n, s.idx, s.x, f.mood, greatest(s.x, f.hi) AS h, CASE WHEN s.x > f.hi THEN s.idx ELSE f.hi_at END AS h_at, least(s.x, f.lo) AS l, CASE WHEN s.x < f.lo THEN s.idx ELSE f.lo_at END AS l_at
   FROM f JOIN s ON s.symbol = f.symbol AND s.n = f.n + 1)))
SELECT symbol, turn, turn_price AS price, kind, idx AS confirmed_at FROM f WHERE kind IS NOT NULL""")


@query("bull_bear_turns", "G18", oracle("turns", "SELECT * FROM turns"))
def bull_bear_turns(spark, sf):
    return series.bull_bear_turns(views.panel(spark, sf))


@query("average_cost", "G19", oracle("inputs", """
WITH s AS (SELECT symbol, list({'m': close::DOUBLE, 'q': close::DOUBLE * close, 'v': least(greatest(turnover_rate * 1000, 0), 0.5)} ORDER BY idx) AS s FROM inputs WHERE close IS NOT NULL GROUP BY 1),
r AS (SELECT symbol, list_reduce(list_prepend({'m': s[1].m, 'q': s[1].q, 'v': 0::DOUBLE}, s), lambda a, x: CASE WHEN x.v IS NULL THEN a ELSE {'m': (1 - x.v) * a.m + x.v * x.m, 'q': (1 - x.v) * a.q + x.v * x.m * x.m, 'v': 0::DOUBLE} END) AS c FROM s)
SELECT symbol, round(c.m, 4) AS cost, round(sqrt(greatest(c.q - c.m * c.m, 0)) / c.m, 6) AS dispersion FROM r"""))
def average_cost(spark, sf):
    rows = inputs(spark, sf).withColumn("rate", F.col("turnover_rate") * 1000)
    out = series.average_cost(rows)
    return out.withColumns({"cost": F.round("cost", 4), "dispersion": r6("dispersion")})


@query("same_sign_runs", "G20", oracle("returns", """
WITH r AS (SELECT symbol, idx, sign(ret) AS s, idx FROM returns WHERE ret IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx) - row_number() OVER (PARTITION BY symbol, s ORDER BY idx) AS g FROM r)
SELECT symbol, min(idx) AS start, CAST(min(s) AS INTEGER) AS direction, count(*) AS length FROM g GROUP BY symbol, s, g"""))
def same_sign_runs(spark, sf):
    rows = views.returns(spark, sf).filter("ret is not null").select("symbol", "idx", F.signum("ret").cast("int").alias("direction"))
    runs = windows.islands(rows, ["symbol"], "idx", "direction")
    return runs.groupBy("symbol", "run", "direction").agg(F.min("idx").alias("start"), F.count("*").alias("length")).drop("run")


@query("cooldown_events", "G21", oracle("returns", """
WITH h AS (SELECT symbol, list(idx ORDER BY idx) AS s FROM returns WHERE ret > 0.5 GROUP BY 1),
k AS (SELECT symbol, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] > 20 THEN a || x ELSE a END) AS k FROM h)
SELECT symbol, unnest(k) AS idx FROM k"""))
def cooldown_events(spark, sf):
    return series.cooldown(views.returns(spark, sf).filter("ret > 0.5").select("symbol", "idx"), 20)


CANDLES = """
WITH b AS (SELECT *, abs(close - open) AS body, high - low AS rng, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS n, high - greatest(open, close) AS upper, least(open, close) - low AS lower FROM bars),
a AS (SELECT *, coalesce(avg(body) OVER p, body) AS ab, coalesce(avg(rng) OVER p, rng) AS ar FROM b WINDOW p AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, lag(open, 1) OVER w AS open1, lag(open, 2) OVER w AS open2, lag(close, 1) OVER w AS close1, lag(close, 2) OVER w AS close2, lag(body, 1) OVER w AS body1, lag(body, 2) OVER w AS body2, lag(rng, 1) OVER w AS rng1, lag(rng, 2) OVER w AS rng2, lag(upper, 1) OVER w AS upper1, lag(upper, 2) OVER w AS upper2, lag(lower, 1) OVER w AS lower1, lag(lower, 2) OVER w AS lower2, lag(ab, 1) OVER w AS ab1, lag(ab, 2) OVER w AS ab2, lag(ar, 1) OVER w AS ar1, lag(ar, 2) OVER w AS ar2,
 lag(close, 6) OVER w - lag(close, 1) OVER w AS m0, lag(close, 8) OVER w - lag(close, 3) OVER w AS m2 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
f AS (SELECT *, coalesce(m0 >= ar, false) AS falling, coalesce(-m0 >= ar, false) AS rising, coalesce(m2 >= ar2, false) AS falling2, coalesce(-m2 >= ar2, false) AS rising2, n >= 3 AND rng1 > 0 AND rng2 > 0 AS three,
 body2 >= greatest(ab2, 0.5 * rng2) AND rng2 > 0 AS long2, body1 >= greatest(ab1, 0.5 * rng1) AND rng1 > 0 AS long1, body > body1 AND body >= ab AND body1 >= 0.3::DOUBLE * ab AS engulf, rng >= 0.8::DOUBLE * ar AS single,
 lower >= 2 * body AND upper <= 0.1::DOUBLE * rng AND body > 0 AS long_low, upper >= 2 * body AND lower <= 0.1::DOUBLE * rng AND body > 0 AS long_up FROM l WHERE true)
SELECT symbol, trade_date, pattern FROM (SELECT symbol, trade_date, CASE
 WHEN three AND falling2 AND close2 < open2 AND long2 AND body1 <= 0.3::DOUBLE * body2 AND greatest(open1, close1) <= close2 + 0.1::DOUBLE * body2 AND close > open AND close >= (open2 + close2) / 2 THEN 'morning_star'
 WHEN three AND rising2 AND close2 > open2 AND long2 AND body1 <= 0.3::DOUBLE * body2 AND least(open1, close1) >= close2 - 0.1::DOUBLE * body2 AND close < open AND close <= (open2 + close2) / 2 THEN 'evening_star'
 WHEN three AND falling2 AND close > open AND close1 > open1 AND close2 > open2 AND body >= 0.6::DOUBLE * ab AND body1 >= 0.6::DOUBLE * ab1 AND body2 >= 0.6::DOUBLE * ab2 AND upper <= 0.3::DOUBLE * body AND upper1 <= 0.3::DOUBLE * body1 AND upper2 <= 0.3::DOUBLE * body2
  AND close2 < close1 AND close1 < close AND open2 < open1 AND open1 <= close2 AND open1 < open AND open <= close1 THEN 'three_white_soldiers'
 WHEN three AND rising2 AND close < open AND close1 < open1 AND close2 < open2 AND body >= 0.6::DOUBLE * ab AND body1 >= 0.6::DOUBLE * ab1 AND body2 >= 0.6::DOUBLE * ab2 AND lower <= 0.3::DOUBLE * body AND lower1 <= 0.3::DOUBLE * body1 AND lower2 <= 0.3::DOUBLE * body2
  AND close2 > close1 AND close1 > close AND open2 > open1 AND open1 >= close2 AND open1 > open AND open >= close1 THEN 'three_black_crows'
 WHEN rng1 > 0 AND falling AND engulf AND close1 < open1 AND close > open AND open <= close1 AND close >= open1 THEN 'bullish_engulfing'
 WHEN rng1 > 0 AND rising AND engulf AND close1 > open1 AND close < open AND open >= close1 AND close <= open1 THEN 'bearish_engulfing'
 WHEN rng1 > 0 AND falling AND close1 < open1 AND long1 AND close > open AND open < close1 AND close >= (open1 + close1) / 2 AND close < open1 THEN 'piercing'
 WHEN rng1 > 0 AND rising AND close1 > open1 AND long1 AND close < open AND open > close1 AND close > open1 AND close <= (open1 + close1) / 2 THEN 'dark_cloud'
 WHEN single AND body <= 0.05::DOUBLE * rng AND rng >= ar AND (falling OR rising) THEN 'doji'
 WHEN single AND long_low THEN CASE WHEN falling THEN 'hammer' WHEN rising THEN 'hanging_man' END
 WHEN single AND long_up THEN CASE WHEN falling THEN 'inverted_hammer' WHEN rising THEN 'shooting_star' END END AS pattern FROM f WHERE n >= 2 AND rng > 0 AND ar > 0) WHERE pattern IS NOT NULL"""


@query("candle_patterns", "G17", oracle("bars", CANDLES))
def candle_patterns(spark, sf):
    return series.candles(views.bars(spark, sf))
