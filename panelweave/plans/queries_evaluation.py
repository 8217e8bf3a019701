"""Cross-sections, universes, factor evaluation and score combination."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import evaluate, factors, windows, xsection
from . import views
from .common import classes, r6
from .ctes import define, oracle
from .queries_factors import LIMITS
from .registry import query

# Dense enough on a sparse panel; five families, one size factor that is only industry-neutral.
USED = ["rev_1m", "vol_60", "turn_20", "ln_float_mcap", "amplitude_20"]
MIN_NAMES, QUANTILES, HORIZONS, TOP = 8, 4, (1, 2, 3), 8
BY = ["factor", "idx"]


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


def inputs(spark, sf):
    return views.factor_inputs(spark, sf)


def universe_flags(rows, cap_size=18):
    coverage = factors.bar_coverage(60)
    rows = rows.withColumns({"coverage": coverage, "turnover_mean": windows.mean_n(F.col("amount"), 20, 5),
                             "age": F.col("idx") - F.min("idx").over(Window.partitionBy("symbol"))})
    steps = {"has_bar": F.col("has_bar"), "listed": F.col("age") >= 120, "coverage": F.col("coverage") >= 0.4,
             "price": F.col("close") >= 3000, "size_known": F.col("turnover_mean").isNotNull() & (F.col("float_mcap") > 0)}
    return rows, steps, cap_size


def universe_at(rows, schedule):
    rows, steps, size = universe_flags(rows)
    return xsection.universe(rows.join(schedule.select("idx"), "idx"), steps, "turnover_mean", "float_mcap", size)


def directions(spark):
    """One row per factor used: as small as the registry."""
    rows = [(n, factors.FACTORS[n].family, factors.FACTORS[n].direction, "size" in factors.FACTORS[n].neutralize)
            for n in USED]
    return spark.createDataFrame(rows, "factor string, family string, direction int, by_size boolean")


def raw_long(spark, sf, rows=None, keep=("float_mcap",)):
    rows = inputs(spark, sf) if rows is None else rows
    schedule = evaluate.month_ends(views.calendar(spark, sf))
    wide = factors.compute(rows, USED, LIMITS, keep).join(schedule.select("idx"), "idx")
    return factors.to_long(wide, USED, ("symbol", "idx", *keep))


def processed(spark, sf):
    """Universe members' z-scores at month ends."""
    rows = inputs(spark, sf)
    schedule = evaluate.month_ends(views.calendar(spark, sf))
    members = universe_at(rows, schedule).filter("in_universe").select("idx", "symbol")
    long = (raw_long(spark, sf, rows).join(members, ["idx", "symbol"])
            .join(classes(spark, sf), "symbol").join(F.broadcast(directions(spark)), "factor")
            .withColumn("ln_size", F.log("float_mcap")))
    return xsection.process(long, BY, "raw", "industry", "ln_size", "direction", "by_size", min_names=MIN_NAMES)


@views.kept
def z_scores(spark, sf):
    return processed(spark, sf).select("factor", "idx", "symbol", "z")


def locked():
    """Opens at or above half as much again as the reference price cannot be bought."""
    return F.col("open") >= F.floor(F.floor(F.col("ref_close") + 0.5) * 1.5 + 0.5)


@views.kept
def forwards(spark, sf):
    return evaluate.forward_returns(views.returns(spark, sf), evaluate.month_ends(views.calendar(spark, sf)), HORIZONS,
                                    locked())


@views.kept
def evaluated(spark, sf):
    return z_scores(spark, sf).join(forwards(spark, sf), ["idx", "symbol"])


def composite_scores(spark, sf):
    families = directions(spark).select("factor", "family")
    scores = xsection.family_scores(z_scores(spark, sf), families)
    return xsection.composite(scores, len({factors.FACTORS[n].family for n in USED}), 3)


def targets(spark, sf):
    return xsection.top_n(composite_scores(spark, sf), ["idx"], "score", TOP)


# -- SQL twins ---------------------------------------------------------------------

define("schedule", "calendar", """
SELECT idx, trade_date, row_number() OVER (ORDER BY idx) AS row FROM
(SELECT *, lead(trade_date) OVER (ORDER BY idx) AS nxt FROM calendar) WHERE month(nxt) <> month(trade_date)""")

RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / (count({x}) OVER (PARTITION BY {by}))"

define("flags", "inputs schedule", """
SELECT *, has_bar AND age >= 120 AND coverage >= 0.4 AND close >= 3000 AND turnover_mean IS NOT NULL AND float_mcap > 0 AS eligible FROM
(SELECT *, idx - min(idx) OVER (PARTITION BY symbol) AS age,
  CASE WHEN idx >= 60 THEN (count(*) FILTER (has_bar) OVER (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING)) / 60::DOUBLE END AS coverage,
  CASE WHEN idx >= 20 AND count(amount) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING) >= 5
   THEN avg(amount) OVER (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING) END AS turnover_mean FROM inputs) i
JOIN (SELECT idx FROM schedule) s USING (idx)""")
define("members", "flags", f"""
SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) <= 18 AS in_universe FROM
(SELECT *, 0.5 * {RANK.format(by='idx', x='turnover_mean')} + 0.5 * {RANK.format(by='idx', x='float_mcap')} AS score
 FROM flags WHERE eligible)""")
define("raw_long", "price_factors inputs members classes", """
SELECT p.symbol, p.idx, u.factor, u.raw, ln(m.float_mcap) AS ln_size, c.industry FROM
(UNPIVOT (SELECT symbol, idx, """ + ", ".join(USED) + " FROM price_factors) ON " + ", ".join(USED) + """
 INTO NAME factor VALUE raw) u JOIN price_factors p USING (symbol, idx)
JOIN members m ON m.symbol = u.symbol AND m.idx = u.idx AND m.in_universe JOIN classes c ON c.symbol = u.symbol""")
define("clipped", "raw_long", """
WITH m AS (SELECT *, quantile_cont(raw, 0.5) OVER (PARTITION BY factor, idx) AS med FROM raw_long),
d AS (SELECT *, quantile_cont(abs(raw - med), 0.5) OVER (PARTITION BY factor, idx) * 1.4826 AS mad,
  quantile_cont(raw, 0.01) OVER (PARTITION BY factor, idx) AS p1, quantile_cont(raw, 0.99) OVER (PARTITION BY factor, idx) AS p99 FROM m)
SELECT factor, idx, symbol, industry, ln_size, raw,
 least(greatest(raw, CASE WHEN mad > 0 THEN med - 3 * mad ELSE p1 END), CASE WHEN mad > 0 THEN med + 3 * mad ELSE p99 END) AS x FROM d""")
define("residuals", "clipped", """
WITH d AS (SELECT *, x - avg(x) OVER (PARTITION BY factor, idx, industry) AS dx,
  CASE WHEN factor = 'ln_float_mcap' THEN 0 ELSE ln_size - avg(ln_size) OVER (PARTITION BY factor, idx, industry) END AS ds FROM clipped),
r AS (SELECT *, dx - coalesce(sum(dx * ds) OVER (PARTITION BY factor, idx) / nullif(sum(ds * ds) OVER (PARTITION BY factor, idx), 0), 0) * ds AS e FROM d)
SELECT factor, idx, symbol, CASE WHEN abs(e) <= 1e-10 * max(abs(x)) OVER (PARTITION BY factor, idx) THEN 0 ELSE e END AS residual FROM r""")
define("processed", "residuals", """
SELECT factor, idx, symbol, CASE WHEN factor IN ('rev_1m', 'vol_60', 'turn_20', 'ln_float_mcap', 'amplitude_20') THEN -1 ELSE 1 END *
  CASE WHEN sd > 0 THEN (residual - m) / sd ELSE 0 END AS z FROM
(SELECT *, stddev_pop(residual) OVER w AS sd, avg(residual) OVER w AS m, count(*) OVER w AS n FROM residuals
 WINDOW w AS (PARTITION BY factor, idx)) WHERE n >= 8""")
define("fwd", "returns schedule", """
WITH p AS (SELECT symbol, idx, lead(CASE WHEN has_bar THEN open * hfq END) OVER w AS entry,
  lead(coalesce(CASE WHEN has_bar THEN open * hfq END, adj_last)) OVER w AS exit_,
  coalesce(lead(open >= floor(floor(ref_close + 0.5) * 1.5 + 0.5)) OVER w, false) AS locked, lead(idx) OVER w AS exit_idx
 FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT symbol, p.idx, s.row, entry IS NOT NULL AND NOT locked AS investable,
""" + ", ".join(f"CASE WHEN entry IS NOT NULL AND NOT locked THEN lead(exit_, {h}) OVER v / entry - 1 END AS fwd_{h}" for h in HORIZONS) + """,
 lead(exit_idx, 1) OVER v AS known_at
FROM p JOIN schedule s ON s.idx = p.idx WINDOW v AS (PARTITION BY symbol ORDER BY s.row)""")
define("evaluated", "processed fwd", "SELECT * FROM processed JOIN fwd USING (idx, symbol)")


def ic_sql(h):
    return f"""
WITH v AS (SELECT *, CASE WHEN investable AND fwd_{h} IS NOT NULL THEN z END AS zz, CASE WHEN investable AND fwd_{h} IS NOT NULL THEN fwd_{h} END AS ff FROM evaluated),
r AS (SELECT factor, idx, symbol, {RANK.format(by='factor, idx', x='zz')} AS zr, {RANK.format(by='factor, idx', x='ff')} AS fr FROM v WHERE zz IS NOT NULL)
SELECT factor, idx, count(zz) AS n, count(*) FILTER (investable) AS investable,
 CASE WHEN count(zz) >= 8 AND var_pop(zz) > 0 AND var_pop(ff) > 0 THEN CASE WHEN abs(corr(zz, ff)) < 1e-12 THEN 0 ELSE corr(zz, ff) END END AS ic,
 CASE WHEN count(zz) >= 8 AND var_pop(zr) > 0 AND var_pop(fr) > 0 THEN CASE WHEN abs(corr(zr, fr)) < 1e-12 THEN 0 ELSE corr(zr, fr) END END AS rank_ic
FROM v LEFT JOIN r USING (factor, idx, symbol) GROUP BY 1, 2"""


define("ic", "evaluated", ic_sql(1))
define("buckets", "evaluated", f"""
SELECT factor, idx, symbol, fwd_1 AS fwd, ntile({QUANTILES}) OVER (PARTITION BY factor, idx ORDER BY z, symbol) AS bucket FROM
(SELECT *, count(*) OVER (PARTITION BY factor, idx) AS n FROM evaluated WHERE investable AND fwd_1 IS NOT NULL) WHERE n >= {max(MIN_NAMES, 2 * QUANTILES)}""")
define("quantiles", "buckets", "SELECT *, q4 - q1 AS top_minus_bottom, q4 - universe_mean AS top_minus_universe FROM (SELECT factor, idx, "
       + ", ".join(f"avg(fwd) FILTER (bucket = {i}) AS q{i}" for i in range(1, 5))
       + ", avg(fwd) AS universe_mean FROM buckets GROUP BY 1, 2)")
define("turnover", "buckets", """
WITH t AS (SELECT * FROM buckets WHERE bucket = 4), r AS (SELECT factor, idx, lag(idx) OVER (PARTITION BY factor ORDER BY idx) AS before
 FROM (SELECT DISTINCT factor, idx FROM buckets))
SELECT t.factor, t.idx, CASE WHEN any_value(r.before) IS NOT NULL THEN 1 - count(p.symbol) / count(*)::DOUBLE END AS top_turnover
FROM t JOIN r USING (factor, idx) LEFT JOIN t p ON p.factor = t.factor AND p.idx = r.before AND p.symbol = t.symbol GROUP BY 1, 2""")
define("families", "processed", """
SELECT idx, symbol, CASE factor WHEN 'rev_1m' THEN 'momentum' WHEN 'vol_60' THEN 'volatility' WHEN 'turn_20' THEN 'liquidity'
 WHEN 'ln_float_mcap' THEN 'size' ELSE 'technical' END AS family, avg(z) AS score FROM processed GROUP BY ALL""")
define("composite", "families", """
SELECT idx, symbol, round(sum(score) / 5, 12) + 0.0::DOUBLE AS score, count(score) AS families FROM families GROUP BY 1, 2 HAVING count(score) >= 3""")
define("targets", "composite", """
SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY idx) AS weight FROM
(SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS place FROM composite) WHERE place <= 8""")


@query("universe_filters", "X4 X5", oracle("members flags", """
SELECT f.idx, count(*) FILTER (f.has_bar) AS after_has_bar, count(*) FILTER (f.has_bar AND f.age >= 120) AS after_listed,
 count(*) FILTER (f.has_bar AND f.age >= 120 AND f.coverage >= 0.4) AS after_coverage,
 count(*) FILTER (f.has_bar AND f.age >= 120 AND f.coverage >= 0.4 AND f.close >= 3000) AS after_price,
 count(*) FILTER (f.eligible) AS after_size_known, count(*) FILTER (m.in_universe) AS universe
FROM flags f LEFT JOIN members m USING (idx, symbol) GROUP BY 1"""))
def universe_filters(spark, sf):
    return xsection.universe_counts(universe_at(inputs(spark, sf), evaluate.month_ends(views.calendar(spark, sf))))


@query("universe_members", "X4 X5", oracle("members", """
SELECT idx, symbol, round(score, 6) AS score, in_universe FROM members"""))
def universe_members(spark, sf):
    flags = universe_at(inputs(spark, sf), evaluate.month_ends(views.calendar(spark, sf)))
    return rounded(flags.filter("after_size_known").select("idx", "symbol", "score", "in_universe"), "score")


@query("factor_panel_long", "X10 E1", oracle("price_factors schedule", f"""
SELECT symbol, idx, factor, round(raw, 6) AS raw FROM (UNPIVOT (SELECT symbol, idx, {', '.join(USED)} FROM price_factors
 JOIN schedule USING (idx)) ON {', '.join(USED)} INTO NAME factor VALUE raw)"""))
def factor_panel_long(spark, sf):
    return rounded(raw_long(spark, sf, keep=()), "raw")


@query("factor_winsorized", "X1", oracle("clipped", "SELECT factor, idx, symbol, round(x, 6) AS x FROM clipped"))
def factor_winsorized(spark, sf):
    rows = inputs(spark, sf)
    members = universe_at(rows, evaluate.month_ends(views.calendar(spark, sf))).filter("in_universe").select("idx", "symbol")
    long = raw_long(spark, sf, rows).join(members, ["idx", "symbol"])
    return rounded(xsection.winsorize(long, BY, "raw").select("factor", "idx", "symbol", "x"), "x")


@query("factor_processed", "X1 X2 X3", oracle("processed", "SELECT factor, idx, symbol, round(z, 6) + 0.0::DOUBLE AS z FROM processed"))
def factor_processed(spark, sf):
    return rounded(processed(spark, sf).select("factor", "idx", "symbol", "z"), "z")


@query("style_zscores", "X11", oracle("raw_long members", """
WITH d AS (SELECT *, quantile_cont(raw, 0.5) OVER w AS med FROM raw_long WINDOW w AS (PARTITION BY factor, idx)),
e AS (SELECT *, quantile_cont(abs(raw - med), 0.5) OVER w * 1.4826 AS mad, quantile_cont(raw, 0.01) OVER w AS p1, quantile_cont(raw, 0.99) OVER w AS p99 FROM d WINDOW w AS (PARTITION BY factor, idx)),
x AS (SELECT e.factor, e.idx, e.symbol, m.float_mcap AS w, least(greatest(raw, CASE WHEN mad > 0 THEN med - 3 * mad ELSE p1 END), CASE WHEN mad > 0 THEN med + 3 * mad ELSE p99 END) AS x
 FROM e JOIN members m USING (idx, symbol)),
a AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS m, count(*) OVER g AS n, avg(x) OVER g AS am, stddev_pop(x) OVER g AS asd FROM x WINDOW g AS (PARTITION BY factor, idx)),
b AS (SELECT *, sqrt(sum(w * (x - m) * (x - m)) OVER g / sum(w) OVER g) AS sd FROM a WINDOW g AS (PARTITION BY factor, idx))
SELECT factor, idx, symbol, round(CASE WHEN n >= 10 AND sd > 0 THEN (x - m) / sd ELSE 0 END, 6) AS cap_z,
 CASE WHEN n >= 10 THEN round(CASE WHEN asd > 0 THEN (x - am) / asd ELSE 0 END, 6) END AS z FROM b"""))
def style_zscores(spark, sf):
    rows = inputs(spark, sf)
    members = universe_at(rows, evaluate.month_ends(views.calendar(spark, sf))).filter("in_universe").select("idx", "symbol")
    long = xsection.winsorize(raw_long(spark, sf, rows).join(members, ["idx", "symbol"]), BY, "raw")
    scored = xsection.zscore(xsection.weighted_zscore(long, BY, "x", "float_mcap", "cap_z"), BY, "x", "z", min_names=10)
    return rounded(scored.select("factor", "idx", "symbol", "cap_z", "z"), "cap_z", "z")


@query("momentum_selection", "X6 W11", oracle("inputs schedule", f"""
WITH s AS (SELECT symbol, idx, close, amount_20, bars_120, lag20 / nullif(lag120, 0) - 1 AS score FROM
 (SELECT symbol, idx, close, avg(amount) OVER {{w20}} AS amount_20, count(*) FILTER (has_bar) OVER (PARTITION BY symbol ORDER BY idx ROWS 120 PRECEDING) AS bars_120,
  lag(adj_last, 20) OVER (PARTITION BY symbol ORDER BY idx) AS lag20, lag(adj_last, 120) OVER (PARTITION BY symbol ORDER BY idx) AS lag120 FROM inputs)
 JOIN (SELECT idx FROM schedule) USING (idx))
SELECT idx, symbol, round(score, 6) AS score, place, round(1.0::DOUBLE / count(*) OVER (PARTITION BY idx), 6) AS weight FROM
(SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS place FROM s
 WHERE close >= 500 AND amount_20 > 0 AND bars_120 >= 50 AND score IS NOT NULL) WHERE place <= 8""".replace(
    "{w20}", "(PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING)")))
def momentum_selection(spark, sf):
    rows = inputs(spark, sf).withColumns({
        "amount_20": F.avg("amount").over(windows.last_n(20)),
        "bars_120": F.count(F.when(F.col("has_bar"), 1)).over(windows.last_n(121)),
        "score": F.try_divide(windows.lag_n("adj_last", 20), windows.lag_n("adj_last", 120)) - 1})
    schedule = evaluate.month_ends(views.calendar(spark, sf)).select("idx")
    fit = rows.join(schedule, "idx").filter("close >= 500 AND amount_20 > 0 AND bars_120 >= 50")
    return rounded(xsection.top_n(fit, ["idx"], "score", TOP).select("idx", "symbol", "score", "place", "weight"),
                   "score", "weight")


@query("family_scores", "X7", oracle("families", "SELECT idx, symbol, family, round(score, 6) + 0.0::DOUBLE AS score FROM families"))
def family_scores(spark, sf):
    return rounded(xsection.family_scores(z_scores(spark, sf), directions(spark).select("factor", "family")), "score")


@query("composite_scores", "X7 X9", oracle("composite", """
SELECT idx, symbol, round(score, 6) + 0.0::DOUBLE AS score, families, row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS rank FROM composite"""))
def composite_ranked(spark, sf):
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "symbol"))
    return rounded(composite_scores(spark, sf).withColumn("rank", place), "score")


@query("forward_returns", "E2", oracle("fwd", """
SELECT symbol, idx, row, investable, known_at, round(fwd_1, 6) AS fwd_1, round(fwd_2, 6) AS fwd_2, round(fwd_3, 6) AS fwd_3 FROM fwd"""))
def forward_returns(spark, sf):
    return rounded(forwards(spark, sf), "fwd_1", "fwd_2", "fwd_3")


@query("information_coefficients", "E3", oracle("ic", """
SELECT factor, idx, n, investable, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ic"""))
def information_coefficients(spark, sf):
    return rounded(evaluate.information_coefficients(evaluated(spark, sf), 1, MIN_NAMES), "ic", "rank_ic")


@query("ic_decay", "E3 E6", oracle("evaluated", " UNION ALL ".join(
    f"SELECT factor, {h} AS horizon, round(avg(rank_ic), 6) AS rank_ic FROM ({ic_sql(h)}) GROUP BY 1" for h in HORIZONS)))
def ic_decay(spark, sf):
    values = evaluated(spark, sf)
    parts = [evaluate.information_coefficients(values, h, MIN_NAMES).groupBy("factor").agg(r6(F.avg("rank_ic")).alias("rank_ic"))
             .withColumn("horizon", F.lit(h)) for h in HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("quantile_returns", "E4", oracle("quantiles", "SELECT factor, idx, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("q1", "q2", "q3", "q4", "universe_mean", "top_minus_bottom", "top_minus_universe")) + " FROM quantiles"))
def quantile_returns(spark, sf):
    table = evaluate.quantile_returns(evaluate.quantile_buckets(evaluated(spark, sf), 1, QUANTILES, MIN_NAMES), QUANTILES)
    return rounded(table, *[c for c in table.columns if c not in BY])


@query("top_bucket_turnover", "E5", oracle("turnover", "SELECT factor, idx, round(top_turnover, 6) AS top_turnover FROM turnover"))
def top_bucket_turnover(spark, sf):
    buckets = evaluate.quantile_buckets(evaluated(spark, sf), 1, QUANTILES, MIN_NAMES)
    return rounded(evaluate.top_turnover(buckets, QUANTILES), "top_turnover")


define("factor_summary", "ic quantiles turnover", """
WITH a AS (SELECT factor, count(ic) AS periods, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS ic_ir, avg(rank_ic) AS rank_ic_mean,
 avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(rank_ic)) AS rank_ic_t, avg(CAST(rank_ic > 0 AS INTEGER)) AS rank_ic_hit,
 avg(n / nullif(investable, 0)::DOUBLE) AS coverage FROM ic GROUP BY 1),
b AS (SELECT factor, avg(top_minus_universe) * 12 AS top_minus_universe_ann,
 avg(top_minus_universe) / stddev_samp(top_minus_universe) * sqrt(count(*)) AS top_minus_universe_t, avg(top_minus_bottom) * 12 AS top_minus_bottom_ann FROM quantiles GROUP BY 1),
c AS (SELECT factor, avg(top_turnover) AS top_turnover FROM turnover GROUP BY 1)
SELECT * FROM a LEFT JOIN b USING (factor) LEFT JOIN c USING (factor)""")
SUMMARY = ["ic_mean", "ic_ir", "rank_ic_mean", "rank_ic_t", "rank_ic_hit", "coverage", "top_minus_universe_ann",
           "top_minus_universe_t", "top_minus_bottom_ann", "top_turnover"]


@views.kept
def bucketed(spark, sf):
    return evaluate.quantile_buckets(evaluated(spark, sf), 1, QUANTILES, MIN_NAMES)


def summary_table(spark, sf):
    values = evaluated(spark, sf)
    ic = evaluate.information_coefficients(values, 1, MIN_NAMES)
    buckets = bucketed(spark, sf)
    return evaluate.summary(ic, evaluate.quantile_returns(buckets, QUANTILES), evaluate.top_turnover(buckets, QUANTILES), 12)


@query("factor_summary", "E6", oracle("factor_summary", "SELECT factor, periods, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in SUMMARY) + " FROM factor_summary"))
def factor_summary(spark, sf):
    return rounded(summary_table(spark, sf), *SUMMARY)


@query("factor_significance", "E7", oracle("factor_summary", """
WITH p AS (SELECT factor, rank_ic_t AS t, abs(rank_ic_t) / sqrt(2) AS x FROM factor_summary),
e AS (SELECT factor, t, 1 - exp(-x * x) * list_sum([exp((2 * n + 1) * ln(x) - lgamma(n + 1.5)) FOR n IN range(0, 400)]) AS p FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY p, factor) AS k, count(*) OVER () AS m FROM e)
SELECT factor, round(t, 6) AS t, round(p, 6) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS q,
 abs(t) > 3 OR least(min(p * m / k) OVER (ORDER BY k DESC), 1) < 0.05 AS significant FROM r"""))
def factor_significance(spark, sf):
    rows = summary_table(spark, sf).select("factor", F.col("rank_ic_t").alias("t"))
    tested = evaluate.benjamini_hochberg(rows.withColumn("p", evaluate.normal_p("t")), "p", "q")
    return rounded(tested.withColumn("significant", (F.abs("t") > 3) | (F.col("q") < 0.05)), "t", "p", "q")


CORRELATION_SQL = f"""
WITH r AS (SELECT factor, idx, symbol, {RANK.format(by='factor, idx', x='z')} AS r FROM processed),
c AS (SELECT a.idx, a.factor AS f1, b.factor AS f2, CASE WHEN count(*) >= 8 AND var_pop(a.r) > 0 AND var_pop(b.r) > 0 THEN corr(a.r, b.r) END AS c
 FROM r a JOIN r b ON a.idx = b.idx AND a.symbol = b.symbol AND a.factor <= b.factor GROUP BY ALL)
SELECT f1, f2, round(avg(c), 6) AS correlation, count(c) AS rows FROM c GROUP BY 1, 2"""


@query("factor_correlation", "E8", oracle("processed", CORRELATION_SQL))
def factor_correlation(spark, sf):
    return rounded(evaluate.factor_correlation(processed(spark, sf), MIN_NAMES), "correlation")


@query("correlated_factor_pairs", "E9", oracle("processed", f"""
SELECT * FROM ({CORRELATION_SQL}) WHERE f1 <> f2 AND abs(correlation) >= 0.1"""))
def correlated_factor_pairs(spark, sf):
    pairs = evaluate.correlated_pairs(evaluate.factor_correlation(processed(spark, sf), MIN_NAMES), 0.1)
    return rounded(pairs, "correlation")


@query("trailing_ic_weights", "X8", oracle("ic fwd", """
WITH k AS (SELECT i.factor, i.idx, i.rank_ic, f.known_at FROM ic i JOIN (SELECT DISTINCT idx, known_at FROM fwd WHERE known_at IS NOT NULL) f USING (idx)),
t AS (SELECT DISTINCT idx FROM ic),
n AS (SELECT t.idx AS target, k.*, dense_rank() OVER (PARTITION BY t.idx ORDER BY k.idx DESC) AS age FROM t JOIN k ON k.known_at <= t.idx)
SELECT target AS idx, factor, round(avg(rank_ic), 6) AS weight FROM n WHERE age <= 24 GROUP BY 1, 2
HAVING avg(rank_ic) > 0 AND (SELECT count(DISTINCT idx) FROM k WHERE known_at <= target) >= 12"""))
def trailing_ic_weights(spark, sf):
    values = evaluated(spark, sf)
    ic = evaluate.information_coefficients(values, 1, MIN_NAMES)
    known = forwards(spark, sf).groupBy("idx").agg(F.max("known_at").alias("known_at"))
    weights = xsection.trailing_ic_weights(ic.join(known, "idx").select("factor", "idx", "known_at", F.col("rank_ic").alias("ic")),
                                           ic.select("idx").distinct())
    return rounded(weights, "weight")


def sweep(spark, sf):
    """One grouping key more than an evaluation: every (top n, horizon) variant in the same pass."""
    ranked = composite_scores(spark, sf).withColumn(
        "place", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "symbol")))
    rows = ranked.join(forwards(spark, sf), ["idx", "symbol"]).filter("investable")
    grid = rows.withColumn("top", F.explode(F.array(F.lit(4), F.lit(8), F.lit(12)))).filter("place <= top")
    long = grid.unpivot(["idx", "top"], ["fwd_1", "fwd_2"], "horizon", "ret").filter("ret is not null")
    monthly = long.groupBy("top", "horizon", "idx").agg(F.avg("ret").alias("ret"))
    return monthly.groupBy("top", "horizon").agg(
        F.count("*").alias("periods"), F.avg("ret").alias("mean"),
        (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("sharpe"))


define("sweep", "composite fwd", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, symbol) AS place FROM composite),
g AS (SELECT r.idx, t.top, f.fwd_1, f.fwd_2 FROM r JOIN fwd f USING (idx, symbol) JOIN (VALUES (4), (8), (12)) t(top) ON r.place <= t.top WHERE f.investable),
l AS (UNPIVOT g ON fwd_1, fwd_2 INTO NAME horizon VALUE ret),
m AS (SELECT top, horizon, idx, avg(ret) AS ret FROM l GROUP BY ALL)
SELECT top, horizon, count(*) AS periods, avg(ret) AS mean, avg(ret) / stddev_samp(ret) * sqrt(12) AS sharpe FROM m GROUP BY 1, 2""")


@query("parameter_grid", "E10", oracle("sweep", "SELECT top, horizon, periods, round(mean, 6) AS mean, round(sharpe, 6) AS sharpe FROM sweep"))
def parameter_grid(spark, sf):
    return rounded(sweep(spark, sf), "mean", "sharpe")


@query("sweep_summary", "E11", oracle("sweep", """
SELECT count(*) AS runs, round(max(sharpe), 6) AS best, round(median(sharpe), 6) AS median, round(stddev_samp(sharpe), 6) AS spread,
 round(stddev_samp(sharpe) * sqrt(2 * ln(count(*))), 6) AS expected_max FROM sweep"""))
def sweep_summary(spark, sf):
    return rounded(evaluate.sweep_summary(sweep(spark, sf)), "best", "median", "spread", "expected_max")
