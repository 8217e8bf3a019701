"""Event studies and conditional statistics over the session panel.

Outcomes ahead of a session are plain ``lead`` columns of the panel, so an event
study is one equi-join of the events to their (symbol, session) row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.io import written
from .order_stats import expanding_quantiles
from .windows import last_n, lead_n, series, so_far


def outcomes(panel: DataFrame, horizons: tuple[int, ...], key: str = "symbol", order: str = "idx") -> DataFrame:
    """Return from the next open to the close h sessions later, and its excess over the equal-weight market."""
    entry = F.when(F.col("has_bar"), F.col("open") * F.col("hfq"))
    rows = panel.withColumn("_e", lead_n(entry, 1, key, order))
    rows = rows.withColumns({f"ret_{h}": lead_n("adj_last", h, key, order) / F.col("_e") - 1 for h in horizons})
    day = Window.partitionBy(order)
    return rows.withColumns({f"excess_{h}": F.col(f"ret_{h}") - F.avg(f"ret_{h}").over(day) for h in horizons}).drop("_e")


def event_study(events: DataFrame, ahead: DataFrame, horizons: tuple[int, ...], by: list[str], key: str = "symbol",
                order: str = "idx") -> DataFrame:
    """Mean outcome, mean excess and win rate of the events per group."""
    hit = events.join(ahead.select(key, order, *[f"{n}_{h}" for h in horizons for n in ("ret", "excess")]), [key, order])
    aggs = [F.count("*").alias("events")]
    for h in horizons:
        aggs += [F.avg(f"ret_{h}").alias(f"ret_{h}"), F.avg(f"excess_{h}").alias(f"excess_{h}"),
                 F.avg((F.col(f"excess_{h}") > 0).cast("int")).alias(f"win_{h}")]
    return hit.groupBy(*by).agg(*aggs)


def quantile_sort(rows: DataFrame, x: str, y: str, q: int, by: list[str], key: str = "symbol") -> DataFrame:
    """Mean of y by quantile of x within each group's own ordering."""
    w = Window.partitionBy(*by).orderBy(x, key)
    ranked = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", F.ntile(q).over(w))
    return ranked.groupBy("bucket").agg(F.avg(y).alias("mean"), F.count("*").alias("n"), F.corr(x, y).alias("corr"))


def double_sort(rows: DataFrame, a: str, b: str, y: str, q: int, by: list[str], key: str = "symbol") -> DataFrame:
    """Mean of y by quantile of a, then by quantile of b inside it (the second sort keeps the first partitioning)."""
    clean = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    first = clean.withColumn("qa", F.ntile(q).over(Window.partitionBy(*by).orderBy(a, key)))
    second = first.withColumn("qb", F.ntile(q).over(Window.partitionBy(*by, "qa").orderBy(b, key)))
    return second.groupBy("qa", "qb").agg(F.avg(y).alias("mean"), F.count("*").alias("n"))


def regimes(prices: DataFrame, ma: int = 200, look: int = 250, vol: int = 60, history: int = 250, key: str = "series",
            order: str = "idx", price: str = "close") -> DataFrame:
    """Above or below the long mean, up or down over a year, volatility against its expanding median before."""
    w = series(key, order)
    mean = F.when(F.count(price).over(last_n(ma, key, order)) >= ma, F.avg(price).over(last_n(ma, key, order)))
    rows = prices.withColumn("_r", F.log(F.col(price) / F.lag(price).over(w)))
    rows = rows.withColumn("_v", F.when(F.count("_r").over(last_n(vol, key, order)) >= vol, F.stddev_samp("_r").over(last_n(vol, key, order))))
    rows = expanding_quantiles(rows, key, order, "_v", {"_m": 0.5}, history)
    change = F.col(price) / F.lag(price, look).over(w) - 1
    return rows.withColumns({
        "ma_side": F.when(F.col(price) > mean, "above").when(mean.isNotNull(), "below"),
        "year": F.when(change > 0, "up").when(change.isNotNull(), "down"),
        "vol": F.when(F.col("_v") > F.col("_m") * (1 + 1e-12), "high").when(F.col("_v").isNotNull() & F.col("_m").isNotNull(), "low")}).drop("_r", "_v", "_m")


def known_means(samples: DataFrame, by: list[str], order: str, known: str, x: str) -> DataFrame:
    """At each sample, the mean of its group's samples already known then (walk-forward)."""
    marks = samples.select(*by, F.col(known).alias("_t"), F.col(x).alias("_x"), F.lit(0).alias("_k"))
    probes = samples.select(*by, F.col(order).alias("_t"), F.lit(None).cast("double").alias("_x"), F.lit(1).alias("_k"), F.col(order))
    w = Window.partitionBy(*by).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(probes, allowMissingColumns=True)
    return merged.withColumns({"known_mean": F.avg("_x").over(w), "known_n": F.count("_x").over(w)}).filter("_k = 1").select(
        *by, order, "known_mean", "known_n")


def lead_lag(rows: DataFrame, x: str, y: str, lags: tuple[int, ...], order: str, key: str | None = None) -> DataFrame:
    """Correlation of x with y shifted by each lag (positive: x leads)."""
    w = Window.partitionBy(*([key] if key else [])).orderBy(order)
    wide = rows.withColumns({f"_y{i}": F.lead(y, n).over(w) if n >= 0 else F.lag(y, -n).over(w) for i, n in enumerate(lags)})
    cells = [F.struct(F.lit(n).alias("lag"), F.corr(x, f"_y{i}").alias("corr"), F.count(F.when(F.col(x).isNotNull(), F.col(f"_y{i}"))).alias("n"))
             for i, n in enumerate(lags)]
    grouped = wide.groupBy(*([key] if key else [])).agg(F.array(*cells).alias("c"))
    return grouped.select(*([key] if key else []), F.inline("c"))


def entry_rules(panel: DataFrame, events: DataFrame, hold: int, rules: dict[str, tuple[int, float]], key: str = "symbol",
                order: str = "idx") -> DataFrame:
    """Several ways into the same event: buy in batches a step apart, with an optional stop.

    ``rules``: name -> (batches, stop fraction; 0 = none).  The path ahead of an
    event is one bounded row frame of the panel.
    """
    w = series(key, order).rowsBetween(1, hold)
    rows = panel.withColumns({"_path": F.collect_list("adj_last").over(w), "_n": F.count("adj_last").over(w)})
    hit = events.select(key, order).join(rows.select(key, order, "_path", "_n"), [key, order]).filter(F.col("_n") == hold)
    cells = []
    for name, (batches, stop) in rules.items():
        step = max(1, hold // (2 * batches))
        prices = F.array(*[F.col("_path")[i * step] for i in range(batches)])
        cost = F.aggregate(prices, F.lit(0.0), lambda a, x: a + x) / batches
        tail = F.slice("_path", (batches - 1) * step + 1, hold)
        hits = F.filter(tail, lambda x: x <= F.lit(1 - stop) * cost) if stop else F.array().cast("array<double>")
        out = F.when(F.size(hits) > 0, hits[0]).otherwise(F.element_at("_path", -1)) if stop else F.element_at("_path", -1)
        cells.append(F.struct(F.lit(name).alias("rule"), (out / cost - 1).alias("ret"), (F.array_min(tail) / cost - 1).alias("worst")))
    long = hit.select(key, order, F.inline(F.array(*cells)))
    return long.groupBy("rule").agg(F.count("*").alias("events"), F.avg("ret").alias("ret"), F.avg("worst").alias("worst"),
                                    F.avg((F.col("ret") > 0).cast("int")).alias("win"))


ENTRY_RULES = ("at_once", "thirds", "at_once_stop", "thirds_stop", "above_mean")


def entry_paths(panel: DataFrame, events: DataFrame, hold: int = 120, step: int = 20, look: int = 20, mean: int = 60, key: str = "symbol",
                order: str = "idx") -> DataFrame:
    """One unit of capital into each event by five rules: key, order, rule, ret, worst (deepest fall of its value on the way).

    ``panel``: key, order, open, close (adjusted, a row a session).  All at the next open; thirds at opens ``step`` apart; both
    with an exit at the first close under the low of the ``look`` closes before the event; or all at the open after the
    first close above its mean of ``mean``.  An event brings ``hold`` sessions with it and meets the panel on (key, session);
    events without all of them are left out.
    """
    w = series(key, order)
    rows = panel.withColumns({"_mean": F.when(F.count("close").over(last_n(mean, key, order)) >= mean, F.avg("close").over(last_n(mean, key, order))),
                              "_low": F.min("close").over(w.rowsBetween(-look, -1))})
    start = events.select(key, order).distinct().join(rows.select(key, order, "_low"), [key, order])
    ahead = start.select(key, F.col(order).alias("_event"), "_low", F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("_k")).withColumn(order, F.col("_event") + F.col("_k"))
    path = ahead.join(rows.select(key, order, "open", "close", "_mean"), [key, order]).drop(order)
    each = Window.partitionBy(key, "_event")
    upto = each.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("_n", F.count("close").over(each)).filter(F.col("_n") == hold)
    k, c, o = F.col("_k"), F.col("close"), F.col("open")
    third = F.when(k.isin(1, step + 1, 2 * step + 1), F.lit(1.0) / 3)
    path = path.withColumns({
        "at_once": c * F.max(F.when(k == 1, 1 / o)).over(each), "thirds": 1 - F.sum(third).over(upto) + F.sum(third / o).over(upto) * c,
        "_hit": F.min(F.when(c < F.col("_low"), k)).over(each), "_above": F.min(F.when((c > F.col("_mean")) & (k <= hold - 2), k)).over(each)})
    frozen = lambda name: F.when(k < F.coalesce("_hit", F.lit(hold)), F.col(name)).otherwise(
        F.max(F.when(k == F.coalesce("_hit", F.lit(hold)), F.col(name))).over(each))
    entry = F.max(F.when(k == F.col("_above") + 1, o)).over(each)
    path = path.withColumns({"at_once_stop": frozen("at_once"), "thirds_stop": frozen("thirds"),
                             "above_mean": F.when(k > F.col("_above"), c / entry).otherwise(1.0)})
    long = path.select(key, "_event", "_k", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in ENTRY_RULES])))
    peak = F.max(F.greatest(F.col("v"), F.lit(1.0))).over(Window.partitionBy(key, "_event", "rule").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return long.withColumn("_d", F.col("v") / peak - 1).groupBy(key, F.col("_event").alias(order), "rule").agg(
        (F.max_by("v", "_k") - 1).alias("ret"), F.least(F.min("_d"), F.lit(0.0)).alias("worst"))


def entry_summary(paths: DataFrame) -> DataFrame:
    """What each rule brought over all events."""
    return paths.groupBy("rule").agg(
        F.count("*").alias("events"), F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("median"), F.avg((F.col("ret") > 0).cast("int")).alias("win"),
        F.percentile("ret", F.lit(0.1)).alias("low_tenth"), F.min("ret").alias("lowest"), F.percentile("worst", F.lit(0.5)).alias("fall_median"),
        F.percentile("worst", F.lit(0.1)).alias("fall_tenth"))


def rally_bottoms(panel: DataFrame, lookback: int, ahead: int, rise: float, fall: float, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Falls after a rally: whether the low of the day held over the next sessions, and the worst close."""
    high = F.max("adj_last").over(last_n(lookback, key, order))
    low = F.min("adj_last").over(last_n(lookback, key, order))
    future = F.min("adj_last").over(series(key, order).rowsBetween(1, ahead))
    rows = panel.withColumns({"_h": high, "_l": low, "_f": future})
    hit = rows.filter((F.col("_h") / F.col("_l") - 1 >= rise) & (F.col("adj_last") <= F.col("_h") * (1 - fall)) & F.col("_f").isNotNull())
    return hit.select(key, order, (F.col("_f") >= F.col("adj_last")).alias("held"), (F.col("_f") / F.col("adj_last") - 1).alias("worst"))


def minute_features(minutes: DataFrame, by: list[str], order: str, price: str, amount: str, surge: float) -> DataFrame:
    """Tick-rule signed amount and minutes far above the day's median (one row per minute: bounded per day)."""
    w = Window.partitionBy(*by).orderBy(order)
    sign = F.signum(F.col(price) - F.lag(price).over(w))
    rows = minutes.withColumns({"_s": F.last(F.when(sign != 0, sign), True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                "_m": F.percentile(amount, F.lit(0.5)).over(Window.partitionBy(*by))})
    return rows.groupBy(*by).agg(F.sum(F.coalesce("_s", F.lit(0.0)) * F.col(amount)).alias("signed_amount"),
                                 F.count_if(F.col(amount) >= surge * F.col("_m")).alias("surge_minutes"),
                                 F.count("*").alias("minutes"))


def threshold_grid(events: DataFrame, x: str, thresholds: tuple[float, ...], y: str) -> DataFrame:
    """Events at or above each threshold in one pass: a row counts for every threshold it reaches."""
    levels = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(x))
    rows = events.select(F.explode(levels).alias("threshold"), y)
    return rows.groupBy("threshold").agg(F.count(y).alias("events"), F.avg(y).alias("mean"), F.avg((F.col(y) > 0).cast("int")).alias("win"))


def publication_timing(probes: DataFrame, source: list[str], at: str, present: Column, value: str) -> DataFrame:
    """First appearance of each source's data and whether it changed afterwards."""
    seen = probes.withColumns({"_p": present, "_at": F.when(present, F.col(at))})
    g = seen.groupBy(*source).agg(F.min("_at").alias("first_seen"), F.min_by(value, "_at").alias("first_value"),
                                  F.max_by(value, "_at").alias("last_value"), F.count("*").alias("probes"))
    return g.withColumn("changed", ~F.col("first_value").eqNullSafe(F.col("last_value")))


def drawdown_context(panel: DataFrame, lookback: int = 250, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Per session: median drawdown from the high, share of names up, names at a new high."""
    w = last_n(lookback, key, order)
    rows = panel.withColumns({"_dd": F.col("adj_last") / F.max("adj_last").over(w) - 1,
                              "_up": F.col("adj_last") > F.lag("adj_last").over(series(key, order))})
    return rows.groupBy(order).agg(F.percentile("_dd", F.lit(0.5)).alias("median_drawdown"), F.avg(F.col("_up").cast("int")).alias("up_share"),
                                   F.count_if(F.col("_dd") == 0).alias("new_highs"))


def recent_creations(flows: DataFrame, calendar: DataFrame, recent: int = 5, order: str = "idx") -> DataFrame:
    """Per session: creations less redemptions of the last ``recent`` sessions, their share of assets, and groups that had creations."""
    daily = flows.groupBy("trade_date").agg(F.sum("flow").alias("flow"), F.sum("aum").alias("aum"), F.count_if(F.col("flow") > 0).alias("groups"))
    rows = calendar.join(daily, "trade_date", "left")
    w = Window.orderBy(order).rowsBetween(-(recent - 1), 0)  # one row a session
    return rows.select(order, F.sum("flow").over(w).alias("recent_flow"), F.try_divide(F.sum("flow").over(w), F.last("aum", True).over(
        Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).alias("recent_share"), F.coalesce(F.sum("groups").over(w), F.lit(0)).alias("group_days"))


def cap_weighted(rows: DataFrame, by: list[str], cap: str, values: list[str], key: str = "symbol") -> DataFrame:
    """Cap-weighted means of some measures, with the largest weight and the effective number of names."""
    known = rows.filter(F.col(cap) > 0).withColumn(cap, F.col(cap).cast("double"))
    total = F.sum(cap)
    means = [(F.sum(F.when(F.col(v).isNotNull(), F.col(cap) * F.col(v))) / F.sum(F.when(F.col(v).isNotNull(), F.col(cap)))).alias(v) for v in values]
    return known.groupBy(*by).agg(F.count("*").alias("names"), (F.max(cap) / total).alias("largest"),
                                  (total * total / F.sum(F.col(cap) * F.col(cap))).alias("effective_names"), *means)


#: Months a regime (or the whole past) must have before it decides, and the months of the trailing rule.
STATE_MONTHS, TRAILING = 12, 12


def select_families(families: DataFrame, regimes_: DataFrame, keys: tuple[str, ...], least: int = STATE_MONTHS, trailing: int = TRAILING) -> DataFrame:
    """What rules that choose families by their past would have earned, period by period.

    ``families``: k (period number, without gaps), family, value; ``regimes_``: k and one label column per regime key.  At
    period k the results up to k - 2 are known.  A rule takes the families whose mean over its past is positive, all that
    are there where none is or the past is shorter than ``least``: of the periods in today's state (of all, where those are
    fewer than ``least``), the last ``trailing``, or all.  Rule ``all`` always takes all.  One running sum per family and
    one per (family, state) give every mean; no period meets another.
    """
    periods = families.select("k").distinct().join(regimes_, "k", "left")
    rows = families.join(regimes_, "k", "left")
    of_family = Window.partitionBy("family").orderBy("k")
    past, recent = of_family.rangeBetween(Window.unboundedPreceding, -2), of_family.rangeBetween(-trailing - 1, -2)
    rows = rows.withColumns({"_all": F.avg("value").over(past), "_recent": F.avg("value").over(recent)})
    first = families.agg(F.min("k")).scalar()
    rows = rows.withColumn("_known", F.greatest(F.col("k") - 1 - first, F.lit(0)))
    bases = {"all": None, "expanding": F.col("_all"), "trailing": F.col("_recent")}
    for key in keys:
        state = Window.partitionBy("family", key).orderBy("k").rangeBetween(Window.unboundedPreceding, -2)
        months = Window.partitionBy(key).orderBy("k").rangeBetween(Window.unboundedPreceding, -2)
        seen = periods.withColumn("_seen", F.when(F.col(key).isNotNull(), F.count("*").over(months)).otherwise(0)).select("k", F.col("_seen").alias(f"_n_{key}"))
        rows = rows.withColumn(f"_in_{key}", F.avg("value").over(state)).join(seen, "k")
        bases[f"by_{key}"] = F.when(F.coalesce(F.col(f"_n_{key}"), F.lit(0)) >= least, F.col(f"_in_{key}")).otherwise(F.col("_all"))
    good = [F.struct(F.lit(name).alias("rule"), (F.lit(False) if base is None else F.coalesce((F.col("_known") >= least) & (base > 0), F.lit(False))).alias("good"))
            for name, base in bases.items()]
    long = rows.filter("value is not null").select("k", "value", F.inline(F.array(*good)))
    chosen = long.groupBy("k", "rule").agg(F.avg("value").alias("_any"), F.avg(F.when(F.col("good"), F.col("value"))).alias("_good"), F.count_if("good").alias("chosen"))
    return chosen.select("k", "rule", F.coalesce("_good", "_any").alias("value"), "chosen")


# -- classifiers ---------------------------------------------------------------------------------

def _solve(n: int, keys: list[str]):
    """Newton steps of small systems, one row each: gradient and the upper triangle of the Hessian."""
    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            grad = np.stack(pdf["grad"].to_numpy()) if len(pdf) else np.zeros((0, n))
            flat = np.stack(pdf["hess"].to_numpy()) if len(pdf) else np.zeros((0, n * (n + 1) // 2))
            full = np.zeros((len(pdf), n, n))
            full[:, *np.triu_indices(n)] = flat
            full = full + np.transpose(np.triu(full, 1), (0, 2, 1))
            step = np.linalg.solve(full, grad[..., None])[..., 0] if len(pdf) else grad
            out["w"] = list(np.stack(pdf["w"].to_numpy()) - step) if len(pdf) else []
            yield out

    return run


def expanding_logistic(samples: DataFrame, x: list[str], label: str, order: str, known: str, least: int = 60, penalty: float = 1.0,
                       rounds: int = 8) -> DataFrame:
    """``samples`` with the probability that a logistic model of everything known before gives to label 1.

    For every period of ``order`` a model is fitted to the samples whose outcome was ``known`` before it, with inputs
    standardised by their mean and deviation there, by reweighted least squares with a penalty on all but the constant.
    All periods are fitted at once: a round is one join of the samples with the weights of the periods they are known in
    and one aggregation by period of gradient and Hessian, summed before the shuffle; the small systems that remain, one
    row a period, are solved in tasks.  Periods with fewer than ``least`` known samples or one class have no model.
    """
    n = len(x) + 1
    data = written(samples.dropna(subset=[*x, order]), "samples")
    periods = data.select(F.col(order).alias("_at")).distinct()
    trained = data.filter(F.col(label).isNotNull() & F.col(known).isNotNull())
    inputs = F.array(*[F.col(c).cast("double") for c in x])
    # a sample meets the periods after it became known: the fits overlap, so the work is samples times periods
    last = periods.agg(F.max("_at")).scalar()
    firsts = trained.select(F.col(known).cast("long").alias("_known"), inputs.alias("_x"), F.col(label).cast("double").alias("_y"))
    pairs = firsts.select("_x", "_y", F.explode(F.when(F.col("_known") <= last, F.sequence(F.col("_known"), last.cast("long")))).alias("_at"))
    pairs = pairs.join(periods, "_at")
    moments = pairs.groupBy("_at").agg(F.count("*").alias("_n"), F.sum("_y").alias("_ones"), F.array(*[F.avg(F.col("_x")[i]) for i in range(n - 1)]).alias("_mean"),
                                       F.array(*[F.stddev_samp(F.col("_x")[i]) for i in range(n - 1)]).alias("_dev"))
    fits = moments.filter((F.col("_n") >= least) & (F.col("_ones") > 0) & (F.col("_ones") < F.col("_n")))
    fits = written(fits.select("_at", "_mean", "_dev"), "moments")
    scaled = lambda at: F.zip_with(F.zip_with(at, "_mean", lambda a, m: a - m), "_dev", lambda a, d: F.when(d > 0, a / d).otherwise(0.0))
    pairs = written(pairs.join(fits, "_at").select("_at", "_y", F.concat(F.array(F.lit(1.0)), scaled(F.col("_x"))).alias("_z")), "pairs")
    weights = fits.select("_at", F.array_repeat(F.lit(0.0), n).alias("w"))
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    ridge = [penalty if i else 0.0 for i in range(n)]
    for _ in range(rounds):
        dot = F.aggregate(F.zip_with("_z", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        met = pairs.join(weights, "_at").withColumn("_p", 1 / (1 + F.exp(-dot)))
        z = lambda i: F.col("_z")[i]
        v = F.col("_p") * (1 - F.col("_p"))
        grad = F.array(*[F.sum(z(i) * (F.col("_p") - F.col("_y"))) + ridge[i] * F.first(F.col("w")[i]) for i in range(n)])
        hess = F.array(*[F.sum(z(i) * z(j) * v) + (ridge[i] if i == j else 0.0) for i, j in cells])
        sums = met.groupBy("_at").agg(grad.alias("grad"), hess.alias("hess"), F.first("w").alias("w"))
        weights = written(sums.mapInPandas(_solve(n, ["_at"]), "_at long, w array<double>"), "weights")
    scored = data.join(fits.join(weights, "_at"), data[order] == F.col("_at"))
    own = F.concat(F.array(F.lit(1.0)), scaled(inputs))
    p = 1 / (1 + F.exp(-F.aggregate(F.zip_with(own, "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    return scored.select(*samples.columns, p.alias("probability"))
