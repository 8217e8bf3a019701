"""Ordered state machines and shape detection along one series.

Everything that can be said with windows is; only the part of a rule that
depends on its own last decision runs in Python, one series per group.  A daily
series is bounded by the calendar.  Event logs are not: those go through
:func:`ordered_fold`, which streams sorted rows and keeps only the state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import islands, last_n, series, so_far

# Stage codes.
UNKNOWN, BASE, ADVANCE, TOP, DECLINE = range(5)
STAGES = ("unknown", "base", "advance", "top", "decline")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str,
                 step: Callable[[dict, dict], tuple[dict, dict]], columns: list[str]) -> DataFrame:
    """Fold each key's rows in order; rows stream through the task in Arrow batches.

    ``step(state, row) -> (state, output)`` sees one row at a time.  Nothing but
    the current key's state is held, so a key with very many rows needs no more
    memory than one with few.
    """
    ordered = df.select(*keys, *[c for c in columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        current, state = None, {}
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, {}
                state, shown = step(state, row)
                out.append(shown)
            yield pd.DataFrame(out)

    return ordered.mapInPandas(run, schema)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], object],
                 advance: Callable[..., tuple], columns: list[str], found: list[str]) -> DataFrame:
    """:func:`ordered_fold` for logs that grow with the tables: a row costs one call, and no column but those it needs is unpacked.

    ``advance(state, *columns) -> found`` changes a key's state, made by ``start``, in place.  The other columns of
    ``schema`` are handed on as they came.  Days come as numbers or None; whole numbers of a batch that holds nulls as floats, the nulls NaN.
    """
    shown = [part.split()[0] for part in schema.split(", ")]
    types = dict(part.split() for part in schema.split(", "))
    needed = dict.fromkeys([*keys, *columns, *[c for c in shown if c not in found]])
    taken = [F.col(c).cast(types.get(c, df.schema[c].dataType)).alias(c) for c in needed]
    ordered = (df.select(*taken, *[c for c in order if c not in needed]).repartition(*keys).sortWithinPartitions(*keys, *order)
               .select(*needed))

    def run(batches):
        current, state = None, None
        for batch in batches:
            place = list(zip(*[_plain(batch.column(k)) for k in keys], strict=True))
            out = []
            for key, row in zip(place, zip(*[_plain(batch.column(c)) for c in columns], strict=True), strict=True):
                if key != current:
                    current, state = key, start()
                out.append(advance(state, *row))
            new = dict(zip(found, zip(*out, strict=True), strict=True)) if out else {c: () for c in found}
            arrays = [_packed(new[c], types[c]) if c in new else batch.column(c) for c in shown]
            yield pa.RecordBatch.from_arrays(arrays, names=shown)

    return ordered.mapInArrow(run, schema)


def _plain(column: pa.Array) -> list:
    """Python values of an Arrow column."""
    if pa.types.is_date(column.type):
        column = column.cast(pa.int32())
        if column.null_count:  # a null day equals another one, a NaN would not
            return column.to_pylist()
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _packed(values: tuple, kind: str) -> pa.Array:
    if kind == "string":
        return pa.array(values, pa.string())
    try:
        return pa.array(values, pa.int64())
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # floats, of rows with nulls
        return pa.Array.from_pandas(pd.Series(values, dtype="float64"), type=pa.int64())


# -- stages ------------------------------------------------------------------------------

def stages(prices: DataFrame, ma: int = 200, slope: int = 20, flat: float = 0.03, band: float = 0.03, confirm: int = 10,
           context: int = 250, rise: float = 0.5, key: str = "symbol", order: str = "idx", price: str = "adj_last") -> DataFrame:
    """Four market stages with a confirmation period.

    What each state would move to on a session is computed for all sessions by
    column expressions; the walk only follows that table and counts how long a
    change has been pending.
    """
    w = series(key, order)
    mean = F.when(F.count(price).over(last_n(ma, key, order)) >= ma, F.avg(price).over(last_n(ma, key, order)))
    low = F.when(F.count(price).over(last_n(context, key, order)) >= min(20, context), F.min(price).over(last_n(context, key, order)))
    rows = prices.withColumns({"ma": mean, "_low": low})
    rows = rows.withColumn("slope", F.col("ma") / F.lag("ma", slope).over(w) - 1)
    p, m, s = F.col(price), F.col("ma"), F.col("slope")
    up, down = s > flat, s < -flat
    level = ~up & ~down
    far_below, far_above = p < m * (1 - band), p > m * (1 + band)
    risen = F.coalesce(p / F.col("_low") - 1 > rise, F.lit(False))

    def moves(state: int) -> Column:
        was_up, was_down = state in (ADVANCE, TOP), state in (DECLINE, BASE)
        out = F.when(level, TOP if was_up else BASE) if state else F.when(level & risen, TOP).when(level, BASE)
        out = out.when(up & ~far_below, ADVANCE).when(down & ~far_above, DECLINE)
        if was_up:
            out = out.when(up & far_below, TOP)
        if was_down:
            out = out.when(down & far_above, BASE)
        return F.when(s.isNull() | p.isNull() | m.isNull(), -1).otherwise(out.otherwise(state))

    table = rows.select(key, order, price, "ma", "slope", F.array(*[moves(k) for k in range(5)]).alias("_to"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        out = np.zeros(len(group), dtype="int32")
        state, waiting, days = UNKNOWN, UNKNOWN, 0
        for i, to in enumerate(np.stack(group["_to"].to_numpy())):
            goal = state if to[state] < 0 else to[state]
            waiting, days = goal, days + 1 if goal == waiting else 1
            if to[state] >= 0 and goal != state and (days >= confirm or state == UNKNOWN):
                state = goal
            out[i] = state
        return group.drop(columns="_to").assign(stage=out)

    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields if f.name != "_to"}
    return table.groupBy(key).applyInPandas(walk, ", ".join(f"{n} {t}" for n, t in fields.items()) + ", stage int")


def volume_surge(bars: DataFrame, dry: int = 10, compare: int = 20, ratio: float = 0.7, multiple: float = 2.0,
                 key: str = "symbol", order: str = "idx") -> Column:
    """An up day with heavy volume after volume had dried up (the day itself does not raise the bar)."""
    w = series(key, order)
    recent_w, before_w = w.rowsBetween(-dry, -1), w.rowsBetween(-dry - compare, -dry - 1)
    recent = F.when(F.count("volume").over(recent_w) >= max(2, dry - 2), F.avg("volume").over(recent_w))
    before = F.when(F.count("volume").over(before_w) >= max(2, compare - 5), F.avg("volume").over(before_w))
    return F.coalesce((recent / before < ratio) & (F.col("volume") >= multiple * recent) & (F.col("close") > F.col("open")), F.lit(False))


def latest_stage(staged: DataFrame, key: str = "symbol", order: str = "idx", price: str = "adj_last") -> DataFrame:
    """The stage of the last session: since when, how long, slope, gap to the mean, the stage before."""
    runs = islands(staged, [key], order, "stage")
    spans = runs.groupBy(key, "run", "stage").agg(F.min(order).alias("since"), F.max(order).alias("_end"), F.count("*").alias("days"),
                                                  F.max_by(F.struct("ma", "slope", F.col(price).alias("p")), order).alias("l"))
    w = series(key, "run")
    spans = spans.withColumns({"previous": F.lag("stage").over(w), "_last": F.max("run").over(Window.partitionBy(key))})
    return spans.filter("run = _last").select(key, "stage", "previous", "since", "days", "l.ma", "l.slope",
                                              (F.col("l.p") / F.col("l.ma") - 1).alias("gap"))


def stage_statistics(staged: DataFrame, horizons: tuple[int, ...] = (20, 60, 120), key: str = "symbol", order: str = "idx",
                     price: str = "adj_last") -> DataFrame:
    """Per stage change (previous, new): count and mean forward excess over the market's mean."""
    w = series(key, order)
    rows = staged.withColumn("previous", F.coalesce(F.lag("stage").over(w), F.lit(UNKNOWN)))
    rows = rows.withColumns({f"_f{h}": F.lead(price, h).over(w) / F.col(price) - 1 for h in horizons})
    day = Window.partitionBy(order)
    rows = rows.withColumns({f"_x{h}": F.col(f"_f{h}") - F.avg(f"_f{h}").over(day) for h in horizons})
    return rows.filter("stage > 0").groupBy("previous", "stage").agg(
        F.count("*").alias("count"), *[F.avg(f"_x{h}").alias(f"excess_{h}") for h in horizons],
        F.avg((F.col(f"_x{horizons[0]}") > 0).cast("int")).alias("beat"))


# -- structures ---------------------------------------------------------------------------

PHASES = ("pending", "active", "realized", "exhausted")


def structure_phases(prices: DataFrame, realized: float = 1.0, exhausted: float = 0.15, key: str = "symbol", order: str = "idx",
                     price: str = "close") -> DataFrame:
    """Phase and completion of a price structure by session, by windows alone.

    ``prices`` carries neckline and target.  Active from the first close above the
    neckline; realized once the peak since then completes the target; exhausted
    at the first close far enough below the peak afterwards.
    """
    w = so_far(key, order)
    rows = prices.withColumn("_on", F.min(F.when(F.col(price) > F.col("neckline"), F.col(order))).over(w))
    rows = rows.withColumn("peak", F.max(F.when(F.col(order) >= F.col("_on"), F.col(price))).over(w))
    done = lambda x: (x - F.col("neckline")) / (F.col("target") - F.col("neckline"))
    # The activating close itself does not realize the structure.
    rows = rows.withColumn("_re", F.min(F.when((done(F.col("peak")) >= realized) & (F.col(order) > F.col("_on")), F.col(order))).over(w))
    drop = (F.col(order) > F.col("_re")) & (F.col(price) <= F.col("peak") * (1 - exhausted))
    rows = rows.withColumn("_ex", F.min(F.when(drop, F.col(order))).over(w))
    phase = F.when(F.col("_ex").isNotNull(), "exhausted").when(F.col("_re").isNotNull(), "realized").when(
        F.col("_on").isNotNull(), "active").otherwise("pending")
    return rows.withColumns({"phase": phase, "completion": done(F.col(price))}).drop("_on", "_re", "_ex")


def once_per_period(df: DataFrame, key: str, order: str, inside: str, hit: str) -> DataFrame:
    """The first hit of each unbroken period in which ``inside`` holds."""
    runs = islands(df, [key], order, inside, "_period")
    return runs.filter(F.col(inside) & F.col(hit)).groupBy(key, "_period").agg(F.min(order).alias(order)).drop("_period")


def first_crossing(df: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    return df.filter(hit).groupBy(key).agg(F.min(order).alias(order))


def suggest_path(close: Column, peak: Column, neckline: Column) -> Column:
    """After a round: C near the peak, A after a shallow pullback, B after a deep one."""
    height = peak - neckline
    pullback = F.when(height > 0, (peak - close) / height).otherwise(1.0)
    return F.when(close >= peak * 0.95, "C").when(pullback <= 0.5, "A").otherwise("B")


# -- ranges, turns, recursions -----------------------------------------------------------------

def average_true_range(bars: DataFrame, window: int = 14, key: str = "symbol", order: str = "trade_date") -> Column:
    w = series(key, order)
    before = F.coalesce(F.lag("close").over(w), F.col("close"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return true_range


def with_atr(bars: DataFrame, window: int = 14, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Simple mean of the true range, over what exists at the start."""
    ranged = bars.withColumn("_tr", average_true_range(bars, window, key, order))
    return ranged.withColumn("atr", F.greatest(F.avg("_tr").over(last_n(window, key, order)), F.lit(1e-9))).drop("_tr")


def retests(staged: DataFrame, rebound: float = 0.05, key: str = "symbol", order: str = "idx", price: str = "adj_last") -> DataFrame:
    """Sessions of a base that come back near its low after a rebound from it, without closing below.

    Inside each run of the base stage the lowest close so far is a running minimum; the closes since then are the islands
    between new lows, so the rebound is a running maximum inside an island.  Both are read as of the session before.
    """
    run = islands(staged.filter(F.col(price).isNotNull()), [key], order, "stage", "_run").filter(F.col("stage") == BASE)
    w = Window.partitionBy(key, "_run").orderBy(order)
    low_before = F.min(price).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = run.withColumns({"_low": F.min(price).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_new": F.coalesce(F.col(price) < low_before, F.lit(True)),
                            "_place": F.row_number().over(w)})
    rows = rows.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(key, "_run", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_high", F.max(F.when(~F.col("_new"), F.col(price))).over(since))
    low, high = F.lag("_low").over(w), F.lag("_high").over(w)
    holds = (F.col("_place") >= 5) & (high >= low * (1 + rebound)) & (F.col(price) >= low) & (F.col(price) <= low * (1 + rebound / 2))
    return rows.withColumns({"base_low": low, "_holds": F.coalesce(holds, F.lit(False))}).filter("_holds").select(key, order, price, "base_low")


def stage_years(staged: DataFrame, gate: DataFrame, horizons: tuple[int, ...] = (20, 60, 120), key: str = "symbol", order: str = "idx", price: str = "adj_last") -> DataFrame:
    """Per year, stage and state of the index (``gate``: order, year, open): sessions, share of the year's, forward excess over the average."""
    w, day = series(key, order), Window.partitionBy(order)
    rows = staged.withColumns({f"_f{h}": F.lead(price, h).over(w) / F.col(price) - 1 for h in horizons})
    rows = rows.withColumns({f"_x{h}": F.col(f"_f{h}") - F.avg(f"_f{h}").over(day) for h in horizons}).join(gate, order)
    sums = rows.groupBy("year", "open", "stage").agg(F.count("*").alias("sessions"), *[F.avg(f"_x{h}").alias(f"excess_{h}") for h in horizons])
    return sums.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy("year")))


def swing_points(high: np.ndarray, low: np.ndarray, reach: np.ndarray) -> list[tuple[int, float, str, bool]]:
    """Alternating swing highs and lows (position, price, kind, confirmed).

    A swing ends when price comes back from its extreme by the reach of that bar;
    of equal extremes the first counts, and the last swing is provisional.
    """
    points: list[tuple[int, float, str, bool]] = []
    if len(high) < 3:
        return points
    sides = {"H": (high, 1.0), "L": (-low, -1.0)}
    best = {"H": 0, "L": 0}
    seeking = None
    for i in range(1, len(high)):
        if seeking is None:
            for kind, (x, _) in sides.items():
                if x[i] > x[best[kind]]:
                    best[kind] = i
            if high[best["H"]] - low[best["L"]] >= reach[i]:
                first = "L" if best["H"] > best["L"] else "H"
                x, sign = sides[first]
                points.append((best[first], float(sign * x[best[first]]), first, True))
                seeking = "H" if first == "L" else "L"
            continue
        x, sign = sides[seeking]
        other = "L" if seeking == "H" else "H"
        y = sides[other][0]
        if x[i] > x[best[seeking]]:
            best[seeking] = i
        elif x[best[seeking]] + y[i] >= reach[i]:
            at = best[seeking]
            points.append((at, float(sign * x[at]), seeking, True))
            best[other] = at + 1 + int(np.argmax(y[at + 1:i + 1]))
            seeking = other
    if seeking is not None:
        x, sign = sides[seeking]
        points.append((best[seeking], float(sign * x[best[seeking]]), seeking, False))
    return points


def zigzag(bars: DataFrame, multiple: float = 3.0, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Swing points of every series."""
    rows = with_atr(bars, key=key, order=order).select(key, order, F.col("high").cast("double"), F.col("low").cast("double"), "atr")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        found = swing_points(group["high"].to_numpy(), group["low"].to_numpy(), multiple * group["atr"].to_numpy())
        return pd.DataFrame([(group[key].iloc[0], group[order].iloc[i], i, price, kind, sure) for i, price, kind, sure in found],
                            columns=[key, order, "pos", "price", "kind", "confirmed"])

    return rows.groupBy(key).applyInPandas(scan, f"{key} string, {order} date, pos int, price double, kind string, confirmed boolean")


# Retracement ratios.
FIB_RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def fibonacci(pivots: DataFrame, key: str = "symbol") -> DataFrame:
    """Retracement levels of the latest swing (the last two swing points)."""
    last = pivots.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "price")), asc=False), 1, 2).alias("p")).filter(
        F.size("p") == 2)
    legs = last.select(key, F.col("p")[1]["price"].alias("from_price"), F.col("p")[0]["price"].alias("to_price"),
                       F.explode(F.array(*[F.lit(r) for r in FIB_RATIOS])).alias("ratio"))
    return legs.withColumn("level", F.col("to_price") - (F.col("to_price") - F.col("from_price")) * F.col("ratio"))


def price_zones(pivots: DataFrame, bars: DataFrame, per_side: int = 3, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """Support and resistance zones: clusters of confirmed swing points, scored by touches and recency.

    A cluster spans at most twice the tolerance from its lowest point, which
    depends on where the cluster before ended, so clustering walks the sorted
    prices; everything else is aggregation.
    """
    ranged = with_atr(bars, key=key, order=order)
    last = ranged.groupBy(key).agg(F.max_by(F.struct("close", "atr"), order).alias("l"), F.count("*").alias("n"),
                                   F.max("high").alias("top"), F.min("low").alias("bottom"))
    last = last.withColumn("tol", F.greatest(0.8 * F.col("l.atr"), 0.005 * F.col("l.close")))
    points = pivots.filter("confirmed").join(last.select(key, "n", "tol", F.col("l.close").cast("double").alias("last_close")), key)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("price", kind="stable", ignore_index=True)
        ids, start, span = [], None, 2 * group["tol"].iloc[0]
        current = -1
        for price in group["price"]:
            if start is None or price - start > span:
                start, current = price, current + 1
            ids.append(current)
        return group.assign(cluster=ids)

    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    marked = points.groupBy(key).applyInPandas(cluster, ", ".join(f"{n} {t}" for n, t in fields.items()) + ", cluster int")
    age = F.exp(-(F.col("n") - 1 - F.col("pos")) / F.greatest(F.col("n") / 3, F.lit(1.0)))
    zones = marked.groupBy(key, "cluster", "tol", "last_close").agg(
        F.count("*").alias("touches"), F.avg("price").alias("price"), F.min("price").alias("lo"), F.max("price").alias("hi"),
        F.sum(0.5 + 0.5 * age).alias("weight"), (F.countDistinct("kind") == 2).alias("flipped")).filter("touches >= 2")
    pad = F.greatest(F.lit(0.0), (F.col("tol") * 0.5 - (F.col("hi") - F.col("lo"))) / 2)
    zones = zones.select(key, F.when(F.col("price") > F.col("last_close"), "resistance").otherwise("support").alias("side"),
                         (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"), "price", "touches",
                         F.round(F.col("weight") + F.when(F.col("flipped"), 0.5).otherwise(0.0), 3).alias("score"), "flipped", "tol")
    edges = last.select(key, "tol", F.inline(F.array(
        F.struct(F.lit("resistance").alias("side"), F.col("top").cast("double").alias("price")),
        F.struct(F.lit("support").alias("side"), F.col("bottom").cast("double").alias("price")))))
    z = zones.select(key, F.col("low").alias("_l"), F.col("high").alias("_h"))
    free = edges.join(z, (edges[key] == z[key]) & (F.col("price") >= F.col("_l") - F.col("tol")) & (F.col("price") <= F.col("_h") + F.col("tol")),
                      "left_anti")
    extra = free.select(key, "side", (F.col("price") - F.col("tol") * 0.25).alias("low"), (F.col("price") + F.col("tol") * 0.25).alias("high"),
                        "price", F.lit(1).cast("long").alias("touches"), F.lit(0.9).alias("score"), F.lit(False).alias("flipped"), "tol")
    place = F.row_number().over(Window.partitionBy(key, "side").orderBy(F.desc("score"), "price"))
    return zones.unionByName(extra).withColumn("_p", place).filter(F.col("_p") <= per_side).drop("_p", "tol")


def bull_bear_turns(prices: DataFrame, threshold: float = 0.2, key: str = "symbol", order: str = "idx", price: str = "adj_last") -> DataFrame:
    """Alternating peaks and troughs at least ``threshold`` apart, with the session that confirmed each."""
    rows = prices.filter(F.col(price).isNotNull()).select(key, F.col(order).cast("long").alias(order), F.col(price).cast("double").alias(price))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        at, x = group[order].to_numpy(), group[price].to_numpy()
        high = low = 0
        mood, out = None, []
        for i in range(1, len(x)):
            high, low = (i if x[i] > x[high] else high), (i if x[i] < x[low] else low)
            if mood != "bear" and x[i] <= x[high] * (1 - threshold):
                out.append((at[high], x[high], "peak", at[i]))
                mood, low = "bear", i
            elif mood != "bull" and x[i] >= x[low] * (1 + threshold):
                out.append((at[low], x[low], "trough", at[i]))
                mood, high = "bull", i
        return pd.DataFrame([(group[key].iloc[0], *o) for o in out], columns=[key, "turn", "price", "kind", "confirmed_at"])

    return rows.groupBy(key).applyInPandas(walk, f"{key} string, turn long, price double, kind string, confirmed_at long")


def average_cost(rows: DataFrame, key: str = "symbol", order: str = "idx", price: str = "close", rate: str = "rate",
                 ceiling: float = 0.5) -> DataFrame:
    """Average holding cost and its dispersion: each session the traded share of holders moves to the price.

    A fold over the series, inside the JVM.
    """
    seq = rows.filter(F.col(price).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(price).cast("double").alias("p"), F.least(F.greatest(F.col(rate), F.lit(0.0)), F.lit(ceiling)).alias("v")))).alias("s"))
    start = F.struct(F.col("s")[0]["p"].alias("m"), (F.col("s")[0]["p"] * F.col("s")[0]["p"]).alias("q"))

    def move(acc: Column, x: Column) -> Column:
        v, p = x["v"], x["p"]
        known = v.isNotNull()
        return F.struct(F.when(known, (1 - v) * acc["m"] + v * p).otherwise(acc["m"]).alias("m"),
                        F.when(known, (1 - v) * acc["q"] + v * p * p).otherwise(acc["q"]).alias("q"))

    cost = F.aggregate("s", start, move)
    return seq.select(key, cost.alias("c")).select(
        key, F.col("c.m").alias("cost"), (F.sqrt(F.greatest(F.col("c.q") - F.col("c.m") * F.col("c.m"), F.lit(0.0))) / F.col("c.m")).alias("dispersion"))


def cooldown(hits: DataFrame, gap: int, key: str = "symbol", order: str = "idx") -> DataFrame:
    """Hits more than ``gap`` after the last one *kept* (a fold, unlike a gap to the last hit)."""
    seq = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.col(order).cast("long"))).alias("s"))
    none = F.array().cast("array<bigint>")
    kept = F.aggregate("s", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > gap), F.concat(acc, F.array(x))).otherwise(acc))
    return seq.select(key, F.explode(kept).alias(order))


# -- candles ----------------------------------------------------------------------------------------

def candles(bars: DataFrame, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """One-, two- and three-bar candlestick patterns in their trend context; the longest wins."""
    w = series(key, order)
    past = w.rowsBetween(-10, -1)
    rows = bars.withColumns({"body": F.abs(F.col("close") - F.col("open")), "rng": F.col("high") - F.col("low"), "n": F.row_number().over(w),
                             "upper": F.col("high") - F.greatest("open", "close"), "lower": F.least("open", "close") - F.col("low")})
    rows = rows.withColumns({"ab": F.coalesce(F.avg("body").over(past), "body"), "ar": F.coalesce(F.avg("rng").over(past), "rng")})
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    names = ("open", "close", "body", "rng", "upper", "lower", "ab", "ar", "n")
    wide = {f"{c}{k}": back(c, k) for c in names for k in (1, 2)}
    move = {f"move{k}": F.lag("close", 6 + k).over(w) - F.lag("close", 1 + k).over(w) for k in (0, 2)}
    rows = rows.withColumns({**wide, **move})
    o, c, body, rng, up, lo, ab, ar = ({k: F.col(f"{x}{k or ''}") for k in (0, 1, 2)} for x in ("open", "close", "body", "rng", "upper", "lower", "ab", "ar"))
    falling = {k: F.coalesce(F.col(f"move{k}") >= ar[k], F.lit(False)) for k in (0, 2)}
    rising = {k: F.coalesce(-F.col(f"move{k}") >= ar[k], F.lit(False)) for k in (0, 2)}
    bull, bear = {k: c[k] > o[k] for k in o}, {k: c[k] < o[k] for k in o}
    long_ = {k: (body[k] >= F.greatest(ab[k], 0.5 * rng[k])) & (rng[k] > 0) for k in o}
    top, bottom = {k: F.greatest(o[k], c[k]) for k in o}, {k: F.least(o[k], c[k]) for k in o}
    three = (F.col("n") >= 3) & (rng[1] > 0) & (rng[2] > 0)
    middle = (o[2] + c[2]) / 2
    every = lambda f: f(0) & f(1) & f(2)
    soldiers = every(lambda k: bull[k] & (body[k] >= 0.6 * ab[k]) & (up[k] <= 0.3 * body[k]))
    crows = every(lambda k: bear[k] & (body[k] >= 0.6 * ab[k]) & (lo[k] <= 0.3 * body[k]))
    pair = rng[1] > 0
    engulf = (body[0] > body[1]) & (body[0] >= ab[0]) & (body[1] >= 0.3 * ab[0])
    single = rng[0] >= 0.8 * ar[0]
    small_top, small_bottom = up[0] <= 0.1 * rng[0], lo[0] <= 0.1 * rng[0]
    mid1 = (o[1] + c[1]) / 2
    doji = (body[0] <= 0.05 * rng[0]) & (rng[0] >= ar[0]) & (falling[0] | rising[0])
    long_low = (lo[0] >= 2 * body[0]) & small_top & (body[0] > 0)
    long_up = (up[0] >= 2 * body[0]) & small_bottom & (body[0] > 0) & ~long_low
    rules = [
        ("morning_star", three & falling[2] & bear[2] & long_[2] & (body[1] <= 0.3 * body[2]) & (top[1] <= c[2] + 0.1 * body[2]) & bull[0] & (c[0] >= middle)),
        ("evening_star", three & rising[2] & bull[2] & long_[2] & (body[1] <= 0.3 * body[2]) & (bottom[1] >= c[2] - 0.1 * body[2]) & bear[0] & (c[0] <= middle)),
        ("three_white_soldiers", three & falling[2] & soldiers & (c[2] < c[1]) & (c[1] < c[0]) & (o[2] < o[1]) & (o[1] <= c[2]) & (o[1] < o[0]) & (o[0] <= c[1])),
        ("three_black_crows", three & rising[2] & crows & (c[2] > c[1]) & (c[1] > c[0]) & (o[2] > o[1]) & (o[1] >= c[2]) & (o[1] > o[0]) & (o[0] >= c[1])),
        ("bullish_engulfing", pair & falling[0] & engulf & bear[1] & bull[0] & (o[0] <= c[1]) & (c[0] >= o[1])),
        ("bearish_engulfing", pair & rising[0] & engulf & bull[1] & bear[0] & (o[0] >= c[1]) & (c[0] <= o[1])),
        ("piercing", pair & falling[0] & bear[1] & long_[1] & bull[0] & (o[0] < c[1]) & (c[0] >= mid1) & (c[0] < o[1])),
        ("dark_cloud", pair & rising[0] & bull[1] & long_[1] & bear[0] & (o[0] > c[1]) & (c[0] > o[1]) & (c[0] <= mid1)),
        ("doji", single & doji),
        ("hammer", single & ~doji & long_low & falling[0]), ("hanging_man", single & ~doji & long_low & ~falling[0] & rising[0]),
        ("inverted_hammer", single & ~doji & long_up & falling[0]), ("shooting_star", single & ~doji & long_up & ~falling[0] & rising[0]),
    ]
    pattern = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        pattern = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(pattern)
    alive = (F.col("n") >= 2) & (rng[0] > 0) & (ar[0] > 0)
    return rows.withColumn("pattern", F.when(alive, pattern)).filter("pattern is not null").select(key, order, "pattern")
