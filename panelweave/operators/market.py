"""Relational market queries: ranges, resampling, breadth, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .windows import series


# -- breadth ------------------------------------------------------------------

def breadth_flags(bars: DataFrame, price: str, windows: tuple[int, ...] = (20, 60, 120, 250), extreme: int = 250,
                  min_history: int = 250, key: str = "symbol", day: str = "trade_date",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Per bar: above each mean, at the high or low, up or down; windows count existing bars."""
    w = series(key, day)
    rows = lambda n: w.rowsBetween(-(n - 1), 0)
    c = F.col(price)
    previous = F.lag(price).over(w)
    flags = {f"a{n}": (c > F.avg(price).over(rows(n))).cast("int") for n in windows}
    flags |= {"high": (c >= F.max(price).over(rows(extreme))).cast("int"),
              "low": (c <= F.min(price).over(rows(extreme))).cast("int"),
              "up": (c > previous).cast("int"), "down": (c < previous).cast("int")}
    return (bars.filter(c > 0).withColumns({**flags, "_n": F.count("*").over(rows(extreme))})
            .filter(F.col("_n") >= min_history).select(key, day, *keep, *flags))


def breadth(flags: DataFrame, windows: tuple[int, ...] = (20, 60, 120, 250),
            by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    return flags.groupBy(*by).agg(
        F.count("*").alias("stocks"), *[F.avg(f"a{n}").alias(f"above{n}") for n in windows],
        F.sum("high").alias("highs"), F.sum("low").alias("lows"), F.sum("up").alias("ups"),
        F.sum("down").alias("downs"))


def breadth_latest(market: DataFrame, windows: tuple[int, ...], back: int = 5) -> DataFrame:
    """The last session: each share, its change over ``back`` sessions and its place in history."""
    day = Window.orderBy("trade_date")  # one row per session
    changed = market.withColumns({f"above{n}_5d": F.col(f"above{n}") - F.lag(f"above{n}", back).over(day)
                                  for n in windows})
    last = changed.agg(F.max_by(F.struct(*changed.columns), "trade_date").alias("last"))
    ranks = [F.avg((F.col(f"above{n}") <= F.col(f"last.above{n}")).cast("int")).alias(f"above{n}_rank")
             for n in windows]
    latest = changed.withColumn("last", last.scalar())
    return latest.agg(F.first("last").alias("last"), *ranks).select("last.*", *[f"above{n}_rank" for n in windows])


def industry_breadth_change(flags: DataFrame, classes: DataFrame, windows: tuple[int, ...], lookback: int = 20,
                            key: str = "symbol") -> DataFrame:
    """Breadth per industry on the last session and its change over ``lookback`` sessions."""
    days = flags.select("trade_date").distinct().withColumn(
        "_age", F.row_number().over(Window.orderBy(F.desc("trade_date"))))
    picked = days.filter(F.col("_age").isin(1, lookback + 1))
    rows = breadth(flags.join(picked, "trade_date").join(classes, key), windows, ("_age", "industry"))
    now, before = rows.filter("_age = 1").alias("n"), rows.filter(f"_age = {lookback + 1}").alias("b")
    return now.join(before, "industry", "left").select(
        "industry", "n.stocks", "n.highs", "n.lows", *[F.col(f"n.above{n}").alias(f"above{n}") for n in windows],
        *[(F.col(f"n.above{n}") - F.col(f"b.above{n}")).alias(f"above{n}_change") for n in windows])


# -- bars -----------------------------------------------------------------------

def last_bars(bars: DataFrame, symbol: str, start: str, end: str, limit: int) -> DataFrame:
    """The newest ``limit`` bars of a symbol in a date range (a top-k, never a full sort)."""
    return bars.filter((F.col("symbol") == symbol) & F.col("trade_date").between(F.to_date(F.lit(start)),
                                                                                 F.to_date(F.lit(end)))
                       ).orderBy(F.desc("trade_date")).limit(limit)


def resample(bars: DataFrame, period: str, adjusted: str = "hfq_close", key: str = "symbol",
             day: str = "trade_date") -> DataFrame:
    """Weekly or monthly bars with change on the adjusted close and amplitude on the previous close."""
    start = F.to_date(F.date_trunc(period, F.col(day)))
    grouped = bars.groupBy(key, start.alias("period")).agg(
        F.max(day).alias(day), F.min_by("open", day).alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", day).alias("close"), F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"), F.max_by(adjusted, day).alias(adjusted))
    w = series(key, "period")
    return grouped.withColumns({
        "pct": F.try_divide(F.col(adjusted), F.lag(adjusted).over(w)) - 1,
        "amplitude": F.try_divide(F.col("high") - F.col("low"), F.lag("close").over(w))})


def latest_per_key(df: DataFrame, key: list[str], order: list[str], values: list[str] | None = None) -> DataFrame:
    """The last row of each key, by aggregation (partial before the shuffle, no per-key sort)."""
    kept = values or [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def search(df: DataFrame, text: str, code: str, name: str, last_if: Column, limit: int | None = None) -> DataFrame:
    """Codes by prefix or names by substring; rows matching ``last_if`` come last.  All of them, unless ``limit`` asks for the first."""
    found = df.filter(F.col(code).startswith(text) | F.col(name).contains(text))
    ordered = found.withColumn("_last", last_if.cast("int")).orderBy("_last", code)
    return (ordered if limit is None else ordered.limit(limit)).drop("_last")


def day_overview(bars: DataFrame, calendar: DataFrame, day: str, limit: float) -> DataFrame:
    """Advances, declines, limit moves and turnover of one session against the one before."""
    target = F.to_date(F.lit(day))
    previous = calendar.filter(F.col("trade_date") < target).agg(F.max("trade_date")).scalar()
    now = bars.filter(F.col("trade_date") == target).select("symbol", F.col("close"), "amount", "trade_date")
    before = bars.filter(F.col("trade_date") == previous).select("symbol", F.col("close").alias("prev"))
    both = now.join(before, "symbol", "left")
    up = F.floor(F.col("prev") * (1 + limit) + 0.5)
    down = F.floor(F.col("prev") * (1 - limit) + 0.5)
    count = lambda c: F.count_if(c)
    return both.groupBy("trade_date").agg(
        count(F.col("close") > F.col("prev")).alias("advances"),
        count(F.col("close") < F.col("prev")).alias("declines"),
        count(F.col("close") == F.col("prev")).alias("flat"),
        count(F.col("close") >= up).alias("limit_up"), count(F.col("close") <= down).alias("limit_down"),
        F.sum("amount").alias("amount"))


def sector_changes(bars: DataFrame, classes: DataFrame, day: str, key: str = "symbol") -> DataFrame:
    """Mean change per sector on one session, ranked."""
    w = series(key, "trade_date")
    moves = (bars.withColumn("_chg", F.col("close") / F.lag("close").over(w) - 1)
             .filter(F.col("trade_date") == F.to_date(F.lit(day))).join(classes, key))
    means = moves.groupBy("industry").agg(F.avg("_chg").alias("change"), F.count("_chg").alias("stocks"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("change"), "industry")))


#: Days after the listing in which a security has no price band.
YOUNG_DAYS = 10


def daily_moves(ruled: DataFrame, key: str = "symbol") -> DataFrame:
    """Change of each bar against the session before it, carried through a factor step; null without a bar there.

    ``ruled``: key, idx, has_bar, close, close_before, hfq_before, hfq, and the band of the rules (up, down).
    """
    adjacent = F.coalesce(F.lag("has_bar").over(series(key, "idx")), F.lit(False))
    base = F.col("close_before") * F.coalesce(F.try_divide("hfq_before", "hfq"), F.lit(1.0))
    rows = ruled.withColumn("change", F.when(F.col("has_bar") & adjacent & (base > 0), F.col("close") / base - 1))
    return rows.filter("has_bar")


def overview(moves: DataFrame) -> DataFrame:
    """Every session at once: advances, declines, limit moves by the rules in force, turnover."""
    known, banded = F.col("change").isNotNull(), F.datediff("trade_date", "list_date") >= YOUNG_DAYS
    return moves.groupBy("idx").agg(
        F.count_if(F.col("change") > 0).alias("advances"), F.count_if(F.col("change") < 0).alias("declines"), F.count_if(F.col("change") == 0).alias("flat"),
        F.count_if(known & banded & (F.col("close") >= F.col("up"))).alias("limit_up"),
        F.count_if(known & banded & (F.col("close") <= F.col("down"))).alias("limit_down"), F.sum("amount").alias("amount"))


def sectors(moves: DataFrame, classes: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean change of each industry and its place in every session."""
    means = moves.filter("change is not null").join(classes, key).groupBy("idx", "industry").agg(F.avg("change").alias("change"), F.count("*").alias("stocks"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("change"), "industry")))
