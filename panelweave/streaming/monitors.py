"""Intraday monitors as column expressions and aggregations shared by batch and stream.

A trade table has: day, ts, seq, symbol, group_id, amount, side (B, S or N).
"""

from __future__ import annotations

from statistics import median

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.asof import asof_join

# Session bounds (a minute is labelled by its end), minutes of a session, recent span.
FIRST, NOON, AFTERNOON, LAST, MINUTES, RECENT = "09:31", "11:30", "13:00", "15:00", 240, 30


def minute_label(ts: Column) -> Column:
    """Session minute of a time: the auction counts to 09:31, the break to 11:30, the close to 15:00."""
    label = F.date_format(ts + F.expr("interval 1 minute"), "HH:mm")
    # The last minute of a day wraps to 00:00.
    late = F.date_format(ts, "HH:mm") >= LAST
    return (F.when(late, LAST).when(label < FIRST, FIRST).when((label > NOON) & (label <= AFTERNOON), NOON).otherwise(F.least(label, F.lit(LAST))))


def minute_number(label: Column) -> Column:
    """1 for 09:31 up to 240 for 15:00."""
    m = F.substring(label, 1, 2).cast("int") * 60 + F.substring(label, 4, 2).cast("int")
    return F.when(m <= 690, m - 570).otherwise(m - 780 + 120)


def measures(big: float) -> dict[str, Column]:
    buy, sell, large = F.col("side") == "B", F.col("side") == "S", F.col("amount") >= big
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0.0))
    return {"amount": F.sum("amount"), "active_net": pick(buy) - pick(sell), "big_buy": pick(large & buy), "big_sell": pick(large & sell),
            "big_amount": pick(large)}


def minute_table(trades: DataFrame, big: float, keys: tuple[str, ...] = ("group_id", "day")) -> DataFrame:
    """One row per key and minute: bounded by 240 minutes, whatever the number of trades."""
    return trades.groupBy(*keys, minute_label(F.col("ts")).alias("minute")).agg(*[c.alias(n) for n, c in measures(big).items()])


def cumulate(minutes: DataFrame, keys: tuple[str, ...] = ("group_id", "day"), recent: int = RECENT) -> DataFrame:
    """Running totals of the session and the net of large trades over the last minutes."""
    rows = minutes.withColumn("_n", minute_number(F.col("minute")))
    w = Window.partitionBy(*keys).orderBy("_n")
    upto, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rangeBetween(-(recent - 1), 0)
    totals = {c: F.sum(c).over(upto) for c in ("amount", "active_net", "big_buy", "big_sell", "big_amount")}
    return rows.withColumns({"big_net_recent": F.sum(F.col("big_buy") - F.col("big_sell")).over(last), **totals}).drop("_n")


def profile(minutes: DataFrame, keys: tuple[str, ...] = ("group_id", "day")) -> DataFrame:
    """Average share of a session's turnover traded by each minute that has trades."""
    rows = minutes.withColumn("_n", minute_number(F.col("minute")))
    w = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("amount").over(w) / F.sum("amount").over(Window.partitionBy(*keys))
    return rows.withColumn("_s", share).groupBy("minute").agg(F.avg("_s").alias("share"), F.count("*").alias("sessions"))


def typical_turnover(minutes: DataFrame, sessions: int, group: str = "group_id") -> DataFrame:
    """Median turnover of a group's last sessions."""
    daily = minutes.groupBy(group, "day").agg(F.sum("amount").alias("amount"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("day")))
    return daily.withColumn("_n", n).filter(F.col("_n") <= sessions).groupBy(group).agg(F.percentile("amount", F.lit(0.5)).alias("typical"))


def covering(members: DataFrame, coverage: float, group: str = "group_id", turnover: str = "turnover", key: str = "symbol") -> DataFrame:
    """The most traded members of each group until they cover a share of its turnover."""
    w = Window.partitionBy(group).orderBy(F.desc(turnover), key)
    before = F.coalesce(F.sum(turnover).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = before / F.sum(turnover).over(Window.partitionBy(group))
    return members.withColumn("covered_before", share).filter(F.col("covered_before") < coverage)


def against_baseline(snapshots: DataFrame, shape: DataFrame, typical: DataFrame, group: str = "group_id") -> DataFrame:
    """Snapshots with the turnover usual by that minute; both tables are small and joined without a shuffle hint."""
    rows = snapshots.join(shape.select("minute", "share"), "minute", "left").join(typical, group, "left")
    base = F.col("typical") * F.col("share")
    net = F.col("big_buy") - F.col("big_sell")
    return rows.withColumns({"baseline": base, "ratio": F.when(base > 0, F.col("amount") / base), "big_net": net,
                             "big_share": F.when(F.col("amount") > 0, F.col("big_amount") / F.col("amount"))})


def direction(min_ratio: float, min_big_share: float, min_net: float, net_share: float, not_before: str) -> Column:
    """'buy' or 'sell' where a snapshot passes all thresholds."""
    need = F.greatest(F.lit(min_net), net_share * F.col("typical"))
    ready = (F.col("minute") >= not_before) & (F.col("ratio") >= min_ratio) & (F.col("big_share") >= min_big_share)
    return F.when(ready & (F.col("big_net") >= need), "buy").when(ready & (F.col("big_net") <= -need), "sell")


def first_alerts(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """One alert per (group, direction, day): the first minute."""
    return rows.filter("direction is not null").groupBy(group, "day", "direction").agg(F.min("minute").alias("minute"))


def freshness(trades: DataFrame, quotes: DataFrame, key: str, at: str, factor: float, slack: float) -> DataFrame:
    """Running turnover of a source's day against its newest quote of that day: fresh, stale or without a quote.

    ``trades``: key, day, at, amount; ``quotes``: key, day, at, quoted (turnover of the day so far).  A quote of another day
    says nothing, and turnover far above the quoted one is another session's.
    """
    total = F.sum("amount").over(Window.partitionBy(key, "day").orderBy(at))
    rows = asof_join(trades.withColumn("total", total).drop("amount"), quotes, [key, "day"], at, at, ["quoted"])
    source = (F.when(F.col("quoted").isNull(), "no_quote").when(F.col("total") > F.col("quoted") * factor + slack, "stale").otherwise("fresh"))
    return rows.withColumn("source", source)


#: Strikes a value must have against the session's median, values before that counts, rise and percentile of an alert.
STRIKE_SHARE, STRIKE_VALUES, ALERT_RISE, ALERT_PERCENTILE, REFERENCE = 0.9, 5, 0.02, 0.5, 50


def volatility_step(state: dict, row: dict) -> tuple[dict, dict]:
    """One value of a volatility index: kept or thin, its rise over the last session, and at most one alert a session.

    The state holds the session's strike counts, its last value, and the last values of up to ``REFERENCE`` sessions.
    """
    known = lambda x: x is not None and x == x
    s = {"session": "", "seen": [], "last": None, "previous": None, "reference": [], "alerted": False} | state
    if row["session"] != s["session"]:
        if s["last"] is not None:
            s = s | {"previous": s["last"], "reference": [*s["reference"], s["last"]][-REFERENCE:]}
        s = s | {"session": row["session"], "seen": [], "last": None, "alerted": False}
    value, strikes = row["value"], int(row["strikes"])
    thin = len(s["seen"]) >= STRIKE_VALUES and strikes < STRIKE_SHARE * median(s["seen"])
    kept = known(value) and known(row["near_vol"]) and not thin
    rise = value / s["previous"] - 1 if kept and s["previous"] is not None else None
    share = sum(x <= value for x in s["reference"]) / len(s["reference"]) if kept and s["reference"] else None
    alert = bool(not s["alerted"] and rise is not None and share is not None and rise >= ALERT_RISE and share >= ALERT_PERCENTILE)
    if kept:
        s = s | {"seen": [*s["seen"], strikes], "last": float(value), "alerted": s["alerted"] or alert}
    return s, {"underlying": row["underlying"], "day": row["day"], "value": float(value) if known(value) else None, "kept": kept, "rise": rise,
               "percentile": share, "alert": alert}
