"""Effective-dated trading rules as small tables and column expressions.

Prices and money are integer fen.  Rates are kept in parts per million, so all
rounding is exact integer arithmetic: half-up of n / d is (2 n + d) div (2 d).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Price limits by board, risk state and date (inclusive; None = open), in parts per million.
MAIN, ALL_RISK = ("SSE_MAIN", "SZSE_MAIN"), ("normal", "risk_warning", "delisting_period")
PRICE_LIMITS = (
    (MAIN, ("normal",), None, None, 100000),
    (MAIN, ("risk_warning",), None, "2026-07-05", 50000),
    (MAIN, ("risk_warning",), "2026-07-06", None, 100000),
    (MAIN, ("delisting_period",), None, None, 100000),
    (("CHINEXT",), ("normal", "delisting_period"), None, "2020-08-23", 100000),
    (("CHINEXT",), ("risk_warning",), None, "2020-08-23", 50000),
    (("CHINEXT",), ALL_RISK, "2020-08-24", None, 200000),
    (("STAR",), ALL_RISK, None, None, 200000),
    (("BSE",), ALL_RISK, None, None, 300000),
)
SYMBOL_LIMITS = (("600182", None, None, 50000),)
# First sessions after listing without a limit (boards, listed from, sessions).
NO_LIMIT = ((("STAR",), "2019-07-22", 5), (("CHINEXT",), "2020-08-24", 5), (MAIN, "2023-04-10", 5),
            ((*MAIN, "CHINEXT", "STAR", "BSE"), None, 1))
DELISTING_FIRST_FREE_FROM = "2020-12-31"
# Lot rules (boards, smallest buy, step, odd lot below), fees (ppm) and tick.
LOTS = (((*MAIN, "CHINEXT"), 100, 100, 100), (("STAR",), 200, 1, 200), (("BSE",), 100, 1, 100))
STAMP_DUTY = (("sell", None, "2023-08-27", 1000), ("sell", "2023-08-28", None, 500))
TRANSFER_FEE = ((("SSE", "SZSE"), None, "2022-04-28", 20), (("BSE",), None, "2022-04-28", 25),
                (("SSE", "SZSE", "BSE"), "2022-04-29", None, 10))
TICK = 1
OPEN, CLOSED = "1900-01-01", "9999-12-31"


def limit_table(spark: SparkSession) -> DataFrame:
    rows = [(b, r, s or OPEN, e or CLOSED, ppm) for boards, risks, s, e, ppm in PRICE_LIMITS
            for b in boards for r in risks]
    return _dated(spark.createDataFrame(rows, "board string, risk string, start string, end string, ppm long"))


def lot_table(spark: SparkSession) -> DataFrame:
    rows = [(b, low, step, odd) for boards, low, step, odd in LOTS for b in boards]
    return spark.createDataFrame(rows, "board string, buy_min long, buy_step long, odd_lot_below long")


def stamp_table(spark: SparkSession) -> DataFrame:
    return _dated(spark.createDataFrame([(side, s or OPEN, e or CLOSED, ppm) for side, s, e, ppm in STAMP_DUTY],
                                        "side string, start string, end string, ppm long"))


def transfer_table(spark: SparkSession) -> DataFrame:
    rows = [(x, s or OPEN, e or CLOSED, ppm) for exchanges, s, e, ppm in TRANSFER_FEE for x in exchanges]
    return _dated(spark.createDataFrame(rows, "exchange string, start string, end string, ppm long"))


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def lookup(df: DataFrame, table: DataFrame, keys: list[str], day: str, out: str) -> DataFrame:
    """The rate in force: equal keys and a day inside the window (rule tables are code-sized, so broadcast)."""
    t = table.alias("rule")
    condition = F.col(f"x.{day}").between(F.col("rule.start"), F.col("rule.end"))
    for k in keys:
        condition = condition & (F.col(f"x.{k}") == F.col(f"rule.{k}"))
    return df.alias("x").join(F.broadcast(t), condition, "left").select("x.*", F.col("rule.ppm").alias(out))


def limit_ratio(df: DataFrame, day: str = "trade_date", symbol: str = "symbol") -> DataFrame:
    """Limit of the security itself where one is set, else of its board and risk state."""
    own = F.lit(None).cast("long")
    for code, s, e, ppm in SYMBOL_LIMITS:
        own = F.when((F.col(symbol) == code) & F.col(day).between(F.to_date(F.lit(s or OPEN)), F.to_date(F.lit(e or CLOSED))),
                     ppm).otherwise(own)
    found = lookup(df, limit_table(df.sparkSession), ["board", "risk"], day, "_ppm")
    return found.withColumn("limit_ppm", F.coalesce(own, F.col("_ppm"))).drop("_ppm")


def rule_gaps(spark: SparkSession, table: DataFrame, keys: list[str]) -> DataFrame:
    """Boundary days on which a key has no rule or more than one (empty for a sound table)."""
    edges = table.select(*keys, F.explode(F.array(
        F.to_date(F.lit("2019-01-02")), F.to_date(F.lit("2030-12-31")), "start", F.date_sub("start", 1),
        "end", F.when(F.col("end") < F.to_date(F.lit(CLOSED)), F.date_add("end", 1)))).alias("day"))
    days = edges.filter(F.col("day") > F.to_date(F.lit(OPEN))).select("day").distinct()
    every = table.select(*keys).distinct().join(
        F.broadcast(days.agg(F.collect_set("day").alias("days")))).select(*keys, F.explode("days").alias("day"))
    t, x = table.alias("t"), every.alias("x")
    condition = F.col("x.day").between(F.col("t.start"), F.col("t.end"))
    for k in keys:
        condition = condition & (F.col(f"x.{k}") == F.col(f"t.{k}"))
    return x.join(t, condition, "left").groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], "x.day").agg(
        F.count("t.start").alias("rules")).filter("rules <> 1")


def half_up(amount: Column, ppm: Column) -> Column:
    """amount × ppm / 1e6 rounded half-up, in whole fen (amount ≥ 0)."""
    return F.floor((amount.cast("decimal(28,0)") * ppm * 2 + 1000000) / 2000000).cast("long")


def limit_prices(reference: Column, ppm: Column) -> tuple[Column, Column]:
    """Up and down limit: half-up to the tick and at least one tick away."""
    up = F.greatest(half_up(reference, ppm + 1000000), reference + TICK)
    down = F.greatest(F.least(half_up(reference, F.lit(1000000) - ppm), reference - TICK), F.lit(TICK))
    return F.when(reference.isNotNull(), up).cast("long"), F.when(reference.isNotNull(), down).cast("long")


def no_limit(board: Column, list_date: Column, sessions_since_listing: Column) -> Column:
    hit = F.lit(False)
    for boards, listed_from, sessions in NO_LIMIT:
        hit = hit | (board.isin(*boards) & (list_date >= F.to_date(F.lit(listed_from or OPEN)))
                     & (sessions_since_listing < sessions))
    return F.coalesce(hit, F.lit(False))


def reference_price(close: Column, hfq_before: Column, hfq_now: Column) -> Column:
    """Previous close carried through a factor step, half-up, at least one fen."""
    carried = F.greatest(F.lit(1).cast("long"), F.floor(close * hfq_before / hfq_now + 0.5))
    usable = hfq_before.isNotNull() & hfq_now.isNotNull() & (hfq_now > 0)
    return F.when(close.isNull(), None).when(usable, carried).otherwise(close)


def open_state(df: DataFrame, one_price_move: float = 0.045) -> DataFrame:
    """Band, lock reasons and flags at the open.

    Needs open, high, low, close, has_bar, reference, limit_ppm and unlimited.
    """
    up, down = limit_prices(F.col("reference"), F.col("limit_ppm"))
    banded = F.col("has_bar") & F.col("reference").isNotNull()
    df = df.withColumns({"up": F.when(banded, up), "down": F.when(banded, down)})
    inside = (F.col("low") >= F.col("down") - TICK) & (F.col("high") <= F.col("up") + TICK)
    df = df.withColumn("band_in_force", F.coalesce(banded & ~F.col("unlimited") & inside, F.lit(False)))
    flat = (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    move = F.col("close") / F.col("reference") - 1
    free = banded & ~F.col("unlimited")
    return df.withColumns({
        "lock_buy": F.when(F.col("band_in_force") & (F.col("open") >= F.col("up")), "LIMIT_UP_AT_OPEN")
        .when(free & flat & (move >= one_price_move), "ONE_PRICE_LIMIT_UP"),
        "lock_sell": F.when(F.col("band_in_force") & (F.col("open") < F.col("up")) & (F.col("open") <= F.col("down")),
                            "LIMIT_DOWN_AT_OPEN").when(free & flat & (move <= -one_price_move), "ONE_PRICE_LIMIT_DOWN"),
        "flag": F.when(F.col("has_bar") & F.col("reference").isNull(), "NO_REFERENCE_PRICE")
        .when(banded & F.col("unlimited"), "NO_LIMIT_SESSION")
        .when(free & ~F.col("band_in_force"), "LIMIT_BAND_NOT_IN_FORCE")})


def fill_price(side: Column, open_: Column, slippage_ppm: int, band: Column, up: Column, down: Column) -> Column:
    """Open moved against the order by the slippage, kept inside the band, at least one fen."""
    buy, sell = half_up(open_, F.lit(1000000 + slippage_ppm)), half_up(open_, F.lit(1000000 - slippage_ppm))
    price = F.when(side == "buy", F.when(band & up.isNotNull(), F.least(buy, up)).otherwise(buy)).otherwise(
        F.when(band & down.isNotNull(), F.greatest(sell, down)).otherwise(sell))
    return F.greatest(price, F.lit(1).cast("long"))


def fees(df: DataFrame, commission_ppm: int, minimum: int, day: str = "trade_date") -> DataFrame:
    """Commission (with a minimum), stamp duty and transfer fee of each fill; needs side, exchange, notional."""
    df = lookup(df, stamp_table(df.sparkSession), ["side"], day, "_stamp")
    df = lookup(df, transfer_table(df.sparkSession), ["exchange"], day, "_transfer")
    n, zero = F.col("notional"), F.lit(0).cast("long")
    traded = lambda c: F.when(n > 0, c).otherwise(zero)
    return df.withColumns({
        "commission": traded(F.greatest(half_up(n, F.lit(commission_ppm)), F.lit(minimum).cast("long"))),
        "stamp_duty": traded(half_up(n, F.coalesce("_stamp", zero))),
        "transfer_fee": traded(half_up(n, F.col("_transfer")))}).drop("_stamp", "_transfer")


def round_buy(quantity: Column) -> Column:
    """Largest legal buy not above ``quantity``; needs the lot columns."""
    step = F.floor((quantity - F.col("buy_min")) / F.col("buy_step")) * F.col("buy_step")
    return F.when(quantity < F.col("buy_min"), 0).otherwise(F.col("buy_min") + step).cast("long")


def round_sell(quantity: Column, holding: Column) -> Column:
    """Largest legal sell: all of a holding is always legal, an odd lot only as a whole."""
    asked = F.least(quantity, holding)
    return (F.when(asked <= 0, 0).when(asked == holding, holding).when(holding < F.col("odd_lot_below"), 0)
            .otherwise(round_buy(asked)).cast("long"))


def share_adjustment(quantity: Column, hfq_before: Column, hfq_now: Column, reference: Column) -> dict[str, Column]:
    """New quantity and cash in lieu of the fraction when the factor steps."""
    exact = quantity * (hfq_now / hfq_before)
    new = F.floor(exact + 1e-9)
    return {"new_quantity": new, "cash_in_lieu": F.floor((exact - new) * reference + 0.5)}
