"""Option chains and model-free volatility."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order_stats import expanding_quantiles


def intrinsic(kind: Column, spot: Column, strike: Column) -> Column:
    return F.greatest(F.when(kind == "call", spot - strike).otherwise(strike - spot), F.lit(0.0))


# Coefficients of Hart's rational approximation of the normal distribution, highest power first.
HART_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
               440.413735824752)
HART_CUT, HART_END, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631
#: Range of implied volatilities, rounds of the root finding, and the least time value (share of the spot) that has one.
VOL_LOW, VOL_HIGH, ROUNDS, TIME_VALUE = 0.001, 5.0, 40, 1e-4


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def normal_cdf(x: Column) -> Column:
    """Normal distribution function to double precision, as a column expression."""
    def polynomial(a: Column, terms: tuple[float, ...]) -> Column:
        out = F.lit(terms[0])
        for c in terms[1:]:
            out = out * a + c
        return out

    def tail(a: Column) -> Column:
        far = a + 0.65
        for c in (4.0, 3.0, 2.0, 1.0):
            far = a + F.lit(c) / far
        inner = polynomial(a, HART_TOP) / polynomial(a, HART_BOTTOM)
        return F.when(a > HART_END, 0.0).otherwise(F.exp(-a * a / 2) * F.when(a < HART_CUT, inner).otherwise(1 / (far * ROOT_TWO_PI)))

    return bound(x, lambda v: bound(tail(F.abs(v)), lambda t: F.when(v > 0, 1 - t).otherwise(t)))


def _d1(spot: Column, strike: Column, t: Column, vol: Column, rate: float) -> Column:
    return (F.log(spot / strike) + (rate + vol * vol / 2) * t) / (vol * F.sqrt(t))


def option_value(kind: Column, spot: Column, strike: Column, t: Column, vol: Column, rate: float) -> Column:
    """Black-Scholes price."""
    paid = strike * F.exp(-rate * t)

    def priced(d: Column) -> Column:
        e = d - vol * F.sqrt(t)
        return F.when(kind == "call", spot * normal_cdf(d) - paid * normal_cdf(e)).otherwise(paid * normal_cdf(-e) - spot * normal_cdf(-d))

    return bound(_d1(spot, strike, t, vol, rate), priced)


def option_delta(kind: Column, spot: Column, strike: Column, t: Column, vol: Column, rate: float) -> Column:
    up = normal_cdf(_d1(spot, strike, t, vol, rate))
    return F.when(kind == "call", up).otherwise(up - 1)


def implied_volatility(kind: Column, price: Column, spot: Column, strike: Column, t: Column, rate: float) -> Column:
    """Volatility at which the model gives the price: Newton's method inside a bracket, as one fold per row.

    Null without a time value of ``TIME_VALUE`` of the spot, and where no volatility of the range gives the price.
    """
    value = lambda x: option_value(kind, spot, strike, t, x, rate)

    def narrowed(state: Column, _: Column) -> Column:
        x = state["x"]

        def moved(p: Column) -> Column:
            low, high = F.when(p > price, state["low"]).otherwise(x), F.when(p > price, x).otherwise(state["high"])
            d = _d1(spot, strike, t, x, rate)
            vega = spot * F.sqrt(t) * F.exp(-d * d / 2) / ROOT_TWO_PI
            newton = x - (p - price) / F.greatest(vega, F.lit(1e-300))
            return bound(F.struct(low.alias("low"), high.alias("high"), newton.alias("x")), lambda s: F.struct(
                s["low"].alias("low"), s["high"].alias("high"), F.when((s["x"] > s["low"]) & (s["x"] < s["high"]), s["x"]).when(
                    p == price, x).otherwise((s["low"] + s["high"]) / 2).alias("x")))

        return bound(value(x), moved)

    start = F.struct(F.lit(VOL_LOW).alias("low"), F.lit(VOL_HIGH).alias("high"), F.lit(0.5).alias("x"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, narrowed)["x"]
    paid = strike * F.exp(-rate * t)
    floor = F.greatest(F.when(kind == "call", spot - paid).otherwise(paid - spot), F.lit(0.0))
    usable = (price >= floor + TIME_VALUE * spot) & (price > value(F.lit(VOL_LOW))) & (price < value(F.lit(VOL_HIGH)))
    return F.when((t > 0) & (spot > 0) & (strike > 0) & usable, found)


def with_risk(bars: DataFrame, rate: float, t: str = "t") -> DataFrame:
    """``bars`` (kind, close, spot, strike, t) with implied volatility and delta."""
    args = [F.col(c).cast("double") for c in ("spot", "strike", t)]
    out = bars.withColumn("iv", implied_volatility(F.col("kind"), F.col("close").cast("double"), *args, rate))
    return out.withColumn("delta", F.when(F.col("iv").isNotNull(), option_delta(F.col("kind"), *args, F.col("iv"), rate)))


def pick_by_delta(bars: DataFrame, by: list[str], expiry: str, days_left: Column, least: int, most: int, target: float, tolerance: float,
                  tie: str = "strike") -> DataFrame:
    """Per group the contract of the nearest expiry inside a band of days left whose delta is nearest to the target.

    The expiry is fixed before deltas are looked at; a group without a contract within the tolerance has no row.
    """
    inside = bars.filter(days_left.between(least, most))
    nearest = inside.withColumn("_first", F.min(expiry).over(Window.partitionBy(*by))).filter(F.col(expiry) == F.col("_first")).drop("_first")
    near = nearest.filter(F.abs(F.col("delta") - target) <= tolerance)
    return pick_by_target(near, by, "delta", target, tie)


def exits(chosen: DataFrame, bars: DataFrame, contract: list[str], at: str, life: Column, hold: int, gains: dict[str, float]) -> DataFrame:
    """Bought a session after it was chosen: returns at a fixed time, at the end, and at the first gain of some size.

    ``chosen``: contract, at (session number); ``bars``: contract, at, close.  ``life`` is the number of sessions from the
    purchase to the end.  A rule that never fires sells at the end; a session without a price has no return.
    """
    start = chosen.select(*contract, F.col(at).alias("_at"), (F.col(at) + 1).alias("_in"), life.alias("_life"))
    path = start.join(bars.select(*contract, F.col(at).alias("_day"), "close"), contract).filter(
        (F.col("_day") >= F.col("_in")) & (F.col("_day") <= F.col("_in") + F.col("_life")))
    age = F.col("_day") - F.col("_in")
    entry = F.max(F.when(age == 0, F.col("close"))).over(Window.partitionBy(*contract, "_at"))
    path = path.withColumns({"_age": age, "entry": entry}).filter("entry > 0")
    at_age = lambda n: F.max(F.when(F.col("_age") == n, F.col("close")))
    first = lambda g: F.min_by("close", F.when((F.col("_age") > 0) & (F.col("close") >= (1 + g) * F.col("entry")), F.col("_age")))
    sold = path.groupBy(*contract, F.col("_at").alias(at), "entry").agg(
        at_age(F.col("_life")).alias("_end"), at_age(F.least(F.lit(hold), F.col("_life"))).alias("_held"), *[first(g).alias(f"_{n}") for n, g in gains.items()])
    ret = lambda c: c / F.col("entry") - 1
    return sold.select(*contract, at, "entry", ret(F.col("_end")).alias("at_end"), ret(F.col("_held")).alias("held"),
                       *[ret(F.coalesce(F.col(f"_{n}"), F.col("_end"))).alias(n) for n in gains])


def chain(bars: DataFrame, spot: DataFrame, by: list[str]) -> DataFrame:
    """T-shaped chain: call and put side by side per strike, at-the-money flag, intrinsic and time value.

    ``bars``: by, strike, kind, close, prev_close; ``spot``: by, spot.
    """
    rows = bars.join(spot, by)
    value = intrinsic(F.col("kind"), F.col("spot"), F.col("strike"))
    rows = rows.withColumns({"change": F.col("close") - F.col("prev_close"), "intrinsic": value, "time_value": F.col("close") - value})
    sides = [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("call", "put")
             for c in ("close", "change", "intrinsic", "time_value")]
    table = rows.groupBy(*by, "strike").agg(F.first("spot").alias("spot"), *sides)
    nearest = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).over(Window.partitionBy(*by))
    return table.withColumn("atm", nearest["strike"] == F.col("strike"))


def term_variance(quotes: DataFrame, by: list[str], rate: float, t: str = "t") -> DataFrame:
    """Model-free variance of every term at once.

    ``quotes``: by, t (years), strike, kind, bid, ask.  The strikes of one term are
    a short list; they are walked outwards from the forward with running windows
    (two missing quotes in a row end a side).
    """
    good = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid"))
    mid = F.when(good, (F.col("bid") + F.col("ask")) / 2)
    table = quotes.filter(F.col(t) > 0).groupBy(*by, t, "strike").agg(
        *[F.avg(F.when(F.col("kind") == k, mid)).alias(k) for k in ("call", "put")])
    term = Window.partitionBy(*by)
    gap = F.when(F.col("call").isNotNull() & F.col("put").isNotNull(), F.struct(F.abs(F.col("call") - F.col("put")), "strike", "call", "put"))
    growth = F.exp(rate * F.col(t))
    table = table.withColumn("_k", F.min(gap).over(term)).filter("_k is not null")
    table = table.withColumn("forward", F.col("_k.strike") + growth * (F.col("_k.call") - F.col("_k.put")))
    table = table.withColumn("k0", F.max(F.when(F.col("strike") <= F.col("forward"), F.col("strike"))).over(term)).filter("k0 is not null")
    side = F.when(F.col("strike") < F.col("k0"), -1).when(F.col("strike") > F.col("k0"), 1).otherwise(0)
    table = table.withColumns({"_side": side, "_q": F.when(side < 0, F.col("put")).when(side > 0, F.col("call")).otherwise(
        F.coalesce((F.col("call") + F.col("put")) / 2, "call", "put"))})
    outward = Window.partitionBy(*by, "_side").orderBy(F.abs(F.col("strike") - F.col("k0")))
    twice = F.col("_q").isNull() & F.coalesce(F.lag(F.col("_q").isNull()).over(outward), F.lit(False))
    table = table.withColumn("_twice", twice)
    stopped = F.coalesce(F.bool_or("_twice").over(outward.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    has_k0 = F.max(F.when((F.col("_side") == 0) & F.col("_q").isNotNull(), 1)).over(term)
    used = table.withColumns({"_stop": stopped, "_ok": has_k0}).filter("_ok = 1 and not _stop and _q is not null")
    w = term.orderBy("strike")
    below, above = F.lag("strike").over(w), F.lead("strike").over(w)
    dk = F.when(below.isNull(), above - F.col("strike")).when(above.isNull(), F.col("strike") - below).otherwise((above - below) / 2)
    used = used.withColumn("_part", dk / (F.col("strike") * F.col("strike")) * F.col("_q"))
    sums = used.groupBy(*by, t, "forward", "k0").agg(F.sum("_part").alias("_s"), F.count("*").alias("strikes")).filter("strikes >= 3")
    tilt = F.col("forward") / F.col("k0") - 1
    return sums.select(*by, t, "forward", "strikes", (F.lit(2.0) / F.col(t) * growth * F.col("_s") - tilt * tilt / F.col(t)).alias("variance"))


def thirty_day(terms: DataFrame, by: list[str], expiry: str, t: str = "t", min_days: float = 7.0) -> DataFrame:
    """The two nearest terms interpolated to 30 days; one term alone gives its own volatility."""
    near = terms.filter(F.col(t) * 365 >= min_days)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(expiry))
    rows = near.withColumn("_p", place).filter("_p <= 2")
    pick = lambda i, c: F.max(F.when(F.col("_p") == i, F.col(c)))
    g = rows.groupBy(*by).agg(pick(1, t).alias("t1"), pick(1, "variance").alias("v1"), pick(2, t).alias("t2"),
                              pick(2, "variance").alias("v2"), F.sum("strikes").alias("strikes"))
    month = F.lit(30.0 / 365.0)
    w = (F.col("t2") - month) / (F.col("t2") - F.col("t1"))
    mixed = (F.col("t1") * F.col("v1") * w + F.col("t2") * F.col("v2") * (1 - w)) / month
    value = F.when(F.col("t2").isNull(), F.col("v1")).otherwise(mixed)
    vol = lambda v: F.when(v > 0, 100 * F.sqrt(v))
    return g.select(*by, vol(value).alias("value"), vol(F.col("v1")).alias("near_vol"), vol(F.col("v2")).alias("next_vol"), "strikes")


def carry_quotes(minutes: DataFrame, contract: list[str], minute: str, columns: list[str]) -> DataFrame:
    """Each contract's last quote at every minute of its grid."""
    w = Window.partitionBy(*contract).orderBy(minute).rowsBetween(Window.unboundedPreceding, 0)
    return minutes.withColumns({c: F.last(c, True).over(w) for c in columns})


def alerts(history: DataFrame, by: list[str], day: str, value: str, rise: float, percentile: float, back: int) -> DataFrame:
    """Rise against the day before with the percentile of the value in the trailing history."""
    w = Window.partitionBy(*by).orderBy(day)
    past = w.rowsBetween(-back, -1)
    rows = history.withColumn("_seen", F.collect_list(value).over(past))  # bounded by ``back``
    rank = F.when((F.size("_seen") > 0) & F.col(value).isNotNull(), F.size(F.filter("_seen", lambda v: v <= F.col(value))) / F.size("_seen"))
    rows = rows.withColumns({"rise": F.col(value) / F.lag(value).over(w) - 1, "percentile": rank})
    return rows.withColumn("alert", F.coalesce((F.col("rise") >= rise) & (F.col("percentile") >= percentile), F.lit(False))).drop("_seen")


def thin(minutes: DataFrame, by: list[str], order: str, strikes: str, share: float, least: int = 5) -> DataFrame:
    """Flag minutes with far fewer strikes than the median of the ones before."""
    keyed = minutes.withColumn("_key", F.to_json(F.struct(*by)))
    usual = expanding_quantiles(keyed, "_key", order, strikes, {"_usual": 0.5}, least)
    return usual.withColumn("thin", F.coalesce(F.col(strikes) < share * F.col("_usual"), F.lit(False))).drop("_key", "_usual")


def pick_by_target(rows: DataFrame, by: list[str], x: str, target: float, tie: str) -> DataFrame:
    """The contract nearest to a target (delta, moneyness) per group."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col(x) - target), tie)).alias("_r")).select(*by, "_r.*")


def first_hit(path: DataFrame, by: list[str], day: str, hit: Column, value: str) -> DataFrame:
    """First day a rule holds and the value then, else the last value."""
    return path.groupBy(*by).agg(
        F.min(F.when(hit, F.col(day))).alias("exit_day"),
        F.coalesce(F.min_by(value, F.when(hit, F.col(day))), F.max_by(value, day)).alias("exit_value"))
