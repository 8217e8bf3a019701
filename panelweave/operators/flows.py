"""Market structure: crowding of turnover, fund flows, money waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order_stats import expanding_quantiles, expanding_rank
from .windows import islands, last_n, series

# Crowding windows (sessions), zone limits, cells, horizons (weeks), entry gap (weeks).
SHORT, SHORT_MIN, LONG, BASE_MIN, R3, R12, CHANGE = 20, 15, 750, 250, 60, 250, 60
CROWDED, FIGHT, FIGHT_RETURN, STARTING, STARTING_RETURN, QUIET_RETURN = 1.8, (0.8, 1.4), 0.30, (0.6, 0.8), (0.15, 0.50), 0.15
C_BANDS = ((None, 0.8, "C<0.8"), (0.8, 1.4, "C 0.8–1.4"), (1.4, 1.8, "C 1.4–1.8"), (1.8, None, "C>1.8"))
R_BANDS = ((None, 0.15, "<15%"), (0.15, 0.30, "15–30%"), (0.30, 0.50, "30–50%"), (0.50, None, ">50%"))
HORIZONS, ENTRY_GAP = (13, 26), 13
# Fund-flow events and abnormal days.
SPLIT_RATIO, SPLIT_TOLERANCE, MAX_GAP = 1.4, 1.25, 5
BASELINE, BASELINE_MIN, ABNORMAL_Z, ABNORMAL_SHARE, STRONG_Z, STRONG_SHARE, FLOOR_SHARE = 250, 60, 4.0, 0.005, 8.0, 0.02, 0.0001
WAVE_SESSIONS, WAVE_TAIL, WAVE_MIN_HISTORY, WAVE_GAP, WAVE_HORIZONS = 10, 0.02, 250, 20, (5, 20, 60)


def crowding(panel: DataFrame, key: str = "code", short_min: int = SHORT_MIN, base_min: int = BASE_MIN) -> DataFrame:
    """Turnover share, crowding C, its change and the 3- and 12-month returns on the dense grid."""
    rows = panel.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy("idx")))
    mean = lambda n, least: F.when(F.count("share").over(last_n(n, key)) >= least, F.avg("share").over(last_n(n, key)))
    rows = rows.withColumns({"c": mean(SHORT, short_min) / mean(LONG, base_min), "base": F.count("share").over(last_n(LONG, key))})
    w = series(key, "idx")
    back = lambda x, n: F.lag(x, n).over(w)
    return rows.withColumns({"dc60": F.col("c") - back("c", CHANGE), "r3": F.col("close") / back("close", R3) - 1,
                             "r12": F.col("close") / back("close", R12) - 1})


def zone(c: Column, r: Column) -> Column:
    known = c.isNotNull() & r.isNotNull()
    return (F.when(~known, None).when(c > CROWDED, "crowded")
            .when(c.between(*FIGHT) & (r >= FIGHT_RETURN), "fight")
            .when((c >= STARTING[0]) & (c < STARTING[1]) & r.between(*STARTING_RETURN), "starting")
            .when((c < FIGHT[0]) & (r < QUIET_RETURN), "waiting").otherwise("other"))


def band(x: Column, bands: tuple) -> Column:
    out = F.lit("")
    for low, high, label in bands:
        inside = (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x <= high)
        out = F.when(inside, label).otherwise(out)
    return out


def cell(c: Column, r: Column) -> Column:
    return F.when(c.isNotNull() & r.isNotNull(), F.concat_ws("|", band(c, C_BANDS), band(r, R_BANDS)))


def week_key(day: str) -> Column:
    """Weeks that end on Friday."""
    return F.to_date(F.date_trunc("week", F.date_add(day, 2)))


def week_ends(calendar: DataFrame) -> DataFrame:
    """Last session of each week with the week's number (one row per week)."""
    ends = calendar.groupBy(week_key("trade_date").alias("_w")).agg(F.max_by(F.struct("idx", "trade_date"), "idx").alias("e"))
    return ends.select("e.*", (F.row_number().over(Window.orderBy("_w")) - 1).cast("long").alias("week_no"))


def weekly_table(daily: DataFrame, weeks: DataFrame, benchmark: DataFrame, key: str = "code",
                 horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Weekly measures with forward excess over the average industry (x) and the benchmark (h)."""
    rows = daily.join(weeks.select("idx", "week_no"), "idx").join(benchmark.select("idx", "bench"), "idx")
    w, whole = series(key, "week_no"), Window.partitionBy("week_no")
    for h in horizons:
        forward = F.lead("close", h).over(w) / F.col("close") - 1
        rows = rows.withColumn("_f", forward)
        rows = rows.withColumns({f"x{h}": F.col("_f") - F.avg("_f").over(whole),
                                 f"h{h}": F.col("_f") - (F.lead("bench", h).over(w) / F.col("bench") - 1)}).drop("_f")
    c, r = F.col("c"), F.col("r12")
    return rows.withColumns({"zone": zone(c, r), "cell": cell(c, r)}).filter("c is not null")


def entries(weekly: DataFrame, key: str = "code", level: float = CROWDED, gap: int = ENTRY_GAP) -> DataFrame:
    above = weekly.filter(F.col("c") > level)
    before = F.lag("week_no").over(series(key, "week_no"))
    return above.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("week_no") - F.col("_b") > gap)).drop("_b")


def pit_statistics(samples: DataFrame, key: str, weeks: DataFrame, h: int) -> DataFrame:
    """Per key and week: samples whose forward window has closed, their mean excess and share of losses.

    Samples are summed by the week they become known; a running sum over the
    key's weeks follows, so no sample meets more than one week.
    """
    known = samples.filter(F.col(f"x{h}").isNotNull() & F.col(key).isNotNull()).select(
        key, (F.col("week_no") + h).alias("week_no"), F.lit(1).alias("n"), F.col(f"x{h}").alias("x"),
        (F.col(f"x{h}") < 0).cast("int").alias("lose"))
    sums = known.groupBy(key, "week_no").agg(*[F.sum(c).alias(c) for c in ("n", "x", "lose")])
    keys = known.select(key).distinct()
    every = weeks.agg(F.sequence(F.min("week_no"), F.max("week_no")).alias("w")).scalar()
    grid = keys.select(key, F.explode(every).alias("week_no")).join(sums, [key, "week_no"], "left")
    w = series(key, "week_no").rowsBetween(Window.unboundedPreceding, 0)
    total = {c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("n", "x", "lose")}
    rows = grid.select(key, "week_no", *[v.alias(k) for k, v in total.items()])
    return rows.select(key, "week_no", "n", F.when(F.col("n") > 0, F.col("x") / F.col("n")).alias("mean"),
                       F.when(F.col("n") > 0, F.col("lose") / F.col("n")).alias("losses"))


def crossings(daily: DataFrame, key: str = "code", high: float = CROWDED, low: float = FIGHT[1]) -> DataFrame:
    """C rising above ``high``; then the first fall below ``low`` after such a rise.

    Both kinds of crossing are marked by ``lag``; a fall counts when the mark
    before it is a rise, so no state has to be carried along.
    """
    w = series(key, "idx")
    before = F.lag("c").over(w)
    rise = (F.col("c") > high) & ~F.coalesce(before > high, F.lit(False))
    fall = (F.col("c") < low) & ~F.coalesce(before < low, F.lit(False))
    marks = daily.withColumn("event", F.when(rise, "crowded").when(fall, "relief")).filter("event is not null")
    previous = F.lag("event").over(w)
    return marks.withColumn("_p", previous).filter((F.col("event") == "crowded") | (F.col("_p") == "crowded")).select(
        key, "idx", "event", "c")


def spell_lengths(entries_: DataFrame, weekly: DataFrame, exit_below: float, key: str = "code") -> DataFrame:
    """Weeks from each entry until C is first below the exit level (null while it is not)."""
    w = series(key, "week_no").rowsBetween(1, Window.unboundedFollowing)
    out = weekly.withColumn("_exit", F.min(F.when(F.col("c") < exit_below, F.col("week_no"))).over(w))
    return entries_.select(key, "week_no").join(out.select(key, "week_no", "_exit"), [key, "week_no"]).select(
        key, "week_no", (F.col("_exit") - F.col("week_no")).alias("weeks"))


# -- fund flows -------------------------------------------------------------------------

def fund_flows(shares: DataFrame, closes: DataFrame, calendar: DataFrame, key: str = "symbol") -> DataFrame:
    """Daily creation per fund (share change × close) with new, gap, split and jump events set apart."""
    rows = shares.join(closes, [key, "trade_date"], "left").join(calendar, "trade_date")
    w = series(key, "idx")
    rows = rows.withColumn("close", F.last("close", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_s": F.lag("shares").over(w), "_c": F.lag("close").over(w), "_i": F.lag("idx").over(w)})
    rows = rows.withColumns({"_ratio": F.col("shares") / F.col("_s"), "_pr": F.col("close") / F.col("_c")})
    near = [F.col("_pr"), F.lag("_pr").over(w), F.lead("_pr").over(w)]
    rows = rows.withColumns({f"_n{i}": x for i, x in enumerate(near)})
    tolerance = F.log(F.lit(SPLIT_TOLERANCE))
    offset, unknown = F.lit(False), F.lit(True)
    for i in range(3):
        n = F.col(f"_n{i}")
        offset = offset | F.coalesce(F.abs(F.log(n * F.col("_ratio"))) <= tolerance, F.lit(False))
        unknown = unknown & n.isNull()
    big = F.abs(F.log("_ratio")) >= F.log(F.lit(SPLIT_RATIO))
    event = (F.when(F.col("_s").isNull(), "new").when(F.col("idx") - F.col("_i") > MAX_GAP, "gap")
             .when(big & offset, "split").when(big & unknown, "jump"))
    change = F.col("shares") - F.col("_s")
    return rows.select(key, "trade_date", "idx", "shares", "close", (F.col("shares") * F.col("close")).alias("aum"),
                       change.alias("share_change"), F.when(event.isNull(), change * F.col("close")).alias("flow"), event.alias("event"))


def group_flows(funds: DataFrame, group: str = "group_id") -> DataFrame:
    """Flows per group and day with the robust z-score and the abnormal and strong flags."""
    daily = funds.groupBy(group, "trade_date").agg(
        F.sum("aum").alias("aum"), F.sum("flow").alias("flow"), F.countDistinct("symbol").alias("funds"),
        F.count("aum").alias("priced_funds"), F.count("event").alias("events"))
    w = series(group, "trade_date")
    past = w.rowsBetween(-BASELINE, -1)
    daily = daily.withColumns({"flow_pct": F.col("flow") / F.lag("aum").over(w), "_n": F.count("flow").over(past)})
    # The three quantiles share one pass over the frame.
    daily = daily.withColumn("_q", F.percentile("flow", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(past))
    spread = F.greatest((F.col("_q")[2] - F.col("_q")[0]) / 1.349, FLOOR_SHARE * F.lag("aum").over(w))
    daily = daily.withColumns({"_m": F.col("_q")[1], "_s": spread})
    z = F.when((F.col("_n") >= BASELINE_MIN) & (F.col("_s") > 0), F.bround((F.col("flow") - F.col("_m")) / F.col("_s"), 2))
    daily = daily.withColumn("z", z).drop("_n", "_m", "_s", "_q")
    abnormal = (F.when((F.col("z") >= ABNORMAL_Z) & (F.col("flow_pct") >= ABNORMAL_SHARE), "in")
                .when((F.col("z") <= -ABNORMAL_Z) & (F.col("flow_pct") <= -ABNORMAL_SHARE), "out"))
    strong = abnormal.isNotNull() & (F.abs("z") >= STRONG_Z) & (F.abs("flow_pct") >= STRONG_SHARE)
    return daily.withColumns({"abnormal": abnormal, "strong": strong})


def trailing_flows(daily: DataFrame, windows: tuple[int, ...], group: str = "group_id") -> DataFrame:
    """Sums of the last n sessions as of each group's last session."""
    w = Window.partitionBy(group).orderBy(F.desc("trade_date"))
    aged = daily.withColumn("_age", F.row_number().over(w))
    return aged.groupBy(group).agg(*[F.coalesce(F.sum(F.when(F.col("_age") <= n, F.col("flow"))), F.lit(0.0)).alias(f"flow_{n}d")
                                     for n in windows])


def streak(df: DataFrame, key: str, order: str, x: str, out: str = "streak") -> DataFrame:
    """Signed length of the run of same-sign values (zero breaks it)."""
    runs = islands(df.withColumn("_sign", F.signum(F.coalesce(x, F.lit(0.0)))), [key], order, "_sign", "_run")
    n = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return runs.withColumn(out, (n * F.col("_sign")).cast("int")).drop("_sign", "_run")


def flow_waves(daily: DataFrame, group: str = "group_id", min_history: int = WAVE_MIN_HISTORY, index: str = "index_close") -> DataFrame:
    """10-session flow as a share of assets, its point-in-time band and rank, waves and what followed.

    A group's series has one row per session; its expanding quantiles and ranks are exact.
    """
    w = series(group, "trade_date")
    rows = daily.withColumns({"_n": F.row_number().over(w), "_f": F.coalesce("flow", F.lit(0.0)),
                              index: F.last(index, True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    total = F.when(F.col("_n") >= WAVE_SESSIONS, F.sum("_f").over(w.rowsBetween(-(WAVE_SESSIONS - 1), 0)))
    rows = rows.withColumn("wave_flow", total).withColumn("wave_pct", F.col("wave_flow") / F.lag("aum", WAVE_SESSIONS).over(w))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = expanding_quantiles(rows, group, "trade_date", "wave_pct", {"low": WAVE_TAIL, "high": 1 - WAVE_TAIL}, min_history)
    rows = expanding_rank(rows, group, "trade_date", "wave_pct", "rank", min_history)
    rows = streak(rows, group, "trade_date", "flow")
    rows = rows.withColumn("index_window", F.col(index) / F.lag(index, WAVE_SESSIONS).over(w) - 1)
    rows = rows.withColumns({f"after_{h}": F.lead(index, h).over(w) / F.col(index) - 1 for h in WAVE_HORIZONS})
    hit = {"creation": F.col("wave_pct") > F.col("high"), "redemption": F.col("wave_pct") < F.col("low")}
    wave = F.lit(None).cast("string")
    for kind, cond in hit.items():
        last_hit = F.last(F.when(cond, F.col("_n")), True).over(past)
        wave = F.when(cond & (last_hit.isNull() | (F.col("_n") - last_hit > WAVE_GAP)), kind).otherwise(wave)
    rows = rows.withColumn("wave", wave)
    rising = F.coalesce(F.col("index_window") > 0, F.lit(False))
    counter = ((F.col("wave") == "redemption") & rising) | ((F.col("wave") == "creation") & ~rising & F.col("index_window").isNotNull())
    return rows.withColumn("counter", F.coalesce(counter, F.lit(False))).drop("_n", "_f")


def wave_base(waves: DataFrame) -> DataFrame:
    """What followed any day, per horizon: mean, share up, number."""
    long = waves.unpivot([], [f"after_{h}" for h in WAVE_HORIZONS], "horizon", "ret").filter("ret is not null")
    return long.groupBy("horizon").agg(F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("int")).alias("up"), F.count("*").alias("n"))


def complete_until(df: DataFrame, by: str, day: str = "trade_date") -> DataFrame:
    """Rows up to the last day every source has delivered."""
    cut = df.groupBy(by).agg(F.max(day).alias("_m")).agg(F.min("_m")).scalar()
    return df.filter(F.col(day) <= cut)


def first_class(text: Column, patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """Class of the first matching pattern."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out
