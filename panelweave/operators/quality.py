"""Data-quality rules as tables of issues: one pass per dataset, one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ISSUE = ("rule", "severity", "affected_rows")


def issue_table(df: DataFrame, rules: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Count all rules in one aggregation, then unpivot; clean rules give no row."""
    keys = by or []
    counts = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, (_, c) in rules.items()])
    long = counts.unpivot(keys, list(rules), "rule", "affected_rows").filter("affected_rows > 0")
    severity = F.lit(None).cast("string")
    for name, (level, _) in rules.items():
        severity = F.when(F.col("rule") == name, level).otherwise(severity)
    return long.withColumn("severity", severity)


def duplicates(df: DataFrame, keys: list[str], by: list[str] | None = None, rule: str = "unique_key",
               severity: str = "blocking") -> DataFrame:
    """Rows beyond the first of a key, from key counts."""
    counts = df.groupBy(*keys).agg((F.count("*") - 1).alias("_n"))
    grouped = counts.groupBy(*(by or [])).agg(F.sum("_n").alias("affected_rows")).filter("affected_rows > 0")
    return grouped.withColumns({"rule": F.lit(rule), "severity": F.lit(severity)})


def bar_rules() -> dict[str, tuple[str, Column]]:
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    return {
        "key_not_null": ("blocking", F.col("symbol").isNull() | F.col("trade_date").isNull()),
        "positive_prices": ("blocking", (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)),
        "valid_ohlc": ("blocking", (h < F.greatest(o, c, l)) | (l > F.least(o, c, h))),
        "non_negative_volume": ("blocking", F.col("volume") < 0),
        "price_not_null": ("blocking", o.isNull() | h.isNull() | l.isNull() | c.isNull()),
    }


def validate_bars(bars: DataFrame, by: list[str]) -> DataFrame:
    issues = issue_table(bars, bar_rules(), by)
    return issues.unionByName(duplicates(bars, ["symbol", "trade_date"], by, "unique_symbol_date").select(*issues.columns))


def volume_unit_outliers(bars: DataFrame, by: list[str], amount: str = "amount", low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Batches whose median amount / (volume × close) is not about one."""
    valid = bars.filter((F.col("volume") > 0) & (F.col("close") > 0) & (F.col(amount) > 0))
    ratio = F.col(amount) / (F.col("volume") * F.col("close"))
    return valid.groupBy(*by).agg(F.percentile(ratio, F.lit(0.5)).alias("ratio"), F.count("*").alias("rows")).filter(
        ~F.col("ratio").between(low, high))


def vanished_share(previous: DataFrame, current: DataFrame, key: str, status: str) -> DataFrame:
    """How many live keys vanished, against how many there were."""
    live = previous.filter(F.col(status) != "delisted")
    seen = current.select(key).distinct().withColumn("_seen", F.lit(1))
    return live.join(seen, key, "left").agg(F.count("*").alias("live"), F.count_if(F.col("_seen").isNull()).alias("vanished"))


def factor_history(new: DataFrame, old: DataFrame, key: str = "symbol", tolerance: float = 1e-9) -> DataFrame:
    """Revised and removed steps of a factor history per key."""
    n = new.select(key, "effective_date", F.col("hfq").alias("_n"), F.lit(1).alias("_in"))
    o = old.select(key, "effective_date", F.col("hfq").alias("_o"), F.lit(1).alias("_was"))
    both = n.join(o, [key, "effective_date"], "full")
    moved = F.col("_in").isNotNull() & F.col("_was").isNotNull() & (F.abs(F.col("_n") - F.col("_o")) > tolerance * F.abs("_o"))
    return both.groupBy(key).agg(F.count_if(moved).alias("changed"), F.count_if(F.col("_in").isNull()).alias("removed")).filter(
        "changed > 0 or removed > 0")


def regressed(incoming: DataFrame, existing: DataFrame, key: str, day: str) -> DataFrame:
    """Keys whose refresh ends before what is stored."""
    a = incoming.groupBy(key).agg(F.max(day).alias("new_last"))
    b = existing.groupBy(key).agg(F.max(day).alias("old_last"))
    return a.join(b, key).filter("new_last < old_last")


def severity_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"), F.sum("affected_rows").alias("affected_rows"))


def latest_coverage(active: DataFrame, bars: DataFrame, suspended: DataFrame, day: Column, key: str = "symbol") -> DataFrame:
    """Active names with a bar on the day, suspended without one, and unexplained."""
    last = bars.groupBy(key).agg(F.max("trade_date").alias("last_bar"), F.bool_or(F.col("trade_date") == day).alias("_has"))
    rows = active.select(key).join(last, key, "left").join(suspended.select(key).distinct().withColumn("_susp", F.lit(True)), key, "left")
    return rows.select(key, "last_bar", F.coalesce("_has", F.lit(False)).alias("has_bar"), F.coalesce("_susp", F.lit(False)).alias("suspended"))


def coverage_summary(rows: DataFrame) -> DataFrame:
    with_bar, halted = F.col("has_bar"), ~F.col("has_bar") & F.col("suspended")
    base = rows.agg(F.count("*").alias("active"), F.count_if(with_bar).alias("with_bar"), F.count_if(halted).alias("suspended"),
                    F.count_if(~with_bar & ~F.col("suspended")).alias("unexplained"))
    return base.withColumn("coverage", F.col("with_bar") / F.greatest(F.col("active") - F.col("suspended"), F.lit(1)))


# Gap length classes (upper bound, label).
GAP_CLASSES = ((1, "1"), (5, "2-5"), (20, "6-20"), (60, "21-60"), (250, "61-250"))


def gap_class(sessions: Column) -> Column:
    out = F.lit(">250")
    for upper, label in reversed(GAP_CLASSES):
        out = F.when(sessions <= upper, label).otherwise(out)
    return out


def limit_breaches(bars: DataFrame, calendar: DataFrame, ratio: Column, factor_days: DataFrame, warmup: int = 5) -> DataFrame:
    """Closes beyond the limit price from one session to the next, without a factor step that day."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    rows = bars.withColumns({"prev_close": F.lag("close").over(w), "_pd": F.lag("trade_date").over(w), "_n": F.row_number().over(w)})
    sessions = calendar.withColumn("_ps", F.lag("trade_date").over(Window.orderBy("trade_date"))).select("trade_date", "_ps")
    up, down = F.floor(F.col("prev_close") * (1 + ratio) + 0.5), F.floor(F.col("prev_close") * (1 - ratio) + 0.5)
    near = rows.join(sessions, "trade_date").filter((F.col("_n") > warmup) & (F.col("_pd") == F.col("_ps")))
    out = near.filter((F.col("close") > up) | (F.col("close") < down))
    steps = factor_days.select("symbol", F.col("effective_date").alias("trade_date"))
    return out.join(steps, ["symbol", "trade_date"], "left_anti").select(
        "symbol", "trade_date", "prev_close", "close", F.round((F.col("close") / F.col("prev_close") - 1) * 100, 2).alias("pct"))


def factor_freshness(bars: DataFrame, factors: DataFrame, key: str = "symbol", as_of: str = "factor_as_of") -> DataFrame:
    last = bars.groupBy(key).agg(F.max("trade_date").alias("last_bar"))
    known = factors.groupBy(key).agg(F.max(as_of).alias(as_of))
    state = F.when(F.col(as_of).isNull(), "missing").when(F.col(as_of) < F.col("last_bar"), "stale").otherwise("ok")
    return last.join(known, key, "left").withColumn("state", state)


def symmetric_difference(a: DataFrame, b: DataFrame, on: str, left: str, right: str) -> DataFrame:
    x, y = a.select(on).distinct(), b.select(on).distinct()
    return x.join(y, on, "left_anti").withColumn("side", F.lit(left)).unionByName(
        y.join(x, on, "left_anti").withColumn("side", F.lit(right)))


def reconcile_trades(trades: DataFrame, bars: DataFrame, keys: list[str], max_gap: float = 0.02, price_gap: float = 0.0015) -> DataFrame:
    """Trades of a key and session against its bars: amounts within the gap, same last price."""
    t = trades.groupBy(*keys).agg(F.sum("amount").alias("trade_amount"), F.max_by("price", "seq").alias("trade_last"))
    b = bars.groupBy(*keys).agg(F.sum("amount").alias("bar_amount"), F.max_by("close", "time").alias("bar_last"))
    verdict = (F.when(F.col("bar_amount").isNull(), "no_bars").when(F.col("trade_amount").isNull(), "no_trades")
               .when((F.col("bar_amount") <= 0) | (F.abs(F.col("trade_amount") / F.col("bar_amount") - 1) > max_gap), "amount")
               .when(F.abs(F.col("trade_last") - F.col("bar_last")) > price_gap, "last_price").otherwise("ok"))
    return t.join(b, keys, "full").withColumn("verdict", verdict)


def band_evidence(rows: DataFrame, ppm: Column) -> DataFrame:
    """Sessions that lie beyond, or exactly at, a tight band around the reference of the session before.

    ``rows``: symbol, idx, high, low, close, reference (previous close carried over factor steps), prev_idx.
    """
    from ..functions.trading_rules import half_up
    up, down = half_up(F.col("reference"), ppm + 1000000), half_up(F.col("reference"), F.lit(1000000) - ppm)
    adjacent = rows.filter((F.col("idx") - F.col("prev_idx") == 1) & F.col("reference").isNotNull())
    return adjacent.withColumns({"beyond": (F.col("high") > up) | (F.col("low") < down),
                                 "agrees": ((F.col("close") == up) | (F.col("close") == down))
                                 & (F.col("high") <= up) & (F.col("low") >= down)})


def near_sessions(a: DataFrame, b: DataFrame, key: str, within: int = 2) -> DataFrame:
    """Rows of ``a`` without a row of ``b`` (same key and status) within some sessions.

    b is spread over its neighbouring sessions, so the match is an equi-join.
    """
    spread = b.withColumn("idx", F.explode(F.sequence(F.col("idx") - within, F.col("idx") + within))).select(key, "idx", "status").distinct()
    return a.join(spread, [key, "idx", "status"], "left_anti")


def signal_gate(counts: DataFrame, order: str, n: str, back: int = 6, tolerance: float = 0.2) -> DataFrame:
    """Signal counts against the median of the rows before; ``passes`` is null without history."""
    w = Window.orderBy(order).rowsBetween(-back, -1)  # one row per run
    typical = F.percentile(n, F.lit(0.5)).over(w)
    return counts.withColumn("typical", typical).withColumn("passes", F.abs(F.col(n) / F.col("typical") - 1) <= tolerance)


#: Fixed values of the run gates: range of the weights' sum, tolerance of the number of holdings, of signal counts, rows of their median.
WEIGHT_SUM, HOLDINGS_TOLERANCE, SIGNAL_TOLERANCE, SIGNAL_ROWS, SIGNAL_LEAST = (0.90, 1.0 + 1e-9), 0.10, 0.20, 6, 3


def run_gates(runs: DataFrame, order: str = "session", by: list[str] | None = None) -> DataFrame:
    """The five gates of every decision run and whether all are open.

    ``runs``: session, ingest_status, expected_latest, ingest_version, market_version, universe, scored, mode, confirmed, unfilled,
    weight_sum, names, wanted; one row a run.  G1: the ingest is complete and reaches the session.  G2: the market's data version is
    the ingest's.  G3: signal counts are near the median of the runs before (open without enough of them).  G4: a manual account's
    holdings were confirmed and no approved order waits.  G5: the target's weights and number of names are sound.
    """
    past = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(-SIGNAL_ROWS, -1)

    def stable(x: str) -> Column:
        usual = F.percentile(x, F.lit(0.5)).over(past)
        return (F.count(F.lit(1)).over(past) < SIGNAL_LEAST) | (usual <= 0) | (F.abs(F.col(x) - usual) / usual <= SIGNAL_TOLERANCE)

    near = (F.coalesce("wanted", F.lit(0)) == 0) | (F.abs(F.col("names") - F.col("wanted")) / F.col("wanted") <= HOLDINGS_TOLERANCE)
    gates = {
        "g1": (F.col("ingest_status") == "complete") & (F.col("expected_latest") == F.col(order)),
        "g2": (F.col("market_version") != "") & (F.col("market_version") == F.col("ingest_version")),
        "g3": stable("universe") & stable("scored"),
        "g4": (F.col("mode") != "manual") | (F.col("confirmed").isNotNull() & (F.coalesce("unfilled", F.lit(0)) == 0)),
        "g5": F.col("weight_sum").between(*WEIGHT_SUM) & near}
    closed = {name: F.coalesce(gate, F.lit(False)) for name, gate in gates.items()}
    out = runs.withColumns(closed)
    return out.withColumn("failed", F.array_join(F.filter(F.array(*[F.when(~F.col(g), F.lit(g)) for g in gates]), lambda g: g.isNotNull()), ","))
