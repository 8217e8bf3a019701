"""Cross-sectional processing: every step works inside one (factor, session) group.

All windows below are partitioned by the group or by the group plus a finer key,
which the same hash partitioning serves, so a whole chain costs one shuffle.
A group holds one value per security: its size is the number of securities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# MAD scale for normal data, rounding noise treated as a zero residual.
MAD_SCALE, RESIDUAL_TOLERANCE = 1.4826, 1e-10


def group(by: list[str]):
    return Window.partitionBy(*by)


def winsorize(df: DataFrame, by: list[str], x: str, k: float = 3.0, out: str = "x") -> DataFrame:
    """Clip at median ± k scaled MADs; at the 1st and 99th percentile where the MAD is zero."""
    w = group(by)
    df = df.withColumn("_q", F.percentile(x, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).over(w))
    median = F.col("_q")[1]
    df = df.withColumn("_mad", F.percentile(F.abs(F.col(x) - median), F.lit(0.5)).over(w) * MAD_SCALE)
    low = F.when(F.col("_mad") > 0, median - k * F.col("_mad")).otherwise(F.col("_q")[0])
    high = F.when(F.col("_mad") > 0, median + k * F.col("_mad")).otherwise(F.col("_q")[2])
    return df.withColumn(out, F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), low), high))).drop("_q", "_mad")


def neutralize(df: DataFrame, by: list[str], x: str, industry: str | None, size: str | None,
               out: str = "residual") -> DataFrame:
    """Residual of x on industry dummies and ln size.

    Both variables are demeaned within the industry; one slope per group is then
    the full regression (Frisch-Waugh), so no matrix is formed.
    """
    inside = group([*by, industry]) if industry else group(by)
    whole = group(by)
    df = df.withColumn("_x", F.col(x) - F.avg(x).over(inside))
    if size:
        df = df.withColumn("_s", F.col(size) - F.avg(size).over(inside))
        slope = F.try_divide(F.sum(F.col("_x") * F.col("_s")).over(whole), F.sum(F.col("_s") * F.col("_s")).over(whole))
        df = df.withColumn("_x", F.col("_x") - F.coalesce(slope, F.lit(0.0)) * F.col("_s")).drop("_s")
    noise = F.abs("_x") <= RESIDUAL_TOLERANCE * F.max(F.abs(x)).over(whole)
    return df.withColumn(out, F.when(noise, 0.0).otherwise(F.col("_x"))).drop("_x")


def zscore(df: DataFrame, by: list[str], x: str, out: str = "z", direction: str | None = None,
           min_names: int = 1) -> DataFrame:
    w = group(by)
    spread = F.stddev_pop(x).over(w)
    z = F.when(spread > 0, (F.col(x) - F.avg(x).over(w)) / spread).otherwise(0.0)
    sign = F.col(direction) if direction else F.lit(1)
    return df.withColumn(out, F.when((F.count(x).over(w) >= min_names) & F.col(x).isNotNull(), sign * z))


def weighted_zscore(df: DataFrame, by: list[str], x: str, weight: str, out: str = "z") -> DataFrame:
    """z-score with the weighted mean and spread (at least ten names, else zero)."""
    w = group(by)
    wt = F.when(F.col(x).isNotNull(), F.col(weight))
    mean = F.sum(wt * F.col(x)).over(w) / F.sum(wt).over(w)
    df = df.withColumn("_m", mean)
    spread = F.sqrt(F.sum(wt * (F.col(x) - F.col("_m")) * (F.col(x) - F.col("_m"))).over(w) / F.sum(wt).over(w))
    z = F.when((spread > 0) & (F.count(x).over(w) >= 10), (F.col(x) - F.col("_m")) / spread)
    return df.withColumn(out, F.coalesce(z, F.lit(0.0))).drop("_m")


def process(df: DataFrame, by: list[str], raw: str, industry: str, size: str, direction: str, by_size: str,
            k: float = 3.0, min_names: int = 30) -> DataFrame:
    """Winsorise, neutralise and standardise; ``by_size`` says whether a factor is size-neutral.

    Rows missing the size they need do not take part.
    """
    rows = df.filter(F.col(raw).isNotNull() & (~F.col(by_size) | F.col(size).isNotNull()))
    rows = winsorize(rows, by, raw, k)
    rows = rows.withColumn("_size", F.when(F.col(by_size), F.col(size)).otherwise(0.0))
    rows = neutralize(rows, by, "x", industry, "_size")
    return zscore(rows, by, "residual", "z", direction, min_names).filter("z is not null").drop("x", "residual", "_size")


def pct_rank(x: str, by: list[str]) -> Column:
    """Average-tie percentile rank in (0, 1] of the non-null values of a group."""
    present = F.col(x).isNotNull()
    ordered = Window.partitionBy(*by, present).orderBy(x)
    ties = Window.partitionBy(*by, x)
    return F.when(present, (F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2) / F.count(x).over(group(by)))


def universe(df: DataFrame, steps: dict[str, Column], turnover: str, cap: str, size: int, weight: float = 0.5,
             by: str = "idx", key: str = "symbol") -> DataFrame:
    """Flags of the eligible names after each step and the ``size`` best by mixed rank.

    Adds ``after_<step>`` flags, ``score`` (eligible names only) and ``in_universe``.
    """
    eligible = F.lit(True)
    for name, condition in steps.items():
        eligible = eligible & F.coalesce(condition, F.lit(False))
        df = df.withColumn(f"after_{name}", eligible)
    last = f"after_{list(steps)[-1]}"
    df = df.withColumns({"_t": F.when(F.col(last), F.col(turnover)), "_c": F.when(F.col(last), F.col(cap))})
    df = df.withColumn("score", weight * pct_rank("_t", [by]) + (1 - weight) * pct_rank("_c", [by]))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("score"), key))
    return df.withColumn("in_universe", F.col(last) & (place <= size)).drop("_t", "_c")


def universe_counts(flags: DataFrame, by: str = "idx") -> DataFrame:
    names = [c for c in flags.columns if c.startswith("after_")]
    return flags.groupBy(by).agg(*[F.count_if(F.col(n)).alias(n) for n in names],
                                 F.count_if("in_universe").alias("universe"))


def top_n(df: DataFrame, by: list[str], score: str, n: int, key: str = "symbol", weight: str = "weight") -> DataFrame:
    """The n best per group (ties by key) with equal weights and their place."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    picked = df.filter(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return picked.withColumn(weight, F.lit(1.0) / F.count("*").over(group(by)))


def family_scores(z: DataFrame, families: DataFrame) -> DataFrame:
    """Mean of a family's factors per name; ``families`` is a small (factor, family) table."""
    return z.join(families, "factor").groupBy("idx", "symbol", "family").agg(F.avg("z").alias("score"))


def composite(scores: DataFrame, n_families: int, min_families: int) -> DataFrame:
    """Sum of the family scores over all families, for names with enough of them.

    Rounded to 12 digits so that summation noise never decides a rank.
    """
    return (scores.groupBy("idx", "symbol").agg(F.round(F.sum("score") / n_families, 12).alias("score"),
                                                F.count("score").alias("families"))
            .filter(F.col("families") >= min(min_families, n_families)))


def trailing_ic_weights(ic: DataFrame, schedule: DataFrame, lookback: int = 24, min_periods: int = 12) -> DataFrame:
    """Per rebalance row, the positive mean of the rank ICs known by then (the last ``lookback`` of them).

    ``ic``: factor, idx, known_at, ic (null where not evaluable).  Rows become
    known in row order, so the known rows of a target are the ``lookback`` rows
    up to the last one whose window has closed: a row range, not a pair of all rows.
    """
    periods = ic.select("idx", "known_at").distinct().filter("known_at is not null")
    order = Window.orderBy("idx")  # one row per rebalance date
    numbered = periods.withColumn("n", F.row_number().over(order))
    marks = numbered.select(F.col("known_at").alias("t"), F.col("n"), F.lit(0).alias("kind"))
    probes = schedule.select(F.col("idx").alias("t"), F.lit(None).cast("int").alias("n"), F.lit(1).alias("kind"))
    upto = Window.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    targets = (marks.unionByName(probes).withColumn("known", F.max("n").over(upto)).filter("kind = 1")
               .filter(F.col("known") >= min_periods)
               .select(F.col("t").alias("target"), F.explode(F.sequence(
                   F.greatest(F.lit(1), F.col("known") - (lookback - 1)), F.col("known"))).alias("n")))
    used = targets.join(numbered, "n").join(ic.select("factor", "idx", "ic"), "idx")
    return (used.groupBy(F.col("target").alias("idx"), "factor").agg(F.avg("ic").alias("weight"))
            .filter("weight > 0"))
