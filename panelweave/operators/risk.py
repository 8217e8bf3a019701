"""Exposures, attribution and the cross-sectional risk model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

HORIZON_DAYS = 21  # fixed value: sessions in the risk horizon


def style_exposures(weights: DataFrame, z: DataFrame) -> DataFrame:
    """Weighted style z of the holdings less the universe mean; ``z``: idx, symbol, factor, z (universe)."""
    rows = z.join(weights.select("idx", "symbol", "weight"), ["idx", "symbol"], "left")
    return rows.groupBy("idx", "factor").agg(
        (F.sum(F.col("weight") * F.col("z")) / F.sum(F.when(F.col("z").isNotNull(), F.col("weight"))) - F.avg("z")
         ).alias("exposure"))


def industry_active(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Portfolio and benchmark (equal-weight universe) share per industry."""
    rows = universe.select("idx", "symbol", "industry").join(weights.select("idx", "symbol", "weight"),
                                                             ["idx", "symbol"], "left")
    size = F.count("*").over(Window.partitionBy("idx"))
    return (rows.withColumn("_b", 1.0 / size).groupBy("idx", "industry")
            .agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("portfolio"), F.sum("_b").alias("benchmark"))
            .withColumn("active", F.col("portfolio") - F.col("benchmark")))


def concentration(weights: DataFrame, prices: DataFrame, low_price: float) -> DataFrame:
    held = weights.filter("weight > 0").join(prices, ["idx", "symbol"], "left")
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("weight"), "symbol"))
    return held.withColumn("_p", place).groupBy("idx").agg(
        F.count("*").alias("names"), F.sum("weight").alias("invested"),
        F.sum(F.when(F.col("_p") <= 10, F.col("weight"))).alias("top10"),
        (1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_n"),
        (F.sum(F.when(F.coalesce("close", F.lit(0)) < low_price, F.col("weight")).otherwise(0.0)) / F.sum("weight")
         ).alias("low_price_weight"))


def brinson(rows: DataFrame) -> DataFrame:
    """Allocation and selection per session; ``rows``: idx, symbol, industry, weight, member, fwd.

    Names without a return drop out and both books are rescaled; an industry a
    book does not hold earns the benchmark's return there.
    """
    live = rows.filter("fwd is not null").withColumns({
        "_w": F.coalesce("weight", F.lit(0.0)), "_b": F.col("member").cast("double")})
    per = live.groupBy("idx", "industry").agg(
        F.sum("_w").alias("w"), F.sum("_b").alias("b"), F.sum(F.col("_w") * F.col("fwd")).alias("wr"),
        F.sum(F.col("_b") * F.col("fwd")).alias("br"))
    whole = Window.partitionBy("idx")
    per = per.withColumns({"_W": F.sum("w").over(whole), "_B": F.sum("b").over(whole)}).filter("_W > 0 and _B > 0")
    per = per.withColumn("_tb", F.sum("br").over(whole) / F.col("_B"))
    wp, wb = F.col("w") / F.col("_W"), F.col("b") / F.col("_B")
    rb = F.when(F.col("b") > 0, F.col("br") / F.col("b")).otherwise(F.col("_tb"))
    rp = F.when(F.col("w") > 0, F.col("wr") / F.col("w")).otherwise(rb)
    return per.filter("w > 0 or b > 0").groupBy("idx").agg(
        F.sum(F.col("wr") / F.col("_W")).alias("portfolio"), F.first("_tb").alias("benchmark"),
        F.sum((wp - wb) * (rb - F.col("_tb"))).alias("allocation"), F.sum(wp * (rp - rb)).alias("selection"))


def factor_returns(rows: DataFrame, names: list[str], by: str = "idx", extra: int = 10) -> DataFrame:
    """Weighted least squares of ``ret`` on the exposure columns, one regression per session.

    Each session is reduced to the sums of its normal equations by a plain
    aggregation; only those k×k sums reach Python, whatever the number of names.
    """
    r = F.least(F.greatest("ret", F.lit(-0.25)), F.lit(0.25))
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs]
    sums += [F.sum(F.col("w") * F.col(n) * r) for n in names]
    normal = rows.filter("ret is not null").groupBy(by).agg(F.count("*").alias("n"), F.array(*sums).alias("s")).filter(
        F.col("n") >= k + extra)

    def solve(batches):
        for pdf in batches:
            out = []
            for s in pdf["s"]:
                a, b = np.zeros((k, k)), np.asarray(s[len(pairs):])
                for v, (i, j) in zip(s, pairs):
                    a[i, j] = a[j, i] = v
                used = np.flatnonzero(np.diag(a) > 0)
                beta = np.zeros(k)
                beta[used] = np.linalg.lstsq(a[np.ix_(used, used)], b[used], rcond=None)[0]
                out.append(beta)
            yield pd.concat([pdf[[by, "n"]], pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)

    return normal.mapInPandas(solve, f"{by} long, n long, " + ", ".join(f"{n} double" for n in names))


def residuals(rows: DataFrame, betas: DataFrame, names: list[str], by: str = "idx") -> DataFrame:
    r = F.least(F.greatest("ret", F.lit(-0.25)), F.lit(0.25))
    fitted = rows.filter("ret is not null").alias("x").join(betas.alias("b"), by)
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(f"x.{n}") * F.col(f"b.{n}")
    return fitted.select(by, "x.symbol", (r - total).alias("residual"))


def ewma_covariance(series: DataFrame, names: list[str], half_life: float, order: str = "idx",
                    horizon: int = HORIZON_DAYS) -> DataFrame:
    """Exponentially weighted covariance of the named columns at the last row, in long form.

    One pass of weighted sums; ``series`` has one row per session.
    """
    complete = series.dropna(subset=names)
    age = F.row_number().over(Window.orderBy(F.desc(order))) - 1
    rows = complete.withColumn("_w", F.pow(F.lit(0.5), age / half_life))
    w = F.sum("_w")
    cells = []
    for i, a in enumerate(names):
        for b in names[i:]:
            ab, ma, mb = (F.sum(F.col("_w") * x) for x in (F.col(a) * F.col(b), F.col(a), F.col(b)))
            cells.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"),
                                  ((ab / w - (ma / w) * (mb / w)) * horizon).alias("cov")))
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def specific_variance(residual: DataFrame, caps: DataFrame, at: int, half_life: float, shrink: float, least: int,
                      horizon: int = HORIZON_DAYS) -> DataFrame:
    """EWMA of squared residuals per name, shrunk to the median of its size decile, floored at the 5 % quantile."""
    w = F.pow(F.lit(0.5), (F.lit(at) - F.col("idx")) / half_life)
    raw = residual.filter(F.col("idx") <= at).groupBy("symbol").agg(
        (F.sum(w * F.col("residual") * F.col("residual")) / F.sum(w)).alias("raw"), F.count("*").alias("n"))
    rows = caps.join(raw, "symbol", "left").withColumn("_l", F.log(F.when(F.col("cap") > 0, F.col("cap"))))
    whole = Window.partitionBy()  # one row per name at one session
    edges = F.percentile("_l", F.array(*[F.lit(i / 10) for i in range(1, 10)])).over(whole)
    rows = rows.withColumn("_e", edges)
    rows = rows.withColumn("decile", F.size(F.filter("_e", lambda e: e <= F.coalesce(F.col("_l"), F.lit(0.0)))))
    rows = rows.withColumns({"_d": F.percentile("raw", F.lit(0.5)).over(Window.partitionBy("decile")),
                             "_m": F.percentile("raw", F.lit(0.5)).over(whole)})
    prior = F.coalesce("_d", "_m")
    count = F.coalesce("n", F.lit(0))
    mix = count / (count + shrink)
    blended = F.when(F.col("raw").isNotNull() & (count >= least), mix * F.col("raw") + (1 - mix) * prior).otherwise(prior)
    rows = rows.withColumn("_x", blended).withColumn("_f", F.percentile("_x", F.lit(0.05)).over(whole))
    return rows.select("symbol", "decile", "n", (F.greatest(F.coalesce("_x", "_f"), F.col("_f")) * horizon).alias("variance"))
