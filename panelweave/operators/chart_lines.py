"""Trend lines and channels through swing points, for all series at once.

A line through two lows (highs) holds if no bar between them falls (rises) through it by more than a tolerance.  That is a
bound on its slope: seen from the first point, every later bar allows the line at most some slope, and the least of those so
far is a running minimum.  One window along the bars behind each anchor thus decides all lines from it, and only lines that
hold are followed to the bar that breaks them.  Anchors are the last ``candidates`` points of a kind, so a series has a bounded
number of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .series import with_atr

#: Anchors of a kind, least bars between anchors, steepest slope a bar, tolerance in ranges, bars a broken line stays.
CANDIDATES, LEAST_SPAN, STEEPEST, TOLERANCE, STALE, LEAST_BARS = 8, 3, 0.03, 0.5, 20, 10


def trend_lines(bars: DataFrame, pivots: DataFrame, candidates: int = CANDIDATES, key: str = "symbol", order: str = "trade_date") -> DataFrame:
    """The best rising line under the lows and the best falling line over the highs of each series.

    ``pivots``: key, pos, price, kind (H, L), confirmed.  The score adds two for each touch, the span as a share of the
    series, two if unbroken, and how recent the end is; ties go to the earlier anchors.  A broken line ends at the first
    close beyond it and is left out when that is long ago.  ``channel_offset`` is the distance to the parallel that holds
    the bars on the other side, null if they never leave the tolerance.
    """
    whole = Window.partitionBy(key)
    rows = with_atr(bars, key=key, order=order).select(
        key, (F.row_number().over(whole.orderBy(order)) - 1).alias("pos"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], "atr")
    size = rows.groupBy(key).agg(F.count("*").alias("n"), (TOLERANCE * F.max_by("atr", "pos")).alias("tol")).filter(F.col("n") >= LEAST_BARS)
    newest = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.desc("pos")))
    anchors = pivots.filter("confirmed").withColumn("_p", newest).filter(F.col("_p") <= candidates).join(size, key).select(
        key, "kind", F.when(F.col("kind") == "L", 1).otherwise(-1).alias("side"), F.col("pos").cast("int").alias("i1"), F.col("price").alias("p1"), "n", "tol")

    s, run = F.col("side"), F.col("pos") - F.col("i1")
    edge = F.when(F.col("kind") == "L", F.col("low")).otherwise(F.col("high"))
    path = anchors.join(rows, key).filter(F.col("pos") > F.col("i1")).withColumns({
        "_bar": F.try_divide(s * (edge - F.col("p1")) + F.col("tol"), run), "_close": F.try_divide(s * (F.col("close") - F.col("p1")) + F.col("tol"), run)})
    upto = Window.partitionBy(key, "kind", "i1").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("_most", F.min("_bar").over(upto))

    second = anchors.select(key, "kind", F.col("i1").alias("pos"), F.col("p1").alias("p2"))
    lines = path.join(second, [key, "kind", "pos"]).withColumnRenamed("pos", "i2")
    rise = s * (F.col("p2") - F.col("p1"))
    lines = lines.withColumn("slope", F.try_divide(F.col("p2") - F.col("p1"), F.col("i2") - F.col("i1"))).filter(
        (F.col("i2") - F.col("i1") >= LEAST_SPAN) & (rise > 0) & (s * F.col("slope") <= F.col("_most")) & (s * F.col("slope") <= STEEPEST * F.col("p1")))
    lines = lines.select(key, "kind", "side", "i1", "p1", "i2", "p2", "slope", "n", "tol")

    own = [key, "kind", "i1", "i2"]
    breaks = lines.select(*own, "side", "slope").join(path.select(key, "kind", "i1", "pos", "_close"), [key, "kind", "i1"]).filter(
        (F.col("pos") > F.col("i2")) & (F.col("_close") < s * F.col("slope"))).groupBy(*own).agg(F.min("pos").alias("_broken"))
    lines = lines.join(breaks, own, "left").withColumns({
        "broken": F.col("_broken").isNotNull(), "end_pos": F.coalesce(F.col("_broken"), F.col("n") - 1).cast("int")})
    points = anchors.select(key, "kind", F.col("i1").alias("_at"), F.col("p1").alias("_price"))
    on_line = F.abs(F.col("_price") - (F.col("p1") + F.col("slope") * (F.col("_at") - F.col("i1")))) <= F.col("tol")
    touches = lines.join(points, [key, "kind"]).filter(F.col("_at").between(F.col("i1"), F.col("end_pos")) & on_line).groupBy(*own).agg(F.count("*").alias("touches"))
    lines = lines.join(touches, own)
    recency = F.when(F.col("broken"), 1 - (F.col("n") - 1 - F.col("end_pos")) / F.col("n")).otherwise(1.0)
    score = F.col("touches") * 2 + (F.col("i2") - F.col("i1")) / F.col("n") + F.when(F.col("broken"), 0).otherwise(2) + recency
    lines = lines.withColumn("score", F.round(score, 3))
    place = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.desc("score"), "i1", "i2"))
    best = lines.withColumn("_p", place).filter(F.col("_p") == 1).filter(~F.col("broken") | (F.col("n") - 1 - F.col("end_pos") <= STALE))

    other = F.when(F.col("kind") == "L", F.col("high")).otherwise(F.col("low"))
    gap = s * (other - (F.col("p1") + F.col("slope") * (F.col("pos") - F.col("i1"))))
    kept = [key, "kind", "side", "i1", "p1", "i2", "p2", "touches", "broken", "end_pos", "score", "tol"]
    wide = best.select(*kept, "slope").join(rows.select(key, "pos", "high", "low"), key).filter(F.col("pos").between(F.col("i1"), F.col("end_pos"))).groupBy(*kept).agg(
        F.max(gap).alias("_offset"))
    return wide.select(*[c for c in kept if c not in ("side", "tol", "kind")], F.when(F.col("kind") == "L", "up").otherwise("down").alias("kind"),
                       F.when(F.col("_offset") > F.col("tol"), s * F.col("_offset")).alias("channel_offset"))
