"""As-of joins and other last-value-so-far operators.

The rows of one key may be far too many for one task.  ``bucket`` splits a key
by time: rows meet inside (key, bucket), and the state a bucket starts from
comes from one pre-aggregated row per earlier bucket.  Without ``bucket`` a
key's rows form one window partition, which is right for daily series whose
length is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def time_bucket(column: str, bucket: str) -> Column:
    """Start of the ``bucket`` (day, week, month, quarter, year, hour, …) a time falls in."""
    return F.date_trunc(bucket, F.col(column).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str],
              tie: list[str] | None = None, strict: bool = False, keep_time: bool = False,
              bucket: str | None = None) -> DataFrame:
    """Left rows with ``values`` of the latest right row at or before ``left_on``.

    ``strict`` asks for a right time strictly before.  ``tie`` orders right rows
    of equal time (the last wins).  ``keep_time`` also returns ``right_on``.
    """
    kept = ([right_on] if keep_time else []) + values
    ties = tie or []
    right_row = F.struct(*[F.col(c) for c in kept])
    events = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_kind"),
        F.struct(*[F.col(c) for c in ties], *[F.col(c) for c in kept]).alias("_tie"), right_row.alias("_state"))
    left_row = F.struct(*[F.col(c) for c in left.columns if c not in by])
    probes = left.select(*by, F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_kind"),
                         left_row.alias("_left"))
    rows = events.unionByName(probes, allowMissingColumns=True)
    keys = list(by)
    if bucket:
        rows = rows.withColumn("_b", time_bucket("_t", bucket))
        keys = [*by, "_b"]
    so_far = (Window.partitionBy(*keys).orderBy("_t", "_kind", "_tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("_found", F.last("_state", ignorenulls=True).over(so_far)).filter("_left is not null")
    if bucket:
        closing = (rows.groupBy(*keys).agg(F.max_by("_state", F.when(F.col("_state").isNotNull(),
                                                                     F.struct("_t", "_tie"))).alias("_closing")))
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        opening = closing.select(*keys, F.last("_closing", ignorenulls=True).over(earlier).alias("_opening"))
        found = found.join(opening.filter("_opening is not null"), keys, "left").withColumn(
            "_found", F.coalesce("_found", "_opening"))
    return found.select(*by, *[F.col(f"_left.{c}").alias(c) for c in left.columns if c not in by],
                        *[F.col(f"_found.{c}").alias(c) for c in kept])


# Fixed value: rows that are sent to every task of a join.
FEW = 50_000


def sent_if_few(df: DataFrame) -> DataFrame:
    """``df``, counted first, sent whole to every task of a join if it is small: the other side, often with few keys, stays where it is."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def running_sum(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], bucket: str,
                bucket_of: str) -> DataFrame:
    """Running totals per key, split by time bucket so that a hot key spreads over tasks.

    ``sums`` maps output name to input column; ``order`` must be unique within a key.
    """
    rows = df.withColumn("_b", time_bucket(bucket_of, bucket))
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_total_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_total_{n}").over(earlier), F.lit(0)).alias(f"_open_{n}")
                                         for n in sums])
    within = (Window.partitionBy(*by, "_b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for name, column in sums.items():
        rows = rows.withColumn(f"_in_{name}", F.coalesce(F.sum(column).over(within), F.lit(0)))
    joined = rows.join(opening, [*by, "_b"])
    return joined.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_open_{n}")).alias(n) for n in sums])


def next_session(events: DataFrame, calendar: DataFrame, day: str, inclusive: bool, out: str = "eff") -> DataFrame:
    """Index of the first session on (``inclusive``) or after ``day``; null past the calendar.

    Distinct days are resolved once against the calendar, then joined back, so
    the events themselves are not sorted.
    """
    days = events.select(F.col(day).alias("_day")).filter("_day is not null").distinct()
    marks = calendar.select(F.col("trade_date").alias("_day"), F.col("idx").alias("_idx"))
    merged = marks.withColumn("_probe", F.lit(False)).unionByName(
        days.withColumn("_probe", F.lit(True)), allowMissingColumns=True)
    # Sessions come after a probe of the same day when that day itself counts.
    rank = F.when(F.col("_probe") == F.lit(inclusive), 0).otherwise(1)
    # One row per distinct day: as small as the calendar, whatever the number of events.
    ahead = Window.orderBy("_day", rank).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lookup = (merged.withColumn(out, F.first("_idx", ignorenulls=True).over(ahead)).filter("_probe")
              .select("_day", out))
    return events.join(lookup, events[day] == lookup["_day"], "left").drop("_day")


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], on: str, start: str, end: str,
                  values: list[str], order: list[str] | None = None, bucket: str = "year", how: str = "left",
                  overlapping: bool = False) -> DataFrame:
    """Points with the values of the interval ``[start, end)`` that holds them (open end = null).

    Intervals are cut at bucket borders and meet the points on (key, bucket), so
    no key is compared with all of its intervals.  With ``overlapping`` the last
    interval by ``order`` then start wins; points must then be unique.
    """
    unit = {"month": "1 month", "quarter": "3 month", "year": "1 year"}[bucket]
    # Open intervals are cut after the last point, which bounds their pieces.
    after_last = points.agg(F.date_add(F.max(on), 1)).scalar()
    spans = intervals.withColumn("_stop", F.least(F.coalesce(F.col(end), after_last), after_last)).filter(
        F.col(start) < F.col("_stop"))
    pieces = spans.select(
        *by, F.col(start).alias("_start"), F.col("_stop"),
        F.struct(*[F.col(c).alias(f"_o_{c}") for c in (order or [])], F.col(start).alias("_o_start"),
                 *[F.col(c) for c in values]).alias("_row"),
        F.explode(F.sequence(F.to_date(F.date_trunc(bucket, F.col(start))),
                             F.to_date(F.date_trunc(bucket, F.date_sub("_stop", 1))),
                             F.expr(f"interval {unit}"))).alias("_b")).alias("s")
    tagged = points.withColumn("_b", F.to_date(F.date_trunc(bucket, F.col(on)))).alias("p")
    condition = (F.col("p._b") == F.col("s._b")) & (F.col(f"p.{on}") >= F.col("s._start")) & (
        F.col(f"p.{on}") < F.col("s._stop"))
    for c in by:
        condition = condition & (F.col(f"p.{c}") == F.col(f"s.{c}"))
    kept = [F.col(f"p.{c}").alias(c) for c in points.columns]
    hits = tagged.join(pieces, condition, how).select(*kept, F.col("s._row").alias("_row"))
    if overlapping:
        hits = hits.groupBy(*points.columns).agg(F.max("_row").alias("_row"))
    return hits.select(*points.columns, *[F.col(f"_row.{c}").alias(c) for c in values])
