"""Validity intervals: suspensions, status histories, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .asof import asof_join
from .windows import islands


def first_after(events: DataFrame, days: DataFrame, by: list[str], on: str, day: str, out: str,
                bucket: str | None = None) -> DataFrame:
    """Each event with the first ``day`` of its key strictly after ``on`` (an as-of join run backwards).

    Each distinct (key, ``on``) is resolved once and joined back, so many events of one key do not meet in one task.
    """
    back = lambda c: F.date_sub(F.lit("2200-01-01").cast("date"), F.datediff(c, F.lit("1970-01-01")))
    probes = events.select(*by, on).distinct()
    left = probes.withColumn("_m", back(F.col(on)))
    right = days.select(*by, back(F.col(day)).alias("_d"), F.col(day).alias(out)).distinct()
    found = asof_join(left, right, by, "_m", "_d", [out], strict=True, bucket=bucket).drop("_m")
    return events.join(found, [*by, on], "left").select(*events.columns, out)


def suspension_spans(events: DataFrame, bars: DataFrame, calendar: DataFrame, key: str = "symbol") -> DataFrame:
    """Ends of open suspensions: the last session before the first bar after their start."""
    resumed = first_after(events, bars, [key], "start_date", "trade_date", "resume_date")
    w = Window.orderBy("trade_date")  # one row per session
    previous = calendar.select(F.col("trade_date").alias("resume_date"), F.lag("trade_date").over(w).alias("_prev"))
    rows = resumed.join(previous, "resume_date", "left")
    inferred = F.col("end_date").isNull() & F.col("resume_date").isNotNull()
    return rows.withColumns({"end_inferred": inferred, "end_date": F.coalesce(
        "end_date", F.when(F.col("resume_date").isNotNull(), F.greatest("start_date", "_prev")))}).drop("_prev")


def status_intervals(changes: DataFrame, key: str = "symbol", day: str = "day", status: str = "status",
                     old: str = "old_status") -> DataFrame:
    """Dated changes as intervals: the state before the first change has no known start.

    Spells without a status are dropped, equal neighbours merged; the last one stays open.
    """
    w = Window.partitionBy(key).orderBy(day)
    head = changes.groupBy(key).agg(F.min_by(old, day).alias(status)).select(
        key, F.lit(None).cast("date").alias(day), status)
    segments = head.unionByName(changes.select(key, day, status))
    runs = islands(segments.withColumn("_o", F.coalesce(F.col(day), F.lit("0001-01-01").cast("date"))), [key], "_o", status)
    merged = runs.groupBy(key, "run", status).agg(F.min_by(day, "_o").alias("start_date"), F.min("_o").alias("_o"))
    ends = merged.withColumn("end_date", F.lead("_o").over(Window.partitionBy(key).orderBy("_o")))
    return ends.filter(F.col(status).isNotNull()).select(key, status, "start_date", "end_date")


def valid_on(intervals: DataFrame, day: Column, by: list[str], values: list[str], start: str = "start_date",
             end: str = "end_date") -> DataFrame:
    """The interval in force on one day (inclusive end), the latest start first."""
    hit = intervals.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day)))
    return hit.groupBy(*by).agg(F.max_by(F.struct(*values), start).alias("_r")).select(*by, "_r.*")


def gaps(bars: DataFrame, calendar: DataFrame, bounds: DataFrame, key: str = "symbol") -> DataFrame:
    """Runs of missing sessions inside each key's window, marked head, tail or internal.

    ``bounds``: key, win_start, win_end.  Only the sessions between two bars need
    a look: consecutive bars give the gap between them directly, so no
    calendar × key grid is built.
    """
    idx = calendar.select("trade_date", "idx")
    from .asof import next_session
    limits = next_session(bounds, calendar, "win_end", inclusive=False, out="_after")
    last = idx.agg(F.max("idx")).scalar()
    limits = limits.withColumn("_e", F.coalesce(F.col("_after") - 1, last)).drop("_after")
    limits = next_session(limits, calendar, "win_start", inclusive=True, out="_s").filter("_s <= _e")
    inside = bars.select(key, "trade_date").distinct().join(idx, "trade_date").join(limits, key).filter(
        F.col("idx").between(F.col("_s"), F.col("_e")))
    edge = limits.select(key, "_s", "_e", (F.col("_s") - 1).alias("idx")).unionByName(
        limits.select(key, "_s", "_e", (F.col("_e") + 1).alias("idx")))
    points = inside.select(key, "_s", "_e", "idx").unionByName(edge)
    w = Window.partitionBy(key).orderBy("idx")
    found = points.withColumn("_p", F.lag("idx").over(w)).filter(F.col("idx") - F.col("_p") > 1)
    runs = found.select(key, (F.col("_p") + 1).alias("i0"), (F.col("idx") - 1).alias("i1"), "_s", "_e").withColumns({
        "sessions": F.col("i1") - F.col("i0") + 1,
        "position": F.when(F.col("i0") == F.col("_s"), "head").when(F.col("i1") == F.col("_e"), "tail").otherwise("internal")})
    d0, d1 = (calendar.select(F.col("idx").alias(i), F.col("trade_date").alias(n)) for i, n in (("i0", "gap_start"), ("i1", "gap_end")))
    return runs.join(d0, "i0").join(d1, "i1").select(key, "gap_start", "gap_end", "sessions", "position")


def explained_by(gap_rows: DataFrame, intervals: DataFrame, last_day: Column, key: str = "symbol", source: str = "source") -> DataFrame:
    """Names of the sources whose intervals overlap a gap, sorted and joined by commas.

    Both sides are cut by year and meet on (key, year); open intervals reach to ``last_day``.
    """
    def years(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("_y", F.explode(F.sequence(F.year(start), F.year(end))))

    closed = intervals.withColumn("_end", F.coalesce(F.col("end_date"), last_day)).filter(F.col("start_date") <= F.col("_end"))
    g, s = years(gap_rows, "gap_start", "gap_end").alias("g"), years(closed, "start_date", "_end").alias("s")
    overlap = ((F.col(f"g.{key}") == F.col(f"s.{key}")) & (F.col("g._y") == F.col("s._y"))
               & (F.col("s.start_date") <= F.col("g.gap_end")) & (F.col("s._end") >= F.col("g.gap_start")))
    joined = g.join(s, overlap, "left").groupBy(*[F.col(f"g.{c}").alias(c) for c in gap_rows.columns]).agg(
        F.array_join(F.array_sort(F.collect_set(f"s.{source}")), ",").alias("explained_by"))
    return joined.withColumn("explained_by", F.when(F.col("explained_by") != "", F.col("explained_by")))


def reconcile(intervals: DataFrame, evidence: DataFrame, least: int, key: str = "symbol") -> DataFrame:
    """Intervals against dated price evidence (``beyond`` = outside the tight band).

    No contrary session: kept.  Contrary sessions only before / after the first /
    last agreeing one: trimmed to them.  Nothing agreeing: dropped.  In between:
    split around the contrary run when it has at least ``least`` sessions.
    """
    from .asof import interval_join
    numbered = intervals.withColumn("interval_start", F.col("start_date"))
    hits = interval_join(evidence, numbered, [key], "trade_date", "start_date", "end_date",
                         ["interval_start"]).filter("interval_start is not null")
    per = hits.groupBy(key, "interval_start").agg(
        F.count_if("beyond").alias("contrary"), F.min(F.when(F.col("agrees"), F.col("trade_date"))).alias("first_ok"),
        F.max(F.when(F.col("agrees"), F.col("trade_date"))).alias("last_ok"),
        F.min(F.when(F.col("beyond"), F.col("trade_date"))).alias("first_bad"), F.max(F.when(F.col("beyond"), F.col("trade_date"))).alias("last_bad"))
    rows = intervals.join(per, (intervals[key] == per[key]) & (intervals["start_date"] == per["interval_start"]), "left").select(
        intervals["*"], "contrary", "first_ok", "last_ok", "first_bad", "last_bad")
    some = F.coalesce(F.col("contrary"), F.lit(0)) > 0
    action = (F.when(~some, "keep").when(F.col("first_ok").isNull(), "drop").when(F.col("last_bad") < F.col("first_ok"), "trim_start")
              .when(F.col("first_bad") > F.col("last_ok"), "trim_end").when(F.col("contrary") >= least, "split").otherwise("keep"))
    s, e = F.col("start_date"), F.col("end_date")
    piece = lambda a, b: F.struct(a.alias("new_start"), b.alias("new_end"))
    pieces = (F.when(F.col("action") == "keep", F.array(piece(s, e)))
              .when(F.col("action") == "trim_start", F.array(piece(F.date_add("last_bad", 1), e)))
              .when(F.col("action") == "trim_end", F.array(piece(s, F.col("first_bad"))))
              .when(F.col("action") == "split", F.array(piece(s, F.col("first_bad")), piece(F.date_add("last_bad", 1), e)))
              .otherwise(F.array().cast("array<struct<new_start:date,new_end:date>>")))
    return rows.withColumn("action", action).withColumn("_p", F.explode_outer(pieces)).select(
        key, "start_date", "end_date", "action", "_p.new_start", "_p.new_end")


#: Statuses that prices can speak for, and the support days of a side that count as more than coincidence.
RISK_STATUSES, STRONG = ("ST", "*ST"), 3


def settle(intervals: DataFrame, evidence: DataFrame, calendar: DataFrame, data_start: Column, strong: int = STRONG, key: str = "symbol") -> DataFrame:
    """Risk intervals made to agree with dated price evidence.

    ``intervals``: key, status, start_date (unique with the key), end_date (open: null), low (null, or the day after which an
    uncertain start may lie); ``evidence``: key, trade_date, beyond (traded outside the tight band), at_limit (closed on
    it).  Support is a close on the limit of a day that stays inside the band.

    An uncertain start is moved back to the session after the last break since ``low`` (without one, to the first session
    after ``low``, at the earliest ``data_start``) if support lies between.  Breaks inside then decide by the support on their
    two sides: strong on both, split around them; on the later side, the start moves behind them; on the earlier one, the
    end moves to them; on neither, by the larger number; without any, the interval is dropped.  ``action`` is what was
    done, null for nothing; a split interval has two rows, a dropped one has none of ``new_start`` and ``new_end``.
    """
    from .asof import interval_join, next_session
    own = [key, "start_date"]
    judged = intervals.filter(F.col("status").isin(*RISK_STATUSES))
    reach = judged.select(*own, F.coalesce(F.date_add("low", 1), "start_date").alias("_from"), F.col("end_date").alias("_to"))
    hits = interval_join(evidence.select(key, "trade_date", "beyond", "at_limit"), reach, [key], "trade_date", "_from", "_to", ["start_date"], how="inner")
    each = Window.partitionBy(*own)
    day, early, support = F.col("trade_date"), F.col("trade_date") < F.col("start_date"), F.col("at_limit") & ~F.col("beyond")
    inside = F.when(~early & F.col("beyond"), day)
    hits = hits.withColumns({"_break": F.max(F.when(early & F.col("beyond"), day)).over(each), "_first": F.min(inside).over(each), "_last": F.max(inside).over(each)})
    since = F.coalesce(F.date_add("_break", 1), data_start)
    sums = hits.groupBy(*own).agg(
        F.first("_break").alias("_break"), F.first("_first").alias("_first"), F.first("_last").alias("_last"),
        F.count_if(early & support & (day >= since)).alias("_extension"),
        F.count_if(~early & support & (day < F.col("_first"))).alias("_before"), F.count_if(~early & support & (day > F.col("_last"))).alias("_after"))
    rows = intervals.join(sums, own, "left")
    final = calendar.agg(F.max("trade_date")).scalar()
    days = calendar.select("idx", F.col("trade_date").alias("_day"))

    def following(df: DataFrame, name: str, out: str) -> DataFrame:
        """The first session after a date, the last one of all past the calendar."""
        found = next_session(df, calendar, name, inclusive=False, out="_idx").join(days, F.col("_idx") == days["idx"], "left")
        return found.withColumn(out, F.when(F.col(name).isNotNull(), F.coalesce("_day", final))).drop("idx", "_idx", "_day")

    for name, out in (("_break", "_after_break"), ("_last", "_after_last"), ("low", "_after_low")):
        rows = following(rows, name, out)
    moved_back = F.coalesce(F.col("_after_break"), F.greatest("_after_low", data_start))
    extended = F.coalesce((F.col("_extension") > 0) & (moved_back < F.col("start_date")), F.lit(False))
    before = F.col("_before") + F.when(extended, F.col("_extension")).otherwise(0)
    rows = rows.withColumns({"_start": F.when(extended, moved_back).otherwise(F.col("start_date")), "_extended": extended, "support_before": before,
                             "support_after": F.col("_after")})
    b, a = F.col("support_before"), F.col("support_after")
    decision = F.when((b >= strong) & (a >= strong), "split").when((a >= strong) | ((b < strong) & (a > b)), "start_moved").when(
        (b >= strong) | (b > a), "end_moved").otherwise("dropped")
    rows = rows.withColumn("_decision", F.when(F.col("_first").isNotNull(), decision))
    piece = lambda s, e: F.struct(F.col(s).alias("new_start"), F.col(e).alias("new_end"))
    d = F.col("_decision")
    pieces = (F.when(d == "split", F.array(piece("_start", "_first"), piece("_after_last", "end_date"))).when(d == "start_moved", F.array(piece("_after_last", "end_date")))
              .when(d == "end_moved", F.array(piece("_start", "_first"))).when(d == "dropped", F.array(F.struct(
                  F.lit(None).cast("date").alias("new_start"), F.lit(None).cast("date").alias("new_end")))).otherwise(F.array(piece("_start", "end_date"))))
    action = F.concat_ws(",", F.when(F.col("_extended"), "start_extended"), d)
    return rows.withColumn("action", F.when(action != "", action)).withColumn("_p", F.explode(pieces)).select(
        key, "status", "start_date", "end_date", "action", "support_before", "support_after", "_p.new_start", "_p.new_end")
