"""Scan-time normalisers: one narrow projection per dataset, no shuffle unless a key is deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import codes


def first_present(df: DataFrame, names: list[str], type_: str = "string") -> Column:
    """The first of the candidate columns the frame has (null when it has none)."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast(type_)


def first_value(df: DataFrame, names: list[str]) -> Column:
    """Per row, the first non-null of the candidate columns the frame has."""
    present = [F.col(n).try_cast("double") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def safe_date(x: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x.cast("string"), F.lit("yyyy-MM-dd")),
                      F.try_to_timestamp(x.cast("string"), F.lit("yyyyMMdd"))).cast("date")


def safe_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), ",", "").try_cast("double")


def quarter_end(day: Column) -> Column:
    return (day == F.last_day(day)) & (F.month(day) % 3 == 0)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; an aggregation, so a hot key is combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
                                            ).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def security_master(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """Live and delisted lists in one master without survivorship bias.

    Both have code, name, list_date, delist_date.  A code delisted twice keeps its
    first listing; a code that is live again belongs to the live security.
    """
    def rows(df: DataFrame) -> DataFrame:
        code = F.lpad(F.trim(F.col("code").cast("string")), 6, "0")
        return df.select(code.alias("symbol"), codes.clean_name(F.col("name")).alias("name"), "list_date",
                         "delist_date").filter(codes.is_a_share(F.col("symbol")))

    live = rows(listed).withColumns({
        "status": F.when(codes.risk_status(F.col("name")) == "DELISTING", "delisting_period").otherwise("listed"),
        "delist_date": F.lit(None).cast("date")})
    live = keep_one(live, ["symbol"], [F.col("list_date").isNull().cast("int"), F.col("name")])
    gone = rows(delisted).filter("delist_date is not null").withColumn("status", F.lit("delisted"))
    age = F.datediff(F.lit("2999-12-31"), F.col("list_date"))
    gone = keep_one(gone, ["symbol"], [F.coalesce(age, F.lit(-1)), F.col("name")])
    both = live.unionByName(gone.join(live, "symbol", "left_anti").select(*live.columns))
    s = F.col("symbol")
    return both.withColumns({"board": codes.board(s), "exchange": codes.exchange(s),
                             "security_type": codes.security_type(s), "instrument_id": codes.instrument_id(s)})


def daily_bars(raw: DataFrame, scales: dict[str, int], source: str = "source") -> DataFrame:
    """Vendor bars with volume in shares; the applied scale is kept."""
    scale = F.lit(1)
    for name, factor in scales.items():
        scale = F.when(F.col(source) == name, factor).otherwise(scale)
    return raw.withColumns({"volume_scale": scale, "volume": F.col("volume") * scale})


def valid_prices(bars: DataFrame, columns: tuple[str, ...] = ("open", "high", "low", "close")) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    return ok


def derived_changes(bars: DataFrame, key: str = "symbol", day: str = "trade_date") -> DataFrame:
    """Change, percent and amplitude against the previous close (only a positive one counts)."""
    previous = F.lag("close").over(Window.partitionBy(key).orderBy(day))
    previous = F.when(previous > 0, previous)
    return bars.withColumns({"change": F.col("close") - previous,
                             "pct_change": (F.col("close") - previous) / previous * 100,
                             "amplitude_pct": (F.col("high") - F.col("low")) / previous * 100})


def index_bars(raw: DataFrame) -> DataFrame:
    """Close-only series get open, high and low from the close."""
    return raw.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})


def adjustment_factors(raw: DataFrame, key: str = "symbol") -> DataFrame:
    """One factor per date (the last given wins) and its ratio to the latest one."""
    clean = keep_one(raw.filter("effective_date is not null"), [key, "effective_date"], [F.col("seq")])
    latest = clean.groupBy(key).agg(F.max_by("hfq", F.when(F.col("hfq").isNotNull(), F.col("effective_date"))).alias("_l"))
    return clean.join(latest, key).withColumn("qfq", F.col("hfq") / F.col("_l")).drop("_l", "seq")


# Vendor suspension terms.
SUSPENSION_TYPES = {"停牌一天": "full_day", "连续停牌": "continuous", "停牌半天": "half_day", "盘中停牌": "intraday"}
INTRADAY_REASON = "盘中|临时停牌"


def suspension_type(term: Column) -> Column:
    out = F.lit("unknown")
    for text, kind in SUSPENSION_TYPES.items():
        out = F.when(term == text, kind).otherwise(out)
    return out


def intraday_halt(start: Column, resume: Column, reason: Column) -> Column:
    hit = (start == resume) | F.coalesce(reason, F.lit("")).rlike(INTRADAY_REASON)
    return F.when(F.coalesce(hit, F.lit(False)), "intraday").otherwise("unknown")


def record_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def industry_intervals(history: DataFrame, table: DataFrame, mapping: DataFrame, switch: str) -> DataFrame:
    """Dated industry rows as intervals with one class system throughout.

    ``history``: symbol, start_date, code, update_time; ``table``: code, l1_name of
    the new system; ``mapping``: old code -> l1_code.  Lookup tables are joined
    without a hint; the optimiser broadcasts them while they are small.
    """
    rows = keep_one(history, ["symbol", "start_date"], [F.col("update_time"), F.col("code")])
    rows = rows.withColumn("end_date", F.lead("start_date").over(Window.partitionBy("symbol").orderBy("start_date")))
    known = table.select("code").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "code", "left").join(mapping.select(F.col("code"), F.col("l1_code").alias("_mapped")), "code", "left")
    new, in_table = F.col("start_date") >= F.to_date(F.lit(switch)), F.col("_known").isNotNull()
    native = new | in_table
    own = F.concat(F.substring("code", 1, 2), F.lit("0000"))
    rows = rows.withColumns({
        "mapping": F.when(new & ~in_table, "native_code_not_in_table").when(new, "native").when(in_table, "same_code")
        .otherwise("mapped"),
        "l1_code": F.when(native, own).otherwise(F.coalesce("_mapped", F.lit("000000")))})
    names = table.select(F.concat(F.substring("code", 1, 2), F.lit("0000")).alias("l1_code"), "l1_name").groupBy("l1_code").agg(
        F.min("l1_name").alias("l1_name"))
    return rows.join(names, "l1_code", "left").select("symbol", "start_date", "end_date", "code", "mapping", "l1_code", "l1_name")


def majority_mapping(pairs: DataFrame, old_codes: DataFrame, table: DataFrame) -> DataFrame:
    """Old code -> new class: unchanged, else the most frequent move of the code, its level 2, its level 1.

    ``pairs``: old_code, l1_code of names seen under both systems.  Counts are
    aggregated per level; ties go to the smaller class.
    """
    def majority(length: int, method: str) -> DataFrame:
        counts = pairs.groupBy(F.substring("old_code", 1, length).alias("k"), "l1_code").agg(F.count("*").alias("n"))
        best = counts.groupBy("k").agg(F.max_by(F.struct("l1_code", "n"), F.struct("n", -F.col("l1_code").cast("int"))).alias("b"),
                                       F.sum("n").alias("total"))
        return best.select(F.col("k").alias(f"k{length}"), F.struct(
            F.col("b.l1_code").alias("l1_code"), F.lit(method).alias("method"), F.col("b.n").alias("names"),
            (F.col("b.n") / F.col("total")).alias("share")).alias(f"m{length}"))

    rows = old_codes.select("old_code").distinct().withColumns({f"k{n}": F.substring("old_code", 1, n) for n in (6, 4, 2)})
    for n, method in ((6, "transition"), (4, "level2_majority"), (2, "level1_majority")):
        rows = rows.join(majority(n, method), f"k{n}", "left")
    same = table.select(F.col("code").alias("old_code")).distinct().withColumn("_same", F.lit(True))
    rows = rows.join(same, "old_code", "left")
    unmapped = F.struct(F.lit("000000").alias("l1_code"), F.lit("unmapped").alias("method"),
                        F.lit(0).cast("long").alias("names"), F.lit(0.0).alias("share"))
    kept = F.struct(F.concat("k2", F.lit("0000")).alias("l1_code"), F.lit("same_code").alias("method"),
                    F.lit(0).cast("long").alias("names"), F.lit(1.0).alias("share"))
    pick = F.when(F.col("_same").isNotNull(), kept).otherwise(F.coalesce("m6", "m4", "m2", unmapped))
    return rows.withColumn("_p", pick).select("old_code", "_p.*")


def content_hash(columns: list[str]) -> Column:
    """Hash of the values at six significant digits; equal content gives an equal hash."""
    parts = [F.coalesce(F.format_string("%.5e", F.col(c).cast("double")), F.lit("null")) for c in columns]
    return F.substring(F.sha2(F.concat_ws(",", *parts), 256), 1, 20)


# Words that decide the kind of a buyback, strongest last.
BUYBACK_KINDS = (("incentive", "股权激励|员工持股"), ("cancel", "注销|减少注册资本"))


def buyback_kind(purpose: Column) -> Column:
    kind = F.lit("other")
    for name, words in BUYBACK_KINDS:
        kind = F.when(F.coalesce(purpose, F.lit("")).rlike(words), name).otherwise(kind)
    return kind


def average_price(amount: Column, shares: Column) -> Column:
    return F.when((amount > 0) & (shares > 0), amount / shares)


# Option code formats, and the expiry weekday (1 = Monday) with its number in the month.
SSE_OPTION, CFFEX_OPTION = r"^(\d{6})([CP])(\d{2})(\d{2})([A-Z])(\d{5})$", r"^(IO|MO|HO)(\d{2})(\d{2})-([CP])-(\d+(?:\.\d+)?)$"
EXPIRY = {"SSE": (3, 4), "CFFEX": (5, 3)}


def nth_weekday(month_start: Column, weekday: int, nth: int) -> Column:
    """The nth given weekday of a month (weekday 1 = Monday)."""
    offset = F.pmod(F.lit(weekday) - (F.weekday(month_start) + 1), F.lit(7)) + 7 * (nth - 1)
    return F.date_add(month_start, offset.cast("int"))


def option_contracts(raw: DataFrame, calendar: DataFrame, code: str = "code") -> DataFrame:
    """Terms read from option codes; expiry rolls to the next session when its day is closed."""
    from .asof import next_session
    c = F.col(code)
    sse = c.rlike(SSE_OPTION)
    part = lambda i, j: F.when(sse, F.regexp_extract(c, SSE_OPTION, i)).otherwise(F.regexp_extract(c, CFFEX_OPTION, j))
    rows = raw.filter(sse | c.rlike(CFFEX_OPTION)).withColumns({
        "exchange": F.when(sse, "SSE").otherwise("CFFEX"), "underlying": part(1, 1),
        "kind": F.when(part(2, 4) == "C", "call").otherwise("put"),
        "month": F.to_date(F.concat(F.lit("20"), part(3, 2), F.lit("-"), part(4, 3), F.lit("-01"))),
        "strike": F.when(sse, F.regexp_extract(c, SSE_OPTION, 6).try_cast("double") / 1000).otherwise(
            F.regexp_extract(c, CFFEX_OPTION, 5).try_cast("double"))})
    due = F.when(F.col("exchange") == "SSE", nth_weekday(F.col("month"), *EXPIRY["SSE"])).otherwise(
        nth_weekday(F.col("month"), *EXPIRY["CFFEX"]))
    rows = next_session(rows.withColumn("due", due), calendar, "due", inclusive=True, out="_idx")
    rows = rows.join(calendar.select(F.col("idx").alias("_idx"), F.col("trade_date").alias("_session")), "_idx", "left")
    near = F.datediff("_session", "due") < 10
    return rows.withColumn("expiry_date", F.when(near, F.col("_session")).otherwise(F.col("due"))).drop("_idx", "_session")


def zero_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in columns})


def split_code_name(text: Column) -> tuple[Column, Column]:
    """A "code name" cell in two columns."""
    return F.regexp_extract(text, r"^\s*(\d{6})", 1), F.trim(F.regexp_replace(text, r"^\s*\d{6}\s*", ""))


def fund_shares(raw: DataFrame, day: Column, unit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the asked day with valid codes and shares, one per key, and the counts dropped on the way."""
    flags = raw.withColumns({"_other": ~F.col("trade_date").eqNullSafe(day)})
    flags = flags.withColumn("_bad", ~F.col("_other") & ~(F.coalesce(F.col("symbol").rlike(r"^\d{6}$"), F.lit(False))
                                                          & F.coalesce(F.col("shares") > 0, F.lit(False))))
    good = flags.filter("not _other and not _bad").withColumn("shares", F.col("shares") * unit).drop("_other", "_bad")
    kept = keep_one(good, ["trade_date", "exchange", "symbol"], [F.col("seq")])
    counts = flags.agg(F.count_if("_other").alias("dropped_other_date"), F.count_if("_bad").alias("dropped_invalid"),
                       (F.count_if(~F.col("_other") & ~F.col("_bad")) - F.countDistinct(
                           F.when(~F.col("_other") & ~F.col("_bad"), F.struct("trade_date", "exchange", "symbol")))
                        ).alias("dropped_duplicate"))
    return kept, counts


# Session open and the time a daily bar is final.
SESSION_OPEN, FINAL_TIME = "09:30:00", "16:00:00"


def snapshot_session(snaps: DataFrame, calendar: DataFrame, at: str) -> DataFrame:
    """Label snapshots: intraday ones have no session, the others belong to the latest final session."""
    from .asof import asof_join
    days = calendar.select(F.col("trade_date").alias("session"), F.col("trade_date").alias("_on"))
    day, clock = F.to_date(at), F.date_format(at, "HH:mm:ss")
    # Before the final time today's session does not count yet.
    probe = snaps.withColumns({"_cut": F.when(clock < FINAL_TIME, F.date_sub(day, 1)).otherwise(day), "_day": day})
    # A day is looked up once, however many snapshots it has; the lookups have a row a day and go to the snapshots, not these to a few days.
    cuts = probe.select("_cut").filter("_cut is not null").distinct().withColumn("_all", F.lit(1))
    latest = asof_join(cuts, days.withColumn("_all", F.lit(1)), ["_all"], "_cut", "_on", ["session"]).drop("_all")
    opened = days.select(F.col("_on").alias("_day"), F.lit(True).alias("_open"))
    open_today = probe.join(F.broadcast(latest), "_cut", "left").join(F.broadcast(opened), "_day", "left")
    intraday = F.coalesce("_open", F.lit(False)) & (clock >= SESSION_OPEN) & (clock < FINAL_TIME)
    return open_today.withColumns({"kind": F.when(intraday, "intraday").otherwise("post_close"),
                                   "session": F.when(~intraday, F.col("session"))}).drop("_cut", "_day", "_open")


def last_final_session(events: DataFrame, time: str, close: str = "15:00") -> Column:
    """Last day that has an event at or after the close, as a scalar; a later day is still open."""
    closed = events.filter(F.date_format(time, "HH:mm") >= close)
    return closed.agg(F.max(F.to_date(time))).scalar()


# The two layouts of a market snapshot, as target column: (source column, factor to its unit).
SNAPSHOT_LAYOUTS = (
    {"symbol": ("代码", None), "name": ("名称", None), "last": ("最新价", 1), "volume_shares": ("成交量", 100), "turnover_cny": ("成交额", 1),
     "pct_change": ("涨跌幅", 1), "change_cny": ("涨跌额", 1), "open": ("今开", 1), "high": ("最高", 1), "low": ("最低", 1), "previous_close": ("昨收", 1),
     "turnover_rate_pct": ("换手率", 1), "market_cap_cny": ("总市值", 1), "float_market_cap_cny": ("流通市值", 1)},
    {"symbol": ("code", None), "name": ("name", None), "last": ("zxj", 1), "volume_shares": ("volume", 100), "turnover_cny": ("turnover", 10_000),
     "pct_change": ("zdf", 1), "change_cny": ("zd", 1), "turnover_rate_pct": ("hsl", 1), "market_cap_cny": ("zsz", 100_000_000),
     "float_market_cap_cny": ("ltsz", 100_000_000)})
SNAPSHOT_NEEDED = ("symbol", "name", "last", "volume_shares", "turnover_cny")


def market_snapshot(raw: DataFrame, snapshot_date: Column, order: str | None = None) -> DataFrame:
    """A snapshot of either layout in common columns and units; what a layout lacks is null, bad numbers are null.

    The last row of a security by ``order`` stays (any one without an order).
    """
    layout = next((one for one in SNAPSHOT_LAYOUTS if all(one[c][0] in raw.columns for c in SNAPSHOT_NEEDED)), None)
    if layout is None:
        raise ValueError(f"no known snapshot layout has the columns {raw.columns}")

    def cell(target: str) -> Column:
        source, factor = layout.get(target, (None, 1))
        number = F.col(source).try_cast("double") * factor if source in raw.columns else F.lit(None).cast("double")
        return F.round(number).cast("long") if target == "volume_shares" else number

    symbol = F.lpad(F.regexp_extract(F.col(layout["symbol"][0]).cast("string"), r"(.{1,6})$", 1), 6, "0")
    rows = raw.select(symbol.alias("symbol"), F.regexp_replace(F.col(layout["name"][0]).cast("string"), r"(?U)^\s+|\s+$", "").alias("name"),
                      *[cell(c).alias(c) for c in SNAPSHOT_LAYOUTS[0] if c not in ("symbol", "name")], *([F.col(order).alias("_order")] if order else []))
    rows = rows.withColumns({"exchange": codes.exchange(F.col("symbol")), "snapshot_date": snapshot_date,
                             "is_st": F.coalesce(codes.risk_status(F.col("name")).isin("ST", "*ST"), F.lit(False))})
    if not order:
        return rows.dropDuplicates(["symbol"])
    kept = [c for c in rows.columns if c not in ("symbol", "_order")]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*kept), "_order").alias("_r")).select("symbol", "_r.*")
