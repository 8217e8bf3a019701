"""Facts read from titles and report texts, as column expressions and line tables.

Texts are split into lines by Spark; a table row that wraps over several lines is
put together again by a grouping, so no document is parsed as a whole in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.codes import risk_status
from .asof import next_session
from .intervals import first_after

# Patterns that must read titles as the exchanges write them.  Words that make a title irrelevant; what an early
# warning looks like; repairs of a title; what frames its subject; where clauses part; the phrase for a resumed listing.
IGNORED_WORDS = ["可能", "进展", "申请", "风险提示", "存在被", "相关事项", "监管工作函", "问询函", "回复", "补充", "更正", "摘要", "更新后", "说明", "意见",
                 "核查", "自查", "会计师", "律师", "专项", "独立董事", "撤回", "取消", "整改", "情况报告", "年度报告", "终止上市", "触及", "暂不", "不提交",
                 "不申请", "无需", "关注", "中诚信", "评级", "债券", "受托管理", "上海证券交易所关于", "筹划"]
EARLY = "^(?=.*(将被|将实施|预计))((?=.*第.次)|(?=.*提示)(?!.*停牌))"
REPAIRS = [(r"\s+|[“”\"']", ""), ("（", "("), ("）", ")"), (r"^\[[^\]]*\]", ""), ("其他退市风险警示|其他风险(?!警示)", "其他风险警示"), ("风险风险警示", "风险警示")]
FRAME = [("^.*?关于", ""), ("的(补充)?(提示性)?公告.*$", ""), ("(?<=风险警示)(?=继续|实施|叠加)", "暨")]
CLAUSE = r"暨|并|，|,|、|(?:及|和|同时)(?=(?:公司)?(?:股票)?(?:交易)?(?:将)?(?:被)?(?:撤销|实施|实行|继续|叠加|变更))"
RESUME = "复牌"
# What a clause says of a warning, as (warning, action, phrase, not with).  Rules of a warning exclude each other.
NAMED = {"star": "退市风险警示", "st": "其他风险警示"}
CLAUSE_RULES = [
    ("star", "revoke", "撤销.*退市风险警示|退市风险警示.*撤销", "因重整而被实施的退市风险警示"),
    ("star", "revoke", "撤销", "退市风险警示|其他风险警示"),
    ("star", "assert", "继续.*退市风险警示|退市风险警示.*继续", "撤销"),
    ("star", "set", "(实施|实行|叠加|对公司股票).*退市风险警示|退市风险警示.*(实施|实行|叠加|对公司股票)", "撤销|继续"),
    ("st", "revoke", "撤销.*其他风险警示|其他风险警示.*撤销", "部分(撤销)?其他风险警示"),
    ("st", "revoke", "撤销", "退市风险警示|其他风险警示"),
    ("st", "assert", "继续.*其他风险警示|其他风险警示.*继续", "撤销"),
    ("st", "set", "(实施|实行|叠加|对公司股票).*其他风险警示|其他风险警示.*(实施|实行|叠加|对公司股票)", "撤销|继续")]


def edited(text: Column, edits: list[tuple[str, str]]) -> Column:
    for pattern, replacement in edits:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def said_of(warning: str, clauses: Column) -> Column:
    """What the last clause that speaks of a warning says of it, by the table of rules."""
    def action(clause: Column) -> Column:
        hits = [F.when(clause.rlike(phrase) & ~clause.rlike(against), name) for of, name, phrase, against in CLAUSE_RULES if of == warning]
        return F.coalesce(*hits)

    return F.try_element_at(F.filter(F.transform(clauses, action), lambda a: a.isNotNull()), F.lit(-1))


def classify_title(title: Column, exchange: Column) -> Column:
    """Struct (star, st, kind): what a notice does to each warning; kind is change, assert or ignore.

    A warning is set, revoked or goes on as the last clause about it says.  Where the graver one is revoked and nothing is
    said of the other, that one is revoked with it.
    """
    text = edited(F.coalesce(title, F.lit("")), REPAIRS)
    read = text.contains("风险警示") & ~text.rlike("|".join(IGNORED_WORDS)) & ~(text.rlike(EARLY) & (exchange == "SSE"))
    clauses = F.filter(F.split(edited(text, FRAME), CLAUSE), lambda c: c.contains("风险警示"))
    star, said = (F.when(read, said_of(warning, clauses)) for warning in NAMED)
    st = F.coalesce(said, F.when(star == "revoke", "revoke_implied"))
    silent, going_on = star.isNull() & st.isNull(), F.coalesce(star, F.lit("assert")).isin("assert") & F.coalesce(st, F.lit("assert")).isin("assert")
    return F.struct(star.alias("star"), st.alias("st"), F.when(silent, "ignore").when(going_on, "assert").otherwise("change").alias("kind"))


def effective_days(events: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """First session under a new status: after the trading halt of the notice, else the next session.

    ``events``: symbol, pub_date, title.
    """
    # what the calendar and the bars say is worked out once for a symbol and a day, however many notices they have
    rows = next_session(events.select("symbol", "pub_date").distinct(), calendar, "pub_date", inclusive=True, out="_i0")
    days = calendar.select(F.col("idx").alias("_i0"), F.col("trade_date").alias("d0"))
    after = calendar.select((F.col("idx") - 1).alias("_i0"), F.col("trade_date").alias("d1"))
    rows = rows.join(days, "_i0", "left").join(after, "_i0", "left").filter("d0 is not null")
    span = bars.groupBy("symbol").agg(F.min("trade_date").alias("_a"), F.max("trade_date").alias("_z"))
    traded = bars.select("symbol", F.col("trade_date").alias("d0"), F.lit(True).alias("_bar"))
    rows = rows.join(span, "symbol", "left").join(traded, ["symbol", "d0"], "left")
    rows = first_after(rows, bars, ["symbol"], "d0", "trade_date", "_next_bar")
    inside = (F.col("d0") >= F.col("_a")) & (F.col("d0") <= F.col("_z"))
    found = rows.select(F.col("symbol").alias("_symbol"), F.col("pub_date").alias("_pub"), "d0", "d1", "_next_bar", (inside & F.col("_bar").isNull()).alias("_halt"))
    rows = events.join(found, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("pub_date") == F.col("_pub")))
    resume = F.col("title").contains(RESUME)
    eff = F.when(F.col("_halt"), F.col("_next_bar")).when(resume, F.col("d0")).otherwise(F.col("d1"))
    method = F.when(F.col("_halt"), "first_bar_after_halt").when(resume, "resumption_day").otherwise("next_session")
    return rows.withColumns({"eff_date": eff, "method": method}).drop("_symbol", "_pub", "d0", "d1", "_next_bar", "_halt")


def status_transitions(events: DataFrame, window_days: int = 60) -> DataFrame:
    """Status after each effective notice, only where it changes.

    ``events``: symbol, eff_date, bid, star, st.  A repeat of the same notice within
    the window is dropped.  A flag is what its last notice said, so the state is
    two ``last`` windows.
    """
    same = Window.partitionBy("symbol", "star", "st").orderBy("eff_date", "bid")
    gap = F.datediff("eff_date", F.lag("eff_date").over(same))
    rows = events.withColumn("_g", gap).filter(F.col("_g").isNull() | (F.col("_g") > window_days))
    w = Window.partitionBy("symbol").orderBy("eff_date", "bid")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    said = lambda c: F.when(F.col(c).isin("set", "assert"), 1).when(F.col(c).isin("revoke", "revoke_implied"), 0)
    rows = rows.withColumns({"_star": F.last(said("star"), True).over(upto), "_st": F.last(said("st"), True).over(upto)})
    rows = rows.withColumn("status", F.when(F.col("_star") == 1, "*ST").when(F.col("_st") == 1, "ST"))
    last = rows.groupBy("symbol", "eff_date").agg(F.max_by("status", "bid").alias("status"))
    day = Window.partitionBy("symbol").orderBy("eff_date")
    before = F.lag("status").over(day)
    return last.withColumn("_b", before).filter(~F.col("status").eqNullSafe(F.col("_b"))).drop("_b")


def transitions_to_intervals(changes: DataFrame) -> DataFrame:
    end = F.lead("eff_date").over(Window.partitionBy("symbol").orderBy("eff_date"))
    return changes.withColumn("end_date", end).filter("status is not null").select(
        "symbol", "status", F.col("eff_date").alias("start_date"), "end_date")


# A risk-marked name at the head of a title.
NAME_HEAD = (r"^\s*(S?\*?ST[一-龥A-Za-z0-9]{1,6}?)(?=关于|：|:|\s|股票|公司|20\d\d|第|重大|对|风险|董事|监事|年|独立|收到|澄清|更正|补充|股东|日常|控股|"
             r"重整|诉讼|资产|终止|全资|子公司|业绩|$)")


def name_evidence(bulletins: DataFrame, change_days: DataFrame) -> DataFrame:
    """Dated names from titles, without what was published on the day of a status notice."""
    free = bulletins.join(change_days.select("symbol", "pub_date").distinct(), ["symbol", "pub_date"], "left_anti")
    name = F.regexp_extract("title", NAME_HEAD, 1)
    return free.withColumn("name", name).filter("name <> ''").withColumn("status", risk_status(F.col("name"))).select(
        "symbol", "pub_date", "name", "status")


# Report titles, the section of the holder table, its end, page noise and the cells of a row.
TITLE, SKIP_TITLE = r"(\d{4})\s*年\s*(年度报告|半年度报告|中期报告)", "摘要|英文|English|提示|更正公告"
SECTION, END = "期末上市基金前十名持有人", r"^\s*(\d+\.\d+\s+\S|§|注[:：])"
NOISE = r"序号|持有人名称|持有份额|份额比例|年度报告|中期报告|半年度报告|第\s*\d+\s*页|^[\s比例（）()%]+$|^\s*号(\s|$)"
RANK, SHARES, PERCENT = r"^\s*(\d{1,2}|[-－—])\s+", r"((?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2})(?=\s|$)", r"(\d+(?:\.\d+)?)%\s*$"


def report_period(title: Column) -> Column:
    """Struct (report_date, report_type) of a periodic report, null for other documents."""
    year, kind = F.regexp_extract(title, TITLE, 1), F.regexp_extract(title, TITLE, 2)
    annual = kind == "年度报告"
    return F.when((year != "") & ~title.rlike(SKIP_TITLE), F.struct(
        F.make_date(year.cast("int"), F.when(annual, 12).otherwise(6), F.when(annual, 31).otherwise(30)).alias("report_date"),
        F.when(annual, "annual").otherwise("interim").alias("report_type")))


def holder_table(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rank, holder, shares and percent of the top-holder table of each report.

    Lines after the last section heading up to the end mark are kept.  A line that
    starts with a rank opens a record; lines without one continue it.
    """
    lines = reports.select(key, F.posexplode(F.split(F.element_at(F.split(F.col(text), SECTION), -1), "\n")).alias("n", "line"), F.col(text).contains(SECTION).alias("_has"))
    w = Window.partitionBy(key).orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    live = lines.filter("_has and n > 0").withColumn("_end", F.max(F.col("line").rlike(END).cast("int")).over(upto)).filter("_end = 0")
    live = live.filter((F.trim("line") != "") & ~F.col("line").rlike(NOISE))
    live = live.withColumn("_rank", F.regexp_extract("line", RANK, 1))
    live = live.withColumn("_rec", F.sum((F.col("_rank") != "").cast("int")).over(upto)).filter("_rec > 0")
    rest = F.regexp_replace("line", RANK, "")
    cells = live.withColumns({"_shares": F.regexp_extract(rest, SHARES, 1), "_pct": F.regexp_extract(rest, PERCENT, 1)})
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, PERCENT, ""), SHARES, ""), r"\s+", "")
    records = cells.withColumn("_name", name).groupBy(key, "_rec").agg(
        F.max("_rank").alias("rank"), F.max("_shares").alias("shares"), F.max("_pct").alias("pct"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_name"))), lambda x: x["_name"]), "").alias("holder"))
    whole = records.filter("shares <> '' and pct <> ''")
    place = F.when(F.col("rank").rlike(r"^\d+$"), F.col("rank").try_cast("int")).otherwise(F.col("_rec").cast("int"))
    return whole.select(key, place.alias("rank"), "holder", F.regexp_replace("shares", ",", "").cast("double").alias("shares"), F.col("pct").cast("double").alias("pct"))
