"""Operators against second implementations on small frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from panelweave.functions import codes, trading_rules as rules
from panelweave.operators import accounts, asof, evaluate, intervals, pit, risk, series, text, windows, xsection

DAY = dt.date(2020, 1, 1)


def panel(spark, symbols=3, sessions=90, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        price = 100.0
        for i in range(1, sessions + 1):
            if rng.random() < 0.1 and i > 1:
                rows.append((f"s{s}", i, None))
            else:
                price *= 1 + rng.normal(0, 0.03)
                rows.append((f"s{s}", i, float(price)))
    return spark.createDataFrame(rows, "symbol string, idx long, x double")


def test_windows_match_pandas(spark):
    df = panel(spark)
    got = df.select("symbol", "idx", windows.mean_n(F.col("x"), 20, 15).alias("m"), windows.std_n(F.col("x"), 20, 15).alias("s")).toPandas()
    want = df.toPandas().sort_values(["symbol", "idx"])
    roll = want.groupby("symbol")["x"].rolling(20, min_periods=15)
    full = want["idx"].to_numpy() >= 20
    got = got.sort_values(["symbol", "idx"])
    np.testing.assert_allclose(got["m"], np.where(full, roll.mean().to_numpy(), np.nan), rtol=1e-9)
    np.testing.assert_allclose(got["s"], np.where(full, roll.std().to_numpy(), np.nan), rtol=1e-7)


@pytest.mark.parametrize("cut", [40, 70])
def test_past_does_not_change_when_the_future_is_cut(spark, cut):
    df = panel(spark).withColumnRenamed("x", "adj_last").withColumn("adj_last", F.coalesce("adj_last", F.lit(100.0)))
    run = lambda d: series.stages(d, ma=20, slope=5, confirm=3).select("symbol", "idx", "stage", "ma")
    whole = run(df).filter(F.col("idx") <= cut).toPandas().sort_values(["symbol", "idx"], ignore_index=True)
    part = run(df.filter(F.col("idx") <= cut)).toPandas().sort_values(["symbol", "idx"], ignore_index=True)
    pd.testing.assert_frame_equal(whole, part)


@pytest.mark.parametrize("bucket", [None, "day", "month"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_matches_merge_asof(spark, bucket, strict):
    rng = np.random.default_rng(3)
    base = dt.datetime(2020, 1, 1)
    make = lambda n: pd.DataFrame({"k": rng.integers(0, 3, n), "t": [base + dt.timedelta(hours=int(h)) for h in rng.choice(3000, n, replace=False)],
                                   "v": np.arange(n)})
    left, right = make(200), make(60).rename(columns={"t": "rt"})
    out = asof.asof_join(spark.createDataFrame(left.rename(columns={"v": "id"})), spark.createDataFrame(right), ["k"], "t", "rt", ["v"],
                         strict=strict, bucket=bucket).toPandas().sort_values("id", ignore_index=True)
    want = pd.merge_asof(left.rename(columns={"v": "id"}).sort_values("t"), right.sort_values("rt"), left_on="t", right_on="rt", by="k",
                         allow_exact_matches=not strict).sort_values("id", ignore_index=True)
    np.testing.assert_array_equal(out["v"].fillna(-1).to_numpy(), want["v"].fillna(-1).to_numpy())


def test_bucketed_running_sum(spark):
    pdf = pd.DataFrame({"k": ["a"] * 50 + ["b"] * 5, "t": [dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i) for i in range(55)],
                        "i": range(55), "v": np.arange(55)})
    out = asof.running_sum(spark.createDataFrame(pdf), ["k"], ["t", "i"], {"total": "v"}, "day", "t").toPandas().sort_values("i")
    assert out["total"].tolist() == pdf.groupby("k")["v"].cumsum().tolist()


def test_neutralize_is_the_regression_residual(spark):
    rng = np.random.default_rng(5)
    n = 40
    pdf = pd.DataFrame({"g": 1, "symbol": [f"s{i:02d}" for i in range(n)], "ind": [f"i{i % 4}" for i in range(n)], "size": rng.normal(size=n),
                        "x": rng.normal(size=n)})
    got = xsection.neutralize(spark.createDataFrame(pdf), ["g"], "x", "ind", "size").toPandas().sort_values("symbol")["residual"].to_numpy()
    design = np.hstack([pd.get_dummies(pdf["ind"]).to_numpy(dtype=float), pdf[["size"]].to_numpy()])
    beta, *_ = np.linalg.lstsq(design, pdf["x"].to_numpy(), rcond=None)
    np.testing.assert_allclose(got, pdf["x"] - design @ beta, atol=1e-9)


def test_factor_returns_solve_weighted_least_squares(spark):
    rng = np.random.default_rng(6)
    rows = [(1, f"s{i}", float(i % 2 == 0), float(i % 2 == 1), float(rng.normal()), float(1 + rng.random()), float(rng.normal(0, 0.05))) for i in range(30)]
    df = spark.createDataFrame(rows, "idx long, symbol string, a double, b double, z double, w double, ret double")
    got = risk.factor_returns(df, ["a", "b", "z"], extra=2).toPandas().iloc[0][["a", "b", "z"]].to_numpy(dtype=float)
    x, w, r = (np.array([r[2:5] for r in rows]), np.array([r[5] for r in rows]), np.array([r[6] for r in rows]))
    want = np.linalg.lstsq(x * np.sqrt(w)[:, None], np.clip(r, -0.25, 0.25) * np.sqrt(w), rcond=None)[0]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_capped_weights_match_redistribution(spark):
    rng = np.random.default_rng(7)
    for trial in range(4):
        raw, cap = rng.uniform(0.5, 2, 8), rng.uniform(0.02, 0.3, 8)
        w = raw / raw.sum() * 0.95
        for _ in range(100):
            over = w > cap + 1e-15
            free = ~over & (w < cap - 1e-15)
            if not over.any() or not free.any():
                break
            extra = (w[over] - cap[over]).sum()
            w[over] = cap[over]
            w[free] += extra * w[free] / w[free].sum()
        df = spark.createDataFrame(pd.DataFrame({"idx": trial, "symbol": [f"s{i}" for i in range(8)], "raw": raw, "cap": cap}))
        got = accounts.capped_weights(df, "idx", "raw", "cap", 0.95).toPandas().sort_values("symbol")["weight"]
        np.testing.assert_allclose(got, np.minimum(w, cap), atol=1e-9)


def test_position_fold_batch_rules(spark):
    d = lambda i: DAY + dt.timedelta(days=i)
    rows = [(1, "s", d(0), "a", "buy", 300, 3000), (1, "s", d(0), "b", "sell", 100, 1100), (1, "s", d(1), "c", "sell", 100, 1100),
            (1, "s", d(1), "c", "sell", 100, 1100), (1, "s", d(2), "d", "sell", 500, 1)]
    df = spark.createDataFrame(rows, "account long, symbol string, day date, event_id string, side string, shares long, amount long")
    out = accounts.fold_positions(df).toPandas()
    assert out["verdict"].tolist() == ["ok", "rejected", "ok", "duplicate", "rejected"]
    assert out["quantity"].tolist() == [300, 300, 200, 200, 200]
    assert out["cost"].tolist()[-1] == 2000 and out["cash_change"].sum() == -1900


def test_rule_tables_have_exactly_one_rule_everywhere(spark):
    assert rules.rule_gaps(spark, rules.limit_table(spark), ["board", "risk"]).isEmpty()
    assert rules.rule_gaps(spark, rules.transfer_table(spark), ["exchange"]).isEmpty()


def test_limit_prices_round_half_up_and_leave_a_tick(spark):
    df = spark.createDataFrame([(435, 100000), (5, 50000), (1234, 200000)], "r long, p long")
    up, down = rules.limit_prices(F.col("r"), F.col("p"))
    assert [tuple(x) for x in df.select(up, down).collect()] == [(479, 392), (6, 4), (1481, 987)]


def test_codes_and_names(spark):
    df = spark.createDataFrame([("688001", "*ST 甲"), ("000001", "XDST乙"), ("430001", "丙退"), ("689009", "Ｓ ＳＴ丁"), ("300001", "戊")], "c string, n string")
    got = [tuple(r) for r in df.select(codes.board(F.col("c")), codes.risk_status(F.col("n"))).collect()]
    assert got == [("STAR", "*ST"), ("SZSE_MAIN", "ST"), ("BSE", "DELISTING"), ("STAR", "ST"), ("CHINEXT", None)]


@pytest.mark.parametrize("title,star,st,kind", [
    ("关于公司股票实施退市风险警示的公告", "set", None, "change"),
    ("关于撤销退市风险警示并继续实施其他风险警示的公告", "revoke", "assert", "change"),
    ("关于撤销公司股票风险警示的公告", "revoke", "revoke", "change"),
    ("关于股票可能被实施退市风险警示的提示性公告", None, None, "ignore"),
    ("关于部分撤销其他风险警示的公告", None, None, "ignore"),
])
def test_titles(spark, title, star, st, kind):
    row = spark.range(1).select(text.classify_title(F.lit(title), F.lit("SZSE")).alias("c")).select("c.*").first()
    assert tuple(row) == (star, st, kind)


def test_swing_points():
    high = np.array([10, 11, 12, 11, 9, 8, 9, 12, 13, 12.5], dtype=float)
    low = high - 0.5
    got = series.swing_points(high, low, np.full(10, 2.0))
    assert [(i, k, sure) for i, _, k, sure in got] == [(0, "L", True), (2, "H", True), (5, "L", True), (8, "H", False)]


def test_selection_by_ranks(spark):
    # two industries of six: tolerance 0.05 asks for at least three of each among six
    rows = [(1, f"a{i}", 10.0 - i, "A", i == 5, i != 0) for i in range(6)] + [(1, f"b{i}", 3.0 - i, "B", False, True) for i in range(6)]
    df = spark.createDataFrame(rows, "idx long, symbol string, score double, industry string, held boolean, affordable boolean")
    got = sorted(r.symbol for r in accounts.select_names(df, 6, 0.05).collect())
    # a5 is held and inside the buffer, a0 can't be bought, each side gets its least of three
    assert got == ["a1", "a2", "a5", "b0", "b1", "b2"]
    assert sorted(r.symbol for r in accounts.select_names(df, 6, 1.0, buffer=0.0).collect()) == ["a1", "a2", "a3", "a4", "a5", "b0"]


def test_statement_metrics_follow_restatements(spark):
    q = [dt.date(2019, 12, 31), dt.date(2020, 3, 31), dt.date(2019, 3, 31)]
    rows = [("s", "income", q[2], 1, 1, 10.0), ("s", "income", q[0], 1, 2, 100.0), ("s", "income", q[1], 1, 3, 30.0), ("s", "income", q[0], 2, 4, 90.0)]
    df = spark.createDataFrame(rows, "symbol string, statement string, report_date date, version int, eff long, parent_net_profit double")
    for names in pit.INPUTS.values():
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("double"))
    got = pit.statement_metrics(df).select("eff", "ni_ttm").toPandas().sort_values("eff")
    assert got["ni_ttm"].fillna(-1).tolist() == [-1, 100, 120, 110]


def test_interval_join_and_cooldown(spark):
    pts = spark.createDataFrame([("a", dt.date(2020, 5, 5)), ("a", dt.date(2022, 1, 1)), ("b", dt.date(2020, 1, 1))], "k string, d date")
    iv = spark.createDataFrame([("a", dt.date(2019, 1, 1), dt.date(2020, 5, 5), "x"), ("a", dt.date(2020, 5, 5), None, "y")], "k string, s date, e date, v string")
    got = {(r.k, r.d): r.v for r in asof.interval_join(pts, iv, ["k"], "d", "s", "e", ["v"]).collect()}
    assert got == {("a", dt.date(2020, 5, 5)): "y", ("a", dt.date(2022, 1, 1)): "y", ("b", dt.date(2020, 1, 1)): None}
    hits = spark.createDataFrame([("a", i) for i in (1, 5, 12, 20, 22)], "symbol string, idx long")
    assert sorted(r.idx for r in series.cooldown(hits, 10).collect()) == [1, 12]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "factor string, p double")
    got = {r.factor: r.q for r in evaluate.benjamini_hochberg(df, "p", "q").collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04) and got["d"] is None


def test_ranks_of_few_large_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 1009).alias("x"))
    order = [F.desc("x"), F.col("id")]
    got = windows.ranked(rows, "g", order, "place")
    expected = rows.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert {tuple(r) for r in got.select("id", "place").collect()} == {tuple(r) for r in expected.select("id", "place").collect()}


def test_first_day_after_many_events_of_one_key(spark):
    events = spark.range(5000).select(F.lit("a").alias("k"), "id", F.date_add(F.lit(DAY), (F.col("id") % 9).cast("int")).alias("d"))
    days = spark.createDataFrame([("a", DAY + dt.timedelta(days=i)) for i in (0, 4, 4, 7)], "k string, day date")
    got = intervals.first_after(events, days, ["k"], "d", "day", "next")
    found = {(r.d - DAY).days: r.next and (r.next - DAY).days for r in got.select("d", "next").distinct().collect()}
    assert got.count() == 5000 and found == {0: 4, 1: 4, 2: 4, 3: 4, 4: 7, 5: 7, 6: 7, 7: None, 8: None}


def test_sources_are_packed_for_the_executors(spark):
    import zipfile

    from panelweave.sources import ship
    ship.ship(spark)
    ship.ship(spark)
    packed = [f for f in spark.sparkContext._python_includes if f == "panelweave.zip"]
    assert len(packed) == 1
    from pyspark import SparkFiles
    assert "panelweave/operators/asof.py" in zipfile.ZipFile(SparkFiles.get("panelweave.zip")).namelist()
