import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelweave.operators import ledger, series
from panelweave.streaming import jobs, monitors, state

SCHEMA = "account long, event_id string, day date, seq long, kind string, symbol string, shares long, amount long, fees long, step_milli long, expected long"
D = date(2024, 1, 1)


def event(account, event_id, day, kind, symbol="", shares=0, amount=0, fees=0, step=0, expected=-1):
    return (account, event_id, D + timedelta(days=day), ledger.KINDS.index(kind) + 1, kind, symbol, shares, amount, fees, step, expected)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def after(spark, rows):
    return {r["event_id"]: r for r in ledger.fold(table(spark, rows)).collect()}


def test_every_kind_of_event(spark):
    got = after(spark, [
        event(1, "d", 0, "deposit", amount=10_000), event(1, "d0", 0, "deposit", amount=0),
        event(1, "b1", 1, "buy", "x", 100, 4_000, 10), event(1, "b2", 1, "buy", "y", 100, 6_000, 10), event(1, "s0", 1, "sell", "x", 10, 500),
        event(1, "s1", 2, "sell", "x", 40, 2_000, 5), event(1, "s2", 2, "sell", "x", 61, 3_000),
        event(1, "a1", 3, "adjust", "x", amount=7, step=1_255), event(1, "a2", 3, "adjust", "z", amount=7, step=1_100), event(1, "a3", 3, "adjust", "x", amount=7, step=1_100, expected=60),
        event(1, "c1", 4, "correct", "y", 30, 900, expected=0), event(1, "c2", 4, "correct", "y", 5, 100, expected=7),
        event(1, "w1", 5, "cash", amount=-9_000), event(1, "w2", 5, "cash", amount=-7_000),
        event(1, "x1", 6, "delist", "x", amount=3), event(1, "x2", 6, "delist", "x", amount=3), event(1, "n", 6, "buy", "x", -5, 100)])
    verdicts = {k: r["verdict"] for k, r in got.items()}
    assert verdicts == {"d": "ok", "d0": "invalid", "b1": "ok", "b2": "no_cash", "s0": "not_sellable", "s1": "ok", "s2": "not_sellable", "a1": "ok", "a2": "mismatch",
                        "a3": "mismatch", "c1": "ok", "c2": "mismatch", "w1": "no_cash", "w2": "ok", "x1": "ok", "x2": "mismatch", "n": "invalid"}
    state_of = lambda k: tuple(got[k][c] for c in ("cash", "quantity", "sellable", "cost"))
    assert state_of("b1") == (5_990, 100, 0, 4_010) and state_of("s1") == (7_985, 60, 60, 2_406)
    assert state_of("a1") == (7_985 + 300 * 7 // 1000, 75, 75, 2_406)  # 60 * 1.255 = 75.3
    assert state_of("c1")[1:] == (30, 30, 900) and state_of("w2")[0] == got["a1"]["cash"] - 7_000
    assert state_of("x1") == (got["w2"]["cash"] + 225, 0, 0, 0)


def test_a_copy_of_an_event_changes_nothing(spark):
    rows = [event(1, "d", 0, "deposit", amount=500), event(1, "d", 3, "deposit", amount=900), event(2, "d", 0, "deposit", amount=7)]
    got = sorted((r["account"], r["verdict"], r["cash"]) for r in ledger.fold(table(spark, rows)).collect())
    assert got == [(1, "duplicate", 500), (1, "ok", 500), (2, "ok", 7)]


def made(seed, n=900, accounts=7, days=60):
    rng = random.Random(seed)
    rows = [event(a, f"o{a}", 0, "deposit", amount=rng.randrange(1_000, 9_000)) for a in range(accounts)]
    for i in range(n):
        kind, shares = rng.choice([*ledger.KINDS, "buy", "buy", "sell", "sell"]), rng.randrange(1, 60)
        symbol = "" if kind in ("deposit", "cash") else rng.choice("xyz")
        amount = rng.randrange(-9000, 900) if kind == "cash" else rng.randrange(1, 9000) if kind in ("deposit", "buy", "sell", "correct") else rng.randrange(1, 50)
        day = rng.randrange(days)
        rows.append(event(rng.randrange(accounts), f"e{day}.{rng.randrange(n // days)}", day, kind, symbol, shares, amount, rng.randrange(3), rng.choice([900, 1000, 1300]),
                          rng.choice([-1, -1, 0, 20])))
    return rows


def test_invariants_and_prefixes(spark):
    """Cash and positions are never negative, and later events change nothing before them."""
    rows = made(1)
    whole = ledger.fold(table(spark, rows))
    assert whole.filter("cash < 0 OR quantity < 0 OR sellable < 0 OR sellable > quantity OR cost < 0").count() == 0
    assert {r["verdict"] for r in whole.collect()} >= {"ok", "duplicate", "no_cash", "not_sellable", "mismatch"}
    cut = D + timedelta(days=30)
    early = ledger.fold(table(spark, [r for r in rows if r[2] < cut]))
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, whole.filter(F.col("day") < F.lit(cut)).collect()))


def streamed(spark, rows, folder, late, files):
    """Files of the given parts, in that order."""
    for i, part in enumerate(files):
        table(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(table(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return state.fold_stream(stream, ["account"], ledger.ORDER, ledger.COLUMNS, ledger.SCHEMA, ledger.step, late, "ledger-test", "event_id")


def test_stream_over_shuffled_files_equals_batch(spark, tmp_path):
    rows = made(2, 400)
    random.Random(3).shuffle(rows)
    out = streamed(spark, rows, tmp_path, 61, [rows[i::5] for i in range(5)])
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, ledger.fold(table(spark, rows)).collect()), key=str)


def test_days_are_closed_by_the_watermark(spark, tmp_path, monkeypatch):
    rows = sorted(made(4, 500), key=lambda r: r[2])
    parts = []
    for i in range(6):  # ten days a file, each with a few rows of up to two days before
        late = [r for r in rows if 10 * i - 2 <= (r[2] - D).days < 10 * i][::2]
        parts.append([r for r in rows if 10 * i <= (r[2] - D).days < 10 * i + 10 and r not in [x for p in parts for x in p]] + [r for r in late if r not in [x for p in parts for x in p]])
    written = {}
    run = jobs.run_available
    monkeypatch.setattr(state.jobs, "run_available", lambda *a: written.setdefault("rows", run(*a)))
    out = streamed(spark, rows, tmp_path, 3, parts)
    sent = [r for p in parts for r in p]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, ledger.fold(table(spark, sent)).collect()), key=str)
    closed, provisional = (written["rows"].filter(f"closed = {c}").count() for c in ("true", "false"))
    assert closed > len(sent) * 0.7  # forgotten by the state, and returned once
    assert provisional < 3 * len(sent)  # open days only: not every earlier event in every batch


def test_volatility_alert_once_a_session(spark):
    row = lambda day, value, strikes=20, near=1.0: {"underlying": "u", "day": day, "session": day[:7], "value": value, "near_vol": near, "strikes": strikes}
    rows = [row(f"2024-01-{d:02}", 20.0) for d in range(1, 7)] + [row("2024-01-07", 30.0, 5), row("2024-01-08", None), row("2024-01-09", 31.0, 20, float("nan"))]
    rows += [row("2024-02-01", 20.1), row("2024-02-02", 21.0), row("2024-02-03", 25.0), row("2024-03-01", 25.6)]
    current, shown = {}, []
    for r in rows:
        current, out = monitors.volatility_step(current, r)
        shown.append((out["day"], out["kept"], out["alert"]))
    assert [d for d, _, alert in shown if alert] == ["2024-02-02", "2024-03-01"]
    assert [d for d, kept, _ in shown if not kept] == ["2024-01-07", "2024-01-08", "2024-01-09"]
    df = spark.createDataFrame(rows, "underlying string, day string, session string, value double, near_vol double, strikes long").withColumn("day", F.to_date("day"))
    out = series.ordered_fold(df, ["underlying"], ["day"], "underlying string, day date, value double, kept boolean, rise double, percentile double, alert boolean",
                              monitors.volatility_step, ["underlying", "day", "session", "value", "near_vol", "strikes"])
    assert [(str(r["day"]), r["kept"], r["alert"]) for r in out.orderBy("day").collect()] == shown


@pytest.mark.parametrize("quote,expected", [(None, "no_quote"), (10.0, "stale"), (100.0, "fresh")])
def test_a_source_that_still_serves_another_session(spark, quote, expected):
    trades = spark.createDataFrame([("a", D, "10", 40.0), ("a", D, "11", 60.0)], "symbol string, day date, hour string, amount double")
    quotes = spark.createDataFrame([("a", D - timedelta(days=1), "10", 100.0), ("a", D, "11", quote), ("b", D, "10", 1.0)], "symbol string, day date, hour string, quoted double").filter("quoted is not null")
    rows = {r["hour"]: r["source"] for r in monitors.freshness(trades, quotes, "symbol", "hour", 1.5, 5.0).collect()}
    assert rows == {"10": "no_quote", "11": expected}
