"""Steps that must grow no faster than their tables: what is dealt by few keys, worked out twice or kept per row."""

import json
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from panelweave.operators import accounts, ledger, normalize, text
from panelweave.plans import queries_ledger
from panelweave.streaming import state

D = date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_ledger_is_dealt_once_and_its_rows_are_arrow_columns(spark):
    rows = [(1, "d", D, 1, "deposit", "", 0, 500, 0, 0, -1), (1, "d", D, 1, "deposit", "", 0, 500, 0, 0, -1), (1, "b", D, 3, "buy", "x", 10, 400, 1, 0, -1)]
    events = spark.createDataFrame(rows, "account long, event_id string, day date, seq long, kind string, symbol string, shares long, amount long, fees long, step_milli long, expected long")
    folded = ledger.fold(events)
    assert plan(folded).count("hashpartitioning") == 1 and "MapInPandas" not in plan(folded)
    cash, held = ledger.closing(ledger.numbered(folded))
    assert [tuple(r) for r in cash.collect()] == [(1, 99)] and [tuple(r) for r in held.collect()] == [(1, "x", 10, 401)]


def test_days_that_are_null_are_one_day(spark):
    rows = [(1, "d", None, 1, "deposit", "", 0, 5_000, 0, 0, -1), (1, "b", None, 3, "buy", "x", 10, 400, 1, 0, -1), (1, "s", None, 4, "sell", "x", 10, 400, 1, 0, -1),
            (1, "t", D, 4, "sell", "x", 4, 400, 1, 0, -1), (1, "n", D, 4, "sell", "x", None, 400, 1, 0, -1)]
    events = spark.createDataFrame(rows, "account long, event_id string, day date, seq long, kind string, symbol string, shares long, amount long, fees long, step_milli long, expected long")
    got = {r.event_id: (r.verdict, r.quantity) for r in ledger.fold(events).collect()}
    assert got == {"d": ("ok", 0), "b": ("ok", 10), "s": ("not_sellable", 10), "t": ("ok", 6), "n": ("not_sellable", 10)}


def test_a_holding_is_sorted_once_and_meets_few_plans_where_it_is(spark):
    held = spark.createDataFrame([(1, "x", D, 10, 1), (1, "x", D, 20, 2), (1, "x", D + timedelta(9), 0, 3), (2, "x", D, 5, 4)], "account long, symbol string, day date, quantity long, event_id long")
    plans = spark.createDataFrame([("x", D, 1.0), ("x", D + timedelta(9), 2.0), ("x", D + timedelta(10), 3.0)], "symbol string, ex_date date, cash_per_10 double")
    found = accounts.pending_actions(plans, held)
    assert "SortAggregate" not in plan(found) and "SortMergeJoin" not in plan(found)
    assert {tuple(r) for r in found.select("account", "ex_date", "quantity", "cash").collect()} == {
        (1, D + timedelta(9), 20, 4), (2, D + timedelta(9), 5, 1), (2, D + timedelta(10), 5, 2)}


def test_snapshots_stay_where_they_are(spark):
    times = ["2024-01-01 10:00:00", "2024-01-01 16:00:00", "2024-01-02 08:00:00", "2024-01-06 12:00:00", "2023-12-31 12:00:00", None]
    snaps = spark.createDataFrame(list(enumerate(times)), "event_id int, t string").select("event_id", F.to_timestamp("t").alias("ts"))
    days = spark.createDataFrame([(D,), (D + timedelta(1),)], "trade_date date")
    found = normalize.snapshot_session(snaps, days, "ts")
    top = plan(found).split("BroadcastExchange")[0]
    assert "Exchange" not in top and "Window" not in top  # no snapshot is shuffled or held in a window
    got = {r.event_id: (r.session, r.kind) for r in found.collect()}
    assert got == {0: (None, "intraday"), 1: (D, "post_close"), 2: (D, "post_close"), 3: (D + timedelta(1), "post_close"), 4: (None, "post_close"), 5: (None, "post_close")}


def test_notices_of_a_day_are_placed_once(spark):
    calendar = spark.createDataFrame([(D + timedelta(i), i + 1) for i in range(4)], "trade_date date, idx long")
    bars = spark.createDataFrame([("x", D), ("x", D + timedelta(3))], "symbol string, trade_date date")
    notices = spark.createDataFrame([("x", D, 1, "a"), ("x", D, 2, "a"), ("x", D + timedelta(1), 3, "a"), (None, D, 4, "a"), ("x", D + timedelta(9), 5, "a"), ("x", None, 6, "a")],
                                    "symbol string, pub_date date, bid long, title string")
    found = text.effective_days(notices, bars, calendar)
    assert {(r.bid, r.eff_date, r.method) for r in found.collect()} == {
        (1, D + timedelta(1), "next_session"), (2, D + timedelta(1), "next_session"), (3, D + timedelta(3), "first_bar_after_halt"), (4, D + timedelta(1), "next_session")}
    assert not [line for line in plan(found).splitlines() if "struct" in line and "title" in line]  # no notice is carried through a window


class Handle:
    """One key's state."""
    def __init__(self):
        self.kept, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.kept

    def update(self, value):
        self.kept = value

    def registerTimer(self, due):
        self.timers.append(due)


class Now:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_key_has_one_timer(spark):
    fold = state.OrderedFold(lambda s, r: ({"n": s.get("n", 0) + 1}, {"day": r["day"], "n": s.get("n", 0) + 1}), ["day"], ["day"], ["day", "n"], 9, None, set(), {"n"})
    handle = Handle()
    fold.init(handle)
    rows = [{"day": D + timedelta(i)} for i in range(50)]
    assert len(list(fold.handleInputRows((1,), iter(rows), Now(0)))) == 50 and len(handle.timers) == 1
    passed = int((datetime(2024, 1, 11) - datetime(1970, 1, 1)).total_seconds() * 1000)
    out = list(fold.handleExpiredTimer((1,), Now(passed), None))
    assert sum(r.closed for r in out) == 10 and [r.n for r in out] == list(range(1, 51))
    assert len(handle.timers) == 2 and handle.timers[1] > passed and len(json.loads(handle.kept[0])["open"]) == 40


class Bodies(Handle):
    """The keys of one group."""
    def __init__(self):
        super().__init__()
        self.of, self.updated = {}, []

    def getMapState(self, name, key, value):
        return self

    def iterator(self):
        return iter([((k,), v) for k, v in self.of.items()])

    def updateValue(self, key, value):
        self.updated.append(key[0])
        self.of[key[0]] = value


def counted(s, r):
    n = s.get("n", 0) + (0 if r["again"] else 1)
    return {"n": n}, {"key": r["key"], "day": r["day"], "n": n, "x": r["x"]}


def test_keys_of_a_group_share_calls_batches_and_timers():
    types = {"key": "long", "day": "date", "n": "long", "x": "long"}
    fold = state.GroupedFolds(["key"], ["day", "id"], ["key", "x"], types, counted, ["key", "day", "id", "x"], ["day", "id"], ["key", "day", "n", "x"], 9, "id", {"key", "x"}, {"key", "n", "x"})
    handle = Bodies()
    fold.init(handle)
    rows = [f'[["2024-01-{1 + i:02}","e{i}"],{key},{x}]' for i in range(20) for key, x in ((1, 2**62 + i), (2, "null"), ("null", 5))] + ['[["2024-01-03","e2"],1,7]']
    out = list(fold.handleInputRows((5,), iter([pd.DataFrame({"packed": part}) for part in (rows[:40], rows[40:])]), Now(0)))
    assert len(out) == 1 and len(out[0]) == 61 and len(handle.timers) == 1 and set(handle.of) == {"1", "2", "NaN"}
    assert out[0].groupby("key", dropna=False).n.max().tolist() == [20, 20, 20]  # the copy changes nothing
    assert out[0][out[0].key == 1].x.tolist()[-1] == 2**62 + 19 and out[0][out[0].key == 2].x.isna().all()
    passed = int((datetime(2024, 1, 11) - datetime(1970, 1, 1)).total_seconds() * 1000)
    handle.updated.clear()
    (more,) = fold.handleInputRows((5,), iter([pd.DataFrame({"packed": ['[["2024-01-30","f"],2,1]']})]), Now(passed))
    assert handle.updated == ["2"] and set(more.key) == {2}  # another key's entry is not written again
    (rest,) = fold.handleExpiredTimer((5,), Now(passed), None)
    assert set(rest.key.dropna()) == {1} and handle.updated == ["2", "1", "NaN"] and rest.closed.sum() == 11 + 10
    assert handle.timers[-1] == passed + 86_400_000 and not list(fold.handleExpiredTimer((5,), Now(passed), None))


def test_rows_of_one_batch_are_not_joined_with_their_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "GROUPS", 2)
    rows = [(a, f"d{a}", D, 1, "deposit", "", 0, 500 * (i + 1), 0, 0, -1) for i, a in enumerate([*range(40), None])]
    rows += [(a, f"b{a}", D + timedelta(3), 3, "buy", 'x"\\,é', 10, 400, 1, 0, -1) for a in range(40)] + [(3, "b3", D + timedelta(4), 3, "buy", "x", None, 400, 1, 0, -1)]
    events = spark.createDataFrame(rows, "account long, event_id string, day date, seq long, kind string, symbol string, shares long, amount long, fees long, step_milli long, expected long")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    found = state.fold_stream(stream, ["account"], ledger.ORDER, ledger.COLUMNS, ledger.SCHEMA, ledger.step, 9, "ledger-test", "event_id")
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, ledger.fold(events.dropna(subset=["account"])).collect()))


def test_events_of_a_line_are_made_without_a_call_a_row(spark):
    items = spark.createDataFrame([(1, 7, 1, 2.0, 20.0, "R", D), (1, 7, 2, 4.0, 20.0, "N", D)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date")
    orders = spark.createDataFrame([(1, 5, D, "P", 9.0, "4-x")], "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_totalprice double, o_orderpriority string")
    found = queries_ledger.events_from(items, orders, spark.createDataFrame([(7, "b")], "p_partkey long, p_brand string"))
    assert "lambda" not in plan(found)
    assert {(r.event_id, r.kind, r.day, r.expected) for r in found.collect()} == {
        ("T1-1", "sell", D, -1), ("T1-2", "buy", D, -1), ("X1-1", "delist", D + timedelta(120), -1), ("C1-2", "correct", D + timedelta(30), -1)}
