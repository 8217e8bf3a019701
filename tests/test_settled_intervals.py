from datetime import date, timedelta

from pyspark.sql import functions as F

from panelweave.operators import intervals

D = date(2021, 1, 4)


def day(n):
    return D + timedelta(days=n)


def settled(spark, rows, evidence):
    calendar = spark.createDataFrame([(day(i), i + 1) for i in range(300) if (D + timedelta(days=i)).weekday() < 5], "trade_date date, idx long")
    spans = spark.createDataFrame([(s, st, day(a), None if b is None else day(b), None if low is None else day(low)) for s, st, a, b, low in rows],
                                  "symbol string, status string, start_date date, end_date date, low date")
    seen = spark.createDataFrame([(s, day(n), "b" in kind, "l" in kind) for s, days, kind in evidence for n in days], "symbol string, trade_date date, beyond boolean, at_limit boolean")
    out = intervals.settle(spans, seen, calendar, F.to_date(F.lit(day(7))))
    return sorted((r["symbol"], r["action"], (r["new_start"] - D).days if r["new_start"] else None, (r["new_end"] - D).days if r["new_end"] else None) for r in out.collect())


def test_each_decision(spark):
    rows = [(s, "ST", 70, 140, None) for s in "abcdefg"] + [("h", "ST", 70, None, None), ("i", "DELISTING", 70, 140, None)]
    evidence = [("a", [77, 78], "b"), ("a", [84, 85, 87], "l"),  # support after the breaks alone
                ("b", [100, 101], "b"), ("b", [77, 78, 80, 84], "l"),  # before them alone
                ("c", [100], "b"), ("c", [77, 78, 80, 105, 106, 107], "l"),  # strong on both sides
                ("d", [100], "b"), ("d", [101, 102], "bl"),  # breaks on the limit are no support
                ("e", [100], "b"), ("e", [80], "l"), ("e", [105, 106], "l"),  # weak on both: the larger number
                ("f", [77, 78], "l"), ("f", [140, 150], "b"),  # breaks past the end
                ("h", [77], "b"), ("h", [210, 211, 212], "l"), ("i", [77], "b")]
    assert settled(spark, rows, evidence) == [
        ("a", "start_moved", 79, 140), ("b", "end_moved", 70, 100), ("c", "split", 70, 100), ("c", "split", 101, 140), ("d", "dropped", None, None),
        ("e", "start_moved", 101, 140), ("f", None, 70, 140), ("g", None, 70, 140), ("h", "start_moved", 78, None), ("i", None, 70, 140)]


def test_an_uncertain_start_moves_back(spark):
    rows = [(s, "*ST", 70, 140, low) for s, low in (("a", 28), ("b", 28), ("c", 28), ("d", 0), ("e", 28), ("f", None))]
    evidence = [("a", [35, 42], "l"),  # no break: to the first session after low
                ("b", [35], "l"), ("b", [42], "b"), ("b", [49], "l"),  # to the session after the last break
                ("c", [35], "l"), ("c", [42], "b"),  # no support after it
                ("d", [3], "l"), ("d", [10], "l"),  # at the earliest the start of the data
                ("e", [35, 36, 37], "l"), ("e", [100], "b"),  # support before the start counts for what follows
                ("f", [35], "l")]
    assert settled(spark, rows, evidence) == [
        ("a", "start_extended", 29, 140), ("b", "start_extended", 43, 140), ("c", None, 70, 140), ("d", "start_extended", 7, 140),
        ("e", "start_extended,end_moved", 29, 100), ("f", None, 70, 140)]
