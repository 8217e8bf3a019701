from datetime import date, timedelta

import pytest

from panelweave.operators import chart_lines, series

D = date(2022, 3, 1)


def path(corners, symbol):
    """Bars along straight lines between (bar, price) corners."""
    out = []
    for (a, p), (b, q) in zip(corners, corners[1:]):
        out += [float(p + (q - p) * (i - a) / (b - a)) for i in range(a, b)]
    out.append(float(corners[-1][1]))
    return [(symbol, D + timedelta(days=i), x, x + 1.0, x - 1.0, x) for i, x in enumerate(out)]


def lines(spark, *paths):
    bars = spark.createDataFrame([r for p in paths for r in p], "symbol string, trade_date date, open double, high double, low double, close double")
    found = chart_lines.trend_lines(bars, series.zigzag(bars, 3.0))
    return {(r["symbol"], r["kind"]): r for r in found.collect()}


RISING = [(0, 100), (12, 130), (20, 112), (32, 145), (40, 124), (52, 158), (60, 136), (70, 160)]


def test_rising_line_falling_line_and_channel(spark):
    falling = [(i, 300 - p) for i, p in RISING]
    got = lines(spark, path(RISING, "a"), path(falling, "b"))
    up, down = got["a", "up"], got["b", "down"]
    assert (up["i1"], up["i2"]) == (0, 60) and up["touches"] == 4 and not up["broken"] and up["end_pos"] == 70
    assert (down["i1"], down["i2"], down["touches"], down["broken"]) == (0, 60, 4, False)
    assert up["channel_offset"] == pytest.approx(-down["channel_offset"]) and up["channel_offset"] > 20


def test_a_broken_line_ends_at_the_break_and_goes_when_old(spark):
    fresh = RISING[:-1] + [(64, 142), (72, 118)]
    old = fresh + [(100, 122)]
    got = lines(spark, path(fresh, "a"), path(old, "b"))
    assert got["a", "up"]["broken"] and 64 < got["a", "up"]["end_pos"] <= 72
    assert ("b", "up") not in got or not got["b", "up"]["broken"] or 100 - got["b", "up"]["end_pos"] <= 20


def test_short_and_flat_series_have_no_lines(spark):
    assert lines(spark, path([(0, 100), (8, 120)], "a"), path([(0, 100), (60, 100)], "b")) == {}
