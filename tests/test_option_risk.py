import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import options

RATE = 0.02


def phi(x):
    return math.erfc(-x / math.sqrt(2)) / 2


def price(kind, s, k, t, v):
    d = (math.log(s / k) + (RATE + v * v / 2) * t) / (v * math.sqrt(t))
    e = d - v * math.sqrt(t)
    paid = k * math.exp(-RATE * t)
    return s * phi(d) - paid * phi(e) if kind == "call" else paid * phi(-e) - s * phi(-d)


def test_normal_distribution(spark):
    xs = [i / 17 for i in range(-700, 700)] + [0.0, 7.07106781186547, -40.0, 40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", options.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(phi(r["x"]), abs=2e-15) for r in got)


def test_volatility_gives_the_price_back(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        kind, s, t, v = rng.choice(["call", "put"]), rng.uniform(1, 5000), rng.uniform(0.01, 3), rng.choice([0.02, 0.1, 0.3, 0.9, 3.0]) * rng.uniform(0.8, 1.25)
        k = s * math.exp(rng.uniform(-1.5, 1.5) * v * math.sqrt(t))
        rows.append((kind, s, k, t, v, price(kind, s, k, t, v)))
    df = spark.createDataFrame(rows, "kind string, spot double, strike double, t double, v double, close double")
    out = options.with_risk(df, RATE).collect()
    known = [r for r in out if r["iv"] is not None]
    assert len(known) > 350
    for r in known:
        assert r["iv"] == pytest.approx(r["v"], rel=1e-6)
        d = (math.log(r["spot"] / r["strike"]) + (RATE + r["v"] ** 2 / 2) * r["t"]) / (r["v"] * math.sqrt(r["t"]))
        assert r["delta"] == pytest.approx(phi(d) - (r["kind"] == "put"), abs=1e-6)
    for r in out:
        paid = r["strike"] * math.exp(-RATE * r["t"])
        floor = max(r["spot"] - paid if r["kind"] == "call" else paid - r["spot"], 0)
        assert (r["iv"] is None) == (r["close"] < floor + options.TIME_VALUE * r["spot"])


def test_prices_without_a_volatility(spark):
    rows = [("call", 100.0, 100.0, 0.5, 0.0), ("call", 100.0, 100.0, 0.5, 101.0), ("put", 100.0, 150.0, 0.5, 40.0), ("call", 100.0, 100.0, 0.0, 5.0),
            ("call", None, 100.0, 0.5, 5.0), ("put", 100.0, 100.0, 0.5, None)]
    out = options.with_risk(spark.createDataFrame(rows, "kind string, spot double, strike double, t double, close double"), RATE).collect()
    assert all(r["iv"] is None and r["delta"] is None for r in out)


def test_contract_choice_and_exits(spark):
    rows = [("u", 1, e, k, d, c) for e, k, d, c in ((10, 90, -0.2, 1.0), (10, 95, -0.31, 2.0), (10, 96, -0.29, 3.0), (60, 95, -0.30, 4.0), (3, 95, -0.30, 5.0))]
    df = spark.createDataFrame(rows, "u string, i long, expiry int, strike int, delta double, close double")
    pick = lambda target, tolerance: [(r["expiry"], r["strike"]) for r in options.pick_by_delta(
        df, ["u", "i"], "expiry", F.col("expiry"), 5, 90, target, tolerance).collect()]
    assert pick(-0.3, 0.1) == [(10, 95)] and pick(-0.5, 0.1) == []  # the later expiry is not looked at
    bars = spark.createDataFrame([("u", i, c) for i, c in enumerate([9.0, 1.0, 2.0, 1.2, 1.6, 3.0, 7.0])], "u string, i long, close double")
    chosen = spark.createDataFrame([("u", 1), ("u", 5), ("u", 6)], "u string, i long")
    got = {r["i"]: r for r in options.exits(chosen, bars, ["u"], "i", F.lit(3), 2, {"half": 0.25, "double": 9.0}).collect()}
    assert set(got) == {1, 5}
    assert (got[1]["entry"], got[1]["held"], got[1]["at_end"], got[1]["half"], got[1]["double"]) == (2.0, pytest.approx(-0.2), 0.5, 0.5, 0.5)
    assert got[5]["entry"] == 7.0 and got[5]["at_end"] is None and got[5]["double"] is None
