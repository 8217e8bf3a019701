import random

import numpy as np
import pytest

from panelweave.operators import studies


def newton(x, y, penalty, rounds):
    z = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [penalty] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
    return w


def test_all_months_at_once_equal_one_fit_a_month(spark):
    rng = random.Random(3)
    rows = []
    for month in range(24):
        for s in range(12):
            a, b = rng.gauss(0, 2), rng.gauss(5, 1)
            label = None if month > 21 else float(rng.random() < 1 / (1 + np.exp(-(a - 0.5 * (b - 5)))))
            rows.append((f"s{s}", month, a, b, month + 2 if label is not None else None, label))
    df = spark.createDataFrame(rows, "symbol string, month long, a double, b double, known long, label double")
    got = {(r["symbol"], r["month"]): r["probability"] for r in studies.expanding_logistic(df, ["a", "b"], "label", "month", "known", least=60).collect()}
    for month in range(24):
        train = [r for r in rows if r[4] is not None and r[4] <= month]
        if len(train) < 60:
            assert not any(m == month for _, m in got)
            continue
        x, y = np.array([r[2:4] for r in train]), np.array([r[5] for r in train])
        mean, dev = x.mean(axis=0), x.std(axis=0, ddof=1)
        w = newton((x - mean) / dev, y, 1.0, 8)
        for r in rows:
            if r[1] == month:
                z = (np.array(r[2:4]) - mean) / dev
                assert got[r[0], month] == pytest.approx(1 / (1 + np.exp(-(w[0] + z @ w[1:]))), abs=1e-9)
    hits = np.mean([(got[r[0], r[1]] > 0.5) == (r[5] == 1) for r in rows if (r[0], r[1]) in got and r[5] is not None])
    assert hits > 0.7


def test_later_outcomes_change_nothing_before(spark):
    rng = random.Random(5)
    rows = [(f"s{s}", m, rng.gauss(0, 1), m + 1, float(rng.random() < 0.5)) for m in range(10) for s in range(20)]
    frame = lambda rs: spark.createDataFrame(rs, "symbol string, month long, a double, known long, label double")
    changed = [r if r[1] < 7 else (*r[:4], 1 - r[4]) for r in rows]
    early = lambda rs: sorted((r["symbol"], r["month"], r["probability"]) for r in studies.expanding_logistic(
        frame(rs), ["a"], "label", "month", "known", least=40, rounds=4).filter("month < 8").collect())
    assert early(rows) == early(changed)


def test_family_choice(spark):
    """By definition, period by period."""
    rng = random.Random(1)
    families = [(k, f, rng.gauss({"a": 0.02, "b": -0.02, "c": 0.0}[f], 0.03)) for k in range(1, 40) for f in "abc" if f != "c" or k > 5]
    states = {k: rng.choice(["up", "down", None]) for k in range(1, 40)}
    out = studies.select_families(spark.createDataFrame(families, "k long, family string, value double"),
                                  spark.createDataFrame(list(states.items()), "k long, state string"), ("state",), 6, 4)
    got = {(r["k"], r["rule"]): r["value"] for r in out.collect()}
    mean = lambda v: sum(v) / len(v) if v else None
    for k in range(1, 40):
        here = {f: v for j, f, v in families if j == k}
        known = [j for j in range(1, k - 1)]
        same = [j for j in known if states[j] == states[k] and states[k] is not None]
        bases = {"all": None, "expanding": known, "trailing": [j for j in known if j >= k - 5], "by_state": same if len(same) >= 6 else known}
        for rule, base in bases.items():
            good = {f: mean([v for j, g, v in families if g == f and base is not None and j in base]) for f in here}
            chosen = [f for f in here if len(known) >= 6 and good[f] is not None and good[f] > 0] or list(here)
            assert got[k, rule] == pytest.approx(mean([here[f] for f in chosen])), (k, rule)
