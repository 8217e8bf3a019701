import random

import numpy as np
import pytest

from panelweave.operators import order_stats


def series(spark, blocks=False):
    rng = random.Random(3)
    rows = []
    for key, n in (("a", 300), ("b", 40), ("c", 1), ("d", 70)):
        for i in range(n):
            x = None if rng.random() < .1 or key == "c" else rng.choice([rng.gauss(0, 1), 0.5, -2.0, float(i)])
            rows.append((key, i, x, i // 37))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key string, t long, x double, b long")


def past(rows, key, t, strict):
    return [x for k, s, x, _ in rows if k == key and x is not None and (s < t if strict else s <= t)]


@pytest.mark.parametrize("block,levels,base", [(None, 3, 32), ("b", 3, 32), (None, 2, 18), ("b", 4, 5)])
def test_expanding_statistics_equal_brute_force(spark, monkeypatch, block, levels, base):
    monkeypatch.setattr(order_stats, "BASE", base)
    rows, df = series(spark)
    out = order_stats.expanding_quantiles(df, "key", "t", "x", {"low": 0.02, "half": 0.5, "top": 1.0}, 5, levels, block)
    out = order_stats.expanding_rank(out, "key", "t", "x", "rank", 5, levels, block)
    got = {(r["key"], r["t"]): r for r in out.collect()}
    assert len(got) == len(rows)
    for key, t, x, _ in rows:
        before, upto = past(rows, key, t, True), past(rows, key, t, False)
        for name, p in (("low", 0.02), ("half", 0.5), ("top", 1.0)):
            want = np.quantile(before, p) if len(before) >= 5 else None
            assert got[key, t][name] == (pytest.approx(want, abs=1e-12) if want is not None else None)
        want = (sum(v < x for v in upto) + (sum(v == x for v in upto) + 1) / 2) / len(upto) if x is not None and len(upto) >= 5 else None
        assert got[key, t]["rank"] == (pytest.approx(want) if want is not None else None)


def test_no_row_holds_its_history(spark):
    _, df = series(spark)
    plan = order_stats.expanding_rank(order_stats.expanding_quantiles(df, "key", "t", "x", {"q": 0.5}), "key", "t", "x", "r")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in text and "percentile" not in text


def test_more_values_than_digits(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BASE", 2)
    _, df = series(spark)
    with pytest.raises(Exception, match="more levels"):
        order_stats.expanding_rank(df, "key", "t", "x", "r", levels=3).collect()
