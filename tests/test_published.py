"""Regressions on predictors that all assets share, against numpy."""

import datetime

import numpy as np

from quillon.operators import published

LAGGED = ["m", "m1", "m2", "m3", "m4"]


def tables(spark, assets=3, dates=60):
    rng = np.random.default_rng(7)
    days = [datetime.date(2000 + k // 12, k % 12 + 1, 28) for k in range(dates)]
    m = rng.normal(0.01, 0.05, dates)
    more = rng.normal(0.3, 0.1, (dates, 3))
    more[:, 2] = 2 * m + 1  # says nothing beside the market
    x = [[m[k], *[m[k - j] if k >= j else None for j in range(1, 5)], *more[k].tolist()] for k in range(dates)]
    y = rng.normal(0, 0.1, (assets, dates)) + m
    rets = [(a, days[k], None if (a, k) == (1, 20) or k == 0 else float(y[a, k])) for a in range(assets) for k in range(dates)]
    states = spark.createDataFrame([(d, *[None if v is None else float(v) for v in row]) for d, row in zip(days, x, strict=True)], "date date, " + ", ".join(f"{c} double" for c in [*LAGGED, "liquidity", "volatility", "tail"]))
    return spark.createDataFrame(rets, "asset int, date date, ret double"), states, days, {(a, d): r for a, d, r in rets}, x


def test_exposures_against_least_squares(spark):
    rets, states, days, y, x = tables(spark)

    def fit(a, k, places):
        own = np.array([y[a, d] for d in days[k - 36 : k]], dtype=float)
        z = np.column_stack([np.ones(36), *[[float(x[i][p]) for i in range(k - 36, k)] for p in places]])
        b = np.linalg.lstsq(z, own, rcond=None)[0]
        return b, 1 - ((own - z @ b) ** 2).sum() / ((own - own.mean()) ** 2).sum()

    want = {}
    for a in range(3):
        for k in range(40, len(days)):
            if all(y[a, d] is not None for d in days[k - 36 : k]):
                want[a, days[k]] = (1 - fit(a, k, [0])[1] / fit(a, k, range(5))[1], fit(a, k, [0, 5])[0][2], -fit(a, k, [0, 6])[0][2], 0.0)
    got = {(r.asset, r.date): (r.delay, r.liquidity, r.volatility, r.tail) for r in published.exposures(rets, states).collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert all(np.allclose(got[key], want[key], atol=1e-9) for key in want)


def test_returns_are_dealt_once_for_all_models(spark):
    rets, states, *_ = tables(spark, 2, 5)
    plan = published.exposures(rets, states)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1
