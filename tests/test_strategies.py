"""Strategy tables against one strategy at a time in numpy."""

import datetime
import math

import numpy as np
import pytest

from quillon.operators import strategy_tables as T

DATES = [datetime.date(2000 + k // 12, k % 12 + 1, 28) for k in range(90)]
SPANS = (("early", "2001-01-01", "2001-12-31"), ("late", "2004-06-01", "2006-01-31"), ("none", "1990-01-01", "1990-12-31"))


def switching(forecast, mkt, rf, cost=0.001):
    equity = forecast > 0
    ret = np.where(equity, mkt, rf)
    switched = np.append(False, equity[1:] != equity[:-1])
    wealth = np.cumprod((1 + ret) * np.where(switched, 1 - cost, 1))
    return {"n": len(ret), "TW": wealth[-1], "AV": ret.mean() * 1200, "SD": ret.std(ddof=1) * math.sqrt(12) * 100, "SR": (ret - rf).mean() / ret.std(ddof=1), "MDD": (1 - wealth / np.maximum.accumulate(wealth)).max(), "switches": int(switched.sum())}


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    mkt, rf = rng.normal(0.006, 0.05, 90), np.full(90, 0.002)
    series = {(m, k): rng.normal(0.002, 0.01, 90) for m in ("a", "b", "mean") for k in (1, 3)}
    rows = [(m, k, d, float(x)) for (m, k), v in series.items() for d, x in zip(DATES, v, strict=True)] + [("a", 1, datetime.date(2030, 1, 1), None)]
    forecasts = spark.createDataFrame(rows, "model string, k int, date date, forecast double").repartition(5)
    market = spark.createDataFrame(list(zip(DATES, mkt.tolist(), rf.tolist(), (mkt - rf).tolist(), strict=True)), "date date, mkt double, rf double, xs double")
    return mkt, rf, series, forecasts, market


def test_figures_of_all_cells(made):
    mkt, rf, series, forecasts, market = made
    got = {(r.model, r.k, r.span): r.asDict() for r in T.table(T.paths(forecasts, market, SPANS)).collect()}
    assert len(got) == 6 * 3  # no row for a span without dates
    for (model, k), f in series.items():
        for span, a, b in (("all", "1900-01-01", "2100-01-01"), *SPANS[:2]):
            own = np.array([a <= d.isoformat() <= b for d in DATES])
            for name, want in switching(f[own], mkt[own], rf[own]).items():
                assert got[model, k, span][name] == pytest.approx(want, rel=1e-9), (model, k, span, name)


def test_shape_has_rows_that_are_not_computed(made):
    _, _, _, forecasts, market = made
    got = T.shaped(T.table(T.paths(forecasts, market)), ["b", "GARCH-M model", "a"], [1, 3]).orderBy("place").collect()
    assert [r.model for r in got] == ["b", "GARCH-M model", "a"] and got[0].asDict().keys() >= {"k1_TW", "k3_MDD"}
    assert got[1].k1_TW is None and got[0].k3_SD is not None


def test_momentum_is_decided_before_the_month(made, spark):
    mkt, *_, market = made
    got = {(r.model, r.date): r.forecast for r in T.momentum_forecasts(market, [3]).collect()}
    assert got["Momentum 3-month", DATES[2]] is None
    for t in range(3, 90):
        assert got["Momentum 3-month", DATES[t]] == pytest.approx(np.prod(1 + mkt[t - 3 : t]) - 1)


def test_errors_and_sets(made, spark):
    mkt, rf, series, forecasts, market = made
    actuals = market.selectExpr("date", "xs as actual")
    y = mkt - rf
    for r in T.errors(forecasts, actuals, "mean").collect():
        e, b = y - series[r.model, r.k], y - series["mean", r.k]
        want = (90, 100 * (1 - (e @ e) / (b @ b)), 100 * (1 - np.abs(e).sum() / np.abs(b).sum()), 100 * (e @ e) / 90, 100 * np.abs(e).mean())
        assert (r.n, r.r2_squared, r.r2_absolute, r.mse, r.mae) == pytest.approx(want)
    sets = T.loss_sets(forecasts, actuals, draws=200).collect()
    assert len(sets) == 3 * 2 * 2 and all(0 <= r.p_value <= 1 for r in sets)
    for k in (1, 3):
        for kind in ("squared", "absolute"):
            own = [r for r in sets if r.k == k and r.kind == kind]
            assert sorted(r.model for r in own) == ["a", "b", "mean"] and max(r.p_value for r in own) == 1.0
            loss = {m: (np.square if kind == "squared" else np.abs)(y - series[m, k]).mean() for m in ("a", "b", "mean")}
            assert {r.model: r.mse for r in own} == pytest.approx(loss)


def test_a_path_of_cash_has_no_sharpe_ratio(spark):
    market = spark.createDataFrame([(d, 0.01 * k, 0.002, 0.0) for k, d in enumerate(DATES[:12])], "date date, mkt double, rf double, xs double")
    forecasts = market.selectExpr("'never' as model", "1 as k", "date", "-1.0D as forecast")
    row = T.table(T.paths(forecasts, market)).first()
    assert row.SR is None and row.SD == pytest.approx(0) and row.switches == 0 and row.MDD == pytest.approx(0) and row.TW == pytest.approx(1.002**12)
