"""Running moments, bootstrap draws and confidence sets against numpy."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import models, moments, resamples


def panel(spark, y, x, asset="a", skip=()):
    day = datetime.date(2000, 1, 1)
    rows = [(asset, day + datetime.timedelta(days=t), None if t in skip else float(y[t]), *map(float, x[t])) for t in range(len(y))]
    return spark.createDataFrame(rows, "asset string, date date, xs double, " + ", ".join(f"x{k} double" for k in range(x.shape[1])))


def least_squares(x, y):
    design = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    sigma = math.sqrt(residual @ residual / (len(y) - design.shape[1]))
    se = sigma * np.sqrt(np.diag(np.linalg.inv(design.T @ design)))
    return beta, beta / se, sigma, 1 - residual @ residual / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("expanding", [False, True])
def test_regressions_of_many_series(spark, expanding):
    rng = np.random.default_rng(1)
    made = {}
    frames = []
    for asset in "ab":
        x = rng.normal(size=(90, 3)) * [1, 50, 0.01] + [5, 1000, 3]
        y = x @ [0.5, -0.02, 30] + rng.normal(size=90)
        made[asset] = x, y
        frames.append(panel(spark, y, x, asset))
    names = ["x0", "x1", "x2"]
    sums = moments.running(frames[0].unionByName(frames[1]), names, 30, expanding=expanding, by=["asset"])
    got = moments.regressions(sums, 3, ["asset", "date"]).collect()
    assert len(got) == 120
    for r in got:
        x, y = made[r.asset]
        t = (r.date - datetime.date(2000, 1, 1)).days
        past = slice(0 if expanding else t - 30, t)
        beta, tv, sigma, r2 = least_squares(x[past], y[past])
        assert [r.intercept, *r.slopes] == pytest.approx(beta.tolist(), rel=1e-6, abs=1e-6)
        assert r.t_values == pytest.approx(tv[1:].tolist(), rel=1e-6) and (r.sigma, r.r2) == pytest.approx((sigma, r2), rel=1e-7)
        assert r.forecast == pytest.approx(float(np.append(1, x[t]) @ beta), rel=1e-8) and r.n == len(y[past])


def test_subsets_are_means_of_regressions(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=50)
    names = [f"x{k}" for k in range(4)]
    specs = [("m", "mean", {}), ("all", "linear", {}), *[(f"k{k}", "subsets", {"k": k}) for k in (1, 2, 3)]]
    got = {(r.date, r.model): r.forecast for r in models.forecast(panel(spark, y, x), names, 20, specs).collect()}
    for t in range(20, 50):
        past, day = slice(t - 20, t), datetime.date(2000, 1, 1) + datetime.timedelta(days=t)
        one = lambda c: float(np.append(1, x[t, c]) @ least_squares(x[past][:, c], y[past])[0])  # noqa: B023, E731
        assert got[day, "m"] == pytest.approx(y[past].mean(), abs=1e-10) and got[day, "all"] == pytest.approx(one([0, 1, 2, 3]), abs=1e-8)
        for k in (1, 2, 3):
            assert got[day, f"k{k}"] == pytest.approx(np.mean([one(list(c)) for c in itertools.combinations(range(4), k)]), abs=1e-8)


@pytest.mark.parametrize("expanding", [False, True])
def test_ten_thousand_rows_in_chunks(spark, expanding):
    rng = np.random.default_rng(3)
    n = 10_000
    x, y = rng.normal(size=n) + 100, np.zeros(n)
    y = 0.3 * x + rng.normal(size=n)
    rows = spark.createDataFrame(list(zip(range(n), x.tolist(), y.tolist(), strict=True)), "id long, x double, xs double").repartition(6)
    plain = moments.running(rows, ["x"], 250, expanding=expanding, order="id")
    cut = moments.running(rows, ["x"], 250, expanding=expanding, order="id", chunk=F.floor(F.col("id") / 700))
    a, b = ({r.id: (r.n, r.slopes[0], r.forecast) for r in moments.regressions(m, 1, ["id"]).collect()} for m in (plain, cut))
    assert a.keys() == b.keys() == set(range(250, n))
    for t in (250, 251, 699, 700, 701, 5000, 9999):
        past = slice(0 if expanding else t - 250, t)
        slope = np.polyfit(x[past], y[past], 1)[0]
        for got in (a, b):
            assert got[t][0] == len(x[past]) and got[t][1] == pytest.approx(slope, rel=1e-7)
    assert max(abs(a[k][2] - b[k][2]) for k in a) < 1e-8


def test_nulls_and_dependent_predictors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2))
    x = np.column_stack([x[:, 0], 2 * x[:, 0] + 1, x[:, 1], np.full(40, 7.0)])  # the second depends on the first, the last is constant
    y = x[:, 0] - x[:, 2] + rng.normal(size=40) * 0.1
    got = moments.regressions(moments.running(panel(spark, y, x, skip={25}), [f"x{k}" for k in range(4)], 10), 4).collect()
    seen = {(r.date - datetime.date(2000, 1, 1)).days: r for r in got}
    assert set(seen) == set(range(10, 40)) - set(range(26, 36))  # windows with the null row are not full
    for t, r in seen.items():
        beta = least_squares(x[t - 10 : t][:, [0, 2]], y[t - 10 : t])[0]
        assert r.slopes == pytest.approx([beta[1], 0, beta[2], 0], abs=1e-6) and r.t_values[1] is None
    assert seen[25].actual is None and seen[25].forecast is not None


def drawn_rows(spark, n, draws, block, seed):
    rows = resamples.positions(spark.createDataFrame([(n,)], "n int"), draws, block, seed).orderBy("draw", "pos").collect()
    return np.array([r["at"] for r in rows]).reshape(draws, n)


def test_blocks_are_geometric_and_uniform_and_the_same_for_any_partitioning(spark):
    idx = drawn_rows(spark, 200, 400, 20, 2)
    assert idx.min() == 0 and idx.max() == 199
    assert (np.diff(idx, axis=1) % 200 != 1).mean() == pytest.approx(1 / 20 * 199 / 200, rel=0.06)
    assert np.bincount(idx.ravel(), minlength=200).std() / 400 < 0.3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = drawn_rows(spark, 200, 400, 20, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (idx == again).all() and (drawn_rows(spark, 3, 5, 50, 1) < 3).all()


def test_weighted_statistics_are_statistics_of_the_drawn_rows(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0.001, 0.02, 120), rng.normal(0.0005, 0.01, 120)
    day = datetime.date(2000, 1, 1)
    series = resamples.numbered(spark.createDataFrame([(day + datetime.timedelta(days=t), float(a[t]), float(b[t])) for t in range(120)], "date date, a double, b double"))
    places = resamples.positions(series.select("n"), 60, 10)
    got = resamples.drawn(series, resamples.weights(places), {"s": lambda w: resamples.weighted_sharpe("a", w), "g": lambda w: resamples.weighted_growth("b", w), "r2": lambda w: resamples.weighted_r2("a", "b", "b", w)})
    downs = {r.draw: r.drawdown for r in resamples.drawn_drawdowns(series, places, "a").collect()}
    idx = drawn_rows(spark, 120, 60, 10, resamples.SEED)
    for r in got.collect():
        x, y = a[idx[r.draw]], b[idx[r.draw]]
        assert r.s == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252)) and r.g == pytest.approx(np.exp(np.log1p(y).sum() * 252 / 120) - 1) and r.r2 == pytest.approx(0)
        wealth = np.cumprod(1 + x)
        assert downs[r.draw] == pytest.approx((wealth / np.maximum(np.maximum.accumulate(wealth), 1)).min() - 1)
    low, high = np.percentile([r.s for r in got.collect()], [2.5, 97.5])
    row = resamples.intervals(got, ["s"]).first()
    assert (row.statistic, row.lo, row.hi) == ("s", pytest.approx(low), pytest.approx(high))


def step_by_step(table, idx, names):
    """The confidence set one elimination after the other, resampling the differences each time."""
    alive, p, so_far = list(range(table.shape[1])), {}, 0.0
    while len(alive) > 1:
        d = table[:, alive] - table[:, alive].mean(axis=1, keepdims=True)
        centre, drawn = d.mean(axis=0), d[idx].mean(axis=1)
        sd = np.sqrt(np.maximum(drawn.var(axis=0, ddof=1), 1e-18))
        so_far = max(so_far, float((((drawn - centre) / sd).max(axis=1) >= (centre / sd).max()).mean()))
        worst = int((centre / sd).argmax())
        p[names[alive[worst]]] = so_far
        alive.pop(worst)
    return {**p, names[alive[0]]: 1.0}


def test_many_confidence_sets_equal_the_step_by_step_test(spark):
    rng = np.random.default_rng(6)
    day, rows, tables = datetime.date(2000, 1, 1), [], {}
    for s in range(40):
        n, m = 30 + s % 3, 2 + s % 9  # lengths and sizes differ
        base = rng.normal(size=n) ** 2
        table = np.column_stack([base + rng.normal(0.02 * k * (s % 4), 0.3, n) for k in range(m)])
        names = [f"m{k:02d}" for k in range(m)]
        tables[s] = table, names
        rows += [(s, names[k], day + datetime.timedelta(days=t), float(table[t, k])) for t in range(n) for k in range(m)]
        rows.append((s, "m00", day + datetime.timedelta(days=500), 9.0))  # a date that others lack
    losses = spark.createDataFrame(rows, "set int, model string, date date, loss double")
    got = {}
    for r in resamples.confidence_sets(losses, ["set"], 300).collect():
        got.setdefault(r.set, {})[r.model] = (r.p_value, r.mse)
    assert len(got) == 40
    draws = {n: drawn_rows(spark, n, 300, 2, 11) for n in (30, 31, 32)}
    for s, (table, names) in tables.items():
        want = step_by_step(table, draws[len(table)], names)
        assert {k: v[0] for k, v in got[s].items()} == pytest.approx(want, abs=1e-9), s
        assert [got[s][n][1] for n in names] == pytest.approx(table.mean(axis=0).tolist())


def test_confidence_set_without_groups_one_model_and_none(spark):
    rng = np.random.default_rng(7)
    day, base = datetime.date(2000, 1, 1), rng.normal(size=200) ** 2
    rows = [(m, day + datetime.timedelta(days=t), float(base[t] + off)) for m, off in (("good", 0.0), ("bad", 1.0)) for t in range(200)]
    rows = [(m, d, x + (0.1 * rng.normal() if m == "bad" else 0)) for m, d, x in rows]
    frame = spark.createDataFrame(rows, "model string, date date, loss double")
    p = {r.model: r.p_value for r in resamples.confidence_sets(frame, draws=300).collect()}
    assert p["good"] == 1.0 and p["bad"] < 0.05
    only = resamples.confidence_sets(frame.filter("model = 'good'"), draws=50).collect()
    assert [(r.model, r.p_value) for r in only] == [("good", 1.0)]
    assert resamples.confidence_sets(frame.limit(0), draws=50).count() == 0


@pytest.mark.parametrize("family", list(models.COPULAS))
def test_conditional_copulas_integrate_to_their_margin(family):
    """The mean chance of a rise over all ranks of the size is the chance at any size; and a derivative of the copula itself."""
    given, low, high = models.COPULAS[family]
    u = (np.arange(20_000) + 0.5) / 20_000
    for t in (low, low / 2, 0.3, high / 2, high):
        if family == "Clayton" and t <= 0:
            continue
        for p in (0.2, 0.5, 0.9):
            assert models.rises(given, u, p, t).mean() == pytest.approx(p, abs=5e-3)
    if family == "Clayton":
        c = lambda a, b: (a**-2.0 + b**-2.0 - 1) ** (-1 / 2.0)
        assert given(0.4, 0.7, 2.0) == pytest.approx((c(0.4 + 1e-6, 0.7) - c(0.4 - 1e-6, 0.7)) / 2e-6, abs=1e-6)
    if family == "Frank":
        c = lambda a, b: -math.log1p(math.expm1(-3 * a) * math.expm1(-3 * b) / math.expm1(-3)) / 3
        assert float(given(0.4, 0.7, 3.0)) == pytest.approx((c(0.4 + 1e-6, 0.7) - c(0.4 - 1e-6, 0.7)) / 2e-6, abs=1e-6)
        assert float(given(0.4, 0.7, 0)) == pytest.approx(0.7, abs=1e-6)
