"""Registered forecasts and subsets against estimators written another way."""

import itertools
import math
import statistics as st

import numpy as np
import pytest

from quillon.operators import models
from quillon.plans import registry
from quillon.plans.estimators import PREDICTORS, WINDOW, frame

QUERIES, _ = registry.load()
FOLDER = "/root/testdata/sf0.001"
NORMAL = st.NormalDist()
phi = np.vectorize(NORMAL.cdf)


@pytest.fixture(scope="module")
def data(spark):
    rows = frame(spark, FOLDER).orderBy("date").select("date", "xs", *PREDICTORS).toPandas()
    return rows["date"].tolist(), rows[PREDICTORS].to_numpy(float), rows["xs"].to_numpy(float)


def ascend(loss, theta, steps=400):
    """A minimum by Newton steps with numeric derivatives, halved until they help."""
    theta = np.array(theta, dtype=float)
    scale = 1e-4 * np.maximum(np.abs(theta), 1)
    for _ in range(steps):
        n = len(theta)
        shift = np.diag(scale)
        grad = np.array([(loss(theta + s) - loss(theta - s)) / (2 * s.sum()) for s in shift])
        hess = np.array([[(loss(theta + a + b) - loss(theta + a - b) - loss(theta - a + b) + loss(theta - a - b)) / (4 * a.sum() * b.sum()) for b in shift] for a in shift])
        move = np.linalg.solve(hess + 1e-9 * np.eye(n) * max(1.0, np.abs(np.diag(hess)).max()), grad)
        size, now = 1.0, loss(theta)
        while size > 1e-8 and loss(theta - size * move) > now:
            size /= 2
        theta = theta - size * move
        if size * np.abs(move).max() < 1e-9:
            break
    return theta


def probit(x, up):
    """Maximum likelihood on standardized columns, given back on the columns as they are."""
    mean, sd = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0)
    z = np.column_stack([x[:, 0], (x[:, 1:] - mean) / sd])

    def loss(b):
        p = np.clip(phi(z @ b), 1e-12, 1 - 1e-12)
        return -np.log(np.where(up, p, 1 - p)).sum()

    b = ascend(loss, np.zeros(z.shape[1]), 30)
    return np.append(b[0] - (b[1:] * mean / sd).sum(), b[1:] / sd)


def auc(scores, up):
    return np.mean([(a > b) + 0.5 * (a == b) for a in scores[up] for b in scores[~up]])


def test_subset_selection(spark, data):
    _, x, y = data
    x, y = x[:WINDOW], y[:WINDOW]
    got = QUERIES["subset_selection"](spark, FOLDER).collect()
    assert len(got) == 2
    best = {}
    for c in map(list, itertools.combinations(range(4), 2)):
        design = np.column_stack([np.ones(WINDOW), x[:, c]])
        linear = design @ np.linalg.pinv(design) @ y
        wide = np.column_stack([design, np.abs(y)])
        sign = wide @ probit(wide, y > 0)
        for kind, scores in (("sign", sign), ("linear", linear)):
            best.setdefault(kind, []).append((auc(scores, y > 0), [PREDICTORS[k] for k in c]))
    for row, kind in zip(got, ("sign", "linear"), strict=True):
        top = max(best[kind], key=lambda p: p[0])
        assert row.auc == pytest.approx(top[0], abs=2e-6 if kind == "linear" else 0.02)
        if kind == "linear":
            assert row.subset == ", ".join(top[1])


def test_decomposed_forecasts_by_integration(spark, data):
    """Forecasts of some origins from a probit and a Weibull model fitted by other means, integrated over a grid of sizes."""
    dates, x, y = data
    rows = QUERIES["model_forecasts"](spark, FOLDER).collect()
    got = {(r.model, r.date): r.forecast for r in rows}
    assert {m for m, _ in got} == {"mean", "linear", "subsets 1", "subsets 2", "subsets 3", "decomposed", *(f"copula {c}" for c in models.COPULAS)}
    assert len(rows) == 10 * (len(y) - WINDOW)
    for t in (WINDOW, len(y) - 1):
        past = slice(t - WINDOW, t)
        size = np.abs(y[past])
        design, now = np.column_stack([np.ones(WINDOW), x[past]]), np.append(1.0, x[t])
        fit = models.fit_magnitude(design, size)
        mean = math.exp(min(max(now @ fit.beta, -20), 5))
        lam = mean / math.gamma(1 + 1 / fit.kappa)
        m = (np.arange(200_000) + 0.5) / 200_000 * lam * 60 ** (1 / fit.kappa)
        density = fit.kappa / lam * (m / lam) ** (fit.kappa - 1) * np.exp(-((m / lam) ** fit.kappa)) * (m[1] - m[0])
        assert density.sum() == pytest.approx(1, abs=5e-3)
        b = models.probit(np.column_stack([design, size]), (y[past] > 0).astype(float))
        chance = phi(np.clip(now @ b[:-1] + b[-1] * m[::50], -8, 8))
        want = (np.interp(m, m[::50], 2 * chance - 1) * m * density).sum()
        assert got["decomposed", dates[t]] == pytest.approx(want, abs=3e-4)
        # no copula moves the forecast further than the whole size, nor to another mean when sign and size do not depend
        marginal = phi(np.clip(now @ models.probit(design, (y[past] > 0).astype(float)), -8, 8))
        for c in models.COPULAS:
            assert abs(got[f"copula {c}", dates[t]]) <= mean * (1 + 1e-6)
        free = (2 * float(marginal) - 1) * mean
        assert min(got[f"copula {c}", dates[t]] for c in models.COPULAS) - 0.02 <= free <= max(got[f"copula {c}", dates[t]] for c in models.COPULAS) + 0.02


def test_probit_reaches_the_maximum(data):
    _, x, y = data
    design = np.column_stack([np.ones(len(y)), x[:, :2]])
    ours, other = models.probit(design, (y > 0).astype(float)), probit(design, y > 0)
    loss = lambda b: -np.log(np.clip(np.where(y > 0, phi(design @ b), 1 - phi(design @ b)), 1e-12, 1)).sum()
    assert loss(ours) <= loss(other) + 1e-4
