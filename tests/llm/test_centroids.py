"""Clustering against brute force in Python integers, and the intervals of the screening."""

import hashlib
import math

import numpy as np
import pytest

from quillon.llm import centroids as op


def brute(rows, k=8, rounds=10, dimensions=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-op.BOUND, min(op.BOUND, x)) for x in v]) for i, v in kept]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[j]
    last = [near(v) for _, v in kept]
    total = sum(d for d, _ in last)
    by = {j: sum(d for d, o in last if o == j) for j in range(len(c))}
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_random_vectors_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 64) / 1024).tolist()) for i in range(300)]  # few values: many ties
    rows += [(7, rows[7][1]), (None, rows[0][1]), (None, rows[0][1]), (900, None), (901, [0.5] * 63), (902, [None] + [0.5] * 63), (903, [float("nan")] + [0.5] * 63), (904, [float("-inf")] + [0.5] * 63), (905, []), (906, [3e30] * 64), (907, [-3e30] + [0.0] * 63)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, q int").repartition(5)
    assert rows_of(op.cluster(frame)) == brute(rows)


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(1, [0.25] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert rows_of(op.cluster(frame)) == brute([(1, [0.25] * 64), (2, [0.5] * 64)])
    empty = op.cluster(frame.limit(0))
    assert empty.columns == op.cluster(frame).columns and empty.count() == 0


def test_other_parameters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    got = op.cluster(frame, k=3, rounds=2, dimensions=5, scale=64)
    as_floats = [(i, [x / 64 for x in v]) for i, v in kept]
    assert rows_of(got) == brute(as_floats, k=3, rounds=2, dimensions=5, scale=64)


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, 1 << 26])
def test_intervals_hold_and_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    x = rng.integers(-size, size + 1, (400, 64))
    c = np.concatenate([rng.integers(-size, size + 1, (20, 64)), x[:5], x[:5], x[:5] + 1])
    exact = np.array([op.squared(x, w[None]) for w in c]).T
    assert op.nearest(x, c).tolist() == exact.argmin(axis=1).tolist()  # argmin: the smallest number of equal ones
    may = op.shortlist(x, c)
    assert may[np.arange(len(x)), exact.argmin(axis=1)].all()
    assert (may & (exact == exact.min(axis=1)[:, None])).sum() == (exact == exact.min(axis=1)[:, None]).sum()  # no tied one is lost


def test_screening_decides_most_vectors():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-400, 400, (2000, 64)), rng.integers(-400, 400, (30, 64))
    assert (op.shortlist(x, c).sum(axis=1) == 1).mean() > 0.99
